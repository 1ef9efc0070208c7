"""Derived score, rule labelling, failed-condition rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyho import spec
from tallyho.operators.select import require_columns


def avg_score(df: DataFrame, name: str = spec.AVG_SCORE) -> DataFrame:
    """``avg_test_score = (math + reading + science) / 3.0``; no-op if present (P10)."""
    if name in df.columns:
        return df
    require_columns(df, spec.SCORE_COLUMNS, "average test score")
    m, r, s = (F.col(c) for c in spec.SCORE_COLUMNS)
    return df.withColumn(name, (m + r + s) / F.lit(3.0))


def label_rule(df: DataFrame, keep_avg: bool = False) -> DataFrame:
    """``pass_fail = 1`` iff ``gpa >= 2.0 AND avg >= 73``; a missing input gives 0."""
    require_columns(df, ["gpa"] + spec.SCORE_COLUMNS, "labelling")
    had_avg = spec.AVG_SCORE in df.columns
    x = avg_score(df)
    cond = (F.col("gpa") >= F.lit(spec.GPA_THRESHOLD)) & (
        F.col(spec.AVG_SCORE) >= F.lit(spec.AVG_SCORE_THRESHOLD))
    x = x.withColumn(spec.TARGET, F.coalesce(cond, F.lit(False)).cast("int"))
    if not had_avg and not keep_avg:
        x = x.drop(spec.AVG_SCORE)
    return x


def failed_conditions(df: DataFrame, label_col: str | None = "prediction",
                      name: str = "failed_conditions") -> DataFrame:
    """Likely failed conditions as ``map<string, boolean>``.

    attendance: attendance_rate < 0.85; test_score: study_hours < 2.0;
    gpa: attendance_rate < 0.80 or study_hours < 1.5; when none holds, both
    test_score and attendance are set.  Only for rows predicted 0 when
    ``label_col`` is given (others get NULL).
    """
    att, study = F.col("attendance_rate"), F.col("study_hours")
    a = F.coalesce(att < F.lit(spec.ATTENDANCE_FAIL_BELOW), F.lit(False))
    t = F.coalesce(study < F.lit(spec.STUDY_FAIL_BELOW), F.lit(False))
    g = F.coalesce((att < F.lit(spec.GPA_RISK_ATTENDANCE_BELOW))
                   | (study < F.lit(spec.GPA_RISK_STUDY_BELOW)), F.lit(False))
    none = ~(a | t | g)
    m = F.create_map(F.lit("gpa"), g, F.lit("test_score"), t | none,
                     F.lit("attendance"), a | none)
    if label_col is not None:
        m = F.when(F.col(label_col) == 0, m)
    return df.withColumn(name, m)
