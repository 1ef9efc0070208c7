"""User-level jobs (Q1-Q6): each composes operators into one Spark plan per
output and writes with Spark's writers.  Nothing row-level passes the driver;
only one-row aggregate reports and small model-metric tables are read back."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyho import spec
from tallyho.operators import clean, label, metrics, ordered, profile, select
from tallyho.operators.contract import validate_contract
from tallyho.operators.models import explain as explain_rows, model_card, score, train_suite
from tallyho.operators.prompts import build_prompts
from tallyho.operators.stats import join_groups
from tallyho.session import materialize
from tallyho.sources import files


def prepare(spark: SparkSession, input_dir: str, output_dir: str,
            head_limits: dict | None = None, probe_rows: int = spec.PROBE_ROWS,
            fmt: str = "parquet") -> dict[str, DataFrame]:
    """Q1: raw splits -> clean -> (first N per split) -> label -> dedup -> write;
    probe = exact seeded sample of the processed test split.

    Every row is kept unless ``head_limits`` names a limit per split (such as
    ``spec.HEAD_LIMITS``).

    Returns the quality reports (label distribution, condition breakdown,
    missing census, duplicates, IQR outliers) as DataFrames.
    """
    cleaned = files.scan_split(spark, input_dir)
    order = "row_ix" if "row_ix" in cleaned.columns else "_row"
    limited = ordered.head_rows(cleaned, head_limits, by="split", order=[order]) if head_limits else cleaned
    if order == "row_ix":
        limited = limited.drop("_row")
    labelled = materialize(label.label_rule(limited))
    reports = {
        "label_distribution": profile.label_distribution(labelled, by="split"),
        "condition_breakdown": profile.condition_breakdown(labelled, by="split"),
        "null_census": clean.null_census(labelled, by="split"),
        "duplicates": clean.duplicate_report(labelled, by="split", exclude=("row_ix", "_row")),
    }
    deduped = clean.dedup_first(labelled, order=order)
    reports["iqr_outliers"] = profile.iqr_outliers(deduped, by="split")
    out = deduped.drop("_row")
    files.write_splits(out, f"{output_dir}/splits", fmt)
    processed = files.scan_processed(spark, f"{output_dir}/splits", fmt=fmt)
    probe = select.sample_n(processed.where(F.col("split") == "test"), probe_rows,
                            key=[c for c in ("row_ix", "student_id") if c in processed.columns]
                            or processed.columns)
    probe.write.mode("overwrite").format(fmt).save(f"{output_dir}/probe")
    return reports


def profile_report(spark: SparkSession, processed_dir: str, output_dir: str, split: str = "train",
                   fmt: str = "parquet") -> dict[str, DataFrame]:
    """Q2: processed split -> class profiles, histograms, densities, region rate,
    threshold profile (all over every row), an exact sample of ``spec.SCATTER_ROWS`` rows
    for plots (``scatter_sample``), report JSON."""
    df = files.scan_processed(spark, processed_dir, [split], fmt)
    df = label.avg_score(df)
    scatter = select.sample_n(df, spec.SCATTER_ROWS, key=[c for c in ("row_ix", "student_id")
                                                          if c in df.columns] or df.columns)
    out = {
        "class_profile": profile.class_profile(df),
        "gpa_histogram": profile.histogram(df, "gpa", by=spec.TARGET, density=True),
        "avg_histogram": profile.histogram(df, spec.AVG_SCORE, by=spec.TARGET, density=True),
        "gpa_kde": profile.kde(df, "gpa"),
        "avg_kde": profile.kde(df, spec.AVG_SCORE),
        "region_rate": profile.region_rate(df),
        "scatter_sample": scatter,
        "threshold_profile": profile.threshold_profile(df),
        "dataset_report": profile.dataset_report(df.drop(spec.AVG_SCORE)),
    }
    for v in spec.THRESHOLDS:
        out[f"{v}_histogram"] = profile.histogram(df, v)
    tp = out["threshold_profile"].select(F.struct("*").alias("s")).agg(
        F.collect_list("s").alias("variables"))   # three rows: bounded
    report = join_groups(out["dataset_report"], tp, []).withColumns({
        "gpa_threshold": F.lit(spec.GPA_THRESHOLD),
        "avg_test_score_threshold": F.lit(spec.AVG_SCORE_THRESHOLD),
        "attendance_rate_threshold": F.lit(spec.ATTENDANCE_THRESHOLD)})
    files.write_json_report(report, f"{output_dir}/summary_report")
    return out


def train(spark: SparkSession, processed_dir: str, model_dir: str, small: bool = False,
          fmt: str = "parquet", fit_rows: int | None = None):
    """Q3: fit all candidates, select by validation F1, save pipeline + card.

    ``fit_rows`` bounds the labelled train rows that the fits read (an exact seeded
    sample); None fits on all.  Validation and test always use every row."""
    df = materialize(select.select_features(files.scan_processed(spark, processed_dir, fmt=fmt)
                                            .withColumnRenamed(spec.TARGET, "_y"))
                     .withColumnRenamed("_y", spec.TARGET))
    tr, va, te = (df.where(F.col("split") == s) for s in spec.SPLITS)
    if fit_rows is not None:
        tr = materialize(select.sample_n(tr, fit_rows, key=[c for c in ("row_ix", "student_id") if c in tr.columns]
                                         or tr.columns))
    result = train_suite(tr, va, te, small=small)
    best = result.models[result.best]
    files.save_model(best, f"{model_dir}/model")
    n_slots = len(best.transform(tr.limit(1)).first()["features"])
    card = model_card(result, n_slots)
    files.write_model_card(spark, card, f"{model_dir}/metadata")
    return result, card


def score_explain(model: PipelineModel, requests: DataFrame, reference: DataFrame) -> DataFrame:
    """Q4 batch: contract -> score -> failed conditions -> attributions -> prompts.

    Works for logistic models (exact linear attributions)."""
    checked = validate_contract(requests).where(F.col("is_valid"))
    scored = score(model, checked)
    scored = label.failed_conditions(scored, label_col="prediction")
    drop = [c for c in scored.columns if c.endswith(("__idx", "__ohe")) or c.startswith("_num_")
            or c in ("features", "rawPrediction", "probability")]
    explained = explain_rows(model, scored.drop(*drop), reference)
    return build_prompts(explained, label_col="prediction", factors_col="top_factors",
                         conditions_col="failed_conditions",
                         keep=("row_ix", "pass_prob", "prediction", "failed_conditions", "top_factors"))


def run_report(log: DataFrame, run_label: str, output_dir: str | None = None,
               truth: DataFrame | None = None, key: str = "request_id") -> DataFrame:
    """Q5: request log (+ optional truth by key) -> one run record, appended to
    the run table when ``output_dir`` is given."""
    x = log.withColumn("label", F.lit(run_label))
    if truth is not None:
        x = metrics.align_predictions(x, truth, key)
    has_y = "y_true" in x.columns and "y_pred" in x.columns
    rec = metrics.run_metrics(x, label="label", latency="latency_ms", ts="ts",
                              error=F.col("status") != F.lit("ok"),
                              y_true="y_true" if has_y else None, y_pred="y_pred" if has_y else None)
    if output_dir:
        files.write_run_metrics(rec, output_dir)
    return rec


def compare(spark: SparkSession, runs_dir: str, base_label: str = "local", other_label: str = "aws",
            base_run: str | None = None, other_run: str | None = None) -> DataFrame:
    """Q6: two runs side by side with differences and verdicts: the named run stamps, else the latest of each label."""
    return metrics.compare_runs(spark.read.parquet(runs_dir), base_label, other_label,
                                base_run=base_run, other_run=other_run)


__all__ = ["prepare", "profile_report", "train", "score_explain", "run_report", "compare"]
