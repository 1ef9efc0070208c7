"""Prompt building and completion parsing as table jobs.

(scored rows) -> one prompt row each; (completion rows) -> parsed guidance.
The model call itself is outside the plan.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyho import spec
from tallyho.functions.scalar import fixed, or_na, yes_no
from tallyho.operators.contract import recommendation_violations
from tallyho.operators.label import failed_conditions


def java_format(template: str) -> tuple[str, list[str]]:
    """Turn a ``{name}`` template into a ``%s`` format string and the name order."""
    fmt, names = [], []
    for literal, field, _spec, _conv in string.Formatter().parse(template):
        fmt.append(literal.replace("%", "%%"))
        if field is not None:
            fmt.append("%s")
            names.append(field)
    return "".join(fmt), names


def fill_template(template: str, values: dict[str, Column]) -> Column:
    fmt, names = java_format(template)
    return F.format_string(fmt, *[values[n] for n in names])


def profile_text(note: str) -> Column:
    """Student profile block (13 lines) from the row's feature columns."""
    att = F.coalesce(F.col("attendance_rate").cast("double"), F.lit(0.0)) * F.lit(100.0)
    values = {
        "age": or_na(F.col("age")), "grade": or_na(F.col("grade")),
        "attendance_pct": fixed(att, 1),
        "attendance_note": F.lit(note),
        "study_hours": fixed(F.coalesce(F.col("study_hours").cast("double"), F.lit(0.0)), 1),
        "extracurricular": yes_no("extracurricular"), "part_time_job": yes_no("part_time_job"),
        "parent_support": yes_no("parent_support"), "internet_access": yes_no("internet_access"),
        "free_time": or_na(F.col("free_time")), "go_out": or_na(F.col("go_out")),
        "parental_education": or_na(F.col("parental_education")),
        "school_type": or_na(F.col("school_type")), "locale": or_na(F.col("locale")),
        "ses_quartile": or_na(F.col("ses_quartile")),
    }
    return fill_template(spec.PROFILE_BLOCK, values)


def conditions_text(conditions: Column) -> Column:
    """Failed conditions -> bullet text; none -> the general sentence."""
    items = F.array_compact(F.array(*[
        F.when(F.coalesce(conditions[k], F.lit(False)), F.lit(t)) for k, t in spec.CONDITION_TEXTS.items()]))
    return F.when(F.coalesce(F.size(items), F.lit(0)) <= 0, F.lit(spec.NO_CONDITION_TEXT)).otherwise(
        F.concat(F.lit(spec.CONDITION_HEADER), F.array_join(items, "\n- ")))


def factors_text(factors: Column) -> Column:
    """Attribution list -> bullet text under a header; empty or missing -> '' (T4)."""
    lines = F.transform(factors, lambda f: F.format_string(
        "- %s: %s impact (%s) - %s", f["feature"], F.coalesce(f["direction"], F.lit("negative")),
        fixed(F.coalesce(f["impact"], F.lit(0.0)), 3, sign=True),
        F.coalesce(f["description"], F.when(F.coalesce(f["impact"], F.lit(0.0)) >= 0,
                                             F.lit(spec.IMPACT_POSITIVE))
                   .otherwise(F.lit(spec.IMPACT_NEGATIVE)))))
    return F.when(F.coalesce(F.size(factors), F.lit(0)) <= 0, F.lit("")).otherwise(
        F.concat(F.lit(spec.FACTOR_HEADER + "\n"), F.array_join(lines, "\n")))


def build_prompts(df: DataFrame, label_col: str = "prediction", factors_col: str | None = None,
                  conditions_col: str | None = None, keep: Sequence[str] = ("row_ix",)) -> DataFrame:
    """One prompt per row, routed by predicted label.

    Label 0 -> at-risk prompt with failed conditions (computed by the P19
    rules when ``conditions_col`` is not given); label 1 -> good-standing
    prompt.  Adds ``route``, ``system_prompt``, ``prompt``, ``max_tokens``,
    ``temperature``.
    """
    x = df
    if conditions_col is None:
        x = failed_conditions(x, label_col=None, name="_conditions")
        conditions_col = "_conditions"
    factors = factors_text(F.col(factors_col)) if factors_col else F.lit("")
    at_risk = fill_template(spec.AT_RISK_TEMPLATE, {
        "profile": profile_text(spec.AT_RISK_ATTENDANCE_NOTE),
        "conditions": conditions_text(F.col(conditions_col)), "factors": factors})
    good = fill_template(spec.GOOD_STANDING_TEMPLATE, {
        "profile": profile_text(spec.GOOD_STANDING_ATTENDANCE_NOTE), "factors": factors})
    risk = F.col(label_col) == 0
    return x.select(
        *[F.col(k) for k in keep if k in x.columns],
        F.when(risk, F.lit("at_risk")).otherwise(F.lit("good_standing")).alias("route"),
        F.when(risk, F.lit(spec.AT_RISK_SYSTEM)).otherwise(F.lit(spec.GOOD_STANDING_SYSTEM)).alias("system_prompt"),
        F.when(risk, at_risk).otherwise(good).alias("prompt"),
        F.when(risk, F.lit(spec.AT_RISK_MAX_TOKENS)).otherwise(F.lit(spec.GOOD_STANDING_MAX_TOKENS)).alias("max_tokens"),
        F.lit(spec.TEMPERATURE).alias("temperature"))


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def unwrap_envelope(raw: Column) -> Column:
    """Chat envelope -> text: choices[0].message.content | choices[0].text |
    generated_text | text | the raw text itself (T6b)."""
    return F.coalesce(F.get_json_object(raw, "$.choices[0].message.content"),
                      F.get_json_object(raw, "$.choices[0].text"),
                      F.get_json_object(raw, "$.generated_text"),
                      F.get_json_object(raw, "$.text"), raw)


def extract_json_text(content: Column) -> Column:
    """Text inside a ```json fence, else inside the first fence, else all."""
    return (F.when(content.contains("```json"),
                   _strip(F.split_part(F.split_part(content, F.lit("```json"), F.lit(2)), F.lit("```"), F.lit(1))))
            .when(content.contains("```"), _strip(F.split_part(content, F.lit("```"), F.lit(2))))
            .otherwise(content))


def _fallback(values: dict) -> Column:
    return F.array(F.struct(*[F.lit(values[k]).cast(spec.RECOMMENDATION[k].dataType).alias(k)
                              for k in spec.RECOMMENDATION_KEYS]))


def parse_completions(df: DataFrame, text_col: str = "completion", envelope: bool = False) -> DataFrame:
    """Parse model completions into guidance rows.

    Adds ``status`` (``ok`` | ``fallback_invalid_json`` | ``fallback_error``),
    ``recommendations`` (array of recommendation structs; items missing any
    of the five keys are dropped) and ``summary`` (default text when absent).
    Text that is not JSON gets fallback A; an empty text, or JSON without a
    ``recommendations`` list, gets fallback B.
    """
    # columns of their own: what refers to one does not compute it again
    steps = [f"_completion_{c}" for c in ("raw", "content", "inner", "parsed", "valid")]
    raw, content, inner, parsed, valid = map(F.col, steps)
    x = df
    for name, value in zip(steps, (
            F.col(text_col), _strip(unwrap_envelope(raw) if envelope else raw), extract_json_text(content),
            F.from_json(inner, "struct<recommendations: array<string>, summary: string>"), F.try_parse_json(inner).isNotNull()),
            strict=True):
        x = x.withColumn(name, value)
    items = parsed["recommendations"]
    keys = F.array(*[F.lit(k) for k in spec.RECOMMENDATION_KEYS])
    kept = F.filter(items, lambda it: F.coalesce(F.size(F.array_except(keys, F.json_object_keys(it))) == 0, F.lit(False)))
    recs = F.transform(kept, lambda it: F.from_json(it, spec.RECOMMENDATION))
    status = (F.when(F.coalesce(F.length(content), F.lit(0)) == 0, F.lit("fallback_error"))
              .when(~valid, F.lit("fallback_invalid_json"))
              .when(items.isNull(), F.lit("fallback_error"))
              .otherwise(F.lit("ok")))
    x = x.withColumn("status", status)
    st = F.col("status")
    return x.withColumn("recommendations", F.when(st == "ok", recs)
                        .when(st == "fallback_invalid_json", _fallback(spec.FALLBACK_INVALID_JSON))
                        .otherwise(_fallback(spec.FALLBACK_OTHER))).withColumn(
        "summary", F.when(st == "ok", F.coalesce(parsed["summary"], F.lit(spec.DEFAULT_SUMMARY)))
        .when(st == "fallback_invalid_json", F.lit(spec.FALLBACK_INVALID_JSON["summary"]))
        .otherwise(F.lit(spec.FALLBACK_OTHER["summary"]))).drop(*steps)


def explode_recommendations(df: DataFrame, id_cols: Sequence[str]) -> DataFrame:
    """One row per recommendation with its contract violations."""
    # the outer form, since a plain explode brings a filter on the array that is pushed down and parses every text once more
    x = df.select(*id_cols, "status", F.posexplode_outer("recommendations").alias("_pos", "_r")).where(F.col("_pos").isNotNull())
    return x.select(*id_cols, "status", (F.col("_pos") + 1).alias("position"), "_r.*",
                    recommendation_violations(F.col("_r")).alias("violations"))
