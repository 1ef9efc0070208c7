"""Row contracts: required fields, types and ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyho import spec


def _checks(df: DataFrame, field: str, typ: str, lo, hi, required: bool) -> list[Column]:
    if field not in df.columns:
        return [F.lit(f"{field}:missing")] if required else []
    dtype = df.schema[field].dataType
    c = F.col(f"`{field}`")
    out = []
    if required:
        out.append(F.when(c.isNull(), F.lit(f"{field}:missing")))
    if typ in ("int", "float"):
        if isinstance(dtype, T.StringType):
            num = F.trim(c).try_cast("double")
            out.append(F.when(c.isNotNull() & num.isNull(), F.lit(f"{field}:type")))
        else:
            num = c.cast("double")
        if typ == "int" and not isinstance(dtype, T.IntegralType):
            out.append(F.when(num.isNotNull() & (num != F.floor(num)), F.lit(f"{field}:type")))
        if lo is not None:
            out.append(F.when(num < F.lit(lo), F.lit(f"{field}:below")))
        if hi is not None:
            out.append(F.when(num > F.lit(hi), F.lit(f"{field}:above")))
    elif typ == "str" and not isinstance(dtype, T.StringType):
        out.append(F.when(c.isNotNull(), F.lit(f"{field}:type")))
    return out


def validate_contract(df: DataFrame, fields: dict = spec.CONTRACT_FIELDS,
                      optional: dict = spec.OPTIONAL_CONTRACT_FIELDS,
                      name: str = "violations") -> DataFrame:
    """Add ``violations`` (array of ``field:code`` in field order) and ``is_valid``.

    Codes: ``missing`` (required field NULL or absent), ``type`` (not a
    number, or a fraction for an integer field), ``below`` / ``above`` (range).
    Categorical strings are not checked against a domain and extra columns are
    ignored.  Pure projection: no shuffle.
    """
    checks = []
    for f, (typ, lo, hi) in fields.items():
        checks += _checks(df, f, typ, lo, hi, True)
    for f, (typ, lo, hi) in optional.items():
        checks += _checks(df, f, typ, lo, hi, False)
    v = F.array_compact(F.array(*checks)) if checks else F.array().cast("array<string>")
    return df.withColumn(name, v).withColumn("is_valid", F.size(F.col(name)) == 0)


def split_contract(df: DataFrame, **kw) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) rows after ``validate_contract``."""
    checked = validate_contract(df, **kw)
    return checked.where(F.col("is_valid")), checked.where(~F.col("is_valid"))


def recommendation_violations(rec: Column) -> Column:
    """Contract of one recommendation: priority 1..5, the four texts present."""
    pr = rec["priority"]
    checks = [F.when(pr.isNull(), F.lit("priority:missing")),
              F.when(pr < 1, F.lit("priority:below")), F.when(pr > 5, F.lit("priority:above"))]
    for k in spec.RECOMMENDATION_KEYS[1:]:
        checks.append(F.when(rec[k].isNull(), F.lit(f"{k}:missing")))
    return F.array_compact(F.array(*checks))
