"""Attribution roll-up and top factors per row.

Both work inside each row on arrays, so they need no shuffle at all: the
slot -> base map is a fixed, small list known when the model is fitted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyho import spec
from tallyho.functions.scalar import impact_direction


def rollup_attributions(df: DataFrame, array_col: str, slot_base: Sequence[int],
                        base_names: Sequence[str], name: str = "attributions") -> DataFrame:
    """Mean contribution per base feature from per-slot contributions.

    ``slot_base[i]`` is the base index of slot ``i``.  Produces
    ``array<struct<ix int, feature string, impact double>>`` in base order.
    """
    arr = F.col(array_col)
    items = []
    for b, base in enumerate(base_names):
        slots = [i for i, sb in enumerate(slot_base) if sb == b]
        if not slots:
            continue
        total = None
        for i in slots:
            term = arr[i].cast("double")
            total = term if total is None else total + term
        items.append(F.struct(F.lit(b).alias("ix"), F.lit(base).alias("feature"),
                              (total / F.lit(float(len(slots)))).alias("impact")))
    return df.withColumn(name, F.array(*items))


def _by_abs_impact(left: Column, right: Column) -> Column:
    la, ra = F.abs(left["impact"]), F.abs(right["impact"])
    return (F.when(la > ra, F.lit(-1)).when(la < ra, F.lit(1))
            .when(left["ix"] < right["ix"], F.lit(-1)).when(left["ix"] > right["ix"], F.lit(1))
            .otherwise(F.lit(0)))


def top_factors(df: DataFrame, col: str = "attributions", k: int = spec.TOP_FACTORS,
                name: str = "top_factors") -> DataFrame:
    """Top ``k`` bases by absolute impact, descending, stable by base order.

    Produces ``array<struct<feature, impact, direction, description>>``.
    """
    ranked = F.slice(F.array_sort(F.col(col), _by_abs_impact), 1, k)
    shaped = F.transform(ranked, lambda a: F.struct(
        a["feature"].alias("feature"), a["impact"].alias("impact"),
        impact_direction(a["impact"]).alias("direction"),
        F.when(a["impact"] >= 0, F.lit(spec.IMPACT_POSITIVE))
        .otherwise(F.lit(spec.IMPACT_NEGATIVE)).alias("description")))
    return df.withColumn(name, shaped)


def explode_factors(df: DataFrame, id_cols: Sequence[str], col: str = "top_factors") -> DataFrame:
    """One row per (row, rank) factor; rank starts at 1."""
    x = df.select(*id_cols, F.posexplode(F.col(col)).alias("_pos", "_f"))
    return x.select(*id_cols, (F.col("_pos") + 1).alias("rank"), "_f.*")
