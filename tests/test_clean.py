"""Cleaning operators on hand-made frames: ties, all-null columns, NaN, invalid modes."""

import pytest
from pyspark.sql import functions as F

from tallyho.operators import clean
from tallyho.sources.tables import nan_to_null


def test_mode_fill_ties_smallest_and_truncates(spark):
    df = spark.createDataFrame([(1, "3"), (2, "2"), (3, "n/a"), (4, "2"), (5, "3"), (6, "-2.7")],
                               "row_ix long, age_raw string")
    out = {r.row_ix: r.age for r in clean.coerce_types(df, ["age"]).collect()}
    # counts: 3 -> 2, 2 -> 2 (tie -> smallest = 2); unparsable filled; -2.7 truncates to -2
    assert out == {1: 3, 2: 2, 3: 2, 4: 2, 5: 3, 6: -2}


def test_all_null_column_fills_zero(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "row_ix long, grade string")
    assert [r.grade for r in clean.coerce_types(df, ["grade"]).orderBy("row_ix").collect()] == [0, 0]


def test_mode_per_group(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", None), (3, "b", 5.0), (4, "b", None), (5, "b", 5.0)],
                               "row_ix long, split string, grade double")
    got = {r.row_ix: r.grade for r in clean.coerce_types(df, ["grade"], by="split").collect()}
    assert got == {1: 1, 2: 1, 3: 5, 4: 5, 5: 5}


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(1, 5.0), (2, -1.0), (3, None), (4, 2.5)], "row_ix long, gpa double")
    got = {r.row_ix: r.gpa for r in clean.clip_ranges(df).collect()}
    assert got == {1: 4.0, 2: 0.0, 3: None, 4: 2.5}


def test_clip_report_counts_before_clipping(spark):
    df = spark.createDataFrame([(5.0,), (-1.0,), (4.5,), (None,)], "gpa double")
    r = clean.clip_report(df).where(F.col("column") == "gpa").first()
    assert (r.n_below, r.n_above) == (1, 2)


def test_invalid_category_that_is_the_mode_stays(spark):
    df = spark.createDataFrame([(1, "X"), (2, "X"), (3, "Public"), (4, None)], "row_ix long, school_type string")
    got = {r.row_ix: r.school_type for r in clean.repair_domain(df).collect()}
    assert got == {1: "X", 2: "X", 3: "Public", 4: "X"}
    got2 = {r.row_ix: r.school_type for r in clean.repair_domain(df, valid_only=True).collect()}
    assert got2 == {1: "Public", 2: "Public", 3: "Public", 4: "Public"}


def test_no_mode_uses_first_domain_value(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "row_ix long, locale string")
    assert {r.locale for r in clean.repair_domain(df).collect()} == {"Suburban"}


def test_nan_becomes_null_at_scan(spark):
    df = spark.createDataFrame([(1, float("nan")), (2, 3.0)], "row_ix long, gpa double")
    got = {r.row_ix: r.gpa for r in nan_to_null(df).collect()}
    assert got == {1: None, 2: 3.0}


def test_fill_mean_median(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, 2.0), (4, 10.0)], "row_ix long, x double")
    assert {r.row_ix: r.x for r in clean.fill_mean(df, ["x"]).collect()}[2] == pytest.approx(13 / 3)
    assert {r.row_ix: r.x for r in clean.fill_median(df, ["x"]).collect()}[2] == 2.0


def test_dedup_first_and_report(spark):
    df = spark.createDataFrame([(3, "a", None), (1, "a", None), (2, "b", 1.0), (4, "b", 1.0), (5, "c", 2.0)],
                               "row_ix long, k string, v double")
    kept = sorted(r.row_ix for r in clean.dedup_first(df).collect())
    assert kept == [1, 2, 5]
    rep = clean.duplicate_report(df).first()
    assert (rep.n_rows, rep.n_distinct, rep.n_duplicates) == (5, 3, 2)


def test_null_census_nonzero_only(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, 1.0, None), (3, None, "c")], "row_ix long, x double, y string")
    got = {r.column: r.n_null for r in clean.null_census(df).collect()}
    assert got == {"x": 2, "y": 1}


def test_clean_split_equals_step_by_step(spark):
    from tests.conftest import SF001
    from tallyho.sources.tables import students
    s = students(spark, SF001)
    fused = clean.clean_split(s, by="split")
    steps = clean.drop_missing(clean.repair_domain(clean.clip_ranges(clean.coerce_types(s, by="split")),
                                                   by="split"))
    assert sorted(map(tuple, fused.collect())) == sorted(map(tuple, steps.select(*fused.columns).collect()))
