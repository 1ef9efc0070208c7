"""File sources and sinks.

Raw splits are CSV; processed splits, reports, run records and models are
written with Spark's own writers (parallel, one file per task), partitioned by
``split`` / ``label`` so readers prune partitions.  Paths may be any Hadoop
URI (``s3a://``, ``abfss://``, ``hdfs://``) — S11 is just a path argument.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.utils import AnalysisException

from tallyho import spec
from tallyho.operators.clean import clean_split
from tallyho.operators.metrics import latest_run as _latest_run
from tallyho.operators.select import require_columns
from tallyho.operators.stats import join_small
from tallyho.sources.tables import nan_to_null


def _normalise_raw(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Rename raw headers, map every missing spelling to NULL, cast doubles; ``keep`` columns stay as they are."""
    cols = [F.col(c) for c in keep]
    for c in df.columns:
        if c in keep:
            continue
        name = spec.RAW_COLUMN_NAMES.get(c, c)
        v = F.col(f"`{c}`")
        v = F.when(F.trim(v).isin(spec.MISSING_TOKENS) | v.isNull(), F.lit(None).cast("string")).otherwise(v)
        if name in spec.RAW_DOUBLE_COLUMNS:
            v = F.trim(v).try_cast("double")
            v = F.when(F.isnan(v), F.lit(None).cast("double")).otherwise(v)
        cols.append(v.alias(name))
    return df.select(*cols)


def with_file_order(scan: DataFrame, name: str = "_row") -> DataFrame:
    """A file scan with each row's position in its files, which are ordered by name, from 0 on.

    Spark packs files into partitions by size, so a row's partition says nothing of its file.  A block of a file (its path
    and the block's start, from the scan's metadata) is read by one task in order: a first pass, which reads no data
    column, counts the rows of each block, the running sum over the blocks in order gives where each one begins, and
    inside a block the row number of the scan counts on.
    """
    seen = F.monotonically_increasing_id()
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), seen.alias("_seen")]
    blocks = scan.select(*place).groupBy("_file", "_block").agg(F.min("_seen").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = W.orderBy("_file", "_block").rowsBetween(W.unboundedPreceding, -1)  # the table has one row a block
    blocks = blocks.select("_file", "_block", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begin"))
    rows = join_small(scan.select("*", *place), blocks, ["_file", "_block"])
    return rows.withColumn(name, F.col("_begin") + F.col("_seen") - F.col("_first")).drop("_file", "_block", "_seen", "_first", "_begin")


def read_raw_splits(spark: SparkSession, input_dir: str, splits=tuple(spec.SPLITS)) -> DataFrame:
    """All raw split CSVs as one table with ``split`` and file-order ``_row`` columns
    (text values, no schema inference).

    A split is a file or a folder of files named ``<split>.csv``; ``_row`` counts its rows from 0, files in the order of
    their names.  A missing file raises ``FileNotFoundError``.
    """
    frames = []
    for s in splits:
        path = f"{input_dir.rstrip('/')}/{s}.csv"
        try:
            raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
            raw.schema  # resolve now so a missing file fails here
        except AnalysisException as e:
            raise FileNotFoundError(f"Dataset file not found: {path}") from e
        frames.append(_normalise_raw(with_file_order(raw), ["_row"]).withColumn("split", F.lit(s)))
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def scan_split(spark: SparkSession, input_dir: str, splits=tuple(spec.SPLITS)) -> DataFrame:
    """Read raw splits and run the cleaning chain per split."""
    return clean_split(read_raw_splits(spark, input_dir, splits), by="split")


def processed_type(name: str) -> str:
    """Type of a processed column by its name."""
    if name in (*spec.RAW_DOUBLE_COLUMNS, spec.AVG_SCORE):
        return "double"
    if name in ("row_ix", "student_id", "_row", spec.TARGET) or (name in spec.NUMERIC_FEATURES):
        return "bigint"
    return "string"


def scan_processed(spark: SparkSession, path: str, splits=None, fmt: str = "parquet") -> DataFrame:
    """Processed splits (partitioned by ``split``); requires the label column.

    NaN becomes NULL.  CSV columns get their types from ``spec`` by name, without a
    second pass over the data; other columns stay text.
    """
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("inferSchema", False)
    df = reader.load(path)
    if fmt == "csv":
        df = df.select(*[F.col(c).cast(processed_type(c)).alias(c) for c in df.columns])
    df = nan_to_null(df)
    require_columns(df, [spec.TARGET], "processed data")
    if splits:
        df = df.where(F.col("split").isin(list(splits)))
    return df


def write_splits(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Overwrite processed splits, one directory per split."""
    w = df.write.mode("overwrite").partitionBy("split").format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    w.save(path)


def write_json_report(report: DataFrame, path: str) -> None:
    """Write a one-row report DataFrame as one JSON document."""
    report.select(F.to_json(F.struct(*[F.col(c) for c in report.columns])).alias("value")) \
        .coalesce(1).write.mode("overwrite").text(path)


def write_model_card(spark: SparkSession, card: dict, path: str) -> None:
    """Model metadata as one JSON document."""
    spark.createDataFrame([(json.dumps(card, default=float),)], "value string") \
        .coalesce(1).write.mode("overwrite").text(path)


def read_model_card(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def save_model(model: PipelineModel, path: str) -> None:
    """Persist the fitted pipeline."""
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def write_run_metrics(runs: DataFrame, path: str) -> None:
    """Add benchmark records, one folder per run: its ``label`` and ``timestamp``.

    The folder is the run's commit marker: a job that is run again replaces its own record, and those of other runs stay.
    """
    (runs.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("label", "timestamp").parquet(path))


def latest_run(spark: SparkSession, path: str, label: str | None = None) -> DataFrame:
    """Latest record per label from the run table; raises when a label has none."""
    runs = spark.read.parquet(path)
    if label is not None:
        runs = runs.where(F.col("label") == label)
        if runs.limit(1).count() == 0:
            raise FileNotFoundError(f"No benchmark runs found for label '{label}' in {path}")
    return _latest_run(runs)
