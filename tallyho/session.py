"""Spark session and shared-storage helpers."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "tallyho") -> SparkSession:
    """Return the active session, or build a local one configured for tests/bench.

    On a cluster the session already exists (spark-submit / notebook) and its
    configuration wins; we only fill in settings that are unset.
    """
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster's setting (or a directory already set on the context) is always
    used when present.  Only a ``local`` master without any setting (tests) gets
    a private scratch folder; on a cluster a machine-local folder would lose
    rows, so an unset folder raises there.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        configured = tempfile.mkdtemp(prefix="tallyho-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint folder for materialised tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: write the DataFrame as a parquet table under the shared
    checkpoint folder (``spark.checkpoint.dir``) and read it back.

    One job computes and writes the data (``DataFrame.checkpoint`` would run the
    plan twice unless cached); later passes and task retries read the written
    table instead of re-running upstream stages.  Never a local checkpoint.
    """
    return _write_table(df)[0]


#: Spark's setting by which an action deletes its shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Bytes of a generated method beyond which Spark evaluates a stage's expressions by methods of their own: the JVM does not compile
#: longer methods at all, so a long projection in one method, as of the cleaning chain, is interpreted row by row.
HUGE_METHOD, JIT_BYTES = "spark.sql.codegen.hugeMethodLimit", "8000"


def _write_table(df: DataFrame) -> tuple[DataFrame, str]:
    """The written table is all that is read later, so the shuffle files behind it go at once."""
    spark = df.sparkSession
    path = scratch_path(spark, f"tables/{uuid.uuid4().hex}")
    own = {CLEANUP: "true", HUGE_METHOD: JIT_BYTES}
    before = {key: spark.conf.get(key, None) for key in own}
    for key, value in own.items():
        spark.conf.set(key, value)
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)
    return spark.read.schema(df.schema).parquet(path), path


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a written table through the file system that holds it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Written intermediate tables of one job, deleted when the job is done.

    ``with Scratch(spark) as scratch: t = scratch.table(df)`` writes ``df`` under
    the shared checkpoint folder.  Leaving the block deletes the tables, so a
    result that is returned lazily must not read them (use ``materialize``).
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: list[tuple[DataFrame, str]] = []

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *exc) -> None:
        for _, path in self.paths:
            delete_path(self.spark, path)
        self.paths = []

    def table(self, df: DataFrame) -> DataFrame:
        written = _write_table(df)
        self.paths.append(written)
        return written[0]

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later step reads."""
        for t in tables:
            for entry in [e for e in self.paths if e[0] is t]:
                delete_path(self.spark, entry[1])
                self.paths.remove(entry)
