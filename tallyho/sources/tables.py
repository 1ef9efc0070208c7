"""Driver tables and the ``students`` fixture view."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]

# The student fixture (FIXTURES.md §1).  Plain SQL accepted unchanged by Spark
# and DuckDB; ``{orders}`` is replaced by a table reference.
STUDENTS_SQL = """
WITH base AS (
  SELECT o_orderkey AS k, o_custkey AS c, o_totalprice AS p, o_orderpriority AS pr, 0 AS dup FROM {orders}
  UNION ALL
  SELECT o_orderkey AS k, o_custkey AS c, o_totalprice AS p, o_orderpriority AS pr, 1 AS dup FROM {orders} WHERE o_orderkey % 211 = 0
)
SELECT
  CAST(k * 2 + dup AS BIGINT) AS row_ix,
  CAST(k AS BIGINT) AS student_id,
  CASE WHEN k % 10 < 8 THEN 'train' WHEN k % 10 = 8 THEN 'validation' ELSE 'test' END AS split,
  CASE WHEN k % 97 = 0 THEN 'n/a' WHEN k % 71 = 0 THEN '15.7' WHEN k % 103 = 0 THEN NULL
       ELSE CAST(13 + k % 7 AS STRING) END AS age_raw,
  CAST(9 + k % 4 AS BIGINT) AS grade,
  CAST(CASE WHEN c % 83 = 0 THEN NULL ELSE 1 + c % 4 END AS BIGINT) AS ses_quartile,
  CAST(CASE WHEN k % 9 = 0 THEN 0 ELSE 1 END AS BIGINT) AS internet_access,
  CAST(c % 2 AS BIGINT) AS extracurricular,
  CAST(CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS part_time_job,
  CAST(CASE WHEN c % 3 = 0 THEN 0 ELSE 1 END AS BIGINT) AS parent_support,
  CAST(CASE WHEN k % 7 = 0 THEN 1 ELSE 0 END AS BIGINT) AS romantic,
  CAST(1 + k % 6 AS BIGINT) AS free_time,
  CAST(c % 6 AS BIGINT) AS go_out,
  CASE WHEN k % 53 = 0 THEN 'Unknown' WHEN k % 59 = 0 THEN NULL WHEN c % 4 = 0 THEN '<HS'
       WHEN c % 4 = 1 THEN 'HS' WHEN c % 4 = 2 THEN 'SomeCollege' ELSE 'Bachelors+' END AS parental_education,
  CASE WHEN k % 3 = 0 THEN 'Private' ELSE 'Public' END AS school_type,
  CASE WHEN pr = '1-URGENT' THEN 'City' WHEN pr = '2-HIGH' THEN 'Rural' WHEN pr = '3-MEDIUM' THEN 'Town'
       ELSE 'Suburban' END AS locale,
  CASE WHEN c % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
  CONCAT('R', CAST(c % 5 AS STRING)) AS race,
  CASE WHEN k % 101 = 0 THEN NULL ELSE (70 + c % 33) / CAST(100 AS DOUBLE) END AS attendance_rate,
  (k % 46) / CAST(10 AS DOUBLE) AS study_hours,
  CASE WHEN k % 107 = 0 THEN NULL ELSE CAST(p AS DOUBLE) / CAST(120000 AS DOUBLE) END AS gpa,
  CAST(50 AS DOUBLE) + CAST(p AS DOUBLE) / CAST(10000 AS DOUBLE) AS test_math,
  CAST(45 + c % 50 AS DOUBLE) AS test_reading,
  CASE WHEN k % 89 = 0 THEN NULL ELSE CAST(40 + k % 60 AS DOUBLE) END AS test_science
FROM base
"""


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def nan_to_null(df: DataFrame) -> DataFrame:
    """Normalise NaN to NULL in every float/double column (one missing marker)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.col(f"`{f.name}`")
            cols.append(F.when(F.isnan(c), F.lit(None).cast(f.dataType)).otherwise(c).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one driver table; NaN is normalised to NULL at the scan."""
    return nan_to_null(spark.read.parquet(table_path(sf_dir, name)))


def students(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The student fixture over ``orders`` (row_ix is given by the keys)."""
    view = "tallyho_orders_" + format(abs(hash(table_path(sf_dir, "orders"))), "x")
    read_table(spark, sf_dir, "orders").createOrReplaceTempView(view)
    return spark.sql(STUDENTS_SQL.format(orders=view))


def students_oracle_cte() -> str:
    """The same fixture as a DuckDB CTE body over the ``orders`` view."""
    return STUDENTS_SQL.format(orders="orders")
