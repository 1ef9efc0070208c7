"""Corpus pipeline: quality filter, line dedup, near-duplicate removal, source mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and reread as the next one's ``docs``.  All stages but the last return the
columns of ``documents``; ``n_chars`` follows the text.

Defined results: a null text is scored as an empty one, has no lines and no shingles, and
is not taken by the mix (it has no words).  Rows that repeat an id are one document to the
near-duplicate stage, which keeps one of them; rows with a null id are kept there.  An
empty table passes through every stage.  Further columns pass through as they are, whatever
their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyho.llm import jaccard_join, line_dedup, mixing, packing, quality
from tallyho.llm._join import fits
from tallyho.session import materialize

ORACLE_SQL = None
#: Words of a shingle and least similarity of near duplicates; the op5 query has a contract of its own.
NEAR_WIDTH, NEAR_NUM, NEAR_DEN = 5, 80, 100


DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")


def _keeps_columns(stage: Callable) -> Callable:
    """The stage with further columns under names that no operator uses, and back under their own afterwards."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        safe = {c if c in DOCUMENT else f"__extra{i}": c for i, c in enumerate(docs.columns)}
        out = stage(spark, docs.toDF(*safe), sf_dir)
        return out.toDF(*[safe[c] for c in out.columns])

    return run


def _like(docs: DataFrame, out: DataFrame) -> DataFrame:
    """The columns of ``docs``, ``n_chars`` (where there is one) counted anew."""
    n_chars = F.length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return out.select(*[n_chars.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


@_keeps_columns
def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model, fitted on the labels, does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels)
    scored = quality.score(docs.select(*[F.col(c).alias(f"d_{c}") for c in docs.columns]), model, "d_text")
    return scored.where("predicted = 1").select(*[F.col(f"d_{c}").alias(c) for c in docs.columns])


@_keeps_columns
def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without the boilerplate lines of its source."""
    return _like(docs, line_dedup.drop_boilerplate(docs, "source", "text"))


@_keeps_columns
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id, of each group linked by 5-gram Jaccard similarity of 0.8 or more."""
    groups = jaccard_join.jaccard_groups(docs, width=NEAR_WIDTH, num=NEAR_NUM, den=NEAR_DEN)
    gone = materialize(groups.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct())
    side = F.broadcast(gone) if fits(gone) else gone  # a counted list of ids; beyond the bound the texts are shuffled
    kept = docs.join(side, docs["doc_id"] == side["__gone"], "left_anti")
    if groups.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept
    return kept.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(kept.where("doc_id is null"))


@_keeps_columns
def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, whole or in part, once or twice, that give the sources their target shares."""
    return _like(docs, mixing.mixed_documents(docs))


def curve_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens, alike documents together."""
    import public_tokenizers
    packed = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id",
                         "offset")


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", source_mix),
    ("packing", curve_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
