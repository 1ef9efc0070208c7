"""Operator 8, mixing sources to target weights by Sainte-Lague apportionment (DataFrame functions only).

Sizes are words.  Targets: the sources share ``total`` times all words by weight,
no source above ``max_repeat`` times its own size, the excess going to the others by
weight.  The mix is dealt in blocks of ``block_words`` words: blocks go to sources
by highest quotients target / (2 * seats - 1), then inside each source to its
shards in the same way, giving an integer quota per shard.  A shard is a stream of
whole documents in seeded order, cut into equal blocks; a quota of q from n blocks
takes every block q // n times and a seeded cyclic run of q % n blocks once more,
so that only the documents at the ends of a run are taken in part.

Defined results
* Every input row is a document and is returned once, also repeated rows.
* A null or empty text has size 0 and is never taken.
* A null source is a source of its own and stands last.
* A document is taken ``max_repeat`` times at most.  Reruns agree: order and
  selection are functions of ids, sizes and the seed.
* Columns of the input pass through; ``size``, ``source_size``, ``target``, ``taken`` and
  ``spans`` replace columns of these names.  Empty input gives empty output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyho.llm._join import attach
from tallyho.session import materialize

WEIGHTS = (3, 1, 2)
TOTAL = 1.5
MAX_REPEAT = 2
BLOCK_WORDS = 16
#: Documents of a shard; a source has SHARDS shards at most and larger ones beyond that.
SHARD_DOCS = 512
SHARDS = 65_536
SEED = 20_240
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\f\r"


def word_count(text: Column) -> Column:
    """Number of words; each word is replaced by one letter and the blanks go."""
    bare = F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x"), BLANKS, "")
    return F.length(bare).cast("long")


def source_targets(sizes: DataFrame, weights=WEIGHTS, total: float = TOTAL,
                   max_repeat: float = MAX_REPEAT) -> DataFrame:
    """(source, source_size, n_docs, target) from a table with one row per source.

    In ascending order of cap / weight the level that the uncapped sources share,
    (total - caps so far) / (weights from here on), rises while sources are capped and
    falls afterwards, so its maximum is the final level.
    """
    order = W.orderBy(F.col("source").isNull(), "source")
    by_ratio = W.orderBy("ratio", "rn").rowsBetween(W.unboundedPreceding, -1)
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("rn") - 1) % len(weights) + 1).cast("int"))
    before = lambda c: F.coalesce(F.sum(c).over(by_ratio), F.lit(0.0))
    s = (sizes.withColumn("rn", F.row_number().over(order)).withColumn("w", w)
         .withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
         .withColumn("ratio", F.col("cap") / F.col("w"))
         .withColumn("goal", F.sum("source_size").over(everything) * F.lit(float(total)))
         .withColumn("all_w", F.sum("w").over(everything)))
    level = (F.col("goal") - before("cap")) / (F.col("all_w") - before("w"))
    s = s.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return s.select("source", "source_size", "n_docs",
                    F.least("cap", F.col("level") * F.col("w")).alias("target"))


def apportion(df: DataFrame, part: list[str], key: list[str], share: str, seats: str, out: str) -> DataFrame:
    """Sainte-Lague: deal ``seats`` (equal within ``part``) to rows by highest quotients share / (2 k - 1).

    With k parties the final divisor differs from the exact one by a factor of
    1 +- k / (2 seats), so a party's seats lie within x * k / (2 seats) + 1/2 of its exact
    quota x.  Seats below that band are given outright; only those in the band,
    about three a party, are ranked.
    """
    inside = W.partitionBy(*part) if part else W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ranked = (W.partitionBy(*part) if part else W.partitionBy()).orderBy(F.desc("__q"), *key)
    x = F.when(F.col("__all") > 0, F.col(share) * F.col(seats) / F.col("__all")).otherwise(F.lit(0.0))
    band = F.col("__x") * F.col("__k") / (2 * F.greatest(F.col(seats), F.lit(1))) + 1
    base = (df.withColumn("__all", F.sum(share).over(inside))
            .withColumn("__k", F.sum(F.when(F.col(share) > 0, 1).otherwise(0)).over(inside))
            .withColumn("__x", x)
            .withColumn("__low", F.greatest(F.lit(0), F.floor(F.col("__x") - band)).cast("long"))
            .withColumn("__high", F.when(F.col(share) > 0, F.ceil(F.col("__x") + band)).otherwise(F.lit(0)).cast("long"))
            .withColumn("__left", F.col(seats) - F.sum("__low").over(inside)))
    seat = F.explode_outer(F.when(F.col("__high") > F.col("__low"), F.sequence(F.col("__low") + 1, F.col("__high"))))
    dealt = (base.withColumn("__seat", seat).withColumn("__q", F.col(share) / (2 * F.col("__seat") - 1))
             .withColumn("__won", (F.col("__q").isNotNull() & (F.row_number().over(ranked) <= F.col("__left"))).cast("long")))
    keep = [F.first(c).alias(c) for c in df.columns if c not in part + key]
    return (dealt.groupBy(*part, *key).agg(*keep, (F.first("__low") + F.sum("__won")).alias(out)))


def mix(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights=WEIGHTS,
        total: float = TOTAL, max_repeat: int = MAX_REPEAT, block_words: int = BLOCK_WORDS, seed: int = SEED,
        carry: tuple[str, ...] = ()) -> DataFrame:
    """Return (doc_id, source, size, source_size, target, taken, spans) and the columns ``carry`` for every row of ``df``.

    ``spans`` lists [from, to) word ranges of the document that the mix takes, repeats
    listed again.  Only ids, sources and sizes are shuffled; the hot source is dealt
    over its shards, whose streams are the only ordered windows.
    """
    names = {doc_id: "doc_id", source: "source"}
    base = materialize(df.select(*[F.col(k).alias(v) for k, v in names.items()], *carry,
                                 word_count(F.col(text)).alias("size")))
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    targets = materialize(source_targets(sizes, weights, total, max_repeat)
                          .withColumn("src", F.xxhash64("source", F.col("source").isNull()))
                          .withColumn("shards", F.least(F.lit(SHARDS), F.ceil(F.col("n_docs") / SHARD_DOCS)).cast("long")))
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    goal = F.sum("target").over(everything)
    seats = F.when(goal > 0, F.greatest(F.lit(1), F.round(goal / block_words))).otherwise(0).cast("long")
    quotas = apportion(targets.select("src", "target", "source_size").withColumn("seats", seats),
                       [], ["src"], "target", "seats", "src_quota")
    known = materialize(targets.join(quotas.select("src", "src_quota"), "src"))
    shard = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.col("shards"))
    placed = attach(base, known, ["source"]).withColumn("shard", shard)
    shards = apportion(placed.groupBy("src", "shard", "src_quota").agg(F.sum("size").alias("shard_size")),
                       ["src"], ["shard"], "shard_size", "src_quota", "quota").select("src", "shard", "quota")
    shards = materialize(shards)

    stream = W.partitionBy("src", "shard").orderBy("__h", "doc_id", "size")
    flow = (placed.withColumn("__h", F.xxhash64(F.lit(seed + 1), "doc_id"))
            .withColumn("b", F.sum("size").over(stream.rowsBetween(W.unboundedPreceding, 0)))
            .withColumn("s", F.sum("size").over(W.partitionBy("src", "shard")))
            .withColumn("a", F.col("b") - F.col("size")))
    flow = attach(flow, shards, ["src", "shard"])
    n = F.greatest(F.lit(1), F.round(F.col("s") / block_words)).cast("long")
    flow = (flow.withColumn("n", n).withColumn("q", F.least("quota", F.col("n") * max_repeat))
            .withColumn("passes", F.expr("q div n")).withColumn("extra", F.col("q") % F.col("n"))
            .withColumn("first", F.pmod(F.xxhash64(F.lit(seed + 2), "src", "shard"), F.col("n"))))
    edge = lambda block: F.expr(f"({block}) * s div n")  # noqa: E731  exact words where a block begins
    ends = F.col("first") + F.col("extra")
    wraps = ends > F.col("n")
    flow = (flow.withColumn("x1", edge("first"))
            .withColumn("y1", F.when(wraps, F.col("s")).otherwise(edge("first + extra")))
            .withColumn("y2", F.when(wraps, edge("first + extra - n")).otherwise(F.lit(0))))
    part = lambda x, y: F.struct(
        (F.greatest(F.col("a"), x) - F.col("a")).cast("long").alias("from"),
        (F.greatest(F.greatest(F.col("a"), x), F.least(F.col("b"), y)) - F.col("a")).cast("long").alias("to"))
    whole = F.struct(F.lit(0).cast("long").alias("from"), F.col("size").alias("to"))
    spans = F.filter(F.concat(F.array_repeat(whole, F.col("passes").cast("int")),
                              F.array(part(F.col("x1"), F.col("y1")), part(F.lit(0).cast("long"), F.col("y2")))),
                     lambda x: x["to"] > x["from"])
    taken = F.aggregate("spans", F.lit(0).cast("long"), lambda t, x: t + x["to"] - x["from"])
    return flow.withColumn("spans", spans).select(
        "doc_id", "source", "size", "source_size", "target", taken.alias("taken"), "spans", *carry)


def mixed_documents(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
                    **options) -> DataFrame:
    """The mix itself: one row of ``df``, with the words taken as its text, for each span.

    A document taken whole keeps its text as it is; in one taken in part words are
    separated by single blanks.  Rows are told apart by id, text hash and a running
    number, so repeated rows and null ids are dealt with one by one.
    """
    marked = df.withColumn("__mx_hash", F.xxhash64(text))
    dealt = mix(marked, doc_id, text, source, carry=("__mx_hash",), **options)
    nth = F.row_number().over(W.partitionBy("__mx_id", "__mx_hash").orderBy("__mx_size"))
    dealt = (dealt.select(F.col("doc_id").alias("__mx_id"), "__mx_hash", F.col("size").alias("__mx_size"), "spans")
             .withColumn("__mx_nth", nth))
    left = marked.withColumn("__mx_id", F.col(doc_id)).withColumn("__mx_size", F.lit(0)).withColumn("__mx_nth", nth)
    same = [left[c].eqNullSafe(dealt[c]) for c in ("__mx_id", "__mx_hash", "__mx_nth")]
    spans = left.join(dealt.where(F.size("spans") > 0), same).select(
        *[left[c] for c in df.columns], dealt["__mx_size"], F.explode("spans").alias("__mx_span"))
    words = F.filter(F.split(F.col(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    length = F.col("__mx_span.to") - F.col("__mx_span.from")
    part = F.array_join(F.slice(words, (F.col("__mx_span.from") + 1).cast("int"), length.cast("int")), " ")
    return spans.withColumn(text, F.when(length == F.col("__mx_size"), F.col(text)).otherwise(part)).select(*df.columns)
