"""Operator 2, line dedup by site-relative frequency (DataFrame functions only).

A line that stands on many pages of one host is boilerplate of that host, however
rare it is in the corpus.  Rows are grouped by host; for each host the number of
pages that contain a line is divided by the host's page total, and lines above
the ratio are dropped from every page of that host.

Defined results
* Every input row is a page and is returned once, also repeated rows.
* A null text stays null and has no lines; an empty text stays empty.
* Null hosts form one host of their own.
* Lines are compared after trimming blanks, tabs and carriage returns; blank
  lines are never counted and never dropped.
* A line must stand on ``min_pages`` pages at least and on more than ``ratio`` of
  the host's pages, so hosts with few pages lose nothing.
* Columns other than ``text`` pass through; ``n_lines`` and ``n_dropped`` are
  added and replace columns of these names.  Empty input gives empty output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyho.llm._join import attach, fits
from tallyho.session import materialize

RATIO = 0.1
MIN_PAGES = 5
#: Most flagged lines (two longs each) that are broadcast; more go through a salted shuffle join.
BROADCAST_LINES = 500_000
#: Pieces into which every host is split in the shuffle join.
SALTS = 32

BLOCK_TAG = (r"(?i)</?(?:p|div|li|ul|ol|nav|h[1-6]|br|article|footer|header|section|title|head|body|html|table"
             r"|tr|td|th|form|main|aside)(?:\s[^>]*)?/?>")
HIDDEN = [r"(?is)<!--.*?-->", r"(?is)<script(?:\s[^>]*)?>.*?</script>", r"(?is)<style(?:\s[^>]*)?>.*?</style>"]
#: The hidden parts in one pass; the opening bracket stands first so that the search runs from tag to tag.
_HIDDEN_ONCE = r"(?is)<(?:!--.*?--|script(?:\s[^>]*)?>.*?</script|style(?:\s[^>]*)?>.*?</style)>"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def host_of(url: Column) -> Column:
    """Lower-case host of a URL; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, HOST, 1), F.lit("")))


def visible_lines(html: Column) -> Column:
    """The text of a page, one line per block element, without scripts, styles and comments."""
    html = F.regexp_replace(html, _HIDDEN_ONCE, "")
    return F.regexp_replace(F.regexp_replace(html, BLOCK_TAG, "\n"), r"<[^>]*>", "")


def _trimmed(line: Column) -> Column:
    return F.trim(F.translate(line, "\t\r\f", "   "))


def _key(line: Column) -> Column:
    """128 bits of a line."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"))


def boilerplate(df: DataFrame, host: str, text: str, ratio: float = RATIO,
                min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, line key, pages, host_pages) of every line above the ratio.

    Counting is a partial aggregate per (host, line), so a line of a third of all
    pages leaves each map task as one row.
    """
    lines = F.array_distinct(F.filter(F.transform(F.split(F.col(text), "\n"), _trimmed), lambda x: x != ""))
    counted = (df.select(F.col(host).alias("host"), F.explode(lines).alias("line"))
               .select("host", _key(F.col("line")).alias("line"))
               .groupBy("host", "line").agg(F.count("*").alias("pages"))
               .where(F.col("pages") >= min_pages))
    totals = materialize(df.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("host_pages")))
    return attach(counted, totals, ["host"]).where(F.col("pages") > F.lit(ratio) * F.col("host_pages"))


def drop_boilerplate(df: DataFrame, host: str, text: str = "text", ratio: float = RATIO,
                     min_pages: int = MIN_PAGES) -> DataFrame:
    """Return ``df`` with boilerplate lines removed from ``text`` and the counts ``n_lines``, ``n_dropped``.

    A host's flagged lines are gathered in one array: as each stands on more than
    ``ratio`` of its pages, there are at most (mean lines of a page) / ratio of them.
    """
    flagged = materialize(boilerplate(df, host, text, ratio, min_pages).select("host", "line"))
    per_host = flagged.groupBy(F.col("host").alias("__ld_host")).agg(F.collect_list("line").alias("__ld_drop"))
    df = df.drop("n_lines", "n_dropped")
    if fits(flagged, BROADCAST_LINES):
        joined = df.join(F.broadcast(per_host), F.col(host).eqNullSafe(F.col("__ld_host")), "left")
    else:
        salted = per_host.withColumn("__ld_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.xxhash64(F.col(text)), F.lit(SALTS)).cast("int")
        joined = df.withColumn("__ld_mine", salt).join(
            salted, F.col(host).eqNullSafe(F.col("__ld_host")) & (F.col("__ld_mine") == F.col("__ld_salt")), "left")
    full = F.transform(F.split(F.col(text), "\n"), lambda x: F.struct(x.alias("line"), _trimmed(x).alias("bare")))
    keep = F.filter(F.col("__ld_full"), lambda x: (x.bare == "") | F.col("__ld_drop").isNull()
                    | ~F.array_contains(F.col("__ld_drop"), _key(x.bare)))
    return (joined.withColumn("__ld_full", full).withColumn("__ld_keep", keep)
            .withColumn("n_lines", F.coalesce(F.size(F.filter("__ld_full", lambda x: x.bare != "")), F.lit(0)).cast("long"))
            .withColumn("n_dropped", F.when(F.col(text).isNull(), 0).otherwise(
                F.size("__ld_full") - F.size("__ld_keep")).cast("long"))
            .withColumn("n_lines", F.when(F.col(text).isNull(), 0).otherwise(F.col("n_lines")).cast("long"))
            .withColumn(text, F.array_join(F.transform("__ld_keep", lambda x: x.line), "\n"))
            .drop("__ld_host", "__ld_drop", "__ld_full", "__ld_keep", "__ld_salt", "__ld_mine"))
