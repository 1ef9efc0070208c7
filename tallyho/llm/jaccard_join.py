"""Operator 5, n-gram Jaccard join by PartEnum signatures.

A document is the set of its distinct word shingles.  Sizes are cut into bands; for
the pairs whose larger set lies in band i, Jaccard similarity of ``num / den`` or more bounds
the symmetric difference by k_i.  The feature domain is partitioned at random into n1
parts of three cells each; as n1 * 2 > k_i, two such sets differ in at most one cell of
some part.  Every choice of two of its three cells is enumerated as a signature, so the
sets share one.  Signatures only propose pairs; every link is checked exactly on
the whole sets.

Sets that are equal collapse to their smallest id first, and only these get signatures.  A signature of
empty cells alone would be shared by all sets that leave them empty.  Where linked sets have ``CERTAIN`` shingles in
common at least, it is left out: that every shingle which two linked sets have in common lies in cells that differ has
a chance below 0.62 ^ CERTAIN, about that of two equal 64-bit hashes.  A signature's members are not
paired with each other.  All are compared with the signature's smallest id (a star), and
what that links becomes one component.  Only signatures that still hold two components
are looked at again, in cells of bounded size: parity sketches bound the symmetric
difference from below.  A signature with few members hands on the pairs between components that the bound
allows; a cell of a larger one a spanning forest of them, then, once those are checked, the pairs that are
still allowed between components.  No link between different sets is lost.

Defined results
* Every input row is returned once; rows that repeat an id belong to one component.
* A null or empty text has an empty set and is linked with nothing; with fewer words than
  ``width`` the whole sequence is the only shingle.
* A null id is returned with a null component and takes no part in links.
* Columns of the input pass through; ``n_shingles`` and ``component_id`` replace columns of
  these names.  Empty input gives empty output.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyho.llm._cells import whole_groups
from tallyho.llm._components import components
from tallyho.llm._join import fits
from tallyho.llm._shared import sorted_shared_keys
from tallyho.llm._text import binaries, distinct, mix64, shingles, slices, words_of
from tallyho.session import Scratch, materialize

WIDTH = 3
NUM, DEN = 90, 100
#: Ratio of a size band's ends.
BAND = 1.4
#: Members of a signature in one cell's side.
CELL_ROWS = 512
#: Pairs whose sketches are compared at once.
PAIRS = 1 << 16
#: Shingles in common from which signatures of empty cells are left out.
CERTAIN = 100
#: Bits of a parity sketch for each element that may differ: at 4, sets that differ in 1.15 times the bound stand out.
SKETCH_BITS = 4
#: Members up to which a signature's pairs are formed together with those of others.
SMALL = 24
#: Ids up to which a list of wanted documents is broadcast, so that their texts are not shuffled.
WANTED_ROWS = 2_000_000
_PART = np.uint64(0xA0761D6478BD642F)
_CELL = np.uint64(0xE7037ED1A0B428DB)


def bands(num: int = NUM, den: int = DEN, largest: int = 1 << 40) -> np.ndarray:
    """Rows (least size of a member, first size, last size, k) of each band.

    |A ^ B| <= (1 - s) |A u B| and 2 |A u B| = |A| + |B| + |A ^ B| give
    |A ^ B| (den + num) <= (den - num) (|A| + |B|).
    """
    out, lo = [], 1
    while lo <= largest:
        hi = max(lo, int(lo * BAND))
        out.append((-(-lo * num // den), lo, hi, (den - num) * 2 * hi // (den + num)))
        lo = hi + 1
    return np.array(out, dtype=np.int64)


def signatures(sets: np.ndarray, first: np.ndarray, table: np.ndarray, num: int = NUM, den: int = DEN) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, document of each) of documents given as flat sets of 64-bit hashes.

    A set stands in its own band and in all further ones whose members may be linked with it.
    """
    n = np.diff(first)
    own = np.searchsorted(table[:, 1], n, side="right") - 1
    found: list[tuple[np.ndarray, np.ndarray]] = []
    step = -1
    while True:
        step += 1
        band = np.minimum(own + step, len(table) - 1)
        docs = np.flatnonzero((n > 0) & (n >= table[band, 0]) & (band == own + step))
        if not len(docs):
            break
        k = table[band[docs], 3]
        parts = np.where(k > 0, (k + 2) // 2, 1)  # n1 * 2 > k
        base = np.concatenate([[0], np.cumsum(parts * 3)])
        size = n[docs]
        doc = np.repeat(np.arange(len(docs)), size)
        at = np.repeat(first[docs] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        h = sets[at]
        mixed = mix64(h ^ _PART)
        part = (mixed >> np.uint64(32)).astype(np.int64) % parts[doc]
        cell = base[doc] + part * 3 + (mixed & np.uint64(0xFFFFFFFF)).astype(np.int64) % 3
        sums = np.zeros(base[-1], np.uint64)
        np.add.at(sums, cell, mix64(h ^ _CELL))
        sums = sums.reshape(-1, 3)
        filled = np.bincount(cell, minlength=base[-1]).reshape(-1, 3)
        sure = np.repeat(table[band[docs], 1] * num >= CERTAIN * den, parts)
        total = sums.sum(axis=1, dtype=np.uint64)
        place = np.arange(len(sums)) - np.repeat(base[:-1] // 3, parts)
        seed = mix64((np.repeat(band[docs], parts).astype(np.uint64) << np.uint64(40)) + place.astype(np.uint64) * np.uint64(4))
        of = np.repeat(docs, parts)
        exact = np.repeat(k == 0, parts)  # no difference allowed: the whole set is the signature
        found.append((mix64(total[exact] + seed[exact]), of[exact]))
        for left_out in range(3):
            use = ~exact & (~sure | (filled.sum(axis=1) > filled[:, left_out]))
            found.append((mix64((total - sums[:, left_out])[use] + mix64(seed[use] + np.uint64(left_out + 1))), of[use]))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sig, doc = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.argsort(doc, kind="stable")
    return sig[order], doc[order]


def describe(df: DataFrame, doc_id: str, text: str, width: int) -> DataFrame:
    """(doc_id, n, fa, fb): size and 128-bit fingerprint of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            sets, first = distinct(*shingles(words_of(batch.column(1)), width))
            total = [np.zeros(len(sets) + 1, np.uint64) for _ in range(2)]
            for t, c in zip(total, (_PART, _CELL), strict=True):
                np.cumsum(mix64(mix64(sets + c)), out=t[1:])
            fa, fb = (mix64(t[first[1:]] - t[first[:-1]]).astype(np.int64) for t in total)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(first)), pa.array(fa), pa.array(fb)],
                                             names=["doc_id", "n", "fa", "fb"])

    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, n bigint, fa bigint, fb bigint")


def memberships(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """(key, id): the signatures of documents (id, text)."""
    table = bands(num, den)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            sets, first = distinct(*shingles(words_of(batch.column(1)), width))
            sig, doc = signatures(sets, first, table, num, den)
            yield pa.RecordBatch.from_arrays([pa.array(sig.astype(np.int64)), batch.column(0).take(pa.array(doc))], names=["key", "id"])

    return docs.select("id", "text").mapInArrow(run, "key bigint, id bigint")


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows whose id is not in the written list ``gone``, which is broadcast if its counted rows are within the bound."""
    return docs.join(F.broadcast(gone) if fits(gone) else gone, "id", "left_anti")


def sketch(elements: np.ndarray, num: int, den: int) -> bytes:
    """Parity of the number of elements in each of 2^m buckets.

    Two sketches differ in at most as many bits as their sets differ in elements.  A
    longer sketch folds to a shorter one by the exclusive or of its halves.
    """
    differ = (den - num) * 2 * len(elements) // (den + num)
    bits = 1 << max(8, (SKETCH_BITS * differ).bit_length())
    bucket = (mix64(elements ^ _CELL ^ _PART) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(bucket, minlength=bits) & 1).astype(np.uint8), bitorder="little").tobytes()


def _folded(raw: list[bytes]) -> np.ndarray:
    """Sketches as rows of 64-bit words, folded to the shortest."""
    width = min(map(len, raw))
    out = np.empty((len(raw), width // 8), np.uint64)
    for i, x in enumerate(raw):
        v = np.frombuffer(x, np.uint64)
        while len(v) > width // 8:
            v = v[:len(v) // 2] ^ v[len(v) // 2:]
        out[i] = v
    return out


def apart(raw: pa.Array, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Bits in which the sketches of row pairs differ, each pair folded to its shorter one."""
    size = pc.binary_length(raw).to_numpy()
    out = np.empty(len(left), np.int64)
    lo, hi = np.minimum(size[left], size[right]), np.maximum(size[left], size[right])
    swap = size[left] > size[right]
    short, long = np.where(swap, right, left), np.where(swap, left, right)
    for a, b in np.unique(np.stack([lo, hi], axis=1), axis=0) if len(left) else ():
        own = np.flatnonzero((lo == a) & (hi == b))
        rows = {w: np.unique(side[own], return_inverse=True) for w, side in (("s", short), ("l", long))}
        x, y = (np.frombuffer(b"".join(raw.take(pa.array(rows[w][0])).to_pylist()), np.uint64).reshape(-1, n // 8)
                for w, n in (("s", a), ("l", b)))
        while y.shape[1] > x.shape[1]:
            y = y[:, :y.shape[1] // 2] ^ y[:, y.shape[1] // 2:]
        for at in range(0, len(own), PAIRS):
            cut = slice(at, at + PAIRS)
            out[own[cut]] = np.bitwise_count(x[rows["s"][1][cut]] ^ y[rows["l"][1][cut]]).sum(axis=1)
    return out


def allowed(raw: pa.Array, n: np.ndarray, left: np.ndarray, right: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether the sizes and sketches of row pairs allow a link."""
    keep = np.maximum(n[left], n[right]) * num <= np.minimum(n[left], n[right]) * den
    own = np.flatnonzero(keep)
    keep[own] = apart(raw, left[own], right[own]) * (den + num) <= (den - num) * (n[left[own]] + n[right[own]])
    return keep


def contents(df: DataFrame, wanted: DataFrame, doc_id: str, text: str, width: int, num: int, den: int) -> DataFrame:
    """(id, n, set, sketch) of the rows with an id of the written list ``wanted``; the set is sorted 64-bit shingle hashes as binary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            sets, first = distinct(*shingles(words_of(batch.column(1)), width))
            marks = [sketch(sets[a:b], num, den) for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.diff(first)), binaries(sets, first).cast(pa.binary()),
                 pa.array(marks, pa.binary())], names=["id", "n", "set", "sketch"])

    rows = df.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    side = F.broadcast(wanted) if fits(wanted, WANTED_ROWS) else wanted
    return rows.join(side, "id").mapInArrow(run, "id bigint, n bigint, set binary, sketch binary")


def possible(pairs: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sketches and sizes allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = np.arange(batch.num_rows)
            n = np.concatenate([batch.column(c).to_numpy() for c in (2, 3)])
            raw = pa.concat_arrays([batch.column(4), batch.column(5)])
            keep = pa.array(allowed(raw, n, row, row + batch.num_rows, num, den))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in (0, 1)], names=["a", "b"])

    one = sketches.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    two = sketches.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    near_size = F.greatest("na", "nb") * num <= F.least("na", "nb") * den
    return (pairs.join(one, "a").join(two, "b").where(near_size).select("a", "b", "na", "nb", "sa", "sb")
            .mapInArrow(run, "a bigint, b bigint"))


def verified(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(u, v) of the pairs (a, b) that are linked, exact on the whole sets; any text of a repeated id counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.zeros(batch.num_rows, bool)
            left, right = batch.column(2), batch.column(3)
            for i in range(batch.num_rows):
                a, b = (np.frombuffer(c[i].as_buffer(), np.uint64) for c in (left, right))
                if len(a) > len(b):
                    a, b = b, a
                at = np.searchsorted(b, a)
                at[at == len(b)] = 0
                inter = np.count_nonzero(b[at] == a) if len(b) else 0
                near[i] = inter > 0 and den * inter >= num * (len(a) + len(b) - inter)
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(near)) for i in (0, 1)], names=["u", "v"])

    one = sets.select(F.col("id").alias("a"), F.col("set").alias("set_a"))
    two = sets.select(F.col("id").alias("b"), F.col("set").alias("set_b"))
    return (pairs.join(one, "a").join(two, "b").select("a", "b", "set_a", "set_b")
            .mapInArrow(run, "u bigint, v bigint").distinct())


def allowed_pairs(side: np.ndarray, comp: np.ndarray, n: np.ndarray, raw: list[bytes], num: int, den: int,
                  forest: bool) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of a cell that lie in different components and that sizes and sketches allow.

    ``side`` is 0 or 1: rows of side 0 meet those of side 1, or each other when all are 0.
    With ``forest`` only a spanning forest over the components, nearest pairs first.
    """
    one = np.flatnonzero(side == 0)
    two = np.flatnonzero(side == 1) if side.any() else one
    if not len(one) or not len(two):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words = _folded(raw)
    apart = np.zeros((len(one), len(two)), np.int32)
    for w in range(words.shape[1]):
        apart += np.bitwise_count(words[one, w][:, None] ^ words[two, w][None, :])
    na, nb = n[one][:, None], n[two][None, :]
    ok = ((comp[one][:, None] != comp[two][None, :]) & (apart * (den + num) <= (den - num) * (na + nb))
          & (np.maximum(na, nb) * num <= np.minimum(na, nb) * den))
    i, j = np.nonzero(ok)
    if not forest:
        if two is one:
            i, j = i[i < j], j[i < j]
        return one[i], two[j]
    order = np.argsort(apart[i, j], kind="stable")
    a, b = one[i[order]], two[j[order]]
    _, label = np.unique(comp, return_inverse=True)
    chosen: list[np.ndarray] = []
    while len(a):  # each component takes its nearest pair, components merge, until no pair lies between two
        picks = np.unique(np.concatenate([np.unique(label[x], return_index=True)[1] for x in (a, b)]))
        chosen.append(np.stack([a[picks], b[picks]]))
        for x, y in chosen[-1].T:
            label[label == label[x]] = label[y]
        cross = label[a] != label[b]
        a, b = a[cross], b[cross]
    both = np.concatenate(chosen, axis=1) if chosen else np.zeros((2, 0), np.int64)
    return both[0], both[1]


def small_pairs(edges: np.ndarray, comp: np.ndarray, n: np.ndarray, marks: pa.Array, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """All allowed pairs between components of the signatures with at most ``SMALL`` members, formed by their distance in the group."""
    size = np.diff(edges)
    left_in = np.repeat(edges[1:], size) - np.arange(edges[-1])  # rows of the group from this one on
    left_in[np.repeat(size, size) > SMALL] = 0
    one, two = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for step in range(1, SMALL):
        x = np.flatnonzero(left_in > step)
        x = x[comp[x] != comp[x + step]]
        for at in range(0, len(x), PAIRS):
            part = x[at:at + PAIRS]
            part = part[allowed(marks, n, part, part + step, num, den)]
            one.append(part)
            two.append(part + step)
    return np.concatenate(one), np.concatenate(two)


def cell_pairs(members: DataFrame, num: int, den: int, forest: bool) -> DataFrame:
    """(a, b) from (key, id, c, n, sketch) rows of signatures with several components.

    A signature with many members is split into blocks by a hash of the id, and each pair of
    blocks is a cell; the rows of a cell stand together after a sort by cell.
    """
    count = members.groupBy("key").agg(F.count("*").alias("rows")).select(
        "key", F.ceil(F.col("rows") / CELL_ROWS).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    rows = (members.join(count, "key").withColumn("own", own)
            .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            .withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other"))
            .withColumn("side", (F.col("own") > F.col("lo")).cast("int")))
    rows = (rows.select("key", "lo", "hi", "side", "id", "c", "n", "sketch").repartition("key", "lo", "hi")
            .sortWithinPartitions("key", "lo", "hi"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in whole_groups(batches, 3):
            lo, hi, side, ident, comp, n = (table.column(i).to_numpy() for i in range(1, 7))
            marks = table.column(7).combine_chunks()
            marks = pa.concat_arrays(marks.chunks) if isinstance(marks, pa.ChunkedArray) else marks
            found = [tuple(ident[x] for x in small_pairs(edges, comp, n, marks, num, den))]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b - a <= SMALL and lo[a] == hi[a]:
                    continue
                raw = marks.slice(a, b - a).to_pylist()
                if comp[a:b].min() < comp[a:b].max() and (lo[a] == hi[a] or side[a:b].any()):
                    x, y = allowed_pairs(side[a:b], comp[a:b], n[a:b], raw, num, den, forest)
                    found.append((ident[a + x], ident[a + y]))
            one, two = (np.concatenate(c) for c in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(one, two)), pa.array(np.minimum(one, two))], names=["a", "b"])

    return rows.mapInArrow(run, "a bigint, b bigint").distinct()


def _with_component(rows: DataFrame, comp: DataFrame) -> DataFrame:
    return rows.join(comp.select("id", F.col("component").alias("c")), "id", "left").withColumn("c", F.coalesce("c", "id"))


def link(active: DataFrame, sets: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    """(id, component) of linked ids from the memberships (key, id) of shared signatures."""
    marks = sets.select("id", "n", "sketch")
    lead = active.groupBy("key").agg(F.min("id").alias("b"))
    star = active.select("key", F.col("id").alias("a")).join(lead, "key").where("a <> b").select("a", "b").distinct()
    links = scratch.table(verified(possible(star, marks, num, den), sets, num, den))
    comp, tested = components(links, scratch), None
    for forest in (True, False):
        placed = scratch.table(_with_component(active, comp))
        several = placed.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key")
        members = scratch.table(placed.join(several, "key").join(marks, "id").select("key", "id", "c", "n", "sketch"))
        if members.isEmpty():
            break
        pairs = cell_pairs(members, num, den, forest)
        pairs = scratch.table(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"))
        scratch.drop(placed, members)
        more, tested = scratch.table(verified(pairs, sets, num, den)), pairs
        if not more.isEmpty():
            links = links.unionByName(more)
            comp = components(links, scratch)
    return comp


def jaccard_groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, num: int = NUM,
                   den: int = DEN) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id) of every row; ``class_id`` is the smallest id with an equal set."""
    spark = df.sparkSession
    with Scratch(spark) as scratch:
        sets = scratch.table(describe(df, doc_id, text, width))
        usable = sets.where("doc_id is not null and n > 0")
        classes = scratch.table(usable.groupBy("n", "fa", "fb").agg(F.min("doc_id").alias("rep")))
        members = scratch.table(usable.select("doc_id", "n", "fa", "fb").join(classes, ["n", "fa", "fb"]).select("doc_id", "rep"))
        # an id that stands for a class in any of its rows keeps its signatures
        gone = scratch.table(members.groupBy(F.col("doc_id").alias("id")).agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"))
                             .where("lo <> id and hi <> id").select("id"))
        docs = df.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
        active = scratch.table(sorted_shared_keys(memberships(_without(docs, gone), width, num, den)))
        scratch.drop(classes, gone)
        wanted = scratch.table(active.select("id").distinct())
        full = contents(df, wanted, doc_id, text, width, num, den)
        if not usable.groupBy("doc_id").count().where("count > 1").isEmpty():
            full = full.distinct()
        comp = link(active, scratch.table(full), num, den, scratch)
        same = members.select(F.col("doc_id").alias("u"), F.col("rep").alias("v")).where("u <> v").distinct()
        whole = components(comp.select(F.col("id").alias("u"), F.col("component").alias("v")).unionByName(same), scratch)
        reps_of = members.groupBy("doc_id").agg(F.min("rep").alias("class_id"))
        rows = sets.select("doc_id", F.col("n").alias("n_shingles"))
        named = whole.select(F.col("id").alias("doc_id"), F.col("component").alias("component_id"))
        return materialize(rows.join(named, "doc_id", "left").join(reps_of, "doc_id", "left").select(
            "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
            F.coalesce("class_id", "doc_id").alias("class_id")))
