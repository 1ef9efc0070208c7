"""Operator 11, hard-negative mining with cover trees.

The largest inner product becomes the smallest distance when a candidate x gets one more
component, sqrt(M^2 - |x|^2), and an anchor q gets 0 there: |q' - x'|^2 = |q|^2 + M^2 - 2 q.x.  So a ball of
candidates around c with radius R bounds the inner products of all its members from both sides.

The top of the tree are centres from a bounded sample; every candidate goes to its nearest centre,
and the cell's exact covering radius (of all its rows, and per label) is aggregated.  An anchor meets only cells
whose bounds leave room: enough rows are certain to lie in the cells of highest lower bounds, which gives a score
that no cell below needs to be opened for.  Inside a cell's bounded parts a cover tree is built, level by
level with halved radii.  A search opens the node of highest bound first, skips nodes that lie wholly
outside its window of scores or below the k-th best score so far, and measures what it opens exactly.  All searches of a part go on in step,
those that open the same node as one matrix product.

First every anchor searches its positives, the k rows of its own label with the highest scores; each positive
score gives a window, in which the negatives, rows of other labels, are searched.

Defined results
* One row per anchor, positive and rank; none where the window holds no row of another label.
* Rows with a null id, label or vector, or with a null, NaN or infinite component take no part.  Vectors of
  different lengths do not meet.
* Equal rows count once.  Of different rows that repeat an id the one with the least label, then the shortest and bytewise
  least vector, counts.
* A component x is floor(scale * x), held within the bound at which all scores fit 64 bits (``limit``).
* Equal vectors of a label are searched as one entry with its smallest ids, so a group of copies of any size is one row.
* Other columns are not read.  Empty input gives empty output.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyho.llm._cells import whole_groups
from tallyho.llm._join import attach
from tallyho.session import Scratch, materialize

POSITIVES, NEGATIVES, SCALE = 5, 10, 256
#: Window of a negative's score in percent of the positive's.
LOW, HIGH = 30, 90
#: Rows of a cell's part, most centres of one vector length, lengths that get centres, and bytes of all centres.
CELL_ROWS, CENTRES, LENGTHS, CENTRE_BYTES = 2048, 1024, 16, 32 << 20
#: Members below which a node is a leaf, the ratio of radii between levels, searches that go on in step.
LEAF, SHRINK, BLOCK = 24, 0.5, 256
#: Most lists of cells that a join broadcasts.
LISTS = 2000
SLACK = 1e-9
_NONE = -(1 << 63)
_MOST = (1 << 63) - 1


def limit(dim: int) -> int:
    """Largest component such that 100 times any score fits 64 bits."""
    return int(((1 << 56) / max(1, dim)) ** 0.5)


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows; by floating point where every sum is below 2^53."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[1]
    if top < 1 << 53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    return q @ x.T


def lifted(x: np.ndarray, squared_norm: float) -> np.ndarray:
    """Rows with the component that gives all of them the same norm."""
    x = x.astype(np.float64)
    rest = np.sqrt(np.maximum(0.0, squared_norm - np.einsum("rd,rd->r", x, x)))
    return np.concatenate([x, rest[:, None]], axis=1)


def bounds(q_norm: np.ndarray, ip: np.ndarray, squared_norm: float, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bound of the inner products with all members of balls, given those with the centres."""
    span = q_norm + squared_norm
    d = np.sqrt(np.maximum(0.0, span - 2.0 * ip))
    room = SLACK * (span + 1.0)
    return (span - (d + radius) ** 2) / 2 - room, (span - np.maximum(0.0, d - radius) ** 2) / 2 + room


@dataclass
class Tree:
    """Node i covers everything within ``radius[i]`` of row ``centre[i]``; ``kids[i]`` are nodes, ``rows[i]`` the rows of a leaf but its centre."""

    centre: list[int]
    radius: list[float]
    kids: list[np.ndarray]
    rows: list[np.ndarray]
    squared_norm: float


def build(x: np.ndarray) -> Tree:
    """Cover tree of integer rows.  The centres of a level lie further apart than its radius, and a node's centre is one of its children's."""
    squared_norm = float(np.einsum("rd,rd->r", x.astype(np.float64), x.astype(np.float64)).max(initial=0.0))
    points = lifted(x, squared_norm)
    tree = Tree([], [], [], [], squared_norm)

    def add(centre: int, members: np.ndarray, d: np.ndarray) -> int:
        tree.centre.append(centre)
        tree.radius.append(float(d.max(initial=0.0)) * (1 + SLACK) + SLACK)
        tree.kids.append(np.zeros(0, np.int64))
        tree.rows.append(members)
        return len(tree.centre) - 1

    if not len(x):
        return tree
    away = points - points[0]
    todo = [add(0, np.arange(1, len(x)), np.sqrt(np.einsum("rd,rd->r", away, away))[1:])]
    while todo:
        node = todo.pop()
        members = tree.rows[node]
        if len(members) <= LEAF:
            continue
        level = tree.radius[node] * SHRINK
        centre, kids, left = tree.centre[node], [], members
        while True:
            away = points[left] - points[centre]
            d = np.sqrt(np.einsum("rd,rd->r", away, away))
            near = d <= level
            kids.append(add(centre, left[near], d[near]))
            left = left[~near]
            if not len(left):
                break
            centre, left = int(left[0]), left[1:]
            if not len(left):
                kids.append(add(centre, left, np.zeros(0)))
                break
        if len(kids) == 1 and len(tree.rows[kids[0]]) == len(members) and tree.radius[kids[0]] >= tree.radius[node]:
            tree.centre.pop(), tree.radius.pop(), tree.kids.pop(), tree.rows.pop()
            continue  # all members at one distance that no level divides: a leaf
        tree.kids[node], tree.rows[node] = np.array(kids), np.zeros(0, np.int64)
        todo += [kid for kid in kids if len(tree.rows[kid])]
    return tree


@dataclass
class Search:
    """Searches in a part: vectors, labels, windows (inclusive); ``same``: rows of the own label, else of others."""

    q: np.ndarray
    label: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    same: bool


def _merge(score: np.ndarray, row: np.ndarray, new_score: np.ndarray, new_row: np.ndarray, name: np.ndarray, k: int) -> tuple:
    """Best k of each search, ties to the smaller name."""
    s = np.concatenate([score, new_score], axis=1)
    r = np.concatenate([row, np.broadcast_to(new_row, new_score.shape)], axis=1)
    named = np.where(s == _NONE, _MOST, name[r])
    order = np.lexsort((named, -np.maximum(s, -_MOST)), axis=-1)[:, :k]
    return np.take_along_axis(s, order, axis=1), np.take_along_axis(r, order, axis=1)


def descend(tree: Tree, x: np.ndarray, label: np.ndarray, name: np.ndarray, search: Search, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(search, row, score) of the k best rows of each search, and how many products were made."""
    found, measured = [], 0
    centre, radius = np.array(tree.centre), np.array(tree.radius)
    for at in range(0, len(search.q), BLOCK):
        part = slice(at, at + BLOCK)
        q, own, lo, hi = search.q[part], search.label[part], search.lo[part], search.hi[part]
        norm = np.einsum("rd,rd->r", q.astype(np.float64), q.astype(np.float64))
        score, row = np.full((len(q), k), _NONE, np.int64), np.zeros((len(q), k), np.int64)
        upper = np.full((len(q), len(centre)), -np.inf)

        def measure(rows: np.ndarray, points: np.ndarray) -> np.ndarray:
            """Products with rows of the part, which become candidates."""
            nonlocal measured
            ip = products(q[rows], x[points])  # noqa: B023
            measured += ip.size
            fits = (label[points][None, :] == own[rows][:, None]) == search.same  # noqa: B023
            fits &= (ip >= lo[rows][:, None]) & (ip <= hi[rows][:, None])  # noqa: B023
            if fits.any():
                score[rows], row[rows] = _merge(score[rows], row[rows], np.where(fits, ip, _NONE), points, name, k)  # noqa: B023
            return ip

        def push(rows: np.ndarray, nodes: np.ndarray, ip: np.ndarray) -> None:
            low, high = bounds(norm[rows][:, None], ip.astype(np.float64), tree.squared_norm, radius[nodes][None, :])  # noqa: B023
            inside = (high >= lo[rows][:, None]) & (low <= hi[rows][:, None])  # noqa: B023
            upper[np.ix_(rows, nodes)] = np.where(inside, np.minimum(high, hi[rows][:, None]), -np.inf)  # noqa: B023

        todo = np.arange(len(q))
        push(todo, np.array([0]), measure(todo, centre[:1]))
        while len(todo):
            node = upper[todo].argmax(axis=1)
            best = upper[todo, node]
            go = (best > -np.inf) & ((score[todo, -1] == _NONE) | (best >= score[todo, -1]))
            todo, node = todo[go], node[go]
            upper[todo, node] = -np.inf
            for n in np.unique(node):
                rows = todo[node == n]
                if not len(tree.kids[n]):
                    if len(tree.rows[n]):
                        measure(rows, tree.rows[n])
                    continue
                kids = tree.kids[n]  # the first child's centre is the node's own, which is measured already
                ip = np.concatenate([products(q[rows], x[centre[kids[:1]]]), measure(rows, centre[kids[1:]])], axis=1)
                more = np.array([len(tree.kids[i]) + len(tree.rows[i]) > 0 for i in kids])
                push(rows, kids[more], ip[:, more])
        s, c = np.nonzero(score != _NONE)
        found.append((at + s, row[s, c], score[s, c]))
    return (*(np.concatenate(v) for v in zip(*found, strict=True)), measured)


def prepared(df: DataFrame, anchor: Column, vec_id: str, embedding: str, label: str, scale: float) -> DataFrame:
    """(id, label, dim, vec, norm, wanted) of the rows that take part; ``vec`` is the integers as binary, ``norm`` its square."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            size = np.diff(column.offsets.to_numpy())
            flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            edge = np.concatenate([[0], np.cumsum(size)])
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            good = np.flatnonzero(np.diff(bad[edge]) == 0)
            cells, norm = [], []
            for i in good:
                most = limit(int(size[i]))
                with np.errstate(over="ignore"):
                    whole = np.clip(np.floor(flat[edge[i]:edge[i + 1]] * scale), -most, most)
                cells.append(whole.astype("<i4").tobytes())
                norm.append(float(np.dot(whole, whole)))
            take = pa.array(good)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(size[good].astype(np.int32)),
                 pa.array(cells, pa.binary()), pa.array(norm, pa.float64()), batch.column(3).take(take)],
                names=["id", "label", "dim", "vec", "norm", "wanted"])

    rows = df.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"),
                     F.col(embedding).cast("array<double>").alias("v"), F.coalesce(anchor, F.lit(False)).alias("wanted"))
    rows = rows.where("id is not null and label is not null and v is not null")
    return rows.mapInArrow(run, "id bigint, label bigint, dim int, vec binary, norm double, wanted boolean").distinct()


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(len(column), dim).astype(np.int64)


def top_centres(vectors: DataFrame) -> dict[int, tuple[np.ndarray, float]]:
    """(centres, largest squared norm) of the vector lengths with most rows: first by hash, each next the farthest from those before."""
    sizes = (vectors.groupBy("dim").count().where((F.col("count") > CELL_ROWS) & (F.col("dim") > 0))
             .orderBy(F.desc("count"), "dim").limit(LENGTHS).collect())
    out = {}
    for r in sizes:
        k = max(1, min(CENTRES, r["count"] // CELL_ROWS, CENTRE_BYTES // LENGTHS // (8 * r.dim)))
        rows = vectors.where(F.col("dim") == r.dim)
        norm = F.max("norm").alias("norm")
        squared_norm = float(rows.agg(norm).first()[0])
        pool = _matrix(rows.orderBy(F.xxhash64("vec"), "vec").limit(4 * k).select("vec").toArrow().column(0), r.dim)
        points = lifted(pool, squared_norm)
        chosen, far = [0], np.linalg.norm(points - points[0], axis=1)
        while len(chosen) < min(k, len(pool)):
            chosen.append(int(far.argmax()))
            far = np.minimum(far, np.linalg.norm(points - points[chosen[-1]], axis=1))
        out[r.dim] = (pool[chosen], squared_norm)
    return out


def celled(vectors: DataFrame, centres: dict[int, tuple[np.ndarray, float]]) -> DataFrame:
    """(cls, cell, away): the nearest centre of every vector; vectors of a length without centres are in cell 0 with unbounded radius."""
    known = vectors.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy()
            cell, away = np.zeros(len(dims), np.int32), np.full(len(dims), np.inf)
            for dim in np.unique(dims):
                if int(dim) in known.value:
                    own = np.flatnonzero(dims == dim)
                    tops, squared_norm = known.value[int(dim)]
                    x = lifted(_matrix(batch.column(2).take(pa.array(own)), int(dim)), squared_norm)
                    c = lifted(tops, squared_norm)
                    d = np.sqrt(np.maximum(0.0, 2 * squared_norm - 2 * (x @ c.T)))
                    cell[own] = d.argmin(axis=1)
                    exact = x - c[cell[own]]
                    away[own] = np.sqrt(np.einsum("rd,rd->r", exact, exact)) * (1 + SLACK) + SLACK
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell), pa.array(away)], names=["cls", "cell", "away"])

    return vectors.select("cls", "dim", "vec").mapInArrow(run, "cls bigint, cell int, away double")


def _certain(lower: np.ndarray, upper: np.ndarray, count: np.ndarray, k: int) -> np.ndarray:
    """Cells that may hold one of the k best: k rows are certain at or above some lower bound."""
    order = np.argsort(-lower, kind="stable")
    have = np.cumsum(count[order])
    enough = np.flatnonzero(have >= k)
    return upper >= lower[order[enough[0]]] if len(enough) else np.ones(len(lower), bool)


def visits(asked: DataFrame, centres: dict[int, tuple[np.ndarray, float]], k: int, same: bool) -> DataFrame:
    """(cls, dim, cell, lo, hi): the cells each search must open.

    ``asked`` has cls, dim, vec, tops and own (arrays of cell, radius, rows; at most ``CENTRES``), and windows
    (arrays of lo and hi).
    """
    known = asked.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for cls, dim, raw, tops, own, windows in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
                mine = {o["cell"]: o for o in own or []}
                if same:
                    cells = list(mine.values())
                    count = np.array([c["rows"] for c in cells])
                else:
                    cells = tops
                    count = np.array([c["rows"] - mine[c["cell"]]["rows"] if c["cell"] in mine else c["rows"] for c in cells])
                cell, radius = np.array([c["cell"] for c in cells], np.int64), np.array([c["radius"] for c in cells])
                if dim in known.value:
                    points, squared_norm = known.value[dim]
                    q = np.frombuffer(raw, "<i4")[None, :].astype(np.int64)
                    low, high = bounds(float(np.dot(q[0].astype(np.float64), q[0].astype(np.float64))),
                                       products(q, points[cell])[0].astype(np.float64), squared_norm, radius)
                else:
                    low, high = np.full(len(cells), -np.inf), np.full(len(cells), np.inf)
                for w in windows:
                    lo, hi = w["lo"], w["hi"]
                    open_ = (count > 0) & (high >= lo) & (low <= hi)
                    sure = np.where((low >= lo) & (high <= hi), count, 0)
                    open_ &= _certain(low, high, sure, k)
                    out += [(cls, dim, int(c), lo, hi) for c in cell[open_]]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
            columns = zip(*out, strict=True) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                                             names=["cls", "dim", "cell", "lo", "hi"])

    return asked.select("cls", "dim", "vec", "tops", "own", "windows").mapInArrow(
        run, "cls bigint, dim int, cell int, lo bigint, hi bigint")


def searched(index: DataFrame, queries: DataFrame, parts: DataFrame, k: int, same: bool) -> DataFrame:
    """(cls, lo, hi, hit, score): the k best entries of each search in every part of the cells it opens.

    ``index`` has cls, dim, label, vec, name, cell and part; ``queries`` cls, dim, label, vec, cell, lo and hi.
    """
    asked = attach(queries, parts, ["dim", "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    asked = asked.select("dim", "cell", "part", F.lit(1).alias("side"), "cls", "label", "vec", F.lit(0).cast("long").alias("name"), "lo", "hi")
    none = F.lit(0).cast("long")
    rows = index.select("dim", "cell", "part", F.lit(0).alias("side"), "cls", "label", "vec", "name", none.alias("lo"), none.alias("hi"))
    rows = rows.unionByName(asked).repartition("dim", "cell", "part").sortWithinPartitions("dim", "cell", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, edges in whole_groups(batches, 3):
            dims, side, cls, label, name, lo, hi = (table.column(i).to_numpy() for i in (0, 3, 4, 5, 7, 8, 9))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                ask, have = np.flatnonzero(side[a:b] == 1), np.flatnonzero(side[a:b] == 0)
                if not len(ask) or not len(have):
                    continue
                x = _matrix(table.column(6).slice(a, b - a), int(dims[a]))
                own = Search(x[ask], label[a:b][ask], lo[a:b][ask], hi[a:b][ask], same)
                s, row, score, _ = descend(build(x[have]), x[have], label[a:b][have], name[a:b][have], own, k)
                mine = cls[a:b][ask]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mine[s]), pa.array(own.lo[s]), pa.array(own.hi[s]), pa.array(cls[a:b][have][row]), pa.array(score)],
                    names=["cls", "lo", "hi", "hit", "score"])

    return rows.mapInArrow(run, "cls bigint, lo bigint, hi bigint, hit bigint, score bigint")


def _best(hits: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """(cls, lo, hi, r, id, score): the k best rows of each search; each hit stands for at most k ids."""
    named = hits.join(vectors.select(F.col("cls").alias("hit"), F.slice("ids", 1, k).alias("ids")), "hit")
    rows = named.select("cls", "lo", "hi", "score", F.explode("ids").alias("id"))
    rank = F.row_number().over(W.partitionBy("cls", "lo", "hi").orderBy(F.desc("score"), "id"))
    return rows.withColumn("r", rank).where(F.col("r") <= k)


def mine(df: DataFrame, anchor: Column, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label",
         positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH,
         scale: float = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where ``anchor`` holds.

    A negative's score is at least ``low`` and at most ``high`` percent of the positive's.
    """
    spark = df.sparkSession
    keep = max(positives + 1, negatives)
    with Scratch(spark) as scratch:
        rows = scratch.table(prepared(df, anchor, vec_id, embedding, label, scale))
        if not rows.groupBy("id").count().where("count > 1").isEmpty():
            first = F.row_number().over(W.partitionBy("id").orderBy("label", "dim", "vec", F.desc("wanted")))
            rows = scratch.table(rows.withColumn("r", first).where("r = 1").drop("r"))
        ranked = F.row_number().over(W.partitionBy("dim", "label", "vec").orderBy("id"))
        firsts = rows.select("dim", "label", "vec", "id").withColumn("r", ranked).where(F.col("r") <= keep)
        ids = firsts.groupBy("dim", "label", "vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))
        asked = rows.groupBy("dim", "label", "vec").agg(F.max("wanted").alias("wanted"), F.max("norm").alias("norm"))
        vectors = ids.join(asked, ["dim", "label", "vec"])
        vectors = scratch.table(vectors.withColumn("cls", F.monotonically_increasing_id()))
        centres = top_centres(vectors)
        cells = scratch.table(celled(vectors, centres))
        placed = vectors.select("cls", "dim", "label", F.size("ids").alias("rows")).join(cells, "cls")
        parts = scratch.table(placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / CELL_ROWS).cast("int").alias("parts")))
        balls = scratch.table(placed.groupBy("dim", "cell", "label").agg(F.max("away").alias("radius"), F.sum("rows").alias("rows")))
        listed = F.sort_array(F.collect_list(F.struct("cell", "radius", "rows")))  # at most CENTRES each
        tops = scratch.table(balls.groupBy("dim", "cell").agg(F.max("radius").alias("radius"), F.sum("rows").alias("rows"))
                             .groupBy("dim").agg(listed.alias("tops")))
        own = scratch.table(balls.groupBy("dim", "label").agg(listed.alias("own")))
        index = (vectors.select("cls", "dim", "label", "vec", F.col("ids")[0].alias("name")).join(cells.select("cls", "cell"), "cls"))
        index = attach(index, parts, ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int"))
        queries = vectors.where("wanted").select("cls", "dim", "label", "vec")
        queries = scratch.table(attach(attach(queries, tops, ["dim"], max_rows=LISTS), own, ["dim", "label"], max_rows=LISTS))

        every = F.array(F.struct(F.lit(-_MOST).alias("lo"), F.lit(_MOST).alias("hi")))
        near = visits(queries.withColumn("windows", every), centres, positives + 1, True)
        near = near.join(queries.select("cls", "label", "vec"), "cls")
        best = scratch.table(_best(searched(index, near, parts, positives + 1, True), vectors, positives + 1))
        anchors = rows.where("wanted").join(vectors.select("dim", "label", "vec", "cls"), ["dim", "label", "vec"]).select("id", "cls")
        lists = best.groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("r", "id", "score"))).alias("near"))  # positives + 1 each
        others = F.slice(F.filter("near", lambda p: p["id"] != F.col("anchor_id")), 1, positives)
        pairs = (anchors.withColumnRenamed("id", "anchor_id").join(lists, "cls").select("cls", "anchor_id", F.explode(others).alias("p"))
                 .select("cls", "anchor_id", F.col("p.id").alias("positive_id"), F.col("p.score").alias("positive_score")))

        # the window of a positive score, in integers: ceil(low * p / 100) to floor(high * p / 100)
        down = lambda value: f"({value} - pmod({value}, 100L)) div 100"
        lo, hi = F.expr(f"-({down(f'(-score * {low})')})"), F.expr(down(f"(score * {high})"))
        window = best.select("cls", "score").distinct().select("cls", "score", lo.cast("long").alias("lo"), hi.cast("long").alias("hi"))
        window = scratch.table(window.where("lo <= hi"))
        wanted = window.groupBy("cls").agg(F.collect_set(F.struct("lo", "hi")).alias("windows"))  # positives + 1 each
        open_ = visits(queries.join(wanted, "cls"), centres, negatives, False).join(queries.select("cls", "label", "vec"), "cls")
        hard = _best(searched(index, open_, parts, negatives, False), vectors, negatives)
        hard = hard.select("cls", "lo", "hi", F.col("r").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        ranked = hard.join(window, ["cls", "lo", "hi"]).select("cls", F.col("score").alias("positive_score"), "rank", "negative_id", "negative_score")
        return materialize(pairs.join(ranked, ["cls", "positive_score"]).select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score"))
