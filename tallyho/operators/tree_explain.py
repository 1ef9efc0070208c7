"""Shapley attributions of tree ensembles (M12, tree models).

The value of a set of features is the tree's output when only they are known: at a split on another feature both
sides count by their cover, the weight of the training rows that went there (path-dependent expectation).  A leaf
with value v and d distinct features on its path adds to feature i

    v * (o_i - z_i) * integral over t of the product over j != i of (o_j * t + z_j * (1 - t)),

where o_j is 1 if the row passes all splits on feature j along the path and z_j is the product of their cover shares:
the weights |S|! (d - |S| - 1)! / d! are the integrals of t^|S| (1 - t)^(d - 1 - |S|).  The integrand is a polynomial of degree d - 1,
so a Gauss-Legendre rule of d / 2 points is exact.  It depends on a row only through which o_j are 1, so it is tabulated
for each pattern and rows look it up.  Summed over leaves and trees (boosting: times the tree weight, in margin space;
forest: averaged, in probability of class 1) plus the expected output, the attributions add up to the model's output.

Neighbouring leaves of a tree are looked up together as a unit: a row's cell says between which of the unit's thresholds each
feature is, and the unit's table has the sums of its leaves' values for each cell.  Units grow up the tree to ``CELLS`` cells.

The node table (model-sized) is read from the fitted model and broadcast; rows are processed in Arrow batches, one
vectorised step per unit, never per row.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel, RandomForestClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tallyho import spec
from tallyho.operators.boosting import BoostedTreesModel
from tallyho.operators.explain import rollup_attributions, top_factors
from tallyho.operators.features import slot_table
from tallyho.operators.forest import ForestModel
from tallyho.session import delete_path, scratch_path

#: Distinct features of a path up to which all patterns are tabulated at once; beyond, those that occur.
TABLE_FEATURES = 8
#: Cells of a unit of leaves at most.
CELLS = 512
#: Bytes of such tables that a task keeps from one batch of rows to the next; further ones are made anew.
TABLE_BYTES = 64 << 20
#: Partitions for each core over which rows are dealt before they are explained.
DEAL = 2


@dataclass
class TreeNodes:
    """Nodes by number, the root 0; leaves have left -1.  ``groups[i]`` marks the categories that go left at a categorical split."""

    left: np.ndarray
    right: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    cover: np.ndarray
    groups: dict[int, np.ndarray]
    weight: float

    def goes_left(self, node: int, x: np.ndarray) -> np.ndarray:
        column = x[:, self.feature[node]]
        if node in self.groups:
            marks = self.groups[node]
            inside = (column >= 0) & (column < len(marks))
            return inside & marks[np.where(inside, column, 0).astype(np.int64)]
        return column <= self.threshold[node]


@dataclass
class Leaf:
    """A leaf's value, the distinct features of its path, their cover shares, and per feature its splits (node, whether left)."""

    value: float
    features: list[int]
    shares: np.ndarray
    splits: list[list[tuple[int, bool]]]


def leaves(tree: TreeNodes) -> list[Leaf]:
    return list(leaves_by_node(tree).values())


def leaves_by_node(tree: TreeNodes) -> dict[int, Leaf]:
    out, todo = {}, [(0, ())]
    while todo:
        node, path = todo.pop()
        if tree.left[node] >= 0:
            for child, side in ((tree.left[node], True), (tree.right[node], False)):
                share = tree.cover[child] / tree.cover[node] if tree.cover[node] > 0 else 0.0
                todo.append((int(child), (*path, (node, side, share))))
            continue
        features = sorted({int(tree.feature[n]) for n, _, _ in path})
        own = [[(n, side, share) for n, side, share in path if tree.feature[n] == f] for f in features]
        out[node] = Leaf(float(tree.value[node]), features, np.array([math.prod(s for _, _, s in steps) for steps in own]),
                         [[(n, side) for n, side, _ in steps] for steps in own])
    return out


@lru_cache(maxsize=64)
def _rule(points: int) -> tuple[np.ndarray, np.ndarray]:
    """Gauss-Legendre points and weights on 0 to 1."""
    t, w = np.polynomial.legendre.leggauss(points)
    return (t + 1) / 2, w / 2


def pattern_values(shares: np.ndarray, patterns: np.ndarray) -> np.ndarray:
    """(pattern, feature): Shapley values of a leaf of value 1 for rows that pass the features of a bit pattern."""
    d = len(shares)
    t, w = _rule(max(1, (d + 1) // 2))
    passed = (patterns[:, None] >> np.arange(d)) & 1
    term = passed[:, :, None] * t + (shares[:, None] * (1 - t))[None]   # pattern, feature, point
    ones = np.ones((len(patterns), 1, len(t)))
    before = np.concatenate([ones, term[:, :-1].cumprod(axis=1)], axis=1)
    after = np.concatenate([term[:, :0:-1].cumprod(axis=1)[:, ::-1], ones], axis=1)
    return (passed - shares) * ((before * after) @ w)


def expected_output(trees: list[TreeNodes]) -> float:
    return float(sum(t.weight * leaf.value * math.prod(leaf.shares) for t in trees for leaf in leaves(t)))


@dataclass
class Unit:
    """Leaves that are looked up together, the thresholds of each feature on their paths, and their categorical splits."""

    leaves: list[Leaf]
    cuts: dict[int, tuple[float, ...]]
    groups: tuple[int, ...]
    #: Distinct features of the paths, and what the bin of a feature (by the thresholds of all trees) adds to a row's cell.
    features: list[int] = field(default_factory=list)
    steps: list[tuple[int, np.ndarray]] = field(default_factory=list)

    @property
    def cells(self) -> int:
        return math.prod(len(c) + 1 for c in self.cuts.values()) << len(self.groups)

    def with_other(self, other: Unit) -> Unit:
        cuts = {f: tuple(sorted({*self.cuts.get(f, ()), *other.cuts.get(f, ())})) for f in (*self.cuts, *other.cuts)}
        return Unit(self.leaves + other.leaves, cuts, tuple(sorted({*self.groups, *other.groups})))


def units(tree: TreeNodes) -> list[Unit]:
    """The leaves of a tree in units; a leaf whose own path has more than ``CELLS`` cells is one alone."""
    found: dict[int, list[Unit]] = {}
    for number, leaf in leaves_by_node(tree).items():
        nodes = [n for splits in leaf.splits for n, _ in splits]
        cuts: dict[int, set[float]] = {}
        for n in nodes:
            if n not in tree.groups:
                cuts.setdefault(int(tree.feature[n]), set()).add(float(tree.threshold[n]))
        found[number] = [Unit([leaf], {f: tuple(sorted(c)) for f, c in cuts.items()}, tuple(sorted(n for n in nodes if n in tree.groups)))]
    todo = [(0, False)]
    while todo:  # children before their parents
        n, seen = todo.pop()
        if n in found:
            continue
        kids = int(tree.left[n]), int(tree.right[n])
        if not seen:
            todo += [(n, True), *((k, False) for k in kids)]
            continue
        one, two = (found.pop(k) for k in kids)
        both = one[0].with_other(two[0]) if len(one) == len(two) == 1 else None
        found[n] = [both] if both and both.cells <= CELLS else one + two
    for unit in found[0]:
        unit.features = sorted({f for leaf in unit.leaves for f in leaf.features})
    return found[0]


@dataclass
class TreeTables:
    """A tree, its units of leaves, and for each unit its values by cell or None."""

    tree: TreeNodes
    units: list[Unit]
    tables: list[np.ndarray | None]


class Prepared(list):
    """``TreeTables`` of the trees, and the thresholds of all of them by feature."""

    cuts: dict[int, np.ndarray]


def _table(tree: TreeNodes, leaf: Leaf, patterns: np.ndarray) -> np.ndarray:
    """(feature, pattern): attributions of a leaf."""
    return np.ascontiguousarray((tree.weight * leaf.value * pattern_values(leaf.shares, patterns)).T)


def _codes(leaf: Leaf, goes: dict[int, np.ndarray], n: int) -> np.ndarray:
    """Pattern of each of ``n`` rows or cells: bit j if it passes all splits on feature j."""
    code = np.zeros(n, np.int64)
    for j, splits in enumerate(leaf.splits):
        sides = [goes[node] if side else ~goes[node] for node, side in splits]
        code |= (sides[0] if len(sides) == 1 else np.logical_and.reduce(sides)).astype(np.int64) << j
    return code


def _unit_table(tree: TreeNodes, unit: Unit) -> np.ndarray:
    """(feature, cell): attributions of all leaves of a unit."""
    cells, factor, goes = np.arange(unit.cells), 1, {}
    state = {}
    for f, cuts in unit.cuts.items():
        state[f], factor = cells // factor % (len(cuts) + 1), factor * (len(cuts) + 1)
    for n in unit.groups:
        goes[n], factor = cells // factor % 2 == 1, factor * 2
    for leaf in unit.leaves:
        for n in (n for splits in leaf.splits for n, _ in splits if n not in goes):
            f = int(tree.feature[n])
            goes[n] = state[f] <= unit.cuts[f].index(float(tree.threshold[n]))
    out, at = np.zeros((len(unit.features), len(cells))), {f: i for i, f in enumerate(unit.features)}
    for leaf in unit.leaves:
        code, d = _codes(leaf, goes, len(cells)), len(leaf.features)
        if d > TABLE_FEATURES:
            found, code = np.unique(code, return_inverse=True)
        values = _table(tree, leaf, found if d > TABLE_FEATURES else np.arange(1 << d))
        for j, f in enumerate(leaf.features):
            out[at[f]] += values[j].take(code)
    return out


def prepared(trees: list[TreeNodes]) -> Prepared:
    """Units of the trees' leaves, with tables of up to ``TABLE_BYTES``."""
    out, room = Prepared(), TABLE_BYTES
    found: dict[int, set[float]] = {}
    for tree in trees:
        for n in np.flatnonzero(tree.left >= 0):
            if int(n) not in tree.groups:
                found.setdefault(int(tree.feature[n]), set()).add(float(tree.threshold[n]))
    out.cuts = {f: np.array(sorted(c)) for f, c in found.items()}
    for tree in trees:
        own, tables = [u for u in units(tree) if u.features], []
        for unit in own:
            fits = unit.cells <= CELLS
            room -= len(unit.features) * unit.cells * 8 if fits else 0
            tables.append(_unit_table(tree, unit) if fits and room >= 0 else None)
            factor = 1
            for f, cuts in unit.cuts.items():
                passed = np.zeros(len(out.cuts[f]) + 1, np.int64)
                passed[np.searchsorted(out.cuts[f], cuts) + 1] = factor
                unit.steps.append((f, passed.cumsum()))
                factor *= len(cuts) + 1
        out.append(TreeTables(tree, own, tables))
    return out


def shapley_values(trees: list[TreeNodes] | Prepared, x: np.ndarray) -> np.ndarray:
    """(rows, slots) attributions of encoded rows."""
    out = np.zeros(x.shape[::-1])  # by slot, so that what a unit adds to a slot is one run of memory
    x = np.asfortranarray(x)
    trees = trees if isinstance(trees, Prepared) else prepared(trees)
    rank = {f: np.searchsorted(cuts, x[:, f]) for f, cuts in trees.cuts.items()}  # NaN goes right everywhere
    cell, part, more = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64), np.zeros(len(x))
    for t in trees:
        for unit, table in zip(t.units, t.tables, strict=True):
            if unit.cells > CELLS:  # one leaf of a long path: the patterns that occur
                leaf = unit.leaves[0]
                goes = {n: t.tree.goes_left(n, x) for splits in leaf.splits for n, _ in splits}
                found, at = np.unique(_codes(leaf, goes, len(x)), return_inverse=True)
                for f, values in zip(leaf.features, _table(t.tree, leaf, found), strict=True):
                    out[f] += values.take(at)
                continue
            cell[:] = 0
            for f, passed in unit.steps:
                cell += passed.take(rank[f], out=part, mode="clip")
            for i, n in enumerate(unit.groups):
                cell += t.tree.goes_left(n, x) * (unit.cells >> (len(unit.groups) - i))
            for f, values in zip(unit.features, _unit_table(t.tree, unit) if table is None else table, strict=True):
                out[f] += values.take(cell, out=more, mode="clip")
    return out.T


def saved_trees(spark, clf) -> list[TreeNodes]:
    """Trees of a fitted classifier, from its own table or its saved form."""
    if isinstance(clf, BoostedTreesModel):
        step = clf.body["step"]
        start = TreeNodes(np.array([-1]), np.array([-1]), np.zeros(1, np.int64), np.zeros(1), np.array([clf.start]), np.ones(1), {}, 1.0)
        return [start, *(TreeNodes(t["left"], t["right"], t["feature"], t["threshold"], t["value"], t["cover"], {}, step)
                         for t in clf.trees)]
    if isinstance(clf, ForestModel):
        own = clf.trees
        return [TreeNodes(t["left"], t["right"], t["feature"], t["threshold"], t["value"], t["cover"], {}, 1 / len(own)) for t in own]
    if not isinstance(clf, (GBTClassificationModel, RandomForestClassificationModel)):
        raise TypeError(f"tree attributions need a boosted or random forest model, got {type(clf).__name__}")
    path = scratch_path(spark, f"models/{uuid.uuid4().hex}")
    clf.write().overwrite().save(path)
    nodes = spark.read.parquet(path + "/data").select(
        "treeID", "nodeData.id", "nodeData.prediction", "nodeData.impurityStats", "nodeData.leftChild",
        "nodeData.rightChild", "nodeData.split.featureIndex", "nodeData.split.leftCategoriesOrThreshold",
        "nodeData.split.numCategories").toPandas()
    margin = isinstance(clf, GBTClassificationModel)
    weights = dict(enumerate(clf.treeWeights)) if margin else {t: 1.0 / clf.getNumTrees for t in nodes.treeID.unique()}
    delete_path(spark, path)
    trees = []
    for number, g in nodes.groupby("treeID"):
        size = int(g.id.max()) + 1
        t = TreeNodes(np.full(size, -1), np.full(size, -1), np.zeros(size, np.int64), np.zeros(size), np.zeros(size), np.zeros(size),
                      {}, float(weights[number]))
        for r in g.itertuples(index=False):
            i = int(r.id)
            stats = np.asarray(r.impurityStats, dtype=float)
            t.left[i], t.right[i], t.feature[i] = int(r.leftChild), int(r.rightChild), max(int(r.featureIndex), 0)
            # a regression tree's statistics are (rows, sum, sum of squares), a classification tree's the rows of each class
            t.cover[i] = stats[0] if margin else stats.sum()
            t.value[i] = float(r.prediction) if margin else (stats[1] / stats.sum() if stats.sum() > 0 and len(stats) > 1 else 0.0)
            sides = list(r.leftCategoriesOrThreshold) if r.leftCategoriesOrThreshold is not None else []
            if int(r.numCategories) >= 0:
                t.groups[i] = np.isin(np.arange(int(r.numCategories)), [int(c) for c in sides])
            elif sides:
                t.threshold[i] = float(sides[0])
        trees.append(t)
    return trees


def tree_contributions(model: PipelineModel, df: DataFrame, keep: list[str],
                       name: str = "contributions") -> DataFrame:
    """Per-slot Shapley values (``array<double>``) and ``bias``, the expected output, for each row of ``df``."""
    spark = df.sparkSession
    trees = saved_trees(spark, model.stages[-1])
    bias = expected_output(trees)
    bc, key = spark.sparkContext.broadcast(trees), uuid.uuid4().hex
    # every row takes a step for each leaf of each tree: a file of a few MB, which is read as one partition, is dealt over all cores
    enc = PipelineModel(stages=model.stages[:-1]).transform(df.repartition(DEAL * spark.sparkContext.defaultParallelism))
    x = enc.select(*keep, vector_to_array("features").alias("_f"))
    out_schema = T.StructType([*[f for f in x.schema.fields if f.name != "_f"],
                               T.StructField(name, T.ArrayType(T.DoubleType())),
                               T.StructField("bias", T.DoubleType())])

    at = x.columns.index("_f")

    def fn(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            values = shapley_values(_tables_of(key, bc), rows)
            first = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
            parts = pa.ListArray.from_arrays(pa.array(first), pa.array(np.ascontiguousarray(values).ravel()))
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != at), parts, pa.array(np.full(batch.num_rows, bias))],
                                             names=[*(n for i, n in enumerate(batch.schema.names) if i != at), name, "bias"])

    return x.mapInArrow(fn, out_schema)


#: Tables of the model that this Python worker explained last, by key: its next task has them.
_LAST: dict[str, Prepared] = {}


def _tables_of(key: str, trees) -> Prepared:
    if key not in _LAST:
        _LAST.clear()
        _LAST[key] = prepared(trees.value)
    return _LAST[key]


def explain_trees(model: PipelineModel, df: DataFrame, keep: list[str], k: int = spec.TOP_FACTORS) -> DataFrame:
    """Tree attributions rolled up to base features, and the top ``k``."""
    _, slot_base, bases = slot_table(model)
    x = tree_contributions(model, df, keep)
    return top_factors(rollup_attributions(x, "contributions", slot_base, bases), k=k)

