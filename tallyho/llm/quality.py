"""Operator 7, a generalised additive model with pairwise interactions.

Texts become a few numeric features.  The model is a sum of one look-up table per
feature and one per chosen pair of features; the tables are learnt by boosting
shallow trees, one feature after the other in a cycle, at a small learning rate.
A text is scored by looking up its bins and adding.

The model is fitted on at most ``FIT_ROWS`` labelled rows, the first by a hash of the
id; everything else covers all rows: every text is read whole and scored.

Defined results
* Every input row is scored and returned once, also repeated rows; a null text is
  scored as an empty one.  Labels, language, source and id are never inputs.
* Labels that are null, or whose document is missing, are not learnt from; several
  labels of a document count each.  Without any label every score is 0.5, with labels
  of one kind it is the smoothed rate of label 1.
* Added columns replace columns of these names.  Empty input gives empty output.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyho.llm._text import Words, distinct, shingles, slices, words_of

#: Most labelled rows that the fit reads.
FIT_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, LEAVES, RIDGE = 120, 60, 0.1, 3, 5.0
THRESHOLD = 0.3

FEATURES = [
    "log_words", "bytes_per_word", "upper_share", "digit_share", "punctuation_share", "symbol_share",
    "exclamation_share", "wide_share", "lines_per_word", "distinct_words", "top_word_share", "adjacent_repeats",
    "distinct_triples", "longest_word", "capital_words", "words_with_symbol", "stops_per_word", "repeated_lines",
]


def _table(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[np.frombuffer(chars.encode(), np.uint8)] = True
    return t


_UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGIT = _table("0123456789")
_PUNCT = _table(".,;:'\"()-?")
_SYMBOL = _table("#$%&*@^~|<>{}[]\\=+_/")
_SHOUT = _table("!")
_STOP = _table(".!?")


def _sums(mask: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Number of set bytes in each [edges[i], edges[i + 1])."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return np.diff(total[edges])


def _line_repeats(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Share of a document's non-empty lines that repeat an earlier one."""
    out = np.zeros(len(offsets) - 1)
    raw = data.tobytes()
    for d in range(len(out)):
        lines = [x for x in raw[offsets[d]:offsets[d + 1]].split(b"\n") if x]
        out[d] = 1 - len(set(lines)) / len(lines) if lines else 0.0
    return out


def features(words: Words) -> np.ndarray:
    """(documents, FEATURES) of a slice; all zero for a text without words."""
    data, off, docs = words.data, words.offsets, words.docs
    size, n = np.maximum(1, np.diff(off)), words.per_doc
    count = np.maximum(1, n)
    doc = words.doc_of_word()
    per = lambda table: _sums(table[data], off) / size
    length = words.ends - words.starts
    vocabulary, first = distinct(words.hashes, words.first)
    order = np.lexsort((words.hashes, doc))
    h, d = words.hashes[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    runs = np.diff(np.append(np.flatnonzero(new), len(h)))
    top, longest = np.zeros(docs), np.zeros(docs)
    np.maximum.at(top, d[new], runs)
    np.maximum.at(longest, doc, length)
    again = np.zeros(len(doc), bool)
    again[1:] = (words.hashes[1:] == words.hashes[:-1]) & (doc[1:] == doc[:-1])
    triples, t_first = shingles(words, 3)
    by_word = lambda flag: np.bincount(doc, weights=flag, minlength=docs) / count
    marks = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_SYMBOL[data], out=marks[1:])
    columns = [
        np.log1p(n), np.diff(off) / count, per(_UPPER), per(_DIGIT), per(_PUNCT), per(_SYMBOL), per(_SHOUT),
        _sums(data >= 128, off) / size, _sums(data == 10, off) / count, np.diff(first) / count, top / count, by_word(again),
        np.diff(distinct(triples, t_first)[1]) / np.maximum(1, np.diff(t_first)), longest,
        by_word(_UPPER[data[words.starts]]), by_word(marks[words.ends] > marks[words.starts]),
        _sums(_STOP[data], off) / count, _line_repeats(data, off),
    ]
    out = np.stack([np.asarray(c, float) for c in columns], axis=1)
    out[n == 0] = 0.0
    return out


@dataclass
class Model:
    """Look-up tables: ``edges[f]`` are the bin borders of feature f, ``tables[f]`` its values by bin."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, (e, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += t[np.searchsorted(e, x[:, f], side="right")]
        for (a, b), t in zip(self.pairs, self.pair_tables, strict=True):
            total += t[np.searchsorted(self.pair_edges[a], x[:, a], side="right"),
                       np.searchsorted(self.pair_edges[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-total))


def _borders(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.arange(1, bins) / bins)) if len(values) else np.zeros(0)


def _best_split(g: np.ndarray, h: np.ndarray, lo: int, hi: int) -> tuple[float, int]:
    """Gain and place of the best cut of bins [lo, hi)."""
    if hi - lo < 2:
        return 0.0, lo
    gl, hl = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
    G, H = g[lo:hi].sum(), h[lo:hi].sum()
    gain = gl ** 2 / (hl + RIDGE) + (G - gl) ** 2 / (H - hl + RIDGE) - G ** 2 / (H + RIDGE)
    k = int(np.argmax(gain))
    return float(gain[k]), lo + k + 1


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Step function over ordered bins with at most ``leaves`` pieces, grown by best gain."""
    cuts = [0, len(g)]
    for _ in range(leaves - 1):
        found = max(((*_best_split(g, h, a, b),) for a, b in zip(cuts[:-1], cuts[1:], strict=True)), default=(0.0, 0))
        if found[0] <= 1e-9:
            break
        cuts = sorted([*cuts, found[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + RIDGE)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of a tree of depth two on a grid: one cut of the rows, one cut of the columns in each half."""
    best, out = _best_split(g.sum(axis=1), h.sum(axis=1), 0, len(g))
    values, total = np.zeros_like(g), best
    for rows in (slice(0, out), slice(out, len(g))):
        gc, hc = g[rows].sum(axis=0), h[rows].sum(axis=0)
        values[rows] = _tree(gc, hc, 2)
        total += _best_split(gc, hc, 0, len(gc))[0]
    return total, values


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Cyclic boosting on the logistic loss: single features first, then the pairs that gain most on what is left."""
    if not len(y):
        return Model()
    rate = (y.sum() + 1) / (len(y) + 2)
    model = Model(base=float(np.log(rate / (1 - rate))))
    if y.min() == y.max():
        return model
    model.edges = [_borders(x[:, f], BINS) for f in range(x.shape[1])]
    model.pair_edges = [_borders(x[:, f], PAIR_BINS) for f in range(x.shape[1])]
    bins = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(model.edges)]
    coarse = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(model.pair_edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f, table in enumerate(model.tables):
            g, h = slopes()
            step = RATE * _tree(np.bincount(bins[f], g, len(table)), np.bincount(bins[f], h, len(table)), LEAVES)
            table += step
            total += step[bins[f]]

    def grid(a: int, b: int, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shape = (len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1)
        cell = coarse[a] * shape[1] + coarse[b]
        return tuple(np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (g, h))

    g, h = slopes()
    gains = [(-_pair_tree(*grid(a, b, g, h))[0], a, b) for a in range(x.shape[1]) for b in range(a + 1, x.shape[1])]
    model.pairs = [(a, b) for _, a, b in sorted(gains)[:PAIRS]]
    model.pair_tables = [np.zeros((len(model.pair_edges[a]) + 1, len(model.pair_edges[b]) + 1)) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (a, b), table in zip(model.pairs, model.pair_tables, strict=True):
            step = RATE * _pair_tree(*grid(a, b, *slopes()))[1]
            table += step
            total += step[coarse[a], coarse[b]]
    return model


def training_sample(df: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, rows: int) -> DataFrame:
    """At most ``rows`` labelled texts.  The labels are bounded before the join, so they can be broadcast; of the
    rows that repeat an id the text of the smallest hash is taken."""
    chosen = (labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull())
              .select(F.col(doc_id).alias("__q_id"), F.col(label).cast("int").alias("__q_label"))
              .orderBy(F.xxhash64("__q_id"), "__q_id", "__q_label").limit(rows))
    joined = df.join(F.broadcast(chosen), F.col(doc_id) == F.col("__q_id")).select("__q_id", "__q_label", F.col(text).alias("text"))
    first = F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("first")
    return joined.groupBy("__q_id", "__q_label").agg(first).select("first.text", "__q_label")


def train(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
          rows: int = FIT_ROWS) -> Model:
    """Fit on a bounded sample of the labelled rows; features are computed by tasks, the tables on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 0):
            x = features(words_of(batch.column(0)))
            yield pa.RecordBatch.from_arrays([batch.column(1), *(pa.array(c) for c in x.T.copy())],
                                             names=["label", *FEATURES])

    schema = ", ".join(["label int", *(f"{f} double" for f in FEATURES)])
    got = training_sample(df, labels, doc_id, text, label, rows).mapInArrow(run, schema).toArrow()
    x = np.stack([got.column(f).to_numpy() for f in FEATURES], axis=1) if got.num_rows else np.zeros((0, len(FEATURES)))
    order = np.lexsort(x.T) if len(x) else np.zeros(0, int)  # one order of rows whatever the tasks return first
    return fit(x[order], got.column("label").to_numpy()[order].astype(float))


def score(df: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Add ``score`` and ``predicted`` to every row of ``df``."""
    df = df.drop("score", "predicted")
    at = df.columns.index(text)
    known = df.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            p = known.value.score(features(words_of(batch.column(at))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p)], names=[*batch.schema.names, "score"])

    return df.mapInArrow(run, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
