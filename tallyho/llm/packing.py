"""Operator 6, packing along a space-filling curve.

Documents become token ids, ids become a hashed document vector, vectors are
projected to a few dimensions and get a Hilbert key.  Sorted by that key the
documents form one stream in which neighbours are alike; the stream is cut every
``length`` ids.  What remains at its end is cut at powers of two, so no sequence is
padded.

Only (key, id, number of tokens) is range-sorted; the ids stay in their written table
and get their place in the stream by a join on the row number.  The pieces are cut from
that table when the result is read, so their ids are not written a second time.

Defined results
* Every input row is a document, also repeated rows; each has at least the end id.
* A null or empty text is the end id alone.
* Documents with equal keys are ordered by id (null first), then by row number, so a
  group of copies of any size is range-sorted like other rows.
* The output has the columns listed in ``PIECES``; other input columns are not read.
  Empty input gives empty output.
"""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyho.llm._hilbert import hilbert_index
from tallyho.llm._text import Words, binaries, hash_words, mix64, slices, words_of
from tallyho.session import Scratch, materialize

LENGTH = 2048
END_ID = 1
#: Width of the hashed vector, dimensions and bits of each dimension of the curve.
BUCKETS, DIMS, BITS = 1024, 3, 16
SEED = 11
#: Distinct words whose ids a Python worker keeps; beyond that it starts anew.
KNOWN_WORDS = 1_500_000
#: Words that are handed to the tokenizer at once.
LEARN_WORDS = 20_000
#: Documents whose hashed vectors are held at once.
VECTOR_DOCS = 1024
#: Bytes of ids after which a task hands on its pieces.
FLUSH_BYTES = 4 << 20
_LETTER = np.array([chr(b).isalnum() and b < 128 for b in range(256)])
_MARK = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])
PIECES = ("doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, "
          "offset bigint")


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from 256 on."""
    kept = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in kept]
    return {**{b: chr(b) for b in kept}, **{b: chr(256 + i) for i, b in enumerate(other)}}


class WordIds:
    """Token ids of words.

    White space separates the tokenizer's pieces, so the ids of a text are those of its
    words; marks behind a letter or digit are a piece of their own.  Ids are kept by the
    hash of the lower-cased span (the tokenizer lower-cases); words with "<" may hold a
    special token, so they are neither cut nor folded.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.letters = _byte_letters()
        self.clear()

    def clear(self) -> None:
        self.keys, self.at, self.n = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _ids(self, raw: list[bytes]) -> list[list[int]]:
        """Ids of spans.  A span of letters is one piece, which goes to the model as it is; others go through the tokenizer."""
        out: list[list[int]] = []
        rest: list[int] = []
        texts = [x.decode("utf-8", "replace") for x in raw]
        one = self.tokenizer.model.tokenize
        for i, text in enumerate(texts):
            small = text.lower()
            if small.isascii():
                plain = small.isalpha()
            else:
                small = unicodedata.normalize("NFC", text).lower()
                plain = small.isalpha() and max(map(ord, small)) < 0x250
                small = "".join(map(self.letters.__getitem__, small.encode()))
            if plain:
                out.append([t.id for t in one(small)])
            else:
                out.append([])
                rest.append(i)
        for i, e in zip(rest, self.tokenizer.encode_batch([texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> None:
        flats, counts = [self.flat], []
        for lo in range(0, len(keys), LEARN_WORDS):
            cut = slice(lo, lo + LEARN_WORDS)
            ids = self._ids([data[a:b].tobytes() for a, b in zip(starts[cut], ends[cut], strict=True)])
            counts.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            flats.append(np.fromiter((i for x in ids for i in x), np.uint32, int(counts[-1].sum())))
        n = np.concatenate(counts)
        at = len(self.flat) + np.cumsum(n) - n
        self.flat = np.concatenate(flats)
        place = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.n = (np.insert(x, place, y) for x, y in ((self.keys, keys), (self.at, at), (self.n, n)))

    def _spans(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, document, may hold a special token) of words cut before their last marks."""
        data, starts, ends = words.data, words.starts, words.ends
        opened = np.zeros(len(data) + 1, np.int32)
        np.cumsum(data == ord("<"), out=opened[1:])
        odd = opened[ends] > opened[starts]
        mark = _MARK[data]
        other = np.concatenate([[-1], np.maximum.accumulate(np.where(mark, -1, np.arange(len(data))))])
        last = np.maximum(other[ends], starts)  # the last byte that is no mark
        before = data[np.maximum(last - 1, 0)]
        letter = _LETTER[data[last]] | ((last > starts) & (before == 0xC3) & ~np.isin(data[last], [0x97, 0xB7]))
        tail = np.flatnonzero((last + 1 < ends) & letter & ~mark[last] & ~odd)
        at = np.insert(starts, tail + 1, last[tail] + 1)
        to = np.insert(ends, tail, last[tail] + 1)
        return at, to, np.insert(words.doc_of_word(), tail, words.doc_of_word()[tail]), np.insert(odd, tail, False)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, first) with the end id after each text."""
        words = words_of(column, hashed=False)
        starts, ends, doc, odd = self._spans(words)
        hashes = hash_words(words.data, starts, ends)
        odd = np.flatnonzero(odd)
        hashes[odd] = mix64(hash_words(words.data, starts[odd], ends[odd], lower=False))
        unique, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.keys) > KNOWN_WORDS:
            self.clear()
        place = np.minimum(np.searchsorted(self.keys, unique), max(0, len(self.keys) - 1))
        new = self.keys[place] != unique if len(self.keys) else np.ones(len(unique), bool)
        if new.any():
            self._learn(words.data, starts[where[new]], ends[where[new]], unique[new])
        row = np.searchsorted(self.keys, unique)
        n, at = self.n[row][inverse], self.at[row][inverse]
        begin = np.concatenate([[0], np.cumsum(n)])
        first = begin[np.searchsorted(doc, np.arange(words.docs + 1))] + np.arange(words.docs + 1)
        out = np.full(first[-1], END_ID, np.uint32)
        body = np.ones(len(out), bool)
        body[first[1:] - 1] = False
        out[body] = self.flat[np.repeat(at - begin[:-1], n) + np.arange(begin[-1])]
        return out, first


_word_ids: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The worker's tokenizer, loaded once."""
    if path not in _word_ids:
        _word_ids[path] = WordIds(path)
    return _word_ids[path]


def curve_keys(ids: np.ndarray, first: np.ndarray, buckets: int = BUCKETS, dims: int = DIMS, bits: int = BITS,
               seed: int = SEED) -> np.ndarray:
    """Hilbert keys of documents given as flat ids."""
    plane = np.random.default_rng(seed).standard_normal((buckets, dims))
    bucket = (mix64(np.arange(int(ids.max(initial=0)) + 1, dtype=np.uint64)) % np.uint64(buckets)).astype(np.int64)
    keys = []
    for lo in range(0, len(first) - 1, VECTOR_DOCS):
        hi = min(lo + VECTOR_DOCS, len(first) - 1)
        own = ids[first[lo]:first[hi]]
        doc = np.repeat(np.arange(hi - lo), np.diff(first[lo:hi + 1]))
        cell = doc * buckets + bucket[own]
        vector = np.sqrt(np.bincount(cell, minlength=(hi - lo) * buckets).reshape(hi - lo, buckets))
        norm = np.sqrt((vector * vector).sum(axis=1, keepdims=True))
        point = (vector / np.maximum(norm, 1e-12)) @ plane
        grid = np.clip((np.tanh(point) + 1) / 2 * (1 << bits), 0, (1 << bits) - 1)
        keys.append(hilbert_index(grid.astype(np.int64), bits))
    return np.concatenate(keys) if keys else np.zeros(0, np.uint64)


def pieces(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def tail_cuts(total: int, length: int) -> list[int]:
    """Positions where the sequences after the last full one begin, and the end: powers of two, largest first."""
    at = total // length * length
    cuts = [at]
    for power in (1 << b for b in range(length.bit_length() - 1, -1, -1)):
        if power < length and (total - at) >= power:
            at += power
            cuts.append(at)
    return cuts


def pack(df: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """Pieces (PIECES) of all documents; ``ids`` are little-endian unsigned 32-bit token ids."""
    spark = df.sparkSession

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_ids(tokenizer)
        for batch in slices(batches, 1):
            ids, first = coder.encode(batch.column(1))
            keys = curve_keys(ids, first)
            small = ids.astype(np.uint16) if len(ids) == 0 or coder.tokenizer.get_vocab_size() <= 1 << 16 else ids
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(keys.astype(np.int64)), pa.array(np.diff(first)),
                pa.array(np.full(batch.num_rows, small.dtype.itemsize, np.int32)),
                binaries(small, first).cast(pa.binary())], names=["doc_id", "key", "n", "width", "ids"])

    with Scratch(spark) as scratch:
        encoded = materialize(
            df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
            .mapInArrow(encode, "doc_id bigint, key bigint, n bigint, width int, ids binary")
            .withColumn("row", F.monotonically_increasing_id()))
        order = ["key", "doc_id", "row"]
        ranged = scratch.table(encoded.select("key", "doc_id", "row", "n").repartitionByRange(*order)
                               .withColumn("part", F.spark_partition_id()))
        totals = ranged.groupBy("part").agg(F.sum("n").alias("n"))
        before = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n")
        base = totals.select("part", before.alias("base"))  # one row a partition
        inside = F.sum("n").over(W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow))
        placed = materialize(ranged.withColumn("to", inside).join(F.broadcast(base), "part")
                               .select("row", (F.col("base") + F.col("to") - F.col("n")).alias("at")))
        total = ranged.agg(F.sum("n")).first()[0] or 0
        cuts = np.array(tail_cuts(total, length), np.int64)

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            full, rows, held = int(cuts[0]), [], 0
            for batch in batches:
                for i in range(batch.num_rows):
                    doc, at, width, raw = (batch.column(c)[i].as_py() for c in range(4))
                    ids = np.frombuffer(raw, np.uint16 if width == 2 else np.uint32).astype("<u4")
                    end = at + len(ids)
                    inner = range((at // length + 1) * length, min(end, full + 1), length)
                    edges = [at, *inner, *(int(c) for c in cuts[1:] if at < c < end), end]
                    for a, b in zip(edges[:-1], edges[1:], strict=True):
                        tail = int(np.searchsorted(cuts, a, side="right")) - 1
                        seq, begin = (a // length, a // length * length) if a < full else (full // length + tail, int(cuts[tail]))
                        rows.append((doc, a - at, b - a, ids[a - at:b - at].tobytes(), len(ids), seq, a - begin))
                    held += len(raw)
                    if held > FLUSH_BYTES:
                        yield pieces(rows)
                        rows, held = [], 0
            if rows:
                yield pieces(rows)

        return encoded.join(placed, "row").select("doc_id", "at", "width", "ids").mapInArrow(cut, PIECES)
