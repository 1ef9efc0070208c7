"""Operator 12, token ids in bit-plane files.

Documents are range-sorted by id, become token ids inside the sorted partitions, and the ids of a
partition are cut into chunks of ``CHUNK_IDS``.  A chunk is transposed into planes (bit i, or byte
i, of all its ids), each plane is compressed by zstandard on its own, and the lengths of the
compressed planes are the chunk's index, so one plane can be read without the others: ids below 65,536
leave the upper half of the planes empty.

The files are Parquet tables in one folder, so Spark's writer commits them and lost tasks are
run again: ``chunks`` holds the planes and, per chunk, the pieces of documents in it;
``index`` holds per chunk its partition, its number and the position of its first id in the whole
file, which is all that a reader needs to find a range of ids.

Documents that a chunk's end cuts are digested piece by piece: the checksum of a text
follows from those of its pieces and their lengths, so no document is put together for it.

Defined results
* Every input row is a document, also repeated rows; each has at least the end id.
* A null or empty text is the end id alone.
* Documents stand in ascending order of ``doc_id``, null first; rows that repeat an id by a hash
  of their text.  Equal rows are interchangeable, and any number of them is dealt over
  partitions like other rows.  Ids are integers.
* Other columns are not read.  Empty input gives an empty dataset.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tallyho.llm._join import attach
from tallyho.llm._text import slices
from tallyho.llm.packing import word_ids
from tallyho.session import Scratch, materialize, scratch_path

#: Ids of a chunk (the last one of a partition may have fewer).
CHUNK_IDS = 1 << 16
LEVEL = 1
CHUNK = ("chunk bigint, first bigint, n int, kind string, plane_bytes array<int>, planes binary, "
         "ordinals array<bigint>, doc_ids array<bigint>, starts array<bigint>, lengths array<bigint>, tokens array<bigint>")
PIECE = ("part int, ordinal bigint, doc_id bigint, at bigint, start bigint, length bigint, tokens bigint, crc bigint")
#: Polynomial of the checksum, lowest power in the highest bit.
_POLYNOMIAL = 0xEDB88320


def to_planes(ids: np.ndarray, kind: str = "bit") -> list[bytes]:
    """Planes of unsigned 32-bit ids, lowest first: 32 of bits (8 ids a byte, first id lowest) or 4 of bytes."""
    octets = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if kind == "byte":
        return [octets[:, i].tobytes() for i in range(4)]
    bits = np.unpackbits(octets, axis=1, bitorder="little")
    return [row.tobytes() for row in np.ascontiguousarray(np.packbits(bits, axis=0, bitorder="little").T)]


def from_planes(planes: list[bytes], n: int, kind: str = "bit") -> np.ndarray:
    rows = np.frombuffer(b"".join(planes), np.uint8).reshape(len(planes), -1)
    if kind == "byte":
        return np.ascontiguousarray(rows.T).view("<u4").ravel()
    bits = np.unpackbits(np.ascontiguousarray(rows.T), axis=0, count=n, bitorder="little")
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").ravel()


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo the checksum's."""
    out = 0
    while b:
        if b & 0x80000000:
            out ^= a
        b = (b << 1) & 0xFFFFFFFF
        a = (a >> 1) ^ (_POLYNOMIAL if a & 1 else 0)
    return out


def joined_crc(one: int, two: int, length: int) -> int:
    """crc32 of two byte strings set end to end, the second of ``length`` bytes, from their own: one * x^(8 length) + two."""
    power, step = 0x80000000, 0x00800000  # 1 and x^8
    while length:
        if length & 1:
            power = _times(power, step)
        step, length = _times(step, step), length >> 1
    return _times(one, power) ^ two


def encode(df: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", kind: str = "bit",
           chunk_ids: int = CHUNK_IDS, level: int = LEVEL) -> DataFrame:
    """Chunks (CHUNK and ``part``, which ascends with the ids) of the documents in ascending order of their ids."""
    if kind not in ("bit", "byte"):
        raise ValueError("kind must be bit or byte")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, press = word_ids(tokenizer), zstandard.ZstdCompressor(level=level)
        chunk, position, ordinal = 0, 0, 0
        held: list[tuple[int, int | None, int, np.ndarray, int]] = []  # ordinal, id, start, ids, tokens of each piece
        size = 0

        def out() -> pa.RecordBatch:
            ids = np.concatenate([h[3] for h in held])
            planes = [press.compress(p) for p in to_planes(ids, kind)]
            one = lambda values, kind_of: pa.array([values], pa.list_(kind_of))
            return pa.RecordBatch.from_arrays([
                pa.array([chunk], pa.int64()), pa.array([position], pa.int64()), pa.array([len(ids)], pa.int32()), pa.array([kind]),
                one([len(p) for p in planes], pa.int32()), pa.array([b"".join(planes)], pa.binary()),
                one([h[0] for h in held], pa.int64()), one([h[1] for h in held], pa.int64()),
                one([h[2] for h in held], pa.int64()), one([len(h[3]) for h in held], pa.int64()),
                one([h[4] for h in held], pa.int64())],
                names=["chunk", "first", "n", "kind", "plane_bytes", "planes", "ordinals", "doc_ids", "starts", "lengths", "tokens"])

        for batch in slices(batches, 1):
            ids, first = coder.encode(batch.column(1))
            for d, doc in enumerate(batch.column(0).to_pylist()):
                own, start = ids[first[d]:first[d + 1]], 0
                while start < len(own):
                    piece = own[start:start + chunk_ids - size]
                    held.append((ordinal, doc, start, piece, len(own)))
                    size, start = size + len(piece), start + len(piece)
                    if size == chunk_ids:
                        yield out()
                        chunk, position, held, size = chunk + 1, position + size, [], 0
                ordinal += 1
        if held:
            yield out()

    rows = df.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("mark"),
                     F.monotonically_increasing_id().alias("row"))
    order = ["id", "mark", "row"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
    return ranged.mapInArrow(run, CHUNK).withColumn("part", F.spark_partition_id())


def write_ids(df: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", kind: str = "bit",
              chunk_ids: int = CHUNK_IDS, level: int = LEVEL) -> None:
    """Write the token ids of all documents as a dataset under ``path``."""
    spark = df.sparkSession
    encode(df, tokenizer, doc_id, text, kind, chunk_ids, level).write.mode("overwrite").parquet(f"{path}/chunks")
    chunks = spark.read.parquet(f"{path}/chunks")
    parts = chunks.groupBy("part").agg(F.sum("n").alias("ids"))  # one row a partition
    base = F.sum("ids").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("ids")
    with Scratch(spark) as scratch:
        bases = scratch.table(parts.select("part", base.alias("base")))
        index = attach(chunks.select("part", "chunk", "first", "n"), bases, ["part"])
        index = index.select("part", "chunk", "n", (F.col("base") + F.col("first")).alias("start"))
        index.write.mode("overwrite").parquet(f"{path}/index")


def _decoded(batch: pa.RecordBatch, columns: dict[str, int], i: int, press: zstandard.ZstdDecompressor) -> np.ndarray:
    value = lambda c: batch.column(columns[c])[i].as_py()
    edges, raw = np.concatenate([[0], np.cumsum(value("plane_bytes"))]), value("planes")
    planes = [press.decompress(raw[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return from_planes(planes, value("n"), value("kind"))


def _placed(spark: SparkSession, path: str) -> DataFrame:
    """The chunks and the position of each one's first id in the whole file (``place``)."""
    chunks = spark.read.parquet(f"{path}/chunks")
    index = spark.read.parquet(f"{path}/index").select("part", "chunk", F.col("start").alias("place"))
    return attach(chunks, index, ["part", "chunk"])


def read_pieces(spark: SparkSession, path: str) -> DataFrame:
    """(part, ordinal, doc_id, at, start, length, tokens, crc, ids) of the pieces of documents in each chunk, read from the files.

    ``at`` is a piece's place in the whole file, ``start`` that in its document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            at = {c: i for i, c in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                ids = _decoded(batch, at, i, press)
                cell = lambda c: batch.column(at[c]).slice(i, 1).flatten()  # noqa: B023, E731
                length = cell("lengths").to_numpy()
                edge = np.concatenate([[0], np.cumsum(length)])
                raw = [ids[a:b].tobytes() for a, b in zip(edge[:-1], edge[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(raw), batch.column(at["part"])[i].as_py(), np.int32)), cell("ordinals"), cell("doc_ids"),
                    pa.array(batch.column(at["place"])[i].as_py() + edge[:-1]), cell("starts"), cell("lengths"), cell("tokens"),
                    pa.array([zlib.crc32(x) for x in raw], pa.int64()), pa.array(raw, pa.binary())],
                    names=["part", "ordinal", "doc_id", "at", "start", "length", "tokens", "crc", "ids"])

    return _placed(spark, path).mapInArrow(run, f"{PIECE}, ids binary")


def read_range(spark: SparkSession, path: str, lo: int, hi: int) -> DataFrame:
    """(at, ids): the ids at places lo to hi - 1 of the whole file, chunk by chunk; other chunks are not decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            names = {c: i for i, c in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                place = batch.column(names["place"])[i].as_py()
                ids = _decoded(batch, names, i, press)[max(0, lo - place):max(0, hi - place)]
                yield pa.RecordBatch.from_arrays([pa.array([max(lo, place)], pa.int64()), pa.array([ids.tobytes()], pa.binary())],
                                                 names=["at", "ids"])

    rows = _placed(spark, path).where((F.col("place") < hi) & (F.col("place") + F.col("n") > lo))
    return rows.select("place", "n", "kind", "plane_bytes", "planes").mapInArrow(run, "at bigint, ids binary")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read from the files."""

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs = []
            for pieces in batch.column(3).to_pylist():
                crc = pieces[0]["crc"]
                for p in pieces[1:]:
                    crc = joined_crc(crc, p["crc"], 4 * p["length"])
                crcs.append(crc)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(3)), pa.array(crcs, pa.int64())],
                                             names=["doc_id", "start", "n_tokens", "ids_crc32"])

    with Scratch(spark) as scratch:
        pieces = scratch.table(read_pieces(spark, path).drop("ids"))
        whole = pieces.where("length = tokens").select("doc_id", F.col("at").alias("start"), F.col("tokens").alias("n_tokens"),
                                                       F.col("crc").alias("ids_crc32"))
        cut = (pieces.where("length < tokens").groupBy("part", "ordinal", "doc_id", "tokens")
               .agg(F.min("at").alias("at"), F.sort_array(F.collect_list(F.struct("start", "length", "crc"))).alias("pieces")))
        cut = cut.select("doc_id", "at", "tokens", "pieces").mapInArrow(
            combine, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
        return materialize(whole.unionByName(cut))


def new_dataset(spark: SparkSession) -> str:
    """A path for a dataset in the shared folder of the session."""
    return scratch_path(spark, f"tables/{uuid.uuid4().hex}")
