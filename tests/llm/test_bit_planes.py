"""Bit-plane files of token ids (operator 12): exact round trips."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyho.llm import bit_planes, catalog
from tests.llm.helpers import SCHEMA, documents, frame

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def plain_ids(texts):
    from tokenizers import Tokenizer
    coder = Tokenizer.from_file(TOKENIZER)
    return [[*coder.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), min_size=1, max_size=70), st.sampled_from(["bit", "byte"]))
def test_planes_round_trip(ids, kind):
    planes = bit_planes.to_planes(np.array(ids, np.uint32), kind)
    assert len(planes) == (32 if kind == "bit" else 4)
    assert bit_planes.from_planes(planes, len(ids), kind).tolist() == ids


def test_a_bit_plane_holds_that_bit():
    ids = np.arange(64, dtype=np.uint32) * 977
    plane = np.unpackbits(np.frombuffer(bit_planes.to_planes(ids)[5], np.uint8), bitorder="little")
    assert plane.tolist() == [(int(i) >> 5) & 1 for i in ids]
    assert bit_planes.to_planes(ids, "byte")[1] == bytes((int(i) >> 8) & 255 for i in ids)


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=40), st.binary(max_size=4000))
def test_joined_checksums(one, two):
    assert bit_planes.joined_crc(zlib.crc32(one), zlib.crc32(two), len(two)) == zlib.crc32(one + two)


@pytest.mark.parametrize("kind,chunk", [("bit", 1 << 16), ("byte", 1000), ("bit", 64)])
def test_documents_come_back(spark, kind, chunk):
    rows = documents()
    path = bit_planes.new_dataset(spark)
    bit_planes.write_ids(frame(spark, rows), path, TOKENIZER, kind=kind, chunk_ids=chunk)
    ids = plain_ids([r[1] for r in rows])
    got = bit_planes.digests(spark, path).collect()
    assert sorted((r.doc_id is not None, r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == sorted(
        (r[0] is not None, r[0], len(i), crc(i)) for r, i in zip(rows, ids, strict=True))
    # every id stands once, documents ascend, starts are gapless
    order = sorted(got, key=lambda r: r.start)
    at = 0
    for r in order:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in order] == sorted((r.doc_id for r in order), key=lambda i: (i is not None, i))
    assert at == sum(map(len, ids))
    # a window of the whole file, and the sizes of the chunks
    whole = {r.start: r for r in order}
    third = order[len(order) // 3]
    part = bit_planes.read_range(spark, path, third.start, third.start + third.n_tokens).orderBy("at").collect()
    assert zlib.crc32(b"".join(bytes(p.ids) for p in part)) == whole[third.start].ids_crc32
    assert {r.kind for r in spark.read.parquet(f"{path}/chunks").select("kind").distinct().collect()} == {kind}
    assert spark.read.parquet(f"{path}/chunks").where(f"n > {chunk}").isEmpty()


def test_pieces_carry_ids(spark):
    rows = documents()
    path = bit_planes.new_dataset(spark)
    bit_planes.write_ids(frame(spark, rows), path, TOKENIZER, chunk_ids=5000)
    want = {r[0]: i for r, i in zip(rows, plain_ids([r[1] for r in rows]), strict=True)}
    pieces = bit_planes.read_pieces(spark, path).where("doc_id = 307").orderBy("start").collect()
    assert len(pieces) > 5
    assert np.concatenate([np.frombuffer(bytes(p.ids), "<u4") for p in pieces]).tolist() == want[307]


def test_empty_table(spark):
    path = bit_planes.new_dataset(spark)
    bit_planes.write_ids(spark.createDataFrame([], SCHEMA), path, TOKENIZER)
    out = bit_planes.digests(spark, path)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.collect() == []
    assert bit_planes.read_range(spark, path, 0, 10).collect() == []


def test_query_over_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    ids = dict(zip([d.doc_id for d in docs], plain_ids([d.text for d in docs]), strict=True))
    at = 0
    want = []
    for doc in sorted(ids):
        want.append((doc, at, len(ids[doc]), crc(ids[doc])))
        at += len(ids[doc])
    assert sorted(map(tuple, catalog.op12_bit_planes(spark, sf).collect())) == want
