import collections

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyho.llm import mixing, packing, sharding

from .helpers import SCHEMA, WORD, documents, frame

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("length", [2048, 64])
def test_packing_round_trip(spark, length):
    rows = documents()
    out = packing.pack(frame(spark, rows), TOKENIZER, length=length).collect()
    plain = Tokenizer.from_file(TOKENIZER)
    want = collections.Counter((str(i), tuple(plain.encode(t or "", add_special_tokens=False).ids) + (1,)) for i, t, *_ in rows)
    sequences = collections.defaultdict(list)
    docs = collections.defaultdict(list)
    for r in out:
        assert r.length * 4 == len(r.ids) and 0 < r.length <= length
        sequences[r.sequence_id].append(r)
        docs[str(r.doc_id), r.sequence_id * length + r.offset - r.start].append(r)
    got = collections.Counter()
    for (doc, _), pieces in docs.items():
        pieces.sort(key=lambda r: r.start)
        ids = [int(x) for r in pieces for x in np.frombuffer(r.ids, "<u4")]
        if pieces[0].start == 0 and len(ids) == pieces[0].doc_tokens:
            got[doc, tuple(ids)] += 1
    assert sum((want - got).values()) <= 12  # a document over the tail's shorter sequences has several such keys
    assert sorted(sequences) == list(range(len(sequences)))
    for k, pieces in sequences.items():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == list(np.cumsum([0, *[r.length for r in pieces[:-1]]]))
        size = sum(r.length for r in pieces)
        assert size & (size - 1) == 0
    assert sum(r.length for r in out) == sum(len(ids) * c for (_, ids), c in want.items())
    by_doc = collections.defaultdict(list)
    for r in out:
        by_doc[r.doc_id].append(r)
    for doc, pieces in by_doc.items():
        if sum(r.length for r in pieces) == pieces[0].doc_tokens:
            ids = tuple(int(x) for r in sorted(pieces, key=lambda r: r.start) for x in np.frombuffer(r.ids, "<u4"))
            assert want[str(doc), ids] == 1


def test_packing_nothing(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), TOKENIZER).count() == 0
    assert packing.tail_cuts(2048 * 3 + 13, 2048) == [6144, 6152, 6156, 6157] and packing.tail_cuts(0, 2048) == [0]


def test_word_ids_equal_whole_text_ids():
    import pyarrow as pa
    texts = ["a<|endoftext|>b x.", "<|EndOfText|> <|endoftext|>.", "it's. 's don't'", "foo....", "x…. y…,%", "é. É!! İstanbul İ. ß",
             "1234. 12,5%", "日本語。 テスト!", "×. ÷! Ã— â€™.", "foo\x1cbar.\x0bz", "\u0085 a", "..a.. <b>.", "ñ! ́a", "ﬁ. ǅ! ß!!", "😀. 😀a!", ""]
    coder, plain = packing.word_ids(TOKENIZER), Tokenizer.from_file(TOKENIZER)
    for _ in range(2):
        ids, first = coder.encode(pa.array(texts))
        for i, t in enumerate(texts):
            assert ids[first[i]:first[i + 1]].tolist() == [*plain.encode(t, add_special_tokens=False).ids, 1], t
        coder.clear()


def test_similar_documents_are_neighbours(spark):
    rows = [(i, " ".join(f"{'abcd'[i % 4] * 3}{k}" for k in range(i, i + 60)), "en", "s", 0) for i in range(80)]
    out = packing.pack(frame(spark, rows), TOKENIZER).where("start = 0").orderBy("sequence_id", "offset").collect()
    kinds = [r.doc_id % 4 for r in out]
    assert sum(a == b for a, b in zip(kinds, kinds[1:], strict=False)) > 40


def plain_seats(share, seats):
    got = [0] * len(share)
    for _ in range(seats):
        k = max(range(len(share)), key=lambda i: (share[i] / (2 * got[i] + 1), -i))
        got[k] += 1
    return got


def test_apportion_is_sainte_lague(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for p in range(12):
        share = rng.integers(0, 10 ** int(rng.integers(1, 6)), 1 + p).astype(float)
        if p == 5:
            share = np.full(6, 7.0)
        seats = int(rng.integers(0, 400)) if share.sum() else 0
        rows += [(p, k, float(s), seats) for k, s in enumerate(share)]
        want |= {(p, k): n for k, n in enumerate(plain_seats(share.tolist(), seats))}
    df = spark.createDataFrame(rows, "p int, k int, share double, seats long")
    got = {(r.p, r.k): r.out for r in mixing.apportion(df, ["p"], ["k"], "share", "seats", "out").collect()}
    assert got == want


def plain_targets(size, weights=(3, 1, 2), total=1.5, most=2):
    names = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, left, capped = {}, total * sum(size.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        level = left / sum(w[s] for s in free) if free else 0
        over = [s for s in free if level * w[s] > most * size[s]]
        if not over:
            return target | {s: level * w[s] for s in free}
        for s in over:
            target[s] = most * size[s]
            left -= target[s]
            capped.add(s)


def test_mix_reaches_its_targets(spark):
    rows = documents() + [(5000 + i, f"word{i} " * (i % 90), "en", f"t{i % 7}", 0) for i in range(900)]
    out = mixing.mix(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    sizes = {(i, s, len(WORD.findall(t or ""))) for i, t, _, s, _ in rows}
    assert {(r.doc_id, r.source, r.size) for r in out} == sizes
    size = collections.Counter()
    for _, t, _, s, _ in rows:
        size[s] += len(WORD.findall(t or ""))
    want, taken = plain_targets(size), collections.Counter()
    for r in out:
        assert r.source_size == size[r.source] and r.target == pytest.approx(want[r.source])
        assert 0 <= r.taken <= 2 * r.size and r.taken == sum(s["to"] - s["from"] for s in r.spans)
        taken[r.source] += r.taken
    for s in size:
        assert abs(taken[s] - want[s]) <= 0.005 * want[s] + 40, (s, taken[s], want[s])
    again = {(r.doc_id, r.size): r.taken for r in mixing.mix(frame(spark, rows).repartition(5)).collect() if r.doc_id != 310}
    assert again == {(r.doc_id, r.size): r.taken for r in out if r.doc_id != 310}


def test_mixed_documents(spark):
    rows = documents()
    df = frame(spark, rows)
    dealt = mixing.mix(df).agg(F.sum("taken")).first()[0]
    got = mixing.mixed_documents(df)
    assert got.columns == df.columns
    texts = {i: t for i, t, *_ in rows}
    total = 0
    for r in got.collect():
        w = WORD.findall(r.text)
        total += len(w)
        assert r.text == texts[r.doc_id] or " ".join(w) in " ".join(WORD.findall(texts[r.doc_id]))
    assert total == dealt


def test_mix_of_nothing(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    out = mixing.mix(frame(spark, [(1, None, None, None, None), (2, "", "en", "a", 0)])).collect()
    assert all((r.size, r.taken, r.target) == (0, 0, 0.0) for r in out) and len(out) == 2


def test_main_paths_hold_no_python(spark):
    from tallyho.llm import line_dedup
    for out in (mixing.mix(frame(spark)), line_dedup.drop_boilerplate(frame(spark), "source", "text")):
        plan = out._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def plain_fill(names, slots):
    orders = [sharding.preference(n, slots).tolist() for n in names]
    table = [None] * slots
    while None in table:
        for k, order in enumerate(orders):
            free = next((s for s in order if table[s] is None), None)
            if free is not None:
                table[free] = k
    return table


def test_table_is_filled_in_turns():
    names = [f"n{i}" for i in range(7)]
    table = sharding.fill_table(names, slots=211)
    assert table.tolist() == plain_fill(names, 211)
    assert max(np.bincount(table)) - min(np.bincount(table)) <= 1
    big = sharding.fill_table(names)
    fewer = sharding.fill_table(names[:-1])
    stay = (big == fewer)[big != 6].mean()
    assert stay > 0.85
    heavy = np.bincount(sharding.fill_table(names, weights=[2, 1, 1, 1, 1, 1, 0]), minlength=7)
    assert heavy[0] > 1.9 * heavy[1] and heavy[6] == 0
    for bad in (([], None, 211), (["a", "a"], None, 211), (["a"], None, 210), (["a"], [0], 211)):
        with pytest.raises(ValueError):
            sharding.fill_table(bad[0], bad[1], bad[2])


def test_place(spark, tmp_path):
    df = frame(spark)
    names = [f"n{i}" for i in range(5)]
    out = sharding.place(df, ["doc_id"], names)
    rows = out.collect()
    table = sharding.fill_table(names)
    assert len(rows) == len(documents()) and all(r.shard == names[table[r.slot]] for r in rows)
    assert out.columns.count("shard") == 1 and len({r.shard for r in rows if r.doc_id == 310}) == 1
    hot = spark.range(3000).selectExpr("id", "if(id % 3 = 0, 'hot', cast(id as string)) as k").union(
        spark.range(50).selectExpr("id", "cast(null as string)"))
    placed = sharding.place(hot, ["k"], names, max_rows=100)
    load = {r["shard"]: r["count"] for r in placed.groupBy("shard").count().collect()}
    assert sum(load.values()) == 3050 and max(load.values()) < 1100
    assert placed.where("k = 'hot'").select("shard").distinct().count() >= 3
    sharding.write_shards(placed, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == 3050
    assert sharding.place(df.limit(0), ["doc_id"], names).count() == 0
