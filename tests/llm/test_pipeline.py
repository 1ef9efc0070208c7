"""The pipeline against plain-Python versions of its stages, each on the rows that Spark's stage before it kept."""

import collections
import random

import pytest

import corpus_pipeline
from tallyho.llm import quality

from .helpers import SCHEMA, WORD, documents, prose
from .test_placement import plain_targets
from .test_text_operators import brute_groups, brute_lines


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    import random
    rng = random.Random(12)
    rows = documents()
    labels = [(i, 1) for i, t, *_ in rows if i is not None and i < 300]
    for i in range(60):
        good = i % 3 > 0
        text = prose(rng, 60 + i)
        body = f"top of page\n{text}\nend" if good else " ".join(w.upper() + "!!" for w in text.split())
        rows.append((1000 + i, body, "en", "site", len(body)))
        labels.append((1000 + i, int(good)))
    folder = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    steps, docs = [], spark.read.parquet(f"{folder}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(folder)).write.parquet(f"{folder}/step{k}")
        docs = spark.read.parquet(f"{folder}/step{k}")
        steps.append(docs)
    return str(folder), rows, labels, steps


def plain(df):
    return sorted(((r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in df.collect()), key=str)


def test_quality_stage_keeps_clean_documents(spark, corpus):
    folder, rows, labels, steps = corpus
    kept = plain(steps[0])
    assert set(map(str, kept)) <= set(map(str, rows))
    ids = {r[0] for r in kept}
    assert {i for i, q in labels if q} <= ids and not ids & {i for i, q in labels if not q}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    good = quality.score(docs, model).where("predicted = 1").count()
    assert good == len(kept)


def test_further_columns_of_any_name_pass_through(spark, corpus):
    folder, rows, _, _ = corpus
    docs = spark.createDataFrame(rows, SCHEMA)
    names = ["n_lines", "n_dropped", "score", "predicted", "a.b", "x`y", "__gone", "size", "id", "d_text"]
    for name in names:
        quoted = name.replace("`", "``")
        docs = docs.selectExpr("*", f"coalesce(doc_id, -1) + 777 as `{quoted}`")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        kept = out.collect()
        assert kept and all(r[name] == (-1 if r.doc_id is None else r.doc_id) + 777 for r in kept for name in names)


def test_line_stage(corpus):
    before, after = plain(corpus[3][0]), plain(corpus[3][1])
    texts = brute_lines([(r[3], r[1]) for r in before], 0.1, 5)
    want = sorted(((i, t, lang, s, None if t is None else len(t)) for (i, _, lang, s, _), t in zip(before, texts, strict=True)), key=str)
    assert after == want and not any("top of page" in (r[1] or "") for r in after)


def test_near_duplicate_stage(corpus):
    before, after = plain(corpus[3][1]), plain(corpus[3][2])
    _, find = brute_groups(before)
    want, seen = [], set()
    for r in before:
        if r[0] is None or (find(r[0]) == r[0] and r[0] not in seen):
            want.append(r)
            seen.add(r[0])
    assert after == sorted(want, key=str)


def test_near_duplicate_stage_takes_five_words_and_four_fifths(spark):
    rng = random.Random(31)
    rows, gone = [], set()
    for i in range(24):  # 50 words with one changed: 41 / 51 of five words, 45 / 51 of three; with two changed 36 / 56
        base = [f"b{rng.randrange(10**9)}" for _ in range(50)]
        rows.append((i, " ".join(base)))
        for place in ((25,) if i % 2 else (15, 30)):
            base[place] = f"x{rng.randrange(10**9)}"
        rows.append((100 + i, " ".join(base)))
    long = [f"c{rng.randrange(10**9)}" for _ in range(300)]
    rows.append((50, " ".join(long)))
    for k in range(6):  # 266 / 326
        long[20 + 45 * k] = "changed"
    rows.append((51, " ".join(long)))
    sets = {i: {tuple(t.split()[k:k + 5]) for k in range(len(t.split()) - 4)} for i, t in rows}
    for b, y in sets.items():
        if any(a < b and 100 * len(x & y) >= 80 * len(x | y) for a, x in sets.items()):
            gone.add(b)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()}
    assert gone == {51} | {100 + i for i in range(1, 24, 2)} and kept == set(sets) - gone


def test_mixing_stage(corpus):
    before, after = plain(corpus[3][2]), plain(corpus[3][3])
    size, taken, own = collections.Counter(), collections.Counter(), collections.Counter()
    for _, t, _, s, _ in before:
        size[s] += len(WORD.findall(t or ""))
    for i, t, _, s, n in after:
        taken[s] += len(WORD.findall(t))
        own[str(i)] += len(WORD.findall(t))
        assert n == len(t)
    want = plain_targets(size)
    assert all(abs(taken[s] - want[s]) <= 0.005 * want[s] + 40 for s in size)
    assert all(own[str(i)] <= 2 * len(WORD.findall(t or "")) for i, t, *_ in before if i is not None)


def test_packing_stage_and_run(spark, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer
    folder, _, _, steps = corpus
    plain_tokens = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    total = sum(len(plain_tokens.encode(r[1], add_special_tokens=False).ids) + 1 for r in plain(steps[3]))
    packed = steps[4].collect()
    assert sum(r.length for r in packed) == total
    by = collections.Counter()
    for r in packed:
        by[r.sequence_id] += r.length
    assert all(n & (n - 1) == 0 and n <= 2048 for n in by.values())
    run = corpus_pipeline.run(spark, folder).collect()
    assert sorted(map(str, run)) == sorted(map(str, packed))


def test_empty_tables_pass_through(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert corpus_pipeline.ORACLE_SQL is None and len(corpus_pipeline.STAGES) == 5
