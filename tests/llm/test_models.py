import collections
import math
import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyho.llm import pitman_yor, quality

from .helpers import SCHEMA, documents, frame, prose, words


def test_scores_and_counts(spark, monkeypatch):
    monkeypatch.setattr(pitman_yor, "BUCKET_TOKENS", 9000)
    monkeypatch.setattr(pitman_yor, "CHUNK_TOKENS", 4000)
    rows = documents()
    train = F.crc32(F.col("doc_id").cast("string")) % 5 != 1
    out = pitman_yor.score(frame(spark, rows), train).collect()
    held = [i is None or zlib.crc32(str(i).encode()) % 5 == 1 for i, *_ in rows]
    tokens = [words(t) + ["\n"] for _, t, *_ in rows]
    c = collections.Counter(x for h, w in zip(held, tokens, strict=True) if not h for x in w)
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), h, len(w), sum(c[x] > 0 for x in w), n,
                   round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6))
                  for (i, *_), h, w in zip(rows, held, tokens, strict=True))
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in out)
    same = [r for r in out if r.doc_id == 310]
    assert same[0] == same[1]


def test_score_without_training_rows(spark):
    assert pitman_yor.score(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0
    rows = pitman_yor.score(frame(spark, documents()[:3] + [(9, None, None, None, None)]), F.lit(False)).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.score == pytest.approx(0.0) for r in rows)


def model_of(rows):
    """The model's buckets, totals and corpus over (context class, word, count) entries, without Spark."""
    split = collections.defaultdict(list)
    for context, word, count in rows:
        split[word % 3].append((word, context, count))
    buckets = []
    for b, entries in split.items():
        entries.sort()
        vocabulary, size = np.unique([w for w, _, _ in entries], return_counts=True)
        buckets.append(pitman_yor.Bucket(b, vocabulary.astype(np.uint64).tobytes(), size.astype(np.uint8).tobytes(),
                                         bytes(c for _, c, _ in entries), np.array([n for *_, n in entries], "<i8").tobytes()))
    customers = np.zeros(pitman_yor.CLASSES, np.int64)
    for context, _, count in rows:
        customers[context] += count
    corpus = pitman_yor.Corpus(customers, int(customers.sum()), sum(len(b.words) for b in buckets), 0.6, 0.5)
    history = []
    for _ in range(4):
        tables, parent, dishes = np.zeros(pitman_yor.CLASSES, np.int64), 0, 0
        for b in buckets:
            *_, (t, p, s) = b.sweeps(corpus, history)
            tables += np.bincount(b.context, weights=t, minlength=pitman_yor.CLASSES).astype(np.int64)
            parent, dishes = parent + p.sum(), dishes + s.sum()
        history.append(pitman_yor.Totals(tables, int(parent), int(dishes)))
    return buckets, corpus, history


def test_predictive_probabilities_sum_to_one():
    rng = random.Random(2)
    rows = [(c, w, rng.choice([1, 1, 2, 5, 40, 3000])) for c in range(6) for w in rng.sample(range(200), 60)]
    buckets, corpus, history = model_of(rows)
    last = history[-1]
    for context in range(6):
        weight = (pitman_yor.THETA + corpus.discount * last.tables[context]) / (pitman_yor.THETA + corpus.customers[context])
        total = weight * corpus.base(last) / (pitman_yor.THETA + last.customers)  # the unknown word
        for b in buckets:
            *_, (tables, customers, dishes) = b.sweeps(corpus, history[:-1])
            total += weight * corpus.parent(customers, dishes, last).sum()
            mine = b.context == context
            total += ((b.count - corpus.discount * tables) / (pitman_yor.THETA + corpus.customers[context]))[mine].sum()
            assert (tables >= 1).all() and (tables <= b.count).all() and (dishes <= customers).all()
        assert total == pytest.approx(1.0, abs=1e-9)


def test_seating_in_parties_agrees_with_one_by_one():
    rng = np.random.default_rng(0)
    n, customers, odds, growth, d = 400, 600, 3.0, 0.02, 0.5
    got = pitman_yor.seat(np.full(n, customers), np.full(n, odds), np.full(n, growth), d, rng)
    plain = []
    for _ in range(n):
        t = 1
        for seated in range(1, customers):
            new = odds + growth * t
            t += rng.random() < new / (new + seated - d * t)
        plain.append(t)
    assert abs(got.mean() - np.mean(plain)) < 4 * np.sqrt((got.var() + np.var(plain)) / n) + 0.4


def plain_start(rows):
    """Scores of (text, train) rows when every pair of a word and the word before it has one table, by a plain double loop."""
    texts = [(words(t) + ["\n"], train) for t, train in rows]
    steps = [list(zip(["\n", *w], w, strict=False)) for w, _ in texts]
    pairs = collections.Counter(s for x, (_, train) in zip(steps, texts, strict=True) if train for s in x)
    n = collections.Counter()
    for (u, _), k in pairs.items():
        n[u] += k
    tables, customers = collections.Counter(u for u, _ in pairs), collections.Counter(w for _, w in pairs)

    def rate(counts):
        ones, twos = (sum(v == k for v in counts.values()) for k in (1, 2))
        return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones + twos else 0.5

    d, e, v = rate(pairs), rate(customers), len(customers)

    def p(u, w):
        parent = (customers[w] - e * (w in customers) + (1 + e * v) / (v + 1)) / (1 + len(pairs))
        return (pairs[u, w] - d * ((u, w) in pairs) + (1 + d * tables[u]) * parent) / (1 + n[u])

    return [sum(math.log10(p(u, w)) for u, w in x) for x in steps]


@pytest.mark.parametrize("bucket", [10**6, 700])
def test_start_matches_plain_contexts(spark, monkeypatch, bucket):
    monkeypatch.setattr(pitman_yor, "BUCKET_TOKENS", bucket)
    monkeypatch.setattr(pitman_yor, "CHUNK_TOKENS", 600)
    rng = random.Random(5)
    texts = [None, "", "one"] + [" ".join(rng.choice(["the", "the", "of", f"w{int(rng.paretovariate(0.7)) % 900}"])
                                          for _ in range(rng.randrange(1, 80))) for _ in range(150)]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(texts)]
    train = F.col("doc_id") % 4 != 1
    if bucket == 700:
        chunks = pitman_yor.token_chunks(frame(spark, rows).select("doc_id", "text", F.lit(True))).withColumn("chunk", F.lit(1))
        assert 2 <= len(pitman_yor.frequent_words(chunks, 6000)) <= 12
    out = {r.doc_id: r.score for r in pitman_yor.score(frame(spark, rows), train, sweeps=0).collect()}
    want = plain_start([(t, i % 4 != 1) for i, t in enumerate(texts)])
    assert [out[i] for i in range(len(texts))] == pytest.approx(want, abs=1e-9)


def test_each_preceding_word_is_a_context_of_its_own(spark, monkeypatch):
    """300 words that each have one follower: more than any fixed number of classes keeps apart."""
    monkeypatch.setattr(pitman_yor, "BUCKET_TOKENS", 9000)
    rows = [(30 * i + k, f"a{i} b{i}", "en", "s", 0) for i in range(300) for k in range(31)]
    out = pitman_yor.score(frame(spark, rows), F.col("doc_id") % 31 != 0).collect()
    # log10 of 1 / 300 for the first word; its follower and the end are all but certain
    assert min(r.score for r in out) > -math.log10(300) - 0.1


def test_sweeps_of_many_buckets_agree_with_those_of_one(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(i, prose(rng, rng.randrange(20, 120), 60) + " the end the", "en", "s", 0) for i in range(120)]
    total = {}
    for bucket in (10**6, 600):
        monkeypatch.setattr(pitman_yor, "BUCKET_TOKENS", bucket)
        out = pitman_yor.score(frame(spark, rows), F.col("doc_id") % 5 != 1).collect()
        total[bucket] = {held: sum(r.score for r in out if r.held_out == held) for held in (True, False)}
    for held in (True, False):
        assert total[600][held] == pytest.approx(total[10**6][held], rel=0.004)


def labelled(n=600):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        text = prose(rng, rng.randrange(30, 200))
        if not good:
            text = [text.upper(), " ".join(w + "!!" for w in text.split()), " ".join([text.split()[0]] * 90), "a | b | c |"][i % 4]
        rows.append((i, text, "en", "s", len(text)))
        labels.append((i, int(good)))
    return rows, labels


def test_quality_on_held_out_rows(spark):
    rows, labels = labelled()
    rows += [(900, None, None, None, None), (901, "", "en", "s", 0), (902, "word " * 50_000, "en", "s", 1), (902, "word " * 50_000, "en", "s", 1)]
    df = frame(spark, rows)
    given = spark.createDataFrame([x for x in labels if x[0] % 5] + [(None, 1), (3, None), (99999, 0)], "doc_id long, quality int")
    out = quality.score(df, quality.train(df, given)).collect()
    assert len(out) == len(rows) and out[0].size == "clash" and 0 <= min(r.score for r in out) and max(r.score for r in out) <= 1
    want = dict(labels)
    held = [r for r in out if r.doc_id in want and r.doc_id % 5 == 0]
    assert sum(r.predicted == want[r.doc_id] for r in held) / len(held) >= 0.97
    assert len({r.score for r in out if r.doc_id in (900, 901)}) == 1
    again = quality.score(df, quality.train(df, given)).collect()
    assert sorted(r.score for r in out) == sorted(r.score for r in again)


def test_quality_without_labels(spark):
    df = frame(spark, documents()[:4])
    empty = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.score(df, quality.train(df, empty)).collect()} == {0.5}
    one = spark.createDataFrame([(0, 1), (1, 1)], "doc_id long, quality int")
    assert all(r.score == pytest.approx(0.75) for r in quality.score(df, quality.train(df, one)).collect())
    assert quality.score(df.limit(0), quality.Model()).count() == 0


def test_pair_tables_learn_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y)
    assert (0, 1) in model.pairs
    assert ((model.score(x) > 0.5) == y).mean() > 0.9


def test_rows_that_repeat_an_id_stay_within_the_bound_of_the_fit(spark):
    rows = [(7, f"text {i}", "en", "s", 6) for i in range(50)] + [(8, None, "en", "s", None), (9, "other", "en", "s", 5)]
    given = spark.createDataFrame([(7, 1), (8, 0), (9, 0)], "doc_id long, quality int")
    got = quality.training_sample(frame(spark, rows), given, "doc_id", "text", "quality", 3).collect()
    assert sorted(r["__q_label"] for r in got) == [0, 0, 1] and {None, "other"} < {r.text for r in got}


def test_asks_hold_little_of_a_chunk():
    """A chunk's asks leave in small batches, and no more is held than a few arrays of its tokens."""

    class Frame:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):  # noqa: N802
            self.run = run
            return self

    rng, n = np.random.default_rng(3), 400_000
    vocabulary = np.array([f"w{i}" for i in range(20_000)])
    texts = [" ".join(vocabulary[x]) for x in np.array_split(rng.integers(0, len(vocabulary), n), 400)]
    docs = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts), pa.array([True] * len(texts))],
                                      names=["id", "text", "train"])
    frame = Frame()
    pitman_yor.token_chunks(frame)
    chunk = next(frame.run(iter([docs])))
    pitman_yor.asks(frame, 4, np.zeros(0, np.uint64))
    row = pa.RecordBatch.from_arrays([pa.array([0], pa.int64()), *[chunk.column(c) for c in ("train", "n", "words", "places", "tokens")]],
                                     names=["chunk", "train", "n", "words", "places", "tokens"])
    tracemalloc.start()
    most = max(batch.nbytes for batch in frame.run(iter([row])))
    peak = tracemalloc.get_traced_memory()[1] / n
    tracemalloc.stop()
    assert most < 2 * pitman_yor.BATCH_BYTES, most
    assert peak < 65, peak
