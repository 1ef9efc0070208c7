import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyho.llm import _text, jaccard_join, line_dedup, substring_dedup
from tallyho.llm._shared import sorted_shared_keys
from tallyho.session import Scratch

from .helpers import SCHEMA, documents, frame, union_find, words


def test_words_and_shingles_match_plain_python():
    texts = [t for _, t, *_ in documents()]
    w = _text.words_of(pa.array(texts, pa.string()))
    plain = [words(t) for t in texts]
    assert w.per_doc.tolist() == [len(p) for p in plain]
    of = {}
    for h, x in zip(w.hashes.tolist(), [x for p in plain for x in p], strict=True):
        assert of.setdefault(x, h) == h
    assert len(set(of.values())) == len(of)
    sets, first = _text.distinct(*_text.shingles(w, 3))
    count = [len({tuple(p[k:k + 3]) for k in range(max(1, len(p) - 2))}) if p else 0 for p in plain]
    assert np.diff(first).tolist() == count
    for size in (1, 1000):
        got = list(_text.slices(iter([pa.record_batch([pa.array(texts, pa.string())], names=["t"])]), 0, size))
        assert [x for b in got for x in b.column(0).to_pylist()] == texts


def brute_lines(rows, ratio, least):
    lines = [(i, host, [x.replace("\t", " ").replace("\r", " ").replace("\f", " ").strip(" ") for x in (t or "").split("\n")])
             for i, (host, t) in enumerate(rows)]
    total, pages = {}, {}
    for _, host, ls in lines:
        total[host] = total.get(host, 0) + 1
        for x in {x for x in ls if x}:
            pages[host, x] = pages.get((host, x), 0) + 1
    bad = {k for k, n in pages.items() if n >= least and n > ratio * total[k[0]]}
    return [None if t is None else "\n".join(x for x, b in zip(t.split("\n"), ls, strict=True) if (host, b) not in bad)
            for (host, t), (_, _, ls) in zip(rows, lines, strict=True)]


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_line_dedup_matches_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(line_dedup, "BROADCAST_LINES", broadcast)
    rng = random.Random(1)
    rows = []
    for i in range(60):
        host = ["a", "b", None, "tiny"][i % 4 if i < 50 else 0]
        body = [f"line {rng.randrange(40)}" for _ in range(rng.randrange(1, 6))]
        rows.append((host, "\n".join([" menu \t", *body, "", "footer" if host == "a" else f"own {i}"])))
    rows += [("a", None), ("a", ""), ("b", "x" * 100_000), ("tiny", rows[3][1]), ("tiny", rows[3][1])]
    df = spark.createDataFrame([(i, h, t, 7, "clash") for i, (h, t) in enumerate(rows)],
                               "n long, host string, text string, n_lines long, line string")
    out = {r.n: r for r in line_dedup.drop_boilerplate(df, "host", "text", ratio=0.3, min_pages=3).collect()}
    assert [out[i].text for i in range(len(rows))] == brute_lines(rows, 0.3, 3)
    assert out[60].n_lines == 0 and out[60].n_dropped == 0 and out[60].text is None
    assert out[0].line == "clash" and out[0].n_dropped >= 1 and len(out) == len(rows)
    empty = line_dedup.drop_boilerplate(df.limit(0), "host", "text")
    assert empty.count() == 0 and set(empty.columns) == {"n", "host", "text", "n_lines", "line", "n_dropped"}


def test_visible_lines(spark):
    html = ("<html><head><title>T</title><style>p{}</style><script>var a='</p>';</script></head><body><!-- <p>x</p> -->"
            "<p>One <b>two</b><br>three</p><ul><li>A</li></ul>")
    row = spark.createDataFrame([(html, "HTTP://Www.X.org/a?b"), (None, None)], "h string, u string").select(
        line_dedup.visible_lines(F.col("h")).alias("t"), line_dedup.host_of(F.col("u")).alias("u")).collect()
    assert [x for x in row[0].t.split("\n") if x] == ["T", "One two", "three", "A"]
    assert row[0].u == "www.x.org" and row[1].t is None and row[1].u == ""


def brute_groups(rows, num=90, den=100, width=3):
    sets = []
    for i, t, *_ in rows:
        w = words(t)
        sets.append((i, frozenset(tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()))
    pairs = [(i, i) for i, _ in sets if i is not None]
    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if i is not None and j is not None and x and y and den * len(x & y) >= num * len(x | y):
                pairs.append((i, j))
    return sets, union_find(pairs)


def near_miss_corpus():
    """Variants of one text whose distances lie on both sides of the limit, and texts that share half."""
    rng = random.Random(9)
    base = [f"b{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(60):
        text = list(base)
        for _ in range(rng.randrange(0, 5)):
            text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
        rows.append((500 - i, " ".join(text), "en", "s", 0))
    rows += [(900 + i, " ".join(base[:60] + [f"y{i}_{k}" for k in range(60)]), "en", "s", 0) for i in range(10)]
    return rows


@pytest.mark.parametrize("rows, cell", [(documents(), 512), (near_miss_corpus(), 7)])
def test_jaccard_groups_match_brute_force(spark, monkeypatch, rows, cell):
    monkeypatch.setattr(jaccard_join, "CELL_ROWS", cell)
    sets, find = brute_groups(rows)
    got = jaccard_join.jaccard_groups(frame(spark, rows)).collect()
    want = sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=str)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == want


def test_jaccard_groups_of_nothing(spark):
    out = jaccard_join.jaccard_groups(spark.createDataFrame([], SCHEMA))
    assert out.count() == 0 and out.columns[:3] == ["doc_id", "n_shingles", "component_id"]


def test_partenum_signatures_are_shared_by_all_similar_sets():
    rng = np.random.default_rng(4)
    table = jaccard_join.bands()
    for n in (1, 2, 9, 10, 11, 19, 20, 50, 133, 400, 1500):
        for _ in range(20):
            a = rng.integers(0, 2**63, n, dtype=np.uint64)
            most = n * 10 // 100  # |A ^ B| within the limit when so many elements of A go or come
            gone = int(rng.integers(0, most + 1))
            b = np.concatenate([a[gone:], rng.integers(0, 2**63, max(0, (most - gone) // 2), dtype=np.uint64)])
            a, b = np.unique(a), np.unique(b)
            inter, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
            if 100 * inter < 90 * union:
                continue
            sig, doc = jaccard_join.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), table)
            assert set(sig[doc == 0].tolist()) & set(sig[doc == 1].tolist()), (n, inter, union)


@pytest.mark.parametrize("num", [90, 80, 50, 40])
def test_nested_sets_at_the_bar_share_a_signature(num):
    """Sizes at the farthest ratio that the bar allows, over several size bands at a low bar."""
    rng = np.random.default_rng(num)
    table = jaccard_join.bands(num, 100)
    for n in [*range(1, 60), *range(60, 1200, 37)]:
        large = np.sort(rng.integers(0, 2**63, n, dtype=np.uint64))
        small = large[:-(-n * num // 100)]
        sets = np.concatenate([large, small])
        sig, doc = jaccard_join.signatures(sets, np.array([0, n, len(sets)]), table, num, 100)
        assert set(sig[doc == 0].tolist()) & set(sig[doc == 1].tolist()), n


def test_large_sets_share_no_signature_of_empty_cells():
    """Sets without a common shingle do not meet, however many cells both leave empty."""
    rng = np.random.default_rng(6)
    table = jaccard_join.bands(80, 100)
    sizes = [125 + 3 * i for i in range(60)]
    sets, first = rng.integers(0, 2**63, sum(sizes), dtype=np.uint64), np.concatenate([[0], np.cumsum(sizes)])
    sig, _ = jaccard_join.signatures(sets, first, table, 80, 100)
    assert len(np.unique(sig)) == len(sig)


@pytest.mark.parametrize("num", [80, 50])
def test_jaccard_groups_at_other_bars(spark, num):
    rows = near_miss_corpus()
    sets, find = brute_groups(rows, width=5, num=num)
    got = jaccard_join.jaccard_groups(frame(spark, rows), width=5, num=num, den=100).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted((i, len(s), find(i)) for i, s in sets)


def test_shared_keys_of_sorted_rows(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(300), rng.randrange(40)) for _ in range(700)] + [(7, 5)] * 50 + [(8, i % 900) for i in range(2000)]
    rows += [(9000 + i, 1) for i in range(500)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = sorted_shared_keys(spark.createDataFrame(rows, "key long, id long")).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    by_key = {}
    for k, i in rows:
        by_key.setdefault(k, set()).add(i)
    assert sorted(map(tuple, got)) == sorted((k, i) for k, ids in by_key.items() if len(ids) > 1 for i in ids)


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(5)
    for n in (5, 80, 700, 9000):
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        b = np.concatenate([a[n // 7:], rng.integers(0, 2**63, n // 5, dtype=np.uint64)])
        x, y = jaccard_join._folded([jaccard_join.sketch(s, 90, 100) for s in (a, b)])
        assert int(np.bitwise_count(x ^ y).sum()) <= len(np.setxor1d(a, b))


def test_repeated_passages_cover_all_shared_runs(spark):
    rows = documents()
    texts = {i: words(t) for i, t, *_ in rows if i is not None}
    runs = {}
    for i, w in texts.items():
        for k in range(len(w) - 49):
            runs.setdefault(tuple(w[k:k + 50]), set()).add(i)
    true = {}
    for i, w in texts.items():
        for k in range(len(w) - 49):
            if len(runs[tuple(w[k:k + 50])]) > 1:
                true.setdefault(i, set()).update(range(k, k + 50))
    df = frame(spark, rows)
    found = substring_dedup.repeated_passages(df)
    got = {}
    for r in found.collect():
        assert r.n_words >= 50 and r.start_word + r.n_words <= len(texts[r.doc_id])
        got.setdefault(r.doc_id, set()).update(range(r.start_word, r.start_word + r.n_words))
    assert set(got) == set(true)
    assert all(true[i] <= got[i] for i in true)
    kept = [r for r in found.collect() if r.kept]
    assert all((r.doc_id, r.start_word) == (r.group_doc_id, r.group_start) for r in kept)
    assert len(kept) == len({(r.group_doc_id, r.group_start) for r in found.collect()})
    # what is cut are the repeats; the first place of the shared passage stays
    cut = {r.doc_id: r.text for r in substring_dedup.drop_repeats(df, found).collect()}
    assert cut[3] == {i: t for i, t, *_ in rows}[3] and len(words(cut[11])) == len(texts[11]) - 60 and cut[300] is None
    assert words(cut[107]) == []


def test_pairs_verified_in_turns_give_the_same_passages(spark, monkeypatch):
    written = []

    class Counted(Scratch):
        def table(self, df):
            written.append(df)
            return super().table(df)

    shared = list(range(60))
    rows = [(i, np.array([*range(1000 * i, 1000 * i + i), *shared], np.uint32).tobytes()) for i in range(1, 13)]
    tokens = spark.createDataFrame([(i, bytearray(t)) for i, t in rows], "id long, tokens binary")
    pairs = spark.createDataFrame([(a, b) for a in range(1, 13) for b in range(1, a)], "a long, b long")
    with Counted(spark) as scratch:
        got = [sorted(map(tuple, substring_dedup.verified_in_turns(pairs, tokens, scratch).collect()))]
        assert len(written) == 3  # 66 pairs of 12 documents, 24 at once
        monkeypatch.setattr(substring_dedup, "TURN_PAIRS", 100)
        got.append(sorted(map(tuple, substring_dedup.verified_in_turns(pairs, tokens, scratch).collect())))
        assert len(written) == 4
    assert got[0] == got[1] and len(got[0]) == 66 and got[0][0] == (2, 1, 2, 61, 1, 60)


def test_pairs_below_the_bound_have_no_passages():
    rng = np.random.default_rng(12)
    docs = [rng.integers(0, 40, rng.integers(0, 160), dtype=np.uint32) for _ in range(30)] + [np.zeros(0, np.uint32)]
    docs += [np.concatenate([docs[0], np.arange(100, 160, dtype=np.uint32)]), np.arange(90, 170, dtype=np.uint32)]
    rows = sorted(((a, b) for a in range(len(docs)) for b in range(a)), key=lambda r: r[1])
    column = lambda k: pa.array([docs[r[k]].tobytes() for r in rows], pa.binary())
    (ta, fa), (tb, fb) = substring_dedup._tokens(column(0)), substring_dedup._tokens(column(1).slice(0))
    bound = substring_dedup.common_bound(np.array([b for _, b in rows]), ta, fa, tb, fb)
    for n, (a, b) in zip(bound, rows, strict=True):
        assert n >= max(np.isin(docs[a], docs[b]).sum(), np.isin(docs[b], docs[a]).sum())
        assert n >= 0.8 * substring_dedup.T or substring_dedup.passages(docs[a], docs[b]) == []
    assert (bound < 0.8 * substring_dedup.T).any() and substring_dedup.passages(docs[-1], docs[-2])


def test_no_passages(spark):
    rows = [(i, f"{i} " * 40, "en", "s", 0) for i in range(5)] + [(9, None, None, None, None)]
    assert substring_dedup.repeated_passages(spark.createDataFrame(rows, SCHEMA)).count() == 0
    assert substring_dedup.repeated_passages(spark.createDataFrame([], SCHEMA)).count() == 0


def test_signatures_cover_every_sequence():
    rng = np.random.default_rng(2)
    tokens = rng.permutation(400).astype(np.uint64)
    first = np.array([0, 150, 180, 400])
    key, doc, at = substring_dedup.signatures(tokens, first)
    seeds = _text.mix64(np.arange(1, substring_dedup.HASHES + 1, dtype=np.uint64))
    for d, (lo, hi) in enumerate(zip(first[:-1], first[1:], strict=True)):
        smallest = [tuple(int(_text.mix64(tokens[i:i + 46] ^ s).min()) for s in seeds) for i in range(lo, hi - 45)]
        starts = [i for i in range(len(smallest)) if not i or smallest[i] != smallest[i - 1]]
        assert at[doc == d].tolist() == starts
        of = dict(zip([smallest[i] for i in starts], key[doc == d].tolist(), strict=True))
        assert len(set(of.values())) == len(of)
    again = substring_dedup.signatures(np.concatenate([tokens[200:300], tokens[20:120]]), np.array([0, 100, 200]))[0]
    assert set(again.tolist()) <= set(substring_dedup.signatures(tokens, np.array([0, 400]))[0].tolist())


def test_passages_survive_edits_and_inner_repeats():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**32, 200, dtype=np.uint32)
    b = np.concatenate([rng.integers(0, 2**32, 40, dtype=np.uint32), a[50:150], rng.integers(0, 2**32, 30, dtype=np.uint32)])
    assert substring_dedup.passages(a, b) == [(50, 149, 40, 139)]
    changed = b.copy()
    changed[90:95] = 7
    assert substring_dedup.passages(a, changed) == [(50, 149, 40, 139)]
    twice = np.concatenate([a[60:80], b])
    assert (50, 149, 60, 159) in substring_dedup.passages(a, twice)
    assert substring_dedup.passages(a, b[:40]) == [] and substring_dedup.passages(a[:0], b) == []


@pytest.mark.parametrize("changed, similarity", [(20, 0.80), (3, 0.84), (2, 0.87), (1, 0.91), (0, 0.95)])
def test_changed_passages_share_a_signature(changed, similarity):
    rng = np.random.default_rng(changed)
    found, n = 0, 400
    for _ in range(n):
        one = rng.integers(0, 2**63, 50, dtype=np.uint64)
        two = one.copy()
        two[changed] = 1
        tokens = np.concatenate([_text.rolled(w, substring_dedup.WIDTH) for w in (one, two)])
        a, b = (set(tokens[x:x + 46].tolist()) for x in (0, 46))
        assert similarity <= len(a & b) / len(a | b) < similarity + 0.05
        bands = [substring_dedup.signatures(tokens, np.array([0, 46, 92]), band=k)[0] for k in range(substring_dedup.BANDS)]
        found += any(k[0] == k[1] for k in bands)
    assert found >= 0.95 * n


def test_short_passages_with_a_changed_word_are_found(spark):
    rng = random.Random(21)
    rows = []
    for i in range(80):
        passage = [f"p{rng.randrange(10**9)}" for _ in range(50)]
        for d in (i, 1000 + i):
            rows.append((d, " ".join([f"q{rng.randrange(10**9)}" for _ in range(30)] + passage), "en", "s", 0))
            passage[24] = "changed"
    found = substring_dedup.repeated_passages(spark.createDataFrame(rows, SCHEMA)).collect()
    pairs = {r.group_doc_id for r in found if r.doc_id == r.group_doc_id + 1000 and (r.start_word, r.n_words) == (30, 50)}
    assert len(pairs) >= 74  # 0.98 of 80 expected at similarity 41 / 51


def test_windows_covered_by_passages_with_others_are_still_tested(spark):
    rng = np.random.default_rng(6)
    fresh = lambda n: rng.integers(0, 2**32, n, dtype=np.uint32)

    def change(tokens, at):
        out = tokens.copy()
        out[at::10] = fresh(6)
        return out

    one = fresh(60)
    two = change(one, 8)
    docs = {1: fresh(60), 5: change(one, 5), 6: change(two, 2), 10: one, 20: two}  # 1 leads the signature of 10 and 20
    active = spark.createDataFrame([(1, 1, 7), (1, 10, 7), (1, 20, 7), (2, 5, 7), (2, 10, 7), (3, 6, 7), (3, 20, 7)],
                                   "key bigint, id bigint, at int")
    tokens = spark.createDataFrame([(i, bytearray(t.tobytes())) for i, t in docs.items()], "id bigint, tokens binary")
    with Scratch(spark) as scratch:
        pairs = {(r.a, r.b) for r in substring_dedup.links(active, tokens, scratch).collect()}
    assert pairs == {(10, 5), (20, 6), (20, 10)}


@pytest.mark.parametrize("in_a, in_b", [(1, 3), (1, 5), (2, 4), (4, 4)])
def test_every_occurrence_of_a_passage_is_matched(in_a, in_b):
    rng = np.random.default_rng(in_b)
    fresh = lambda n: rng.integers(0, 2**32, n, dtype=np.uint32)
    shared = fresh(60)
    a, b = (np.concatenate([x for _ in range(n) for x in (fresh(30), shared)]) for n in (in_a, in_b))
    found = substring_dedup.passages(a, b)
    assert {f[:2] for f in found} == {(30 + 90 * k, 89 + 90 * k) for k in range(in_a)}
    assert {f[2:] for f in found} == {(30 + 90 * k, 89 + 90 * k) for k in range(in_b)}


def common_line_documents():
    """Token sequences of 70 documents around one line, 20 of which share a long frequent stretch and two a rare passage."""
    rng = np.random.default_rng(8)
    fresh = lambda n: rng.integers(0, 2**32, n, dtype=np.uint32)
    line, stretch, passage = fresh(20), fresh(60), fresh(50)
    docs = {i: np.concatenate([fresh(30), line, fresh(40)]) for i in range(1, 71)}
    for i in range(30, 50):
        docs[i] = np.concatenate([docs[i], stretch])
    for i in (60, 66):
        docs[i] = np.concatenate([passage, docs[i]])
    return docs


def test_a_common_line_does_not_bring_all_pairs_together(spark, monkeypatch):
    docs, tested = common_line_documents(), []
    verify = substring_dedup.verified_in_turns
    monkeypatch.setattr(substring_dedup, "verified_in_turns",
                        lambda pairs, *rest: (tested.extend(map(tuple, pairs.collect())), verify(pairs, *rest))[1])
    active = spark.createDataFrame([(1, i, 30) for i in docs], "key bigint, id bigint, at int")
    tokens = spark.createDataFrame([(i, bytearray(t.tobytes())) for i, t in docs.items()], "id bigint, tokens binary")
    with Scratch(spark) as scratch:
        found = {(r.a, r.b) for r in substring_dedup.links(active, tokens, scratch).collect()}
    assert found == {(a, b) for a in docs for b in range(1, a) if substring_dedup.passages(docs[a], docs[b])}
    assert len(found) == 191 and len(tested) == len(set(tested)) <= 69 + 191  # of 2415 pairs


def test_pairs_with_a_passage_are_near(spark):
    rng = np.random.default_rng(14)
    docs = common_line_documents()
    for i in range(100, 130):  # few words, many repeats
        docs[i] = rng.integers(0, 25, rng.integers(0, 200), dtype=np.uint32)
    for i in range(130, 150):
        docs[i] = np.concatenate([docs[i - 30], docs[i - 80][:60], rng.integers(0, 2**32, 9, dtype=np.uint32)])
    tokens = spark.createDataFrame([(i, bytearray(t.tobytes())) for i, t in docs.items()], "id bigint, tokens binary")
    with Scratch(spark) as scratch:
        rare, often = substring_dedup.near(tokens.where("id <> 149").select("id"), tokens, scratch)
        rare, often = {tuple(r) for r in rare.collect()}, {r.id for r in often.collect()}
    true = {(a, b) for a in docs for b in docs if b < a < 149 and substring_dedup.passages(docs[a], docs[b])}
    assert len(true) > 200 and all(p in rare or set(p) <= often for p in true)
    assert (66, 60) in rare and set(range(30, 50)) <= often and not often & {1, 60, 66}
