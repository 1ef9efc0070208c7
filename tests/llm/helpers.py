"""Small corpora with the hard cases, and plain-Python versions of what operators compute."""

from __future__ import annotations

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def prose(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary):x}" + rng.choice(["", "", "", ".", ","]) for _ in range(n))


def documents(seed=3):
    """(doc_id, text, lang, source, n_chars): prose, copies, near copies, a shared passage, and empty, short and very long texts."""
    rng = random.Random(seed)
    passage = prose(rng, 60)
    rows = []
    for i in range(40):
        text = prose(rng, rng.randrange(80, 260))
        if i % 8 == 3:
            text = f"{text}\n{passage}\n{prose(rng, 90)}"
        rows.append([i, text, "en", f"s{i % 3}" if i % 4 else "hot"])
    for i in range(8):  # copies and near copies of documents 0 and 1
        rows.append([100 + i, rows[0][1], "en", "hot"])
        near = rows[1][1].split()
        near[10 * i + 5] = f"changed{i}"
        rows.append([200 + i, " ".join(near), "fr", "hot"])
    rows += [[300, None, None, "s1"], [301, "", "en", None], [302, " \n\t ", "en", "s2"], [303, "One", "en", "s1"],
             [304, "One two", "en", "s1"], [305, "one TWO", None, "s2"], [306, "a b c", "en", "s0"],
             [307, prose(rng, 30_000, 50_000), "en", "s0"], [308, "the " * 5000, "en", "s1"],
             [309, "ñandú Straße 日本語 é x <|endoftext|> 12.5%", "es", None], [None, rows[2][1], "en", "s0"],
             [310, rows[3][1], "en", "s1"], [310, rows[3][1], "en", "s1"]]
    return [(*r, len(r[1]) if r[1] is not None else None) for r in rows]


def frame(spark, rows=None, extra=True):
    """The rows as a DataFrame, with further columns whose names operators use themselves."""
    df = spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
    if extra:
        for name in ("id", "key", "score", "size", "taken", "slot", "shard", "n_lines", "u", "row", "component", "sketch", "train"):
            df = df.selectExpr("*", f"'clash' as {name}")
    return df


def union_find(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return find
