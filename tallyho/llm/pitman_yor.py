"""Operator 3, scoring by a hierarchical Pitman-Yor language model.

Words are drawn from restaurants.  Every preceding word is a context with a restaurant of
its own; all contexts share a parent, the restaurant of single words, whose base is uniform
over the V training words and one unknown word.  Customers of a context are its training
tokens; every table of a context is a customer of the parent.  Seating is sampled by
Gibbs sweeps: a dish of a context leaves with all its customers and they are seated
anew, one after the other, a new table having the odds (theta + d * tables) * parent
probability against (seated - d * their tables).  Beyond ``SINGLE`` customers they come in
parties of an eighth of those seated.  The score uses predictive probabilities
averaged over the sweeps after ``BURN``.

Documents become chunks of tokens.  A chunk asks for its words and for its pairs (word,
context).  Words are dealt over buckets by hash, pairs go with their word; the pairs of
frequent words are dealt by hash of the pair, so no word's contexts meet in one task.  A
bucket counts and seats its pairs and answers for them and for its words.  What it cannot
know alone are the tables of its contexts, as other words sit there too: after each sweep
every bucket reports the tables of its contexts, these are summed by classes of contexts
(ranges of their hashes) and sent back to the buckets that hold the context.  Only sums of
the whole corpus and those of the frequent words pass through the driver.  A pair that
occurs once has one table for ever, so sweeps move the others alone.  A sweep follows from
the seating before it, the sums and a seed, so a lost task or a retry seats in the same way.

Defined results
* Every input row is scored and returned once, also repeated rows; rows where ``train`` is
  null or false are not learnt from.
* A null or empty text is the end token alone.  Without training rows all probabilities are
  uniform over the one unknown word.
* Other columns are not read.  Empty input gives empty output.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyho.llm._text import slices, words_of
from tallyho.session import Scratch, materialize

#: Classes of contexts, more where there are many buckets; each is summed by one task.
CLASSES = 64
SWEEPS, BURN, SINGLE = 4, 1, 32
THETA, SEED = 1.0, 17
#: Tokens of a chunk (more if one document has more), and of a bucket.
CHUNK_TOKENS, BUCKET_TOKENS = 1_500_000, 1_000_000
#: Bytes of rows that a task sends at once.
BATCH_BYTES = 1 << 20
#: A word with this part of a bucket's tokens is frequent.
FREQUENT = 0.25
END = np.uint64(0x5851F42D4C957F2D)
SCORES = ("doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, "
          "base_score double, score double")


def _planes(values: np.ndarray) -> bytes:
    """Bytes of numbers from 0 by significance, without those that are 0 in all; their number leads."""
    raw = np.ascontiguousarray(values, "<i8" if values.dtype.itemsize == 8 else "<i4")
    width = max(1, (int(raw.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(raw.view(np.uint8).reshape(-1, raw.itemsize)[:, :width].T).tobytes()


def _values(raw: bytes) -> np.ndarray:
    width = raw[0]
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(width, -1)
    size = 4 if width < 4 else 8
    out = np.zeros((planes.shape[1], size), np.uint8)
    out[:, :width] = planes.T
    return out.view(f"<i{size}").ravel()


def _steps(values: np.ndarray) -> bytes:
    """Rising numbers by their differences."""
    return _planes(np.diff(values, prepend=0))


def _rising(raw: bytes) -> np.ndarray:
    return np.cumsum(_values(raw), dtype=np.int64)


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, each value's place among them), as ``np.unique`` has them but with less memory."""
    order = np.argsort(values)
    ranked = values[order]
    new = np.ones(len(values), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    ranked = ranked[new]
    nth = np.cumsum(new, dtype=np.int32)
    nth -= 1
    place = np.empty(len(values), np.int32)
    place[order] = nth
    return ranked, place


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows one after the other, as some are large."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in batch.columns)
        del batch  # or it stays until the next one is there
        pa.default_memory_pool().release_unused()


def _batches(rows: Iterator[tuple], names: list[str], kinds: tuple) -> Iterator[pa.RecordBatch]:
    """Rows, some of them large, in batches of about ``BATCH_BYTES`` of binary cells, so that few are held at once."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes))
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], k) for i, k in enumerate(kinds)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], k) for i, k in enumerate(kinds)], names=names)


def _share(hashes: np.ndarray, parts: int) -> np.ndarray:
    """The part of each hash: ranges of equal length, so ascending hashes have ascending parts."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _hashes(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


def token_chunks(df: DataFrame) -> DataFrame:
    """(ids, train, n, words, places, counts, tokens, size): documents of a chunk, their token counts, its words and each
    token's word.

    Words stand by hash; tokens number them by falling frequency, ``places`` has the place and ``counts`` the tokens of
    each number.  ``df`` has id, text and train.
    """

    def pack(parts: list[tuple]) -> pa.RecordBatch:
        hashes, n = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
        words, place = _distinct(hashes)
        count = np.bincount(place)
        order = np.argsort(-count, kind="stable")
        rank = np.empty(len(words), np.int32)
        rank[order] = np.arange(len(words))
        ids = pa.concat_arrays([p[0] for p in parts])
        train = np.concatenate([p[3] for p in parts])
        cells = (train.tobytes(), n.astype(np.int32).tobytes(), words.tobytes(), _planes(order), _planes(count[order]),
                 _planes(rank[place]))
        return pa.RecordBatch.from_arrays(
            [pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *(pa.array([c], pa.binary()) for c in cells),
             pa.array([len(hashes)], pa.int64())],
            names=["ids", "train", "n", "words", "places", "counts", "tokens", "size"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in slices(batches, 1):
            words = words_of(batch.column(1))
            n = words.per_doc + 1
            tokens = np.full(int(n.sum()), END, np.uint64)
            body = np.ones(len(tokens), bool)
            body[np.cumsum(n) - 1] = False
            tokens[body] = words.hashes
            train = batch.column(2).fill_null(False).to_numpy(zero_copy_only=False).astype(np.uint8)
            parts.append((batch.column(0), tokens, n, train))
            held += len(tokens)
            if held >= CHUNK_TOKENS:
                yield pack(parts)
                parts, held = [], 0
        if parts:
            yield pack(parts)

    return df.mapInArrow(run, "ids array<bigint>, train binary, n binary, words binary, places binary, counts binary, "
                              "tokens binary, size bigint")


def frequent_words(chunks: DataFrame, tokens: int) -> np.ndarray:
    """Hashes, ascending, of words with ``FREQUENT`` of a bucket's tokens; half the rate in a chunk makes a candidate."""
    least = FREQUENT * BUCKET_TOKENS
    rate = least / 2 / max(1, tokens)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words, places, counts, size in _rows(batches):
            count = _values(counts)
            at = np.flatnonzero(count >= max(2, rate * size))
            yield pa.RecordBatch.from_arrays([pa.array(_hashes(words)[_values(places)[at]].view(np.int64)),
                                              pa.array(count[at].astype(np.int64))], names=["word", "n"])

    found = chunks.select("words", "places", "counts", "size").mapInArrow(run, "word bigint, n bigint")
    rows = found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least).collect()
    return np.sort(np.array([r["word"] for r in rows], np.int64).view(np.uint64))


def _pairs(places: np.ndarray, token: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, context, each token's pair): the distinct pairs of a word and the word before it, by their places in the chunk."""
    word = places[token]
    begin = np.cumsum(n) - n
    first = word[begin].astype(np.int64) * len(places) + word[n[0] - 1]  # a text begins where another ended
    pairs = word.astype(np.int64)
    pairs *= len(places)
    pairs[1:] += word[:-1]
    pairs[begin] = first
    del word
    pairs, inverse = _distinct(pairs)
    word = (pairs // len(places)).astype(np.int32)
    pairs %= len(places)
    return word, pairs.astype(np.int32), inverse


def _number(words: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Each word's number among the frequent words, or -1."""
    at = np.searchsorted(frequent, words)
    same = np.append(frequent, np.uint64(0))[at] == words
    return np.where(same & (at < len(frequent)), at, -1)


def _dealt(home: np.ndarray, number: np.ndarray, word: np.ndarray, context: np.ndarray,
           buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, bucket, number) of pairs: by bucket, frequent words last, by word and context.

    ``home`` is the bucket of each word, ``number`` its number among the frequent words or -1.  Pairs of a frequent word
    are dealt by its number and the bucket of the context.
    """
    home, number = home.astype(np.int32), number.astype(np.int32)[word]
    wide = number >= 0
    bucket = home[word]
    bucket[wide] = (home[context[wide]] + number[wide]) % buckets
    order = np.argsort(bucket * 2 + wide, kind="stable").astype(np.int32)
    return order, bucket[order], number[order]


def asks(chunks: DataFrame, buckets: int, frequent: np.ndarray) -> DataFrame:
    """(bucket, chunk, words, seen, sizes, contexts, counts): a chunk's words in a bucket and how often training has them;
    the pairs of each of these and of each frequent word, their contexts, and how often training has the pair."""

    def asked(chunk: int, train: bytes, n: bytes, words: bytes, places: bytes, token: bytes) -> Iterator[tuple]:
        n, words = np.frombuffer(n, np.int32), _hashes(words)
        word, context, inverse = _pairs(_values(places), _values(token), n)
        count = np.bincount(inverse[np.repeat(np.frombuffer(train, bool), n)], minlength=len(word))
        del inverse, token
        # pairs stand by word, and every word has one
        seen = np.add.reduceat(count, np.flatnonzero(np.diff(word, prepend=-1)))
        home = _share(words, buckets)
        order, bucket, number = _dealt(home, _number(words, frequent), word, context, buckets)
        held = np.unique(np.concatenate([home, bucket]))
        for b, w0, w1, p0, p1 in zip(held.tolist(), np.searchsorted(home, held), np.searchsorted(home, held, "right"),
                                     np.searchsorted(bucket, held), np.searchsorted(bucket, held, "right"), strict=True):
            at = order[p0:p1]
            own = np.where(number[p0:p1] < 0, word[at] - w0, w1 - w0 + number[p0:p1])
            yield (b, chunk, words[w0:w1].tobytes(), _planes(seen[w0:w1]),
                   _planes(np.bincount(own, minlength=w1 - w0 + len(frequent))), words[context[at]].tobytes(), _planes(count[at]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            yield from _batches(asked(*row), ["bucket", "chunk", "words", "seen", "sizes", "contexts", "counts"],
                                (pa.int64(), pa.int64(), *[pa.binary()] * 5))

    return chunks.select("chunk", "train", "n", "words", "places", "tokens").mapInArrow(
        run, "bucket bigint, chunk bigint, words binary, seen binary, sizes binary, contexts binary, counts binary")


BUCKET = ("bucket bigint, seen binary, wide binary, counts binary, names binary, name_alone binary, "
          "name_busy binary, runs binary, alone binary, sizes binary, contexts binary, busy binary, facts array<bigint>, "
          "asks array<struct<chunk: bigint, words: binary, wide: binary, pairs: binary>>")
#: Training words, pairs that occur once and twice, words in one and in two contexts, all pairs, words with contexts.
FACTS = ("words", "ones", "twos", "single", "double", "customers", "dishes")


def _found(place: np.ndarray, known: np.ndarray) -> bytes:
    """Places, rising, of what is known; what is not has the place before it."""
    return _steps(2 * (place + 1) + (~known).astype(np.int64))


def _at(raw: bytes) -> np.ndarray:
    """The places behind ``_found``, -1 for what is not known."""
    code = _rising(raw)
    return np.where(code & 1, -1, (code >> 1) - 1)


def gathered(asked: DataFrame, frequent: np.ndarray, classes: int) -> DataFrame:
    """BUCKET: a bucket's training words and pairs, and the places in both of what each chunk asks.

    Of the words how often training has them (``seen``) and their number among the frequent ones plus 1 (``wide``); of all
    pairs how often it has them (``counts``).  ``alone`` and ``sizes`` are the pairs of each word, then of each frequent
    word, that occur once and more often; ``contexts`` and ``busy`` are the contexts and counts of the latter, whose
    contexts are numbered by hash, ``runs`` of them in each class.  ``names`` are all contexts, with their pairs that occur
    once and more often.  ``facts``: FACTS, then the training tokens of each class, then the pairs of each frequent word.
    """

    def run(table: pa.Table) -> pa.Table:
        col = {c: table.column(c).to_pylist() for c in table.column_names}
        words, seen = [_hashes(w) for w in col["words"]], np.concatenate([_values(x) for x in col["seen"]])
        every, of = np.unique(np.concatenate(words), return_inverse=True)
        total = np.bincount(of, weights=seen, minlength=len(every)).astype(np.int64)
        in_training = total > 0
        place = np.cumsum(in_training) - 1
        edge = np.cumsum([0, *map(len, words)])
        sizes = [_values(x) for x in col["sizes"]]
        wide = len(every) + np.arange(len(frequent))
        word = np.concatenate([np.repeat(np.concatenate([of[a:b], wide]), n)
                               for a, b, n in zip(edge[:-1], edge[1:], sizes, strict=True)])
        names, context = _distinct(np.concatenate([_hashes(x) for x in col["contexts"]]))
        pairs, pair = _distinct(word * len(names) + context)
        count = np.bincount(pair, weights=np.concatenate([_values(x) for x in col["counts"]]),
                            minlength=len(pairs)).astype(np.int64)
        kept = count > 0
        nth = np.cumsum(kept) - 1
        word, context = (pairs // max(1, len(names)))[kept], (pairs % max(1, len(names)))[kept]
        n_words = int(in_training.sum())
        word = np.where(word < len(every), np.append(place, 0)[np.minimum(word, len(every))], word - len(every) + n_words)
        count = count[kept]
        many = count > 1
        per = lambda x, n: np.bincount(x, minlength=n)
        alone, sizes_many = per(word[~many], n_words + len(frequent)), per(word[many], n_words + len(frequent))
        name_alone, name_many = per(context[~many], len(names)), per(context[many], len(names))
        used, moving = name_alone + name_many > 0, name_many > 0
        part = _share(names, classes)
        own = (alone + sizes_many)[:n_words]
        facts = np.concatenate([
            [n_words, (count == 1).sum(), (count == 2).sum(), (own == 1).sum(), (own == 2).sum(), len(count), (own > 0).sum()],
            np.bincount(part[context], weights=count, minlength=classes), (alone + sizes_many)[n_words:]]).astype(np.int64)
        cut = np.cumsum([0, *(int(n.sum()) for n in sizes)])
        number = _number(every, frequent) + 1
        ask = [{"chunk": c, "words": _found(place[of[a:b]], in_training[of[a:b]]), "wide": _planes(number[of[a:b]]),
                "pairs": _found(nth[pair[x:y]], kept[pair[x:y]])}
               for c, a, b, x, y in zip(col["chunk"], edge[:-1], edge[1:], cut[:-1], cut[1:], strict=True)]
        cells = (_planes(total[in_training]), _planes(number[in_training]),
                 _planes(count), names[used].tobytes(), _planes(name_alone[used]), _planes(name_many[used]),
                 _planes(per(part[moving], classes)), _planes(alone), _planes(sizes_many),
                 _planes((np.cumsum(moving) - 1)[context[many]]), _planes(count[many]))
        kind = pa.list_(pa.struct([("chunk", pa.int64()), ("words", pa.binary()), ("wide", pa.binary()), ("pairs", pa.binary())]))
        return pa.Table.from_arrays(
            [pa.array(col["bucket"][:1], pa.int64()), *(pa.array([c], pa.binary()) for c in cells),
             pa.array([facts], pa.list_(pa.int64())), pa.array([ask], kind)],
            names=["bucket", "seen", "wide", "counts", "names", "name_alone", "name_busy", "runs", "alone", "sizes", "contexts",
                   "busy", "facts", "asks"])

    return asked.groupBy("bucket").applyInArrow(run, BUCKET)


class Totals:
    """What buckets share after a sweep: tables of each context they hold, customers and tables of the parent, and these
    of each frequent word."""

    def __init__(self, tables: np.ndarray, customers: int, dishes: int, wide: np.ndarray | None = None,
                 wide_dishes: np.ndarray | None = None) -> None:
        self.tables, self.customers, self.dishes = tables, customers, dishes
        self.wide = np.zeros(0, np.int64) if wide is None else wide
        self.wide_dishes = np.zeros(0, np.int64) if wide_dishes is None else wide_dishes


class Corpus:
    """What does not change: customers of each class of contexts, training tokens and words, discounts."""

    def __init__(self, customers: np.ndarray, tokens: int, words: int, discount: float, parent_discount: float) -> None:
        self.customers, self.tokens, self.words = customers, tokens, words
        self.discount, self.parent_discount = discount, parent_discount

    def base(self, totals: Totals) -> float:
        """Weight of an unseen dish in the parent."""
        return (THETA + self.parent_discount * totals.dishes) / (self.words + 1)

    def parent(self, customers: np.ndarray, tables: np.ndarray, totals: Totals) -> np.ndarray:
        return (customers - self.parent_discount * tables + self.base(totals)) / (THETA + totals.customers)

    def parent_seats(self, customers: np.ndarray, totals: Totals, rng: np.random.Generator) -> np.ndarray:
        """Tables of the parent's dishes, seated anew."""
        start = np.full(len(customers), (THETA + self.parent_discount * (totals.dishes - 1)) / (self.words + 1))
        return seat(customers, start, np.full(len(start), self.parent_discount / (self.words + 1)), self.parent_discount, rng)


def seat(customers: np.ndarray, odds: np.ndarray, growth: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables after seating each dish's customers; a new table has weight odds + growth * own tables."""
    tables = np.minimum(customers, 1).astype(np.int64)
    todo = np.flatnonzero(customers > 1)
    seated = 1
    while len(todo):
        party = np.minimum(1 if seated < SINGLE else seated // 8, customers[todo] - seated)
        new = odds[todo] + growth[todo] * tables[todo]
        chance = new / (new + seated - discount * tables[todo])
        tables[todo] += rng.random(len(todo)) < chance if seated < SINGLE else rng.binomial(party, np.clip(chance, 0, 1))
        seated += 1 if seated < SINGLE else seated // 8
        todo = todo[customers[todo] > seated]
    return tables


class Bucket:
    """Training pairs of a bucket, and their seating from the totals of the sweeps so far.

    ``alone`` are customers of each word at tables that never change; the last ``wide`` words are the frequent ones.
    """

    def __init__(self, bucket: int, words: bytes | np.ndarray, sizes: bytes | np.ndarray, contexts: bytes | np.ndarray,
                 counts: bytes | np.ndarray, alone: np.ndarray | None = None, wide: int = 0) -> None:
        given = lambda x, dtype: np.frombuffer(x, dtype) if isinstance(x, bytes) else x
        self.bucket, self.words = bucket, given(words, np.uint64)
        self.context, self.count = given(contexts, np.uint8), given(counts, np.int64)
        own = given(sizes, np.uint8).astype(np.int64)
        self.alone = np.zeros(len(own), np.int64) if alone is None else alone
        self.size, self.own = own + self.alone, len(own) - wide
        self.of = np.repeat(np.arange(len(own)), own)

    def per_word(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.of, weights=values, minlength=len(self.size)).astype(np.int64) + self.alone

    def begin(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tables of each pair, parent customers and tables of each word) at the start.

        Of frequent words a bucket has its own part of the customers, and no parent tables.
        """
        dishes = np.minimum(self.size, 1)
        dishes[self.own:] = 0
        return np.ones(len(self.count), np.int64), self.size.copy(), dishes

    def sweep(self, corpus: Corpus, totals: Totals, sweep: int, tables: np.ndarray, customers: np.ndarray,
              dishes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The seating after the sweep that follows the given one, whose totals are given."""
        busy = np.flatnonzero(self.count > 1)
        word, context = self.of[busy], self.context[busy]
        rng = np.random.default_rng([SEED, sweep, self.bucket])
        customers, dishes, tables = customers.copy(), dishes.copy(), tables.copy()
        customers[self.own:], dishes[self.own:] = totals.wide, totals.wide_dishes
        left = customers[word] - tables[busy]
        parent = corpus.parent(left, dishes[word] * left / np.maximum(1, customers[word]), totals)
        weight = THETA + corpus.discount * (totals.tables[context] - tables[busy])
        tables[busy] = seat(self.count[busy], weight * parent, corpus.discount * parent, corpus.discount, rng)
        customers, dishes = self.per_word(tables), np.zeros(len(customers), np.int64)
        dishes[:self.own] = corpus.parent_seats(customers[:self.own], totals, rng)
        return tables, customers, dishes

    def sweeps(self, corpus: Corpus, history: list[Totals]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The seating at the start, then after each sweep."""
        seating = self.begin()
        yield seating
        for sweep, totals in enumerate(history):
            seating = self.sweep(corpus, totals, sweep, *seating)
            yield seating


def _bucket(row: dict, frequent: int) -> Bucket:
    """The bucket of the pairs that occur more than once."""
    return Bucket(row["bucket"], np.zeros(0, np.uint64), _values(row["sizes"]), _values(row["contexts"]), _values(row["busy"]),
                  _values(row["alone"]), frequent)


def _discount(ones: float, twos: float) -> float:
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones + twos else 0.5


def survey(state: DataFrame, frequent: int, classes: int) -> tuple[Corpus, Totals]:
    """Counts of the corpus, and the sums at the start, where each pair has one table."""
    rows = state.select(F.posexplode("facts").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).collect()
    sums = np.zeros(len(FACTS) + classes + frequent, np.int64)
    for r in rows:
        sums[r["k"]] = r["n"]
    one = dict(zip(FACTS, sums.tolist(), strict=False))
    customers, wide = sums[len(FACTS):len(FACTS) + classes], sums[len(FACTS) + classes:]
    corpus = Corpus(customers, int(customers.sum()), one["words"], _discount(one["ones"], one["twos"]),
                    _discount(one["single"], one["double"]))
    dishes = np.minimum(wide, 1)
    return corpus, Totals(np.zeros(0), one["customers"], one["dishes"] + int(dishes.sum()), wide, dishes)


ROOM = "class bigint, fixed binary, start binary, homes binary, runs binary, holders array<struct<bucket: bigint, at: binary>>"
NEWS = "bucket bigint, sweep int, class bigint, home boolean, tables binary"


def rooms(state: DataFrame, classes: int, buckets: int) -> DataFrame:
    """ROOM: of the contexts of a class the tables of pairs that occur once, all tables at the start, the buckets of the
    contexts' own words (homes, with the length of their runs), and the contexts whose tables change in each bucket."""

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, names, alone, busy in _rows(batches):
            names, alone, busy = _hashes(names), _values(alone), _values(busy)
            part = _share(names, classes)
            held = np.unique(part)
            cuts = list(zip(np.searchsorted(part, held), np.searchsorted(part, held, "right"), strict=True))
            columns = (held.tolist(), [bucket] * len(held), [names[a:b].tobytes() for a, b in cuts],
                       [_planes(alone[a:b]) for a, b in cuts], [_planes(busy[a:b]) for a, b in cuts])
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                             names=["class", "bucket", "names", "alone", "busy"])

    def opened(table: pa.Table) -> pa.Table:
        col = {c: table.column(c).to_pylist() for c in table.column_names}
        alone, busy = ([_values(x) for x in col[c]] for c in ("alone", "busy"))
        names, of = np.unique(np.concatenate([_hashes(x) for x in col["names"]]), return_inverse=True)
        sums = lambda x: np.bincount(of, weights=np.concatenate(x), minlength=len(names)).astype(np.int64)
        fixed = sums(alone)
        homes, runs = np.unique(_share(names, buckets), return_counts=True)
        edge = np.cumsum([0, *map(len, busy)])
        holders = [{"bucket": b, "at": _steps(of[lo:hi][n > 0])}
                   for b, lo, hi, n in zip(col["bucket"], edge[:-1], edge[1:], busy, strict=True) if (n > 0).any()]
        cells = (_planes(fixed), _planes(fixed + sums(busy)), _planes(homes), _planes(runs))
        kind = pa.list_(pa.struct([("bucket", pa.int64()), ("at", pa.binary())]))
        return pa.Table.from_arrays([pa.array(col["class"][:1], pa.int64()), *(pa.array([c], pa.binary()) for c in cells),
                                     pa.array([holders], kind)], names=["class", "fixed", "start", "homes", "runs", "holders"])

    parts = state.select("bucket", "names", "name_alone", "name_busy").mapInArrow(
        told, "class bigint, bucket bigint, names binary, alone binary, busy binary")
    return parts.groupBy("class").applyInArrow(opened, ROOM)


def _news(room: dict, tables: np.ndarray, sweep: int, home: bool) -> pa.Table:
    """What a class sends after a sweep: to each holder the tables of its contexts, and those of its words to their homes."""
    rows = [(h["bucket"], False, tables[_rising(h["at"])]) for h in room["holders"]]
    if home:
        runs = _values(room["runs"])
        rows += [(int(b), True, t) for b, t in zip(_values(room["homes"]), np.split(tables, np.cumsum(runs)[:-1]), strict=True)]
    columns = ([r[0] for r in rows], [sweep] * len(rows), [room["class"]] * len(rows), [r[1] for r in rows],
               [_planes(r[2]) for r in rows])
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.binary())
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                names=["bucket", "sweep", "class", "home", "tables"])


def opening_news(room: DataFrame, home: bool) -> DataFrame:
    """NEWS of the start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from _news(row, _values(row["start"]), 0, home).to_batches()

    return room.mapInArrow(run, NEWS)


def sweep_news(room: DataFrame, reports: DataFrame, sweep: int, home: bool) -> DataFrame:
    """NEWS of a sweep from the tables that all buckets report (class, bucket, tables)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = left.to_pylist()
        if not rows:
            return pa.table({n: pa.array([], k) for n, k in (("bucket", pa.int64()), ("sweep", pa.int32()), ("class", pa.int64()),
                                                             ("home", pa.bool_()), ("tables", pa.binary()))})
        tables = _values(rows[0]["fixed"]).copy()
        at = {h["bucket"]: h["at"] for h in rows[0]["holders"]}
        for r in right.to_pylist():
            tables[_rising(at[r["bucket"]])] += _values(r["tables"])
        return _news(rows[0], tables, sweep, home)

    return room.groupBy("class").cogroup(reports.groupBy("class")).applyInArrow(run, NEWS)


def _told(news: list[dict], sweep: int, home: bool) -> np.ndarray:
    """The tables of a bucket's contexts after a sweep (or of its own words as contexts), by hash."""
    rows = sorted((r["class"], r["tables"]) for r in news if r["sweep"] == sweep and r["home"] == home)
    return np.concatenate([_values(t) for _, t in rows]) if rows else np.zeros(0, np.int64)


REPORT = "bucket bigint, class bigint, tables binary, dishes binary, sums array<bigint>"


def sweep_reports(state: DataFrame, seated: DataFrame | None, news: DataFrame, corpus: Corpus, last: Totals, sweep: int,
                  frequent: int) -> DataFrame:
    """REPORT of a sweep: each bucket's tables of its contexts by class; without a class its seating and its sums.

    ``seated`` and ``news`` are the seating and the tables of contexts after the sweep before, ``last`` its sums.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows, told = left.to_pylist(), right.to_pylist()
        out = []
        for row in rows:
            b = _bucket(row, frequent)
            seating = b.begin()
            if row["tables"] is not None:
                tables = _values(row["tables"])
                seating = tables, b.per_word(tables), _values(row["dishes"])
            totals = Totals(_told(told, sweep - 1, False), last.customers, last.dishes, last.wide, last.wide_dishes)
            tables, customers, dishes = b.sweep(corpus, totals, sweep - 1, *seating)
            runs = _values(row["runs"])
            held = np.bincount(b.context, weights=tables, minlength=int(runs.sum())).astype(np.int64)
            out += [(b.bucket, k, _planes(t), None, None) for k, t in enumerate(np.split(held, np.cumsum(runs)[:-1])) if len(t)]
            out.append((b.bucket, None, _planes(tables), _planes(dishes),
                        [int(customers.sum()), int(dishes.sum()), *customers[b.own:].tolist()]))
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
        return pa.Table.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)],
                                    names=["bucket", "class", "tables", "dishes", "sums"])

    left = state.select("bucket", "alone", "sizes", "contexts", "busy", "runs")
    empty = F.lit(None).cast("binary")
    if seated is None:
        left = left.select("*", empty.alias("tables"), empty.alias("dishes"))
    else:
        left = left.join(seated.select("bucket", "tables", "dishes"), "bucket")
    return left.groupBy("bucket").cogroup(news.where("not home").groupBy("bucket")).applyInArrow(run, REPORT)


def fit(state: DataFrame, frequent: int, classes: int, buckets: int, sweeps: int, burn: int,
        scratch: Scratch) -> tuple[Corpus, list[Totals], list[DataFrame], list[DataFrame]]:
    """Counts of the corpus; after each sweep, the start included, its sums and the tables of contexts; after each sweep
    the seating of the buckets."""
    corpus, start = survey(state, frequent, classes)
    history, kept, seated = [start], _kept(sweeps, burn), []
    room = scratch.table(rooms(state, classes, buckets))
    news = [scratch.table(opening_news(room, 0 in kept))]
    for sweep in range(1, sweeps + 1):
        reports = scratch.table(sweep_reports(state, seated[-1] if seated else None, news[-1], corpus, history[-1], sweep, frequent))
        seated.append(reports.where("class is null"))
        sums = np.zeros(2 + frequent, np.int64)
        for r in seated[-1].select(F.posexplode("sums").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).collect():
            sums[r["k"]] = r["n"]
        dishes = corpus.parent_seats(sums[2:], history[-1], np.random.default_rng([SEED, sweep]))
        history.append(Totals(np.zeros(0), int(sums[0]), int(sums[1] + dishes.sum()), sums[2:], dishes))
        tables = reports.where("class is not null").select("class", "bucket", "tables")
        news.append(scratch.table(sweep_news(room, tables, sweep, sweep in kept)))
    scratch.drop(room)
    return corpus, history, news, seated


def _kept(sweeps: int, burn: int) -> list[int]:
    return list(range(burn + 1, sweeps + 1)) or [sweeps]


def answers(state: DataFrame, news: list[DataFrame], seated: list[DataFrame], history: list[Totals], frequent: int,
            burn: int = BURN) -> DataFrame:
    """(chunk, bucket, seen, wide, seats, counts, tables): per asked word its training count, its number among the frequent
    ones plus 1, and after each kept sweep its parent customers and tables and its tables as a context; per asked pair its
    training count and the sum of its tables."""
    kept = _kept(len(history) - 1, burn)
    # the news of the words at home and the seating, as rows of a bucket
    told = [news[k].where("home").select("bucket", "sweep", "class", "home", "tables", F.lit(None).cast("binary").alias("dishes"))
            for k in kept]
    told += [seated[k - 1].select("bucket", F.lit(k).alias("sweep"), "class", F.lit(False).alias("home"), "tables", "dishes")
             for k in kept if k]
    rows_of = told[0]
    for more in told[1:]:
        rows_of = rows_of.unionByName(more)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out, given = [], right.to_pylist()
        for row in left.to_pylist():
            seen, wide, count = (_values(row[c]) for c in ("seen", "wide", "counts"))
            b = _bucket(row, frequent)
            tables = np.full(len(count), len(kept), np.int64)
            at = np.flatnonzero(wide)
            seats = []
            for k in kept:
                seating = [r for r in given if r["sweep"] == k and not r["home"]]
                own, _, dishes = b.begin()
                if seating:
                    own, dishes = _values(seating[0]["tables"]), _values(seating[0]["dishes"])
                tables[count > 1] += own - 1
                customers, dishes = b.per_word(own)[:b.own], dishes[:b.own].copy()
                customers[at], dishes[at] = history[k].wide[wide[at] - 1], history[k].wide_dishes[wide[at] - 1]
                seats += [customers, dishes, _told(given, k, True)]
            last = lambda x: np.append(x, 0)  # noqa: E731  what is not known has none
            count, tables = last(count), last(tables)
            per_word = [last(x) for x in (seen, *seats)]
            for ask in row["asks"]:
                w, p = _at(ask["words"]), _at(ask["pairs"])
                n, *values = [x[w] for x in per_word]
                out.append((ask["chunk"], b.bucket, _planes(n), ask["wide"], [_planes(x) for x in values],
                            _planes(count[p]), _planes(tables[p])))
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.binary(), pa.binary())
        return pa.Table.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)],
                                    names=["chunk", "bucket", "seen", "wide", "seats", "counts", "tables"])

    return (state.select("bucket", "seen", "wide", "counts", "alone", "sizes", "contexts", "busy", "asks").groupBy("bucket")
            .cogroup(rows_of.groupBy("bucket")).applyInArrow(
        run, "chunk bigint, bucket bigint, seen binary, wide binary, seats array<binary>, counts binary, tables binary"))


def judged(chunks: DataFrame, replies: DataFrame, corpus: Corpus, history: list[Totals], buckets: int,
           burn: int = BURN) -> DataFrame:
    """SCORES of the chunks' documents."""
    kept = [history[k] for k in _kept(len(history) - 1, burn)]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        col = {c: v.to_pylist() for c, v in zip(right.column_names, right.sort_by("bucket").columns, strict=True)}
        joined = lambda cells: np.concatenate([_values(x) for x in cells])
        seen, number = joined(col["seen"]), joined(col["wide"]) - 1
        home = np.repeat(col["bucket"], [len(_values(x)) for x in col["seen"]])
        seats = [joined(x) for x in zip(*col["seats"], strict=True)]
        out = []
        for row in left.to_pylist():
            n, places, token = np.frombuffer(row["n"], np.int32), _values(row["places"]), _values(row["tokens"])
            word, context, inverse = _pairs(places, token, n)
            order = _dealt(home, number, word, context, buckets)[0]
            count, tables = np.empty(len(word)), np.empty(len(word))
            count[order], tables[order] = joined(col["counts"]), joined(col["tables"])
            del order
            tables *= corpus.discount
            tables /= len(kept)
            count -= tables
            p = count
            for t, customers, dishes, own in zip(kept, seats[0::3], seats[1::3], seats[2::3], strict=True):
                parent = corpus.parent(customers, dishes, t)
                part = (THETA + corpus.discount * own)[context]
                part *= parent[word]
                part /= len(kept)
                p += part
            p /= (THETA + seen)[context]
            logs = np.log10(p, out=p)
            del tables, count, part, word, context
            base = np.log10((seen + 0.5) / (corpus.tokens + 0.5 * (corpus.words + 1)))
            token = places[token]
            begin = np.cumsum(n) - n
            total = lambda v: np.add.reduceat(v, begin)
            out.append(pa.table({
                "doc_id": pa.array(row["ids"], pa.int64()),
                "held_out": pa.array(np.frombuffer(row["train"], np.uint8) == 0),
                "n_tokens": pa.array(n.astype(np.int64)), "n_known": pa.array(total((seen > 0).astype(np.int64)[token])),
                "train_tokens": pa.array(np.full(len(n), corpus.tokens)),
                "base_score": pa.array(total(base[token])), "score": pa.array(total(logs[inverse]))}))
        return pa.concat_tables(out)

    return chunks.select("chunk", "ids", "train", "n", "places", "tokens").groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(run, SCORES)


def score(df: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text", sweeps: int = SWEEPS,
          burn: int = BURN) -> DataFrame:
    """Score every text (SCORES) by a model learnt from the rows where ``train`` holds; ``held_out`` is the others."""
    spark = df.sparkSession
    with Scratch(spark) as scratch:
        docs = df.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"),
                         F.coalesce(train, F.lit(False)).alias("train"))
        chunks = scratch.table(token_chunks(docs).withColumn("chunk", F.monotonically_increasing_id()))
        tokens = chunks.agg(F.sum("size")).first()[0] or 0
        buckets = max(1, round(tokens / BUCKET_TOKENS))
        classes = max(CLASSES, buckets // 4)
        frequent = frequent_words(chunks, tokens)
        state = scratch.table(gathered(asks(chunks, buckets, frequent), frequent, classes))
        corpus, history, news, seated = fit(state, len(frequent), classes, buckets, sweeps, burn, scratch)
        replies = scratch.table(answers(state, news, seated, history, len(frequent), burn))
        scratch.drop(state)
        return materialize(judged(chunks, replies, corpus, history, buckets, burn))


def perplexity(scored: DataFrame) -> Column:
    """Perplexity per token of a scored table's rows, as an aggregate."""
    return F.pow(F.lit(10.0), -F.sum("score") / F.sum("n_tokens"))
