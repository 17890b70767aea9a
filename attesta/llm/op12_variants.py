"""Spelling variants: words one edit apart, found in a positional q-gram inverted index.

A word of ``L`` letters has ``L + Q - 1`` padded q-grams; two words one edit apart share all but ``Q``
of the longer one's, each at the same place before the edit and one place on behind it. So they
share one of the first ``Q + 1`` grams of either, in an order that all words share (rare grams first,
by a count sketch of fixed size; the order affects speed alone). The index has a list for each gram,
place and length. A word stands in those of its own first grams, and asks, as the longer one, those of
words a letter shorter at both places the gram may have there. Spark merges the postings (a shuffle
sorted by list is the heap merge, spilled where it must); words that meet are counted by a 64-bit
signature of their grams, kept above the bound that one edit leaves, and verified letter by letter.

A list that a second sketch knows to be long is not met as a whole: its words share the other grams
but ``Q`` too, so it is parted by each of the first ``Q + 1`` of these, with their places. That is
the same search once more inside the list, and as exact.

Words hold letters up to U+00FF, so they are compared as Latin-1, a byte a letter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.scratch import discard, in_batches, stash
from attesta.llm.textkit import flat, mix64, slices

Q = 3
MIN_LENGTH, MIN_COUNT = 7, 2
#: One in so many spellings of a document loses a letter; 0 for none.
DROP = 31
#: A form must be this many times as frequent as the word.
FORM_TIMES = 10
#: Counters of each sketch: 2 MB whatever the vocabulary.
SKETCH = 1 << 18
#: Lists whose counter is above this are parted by a second gram.
LONG_LIST = 1 << 10
#: Words that a task counts before it hands them on, and pairs that it compares at once.
HELD, PAIRS = 1 << 18, 1 << 20
#: Longer words are compared one by one.
WIDE = 64

_POSTING = "key long, longer boolean, word binary, n long"
_TURN = np.uint64(0x9E3779B97F4A7C15)


def spelling(start: int, run: str, drop: int = DROP) -> str:
    """``run`` without the letter that the hash of its document and itself deletes, if it does; ``start`` is the crc32 of ``<doc_id>:``."""
    if not drop:
        return run
    h = zlib.crc32(run.encode(), start)
    if h % drop:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counted(min_length: int, drop: int):
    runs = re.compile(f"[a-zÀ-ÿ]{{{min_length},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        out = lambda: pa.record_batch({"word": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})
        for batch in batches:
            for part in slices(batch, "text"):
                for i, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), strict=True):
                    if not text:
                        continue
                    start = zlib.crc32(b"%d:" % i if i is not None else b":")
                    for found, n in Counter(runs.findall(text.lower().decode("utf-8", "replace"))).items():
                        word = spelling(start, found, drop)
                        if len(word) >= min_length:
                            held[word] += n
                    if len(held) > HELD:
                        yield out()
                        held.clear()
        if held:
            yield out()

    return run


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, drop: int = DROP) -> DataFrame:
    """``(word, n)``: words of at least ``min_length`` letters that occur ``min_count`` times or more."""
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return in_batches(text, _counted(min_length, drop), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


class _Grams:
    """The padded grams of many words, one after another: ``code`` (a byte a letter), ``place``, ``owner``; ``size`` is each word's length."""

    def __init__(self, words: pa.Array):
        raw, at = flat(words)
        self.raw, self.at, self.size = raw, at, np.diff(at)
        per = self.size + Q - 1
        self.first = np.concatenate([[0], np.cumsum(per)])
        self.owner = np.repeat(np.arange(len(per)), per)
        self.place = np.arange(self.first[-1]) - np.repeat(self.first[:-1], per)
        b = np.zeros(len(raw) + (len(per) + 1) * (Q - 1), np.uint64)
        b[np.arange(len(raw)) + np.repeat(np.arange(1, len(per) + 1) * (Q - 1), self.size)] = raw
        begin = np.arange(self.first[-1])  # padding of Q - 1 zeros stands between two words and serves both
        self.code = np.zeros(self.first[-1], np.uint64)
        for j in range(Q):
            self.code |= b[begin + j] << np.uint64(8 * (Q - 1 - j))


def _spot(h: np.ndarray) -> np.ndarray:
    return (mix64(h) % np.uint64(SKETCH)).astype(np.int64)


def _list_key(code, place, length) -> np.ndarray:
    return mix64(mix64(code + np.uint64(1)) * _TURN + (np.asarray(length, np.int64).astype(np.uint64) << np.uint64(32)) + np.asarray(place, np.int64).astype(np.uint64))


def _latin(words: pa.Array) -> pa.Array:
    return pa.array([w.encode("latin-1") for w in words.to_pylist()], pa.binary())


def _tally(spots: Iterator[np.ndarray]) -> Iterator[pa.RecordBatch]:
    full = np.zeros(SKETCH, np.int64)
    for spot in spots:
        full += np.bincount(spot, minlength=SKETCH)
    spot = np.flatnonzero(full)
    yield pa.record_batch({"spot": spot.astype(np.int32), "c": full[spot]})


def _sketch(df: DataFrame, spots) -> np.ndarray:
    """The summed counters of what ``spots`` gives for each batch."""
    counters = df.mapInArrow(lambda batches: _tally(map(spots, batches)), "spot int, c long").groupBy("spot").agg(F.sum("c").alias("c"))
    rows, full = counters.toArrow(), np.zeros(SKETCH, np.int64)  # SKETCH rows at most
    full[rows.column(0).to_numpy()] = rows.column(1).to_numpy()
    return full


def _ordered(g: _Grams, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all grams, each word's in the shared order (rare first, then by code and place), and each one's rank."""
    order = np.lexsort((g.place, g.code, counts[_spot(g.code)], g.owner))
    return order, np.arange(len(order)) - g.first[g.owner[order]]


def _postings(counts, lists, long_list: int, min_length: int):
    """``lists`` holds the counters of list lengths; None gives the spots of the lists instead."""

    def own(batch: pa.RecordBatch):
        g = _Grams(_latin(batch.column(0)))
        order, rank = _ordered(g, counts.value)
        top = order[rank <= Q]
        return g, order, rank, top

    def spots(batch: pa.RecordBatch) -> np.ndarray:
        g, _, _, top = own(batch)
        return _spot(_list_key(g.code[top], g.place[top], g.size[g.owner[top]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length_of = lists.value
        for batch in batches:
            g, order, rank, top = own(batch)
            words, n = _latin(batch.column(0)), batch.column(1)
            keys, owners, roles = [], [], []

            def add(key, owner, longer):
                keys.append(key)
                owners.append(owner)
                roles.append(np.full(len(key), longer))

            # As a word among those of its length, and as the longer one, at both places its gram may have in a shorter one.
            for longer, shift in ((False, 0), (True, 0), (True, 1)):
                mine = top[g.place[top] >= shift] if shift else top
                if longer:
                    mine = mine[g.size[g.owner[mine]] > min_length]
                size = g.size[g.owner[mine]] - longer
                key = _list_key(g.code[mine], g.place[mine] - shift, size)
                long_ = length_of[_spot(key)] > long_list
                add(key[~long_], g.owner[mine][~long_], longer)
                for i, k in zip(mine[long_], key[long_], strict=True):
                    w = g.owner[i]
                    others = order[g.first[w] : g.first[w + 1]]
                    others = others[others != i][: Q + 1]
                    after = g.place[others] > g.place[i]
                    # Behind the edit all grams have moved: none before a gram that has not moved, all behind one that has.
                    for also in (0, 1) if longer else (0,):
                        fits = others[np.where(after, also >= shift, also <= shift)]
                        add(mix64(_list_key(g.code[fits], g.place[fits] - also, np.zeros(len(fits))) * _TURN + k), np.full(len(fits), w), longer)
            owner = np.concatenate(owners)
            yield pa.record_batch({"key": np.concatenate(keys).view(np.int64), "longer": np.concatenate(roles), "word": words.take(pa.array(owner)), "n": n.take(pa.array(owner))})

    return spots if lists is None else run


def _signature(g: _Grams) -> np.ndarray:
    """A bit for each gram, of 64."""
    return np.bitwise_or.reduceat(np.uint64(1) << (mix64(g.code) >> np.uint64(58)), g.first[:-1]) if len(g.size) else np.zeros(0, np.uint64)


def _one_edit(g: _Grams, x: np.ndarray, y: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """Whether words ``x`` and ``y`` are exactly one edit apart; ``y`` is a letter longer where ``longer`` says so."""
    hit = np.zeros(len(x), bool)
    wide = g.size[x] > WIDE
    for i in np.flatnonzero(wide):
        a, b = (g.raw[g.at[j] : g.at[j + 1]] for j in (x[i], y[i]))
        lead = int(np.argmin(np.append(a == b[: len(a)], False)))
        hit[i] = np.array_equal(a[lead + (not longer[i]) :], b[lead + 1 :]) if len(b) > lead else False
    few = np.flatnonzero(~wide)
    if len(few):
        x, y, longer = x[few], y[few], longer[few]
        size, width = g.size[x], int(g.size[x].max())
        col = np.arange(width)
        inside = col < size[:, None]
        at = lambda j, to: g.raw[np.minimum(g.at[j][:, None] + to, len(g.raw) - 1)]
        same = (at(x, col) == at(y, col)) | ~inside
        moved = (at(x, col) == at(y, col + 1)) | ~inside
        lead = np.where(same.all(1), size, np.argmin(same, 1))
        tail = np.where(moved.all(1), 0, width - np.argmin(moved[:, ::-1], 1))  # from here on all agree, moved by one
        hit[few] = np.where(longer, tail <= lead, (~same).sum(1) == 1)
    return hit


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs one edit apart, both ways, from postings sorted by list, those of shorter words first."""
    held: list[pa.RecordBatch] = []  # the last list may go on in the next batch
    of = None
    for batch in batches:
        key = batch.column(0).to_numpy()
        if not len(key):
            continue
        last = int(np.searchsorted(key, key[-1]))
        if last or key[0] != of:
            held.append(batch.slice(0, last))
            yield from _in_lists(pa.Table.from_batches(held))
            held, of = [], key[-1]
        held.append(batch.slice(last))
    if held:
        yield from _in_lists(pa.Table.from_batches(held))


def _in_lists(table: pa.Table) -> Iterator[pa.RecordBatch]:
    if not table.num_rows:
        return
    key, longer = table.column(0).to_numpy(), table.column(1).to_numpy()
    words = table.column(2).combine_chunks()
    n = table.column(3).to_numpy()
    g = _Grams(words)
    sign = _signature(g)
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    end = np.repeat(np.append(begin[1:], len(key)), np.diff(np.append(begin, len(key))))
    partners = np.where(longer, 0, end - np.arange(len(key)) - 1)
    upto = np.cumsum(partners)
    at = 0
    while at < len(key):
        base = upto[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(upto, base + PAIRS, side="right")))
        per = partners[at:to]
        x = np.repeat(np.arange(at, to), per)
        y = x + 1 + np.arange(len(x)) - np.repeat(upto[at:to] - per - base, per)
        lost = np.bitwise_count(sign[x] ^ sign[y])
        near = (lost <= np.where(longer[y], 2 * Q - 1, 2 * Q)) & (g.size[y] - g.size[x] == longer[y])  # all that one edit can change
        x, y = x[near], y[near]
        hit = _one_edit(g, x, y, longer[y])
        x, y = x[hit], y[hit]
        if len(x):
            both, other = np.concatenate([x, y]), np.concatenate([y, x])
            text = lambda i: pa.array([w.decode("latin-1") for w in words.take(pa.array(i)).to_pylist()], pa.string())
            yield pa.record_batch({"word": text(both), "other": text(other), "other_n": n[other]})
        at = to


def near_words(words: DataFrame, min_length: int = MIN_LENGTH, long_list: int = LONG_LIST) -> DataFrame:
    """``(word, other, other_n)`` for all pairs of ``words(word, n)`` one edit apart, both ways; ``words`` is read several times."""
    spark = words.sparkSession
    only = words.select("word")
    counts = spark.sparkContext.broadcast(_sketch(only, lambda batch: _spot(_Grams(_latin(batch.column(0))).code)))
    lists = spark.sparkContext.broadcast(_sketch(only, _postings(counts, None, long_list, min_length)))
    postings = in_batches(words.select("word", "n"), _postings(counts, lists, long_list, min_length), _POSTING)
    met = in_batches(postings.repartition("key").sortWithinPartitions("key", "longer"), _met, "word string, other string, other_n long")
    return met.groupBy("word", "other").agg(F.first("other_n").alias("other_n"))


def _roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` of all words that have a form: each round doubles the steps followed. A form is ``FORM_TIMES`` as frequent as its word, so there are no circles and few steps."""
    now = stash(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("on"))
        new = stash(now.join(on, "root", "left").select("word", F.coalesce("on", "root").alias("root"), F.col("on").isNotNull().alias("moved")), "roots")
        discard(now)
        now = new
        if now.filter("moved").isEmpty():
            return now.select("word", "root")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, drop: int = DROP, times: int = FORM_TIMES, long_list: int = LONG_LIST) -> DataFrame:
    """Per word ``word, n, n_near, form, form_n, root``.

    Words are the maximal runs of letters A-Z, a-z and U+00C0 to U+00FF of all texts, A-Z lower-cased;
    where ``drop`` divides the crc32 of ``<doc_id>:<run>`` the run loses a letter first. ``form`` is the
    most frequent word one edit away (ties: first in code-point order) if it is ``times`` as frequent,
    ``root`` the last of the forms of forms. Null and empty texts have no words; a null doc_id hashes as
    no digits; repeated rows count again each. Texts are read whole, runs of any length are words.
    Extra columns are not read; an empty table gives no rows.
    """
    words = stash(vocabulary(docs, id_col, text_col, min_length, min_count, drop), "words")
    near = near_words(words, min_length, long_list).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form"))).alias("best"))
    form_n = -F.col("best.less")
    fits = form_n >= times * F.col("n")
    full = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.form")).alias("form"), F.when(fits, form_n).alias("form_n"))
    full = stash(full, "forms")
    roots = _roots(full.filter("form is not null"))
    return full.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))


def oracle() -> str:
    """The same rows in DuckDB; near words meet by what a deletion leaves of them."""
    return f"""
    WITH RECURSIVE table_ AS (
      SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)
    ), runs AS (
      SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
    ), each_ AS (
      SELECT id, run, count(*) AS n FROM runs WHERE length(run) >= {MIN_LENGTH} GROUP BY ALL
    ), hashed AS (
      SELECT run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(id || ':' || run, ''),
        lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [192 | (unicode(x) >> 6), 128 | (unicode(x) & 63)] END))),
        lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) AS h FROM each_, table_
    ), spelt AS (
      SELECT CASE WHEN h % {DROP} = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n FROM hashed
    ), words AS (
      SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelt WHERE length(word) >= {MIN_LENGTH} GROUP BY word HAVING sum(n) >= {MIN_COUNT}
    ), cut AS (
      SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM words, LATERAL (SELECT unnest(range(1, length(word) + 1)) AS i)
    ), pairs AS (
      SELECT a.word, b.word AS other, b.n AS other_n FROM cut a JOIN cut b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
      UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.less = b.word
      UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.less = b.word
    ), near AS (
      SELECT word, count(*) AS n_near, max(other_n) AS most, arg_min(other, (-other_n, other)) AS best FROM pairs GROUP BY word
    ), forms AS (
      SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= {FORM_TIMES} * w.n THEN best END AS form, CASE WHEN most >= {FORM_TIMES} * w.n THEN most END AS form_n FROM words w LEFT JOIN near USING (word)
    ), steps(word, root) AS (
      SELECT word, word FROM forms UNION ALL SELECT s.word, f.form FROM steps s JOIN forms f ON s.root = f.word WHERE f.form IS NOT NULL
    )
    SELECT f.word, f.n, f.n_near, f.form, f.form_n, s.root FROM forms f JOIN (SELECT s.word, s.root FROM steps s JOIN forms f ON s.root = f.word WHERE f.form IS NULL) s ON f.word = s.word"""
