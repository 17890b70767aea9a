"""Language-model scoring with a hashed maximum-entropy model whose softmax is factored by class.

Tokens are counted over all training texts by Spark. The most frequent ones are symbols of their own;
all others are one of ``RARE`` symbols, by the last bytes they end in. Symbols are dealt over ``CLASSES``
classes by rank. The probability of a token is that of its symbol's class after the tokens before,
that of the symbol within the class after the same, and, for a rare symbol, the token's smoothed share
of its symbol's counts; a token that was never seen has the share of one of count zero, so the
probabilities of all tokens, one unseen of each ending among them, sum to one.

Both softmaxes start from the counts' own log shares and add weights of hashed features: the token
before, the one two and the one three before it (skips), and the last two together. Weights lie in tables
of a fixed number of rows. They are trained by distributed gradient updates: in each round every task
goes through its documents in mini-batches with steps that shrink as a row is used (AdaGrad), and the
tasks' weights are then averaged row by row, by how often each task used the row. Each training
document is in one round. The tables' size is fixed; the number of tasks grows with the tokens.

Counts of the ``KNOWN`` most frequent tokens go to the tasks as arrays; all others are joined, so
the counts that a text needs are exact whatever the vocabulary. Tokens are told apart by 64-bit hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.scratch import in_batches, stash
from attesta.llm.textkit import Words, mix64, slices

CLASSES, MEMBERS = 32, 32
RARE = 64
#: Tokens whose counts every task holds: 17 bytes each.
KNOWN = 1 << 18
#: Rows of each table of weights; 2 ** 15 rows of CLASSES and of MEMBERS numbers are 8 MB.
ROWS = 1 << 15
ROUNDS = 2
#: Training tokens of a task and round, about.
SHARD = 4 << 20
#: Positions of a mini-batch, and the length of a step.
BATCH, RATE = 1024, 0.1
CHUNK = 1 << 11

_END = int(mix64(np.array([0xE0D], np.uint64))[0])
_ENCODED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, rare double, ids binary, rest array<long>, rest_as array<long>"


class Tokens:
    """The tokens of a slice of texts: hashes in text order, each text's end token behind its words, and the ending of each."""

    def __init__(self, col: pa.Array):
        w = Words(col)
        n = len(w.first) - 1
        own = np.arange(len(w.hash)) + np.repeat(np.arange(n), w.count())
        self.first = w.first + np.arange(n + 1)
        self.hash = np.full(self.first[-1], _END, np.uint64)
        self.hash[own] = w.hash
        last = np.zeros(len(w.hash), np.uint64)
        for j in range(1, 4):
            at = w.end - j
            last = last << np.uint64(8) | np.where(at >= w.start, w.bytes[np.maximum(at, 0)], 0).astype(np.uint64)
        self.kind = np.zeros(self.first[-1], np.int16)
        self.kind[own] = mix64(last) % np.uint64(RARE)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [np.zeros(0, t) for t in (np.uint64, np.int16, np.int64)]
    out = lambda: pa.record_batch({"hash": held[0].view(np.int64), "kind": held[1], "c": held[2]})
    for batch in batches:
        for part in slices(batch, "text"):
            t = Tokens(part.column(0))
            h, at, c = np.unique(t.hash, return_index=True, return_counts=True)
            both, at2, spot = np.unique(np.concatenate([held[0], h]), return_index=True, return_inverse=True)
            held = [both, np.concatenate([held[1], t.kind[at]])[at2], np.bincount(spot, np.concatenate([held[2], c]), len(both)).astype(np.int64)]
            if len(both) > 1 << 20:
                yield out()
                held = [x[:0] for x in held]
    if len(held[0]):
        yield out()


class Counts(NamedTuple):
    """What all tasks know: tokens of known count in ascending order of hash, their symbols or -1, and the totals."""

    hash: np.ndarray
    c: np.ndarray
    symbol: np.ndarray
    tokens: int
    distinct: int
    rare_tokens: np.ndarray
    rare_distinct: np.ndarray
    sizes: np.ndarray  # the count of each symbol: frequent tokens first, then one for each ending

    def base(self, c):
        """log10 share of a token of count ``c``."""
        return np.log10((c + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))

    def share(self, c, kind):
        """log10 share of a rare token in its symbol."""
        return np.log10((c + 0.5) / (self.rare_tokens[kind] + 0.5 * (self.rare_distinct[kind] + 1)))

    @property
    def frequent(self) -> int:
        return len(self.sizes) - RARE


#: Eight levels a power of two.
_LEVEL = "cast(floor(log2(c) * 8) as int)"


def counts_of(counts: DataFrame, known: int = KNOWN) -> Counts:
    """From ``counts(hash, kind, c)`` of all training tokens; which are frequent is decided by level of count, so that no order of all tokens is needed."""
    levels = {r.level: (r.words, r.tokens) for r in counts.groupBy(F.expr(_LEVEL).alias("level")).agg(F.count("*").alias("words"), F.sum("c").alias("tokens")).collect()}  # some hundred

    def from_level(most: int) -> int:
        least, words = 1 << 30, 0
        for level in sorted(levels, reverse=True):
            words += levels[level][0]
            if words > most:
                break
            least = level
        return least

    frequent, held = from_level(CLASSES * MEMBERS - RARE), from_level(known)
    rows = counts.filter(f"{_LEVEL} >= {held}").select("hash", "c", F.expr(f"{_LEVEL} >= {frequent}").alias("own")).toArrow()  # ``known`` rows at most
    h, c, own = rows.column(0).to_numpy().view(np.uint64), rows.column(1).to_numpy(), rows.column(2).to_numpy()
    order = np.argsort(h)
    h, c, own = h[order], c[order], own[order]
    ranked = np.flatnonzero(own)
    ranked = ranked[np.lexsort((h[ranked], -c[ranked]))]
    symbol = np.full(len(h), -1, np.int32)
    symbol[ranked] = np.arange(len(ranked))
    rare = np.zeros((2, RARE), np.int64)
    for r in counts.filter(f"{_LEVEL} < {frequent}").groupBy("kind").agg(F.sum("c").alias("c"), F.count("*").alias("words")).collect():  # RARE rows
        rare[:, r.kind] = r.c, r.words
    tokens, distinct = sum(t for _, t in levels.values()), sum(w for w, _ in levels.values())
    return Counts(h, c, symbol, tokens, distinct, rare[0], rare[1], np.concatenate([c[ranked], rare[0]]))


def _encoded(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Counts = shared.value
        end_symbol = known.frequent
        for batch in batches:
            for part in slices(batch, "text"):
                t = Tokens(part.column(3))
                at = np.minimum(np.searchsorted(known.hash, t.hash), max(len(known.hash) - 1, 0))
                hit = known.hash[at] == t.hash if len(known.hash) else np.zeros(len(t.hash), bool)
                c = np.where(hit, known.c[at], 0) if len(known.hash) else np.zeros(len(t.hash), np.int64)
                symbol = np.where(hit, known.symbol[at], -1) if len(known.hash) else np.full(len(t.hash), -1)
                rare = np.where(hit & (symbol < 0), known.share(c, t.kind), 0.0)
                base = np.where(hit, known.base(c), 0.0)
                ids = np.where(symbol < 0, end_symbol + t.kind, symbol).astype("<u2")
                first = t.first
                per = lambda x: np.add.reduceat(x, first[:-1])  # noqa: E731  every text has its end token
                rest, rest_as = [], []
                for s, e in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
                    other = s + np.flatnonzero(~hit[s:e])
                    h, one, m = np.unique(t.hash[other], return_index=True, return_counts=True)
                    rest.append(h.view(np.int64))
                    rest_as.append(m * RARE + t.kind[other[one]])
                yield pa.record_batch({
                    **{n: part.column(i) for i, n in enumerate(("row", "doc_id", "held_out"))}, "n_tokens": np.diff(first), "n_known": per(hit.astype(np.int64)), "base": per(base), "rare": per(rare),
                    "ids": pa.array([ids[s:e].tobytes() for s, e in zip(first[:-1], first[1:], strict=True)], pa.binary()),
                    "rest": pa.array(rest, pa.list_(pa.int64())), "rest_as": pa.array(rest_as, pa.list_(pa.int64())),
                })

    return run


class Positions:
    """Contexts of all positions of some encoded texts, ready for the tables: symbols, classes, members and hashed features."""

    def __init__(self, ids: list[bytes], symbols: int):
        seq = [np.frombuffer(x, "<u2") for x in ids]
        size = np.array([len(x) for x in seq], np.int64)
        z = np.full(int(size.sum()) + 3 * len(seq), symbols, np.uint32)  # three starts before each text
        own = np.arange(int(size.sum())) + np.repeat(np.arange(1, len(seq) + 1) * 3, size)
        z[own] = np.concatenate(seq) if seq else 0
        self.size, self.symbol = size, z[own]
        self.before = [z[own - j] for j in (1, 2, 3)]
        self.group, self.member = self.symbol % CLASSES, self.symbol // CLASSES

    def features(self, a: int, b: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Rows in the table of classes and in that of members, of the positions from ``a`` to ``b``."""
        p, q, r = (x[a:b] for x in self.before)
        k = (self.group[a:b] + np.uint32(1)) << np.uint32(16)
        return [_row(p, 0 * p, 1), _row(q, 0 * p, 2), _row(r, 0 * p, 3), _row(p, q, 4)], [_row(p | k, 0 * p, 5), _row(q | k, 0 * p, 6), _row(p | k, q, 7)]


def _row(a: np.ndarray, b: np.ndarray, of: int) -> np.ndarray:
    h = a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA6B) + np.uint32(of * 0xC2B2AE35 & 0xFFFFFFFF)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    h ^= h >> np.uint32(13)
    return (h * np.uint32(0x297A2D39) >> np.uint32(17)).astype(np.uint16)  # ROWS is 2 ** 15


class Model:
    """The two tables of weights, and the log shares that they start from."""

    def __init__(self, sizes: np.ndarray):
        full = np.full(CLASSES * MEMBERS, np.nan)
        full[: len(sizes)] = sizes + 0.5
        by = full.reshape(MEMBERS, CLASSES).T  # symbol s is member s div CLASSES of class s mod CLASSES
        whole = np.nansum(by, 1)
        with np.errstate(divide="ignore"):
            self.group_start = np.log(whole / whole.sum()).astype(np.float32)
            self.member_start = np.where(np.isnan(by), -np.inf, np.log(by / np.maximum(whole, 0.5)[:, None])).astype(np.float32)
        self.groups, self.members = np.zeros((ROWS, CLASSES), np.float32), np.zeros((ROWS, MEMBERS), np.float32)

    @staticmethod
    def _log_softmax(start: np.ndarray, table: np.ndarray, rows: list[np.ndarray]) -> np.ndarray:
        z = start + table[rows[0]]
        for r in rows[1:]:
            z += table[r]
        z -= z.max(1, keepdims=True)
        z -= np.log(np.exp(z).sum(1, keepdims=True))
        return z

    def outputs(self, x: Positions, a: int, b: int):
        """Log probabilities of all classes, and of all members of the right class, with the rows they come from."""
        of_groups, of_members = x.features(a, b)
        return self._log_softmax(self.group_start, self.groups, of_groups), self._log_softmax(self.member_start[x.group[a:b]], self.members, of_members), of_groups, of_members

    def log_probability(self, ids: list[bytes], symbols: int) -> np.ndarray:
        """log10 probability of each text's symbols."""
        x = Positions(ids, symbols)
        out = np.zeros(len(x.symbol))
        for a in range(0, len(out), BATCH):
            b = min(a + BATCH, len(out))
            g, m, _, _ = self.outputs(x, a, b)
            at = np.arange(b - a)
            out[a:b] = g[at, x.group[a:b]].astype(np.float64) + m[at, x.member[a:b]]
        first = np.concatenate([[0], np.cumsum(x.size)])
        return np.add.reduceat(out, first[:-1]) / math.log(10) if len(x.size) else out

    def train(self, ids: list[bytes], symbols: int, used: list[np.ndarray], squares: list[np.ndarray]) -> None:
        """One pass over the texts in mini-batches; ``used`` counts the steps of rows, ``squares`` sums squared gradients.

        A row that several positions of a mini-batch use takes the step of one of them, the last.
        """
        x = Positions(ids, symbols)
        for a in range(0, len(x.symbol), BATCH):
            b = min(a + BATCH, len(x.symbol))
            g, m, of_groups, of_members = self.outputs(x, a, b)
            at = np.arange(b - a)
            for t, (lp, wanted, table, rows) in enumerate(((g, x.group, self.groups, of_groups), (m, x.member, self.members, of_members))):
                lost = np.exp(lp)
                lost[at, wanted[a:b]] -= 1
                norm = (lost * lost).mean(1)
                for r in rows:
                    used[t][r] += 1
                    squares[t][r] += norm
                    table[r] -= (RATE / np.sqrt(1 + squares[t][r]))[:, None] * lost


def _trained(shared, symbols: int):
    """The rows that a task has used, in chunks: weights times uses, and uses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = Model.__new__(Model)
        model.__dict__ |= shared.value.__dict__ | {"groups": shared.value.groups.copy(), "members": shared.value.members.copy()}
        used, squares = [np.zeros(ROWS, np.int64) for _ in range(2)], [np.zeros(ROWS, np.float32) for _ in range(2)]
        for batch in batches:
            for part in slices(batch, "ids"):
                model.train([x for x in part.column(0).to_pylist() if x], symbols, used, squares)
        for t, table in enumerate((model.groups, model.members)):
            for i in range(0, ROWS, CHUNK):
                n = used[t][i : i + CHUNK]
                if n.any():
                    yield pa.record_batch({"part": pa.array([t * ROWS + i], pa.int32()), "weights": pa.array([table[i : i + CHUNK].astype(np.float16).tobytes()], pa.binary()), "used": pa.array([n.tobytes()], pa.binary())})

    return run


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for part, weights, used in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            n = np.frombuffer(used, np.int64)
            w = np.frombuffer(weights, np.float16).astype(np.float64).reshape(CHUNK, -1) * n[:, None]
            if part in held:
                held[part][0] += w
                held[part][1] += n
            else:
                held[part] = [w, n.copy()]
    for part, (w, n) in held.items():
        yield pa.record_batch({"part": pa.array([part], pa.int32()), "weights": pa.array([(w / np.maximum(n, 1)[:, None]).astype(np.float32).tobytes()], pa.binary()), "used": pa.array([(n > 0).tobytes()], pa.binary())})


def fit(encoded: DataFrame, known: Counts) -> Model:
    """The model of the rows of ``encoded`` that aren't held out."""
    spark = encoded.sparkSession
    model, symbols = Model(known.sizes), len(known.sizes)
    tasks = max(1, -(-known.tokens // (ROUNDS * SHARD)))
    for turn in range(ROUNDS):
        shared = spark.sparkContext.broadcast(model)
        mine = encoded.filter(~F.col("held_out")).filter(F.pmod(F.xxhash64("row"), F.lit(ROUNDS)) == turn).select("ids").coalesce(tasks)
        parts = in_batches(mine, _trained(shared, symbols), "part int, weights binary, used binary")
        for r in in_batches(parts.repartition(2 * ROWS // CHUNK, "part"), _averaged, "part int, weights binary, used binary").collect():  # the tables: 8 MB
            table = (model.groups, model.members)[r.part // ROWS]
            at = r.part % ROWS + np.flatnonzero(np.frombuffer(r.used, bool))
            table[at] = np.frombuffer(r.weights, np.float32).reshape(CHUNK, -1)[at - r.part % ROWS]
        shared.destroy()
    return model


def _scored(shared, symbols: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        for batch in batches:
            for part in slices(batch, "ids"):
                yield pa.record_batch({"row": part.column(0), "symbols": model.log_probability(part.column(1).to_pylist(), symbols)})

    return run


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", held_out: tuple[int, int] = (5, 1), known: int = KNOWN) -> DataFrame:
    """Per row of ``docs``: ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    Held out are the rows whose crc32 of doc_id as text leaves ``held_out[1]`` when divided by
    ``held_out[0]``; the model learns from all others. Tokens are words with A-Z lower-cased and one end
    a text; ``n_known`` of them occur in training. ``base_score`` is the text's log10 probability by
    token counts, ``score`` by the model. Null text is empty: its end is its only token. A null
    doc_id hashes as no digits. Repeated rows are counted and scored again each. Texts are read whole.
    With nothing to learn from all tokens are unseen. Extra columns are not read; an empty table gives
    no rows.
    """
    spark = docs.sparkSession
    parts, left = held_out
    out = F.crc32(F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("")).cast("binary")) % parts == left
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), out.alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    counts = in_batches(text.filter(~F.col("held_out")).select("text"), _counted, "hash long, kind short, c long").groupBy("hash").agg(F.sum("c").alias("c"), F.min("kind").alias("kind"))
    counts = stash(counts, "counts")
    found = counts_of(counts, known)
    shared = spark.sparkContext.broadcast(found)
    encoded = stash(in_batches(text.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text"), _encoded(shared), _ENCODED), "encoded")
    shared.destroy()

    model = spark.sparkContext.broadcast(fit(encoded, found))
    scored = stash(in_batches(encoded.select("row", "ids"), _scored(model, len(found.sizes)), "row long, symbols double"), "scored")
    model.destroy()

    # Tokens that the tasks don't know the count of.
    rest = encoded.select("row", F.explode(F.arrays_zip("rest", "rest_as")).alias("r")).select("row", F.col("r.rest").alias("hash"), F.col("r.rest_as").alias("mk"))
    rest = rest.join(counts.select("hash", "c"), "hash", "left").withColumns({"c": F.coalesce("c", F.lit(0)), "m": F.expr(f"mk div {RARE}"), "kind": (F.col("mk") % RARE).cast("int")})
    under = F.array([F.lit(float(n + 0.5 * (v + 1))) for n, v in zip(found.rare_tokens, found.rare_distinct, strict=True)])
    all_ = found.tokens + 0.5 * (found.distinct + 1)
    rest = rest.groupBy("row").agg(
        F.sum(F.expr("if(c > 0, m, 0)")).alias("more"),
        F.sum(F.col("m") * F.log10((F.col("c") + 0.5) / F.lit(float(all_)))).alias("base_rest"),
        F.sum(F.col("m") * F.log10((F.col("c") + 0.5) / F.get(under, F.col("kind")))).alias("rare_rest"),
    )
    full = encoded.select("row", "doc_id", "held_out", "n_tokens", "n_known", "base", "rare").join(scored, "row").join(rest, "row", "left")
    plus = lambda *c: sum((F.coalesce(x, F.lit(0)) for x in c[1:]), F.col(c[0]))
    return full.select("doc_id", "held_out", "n_tokens", plus("n_known", "more").alias("n_known"), F.lit(found.tokens).cast("long").alias("train_tokens"), plus("base", "base_rest").alias("base_score"), plus("symbols", "rare", "rare_rest").alias("score"))

