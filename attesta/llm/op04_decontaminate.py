"""Benchmark decontamination: BM25 over test items with block-max WAND.

The test items form an inverted index; every passage of every training text is a query. Scores
are divided by the item's score against itself, so one threshold fits items of any length. Most
passages are passed over together: the longest lists, which no item gets half the threshold from,
are set aside, and what the other terms of a passage can add stays too low for every item. The
rest go through block-max WAND, which returns all items at or above the threshold, and each hit is
verified: five-word shingles of the item's question and words of its answer must be in the passage.
A question of fewer than five words must be in it as a sequence.

Document frequencies, the number of items, their mean and greatest length are those of all items,
so scores don't depend on how the items are indexed: in blocks of bounded bytes, each sent to the
executors, so any number of items is handled. Texts are read where they lie: no shuffle.

Of items or passages with equal scores all are found. A document's best passage for an item is the
one with the highest score, of equal ones the first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.prefilter import without
from attesta.llm.scratch import in_batches, stash
from attesta.llm.textkit import Words, slices

#: Bytes of test items in one index; more items make more blocks, and each block is one reading of the texts.
BLOCK_BYTES = 16 << 20
#: Postings that share one maximum.
POSTINGS = 16
K1, B = 1.2, 0.75
SCORE = 0.5
QUESTION, ANSWER = 0.5, 0.5
SHINGLE = 5


def split_item(text: str) -> tuple[str, str]:
    """Question and answer: the last sentence is the answer if another stands before it."""
    cut = [m.end() for m in re.finditer(r"[.!?]\s+", text.rstrip())]
    return (text[: cut[-1]], text[cut[-1] :]) if cut else (text, "")


def _words(texts: list[str]) -> list[np.ndarray]:
    w = Words(pa.array(texts, pa.string()))
    return [w.hash[s:e] for s, e in zip(w.first[:-1], w.first[1:], strict=True)]


def _shingles(texts: list[str]) -> list[np.ndarray]:
    h, at = Words(pa.array(texts, pa.string())).shingles(SHINGLE)
    return [np.unique(h[s:e]) for s, e in zip(at[:-1], at[1:], strict=True)]


def _holds(passage: np.ndarray, words: np.ndarray) -> bool:
    """Whether ``words`` stand one after another in ``passage``."""
    n = len(passage) - len(words) + 1
    return n > 0 and bool(np.logical_and.reduce([passage[j : j + n] == x for j, x in enumerate(words)]).any())


class Statistics(NamedTuple):
    """Of all items: their number, mean and greatest length in words, and (for the terms at hand) in how many each term is."""

    items: int
    mean: float
    longest: int
    df: dict[int, int]

    @classmethod
    def of(cls, texts: list[str]) -> Statistics:
        words = _words(texts)
        terms, df = np.unique(np.concatenate([np.unique(w) for w in words]) if words else np.zeros(0, np.uint64), return_counts=True)
        length = [len(w) for w in words]
        return cls(len(words), float(np.mean(length)) if words else 0.0, max(length, default=0), dict(zip(terms.tolist(), df.tolist(), strict=True)))


class _Lists:
    """Parts of one flat array by number."""

    def __init__(self, flat: np.ndarray, at: np.ndarray):
        self.flat, self.at = flat, at

    def __getitem__(self, i: int) -> np.ndarray:
        return self.flat[self.at[i] : self.at[i + 1]]


class Index:
    """Impact-ordered inverted lists of one block of items, with block maxima."""

    def __init__(self, items: list[tuple[int, str]], least: float, of_all: Statistics | None = None):
        items = sorted(items)
        self.ids = [i for i, _ in items]
        all_ = of_all or Statistics.of([t for _, t in items])
        words = _words([t for _, t in items])
        n, length = len(items), np.array([len(w) for w in words], float)
        self.width = int(max(64, 2 * all_.longest))
        norm = K1 * (1 - B + B * length / max(all_.mean, 1e-9))
        terms, docs, impacts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], [np.zeros(0)]
        for d, w in enumerate(words):
            t, c = np.unique(w, return_counts=True)
            df = np.array([all_.df[x] for x in t.tolist()], float)
            impact = np.log1p((all_.items - df + 0.5) / (df + 0.5)) * c * (K1 + 1) / (c + norm[d])
            terms.append(t)
            docs.append(np.full(len(t), d, np.int32))
            impacts.append(impact / max(impact.sum(), 1e-12))
        term = np.concatenate(terms)
        order = np.argsort(term, kind="stable")
        self.terms, self.sizes = np.unique(term, return_counts=True)
        self.offsets = np.cumsum(self.sizes) - self.sizes
        at = np.append(self.offsets, len(term))
        self.all_docs, self.all_impacts = np.concatenate(docs)[order], np.concatenate(impacts)[order]
        self.docs, self.impacts = _Lists(self.all_docs, at), _Lists(self.all_impacts, at)
        self.most = np.maximum.reduceat(self.all_impacts, self.offsets) if len(term) else np.zeros(0)
        blocks = -(-self.sizes // POSTINGS)
        block_at = np.append(np.cumsum(blocks) - blocks, blocks.sum())
        first = np.repeat(self.offsets - POSTINGS * block_at[:-1], blocks) + POSTINGS * np.arange(block_at[-1])
        self.block_most = _Lists(np.maximum.reduceat(self.all_impacts, first) if len(term) else np.zeros(0), block_at)
        # Long lists that give no item more than half of what it needs, the longest first.
        given, self.essential = np.zeros(n), np.ones(len(self.terms), bool)
        for t in np.argsort(-self.sizes, kind="stable").tolist():
            given[self.docs[t]] += self.impacts[t]
            if given.max() > least / 2:
                given[self.docs[t]] -= self.impacts[t]
                break
            self.essential[t] = False
        self.needed = least - given
        parts = [split_item(t) for _, t in items]
        self.question, self.answer = _shingles([q for q, _ in parts]), [np.unique(w) for w in _words([a for _, a in parts])]
        self.short = [w if 0 < len(w) < SHINGLE else None for w in _words([q for q, _ in parts])]  # questions too short for a shingle

    def likely(self, passage: np.ndarray, term: np.ndarray) -> np.ndarray:
        """Passages that some item may reach the threshold in, from their essential terms."""
        both = np.unique(passage * len(self.terms) + term)
        passage, term = both // len(self.terms), both % len(self.terms)
        size = self.sizes[term]
        at = np.repeat(self.offsets[term] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        pair, spot = np.unique(np.repeat(passage, size) * len(self.ids) + self.all_docs[at], return_inverse=True)
        reached = np.bincount(spot, self.all_impacts[at], len(pair))
        return np.unique(pair[reached >= self.needed[pair % len(self.ids)] - 1e-9] // len(self.ids))

    def search(self, terms: np.ndarray, least: float) -> list[tuple[int, float]]:
        """All items whose score against these distinct terms is ``least`` or more, by block-max WAND."""
        cursors = [[int(self.docs[t][0]), 0, int(t)] for t in terms]
        found = []
        slack = least - 1e-9
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for i, (_, _, t) in enumerate(cursors):
                bound += self.most[t]
                if bound >= slack:
                    pivot = i
                    break
            if pivot < 0:
                break
            doc = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == doc:
                pivot += 1
            near, until = 0.0, None  # maxima of the blocks that hold doc, and where the first of them ends
            for c in cursors[: pivot + 1]:
                docs = self.docs[c[2]]
                at = c[1] + int(np.searchsorted(docs[c[1] :], doc))
                if at < len(docs):
                    near += self.block_most[c[2]][at // POSTINGS]
                    last = int(docs[min((at // POSTINGS + 1) * POSTINGS, len(docs)) - 1])
                    until = last if until is None else min(until, last)
            if near >= slack:
                score = 0.0
                for c in cursors[: pivot + 1]:
                    docs = self.docs[c[2]]
                    at = c[1] + int(np.searchsorted(docs[c[1] :], doc))
                    if at < len(docs) and docs[at] == doc:
                        score += self.impacts[c[2]][at]
                if score >= slack:
                    found.append((doc, score))
                to = doc + 1
            else:
                to = (doc if until is None else until) + 1
                if pivot + 1 < len(cursors):
                    to = min(to, cursors[pivot + 1][0])
                to = max(to, doc + 1)
            for c in cursors[: pivot + 1]:
                docs = self.docs[c[2]]
                c[1] += int(np.searchsorted(docs[c[1] :], to))
                c[0] = int(docs[c[1]]) if c[1] < len(docs) else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return found


def _scan(index, score: float, question: float, answer: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix: Index = index.value
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column(1))
                out: dict[tuple[int, int], tuple] = {}
                if len(w.hash) and len(ix.terms):
                    term = np.minimum(np.searchsorted(ix.terms, w.hash), len(ix.terms) - 1)
                    known = ix.terms[term] == w.hash
                    n, step = w.count(), ix.width // 2
                    per = np.where(n > 0, np.maximum(1, -(-(n - step) // step)), 0)
                    base = np.cumsum(per) - per
                    doc = np.repeat(np.arange(len(n)), per)
                    begin = w.first[doc] + step * (np.arange(len(doc)) - base[doc])
                    end = np.minimum(begin + ix.width, w.first[doc + 1])
                    word = np.flatnonzero(known & ix.essential[term])
                    of = np.searchsorted(w.first, word, side="right") - 1
                    nth = (word - w.first[of]) // step  # a word is in this passage and the one before
                    here, before = nth < per[of], nth > 0
                    likely = ix.likely(np.concatenate([(base[of] + nth)[here], (base[of] + nth - 1)[before]]), np.concatenate([term[word][here], term[word][before]]))
                    h, at = w.shingles(SHINGLE) if len(likely) else (None, None)
                    for i in likely.tolist():
                        s, e, d = int(begin[i]), int(end[i]), int(doc[i])
                        hits = ix.search(np.unique(term[s:e][known[s:e]]), score)
                        if not hits:
                            continue
                        first = int(at[d]) + s - int(w.first[d])
                        own = np.unique(h[first : max(first + 1, first + e - s - SHINGLE + 1)])
                        words = np.unique(w.hash[s:e])
                        for item, value in hits:
                            if ix.short[item] is not None:
                                q = float(_holds(w.hash[s:e], ix.short[item]))
                            else:
                                q = np.isin(ix.question[item], own).mean() if len(ix.question[item]) else 0.0
                            a = np.isin(ix.answer[item], words).mean() if len(ix.answer[item]) else 1.0
                            new = (float(value), float(q), float(a), s - int(w.first[d]))
                            if q >= question and a >= answer and out.get((d, item), (-1.0,))[0] < new[0]:
                                out[d, item] = new
                if out:
                    at_, rows = list(out), list(out.values())
                    yield pa.record_batch({"doc_id": part.column(0).take(pa.array([d for d, _ in at_])), "item_id": pa.array([ix.ids[i] for _, i in at_], pa.int64()), "score": [r[0] for r in rows], "question_overlap": [r[1] for r in rows], "answer_overlap": [r[2] for r in rows], "passage_start": pa.array([r[3] for r in rows], pa.int64())})

    return run


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            w = Words(part.column(1))
            item = np.repeat(np.arange(part.num_rows), w.count())
            both = np.unique(np.stack([item.astype(np.uint64), w.hash], 1), axis=0) if len(item) else np.zeros((0, 2), np.uint64)
            yield pa.record_batch({"block": part.column(0).take(pa.array(both[:, 0].astype(np.int64))), "term": both[:, 1].view(np.int64), "words": pa.nulls(len(both), pa.int64())})
            yield pa.record_batch({"block": part.column(0), "term": pa.nulls(part.num_rows, pa.int64()), "words": w.count().astype(np.int64)})


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", score: float = SCORE, question: float = QUESTION, answer: float = ANSWER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document row and test item that it holds: ``doc_id, item_id, score, question_overlap, answer_overlap, passage_start``.

    The best passage is given, its start in words; of equal ones the first. Items without words
    match nothing; items that repeat are each reported, and count each in the statistics. Null or
    empty texts and an empty table on either side give no rows; rows that repeat a document are each
    reported; a null doc_id is kept; a null item_id takes no part. Extra columns are not read.
    """
    spark = docs.sparkSession
    items = benchmark.filter("text is not null and item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-int(size) // block_bytes))
    items = items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    terms = stash(in_batches(items.select("block", "text"), _item_terms, "block long, term long, words long"), "terms")
    all_ = terms.filter("words > 0").agg(F.count("*").alias("n"), F.avg("words").alias("mean"), F.max("words").alias("longest")).first()
    df = terms.filter("term is not null").groupBy("term").agg(F.count("*").alias("df"))
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, passage_start long"
    found = []
    for i in range(blocks):
        own = [(r.item_id, r.text) for r in items.filter(F.col("block") == i).collect() if r.text.strip()]  # about block_bytes
        here = terms.filter((F.col("block") == i) & F.col("term").isNotNull()).select("term").distinct()
        of_all = Statistics(all_.n, all_.mean or 0.0, all_.longest or 0, {r.term & (2**64 - 1): r.df for r in df.join(here, "term").collect()})  # no more than the block's words
        index = spark.sparkContext.broadcast(Index(own, score, of_all))
        found.append(in_batches(text, _scan(index, score, question, answer), kind))
    return reduce(DataFrame.union, found)


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text holds a test item.

    A row is judged by its text alone: equal texts stay or go together, whatever their ids. Null and empty texts stay; an empty benchmark removes
    nothing; columns and their order stay.
    """
    same = F.xxhash64(F.col(text_col).cast("string"))
    held = contaminated(docs.select(same.alias("same"), F.col(text_col).alias("text")), benchmark, "same", "text").select("doc_id")
    return without(docs, same, stash(held, "held"))
