"""Language identification by multilingual mixture inference.

Training counts byte n-grams of every labelled training text per language (a fixed number of
counters a language, summed by Spark). A document is a mixture: each of its words comes from one
language, and expectation-maximisation estimates the proportions from the words' n-gram
likelihoods, from even ones until no proportion moves by ``SETTLED`` in a round. Languages then
leave the mixture one by one, the smallest first, as long as the likelihood penalised for each
language kept (BIC) does not fall; what is left settles again after each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.scratch import in_batches
from attesta.llm.textkit import flat, slices

#: Counters a language; the model's size is this times the number of languages, whatever the corpus.
BUCKETS = 1 << 16
SETTLED = 1e-3

_ASCII_LETTER = re.compile(r"[A-Za-z]")


def has_letter(text: str | None) -> bool:
    """Whether some character is a letter (not a number such as ½ or Ⅷ)."""
    return text is not None and (_ASCII_LETTER.search(text) is not None or not text.isascii() and any(map(str.isalpha, text)))


class _Grams:
    """Four-byte windows, one at each letter byte, that don't look past the end of a word."""

    def __init__(self, col: pa.Array):
        raw, at = flat(col)
        b = np.full(len(raw) + 4, 32, np.uint8)
        b[1 : len(raw) + 1] = raw
        up = (b >= 65) & (b <= 90)
        b[up] += 32
        letter = ((b >= 97) & (b <= 122)) | (b >= 128)
        b[~letter] = 32
        spot = np.flatnonzero(letter)
        edge = np.zeros(len(b), bool)
        edge[at[:-1] + 1] = True
        left = np.where(edge[spot], 32, b[spot - 1]).astype(np.uint32)
        one = b[spot].astype(np.uint32)
        two = np.where(edge[spot + 1], 32, b[spot + 1]).astype(np.uint32)
        three = np.where((two == 32) | edge[spot + 2], 32, b[spot + 2]).astype(np.uint32)
        code = left | one << np.uint32(8) | two << np.uint32(16) | three << np.uint32(24)
        code = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        self.bucket = ((code ^ (code >> np.uint32(13))) * np.uint32(0x297A2D39)) >> np.uint32(16)
        self.first = np.searchsorted(spot, at + 1)  # of each document
        self.word = np.flatnonzero(left == 32)  # each word's first window
        self.words = np.searchsorted(self.word, self.first)  # of each document


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for part in slices(batch, "text"):
            g = _Grams(part.column(0))
            langs = part.column(1).dictionary_encode()
            names = langs.dictionary.to_pylist()
            per = np.repeat(langs.indices.to_numpy(zero_copy_only=False), np.diff(g.first))
            for i, name in enumerate(names):
                own = np.bincount(g.bucket[per == i], minlength=BUCKETS)
                total[name] = total[name] + own if name in total else own
    if total:
        yield pa.record_batch({"lang": pa.array(list(total)), "counts": pa.array([v.astype(np.int64).tobytes() for v in total.values()], pa.binary())})


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        for name, c in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            x = np.frombuffer(c.as_buffer(), np.int64)
            total[name] = total[name] + x if name in total else x
    if total:
        yield pa.record_batch({"lang": pa.array(list(total)), "counts": pa.array([v.tobytes() for v in total.values()], pa.binary())})


def fit(train: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and log-probabilities ``[BUCKETS, languages]``, of ``train(text, lang)``."""
    kind = "lang string, counts binary"
    rows = in_batches(train.filter("lang is not null and text is not null").select("text", "lang"), _count, kind).repartition("lang").mapInArrow(_add, kind).collect()  # half a MB a language
    rows = sorted(rows, key=lambda r: r.lang)
    langs = [r.lang for r in rows]
    if not langs:
        return [], np.zeros((BUCKETS, 0), np.float32)
    c = np.stack([np.frombuffer(r.counts, np.int64) for r in rows], 1).astype(np.float64) + 0.25
    return langs, np.log(c / c.sum(0)).astype(np.float32)


def _likelihood(like: np.ndarray, doc: np.ndarray, first: np.ndarray, pi: np.ndarray) -> np.ndarray:
    full = np.flatnonzero(np.diff(first))
    ll = np.zeros(len(pi))
    ll[full] = np.add.reduceat(np.log(np.maximum((like * pi[doc]).sum(1), 1e-30)), first[:-1][full])
    return ll


def mixture(like: np.ndarray, first: np.ndarray, pi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of each document, from the proportions given (zero stays zero).

    ``like``: likelihoods of words under each language, scaled by the word's largest; ``first``:
    each document's first word. A document whose proportions have settled takes no further part.
    """
    pi, n = pi / pi.sum(1, keepdims=True), np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    open_ = np.flatnonzero((n > 0) & ((pi > 0).sum(1) > 1))
    own, at = like, first[:-1]
    if len(open_) < len(n):
        keep = np.isin(doc, open_)
        own = like[keep]
        at = np.cumsum(n[open_]) - n[open_]
    while len(open_):
        w = own * np.repeat(pi[open_], n[open_], axis=0)
        w /= np.maximum(w.sum(1, keepdims=True), 1e-30)
        new = np.add.reduceat(w, at, axis=0) / n[open_][:, None]
        moves = np.abs(new - pi[open_]).max(1) >= SETTLED
        pi[open_] = new
        if not moves.all():
            own = own[np.repeat(moves, n[open_])]
            open_ = open_[moves]
            at = np.cumsum(n[open_]) - n[open_]
    return pi, _likelihood(like, doc, first, pi)


def languages(like: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Proportions of each document's languages; those left out by the penalised likelihood have none."""
    count, n = like.shape[1], np.maximum(np.diff(first), 1)
    pi, ll = mixture(like, first, np.ones((len(n), count)))
    open_ = np.arange(len(n))
    while len(open_ := open_[(pi[open_] > 0).sum(1) > 1]):
        less = pi[open_].copy()
        less[np.arange(len(open_)), np.where(less > 0, less, 2).argmin(1)] = 0
        words = np.repeat(np.isin(np.arange(len(first) - 1), open_), np.diff(first))
        pi2, ll2 = mixture(like[words], np.append(0, np.cumsum(np.diff(first)[open_])), less)
        good = ll2 + 0.5 * np.log(n[open_]) >= ll[open_]
        open_ = open_[good]
        pi[open_], ll[open_] = pi2[good], ll2[good]
    return pi


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, logp = model.value
        count = len(langs)
        limit = max(1 << 16, (4 << 20) // max(4, count))
        for batch in batches:
            for part in slices(batch, "text", limit):
                texts = part.column(1).to_pylist()
                known = np.array([has_letter(t) for t in texts])
                best, score, several = np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts), int)
                if count and known.any():
                    g = _Grams(part.column(1))
                    if len(g.word):
                        words = np.add.reduceat(logp[g.bucket], g.word, axis=0)
                        like = np.exp(np.maximum(words - words.max(1, keepdims=True), -30)).astype(np.float64)
                        pi = languages(like, g.words)
                        best, several, score = pi.argmax(1), (pi > 0).sum(1), pi.max(1)
                names = [langs[i] if k and count else "und" for i, k in zip(best, known, strict=True)]
                yield pa.record_batch({"doc_id": part.column(0), "lang_pred": pa.array(names), "score": pa.array(np.where(known, np.clip(score, 0, 1), 0.0)), "n_langs": pa.array(np.where(known, several, 0), pa.int32()), "held_out": part.column(2)})

    return run


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per row ``doc_id, held_out, lang_pred, score, n_langs``.

    Learns from rows whose crc32(id as text) mod 4 is not 2 and whose language is known; neither
    language, source nor id is an input of a prediction. Null text or text without a letter is
    ``und`` with score 0, as is every text if nothing could be learned. ``score`` is the predicted
    language's share of the mixture, ``n_langs`` the size of the chosen set; ties go to the
    language that sorts first. Rows that repeat are each answered; a null id counts as held in.
    """
    held = F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), held.alias("held_out"))
    model = docs.sparkSession.sparkContext.broadcast(fit(rows.filter("not held_out")))
    out = in_batches(rows.select("doc_id", "text", "held_out"), _predict(model), "doc_id long, lang_pred string, score double, n_langs int, held_out boolean")
    return out.select("doc_id", "held_out", "lang_pred", "score", "n_langs")
