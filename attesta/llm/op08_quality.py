"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text.

The model is over bytes (of UTF-8), order four. Counting is spread over hash shards of the
n-grams: grouped counts of four-grams, continuation counts of each shorter order from the next
longer one's distinct n-grams, and joins of the counts with their contexts' totals give each
n-gram its discounted share and each context's weight for the shorter order. Those two numbers of
every n-gram stay rows. Documents are scored in blocks of some megabytes: the distinct four-grams of
each block are joined with the model order by order, and what comes of it goes to the block's documents,
so that neither the driver nor a task holds the model. All probabilities are exact. The documents
themselves are written once, compressed and bucketed by block, and are not shuffled.

A document's perplexity is held against a fence from the quantiles of the trusted documents of its
own language and length class, drawn towards its language's the fewer documents the class has.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.prefilter import split_by, without
from attesta.llm.scratch import discard, in_batches, stash, stash_bucketed
from attesta.llm.textkit import flat, slices

ORDER = 4
#: Text of a block, whose distinct four-grams are looked up together; it lies in compressed pages that are read one by one.
BLOCK_BYTES = 32 << 20
PAGE_BYTES = 1 << 20
#: A document is rejected if its log-perplexity lies this many quartile ranges above its class's third quartile.
FENCE = 4.0
#: A class's fence counts as much as its language's when it has this many trusted documents; a language's against all, the same.
DRAWN = 50


def _codes(b: np.ndarray, order: int) -> np.ndarray:
    """Codes of the windows of ``order`` bytes that end at each byte, the last byte lowest."""
    code = np.zeros(len(b), np.int64)
    for j in range(order):
        code[j:] |= b[: len(b) - j].astype(np.int64) << (8 * j)
    return code


def _laid_out(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with ``ORDER - 1`` zero bytes before each text (the start symbol), where each text's own bytes are, and each text's first one among them."""
    raw, at = flat(col)
    n = len(at) - 1
    own = np.arange(len(raw)) + np.repeat(np.arange(1, n + 1) * (ORDER - 1), np.diff(at))
    b = np.zeros(len(raw) + n * (ORDER - 1), np.uint8)
    b[own] = raw
    return b, own, at


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        for part in slices(batch, "text"):
            b, own, _ = _laid_out(part.column(0))
            k, c = np.unique(_codes(b, ORDER)[own].astype(np.uint32), return_counts=True)
            both, spot = np.unique(np.concatenate([keys, k.astype(np.int64)]), return_inverse=True)
            counts = np.bincount(spot, np.concatenate([counts, c]), len(both)).astype(np.int64)
            keys = both
            if len(keys) > 1 << 20:  # a task holds no more than this
                yield pa.record_batch({"gram": keys, "c": counts})
                keys, counts = keys[:0], counts[:0]
    if len(keys):
        yield pa.record_batch({"gram": keys, "c": counts})


def _discounts(grams: DataFrame) -> list[float]:
    """D1, D2 and D3+ from the counts of counts."""
    n = grams.agg(*[F.count_if(F.col("c") == i).alias(f"n{i}") for i in range(1, 5)]).first()
    n1, n2, n3, n4 = (float(x or 0) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else y, 2 - 3 * y * n3 / n2 if n2 else 2 * y, 3 - 4 * y * n4 / n3 if n3 else 3 * y]
    return [min(max(d, 0.05), i + 0.95) for i, d in enumerate(raw)]


class Model(NamedTuple):
    """Rows ``t, code, v``: of each order, shortest first, n-grams with their discounted shares, then contexts with what they leave to the shorter order."""

    rows: DataFrame

    def looked_up(self, grams: DataFrame) -> DataFrame:
        """``gram, p``: interpolated probability of the last byte of each of the distinct four-grams after the other three."""
        out = grams.withColumn("p", F.lit(1 / 256))
        for order in range(ORDER):
            share = self.rows.filter(F.col("t") == order).select(F.col("code").alias("own"), F.col("v").alias("share"))
            weight = self.rows.filter(F.col("t") == ORDER + order).select(F.col("code").alias("context"), F.col("v").alias("weight"))
            # N-grams of two bytes are 65,536 at most.
            share, weight = F.broadcast(share) if order < 2 else share, F.broadcast(weight) if order < 3 else weight
            out = out.withColumn("own", F.col("gram") % (1 << (8 * (order + 1)))).withColumn("context", F.expr("own div 256"))
            out = out.join(share, "own", "left").join(weight, "context", "left")
            out = out.select("gram", (F.coalesce("share", F.lit(0.0)) + F.coalesce("weight", F.lit(1.0)) * F.col("p")).alias("p"))
        return out

    def probability(self, code: np.ndarray) -> np.ndarray:
        """The same of a few four-grams, in their order."""
        grams = self.rows.sparkSession.createDataFrame([(int(c),) for c in np.unique(code)], "gram long")
        found = {r.gram: r.p for r in self.looked_up(grams).collect()}
        return np.array([found[int(c)] for c in code])


def fit(trusted: DataFrame) -> Model:
    """The model of ``trusted(text)``; of nothing, all bytes are equally likely."""
    grams = stash(in_batches(trusted.filter("text is not null").select("text"), _counted, "gram long, c long").groupBy("gram").agg(F.sum("c").alias("c")), "grams")
    tables, made = [], [grams]
    for order in range(ORDER, 0, -1):
        d = _discounts(grams)
        off = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        own = grams.withColumns({"context": F.expr("gram div 256"), "off": off})
        total = own.groupBy("context").agg(F.sum("c").alias("all"), F.sum("off").alias("left"))
        shares = own.join(total, "context").select(F.lit(order - 1).alias("t"), F.col("gram").alias("code"), ((F.col("c") - F.col("off")) / F.col("all")).cast("float").alias("v"))
        weights = total.select(F.lit(ORDER + order - 1).alias("t"), F.col("context").alias("code"), (F.col("left") / F.col("all")).cast("float").alias("v"))
        tables.append(shares.union(weights))
        if order > 1:
            # Continuation counts: in how many different contexts one byte longer the shorter n-gram occurs.
            grams = stash(grams.groupBy((F.col("gram") % (1 << (8 * (order - 1)))).alias("gram")).agg(F.count("*").alias("c")), "grams")
            made.append(grams)
    rows = stash(reduce(DataFrame.union, tables), "model")
    discard(*made)
    return Model(rows)


def _page(rows: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def _in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages of rows, each with the number of its block (about ``BLOCK_BYTES`` of text that lies together), and the distinct four-grams of each block."""
    context = TaskContext.get()
    block, held, grams = (context.partitionId() if context else 0) << 32, 0, np.zeros(0, np.uint32)

    def row(page: bytes | None, grams: np.ndarray | None) -> pa.RecordBatch:
        return pa.record_batch([pa.array([block], pa.int64()), pa.array([page], pa.binary()), pa.array([grams], pa.list_(pa.int64()))], names=["block", "page", "grams"])

    for batch in batches:
        for part in slices(batch, "text", PAGE_BYTES):
            b, own, _ = _laid_out(part.column(2))
            grams = np.union1d(grams, _codes(b, ORDER)[own].astype(np.uint32))
            yield row(_page(part), None)
            held += len(own)
            if held >= BLOCK_BYTES:
                yield row(None, grams.astype(np.int64))
                block, held, grams = block + 1, 0, grams[:0]
    if len(grams):
        yield row(None, grams.astype(np.int64))


def _scored(key, pages: pa.Table, known: pa.Table) -> pa.Table:
    order = np.argsort(np.asarray(known["gram"]))
    grams, p = np.asarray(known["gram"])[order], np.asarray(known["p"])[order]
    lost = -np.log(np.maximum(p, 1e-9))
    out = []
    for page in pages["page"]:
        for part in pa.ipc.open_stream(page.as_buffer()):
            b, own, at = _laid_out(part.column(2))
            each = lost[np.searchsorted(grams, _codes(b, ORDER)[own].astype(np.uint32).astype(np.int64))] if len(own) else np.zeros(0)
            size = np.diff(at)
            mean = np.full(len(size), np.nan)
            full = np.flatnonzero(size)
            if len(full):
                mean[full] = np.add.reduceat(each, at[:-1][full]) / size[full]
            out.append(pa.record_batch({"doc_id": part.column(0), "same": part.column(1), "lang": part.column(3), "n_bytes": pa.array(size, pa.int64()), "log_ppl": pa.array(mean, mask=np.isnan(mean))}))
    kinds = [("doc_id", pa.int64()), ("same", pa.int64()), ("lang", pa.string()), ("n_bytes", pa.int64()), ("log_ppl", pa.float64())]
    return pa.Table.from_batches(out).cast(pa.schema(kinds)) if out else pa.schema(kinds).empty_table()


def _perplexities(text: DataFrame, model: Model) -> DataFrame:
    """``doc_id, same, lang, n_bytes, log_ppl`` of each row of ``text(doc_id, same, text, lang)``."""
    blocks = stash_bucketed(in_batches(text, _in_blocks, "block long, page binary, grams array<long>"), "blocks", "block")
    asked = blocks.select(F.col("block").alias("of"), F.explode("grams").alias("gram"))
    known = asked.join(model.looked_up(asked.select("gram").distinct()), "gram")
    pages = blocks.filter("page is not null").select("block", "page")
    scored = pages.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(_scored, "doc_id long, same long, lang string, n_bytes long, log_ppl double")
    scored = stash(scored, "scored")
    discard(blocks, model.rows)
    return scored


def _judged(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str, fence: float) -> DataFrame:
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("same"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    good = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min((F.coalesce("quality", F.lit(0)) == 1) & (F.coalesce("toxic", F.lit(1)) == 0)).alias("trusted")).filter("trusted and doc_id is not null")
    # Of texts only those are shuffled that the bitmap of trusted ids lets through wrongly, or may have: ids decide.
    maybe = split_by(text.filter("doc_id is not null and text is not null").select("doc_id", "text"), F.col("doc_id"), good.select("doc_id"))[0]
    wrong = stash(maybe.select("doc_id").distinct().join(good.select("doc_id").hint("merge"), "doc_id", "left_anti"), "untrusted")
    scored = _perplexities(text, fit(without(maybe, F.col("doc_id"), wrong)))
    discard(wrong)
    scored = scored.join(good, "doc_id", "left").withColumn("trusted", F.col("trusted").isNotNull())
    scored = scored.withColumn("length_class", F.floor(F.log2(F.greatest("n_bytes", F.lit(1))) / 2))
    known = scored.filter("trusted and log_ppl is not null")
    quartiles = [F.percentile_approx("log_ppl", q, 10000).alias(n) for q, n in ((0.25, "q1"), (0.75, "q3"))]
    level = known.rollup("lang", "length_class").agg(F.grouping_id().alias("g"), F.count("*").alias("n"), *quartiles)
    level = level.withColumn("top", F.col("q3") + fence * F.greatest(F.col("q3") - F.col("q1"), F.lit(0.01)))
    by_class = level.filter("g = 0").select(F.col("lang").alias("l2"), F.col("length_class").alias("c2"), F.col("n").alias("n2"), F.col("top").alias("t2"))
    by_lang = level.filter("g = 1").select(F.col("lang").alias("l1"), F.col("n").alias("n1"), F.col("top").alias("t1"))
    whole = level.filter("g = 3 and n > 0").select("top").first()  # one row
    out = scored.join(by_class, F.expr("lang <=> l2 and length_class = c2"), "left").join(by_lang, F.expr("lang <=> l1"), "left")
    drawn = lambda n, top, to: (F.coalesce(n, F.lit(0)) * F.coalesce(top, F.lit(0.0)) + DRAWN * to) / (F.coalesce(n, F.lit(0)) + DRAWN)
    ceiling = F.exp(drawn(F.col("n2"), F.col("t2"), drawn(F.col("n1"), F.col("t1"), F.lit(whole.top if whole else math.inf))))
    ppl = F.exp("log_ppl")
    return out.select("doc_id", "same", "lang", "n_bytes", ppl.alias("perplexity"), ceiling.alias("ceiling"), F.coalesce(ppl <= ceiling, F.lit(False)).alias("keep"))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fence: float = FENCE) -> DataFrame:
    """Per row ``doc_id, lang, n_bytes, perplexity, ceiling, keep``.

    Trusted are the documents that a row of ``labels`` gives quality 1 and toxic 0 and no row
    contradicts. ``ceiling`` comes from the trusted documents' quantiles in the row's language and
    length class (powers of four bytes), drawn towards those of its language, and these towards
    those of all, the fewer there are; a row above it goes, one on it stays. Null or empty text has
    no perplexity and goes; with nothing trusted all other rows stay. Repeated rows get the same
    verdict each; a null language is a language of its own. Extra columns are not read; an empty
    table gives no rows.
    """
    return _judged(docs, labels, id_col, text_col, lang_col, fence).drop("same")


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the rows that the classifier rejects, null and empty texts among them.

    A row is judged by its text, language and id's label, so rows that repeat an id with another
    text stay or go on their own, and null ids are judged too. Columns and their order stay; an
    empty table gives no rows.
    """
    at = lambda i, s, n: F.struct(F.coalesce(i, F.lit(2**63 - 1)).alias("doc_id"), s.alias("same"), F.coalesce(n, F.lit("")).alias("lang"))
    gone = _judged(docs, labels, id_col, text_col, lang_col, FENCE).filter("not keep").select(at(F.col("doc_id"), F.col("same"), F.col("lang")).alias("at"))
    return without(docs, at(F.col(id_col).cast("long"), F.xxhash64(F.col(text_col).cast("string")), F.col(lang_col).cast("string")), stash(gone, "rejected"))
