"""Conflict-constrained best-fit packing of documents into bins of a fixed number of tokens.

Pieces of documents are dealt over shards by a hash of id and piece, as many shards as keep each
within a fixed number of pieces; each shard packs its own bins, and its least filled ones are all
that this costs. Within a shard, open bins are ordered by what is
left in them and carry two bitmaps: sources and duplicate clusters already inside. A piece goes to
the tightest bin that it fits and that has neither its source nor its cluster; the search moves on
to the next larger residual until such a bin is found, else a bin is opened.

Only ids, lengths and two hashes are shuffled, never texts. A hot source spreads over all shards.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.scratch import in_batches, stash
from attesta.llm.textkit import Words, set_digest, slices

CAPACITY = 2048
#: Pieces of documents that one shard packs, about.
SHARD_PIECES = 20_000


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            w = Words(part.column(1))
            place = np.arange(len(w.hash), dtype=np.uint64) - np.repeat(w.first[:-1], w.count()).astype(np.uint64)
            yield pa.record_batch({"doc_id": part.column(0), "source": part.column(2), "n_tokens": w.count().astype(np.int64), "cluster": set_digest(w.hash + place * np.uint64(0x9E3779B97F4A7C15), w.first)})


class _Bits:
    """Bitmaps of the bins of a shard, grown by rows."""

    def __init__(self, codes: np.ndarray):
        self.words = max(1, (int(codes.max(initial=0)) >> 6) + 1)
        self.rows = np.zeros((256, self.words), np.uint64)

    def room(self, n: int) -> None:
        if n >= len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])


def pack(sizes: np.ndarray, sources: np.ndarray, clusters: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each piece; pieces come largest first. Codes are dense and 0 means: no conflict with anything."""
    bins = np.zeros(len(sizes), np.int64)
    by_source, by_cluster = _Bits(sources), _Bits(clusters)
    left, at = np.zeros(0, np.int64), np.zeros(0, np.int64)  # open bins by residual, then age
    opened = 0
    smallest = int(sizes.min(initial=capacity))
    for i, (size, s, c) in enumerate(zip(sizes.tolist(), sources.tolist(), clusters.tolist(), strict=True)):
        sw, sb, cw, cb = s >> 6, np.uint64(1 << (s & 63)), c >> 6, np.uint64(1 << (c & 63))
        spot, found = int(np.searchsorted(left, size)), -1
        while spot < len(left):
            near = at[spot : spot + 512]
            clash = np.zeros(len(near), bool)
            if s:
                clash |= (by_source.rows[near, sw] & sb) != 0
            if c:
                clash |= (by_cluster.rows[near, cw] & cb) != 0
            free = np.flatnonzero(~clash)
            if len(free):
                found = spot + int(free[0])
                break
            spot += 512
        if found < 0:
            b, rest = opened, capacity - size
            opened += 1
            by_source.room(b)
            by_cluster.room(b)
        else:
            b, rest = int(at[found]), int(left[found]) - size
            left, at = np.delete(left, found), np.delete(at, found)
        by_source.rows[b, sw] |= sb
        by_cluster.rows[b, cw] |= cb
        bins[i] = b
        if rest >= smallest:
            to = int(np.searchsorted(left, rest, side="right"))
            left, at = np.insert(left, to, rest), np.insert(at, to, b)
    return bins


def _codes(values: pd.Series, only_repeated: bool) -> np.ndarray:
    code = pd.factorize(values)[0] + 1  # null is -1, hence 0
    if only_repeated and len(code):
        many = np.bincount(code) > 1
        code = np.where(many[code], np.cumsum(many)[code], 0)
    return code.astype(np.int64)


def _pack_shard(capacity: int):
    def run(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(["n_tokens", "doc_id", "piece", "cluster"], ascending=[False, True, True, True], ignore_index=True)
        size = pieces.n_tokens.to_numpy()
        full = int(np.count_nonzero(size == capacity))  # they come first, and nothing else fits beside them
        rest = pieces.iloc[full:]
        bins = np.concatenate([np.arange(full), full + pack(size[full:], _codes(rest.source, False), _codes(rest.cluster, True), capacity)])
        out = pieces[["doc_id", "piece", "n_tokens"]].copy()
        out["bin_id"] = pieces["shard"].astype(np.int64) * (1 << 32) + bins
        out["bin_offset"] = out.groupby("bin_id").n_tokens.cumsum() - out.n_tokens
        return out

    return run


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", clusters: DataFrame | None = None) -> DataFrame:
    """One row per piece of a document: ``doc_id, piece, n_tokens, bin_id, bin_offset``.

    Tokens are words. A text of more than ``capacity`` words is cut into full pieces and a rest; a
    full piece is a bin of its own, since nothing else fits. No bin holds two pieces of one source
    or of one duplicate cluster. ``clusters(doc_id, component_id)`` names the clusters of near
    duplicates, one row an id (as ``jaccard_components`` gives them); documents that it doesn't
    name, and all without it, are in one cluster if their word sequences are equal. A null source
    conflicts with nothing. Null or empty texts take no room and are in one row each with null bin;
    rows that repeat a doc_id are packed each. Pieces of equal size go by id, bins of equal room by
    age. Extra columns are not read; an empty table gives no rows.
    """
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(source_col).cast("string").alias("source"))
    rows = stash(in_batches(text, _sizes, "doc_id long, source string, n_tokens long, cluster long"), "sizes")
    n = rows.agg(F.sum(F.ceil(F.col("n_tokens") / capacity))).first()[0] or 0
    if clusters is not None:
        named = clusters.filter("component_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("component_id").alias("named")).dropDuplicates(["doc_id"])
        rows = rows.join(named, "doc_id", "left").select("doc_id", "source", "n_tokens", F.coalesce("named", "cluster").alias("cluster"))
    shards = max(1, -(-int(n) // SHARD_PIECES))
    cut = rows.filter("n_tokens > 0").withColumn("piece", F.explode(F.expr(f"sequence(0L, (n_tokens - 1) div {capacity})")))
    cut = cut.withColumns({"n_tokens": F.expr(f"least({capacity}, n_tokens - piece * {capacity})"), "shard": F.pmod(F.xxhash64("doc_id", "cluster", "piece"), F.lit(shards)).cast("long")})
    packed = cut.groupBy("shard").applyInPandas(_pack_shard(capacity), "doc_id long, piece long, n_tokens long, bin_id long, bin_offset long")
    none = rows.filter("n_tokens = 0").select("doc_id", F.lit(0).cast("long"), "n_tokens", F.lit(None).cast("long"), F.lit(None).cast("long"))
    return packed.union(none)
