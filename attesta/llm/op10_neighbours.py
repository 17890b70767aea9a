"""Approximate nearest neighbours by inner product over balanced posting lists.

Vectors are brought to one length by an extra component, so that the largest inner product is the
smallest distance; queries are scaled to that length, which changes no order, only to find their lists. Balanced k-means on a bounded sample gives the centroids; every vector then
goes to its nearest centroid's list, and to further ones that are nearly as near (boundary
vectors). A query finds its centroids in a neighbour graph in memory and reads the lists whose
distance is within a ratio of the nearest one's. Lists are cut into chunks of bounded size and
queries into blocks, each pair of which is one task's matrix product; exact scores on the original
vectors decide.

Of equal vectors only the ``k + 1`` smallest ids are kept in the lists: no others can be among a
query's ``k`` nearest, so a vector that a third of the rows share makes no long list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm.scratch import discard, stash

#: Vectors that the centroids are fitted on, at most.
SAMPLE = 20_000
#: Vectors that a centroid is fitted on, at least: so there are SAMPLE / LIST_SAMPLE lists at most, which then grow and are cut into chunks.
LIST_SAMPLE = 8
#: A vector goes to further lists whose centroid is at most this much farther than its nearest one's.
BOUNDARY, REPLICAS = 1.05, 4
#: A query reads lists whose centroid is at most this much farther than its nearest one's.
REACH, MOST_READ = 1.25, 64
CHUNK, BLOCK = 8192, 4096


def _longer(x: np.ndarray, longest: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(longest**2 - (x * x).sum(1, keepdims=True), 0))], 1)


def _far(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None], 0)


def balanced_centroids(x: np.ndarray, lists: int, rounds: int = 10) -> np.ndarray:
    """k-means in which a full list looks farther away."""
    rng = np.random.default_rng(7)
    c = x[rng.choice(len(x), lists, replace=False)].copy()
    size = np.full(lists, len(x) / lists)
    for _ in range(rounds):
        d = _far(x, c)
        near = (d + 0.1 * d.min(1).mean() * (size * lists / len(x))[None]).argmin(1)
        size = np.bincount(near, minlength=lists).astype(float)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        full = size > 0
        c[full] = total[full] / size[full, None]
        if (~full).any():
            c[~full] = x[rng.choice(len(x), int((~full).sum()))]
    return c


class Graph:
    """Nearest-neighbour graph of the centroids, searched greedily with a beam."""

    def __init__(self, c: np.ndarray, degree: int = 24):
        self.c = c
        d = _far(c, c)
        self.near = np.argsort(d, 1, kind="stable")[:, : degree + 1]
        back: list[list[int]] = [[] for _ in range(len(c))]
        for i, row in enumerate(self.near.tolist()):
            for j in row:
                back[j].append(i)
        self.links = [np.unique(np.concatenate([row, b[:degree]])).astype(int) for row, b in zip(self.near, back, strict=True)]
        self.entry = np.unique(np.linspace(0, len(c) - 1, min(len(c), 16)).astype(int))

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """About the ``beam`` nearest centroids, nearest first, and their squared distances."""
        dist: dict[int, float] = {}
        new, done = self.entry, set()
        while True:
            for i, v in zip(new.tolist(), ((self.c[new] - q) ** 2).sum(1).tolist(), strict=True):
                dist[i] = v
            best = sorted(dist, key=dist.__getitem__)[:beam]
            todo = [i for i in best if i not in done]
            if not todo:
                return np.array(best), np.array([dist[i] for i in best])
            done.update(todo)
            new = np.unique(np.concatenate([self.links[i] for i in todo]))
            new = new[[i not in dist for i in new.tolist()]]


def _matrix(col: pa.Array) -> np.ndarray:
    return np.array(col.flatten(), dtype=np.float64).reshape(len(col), -1)


def _assign(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, longest = model.value
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                d = _far(_longer(_matrix(part.column(1)), longest), c)
                few = min(REPLICAS, len(c))
                near = np.argpartition(d, few - 1, 1)[:, :few]
                own = np.take_along_axis(d, near, 1)
                row, spot = np.nonzero(own <= BOUNDARY**2 * own.min(1, keepdims=True) + 1e-12)
                out = part.take(pa.array(row))
                yield pa.record_batch([pa.array(near[row, spot], pa.int32()), out.column(0), out.column(1)], names=["list", "vec_id", "v"])

    return run


def _route(model, k: int, reach: float, most_read: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph, sizes, longest = model.value
        for batch in batches:
            if not batch.num_rows:
                continue
            q = _matrix(batch.column(1))
            q *= longest / np.sqrt((q * q).sum(1, keepdims=True))  # its order of vectors is the same at any length, that of the lists is not
            q = np.concatenate([q, np.zeros((len(q), 1))], 1)
            rows, lists = [], []
            for i in range(len(q)):
                near, d = graph.search(q[i], min(most_read, len(sizes)))
                enough = int(np.searchsorted(np.cumsum(sizes[near]), 10 * k)) + 1  # and lists that hold enough to choose from
                n = max(enough, int(np.count_nonzero(d <= reach**2 * d[0] + 1e-12)))
                lists.append(near[:n])
                rows.append(np.full(len(lists[-1]), i))
            out = batch.take(pa.array(np.concatenate(rows)))
            yield pa.record_batch([pa.array(np.concatenate(lists), pa.int32()), out.column(0), out.column(1)], names=["list", "query_id", "q"])

    return run


def _best(k: int):
    def run(key, queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(vectors):
            v, ids = np.array(vectors.v.to_list(), np.float64), vectors.vec_id.to_numpy()
            q, qids = np.array(queries.q.to_list(), np.float64), queries.query_id.to_numpy()
            for at in range(0, len(q), 256):
                s = q[at : at + 256] @ v.T
                s[qids[at : at + 256, None] == ids[None]] = -np.inf
                few = min(k, len(v))
                floor = -np.partition(-s, few - 1, 1)[:, few - 1 : few]
                floor = np.where(np.isfinite(floor), floor - 1e-9 * np.maximum(1, np.abs(floor)), np.finfo(float).min)
                row, spot = np.nonzero(s >= floor)
                exact = (q[at + row] * v[spot]).sum(1)  # the same sum for equal vectors wherever they stand
                got = pd.DataFrame({"query_id": qids[at + row], "vec_id": ids[spot], "score": exact}).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True])
                out.append(got.groupby("query_id").head(k))
        return pd.concat(out) if out else pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    return run


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", reach: float = REACH, most_read: int = MOST_READ) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` rows of ``vectors`` nearest to each row of ``queries`` by inner product, never its own id.

    ``reach`` and ``most_read`` bound the lists that a query reads; with both unbounded all are read and
    the answer is exact. Both tables have the same columns. Vectors that are null, zero, hold a null or a non-finite
    component, or have another dimension than most take no part; neither do rows without an id.
    Ties go to the smaller id; fewer candidates give fewer rows; of rows that repeat an id the one
    whose vector sorts first counts. Extra columns are not read; empty tables give no rows.
    """
    spark = vectors.sparkSession
    usable = f"{id_col} is not null and {vec_col} is not null and forall({vec_col}, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists({vec_col}, x -> x <> 0)"
    clean = lambda df: df.filter(usable).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    shape = clean(vectors).groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(F.expr("aggregate(v, 0D, (s, x) -> s + x * x)")).alias("long")).orderBy(F.desc("n"), "dim").first()
    if shape is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    same = F.xxhash64("v")
    of = Window.partitionBy("same", "v").orderBy("vec_id")
    base = clean(vectors).filter(F.size("v") == shape.dim).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("same", same).withColumn("rn", F.row_number().over(of)).filter(F.col("rn") <= k + 1).select("vec_id", "v")
    base = stash(base, "vectors")
    n = base.count()
    longest = float(np.sqrt(shape.long))
    lists = int(max(1, min(SAMPLE // LIST_SAMPLE, np.sqrt(n))))
    if lists > 1:
        part = base.filter(F.pmod(F.xxhash64("vec_id"), F.lit(1_000_000)) < int(min(1.0, 1.2 * SAMPLE / n) * 1_000_000)).select("v").limit(SAMPLE).collect()  # bounded: it only places centroids
        c = balanced_centroids(_longer(np.array([r.v for r in part], np.float64), longest), lists)
    else:
        c = np.zeros((1, shape.dim + 1))
    placed = stash(base.mapInArrow(_assign(spark.sparkContext.broadcast((c, longest))), "list int, vec_id long, v array<double>"), "lists")
    sizes = np.zeros(lists, np.int64)
    for r in placed.groupBy("list").count().collect():  # a row a list
        sizes[r["list"]] = r["count"]
    asked = clean(queries).filter(F.size("v") == shape.dim).groupBy("vec_id").agg(F.min("v").alias("v"))
    routed = stash(asked.mapInArrow(_route(spark.sparkContext.broadcast((Graph(c), sizes, longest)), k, reach, most_read), "list int, query_id long, q array<double>"), "routed")
    blocks = {r["list"]: -(-r["count"] // BLOCK) for r in routed.groupBy("list").count().collect()}
    counts = spark.createDataFrame([(i, int(max(1, -(-int(sizes[i]) // CHUNK))), int(blocks.get(i, 0))) for i in range(lists)], "list int, chunks int, blocks int")
    counts = F.broadcast(counts)  # a row a list
    left = routed.join(counts, "list").select("list", F.explode(F.expr("sequence(0, chunks - 1)")).alias("chunk"), F.expr("int(pmod(xxhash64(query_id), blocks))").alias("block"), "query_id", "q")
    right = placed.join(counts, "list").filter("blocks > 0").select("list", F.expr("int(pmod(xxhash64(vec_id), chunks))").alias("chunk"), F.explode(F.expr("sequence(0, blocks - 1)")).alias("block"), "vec_id", "v")
    keys = ["list", "chunk", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_best(k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # A vector in several lists has the same score in each, so its copies are neighbours in this order.
    once = found.withColumn("before", F.lag("vec_id").over(order)).filter("before is null or before <> vec_id")
    ranked = once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    out = stash(ranked, "nearest")
    discard(base, placed, routed)
    return out
