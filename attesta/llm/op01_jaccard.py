"""N-gram Jaccard join by T-occurrence search (DivideSkip).

Every distinct shingle set is a query against the inverted lists of all others. A partner must
share ``T`` shingles with it. In an order of shingles that all documents share, a query keeps its
first ``n - T + c`` lists; any partner is in ``c`` of these at least. Spark merges them (a shuffle
sorted by shingle is the heap merge, spilled to disk where it must). Of the merged lists, whose
lengths are now exact, a query sets its ``c - 1`` longest aside and finds candidates in the
others alone; candidates must then be in ``c`` lists, and the rest is probed by binary search in
the candidate's sorted set, which gives the exact overlap.

The order comes from a count sketch of fixed size over all documents, rare shingles first. It
affects speed alone: any shared order gives the same links. Groups of equal sets are one class from the start, and large groups of near copies are
first linked as stars (each list's best-placed member against the rest); only pairs of classes
that are still apart are then formed. No group is expanded into all its pairs where its members
are already connected, and none is cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.llm.components import components
from attesta.llm.prefilter import split_by, without
from attesta.llm.scratch import discard, in_batches, stash
from attesta.llm.textkit import Words, set_digest, slices, sorted_sets

#: Lists whose counter says that they may be longer than this, and than four times the mean, are split among tasks.
LONG_LIST = 1 << 16
SPLITS = 64
#: Counters of the sketch that orders shingles: 4 MB whatever the corpus holds.
SKETCH_BITS = 20
CHUNK = 1 << 14

_NUM, _DEN = 3, 4  # 0.75 as a fraction, so that limits are computed in whole numbers


def _ceil(a, b):
    return -((-a) // b)


def probe_length(n, num: int = _NUM, den: int = _DEN):
    """Short lists of a set of ``n`` against partners of any size: n - ceil(t n) + 1."""
    return n - _ceil(num * n, den) + 1


def index_length(n, num: int = _NUM, den: int = _DEN):
    """The same against partners at least as large: n - ceil(2t/(1+t) n) + 1."""
    return n - _ceil(2 * num * n, num + den) + 1


def spare(n):
    """c: lists beyond the first that a partner must be in, so that the longest can be set aside."""
    return 1 + n // 30


def _profile(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.int32)
        shift = np.uint64(64 - SKETCH_BITS)
        seen = False
        for batch in batches:
            for part in slices(batch, "text"):
                h, at = sorted_sets(*Words(part.column(1)).shingles(k))
                if len(h):
                    sketch += np.bincount((h >> shift).astype(np.int64), minlength=len(sketch)).astype(np.int32)
                    seen = True
                n = np.diff(at)
                size = part.num_rows
                yield pa.record_batch({"doc_id": part.column(0), "same": part.column(2), "n": pa.array(n, pa.int64()), "digest": pa.array(set_digest(h, at), pa.int64()), "chunk": pa.nulls(size, pa.int32()), "counts": pa.nulls(size, pa.binary())})
        if seen:
            rows = [(i, sketch[i * CHUNK : (i + 1) * CHUNK]) for i in range(len(sketch) // CHUNK)]
            yield pa.record_batch({"doc_id": pa.nulls(len(rows), pa.int64()), "same": pa.nulls(len(rows), pa.int64()), "n": pa.nulls(len(rows), pa.int64()), "digest": pa.nulls(len(rows), pa.int64()), "chunk": pa.array([i for i, _ in rows], pa.int32()), "counts": pa.array([c.tobytes() for _, c in rows], pa.binary())})

    return run


def _add_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, c in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            x = np.frombuffer(c.as_buffer(), np.int32).astype(np.int64)
            total[i] = total[i] + x if i in total else x
    if total:
        yield pa.record_batch({"chunk": pa.array(list(total), pa.int32()), "counts": pa.array([v.tobytes() for v in total.values()], pa.binary())})


def _weights(profile: DataFrame) -> tuple[np.ndarray, float]:
    """A byte for each counter: how far it stands above the mean, in quarters of a power of two; and the mean."""
    parts = profile.filter("chunk is not null").select("chunk", "counts").repartition((1 << SKETCH_BITS) // CHUNK, "chunk")
    full = np.zeros(1 << SKETCH_BITS, np.int64)
    for r in parts.mapInArrow(_add_chunks, "chunk int, counts binary").collect():  # 8 MB: the sketch's fixed size
        full[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = np.frombuffer(r.counts, np.int64)
    mean = max(1.0, full.mean())
    return np.clip(4 * np.log2(np.maximum(full, 1) / mean), 0, 63).astype(np.uint8), mean


def _postings(k: int, weights, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = weights.value
        shift = np.uint64(64 - SKETCH_BITS)
        done: set[int] = set()
        for batch in batches:
            for part in slices(batch, "text"):
                h, at = sorted_sets(*Words(part.column(0)).shingles(k))
                n = np.diff(at)
                digest = set_digest(h, at)
                key = (order[(h >> shift).astype(np.int64)].astype(np.uint64) << np.uint64(57)) | (h & np.uint64((1 << 57) - 1))
                keys, owners, sizes, places = [], [], [], []
                for i in range(len(n)):
                    if not n[i] or (d := int(digest[i])) in done:
                        continue
                    done.add(d)
                    short = probe_length(int(n[i]), num, den) + spare(int(n[i])) - 1
                    mine = key[at[i] : at[i + 1]]
                    mine = np.sort(np.partition(mine, short - 1)[:short]) if short < len(mine) else np.sort(mine)
                    keys.append(mine)
                    owners.append(np.full(len(mine), d))
                    sizes.append(np.full(len(mine), n[i]))
                    places.append(np.arange(len(mine)))
                if keys:
                    yield pa.record_batch({"key": np.concatenate(keys).view(np.int64), "digest": np.concatenate(owners), "n": np.concatenate(sizes).astype(np.int32), "pos": np.concatenate(places).astype(np.int32)})

    return run


def _verify(k: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "tb"):
                ha, fa = sorted_sets(*Words(part.column(2)).shingles(k))
                hb, fb = sorted_sets(*Words(part.column(3)).shingles(k))
                hit = np.zeros(part.num_rows, bool)
                for i in range(part.num_rows):
                    a, b = ha[fa[i] : fa[i + 1]], hb[fb[i] : fb[i + 1]]
                    if len(a) > len(b):
                        a, b = b, a
                    if not len(a):
                        continue
                    spot = np.searchsorted(b, a)  # binary probes of the lists set aside
                    both = int(np.count_nonzero(b[np.minimum(spot, len(b) - 1)] == a))
                    hit[i] = den * both >= num * (len(a) + len(b) - both)
                yield pa.record_batch({"u": part.column(0), "v": part.column(1), "linked": pa.array(hit)})

    return run


def _verified(pairs: DataFrame, first: DataFrame, read: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """``pairs(a, b)`` as ``(u, v, linked)`` by an exact comparison; ``first(digest, at)`` says where a class's text is."""
    placed = pairs.join(first.select(F.col("digest").alias("a"), F.col("at").alias("at_a")), "a").join(first.select(F.col("digest").alias("b"), F.col("at").alias("at_b")), "b")
    placed = stash(placed, "placed")
    texts = split_by(read, F.col("at"), placed.select(F.col("at_a").alias("at")).union(placed.select("at_b")))[0].groupBy("at").agg(F.first("text").alias("text"))
    one = placed.join(texts.select(F.col("at").alias("at_b"), F.col("text").alias("tb")), "at_b")
    two = one.join(texts.select(F.col("at").alias("at_a"), F.col("text").alias("ta")), "at_a").select("a", "b", "ta", "tb")
    return in_batches(two, _verify(k, num, den), "u long, v long, linked boolean")


def _with_links(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots(node, root)`` after further links: components of the components that they join."""
    if not links.limit(1).count():
        return roots
    of = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
    placed = links.join(of("u"), "u", "left").join(of("v"), "v", "left").select("u", "v", F.coalesce("root_u", "u").alias("root_u"), F.coalesce("root_v", "v").alias("root_v"))
    merged = components(placed.select(F.col("root_u").alias("u"), F.col("root_v").alias("v"))).select(F.col("node").alias("root"), F.col("root").alias("_to"))
    own = placed.select(F.col("root_u").alias("node")).union(placed.select("root_v")).distinct()
    full = roots.union(own.join(roots, "node", "left_anti").select("node", F.col("node").alias("root")))
    return full.join(merged, "root", "left").select("node", F.coalesce("_to", "root").alias("root"))


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: tuple[int, int] = (_NUM, _DEN), long_list: int = LONG_LIST) -> tuple[DataFrame, DataFrame]:
    """Per row ``(doc_id, n, digest)``, and ``(node, root)`` of the classes (digests) that have links."""
    spark = docs.sparkSession
    num, den = threshold
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("same", F.xxhash64("text"))
    profile = stash(in_batches(text, _profile(k), "doc_id long, same long, n long, digest long, chunk int, counts binary"), "profile")
    weights, mean = _weights(profile)
    order = spark.sparkContext.broadcast(weights)
    rows = profile.filter("n is not null").select("doc_id", "same", "n", "digest")

    # A list is one window; those that the counters know to be long are dealt over SPLITS windows, whose ends are then put together.
    weight = int(min(63, max(8, np.ceil(4 * np.log2(max(long_list, 1) / mean)))))
    long_ = f"shiftrightunsigned(key, 57) >= {weight}"
    part = Window.partitionBy("key", F.expr(f"if({long_}, pmod(digest, {SPLITS}L), 0L)"))
    short = in_batches(text.select("text"), _postings(k, order, num, den), "key long, digest long, n int, pos int")
    ends = {"lo": F.min("digest").over(part), "hi": F.max("digest").over(part), "best": F.min(F.struct("pos", "digest", "n")).over(part)}
    ended = stash(short.withColumns(ends).withColumn("long", F.expr(long_)).filter("long or lo <> hi"), "lists")
    order.destroy()
    whole = ended.filter("long").groupBy("key").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("best").alias("best")).filter("lo <> hi")
    shared = ended.filter("not long").select("key", "digest", "n", "pos", "best").union(ended.filter("long").select("key", "digest", "n", "pos").join(whole.select("key", "best"), "key"))
    shared = shared.select("key", "digest", "n", "pos", F.col("best.digest").alias("lead"), F.col("best.n").alias("lead_n"))

    fits = lambda a, b: f"{den} * least({a}, {b}) >= {num} * greatest({a}, {b})"
    star = shared.filter("digest <> lead").filter(fits("n", "lead_n")).groupBy(F.col("lead").alias("a"), F.col("digest").alias("b")).agg(F.count("*").alias("hits")).select("a", "b")
    star = stash(star, "pairs")
    # A class is read from the first of its rows.
    known_id = F.coalesce("doc_id", F.lit(-1)).alias("doc_id")
    first = rows.groupBy("digest").agg(F.min(F.struct(known_id, "same")).alias("at"))
    read = text.select(F.struct(known_id, "same").alias("at"), "text")
    tested = stash(_verified(star, first, read, k, num, den), "tested")
    roots = components(tested.filter("linked"))

    # What is still apart: candidates in different components.
    placed = shared.select("key", "digest", "n", "pos").dropDuplicates(["key", "digest"]).join(roots.withColumnRenamed("node", "digest"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    # ``alone``: lists of one document, up to its last shared list, that no other has among its first. If that
    # list comes no later than the partner's last one, the partner lacks those shingles altogether.
    own = Window.partitionBy("digest")
    # The shared lists themselves are in a signature of 256 bits: a bit that only one of the two has is a list less in common.
    bit = lambda i: F.bit_or(F.expr(f"if((key >> 6) & 3 = {i}, shiftleft(1L, int(key & 63)), 0L)")).over(own)
    placed = placed.withColumns({"last": F.max("key").over(own), "alone": F.max("pos").over(own) + 1 - F.count("*").over(own)} | {f"s{i}": bit(i) for i in range(4)})
    placed = stash(placed, "placed")
    # ``home``: the root of the list's best-placed member. Most of a large group are in it, and they don't meet each other again.
    lists = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("length"), F.min(F.struct("pos", "digest", "root")).alias("lead")).filter("lo <> hi")
    apart = placed.join(lists.select("key", "length", F.col("lead.root").alias("home")), "key").withColumn("away", F.col("root") != F.col("home"))
    apart = stash(apart, "apart")
    discard(placed)
    c = "(1 + n div 30)"
    longest_first = Window.partitionBy("digest").orderBy(F.desc("length"), "key")
    query = apart.filter(f"pos < n - cast(ceil({2 * num} * n / {num + den}.0D) as int) + {c}").withColumn("nth", F.row_number().over(longest_first)).filter(f"nth >= {c}")
    # Those at home meet those away only; those away meet all.
    x, y = query.alias("x"), apart.withColumn("meets", F.explode(F.expr("if(away, array(true, false), array(true))"))).alias("y")
    lost = lambda a, b: f"{a}.alone + " + " + ".join(f"bit_count({a}.s{i} & ~{b}.s{i})" for i in range(4))
    rest = x.join(y, F.expr(f"""x.key = y.key and x.away = y.meets and x.root <> y.root and (x.n < y.n or x.n = y.n and x.digest < y.digest) and {den} * x.n >= {num} * y.n
        and {num + den} * if(x.last <= y.last, x.n - ({lost("x", "y")}), y.n - ({lost("y", "x")})) >= {num} * (x.n + y.n)
        and least(x.pos, y.pos) + least(x.n - x.pos, y.n - y.pos) >= ceil({num} * (x.n + y.n) / {num + den}.0D)"""))
    rest = rest.select(F.col("x.digest").alias("a"), F.col("y.digest").alias("b")).distinct()
    # Up to the last list that both are in, all of either's lists are known: what isn't common there is lost to the overlap.
    merged = apart.groupBy("digest").agg(F.map_from_entries(F.collect_list(F.struct("key", "pos"))).alias("at"), F.first("n").alias("n"))
    of = lambda d, i: merged.select(F.col("digest").alias(d), F.col("at").alias(f"at_{i}"), F.col("n").alias(f"n_{i}"))
    rest = rest.join(of("a", 1), "a").join(of("b", 2), "b").withColumn("common", F.array_intersect(F.map_keys("at_1"), F.map_keys("at_2")))
    rest = rest.filter("size(common) >= 1 + least(n_1, n_2) div 30").withColumn("last", F.array_max("common"))
    rest = rest.withColumn("most", F.expr("size(common) + least(n_1 - at_1[last], n_2 - at_2[last]) - 1")).filter(f"{den} * most >= {num} * (n_1 + n_2 - most)").select("a", "b")
    known = tested.select(F.least("u", "v").alias("p"), F.greatest("u", "v").alias("q"))
    rest = rest.join(known, (F.least("a", "b") == F.col("p")) & (F.greatest("a", "b") == F.col("q")), "left_anti")
    more = stash(_verified(rest, first, read, k, num, den), "tested")
    roots = stash(_with_links(roots, more.filter("linked").select("u", "v")), "roots")
    discard(star, tested, apart, more, ended)
    return rows, roots


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: tuple[int, int] = (_NUM, _DEN)) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_shingles, component_id``.

    ``threshold`` is a fraction (numerator, denominator). Two documents link when the Jaccard
    similarity of their sets of distinct ``k``-word shingles reaches it; component_id is the
    smallest doc_id reachable. Null, empty or blank text: n_shingles 0, its own component. Fewer
    than ``k`` words: the whole sequence is the one shingle. A row that repeats a doc_id is judged
    by its own text; a null doc_id gets a null component_id unless others in its component have
    ids. Extra columns are not read; an empty table gives no rows.
    """
    rows, roots = jaccard_links(docs, id_col, text_col, k, threshold)
    ids = rows.filter("n > 0").groupBy("digest").agg(F.min("doc_id").alias("least_id"))
    ids = ids.join(roots.withColumnRenamed("node", "digest"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))
    least = ids.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = ids.join(least, "root").select("digest", "component_id")
    full = rows.filter("n > 0").join(named, "digest").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return full.union(rows.filter("n = 0").select("doc_id", "n", "doc_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that of its smallest doc_id.

    A row that repeats a doc_id with the same text goes; one that repeats it with another text is a
    document of its own, and of two in one group the text whose hash is smaller stays. Null ids come
    after all others. Null, empty and blank texts have no duplicates but rows with their own id and
    text. Columns and their order stay; an empty table gives no rows.
    """
    last = F.lit(2**63 - 1)
    rows, roots = jaccard_links(docs, id_col, text_col)
    rows = rows.select(F.struct(F.coalesce("doc_id", last).alias("doc_id"), "same").alias("at"), "n", "digest")
    full = rows.filter("n > 0").join(roots.withColumnRenamed("node", "digest"), "digest", "left").select("at", F.coalesce("root", "digest").alias("root"))
    firsts = full.groupBy("root").agg(F.min("at").alias("first"))
    gone = full.join(firsts, "root").filter("at <> first").select("at")
    again = rows.groupBy("at").count().filter("count > 1").select("at")
    at = F.struct(F.coalesce(F.col(id_col).cast("long"), last).alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("same"))
    return _once(without(docs, at, stash(gone, "gone")), at, stash(again, "again"))


def _once(docs: DataFrame, at, again: DataFrame) -> DataFrame:
    """Of rows with one key that is in ``again``, one."""
    if again.isEmpty():
        return docs
    maybe, rest = split_by(docs, at, again)
    return rest.union(maybe.select(at.alias("key"), F.struct("*").alias("row")).groupBy("key").agg(F.first("row").alias("row")).select("row.*"))
