"""Join shapes beyond the plain equi-join."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exists_either(df: DataFrame, *sides: tuple[DataFrame, str, str]) -> DataFrame:
    """Rows whose key ``(left column, right column)`` is in any side: one equi-join per side, not a join on OR.

    Each side is ``(other, column of df, column of other)``; a row is returned once.
    """
    marked, flags = df, []
    for i, (other, own, theirs) in enumerate(sides):
        keys = other.select(F.col(theirs).alias(f"_k{i}")).distinct().withColumn(f"_f{i}", F.lit(True))
        marked = marked.join(keys, F.col(own) == F.col(f"_k{i}"), "left").drop(f"_k{i}")
        flags.append(F.col(f"_f{i}").isNotNull())
    hit = flags[0]
    for f in flags[1:]:
        hit = hit | f
    return marked.filter(hit).select(df.columns)


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join in which null keys meet null keys; the left side's keys are kept."""
    r = right.select([F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(r, on, how).drop(*[f"_r_{k}" for k in keys])


def both_or_null(a: Column, b: Column) -> Column:
    """Equal where both are given; where one is missing, consistent."""
    return a.isNull() | b.isNull() | (a == b)


def unique_match(left: DataFrame, right: DataFrame, keys: Sequence[str], target: str) -> DataFrame:
    """``left`` with ``target`` where exactly one candidate fits, and ``candidates``: several are a refusal, not a pick."""
    found = right.filter(F.col(target).isNotNull()).groupBy(*keys).agg(F.count_distinct(target).alias("candidates"), F.min(target).alias("_one"))
    joined = left.join(found, list(keys), "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))
    status = F.when(F.col("candidates") == 1, "resolved").when(F.col("candidates") == 0, "missing").otherwise("ambiguous")
    return joined.withColumns({target: F.when(F.col("candidates") == 1, F.col("_one")), "status": status}).drop("_one")


def with_fallback(left: DataFrame, first: DataFrame, second: DataFrame, first_keys: Sequence[str], second_keys: Sequence[str], target: str) -> DataFrame:
    """The target by the first keys, else by the second ones; each side has a key once."""
    a = first.select(*first_keys, F.col(target).alias("_a"))
    b = second.select(*second_keys, F.col(target).alias("_b"))
    return left.join(a, list(first_keys), "left").join(b, list(second_keys), "left").withColumn(target, F.coalesce("_a", "_b")).drop("_a", "_b")


def parent_of(df: DataFrame, group: Sequence[str], id_: str, parent: str, take: Sequence[str]) -> DataFrame:
    """Rows with ``parent_*`` columns of the row of the same group that ``parent`` names."""
    p = df.select(*group, F.col(id_).alias(parent), *[F.col(c).alias(f"parent_{c}") for c in take])
    return df.join(p, [*group, parent], "left")


def earliest_by_either(left: DataFrame, right: DataFrame, keys: Sequence[str], order: Sequence[str], id_: str) -> DataFrame:
    """For each row of ``left`` its earliest match by any of ``keys`` ``(left_id = right.key)``: a union of equi-joins, then rank 1."""
    found = None
    for k in keys:
        one = left.join(right.withColumnRenamed(k, "_k").withColumn(k, F.col("_k")), F.col(id_) == F.col("_k")).drop("_k")
        found = one if found is None else found.unionByName(one)
    w = Window.partitionBy(id_).orderBy(*order)
    return found.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def in_windows(events: DataFrame, windows: DataFrame, at: str, start: str, end: str, keys: Sequence[str], bucket_seconds: int) -> DataFrame:
    """Events inside half-open windows ``[start, end)`` of the same keys, by an equi-join on time buckets.

    A window is copied to each bucket that it touches; pick buckets about as long as windows.
    """
    b = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / (bucket_seconds * 1_000_000))
    w = windows.withColumn("_b", F.explode(F.sequence(b(start), b(end))))
    e = events.withColumn("_b", b(at))
    return e.join(w, [*keys, "_b"]).filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_b")
