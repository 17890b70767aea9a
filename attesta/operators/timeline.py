"""Occurrences, snapshots and the state of things over time.

An occurrence is one sighting; a snapshot is content that was seen, stored once by its hash. A
thing that goes A, B, A has three occurrences and two snapshots.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Keys = Sequence[str]


def newest_first(*columns: str) -> list[Column]:
    return [F.desc_nulls_last(c) for c in columns]


def ranked(df: DataFrame, keys: Keys, order: Sequence[Column | str], name: str = "rn") -> DataFrame:
    """Rank of each row within its key. A filter on it plans a group limit below the shuffle."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def latest(df: DataFrame, keys: Keys, at: str, tie: str) -> DataFrame:
    """The newest row of each key."""
    return ranked(df, keys, newest_first(at, tie)).filter("rn = 1").drop("rn")


def latest_where(df: DataFrame, keys: Keys, at: str, tie: str, condition: Column | str) -> DataFrame:
    """Newest rows that meet a condition themselves: the filter stands above the rank, so an older row never steps in."""
    return latest(df, keys, at, tie).filter(condition)


def top_k(df: DataFrame, keys: Keys, order: Sequence[Column | str], k: int) -> DataFrame:
    """The first ``k`` rows of each key; ``truncated`` says that there were more (one more is read to know)."""
    more = F.max((F.col("rn") > k).cast("int")).over(Window.partitionBy(*keys)) == 1
    return ranked(df, keys, order).filter(F.col("rn") <= k + 1).withColumn("truncated", more).filter(F.col("rn") <= k)


def previous_distinct(df: DataFrame, keys: Keys, at: str, tie: str, content: str) -> DataFrame:
    """Per key its newest row, and the newest earlier one with other content (``previous_*``, null if there is none).

    One shuffle: within the key, the newest row's content is spread over all rows and the best of
    the differing earlier ones is an aggregate.
    """
    newest = Window.partitionBy(*keys).orderBy(*newest_first(at, tie)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = df.withColumns({"_at": F.first(at).over(newest), "_tie": F.first(tie).over(newest), "_content": F.first(content).over(newest)})
    other = (F.col(at) < F.col("_at")) & ~F.col(content).eqNullSafe(F.col("_content"))
    before = F.max(F.when(other, F.struct(F.col(at).alias("at"), F.col(tie).alias("tie"), F.col(content).alias("content"))))
    names = {at: "at", tie: "tie", content: "content"}  # the tie-breaker may be the content itself
    now = seen.groupBy(*keys).agg(*[F.first(f"_{role}").alias(c) for c, role in names.items()], before.alias("_p"))
    return now.select(*keys, *names, *[F.col(f"_p.{role}").alias(f"previous_{c}") for c, role in names.items()])


def snapshots(occurrences: DataFrame, keys: Keys, content: str, at: str, tie: str) -> DataFrame:
    """Content once per key and hash, from its first sighting."""
    return ranked(occurrences, [*keys, content], [F.asc(at), F.asc(tie)]).filter("rn = 1").drop("rn")


def occurrence_log(sightings: DataFrame, keys: Keys, content: str, at: str) -> DataFrame:
    """Sightings without exact repeats of (key, content, time)."""
    return sightings.dropDuplicates([*keys, content, at])


def timeline(occurrences: DataFrame, snaps: DataFrame, keys: Keys, content: str, from_snapshot: Sequence[str]) -> DataFrame:
    """Occurrences with what their snapshot holds: circumstances of the sighting, content of the first."""
    return occurrences.drop(*from_snapshot).join(snaps.select(*keys, content, *from_snapshot), [*keys, content])


def revisits(occurrences: DataFrame, keys: Keys, content: str) -> DataFrame:
    """Per key: sightings, snapshots, and how often content came back."""
    return occurrences.groupBy(*keys).agg(F.count("*").alias("occurrences"), F.count_distinct(content).alias("snapshots")).withColumn("revisits", F.col("occurrences") - F.col("snapshots"))


def change_points(df: DataFrame, keys: Keys, at: str, tie: str, content: str) -> DataFrame:
    """Rows at which content differs from the row before."""
    order = Window.partitionBy(*keys).orderBy(at, tie)
    return df.withColumn("_before", F.lag(content).over(order)).withColumn("_n", F.row_number().over(order)).filter((F.col("_n") == 1) | ~F.col(content).eqNullSafe(F.col("_before"))).drop("_n", "_before")


def drift(entities: DataFrame, newest: DataFrame, key: str, state: str, content: str) -> DataFrame:
    """``matches_latest``: true, false, or null if nothing was observed. Compare canonical JSON."""
    return entities.join(newest.select(key, F.col(content).alias("_seen")), key, "left").withColumn("matches_latest", F.when(F.col("_seen").isNotNull(), F.col(state).eqNullSafe(F.col("_seen")))).drop("_seen")


def single_current(edges: DataFrame, child: Keys, parent: str, at: str, tie: str) -> DataFrame:
    """Every (child, parent) edge ever seen, once; ``current`` on the parent seen last, others are ``previous``."""
    newest = Window.partitionBy(*child).orderBy(*newest_first(at, tie)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return edges.withColumn("_now", F.first(parent).over(newest)).groupBy(*child, parent).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen"), F.first("_now").alias("_now")).withColumn("kind", F.when(F.col(parent).eqNullSafe(F.col("_now")), "current").otherwise("previous")).drop("_now")


def numbered(df: DataFrame, context: Keys, order: Sequence[str]) -> DataFrame:
    """Versions from 1 within each context, in order of arrival."""
    return ranked(df, context, [F.asc(c) for c in order], "version")


def occurrences_per(df: DataFrame, keys: Keys) -> DataFrame:
    return df.withColumn("versions", F.count("*").over(Window.partitionBy(*keys)))


# Writes on tables without MERGE: a new table from the old one and the incoming rows.


def insert_ignore(old: DataFrame, new: DataFrame, keys: Keys) -> DataFrame:
    """Old rows and those new ones whose key is unknown, once each."""
    return old.unionByName(new.dropDuplicates(list(keys)).join(old.select(*keys), list(keys), "left_anti"))


def upsert(old: DataFrame, new: DataFrame, keys: Keys) -> DataFrame:
    """New rows replace old ones of the same key; ``new`` has a key once."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def upsert_merge(old: DataFrame, new: DataFrame, keys: Keys, state: str = "state") -> DataFrame:
    """Maps are merged key by key, the new value wins; all other columns come from the new row."""
    prior = old.select(*keys, F.col(state).alias("_old"))
    empty = F.map_filter(F.col(state), lambda k, v: F.lit(False))
    kept = F.map_filter(F.coalesce("_old", empty), lambda k, v: ~F.map_contains_key(F.col(state), k))
    merged = new.join(prior, list(keys), "left").withColumn(state, F.coalesce(F.map_concat(kept, state), "_old")).drop("_old")
    return upsert(old, merged, keys)


def guarded_projection(projection: DataFrame, arrivals: DataFrame, keys: Keys, at: str, tie: str) -> DataFrame:
    """State by time of observation, not of arrival: a late row goes to history only."""
    return latest(projection.unionByName(arrivals), keys, at, tie)
