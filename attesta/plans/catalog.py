"""The read surface by name: what a user asks for, composed from operators.

Each function takes tables with the schemas of ``attesta.schema`` and gives a DataFrame; paging is
applied last, so the same plan serves one owner or all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import jsonfn
from attesta.operators import attention, graph, paging, preferences, search, storage, timeline

#: Scopes of contexts made by tests: fixed values.
SYNTHETIC_ENVIRONMENTS = ("synthetic", "synthetic-host-lab", "test")
SYNTHETIC_PURPOSE = "acceptance-test"
SYNTHETIC_RUN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}-skill-[0-9]+[.][0-9]+[.][0-9]+$"


def synthetic(scope: str = "scope") -> Column:
    """Whether a context's scope says that it was made by a test: by environment, by purpose, or a dated mobile validation run."""
    of = lambda k: F.col(scope)[k]
    mobile = (of("purpose") == "validation") & (of("surface") == "mobile") & of("run").rlike(SYNTHETIC_RUN)
    return F.coalesce(of("environment").isin(*SYNTHETIC_ENVIRONMENTS), F.lit(False)) | F.coalesce(of("purpose") == SYNTHETIC_PURPOSE, F.lit(False)) | F.coalesce(mobile, F.lit(False))


def contexts(contexts_: DataFrame, deltas: DataFrame, offset: int = 0, delta_offset: int = 0, include_synthetic: bool = False) -> tuple[DataFrame, DataFrame]:
    """A page of contexts and, paged on its own, their deltas."""
    df = contexts_ if include_synthetic else contexts_.filter(~synthetic())
    page = paging.offset_page(df, [F.desc("updated_at"), F.asc("id")], offset)
    own = deltas.join(page.select(F.col("id").alias("context_id")), "context_id", "left_semi")
    return page, paging.offset_page(own, [F.desc("recorded_at"), F.asc("id")], delta_offset, 50)


def history(deltas: DataFrame, context_id: str, offset: int = 0) -> DataFrame:
    return paging.offset_page(deltas.filter(F.col("context_id") == context_id), [F.desc("version")], offset)


def find(deltas: DataFrame, entities: DataFrame, query: str, offset: int = 0) -> tuple[DataFrame, DataFrame]:
    """Deltas that have the query's words or text, and entities whose title contains it."""
    d = paging.offset_page(search.search_either(deltas, "content", query), [F.desc("recorded_at"), F.asc("id")], offset)
    e = paging.offset_page(entities.filter(search.contains(F.col("title"), query)), ["title", "id"], offset)
    return d, e


def entities_page(entities: DataFrame, connection_id: str | None = None, kind: str | None = None, query: str | None = None, offset: int = 0) -> DataFrame:
    df = entities
    for column, value in (("connection_id", connection_id), ("kind", kind)):
        df = df if value is None else df.filter(F.col(column) == value)
    df = df if query is None else df.filter(search.contains(F.col("title"), query))
    return paging.offset_page(df, ["title", "id"], offset)


def entity_context(entities: DataFrame, occurrences: DataFrame, relations: DataFrame, entity_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The node with its drift, its five newest observations and at most thirty edges."""
    node = entities.filter(F.col("id") == entity_id).withColumn("canonical_state", jsonfn.canonical("state"))
    seen = occurrences.filter(F.col("entity_id") == entity_id)
    newest = timeline.latest(seen, ["entity_id"], "observed_at", "content_hash").select(F.col("entity_id").alias("id"), jsonfn.canonical("content").alias("content"))
    edges = relations.filter((F.col("from_id") == entity_id) | (F.col("to_id") == entity_id)).orderBy("kind", "from_id", "to_id").limit(30)
    return timeline.drift(node, newest, "id", "canonical_state", "content"), paging.keyset_desc(seen, "observed_at", "content_hash", size=5), edges


def files_page(files: DataFrame, entity_id: str | None = None, offset: int = 0) -> DataFrame:
    """Files without their bulky extraction parts."""
    df = files if entity_id is None else files.filter(F.col("entity_id") == entity_id)
    slim = df.withColumn("extraction", jsonfn.without_keys(F.col("extraction"), "pages", "blocks", "sanitized_html")).drop("inline_content")
    return paging.offset_page(slim, ["name", "id"], offset)


def library(files: DataFrame, entities: DataFrame, connections: DataFrame, after: str | None = None) -> DataFrame:
    """Files of resources and artifacts with their connection, by key; ``available`` if the bytes are here."""
    kept = entities.filter(F.col("kind").isin("resource", "artifact")).select("owner_id", F.col("id").alias("entity_id"), "title", "connection_id")
    joined = files.join(kept, ["owner_id", "entity_id"]).join(connections.select("owner_id", F.col("id").alias("connection_id"), "provider"), ["owner_id", "connection_id"])
    has = F.col("inline_content").isNotNull() | F.col("blob_sha256").isNotNull()
    return paging.keyset_asc(joined.select("id", "name", "title", "provider", "bytes", has.alias("available")), "id", after)


def usage(files: DataFrame, blobs: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Row counts, and bytes referred to, stored and saved, as decimal text."""
    counts = storage.usage(tables)
    logical = files.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("preserved"))
    stored = blobs.agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("stored"))
    one = counts.join(logical).join(stored)  # three rows of one
    return one.withColumn("saved", F.greatest(F.col("preserved") - F.col("stored"), F.lit(0)).cast("string")).withColumns({c: F.col(c).cast("string") for c in ("preserved", "stored")})


def study_package(relations: DataFrame, entities: DataFrame, files: DataFrame, activity: DataFrame) -> DataFrame:
    return graph.package(graph.study_graph(relations, entities, activity), files)


def preferences_at(rows: DataFrame, scope: dict[str, str], at: Column) -> DataFrame:
    """Preferences that apply to a scope; more than 200 rows of history are not answered from."""
    kept, complete = paging.bounded_history(rows, [F.desc("recorded_at"), F.desc("id")])
    return preferences.resolve(kept, scope, at, complete)


def coverage_of(results: DataFrame, keys: list[str]) -> DataFrame:
    """Worst coverage of a job's parts; a cut is never complete, and a coverage that isn't known is worst of all."""
    from attesta.operators.merge import worst_coverage

    cut = F.when(F.col("truncated") & (F.col("coverage") == "complete"), "partial").otherwise(F.col("coverage"))
    return results.withColumn("coverage", cut).groupBy(*keys).agg(worst_coverage().alias("coverage"))


def attention_page(*inputs, offset: int = 0, **named) -> DataFrame:
    """A page of ``attention.overview``, by the nearest deadline."""
    return paging.offset_page(attention.overview(*inputs, **named), [F.asc_nulls_last("due_at"), F.asc("entity_id")], offset)


def followups(grants: DataFrame, connections: DataFrame, now: Column) -> DataFrame:
    """The twenty newest grants with a status from their own and their connection's state."""
    c = connections.select("owner_id", F.col("id").alias("connection_id"), F.col("state").alias("connection_state"), "oauth_epoch")
    state = F.when(F.col("revoked"), "revoked").when(F.col("expires_at") <= now, "expired").when(F.col("paused"), "paused").when((F.col("connection_state") != "active") | ~F.col("epoch").eqNullSafe(F.col("oauth_epoch")), "disconnected").otherwise("active")
    return grants.join(c, ["owner_id", "connection_id"]).withColumn("status", state).orderBy(F.desc("created_at"), "id").limit(20)
