"""Bindings, marks and requirements: writes as new tables, reads with their ambiguity kept."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.functions.hashing import stable_uuid
from attesta.operators import timeline


def targets(contexts: DataFrame, bindings: DataFrame) -> DataFrame:
    """Each context with its active targets: ``unbound``, ``unique`` with the one, or ``ambiguous``."""
    found = bindings.filter("active").groupBy("context_id").agg(F.sort_array(F.collect_set("entity_id")).alias("entity_ids"))
    out = contexts.join(found, "context_id", "left").withColumn("entity_ids", F.coalesce("entity_ids", F.array().cast("array<string>")))
    n = F.size("entity_ids")
    return out.withColumns({"status": F.when(n == 0, "unbound").when(n == 1, "unique").otherwise("ambiguous"), "target_id": F.when(n == 1, F.get("entity_ids", F.lit(0)))})


def bind(bindings: DataFrame, wanted: DataFrame) -> DataFrame:
    """Bindings after a request ``(context_id, entity_id)``: all of a named context's others become inactive."""
    named = wanted.select("context_id").distinct().withColumn("_named", F.lit(True))
    new = wanted.select("context_id", "entity_id").distinct().withColumn("_wanted", F.lit(True))
    merged = bindings.join(new, ["context_id", "entity_id"], "full_outer").join(named, "context_id", "left")
    active = F.when(F.col("_wanted").isNotNull(), F.lit(True)).when(F.col("_named").isNotNull(), F.lit(False)).otherwise(F.col("active"))
    return merged.select("context_id", "entity_id", active.alias("active"))


def resolve_event_target(events: DataFrame, bindings: DataFrame, contents: DataFrame) -> DataFrame:
    """Events with the entity that they are about: the one named, a module's only content, else the context's only target.

    ``contents(module_id, entity_id)`` are the concrete children of modules. What isn't unique is
    refused with a reason, never picked.
    """
    child = contents.groupBy(F.col("module_id").alias("target_entity_id")).agg(F.count_distinct("entity_id").alias("_children"), F.min("entity_id").alias("_child"))
    bound = bindings.filter("active").groupBy("context_id").agg(F.count_distinct("entity_id").alias("_bound"), F.min("entity_id").alias("_one"))
    out = events.join(child, "target_entity_id", "left").join(bound, "context_id", "left")
    named = F.col("target_entity_id").isNotNull()
    resolved = F.when(named & (F.col("_children") == 1), F.col("_child")).when(named & F.col("_children").isNull(), F.col("target_entity_id")).when(~named & (F.col("_bound") == 1), F.col("_one"))
    reason = F.when(resolved.isNotNull(), F.lit(None)).when(named, "ambiguous_module").when(F.coalesce("_bound", F.lit(0)) == 0, "unbound").otherwise("ambiguous_context")
    return out.withColumns({"resolved_id": resolved, "refusal": reason}).drop("_children", "_child", "_bound", "_one")


def record_requirements(requests: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(entities, occurrences)`` of stated requirements; a payload that is known adds no occurrence.

    ``requests(owner_id, entity_id, requirement_key, payload, recorded_at)``.
    """
    node = stable_uuid(F.col("owner_id"), F.col("entity_id"), F.lit("requirement"), F.col("requirement_key"))
    rows = requests.withColumns({"id": node, "content_hash": F.sha2("payload", 256)})
    entities = timeline.latest(rows, ["owner_id", "id"], "recorded_at", "content_hash").select("owner_id", "id", F.lit("requirement").alias("kind"), F.col("requirement_key").alias("external_id"), F.col("payload").alias("state"))
    seen = rows.select("owner_id", F.col("id").alias("entity_id"), "content_hash", F.col("recorded_at").alias("observed_at"), F.col("payload").alias("content"))
    return entities, timeline.insert_ignore(known, seen, ["owner_id", "entity_id", "content_hash"])


def mark(marks: DataFrame, presented: DataFrame, newest: DataFrame, column: str = "presented_hash") -> DataFrame:
    """Marks pinned to a version: a mark for content that isn't the newest is refused and changes nothing."""
    good = presented.join(newest.select("entity_id", "content_hash"), ["entity_id", "content_hash"], "left_semi").select("entity_id", F.col("content_hash").alias("_new")).dropDuplicates(["entity_id"])
    return marks.join(good, "entity_id", "full_outer").withColumn(column, F.coalesce("_new", column)).drop("_new")


def archive(current: DataFrame, replaced: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """``(current, archived)`` after replacements: what a new row replaces is kept, once."""
    old = current.join(replaced.select(*keys), list(keys), "left_semi")
    return timeline.upsert(current, replaced, keys), old.dropDuplicates()


def observed_text(selected: DataFrame, observations: DataFrame, text: str, author: str) -> DataFrame:
    """A draft against what was published: needs the newest complete observation of the post."""
    from attesta.functions.text import compare_published

    newest = timeline.latest_where(observations, ["entity_id"], "observed_at", "content_hash", "coverage = 'complete'").select("entity_id", F.col(text).alias("_seen"), F.col(author).alias("_author"))
    out = selected.join(newest, "entity_id", "left")
    verdict = F.when(F.col("_seen").isNull(), "no_evidence").otherwise(compare_published(F.col(text), F.col("_seen"), F.col("_author").eqNullSafe(F.col(author))))
    return out.withColumn("comparison", verdict).drop("_seen", "_author")


def time_context(entities: DataFrame, occurrences: DataFrame, zones: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Dates of each entity from its newest observation, with wall times in several zones."""
    from attesta.functions.timefn import date_fields, displays

    newest = timeline.latest(occurrences, ["owner_id", "entity_id"], "observed_at", "content_hash")
    read = newest.select("owner_id", "entity_id", *[F.get_json_object("content", f"$.{f}").try_cast("long").alias(f) for f in fields])
    dates = date_fields(read, ["owner_id", "entity_id"], fields)
    named = entities.select("owner_id", F.col("id").alias("entity_id"), "title")
    return named.join(dates, ["owner_id", "entity_id"]).withColumn("displays", displays(F.col("at"), zones))


def report_submission(reports: DataFrame, bindings: DataFrame) -> DataFrame:
    """Reports of submitted work with the only active target of their context; others are refused."""
    one = bindings.filter("active").groupBy("context_id").agg(F.count_distinct("entity_id").alias("_n"), F.min("entity_id").alias("_one"))
    out = reports.join(one, "context_id", "left")
    return out.withColumns({"entity_id": F.when(F.col("_n") == 1, F.col("_one")), "refusal": F.when(F.col("_n").isNull(), "unbound").when(F.col("_n") > 1, "ambiguous")}).drop("_n", "_one")


def fenced(rows: DataFrame, connections: DataFrame) -> DataFrame:
    """Rows written under the connection's current epoch."""
    now = connections.select(F.col("id").alias("connection_id"), F.col("oauth_epoch").alias("epoch"))
    return rows.join(now, ["connection_id", "epoch"], "left_semi")


def crash_outcomes(attempts: DataFrame, jobs: DataFrame) -> DataFrame:
    """Abandoned attempts whose job was finished all the same count as finished."""
    done = jobs.select(F.col("id").alias("job_id"), F.col("state").alias("_state"))
    settled = F.when(F.col("_state").isin("complete", "partial"), "completed").otherwise(F.col("outcome"))
    return attempts.join(done, "job_id", "left").withColumn("outcome", F.when(F.col("outcome") == "abandoned", settled).otherwise(F.col("outcome"))).drop("_state")

