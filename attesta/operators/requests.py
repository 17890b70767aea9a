"""Small reads and decisions that a request makes before or after the source is asked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attesta.operators import paging

PDF_BYTES = 20 << 20
MOST_PAGES = 10_000
REFERENCES = 20
#: Coverages that a stored extraction may name: fixed values.
COVERAGES = ("complete", "partial", "denied", "unavailable", "expired", "timeout", "parsing_error")
_UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"


def resume_page(pages: Column, count: Column) -> Column:
    """The page to go on from: the first that is missing, else the first truncated one of ``pages(page, truncated)``.

    Nothing stored: 1. Without a ``count``, known pages end at the largest, and the one after it comes last.
    """
    present = F.transform(pages, lambda p: p.page)
    limit = F.coalesce(count, F.array_max(present))
    missing = F.array_min(F.array_except(F.sequence(F.lit(1), limit), present))
    cut = F.array_min(F.transform(F.filter(pages, lambda p: p.truncated & (p.page <= limit)), lambda p: p.page))
    return F.when(F.size(pages) == 0, 1).otherwise(F.coalesce(missing, cut, F.when(count.isNull(), limit + 1)))


def pdf_page(files: DataFrame, after=None) -> DataFrame:
    """A page of stored PDFs by id, each with its coverage and the page to go on from.

    ``files(id, name, sha256, bytes, mime_type, stored, extraction)`` with ``extraction`` a struct
    ``(coverage, page_count, pages_in_document, pages: array of (page, truncated))``.
    """
    kept = files.filter((F.col("mime_type") == "application/pdf") & F.col("stored") & (F.col("bytes") <= PDF_BYTES))
    pages = F.coalesce("extraction.pages", F.array().cast("array<struct<page:int,truncated:boolean>>"))
    valid = lambda c: F.when(F.col(c).between(1, MOST_PAGES), F.col(c).cast("int"))
    count = F.coalesce(valid("extraction.page_count"), valid("extraction.pages_in_document"))
    listed = F.coalesce(F.col("extraction.coverage").isin(*COVERAGES), F.lit(False))
    out = paging.keyset_asc(kept, "id", after)
    return out.withColumns({"coverage": F.when(listed, F.col("extraction.coverage")).otherwise("not_extracted"), "next_page": resume_page(pages, count)}).drop("extraction")


def actions_page(actions: DataFrame, approvals: DataFrame, states: Sequence[str] | None = None, limit: int = 50) -> DataFrame:
    """The newest actions with their approval, if any; ``states`` narrows them."""
    if not 1 <= limit <= 200 or states is not None and not states:
        raise ValueError("limit is 1 to 200, states name one at least")
    found = actions if states is None else actions.filter(F.col("state").isin(*states))
    top = found.orderBy(F.desc("created_at"), "id").limit(limit)
    return top.join(approvals.withColumnRenamed("action_id", "id"), ["owner_id", "id"], "left")


def import_summary(outcomes: DataFrame) -> DataFrame:
    """Per coverage: files, what was done with them, and the bytes of those that were written."""
    wrote = F.col("action").isin("inserted", "updated")
    counts = [F.count_if(F.col("action") == a).alias(a) for a in ("inserted", "updated", "kept_prior")]
    return outcomes.groupBy("coverage").agg(F.count("*").alias("files"), *counts, F.coalesce(F.sum(F.when(wrote, F.col("bytes"))), F.lit(0)).alias("bytes_preserved"))


def admitted(requests: DataFrame, connections: DataFrame, contexts: DataFrame, provider: str = "moodle") -> DataFrame:
    """Requests ``(owner_id, connection_id, context_id)`` with ``refusal``: the owner must have both, the connection of the provider."""
    c = connections.filter(F.col("provider") == provider).select("owner_id", F.col("id").alias("connection_id")).distinct().withColumn("_c", F.lit(True))
    x = contexts.select("owner_id", F.col("id").alias("context_id")).distinct().withColumn("_x", F.lit(True))
    out = requests.join(c, ["owner_id", "connection_id"], "left").join(x, ["owner_id", "context_id"], "left")
    return out.withColumn("refusal", F.when(F.col("_c").isNull() | F.col("_x").isNull(), "not_found")).drop("_c", "_x")


def selected_activity(candidates: DataFrame, request: str, entity: str) -> DataFrame:
    """Per request its only activity; none or several are refused, never picked."""
    one = F.count_distinct(entity) == 1
    return candidates.groupBy(request).agg(F.when(one, F.min(entity)).alias(entity), F.when(~one, "ambiguous_activity").alias("refusal"))


def capabilities(offered: Column, audited: Sequence[str], implemented: Sequence[str]) -> Column:
    """``available`` (offered, audited and implemented) and ``not_offered`` (audited only) of an array of offered functions."""
    known, own = F.array(*[F.lit(a) for a in audited]), F.array(*[F.lit(i) for i in implemented])
    return F.struct(F.array_sort(F.array_intersect(F.array_intersect(offered, known), own)).alias("available"), F.array_except(known, offered).alias("not_offered"))


def origin_drift(manifests: DataFrame, heads: DataFrame) -> DataFrame:
    """Recorded commits against the origin's current ones: ``unchanged``, ``advanced``, or ``unavailable`` where there is no head."""
    out = manifests.join(heads.select("origin", F.col("commit").alias("current_commit")), "origin", "left")
    drift = F.when(F.col("current_commit").isNull(), "unavailable").when(F.col("current_commit") == F.col("commit"), "unchanged").otherwise("advanced")
    return out.withColumn("drift", drift)


def commit_and_refresh(receipts: DataFrame, refreshes: DataFrame) -> DataFrame:
    """Every committed receipt with the state of its source's refresh: a failed or absent one takes nothing back."""
    done = refreshes.groupBy("delta_id").agg(F.bool_or("ok").alias("_ok"))
    out = receipts.join(done, "delta_id", "left")
    return out.withColumn("source_refresh", F.when(F.col("_ok"), "complete").otherwise("failed")).drop("_ok")


def course_of(kind: Column) -> Column:
    """The course that a job's kind names, null where it names none."""
    number = F.regexp_extract(kind, r"^moodle_course:([0-9]+)$", 1).try_cast("long")
    return F.when(number.between(1, 2**53 - 1), number)


def dispatched(jobs: DataFrame, follow_up: bool = False) -> DataFrame:
    """Jobs ``(kind, error, coverage)`` with ``finished_as``: null leaves a job to whoever holds its lease now.

    Kinds that are neither the course list nor a course are unavailable; so are errors, but for an
    invalid credential under follow-up, which counts as expired.
    """
    course = course_of(F.col("kind"))
    known = (F.col("kind") == "moodle_courses") | course.isNotNull()
    failed = F.when((F.col("error") == "invalid_token") & F.lit(follow_up), "expired").otherwise("unavailable")
    as_ = F.when(~F.coalesce(known, F.lit(False)), "unavailable").when(F.col("error").isin("job_conflict", "expired"), None).when(F.col("error").isNotNull(), failed).otherwise(F.col("coverage"))
    return jobs.withColumns({"course_id": course, "finished_as": as_})


def attempt_metrics(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per attempt of ``log(*keys, event, at_ms, memory)``: whole milliseconds from start to report, calls, memory at both ends."""
    at = lambda e, c: F.max(F.when(F.col("event") == e, F.col(c)))
    spent = F.greatest(F.lit(0), F.round(at("report", "at_ms") - at("start", "at_ms"))).cast("long")
    return log.groupBy(*keys).agg(spent.alias("duration_ms"), F.count_if(F.col("event") == "call").alias("calls"), at("start", "memory").alias("memory_start"), at("report", "memory").alias("memory_end"))


def reusable_transcription(previous: Column, expected: Column) -> Column:
    """Whether a stored transcription stands: same engine, language and model, none of them unknown or empty."""
    same = lambda f: (previous[f] == expected[f]) & (previous[f] != "")
    return F.coalesce(same("engine_version") & same("language") & same("model_sha256"), F.lit(False))


def transcript(df: DataFrame) -> DataFrame:
    """Media ``(probe_ok, probe_coverage, subtitles_ok, subtitles_coverage, cues, truncated, wanted, asr_ok, asr_coverage)`` with ``transcript_source`` and ``coverage``.

    Captions in the file come before a transcription; one is wanted only where there are none.
    """
    captions = F.col("cues") > 0
    asr = ~captions & F.col("wanted")
    source = F.when(captions, "embedded_captions").when(asr & F.coalesce("asr_ok", F.lit(False)), "local_asr").otherwise("none")
    coverage = F.when(~F.col("probe_ok"), F.col("probe_coverage")).when(~F.col("subtitles_ok"), F.col("subtitles_coverage")).when(asr, F.coalesce("asr_coverage", F.lit("partial"))).when(captions & ~F.col("truncated"), "complete").otherwise("partial")
    return df.withColumns({"transcript_source": source, "coverage": coverage})


def read_curation(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The JSON files of a tree's curation folder, a row each; no folder, no rows. Order by ``batchId`` where order matters."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/curation")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(f"{folder}/curation")


def draft_references(drafts: DataFrame, required: DataFrame, most: int = REFERENCES) -> DataFrame:
    """References of drafts, one more than ``most`` so that too many can be seen, by basis and id.

    ``drafts(draft_id, context_id, entity_id, provenance: array of (locator, version))``; ``required``
    are material edges ``(from_id, to_id, observation_id, content_hash, context_id, draft_id)``, whose
    last two narrow an edge to one context or draft where set. Ids that are no UUID have a null ``base_uuid``.
    """
    own = drafts.select("draft_id", F.explode("provenance").alias("p")).filter(F.col("p.locator").rlike(r"^hub:observation:[0-9a-fA-F-]{36}$") & (F.coalesce("p.version", F.lit("")) != ""))
    own = own.select("draft_id", F.lit("artifact_provenance").alias("basis"), F.substring("p.locator", 17, 36).alias("base_id"), F.col("p.version").alias("base_hash"), F.lit(None).cast(required.schema["to_id"].dataType).alias("required_entity_id"))
    e = required.filter("coalesce(observation_id, '') <> '' and coalesce(content_hash, '') <> ''").select(F.col("from_id").alias("entity_id"), "to_id", "observation_id", "content_hash", F.col("context_id").alias("_context"), F.col("draft_id").alias("_draft"))
    edges = drafts.select("draft_id", "context_id", "entity_id").join(e, "entity_id").filter("(_context is null or _context = context_id) and (_draft is null or _draft = draft_id)")
    edges = edges.select("draft_id", F.lit("required_material").alias("basis"), F.col("observation_id").alias("base_id"), F.col("content_hash").alias("base_hash"), F.col("to_id").alias("required_entity_id"))
    w = Window.partitionBy("draft_id").orderBy("basis", "base_id", "base_hash", F.asc_nulls_last("required_entity_id"))
    first = own.union(edges).withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= most + 1)
    return first.withColumn("base_uuid", F.when(F.col("base_id").rlike(f"^{_UUID}$"), F.lower("base_id")))


def resources_of(modules: DataFrame, resources: DataFrame) -> DataFrame:
    """Modules ``(owner_id, connection_id, activity_id, course_id, module_id)`` with the resources that name the same course and module, as text.

    There is no edge between them. Ids that aren't positive decimals name nothing, and an activity isn't its own resource.
    """
    number = r"^[1-9][0-9]*$"
    named = modules.filter(F.col("course_id").rlike(number) & F.col("module_id").rlike(number))
    r = resources.select("owner_id", "connection_id", "course_id", "module_id", F.col("id").alias("resource_id"))
    return named.join(r, ["owner_id", "connection_id", "course_id", "module_id"]).filter("resource_id <> activity_id")
