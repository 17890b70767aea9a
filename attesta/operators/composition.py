"""Evidence of activities from its sources, each as rows that ``attention.overview`` folds in its one shuffle.

Every function returns ``owner_id, entity_id`` and some of ``attention.PROOFS``; none is joined to
another. JSON states and snapshots become typed columns here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.operators import attention, qualification

_KEYS = ["owner_id", "entity_id"]
#: Operations of confirmed actions that prove a requirement: fixed values.
SUBMIT, TOPIC = "moodle.assignment.submit", "moodle.forum.discussion"


_TARGET = "course_id string, cmid string, instance_id string, discussion_id string, parent_id string"
#: What an action's snapshot and an entity's state hold, read from their JSON at once.
_SNAPSHOT = f"connectionId string, operation string, target string, content struct<target: struct<{_TARGET.replace(' string', ': string')}>>"
_STATE = "course_id string, coursemodule string, cmid string, instance_id string, discussion_id string, post_id string, parent_id string, completion string, user_report struct<reported: string, delta_id: string>, attention_presented struct<content_hash: string>, attention_read struct<content_hash: string>, provider_record string"


def confirmed_actions(actions: DataFrame) -> DataFrame:
    """Receipts of actions that succeeded: ``owner_id, action_id, connection_id, operation, target, external_id, updated_at`` and the ids of the snapshot's target.

    ``actions(owner_id, id, connection_id, operation, target, snapshot, external_id, state, updated_at)``.
    What the row itself lacks comes from its snapshot; a snapshot that is no JSON says nothing.
    """
    of = lambda name: F.col(f"_s.{name}")
    rows = actions.filter("state = 'succeeded'").withColumn("_s", F.from_json("snapshot", _SNAPSHOT))
    ids = {n: F.col(f"_s.content.target.{n}").try_cast("double") for n in ("course_id", "cmid", "instance_id", "discussion_id", "parent_id")}
    return rows.select(
        "owner_id", F.col("id").alias("action_id"), F.coalesce("connection_id", of("connectionId"), F.lit("")).alias("connection_id"), F.coalesce("operation", of("operation"), F.lit("")).alias("operation"),
        F.coalesce("target", of("target"), F.lit("")).alias("target"), "external_id", "updated_at", *[c.alias(n) for n, c in ids.items()],
    )


def action_receipts(entities: DataFrame, receipts: DataFrame) -> DataFrame:
    """``(owner_id, entity_id, action_id, operation)``: receipts whose connection, course, module and instance are the entity's.

    A discussion or a parent post counts against a match only where both sides name one.
    """
    state = lambda *names: F.coalesce(*[F.col(f"_s.{n}").try_cast("double") for n in names])
    known = entities.withColumn("_s", F.from_json("state", _STATE)).select(
        "owner_id", F.col("id").alias("entity_id"), "connection_id", state("course_id").alias("course_id"), state("coursemodule", "cmid").alias("cmid"), state("instance_id").alias("instance_id"), state("discussion_id").alias("_discussion"), state("post_id", "parent_id").alias("_parent")
    )
    on = ["owner_id", "connection_id", "course_id", "cmid", "instance_id"]
    apart = lambda a, b: F.coalesce(F.col(a) != F.col(b), F.lit(False))
    met = known.join(receipts.select(*on, "action_id", "operation", "discussion_id", "parent_id"), on)
    return met.filter(~apart("discussion_id", "_discussion") & ~apart("parent_id", "_parent")).select(*_KEYS, "action_id", "operation")


def receipt_proofs(receipts: DataFrame) -> DataFrame:
    is_ = lambda op: (F.col("operation") == op).cast("long")
    return receipts.select(*_KEYS, F.lit(1).cast("long").alias("receipts"), is_(SUBMIT).alias("submit_receipts"), is_(TOPIC).alias("topic_receipts"))


def state_proofs(entities: DataFrame, superseded: DataFrame) -> DataFrame:
    """What entities' own states say: an old report of the user, unless it is withdrawn or in ``superseded(owner_id, delta_id)``, and a completion."""
    said = F.col("_s.user_report")
    rows = entities.withColumn("_s", F.from_json("state", _STATE)).select("owner_id", F.col("id").alias("entity_id"), said.isNotNull().alias("_said"), said.reported.alias("_on"), said.delta_id.alias("delta_id"), (F.col("_s.completion") == "true").alias("native_completion"))
    gone = superseded.select("owner_id", F.col("delta_id").cast("string").alias("delta_id")).distinct().withColumn("_gone", F.lit(True))
    legacy = F.col("_said") & ~F.col("_on").eqNullSafe(F.lit("false")) & F.col("_gone").isNull()
    return rows.filter("_said or native_completion").join(gone, ["owner_id", "delta_id"], "left").select(*_KEYS, legacy.alias("legacy_report"), "native_completion")


def tracker_proofs(trackers: DataFrame) -> DataFrame:
    """From ``qualification.completion_trackers``: states 1 and 2 are completions."""
    return trackers.select(*_KEYS, F.col("state").isin("1", "2").alias("native_completion"))


def status_proofs(statuses: DataFrame) -> DataFrame:
    """From ``qualification.own_submission_status``: the status speaks only if it is qualified."""
    return statuses.select(*_KEYS, F.col("qualified").alias("status_qualified"), F.when(F.col("qualified"), F.col("status")).alias("native_status"), (F.col("qualified") & F.col("feedback_available")).alias("feedback_available"))


def forum_proofs(posts: DataFrame) -> DataFrame:
    """From ``posts(owner_id, forum_id, discussion_id, post_id, parent_id, author_id, subject, coverage)``; without a subject nothing is known of the forum."""
    found = attention.forum_evidence(posts.filter("subject is not null"), F.col("subject"))
    partial = lambda c: F.coalesce(F.col(c), F.lit(False))
    return found.select(
        "owner_id", F.col("forum_id").alias("entity_id"), F.col("own_topics").alias("publications"), partial("partial_topics").alias("partial_publications"), "colleagues_answered", partial("partial_replies").alias("partial_replies"), F.lit(True).alias("forum_known")
    )


def material_proofs(drafts: DataFrame, newest: DataFrame) -> DataFrame:
    """Per activity how many of its drafts' materials have changed: ``drafts(owner_id, focal_id, draft_id, entity_id, base_hash)``, ``newest(entity_id, content_hash)``; a pair of draft and base counts once."""
    changed = attention.dependency_drift(drafts.filter("base_hash is not null"), newest).filter("drift = 'changed'").select("owner_id", F.col("focal_id").alias("entity_id"), "draft_id", F.col("entity_id").alias("_m"), "base_hash").distinct()
    return changed.groupBy(*_KEYS).agg(F.count("*").alias("changed_materials"))


def marks_of(entities: DataFrame) -> DataFrame:
    """Which content the user was shown and has read, from the entities' states."""
    state = entities.select("owner_id", F.col("id").alias("entity_id"), F.from_json("state", _STATE).alias("_s"))
    return state.select(*_KEYS, F.col("_s.attention_presented.content_hash").alias("presented_hash"), F.col("_s.attention_read.content_hash").alias("read_hash")).filter("presented_hash is not null or read_hash is not null")


def composed(entities: DataFrame, occurrences: DataFrame, requirements: DataFrame, reports: DataFrame, actions: DataFrame, relations: DataFrame, nodes: DataFrame, observed: DataFrame, posts: DataFrame, drafts: DataFrame, materials: DataFrame, superseded: DataFrame) -> tuple[DataFrame, ...]:
    """The inputs of ``attention.overview`` from preserved tables alone.

    ``entities(owner_id, id, connection_id, provider_subject, kind, title, connection_state, state)``;
    ``nodes`` are the trackers and own statuses that ``relations`` lead to, ``observed`` the newest
    observation of the latter. The current record of an entity is its state's ``provider_record``.
    """
    works = entities.filter(F.col("kind").isin("assignment", "module")).select("owner_id", F.col("id").alias("entity_id"), "connection_id", "provider_subject", "state")
    proofs = [
        receipt_proofs(action_receipts(entities, confirmed_actions(actions))),
        state_proofs(entities, superseded),
        tracker_proofs(qualification.completion_trackers(relations, nodes)),
        status_proofs(qualification.own_submission_status(works, relations, nodes, observed)),
        forum_proofs(posts),
        material_proofs(drafts, materials),
    ]
    evidence = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), proofs)
    known = entities.withColumn("provider_record", F.get_json_object("state", "$.provider_record"))
    return known, occurrences, requirements, reports, evidence, marks_of(entities)
