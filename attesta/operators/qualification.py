"""Whether a preserved state may speak for the user: completion trackers and the status of an own submission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def completion_trackers(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Per ``(owner_id, entity_id)`` the state of the tracker with the smallest id; entities without one have no row.

    ``relations(owner_id, from_id, to_id, kind)``, ``entities(owner_id, id, kind, state)`` with JSON states.
    """
    links = relations.filter("kind = 'tracks_completion'").select("owner_id", F.col("from_id").alias("entity_id"), F.col("to_id").alias("id"))
    found = links.join(entities.filter("kind = 'completion_activity'").select("owner_id", "id", "state"), ["owner_id", "id"])
    first = found.groupBy("owner_id", "entity_id").agg(F.min_by("state", "id").alias("_s")).filter("_s is not null")
    of = lambda name: F.get_json_object("_s", f"$.{name}").alias(name)
    return first.select("owner_id", "entity_id", of("state"), of("timecompleted"), F.lit("moodle_completion_tracker").alias("basis"))


def _number(json: str, path: str) -> Column:
    return F.get_json_object(json, path).try_cast("double")


def own_submission_status(assignments: DataFrame, relations: DataFrame, statuses: DataFrame, newest: DataFrame) -> DataFrame:
    """Per assignment its own submission's status, ``qualified`` only where nothing speaks against it; ``reasons`` lists what does.

    ``assignments(owner_id, entity_id, connection_id, provider_subject, state)``; ``statuses(owner_id,
    id, connection_id, kind, state)``, of which the smallest id counts; ``newest`` is the newest
    observation of each status, ``(owner_id, entity_id, observation_id, content, coverage,
    provenance)``. States, contents and provenances are JSON. Assignments without a status have no row.
    """
    links = relations.filter("kind = 'has_own_submission_status'").select("owner_id", F.col("from_id").alias("entity_id"), F.col("to_id").alias("status_entity_id"))
    known = statuses.filter("kind = 'own_submission_status'").select("owner_id", F.col("id").alias("status_entity_id"), "connection_id", F.col("state").alias("_status"))
    one = assignments.join(links, ["owner_id", "entity_id"]).join(known, ["owner_id", "connection_id", "status_entity_id"])
    one = one.groupBy("owner_id", "entity_id", "connection_id", "provider_subject", "state").agg(F.min_by(F.struct("status_entity_id", "_status"), "status_entity_id").alias("_f")).select("*", "_f.*").drop("_f")
    seen = newest.select("owner_id", F.col("entity_id").alias("status_entity_id"), "observation_id", "content", "coverage", "provenance")
    out = one.join(seen, ["owner_id", "status_entity_id"], "left")

    # The attempt stands in the content itself or under ``data``.
    direct = F.get_json_object("content", "$.lastattempt.submission.status").isNotNull()
    submission = F.when(direct, F.get_json_object("content", "$.lastattempt.submission")).otherwise(F.get_json_object("content", "$.data.lastattempt.submission"))
    out = out.withColumns({"_sub": submission, "_subject": F.get_json_object("provenance", "$.subject_userid"), "_me": F.when(F.col("provider_subject") != "", F.col("provider_subject"))})
    author = F.get_json_object("_sub", "$.userid")
    me, subject = F.col("_me"), F.col("_subject")
    by_provenance = F.coalesce(subject == me, F.lit(False))
    by_submission = subject.isNull() & F.coalesce(author == me, F.lit(False))
    differs = lambda path: ~F.coalesce(_number("_status", path) == _number("state", path), F.lit(False))
    against = [
        (F.col("observation_id").isNull(), "no_preserved_observation"),
        (~F.get_json_object("provenance", "$.system").eqNullSafe(F.lit("moodle")), "observation_not_from_moodle"),
        (~F.coalesce(F.col("coverage").isin("complete", "partial"), F.lit(False)), "invalid_observation_coverage"),
        (~F.get_json_object("provenance", "$.connection_id").eqNullSafe(F.col("connection_id").cast("string")), "connection_mismatch"),
        (author.isNotNull() & ~author.eqNullSafe(F.col("provider_subject")), "submission_author_mismatch"),
        (me.isNull(), "connection_subject_unknown"),
        (me.isNotNull() & subject.isNotNull() & ~by_provenance, "observation_author_mismatch"),
        (me.isNotNull() & subject.isNull() & ~by_submission, "author_not_declared"),
        (differs("$.course_id"), "course_id_mismatch"),
        (differs("$.instance_id"), "instance_id_mismatch"),
    ]
    reasons = F.array_compact(F.array(*[F.when(c, name) for c, name in against]))
    basis = F.when(by_provenance, "provenance_subject_userid").when(by_submission, "submission_userid")
    return out.withColumns({"reasons": reasons, "authorship_basis": basis, "status": F.lower(F.get_json_object("_sub", "$.status")), "feedback_available": F.coalesce(F.get_json_object("content", "$.feedback.available") == "true", F.lit(False))}).select(
        "owner_id", "entity_id", "status_entity_id", "observation_id", (F.size("reasons") == 0).alias("qualified"), "reasons", "authorship_basis", "status", "feedback_available"
    )


def consented_reads(reads: DataFrame, grants: DataFrame) -> DataFrame:
    """``reads`` of a user's own submission status with ``refusal`` or ``status``: the newest grant before a read decides.

    ``reads(owner_id, connection_id, seq, account, response)`` and more; ``grants(owner_id, connection_id, seq,
    granted)``, a withdrawal being a grant that is false. An as-of join by sequence: both are one
    table, ordered once per connection. Refused are reads never granted or since ``revoked``, and
    responses that speak of another account (``not_own``). Of a response the last attempt stays, and
    of its feedback only that there is some and when it was graded: no grade, no reviewer.
    """
    keys = ["owner_id", "connection_id"]
    log = grants.select(*keys, "seq", "granted")
    both = reads.withColumn("_read", F.lit(True)).unionByName(log, allowMissingColumns=True)
    # Of a grant and a read at the same place in the sequence the read comes first.
    before = Window.partitionBy(*keys).orderBy("seq", F.col("_read").desc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    out = both.withColumn("_now", F.last("granted", ignorenulls=True).over(before)).filter("_read")
    author = F.get_json_object("response", "$.lastattempt.submission.userid")
    refusal = F.when(F.col("_now").isNull(), "never_granted").when(~F.col("_now"), "revoked").when(author.isNotNull() & (author != F.col("account")), "not_own")
    graded = F.get_json_object("response", "$.feedback.gradeddate").try_cast("long")
    feedback = F.when(F.get_json_object("response", "$.feedback").isNotNull(), F.to_json(F.struct(F.lit(True).alias("available"), F.when(graded > 0, graded).alias("gradeddate"))))
    attempt = F.coalesce(F.get_json_object("response", "$.lastattempt"), F.lit("{}"))
    status = F.concat(F.lit('{"lastattempt":'), attempt, F.coalesce(F.concat(F.lit(',"feedback":'), feedback), F.lit("")), F.lit("}"))
    return out.withColumn("refusal", refusal).withColumn("status", F.when(F.col("refusal").isNull(), status)).drop("_now", "_read", "granted", "response")
