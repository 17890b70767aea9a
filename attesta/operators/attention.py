"""Obligations, deadlines and what deserves attention, from evidence that may disagree."""

from __future__ import annotations

import operator
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.functions.timefn import epoch_instant

HORIZON_DAYS = 7
#: Date fields of an activity and what they mean: fixed values.
DATE_FIELDS = (("allowsubmissionsfromdate", "opens"), ("duedate", "due"), ("cutoffdate", "closes"), ("gradingduedate", "grading"))
#: Fields in which an activity's instructions stand: fixed values.
INSTRUCTION_FIELDS = ("intro", "description", "content")
#: Kinds that are forums, native states that aren't a submission, connection states without access: fixed values.
FORUM_KINDS = ("forum", "discussion")
NOT_SUBMITTED = ("new", "draft", "reopened")
ACCESS_LOST = ("expired", "revoked", "denied")
#: Reports that are themselves reasons to look: fixed values.
NEWS = ("deadline_change", "requirements_change", "feedback_received")


def deadlines_of(entities: DataFrame, keys: Sequence[str], fields=DATE_FIELDS) -> DataFrame:
    """One row per date that is set: epoch seconds, zero and null mean absent."""
    dates = F.array(*[F.struct(F.lit(label).alias("label"), epoch_instant(F.col(f)).alias("at")) for f, label in fields])
    return entities.select(*keys, F.explode(dates).alias("_d")).select(*keys, "_d.label", "_d.at").filter("at is not null")


def deadline_summary(deadlines: DataFrame, keys: Sequence[str], at: str, now: Column, days: int = HORIZON_DAYS) -> DataFrame:
    ahead = F.col(at) >= now
    near = ahead & (F.col(at) <= now + F.expr(f"interval {days} days"))
    return deadlines.groupBy(*keys).agg(F.count_if(~ahead).alias("overdue"), F.count_if(ahead).alias("upcoming"), F.min(F.when(ahead, F.col(at))).alias("nearest"), F.min(F.when(near, F.col(at))).alias("nearest_in_horizon"))


def reply_parents(posts: DataFrame, group: Sequence[str], id_: str, parent: str, author: str) -> DataFrame:
    """Replies with the author that they answer."""
    p = posts.select(*group, F.col(id_).alias(parent), F.col(author).alias("parent_author"))
    return posts.filter(F.col(parent).isNotNull()).join(p, [*group, parent], "left")


def forum_evidence(posts: DataFrame, subject: str | Column, group: Sequence[str] = ("owner_id", "forum_id")) -> DataFrame:
    """Per forum: own topics, own replies to others, distinct colleagues seen and distinct colleagues answered.

    ``posts(owner_id, forum_id, discussion_id, post_id, parent_id, author_id)``; a topic has parent ``0``.
    ``subject`` is the user, or the column of ``posts`` that names the user of each. With ``coverage``
    it also says whether a topic or a reply that counts was seen in part only.
    """
    own = F.col("author_id") == subject
    part = F.coalesce(F.col("coverage") != "complete", F.lit(False)) if "coverage" in posts.columns else F.lit(False)
    topic = own & (F.col("parent_id") == "0")
    topics = posts.groupBy(*group).agg(F.count_if(topic).alias("own_topics"), F.count_distinct(F.when(~own, F.col("author_id"))).alias("colleagues_seen"), F.bool_or(topic & part).alias("partial_topics"))
    replies = reply_parents(posts, [*group, "discussion_id"], "post_id", "parent_id", "author_id").filter(own & (F.col("parent_id") != "0") & (F.col("parent_author") != subject))
    answered = replies.groupBy(*group).agg(F.count("*").alias("own_replies"), F.count_distinct("parent_author").alias("colleagues_answered"), F.bool_or(part).alias("partial_replies"))
    return topics.join(answered, list(group), "left").fillna(0, ["own_replies", "colleagues_answered"])


def _verdict(kind: Column, several: Column, n: Column, most: Column, need: Column, proof: Callable[[str], Column]) -> Column:
    """``(verdict, reason)`` of a requirement: ``n`` reports count for it, the best of them names ``most`` colleagues; ``proof`` gives a kind of evidence of the entity."""
    count = lambda c: F.coalesce(proof(c), F.lit(0))
    yes = lambda c: F.coalesce(c, F.lit(False))
    reported = (n > 0) | (yes(proof("legacy_report")) & ~several)
    acted, refused = count("submit_receipts") > 0, yes(proof("native_status").isin(*NOT_SUBMITTED))
    of = lambda state, reason=None: F.struct(F.lit(state).alias("verdict"), (F.lit(reason) if reason else F.lit(None).cast("string")).alias("reason"))
    unclear = of("uncertain", "multiple_obligations_require_specific_evidence")
    nobody = of("uncertain", "connection_subject_unknown")
    ladders = {
        "submission": F.when(reported & refused, of("uncertain", "user_report_contradicts_native_status"))
        .when(acted & refused, of("uncertain", "receipt_contradicts_native_status"))
        .when(several & ~reported, unclear)
        .when(reported | acted | yes(proof("native_status") == "submitted"), of("satisfied"))
        .when(refused, of("pending", "native_status_reports_not_submitted"))
        .otherwise(of("pending")),
        "forum_topic": F.when(several & (n == 0), unclear)
        .when((count("publications") + count("topic_receipts") > 0) | (n > 0), of("satisfied"))
        .when(~yes(proof("forum_known")), nobody)
        .otherwise(of("pending", "no_preserved_owner_publication")),
        "forum_reply": F.when(several & (most < need), unclear)
        .when((count("colleagues_answered") >= need) | (most >= need), of("satisfied"))
        .when(~yes(proof("forum_known")), nobody)
        .otherwise(of("pending", "distinct_colleagues_below_required")),
        "completion": F.when(several & (n == 0), unclear).when(yes(proof("native_completion")) | (n > 0), of("satisfied")).otherwise(of("pending")),
    }
    out = F.when(n > 0, of("satisfied")).otherwise(of("pending", "manual_confirmation_pending"))
    for name, ladder in ladders.items():
        out = F.when(kind == name, ladder).otherwise(out)
    return out


def assess(requirements: DataFrame, reports: DataFrame, evidence: DataFrame, keys: Sequence[str] = ("owner_id", "entity_id")) -> DataFrame:
    """``verdict`` and ``reasons`` of each requirement ``(keys, requirement_key, fulfilment, at_least)``.

    ``reports(keys, event_type, requirement_key, distinct_colleagues)`` are the user's own. One that
    names no requirement counts only where the entity has a single one of that fulfilment: it isn't
    guessed which is meant. ``evidence``, a row an entity: ``submit_receipts, topic_receipts,
    publications, colleagues_answered, forum_known, native_status, native_completion,
    legacy_report, partial``. A report and a native state that contradict each other stay apart:
    the verdict is ``uncertain``. Proof from partial coverage stays proof, and is marked.
    """
    keys = list(keys)
    told = reports.groupBy(*keys, F.col("event_type").alias("_type"), "requirement_key").agg(F.count("*").alias("n"), F.max(F.coalesce("distinct_colleagues", F.lit(1))).alias("most"))
    named = told.filter("requirement_key is not null").select(*keys, "_type", "requirement_key", F.col("n").alias("_kn"), F.col("most").alias("_km"))
    loose = told.filter("requirement_key is null").select(*keys, "_type", F.col("n").alias("_ln"), F.col("most").alias("_lm"))
    kind = F.col("fulfilment")
    rows = requirements.withColumns({"fulfilment": F.coalesce("fulfilment", F.lit("manual"))}).withColumn("family_size", F.count("*").over(Window.partitionBy(*keys, "fulfilment")))
    rows = rows.withColumn("_type", F.when(kind == "manual", "completion").otherwise(kind)).join(named, [*keys, "_type", "requirement_key"], "left").join(loose, [*keys, "_type"], "left").join(evidence, keys, "left")
    several = F.col("family_size") > 1
    free = ~several & (kind != "manual")
    n = F.coalesce("_kn", F.lit(0)) + F.when(free, F.coalesce("_ln", F.lit(0))).otherwise(0)
    most = F.greatest(F.coalesce("_km", F.lit(0)), F.when(free, F.coalesce("_lm", F.lit(0))).otherwise(0))
    yes = lambda c: F.coalesce(c, F.lit(False))
    out = _verdict(kind, several, n, most, F.coalesce("at_least", F.lit(1)), F.col)
    marked = F.when(yes("partial") & kind.isin("submission", "forum_topic", "forum_reply"), F.lit("positive_proof_from_partial_coverage"))
    rows = rows.withColumn("_v", out).withColumns({"verdict": F.col("_v.verdict"), "reasons": F.array_compact(F.array(F.col("_v.reason"), marked))})
    return rows.select(*requirements.columns, "family_size", "verdict", "reasons")


def assess_entity(assessed: DataFrame, entities: DataFrame, keys: Sequence[str] = ("owner_id", "entity_id")) -> DataFrame:
    """Per entity ``state, requirements`` and ``state_reasons``.

    Uncertain if any requirement is, concluded if all are satisfied, else pending. Without
    requirements ``entities(keys, kind, submission_evidence, completion_evidence)`` decides: a forum
    is uncertain, an assignment is concluded by evidence of a submission, others by completion.
    """
    keys = list(keys)
    found = assessed.groupBy(*keys).agg(
        F.count("*").alias("requirements"),
        F.when(F.bool_or(F.col("verdict") == "uncertain"), "uncertain").when(F.bool_and(F.col("verdict") == "satisfied"), "concluded").otherwise("pending").alias("_state"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list(F.when(F.col("verdict") == "uncertain", F.col("reasons")))))).alias("_reasons"),
        F.bool_or(F.exists("reasons", lambda r: r.endswith("_contradicts_native_status"))).alias("contradiction"),
    )
    forum, work = F.col("kind").isin(*FORUM_KINDS), F.col("kind") == "assignment"
    handed, done = F.coalesce("submission_evidence", F.lit(False)), F.coalesce("completion_evidence", F.lit(False))
    alone = F.when(forum, "uncertain").when(F.when(work, handed).otherwise(done), "concluded").otherwise("pending")
    why = F.when(forum, F.array(F.lit("requirement_not_interpreted"))).when(work & ~handed, F.array(F.lit("submission_evidence_missing"))).otherwise(F.array().cast("array<string>"))
    out = entities.join(found, keys, "left")
    return out.select(*keys, "kind", "submission_evidence", F.coalesce("requirements", F.lit(0)).cast("long").alias("requirements"), F.coalesce("_state", alone).alias("state"), F.coalesce("_reasons", why).alias("state_reasons"), F.coalesce("contradiction", F.lit(False)).alias("contradiction"))


#: The fields of a content that are compared or dated, read from its JSON at once, each as text.
_FIELDS = ", ".join(f"{f} string" for f in [*(f for f, _ in DATE_FIELDS), *INSTRUCTION_FIELDS])


def _differs(fields: Sequence[str]) -> Column:
    return reduce(operator.or_, [~F.col(f"fields.{f}").eqNullSafe(F.col(f"previous_fields.{f}")) for f in fields])


def attention_items(audit: bool = True) -> Column:
    """The reasons to look at an entity, sorted, as an array; without ``audit`` only those that call for something.

    The row has ``kind, content_hash, fields, previous_hash, previous_fields, presented_hash, read_hash, coverage, connection_state, near_at, state, requirements, submission_evidence,
    contradiction, status_qualified, feedback_available, drift, news (array), changed_materials``.
    """
    there = lambda c: F.col(c).isNotNull()
    fresh = there("previous_hash") & ~F.col("presented_hash").eqNullSafe(F.col("content_hash"))
    forum = F.col("kind").isin(*FORUM_KINDS)
    rules = [
        ("deadline_changed", fresh & _differs([f for f, _ in DATE_FIELDS])),
        ("instructions_changed", fresh & _differs(INSTRUCTION_FIELDS)),
        *[(n, F.array_contains("news", n)) for n in NEWS],
        ("feedback_available", F.col("status_qualified") & F.col("feedback_available")),
        ("not_presented", F.col("presented_hash").isNull() & F.lit(audit)),
        ("changed_since_presented", F.col("presented_hash") != F.col("content_hash")),
        ("changed_since_read", F.col("read_hash") != F.col("content_hash")),
        ("access_lost", F.col("connection_state").isin(*ACCESS_LOST)),
        ("incomplete_coverage", F.col("coverage") != "complete"),
        ("deadline_near", there("near_at") & (F.lit(audit) | (F.col("state") != "concluded"))),
        ("requirement_not_interpreted", forum & (F.col("requirements") == 0)),
        ("submission_evidence_missing", (F.col("kind") == "assignment") & ~F.coalesce("submission_evidence", F.lit(False))),
        ("academic_uncertain", F.col("state") == "uncertain"),
        ("own_submission_status_unqualified", ~F.col("status_qualified")),
        ("report_observation_contradiction", F.col("contradiction")),
        ("unrecorded_reobservation", F.col("drift")),
        ("material_dependency_changed", F.coalesce("changed_materials", F.lit(0)) > 0),
    ]
    return F.sort_array(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules])))


#: What counts as evidence of an entity: how several rows of it are put together, and its type.
PROOFS = {
    "submit_receipts": (F.sum, "long"),
    "topic_receipts": (F.sum, "long"),
    "receipts": (F.sum, "long"),
    "publications": (F.sum, "long"),
    "partial_publications": (F.max, "boolean"),
    "colleagues_answered": (F.max, "long"),
    "partial_replies": (F.max, "boolean"),
    "forum_known": (F.max, "boolean"),
    "native_status": (F.max, "string"),
    "native_completion": (F.max, "boolean"),
    "legacy_report": (F.max, "boolean"),
    "partial": (F.max, "boolean"),
    "status_qualified": (F.max, "boolean"),
    "feedback_available": (F.max, "boolean"),
    "drift": (F.max, "boolean"),
    "changed_materials": (F.sum, "long"),
}
_KEYS = ["owner_id", "entity_id"]
#: Which reasons are a contradiction, and what else is noted of a requirement: fixed values.
CONTRADICTIONS = ("user_report_contradicts_native_status", "receipt_contradicts_native_status")
_MARKED, _STALE = "positive_proof_from_partial_coverage", "requirement_source_changed_requires_review"


def facts(entities: DataFrame, occurrences: DataFrame, requirements: DataFrame, reports: DataFrame, evidence: DataFrame, marks: DataFrame, implied: bool = False) -> DataFrame:
    """A row for each entity with all that is known of it, put together in one aggregate.

    Every input becomes rows of one table that differ in the columns they fill: sightings are reduced to
    the newest and the one before it, reports to counts by type and requirement, and requirements
    are listed with ``needs``. Their union is dealt by entity once, so no two inputs are joined.
    ``implied``: an assignment without a requirement has one, to be submitted.
    """
    column = lambda df, name, kind: (F.col(name) if name in df.columns else F.lit(None)).cast(kind)
    # One sort: the newest sighting of an entity leads, the first behind it that is older and differs is the one before.
    order = Window.partitionBy(*_KEYS).orderBy(F.desc("observed_at"), F.desc("content_hash"), F.desc("coverage"))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = occurrences.select(*_KEYS, "observed_at", "content_hash", "coverage", "content").withColumns({"rn": F.row_number().over(order), "_at": F.first("observed_at").over(whole), "_hash": F.first("content_hash").over(whole)})
    earlier = (F.col("observed_at") < F.col("_at")) & (F.col("content_hash") != F.col("_hash"))
    before = F.first(F.when(earlier, F.struct(F.col("content_hash").alias("hash"), "content")), ignorenulls=True)
    seen = seen.withColumn("previous", before.over(whole)).filter("rn = 1")
    parts = [
        seen.select(*_KEYS, F.struct(F.col("observed_at").alias("at"), F.col("content_hash").alias("hash"), "coverage", "content").alias("newest"), "previous"),
        requirements.select(*_KEYS, F.struct(F.coalesce("fulfilment", F.lit("manual")).alias("type"), F.col("requirement_key").alias("key"), F.coalesce("at_least", F.lit(1)).cast("int").alias("at_least"), column(requirements, "source_hash", "string").alias("source_hash"), F.lit(True).alias("stated")).alias("need")),
        reports.groupBy(*_KEYS, F.col("event_type").alias("type"), F.col("requirement_key").alias("key")).agg(F.count("*").alias("n"), F.max(F.coalesce(column(reports, "distinct_colleagues", "int"), F.lit(1))).alias("most")).select(*_KEYS, F.struct("type", "key", "n", "most").alias("told")),
        entities.select("owner_id", F.col("id").alias("entity_id"), F.struct("kind", "title", "connection_state", column(entities, "provider_record", "string").alias("provider_record")).alias("about")),
        evidence.select(*_KEYS, *[F.col(c).cast(PROOFS[c][1]).alias(c) for c in PROOFS if c in evidence.columns]),
        marks.select(*_KEYS, F.struct("presented_hash", "read_hash").alias("mark")),
    ]
    if implied:
        parts.append(entities.filter("kind = 'assignment'").select("owner_id", F.col("id").alias("entity_id"), F.struct(F.lit("submission").alias("type"), F.lit("submission").alias("key"), F.lit(1).alias("at_least"), F.lit(None).cast("string").alias("source_hash"), F.lit(False).alias("stated")).alias("need")))
    rows = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)
    rows = rows.withColumns({c: F.lit(None).cast(kind) for c, (_, kind) in PROOFS.items() if c not in rows.columns})
    first = [F.max(c).alias(c) for c in ("about", "newest", "previous", "mark")]
    # Few rows of an entity are left, so they are dealt as they are: a partial aggregate would hold most of them.
    out = rows.repartition(*_KEYS).groupBy(*_KEYS).agg(*first, F.collect_list("need").alias("needs"), F.collect_list("told").alias("told"), *[how(c).alias(c) for c, (how, _) in PROOFS.items()]).filter("about is not null")
    # A requirement that is implied counts only where none is stated.
    return out.withColumn("needs", F.when(F.exists("needs", lambda x: x["stated"]), F.filter("needs", lambda x: x["stated"])).otherwise(F.col("needs")))


def _judged(rows: DataFrame) -> DataFrame:
    """``facts`` with ``judged``: of each requirement its ``verdict`` and ``reason``, how many reports count for it, and whether it is ``marked`` as partial or rests on a ``stale`` source."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))

    def counted(x: Column) -> Column:
        kind, several = x["type"], F.size(F.filter("needs", lambda y: y["type"] == x["type"])) > 1
        # What needs a confirmation takes a report of completion that names it; others take one that names none too, if they are the only one of their kind.
        named = F.filter("told", lambda t: (t["type"] == F.when(kind == "manual", "completion").otherwise(kind)) & (t["key"].eqNullSafe(x["key"]) | t["key"].isNull() & (kind != "manual")))
        return F.struct(kind.alias("type"), x["key"].alias("key"), x["at_least"].alias("at_least"), x["source_hash"].alias("source_hash"), x["stated"].alias("stated"), several.alias("several"), named.alias("named"))

    def summed(x: Column) -> Column:
        fits = lambda t: t["key"].isNotNull() | ~x["several"]
        n = F.aggregate(x["named"], F.lit(0).cast("long"), lambda a, t: a + F.when(fits(t), t["n"]).otherwise(0))
        most = F.aggregate(x["named"], F.lit(0), lambda a, t: F.greatest(a, F.when(fits(t), t["most"])))
        return F.struct(x["type"].alias("type"), x["key"].alias("key"), x["at_least"].alias("at_least"), x["source_hash"].alias("source_hash"), x["stated"].alias("stated"), x["several"].alias("several"), n.alias("n"), most.alias("most"))

    def judge(x: Column) -> Column:
        kind = x["type"]
        marked = yes("partial") & kind.isin("submission", "forum_topic", "forum_reply") | yes("partial_publications") & (kind == "forum_topic") | yes("partial_replies") & (kind == "forum_reply")
        # The statement was read from another content than the newest: someone has to look again.
        stale = F.coalesce(x["source_hash"] != F.col("newest.hash"), F.lit(False))
        return F.struct(_verdict(kind, x["several"], x["n"], x["most"], x["at_least"], F.col).alias("v"), kind.alias("type"), x["key"].alias("key"), x["at_least"].alias("at_least"), x["stated"].alias("stated"), x["n"].alias("n"), x["several"].alias("several"), marked.alias("marked"), stale.alias("stale"))

    # Three passes over the list, so that what a verdict looks at several times is computed once.
    return rows.withColumn("judged", F.transform(F.transform(F.transform("needs", counted), summed), judge))


_UNCLEAR = lambda j: j["stale"] | (j["v"]["verdict"] == "uncertain")


def requirement_evidence(rows: DataFrame) -> DataFrame:
    """Stated requirements of ``facts`` with their verdict and what it rests on.

    ``evidence`` lists ``basis`` and ``n``; ``reconciliation`` says that a report or receipt and the native
    state contradict each other and are kept apart; a reply that is short of colleagues has
    ``required_at_least`` and ``observed_distinct_colleagues``.
    """
    out = _judged(rows).withColumn("j", F.explode("judged")).filter("j.stated").select("*", "j.*")
    kind, reason = F.col("type"), F.col("v.reason")
    reasons = F.array_compact(F.array(reason, F.when(F.col("marked"), _MARKED), F.when(F.col("stale"), _STALE)))
    verdict = F.when(F.col("stale"), "uncertain").otherwise(F.col("v.verdict"))
    count = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("long")
    found = [
        ("user_report_delta", F.lit(True), F.col("n")),
        ("legacy_state_user_report", kind == "submission", F.when(~F.col("several") & (F.col("n") == 0), flag("legacy_report")).otherwise(0)),
        ("confirmed_academic_action", kind.isin("submission", "forum_topic"), F.when(kind == "submission", count("submit_receipts")).otherwise(count("topic_receipts"))),
        ("own_submission_status", kind == "submission", F.col("status_qualified").isNotNull().cast("long")),
        ("forum_publication", kind == "forum_topic", count("publications")),
        ("forum_reply", kind == "forum_reply", count("colleagues_answered")),
        ("native_completion", kind == "completion", flag("native_completion")),
    ]
    items = F.filter(F.array(*[F.struct(F.lit(b).alias("basis"), F.when(on, n).otherwise(0).cast("long").alias("n")) for b, on, n in found]), lambda x: x["n"] > 0)
    short, apart = F.coalesce(reason == "distinct_colleagues_below_required", F.lit(False)), reason.isin(*CONTRADICTIONS)
    return out.select(
        *_KEYS, F.col("key").alias("requirement_key"), kind.alias("fulfilment"), verdict.alias("verdict"), reasons.alias("reasons"), items.alias("evidence"), F.when(apart, F.lit("keep_report_and_native_observation_separate")).alias("reconciliation"),
        F.when(short, F.col("at_least")).alias("required_at_least"), F.when(short, count("colleagues_answered")).alias("observed_distinct_colleagues"),
    )


def overview(entities: DataFrame, occurrences: DataFrame, requirements: DataFrame, reports: DataFrame, evidence: DataFrame, marks: DataFrame, now: Column, audit: bool = True, days: int = HORIZON_DAYS, implied: bool = False) -> DataFrame:
    """Entities with their state, newest and previous content, and their attention items as an array.

    ``entities(owner_id, id, kind, title, connection_state)``, with ``provider_record`` (JSON) if the source's
    current record is known: where it isn't the newest content it holds and the entity has drifted;
    ``occurrences`` with ``coverage`` and ``content`` (JSON); ``evidence`` holds any of ``PROOFS``, in as many
    rows an entity as there are sources; ``marks(owner_id, entity_id, presented_hash, read_hash)``. One
    shuffle by entity for all inputs. Pages are cut from it afterwards.
    """
    out = _judged(facts(entities, occurrences, requirements, reports, evidence, marks, implied))
    unclear = F.filter("judged", _UNCLEAR)
    why = F.transform(unclear, lambda j: F.array(j["v"]["reason"], F.when(j["marked"], _MARKED), F.when(j["stale"], _STALE)))
    told = lambda name: F.exists("told", lambda t: t["type"] == name)
    out = out.select(
        *_KEYS, "about.*", "newest", "previous", "mark.*", F.size(F.filter("needs", lambda x: x["stated"])).cast("long").alias("requirements"), F.size("judged").alias("judged"),
        (F.size(unclear) > 0).alias("unclear"), F.forall("judged", lambda j: j["v"]["verdict"] == "satisfied").alias("fulfilled"), F.sort_array(F.array_distinct(F.array_compact(F.flatten(why)))).alias("reasons"),
        F.exists("judged", lambda j: F.coalesce(j["v"]["reason"].isin(*CONTRADICTIONS), F.lit(False))).alias("contradiction"), told("submission").alias("handed"), told("completion").alias("done"),
        F.array_distinct(F.transform(F.filter("told", lambda t: t["type"].isin(*NEWS)), lambda t: t["type"])).alias("news"), *PROOFS,
    )
    yes = lambda c: F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(False))
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    submitted = yes("handed") | yes("legacy_report") | (count("submit_receipts") + count("receipts") > 0) | yes(F.col("native_status") == "submitted")
    finished = yes("native_completion") | yes("done")
    forum, work = F.col("kind").isin(*FORUM_KINDS), F.col("kind") == "assignment"
    alone = F.when(forum, "uncertain").when(F.when(work, submitted).otherwise(finished), "concluded").otherwise("pending")
    why = F.when(forum, F.array(F.lit("requirement_not_interpreted"))).when(work & ~submitted, F.array(F.lit("submission_evidence_missing"))).otherwise(F.array().cast("array<string>"))
    some = F.col("judged") > 0
    state = F.when(~some, alone).when(F.col("unclear"), "uncertain").when(F.col("fulfilled"), "concluded").otherwise("pending")
    record = F.get_json_object("provider_record", "$")
    drifted = F.col("provider_record").isNotNull() & F.coalesce(record != F.get_json_object("newest.content", "$"), F.lit(False))
    out = out.withColumns({
        "state": state, "state_reasons": F.when(some, F.col("reasons")).otherwise(why), "submission_evidence": submitted, "contradiction": yes("contradiction"), "drift": yes("drift") | drifted,
        "content_hash": F.col("newest.hash"), "observed_at": F.col("newest.at"), "coverage": F.col("newest.coverage"), "content": F.when(drifted, F.col("provider_record")).otherwise(F.coalesce("newest.content", "provider_record")),
        "previous_hash": F.col("previous.hash"), "previous_fields": F.from_json("previous.content", _FIELDS),
    }).withColumn("fields", F.from_json("content", _FIELDS))
    dates = F.array_compact(F.array(*[epoch_instant(F.col(f"fields.{f}").try_cast("long")) for f, _ in DATE_FIELDS]))
    near = F.filter(dates, lambda d: (d >= now) & (d <= now + F.expr(f"interval {days} days")))
    out = out.withColumns({"due_at": epoch_instant(F.col("fields.duedate").try_cast("long")), "near_at": F.array_min(near)})
    out = out.withColumn("items", attention_items(audit))
    return out.select(*_KEYS, "kind", "title", "state", "state_reasons", "requirements", "content_hash", "previous_hash", "observed_at", "coverage", "due_at", "near_at", "items")


def dependency_drift(drafts: DataFrame, newest: DataFrame) -> DataFrame:
    """References of drafts ``(draft_id, entity_id, base_hash)``: unchanged, changed or unobserved since the draft began."""
    now = newest.select("entity_id", F.col("content_hash").alias("_now"))
    return drafts.join(now, "entity_id", "left").withColumn("drift", F.when(F.col("_now").isNull(), "unobserved").when(F.col("_now") == F.col("base_hash"), "unchanged").otherwise("changed")).drop("_now")
