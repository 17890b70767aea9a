"""Evidence of activities from their sources, and its fold."""

import json

from pyspark.sql import functions as F

from attesta.operators import attention, composition

ACTION = "owner_id string, id string, connection_id string, operation string, target string, snapshot string, external_id string, state string, updated_at timestamp"
ENTITY = "owner_id string, id string, connection_id string, provider_subject string, kind string, title string, connection_state string, state string"


def snap(**target):
    return json.dumps({"connectionId": "c", "operation": composition.SUBMIT, "target": "1/2/3", "content": {"target": target}})


def test_actions_are_confirmed_and_matched(spark):
    own = {"course_id": 1, "cmid": "2", "instance_id": 3}
    rows = [
        ("o", "a1", "c", None, None, snap(**own), None, "succeeded", None),
        ("o", "a2", None, None, None, snap(**own), None, "succeeded", None),
        ("o", "a3", "d", None, None, snap(**own), None, "succeeded", None),
        ("o", "a4", "c", None, None, snap(**own), None, "failed", None),
        ("o", "a5", "c", composition.TOPIC, None, snap(**own, discussion_id=7), None, "succeeded", None),
        ("o", "a6", "c", composition.TOPIC, None, snap(**own, discussion_id=8), None, "succeeded", None),
        ("o", "a7", "c", None, None, "no json", None, "succeeded", None),
        ("p", "a8", "c", None, None, snap(**own), None, "succeeded", None),
        ("o", "a9", "c", None, None, snap(course_id=1, cmid=2), None, "succeeded", None),
    ]
    actions = spark.createDataFrame(rows, ACTION)
    receipts = {r.action_id: r for r in composition.confirmed_actions(actions).collect()}
    assert sorted(receipts) == ["a1", "a2", "a3", "a5", "a6", "a7", "a8", "a9"] and receipts["a2"].connection_id == "c" and receipts["a7"].operation == "" and receipts["a7"].course_id is None and receipts["a1"].cmid == 2.0
    states = [("e1", {"course_id": "1", "coursemodule": 2, "instance_id": 3}), ("e2", {"course_id": 1, "cmid": 2, "instance_id": 3, "discussion_id": 7}), ("e3", {"course_id": 1, "cmid": 2})]
    entities = spark.createDataFrame([("o", i, "c", "5", "assignment", "t", "connected", json.dumps(s)) for i, s in states], ENTITY)
    met = {(r.entity_id, r.action_id) for r in composition.action_receipts(entities, composition.confirmed_actions(actions)).collect()}
    assert met == {("e1", a) for a in ("a1", "a2", "a5", "a6")} | {("e2", a) for a in ("a1", "a2", "a5")}
    proofs = composition.receipt_proofs(composition.action_receipts(entities, composition.confirmed_actions(actions))).groupBy("entity_id").agg(F.sum("submit_receipts"), F.sum("topic_receipts"), F.sum("receipts"))
    assert sorted(map(tuple, proofs.collect())) == [("e1", 2, 2, 4), ("e2", 2, 1, 3)]


def test_states_speak_unless_withdrawn(spark):
    states = {"a": {"user_report": {"delta_id": "d1"}}, "b": {"user_report": {"delta_id": "d2", "reported": False}}, "c": {"user_report": {"delta_id": "d3"}, "completion": True}, "d": {"completion": False}, "e": {}, "f": {"user_report": {}}}
    entities = spark.createDataFrame([("o", i, "c", "5", "assignment", "t", "connected", json.dumps(s)) for i, s in states.items()], ENTITY)
    gone = spark.createDataFrame([("o", "d3"), ("x", "d1"), ("o", "d3")], "owner_id string, delta_id string")
    got = {r.entity_id: (r.legacy_report, r.native_completion) for r in composition.state_proofs(entities, gone).collect()}
    assert {k: v[0] for k, v in got.items()} == {"a": True, "b": False, "c": False, "f": True} and got["c"][1] is True


def test_forum_proofs_know_their_user_and_coverage(spark):
    rows = [("o", "f", "d", "1", "0", "5", "5", "partial"), ("o", "f", "d", "2", "1", "6", "5", "complete"), ("o", "f", "d", "3", "2", "5", "5", "complete"), ("o", "g", "d", "1", "0", "5", None, "complete")]
    posts = spark.createDataFrame(rows, "owner_id string, forum_id string, discussion_id string, post_id string, parent_id string, author_id string, subject string, coverage string")
    (r,) = composition.forum_proofs(posts).collect()
    assert (r.entity_id, r.publications, r.partial_publications, r.colleagues_answered, r.partial_replies, r.forum_known) == ("f", 1, True, 1, False, True)


def fold(spark, needs=(), told=(), proofs=(), seen=(), kind="assignment", record=None, implied=True, marks=()):
    entities = spark.createDataFrame([("o", "e", kind, "t", "connected", record)], "owner_id string, id string, kind string, title string, connection_state string, provider_record string")
    occurrences = spark.createDataFrame([("o", "e", *s) for s in seen], "owner_id string, entity_id string, content_hash string, observed_at int, coverage string, content string").withColumn("observed_at", F.timestamp_seconds("observed_at"))
    requirements = spark.createDataFrame([("o", "e", *n) for n in needs], "owner_id string, entity_id string, requirement_key string, fulfilment string, at_least int, source_hash string")
    reports = spark.createDataFrame([("o", "e", *n) for n in told], "owner_id string, entity_id string, event_type string, requirement_key string, distinct_colleagues int")
    evidence = spark.createDataFrame([("o", "e", *p) for p in proofs], "owner_id string, entity_id string, native_status string, submit_receipts long, native_completion boolean, colleagues_answered long, forum_known boolean")
    mark = spark.createDataFrame([("o", "e", *m) for m in marks], "owner_id string, entity_id string, presented_hash string, read_hash string")
    return entities, occurrences, requirements, reports, evidence, mark, implied


def state(spark, **given):
    *inputs, implied = fold(spark, **given)
    (row,) = attention.overview(*inputs, F.lit("2026-01-01").cast("timestamp"), implied=implied).collect()
    return row


def test_an_assignment_without_requirements_has_one(spark):
    row = state(spark, told=[("submission", None, None)], proofs=[("draft", None, None, None, None)])
    assert (row.state, row.requirements, row.state_reasons) == ("uncertain", 0, ["user_report_contradicts_native_status"]) and "report_observation_contradiction" in row["items"]
    assert state(spark, told=[("submission", None, None)]).state == "concluded"
    assert state(spark, proofs=[(None, 1, None, None, None), (None, 2, True, None, None)]).state == "concluded"
    assert state(spark).state == "pending" and state(spark, kind="forum").state == "uncertain"
    row = state(spark, needs=[("k", "completion", None, None)], told=[("submission", None, None)])
    assert (row.state, row.requirements) == ("pending", 1)


def test_requirements_read_from_older_content_are_uncertain(spark):
    seen = [("h1", 10, "complete", '{"duedate": 1}'), ("h2", 20, "complete", '{"duedate": 2}')]
    needs = [("k", "completion", None, "h1")]
    row = state(spark, needs=needs, told=[("completion", "k", None)], seen=seen)
    assert row.state == "uncertain" and row.state_reasons == ["requirement_source_changed_requires_review"] and (row.content_hash, row.previous_hash) == ("h2", "h1") and "deadline_changed" in row["items"]
    assert state(spark, needs=[("k", "completion", None, "h2")], told=[("completion", "k", None)], seen=seen).state == "concluded"


def test_drift_uses_the_current_record(spark):
    seen = [("h1", 10, "complete", '{"duedate": 1767312000}')]
    row = state(spark, seen=seen, record='{"duedate":1767400000}', marks=[("h1", "h1")])
    assert "unrecorded_reobservation" in row["items"] and row.due_at.isoformat().startswith("2026-01-03")
    assert "unrecorded_reobservation" not in state(spark, seen=seen, record='{ "duedate": 1767312000 }')["items"]


def test_evidence_of_requirements(spark):
    *inputs, implied = fold(spark, needs=[("a", "submission", None, None), ("b", "forum_reply", 3, None), ("m", "manual", None, None), ("n", "manual", None, None)], told=[("submission", None, None), ("submission", "a", None), ("completion", "m", None), ("completion", None, None)], proofs=[("draft", 2, None, 1, True)])
    got = {r.requirement_key: r for r in attention.requirement_evidence(attention.facts(*inputs, implied=implied)).collect()}
    assert got["a"].verdict == "uncertain" and got["a"].reconciliation and [tuple(x) for x in got["a"].evidence] == [("user_report_delta", 2), ("confirmed_academic_action", 2)]
    assert (got["b"].verdict, got["b"].required_at_least, got["b"].observed_distinct_colleagues) == ("pending", 3, 1)
    assert got["m"].verdict == "satisfied" and got["n"].verdict == "pending" and got["n"].reasons == ["manual_confirmation_pending"]
