"""Whose submission a preserved state speaks of, and which rights an entry has."""

import json

from attesta.operators import graph, qualification, requests

ASSIGNMENT = "owner_id string, entity_id string, connection_id string, provider_subject string, state string"
REL = "owner_id string, from_id string, to_id string, kind string"
STATUS = "owner_id string, id string, connection_id string, kind string, state string"
SEEN = "owner_id string, entity_id string, observation_id string, content string, coverage string, provenance string"
IDS = json.dumps({"course_id": 3, "instance_id": 4})
GOOD = {"system": "moodle", "connection_id": "c", "subject_userid": 7}


def status(spark, subject="7", provenance=GOOD, userid=7, ids=IDS, coverage="complete", nested=False, seen=True):
    attempt = {"lastattempt": {"submission": {"status": "Submitted"} | ({} if userid is None else {"userid": userid})}}
    a = spark.createDataFrame([("o", "a", "c", subject, IDS)], ASSIGNMENT)
    rel = spark.createDataFrame([("o", "a", "s2", "has_own_submission_status"), ("o", "a", "s1", "has_own_submission_status")], REL)
    st = spark.createDataFrame([("o", s, "c", "own_submission_status", ids) for s in ("s1", "s2")], STATUS)
    rows = [("o", "s1", "x", json.dumps({"data": attempt} if nested else attempt), coverage, json.dumps(provenance))] if seen else []
    return qualification.own_submission_status(a, rel, st, spark.createDataFrame(rows, SEEN)).first()


def test_a_qualified_status(spark):
    r = status(spark)
    assert (r.qualified, r.reasons, r.authorship_basis, r.status, r.status_entity_id) == (True, [], "provenance_subject_userid", "submitted", "s1")
    assert status(spark, nested=True).status == "submitted"
    assert status(spark, provenance={k: v for k, v in GOOD.items() if k != "subject_userid"}).authorship_basis == "submission_userid"


def test_every_reason_against_it_is_listed(spark):
    assert status(spark, subject=None).reasons == ["submission_author_mismatch", "connection_subject_unknown"]
    assert status(spark, subject="8").reasons == ["submission_author_mismatch", "observation_author_mismatch"]
    assert status(spark, provenance={"system": "host", "connection_id": "d"}, userid=None).reasons == ["observation_not_from_moodle", "connection_mismatch", "author_not_declared"]
    assert status(spark, coverage="denied", ids=json.dumps({"course_id": 3})).reasons == ["invalid_observation_coverage", "instance_id_mismatch"]
    r = status(spark, seen=False)
    assert r.reasons == ["no_preserved_observation", "observation_not_from_moodle", "invalid_observation_coverage", "connection_mismatch", "author_not_declared"] and r.status is None


def test_the_tracker_with_the_smallest_id_counts(spark):
    rel = spark.createDataFrame([("o", "a", "t2", "tracks_completion"), ("o", "a", "t1", "tracks_completion"), ("o", "b", "t3", "tracks_completion")], REL)
    ent = spark.createDataFrame([("o", "t1", "completion_activity", '{"state":1}'), ("o", "t2", "completion_activity", '{"state":0}'), ("o", "t3", "course", '{"state":1}')], "owner_id string, id string, kind string, state string")
    assert [(r.entity_id, r.state, r.timecompleted) for r in qualification.completion_trackers(rel, ent).collect()] == [("a", "1", None)]


def test_rights_follow_the_kinds_of_each_entry(spark):
    p = spark.createDataFrame([("o", "a", "x", "required", ["references", "required"]), ("o", "a", "y", "required", ["required", "suggested"]), ("o", "a", "z", "has_content", ["has_content"])], "owner_id string, activity_id string, material_id string, relation string, kinds array<string>")
    d = spark.createDataFrame([("o", "a", "x", "references", "cc"), ("o", "a", "x", "required", "own"), ("o", "a", "y", "required", "cc"), ("o", "a", "y", "suggested", "own")], "owner_id string, activity_id string, material_id string, kind string, rights string")
    got = {(r.material_id, r.role): (r.rights, r.rights_requires_review) for r in graph.study_entries(p, d).collect()}
    assert got == {("x", "reference"): ("cc", False), ("x", "required"): ("own", False), ("y", "required"): (graph.NO_RIGHTS, True), ("z", "related"): (graph.NO_RIGHTS, False)}


def test_references_of_a_draft_show_that_there_are_too_many(spark):
    uuid = "00000000-0000-4000-8000-00000000000A"
    own = [(f"hub:observation:{uuid}", "v"), (f"hub:observation:{uuid}", ""), ("hub:file:1", "v")]
    drafts = spark.createDataFrame([("d", "x", "e", own)], "draft_id string, context_id string, entity_id string, provenance array<struct<locator:string,version:string>>")
    edges = [("e", f"m{i}", f"o{i}", "h", None, None) for i in range(3)] + [("e", "m9", "o9", "h", "other", None), ("e", "m8", "", "h", None, None)]
    req = spark.createDataFrame(edges, "from_id string, to_id string, observation_id string, content_hash string, context_id string, draft_id string")
    got = [(r.nth, r.basis, r.base_id, r.base_uuid) for r in requests.draft_references(drafts, req, most=2).orderBy("nth").collect()]
    assert got == [(1, "artifact_provenance", uuid, uuid.lower()), (2, "required_material", "o0", None), (3, "required_material", "o1", None)]


def test_resources_are_joined_by_the_ids_that_they_name(spark):
    m = spark.createDataFrame([("o", "c", "a", "3", "4"), ("o", "c", "b", "03", "4"), ("o", "c", "r", "3", "4")], "owner_id string, connection_id string, activity_id string, course_id string, module_id string")
    r = spark.createDataFrame([("o", "c", "3", "4", "r"), ("o", "d", "3", "4", "q"), ("o", "c", "03", "4", "p")], "owner_id string, connection_id string, course_id string, module_id string, id string")
    assert [(x.activity_id, x.resource_id) for x in requests.resources_of(m, r).collect()] == [("a", "r")]
