import datetime as dt

import pytest
from pyspark.sql import functions as F

from attesta.plans import catalog
from attesta.schema import ENTITY, FILE, OCCURRENCE, RELATION

DAY = lambda d: dt.datetime(2026, 1, d)


@pytest.fixture(scope="module")
def world(spark):
    entities = spark.createDataFrame([("o", "a", "c", "assignment", "1", "Essay", '{"duedate":1767744000}'), ("o", "r", "c", "resource", "2", "Reader", '{"v": 1}')], ENTITY)
    seen = spark.createDataFrame([("o", "a", "h1", DAY(1), DAY(1), "complete", "{}", '{"x":1}'), ("o", "a", "h2", DAY(2), DAY(2), "denied", "{}", '{"x":2}'), ("o", "r", "h3", DAY(1), DAY(1), "complete", "{}", '{"v":1}')], OCCURRENCE)
    rel = spark.createDataFrame([("o", "a", "r", "required", "{}")], RELATION)
    files = spark.createDataFrame([("o", "f1", "r", "x.pdf", "s1", 10, None, "s1", '{"pages":[1],"status":"ok"}'), ("o", "f2", "r", "y.pdf", "s1", 10, None, "s1", "{}")], FILE)
    return entities, seen, rel, files


def test_overview_items(spark, world):
    entities, seen, _, _ = world
    entities = entities.withColumn("connection_state", F.when(F.col("id") == "a", "expired").otherwise("connected"))
    seen = seen.withColumn("content", F.when(F.col("content_hash") == "h1", '{"duedate":1767657600,"intro":"x"}').when(F.col("content_hash") == "h2", '{"duedate":1767744000,"intro":"x"}').otherwise(F.col("content")))
    keys = "owner_id string, entity_id string"
    needs = spark.createDataFrame([("o", "a", "1", "submission", None)], f"{keys}, requirement_key string, fulfilment string, at_least int")
    reports = spark.createDataFrame([("o", "a", "submission", None, None), ("o", "a", "requirements_change", None, None)], f"{keys}, event_type string, requirement_key string, distinct_colleagues int")
    kinds = "submit_receipts int, topic_receipts int, publications int, colleagues_answered int, forum_known boolean, native_status string, native_completion boolean, legacy_report boolean, partial boolean, status_qualified boolean, feedback_available boolean, drift boolean, changed_materials int"
    evidence = spark.createDataFrame([("o", "a", 0, 0, 0, 0, True, "new", False, False, False, True, True, True, 1), ("o", "r", 0, 0, 0, 0, True, None, False, False, False, False, None, False, 0)], f"{keys}, {kinds}")
    marks = spark.createDataFrame([("o", "a", "h1", "h1")], f"{keys}, presented_hash string, read_hash string")
    page = lambda **kw: {r.entity_id: (r.state, set(r["items"])) for r in catalog.attention_page(entities, seen, needs, reports, evidence, marks, F.expr("timestamp '2026-01-05'"), **kw).collect()}
    both = {"deadline_changed", "requirements_change", "feedback_available", "changed_since_presented", "changed_since_read", "access_lost", "incomplete_coverage", "deadline_near", "academic_uncertain", "report_observation_contradiction", "unrecorded_reobservation", "material_dependency_changed"}
    out = page()
    assert out["a"] == ("uncertain", both)
    assert out["r"] == ("pending", {"not_presented", "own_submission_status_unqualified"})
    assert page(audit=False)["r"][1] == {"own_submission_status_unqualified"}


def test_unknown_coverage_is_worst(spark):
    rows = spark.createDataFrame([("j", "complete", True), ("j", "strange", False), ("k", "complete", True)], "job string, coverage string, truncated boolean")
    assert {r.job: r.coverage for r in catalog.coverage_of(rows, ["job"]).collect()} == {"j": "strange", "k": "partial"}


def test_synthetic_contexts(spark):
    scopes = [{"environment": "synthetic-host-lab"}, {"purpose": "acceptance-test"}, {"purpose": "validation", "surface": "mobile", "run": "2026-01-02-skill-1.2.3"}, {"purpose": "validation", "surface": "mobile", "run": "x"}, {"purpose": "probe"}, {}]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(scopes)], "i int, scope map<string,string>")
    assert [r[0] for r in df.orderBy("i").select(catalog.synthetic()).collect()] == [True, True, True, False, False, False]


def test_entity_context_compares_structure(world):
    entities, seen, rel, _ = world
    node, newest, edges = catalog.entity_context(entities, seen, rel, "r")
    assert node.first().matches_latest is True and newest.count() == 1 and edges.count() == 1


def test_files_and_package(spark, world):
    entities, _, rel, files = world
    assert {r.extraction for r in catalog.files_page(files).collect()} == {'{"status":"ok"}', "{}"}
    focal = spark.createDataFrame([("o", "a")], "owner_id string, activity_id string")
    r = catalog.study_package(rel, entities, files, focal).first()
    assert (r.material_id, r.relation, r.selection_required) == ("r", "required", True)
    con = spark.createDataFrame([("o", "c", "moodle")], "owner_id string, id string, provider string")
    assert [x.available for x in catalog.library(files, entities, con).collect()] == [True, True]


def test_usage_counts_shared_bytes_once(spark, world):
    _, _, _, files = world
    blobs = spark.createDataFrame([("o", "s1", 10)], "owner_id string, sha256 string, bytes long")
    r = catalog.usage(files, blobs, {"files": files}).first()
    assert (r.files, r.preserved, r.stored, r.saved) == (2, "20", "10", "10")


def test_a_cut_is_never_complete(spark):
    df = spark.createDataFrame([("j", "complete", True), ("j", "complete", False), ("k", "complete", False)], "job string, coverage string, truncated boolean")
    assert {r.job: r.coverage for r in catalog.coverage_of(df, ["job"]).collect()} == {"j": "partial", "k": "complete"}


def test_synthetic_contexts_are_left_out(spark):
    ctx = spark.createDataFrame([("1", {"environment": "test"}, DAY(1)), ("2", {"course": "x"}, DAY(2))], "id string, scope map<string,string>, updated_at timestamp")
    deltas = spark.createDataFrame([("d", "2", DAY(2), 1, "about essays")], "id string, context_id string, recorded_at timestamp, version int, content string")
    page, own = catalog.contexts(ctx, deltas)
    assert [r.id for r in page.collect()] == ["2"] and own.count() == 1
    assert catalog.history(deltas, "2").count() == 1
    assert catalog.find(deltas, spark.createDataFrame([], ENTITY), "ESSAYS about")[0].count() == 1
