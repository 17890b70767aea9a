import datetime as dt

from pyspark.sql import functions as F

from attesta.functions import jsonfn, net
from attesta.operators import records

DAY = lambda d: dt.datetime(2026, 1, d)


def test_binding_replaces_a_contexts_targets(spark):
    now = spark.createDataFrame([("c", "a", True), ("c", "b", True), ("d", "a", True)], "context_id string, entity_id string, active boolean")
    out = {(r.context_id, r.entity_id): r.active for r in records.bind(now, spark.createDataFrame([("c", "b"), ("c", "n")], "context_id string, entity_id string")).collect()}
    assert out == {("c", "a"): False, ("c", "b"): True, ("c", "n"): True, ("d", "a"): True}


def test_targets_are_never_picked(spark):
    ctx = spark.createDataFrame([("u",), ("o",), ("m",)], "context_id string")
    b = spark.createDataFrame([("o", "x", True), ("o", "y", False), ("m", "x", True), ("m", "y", True)], "context_id string, entity_id string, active boolean")
    assert {r.context_id: (r.status, r.target_id) for r in records.targets(ctx, b).collect()} == {"u": ("unbound", None), "o": ("unique", "x"), "m": ("ambiguous", None)}


def test_event_goes_to_a_modules_only_child(spark):
    e = spark.createDataFrame([(1, "c", "m1"), (2, "c", "m2"), (3, "c", None), (4, "z", None)], "id int, context_id string, target_entity_id string")
    b = spark.createDataFrame([("c", "t", True)], "context_id string, entity_id string, active boolean")
    kids = spark.createDataFrame([("m1", "k"), ("m2", "k"), ("m2", "l")], "module_id string, entity_id string")
    assert {r.id: (r.resolved_id, r.refusal) for r in records.resolve_event_target(e, b, kids).collect()} == {1: ("k", None), 2: (None, "ambiguous_module"), 3: ("t", None), 4: (None, "unbound")}


def test_requirement_is_recorded_once_per_payload(spark):
    req = spark.createDataFrame([("o", "e", "r", "p1", DAY(1)), ("o", "e", "r", "p1", DAY(2)), ("o", "e", "r", "p2", DAY(3))], "owner_id string, entity_id string, requirement_key string, payload string, recorded_at timestamp")
    known = spark.createDataFrame([], "owner_id string, entity_id string, content_hash string, observed_at timestamp, content string")
    entities, seen = records.record_requirements(req, known)
    assert entities.first().state == "p2" and seen.count() == 2
    assert records.record_requirements(req, seen)[1].count() == 2


def test_marks_hold_to_the_newest_version(spark):
    marks = spark.createDataFrame([("a", "old"), ("b", "old")], "entity_id string, presented_hash string")
    newest = spark.createDataFrame([("a", "h2"), ("b", "h2")], "entity_id string, content_hash string")
    asked = spark.createDataFrame([("a", "h2"), ("b", "h1")], "entity_id string, content_hash string")
    assert {r.entity_id: r.presented_hash for r in records.mark(marks, asked, newest).collect()} == {"a": "h2", "b": "old"}


def test_draft_comparison_needs_evidence(spark):
    drafts = spark.createDataFrame([("p1", "same  text", "me"), ("p2", "x", "me"), ("p3", "x", "me"), ("p4", "x", "me")], "entity_id string, message string, author string")
    seen = spark.createDataFrame([("p1", DAY(1), "h", "complete", "same text", "me"), ("p2", DAY(1), "h", "complete", "y", "me"), ("p3", DAY(1), "h", "complete", "x", "other"), ("p4", DAY(1), "h", "denied", "x", "me")], "entity_id string, observed_at timestamp, content_hash string, coverage string, message string, author string")
    assert {r.entity_id: r.comparison for r in records.observed_text(drafts, seen, "message", "author").collect()} == {"p1": "matches", "p2": "differs", "p3": "other_author", "p4": "no_evidence"}


def test_time_context_reads_the_newest_observation(spark):
    e = spark.createDataFrame([("o", "a", "Essay")], "owner_id string, id string, title string")
    seen = spark.createDataFrame([("o", "a", "h1", DAY(1), '{"duedate":1000}'), ("o", "a", "h2", DAY(2), '{"duedate":1767225600,"cutoffdate":0}')], "owner_id string, entity_id string, content_hash string, observed_at timestamp, content string")
    r = records.time_context(e, seen, ["UTC", "America/Sao_Paulo"], ["duedate", "cutoffdate"]).collect()
    assert len(r) == 1 and [d.local for d in r[0].displays] == ["2026-01-01 00:00:00", "2025-12-31 21:00:00"]


def test_json_helpers(spark):
    doc = '{"a":{"Token":"x","u":"http://h/?wstoken=abc&x=1"},"f":[true,null,2]}'
    tree = '[{"id":5,"modname":"page","contents":[{"file_id":"z"}]},{"id":6,"modname":"url","contents":[{"deep":{"file_id":"f"}}]}]'
    r = spark.createDataFrame([(doc, tree, "f")], "d string, t string, f string").select(jsonfn.redacted("d").alias("r"), jsonfn.flat_params("d").alias("p"), jsonfn.module_of_file("t", "f").alias("m")).first()
    assert r.r == '{"a":{"u":"http://h/?wstoken=[REDACTED]&x=1"},"f":[true,null,2]}'
    assert r.p == ["a[Token]=x", "a[u]=http://h/?wstoken=abc&x=1", "f[0]=1", "f[2]=2"] and r.m == "6"


def test_public_addresses(spark):
    rows = ["8.8.8.8", "10.0.0.1", "127.0.0.1", "::1", "2606:4700::1111", "::ffff:10.1.1.1", "224.0.0.1", "not an ip", None, "169.254.1.1", "100.64.0.1"]
    df = spark.createDataFrame([(a,) for a in rows], "a string")
    assert [r[0] for r in df.select(net.is_public_ip(F.col("a"))).collect()] == [True, False, False, False, True, False, False, False, None, False, False]
