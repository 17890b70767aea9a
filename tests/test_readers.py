"""Readers of every function, and an ingest that may be run again."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from attesta.sources import readers
from attesta.sources.captures import CAPTURE


def captures(spark, *rows):
    return spark.createDataFrame([(f, json.dumps(p) if p is not None else None, r if isinstance(r, str) or r is None else json.dumps(r), datetime(2026, 1, d)) for f, p, r, d in rows], CAPTURE)


@pytest.mark.parametrize("name", readers.READERS)
def test_every_function_has_its_items(spark, name):
    how = readers.READERS[name]
    item = {how.key: 7, how.title: "T", "extra": {"deep": [1, None]}}
    params = {"courseid": 3, "forumid": 3, "feedbackid": 3, "discussionid": 3}
    if how.parent and how.parent[0] != "?":
        item[how.parent] = 3
    if name == "assignments":
        response = {"courses": [{"id": 3, "assignments": [{"id": 7, "name": "T", "extra": {"deep": [1, None]}}]}]}
    elif name == "course_completion":
        response = {"completionstatus": {"name": "T", "extra": {"deep": [1, None]}}}
    else:
        response = {how.envelope: [item]} if how.envelope else [item]
    (row,) = readers.read(captures(spark, (name, params, response, 1)), name).collect()
    assert (row.coverage, row.kind, row.title, row.external_id) == ("complete", how.kind, "T", "3" if name == "course_completion" else "7")
    assert row.parent_id == (None if how.parent is None else "3") and json.loads(row.item)["extra"] == {"deep": [1, None]}


def test_odd_responses_are_a_coverage(spark):
    odd = [("pages", None, r, i + 1) for i, r in enumerate(['{"pages": {}}', "null", "no json", '{"pages": []}', '{"pages": [{"id": "x"}, {"id": 5}]}', '{"pages": [{"id": 6}], "warnings": [{}]}', None])]
    rows = readers.read(captures(spark, *odd), "pages").collect()
    by_day: dict = {}
    for r in rows:
        by_day.setdefault(r.captured_at.day, []).append((r.coverage, r.external_id))
    assert by_day == {1: [("parsing_error", None)], 2: [("parsing_error", None)], 3: [("parsing_error", None)], 4: [("complete", None)], 5: [("partial", None), ("partial", "5")], 6: [("partial", "6")], 7: [("parsing_error", None)]}
    (c,) = readers.coverage_of(readers.read(captures(spark, *odd), "pages")).collect()
    assert (c.coverage, c.captures, c.items) == ("parsing_error", 7, 3)


def test_ingest_merges_fields_and_repeats_nothing(spark):
    rows = [("courses", None, [{"id": 1, "fullname": "C"}], 1), ("forums", None, {"forums": [{"id": 9, "name": "old", "course": 1, "a": 1, "b": {"x": 1}}, {"id": 8, "name": "lost", "course": 5}]}, 1), ("forums", None, {"forums": [{"id": 9, "name": "new", "course": 1, "b": {"y": 2}, 'q"\\': "é"}]}, 2), ("forums", None, {"forums": [{"id": 9, "name": "old", "course": 1, "a": 1, "b": {"x": 1}}]}, 3)]
    once, twice = captures(spark, *rows[:3]), captures(spark, *rows[:3], *rows[:3])
    results = []
    for c in (once, twice):
        entities, occurrences, relations = readers.ingest(readers.read_all(c, ("courses", "forums")), "o", "c")
        results.append((sorted((r.kind, r.external_id, r.title, r.state) for r in entities.collect()), sorted((r.observed_at, r.content) for r in occurrences.collect()), relations.count()))
    assert results[0] == results[1]
    entities, seen, n = results[0]
    forum = next(e for e in entities if e[1] == "9")
    assert forum[2] == "new" and json.loads(forum[3]) == {"id": 9, "name": "new", "course": 1, "a": 1, "b": {"y": 2}, 'q"\\': "é"}
    assert n == 1 and len(seen) == 4 and len(entities) == 3  # the parent of 8 isn't there
    back = readers.ingest(readers.read_all(captures(spark, *rows), ("courses", "forums")), "o", "c")
    assert back[1].count() == 4 and back[0].filter("external_id = '9'").first().title == "old"
    assert readers.ingest(readers.read_all(once.limit(0), ("forums",)), "o", "c")[0].count() == 0


def test_states_of_many_rows_are_merged_by_field(spark):
    rows = spark.createDataFrame([(1, i, json.dumps({"k": i, f"f{i % 5}": None if i == 7 else i})) for i in range(50)] + [(2, 1, "{}")], "id int, at int, s string")
    got = {r.id: r.s for r in readers.merged_states(rows, ["id"], "s", "at").collect()}
    assert json.loads(got[1]) == {"k": 49, "f0": 45, "f1": 46, "f2": 47, "f3": 48, "f4": 49} and F is not None


def test_ingested_entities_deal_their_items_once(spark):
    import re

    from __spark_entry__ import queries

    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # so that what is reused shows before it runs
    try:
        plan = queries()["ingested_entities"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    shuffled = [re.search(r"hashpartitioning\((\w+)#|$", line)[1] or "" for line in plan.splitlines() if "Exchange " in line and "ReusedExchange" not in line]
    assert sorted(shuffled) == ["", "external_id", "n", "o_custkey", "s_nationkey", "user_id"]


def test_entities_of_one_content_are_as_merged(spark):
    rows = [("forums", None, {"forums": [{"id": i, "name": f"n{i}", "z": [1, {"b": None}], 'q"': i / 4, "a": None}]}, d) for i, d in ((1, 1), (2, 1), (2, 3), (3, 1))]
    rows += [("forums", None, {"forums": [{"id": 3, "name": "newer", "b": 1}]}, 2), ("forums", None, '{"forums": [{"id": 4, "name": "x", "name": "y"}]}', 1)]
    items = readers.read_all(captures(spark, *rows), ("forums",))
    got = {r.external_id: r for r in readers.entities(items).collect()}
    assert {k: (r.kind, r.title, r.versions) for k, r in got.items()} == {"1": ("forum", "n1", 1), "2": ("forum", "n2", 1), "3": ("forum", "newer", 2), "4": ("forum", "x", 1)}
    merged = {r.external_id: r.item for r in readers.merged_states(items, ["external_id"], "item", "captured_at").collect()}
    assert {k: r.state for k, r in got.items()} == merged and json.loads(merged["3"]) == {"id": 3, "name": "newer", "z": [1, {"b": None}], 'q"': 0.75, "a": None, "b": 1}
