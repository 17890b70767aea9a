"""Requests, stored pages and follow-up policies on small literal tables."""

import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from attesta.operators import followup, requests

POLICY = dict(policy_id=1, paused=False, pause_reason=None, failures=0, next_at=0, expires_at=10_000, active_id=None, active_deadline=None, job_id=None, interval_ms=1000, backoff_ms=100, max_failures=3, revision=2)
SCHEMA = "policy_id long, paused boolean, pause_reason string, failures int, next_at long, expires_at long, active_id string, active_deadline long, job_id long, interval_ms long, backoff_ms long, max_failures int, revision int"


def policies(spark, *changes):
    return spark.createDataFrame([Row(**POLICY | {"policy_id": i + 1} | c) for i, c in enumerate(changes)], SCHEMA)


def now(ms=500):
    return F.lit(ms).cast("long")


def by_id(df):
    return {r.policy_id: r for r in df.collect()}


def test_backoff_doubles_until_success_and_pauses_at_the_limit(spark):
    runs = [(1, 1, 10, "timeout"), (1, 2, 20, "timeout"), (1, 3, 30, "progress"), (1, 4, 40, "timeout"), (1, 5, 50, "timeout"), (1, 6, 60, "denied"), (1, 7, 70, "complete"), (2, 1, 10, "complete"), (2, 2, 20, "expired"), (2, 3, 30, "complete")]
    df = spark.createDataFrame(runs, "policy_id long, run_id long, at long, outcome string")
    got = [(r.policy_id, r.run_id, r.failures, r.next_at, r.pause_reason) for r in followup.settle(df, policies(spark, {}, {})).orderBy("policy_id", "run_id").collect()]
    assert got == [(1, 1, 1, 110, None), (1, 2, 2, 220, None), (1, 3, 0, 130, None), (1, 4, 1, 140, None), (1, 5, 2, 250, None), (1, 6, 3, 460, "failure_limit"), (2, 1, 0, 1010, None), (2, 2, 1, 120, "credential_expired")]


def test_prepare_ends_lapsed_runs_and_names_the_job_wanted(spark):
    p = policies(spark, {}, {"job_id": 5}, {"job_id": 6}, {"job_id": 7}, {"expires_at": 500}, {"active_id": "r", "active_deadline": 500}, {"active_id": "r", "active_deadline": 501}, {"next_at": 501}, {"job_id": 8}, {"active_id": "r", "active_deadline": 9, "job_id": 6, "failures": 2})
    jobs = spark.createDataFrame([(5, "partial", 4), (6, "complete", 5), (7, "partial", 5)], "job_id long, state string, attempts int")
    got = {k: (r.paused, r.pause_reason, r.failures, r.wants) for k, r in by_id(followup.prepare(p, jobs, now())).items()}
    assert got == {
        1: (False, None, 0, "new"), 2: (False, None, 0, "same"), 3: (False, None, 0, "new"), 4: (True, "job_terminal", 0, None), 5: (True, "policy_expired", 0, None),
        6: (False, None, 1, None), 7: (False, None, 0, None), 8: (False, None, 0, None), 9: (True, "job_terminal", 0, None), 10: (False, None, 0, None),
    }


def test_pause_needs_the_stored_revision(spark):
    p = policies(spark, {}, {}, {"active_id": "r"}, {"active_id": "r"}, {"paused": True, "expires_at": 500}, {"paused": True, "failures": 2}, {})
    asked = spark.createDataFrame([(1, True, 2), (2, True, 1), (3, False, 2), (4, True, 2), (5, False, 2), (6, False, 2)], "policy_id long, pause boolean, at_revision int")
    got = {k: (r.paused, r.pause_reason, r.failures, r.revision, r.active_id, r.refusal) for k, r in by_id(followup.pause(p, asked, now())).items()}
    assert got == {
        1: (True, "manual", 0, 3, None, None), 2: (False, None, 0, 2, None, "version_conflict"), 3: (False, None, 0, 2, "r", "policy_busy"), 4: (True, "manual", 1, 3, None, None),
        5: (True, None, 0, 2, None, "policy_expiry"), 6: (False, None, 2, 3, None, None), 7: (False, None, 0, 2, None, None),
    }


def test_interrupt_ends_only_the_named_run(spark):
    p = policies(spark, {"active_id": "a"}, {"active_id": "a"}, {})
    asked = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "policy_id long, run_id string")
    got = {k: (r.failures, r.next_at, r.active_id) for k, r in by_id(followup.interrupt(p, asked, now())).items()}
    assert got == {1: (1, 600, None), 2: (0, 0, "a"), 3: (0, 0, None)}


def test_attempts_of_another_window_are_void(spark):
    s = spark.createDataFrame([(1, "w2", 1000, 1, 3)], "schedule_id long, window_key string, window_end long, cursor long, size long")
    p = [(1, 10, 0, "w1", 2, 0, None, 100, False), (1, 11, 1, "w2", 2, 0, None, 100, False), (1, 12, 2, "w2", 1, 28, None, 100, False)]
    df = spark.createDataFrame(p, "schedule_id long, policy_id long, position long, noted_key string, attempts int, runs int, next_at long, wall_ms long, paused boolean")
    assert [tuple(r) for r in followup.next_run(s, df, now()).collect()] == [(1, 10, 1, 1)]
    assert followup.next_run(s, df, now(901)).collect() == []


def test_a_batch_over_the_budget_is_rolled_back_whole(spark):
    w = spark.createDataFrame([(1, 1, 60), (1, 2, 30), (1, 2, 20), (1, 3, 40), (1, 4, -1), (2, 1, 101)], "run_id long, batch_id long, bytes long")
    limits = spark.createDataFrame([(1, 100), (2, 100)], "run_id long, limit long")
    got = sorted((r.run_id, r.batch_id, r.used, r.refusal) for r in followup.write_budget(w, limits).collect())
    no = "followup_write_budget"
    assert got == [(1, 1, 60, None), (1, 2, 60, no), (1, 3, 100, None), (1, 4, 100, no), (2, 1, 0, no)]


@pytest.mark.parametrize("pages, count, want", [([], None, 1), ([], 3, 1), ([(1, False), (3, True)], 3, 2), ([(1, True), (2, False)], 2, 1), ([(1, False), (2, False)], 2, None), ([(1, False)], None, 2), ([(1, False), (2, True)], 1, None)])
def test_resume_page(spark, pages, count, want):
    df = spark.createDataFrame([(pages, count)], "p array<struct<page:int,truncated:boolean>>, n int")
    assert df.select(requests.resume_page(F.col("p"), F.col("n"))).first()[0] == want


def test_curation_of_a_missing_folder_is_empty(spark, tmp_path):
    schema = "batchId string, items array<string>"
    assert requests.read_curation(spark, str(tmp_path), schema).collect() == []
    (tmp_path / "curation").mkdir()
    for b in ("b2", "b1"):
        (tmp_path / "curation" / f"{b}.json").write_text(json.dumps({"batchId": b, "items": ["x"]}, indent=1))
    (tmp_path / "curation" / "note.txt").write_text("no json")
    assert [r.batchId for r in requests.read_curation(spark, str(tmp_path), schema).orderBy("batchId").collect()] == ["b1", "b2"]


def test_actions_page_refuses_bad_limits(spark):
    with pytest.raises(ValueError):
        requests.actions_page(spark.range(0), spark.range(0), limit=201)
    with pytest.raises(ValueError):
        requests.actions_page(spark.range(0), spark.range(0), states=[])


def test_course_kinds(spark):
    df = spark.createDataFrame([("moodle_course:7",), ("moodle_course:0",), ("moodle_course: 7",), ("moodle_course:9007199254740992",), ("moodle_courses",), (None,)], "kind string")
    assert [r[0] for r in df.select(requests.course_of(F.col("kind"))).collect()] == [7, None, None, None, None, None]


def test_transcriptions_of_unknown_models_are_not_reused(spark):
    df = spark.sql("select named_struct('engine_version', '1', 'language', 'pt', 'model_sha256', m) as p, named_struct('engine_version', '1', 'language', 'pt', 'model_sha256', n) as e from values ('a', 'a'), ('a', 'b'), (null, null), ('', '') as t(m, n)")
    assert [r[0] for r in df.select(requests.reusable_transcription(F.col("p"), F.col("e"))).collect()] == [True, False, False, False]
