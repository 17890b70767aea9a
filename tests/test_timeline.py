from pyspark.sql import functions as F

from attesta.operators import timeline

ABA = "owner_id string, entity_id string, content_hash string, observed_at timestamp, content string"


def aba(spark):
    rows = [("o", "e", h, f"2026-10-0{i + 1} 00:00:00", f'{{"v":"{h}"}}') for i, h in enumerate("ABA")]
    return spark.createDataFrame(rows, "owner_id string, entity_id string, content_hash string, at string, content string").select("owner_id", "entity_id", "content_hash", F.to_timestamp("at").alias("observed_at"), "content")


def test_a_b_a_is_three_occurrences_and_two_snapshots(spark):
    seen = aba(spark)
    keys = ["owner_id", "entity_id"]
    assert timeline.occurrence_log(seen.union(seen), keys, "content_hash", "observed_at").count() == 3
    snaps = timeline.snapshots(seen, keys, "content_hash", "observed_at", "content_hash")
    assert snaps.count() == 2
    back = timeline.revisits(seen, keys, "content_hash").first()
    assert (back.occurrences, back.snapshots, back.revisits) == (3, 2, 1)


def test_previous_distinct_skips_equal_content(spark):
    r = timeline.previous_distinct(aba(spark), ["entity_id"], "observed_at", "content", "content_hash").first()
    assert (r.content_hash, r.previous_content_hash, r.previous_observed_at.day) == ("A", "B", 2)


def test_previous_distinct_of_constant_content_is_null(spark):
    r = timeline.previous_distinct(aba(spark).filter("content_hash = 'A'"), ["entity_id"], "observed_at", "content", "content_hash").first()
    assert r.content_hash == "A" and r.previous_content_hash is None


def test_filter_stands_above_the_rank(spark):
    df = spark.createDataFrame([(1, 1, "good"), (1, 2, "bad")], "k int, at int, what string")
    assert timeline.latest_where(df, ["k"], "at", "at", "what = 'good'").count() == 0


def test_rank_filter_plans_a_group_limit(spark):
    plan = timeline.latest(aba(spark), ["entity_id"], "observed_at", "content_hash")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_top_k_says_whether_more_rows_were_there(spark):
    df = spark.createDataFrame([(1, i) for i in range(6)] + [(2, i) for i in range(5)], "k int, at int")
    out = {(r.k, r.truncated) for r in timeline.top_k(df, ["k"], [F.desc("at")], 5).collect()}
    assert out == {(1, True), (2, False)}


def test_single_current_edge_comes_back(spark):
    df = spark.createDataFrame([("m", "s1", 1), ("m", "s2", 2), ("m", "s1", 3)], "module string, section string, at int")
    out = {r.section: r.kind for r in timeline.single_current(df, ["module"], "section", "at", "section").collect()}
    assert out == {"s1": "current", "s2": "previous"}


def test_merge_is_shallow_and_new_values_win(spark):
    old = spark.createDataFrame([(1, {"a": 1, "b": 2})], "id int, state map<string,int>")
    new = spark.createDataFrame([(1, {"b": 3, "c": 4}), (2, {"z": 1})], "id int, state map<string,int>")
    out = {r.id: r.state for r in timeline.upsert_merge(old, new, ["id"]).collect()}
    assert out == {1: {"a": 1, "b": 3, "c": 4}, 2: {"z": 1}}


def test_late_rows_do_not_replace_newer_state(spark):
    now = spark.createDataFrame([("e", 5, "new")], "e string, at int, v string")
    late = spark.createDataFrame([("e", 3, "old")], "e string, at int, v string")
    assert timeline.guarded_projection(now, late, ["e"], "at", "v").first().v == "new"


def test_drift_has_three_values(spark):
    e = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "id int, state string")
    n = spark.createDataFrame([(1, "x"), (2, "other")], "id int, content string")
    assert {r.id: r.matches_latest for r in timeline.drift(e, n, "id", "state", "content").collect()} == {1: True, 2: False, 3: None}
