"""Preferences, events, graphs, merges, time, text and state machines on small literal tables."""

import pytest
from pyspark.sql import functions as F

from attesta.functions import hashing, jsonfn, text, timefn
from attesta.operators import attention, events, graph, joins, lifecycle, merge, preferences

PREF = "id string, key string, scope map<string,string>, evidence_kind string, state string, valid_from timestamp, valid_until timestamp, supersedes array<string>, recorded_at timestamp"


def prefs(spark, *rows):
    import datetime as dt

    day = lambda d: None if d is None else dt.datetime(2026, 1, d)
    return spark.createDataFrame([(i, k, s, e, st, day(a), day(b), sup, day(r)) for i, k, s, e, st, a, b, sup, r in rows], PREF)


def at():
    return F.expr("timestamp '2026-01-10'")


def test_preference_ladder(spark):
    df = prefs(
        spark,
        ("future", "k", {}, "user_report", "active", 20, None, [], 1),
        ("old", "k", {}, "user_report", "active", 1, None, [], 1),
        ("replacement", "k", {}, "user_report", "active", 2, 5, ["old"], 2),
        ("gone", "k", {}, "user_report", "withdrawn", 1, None, [], 1),
        ("guess", "k", {}, "hypothesis", "active", 1, None, ["now"], 1),
        ("legacy", None, {}, "user_report", "active", 1, None, [], 1),
        ("now", "k", {}, "user_report", "active", 1, None, [], 1),
    )
    out = {r.id: r.status for r in preferences.status(df, at()).collect()}
    assert out == {"future": "future", "old": "superseded", "replacement": "expired", "gone": "withdrawal", "guess": "requires_review", "legacy": "legacy_requires_review", "now": "current"}


def test_narrower_scope_dominates_and_conflicts_do_not_apply(spark):
    df = prefs(
        spark,
        ("wide", "style", {}, "user_report", "active", 1, None, [], 1),
        ("narrow", "style", {"genre": "forum"}, "user_report", "active", 1, None, [], 1),
        ("a", "tone", {}, "user_report", "active", 1, None, [], 1),
        ("b", "tone", {}, "user_report", "active", 1, None, [], 1),
        ("other", "style", {"genre": "essay"}, "user_report", "active", 1, None, [], 1),
    )
    out = {r.id: (r.dominated, r.conflict, r.applicable) for r in preferences.resolve(df, {"genre": "forum"}, at()).collect()}
    assert out == {"wide": (True, False, False), "narrow": (False, False, True), "a": (False, True, False), "b": (False, True, False)}
    assert not any(r.applicable for r in preferences.resolve(df, {"genre": "forum"}, at(), complete=False).collect())


def test_preference_problems(spark):
    df = prefs(spark, ("a", "k", {}, "user_report", "active", 5, 2, ["b", "b"], 1), ("b", "other", {}, "user_report", "active", 1, None, ["x"], 1))
    out = {r.id: set(r.violations) for r in preferences.problems(df).collect()}
    assert out == {"a": {"interval_order", "repeated_target", "other_scope_or_key"}, "b": {"unknown_target"}}


def test_delta_fold_replays_and_refuses(spark):
    rows = [("c", 1, "k1", "f", None), ("c", 2, "k1", "f", None), ("c", 3, "k1", "g", None), ("c", 4, "k2", "f", 0), ("c", 5, "k2", "f", 1)]
    df = spark.createDataFrame(rows, "context_id string, arrival int, idempotency_key string, fingerprint string, expected_version int")
    out = [(r.outcome, r.version) for r in events.record_deltas(df).orderBy("arrival").collect()]
    assert out == [("recorded", 1), ("replayed", 1), ("idempotency_conflict", None), ("version_conflict", None), ("recorded", 2)]


def test_superseded_goes_before_the_rank(spark):
    df = spark.createDataFrame([(1, "t", 1, []), (2, "t", 2, []), (3, "u", 3, [2])], "id int, key string, at int, supersedes array<int>").withColumn("version", F.lit(1))
    assert {r.key: r.id for r in events.current_assertions(df, ["key"], "id", "supersedes", "at", "version").collect()} == {"t": 1, "u": 3}


REL = "owner_id string, from_id string, to_id string, kind string"


def test_section_is_resolved_only_if_unambiguous(spark):
    rel = spark.createDataFrame([("o", "s1", "m1", "has_module"), ("o", "m1", "a", "has_content"), ("o", "s1", "m2", "has_module"), ("o", "s1", "b", "has_module"), ("o", "s2", "b", "has_module")], REL)
    focal = spark.createDataFrame([("o", "a"), ("o", "b"), ("o", "c")], "owner_id string, activity_id string")
    r = graph.resolve_section(rel, focal)
    assert {x.activity_id: (x.section_id, x.gap) for x in r.collect()} == {"a": ("s1", None), "b": (None, "section_ambiguous"), "c": (None, "section_missing")}
    assert {x.material_id for x in graph.section_siblings(rel, r).collect()} == {"m1", "m2", "b"}


def test_strongest_relation_wins(spark):
    rel = spark.createDataFrame([("o", "a", "x", "references"), ("o", "a", "x", "required"), ("o", "a", "y", "suggested")], REL)
    ent = spark.createDataFrame([("o", "x", "X", "resource"), ("o", "y", "Y", "resource")], "owner_id string, id string, title string, kind string")
    focal = spark.createDataFrame([("o", "a")], "owner_id string, activity_id string")
    g = graph.study_graph(rel, ent, focal)
    assert {r.material_id: (r.relation, r.kinds) for r in g.collect()} == {"x": ("required", ["references", "required"]), "y": ("suggested", ["suggested"])}
    files = spark.createDataFrame([("o", "1", "x", "f1"), ("o", "2", "x", "f2")], "owner_id string, id string, entity_id string, name string")
    assert {r.material_id: r.selection_required for r in graph.package(g, files).collect()} == {"x": True, "y": False}


def test_joins(spark):
    a = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    b = spark.createDataFrame([(1,)], "x int")
    c = spark.createDataFrame([(1,), (3,), (3,)], "y int")
    assert sorted(r.id for r in joins.exists_either(a, (b, "id", "x"), (c, "id", "y")).collect()) == [1, 3]
    left = spark.createDataFrame([(None, 1), (1, 2)], "k int, v int")
    right = spark.createDataFrame([(None, 9)], "k int, w int")
    assert [(r.k, r.v, r.w) for r in joins.null_safe(left, right, ["k"]).collect()] == [(None, 1, 9)]
    names = spark.createDataFrame([("f", "m1"), ("f", "m2"), ("g", "m3")], "name string, module string")
    files = spark.createDataFrame([("f",), ("g",), ("h",)], "name string")
    assert {r.name: (r.module, r.status) for r in joins.unique_match(files, names, ["name"], "module").collect()} == {"f": (None, "ambiguous"), "g": ("m3", "resolved"), "h": (None, "missing")}


def test_window_join_touches_all_buckets(spark):
    w = spark.sql("select 1 k, timestamp '2026-01-01 00:30:00' s, timestamp '2026-01-01 03:10:00' e")
    ev = spark.sql("select 1 k, timestamp '2026-01-01 00:00:00' + make_interval(0,0,0,0,0,15 * id) at from range(20)")
    got = joins.in_windows(ev, w, "at", "s", "e", ["k"], 3600).count()
    assert got == ev.filter("at >= '2026-01-01 00:30:00' and at < '2026-01-01 03:10:00'").count()


def test_merges_are_monotone(spark):
    prior = spark.createDataFrame([(1, 1, 100, "p"), (1, 2, 5, "p")], "f int, page int, chars int, src string")
    run = spark.createDataFrame([(1, 1, 100, "r"), (1, 2, 9, "r"), (1, 4, 3, "r")], "f int, page int, chars int, src string")
    out = {r.page: r.src for r in merge.merge_pages(prior, run, ["f"], "page", "chars").collect()}
    assert out == {1: "p", 2: "r", 4: "r"}
    df = spark.createDataFrame([(1, [1, 2, 4], [], 4), (2, [1, 2], [2], 2), (3, [1], [], 1)], "id int, have array<int>, cut array<int>, n int")
    assert {r.id: r.n for r in df.select("id", merge.next_page(F.col("have"), F.col("cut"), F.col("n")).alias("n")).collect()} == {1: 3, 2: 2, 3: None}
    cov = spark.createDataFrame([(1, "complete"), (1, "denied"), (1, "partial")], "k int, coverage string")
    assert cov.groupBy("k").agg(merge.worst_coverage().alias("c")).first().c == "denied"


@pytest.mark.parametrize(
    ("local", "zone", "kind", "reason"),
    [("2026-03-29T01:30:00", "Europe/Lisbon", "unresolved", "nonexistent_local_time"), ("2026-10-25T01:30:00", "Europe/Lisbon", "unresolved", "ambiguous_local_time"), ("2026-07-01T12:00:00", "Europe/Lisbon", "instant", None), ("2026-07-01T12:00:00", None, "unresolved", "missing_zone"), ("2026-07-01T12:00:00Z", "Europe/Lisbon", "instant", "offset_zone_mismatch"), ("2026-07-01T12:00:00+01:00", "Europe/Lisbon", "instant", None)],
)
def test_local_time(spark, local, zone, kind, reason):
    df = spark.createDataFrame([(local, zone)], "t string, z string")
    r = df.select(timefn.normalize(F.col("t"), F.lit(None).cast("string"), F.col("t"), F.col("z")).alias("x")).select("x.*").first()
    assert (r.kind, r.reason) == (kind, reason)


def test_offset_gives_the_instant(spark):
    df = spark.createDataFrame([("2026-07-01T12:00:00-03:00",)], "t string")
    r = df.select(timefn.normalize(F.col("t"), F.lit(None).cast("string"), F.col("t"), F.lit(None).cast("string")).alias("x")).select(F.date_format("x.instant", "yyyy-MM-dd HH:mm").alias("i")).first()
    assert r.i == "2026-07-01 15:00"


def test_schedule_skips_missing_and_takes_first_of_double(spark):
    days = spark.sql("select date '2026-03-29' day union all select date '2026-10-25'")
    out = timefn.schedule_windows(days, "day", "Europe/Lisbon", ["01:30"], 1800, F.expr("timestamp '2026-01-01'"), F.expr("timestamp '2027-01-01'")).collect()
    assert [(str(r.day), r.window_start.strftime("%H:%M")) for r in out] == [("2026-10-25", "00:30")]


def test_epoch_zero_means_absent(spark):
    df = spark.createDataFrame([(0,), (-1,), (253402300800,), (1,)], "s long")
    assert [r[0] is not None for r in df.select(timefn.epoch_instant(F.col("s"))).collect()] == [False, False, False, True]


@pytest.mark.parametrize("secret", ["sk-" + "a" * 16, "ghp_" + "A1" * 10, "github_pat_" + "x" * 20, "AIza" + "b" * 35, "xoxb-1234567890-abc", "eyJ" + "a" * 12 + "." + "b" * 12 + "." + "c" * 12, "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----", "password = hunter2hunter2xx", "token: 'abcdefgh12345678", 'client_secret="abcdefgh12345678"', "senha: abcdefgh12345678", '"api-key": "abcdefgh.1234567'])
def test_each_secret_pattern(spark, secret):
    r = spark.createDataFrame([(f"before {secret} after",)], "t string").select(text.redacted(F.col("t")).alias("x"), text.secret_count(F.col("t")).alias("n")).first()
    assert "[REDACTED]" in r.x and r.n == 1 and r.x.startswith("before") and r.x.rstrip().endswith("after")


@pytest.mark.parametrize("harmless", ["sk-" + "a" * 15, "ghp_" + "A" * 19, "password = short", "a plain sentence about a token and a secret"])
def test_what_is_no_secret_stays(spark, harmless):
    r = spark.createDataFrame([(harmless,)], "t string").select(text.redacted(F.col("t")).alias("x"), text.secret_count(F.col("t")).alias("n")).first()
    assert r.x == harmless and r.n == 0


def test_text_functions(spark):
    one = lambda c, v: spark.createDataFrame([(v,)], "t string").select(c(F.col("t")).alias("x")).first().x
    assert one(text.comparison_key, "  café  au\nlait ") == "café au lait"
    assert one(text.line_ends, "a\r\nb\nc") == "mixed" and one(text.line_ends, "a\rb") == "cr"
    assert one(text.line_count, "a\r\nb\r") == 2 and one(text.line_count, "") == 0
    assert one(text.links, "see https://a.b/c, and http://d.e.") == ["https://a.b/c", "http://d.e"]
    assert tuple(one(lambda c: text.line_range(c, "b\nc"), "a\nb\nc\n")) == (2, 3)
    assert one(text.is_safe_relative, "a/b.txt") and not one(text.is_safe_relative, "a/../b") and not one(text.is_safe_relative, "C:x")
    assert one(text.is_secret_path, "x/.env.local") and not one(text.is_secret_path, "x/env.md")
    assert all(one(text.is_secret_path, p) for p in ("a.PEM", "x/client_secret_9.json", "service-account.json", "credentials-old.json", "b/.ENV")) and not one(text.is_secret_path, "id_rsa")
    assert one(text.escaped, '<a>"&\n') == "&lt;a&gt;&quot;&amp;<br>"
    assert one(text.canonical_url, "HTTPS://Ex.COM/Path/") == "https://ex.com/Path"
    srt = "1\n00:00:01,000 --> 00:00:02,500\n<i>Hello</i>\nthere\n\nbad block\n\n2\n00:03.000 --> 00:04.000\nBye\n"
    assert [tuple(c) for c in one(text.subtitle_cues, srt)] == [(1000, 2500, "Hello\nthere"), (3000, 4000, "Bye")]


def test_hashes(spark):
    r = spark.createDataFrame([("hello\n",)], "t string").select(hashing.git_blob_id(F.col("t")).alias("g"), hashing.stable_uuid(F.col("t")).alias("u"), hashing.cas_path(F.sha2("t", 256)).alias("p")).first()
    assert r.g == "ce013625030ba8dba906f756967f9e9ca394464a"
    assert r.u[14] == "5" and r.u[19] in "89ab" and len(r.u) == 36
    assert r.p.startswith("cas/58/5891b5b522d5df086d0ff0b110fb")


def test_json(spark):
    df = spark.createDataFrame([('{"b":1,"a":{"d":2.0,"c":null}}', '{"b":5,"z":1}')], "x string, y string")
    r = df.select(jsonfn.canonical("x").alias("c"), jsonfn.merged(F.col("x"), F.col("y")).alias("m"), jsonfn.without_keys(F.col("x"), "a").alias("w"), jsonfn.at_pointer(F.col("x"), F.lit("/a/d")).alias("p"), jsonfn.has_key(F.col("x"), "a").alias("h")).first()
    assert r.c == '{"a":{"c":null,"d":2.0},"b":1}' and r.w == '{"b":1}' and r.p == "2.0" and r.h
    import json

    assert json.loads(r.m) == {"a": {"d": 2.0, "c": None}, "b": 5, "z": 1}


def test_job_lease_and_attempts(spark):
    rows = [("j", "00:00", "enqueue", None), ("j", "00:01", "claim", None), ("j", "00:02", "claim", None), ("j", "00:04", "claim", None), ("j", "00:05", "finish", "complete"), ("k", "00:00", "enqueue", None), ("k", "00:01", "claim", None), ("k", "00:09", "finish", "complete")]
    df = spark.createDataFrame(rows, "job_id string, t string, event string, value string").withColumn("at", F.to_timestamp(F.concat(F.lit("2026-01-01 "), "t")))
    out = {r.job_id: (r.state, r.attempts) for r in lifecycle.job_states(df.drop("t")).collect()}
    assert out == {"j": ("complete", 2), "k": ("running", 1)}


def test_action_approval_is_used_once_and_in_time(spark):
    rows = [("a", "00:00", "prepare", "01:00"), ("a", "00:10", "approve", None), ("a", "00:20", "consume", None), ("a", "00:30", "result", None), ("b", "00:00", "prepare", "00:05"), ("b", "00:10", "approve", None), ("c", "00:00", "prepare", "01:00"), ("c", "00:10", "approve", None), ("c", "00:20", "consume", None)]
    ts = lambda c: F.to_timestamp(F.concat(F.lit("2026-01-01 "), c))
    df = spark.createDataFrame(rows, "action_id string, t string, event string, e string").select("action_id", ts("t").alias("at"), "event", ts("e").alias("expires_at"))
    assert {r.action_id: r.state for r in lifecycle.action_states(df).collect()} == {"a": "succeeded", "b": "prepared", "c": "uncertain"}


def test_backoff(spark):
    out = [r[0] for r in spark.range(1, 9).select(lifecycle.backoff_seconds(F.col("id"), 60)).collect()]
    assert out == [60, 120, 240, 480, 960, 1920, 1920, 1920]


def test_requirements_and_reports(spark):
    needs = [("a", "1", "submission"), ("b", "1", "forum_reply"), ("c", "1", "forum_reply"), ("d", "1", "completion"), ("e", "1", "submission"), ("e", "2", "submission"), ("f", "1", "manual"), ("g", "1", "forum_topic")]
    needs = spark.createDataFrame([("o", *n, 2 if n[2] == "forum_reply" else None) for n in needs], "owner_id string, entity_id string, requirement_key string, fulfilment string, at_least int")
    reports = [("a", "submission", None, None), ("c", "forum_reply", "1", 2), ("e", "submission", None, None), ("e", "submission", "2", None), ("f", "completion", None, None)]
    reports = spark.createDataFrame([("o", *r) for r in reports], "owner_id string, entity_id string, event_type string, requirement_key string, distinct_colleagues int")
    none = dict.fromkeys(["submit_receipts", "topic_receipts", "publications", "colleagues_answered", "forum_known", "native_status", "native_completion", "legacy_report", "partial"])
    evidence = [{"entity_id": "a", "native_status": "draft"}, {"entity_id": "b", "colleagues_answered": 1, "forum_known": True, "partial": True}, {"entity_id": "d", "native_completion": True}, {"entity_id": "g"}]
    kinds = "submit_receipts int, topic_receipts int, publications int, colleagues_answered int, forum_known boolean, native_status string, native_completion boolean, legacy_report boolean, partial boolean"
    evidence = spark.createDataFrame([("o", e["entity_id"], *[(none | e)[n] for n in none]) for e in evidence], f"owner_id string, entity_id string, {kinds}")
    assessed = attention.assess(needs, reports, evidence)
    out = {(r.entity_id, r.requirement_key): (r.verdict, r.reasons) for r in assessed.collect()}
    several = ["multiple_obligations_require_specific_evidence"]
    assert out == {
        ("a", "1"): ("uncertain", ["user_report_contradicts_native_status"]), ("b", "1"): ("pending", ["distinct_colleagues_below_required", "positive_proof_from_partial_coverage"]), ("c", "1"): ("satisfied", []),
        ("d", "1"): ("satisfied", []), ("e", "1"): ("uncertain", several), ("e", "2"): ("satisfied", []), ("f", "1"): ("pending", ["manual_confirmation_pending"]), ("g", "1"): ("uncertain", ["connection_subject_unknown"]),
    }
    kinds = [("a", "assignment"), ("d", "module"), ("h", "forum"), ("i", "assignment"), ("j", "assignment"), ("k", "module")]
    entities = spark.createDataFrame([("o", i, k, i == "j", i == "k") for i, k in kinds], "owner_id string, entity_id string, kind string, submission_evidence boolean, completion_evidence boolean")
    got = {r.entity_id: (r.state, r.contradiction, r.state_reasons) for r in attention.assess_entity(assessed, entities).collect()}
    assert got == {"a": ("uncertain", True, ["user_report_contradicts_native_status"]), "d": ("concluded", False, []), "h": ("uncertain", False, ["requirement_not_interpreted"]), "i": ("pending", False, ["submission_evidence_missing"]), "j": ("concluded", False, []), "k": ("concluded", False, [])}


def test_budget_refusals_charge_nothing(spark):
    import datetime as dt

    rows = [("p", dt.datetime(2026, 1, 1, 0, m), m, float(c)) for m, c in ((1, 6), (2, 6), (3, 4), (6, 1), (7, 9), (13, 9))]
    df = spark.createDataFrame(rows, "k string, at timestamp, i int, c double")
    out = lifecycle.tumbling_budget(df, ["k"], "at", "i", {"calls": "c"}, {"calls": 21.0}, {"calls": 10.0}, 300).orderBy("i").collect()
    assert [(r.fits, r.window_calls, r.reserved_calls, r.window_started.minute) for r in out] == [(True, 6, 6, 1), (False, 6, 6, 1), (True, 10, 10, 1), (True, 1, 11, 6), (True, 10, 20, 6), (False, 0, 20, 13)]


def test_budget_holds_the_sums_it_keeps_against_the_limits(spark):
    import datetime as dt

    # 0.1 + 149.9 is 150, while 150 - 149.9 is less than 0.1.
    rows = [(k, dt.datetime(2026, 1, 1, 0, i), i, c) for k in "pq" for i, c in enumerate((0.1, 149.9, 0.01) if k == "p" else (0.1, 149.91, 0.0))]
    df = spark.createDataFrame(rows, "k string, at timestamp, i int, c double")
    for total, window in ((150.0, 1e9), (1e9, 150.0)):
        out = lifecycle.tumbling_budget(df, ["k"], "at", "i", {"calls": "c"}, {"calls": total}, {"calls": window}, 3600).orderBy("k", "i").collect()
        assert [(r.fits, r.reserved_calls) for r in out] == [(True, 0.1), (True, 150.0), (False, 150.0), (True, 0.1), (False, 0.1), (True, 0.1)]


def test_only_replies_to_colleagues_count(spark):
    posts = [("1", "0", "7"), ("2", "1", "8"), ("3", "2", "7"), ("4", "2", "7"), ("5", "1", "9"), ("6", "5", "7"), ("7", "3", "7")]
    df = spark.createDataFrame([("o", "f", "d", *p) for p in posts], "owner_id string, forum_id string, discussion_id string, post_id string, parent_id string, author_id string")
    r = attention.forum_evidence(df, "7").first()
    assert (r.own_topics, r.own_replies, r.colleagues_seen, r.colleagues_answered) == (1, 3, 2, 2)
