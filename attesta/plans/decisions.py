"""Registered queries over requests, stored pages and follow-up policies, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.operators import followup, graph, qualification, requests
from attesta.plans.queries import query

_pick = lambda names, i: F.element_at(F.array(*[F.lit(n) for n in names]), (i + 1).cast("int"))
_NOW = 900_000_000_000
_ms = lambda at: F.unix_millis(F.col(at).cast("timestamp"))


# Stored pages


def _extracted(t):
    """Documents as PDFs: ``doc_id % 4`` pages stored, without the second where ``doc_id % 3 = 0``, every fifth page truncated."""
    k = F.col("doc_id")
    numbers = F.when(k % 4 > 0, F.sequence(F.lit(1), (k % 4).cast("int"))).otherwise(F.array().cast("array<int>"))
    pages = F.transform(F.filter(numbers, lambda p: ~((k % 3 == 0) & (p == 2))), lambda p: F.struct(p.alias("page"), ((p + k) % 5 == 0).alias("truncated")))
    count = F.when(k % 7 > 2, (k % 7).cast("int")).when(k % 7 == 2, F.lit(20000))
    return t.documents.select(k.alias("id"), F.lit("n").alias("name"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").alias("bytes"), F.lit("application/pdf").alias("mime_type"), (k % 11 > 0).alias("stored"), F.struct(_pick(["complete", "partial", "odd"], k % 3).alias("coverage"), count.alias("page_count"), F.lit(None).cast("int").alias("pages_in_document"), pages.alias("pages")).alias("extraction"))


_PAGES = """with d as (select doc_id, text, case when doc_id % 7 > 2 then doc_id % 7 end as n, list_filter(range(1, doc_id % 4 + 1), lambda p: not (doc_id % 3 = 0 and p = 2)) as have from documents),
x as (select *, coalesce(n, list_max(have)) as top from d),
y as (select *, list_min(list_filter(range(1, top + 1), lambda p: not list_contains(have, p))) as gap, list_min(list_filter(have, lambda p: (p + doc_id) % 5 = 0 and p <= top)) as cut from x),
z as (select doc_id as id, sha256(text) as sha256, case doc_id % 3 when 0 then 'complete' when 1 then 'partial' else 'not_extracted' end as coverage, case when len(have) = 0 then 1 else coalesce(gap, cut, case when n is null then top + 1 end) end::int as next_page from y) """


@query(_PAGES + "select id, next_page from z")
def resume_pages(t):
    count = F.col("extraction.page_count")
    return _extracted(t).select("id", requests.resume_page(F.col("extraction.pages"), F.when(count <= requests.MOST_PAGES, count)).alias("next_page"))


@query(_PAGES + "select * from z where id > 100 and id % 11 > 0 order by id limit 20")
def pdf_page(t):
    return requests.pdf_page(_extracted(t), 100).select("id", "sha256", "coverage", "next_page")


# Requests


@query("select o.o_orderkey as id, o_orderstatus as state, decision from orders o left join (select l_orderkey, min(l_returnflag) as decision from lineitem where l_quantity > 40 group by 1) on l_orderkey = o_orderkey where o_orderstatus in ('O', 'P') order by o_orderdate desc, o_orderkey limit 200")
def actions_page(t):
    actions = t.orders.select(F.lit("o").alias("owner_id"), F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("state"), F.col("o_orderdate").alias("created_at"))
    approvals = t.lineitem.filter("l_quantity > 40").groupBy(F.lit("o").alias("owner_id"), F.col("l_orderkey").alias("action_id")).agg(F.min("l_returnflag").alias("decision"))
    return requests.actions_page(actions, approvals, ["O", "P"], 200).select("id", "state", "decision")


@query("""select case doc_id % 4 when 0 then 'complete' when 1 then 'partial' when 2 then 'denied' else 'timeout' end as coverage, count(*) as files, count(*) filter (doc_id % 3 = 0) as inserted, count(*) filter (doc_id % 3 = 1) as updated, count(*) filter (doc_id % 3 = 2) as kept_prior,
coalesce(sum(strlen(text)) filter (doc_id % 3 < 2), 0)::bigint as bytes_preserved from documents group by 1""")
def import_summary(t):
    k = F.col("doc_id")
    return requests.import_summary(t.documents.select(_pick(["complete", "partial", "denied", "timeout"], k % 4).alias("coverage"), _pick(["inserted", "updated", "kept_prior"], k % 3).alias("action"), F.octet_length("text").cast("long").alias("bytes")))


@query("select o_orderkey, case when o_custkey % 5 > 0 and c_custkey is not null and p_partkey is not null then null else 'not_found' end as refusal from orders left join customer on c_custkey = o_custkey and c_custkey % 7 > 0 left join part on p_partkey = o_orderkey % 3000 and p_partkey % 3 > 0")
def admitted_imports(t):
    o = F.lit("o").alias("owner_id")
    asked = t.orders.select(o, "o_orderkey", F.col("o_custkey").alias("connection_id"), (F.col("o_orderkey") % 3000).alias("context_id"))
    connections = t.customer.filter("c_custkey % 7 > 0").select(o, F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 5 > 0, "moodle").otherwise("host").alias("provider"))
    return requests.admitted(asked, connections, t.part.filter("p_partkey % 3 > 0").select(o, F.col("p_partkey").alias("id"))).select("o_orderkey", "refusal")


@query("select l_orderkey, case when count(distinct l_suppkey % 4) = 1 then min(l_suppkey % 4) end as activity, case when count(distinct l_suppkey % 4) > 1 then 'ambiguous_activity' end as refusal from lineitem group by 1")
def selected_activity(t):
    return requests.selected_activity(t.lineitem.select("l_orderkey", (F.col("l_suppkey") % 4).alias("activity")), "l_orderkey", "activity")


_AUDITED, _IMPLEMENTED = ("AIR", "FOB", "MAIL", "RAIL", "SHIP"), ("AIR", "MAIL", "SHIP", "TRUCK")
_MODES = ("AIR", "TRUCK", "MAIL", "RAIL", "REG")


@query("""with o as (select l_orderkey, list(distinct ['AIR', 'TRUCK', 'MAIL', 'RAIL', 'REG'][l_suppkey % 5 + 1]) as m from lineitem group by 1)
select l_orderkey, array_to_string(list_sort(list_filter(m, lambda x: list_contains(['AIR', 'MAIL', 'SHIP'], x))), ',') as available, array_to_string(list_filter(['AIR', 'FOB', 'MAIL', 'RAIL', 'SHIP'], lambda x: not list_contains(m, x)), ',') as not_offered from o""")
def capabilities(t):
    offered = t.lineitem.groupBy("l_orderkey").agg(F.collect_set(_pick(_MODES, F.col("l_suppkey") % 5)).alias("offered"))
    found = offered.select("l_orderkey", requests.capabilities(F.col("offered"), _AUDITED, _IMPLEMENTED).alias("c"))
    return found.select("l_orderkey", F.array_join("c.available", ",").alias("available"), F.array_join("c.not_offered", ",").alias("not_offered"))


@query("select doc_id as origin, case when doc_id % 5 = 0 then 'unavailable' when doc_id % 3 = 0 then 'advanced' else 'unchanged' end as drift from documents")
def origin_drift(t):
    manifests = t.documents.select(F.col("doc_id").alias("origin"), F.sha1("text").alias("commit"))
    return requests.origin_drift(manifests, manifests.filter("origin % 5 > 0").withColumn("commit", F.when(F.col("origin") % 3 == 0, F.sha1("commit")).otherwise(F.col("commit")))).select("origin", "drift")


@query("select o_orderkey as delta_id, case when bool_or(l_quantity > 40) then 'complete' else 'failed' end as source_refresh from orders left join lineitem on l_orderkey = o_orderkey group by 1")
def commit_and_refresh(t):
    return requests.commit_and_refresh(t.orders.select(F.col("o_orderkey").alias("delta_id")), t.lineitem.select(F.col("l_orderkey").alias("delta_id"), (F.col("l_quantity") > 40).alias("ok")))


@query("""select o_orderkey, case when o_orderkey % 4 = 1 and o_custkey > 0 then o_custkey end as course_id,
case when o_orderkey % 4 > 1 or o_orderkey % 4 = 1 and coalesce(o_custkey, 0) < 1 then 'unavailable' when o_orderkey % 6 = 1 then null when o_orderkey % 6 = 3 then 'expired' when o_orderkey % 6 = 5 then 'unavailable' else 'complete' end as finished_as from orders""")
def dispatched_jobs(t):
    k = F.col("o_orderkey")
    kind = F.when(k % 4 == 0, "moodle_courses").when(k % 4 == 1, F.concat(F.lit("moodle_course:"), F.col("o_custkey").cast("string"))).when(k % 4 == 2, F.concat(F.lit("moodle_course:x"), k.cast("string"))).otherwise("moodle_course:0")
    jobs = t.orders.select("o_orderkey", kind.alias("kind"), F.when(k % 6 == 1, "job_conflict").when(k % 6 == 3, "invalid_token").when(k % 6 == 5, "socket").alias("error"), F.lit("complete").alias("coverage"))
    return requests.dispatched(jobs, follow_up=True).select("o_orderkey", "course_id", "finished_as")


@query("select user_id, greatest(0, epoch_us(max(ts) filter (event_id % 3 = 1)) // 1000 - epoch_us(min(ts) filter (event_id % 3 = 0)) // 1000)::bigint as duration_ms, count(*) filter (event_id % 3 = 2) as calls from events group by 1")
def attempt_metrics(t):
    e = t.events.select("user_id", _pick(["start", "report", "call"], F.col("event_id") % 3).alias("event"), _ms("ts").alias("at_ms"), F.lit(None).cast("long").alias("memory"))
    first = e.filter("event = 'start'").groupBy("user_id", "event").agg(F.min("at_ms").alias("at_ms"), F.first("memory").alias("memory"))
    return requests.attempt_metrics(e.filter("event <> 'start'").unionByName(first), ["user_id"]).select("user_id", F.coalesce("duration_ms", F.lit(0)).cast("long").alias("duration_ms"), "calls")


@query("select p_partkey, p_partkey % 4 > 0 and p_partkey % 5 > 1 as reused from part")
def reusable_transcriptions(t):
    k = F.col("p_partkey")
    stamp = lambda v, m: F.struct(v.alias("engine_version"), F.lit("pt").alias("language"), m.alias("model_sha256"))
    return t.part.select("p_partkey", requests.reusable_transcription(stamp(F.when(k % 4 == 0, "old").otherwise("1"), F.when(k % 5 == 0, "").when(k % 5 == 1, None).otherwise("m")), stamp(F.lit("1"), F.when(k % 5 == 0, "").otherwise("m"))).alias("reused"))


@query("""select p_partkey, case when p_partkey % 2 = 0 then 'embedded_captions' when p_partkey % 3 = 0 and p_partkey % 5 > 0 then 'local_asr' else 'none' end as transcript_source,
case when p_partkey % 7 = 0 then 'parsing_error' when p_partkey % 11 = 0 then 'timeout' when p_partkey % 2 = 1 and p_partkey % 3 = 0 then case when p_partkey % 5 > 0 then 'complete' else 'partial' end when p_partkey % 2 = 0 and p_partkey % 13 > 0 then 'complete' else 'partial' end as coverage from part""")
def transcripts(t):
    k = F.col("p_partkey")
    media = t.part.select("p_partkey", (k % 7 > 0).alias("probe_ok"), F.lit("parsing_error").alias("probe_coverage"), (k % 11 > 0).alias("subtitles_ok"), F.lit("timeout").alias("subtitles_coverage"), F.when(k % 2 == 0, 4).otherwise(0).alias("cues"), (k % 13 == 0).alias("truncated"), (k % 3 == 0).alias("wanted"), (k % 5 > 0).alias("asr_ok"), F.when(k % 5 > 0, "complete").alias("asr_coverage"))
    return requests.transcript(media).select("p_partkey", "transcript_source", "coverage")


_ID = "00000000-0000-4000-8000-"


@query("""with r as (select o_custkey as draft_id, 'artifact_provenance' as basis, '00000000-0000-4000-8000-' || lpad(o_orderkey::varchar, 12, '0') as base_id, o_orderstatus as base_hash, null::bigint as required_entity_id from orders where o_orderkey % 6 > 0
union all select c_custkey, 'required_material', 'o' || e.event_id, e.event_type, e.event_id from customer join events e on e.user_id = c_custkey % 90 where e.event_id % 4 <> 1 and (e.event_id % 4 <> 2 or c_custkey % 3 = 0))
select draft_id, basis, base_id, required_entity_id, nth::int as nth, basis = 'artifact_provenance' as is_uuid from (select *, row_number() over (partition by draft_id order by basis, base_id, base_hash, required_entity_id nulls last) as nth from r) where nth <= 21""")
def draft_references(t):
    k = F.col("o_orderkey")
    locator = F.concat(F.lit("hub:observation:" + _ID), F.lpad(k.cast("string"), 12, "0"))
    held = t.orders.groupBy(F.col("o_custkey").alias("draft_id")).agg(F.collect_list(F.struct(F.when(k % 6 == 5, locator).when(k % 6 > 0, locator).otherwise("hub:file:1").alias("locator"), F.col("o_orderstatus").alias("version"))).alias("provenance"))
    drafts = t.customer.select(F.col("c_custkey").alias("draft_id"), (F.col("c_custkey") % 3).alias("context_id"), (F.col("c_custkey") % 90).alias("entity_id")).join(held, "draft_id", "left")
    e = F.col("event_id")
    edges = t.events.select(F.col("user_id").alias("from_id"), e.alias("to_id"), F.when(e % 4 != 1, F.concat(F.lit("o"), e.cast("string"))).alias("observation_id"), F.col("event_type").alias("content_hash"), F.when(e % 4 == 2, 0).cast("long").alias("context_id"), F.lit(None).cast("long").alias("draft_id"))
    return requests.draft_references(drafts, edges).select("draft_id", "basis", "base_id", "required_entity_id", "nth", F.col("base_uuid").isNotNull().alias("is_uuid"))


@query("select o_orderkey as activity_id, l_orderkey * 10 + l_linenumber as resource_id from orders join lineitem on l_partkey = o_custkey and l_suppkey = o_orderkey % 100 where o_custkey > 0 and o_orderkey % 100 > 0 and o_orderkey <> l_orderkey * 10 + l_linenumber")
def attribute_resources(t):
    o, c = F.lit("o").alias("owner_id"), F.lit(1).alias("connection_id")
    modules = t.orders.select(o, c, F.col("o_orderkey").alias("activity_id"), F.col("o_custkey").cast("string").alias("course_id"), (F.col("o_orderkey") % 100).cast("string").alias("module_id"))
    resources = t.lineitem.select(o, c, F.col("l_partkey").cast("string").alias("course_id"), F.col("l_suppkey").cast("string").alias("module_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    return requests.resources_of(modules, resources).select("activity_id", "resource_id")


# Rights and qualified states


@query("""with r as (select l_orderkey as a, l_partkey as m, case l_returnflag when 'R' then 'required' when 'A' then 'suggested' else 'references' end as kind, max(case when l_suppkey % 4 > 0 then 'r' || l_suppkey % 3 end) as rights from lineitem where l_orderkey is not null and l_partkey is not null group by all),
e as (select a, m, case when kind = 'references' then 'reference' else (case when bool_or(kind = 'required') over (partition by a, m) then 'required' else 'suggested' end) end as role, rights from r)
select a as activity_id, m as material_id, role, case when count(distinct rights) = 1 then min(rights) else 'private source; redistribution not authorized' end as rights, count(distinct rights) > 1 as rights_requires_review from e group by 1, 2, 3""")
def study_entries(t):
    kind = F.expr("case l_returnflag when 'R' then 'required' when 'A' then 'suggested' else 'references' end")
    rows = t.lineitem.filter("l_orderkey is not null and l_partkey is not null").select(F.lit("o").alias("owner_id"), F.col("l_orderkey").alias("activity_id"), F.col("l_partkey").alias("material_id"), kind.alias("kind"), F.when(F.col("l_suppkey") % 4 > 0, F.concat(F.lit("r"), (F.col("l_suppkey") % 3).cast("string"))).alias("rights"))
    packed = rows.groupBy("owner_id", "activity_id", "material_id").agg(graph.strongest().alias("relation"), F.sort_array(F.collect_set("kind")).alias("kinds"))
    return graph.study_entries(packed, rows).select("activity_id", "material_id", "role", "rights", "rights_requires_review")


@query("select o_custkey as entity_id, arg_min(o_orderstatus, o_orderkey) as state, arg_min(o_orderkey, o_orderkey)::varchar as timecompleted from orders where o_custkey is not null and o_orderkey % 3 > 0 group by 1")
def completion_trackers(t):
    o, k = F.lit("o").alias("owner_id"), F.col("o_orderkey")
    relations = t.orders.filter("o_custkey is not null").select(o, F.col("o_custkey").alias("from_id"), k.alias("to_id"), F.lit("tracks_completion").alias("kind"))
    entities = t.orders.select(o, k.alias("id"), F.when(k % 3 > 0, "completion_activity").otherwise("course").alias("kind"), F.to_json(F.struct(F.col("o_orderstatus").alias("state"), k.alias("timecompleted"))).alias("state"))
    return qualification.completion_trackers(relations, entities).select("entity_id", "state", "timecompleted")


@query("""with a as (select c_custkey as k, k % 9 > 0 as seen, case when k % 5 > 0 then k % 3 end as me, case when k % 9 > 0 then k % 3 + (k % 11 = 0)::int end as author, case when k % 9 > 0 and k % 2 = 0 then k % 3 + (k % 13 = 0)::int end as subject from customer where c_custkey % 6 > 0)
select k as entity_id, case when me is not null and subject = me then 'provenance_subject_userid' when subject is null and author = me then 'submission_userid' end as authorship_basis, case when seen then 'submitted' end as status,
array_to_string(list_filter([case when not seen then 'no_preserved_observation' end, case when not seen or k % 8 = 0 then 'observation_not_from_moodle' end, case when not seen or k % 3 = 2 then 'invalid_observation_coverage' end, case when not seen or k % 10 = 0 then 'connection_mismatch' end,
case when author is not null and author is distinct from me then 'submission_author_mismatch' end, case when me is null then 'connection_subject_unknown' end, case when me is not null and subject <> me then 'observation_author_mismatch' end, case when me is not null and subject is null and author is distinct from me then 'author_not_declared' end,
case when k % 7 = 0 then 'course_id_mismatch' end, case when k % 12 = 1 then 'instance_id_mismatch' end], lambda x: x is not null), ';') as reasons from a""")
def own_submission_status(t):
    k, o = F.col("c_custkey"), F.lit("o").alias("owner_id")
    state = lambda course, instance: F.to_json(F.struct(course.alias("course_id"), instance.alias("instance_id"))).alias("state")
    base = t.customer
    assignments = base.select(o, k.alias("entity_id"), F.lit("c").alias("connection_id"), F.when(k % 5 > 0, (k % 3).cast("string")).otherwise("").alias("provider_subject"), state(k % 4, k))
    linked = base.filter("c_custkey % 6 > 0")
    relations = linked.select(o, k.alias("from_id"), k.alias("to_id"), F.lit("has_own_submission_status").alias("kind"))
    statuses = base.select(o, k.alias("id"), F.lit("c").alias("connection_id"), F.lit("own_submission_status").alias("kind"), state(F.when(k % 7 > 0, k % 4), F.when(k % 12 != 1, k)))
    attempt = F.struct(F.struct(F.lit("SUBMITTED").alias("status"), (k % 3 + (k % 11 == 0).cast("int")).alias("userid")).alias("submission"))
    content = F.when(k % 4 == 0, F.to_json(F.struct(F.struct(attempt.alias("lastattempt")).alias("data")))).otherwise(F.to_json(F.struct(attempt.alias("lastattempt"))))
    origin = F.to_json(F.struct(F.when(k % 8 > 0, "moodle").otherwise("host").alias("system"), F.when(k % 10 > 0, "c").otherwise("d").alias("connection_id"), F.when(k % 2 == 0, k % 3 + (k % 13 == 0).cast("int")).alias("subject_userid")))
    newest = base.filter("c_custkey % 9 > 0").select(o, k.alias("entity_id"), k.alias("observation_id"), content.alias("content"), _pick(["complete", "partial", "denied"], k % 3).alias("coverage"), origin.alias("provenance"))
    return qualification.own_submission_status(assignments, relations, statuses, newest).select("entity_id", "authorship_basis", "status", F.array_join("reasons", ";").alias("reasons"))


# Follow-up policies


def _policies(t):
    k = F.col("c_custkey")
    return t.customer.select(k.alias("policy_id"), (k % 17 == 0).alias("paused"), F.when(k % 17 == 0, "manual").alias("pause_reason"), (k % 4).alias("failures"), (F.lit(_NOW) + (k % 3 - 1) * 1000).alias("next_at"), (F.lit(_NOW) + (k % 13) * 1000).alias("expires_at"), F.when(k % 5 == 0, F.concat(F.lit("r"), k.cast("string"))).alias("active_id"), F.when(k % 5 == 0, F.lit(_NOW) + (k % 2) * 1000 - 500).alias("active_deadline"), F.when(k % 6 > 0, k).alias("job_id"), F.lit(3_600_000).cast("long").alias("interval_ms"), F.lit(60_000).cast("long").alias("backoff_ms"), F.lit(4).alias("max_failures"), (k % 3).alias("revision"))


_STATE = f"""(select c_custkey as k, c_custkey % 17 = 0 as paused, case when c_custkey % 17 = 0 then 'manual' end as pause_reason, c_custkey % 4 as failures, {_NOW} + (c_custkey % 3 - 1) * 1000 as next_at, {_NOW} + (c_custkey % 13) * 1000 as expires_at,
c_custkey % 5 = 0 as active, c_custkey % 5 = 0 and c_custkey % 2 = 0 as lapsed, case when c_custkey % 6 > 0 then c_custkey end as job_id, c_custkey % 3 as revision from customer)"""


@query("""with o as (select o_custkey as p, o_orderkey as r, epoch_ms(o_orderdate) as t, o_orderkey % 7 as k from orders),
g as (select *, sum((k < 3)::int) over (partition by p order by t, r) as wins from o),
f as (select *, sum((k >= 3)::int) over (partition by p, wins order by t, r)::bigint as failures from g),
s as (select *, k = 6 or failures >= 3 as stops from f),
b as (select *, coalesce(bool_or(stops) over (partition by p order by t, r rows between unbounded preceding and 1 preceding), false) as before from s)
select p as policy_id, r as run_id, failures, (t + case when k = 0 then 3600000 when k < 3 then 60000 else least(86400000, 60000 * 2 ** least(failures - 1, 5)) end)::bigint as next_at, case when k = 6 then 'credential_expired' when failures >= 3 then 'failure_limit' end as pause_reason from b where not before""")
def settled_runs(t):
    k = F.col("o_orderkey") % 7
    runs = t.orders.select(F.col("o_custkey").alias("policy_id"), F.col("o_orderkey").alias("run_id"), _ms("o_orderdate").alias("at"), _pick(["complete", "progress", "progress", "timeout", "partial", "denied", "expired"], k).alias("outcome"))
    return followup.settle(runs, _policies(t).withColumn("max_failures", F.lit(3))).select("policy_id", "run_id", "failures", "next_at", "pause_reason")


@query(f"""with j as (select o_orderkey as job_id, case o_orderkey % 5 when 0 then 'failed' when 1 then 'complete' else 'partial' end as s, o_orderkey % 7 as a from orders where o_orderkey <= 1500),
x as (select *, case when lapsed then case when s = 'complete' then 0 else failures + 1 end else failures end as f1 from {_STATE} p left join j using (job_id)),
y as (select *, case when lapsed then {_NOW} + case when s = 'complete' then 3600000 else least(86400000, 60000 * 2 ** least(f1 - 1, 5)) end else next_at end as n1, paused or lapsed and f1 >= 4 as p1, case when lapsed and f1 >= 4 then 'failure_limit' else pause_reason end as r1 from x),
z as (select *, p1 or expires_at <= {_NOW} as p2, case when expires_at <= {_NOW} then 'policy_expired' else r1 end as r2 from y),
v as (select *, not p2 and not (active and not lapsed) and n1 <= {_NOW} as ready, job_id is not null and (s is null or s = 'failed' or a >= 5 and s <> 'complete') as stuck from z)
select k as policy_id, p2 or ready and stuck as paused, case when ready and stuck then 'job_terminal' else r2 end as pause_reason, f1 as failures, n1::bigint as next_at, case when ready and not stuck then case when job_id is null or s = 'complete' then 'new' else 'same' end end as wants from v""")
def prepared_policies(t):
    k = F.col("o_orderkey")
    jobs = t.orders.filter("o_orderkey <= 1500").select(k.alias("job_id"), F.when(k % 5 == 0, "failed").when(k % 5 == 1, "complete").otherwise("partial").alias("state"), (k % 7).alias("attempts"))
    return followup.prepare(_policies(t), jobs, F.lit(_NOW).cast("long")).select("policy_id", "paused", "pause_reason", "failures", "next_at", "wants")


@query(f"""with x as (select *, k % 2 = 0 as want, case when k % 4 > 0 then k % 9 = 0 or k % 3 > 0 end as same from {_STATE}),
y as (select *, case when k % 4 = 0 then null when not same then 'version_conflict' when not want and active then 'policy_busy' when not want and expires_at <= {_NOW} then 'policy_expiry' end as refusal from x),
z as (select *, k % 4 > 0 and refusal is null as done from y)
select k as policy_id, case when done then want else paused end as paused, case when done then case when want then 'manual' end else pause_reason end as pause_reason, failures + (done and active)::int as failures, revision + done::int as revision, active and not done as active, refusal from z""")
def paused_policies(t):
    p = _policies(t)
    k = F.col("policy_id")
    asked = p.filter(k % 4 > 0).select("policy_id", (k % 2 == 0).alias("pause"), F.when((k % 9 == 0) | (k % 3 > 0), k % 3).otherwise(7).alias("at_revision"))
    return followup.pause(p, asked, F.lit(_NOW).cast("long")).select("policy_id", "paused", "pause_reason", "failures", "revision", F.col("active_id").isNotNull().alias("active"), "refusal")


@query(f"select k as policy_id, failures + (active and k % 3 > 0)::int as failures, paused or active and k % 3 > 0 and failures = 3 as paused, active and k % 3 = 0 as active from {_STATE}")
def interrupted_runs(t):
    p = _policies(t)
    asked = p.select("policy_id", F.concat(F.when(F.col("policy_id") % 3 > 0, "r").otherwise("x"), F.col("policy_id").cast("string")).alias("run_id"))
    return followup.interrupt(p, asked, F.lit(_NOW).cast("long")).select("policy_id", "failures", "paused", F.col("active_id").isNotNull().alias("active"))


@query(f"""with s as (select o_custkey as s, count(*) as n from orders group by 1),
p as (select o_custkey as s, o_orderkey as p, row_number() over (partition by o_custkey order by o_orderkey) - 1 as pos, case when o_orderkey % 2 = 0 then o_orderkey % 4 else 0 end as tried from orders),
f as (select s, p, pos, n, tried, (pos - s % 3 + n) % n as turn from p join s using (s) where p % 31 < 28 and tried < 2 and (p % 5 > 0) and p % 400 <= 300 and p % 7 > 0)
select s as schedule_id, p as policy_id, (tried + 1)::bigint as attempts, ((pos + 1) % n)::bigint as cursor from f qualify row_number() over (partition by s order by turn) = 1""")
def next_scheduled_run(t):
    from attesta.operators import timeline

    k = F.col("o_orderkey")
    p = timeline.numbered(t.orders, ["o_custkey"], ["o_orderkey"])
    policies = p.select(F.col("o_custkey").alias("schedule_id"), k.alias("policy_id"), (F.col("version") - 1).cast("long").alias("position"), F.when(k % 2 == 0, "w2").otherwise("w1").alias("noted_key"), (k % 4).alias("attempts"), (k % 31).alias("runs"), F.when(k % 5 == 0, _NOW + 1).cast("long").alias("next_at"), (k % 400).alias("wall_ms"), (k % 7 == 0).alias("paused"))
    schedules = t.orders.groupBy(F.col("o_custkey").alias("schedule_id")).agg(F.count("*").alias("size")).withColumns({"window_key": F.lit("w2"), "window_end": F.lit(_NOW + 300).cast("long"), "cursor": F.col("schedule_id") % 3})
    return followup.next_run(schedules, policies, F.lit(_NOW).cast("long")).select("schedule_id", "policy_id", F.col("attempts").cast("long").alias("attempts"), F.col("cursor").cast("long").alias("cursor"))


@query("""with recursive a as (select o_custkey as c, o_orderkey as o, sum(trunc(l_quantity - 2)::bigint)::bigint as n, min(trunc(l_quantity - 2)) >= 0 as good from lineitem join orders on o_orderkey = l_orderkey where o_custkey is not null group by 1, 2),
b as (select *, row_number() over (partition by c order by o) as i from a),
f as (select c, o, n, i, case when good and n <= 400 then n else 0 end as used, not (good and n <= 400) as refused from b where i = 1
union all select b.c, b.o, b.n, b.i, f.used + case when good and b.n <= 400 - f.used then b.n else 0 end, not (good and b.n <= 400 - f.used) from f join b on b.c = f.c and b.i = f.i + 1)
select c as run_id, o as batch_id, n as bytes, used::bigint as used, case when refused then 'followup_write_budget' end as refusal from f""")
def write_budget(t):
    writes = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("batch_id"), (F.col("l_quantity") - 2).cast("long").alias("bytes"))
    return followup.write_budget(writes, t.orders.select(F.col("o_custkey").alias("run_id")).distinct().withColumn("limit", F.lit(400).cast("long")))
