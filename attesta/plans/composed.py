"""The composed flagship: every flag of an activity comes from preserved tables through an operator, none is handed in.

Orders are activities, their lines sightings, requirements, actions, posts and drafts; states,
snapshots and contents are JSON, built here as a source would store them and parsed by the engine.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.operators import attention, composition
from attesta.plans.queries import _kinds, _needs, query

_DUE, _LATER = 852076800, 852163200

_RAW = f"""needs as (select l_orderkey as e, l_linenumber::varchar as k, (['submission', 'forum_topic', 'forum_reply', 'completion', 'manual'])[(l_partkey + l_linenumber) % 5 + 1] as f, l_linenumber % 3 + 1 as least, count(*) over (partition by l_orderkey, (l_partkey + l_linenumber) % 5) as family, 'h' || (10 + l_suppkey % 3) as src, true as stated from lineitem where l_orderkey % 16 > 0),
reports as (select l_orderkey as e, (['submission', 'forum_topic', 'forum_reply', 'completion', 'deadline_change'])[l_suppkey % 5 + 1] as t, case when l_linenumber % 2 = 0 then l_linenumber::varchar end as k, l_linenumber as c from lineitem where l_returnflag = 'R'),
occ as (select l_orderkey as e, l_shipdate as seen_at, 'h' || (10 + l_partkey % 12) as h, case when l_linestatus = 'O' then 'partial' else 'complete' end as cov, case when l_partkey % 12 % 3 = 0 then {_DUE} else {_LATER} end as due, case when l_partkey % 12 % 2 = 0 then 'a' else 'b' end as intro from lineitem),
last as (select e, seen_at, h, cov, due, intro from occ qualify row_number() over (partition by e order by seen_at desc, h desc, cov desc) = 1),
prev as (select occ.e, occ.h, occ.due, occ.intro from occ join last on occ.e = last.e and occ.seen_at < last.seen_at and occ.h <> last.h qualify row_number() over (partition by occ.e order by occ.seen_at desc, occ.h desc) = 1),
acts as (select l_orderkey as e, count(case when l_partkey % 3 = 0 then 1 end) as sub, count(case when l_partkey % 3 = 1 then 1 end) as top, count(*) as n from lineitem where l_returnflag = 'A' and l_linestatus = 'F' and l_suppkey % 7 > 0 and l_linenumber = 1 group by 1),
posts as (select l_orderkey as e, l_linenumber as i, l_suppkey % 5 as author, l_orderkey % 5 as me, l_linestatus = 'O' as part from lineitem join orders on o_orderkey = l_orderkey where o_custkey % 3 = 1 and l_orderkey % 5 > 0),
forum as (select a.e, count(case when a.author = a.me and a.i = 1 then 1 end) as pubs, bool_or(a.author = a.me and a.i = 1 and a.part) as ptop, count(distinct case when a.author = a.me and b.author <> a.me then b.author end) as answered, coalesce(bool_or(a.author = a.me and b.author <> a.me and a.part), false) as prep from posts a left join posts b on b.e = a.e and b.i = a.i - 1 group by 1),
mats as (select l_orderkey as e, count(*) as changed from lineitem join part on p_partkey = l_partkey where l_returnflag = 'N' and l_quantity > 40 and l_suppkey % 4 <> p_size % 4 group by 1),
ent as (select o_orderkey as e, (['assignment', 'forum', 'module'])[o_custkey % 3 + 1] as kind, o_orderkey % 5 as me,
  case when o_custkey % 3 <> 1 and o_orderkey % 6 > 0 then o_orderkey % 8 > 0 and o_orderkey % 5 > 0 end as qualified, case when o_custkey % 3 <> 1 and o_orderkey % 6 > 0 and o_orderkey % 8 > 0 and o_orderkey % 5 > 0 then (['new', 'submitted', 'draft'])[o_orderkey % 3 + 1] end as native,
  o_orderkey % 13 = 0 and o_orderkey % 4 in (1, 2) or o_orderkey % 29 = 0 as done, o_orderkey % 17 = 0 and o_orderkey % 34 > 0 as legacy,
  case when o_orderkey % 4 > 0 then 'h' || (10 + o_orderkey % 12) end as presented, case when o_orderkey % 5 = 0 then 'h13' end as seen, o_orderkey % 19 = 0 as recorded from orders),
ev as (select ent.*, coalesce(sub, 0) as acts, coalesce(top, 0) as topacts, coalesce(n, 0) as nacts, coalesce(pubs, 0) as pubs, coalesce(ptop, false) as ptop, coalesce(answered, 0) as answered, coalesce(prep, false) as prep, forum.e is not null as forum, coalesce(changed, 0) as changed,
  last.h, last.cov, last.due as seen_due, last.intro as seen_intro, prev.h as ph, prev.due as pdue, prev.intro as pintro, recorded and last.h is not null and (last.due <> {_DUE} or last.intro <> 'a') as drift from ent left join acts using (e) left join forum using (e) left join mats using (e) left join last using (e) left join prev using (e)),
implied as (select e, 'submission' as k, 'submission' as f, 1 as least, 1 as family, null::varchar as src, false as stated from ent where kind = 'assignment' and e not in (select e from needs)),
told as (select n.*, (select count(*) from reports r where r.e = n.e and r.t = case f when 'manual' then 'completion' else f end and (r.k = n.k or r.k is null and family = 1 and f <> 'manual')) as n,
  (select coalesce(max(c), 0) from reports r where r.e = n.e and r.t = f and (r.k = n.k or r.k is null and family = 1)) as most, ev.* exclude (e) from (select * from needs union all select * from implied) n join ev using (e)),
v as (select *, case f
  when 'submission' then case when (n > 0 or legacy and family = 1) and native in ('new', 'draft', 'reopened') then 'uncertain:user_report_contradicts_native_status' when acts > 0 and native in ('new', 'draft', 'reopened') then 'uncertain:receipt_contradicts_native_status'
    when family > 1 and n = 0 then 'uncertain:multiple_obligations_require_specific_evidence' when n > 0 or legacy and family = 1 or acts > 0 or native = 'submitted' then 'satisfied:' when native in ('new', 'draft', 'reopened') then 'pending:native_status_reports_not_submitted' else 'pending:' end
  when 'forum_topic' then case when family > 1 and n = 0 then 'uncertain:multiple_obligations_require_specific_evidence' when pubs + topacts > 0 or n > 0 then 'satisfied:' when not forum then 'uncertain:connection_subject_unknown' else 'pending:no_preserved_owner_publication' end
  when 'forum_reply' then case when family > 1 and most < least then 'uncertain:multiple_obligations_require_specific_evidence' when answered >= least or most >= least then 'satisfied:' when not forum then 'uncertain:connection_subject_unknown' else 'pending:distinct_colleagues_below_required' end
  when 'completion' then case when family > 1 and n = 0 then 'uncertain:multiple_obligations_require_specific_evidence' when done or n > 0 then 'satisfied:' else 'pending:' end
  else case when n > 0 then 'satisfied:' else 'pending:manual_confirmation_pending' end end as found from told),
w as (select *, case when src <> h then 'uncertain' else split_part(found, ':', 1) end as verdict, concat_ws(';', nullif(split_part(found, ':', 2), ''), case when ptop and f = 'forum_topic' or prep and f = 'forum_reply' then 'positive_proof_from_partial_coverage' end, case when src <> h then 'requirement_source_changed_requires_review' end) as reasons from v)"""


def _tables(t):
    """The preserved tables of a course, from orders and their lines."""
    o, k, c = F.lit("o").alias("owner_id"), F.col("o_orderkey"), F.col("o_custkey")
    lk, ln = F.col("l_orderkey"), F.col("l_linenumber")
    subject = lambda e: F.when(e % 5 > 0, (e % 5).cast("string"))
    connection = lambda e: F.concat(F.lit("c"), (e % 5).cast("string"))
    target = lambda e, course: [course.alias("course_id"), e.alias("cmid"), (e % 1000).cast("string").alias("instance_id")]
    state = F.to_json(
        F.struct(
            (k % 50).alias("course_id"), k.alias("coursemodule"), (k % 1000).alias("instance_id"), F.when(k % 29 == 0, F.lit(True)).alias("completion"),
            F.when(k % 17 == 0, F.struct(F.when(k % 34 == 0, k.cast("string")).alias("delta_id"), F.lit(True).alias("reported"))).alias("user_report"),
            F.when(k % 4 > 0, F.struct(F.concat(F.lit("h"), (10 + k % 12).cast("string")).alias("content_hash"))).alias("attention_presented"), F.when(k % 5 == 0, F.struct(F.lit("h13").alias("content_hash"))).alias("attention_read"),
            F.when(k % 19 == 0, F.struct(F.lit(_DUE).alias("duedate"), F.lit("a").alias("intro"))).alias("provider_record"),
        )
    )
    entities = t.orders.select(o, k.alias("id"), connection(k).alias("connection_id"), subject(k).alias("provider_subject"), _kinds(t).alias("kind"), F.col("o_orderpriority").alias("title"), F.when(k % 23 == 0, "revoked").otherwise("connected").alias("connection_state"), state.alias("state"))
    n = F.col("l_partkey") % 12
    content = F.to_json(F.struct(F.when(n % 3 == 0, _DUE).otherwise(_LATER).alias("duedate"), F.when(n % 2 == 0, "a").otherwise("b").alias("intro")))
    seen = t.lineitem.select(o, lk.alias("entity_id"), F.concat(F.lit("h"), (10 + n).cast("string")).alias("content_hash"), F.col("l_shipdate").alias("observed_at"), F.when(F.col("l_linestatus") == "O", "partial").otherwise("complete").alias("coverage"), content.alias("content"))
    _, reports, _ = _needs(t)
    fulfilment = F.element_at(F.array(*[F.lit(f) for f in ("submission", "forum_topic", "forum_reply", "completion", "manual")]), ((F.col("l_partkey") + ln) % 5 + 1).cast("int"))
    source = F.concat(F.lit("h"), (10 + F.col("l_suppkey") % 3).cast("string"))
    needs = t.lineitem.filter("l_orderkey % 16 > 0").select(o, lk.alias("entity_id"), ln.cast("string").alias("requirement_key"), fulfilment.alias("fulfilment"), (ln % 3 + 1).alias("at_least"), source.alias("source_hash"))
    # Actions name their target in the snapshot; some of another course, some that failed.
    operation = F.element_at(F.array(F.lit("moodle.assignment.submit"), F.lit("moodle.forum.discussion"), F.lit("moodle.other")), (F.col("l_partkey") % 3 + 1).cast("int"))
    course = F.when(F.col("l_suppkey") % 7 > 0, lk % 50).otherwise(lk % 50 + 1)
    snapshot = F.to_json(F.struct(connection(lk).alias("connectionId"), operation.alias("operation"), F.struct(F.struct(*target(lk, course)).alias("target")).alias("content")))
    none = F.lit(None).cast("string")
    actions = t.lineitem.filter("l_returnflag = 'A' and l_linenumber = 1").select(
        o, F.concat_ws("-", lk, ln).alias("id"), F.when(lk % 2 == 0, connection(lk)).alias("connection_id"), F.when(lk % 3 == 0, operation).alias("operation"), none.alias("target"), snapshot.alias("snapshot"), none.alias("external_id"), F.when(F.col("l_linestatus") == "F", "succeeded").otherwise("failed").alias("state"), F.col("l_shipdate").alias("updated_at")
    )
    works = t.orders.filter("o_custkey % 3 <> 1 and o_orderkey % 6 > 0")
    tracked = t.orders.filter("o_orderkey % 13 = 0")
    tid, sid = F.concat(F.lit("t"), k.cast("string")), F.concat(F.lit("s"), k.cast("string"))
    relations = tracked.select(o, k.alias("from_id"), tid.alias("to_id"), F.lit("tracks_completion").alias("kind")).union(works.select(o, k, sid, F.lit("has_own_submission_status")))
    nodes = tracked.select(o, tid.alias("id"), connection(k).alias("connection_id"), F.lit("completion_activity").alias("kind"), F.to_json(F.struct((k % 4).alias("state"))).alias("state")).union(
        works.select(o, sid, connection(k), F.lit("own_submission_status"), F.to_json(F.struct((k % 50).alias("course_id"), (k % 1000).alias("instance_id"))))
    )
    attempt = F.struct(F.struct(F.element_at(F.array(F.lit("NEW"), F.lit("submitted"), F.lit("Draft")), (k % 3 + 1).cast("int")).alias("status"), (k % 5).alias("userid")).alias("submission"))
    origin = F.to_json(F.struct(F.when(k % 8 > 0, "moodle").otherwise("host").alias("system"), connection(k).alias("connection_id"), F.when(k % 2 == 0, k % 5).alias("subject_userid")))
    observed = works.select(o, sid.alias("entity_id"), sid.alias("observation_id"), F.to_json(F.struct(attempt.alias("lastattempt"), F.struct((k % 2 == 0).alias("available")).alias("feedback"))).alias("content"), F.lit("complete").alias("coverage"), origin.alias("provenance"))
    posts = t.lineitem.join(t.orders.filter("o_custkey % 3 = 1").select("o_orderkey"), lk == k).select(
        o, lk.alias("forum_id"), lk.alias("discussion_id"), ln.cast("string").alias("post_id"), (ln - 1).cast("string").alias("parent_id"), (F.col("l_suppkey") % 5).cast("string").alias("author_id"), subject(lk).alias("subject"), F.when(F.col("l_linestatus") == "O", "partial").otherwise("complete").alias("coverage")
    )
    version = lambda x: F.concat(F.lit("m"), (x % 4).cast("string"))
    drafts = t.lineitem.filter("l_returnflag = 'N' and l_quantity > 40").select(o, lk.alias("focal_id"), ln.alias("draft_id"), F.col("l_partkey").alias("entity_id"), version(F.col("l_suppkey")).alias("base_hash"))
    materials = t.part.select(F.col("p_partkey").alias("entity_id"), version(F.col("p_size")).alias("content_hash"))
    superseded = t.orders.filter("o_orderkey % 34 = 0").select(o, k.alias("delta_id"))
    return entities, seen, needs, reports, actions, relations, nodes, observed, posts, drafts, materials, superseded


@query(f"""with {_RAW},
g as (select e, count(*) as judged, count(case when stated then 1 end) as requirements, case when bool_or(verdict = 'uncertain') then 'uncertain' when bool_and(verdict = 'satisfied') then 'concluded' else 'pending' end as state, bool_or(contains(reasons, '_contradicts_native_status')) as contradiction from w group by e),
rep as (select e, bool_or(t = 'submission') as handed, bool_or(t = 'completion') as completed, bool_or(t = 'deadline_change') as news from reports group by e),
x as (select ev.*, case when drift then {_DUE} when h is null and recorded then {_DUE} else seen_due end as due, case when drift then 'a' when h is null and recorded then 'a' else seen_intro end as intro, coalesce(handed, false) or legacy or nacts > 0 or coalesce(native = 'submitted', false) as handed, coalesce(news, false) as news, coalesce(requirements, 0)::bigint as requirements, coalesce(contradiction, false) as contradiction,
  coalesce(g.state, case when kind = 'forum' then 'uncertain' when kind = 'assignment' and (coalesce(handed, false) or legacy or nacts > 0 or coalesce(native = 'submitted', false)) or kind = 'module' and (done or coalesce(completed, false)) then 'concluded' else 'pending' end) as state from ev left join g using (e) left join rep using (e))
select e as entity_id, kind, state, requirements, h as content_hash, ph as previous_hash, array_to_string(list_sort(list_filter([
  case when ph is not null and presented is distinct from h and pdue is distinct from due then 'deadline_changed' end, case when ph is not null and presented is distinct from h and pintro is distinct from intro then 'instructions_changed' end, case when news then 'deadline_change' end,
  case when qualified and e % 2 = 0 then 'feedback_available' end, case when presented is null then 'not_presented' end, case when presented <> h then 'changed_since_presented' end, case when seen <> h then 'changed_since_read' end,
  case when e % 23 = 0 then 'access_lost' end, case when cov <> 'complete' then 'incomplete_coverage' end, case when due = {_DUE} then 'deadline_near' end, case when kind = 'forum' and requirements = 0 then 'requirement_not_interpreted' end, case when kind = 'assignment' and not handed then 'submission_evidence_missing' end,
  case when state = 'uncertain' then 'academic_uncertain' end, case when not qualified then 'own_submission_status_unqualified' end, case when contradiction then 'report_observation_contradiction' end, case when drift then 'unrecorded_reobservation' end, case when changed > 0 then 'material_dependency_changed' end], lambda i: i is not null)), ';') as items from x""")
def composed_attention(t):
    """State, change and attention items of every activity from twelve preserved tables, folded in one shuffle by activity."""
    out = attention.overview(*composition.composed(*_tables(t)), F.timestamp_seconds(F.lit(_DUE - 6 * 86400)), days=6, implied=True)
    return out.select("entity_id", "kind", "state", "requirements", "content_hash", "previous_hash", F.array_join("items", ";").alias("items"))


@query(f"""with {_RAW} select e as l_orderkey, k as requirement_key, f as fulfilment, verdict, reasons,
array_to_string(list_filter([case when n > 0 then 'user_report_delta:' || n end, case when f = 'submission' and family = 1 and n = 0 and legacy then 'legacy_state_user_report:1' end, case when f = 'submission' and acts > 0 then 'confirmed_academic_action:' || acts when f = 'forum_topic' and topacts > 0 then 'confirmed_academic_action:' || topacts end,
  case when f = 'submission' and qualified is not null then 'own_submission_status:1' end, case when f = 'forum_topic' and pubs > 0 then 'forum_publication:' || pubs end, case when f = 'forum_reply' and answered > 0 then 'forum_reply:' || answered end, case when f = 'completion' and done then 'native_completion:1' end], lambda i: i is not null), ';') as evidence,
case when contains(reasons, '_contradicts_native_status') then 'keep_report_and_native_observation_separate' end as reconciliation, case when contains(reasons, 'distinct_colleagues_below_required') then least end as required_at_least, case when contains(reasons, 'distinct_colleagues_below_required') then answered end as observed_distinct_colleagues from w where stated""")
def requirement_evidence(t):
    """Each requirement's verdict with the evidence it rests on."""
    out = attention.requirement_evidence(attention.facts(*composition.composed(*_tables(t)), implied=True))
    listed = F.array_join(F.transform("evidence", lambda x: F.concat_ws(":", x["basis"], x["n"])), ";")
    return out.select(F.col("entity_id").alias("l_orderkey"), "requirement_key", "fulfilment", "verdict", F.array_join("reasons", ";").alias("reasons"), listed.alias("evidence"), "reconciliation", "required_at_least", "observed_distinct_colleagues")


@query("select l_orderkey as entity_id, l_orderkey || '-' || l_linenumber as action_id, (['moodle.assignment.submit', 'moodle.forum.discussion', 'moodle.other'])[l_partkey % 3 + 1] as operation from lineitem join orders on o_orderkey = l_orderkey where l_returnflag = 'A' and l_linestatus = 'F' and l_suppkey % 7 > 0 and l_linenumber = 1")
def confirmed_actions(t):
    tables = _tables(t)
    return composition.action_receipts(tables[0], composition.confirmed_actions(tables[4])).select("entity_id", "action_id", "operation")
