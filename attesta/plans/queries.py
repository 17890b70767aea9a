"""Registered queries: each applies operators to the driver's tables, with the DuckDB SQL for the same rows.

``events`` stand for sightings: a user is the entity, type and properties are the content.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attesta.functions import hashing, jsonfn, text, timefn
from attesta.operators import attention, events as ev, graph, joins, lifecycle, merge, paging, preferences, records, search, storage, timeline
from attesta.sources import documents
from attesta.tables import Tables, optional

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Query]:
    def add(f: Callable[[Tables], DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE[f.__name__] = sql
        return run

    return add


def _sightings(t: Tables) -> DataFrame:
    return t.events.withColumn("content_hash", F.sha2(F.concat_ws("|", "event_type", "props"), 256))


_S = "(select *, sha256(concat_ws('|', event_type, props)) as content_hash from events)"


# Timelines


@query("select event_id, user_id, ts, event_type, value from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def latest_event_per_user(t):
    return timeline.latest(t.events, ["user_id"], "ts", "event_id").select("event_id", "user_id", "ts", "event_type", "value")


@query("""with r as (select *, first_value(ts) over w as lt, first_value(event_id) over w as li, first_value(event_type) over w as lc from events window w as (partition by user_id order by ts desc, event_id desc)),
p as (select user_id, ts, event_id, event_type, row_number() over (partition by user_id order by ts desc, event_id desc) as n from r where ts < lt and event_type <> lc)
select distinct r.user_id, r.lt as ts, r.li as event_id, r.lc as event_type, p.ts as previous_ts, p.event_id as previous_event_id, p.event_type as previous_event_type
from r left join p on p.user_id = r.user_id and p.n = 1""")
def previous_distinct_event(t):
    return timeline.previous_distinct(t.events.select("user_id", "ts", "event_id", "event_type"), ["user_id"], "ts", "event_id", "event_type")


@query("select user_id, event_id, value from (select * from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1) where event_type = 'click'")
def latest_then_filter(t):
    return timeline.latest_where(t.events, ["user_id"], "ts", "event_id", "event_type = 'click'").select("user_id", "event_id", "value")


@query("with r as (select user_id, event_id, row_number() over (partition by user_id order by ts desc, event_id desc) as rn, count(*) over (partition by user_id) as n from events) select user_id, event_id, rn::int as rn, n > 5 as truncated from r where rn <= 5")
def topk_events_per_user_sentinel(t):
    return timeline.top_k(t.events, ["user_id"], [F.desc("ts"), F.desc("event_id")], 5).select("user_id", "event_id", F.col("rn").cast("int").alias("rn"), "truncated")


@query(f"select user_id, content_hash, event_id, ts from {_S} qualify row_number() over (partition by user_id, content_hash order by ts, event_id) = 1")
def snapshot_dedup(t):
    return timeline.snapshots(_sightings(t), ["user_id"], "content_hash", "ts", "event_id").select("user_id", "content_hash", "event_id", "ts")


@query(f"select distinct user_id, content_hash, ts from {_S}")
def occurrence_log(t):
    return timeline.occurrence_log(_sightings(t), ["user_id"], "content_hash", "ts").select("user_id", "content_hash", "ts")


@query(f"with s as (select user_id, content_hash, arg_min(value, (ts, event_id)) as value from {_S} group by all) select e.event_id, e.user_id, e.ts, e.content_hash, s.value from {_S} e join s using (user_id, content_hash)")
def timeline_join(t):
    seen = _sightings(t)
    first = timeline.snapshots(seen, ["user_id"], "content_hash", "ts", "event_id")
    return timeline.timeline(seen, first, ["user_id"], "content_hash", ["value"]).select("event_id", "user_id", "ts", "content_hash", "value")


@query("select user_id, count(*) as occurrences, count(distinct event_type) as snapshots, count(*) - count(distinct event_type) as revisits from events group by user_id")
def aba_revisits(t):
    return timeline.revisits(t.events, ["user_id"], "event_type")


@query("select user_id, event_id, event_type from (select *, lag(event_type) over w as b, row_number() over w as n from events window w as (partition by user_id order by ts, event_id)) where n = 1 or event_type is distinct from b")
def change_points(t):
    return timeline.change_points(t.events, ["user_id"], "ts", "event_id", "event_type").select("user_id", "event_id", "event_type")


@query("with l as (select user_id, arg_max(event_type, (ts, event_id)) as seen from events group by user_id) select c_custkey, c_mktsegment, case when seen is null then 'unknown' when lower(c_mktsegment) = seen then 'true' else 'false' end as matches_latest from customer left join l on user_id = c_custkey")
def drift_flag(t):
    newest = timeline.latest(t.events, ["user_id"], "ts", "event_id").select(F.col("user_id").alias("c_custkey"), "event_type")
    return timeline.drift(t.customer.withColumn("state", F.lower("c_mktsegment")), newest, "c_custkey", "state", "event_type").select("c_custkey", "c_mktsegment", F.coalesce(F.col("matches_latest").cast("string"), F.lit("unknown")).alias("matches_latest"))


@query("with n as (select user_id, arg_max(event_type, (ts, event_id)) as now from events group by user_id) select e.user_id, e.event_type, min(ts) as first_seen, max(ts) as last_seen, case when e.event_type = any_value(now) then 'current' else 'previous' end as kind from events e join n using (user_id) group by e.user_id, e.event_type")
def scd2_single_current_edge(t):
    return timeline.single_current(t.events, ["user_id"], "event_type", "ts", "event_id")


@query("select event_id, user_id, row_number() over (partition by user_id order by ts, event_id)::int as version from events")
def delta_version_numbers(t):
    return timeline.numbered(t.events, ["user_id"], ["ts", "event_id"]).select("event_id", "user_id", F.col("version").cast("int").alias("version"))


@query("select event_id, count(*) over (partition by user_id, event_type) as versions from events")
def occurrences_per_node(t):
    return timeline.occurrences_per(t.events, ["user_id", "event_type"]).select("event_id", "versions")


@query("""with o as (select event_id, user_id, event_type, value from events), n as (select event_id, user_id, event_type, -value as value from events where event_id % 2 = 0)
select * from n union all select * from o where event_id not in (select event_id from n)""")
def upsert_replace(t):
    e = t.events.select("event_id", "user_id", "event_type", "value")
    return timeline.upsert(e, e.filter("event_id % 2 = 0").withColumn("value", -F.col("value")), ["event_id"])


@query("""with o as (select event_id from events where event_id % 3 = 0), n as (select event_id from events)
select event_id, event_id % 3 <> 0 as is_new from (select event_id from o union select event_id from n)""")
def insert_ignore(t):
    e = t.events.select("event_id")
    out = timeline.insert_ignore(e.filter("event_id % 3 = 0").withColumn("is_new", F.lit(False)), e.withColumn("is_new", F.lit(True)), ["event_id"])
    return out


@query("""select c_custkey, case when c_custkey % 2 = 0 then c_nationkey + 100 else c_nationkey end as a, case when c_custkey % 2 = 0 then 7 end as b, c_nationkey as keep from customer""")
def upsert_merge(t):
    old = t.customer.select("c_custkey", F.create_map(F.lit("a"), F.col("c_nationkey"), F.lit("keep"), F.col("c_nationkey")).alias("state"))
    new = t.customer.filter("c_custkey % 2 = 0").select("c_custkey", F.create_map(F.lit("a"), F.col("c_nationkey") + 100, F.lit("b"), F.lit(7)).alias("state"))
    out = timeline.upsert_merge(old, new, ["c_custkey"])
    at = lambda k: F.try_element_at("state", F.lit(k)).alias(k)
    return out.select("c_custkey", at("a"), at("b"), at("keep"))


@query("select user_id, event_id, ts from events qualify row_number() over (partition by user_id order by ts desc, event_id desc) = 1")
def late_arrival_projection(t):
    e = t.events.select("user_id", "event_id", "ts")
    projected = timeline.latest(e.filter("event_id % 2 = 0"), ["user_id"], "ts", "event_id")
    return timeline.guarded_projection(projected, e.filter("event_id % 2 = 1"), ["user_id"], "ts", "event_id")


# Pages


@query("with p as (select event_id, ts from events where (ts, event_id) < (timestamp '2024-01-15 00:00:00', 500) order by ts desc, event_id desc limit 20) select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') as cursor from p")
def keyset_page_desc(t):
    page = paging.keyset_desc(t.events, "ts", "event_id", ("2024-01-15 00:00:00", 500))
    return page.select("event_id", paging.cursor_text(F.col("ts")).alias("cursor"))


@query("select o_orderkey, o_custkey from orders where o_orderkey > 1000 order by o_orderkey limit 20")
def keyset_page_asc(t):
    return paging.keyset_asc(t.orders, "o_orderkey", 1000).select("o_orderkey", "o_custkey")


@query("select o_orderkey, case when (select count(*) from orders) > 60 then 60 end::int as next_offset from (select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20 offset 40)")
def offset_page_sentinel(t):
    return paging.offset_page(t.orders.select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 40).select("o_orderkey", F.col("next_offset").cast("int").alias("next_offset"))


@query("select doc_id, i::int as chunk_no, substring(text, (i * 2000 + 1)::bigint, 2000) as chunk from documents, unnest(range(greatest(1, ceil(length(text) / 2000.0))::bigint)) as r(i)")
def doc_text_chunks(t):
    return paging.text_chunks(t.documents, "text", 2000).select("doc_id", "chunk_no", "chunk")


@query("select doc_id, p.first, p.length from (select doc_id, unnest([{'first': i * 4096, 'length': least(4096, strlen(text) - i * 4096)} for i in range(greatest(1, ceil(strlen(text) / 4096.0))::bigint)]) as p from documents)")
def byte_ranges(t):
    return t.documents.select("doc_id", F.inline(paging.byte_parts(F.octet_length("text").cast("long"), 4096)))


# Search


@query("select doc_id, substring(text, greatest(position('tion' in lower(text)) - 120, 1)::bigint, 800) as excerpt, length(text)::int as length from documents where text ilike '%tion%'")
def doc_search_excerpt(t):
    return search.search_documents(t.documents, "doc_id", "text", "tion")


@query("select doc_id, source from documents where list_has_all(list_distinct(regexp_extract_all(lower(text), '([\\p{L}\\p{N}]+)', 1)), ['the', 'with', 'that'])")
def doc_fts_simple(t):
    return t.documents.filter(search.has_all(F.col("text"), "That with THE")).select("doc_id", "source")


@query("select p_partkey, p_name from part where p_brand = (select min(p_brand) from part) and p_name ilike '%e_%'")
def optional_filter_entities(t):
    first = t.part.agg(F.min("p_brand")).first()[0]
    return optional(t.part, p_brand=first, p_type=None).filter(search.contains(F.col("p_name"), "e_")).select("p_partkey", "p_name")


# Storage


@query("with b as (select source, sha256(text) as h, count(*) as refs, any_value(strlen(text)) as bytes from documents group by all) select source, sum(refs)::bigint as files, count(*) as blobs, sum(bytes * refs)::bigint as preserved_bytes, sum(bytes)::bigint as stored_bytes, greatest(sum(bytes * refs) - sum(bytes), 0)::bigint as saved_bytes from b group by source")
def doc_dedup_savings(t):
    return storage.dedup_savings(t.documents, ["source"], "text")


@query("select sha256(text) as sha256 from documents group by 1 having bool_and(doc_id % 2 = 1)")
def doc_unreferenced(t):
    blobs = storage.blobs_of(t.documents, [], "text").select("sha256")
    return storage.unreferenced(blobs, t.documents.filter("doc_id % 2 = 0").select(F.sha2("text", 256).alias("sha256")), ["sha256"])


@query("select count(*) as row_count, md5(string_agg(h, '' order by h)) as fingerprint from (select md5(concat_ws('|', n_nationkey, n_name, n_regionkey)) as h from nation)")
def table_fingerprint(t):
    return storage.fingerprint(t.nation, [F.col(c).cast("string") for c in ("n_nationkey", "n_name", "n_regionkey")])


@query("select (select count(*) from customer) as customer, (select count(*) from orders) as orders, (select count(*) from documents) as documents, (select count(*) from events) as events")
def usage_counters(t):
    return storage.usage({n: getattr(t, n) for n in ("customer", "orders", "documents", "events")})


@query("select doc_id, 'cas/' || substring(sha256(text), 1, 2) || '/' || sha256(text) as address, 4096 + 4 * strlen(text)::int as write_bytes from documents")
def content_addresses(t):
    return t.documents.select("doc_id", hashing.cas_path(F.sha2("text", 256)).alias("address"), hashing.logical_write_bytes(F.col("text")).alias("write_bytes"))


# Text


@query(r"""with l as (select doc_id, unnest([regexp_replace(u, '[.,;:]+$', '') for u in regexp_extract_all(text, 'https?://[^\s<>"'')\]}]+')]) as link from (select page_id as doc_id, 'see ' || url || '.' as text from pages)) select link, count(*) as n from l group by link""")
def page_links(t):
    body = F.concat(F.lit("see "), F.col("url"), F.lit("."))
    return t.pages.select(F.explode(text.links(body)).alias("link")).groupBy("link").agg(F.count("*").alias("n"))


_quoted = lambda p: "'" + p.replace("'", "''") + "'"


def _redaction_sql() -> str:
    steps, at = [], "d0"
    steps.append("d0 as (select doc_id, text as t, 0 as hits from documents union all select page_id + 1000000, 'x sk-' || repeat('a', 10 + (page_id % 10)::int) || ' ghp_' || repeat('B', 15 + (page_id % 10)::int) || ' client_secret=\"' || repeat('c', 12 + (page_id % 8)::int) || '\" senha: ' || repeat('d', 20) || ' end', 0 from pages)")
    for i, p in enumerate(text.SECRETS, 1):
        steps.append(f"d{i} as (select doc_id, regexp_replace(t, {_quoted(p)}, '[REDACTED]', 'g') as t, hits + len(regexp_extract_all(t, {_quoted(p)})) as hits from {at})")
        at = f"d{i}"
    return f"with {', '.join(steps)} select doc_id, (hits + len(regexp_extract_all(t, {_quoted(text.KEYED_SECRET)})))::int as hits, regexp_replace(t, {_quoted(text.KEYED_SECRET)}, '\\1[REDACTED]', 'g') as redacted from {at} where hits + len(regexp_extract_all(t, {_quoted(text.KEYED_SECRET)})) > 0"


@query(_redaction_sql())
def doc_redaction_hits(t):
    n = lambda least, most: (F.lit(least) + F.col("page_id") % most).cast("int")
    made = F.concat(F.lit("x sk-"), F.repeat(F.lit("a"), n(10, 10)), F.lit(" ghp_"), F.repeat(F.lit("B"), n(15, 10)), F.lit(' client_secret="'), F.repeat(F.lit("c"), n(12, 8)), F.lit('" senha: '), F.repeat(F.lit("d"), F.lit(20)), F.lit(" end"))
    rows = t.documents.select("doc_id", "text").union(t.pages.select(F.col("page_id") + 1000000, made))
    return rows.select("doc_id", text.secret_count(F.col("text")).cast("int").alias("hits"), text.redacted(F.col("text")).alias("redacted")).filter("hits > 0")


@query("select doc_id, case when text = '' then 0 else len(string_split(text, chr(10))) - case when text like '%' || chr(10) then 1 else 0 end end::int as lines, case when contains(text, chr(10)) then 'lf' else 'none' end as eol from documents")
def doc_line_stats(t):
    return t.documents.select("doc_id", text.line_count(F.col("text")).cast("int").alias("lines"), text.line_ends(F.col("text")).alias("eol"))


@query(r"select min(doc_id) as first_doc, count(*) as copies from documents group by trim(regexp_replace(text, '\s+', ' ', 'g')) having count(*) > 1")
def doc_ws_normalised_dupes(t):
    return t.documents.groupBy(F.md5(text.squeezed(F.col("text"))).alias("k")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies")).filter("copies > 1").drop("k")


@query(r"""select page_id, regexp_replace(lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)) || substring(url, length(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)) + 1), '/+$', '') as url from pages""")
def canonical_urls(t):
    return t.pages.select("page_id", text.canonical_url(F.col("url")).alias("url"))


# Graphs


@query("select distinct o_custkey, l_partkey from orders join lineitem on o_orderkey = l_orderkey union select s_suppkey, l_partkey from supplier join lineitem on s_suppkey = l_suppkey")
def graph_two_hop_union(t):
    bought = graph.two_hop(t.orders.withColumnRenamed("o_orderkey", "l_orderkey"), t.lineitem, "o_custkey", "l_orderkey", "l_partkey")
    sold = t.lineitem.join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").select(F.col("l_suppkey").alias("o_custkey"), "l_partkey")
    return graph.union_paths(bought, sold)


_KIND = "case l_returnflag when 'R' then 'required' when 'A' then 'suggested' else 'references' end"


@query(f"select l_orderkey, list_extract(['required', 'related', 'suggested', 'has_content', 'section_related', 'references'], min(list_position(['required', 'related', 'suggested', 'has_content', 'section_related', 'references'], {_KIND}))) as relation from lineitem group by l_orderkey")
def relation_precedence(t):
    return t.lineitem.withColumn("kind", F.expr(_KIND)).groupBy("l_orderkey").agg(graph.strongest().alias("relation"))


@query("select o_custkey, min(o_orderstatus) as o_orderstatus from orders group by o_custkey having count(distinct o_orderstatus) = 1")
def unique_target_binding(t):
    return graph.unique_targets(t.orders, ["o_custkey"], "o_orderstatus")


@query("with c as (select l_orderkey, count(distinct l_suppkey) as candidates, min(l_suppkey) as one from lineitem group by 1) select o_orderkey, coalesce(candidates, 0) as candidates, case when candidates = 1 then one end as l_suppkey, case when candidates is null then 'missing' when candidates = 1 then 'resolved' else 'ambiguous' end as status from orders left join c on l_orderkey = o_orderkey")
def unique_match_refusal(t):
    orders = t.orders.select(F.col("o_orderkey").alias("k"))
    return joins.unique_match(orders, t.lineitem.select(F.col("l_orderkey").alias("k"), "l_suppkey"), ["k"], "l_suppkey").withColumnRenamed("k", "o_orderkey")


@query("""with m as (select l_orderkey as id, count(distinct l_partkey) as n, min(l_partkey) as s from lineitem group by 1)
select distinct id as activity_id, l_orderkey as material_id from m join lineitem on n = 1 and l_partkey = s where l_orderkey <> id""")
def study_graph_siblings(t):
    held = t.lineitem.select(F.lit("o").alias("owner_id"), F.concat(F.lit("s"), "l_partkey").alias("from_id"), F.concat(F.lit("m"), "l_orderkey").alias("to_id"), F.lit("has_module").alias("kind")).distinct()
    focal = t.orders.select(F.lit("o").alias("owner_id"), F.concat(F.lit("m"), "o_orderkey").alias("activity_id"))
    out = graph.section_siblings(held, graph.resolve_section(held, focal))
    number = lambda c: F.substring(c, 2, 20).cast("long")
    return out.select(number("activity_id").alias("activity_id"), number("material_id").alias("material_id"))


# Joins


@query("select c_custkey, c_name from customer where exists (select 1 from orders where o_custkey = c_custkey)")
def semi_customers_with_orders(t):
    return t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey", "c_name")


@query("select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 400000)")
def anti_customers_without_orders(t):
    return t.customer.join(t.orders.filter("o_totalprice > 400000"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey", "c_name")


@query("select p_partkey from part where exists (select 1 from lineitem where l_partkey = p_partkey and l_quantity > 49) or exists (select 1 from supplier where s_suppkey = p_partkey and s_acctbal < 0)")
def or_exists_split(t):
    return joins.exists_either(t.part.select("p_partkey"), (t.lineitem.filter("l_quantity > 49"), "p_partkey", "l_partkey"), (t.supplier.filter("s_acctbal < 0"), "p_partkey", "s_suppkey"))


@query("with l as (select case when doc_id % 5 = 0 then null else quality end as q, count(*) as n from labels group by 1), r as (select case when doc_id % 7 = 0 then null else toxic end as q, count(*) as m from labels group by 1) select l.q, n, m from l join r on l.q is not distinct from r.q")
def null_safe_join(t):
    left = t.labels.groupBy(F.expr("case when doc_id % 5 = 0 then null else quality end").alias("q")).agg(F.count("*").alias("n"))
    right = t.labels.groupBy(F.expr("case when doc_id % 7 = 0 then null else toxic end").alias("q")).agg(F.count("*").alias("m"))
    return joins.null_safe(left, right, ["q"])


@query("with w as (select user_id, ts as s, ts + interval 1 hour as e, event_id as w_id from events where event_type = 'signup') select e.event_id, w_id from events e join w on e.user_id = w.user_id and e.ts >= w.s and e.ts < w.e")
def schedule_window_membership(t):
    w = t.events.filter("event_type = 'signup'").select("user_id", F.col("ts").alias("s"), (F.col("ts") + F.expr("interval 1 hour")).alias("e"), F.col("event_id").alias("w_id"))
    return joins.in_windows(t.events, w, "ts", "s", "e", ["user_id"], 3600).select("event_id", "w_id")


@query("select a.conv_id, a.turn, a.role, b.role as parent_role from conversations a left join conversations b on a.conv_id = b.conv_id and b.turn = a.turn - 1")
def parent_lookup(t):
    c = t.conversations.select("conv_id", "turn", "role", (F.col("turn") - 1).alias("parent_turn"))
    return joins.parent_of(c, ["conv_id"], "turn", "parent_turn", ["role"]).select("conv_id", "turn", "role", "parent_role")


@query("with r as (select a.conv_id, a.role, b.role as p from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn - 1 where a.role <> b.role) select conv_id, count(*) as replies, count(distinct p) as answered from r group by conv_id")
def reply_parent_authors(t):
    c = t.conversations.select("conv_id", "turn", (F.col("turn") - 1).alias("parent"), "role")
    r = attention.reply_parents(c, ["conv_id"], "turn", "parent", "role").filter("role <> parent_author")
    return r.groupBy("conv_id").agg(F.count("*").alias("replies"), F.count_distinct("parent_author").alias("answered"))


# JSON and scopes


@query("select event_id, json_extract_string(props, '$.k')::int <= 50 as within from events")
def scope_containment(t):
    k = F.get_json_object("props", "$.k").cast("int")
    outer = F.to_json(F.struct(F.least(k, F.lit(50)).alias("k"), F.lit("x").alias("other")))
    return t.events.select("event_id", jsonfn.contained(F.col("props"), outer).alias("within"))


@query("select event_id, json_extract_string(props, '$.k')::int as k, list_contains(json_keys(props), 'k') as has_k from events")
def json_paths(t):
    return t.events.select("event_id", jsonfn.any_path(F.col("props"), "$.missing", "$.k").cast("int").alias("k"), jsonfn.has_key(F.col("props"), "k").alias("has_k"))


@query("""select event_id, '{"a":[1,{"x":null,"y":"é"}],"b":{"c":' || user_id || ',"d":"' || event_type || '"},"k":' || json_extract_string(props, '$.k') || '}' as canonical from events""")
def json_canonical(t):
    made = F.concat(F.lit('{ "k": '), F.get_json_object("props", "$.k"), F.lit(', "b": {"d": "'), F.col("event_type"), F.lit('", "c": '), F.col("user_id").cast("string"), F.lit('}, "a" : [1, {"y": "é", "x": null}] }'))
    return t.events.select("event_id", jsonfn.canonical(made).alias("canonical"))


# Coverage and merges

_COVER = "case event_type when 'click' then 'complete' when 'view' then 'partial' when 'signup' then 'timeout' when 'purchase' then 'denied' else 'parsing_error' end"
_RANK = "case {} when 'complete' then 0 when 'partial' then 1 when 'timeout' then 2 when 'parsing_error' then 3 when 'denied' then 5 end"


@query(f"select user_id, date_trunc('hour', ts) as hour, arg_max({_COVER}, {_RANK.format(_COVER)}) as coverage from events group by all")
def coverage_worst_of(t):
    return t.events.withColumns({"coverage": F.expr(_COVER), "hour": F.date_trunc("hour", "ts").cast("timestamp_ntz")}).groupBy("user_id", "hour").agg(merge.worst_coverage().alias("coverage"))


@query("select source, doc_id, n_chars from documents qualify row_number() over (partition by source, lang order by case when lang = 'en' then 5 else 4 end * 1000000000::bigint + least(n_chars, 999999999) desc, doc_id) = 1")
def strength_merge(t):
    d = t.documents.select("source", "lang", "doc_id", "n_chars")
    score = merge.strength(F.when(F.col("lang") == "en", "complete").otherwise("partial"), F.col("n_chars"))
    return merge.keep_strongest(d, ["source", "lang"], score, "doc_id").select("source", "doc_id", "n_chars")


@query("select l_orderkey, n as missing from (select l_orderkey, list(distinct l_linenumber) as have, max(l_linenumber) as top from (select l_orderkey, l_linenumber + l_partkey % 3 as l_linenumber from lineitem) group by 1), unnest(range(1, top + 1)) as r(n) where not list_contains(have, n)")
def gap_pages(t):
    return merge.gaps(t.lineitem.select("l_orderkey", (F.col("l_linenumber") + F.col("l_partkey") % 3).alias("l_linenumber")), ["l_orderkey"], "l_linenumber")


@query("""with p as (select conv_id, list(case when turn % 3 <> 1 then turn + 1 end) as have, list(case when length(text) > 400 then turn + 1 end) as cut, max(turn) + 2 as n from conversations group by 1)
select conv_id, coalesce((select min(x) from unnest(range(1, n + 1)) as r(x) where not list_contains(have, x)), list_min(cut))::bigint as next_page from p""")
def next_page_to_read(t):
    p = t.conversations.groupBy("conv_id").agg(F.collect_list(F.when(F.col("turn") % 3 != 1, F.expr("int(turn + 1)"))).alias("have"), F.collect_list(F.when(F.length("text") > 400, F.expr("int(turn + 1)"))).alias("cut"), (F.max("turn") + 2).cast("int").alias("n"))
    return p.select("conv_id", merge.next_page(F.col("have"), F.col("cut"), F.col("n")).cast("long").alias("next_page"))


@query("with a as (select conv_id, turn, length(text) as n from conversations where turn % 2 = 0), b as (select conv_id, turn, length(text) * (turn % 3) as n from conversations) select coalesce(a.conv_id, b.conv_id) as conv_id, coalesce(a.turn, b.turn) as turn, case when a.n is null or b.n > a.n then b.n else a.n end::bigint as n_chars, a.n is null or coalesce(b.n > a.n, false) as from_run from a full join b using (conv_id, turn)")
def page_merge(t):
    c = t.conversations.select("conv_id", "turn", F.length("text").cast("long").alias("n_chars"))
    prior = c.filter("turn % 2 = 0").withColumn("from_run", F.lit(False))
    run = c.withColumn("n_chars", F.col("n_chars") * (F.col("turn") % 3)).withColumn("from_run", F.lit(True))
    return merge.merge_pages(prior, run, ["conv_id"], "turn", "n_chars")


# Events and preferences


@query("""with s as (select event_id, user_id, event_type, ts, lag(event_id) over (partition by user_id, event_type order by ts, event_id) as named from events where true),
k as (select * from s where event_id not in (select named from s where named is not null and event_id % 2 = 0))
select event_id, user_id, event_type from k qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1""")
def current_assertion(t):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    named = F.lag("event_id").over(w)
    e = t.events.select("event_id", "user_id", "event_type", "ts", F.when((F.col("event_id") % 2 == 0) & named.isNotNull(), F.array(named)).otherwise(F.array().cast("array<bigint>")).alias("supersedes")).withColumn("version", F.lit(1))
    return ev.current_assertions(e, ["user_id", "event_type"], "event_id", "supersedes", "ts", "version").select("event_id", "user_id", "event_type")


@query("""with p as (select event_id, user_id, event_type as key, ts as valid_from, ts + interval 5 day as valid_until, ts as recorded_at, value > 90 as withdrawn, event_type <> 'error' as report, lag(event_id) over (partition by user_id, event_type order by ts, event_id) as named from events),
g as (select distinct named from p where report and named is not null and valid_from <= timestamp '2024-01-20')
select event_id, case when valid_from > timestamp '2024-01-20' then 'future' when event_id in (select named from g) then 'superseded' when withdrawn then 'withdrawal' when valid_until <= timestamp '2024-01-20' then 'expired' when not report then 'requires_review' else 'current' end as status from p""")
def preference_status(t):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    named = F.lag("event_id").over(w)
    rows = t.events.select(F.col("event_id").alias("id"), F.col("event_type").alias("key"), F.col("ts").alias("valid_from"), (F.col("ts") + F.expr("interval 5 days")).alias("valid_until"), F.col("ts").alias("recorded_at"), F.when(F.col("value") > 90, "withdrawn").otherwise("active").alias("state"), F.when(F.col("event_type") == "error", "hypothesis").otherwise("user_report").alias("evidence_kind"), F.when(named.isNotNull(), F.array(named)).otherwise(F.array().cast("array<bigint>")).alias("supersedes"))
    return preferences.status(rows, F.expr("timestamp_ntz '2024-01-20'")).select(F.col("id").alias("event_id"), "status")


@query("""with p as (select event_id, user_id, event_type as key, event_id % 3 = 0 as narrow, ts <= timestamp '2024-01-25' as live from events),
d as (select *, live and not narrow and bool_or(live and narrow) over (partition by user_id, key) as dominated from p),
n as (select *, count(case when live and not dominated then 1 end) over (partition by user_id, key) as rivals from d)
select event_id::varchar as id, user_id as context_id, key, case when live then 'current' else 'future' end as status, dominated, live and not dominated and rivals > 1 as conflict, live and not dominated and rivals = 1 as applicable from n""")
def preference_resolution(t):
    rows = t.events.select(F.col("event_id").cast("string").alias("id"), F.col("user_id").alias("context_id"), F.col("event_type").alias("key"), F.when(F.col("event_id") % 3 == 0, F.create_map(F.lit("genre"), F.lit("forum"))).otherwise(F.create_map().cast("map<string,string>")).alias("scope"), F.lit("user_report").alias("evidence_kind"), F.lit("active").alias("state"), F.col("ts").alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_until"), F.array().cast("array<string>").alias("supersedes"), F.col("ts").alias("recorded_at"))
    return preferences.resolve(rows, {"genre": "forum"}, F.expr("timestamp_ntz '2024-01-25'")).select("id", "context_id", "key", "status", "dominated", "conflict", "applicable")


@query("""with r as (select event_id, user_id, event_type || (event_id % 40) as k, event_id % 5 as fp, event_id % 7 = 0 as bad from events),
f as (select user_id, k, min(event_id) as first, arg_min(fp, event_id) as ffp from r where not bad group by all),
v as (select *, row_number() over (partition by user_id order by first) as version from f)
select r.event_id as arrival, r.user_id as context_id,
  case when r.event_id > first then case when fp = ffp then version end when r.event_id = first then version end as version,
  case when r.event_id > first then case when fp = ffp then 'replayed' else 'idempotency_conflict' end when r.event_id = first then 'recorded' else 'version_conflict' end as outcome
from r left join v on v.user_id = r.user_id and v.k = r.k""")
def delta_version_fold(t):
    key = F.concat("event_type", (F.col("event_id") % 40).cast("string"))
    r = t.events.select(F.col("user_id").alias("context_id"), F.col("event_id").alias("arrival"), key.alias("idempotency_key"), (F.col("event_id") % 5).cast("string").alias("fingerprint"), F.when(F.col("event_id") % 7 == 0, -1).cast("int").alias("expected_version"))
    return ev.record_deltas(r).select("arrival", "context_id", "version", "outcome")


@query("with n as (select user_id, event_type, arg_max(round(value, 2), (ts, event_id)) as v from events group by all) select user_id, count(*) as dimensions, round(sum(v), 2) as total from n group by user_id")
def reconcile_dimensions(t):
    r = ev.reconcile(t.events.withColumn("v", F.round("value", 2)), ["user_id"], "event_type", "v", "ts", "event_id")
    return r.select("user_id", F.size("state").cast("long").alias("dimensions"), F.round(F.aggregate(F.map_values("state"), F.lit(0.0), lambda a, x: a + x), 2).alias("total"))


# Deadlines, budgets, statistics


@query("""with d as (select o_orderkey, unnest([{'label': 'opens', 'at': o_orderdate}, {'label': 'due', 'at': case when o_orderkey % 4 <> 0 then o_orderdate + interval 30 day end}, {'label': 'closes', 'at': case when o_orderkey % 3 = 0 then o_orderdate + interval 60 day end}]) as x from orders) select o_orderkey, x.label as label, x.at as at from d where x.at is not null""")
def deadline_unpivot(t):
    s = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    o = t.orders.select("o_orderkey", s.alias("allowsubmissionsfromdate"), F.when(F.col("o_orderkey") % 4 != 0, s + 30 * 86400).otherwise(0).alias("duedate"), F.when(F.col("o_orderkey") % 3 == 0, s + 60 * 86400).alias("cutoffdate"), F.lit(None).cast("long").alias("gradingduedate"))
    return attention.deadlines_of(o, ["o_orderkey"]).withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("select o_custkey, count(case when o_orderdate < timestamp '1997-01-01' then 1 end) as overdue, count(case when o_orderdate >= timestamp '1997-01-01' then 1 end) as upcoming, min(case when o_orderdate >= timestamp '1997-01-01' then o_orderdate end) as nearest, min(case when o_orderdate >= timestamp '1997-01-01' and o_orderdate <= timestamp '1997-01-08' then o_orderdate end) as nearest_in_horizon from orders group by o_custkey")
def deadline_summary(t):
    return attention.deadline_summary(t.orders, ["o_custkey"], "o_orderdate", F.expr("timestamp_ntz '1997-01-01'"))


@query("""with recursive e as (select user_id, event_id, ts, value as calls, 1000.0 * (event_id % 9) as bytes, 1.0 as wall, row_number() over (partition by user_id order by ts, event_id) as n from events),
s as (
  select user_id, 0::bigint as n, null::bigint as event_id, null::boolean as fits, (select min(ts) from e x where x.user_id = u.user_id) as begun, 0.0::double as rc, 0.0::double as rb, 0.0::double as rw, 0.0::double as wc, 0.0::double as wb, 0.0::double as ww from (select distinct user_id from e) u
  union all
  select user_id, n, event_id, ok, begun, rc + if(ok, calls, 0), rb + if(ok, bytes, 0), rw + if(ok, wall, 0), wc + if(ok, calls, 0), wb + if(ok, bytes, 0), ww + if(ok, wall, 0) from (
    select *, rc + calls <= 2500 and rb + bytes <= 400000 and rw + wall <= 60 and wc + calls <= 150 and wb + bytes <= 20000 and ww + wall <= 5 as ok from (
      select e.user_id, e.n, e.event_id, e.calls, e.bytes, e.wall, if(again, e.ts, s.begun) as begun, s.rc, s.rb, s.rw, if(again, 0, s.wc) as wc, if(again, 0, s.wb) as wb, if(again, 0, s.ww) as ww
      from s join (select *, 0 as z from e) e on e.user_id = s.user_id and e.n = s.n + 1, lateral (select epoch_us(e.ts) - epoch_us(s.begun) >= 86400000000 as again))))
select event_id, user_id, fits, begun as window_started, round(rc, 4) as calls, rb as bytes, ww as window_wall from s where n > 0""")
def tumbling_budget(t):
    e = t.events.select("user_id", "ts", "event_id", F.col("value").alias("calls"), (1000.0 * (F.col("event_id") % 9)).alias("bytes"), F.lit(1.0).alias("wall"))
    names = {n: n for n in ("calls", "bytes", "wall")}
    out = lifecycle.tumbling_budget(e, ["user_id"], "ts", "event_id", names, {"calls": 2500.0, "bytes": 400000.0, "wall": 60.0}, {"calls": 150.0, "bytes": 20000.0, "wall": 5.0}, 86400)
    return out.select("event_id", "user_id", "fits", F.col("window_started").cast("timestamp_ntz").alias("window_started"), F.round("reserved_calls", 4).alias("calls"), F.col("reserved_bytes").alias("bytes"), F.col("window_wall").alias("window_wall"))


@query("select event_type, quantile_disc(value, 0.95) as p95 from events group by event_type")
def p95_nearest_rank(t):
    return t.events.groupBy("event_type").agg(F.expr("percentile_disc(0.95) within group (order by value)").alias("p95"))


@query("select user_id, count(*) as failures, least(86400, 60 * pow(2, least(count(*) - 1, 5)))::bigint as wait, ([1800, 7200, 21600])[least(count(*), 3)]::int as ladder from events where event_type = 'error' group by user_id")
def backoff_ladder(t):
    e = t.events.filter("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("failures"))
    return e.withColumns({"wait": lifecycle.backoff_seconds(F.col("failures"), 60), "ladder": lifecycle.ladder_seconds(F.col("failures"))})


@query("select o_orderpriority, count(*) as n, count(distinct o_custkey) as customers, count(case when o_orderstatus = 'F' then 1 end) as finished, round(sum(o_totalprice), 2) as total from orders group by 1")
def inventory_totals(t):
    return t.orders.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("select c_nationkey, string_agg(c_name, ';' order by c_name, c_custkey) as names from customer group by c_nationkey")
def ordered_collection(t):
    packed = F.sort_array(F.collect_list(F.struct("c_name", "c_custkey")))
    return t.customer.groupBy("c_nationkey").agg(F.array_join(F.transform(packed, lambda x: x["c_name"]), ";").alias("names"))


# Evidence


@query("""with p as (select conv_id, turn, role, lag(role) over (partition by conv_id order by turn) as pr from conversations)
select conv_id, count(case when role = 'user' and turn = 0 then 1 end) as own_topics, count(distinct case when role <> 'user' then role end) as colleagues_seen, count(case when role = 'user' and turn > 0 and pr <> 'user' then 1 end) as own_replies, count(distinct case when role = 'user' and turn > 0 and pr <> 'user' then pr end) as colleagues_answered from p group by conv_id""")
def forum_evidence(t):
    posts = t.conversations.select(F.lit("o").alias("owner_id"), F.col("conv_id").alias("forum_id"), F.col("conv_id").alias("discussion_id"), (F.col("turn") + 1).cast("string").alias("post_id"), F.col("turn").cast("string").alias("parent_id"), F.col("role").alias("author_id"))
    return attention.forum_evidence(posts, "user").select(F.col("forum_id").alias("conv_id"), "own_topics", "colleagues_seen", "own_replies", "colleagues_answered")


# Requirements are lines of an order; reports, receipts and native states come from its other columns.
_NEEDS = """needs as (select l_orderkey as e, l_linenumber::varchar as k, (['submission', 'forum_topic', 'forum_reply', 'completion', 'manual'])[(l_partkey + l_linenumber) % 5 + 1] as f, l_linenumber % 3 + 1 as least, count(*) over (partition by l_orderkey, (l_partkey + l_linenumber) % 5) as family from lineitem),
reports as (select l_orderkey as e, (['submission', 'forum_topic', 'forum_reply', 'completion', 'deadline_change'])[l_suppkey % 5 + 1] as t, case when l_linenumber % 2 = 0 then l_linenumber::varchar end as k, l_linenumber as c from lineitem where l_returnflag = 'R'),
ev as (select o_orderkey as e, case when o_orderkey % 7 = 0 then 1 else 0 end as acts, case when o_orderkey % 11 = 0 then 1 else 0 end as pubs, o_orderkey % 4 as answered, o_orderkey % 3 <> 0 as forum, ([null, 'new', 'submitted', 'draft'])[o_orderkey % 4 + 1] as native, o_orderkey % 13 = 0 as done, o_orderkey % 17 = 0 as legacy, o_orderkey % 5 = 0 as part from orders),
told as (select needs.*, (select count(*) from reports r where r.e = needs.e and r.t = case f when 'manual' then 'completion' else f end and (r.k = needs.k or r.k is null and family = 1 and f <> 'manual')) as n,
  (select coalesce(max(c), 0) from reports r where r.e = needs.e and r.t = f and (r.k = needs.k or r.k is null and family = 1)) as most, ev.* exclude (e) from needs join ev using (e)),
v as (select *, case f
  when 'submission' then case when (n > 0 or legacy and family = 1) and native in ('new', 'draft', 'reopened') then 'uncertain:user_report_contradicts_native_status' when acts > 0 and native in ('new', 'draft', 'reopened') then 'uncertain:receipt_contradicts_native_status'
    when family > 1 and n = 0 then 'uncertain:multiple_obligations_require_specific_evidence' when n > 0 or legacy and family = 1 or acts > 0 or native = 'submitted' then 'satisfied:' when native in ('new', 'draft', 'reopened') then 'pending:native_status_reports_not_submitted' else 'pending:' end
  when 'forum_topic' then case when family > 1 and n = 0 then 'uncertain:multiple_obligations_require_specific_evidence' when pubs > 0 or n > 0 then 'satisfied:' when not forum then 'uncertain:connection_subject_unknown' else 'pending:no_preserved_owner_publication' end
  when 'forum_reply' then case when family > 1 and most < least then 'uncertain:multiple_obligations_require_specific_evidence' when answered >= least or most >= least then 'satisfied:' when not forum then 'uncertain:connection_subject_unknown' else 'pending:distinct_colleagues_below_required' end
  when 'completion' then case when family > 1 and n = 0 then 'uncertain:multiple_obligations_require_specific_evidence' when done or n > 0 then 'satisfied:' else 'pending:' end
  else case when n > 0 then 'satisfied:' else 'pending:manual_confirmation_pending' end end as found from told),
w as (select e, k, f, family, split_part(found, ':', 1) as verdict, concat_ws(';', nullif(split_part(found, ':', 2), ''), case when part and f in ('submission', 'forum_topic', 'forum_reply') then 'positive_proof_from_partial_coverage' end) as reasons from v)"""


def _needs(t):
    pick = lambda names, i: F.element_at(F.array(*[F.lit(n) for n in names]), (i + 1).cast("int"))
    o, e = F.lit("o").alias("owner_id"), F.col("l_orderkey").alias("entity_id")
    needs = t.lineitem.select(o, e, F.col("l_linenumber").cast("string").alias("requirement_key"), pick(["submission", "forum_topic", "forum_reply", "completion", "manual"], (F.col("l_partkey") + F.col("l_linenumber")) % 5).alias("fulfilment"), (F.col("l_linenumber") % 3 + 1).alias("at_least"))
    reports = t.lineitem.filter("l_returnflag = 'R'").select(o, e, pick(["submission", "forum_topic", "forum_reply", "completion", "deadline_change"], F.col("l_suppkey") % 5).alias("event_type"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linenumber").cast("string")).alias("requirement_key"), F.col("l_linenumber").alias("distinct_colleagues"))
    every = lambda n: F.col("o_orderkey") % n == 0
    evidence = t.orders.select(
        o, F.col("o_orderkey").alias("entity_id"), every(7).cast("int").alias("submit_receipts"), F.lit(0).alias("topic_receipts"), every(11).cast("int").alias("publications"), (F.col("o_orderkey") % 4).alias("colleagues_answered"), (~every(3)).alias("forum_known"),
        pick([None, "new", "submitted", "draft"], F.col("o_orderkey") % 4).alias("native_status"), every(13).alias("native_completion"), every(17).alias("legacy_report"), every(5).alias("partial"),
        F.when(~every(6), ~every(8)).alias("status_qualified"), every(2).alias("feedback_available"), every(19).alias("drift"), (F.col("o_orderkey") % 3).alias("changed_materials"))
    return needs, reports, evidence


@query(f"with {_NEEDS} select e as l_orderkey, k as requirement_key, f as fulfilment, family as family_size, verdict, reasons from w")
def assessed_requirements(t):
    return attention.assess(*_needs(t)).select(F.col("entity_id").alias("l_orderkey"), "requirement_key", "fulfilment", "family_size", "verdict", F.array_join("reasons", ";").alias("reasons"))


_OUTCOME = """g as (select e, count(*) as requirements, case when bool_or(verdict = 'uncertain') then 'uncertain' when bool_and(verdict = 'satisfied') then 'concluded' else 'pending' end as state, bool_or(contains(reasons, '_contradicts_native_status')) as contradiction from w group by e),
rep as (select e, bool_or(t = 'submission') as handed, bool_or(t = 'completion') as completed, bool_or(t = 'deadline_change') as news from reports group by e),
ent as (select o_orderkey as e, (['assignment', 'forum', 'module'])[o_custkey % 3 + 1] as kind, coalesce(handed, false) or legacy or acts > 0 or coalesce(native = 'submitted', false) as handed, done or coalesce(completed, false) as completed, coalesce(news, false) as news from orders join ev on ev.e = o_orderkey left join rep on rep.e = o_orderkey),
s as (select ent.*, coalesce(requirements, 0)::bigint as requirements, coalesce(state, case when kind = 'forum' then 'uncertain' when kind = 'assignment' and handed or kind = 'module' and completed then 'concluded' else 'pending' end) as state, coalesce(contradiction, false) as contradiction from ent left join g using (e))"""


def _kinds(t):
    return F.element_at(F.array(*[F.lit(n) for n in ("assignment", "forum", "module")]), (F.col("o_custkey") % 3 + 1).cast("int"))


@query(f"with {_NEEDS}, {_OUTCOME} select e as l_orderkey, kind, requirements, state, contradiction from s")
def assessed_obligations(t):
    needs, reports, evidence = _needs(t)
    keys = ["owner_id", "entity_id"]
    told = reports.groupBy(*keys).agg(F.bool_or(F.col("event_type") == "submission").alias("h"), F.bool_or(F.col("event_type") == "completion").alias("c"))
    known = t.orders.select(F.lit("o").alias("owner_id"), F.col("o_orderkey").alias("entity_id"), _kinds(t).alias("kind")).join(told, keys, "left").join(evidence, keys, "left")
    handed = F.coalesce("h", F.lit(False)) | F.col("legacy_report") | (F.col("submit_receipts") > 0) | F.coalesce(F.col("native_status") == "submitted", F.lit(False))
    judged = known.select(*keys, "kind", handed.alias("submission_evidence"), (F.col("native_completion") | F.coalesce("c", F.lit(False))).alias("completion_evidence"))
    return attention.assess_entity(attention.assess(needs, reports, evidence), judged).select(F.col("entity_id").alias("l_orderkey"), "kind", "requirements", "state", "contradiction")


@query(f"""with {_NEEDS}, {_OUTCOME},
occ as (select l_orderkey as e, l_shipdate as seen_at, 'h' || (10 + l_partkey % 12) as h, case when l_linestatus = 'O' then 'partial' else 'complete' end as cov, case when l_partkey % 12 % 3 = 0 then 852076800 else 852163200 end as due, case when l_partkey % 12 % 2 = 0 then 'a' else 'b' end as intro from lineitem),
last as (select e, seen_at, h, cov, due, intro from occ qualify row_number() over (partition by e order by seen_at desc, h desc, cov desc) = 1),
prev as (select occ.e, occ.h, occ.due, occ.intro from occ join last on occ.e = last.e and occ.seen_at < last.seen_at and occ.h <> last.h qualify row_number() over (partition by occ.e order by occ.seen_at desc, occ.h desc) = 1),
x as (select s.*, last.h, last.cov, last.due, last.intro, prev.h as ph, prev.due as pdue, prev.intro as pintro, case when e % 4 <> 0 and last.h is not null then (case when e % 9 = 0 then last.h else 'h11' end) end as presented, case when e % 5 = 0 then 'h13' end as seen from s left join last using (e) left join prev using (e))
select e as entity_id, kind, state, requirements, h as content_hash, ph as previous_hash, array_to_string(list_sort(list_filter([
  case when ph is not null and presented is distinct from h and pdue is distinct from due then 'deadline_changed' end, case when ph is not null and presented is distinct from h and pintro is distinct from intro then 'instructions_changed' end, case when news then 'deadline_change' end,
  case when e % 6 <> 0 and e % 8 <> 0 and e % 2 = 0 then 'feedback_available' end, case when presented is null then 'not_presented' end, case when presented <> h then 'changed_since_presented' end, case when seen <> h then 'changed_since_read' end,
  case when e % 23 = 0 then 'access_lost' end, case when cov <> 'complete' then 'incomplete_coverage' end, case when due = 852076800 then 'deadline_near' end, case when kind = 'forum' and requirements = 0 then 'requirement_not_interpreted' end, case when kind = 'assignment' and not handed then 'submission_evidence_missing' end,
  case when state = 'uncertain' then 'academic_uncertain' end, case when e % 6 <> 0 and e % 8 = 0 then 'own_submission_status_unqualified' end, case when contradiction then 'report_observation_contradiction' end, case when e % 19 = 0 then 'unrecorded_reobservation' end, case when e % 3 > 0 then 'material_dependency_changed' end], lambda i: i is not null)), ';') as items from x""")
def attention_overview(t):
    """The flagship: orders as activities, lines as sightings and requirements; state, change and attention items of each."""
    needs, reports, evidence = _needs(t)
    o, e = F.lit("o").alias("owner_id"), F.col("o_orderkey")
    entities = t.orders.select(o, e.alias("id"), _kinds(t).alias("kind"), F.col("o_orderpriority").alias("title"), F.when(e % 23 == 0, "revoked").otherwise("connected").alias("connection_state"))
    content = F.to_json(F.struct(F.when(F.col("l_partkey") % 12 % 3 == 0, 852076800).otherwise(852163200).alias("duedate"), F.when(F.col("l_partkey") % 12 % 2 == 0, "a").otherwise("b").alias("intro")))
    seen = t.lineitem.select(o, F.col("l_orderkey").alias("entity_id"), F.concat(F.lit("h"), (10 + F.col("l_partkey") % 12).cast("string")).alias("content_hash"), F.col("l_shipdate").alias("observed_at"), F.when(F.col("l_linestatus") == "O", "partial").otherwise("complete").alias("coverage"), content.alias("content"))
    # Of two sightings of one content at one time the partial one counts.
    seen = seen.groupBy("owner_id", "entity_id", "content_hash", "observed_at").agg(F.max("coverage").alias("coverage"), F.min("content").alias("content"))
    newest = timeline.latest(seen, ["owner_id", "entity_id"], "observed_at", "content_hash").select("owner_id", "entity_id", F.col("content_hash").alias("h"))
    marks = newest.select("owner_id", "entity_id", F.when(F.col("entity_id") % 4 != 0, F.when(F.col("entity_id") % 9 == 0, F.col("h")).otherwise("h11")).alias("presented_hash"), F.when(F.col("entity_id") % 5 == 0, "h13").alias("read_hash"))
    out = attention.overview(entities, seen, needs, reports, evidence, marks, F.timestamp_seconds(F.lit(852076800 - 6 * 86400)), days=6)
    return out.select("entity_id", "kind", "state", "requirements", "content_hash", "previous_hash", F.array_join("items", ";").alias("items"))


# Local time


_STATE = "case when timezone('Europe/Lisbon', timezone('Europe/Lisbon', {0})) <> {0} then 'nonexistent' when timezone('Europe/Lisbon', timezone('Europe/Lisbon', {0}) - interval 1 hour) = {0} or timezone('Europe/Lisbon', timezone('Europe/Lisbon', {0}) + interval 1 hour) = {0} then 'ambiguous' else 'unique' end"


@query(f"with e as (select event_id, ts, timestamp '2024-03-31 01:30:00' + interval (event_id % 3) hour as spring from events) select event_id, {_STATE.format('ts')} as state, {_STATE.format('spring')} as spring_state from e")
def local_time_tristate(t):
    e = t.events.select("event_id", F.col("ts").cast("timestamp").alias("local"))
    spring = F.timestamp_micros(F.unix_micros(F.lit("2024-03-31 01:30:00").cast("timestamp")) + (F.col("event_id") % 3) * 3_600_000_000)
    return e.select("event_id", timefn.local_state(F.col("local"), "Europe/Lisbon").alias("state"), timefn.local_state(spring, "Europe/Lisbon").alias("spring_state"))


@query("""with w as (select day, time, timezone('UTC', timezone('America/Sao_Paulo', (day || ' ' || time || ':00')::timestamp)) as s from (select distinct ts::date as day from events), (select unnest(['08:00', '18:30']) as time))
select day::varchar as day, time, greatest(s, timestamp '2024-01-05') as window_start, least(s + interval 30 minute, timestamp '2024-01-25') as window_end from w where greatest(s, timestamp '2024-01-05') < least(s + interval 30 minute, timestamp '2024-01-25')""")
def schedule_windows(t):
    days = t.events.select(F.col("ts").cast("date").alias("day")).distinct()
    out = timefn.schedule_windows(days, "day", "America/Sao_Paulo", ["08:00", "18:30"], 1800, F.expr("timestamp '2024-01-05'"), F.expr("timestamp '2024-01-25'"))
    return out.select(F.col("day").cast("string").alias("day"), "time", F.col("window_start").cast("timestamp_ntz").alias("window_start"), F.col("window_end").cast("timestamp_ntz").alias("window_end"))


# Documents


@query()
def html_blocks(t):
    return documents.blocks(t.pages.select("page_id", documents.html_blocks("html").alias("x")), ["page_id"], "x")


@query()
def html_counters(t):
    x = t.pages.select("page_id", documents.html_blocks("html").alias("x"))
    return documents.block_counters(x, "x").select("page_id", "x.status", "x.coverage", "n_blocks", "n_headings", "n_paragraphs", "n_list_items", "n_cells", "n_chars")


@query()
def html_removals(t):
    x = t.pages.select("page_id", documents.html_blocks("html").alias("x"))
    return x.select("page_id", F.explode("x.removed").alias("what", "n")).groupBy("what").agg(F.sum("n").alias("n"), F.count("*").alias("pages"))


@query(r"""with b as (select page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<noscript\b.*?</noscript\s*>|<template\b.*?</template\s*>|<!--.*?-->', ' ', 'g'), '(?i)<br\s*/?>|</(p|div|li|tr|h[1-6]|section|article)\s*>', chr(10), 'g'), '<[^>]*>', '', 'g') as h from pages),
e as (select page_id, replace(replace(replace(replace(replace(replace(h, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&amp;', '&') as h from b)
select page_id, trim(regexp_replace(regexp_replace(h, '[ \t]+', ' ', 'g'), '\s*\n\s*', chr(10), 'g'), ' ') as text from e""")
def html_text(t):
    return t.pages.select("page_id", text.plain_html(F.col("html")).alias("text"))


# Records


@query("""with b as (select o_custkey as c, l_suppkey as e, bool_or(l_returnflag = 'R' and l_quantity > 48) as active from orders join lineitem on l_orderkey = o_orderkey group by all),
f as (select c, count(*) as n, min(e) as one from b where active group by c)
select c_custkey, coalesce(n, 0)::int as n, case when n is null then 'unbound' when n = 1 then 'unique' else 'ambiguous' end as status, case when n = 1 then one end as target from customer left join f on c = c_custkey""")
def work_targets(t):
    b = t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("context_id"), F.col("l_suppkey").cast("string").alias("entity_id")).agg(F.bool_or((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 48)).alias("active"))
    out = records.targets(t.customer.select(F.col("c_custkey").alias("context_id")), b)
    return out.select(F.col("context_id").alias("c_custkey"), F.size("entity_ids").alias("n"), "status", F.col("target_id").cast("long").alias("target"))


@query("""with b as (select distinct user_id as c, event_type as e from events), w as (select distinct user_id as c, event_type as e from events where event_id % 50 = 1)
select coalesce(b.c, w.c) as context_id, coalesce(b.e, w.e) as entity_id, case when w.c is not null then true when coalesce(b.c, w.c) in (select c from w) then false else true end as active from b full join w on b.c = w.c and b.e = w.e""")
def bind_targets(t):
    pair = lambda p: t.events.filter(p).select(F.col("user_id").alias("context_id"), F.col("event_type").alias("entity_id")).distinct()
    return records.bind(pair("true").withColumn("active", F.lit(True)), pair("event_id % 50 = 1"))


@query("""with n as (select user_id as e, arg_max(event_id, (ts, event_id)) as h from events group by 1), p as (select user_id as e, max(event_id) as h from events where event_id % 3 <> 0 group by 1)
select n.e as entity_id, case when p.h = n.h then n.h else -1 end as presented_hash from n left join p on p.e = n.e""")
def presented_marks(t):
    newest = timeline.latest(t.events, ["user_id"], "ts", "event_id").select(F.col("user_id").alias("entity_id"), F.col("event_id").alias("content_hash"))
    asked = t.events.filter("event_id % 3 <> 0").groupBy(F.col("user_id").alias("entity_id")).agg(F.max("event_id").alias("content_hash"))
    marks = newest.select("entity_id", F.lit(-1).cast("long").alias("presented_hash"))
    return records.mark(marks, asked, newest)


@query("""select e.event_id, user_id, case when event_type in ('click', 'view') then event_type when n = 1 then one end as target, case when event_type in ('click', 'view') or n = 1 then null when coalesce(n, 0) = 0 then 'unbound' else 'ambiguous_context' end as refusal
from events e left join (select c_custkey, case when c_custkey % 3 = 0 then 1 else 2 end as n, 'm' as one from customer where c_custkey % 3 <> 2) on c_custkey = user_id""")
def event_targets(t):
    e = t.events.select("event_id", "user_id", F.col("user_id").alias("context_id"), F.when(F.col("event_type").isin("click", "view"), F.col("event_type")).alias("target_entity_id"))
    b = t.customer.filter("c_custkey % 3 <> 2").select(F.col("c_custkey").alias("context_id"), F.explode(F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("m"))).otherwise(F.array(F.lit("m"), F.lit("n")))).alias("entity_id"), F.lit(True).alias("active"))
    none = t.customer.limit(0).select(F.lit("").alias("module_id"), F.lit("").alias("entity_id"))
    return records.resolve_event_target(e, b, none).select("event_id", "user_id", F.col("resolved_id").alias("target"), "refusal")


@query("""select event_id, unnest(['ids[0]=' || user_id, 'ids[1]=7', 'options[deep][0][name]=' || event_type, 'options[on]=1', 'k=' || json_extract_string(props, '$.k')]) as param from events""")
def flattened_params(t):
    made = F.concat(F.lit('{"ids":['), F.col("user_id").cast("string"), F.lit(',7],"none":null,"options":{"deep":[{"name":"'), F.col("event_type"), F.lit('"}],"on":true},"k":'), F.get_json_object("props", "$.k"), F.lit("}"))
    return t.events.select("event_id", F.explode(jsonfn.flat_params(made)).alias("param"))


@query("""with p as (select * from (values (0, 'complete'), (1, 'partial'), (2, 'denied'), (3, 'timeout')) as v(m, c))
select conv_id, arg_max(case when length(text) > 500 and c = 'complete' then 'partial' else c end, case case when length(text) > 500 and c = 'complete' then 'partial' else c end when 'complete' then 0 when 'partial' then 1 when 'timeout' then 2 when 'denied' then 5 end) as coverage from conversations join p on m = turn % 4 group by conv_id""")
def truncation_is_partial(t):
    from attesta.plans.catalog import coverage_of

    names = F.array(*[F.lit(c) for c in ("complete", "partial", "denied", "timeout")])
    rows = t.conversations.select("conv_id", F.element_at(names, (F.col("turn") % 4 + 1).cast("int")).alias("coverage"), (F.length("text") > 500).alias("truncated"))
    return coverage_of(rows, ["conv_id"])


@query("select c_custkey, 'o' as owner, upper(substring(c_name, 1, 1)) as initial from customer where c_mktsegment = 'BUILDING'")
def tenant_scan(t):
    own = Tables(t.spark, t.root, "BUILDING", "c_mktsegment").customer
    return own.select("c_custkey", F.lit("o").alias("owner"), F.upper(F.substring("c_name", 1, 1)).alias("initial"))


@query("select row_number() over (order by n) - 1 as turn, n as user_id from (select distinct user_id as n from events)")
def round_robin_turns(t):
    return lifecycle.next_in_turn(t.events.select("user_id").distinct(), "user_id", 0).select(F.col("turn").cast("long").alias("turn"), "user_id")


@query("""with h as (select doc_id, text, sha256(concat_ws(chr(31), source, text)) as h from documents)
select doc_id, substring(h, 1, 8) || '-' || substring(h, 9, 4) || '-5' || substring(h, 14, 3) || '-' || substring('89ab', (('0x' || substring(h, 17, 1))::int % 4 + 1)::bigint, 1) || substring(h, 18, 3) || '-' || substring(h, 21, 12) as uuid,
  sha1(('blob ' || strlen(text))::blob || '\\x00'::blob || encode(text)) as git_blob from h""")
def document_digest_ids(t):
    return t.documents.select("doc_id", hashing.stable_uuid(F.col("source"), F.col("text")).alias("uuid"), hashing.git_blob_id(F.col("text")).alias("git_blob"))
