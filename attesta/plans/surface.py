"""More registered queries: functions and reads that the first module's queries don't touch, over whole tables, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import hashing, jsonfn, net, text, timefn
from attesta.operators import attention, events as ev, graph, joins, lifecycle, merge, paging, preferences, records, storage, timeline
from attesta.plans import catalog
from attesta.plans.queries import QUERIES, query
from attesta.sources import captures, documents, staging
from attesta.streaming import resume

_FIRST = set(QUERIES)
_pick = lambda names, i: F.element_at(F.array(*[F.lit(n) for n in names]), (i + 1).cast("int"))


# Storage and files


def _files(t):
    return t.documents.select(F.col("source").alias("owner_id"), F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("content"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("long").alias("bytes"))


@query("select doc_id, sha256(text) as sha256, strlen(text)::bigint as n from documents")
def file_contents(t):
    files = _files(t)
    inline = F.col("id") % 2 == 0
    refs = files.select("owner_id", "id", F.when(inline, F.col("content")).alias("inline_content"), F.when(~inline, F.col("sha256")).alias("blob_sha256"))
    blobs = files.filter(~inline).groupBy("owner_id", "sha256").agg(F.first("content").alias("content"))
    out = storage.contents(refs, blobs)
    return out.select(F.col("id").alias("doc_id"), F.sha2("binary_content", 256).alias("sha256"), F.octet_length("binary_content").cast("long").alias("n"))


@query("with b as (select count(*) as blobs, sum(n) as stored from (select source, sha256(text) as h, any_value(strlen(text)) as n from documents where doc_id % 3 > 0 group by all)) select (select count(*) from documents where doc_id % 3 = 0) as left_inline, (select count(*) from documents where doc_id % 3 > 0) as moved, blobs, stored::bigint as stored from b")
def compaction(t):
    files = _files(t).withColumns({"inline_content": F.col("content"), "blob_sha256": F.lit(None).cast("string"), "sha256": F.when(F.col("id") % 3 == 0, F.lit("damaged")).otherwise(F.col("sha256"))})
    moved, blobs = storage.compacted(files)
    counts = moved.agg(F.count_if(F.col("inline_content").isNotNull()).alias("left_inline"), F.count_if(F.col("blob_sha256").isNotNull()).alias("moved"))
    return counts.join(blobs.agg(F.count("*").alias("blobs"), F.sum("bytes").alias("stored")))  # a row each


@query("select doc_id, sha256(text) as sha256, true as intact from documents")
def reassembly(t):
    whole = t.documents.select("doc_id", F.col("text").cast("binary").alias("b"), F.sha2("text", 256).alias("sha256"))
    parts = whole.select("doc_id", "b", "sha256", F.inline(paging.byte_parts(F.octet_length("b").cast("long"), 1024))).select("doc_id", "sha256", F.col("first").alias("nth"), storage.slice_bytes(F.col("b"), F.col("first"), F.col("length")).alias("part"))
    return storage.reassembled(parts, "doc_id", "nth", "part", "sha256").select("doc_id", "sha256", "intact")


@query("select source as owner_id, count(*) as files, count(distinct sha256(text)) as blobs, (sum(strlen(text)))::varchar as preserved from documents group by 1")
def owner_usage(t):
    return _files(t).groupBy("owner_id").agg(F.count("*").alias("files"), F.count_distinct("sha256").alias("blobs"), F.sum("bytes").cast("string").alias("preserved"))


@query("select (select count(*) from documents)::bigint as documents, sum(strlen(text))::varchar as preserved, (select sum(n) from (select any_value(strlen(text)) as n from documents group by sha256(text)))::varchar as stored, (sum(strlen(text)) - (select sum(n) from (select any_value(strlen(text)) as n from documents group by sha256(text))))::varchar as saved from documents")
def catalog_usage(t):
    files = _files(t)
    return catalog.usage(files, files.groupBy("sha256").agg(F.first("bytes").alias("bytes")), {"documents": t.documents})


@query("select page_id, 'text' as kind from pages")
def artifact_types(t):
    return t.pages.select("page_id", documents.artifact_type(F.col("html").cast("binary")).alias("kind"))


# Lists and pages


@query("select o_orderkey, o_orderstatus from orders order by o_orderdate desc, o_orderkey limit 30")
def newest_jobs(t):
    return t.orders.orderBy(F.desc("o_orderdate"), "o_orderkey").limit(30).select("o_orderkey", "o_orderstatus")


@query("select o_orderkey as id from orders where o_orderstatus = 'O' and o_orderkey % 6 < 5 or o_orderstatus = 'P' and o_orderdate <= timestamp '1995-06-01' and o_orderkey % 6 < 5 order by o_orderdate, o_orderkey limit 10")
def queue_head(t):
    jobs = t.orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "running").otherwise("complete").alias("state"), F.col("o_orderdate").alias("lease_until"), (F.col("o_orderkey") % 6).alias("attempts"), F.col("o_orderdate").alias("updated_at"))
    return lifecycle.queue_head(jobs, F.expr("timestamp_ntz '1995-06-01'"), 10).select("id")


@query("""select o_orderkey as id, case when o_orderkey % 7 = 0 then 'revoked' when o_orderdate + interval 90 day <= timestamp '1998-01-01' then 'expired' when o_orderkey % 5 = 0 then 'paused' when o_custkey % 4 = 0 or o_orderkey % 3 <> 1 then 'disconnected' else 'active' end as status
from orders join customer on c_custkey = o_custkey order by o_orderdate desc, o_orderkey limit 20""")
def followup_status(t):
    o = F.lit("o").alias("owner_id")
    grants = t.orders.select(o, F.col("o_custkey").alias("connection_id"), F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 7 == 0).alias("revoked"), (F.col("o_orderdate") + F.expr("interval 90 days")).alias("expires_at"), (F.col("o_orderkey") % 5 == 0).alias("paused"), (F.col("o_orderkey") % 3).alias("epoch"), F.col("o_orderdate").alias("created_at"))
    connections = t.customer.select(o, F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 4 == 0, "revoked").otherwise("active").alias("state"), F.lit(1).alias("oauth_epoch"))
    return catalog.followups(grants, connections, F.expr("timestamp_ntz '1998-01-01'")).select("id", "status")


@query("select o_orderkey as id, c_name as title, o_orderkey % 2 = 0 as available from orders join customer on c_custkey = o_custkey where o_custkey % 3 < 2 and o_orderkey > 5000 order by o_orderkey limit 20")
def library_list(t):
    o = F.lit("o").alias("owner_id")
    files = t.orders.select(o, F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("entity_id"), F.lit("n").alias("name"), F.lit(1).alias("bytes"), F.when(F.col("o_orderkey") % 2 == 0, F.lit(b"x")).alias("inline_content"), F.lit(None).cast("string").alias("blob_sha256"))
    entities = t.customer.select(o, F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), _pick(["resource", "artifact", "forum"], F.col("c_custkey") % 3).alias("kind"), F.col("c_nationkey").alias("connection_id"))
    connections = t.nation.select(o, F.col("n_nationkey").alias("id"), F.col("n_name").alias("provider"))
    return catalog.library(files, entities, connections, 5000).select("id", "title", "available")


@query("select c_custkey as id, c_name as name, '{\"status\":\"ok\"}' as extraction, 30 as next_offset from customer order by c_name, c_custkey limit 20 offset 10")
def files_page(t):
    files = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit("e").alias("entity_id"), F.lit('{"pages":[1,2],"status":"ok","blocks":{"a":1},"sanitized_html":"x"}').alias("extraction"), F.lit(b"x").alias("inline_content"))
    return catalog.files_page(files, offset=10).select("id", "name", "extraction", "next_offset")


@query("select p_partkey as id, p_name as title, case when n > 20 then 20 end as next_offset from part, (select count(*) as n from part where p_brand = 'Brand#11' or p_name ilike '%a%') where p_name ilike '%a%' order by p_name, p_partkey limit 20")
def entities_search_page(t):
    e = t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.lit("k").alias("kind"), F.lit("c").alias("connection_id"))
    return catalog.entities_page(e, connection_id="c", query="a").select("id", "title", "next_offset")


@query("select user_id, event_id, version::int as version, case when n > 20 then 20 end::int as next_offset from (select user_id, event_id, row_number() over (order by ts, event_id) as version, count(*) over () as n from events where user_id = 7) order by version desc limit 20")
def context_history(t):
    d = timeline.numbered(t.events.select(F.col("user_id").alias("context_id"), "event_id", "ts"), ["context_id"], ["ts", "event_id"])
    return catalog.history(d, 7).select(F.col("context_id").alias("user_id"), "event_id", F.col("version").cast("int").alias("version"), F.col("next_offset").cast("int").alias("next_offset"))


@query("""with c as (select c_custkey as id from customer where not coalesce(c_custkey % 5 in (0, 1, 2), false) and c_custkey % 5 <> 3 or c_custkey % 5 = 4 or (c_custkey % 5 = 3 and c_custkey % 2 = 0) order by c_acctbal desc, c_custkey limit 20)
select 'context' as what, id from c union all (select 'delta', o_orderkey from orders where o_custkey in (select id from c) order by o_orderdate desc, o_orderkey limit 50)""")
def contexts_with_deltas(t):
    pair = lambda **kv: F.create_map(*[F.lit(x) for i in kv.items() for x in i])
    k = F.col("c_custkey") % 5
    run = F.when(F.col("c_custkey") % 2 == 0, "other").otherwise("2026-01-02-skill-1.2.3")
    scope = F.when(k == 0, pair(environment="test")).when(k == 1, pair(environment="synthetic-host-lab")).when(k == 2, pair(purpose="acceptance-test")).when(k == 3, F.map_concat(pair(purpose="validation", surface="mobile"), F.create_map(F.lit("run"), run))).otherwise(pair(environment="real"))
    contexts = t.customer.select(F.col("c_custkey").alias("id"), scope.alias("scope"), F.col("c_acctbal").alias("updated_at"))
    deltas = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("context_id"), F.col("o_orderdate").alias("recorded_at"))
    page, own = catalog.contexts(contexts, deltas)
    return page.select(F.lit("context").alias("what"), "id").union(own.select(F.lit("delta"), "id"))


@query("select 'delta' as what, doc_id as id from (select doc_id from documents where text ilike '%tion%' order by n_chars desc, doc_id limit 20) union all select 'entity', p_partkey from (select p_partkey from part where p_name ilike '%tion%' order by p_name, p_partkey limit 20)")
def find_in_both(t):
    d, e = catalog.find(t.documents.select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.col("n_chars").alias("recorded_at")), t.part.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title")), "tion")
    return d.select(F.lit("delta").alias("what"), "id").union(e.select(F.lit("entity"), "id"))


@query("""with l as (select arg_max(event_type, (ts, event_id)) as seen, count(*) as n from events where user_id = 9) select 'node' as part, case when seen = 'click' then 'true' else 'false' end as detail from l
union all select 'observation', event_id::varchar from (select event_id from events where user_id = 9 order by ts desc, event_id desc limit 5)
union all select 'edge', l_orderkey::varchar from (select o_orderkey as l_orderkey from orders where o_custkey = 9 order by o_orderkey limit 30)""")
def entity_context(t):
    e = F.concat(F.lit('{"x":"'), F.col("event_type"), F.lit('"}'))
    entities = t.customer.select(F.col("c_custkey").alias("id"), F.lit('{ "x": "click" }').alias("state"))
    seen = t.events.select(F.col("user_id").alias("entity_id"), F.col("ts").alias("observed_at"), F.col("event_id").alias("content_hash"), e.alias("content"))
    relations = t.orders.select(F.lit("k").alias("kind"), F.col("o_custkey").alias("from_id"), F.col("o_orderkey").alias("to_id")).filter("to_id > 9")
    node, newest, edges = catalog.entity_context(entities, seen, relations, 9)
    return node.select(F.lit("node").alias("part"), F.col("matches_latest").cast("string").alias("detail")).union(newest.select(F.lit("observation"), F.col("content_hash").cast("string"))).union(edges.select(F.lit("edge"), F.col("to_id").cast("string")))


# JSON


@query("select event_id, user_id % 3 as a, (ts < timestamp '2024-01-15')::varchar as b from events")
def json_records(t):
    made = F.concat(F.lit('[{"id":'), F.col("event_id").cast("string"), F.lit(',"a":'), (F.col("user_id") % 3).cast("string"), F.lit(',"b":"'), (F.col("ts") < F.expr("timestamp_ntz '2024-01-15'")).cast("string"), F.lit('","junk":[1]}]'))
    return t.events.select(F.inline(jsonfn.records(made, "id:long,a:long,b:string"))).select(F.col("id").alias("event_id"), "a", "b")


@query("select doc_id, i::int as ordinal, w as word from (select doc_id, string_split(text, ' ') as ws from documents), unnest(ws) with ordinality as u(w, i) where i > 3 and i <= 8")
def ordinal_page(t):
    rows = t.documents.select("doc_id", F.split("text", " ").alias("ws"))
    return paging.blocks_page(rows, "ws", 3, 5).select("doc_id", F.col("ordinal").cast("int").alias("ordinal"), F.col("block").alias("word"))


@query("""select event_id, '{"k":' || json_extract_string(props, '$.k') || ',"u":' || user_id || '}' as merged, '{"u":' || user_id || '}' as less, false as forbidden, true as nested from events""")
def json_edits(t):
    both = jsonfn.merged(F.concat(F.lit('{"u":0,"k":'), F.get_json_object("props", "$.k"), F.lit("}")), F.concat(F.lit('{"u":'), F.col("user_id").cast("string"), F.lit("}")))
    return t.events.select("event_id", jsonfn.canonical(both).alias("merged"), jsonfn.without_keys(both, "k").alias("less"), jsonfn.forbidden_keys(F.col("props")).alias("forbidden"), jsonfn.forbidden_keys(F.lit('{"a":[{"Token" : 1}]}')).alias("nested"))


@query("""select event_id, '"' || event_type || '"' as found, null as missing, user_id::varchar as module from events""")
def json_pointers(t):
    made = F.concat(F.lit('{"a/b":[0,{"m~n":"'), F.col("event_type"), F.lit('"}],"sections":[{"modname":"page","id":'), F.col("user_id").cast("string"), F.lit(',"contents":[{"file_id":"f"}]},{"modname":"url","id":0}]}'))
    return t.events.select("event_id", jsonfn.at_pointer(made, F.lit("/a~1b/1/m~0n")).alias("found"), jsonfn.at_pointer(made, F.lit("/a~1b/7")).alias("missing"), jsonfn.module_of_file(made, F.lit("f")).alias("module"))


@query("""select event_id, '{"user":' || user_id || ',"list":[{"keep":1}],"url":"https://x/?wstoken=[REDACTED]&a=1"}' as clean from events""")
def json_redaction(t):
    made = F.concat(F.lit('{"user":'), F.col("user_id").cast("string"), F.lit(',"Password":"p","list":[{"sesskey":"s","keep":1}],"url":"https://x/?wstoken=abc123&a=1"}'))
    return t.events.select("event_id", jsonfn.redacted(made).alias("clean"))


# Text


@query(r"""select doc_id, trim(regexp_replace(nfc_normalize(text), '\s+', ' ', 'g')) as key, regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g') = text as clean from documents""")
def comparison_keys(t):
    return t.documents.select("doc_id", text.comparison_key(F.col("text")).alias("key"), (text.without_controls(F.col("text")) == F.col("text")).alias("clean"))


@query(r"""select doc_id, case when doc_id % 5 = 0 then 'other_author' when doc_id % 3 = 0 then 'differs' else 'matches' end as verdict from documents""")
def published_comparison(t):
    seen = F.concat(F.lit("  "), F.regexp_replace("text", " ", " \n "), F.when(F.col("doc_id") % 3 == 0, " more").otherwise(" "))
    return t.documents.select("doc_id", text.compare_published(F.col("text"), seen, F.col("doc_id") % 5 != 0).alias("verdict"))


@query("select page_id, regexp_replace(url, '^.*/', '') as last, replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') as escaped, 'Item' as title, left(trim(url), 300) as named from pages")
def page_names(t):
    u = F.col("url")
    return t.pages.select("page_id", text.last_segment(u).alias("last"), text.escaped(u).alias("escaped"), text.title_of(F.lit("  "), F.lit(None).cast("string")).alias("title"), text.title_of(F.lit(" "), u).alias("named"))


@query(r"""with d as (select doc_id, text, case when length(text) >= 260 then substr(text, 200, 60) end as part from documents), a as (select *, instr(text, part) as at_, string_split_regex(text, '\r\n|\r|\n') as lines from d)
select doc_id, (len(lines) - case when lines[-1] = '' then 1 else 0 end)::int as n, case when at_ > 0 then len(regexp_extract_all(substr(text, 1, at_ - 1), '\r\n|\r|\n')) + 1 end::int as first, case when at_ > 0 then len(regexp_extract_all(substr(text, 1, at_ - 1), '\r\n|\r|\n')) + 1 + len(regexp_extract_all(part, '\r\n|\r|\n')) end::int as last from a""")
def line_ranges(t):
    """Lines of every text, and those on which a passage of its own stands."""
    part = F.when(F.length("text") >= 260, F.substring("text", 200, 60))
    rows = t.documents.select("doc_id", F.size(text.lines(F.col("text"))).alias("n"), text.line_range(F.col("text"), part).alias("r"))
    return rows.select("doc_id", "n", F.col("r.first").cast("int").alias("first"), F.col("r.last").cast("int").alias("last"))


@query(r"""select p_partkey, case when p_partkey % 4 = 0 then '.env.local' when p_partkey % 4 = 1 then 'client_secret_1.JSON' when p_partkey % 4 = 2 then 'a/b.pem' else 'a/env.md' end as path, p_partkey % 4 < 3 as secret, true as safe, regexp_matches(p_partkey::varchar, '^[1-9][0-9]{0,17}$') as numeric from part""")
def path_rules(t):
    path = _pick([".env.local", "client_secret_1.JSON", "a/b.pem", "a/env.md"], F.col("p_partkey") % 4)
    return t.part.select("p_partkey", path.alias("path"), text.is_secret_path(path).alias("secret"), text.is_safe_relative(path).alias("safe"), text.numeric_id(F.col("p_partkey")).isNotNull().alias("numeric"))


@query("select p_partkey, p_brand || '_x' || '.pdf' as name, '# ' || p_name || chr(10) || chr(10) || '- ' || p_brand || chr(10) || chr(10) || 'end' as marked from part")
def names_and_marked_text(t):
    bad = F.concat(F.lit("c:\\dir/"), F.replace("p_brand", F.lit("#"), F.lit("#")), F.lit("?x.pdf"))
    block = lambda k, v: F.struct(F.lit(k).alias("kind"), v.alias("text"))
    blocks = F.array(block("heading", F.col("p_name")), block("list_item", F.col("p_brand")), block("paragraph", F.lit("end")))
    return t.part.select("p_partkey", F.replace(text.safe_filename(bad), F.lit("Brand_"), F.lit("Brand#")).alias("name"), text.marked_text(blocks).alias("marked"))


@query("select p_partkey, 3723004::bigint + (p_partkey % 60) * 1000 as ms, null::bigint as bad, 2 as cues, 61000 + 500 as first_end from part")
def timecodes(t):
    second = F.lpad((F.col("p_partkey") % 60).cast("string"), 2, "0")
    code = F.concat(F.lit("1:02:"), second, F.lit(",004"))
    srt = F.lit("1\n00:01:00,000 --> 00:01:01,500\n<b>x</b>\n\n2\n00:02:00.000 --> 00:02:01.000\ny\n")
    cues = text.subtitle_cues(srt)
    ms = timefn.milliseconds(code)
    return t.part.select("p_partkey", (ms + 3000).alias("ms"), timefn.milliseconds(F.lit("x")).alias("bad"), F.size(cues).alias("cues"), F.get(cues, 0)["end_ms"].cast("int").alias("first_end"))


@query("select c_custkey, c_custkey % 3 = 1 as public from customer")
def public_addresses(t):
    ip = _pick(["10.0.0.1", "8.8.4.4", "::ffff:192.168.0.1"], F.col("c_custkey") % 3)
    return t.customer.select("c_custkey", net.is_public_ip(ip).alias("public"))


# Digests


@query("select l_orderkey, substring(sha256('c1' || chr(10) || string_agg(l_partkey || ':' || l_linenumber, chr(10) order by l_partkey || ':' || l_linenumber)), 1, 32) as batch from lineitem group by 1")
def batch_ids(t):
    lines = F.collect_list(F.concat_ws(":", F.col("l_partkey").cast("string"), F.col("l_linenumber").cast("string")))
    return t.lineitem.groupBy("l_orderkey").agg(hashing.batch_id(F.lit("c1"), lines).alias("batch"))


@query("select n_regionkey, count(*) as row_count from nation group by 1")
def fingerprints_by_sum(t):
    a = storage.fingerprint_sum(t.nation, [F.col("n_nationkey"), F.col("n_name")])
    b = storage.fingerprint_sum(t.nation.orderBy(F.desc("n_name")), [F.col("n_nationkey"), F.col("n_name")])
    same = a.join(b, "fingerprint").select(F.col("fingerprint").isNotNull().alias("same"))  # a row each
    return t.nation.join(same).filter("same").groupBy("n_regionkey").agg(F.count("*").alias("row_count"))


# Time


@query("select o_orderkey, 'duedate' as field, o_orderdate + interval 30 day as at from orders where o_orderkey % 4 <> 0 union all select o_orderkey, 'extra' || i, o_orderdate + interval (i) day from orders, unnest(range(1, 21)) as r(i)")
def entity_date_fields(t):
    s = F.unix_seconds(F.col("o_orderdate").cast("timestamp"))
    more = F.transform(F.sequence(F.lit(1), F.lit(25)), lambda i: F.struct(F.concat(F.lit("extra"), i.cast("string")).alias("label"), (s + i * 86400).alias("timestamp")))
    rows = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 4 != 0, s + 30 * 86400).otherwise(0).alias("duedate"), more.alias("dates"))
    return timefn.date_fields(rows, ["o_orderkey"], ["duedate"], "dates").withColumn("at", F.col("at").cast("timestamp_ntz"))


@query("select event_id, strftime(timezone('America/Sao_Paulo', timezone('UTC', ts)), '%Y-%m-%d %H:%M:%S') as sao_paulo, strftime(timezone('Europe/Lisbon', timezone('UTC', ts)), '%Y-%m-%d %H:%M:%S') as lisbon from events")
def wall_times(t):
    d = timefn.displays(F.col("ts").cast("timestamp"), ["America/Sao_Paulo", "Europe/Lisbon"])
    return t.events.select("event_id", d.alias("d")).select("event_id", F.col("d")[0]["local"].alias("sao_paulo"), F.col("d")[1]["local"].alias("lisbon"))


@query("select event_id, case event_id % 6 when 0 then 'date_only' when 1 then 'instant' when 2 then 'unresolved' when 3 then 'unresolved' when 4 then 'instant' else 'unresolved' end as kind, case event_id % 6 when 2 then 'nonexistent_local_time' when 3 then 'ambiguous_local_time' when 5 then 'missing_zone' end as reason from events")
def normalised_dates(t):
    i = F.col("event_id") % 6
    when = F.when(i == 1, "2024-01-05 10:00:00Z").when(i == 2, "2024-03-31 01:30:00").when(i == 3, "2024-10-27 01:30:00").when(i >= 4, "2024-06-01 08:00:00")
    zone = F.when(i == 1, "UTC").when(i != 5, "Europe/Lisbon")
    n = timefn.normalize(F.lit("x"), F.when(i == 0, "2024-05-06"), when, zone)
    return t.events.select("event_id", n.alias("n")).select("event_id", "n.kind", "n.reason")


@query("select o_custkey, label, day from (select o_custkey, o_orderkey, 'due' as label, strftime(o_orderdate, '%d/%m/%Y %H:%M') as day from orders)")
def short_instants(t):
    return t.orders.select("o_custkey", F.lit("due").alias("label"), F.date_format("o_orderdate", "dd/MM/yyyy HH:mm").alias("day"))


# Joins and graphs


@query("select o_orderkey, coalesce(case when o_custkey % 2 = 0 then c_name end, n_name) as target from orders left join customer on c_custkey = o_custkey left join nation on n_nationkey = o_orderkey % 25")
def fallback_join(t):
    first = t.customer.filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("target"))
    second = t.nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("target"))
    left = t.orders.select("o_orderkey", "o_custkey", (F.col("o_orderkey") % 25).alias("k"))
    return joins.with_fallback(left, first, second, ["o_custkey"], ["k"], "target").select("o_orderkey", "target")


@query("with m as (select p_partkey, l_orderkey, l_linenumber, l_shipdate from part join lineitem on l_partkey = p_partkey union all select p_partkey, l_orderkey, l_linenumber, l_shipdate from part join lineitem on l_suppkey = p_partkey) select p_partkey, l_orderkey, l_linenumber::int as l_linenumber from m qualify row_number() over (partition by p_partkey order by l_shipdate, l_orderkey, l_linenumber) = 1")
def earliest_by_either_key(t):
    right = t.lineitem.select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", "l_shipdate")
    out = joins.earliest_by_either(t.part.select("p_partkey"), right, ["l_partkey", "l_suppkey"], ["l_shipdate", "l_orderkey", "l_linenumber"], "p_partkey")
    return out.select("p_partkey", "l_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber"))


@query("select a.event_id, b.event_id as receipt_id from events a join events b on a.user_id = b.user_id and a.event_type = 'purchase' and b.event_type = 'signup' and (a.event_id % 3 = 0 or b.event_id % 3 = 0 or a.event_id % 3 = b.event_id % 3)")
def matching_receipts(t):
    part = F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 3)
    side = lambda kind: t.events.filter(F.col("event_type") == kind).select(F.lit("c").alias("connection_id"), F.col("user_id").alias("course_id"), F.lit(1).alias("activity_id"), part.alias("discussion_id"), F.lit(None).cast("long").alias("parent_id"), "event_id")
    return ev.matching_receipts(side("purchase"), side("signup").withColumnRenamed("event_id", "receipt_id")).select("event_id", "receipt_id")


@query("""with b as (select c_custkey as c, case when c_custkey % 3 = 0 then 1 else 2 end as n from customer where c_custkey % 4 <> 0),
x as (select event_id, user_id, event_type, ts, case when event_id % 2 = 0 then 'e' || (event_id % 5) when n = 1 then 'm' end as target, event_id % 11 = 0 as gone from events left join b on c = user_id)
select event_id, target from x where target is not null qualify row_number() over (partition by target, event_type, user_id order by ts desc, event_id desc) = 1 and not gone""")
def academic_assertions(t):
    o = F.lit("o").alias("owner_id")
    e = t.events.select(o, F.col("event_id").alias("id"), F.col("user_id").alias("context_id"), F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("e"), (F.col("event_id") % 5).cast("string"))).otherwise("").alias("entity_id"), "event_type", F.col("user_id").alias("requirement_key"), F.array().cast("array<bigint>").alias("supersedes"), F.col("ts").alias("recorded_at"), F.lit(1).alias("version"), (F.col("event_id") % 11 == 0).alias("retracted"))
    b = t.customer.filter("c_custkey % 4 <> 0").select(o, F.col("c_custkey").alias("context_id"), F.explode(F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("m"))).otherwise(F.array(F.lit("m"), F.lit("n")))).alias("entity_id"), F.lit(True).alias("active"))
    return ev.academic_events(e, b).select(F.col("id").alias("event_id"), F.col("target_id").alias("target"))


@query("select event_id, lag(event_type) over (partition by user_id order by ts, event_id) as from_state, event_type as to_state from events")
def state_changes(t):
    return ev.change_log(t.events, ["user_id"], "ts", "event_id", "event_type").select("event_id", "from_state", "to_state")


@query("""with r as (select distinct l_orderkey as a, l_partkey as m, case l_returnflag when 'R' then 'required' when 'A' then 'suggested' else 'references' end as kind from lineitem),
g as (select a, m, case when bool_or(kind = 'required') then 'required' when bool_or(kind = 'suggested') then 'suggested' else 'references' end as relation, array_to_string(list_sort(list(distinct kind)), ';') as kinds from r group by all),
f as (select ps as m, count(*) as n from (select p_partkey as ps from part where p_partkey % 3 = 0 union all select p_partkey from part where p_partkey % 6 = 0) group by 1)
select a as activity_id, g.m as material_id, relation, kinds, coalesce(n, 0) as file_count, coalesce(n, 0) >= 2 as selection_required, relation = 'references' as bibliography from g join part on p_partkey = g.m left join f on f.m = g.m""")
def study_packages(t):
    o = F.lit("o").alias("owner_id")
    material = F.concat(F.lit("m"), F.col("l_partkey").cast("string"))
    relations = t.lineitem.select(o, F.col("l_orderkey").cast("string").alias("from_id"), material.alias("to_id"), F.expr("case l_returnflag when 'R' then 'required' when 'A' then 'suggested' else 'references' end").alias("kind")).distinct()
    entities = t.part.select(o, F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("title"), F.lit("resource").alias("kind"))
    files = t.part.filter("p_partkey % 3 = 0").select(o, F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("entity_id"), F.lit("a").alias("name"), F.explode(F.when(F.col("p_partkey") % 6 == 0, F.array(F.lit("1"), F.lit("2"))).otherwise(F.array(F.lit("1")))).alias("id"))
    focal = t.orders.select(o, F.col("o_orderkey").cast("string").alias("activity_id"))
    out = catalog.study_package(relations, entities, files, focal)
    return out.select(F.col("activity_id").cast("long").alias("activity_id"), F.substring("material_id", 2, 20).cast("long").alias("material_id"), "relation", F.array_join("kinds", ";").alias("kinds"), "file_count", "selection_required", "bibliography")


@query("with n as (select user_id, arg_max(event_id, (ts, event_id)) as h from events group by 1) select c_custkey as draft_id, case when h is null then 'unobserved' when h = c_custkey then 'unchanged' else 'changed' end as drift from customer left join n on user_id = c_custkey")
def draft_dependencies(t):
    newest = timeline.latest(t.events, ["user_id"], "ts", "event_id").select(F.col("user_id").alias("entity_id"), F.col("event_id").alias("content_hash"))
    return attention.dependency_drift(t.customer.select(F.col("c_custkey").alias("draft_id"), F.col("c_custkey").alias("entity_id"), F.col("c_custkey").alias("base_hash")), newest).select("draft_id", "drift")


# Records


@query("with l as (select l_orderkey as e, l_linenumber % 3 as k, count(distinct l_partkey) as versions, arg_max(l_partkey, (l_shipdate, sha256(l_partkey::varchar))) as now from lineitem group by all) select e as entity_id, k as requirement_key, versions, now::varchar as payload from l")
def recorded_requirements(t):
    req = t.lineitem.select(F.lit("o").alias("owner_id"), F.col("l_orderkey").cast("string").alias("entity_id"), F.concat_ws(":", F.col("l_orderkey").cast("string"), (F.col("l_linenumber") % 3).cast("string")).alias("requirement_key"), F.col("l_partkey").cast("string").alias("payload"), F.col("l_shipdate").alias("recorded_at"))
    known = req.select("owner_id", "entity_id", F.lit("x").alias("content_hash"), F.col("recorded_at").alias("observed_at"), F.col("payload").alias("content")).limit(0)
    entities, seen = records.record_requirements(req, known)
    versions = seen.groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("versions"))
    part = lambda i: F.element_at(F.split("external_id", ":"), i).cast("long")
    return entities.join(versions, "id").select(part(1).alias("entity_id"), part(2).alias("requirement_key"), "versions", F.col("state").alias("payload"))


@query("select o_orderkey as id, case when o_orderkey % 3 = 0 then 'archived' else 'current' end as part, case when o_orderkey % 3 = 0 then o_totalprice end as old from orders union all select o_orderkey, 'current', null from orders where o_orderkey % 3 = 0")
def archive_on_replace(t):
    now = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("v"))
    current, old = records.archive(now, now.filter("id % 3 = 0").withColumn("v", -F.col("v")), ["id"])
    return current.select("id", F.lit("current").alias("part"), F.lit(None).cast("double").alias("old")).union(old.select("id", F.lit("archived"), F.col("v").cast("double")))


@query("select doc_id, case when doc_id % 4 = 0 then 'no_evidence' when doc_id % 4 = 1 then 'other_author' when doc_id % 4 = 2 then 'differs' else 'matches' end as comparison from documents")
def draft_against_published(t):
    d = t.documents.select(F.col("doc_id").alias("entity_id"), F.col("text").alias("body"), F.lit("me").alias("author"))
    k = F.col("entity_id") % 4
    seen = d.select("entity_id", F.when(k == 2, F.concat("body", F.lit(" x"))).otherwise(F.concat(F.lit(" "), F.col("body"))).alias("body"), F.when(k == 1, "you").otherwise("me").alias("author"), F.lit(1).alias("observed_at"), F.lit("h").alias("content_hash"), F.when(k == 0, "partial").otherwise("complete").alias("coverage"))
    return records.observed_text(d, seen, "body", "author").select(F.col("entity_id").alias("doc_id"), "comparison")


@query("with n as (select user_id, arg_max(event_id, (ts, event_id)) as h from events group by 1) select c_custkey as entity_id, 'duedate' as field, to_timestamp(1700000000 + h)::timestamp as at, strftime(timezone('Europe/Lisbon', to_timestamp(1700000000 + h)), '%Y-%m-%d %H:%M:%S') as lisbon from n join customer on c_custkey = user_id")
def time_contexts(t):
    seen = t.events.select(F.lit("o").alias("owner_id"), F.col("user_id").alias("entity_id"), F.col("ts").alias("observed_at"), F.col("event_id").alias("content_hash"), F.concat(F.lit('{"duedate":'), (1700000000 + F.col("event_id")).cast("string"), F.lit("}")).alias("content"))
    out = records.time_context(t.customer.select(F.lit("o").alias("owner_id"), F.col("c_custkey").alias("id"), F.col("c_name").alias("title")), seen, ["Europe/Lisbon"], ["duedate"])
    return out.select("entity_id", "field", F.col("at").cast("timestamp_ntz").alias("at"), F.col("displays")[0]["local"].alias("lisbon"))


@query("select o_orderkey, case when n = 1 then one end as entity_id, case when n is null then 'unbound' when n > 1 then 'ambiguous' end as refusal from orders left join (select c_custkey, case when c_custkey % 3 = 0 then 1 else 2 end as n, 'm' as one from customer where c_custkey % 4 <> 0) on c_custkey = o_custkey")
def submission_reports(t):
    b = t.customer.filter("c_custkey % 4 <> 0").select(F.col("c_custkey").alias("context_id"), F.explode(F.when(F.col("c_custkey") % 3 == 0, F.array(F.lit("m"))).otherwise(F.array(F.lit("m"), F.lit("n")))).alias("entity_id"), F.lit(True).alias("active"))
    return records.report_submission(t.orders.select("o_orderkey", F.col("o_custkey").alias("context_id")), b).select("o_orderkey", "entity_id", "refusal")


@query("select o_orderkey from orders where o_orderkey % 3 = o_custkey % 3")
def fenced_writes(t):
    rows = t.orders.select("o_orderkey", F.col("o_custkey").alias("connection_id"), (F.col("o_orderkey") % 3).alias("epoch"))
    return records.fenced(rows, t.customer.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 3).alias("oauth_epoch"))).select("o_orderkey")


@query("select l_orderkey, l_linenumber::int as attempt, case when l_linenumber % 2 = 0 then 'failed' when o_orderstatus = 'F' then 'completed' else 'abandoned' end as outcome from lineitem join orders on o_orderkey = l_orderkey")
def crash_reconciliation(t):
    tries = t.lineitem.select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").cast("int").alias("attempt"), F.when(F.col("l_linenumber") % 2 == 0, "failed").otherwise("abandoned").alias("outcome"))
    jobs = t.orders.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "complete").otherwise("running").alias("state"))
    return records.crash_outcomes(tries, jobs).select(F.col("job_id").alias("l_orderkey"), "attempt", "outcome")


# Jobs, preferences and merges


@query("select o_orderkey, case when o_orderkey % 5 = 0 then 'running' when o_orderkey % 5 = 1 then 'complete' when o_orderkey % 5 = 2 then 'partial' when o_orderkey % 5 = 3 then 'expired' else 'failed' end as state, case when o_orderkey % 5 = 1 then 'new' else 'old' end as cursor from orders")
def finished_jobs(t):
    jobs = t.orders.select(F.col("o_orderkey").alias("id"), F.lit("running").alias("state"), F.lit("old").alias("cursor"))
    results = t.orders.filter("o_orderkey % 5 > 0").select(F.col("o_orderkey").alias("id"), _pick(["complete", "partial", "expired", "denied"], F.col("o_orderkey") % 5 - 1).alias("coverage"), F.lit("new").alias("cursor"))
    return lifecycle.finish(jobs, results).select(F.col("id").alias("o_orderkey"), "state", "cursor")


@query("select o_orderkey as job_id, case when o_orderkey % 3 = 0 then 'complete' when o_orderkey % 3 = 1 then 'running' else 'pending' end as state, case when o_orderkey % 3 = 0 then 2 when o_orderkey % 3 = 1 then 1 else 0 end::bigint as attempts from orders")
def job_lifecycle(t):
    at = lambda m: (F.col("o_orderdate") + F.make_dt_interval(mins=F.lit(m))).cast("timestamp")
    row = lambda m, kind, value=None: F.struct(at(m).alias("at"), F.lit(kind).alias("event"), F.lit(value).cast("string").alias("value"))
    k = F.col("o_orderkey") % 3
    rows = F.when(k == 0, F.array(row(0, "enqueue"), row(1, "claim"), row(4, "claim"), row(5, "finish", "complete"))).when(k == 1, F.array(row(0, "enqueue"), row(1, "claim"), row(9, "finish", "complete"))).otherwise(F.array(row(0, "enqueue"), row(1, "finish", "complete")))
    return lifecycle.job_states(t.orders.select(F.col("o_orderkey").alias("job_id"), F.inline(rows)))


@query("select o_orderkey as action_id, case when o_orderkey % 4 = 0 then 'succeeded' when o_orderkey % 4 = 1 then 'prepared' when o_orderkey % 4 = 2 then 'denied' else 'uncertain' end as state from orders")
def action_lifecycle(t):
    at = lambda m: (F.col("o_orderdate") + F.make_dt_interval(mins=F.lit(m))).cast("timestamp")
    row = lambda m, kind, expires=60: F.struct(at(m).alias("at"), F.lit(kind).alias("event"), at(expires).alias("expires_at"))
    k = F.col("o_orderkey") % 4
    full = [row(0, "prepare"), row(10, "approve"), row(20, "consume")]
    rows = F.when(k == 0, F.array(*full, row(30, "result"))).when(k == 1, F.array(row(0, "prepare", 5), row(10, "approve"))).when(k == 2, F.array(row(0, "prepare"), row(10, "deny"), row(20, "approve"))).otherwise(F.array(*full, row(40, "consume")))
    return lifecycle.action_states(t.orders.select(F.col("o_orderkey").alias("action_id"), F.inline(rows)))


@query("select p_partkey, case p_partkey % 5 when 0 then 'interval_order' when 1 then 'withdrawal_without_target' when 2 then 'repeated_target' when 3 then 'unknown_target' else '' end as violations from part")
def preference_problems(t):
    k, one = F.col("p_partkey") % 5, F.col("p_partkey").cast("string")
    start = F.expr("timestamp_ntz '2024-01-01'")
    none = F.array().cast("array<string>")
    supersedes = F.when(k == 2, F.array(one, one)).when(k == 3, F.array(F.lit("nobody"))).otherwise(none)
    rows = t.part.select("p_partkey", one.alias("id"), F.lit("k").alias("key"), F.create_map(F.lit("s"), one).alias("scope"), F.when(k == 1, "withdrawn").otherwise("active").alias("state"), start.alias("valid_from"), F.when(k == 0, start).alias("valid_until"), supersedes.alias("supersedes"))
    return preferences.problems(rows).select("p_partkey", F.array_join("violations", ";").alias("violations"))


@query("select doc_id, case when doc_id % 3 = 0 then 'partial' when doc_id % 2 = 0 then 'complete' else 'timeout' end as coverage, doc_id % 2 = 0 or doc_id % 3 = 0 and n_chars > 500 as wins from documents")
def coverage_merges(t):
    d, k = F.col("doc_id"), F.col("doc_id") % 3 == 0
    prior, run = F.when(k, "partial").otherwise("timeout"), F.when(k & (d % 2 > 0), "partial").when(d % 2 == 0, "complete").otherwise("denied")
    blocks = F.when(k, F.col("n_chars")).otherwise(0)
    return t.documents.select("doc_id", merge.merged_coverage(prior, run, k).alias("coverage"), merge.retry_wins(prior, F.lit(500), run, blocks).alias("wins"))


@query("select doc_id, case when doc_id % 4 = 0 then 'chars' else '' end as violations from documents")
def counter_checks(t):
    rows = t.documents.select("doc_id", (F.char_length("text") + (F.col("doc_id") % 4 == 0).cast("int")).alias("chars"), F.octet_length("text").alias("bytes"), "text")
    return merge.counters_agree(rows, {"chars": F.char_length("text"), "bytes": F.octet_length("text")}).select("doc_id", F.array_join("violations", ";").alias("violations"))


# Captures and staging


def _captures(t):
    made = F.concat(F.lit('{"courses":[{"id":'), F.col("o_custkey").cast("string"), F.lit(',"fullname":"c","assignments":[{"id":'), F.col("o_orderkey").cast("string"), F.lit(',"cmid":1,"name":"a","intro":"i","duedate":7},{"id":0,"name":"b"}]}]}'))
    return t.orders.select(F.lit("assignments").alias("function"), F.lit("{}").alias("params"), made.alias("response"), F.col("o_orderdate").alias("captured_at"))


@query("select o_custkey as course_id, o_orderkey as id, 'a' as name, 7::bigint as duedate from orders union all select o_custkey, 0, 'b', null from orders")
def captured_assignments(t):
    return captures.assignments(_captures(t)).select("course_id", "id", "name", "duedate")


@query("select o_custkey as course_id, o_orderkey as section_id, m as module_id, case when m is not null then 1 else -1 end as files from orders, unnest(case when o_orderkey % 3 = 0 then [null] else [1, 2] end) as u(m)")
def captured_contents(t):
    files = '"contents":[{"filename":"f","fileurl":"u","filesize":3}]'
    modules = F.when(F.col("o_orderkey") % 3 == 0, F.lit("[]")).otherwise(F.lit(f'[{{"id":1,"name":"x","modname":"page","instance":5,{files}}},{{"id":2,"name":"y","modname":"url","instance":6,{files}}}]'))
    rows = t.orders.select(F.lit("contents").alias("function"), F.concat(F.lit('{"courseid":'), F.col("o_custkey").cast("string"), F.lit("}")).alias("params"), F.concat(F.lit('[{"id":'), F.col("o_orderkey").cast("string"), F.lit(',"name":"s","modules":'), modules, F.lit("}]")).alias("response"), F.col("o_orderdate").alias("captured_at"))
    return captures.course_contents(rows).select("course_id", "section_id", F.col("module_id").cast("int").alias("module_id"), F.coalesce(F.size("files"), F.lit(-1)).alias("files"))


@query("select conv_id as forum_id, 0 as page, count(*) = 20 as has_more, count(*) as n from conversations group by 1")
def captured_discussions(t):
    rows = t.conversations.groupBy("conv_id").agg(F.to_json(F.struct(F.collect_list(F.struct(F.col("turn").cast("long").alias("discussion"), F.col("turn").cast("long").alias("id"), F.col("role").alias("name"))).alias("discussions"))).alias("response"))
    caps = rows.select(F.lit("discussions").alias("function"), F.concat(F.lit('{"page":0,"forumid":'), F.col("conv_id").cast("string"), F.lit("}")).alias("params"), "response", F.lit(None).cast("timestamp").alias("captured_at"))
    return captures.discussions(caps, 20).groupBy("forum_id", "page", "has_more").agg(F.count("*").alias("n"))


@query("select conv_id as discussion_id, turn + 1 as post_id, turn as parent_id, n > 3 as truncated from (select *, row_number() over (partition by conv_id order by turn) as i, count(*) over (partition by conv_id) as n from conversations) where i <= 3")
def captured_posts(t):
    one = F.struct((F.col("turn") + 1).cast("long").alias("id"), F.when(F.col("turn") > 0, F.col("turn").cast("long")).alias("parentid"), F.struct(F.lit(7).cast("long").alias("id")).alias("author"), F.lit("s").alias("subject"), F.col("text").alias("message"), F.col("turn").cast("long").alias("timecreated"))
    rows = t.conversations.groupBy("conv_id").agg(F.to_json(F.struct(F.collect_list(one).alias("posts"))).alias("response"))
    caps = rows.select(F.lit("posts").alias("function"), F.concat(F.lit('{"discussionid":'), F.col("conv_id").cast("string"), F.lit("}")).alias("params"), "response")
    return captures.posts(caps, limit=3).select("discussion_id", "post_id", "parent_id", "truncated")


@query("select case when o_orderkey % 2 = 0 then 'grades' else 'submission_status' end as function, count(*) as n, 'denied' as coverage from orders where o_orderkey % 4 < 2 group by 1")
def denied_functions(t):
    caps = t.orders.select(_pick(["grades", "submission_status", "posts", "contents"], F.col("o_orderkey") % 4).alias("function"), F.col("o_orderdate").alias("captured_at"))
    return captures.denied(caps).groupBy("function", "coverage").agg(F.count("*").alias("n"))


@query("select event_id from events where ts >= timestamp '2024-01-05' and ts < timestamp '2024-01-12'")
def calendar_interval(t):
    return captures.calendar(t.events.withColumnRenamed("ts", "starts_at"), F.expr("timestamp_ntz '2024-01-05'"), F.expr("timestamp_ntz '2024-01-12'")).select("event_id")


@query("select o_orderkey, case o_orderkey % 3 when 2 then 'parsing_error' else 'complete' end as coverage, case o_orderkey % 3 when 0 then 1 when 1 then 2 else -1 end as n from orders")
def unwrapped_envelopes(t):
    r = _pick(['[{"id":1}]', '{"warnings":[],"items":[{"id":1},{"id":2}]}', '{"exception":"x"}'], F.col("o_orderkey") % 3)
    return t.orders.select("o_orderkey", captures.unwrapped(r, "items", "id:long").alias("u")).select("o_orderkey", "u.coverage", F.coalesce(F.size("u.items"), F.lit(-1)).alias("n"))


@query("select case encoding when 'utf-8' then 'utf-8' end as encoding, count(*) as files, sum(strlen(text))::bigint as bytes from (select 'utf-8' as encoding, text from documents) group by 1")
def staged_inventory(t):
    files = t.documents.select(F.concat(F.lit("/root/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), F.col("text").cast("binary").alias("content"))
    return staging.totals(staging.inventory(files, "root")).select("encoding", "files", "bytes")


@query("select doc_id::varchar as path, case doc_id % 5 when 0 then 'missing' when 1 then 'extra' when 2 then 'corrupted' when 3 then 'blob_mismatch' else 'ok' end as finding from documents")
def staging_findings(t):
    d, k = t.documents.select(F.col("doc_id").cast("string").alias("path"), F.sha2("text", 256).alias("sha256"), hashing.git_blob_id(F.col("text")).alias("git_blob"), (F.col("doc_id") % 5).alias("k")), F.col("k")
    stored = d.filter("k <> 0").select("path", F.when(k == 2, "x").otherwise(F.col("sha256")).alias("sha256"), F.when(k == 3, "y").otherwise(F.col("git_blob")).alias("git_blob"))
    return staging.verify(d.filter("k <> 1"), stored)


@query("select l_orderkey, l_linenumber::int as l_linenumber from lineitem where l_orderkey % 2 = 0 or l_partkey % 3 = 0")
def dangling_relations(t):
    rel = t.lineitem.select("l_orderkey", F.col("l_linenumber").cast("int").alias("l_linenumber"), F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("from_id"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("to_id"))
    known = t.orders.filter("o_orderkey % 2 <> 0").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id")).union(t.part.filter("p_partkey % 3 <> 0").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string"))))
    return staging.dangling(rel, known).select("l_orderkey", "l_linenumber")


@query("select doc_id, case when doc_id % 7 = 0 then 'no_digest' when doc_id % 7 = 1 then 'no_extraction' when doc_id % 7 = 2 then 'unreadable' end as refusal from documents")
def import_refusals(t):
    k = F.col("doc_id") % 7
    mine = F.sha1(F.col("doc_id").cast("string"))
    occurrences = t.documents.select("doc_id", F.when(k != 0, mine).alias("sha256"))
    extractions = t.documents.filter(k != 1).select(mine.alias("sha256"), F.when(k == 2, "parsing_error").otherwise("complete").alias("coverage"), "text")
    return staging.import_refusals(occurrences, extractions).select("doc_id", "refusal")


@query("select count(*) as blobs, count(distinct sha256(text)) as distinct_blobs from (select distinct sha256(text) as x, text from documents)")
def staged_store(t):
    inv = staging.inventory(t.documents.select(F.concat(F.lit("/r/"), F.col("doc_id").cast("string")).alias("path"), F.col("text").cast("binary").alias("content")), "r")
    store = staging.new_blobs(inv, inv.limit(0)).withColumn("content", F.when(F.crc32("sha256") % 2 == 0, F.lit(b"damaged")).otherwise(F.col("content")))
    return staging.staged(inv, store).filter(F.sha2("content", 256) == F.col("sha256")).agg(F.count("*").alias("blobs"), F.count_distinct("sha256").alias("distinct_blobs"))


@query("select doc_id, case when doc_id % 4 = 3 then 1 else 0 end as masked from documents where doc_id % 4 > 0")
def redacted_export(t):
    k = F.col("doc_id") % 4
    path = F.when(k == 0, F.concat(F.col("doc_id").cast("string"), F.lit("/.env"))).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".md")))
    body = F.when(k == 3, F.lit("key ghp_aaaaaaaaaaaaaaaaaaaaaaaa end")).otherwise(F.lit("plain"))
    out = staging.export(t.documents.select("doc_id", path.alias("path"), F.lit("utf-8").alias("encoding"), body.cast("binary").alias("content")))
    return out.select("doc_id", F.contains(F.col("content").cast("string"), F.lit("[REDACTED]")).cast("int").alias("masked"))


# Resumable reads


@query("""with p as (select o_custkey as c, row_number() over (partition by o_custkey order by o_orderkey) - 1 as pos, o_orderkey as f, o_orderkey % 3 + 1 as pages from orders), x as (select c, pos, f, i as page from p, unnest(range(pages)) as r(i))
select c as course_id, n as call, pos as position, f as forum_id, page from (select *, row_number() over (partition by c order by pos, page) as n from x) where n <= 5""")
def next_forum_reads(t):
    forums = timeline.numbered(t.orders, ["o_custkey"], ["o_orderkey"]).select(F.col("o_custkey").alias("course_id"), (F.col("version") - 1).cast("long").alias("position"), F.col("o_orderkey").alias("forum_id"), (F.col("o_orderkey") % 3 + 1).alias("pages"))
    # A saved forum that has moved: the course begins again.
    progress = forums.filter("position = 1").select("course_id", "position", (F.col("forum_id") + 1).alias("forum_id"), F.lit(1).cast("long").alias("next_page"))
    return resume.next_reads(forums, progress, 5).select("course_id", F.col("call").cast("long").alias("call"), "position", "forum_id", "page")


NAMES = tuple(n for n in QUERIES if n not in _FIRST)
