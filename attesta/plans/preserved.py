"""Queries that read parts of preserved JSON, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.operators import preserved
from attesta.plans.queries import query

_ENVELOPES = {"material.v1": "value", "native.v1": "native"}


def _conversations(t):
    """A material for each conversation: its turns as an array; some in an envelope, some in one that isn't known."""
    turn = F.to_json(F.struct("turn", "role", F.length("text").alias("size")))
    turns = t.conversations.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", turn.alias("j")))).alias("all"))
    array = F.concat(F.lit("["), F.array_join(F.transform("all", lambda x: x["j"]), ","), F.lit("]"))
    plain = F.concat(F.lit('{"turns":'), array, F.lit(',"a/b~c":{"n":'), F.size("all").cast("string"), F.lit("}}"))
    wrapped = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit('{"format":"material.v1","value":'), plain, F.lit("}"))).when(F.col("conv_id") % 3 == 1, F.concat(F.lit('{"format":"other","turns":'), array, F.lit(',"value":1}'))).otherwise(plain)
    return turns.select(F.col("conv_id").alias("file_id"), F.concat(F.lit("v"), (F.col("conv_id") % 7).cast("string")).alias("sha256"), wrapped.alias("content"), F.size("all").alias("n"))


@query("""with c as (select conv_id, turn, '{"turn":' || turn || ',"role":"' || role || '","size":' || length(text) || '}' as j, row_number() over (partition by conv_id order by turn) - 1 as i, count(*) over (partition by conv_id) as n from conversations),
asked as (select distinct conv_id, n, unnest([0, 2, 5]) as start, case when conv_id % 2 = 0 then 3 end as lim, conv_id % 11 = 0 as stale from c),
part as (select a.conv_id, a.start, c.i, c.j, sum(strlen(c.j) + 1) over (partition by a.conv_id, a.start order by c.i) + 1 as bytes from asked a join c on c.conv_id = a.conv_id and c.i >= a.start and c.i < a.start + coalesce(a.lim, 20)),
cut as (select conv_id, start, string_agg(j, ',' order by i) filter (where bytes <= 200 or i = start) as body, count(*) filter (where bytes <= 200 or i = start) as k from part group by all)
select a.conv_id, a.start as page_offset, case when stale then 'file_changed' when a.start > n then 'invalid_offset' end as refusal, case when not stale and a.start <= n then '[' || coalesce(body, '') || ']' end as result,
  case when not stale and a.start <= n and a.start + coalesce(k, 0) < n then a.start + coalesce(k, 0) end as next_offset, case when not stale and a.start <= n then case when a.start + coalesce(k, 0) < n then 'partial' else 'complete' end end as coverage from asked a left join cut on cut.conv_id = a.conv_id and cut.start = a.start""")
def pointer_array_pages(t):
    """Pages of each conversation's turns, of at most 200 bytes or three turns, from three cursors."""
    m = _conversations(t)
    requests = m.select("file_id", F.when(F.col("file_id") % 11 == 0, "old").otherwise(F.col("sha256")).alias("sha256"), F.lit("/turns").alias("pointer"), F.explode(F.array(F.lit(0), F.lit(2), F.lit(5))).alias("offset"), F.when(F.col("file_id") % 2 == 0, 3).alias("limit"), F.lit(0).alias("children_offset"))
    out = preserved.read_parts(requests, m, _ENVELOPES, budget=200)
    return out.select(F.col("file_id").alias("conv_id"), F.col("offset").alias("page_offset"), "refusal", "result", "next_offset", "coverage")


@query("""with c as (select conv_id, count(*) as n from conversations group by 1), p as (select unnest(['/a~1b~0c/n', '/turns/0/turn', '/turns/x', '/turns/01', '/missing', 'turns', '/value', '/turns/~2']) as pointer)
select conv_id, pointer, case when pointer in ('turns', '/turns/~2') then 'invalid_locator' when pointer in ('/turns/x', '/turns/01') then 'invalid_locator' when pointer = '/missing' or pointer = '/value' and conv_id % 3 <> 1 or pointer = '/a~1b~0c/n' and conv_id % 3 = 1 then 'not_found' end as refusal,
  case when pointer = '/a~1b~0c/n' and conv_id % 3 <> 1 then n::varchar when pointer = '/turns/0/turn' then '0' when pointer = '/value' and conv_id % 3 = 1 then '1' end as result from c, p""")
def pointer_values(t):
    """Pointers with escapes, places that aren't numbers, missing names; an unknown envelope isn't opened."""
    m = _conversations(t)
    wanted = F.explode(F.array(*[F.lit(p) for p in ("/a~1b~0c/n", "/turns/0/turn", "/turns/x", "/turns/01", "/missing", "turns", "/value", "/turns/~2")]))
    requests = m.select("file_id", "sha256", wanted.alias("pointer"), F.lit(0).alias("offset"), F.lit(None).cast("int").alias("limit"), F.lit(0).alias("children_offset"))
    return preserved.read_parts(requests, m, _ENVELOPES).select(F.col("file_id").alias("conv_id"), "pointer", "refusal", "result")


@query("""with d as (select doc_id, text, length(text) as n, unnest([0, 700, 2400]) as start from documents),
x as (select *, case when start <= n then substr(text, start + 1, case when doc_id % 2 = 0 then 500 else 8000 end) end as piece from d)
select doc_id, start as page_offset, case when start > n then 'invalid_offset' end as refusal, sha256(piece) as piece_sha256, case when start <= n and start + length(piece) < n then start + length(piece) end as next_offset, case when start > n then null when start + length(piece) < n then 'partial' else 'complete' end as coverage from x""")
def pointer_text_pages(t):
    """Pages of every document's text from three cursors."""
    m = t.documents.select(F.col("doc_id").alias("file_id"), F.lit("v").alias("sha256"), F.to_json(F.struct(F.lit("native.v1").alias("format"), F.struct("text").alias("native"))).alias("content"))
    requests = m.select("file_id", "sha256", F.lit("/text").alias("pointer"), F.explode(F.array(F.lit(0), F.lit(700), F.lit(2400))).alias("offset"), F.when(F.col("file_id") % 2 == 0, 500).alias("limit"), F.lit(0).alias("children_offset"))
    out = preserved.read_parts(requests, m, _ENVELOPES)
    return out.select(F.col("file_id").alias("doc_id"), F.col("offset").alias("page_offset"), "refusal", F.sha2(F.from_json(F.concat(F.lit("["), "result", F.lit("]")), "array<string>")[0], 256).alias("piece_sha256"), "next_offset", "coverage")


@query("""with d as (select source, list('d' || doc_id order by doc_id) as names, count(*) as n, sum(length('d' || doc_id) + 4 + length(n_chars::varchar)) + 1 as bytes from (select distinct source, doc_id, n_chars from documents) group by 1), a as (select *, unnest([0, 30, 5000]) as start from d)
select source, start as children_from, case when start > 0 and (bytes <= 640 or start > n) then 'invalid_offset' end as refusal, bytes <= 640 and start = 0 as shown, case when bytes > 640 and start <= n then array_to_string(names[start + 1:start + 100], ';') when bytes <= 640 and start = 0 then '' end as children,
  case when bytes > 640 and start + 100 < n then start + 100 end as children_next_offset from a""")
def pointer_children(t):
    """What is too large to be shown lists the names one level down, a hundred at a time."""
    pair = F.concat(F.lit('"d'), F.col("doc_id").cast("string"), F.lit('":'), F.col("n_chars").cast("string"))
    m = t.documents.select("source", "doc_id", "n_chars").distinct().groupBy("source").agg(F.sort_array(F.collect_list(F.struct("doc_id", pair.alias("j")))).alias("all"))
    m = m.select(F.col("source").alias("file_id"), F.lit("v").alias("sha256"), F.concat(F.lit("{"), F.array_join(F.transform("all", lambda x: x["j"]), ","), F.lit("}")).alias("content"))
    requests = m.select("file_id", "sha256", F.lit("").alias("pointer"), F.lit(0).alias("offset"), F.lit(None).cast("int").alias("limit"), F.explode(F.array(F.lit(0), F.lit(30), F.lit(5000))).alias("children_offset"))
    out = preserved.read_parts(requests, m, budget=640)
    return out.select(F.col("file_id").alias("source"), F.col("children_offset").alias("children_from"), "refusal", F.col("result").isNotNull().alias("shown"), F.array_join("children", ";").alias("children"), "children_next_offset")


# A tree of a depth that differs by document, with markup, secrets, files, attachments and references in it.
_LEAF = """'{"type":"' || case doc_id % 3 when 0 then 'url' when 1 then 'file' else 'content' end || '","filename":"f' || doc_id || '.pdf","filesize":' || n_chars || ',"fileurl":"' || case doc_id % 4 when 0 then 'https://user@host/x' when 1 then 'HTTPS://Files.example/a/' || doc_id || '?token=abc&x=1' when 2 then 'ftp://files.example/b' else 'http://files.example' end || '"}'"""
_TREE = f"""select doc_id, '{{"intro":"<p onclick=\\"x()\\">Doc&nbsp;' || doc_id || '</p><script>no()</script>","Token":"t","name":"n?wstoken=zz' || doc_id || '","modules":[' || case when doc_id % 2 = 0 then '{{"email":"a@b","description":"<b>deep</b> <iframe src=x></iframe>' || source || '","files":[' || {_LEAF} || ',{{"url":"https://host/p/' || doc_id || '#top","filename":"a","filesize":"7"}}]}}' else {_LEAF} end || '],"n":' || n_chars || '}}' as j from documents"""


def _trees(t):
    """The same JSON as the SQL builds."""
    d, n = F.col("doc_id").cast("string"), F.col("n_chars").cast("string")
    cat = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    url = F.when(F.col("doc_id") % 4 == 0, F.lit("https://user@host/x")).when(F.col("doc_id") % 4 == 1, cat("HTTPS://Files.example/a/", d, "?token=abc&x=1")).when(F.col("doc_id") % 4 == 2, F.lit("ftp://files.example/b")).otherwise("http://files.example")
    kind = F.when(F.col("doc_id") % 3 == 0, "url").when(F.col("doc_id") % 3 == 1, "file").otherwise("content")
    leaf = cat('{"type":"', kind, '","filename":"f', d, '.pdf","filesize":', n, ',"fileurl":"', url, '"}')
    deep = cat('{"email":"a@b","description":"<b>deep</b> <iframe src=x></iframe>', F.col("source"), '","files":[', leaf, ',{"url":"https://host/p/', d, '#top","filename":"a","filesize":"7"}]}')
    whole = cat('{"intro":"<p onclick=\\"x()\\">Doc&nbsp;', d, '</p><script>no()</script>","Token":"t","name":"n?wstoken=zz', d, '","modules":[', F.when(F.col("doc_id") % 2 == 0, deep).otherwise(leaf), '],"n":', n, "}")
    return t.documents.select("doc_id", preserved.normalised(whole).alias("normal"))


@query(f"""with j as ({_TREE}), x as (select doc_id, t.* from j, json_tree(j.j) t),
o as (select doc_id, fullkey as path, json_extract_string(value, '$.filename') as name, json_extract_string(value, '$.type') as kind, json_extract_string(value, '$.fileurl') as fileurl, json_extract_string(value, '$.url') as url, json_extract(value, '$.filesize') as size from x where type = 'OBJECT'),
f as (select *, case when fileurl is not null and kind = 'url' then case when regexp_full_match(fileurl, '(?i)https?://[^/?#@\\s]+[^\\s]*') and not regexp_matches(fileurl, '://[^/?#]*@') then 'reference' else 'unsafe' end when fileurl is not null and kind <> 'content' or url is not null and name is not null and size is not null then 'file' end as what from o)
select doc_id, path, name, case what when 'reference' then regexp_replace(lower(regexp_extract(fileurl, '(?i)^https?://[^/?#]+')) || case when regexp_full_match(fileurl, '(?i)https?://[^/?#]+') then '/' else regexp_replace(fileurl, '(?i)^https?://[^/?#]+', '') end, 'token=[^&]+', 'token=[REDACTED]') when 'file' then regexp_replace(coalesce(fileurl, url), '[?#].*', '') end as url,
case when json_type(size) in ('UBIGINT', 'BIGINT') then size::bigint end as size, what as kind from f where what is not null""")
def normalised_files(t):
    """Files, references and unsafe references of nested values, with their paths."""
    return preserved.files_of(_trees(t), ["doc_id"])


@query("""select doc_id, '$.intro' as path, 'Doc ' || doc_id as text from documents union all select doc_id, '$.modules[0].description', trim('deep ' || source) from documents where doc_id % 2 = 0""")
def normalised_twins(t):
    """The text twins of markup at any depth."""
    return _trees(t).select("doc_id", F.explode("normal.twins").alias("w")).select("doc_id", "w.path", "w.text")


@query(f"""with j as ({_TREE}) select doc_id, '<p>Doc&nbsp;' || doc_id || '</p>' as intro, 'n?wstoken=[REDACTED]' as name, 'intro;intro_text;modules;n;name' as names, case when doc_id % 2 = 0 then '<b>deep</b> ' || source end as description, n_chars as n from documents""")
def normalised_trees(t):
    """What is kept of a value: names at the top, sanitised markup, redacted texts, untouched numbers."""
    tree = F.col("normal.tree")
    at = lambda p: F.get_json_object(tree, p)
    return _trees(t).select("doc_id", at("$.intro").alias("intro"), at("$.name").alias("name"), F.array_join(F.sort_array(F.json_object_keys(tree)), ";").alias("names"), at("$.modules[0].description").alias("description"), at("$.n").cast("long").alias("n"))
