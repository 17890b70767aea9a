"""Links of pages as they are meant, and texts that keep them, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from attesta.functions import net, text
from attesta.plans.queries import query

_SECRET = ", ".join(f"'{n}'" for n in net.SECRET_PARAMETERS)


def _resolved_sql(href: str, base: str) -> str:
    """``net.resolved`` in DuckDB, of two columns."""
    s, origin = f"lower(regexp_extract({base}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))", f"lower(regexp_extract({base}, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || '://' || regexp_extract({base}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
    path = f"coalesce(nullif(regexp_extract({base}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), ''), '/')"
    whole = f"""case when regexp_matches({href}, '^[A-Za-z][A-Za-z0-9+.-]*:') then {href} when starts_with({href}, '//') then {s} || ':' || {href} when starts_with({href}, '/') then {origin} || {href} when starts_with({href}, '?') then {origin} || {path} || {href}
      when {href} = '' or starts_with({href}, '#') then {origin} || {path} || regexp_extract({base}, '^[^?#]*(\\?[^#]*)', 1) || {href} else {origin} || regexp_replace({path}, '[^/]*$', '') || {href} end"""
    return whole


_PARTS = """lower(regexp_extract(w, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) as kind, lower(regexp_extract(w, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) as host, string_split(substr(regexp_extract(w, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1), 2), '/') as way,
  list_filter(string_split(regexp_extract(w, '^[^?#]*\\?([^#]*)', 1), '&'), lambda p: p <> '' and lower(regexp_extract(p, '^([^=]*)', 1)) not in (%s)) as asked, regexp_extract(w, '(#.*)$', 1) as mark""" % _SECRET
_JOINED = """case when kind in ('http', 'https') and host <> '' and not contains(host, '@') and not regexp_matches(w, '\\s') then kind || '://' || regexp_replace(host, case kind when 'http' then ':80$' else ':443$' end, '') || '/' || array_to_string(kept, '/') || case when way[-1] in ('.', '..') and len(kept) > 0 then '/' else '' end
  || case when len(asked) > 0 then '?' || array_to_string(asked, '&') else '' end || mark end"""
_FLAT = "list_reduce(list_prepend([]::varchar[], list_transform(way, lambda x: [x])), lambda a, x: case when x[1] = '..' then a[1:len(a) - 1] when x[1] = '.' then a else list_concat(a, x) end)"

_HREFS = """select page_id, url, i, case i % 9 when 0 then h when 1 then '..' || h when 2 then 'a/./b/../' || substr(h, 2) when 3 then '//Other.example:80' || h when 4 then '?token=1&q=' || substr(h, 2) || '&SessKey=2' when 5 then '#' || substr(h, 2) when 6 then 'mailto:' || substr(h, 2) when 7 then 'HTTPS://Host.example:443/x/../..' || h || '/.' else 'http://user:p@host' || h end as href
from (select page_id, url, h, row_number() over (partition by page_id order by pos) - 1 as i from (select page_id, url, unnest(hs) as h, unnest(range(len(hs))) as pos from (select page_id, url, regexp_extract_all(html, 'href="(/[^"\\s]*)"', 1) as hs from pages)))"""


def _references(t):
    """The links of each page, most of them written in another way."""
    found = t.pages.select("page_id", "url", F.posexplode(F.regexp_extract_all("html", F.lit('href="(/[^"\\s]*)"'), 1)).alias("i", "h"))
    h, rest = F.col("h"), F.substring("h", F.lit(2), F.length("h"))
    forms = [h, F.concat(F.lit(".."), h), F.concat(F.lit("a/./b/../"), rest), F.concat(F.lit("//Other.example:80"), h), F.concat(F.lit("?token=1&q="), rest, F.lit("&SessKey=2")), F.concat(F.lit("#"), rest), F.concat(F.lit("mailto:"), rest), F.concat(F.lit("HTTPS://Host.example:443/x/../.."), h, F.lit("/.")), F.concat(F.lit("http://user:p@host"), h)]
    return found.select("page_id", "url", "i", F.element_at(F.array(*forms), (F.col("i") % 9 + 1).cast("int")).alias("href"))


@query(f"""with r as ({_HREFS}), w as (select *, {_resolved_sql('href', 'url')} as w from r), p as (select *, {_PARTS} from w), k as (select *, {_FLAT} as kept from p) select page_id, i, href, {_JOINED} as address from k""")
def resolved_links(t):
    return _references(t).select("page_id", "i", "href", net.resolved(F.col("href"), F.col("url")).alias("address"))


@query(f"""with d as (select page_id, url, regexp_replace(html, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<noscript\\b.*?</noscript\\s*>|<template\\b.*?</template\\s*>|<!--.*?-->', ' ', 'g') as h from pages where url is not null),
s as (select page_id, url, unnest(string_split_regex(h, '(?i)</a\\s*>')) as part, unnest(range(1, len(string_split_regex(h, '(?i)</a\\s*>')) + 1)) as i, len(string_split_regex(h, '(?i)</a\\s*>')) as n from d),
f as (select *, regexp_extract(part, '(?is)^.*<a\\b[^>]*?\\shref\\s*=\\s*("[^"]*"|''[^'']*''|[^\\s>]+)', 1) as raw from s), hr as (select *, replace(regexp_replace(raw, '^["'']|["'']$', '', 'g'), '&amp;', '&') as href from f),
w as (select *, {_resolved_sql('href', 'url')} as w from hr), p as (select *, {_PARTS} from w), k as (select *, {_FLAT} as kept from p),
j as (select page_id, string_agg(part || case when i < n and raw <> '' then coalesce(' (' || replace(replace({_JOINED}, '&', '&amp;'), '<', '&lt;') || ')', '') else '' end, '' order by i) as h from k group by page_id),
l as (select page_id, regexp_replace(regexp_replace(h, '(?i)<br\\s*/?>|</(p|div|li|tr|h[1-6]|section|article)\\s*>', chr(10), 'g'), '<[^>]*>', '', 'g') as h from j),
e as (select page_id, replace(replace(replace(replace(replace(replace(h, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') as h from l)
select page_id, sha256(trim(regexp_replace(regexp_replace(h, '[ \\t]+', ' ', 'g'), '\\s*\\n\\s*', chr(10), 'g'), ' ')) as text_sha256 from e""")
def linked_page_texts(t):
    pages = t.pages.filter("url is not null")
    return pages.select("page_id", F.sha2(text.linked_text(F.col("html"), F.col("url")), 256).alias("text_sha256"))


@query("""with x as (select *, case when event_type in ('signup', 'error') then event_type = 'signup' end as granted from events where event_type in ('signup', 'error', 'view')),
g as (select *, last_value(granted ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as now from x)
select event_id, user_id, case when now is null then 'never_granted' when not now then 'revoked' end as refusal, case when now then round(value, 2) end as value, case when now and event_id % 3 = 0 then true end as feedback_available from g where event_type = 'view' and not (coalesce(now, false) and event_id % 7 = 0) union all
select event_id, user_id, 'not_own', null, null from g where event_type = 'view' and now and event_id % 7 = 0""")
def consented_reads(t):
    """Readings of an own status: the newest grant before each decides, and of what is read no grade stays."""
    from attesta.operators import qualification

    e = t.events.filter("event_type in ('signup', 'error', 'view')").select(F.lit("o").alias("owner_id"), F.col("user_id").alias("connection_id"), "event_id", "ts", "event_type", "value")
    grants = e.filter("event_type <> 'view'").select("owner_id", "connection_id", F.struct("ts", "event_id").alias("seq"), (F.col("event_type") == "signup").alias("granted"))
    body = F.to_json(F.struct(F.struct(F.struct(F.when(F.col("event_id") % 7 == 0, F.col("connection_id") + 1).otherwise(F.col("connection_id")).alias("userid"), F.round("value", 2).cast("string").alias("status")).alias("submission")).alias("lastattempt"), F.when(F.col("event_id") % 3 == 0, F.struct(F.lit(1).alias("gradeddate"), F.lit("A").alias("grade"))).alias("feedback")))
    reads = e.filter("event_type = 'view'").select("owner_id", "connection_id", F.struct("ts", "event_id").alias("seq"), "event_id", F.col("connection_id").cast("string").alias("account"), body.alias("response"))
    out = qualification.consented_reads(reads, grants)
    return out.select("event_id", F.col("connection_id").alias("user_id"), "refusal", F.get_json_object("status", "$.lastattempt.submission.status").cast("double").alias("value"), (F.get_json_object("status", "$.feedback.available") == "true").alias("feedback_available"))
