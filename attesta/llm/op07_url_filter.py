"""URL filter: rules first, then a cascade of Bloom filters over the corpus's own hosts.

The cascade is exact for every key it was built over. Its first filter holds the listed keys; the
second the unlisted ones that the first lets through; the third the listed ones that the second
lets through, and so on until nothing is let through wrongly. A key's verdict is the parity of the
first filter that misses it. Filters are bitmaps in the plan (each once), so judging a URL is a
projection: no join, no shuffle and no Python. Building reads the distinct hosts only; the list may
be a table, met there by the hosts and the domains above them. A list whose filters would be larger
than ``FILTER_BYTES`` is joined to the pages by host instead, with the same verdicts.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.scratch import discard, stash

#: (action, host, path): fixed values.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Domains whose hosts are listed: fixed values.
LISTED = ("spam-farm.example.org", "cheap-pills.example.com", "casino-win.example.net")
#: A filter of a plan may not be larger than this.
FILTER_BYTES = 16 << 20

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """The longest fitting rule as ``host/path`` and its action; null if none fits. Of equally long ones the first listed wins."""
    name, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, action = F.when(fits, h + p).otherwise(name), F.when(fits, what).otherwise(action)
    return name, action


def _bits(key: Column, level: int, hashes: int, size: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(level), F.lit(i)), F.lit(size)) for i in range(hashes)]


def _has(key: Column, level: int, hashes: int, bitmap: bytes) -> Column:
    """Whether all of the key's bits are set. The bitmap is in the expression once."""
    positions = F.array(*_bits(key, level, hashes, len(bitmap) * 8))

    def held(bit: Column) -> Column:
        byte = F.conv(F.hex(F.substring(F.lit(bytearray(bitmap)), (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
        return byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (bit % 8).cast("int"))) != 0

    return F.forall(positions, held)


class Cascade:
    """``listed(key)`` is exact for all keys of the universe it was built over."""

    def __init__(self, filters: list[tuple[int, bytes]]):
        self.filters = filters

    @classmethod
    def build(cls, universe: DataFrame, filter_bytes: int = FILTER_BYTES) -> Cascade | None:
        """From ``universe(key, listed)``, distinct keys; none if a filter would be too large for a plan."""
        inside, outside = stash(universe.filter("listed").select("key"), "keys"), stash(universe.filter("not listed").select("key"), "keys")
        filters: list[tuple[int, bytes]] = []
        while n := inside.count():
            level = len(filters)
            # The first filter lets through about as many as it holds; the others half of what is left.
            rate = 0.5 if level else min(0.5, max(1e-4, n / max(1, outside.count()) / math.sqrt(2)))
            hashes = max(1, round(-math.log2(rate)))
            size = max(64, -(-int(n * hashes * 1.4427) // 64) * 64)
            if size > filter_bytes * 8:
                discard(inside, outside)
                return None
            bits = inside.select(F.explode(F.array(*_bits(F.col("key"), level, hashes, size))).alias("bit"))
            parts = bits.groupBy(F.expr("bit div 32768").alias("chunk")).agg(F.bitmap_construct_agg(F.col("bit") % 32768).alias("map")).collect()  # size / 8 bytes
            full = bytearray(-(-size // 32768) * 4096)
            for r in parts:
                full[r.chunk * 4096 : (r.chunk + 1) * 4096] = r.map
            bitmap = bytes(full[: size // 8])
            filters.append((hashes, bitmap))
            wrong = stash(outside.filter(_has(F.col("key"), level, hashes, bitmap)), "keys")
            discard(outside)
            inside, outside = wrong, inside
        discard(inside, outside)
        return cls(filters)

    def listed(self, key: Column) -> Column:
        last = len(self.filters)
        verdict = F.lit(last % 2 == 1)
        for level in range(last - 1, -1, -1):
            verdict = F.when(_has(key, level, *self.filters[level]), verdict).otherwise(F.lit(level % 2 == 1))
        return verdict


def _universe(hosts: DataFrame, listed: Sequence[str] | DataFrame) -> DataFrame:
    """``hosts(key)`` with ``listed``: whether the key or a domain above it is in the list."""
    if not isinstance(listed, DataFrame):
        listed = hosts.sparkSession.range(1).select(F.explode(F.array(*[F.lit(n) for n in listed]).cast("array<string>")).alias("host"))
    names = listed.select(F.translate(listed.columns[0], _UPPER, _LOWER).alias("domain")).filter("domain <> ''").distinct().withColumn("listed", F.lit(True))
    labels = F.split("key", "\\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    hit = hosts.select("key", F.explode(above).alias("domain")).join(names, "domain", "left_semi").select("key").distinct()
    return hosts.join(hit.withColumn("listed", F.lit(True)), "key", "left").select("key", F.coalesce("listed", F.lit(False)).alias("listed"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, listed: Sequence[str] | DataFrame = LISTED, id_col: str = "page_id", url_col: str = "url", filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """Per row ``page_id, host, path, rule, verdict``.

    A rule fits its host and all subdomains if the path starts with the rule's; the longest wins
    and decides. Else the cascade does: block for hosts that are a listed domain or below one;
    ``listed`` is a list or a table whose first column has the domains. Null URLs and those without
    ``://`` have empty host and path and are allowed. Repeated rows are each judged; extra columns
    are not read; an empty table gives no rows.
    """
    read = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"))
    parts = read.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    universe = _universe(read.select(host_of(F.col("url")).alias("key")).distinct(), listed)
    cascade = Cascade.build(universe, filter_bytes)
    if cascade is None:
        parts = parts.join(universe.select(F.col("key").alias("host"), F.col("listed").alias("is_listed")), "host", "left")
    rule, action = rule_of(F.col("host"), F.col("path"), rules)
    method = F.when(cascade.listed(F.col("host")) if cascade is not None else F.col("is_listed"), "block").otherwise("allow")
    return parts.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(action, method).alias("verdict"))


def oracle(rules: Sequence[tuple[str, str, str]] = RULES, listed: Sequence[str] = LISTED) -> str:
    """The same rows in DuckDB SQL."""
    fits = lambda h, p: f"((host = '{h}' or host like '%.{h}') and path like '{p}%')"
    order = sorted(rules, key=lambda r: -len(r[1] + r[2]))
    name = " ".join(f"when {fits(h, p)} then '{h}{p}'" for _, h, p in order)
    action = " ".join(f"when {fits(h, p)} then '{a}'" for a, h, p in order)
    below = " or ".join(f"host = '{n}' or host like '%.{n}'" for n in listed)
    return f"""with parts as (
  select page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path
  from pages)
select page_id, host, path, case {name} end as rule,
  case {action} when {below} then 'block' else 'allow' end as verdict
from parts"""
