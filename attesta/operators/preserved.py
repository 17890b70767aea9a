"""Reading parts of preserved JSON: by pointer, in pages that fit a number of bytes, and normalised for keeping.

Values are cut in columns: the size of every child of a page is summed up as it would be written, and
the page ends before the sum passes the budget. What is cut is said: the cursor goes on where the
page ends, and a value too large to be shown at all lists its children, to go deeper.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a part, children and characters of a page, the most of each, children listed at once: fixed values.
PART_BYTES = 128 * 1024
CHILDREN, MOST_CHILDREN = 20, 100
CHARACTERS, MOST_CHARACTERS = 8000, 16000
LISTED = 100
MOST_POINTER = 2000

_FOUND = "kind string, length long, children array<string>, names array<string>, text string, refusal string"


def _dumped(value) -> str:
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def _at(text: str | None, pointer: str, offset: int, most: int, envelopes: Mapping[str, str]) -> dict:
    """The value at ``pointer``: an array's children from ``offset`` on, ``most`` at most, an object's names, a text or another value as JSON."""
    try:
        value = json.loads(text or "")
    except (ValueError, RecursionError):
        return {"refusal": "invalid_material"}
    if isinstance(value, dict) and isinstance(value.get("format"), str) and envelopes.get(value["format"]) in value:
        value = value[envelopes[value["format"]]]
    for raw in pointer.split("/")[1:]:
        key = raw.replace("~1", "/").replace("~0", "~")
        if isinstance(value, list):
            if not re.fullmatch("0|[1-9][0-9]*", key, re.ASCII):
                return {"refusal": "invalid_locator"}
            if int(key) >= len(value):
                return {"refusal": "not_found"}
            value = value[int(key)]
        elif isinstance(value, dict) and key in value:
            value = value[key]
        else:
            return {"refusal": "not_found"}
    if isinstance(value, list):
        return {"kind": "array", "length": len(value), "children": [_dumped(x) for x in value[offset : offset + most]]}
    if isinstance(value, dict):
        return {"kind": "object", "names": list(value), "text": _dumped(value)}
    return {"kind": "text", "text": value} if isinstance(value, str) else {"kind": "value", "text": _dumped(value)}


def _located(envelopes: Mapping[str, str]):
    known = dict(envelopes)

    @F.pandas_udf(_FOUND)
    def run(text: pd.Series, pointer: pd.Series, offset: pd.Series, most: pd.Series) -> pd.DataFrame:
        rows = [_at(t, p, int(o), int(m), known) for t, p, o, m in zip(text, pointer, offset, most, strict=True)]
        of = lambda name, kind="object": pd.Series([r.get(name) for r in rows], dtype=kind)
        return pd.DataFrame({"kind": of("kind"), "length": of("length", "Int64"), "children": of("children"), "names": of("names"), "text": of("text"), "refusal": of("refusal")})

    return run


def fitting(children: Column, budget: int = PART_BYTES) -> Column:
    """How many of the leading ``children`` (JSON texts) an array of at most ``budget`` bytes holds; one at least, if there is one."""
    step = lambda a, x: F.struct((a["size"] + F.octet_length(x) + 1).alias("size"), F.when(a["size"] + F.octet_length(x) + 1 <= budget, a["n"] + 1).otherwise(a["n"]).alias("n"))
    # Brackets and commas: one byte before each child and one at the end.
    n = F.aggregate(children, F.struct(F.lit(1).cast("long").alias("size"), F.lit(0).alias("n")), step)["n"]
    return F.least(F.greatest(n, F.lit(1)), F.size(children))


def _units(text: Column, first: Column, n: Column) -> Column:
    """``n`` UTF-16 units of ``text`` from the unit ``first`` on, as bytes."""
    return F.substring(F.encode(text, "UTF-16BE"), (2 * first + 1).cast("int"), (2 * n).cast("int"))


def _half(text: Column, at: Column, low: bool) -> Column:
    """Whether the UTF-16 unit at ``at`` is the second (or first) half of a pair."""
    byte = F.conv(F.hex(F.substring(F.encode(text, "UTF-16BE"), (2 * at + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.coalesce(byte.between(0xDC, 0xDF) if low else byte.between(0xD8, 0xDB), F.lit(False))


def read_parts(requests: DataFrame, materials: DataFrame, envelopes: Mapping[str, str] | None = None, budget: int = PART_BYTES) -> DataFrame:
    """``requests`` with a part of the material each asks for.

    ``requests(file_id, sha256, pointer, offset, limit, children_offset)``, others' columns stay;
    ``materials(file_id, sha256, content)``, content being JSON text. ``envelopes`` names, by format, the
    field in which a wrapped value lies. Adds ``refusal`` (``not_found``, ``file_changed``,
    ``invalid_locator``, ``invalid_material`` or ``invalid_offset``, else null), ``result`` (JSON; null if the
    part exceeds the budget), ``next_offset``, ``coverage``, ``children`` (names or places one level down,
    where the part is too large), ``children_next_offset`` and ``children_count``.

    Arrays go in children, texts in UTF-16 units, never between two halves of a character; other values
    have no offset. A null limit is the usual one. Each request is one row, whatever it asks for.
    """
    own = requests.columns
    held = materials.select("file_id", F.col("sha256").alias("_sha"), F.col("content").alias("_content"))
    rows = requests.join(held, "file_id", "left")
    pointer, offset = F.coalesce("pointer", F.lit("")), F.coalesce("offset", F.lit(0))
    listed_from = F.coalesce("children_offset", F.lit(0))
    bad = (F.length(pointer) > MOST_POINTER) | ((pointer != "") & ~pointer.startswith("/")) | pointer.rlike("~(?![01])") | (offset < 0) | (listed_from < 0) | F.coalesce(~F.col("limit").between(1, MOST_CHARACTERS), F.lit(False))
    early = F.when(bad, "invalid_locator").when(F.col("_sha").isNull(), "not_found").when(F.col("_sha") != F.col("sha256"), "file_changed")
    rows = rows.withColumns({"_early": early, "_offset": offset, "_from": listed_from})
    most = F.least(F.coalesce("limit", F.lit(CHILDREN)), F.lit(MOST_CHILDREN))
    found = _located(envelopes or {})(F.when(F.col("_early").isNull(), F.col("_content")), F.when(F.col("_early").isNull(), pointer).otherwise(""), F.greatest("_offset", F.lit(0)), most)
    rows = rows.withColumn("_f", found)
    kind, text = F.col("_f.kind"), F.col("_f.text")
    length = F.when(kind == "array", F.col("_f.length")).when(kind == "text", F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")
    split_pair = (F.col("_offset") > 0) & _half(text, F.col("_offset"), True) & _half(text, F.col("_offset") - 1, False)
    late = F.when(kind.isin("object", "value") & (F.col("_offset") != 0) | F.coalesce(F.col("_offset") > length, F.lit(False)) | (kind == "text") & split_pair, "invalid_offset")
    rows = rows.withColumns({"_length": length, "refusal": F.coalesce("_early", "_f.refusal", late)})
    stop = F.least(F.col("_length"), F.col("_offset") + F.coalesce("limit", F.lit(CHARACTERS)))
    stop = F.when((stop < F.col("_length")) & _half(text, stop - 1, False), stop + 1).otherwise(stop)
    rows = rows.withColumn("_end", F.when(kind == "array", F.col("_offset") + fitting(F.col("_f.children"), budget)).when(kind == "text", stop))
    shown = F.slice("_f.children", F.lit(1), (F.col("_end") - F.col("_offset")).cast("int"))
    piece = F.decode(_units(text, F.col("_offset"), F.col("_end") - F.col("_offset")), "UTF-16BE")
    quoted = F.to_json(F.array(piece))
    result = F.when(kind == "array", F.concat(F.lit("["), F.array_join(shown, ","), F.lit("]"))).when(kind == "text", F.substring(quoted, 2, F.length(quoted) - 2)).otherwise(text)
    ok = F.col("refusal").isNull()
    rows = rows.withColumn("_result", F.when(ok, result))
    large = F.coalesce(F.octet_length("_result") > budget, F.lit(False))
    places = F.transform(F.sequence(F.lit(0), F.size(shown) - 1), lambda i: (F.col("_offset") + i).cast("string"))
    names = F.when(large & (kind == "object"), F.col("_f.names")).when(large & (kind == "array"), places).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumns({"_large": large, "_names": names})
    beyond = ok & (F.col("_from") > F.size("_names"))
    rows = rows.withColumn("refusal", F.when(beyond, "invalid_offset").otherwise(F.col("refusal")))
    ok = F.col("refusal").isNull()
    more = F.when(F.col("_end") < F.col("_length"), F.col("_end")).cast("long")
    part = F.slice("_names", (F.col("_from") + 1).cast("int"), F.lit(LISTED))
    until = F.col("_from") + F.size(part)
    return rows.select(
        *own, "refusal", F.when(ok & ~F.col("_large"), F.col("_result")).alias("result"), F.when(ok & ~F.col("_large"), more).alias("next_offset"),
        F.when(ok, F.when(F.col("_large") | more.isNotNull(), "partial").otherwise("complete")).alias("coverage"), F.when(ok, part).alias("children"),
        F.when(ok & (until < F.size("_names")), until).cast("long").alias("children_next_offset"), F.when(ok, F.size("_names")).cast("long").alias("children_count"),
    )


# Normalisation

#: Names whose values are secrets, names that are not kept, and names whose texts are HTML: fixed values.
SECRET_NAMES = ("token", "wstoken", "privatetoken", "sesskey", "password", "authorization", "authtoken", "access_token", "refresh_token", "id_token", "client_secret")
DROPPED_NAMES = (*SECRET_NAMES, "onclick", "userpictureurl", "userpictureurlsmall", "useremail", "email")
HTML_NAMES = ("summary", "intro", "content", "message", "feedback", "description", "questiontext", "definition")
#: Characters of sanitised markup and of its text: fixed values.
MARKUP_CHARACTERS, TEXT_CHARACTERS = 1_000_000, 100_000
#: What a text may hide, by patterns that markup is cleaned with, in this order: fixed values.
_CREDENTIAL = (re.compile(r"([?&]?(?:wstoken|token|privatetoken|sesskey|password|access_token|refresh_token)=)[^&\s\"'<>]+", re.I), re.compile(r"Bearer\s+[^\s\"'<>]+", re.I))
_UNSAFE = (
    (re.compile(r"<!--[\s\S]*?-->"), ""),
    (re.compile(r"<(script|style)\b[^>]*>[\s\S]*?</\1\s*>", re.I), ""),
    (re.compile(r"<(iframe|object|embed|form)\b[^>]*>[\s\S]*?</\1\s*>", re.I), ""),
    (re.compile(r"<(iframe|object|embed|form|link|meta|base)\b[^>]*/?>", re.I), ""),
    (re.compile(r"\son[a-z]+\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I), ""),
    (re.compile(r"(href|src)\s*=\s*(?:\"|')?\s*javascript:[^\"'\s>]*", re.I), r'\1="#"'),
)

_STRING = T.StringType()
_TWIN = T.StructType([T.StructField("path", _STRING), T.StructField("text", _STRING)])
_FILE = T.StructType([T.StructField("path", _STRING), T.StructField("name", _STRING), T.StructField("url", _STRING), T.StructField("size", T.LongType()), T.StructField("kind", _STRING)])
_NORMAL = T.StructType([T.StructField("tree", _STRING), T.StructField("twins", T.ArrayType(_TWIN)), T.StructField("files", T.ArrayType(_FILE))])


def _told(text: str) -> str:
    """Without credentials."""
    return _CREDENTIAL[1].sub("Bearer [REDACTED]", _CREDENTIAL[0].sub(r"\1[REDACTED]", text))


def clean_markup(raw: str) -> tuple[str, str]:
    """Markup without what acts or loads, and its text."""
    markup = raw[: 2 * MARKUP_CHARACTERS]
    for pattern, by in _UNSAFE:
        markup = pattern.sub(by, markup)
    markup = markup[:MARKUP_CHARACTERS]
    text = re.sub(r"&nbsp;", " ", re.sub(r"<[^>]+>", " ", markup), flags=re.I)
    return markup, re.sub(r"\s+", " ", text).strip()[:TEXT_CHARACTERS]


def _reference(url: str) -> str | None:
    """An address that may be kept: http or https, without a user."""
    m = re.fullmatch(r"(https?)://([^/?#@\s]+)([/?#]\S*)?", url.strip(), re.I)
    return f"{m[1].lower()}://{m[2].lower()}{m[3] or '/'}" if m else None


def _normal(text: str | None) -> dict:
    try:
        root = json.loads(text or "")
    except (ValueError, RecursionError):
        return {}
    twins: list[dict] = []
    files: list[dict] = []

    def walk(value, path: str):
        if isinstance(value, str):
            return _told(value)
        if isinstance(value, list):
            return [walk(x, f"{path}[{i}]") for i, x in enumerate(value)]
        if not isinstance(value, dict):
            return value
        url, name, size = value.get("fileurl"), value.get("filename"), value.get("filesize")
        attached = isinstance(value.get("url"), str) and isinstance(name, str) and isinstance(size, (int, float, str)) and not isinstance(size, bool)
        out: dict = {}
        for key, item in value.items():
            if key == "fileurl" or key == "url" and attached or key.lower() in DROPPED_NAMES:
                continue
            if isinstance(item, str) and key.lower() in HTML_NAMES:
                markup, plain = clean_markup(item)
                out[key], out[f"{key}_text"] = _told(markup), _told(plain)
                twins.append({"path": f"{path}.{key}", "text": out[f"{key}_text"]})
            else:
                out[key] = walk(item, f"{path}.{key}")
        known = {"path": path, "name": name if isinstance(name, str) else None, "size": int(size) if isinstance(size, (int, float)) and not isinstance(size, bool) else None}
        if isinstance(url, str) and value.get("type") == "url":
            # A reference is not a file of the source: it is never asked for with credentials.
            if to := _reference(url):
                out["external_url"], out["reference_only"] = _told(to), True
                files.append(known | {"url": _told(to), "kind": "reference"})
            else:
                out["reference_error"] = "unsafe_url"
                files.append(known | {"kind": "unsafe"})
        elif isinstance(url, str) and value.get("type") != "content" or attached:
            where = re.sub(r"[?#].*", "", url if isinstance(url, str) and value.get("type") != "content" else value["url"])
            out["file"] = {"name": known["name"], "url": where, "size": known["size"]}
            files.append(known | {"url": where, "kind": "file"})
        return out

    try:
        return {"tree": _dumped(walk(root, "$")), "twins": twins, "files": files}
    except RecursionError:
        return {}


@F.pandas_udf(_NORMAL)
def normalised(text: pd.Series) -> pd.DataFrame:
    """A JSON value as it may be kept: ``tree``, with what was found on the way.

    Secrets and actions go, HTML stays sanitised with its text as a twin ``<name>_text`` beside it, and an
    object that describes a file or a reference says so (``file``, ``external_url``) without its
    credentials. ``twins`` and ``files`` list both with their paths. Text that is no JSON, or is nested
    beyond what a task can follow, gives nulls.
    """
    rows = [_normal(t) for t in text]
    return pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype="object") for c in ("tree", "twins", "files")})


def files_of(rows: DataFrame, keys: list[str], column: str = "normal") -> DataFrame:
    """The table of files: a row for each object of a normalised value that is one."""
    return rows.select(*keys, F.explode(f"{column}.files").alias("f")).select(*keys, "f.*")
