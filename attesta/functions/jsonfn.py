"""JSON text: paths, merges, containment and a canonical form for comparison."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _canonical(text: str | None) -> str | None:
    if text is None:
        return None
    try:
        return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(T.StringType())
def canonical(text: pd.Series) -> pd.Series:
    """Keys sorted at every depth, no white space; null if it isn't JSON. ``to_json(parse_json(x))`` changes numbers."""
    return text.map(_canonical)


def any_path(text: Column, *paths: str) -> Column:
    """The first of several paths that is there."""
    return F.coalesce(*[F.get_json_object(text, p) for p in paths])


def as_map(text: Column) -> Column:
    return F.from_json(text, "map<string,variant>")


def without_keys(text: Column, *keys: str) -> Column:
    return F.to_json(F.map_filter(as_map(text), lambda k, v: ~k.isin(*keys)))


def merged(old: Column, new: Column) -> Column:
    """Shallow merge of two objects; the right one wins."""
    a, b = as_map(F.coalesce(old, F.lit("{}"))), as_map(F.coalesce(new, F.lit("{}")))
    return F.to_json(F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b))


def has_key(text: Column, key: str) -> Column:
    """Whether the object has the key, be its value null."""
    return F.coalesce(F.array_contains(F.json_object_keys(text), key), F.lit(False))


def contained(inner: Column, outer: Column) -> Column:
    """Every entry of a flat object is in the other."""
    a, b = F.from_json(inner, "map<string,string>"), F.from_json(outer, "map<string,string>")
    return F.forall(F.map_entries(a), lambda e: F.map_contains_key(b, e["key"]) & F.try_element_at(b, e["key"]).eqNullSafe(e["value"]))


def records(text: Column, schema: str) -> Column:
    """A JSON array as typed rows."""
    return F.from_json(text, f"array<struct<{schema}>>")


def forbidden_keys(text: Column, names: Sequence[str] = ("password", "token", "secret", "cookie", "authorization")) -> Column:
    """Whether a key at any depth is one of the names, by the text of the JSON."""
    return text.rlike(r'(?i)"(' + "|".join(names) + r')"\s*:')


def _pointer(text: str | None, pointer: str | None) -> str | None:
    if text is None or pointer is None:
        return None
    try:
        node = json.loads(text)
        for raw in pointer.split("/")[1:]:
            key = raw.replace("~1", "/").replace("~0", "~")
            node = node[int(key)] if isinstance(node, list) and key.isdigit() else node[key]
        return json.dumps(node, separators=(",", ":"), ensure_ascii=False)
    except (ValueError, KeyError, IndexError, TypeError, RecursionError):
        return None


@F.pandas_udf(T.StringType())
def at_pointer(text: pd.Series, pointer: pd.Series) -> pd.Series:
    """The value at a JSON pointer, as JSON; null if it isn't there."""
    return pd.Series([_pointer(t, p) for t, p in zip(text, pointer, strict=True)])


#: Keys that are never kept: fixed values.
SENSITIVE = ("password", "passwd", "token", "wstoken", "privatetoken", "sesskey", "secret", "cookie", "authorization")


def _redacted(node, depth: int = 0):
    if depth > 24:
        return None
    if isinstance(node, dict):
        return {k: _redacted(v, depth + 1) for k, v in node.items() if k.lower() not in SENSITIVE}
    if isinstance(node, list):
        return [_redacted(v, depth + 1) for v in node]
    return re.sub(r"((?:ws)?token|sesskey)=[^&\s\"']+", r"\1=[REDACTED]", node) if isinstance(node, str) else node


def _rewritten(text: str | None, change) -> str | None:
    if text is None:
        return None
    try:
        return json.dumps(change(json.loads(text)), separators=(",", ":"), ensure_ascii=False)
    except (ValueError, RecursionError):
        return None


@F.pandas_udf(T.StringType())
def redacted(text: pd.Series) -> pd.Series:
    """Without sensitive keys at any depth, and with tokens in texts replaced."""
    return text.map(lambda t: _rewritten(t, _redacted))


def _flat(node, name: str, out: list[str]) -> None:
    if isinstance(node, dict):
        for k, v in node.items():
            _flat(v, f"{name}[{k}]" if name else k, out)
    elif isinstance(node, list):
        for i, v in enumerate(node):
            _flat(v, f"{name}[{i}]", out)
    elif node is not None:
        out.append(f"{name}={int(node) if isinstance(node, bool) else node}")


def _params(text: str | None) -> list[str] | None:
    if text is None:
        return None
    out: list[str] = []
    try:
        _flat(json.loads(text), "", out)
    except (ValueError, RecursionError):
        return None
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def flat_params(text: pd.Series) -> pd.Series:
    """Nested parameters as ``a[0][b]=value``, in order; nulls are left out, booleans are 0 and 1."""
    return text.map(_params)


def _module_of(text: str | None, file_id: str | None) -> str | None:
    if text is None or file_id is None:
        return None
    try:
        todo = [(json.loads(text), None)]
    except (ValueError, RecursionError):
        return None
    while todo:
        node, module = todo.pop()
        if isinstance(node, dict):
            module = str(node["id"]) if "modname" in node and "id" in node else module
            if node.get("file_id") == file_id:
                return module
            todo += [(v, module) for v in reversed(list(node.values()))]
        elif isinstance(node, list):
            todo += [(v, module) for v in reversed(node)]
    return None


@F.pandas_udf(T.StringType())
def module_of_file(text: pd.Series, file_id: pd.Series) -> pd.Series:
    """Id of the nearest module around the first object with the ``file_id``."""
    return pd.Series([_module_of(t, f) for t, f in zip(text, file_id, strict=True)])
