"""Addresses."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _public(text: str | None) -> bool | None:
    if text is None:
        return None
    try:
        ip = ipaddress.ip_address(text.strip().strip("[]"))
    except ValueError:
        return False
    ip = getattr(ip, "ipv4_mapped", None) or ip
    return ip.is_global and not ip.is_multicast


@F.pandas_udf(T.BooleanType())
def is_public_ip(address: pd.Series) -> pd.Series:
    """Whether an IPv4 or IPv6 address is routed publicly; what isn't an address isn't."""
    return address.map(_public)


#: Names of query parameters that are secrets: fixed values.
SECRET_PARAMETERS = ("token", "wstoken", "privatetoken", "sesskey", "password", "authorization", "authtoken", "access_token", "refresh_token", "id_token", "client_secret")


def _flat_path(path: Column) -> Column:
    """Without ``.`` and ``..`` segments; none leads above the root."""
    parts = F.split(F.substring(path, F.lit(2), F.length(path)), "/")
    step = lambda a, x: F.when(x == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).when(x == ".", a).otherwise(F.concat(a, F.array(x)))
    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    # A path that ends in a dot segment names a folder.
    ends = F.element_at(parts, -1).isin(".", "..") & (F.size(kept) > 0)
    return F.concat(F.lit("/"), F.array_join(kept, "/"), F.when(ends, "/").otherwise(""))


def resolved(href: Column, base: Column) -> Column:
    """An address as a page at ``base`` means it: http or https, without a user and without secret parameters; else null.

    Relative, rooted, scheme-less, query-only and fragment-only references are resolved against the
    base, dot segments are taken out, scheme and host are in lower case, a port that is the scheme's
    own goes.
    """
    href = F.regexp_replace(href, r"^[\s\x00-\x1f]+|[\s\x00-\x1f]+$", "")
    scheme, host = F.lower(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)), F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    origin = F.concat(scheme, F.lit("://"), host)
    path = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)
    path = F.when(path == "", "/").otherwise(path)
    query = F.regexp_extract(base, r"^[^?#]*(\?[^#]*)", 1)
    whole = (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(origin, href))
        .when(href.startswith("?"), F.concat(origin, path, href))
        .when((href == "") | href.startswith("#"), F.concat(origin, path, query, href))
        .otherwise(F.concat(origin, F.regexp_replace(path, r"[^/]*$", ""), href))
    )
    kind = F.lower(F.regexp_extract(whole, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    authority = F.lower(F.regexp_extract(whole, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    authority = F.regexp_replace(authority, F.when(kind == "http", ":80$").otherwise(":443$"), "")
    way = F.regexp_extract(whole, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)
    asked = F.split(F.regexp_extract(whole, r"^[^?#]*\?([^#]*)", 1), "&")
    open_ = F.filter(asked, lambda p: ~F.lower(F.regexp_extract(p, "^([^=]*)", 1)).isin(*SECRET_PARAMETERS) & (p != ""))
    rest = F.concat(F.when(F.size(open_) > 0, F.concat(F.lit("?"), F.array_join(open_, "&"))).otherwise(""), F.regexp_extract(whole, "(#.*)$", 1))
    fine = kind.isin("http", "https") & (authority != "") & ~authority.contains("@") & ~whole.rlike(r"\s")
    return F.when(fine, F.concat(kind, F.lit("://"), authority, F.when(way == "", "/").otherwise(_flat_path(way)), rest))
