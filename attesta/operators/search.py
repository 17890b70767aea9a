"""Search over text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def contains(text: Column, query: str) -> Column:
    """Case-insensitive containment; ``%`` and ``_`` of the query are wildcards."""
    return text.ilike(f"%{query}%")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, without stemming or stop words."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), 1))


def has_all(text: Column, query: str) -> Column:
    """All tokens of the query are tokens of the text; a query without tokens matches nothing."""
    import re

    wanted = sorted(set(re.findall(r"[^\W_]+", query.lower())))
    if not wanted:
        return F.lit(False)
    own = tokens(text)
    return F.forall(F.array(*[F.lit(w) for w in wanted]), lambda w: F.array_contains(own, w))


def excerpt(text: Column, query: str, before: int = 120, size: int = 800) -> Column:
    """``size`` characters from a little before the first place of the query."""
    at = F.greatest(F.instr(F.lower(text), F.lit(query.lower()).cast("string")) - before, F.lit(1))
    return F.substring(text, at, F.lit(size))


def search_documents(df: DataFrame, id_col: str, text_col: str, query: str) -> DataFrame:
    text = F.col(text_col)
    return df.filter(contains(text, query)).select(id_col, excerpt(text, query).alias("excerpt"), F.char_length(text).alias("length"))


def search_either(df: DataFrame, text_col: str, query: str) -> DataFrame:
    """Rows that have all tokens of the query or contain it as it stands."""
    return df.filter(has_all(F.col(text_col), query) | contains(F.col(text_col), query))
