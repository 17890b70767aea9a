"""Pages with a sentinel row, keyset cursors, and slices of long text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE = 20


def offset_page(df: DataFrame, order: Sequence[Column | str], offset: int = 0, size: int = PAGE) -> DataFrame:
    """``size`` rows from ``offset``, each with ``next_offset``: null on the last page. One row more is read to know."""
    page = df.orderBy(*order).offset(offset).limit(size + 1)
    nth = F.row_number().over(_page_window(order))
    numbered = page.withColumns({"_n": nth, "_all": F.count("*").over(_whole())})
    return numbered.filter(F.col("_n") <= size).withColumn("next_offset", F.when(F.col("_all") > size, F.lit(offset + size))).drop("_n", "_all")


def _page_window(order):
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0)).orderBy(*order)  # of a page: size + 1 rows


def _whole():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))


def keyset_desc(df: DataFrame, at: str, id_: str, cursor: tuple | None = None, size: int = PAGE) -> DataFrame:
    """The newest rows strictly before ``cursor`` (time, id), newest first. The comparison of times reaches the scan."""
    if cursor is not None:
        when, last = F.lit(cursor[0]).cast(df.schema[at].dataType), F.lit(cursor[1])
        df = df.filter((F.col(at) <= when) & (F.struct(F.col(at), F.col(id_)) < F.struct(when.alias(at), last.alias(id_))))
    return df.orderBy(F.desc(at), F.desc(id_)).limit(size)


def keyset_asc(df: DataFrame, id_: str, after=None, size: int = PAGE) -> DataFrame:
    return (df if after is None else df.filter(F.col(id_) > after)).orderBy(id_).limit(size)


def cursor_text(at: Column) -> Column:
    """A time as cursor text with microseconds, in UTC sessions."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def text_chunk(text: Column, offset: int, size: int) -> Column:
    """``(chunk, length, next_offset)`` in code points."""
    total = F.char_length(text)
    return F.struct(F.substring(text, offset + 1, size).alias("chunk"), total.alias("length"), F.when(total > offset + size, F.lit(offset + size)).alias("next_offset"))


def text_chunks(df: DataFrame, text: str, size: int) -> DataFrame:
    """All chunks of every text, in rows: ``chunk_no`` from 0; they join to the text again."""
    n = F.greatest(F.lit(1), F.ceil(F.char_length(text) / size)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col(text), i * size + 1, F.lit(size)))
    return df.select(*[c for c in df.columns if c != text], F.posexplode(parts).alias("chunk_no", "chunk"))


def blocks_page(df: DataFrame, blocks: str, offset: int, size: int, most: int = 32000) -> DataFrame:
    """Blocks from ``offset``, in rows; one whose JSON is longer than ``most`` is a pointer to itself."""
    out = df.select("*", F.posexplode(blocks).alias("_p", "_b")).filter((F.col("_p") >= offset) & (F.col("_p") < offset + size))
    as_json = F.to_json(F.struct(F.col("_b").alias("b")))
    return out.withColumns({"ordinal": F.col("_p") + 1, "stub": F.length(as_json) > most, "block": F.when(F.length(as_json) <= most, F.col("_b"))}).drop("_p", "_b", blocks)


def bounded_history(df: DataFrame, order: Sequence[Column | str], most: int = 200) -> tuple[DataFrame, bool]:
    """At most ``most`` rows, and whether that is all; an incomplete history must not be answered from."""
    page = df.orderBy(*order).limit(most + 1)
    return page.limit(most), page.count() <= most


def bounded_count(df: DataFrame, most: int = 2) -> int:
    """Rows counted up to ``most``: none, one or more."""
    return df.limit(most).count()


def byte_parts(size: Column, part: int) -> Column:
    """Ranges ``(first, length)`` of a value of ``size`` bytes."""
    n = F.greatest(F.lit(1), F.ceil(size / part)).cast("long")
    return F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.struct((i * part).alias("first"), F.least(F.lit(part), size - i * part).alias("length")))
