"""Content-addressed storage: one blob for equal bytes of an owner, and the accounting around it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def blobs_of(files: DataFrame, owner: Sequence[str], content: str) -> DataFrame:
    """One row per owner and digest, with its size and how many files refer to it."""
    digest = F.sha2(F.col(content), 256)
    return files.filter(F.col(content).isNotNull()).withColumn("sha256", digest).groupBy(*owner, "sha256").agg(F.first(F.octet_length(content)).cast("long").alias("bytes"), F.count("*").alias("refs"))


def dedup_savings(files: DataFrame, owner: Sequence[str], content: str) -> DataFrame:
    """Per owner: bytes referred to, bytes stored, and what sharing saves."""
    blobs = blobs_of(files, owner, content)
    out = blobs.groupBy(*owner).agg(F.sum("refs").alias("files"), F.count("*").alias("blobs"), F.sum(F.col("bytes") * F.col("refs")).alias("preserved_bytes"), F.sum("bytes").alias("stored_bytes"))
    return out.withColumn("saved_bytes", F.greatest(F.col("preserved_bytes") - F.col("stored_bytes"), F.lit(0)))


def unreferenced(blobs: DataFrame, files: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Blobs that no file refers to."""
    return blobs.join(files.select(*keys), list(keys), "left_anti")


def contents(files: DataFrame, blobs: DataFrame) -> DataFrame:
    """Files with their bytes, inline or from the blob."""
    b = blobs.select("owner_id", F.col("sha256").alias("blob_sha256"), F.col("content").alias("_blob"))
    return files.join(b, ["owner_id", "blob_sha256"], "left").withColumn("binary_content", F.coalesce("inline_content", "_blob")).drop("_blob", "inline_content")


def compacted(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(files, blobs)``: inline bytes that match their recorded digest and length move to blobs, others stay."""
    good = F.col("inline_content").isNotNull() & (F.sha2("inline_content", 256) == F.col("sha256")) & (F.octet_length("inline_content") == F.col("bytes"))
    blobs = files.filter(good).groupBy("owner_id", "sha256").agg(F.first("bytes").alias("bytes"), F.first("inline_content").alias("content"))
    moved = files.withColumns({"blob_sha256": F.when(good, F.col("sha256")).otherwise(F.col("blob_sha256")), "inline_content": F.when(~F.coalesce(good, F.lit(False)), F.col("inline_content"))})
    return moved, blobs


def fingerprint(df: DataFrame, columns: Sequence[Column]) -> DataFrame:
    """Row count and an order-free digest: MD5 of the sorted MD5s of the rows.

    For tables of checkable size; the digests of all rows meet in one value. ``fingerprint_sum``
    is the form for large ones.
    """
    row = F.md5(F.concat_ws("|", *columns))
    return df.agg(F.count("*").alias("row_count"), F.md5(F.array_join(F.sort_array(F.collect_list(row)), "")).alias("fingerprint"))


def fingerprint_sum(df: DataFrame, columns: Sequence[Column]) -> DataFrame:
    """Row count and the sum of row hashes: partial sums per task, any size."""
    return df.agg(F.count("*").alias("row_count"), F.sum(F.xxhash64(*columns).cast("decimal(20,0)")).alias("fingerprint"))


def slice_bytes(content: Column, first: Column | int, length: Column | int) -> Column:
    return F.substring(content, F.lit(first) + 1 if isinstance(first, int) else (first + 1).cast("int"), F.lit(length) if isinstance(length, int) else length.cast("int"))


def reassembled(parts: DataFrame, key: str, order: str, content: str, sha256: str) -> DataFrame:
    """Values from their parts in order; ``intact`` if the digest is the recorded one. One value's parts meet in one row."""
    whole = F.expr(f"aggregate(transform(sort_array(collect_list(struct({order}, {content}))), x -> x.{content}), cast('' as binary), (a, x) -> concat(a, x))")
    return parts.groupBy(key).agg(whole.alias("content"), F.first(sha256).alias(sha256)).withColumn("intact", F.sha2("content", 256) == F.col(sha256))


def usage(counts: dict[str, DataFrame]) -> DataFrame:
    """One row of counts: each a scan of its own that reads no column."""
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in counts.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out.groupBy().pivot("name", list(counts)).agg(F.first("n"))
