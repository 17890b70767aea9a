"""Digests, stable ids and content addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha256(value: Column) -> Column:
    return F.sha2(value, 256)


def git_blob_id(content: Column) -> Column:
    """SHA-1 of ``blob <length>``, a zero byte and the bytes."""
    return F.sha1(F.concat(F.concat(F.lit("blob "), F.octet_length(content).cast("string")).cast("binary"), F.unhex(F.lit("00")), content.cast("binary")))


def stable_uuid(*parts: Column) -> Column:
    """A UUID from the SHA-256 of the parts, with version and variant bits of a name-based one."""
    h = F.sha2(F.concat_ws("\u001f", *parts), 256)
    variant = F.substring(F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1), F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def cas_path(digest: Column) -> Column:
    return F.concat(F.lit("cas/"), F.substring(digest, 1, 2), F.lit("/"), digest)


def batch_id(commit: Column, lines: Column) -> Column:
    """32 hex digits over a commit and the sorted lines of a tree."""
    return F.substring(F.sha2(F.concat_ws("\n", commit, F.array_join(F.sort_array(lines), "\n")), 256), 1, 32)


def logical_write_bytes(json: Column) -> Column:
    return 4096 + 4 * F.octet_length(json)
