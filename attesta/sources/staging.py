"""Staged trees of files: inventory, verification and redacted export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.functions import hashing, text


def inventory(files: DataFrame, root: str) -> DataFrame:
    """``binaryFile`` rows as an inventory: path, size, digests, address, encoding, line ends, lines, links."""
    path = F.regexp_replace("path", f"^.*{root.strip('/')}/", "")
    is_text = F.is_valid_utf8(F.col("content").cast("string")) & ~F.contains(F.hex("content"), F.lit("\x00"))
    body = F.when(is_text, F.col("content").cast("string"))
    return files.select(path.alias("path"), F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"), hashing.git_blob_id(F.col("content")).alias("git_blob"), F.when(is_text, "utf-8").otherwise("binary").alias("encoding"), text.line_ends(body).alias("eol"), text.line_count(body).alias("lines"), text.links(body).alias("links"), "content").withColumn("cas_path", hashing.cas_path(F.col("sha256")))


def totals(inv: DataFrame) -> DataFrame:
    return inv.groupBy("encoding").agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.sum("lines").alias("lines"), F.sum(F.size("links")).alias("links"))


def verify(manifest: DataFrame, stored: DataFrame) -> DataFrame:
    """Each path of the manifest or the store with its finding: ok, missing, corrupted, blob_mismatch or extra."""
    m = manifest.select("path", F.col("sha256").alias("want"), F.col("git_blob").alias("want_blob"))
    s = stored.select("path", F.col("sha256").alias("have"), F.col("git_blob").alias("have_blob"))
    finding = F.when(F.col("have").isNull(), "missing").when(F.col("want").isNull(), "extra").when(F.col("want") != F.col("have"), "corrupted").when(~F.col("want_blob").eqNullSafe(F.col("have_blob")), "blob_mismatch").otherwise("ok")
    return m.join(s, "path", "full_outer").select("path", finding.alias("finding"))


def dangling(relations: DataFrame, known: DataFrame) -> DataFrame:
    """Relations of which an end is unknown."""
    ids = known.select(F.col("id"))
    return relations.join(ids, relations.from_id == ids.id, "left_anti").unionByName(relations.join(ids, relations.from_id == ids.id, "left_semi").join(ids, relations.to_id == ids.id, "left_anti"))


def export(inv: DataFrame) -> DataFrame:
    """Without paths that hold secrets; texts redacted and hashed again."""
    out = inv.filter(~text.is_secret_path(F.col("path")) & text.is_safe_relative(F.col("path")))
    body = F.when(F.col("encoding") == "utf-8", text.redacted(F.col("content").cast("string")).cast("binary")).otherwise(F.col("content"))
    return out.withColumn("content", body).withColumn("sha256", F.sha2("content", 256)).withColumn("cas_path", hashing.cas_path(F.col("sha256")))


def import_refusals(occurrences: DataFrame, extractions: DataFrame) -> DataFrame:
    """Each occurrence with its extraction or the reason why it isn't taken; no row stops the others."""
    known = extractions.select("sha256", "coverage", "text")
    joined = occurrences.join(known, "sha256", "left")
    refusal = F.when(F.col("sha256").isNull(), "no_digest").when(F.col("coverage").isNull(), "no_extraction").when(F.col("coverage") == "parsing_error", "unreadable")
    return joined.withColumn("refusal", refusal)


def new_blobs(inv: DataFrame, store: DataFrame) -> DataFrame:
    """Blobs of an inventory that the store lacks, or holds with bytes that don't match their digest; each once."""
    sound = store.filter(F.sha2("content", 256) == F.col("sha256")).select("sha256")
    return inv.join(sound, "sha256", "left_anti").groupBy("sha256").agg(F.first("cas_path").alias("cas_path"), F.first("content").alias("content"))


def staged(inv: DataFrame, store: DataFrame) -> DataFrame:
    """The store after staging: repeated runs change nothing, damaged blobs are replaced."""
    new = new_blobs(inv, store)
    return store.select("sha256", "cas_path", "content").join(new.select("sha256"), "sha256", "left_anti").unionByName(new)


def restored(manifest: DataFrame, store: DataFrame, batch: str) -> DataFrame:
    """The manifest's files with their bytes, after all have been verified; another batch or a finding refuses them all."""
    if manifest.filter(~F.col("batch_id").eqNullSafe(F.lit(batch))).limit(1).count():
        raise ValueError("the manifest is of another batch")
    joined = manifest.join(store.select("sha256", "content"), "sha256", "left")
    bad = joined.filter(F.col("content").isNull() | (F.sha2("content", 256) != F.col("sha256"))).select("path").limit(5).collect()
    if bad:
        raise ValueError("not restorable: " + ", ".join(r.path for r in bad))
    return joined


def imported(manifest: DataFrame, curation: DataFrame, owner: str, connection: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(entities, occurrences, relations)`` of a staged batch: documents, curated records and what they derive from.

    ``curation(record_id, kind, text, refs array<string>)`` names paths of the manifest; unknown
    ones give no relation. Ids follow from the batch, so importing again changes nothing.
    """
    own = [F.lit(owner), F.lit(connection)]
    docs = manifest.select(F.lit(owner).alias("owner_id"), hashing.stable_uuid(*own, F.lit("document"), F.col("path")).alias("id"), F.lit(connection).alias("connection_id"), F.lit("document").alias("kind"), F.col("path").alias("external_id"), text.last_segment(F.col("path")).alias("title"), F.to_json(F.struct("path", "sha256")).alias("state"))
    made = curation.select(F.lit(owner).alias("owner_id"), hashing.stable_uuid(*own, F.lit("record"), F.col("record_id")).alias("id"), F.lit(connection).alias("connection_id"), F.col("kind"), F.col("record_id").alias("external_id"), text.title_of(F.col("text")).alias("title"), F.to_json(F.struct("text")).alias("state"))
    entities = docs.unionByName(made)
    occurrences = entities.select("owner_id", F.col("id").alias("entity_id"), F.sha2("state", 256).alias("content_hash"), F.col("state").alias("content"))
    refs = curation.select(hashing.stable_uuid(*own, F.lit("record"), F.col("record_id")).alias("from_id"), F.explode("refs").alias("external_id"))
    relations = refs.join(docs.select("external_id", F.col("id").alias("to_id")), "external_id").select(F.lit(owner).alias("owner_id"), "from_id", "to_id", F.lit("derived_from").alias("kind")).distinct()
    return entities, occurrences, relations
