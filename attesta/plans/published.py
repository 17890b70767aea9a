"""Queries over writes that are seen at once: fenced batches, exports with their manifest, restores."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from attesta.operators import publish
from attesta.plans.queries import query

#: Tables whose columns are whole numbers and texts, so that another engine can compute their digests.
EXPORTED = ("region", "nation", "documents", "pages", "benchmark", "labels", "conversations")
#: The twelve tables of a full export.
WHOLE = (*EXPORTED, "customer", "supplier", "part", "orders", "events")


def _folder(spark: SparkSession) -> str:
    """A new folder where the cluster shares files; a temporary one in local sessions without such a place."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="attesta-")
    return f"{shared.rstrip('/')}/published-{uuid.uuid4().hex}"


_ROW = {
    "region": ["r_regionkey", "r_name"], "nation": ["n_nationkey", "n_name", "n_regionkey"], "documents": ["doc_id", "text", "lang", "source", "n_chars"], "pages": ["page_id", "url", "html"],
    "benchmark": ["item_id", "text"], "labels": ["doc_id", "quality", "toxic"], "conversations": ["conv_id", "turn", "role", "text"],
}


def _digest_sql(table: str) -> str:
    text = " || chr(31) || ".join(f"coalesce('=' || {c}::varchar, '-')" for c in _ROW[table])
    return f"select '{table}' as \"table\", count(*) as rows, coalesce(sum(('0x' || substr(md5({text}), 1, 12))::bigint), 0)::varchar as digest, true as same from {table}"


@query(" union all ".join(map(_digest_sql, EXPORTED)))
def exported_tables(t):
    """Tables written once with a manifest measured on the way; the rows are those of a second reading, which agrees."""
    to = _folder(t.spark)
    publish.export_tables({n: getattr(t, n) for n in EXPORTED}, to)
    return publish.verified(t.spark, to)


@query(" union all ".join(f"select '{n}' as \"table\", count(*) as rows, true as same from {n}" for n in WHOLE))
def whole_export(t):
    """All twelve tables, whatever their columns hold."""
    to = _folder(t.spark)
    publish.export_tables({n: getattr(t, n) for n in WHOLE}, to)
    return publish.verified(t.spark, to).select("table", "rows", "same")


@query("select doc_id, source, n_chars from documents")
def restored_documents(t):
    """Documents after an export and a restore that is tried twice."""
    out, into = _folder(t.spark), _folder(t.spark)
    publish.export_tables({"documents": t.documents, "labels": t.labels}, out)
    publish.restore(t.spark, out, into)
    publish.restore(t.spark, out, into)
    return publish.restored_table(t.spark, into, "documents").select("doc_id", "source", "n_chars")


@query("select event_id, user_id, event_id % 3 as epoch, case when event_id % 3 = 0 then 1 else 2 end as fence from events")
def fenced_batches(t):
    """Batches of events under leases: one is run twice, and a holder whose lease has passed on writes nothing."""
    path = _folder(t.spark)
    batch = lambda epoch, fence: t.events.filter(F.col("event_id") % 3 == epoch).select("event_id", "user_id", F.lit(epoch).cast("long").alias("epoch"), F.lit(fence).alias("fence"))
    first = publish.take_lease(t.spark, path, "q")
    publish.write_fenced(batch(0, first), path, "q", 0, first)
    second = publish.take_lease(t.spark, path, "q")
    for epoch in (1, 0, 2, 2):
        publish.write_fenced(batch(epoch, second), path, "q", epoch, second)
    try:
        publish.write_fenced(batch(0, first), path, "q", 3, first)
    except publish.Stale:
        pass
    return publish.published(t.spark, path, "event_id long, user_id long, epoch long, fence int")
