"""Writes that others see at once or not at all: a folder with a log of numbered manifests.

Data is written beside what is there, and counts once a manifest names it. A manifest's number is
the compare-and-swap: its file is created, never overwritten, so of two writers that saw the same
newest number one has to look again. Readers take the folders that the log names; what a
failed or refused write left behind is named by none.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class Stale(RuntimeError):
    """A write of a holder whose lease was given to another since."""


class Log:
    """The manifests of a folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path, self._io = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.hadoop.io.IOUtils
        self._text = jvm.java.lang.String
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def entries(self) -> list[dict]:
        """All manifests, oldest first; a number that is only begun ends the list."""
        folder = self._path(f"{self.path}/_log")
        names = sorted(f.getPath().getName() for f in self._fs.listStatus(folder)) if self._fs.exists(folder) else []
        out: list[dict] = []
        for i, name in enumerate(n for n in names if n.endswith(".json")):
            if name != f"{i:012d}.json":
                break
            stream = self._fs.open(self._path(f"{self.path}/_log/{name}"))
            try:
                raw = bytes(stream.readAllBytes())
            finally:
                stream.close()
            if not raw.endswith(b"}"):
                break
            out.append(json.loads(raw))
        return out

    def append(self, entry: Mapping, number: int) -> bool:
        """Whether ``entry`` became manifest ``number``; False if there is one already."""
        name = self._path(f"{self.path}/_log/{number:012d}.json")
        try:
            stream = self._fs.create(name, False)
        except Exception as e:  # noqa: BLE001  the bridge has one kind of error for all
            if self._fs.exists(name):
                return False
            raise e
        try:
            stream.write(bytearray(json.dumps(dict(entry), sort_keys=True).encode()))
        finally:
            stream.close()
        return True

    def commit(self, entry: Callable[[list[dict]], Mapping | None]) -> bool:
        """Appends what ``entry`` makes of the log so far; it is asked again whenever another writer came first. None ends it."""
        while True:
            before = self.entries()
            made = entry(before)
            if made is None:
                return False
            if self.append(made, len(before)):
                return True


def write_fenced(df: DataFrame, path: str, query: str, epoch: int, fence: int) -> bool:
    """Writes ``df`` as the batch ``epoch`` of ``query``, under the lease ``fence``; False if the batch is there already.

    A lease that is older than one that has written for the query is refused (``Stale``), before the
    data is written and again when it would be named. For ``foreachBatch``: a batch that is run again
    adds nothing.
    """
    log = Log(df.sparkSession, path)
    to = f"{query}-{epoch}-{fence}-{uuid.uuid4().hex}"

    def wanted(before: list[dict]) -> dict | None:
        own = [e for e in before if e.get("query") == query]
        if any(e["fence"] > fence for e in own):
            raise Stale(f"{query}: lease {fence} was followed by {max(e['fence'] for e in own)}")
        return None if any(e["epoch"] == epoch for e in own) else {"query": query, "epoch": epoch, "fence": fence, "folders": [to]}

    if wanted(log.entries()) is None:
        return False
    df.write.parquet(f"{log.path}/data/{to}")
    return log.commit(wanted)


def take_lease(spark: SparkSession, path: str, query: str) -> int:
    """The next lease of ``query``: from now on older ones can't write."""
    log, got = Log(spark, path), []

    def entry(before: list[dict]) -> dict:
        got[:] = [1 + max((e["fence"] for e in before if e.get("query") == query), default=0)]
        return {"query": query, "epoch": None, "fence": got[0], "folders": []}

    log.commit(entry)
    return got[0]


def published(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows that the log of ``path`` names."""
    log = Log(spark, path)
    folders = [f"{log.path}/data/{f}" for e in log.entries() for f in e["folders"]]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


# Export and restore


def row_digest(df: DataFrame) -> Column:
    """A number for each row, from the MD5 of its columns as text: their sum doesn't depend on order."""
    shown = [F.concat(F.lit("="), F.col(f"`{f.name}`").cast("string")) for f in df.schema]
    text = F.concat_ws("\x1f", *[F.coalesce(c, F.lit("-")) for c in shown])
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("decimal(38,0)")


def _measures(df: DataFrame) -> list[Column]:
    return [F.count("*").alias("rows"), F.coalesce(F.sum(row_digest(df)), F.lit(0)).cast("string").alias("digest")]


def export_tables(tables: Mapping[str, DataFrame], to: str) -> dict:
    """Writes every table as Parquet and, last, a manifest of their rows and digests, measured while they were written."""
    kept = {}
    for name, df in tables.items():
        seen = Observation(f"export-{name}-{uuid.uuid4().hex}")
        df.observe(seen, *_measures(df)).write.parquet(f"{to.rstrip('/')}/data/{name}")
        kept[name] = {"rows": seen.get["rows"], "digest": seen.get["digest"], "schema": df.schema.json()}
    spark = next(iter(tables.values())).sparkSession
    manifest = {"tables": kept, "folders": []}
    if not Log(spark, to).append(manifest, 0):
        raise FileExistsError(to)
    return manifest


def _manifest(spark: SparkSession, path: str) -> dict:
    found = Log(spark, path).entries()
    if not found:
        raise FileNotFoundError(f"{path} has no manifest: its export did not end")
    return found[0]


def verified(spark: SparkSession, path: str) -> DataFrame:
    """``table, rows, digest, same`` of an export read again."""
    from functools import reduce

    from pyspark.sql.types import StructType

    parts = []
    for name, told in sorted(_manifest(spark, path)["tables"].items()):
        df = spark.read.schema(StructType.fromJson(json.loads(told["schema"]))).parquet(f"{path.rstrip('/')}/data/{name}")
        parts.append(df.agg(*_measures(df)).select(F.lit(name).alias("table"), "rows", "digest", ((F.col("rows") == told["rows"]) & (F.col("digest") == told["digest"])).alias("same")))
    return reduce(DataFrame.union, parts)


def restore(spark: SparkSession, path: str, into: str) -> bool:
    """Brings the tables of an export to ``into``: all of them by one manifest, or none.

    Every table is verified first and again as it is written; a difference raises and publishes nothing.
    False if this export is there already, so that a restore may be tried again.
    """
    manifest = _manifest(spark, path)
    name = hashlib.sha256(json.dumps(manifest, sort_keys=True).encode()).hexdigest()
    log = Log(spark, into)
    if any(e.get("export") == name for e in log.entries()):
        return False
    if wrong := [r.table for r in verified(spark, path).filter("not same").collect()]:  # a row a table
        raise ValueError(f"differ from their manifest: {', '.join(wrong)}")
    to = f"{name[:16]}-{uuid.uuid4().hex}"
    for table, told in manifest["tables"].items():
        seen = Observation(f"restore-{table}-{uuid.uuid4().hex}")
        df = spark.read.parquet(f"{path.rstrip('/')}/data/{table}")
        df.observe(seen, *_measures(df)).write.parquet(f"{log.path}/data/{to}/{table}")
        if (seen.get["rows"], seen.get["digest"]) != (told["rows"], told["digest"]):
            raise ValueError(f"{table} changed while it was restored")
    return log.commit(lambda before: None if any(e.get("export") == name for e in before) else {"export": name, "folders": [to], "tables": sorted(manifest["tables"])})


def restored_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table of the newest restore."""
    log = Log(spark, path)
    newest = [e for e in log.entries() if table in e.get("tables", ())][-1]
    return spark.read.parquet(f"{log.path}/data/{newest['folders'][0]}/{table}")
