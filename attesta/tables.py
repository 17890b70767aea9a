"""Tenant-scoped access: every read of a table carries its owner's filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Tables:
    """Parquet tables under one folder; with an owner, only that owner's rows are ever seen.

    The filter is part of the plan and reaches the scan, so tables partitioned by ``owner_id`` are
    pruned to one owner's files.
    """

    def __init__(self, spark: SparkSession, root: str, owner: str | None = None, column: str = "owner_id"):
        self.spark, self.root, self.owner, self.column = spark, root.rstrip("/"), owner, column
        self._schemas: dict[str, StructType] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        # The schema is read from the files once; every use is a relation of its own, so a table may be joined to itself.
        read = self.spark.read.schema(self._schemas[name]) if name in self._schemas else self.spark.read
        df = read.parquet(f"{self.root}/{name}.parquet")
        self._schemas[name] = df.schema
        return df.filter(F.col(self.column) == self.owner) if self.owner is not None else df

    def export(self, names: list[str], to: str, fmt: str = "json") -> None:
        """Every named table of the owner, one folder each."""
        for name in names:
            getattr(self, name).write.mode("errorifexists").format(fmt).save(f"{to}/{name}")


def optional(df: DataFrame, **wanted) -> DataFrame:
    """Filters for those parameters that are given; the others restrict nothing."""
    for name, value in wanted.items():
        if value is not None:
            df = df.filter(F.col(name) == value)
    return df
