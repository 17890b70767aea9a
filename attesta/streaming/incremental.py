"""The same operators on streams: idempotent by content, late by event time, stateful by key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def file_stream(spark, path: str, schema: str, fmt: str = "json", files: int = 100) -> DataFrame:
    """New files of a folder; offsets are the query's checkpoint."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).format(fmt).load(path)


def occurrences_once(stream: DataFrame, keys: list[str], at: str, late: str = "1 day") -> DataFrame:
    """Sightings without repeats of (keys, time); state is kept as long as events may be late."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([*keys, at])


def windowed_counts(stream: DataFrame, at: str, length: str, late: str, *keys: str) -> DataFrame:
    return stream.withWatermark(at, late).groupBy(F.window(at, length), *keys).agg(F.count("*").alias("events"))


LATEST = "entity_id string, content_hash string, observed_at timestamp, revisits long"
LATEST_STATE = "content_hash string, observed_at timestamp, revisits long"


def _latest(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now_hash, now_at, back = state.get if state.exists else (None, None, 0)
    for pdf in frames:
        for h, at in pdf.sort_values(["observed_at", "content_hash"])[["content_hash", "observed_at"]].itertuples(index=False):
            if now_at is None or at >= now_at:
                back += now_hash is not None and h != now_hash
                now_hash, now_at = h, at
    state.update((now_hash, now_at, int(back)))
    yield pd.DataFrame({"entity_id": [key[0]], "content_hash": [now_hash], "observed_at": [now_at], "revisits": [int(back)]})


def latest_state(stream: DataFrame) -> DataFrame:
    """Newest content per entity with its number of changes; an older row never replaces it."""
    return stream.groupBy("entity_id").applyInPandasWithState(_latest, LATEST, LATEST_STATE, "update", GroupStateTimeout.NoTimeout)


BUDGET = "policy_id string, at timestamp, cost double, used double, fits boolean"


def budget(stream: DataFrame, seconds: int, limit: float) -> DataFrame:
    """Tumbling budget per policy over ``stream(policy_id, at, cost)``: a charge that fits stays charged, one that doesn't charges nothing.

    A window begins with the first charge that comes ``seconds`` or more after the last one began.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        begin, used = state.get if state.exists else (None, 0.0)
        out = []
        for pdf in frames:
            for at, cost in pdf.sort_values("at")[["at", "cost"]].itertuples(index=False):
                if begin is None or (at - begin).total_seconds() >= seconds:
                    begin, used = at, 0.0
                fits = used + cost <= limit
                out.append((key[0], at, cost, used, fits))
                used += cost if fits else 0.0
        state.update((begin, used))
        yield pd.DataFrame(out, columns=["policy_id", "at", "cost", "used", "fits"])

    return stream.groupBy("policy_id").applyInPandasWithState(run, BUDGET, "begin timestamp, used double", "append", GroupStateTimeout.NoTimeout)


def sink_new(keys: list[str], path: str):
    """``foreachBatch`` writer that adds rows with unknown keys only; running a batch again adds nothing."""

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates(keys)
        try:
            known = spark.read.parquet(path).select(*keys)
        except Exception as e:  # nothing written yet
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
        else:
            rows = rows.join(known, keys, "left_anti")
        rows.write.mode("append").parquet(path)

    return write
