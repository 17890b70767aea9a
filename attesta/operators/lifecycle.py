"""State machines as folds over ordered events: jobs, actions and budgets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.operators.folds import ordered_fold

ATTEMPTS = 5
#: Coverage of a finished job -> its state: fixed values.
FINISHED = {"complete": "complete", "partial": "partial", "expired": "expired"}


def finished_state(coverage: Column) -> Column:
    out = F.lit("failed")
    for k, v in FINISHED.items():
        out = F.when(coverage == k, v).otherwise(out)
    return out


def finish(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Jobs with their results; the cursor moves on only when coverage is complete."""
    done = results.select("id", F.col("coverage").alias("_c"), F.col("cursor").alias("_new"))
    out = jobs.join(done, "id", "left")
    return out.withColumns({"state": F.when(F.col("_c").isNotNull(), finished_state(F.col("_c"))).otherwise(F.col("state")), "cursor": F.when(F.col("_c") == "complete", F.col("_new")).otherwise(F.col("cursor"))}).drop("_c", "_new")


def _newest(folded: DataFrame, key: str, *columns: str) -> DataFrame:
    return folded.groupBy(key).agg(F.max_by(F.struct(*columns), "nth").alias("_s")).select(key, "_s.*")


def _job(state, row):
    now, attempts, until, nth = state or ("absent", 0, None, 0)
    kind, at = row["event"], row["at"]
    if kind == "enqueue" and now in ("absent", "complete", "partial", "failed", "expired"):
        now, attempts, until = "pending", 0, None
    elif kind == "claim" and attempts < ATTEMPTS and (now == "pending" or now == "running" and until is not None and at >= until):
        now, attempts, until = "running", attempts + 1, at + pd.Timedelta(minutes=2)
    elif kind == "finish" and now == "running" and until is not None and at < until:
        now, until = FINISHED.get(row["value"], "failed"), None
    return (now, attempts, until, nth + 1), (row["job_id"], nth, now, attempts)


def job_states(events: DataFrame) -> DataFrame:
    """``(job_id, state, attempts)`` after ``events(job_id, at, event, value)``: enqueue, claim with a two-minute lease, finish.

    A finish after its lease has run out changes nothing; a running job can be claimed again then.
    Events of one time go by the event's name.
    """
    kind = events.schema["job_id"].dataType.simpleString()
    folded = ordered_fold(events.select("job_id", "at", "event", "value"), ["job_id"], ["at", "event"], _job, f"job_id {kind}, nth long, state string, attempts long")
    return _newest(folded, "job_id", "state", "attempts")


def _action(state, row):
    now, expires, nth = state or ("absent", None, 0)
    kind = row["event"]
    late = expires is not None and row["at"] >= expires
    if kind == "prepare" and now == "absent":
        now, expires = "prepared", row["expires_at"] if pd.notna(row["expires_at"]) else None
    elif kind == "approve" and now == "prepared" and not late:
        now = "approved"
    elif kind == "deny" and now in ("prepared", "approved"):
        now = "denied"
    elif kind == "consume" and now == "approved" and not late:
        now = "uncertain"  # until a result is known; an approval is used once
    elif kind == "result" and now == "uncertain":
        now = "succeeded"
    return (now, expires, nth + 1), (row["action_id"], nth, now)


def action_states(events: DataFrame) -> DataFrame:
    """``(action_id, state)`` after ``events(action_id, at, event, expires_at)``; events of one time go by name."""
    kind = events.schema["action_id"].dataType.simpleString()
    folded = ordered_fold(events.select("action_id", "at", "event", "expires_at"), ["action_id"], ["at", "event"], _action, f"action_id {kind}, nth long, state string")
    return _newest(folded, "action_id", "state")


def queue_head(jobs: DataFrame, now: Column, size: int = 1) -> DataFrame:
    """The next jobs to run: pending or with a lapsed lease, oldest first."""
    free = (F.col("state") == "pending") | ((F.col("state") == "running") & (F.col("lease_until") <= now))
    return jobs.filter(free & (F.col("attempts") < ATTEMPTS)).orderBy("updated_at", "id").limit(size)


def tumbling_budget(charges: DataFrame, keys: Sequence[str], at: str, tie: str, costs: Mapping[str, str], total: Mapping[str, float], window: Mapping[str, float], seconds: float) -> DataFrame:
    """Charges with ``fits``, ``window_started`` and, of each dimension, ``reserved_*`` and ``window_*`` after them.

    ``costs`` names a column for each dimension. A charge has to fit its policy's total and the
    window's rest in every dimension; one that doesn't is refused and charges nothing. A window
    begins with the first charge that comes ``seconds`` or more after the last one began.
    """
    names = list(costs)
    out = ", ".join([f"{charges.schema[c].name} {charges.schema[c].dataType.simpleString()}" for c in [*keys, at, tie]] + ["fits boolean", "window_started timestamp"] + [f"{w}_{n} double" for w in ("reserved", "window") for n in names])

    def step(state, row):
        begun, used, here = state or (row[at], dict.fromkeys(names, 0.0), dict.fromkeys(names, 0.0))
        if (row[at] - begun).total_seconds() >= seconds:
            begun, here = row[at], dict.fromkeys(names, 0.0)
        # The sum that is kept is held against the limit: the rest of a limit is rounded otherwise.
        fits = all(used[n] + row[costs[n]] <= total[n] and here[n] + row[costs[n]] <= window[n] for n in names)
        if fits:
            used = {n: used[n] + row[costs[n]] for n in names}
            here = {n: here[n] + row[costs[n]] for n in names}
        return (begun, used, here), (*[row[k] for k in keys], row[at], row[tie], fits, begun, *used.values(), *here.values())

    return ordered_fold(charges.select(*dict.fromkeys([*keys, at, tie, *costs.values()])), keys, [at, tie], step, out)


def backoff_seconds(failures: Column, base: int, most: int = 86400) -> Column:
    """``base * 2^(failures - 1)``, the power up to five, at most a day."""
    return F.least(F.lit(most), (base * F.pow(F.lit(2), F.least(failures - 1, F.lit(5)))).cast("long"))


def ladder_seconds(failures: Column, steps: Sequence[int] = (1800, 7200, 21600)) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in steps]), F.least(F.greatest(failures, F.lit(1)), F.lit(len(steps))).cast("int"))


def next_in_turn(policies: DataFrame, order: str, cursor: int) -> DataFrame:
    """Policies from the cursor on, round the end. Numbered by range partitions and what lies before each, not in one task."""
    part = policies.repartitionByRange(order).withColumn("_part", F.spark_partition_id()).withColumn("_i", F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1)
    sizes = part.groupBy("_part").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    starts = sizes.withColumns({"_before": F.coalesce(F.sum("_size").over(before), F.lit(0)), "_n": F.sum("_size").over(Window.partitionBy(F.lit(0)))}).drop("_size")
    return part.join(starts, "_part").withColumn("turn", F.pmod(F.col("_i") + F.col("_before") - cursor, F.col("_n"))).drop("_i", "_n", "_part", "_before")
