"""Follow-up policies: settling runs, preparing the next one, pauses by revision, schedules and write budgets.

Times are milliseconds since the epoch. State is a table with a row a policy; each function gives
that table after its requests, with a reason where one is refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attesta.operators.folds import ordered_fold

DAY_MS = 86_400_000
RUNS, ATTEMPTS, JOB_ATTEMPTS = 28, 2, 5


def _failures(outcome: Column, before: Column) -> Column:
    return F.when(outcome.isin("complete", "progress"), 0).otherwise(before + 1)


def _next_at(outcome: Column, failures: Column, at: Column) -> Column:
    """When a policy may run again: its interval after success, else its backoff, doubled up to five times, a day at most."""
    later = F.least(F.lit(DAY_MS), (F.col("backoff_ms") * F.pow(F.lit(2), F.least(failures - 1, F.lit(5)))).cast("long"))
    return at + F.when(outcome == "complete", F.col("interval_ms")).when(outcome == "progress", F.col("backoff_ms")).otherwise(later)


def _reason(outcome: Column, failures: Column) -> Column:
    return F.when(outcome == "expired", "credential_expired").when(failures >= F.col("max_failures"), "failure_limit")


def settle(outcomes: DataFrame, policies: DataFrame) -> DataFrame:
    """Runs ``(policy_id, run_id, at, outcome)`` with the policy's ``failures, next_at, pause_reason`` after each.

    A policy that a run has paused runs no more: later rows of it are left out. ``policies`` has
    ``(policy_id, interval_ms, backoff_ms, max_failures)``. Runs of one time go by run_id.
    """
    order = [F.col("at"), F.col("run_id")]
    good = F.col("outcome").isin("complete", "progress")
    streak = Window.partitionBy("policy_id", "_wins").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    wins = Window.partitionBy("policy_id").orderBy(*order)
    out = outcomes.join(policies.select("policy_id", "interval_ms", "backoff_ms", "max_failures"), "policy_id")
    out = out.withColumn("_wins", F.count_if(good).over(wins.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.withColumn("failures", F.count_if(~good).over(streak))
    out = out.withColumns({"next_at": _next_at(F.col("outcome"), F.col("failures"), F.col("at")), "pause_reason": _reason(F.col("outcome"), F.col("failures"))})
    earlier = F.coalesce(F.max(F.col("pause_reason").isNotNull()).over(wins.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False))
    return out.withColumn("_earlier", earlier).filter("not _earlier").drop("_earlier", "_wins", "interval_ms", "backoff_ms", "max_failures")


def _ended(df: DataFrame, ends: Column, outcome: Column, now: Column) -> DataFrame:
    """Policies whose active run ends now, where ``ends``."""
    out = df.withColumns({"_ends": F.coalesce(ends, F.lit(False)), "_outcome": outcome})
    out = out.withColumn("failures", F.when(F.col("_ends"), _failures(F.col("_outcome"), F.col("failures"))).otherwise(F.col("failures")))
    reason = F.when(F.col("_ends"), _reason(F.col("_outcome"), F.col("failures")))
    out = out.withColumns({
        "next_at": F.when(F.col("_ends"), _next_at(F.col("_outcome"), F.col("failures"), now)).otherwise(F.col("next_at")),
        "paused": F.col("paused") | reason.isNotNull(),
        "pause_reason": F.coalesce(reason, "pause_reason"),
        "active_id": F.when(~F.col("_ends"), F.col("active_id")),
        "active_deadline": F.when(~F.col("_ends"), F.col("active_deadline")),
    })
    return out.drop("_ends", "_outcome")


def prepare(policies: DataFrame, jobs: DataFrame, now: Column) -> DataFrame:
    """Policies made ready to run, with ``wants``: a ``new`` job, the ``same`` one, or none.

    A lapsed run is ended first (complete if its job is), an expired policy is paused, and one whose
    job can't go on (absent, failed, expired, or out of attempts) is paused as ``job_terminal``.
    ``policies(policy_id, paused, pause_reason, failures, next_at, expires_at, active_id,
    active_deadline, job_id, interval_ms, backoff_ms, max_failures)``, ``jobs(job_id, state, attempts)``.
    """
    job = jobs.select("job_id", F.col("state").alias("_state"), F.col("attempts").alias("_attempts"))
    out = policies.join(job, "job_id", "left")
    done = F.col("_state") == "complete"
    out = _ended(out, F.col("active_deadline") <= now, F.when(done, "complete").otherwise("abandoned"), now)
    expired = F.col("expires_at") <= now
    out = out.withColumns({"paused": F.col("paused") | expired, "pause_reason": F.when(expired, "policy_expired").otherwise(F.col("pause_reason"))})
    waits = F.col("paused") | F.col("active_id").isNotNull() | (F.col("next_at") > now)
    stuck = F.col("job_id").isNotNull() & (F.col("_state").isNull() | F.col("_state").isin("failed", "expired") | (F.col("_attempts") >= JOB_ATTEMPTS) & ~done)
    out = out.withColumns({"_waits": waits, "_stuck": ~waits & stuck})
    return out.withColumns({
        "paused": F.col("paused") | F.col("_stuck"),
        "pause_reason": F.when(F.col("_stuck"), "job_terminal").otherwise(F.col("pause_reason")),
        "wants": F.when(~F.col("_waits") & ~F.col("_stuck"), F.when(F.col("job_id").isNull() | done, "new").otherwise("same")),
    }).drop("_state", "_attempts", "_waits", "_stuck")


def pause(policies: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """Policies after ``requests(policy_id, pause, at_revision)``, at most one a policy.

    Refused: another revision than the stored one, resuming while a run is active, resuming an expired
    policy. A pause ends the active run; resuming keeps balances, failures and ``next_at``.
    """
    out = policies.join(requests.select("policy_id", F.col("pause").alias("_pause"), F.col("at_revision").alias("_at")), "policy_id", "left")
    refusal = F.when(F.col("_at") != F.col("revision"), "version_conflict").when(~F.col("_pause") & F.col("active_id").isNotNull(), "policy_busy").when(~F.col("_pause") & (F.col("expires_at") <= now), "policy_expiry")
    out = out.withColumn("refusal", refusal).withColumn("_done", F.col("_pause").isNotNull() & F.col("refusal").isNull())
    out = _ended(out, F.col("_done") & F.col("active_id").isNotNull(), F.lit("paused"), now)
    return out.withColumns({
        "paused": F.when(F.col("_done"), F.col("_pause")).otherwise(F.col("paused")),
        "pause_reason": F.when(F.col("_done"), F.when(F.col("_pause"), "manual")).otherwise(F.col("pause_reason")),
        "revision": F.col("revision") + F.col("_done").cast("int"),
    }).drop("_pause", "_at", "_done")


def interrupt(policies: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """Policies after ``requests(policy_id, run_id)``: the named run ends by timeout, if it is the active one."""
    named = requests.select("policy_id", F.col("run_id").alias("_run")).distinct().withColumnRenamed("_run", "active_id").withColumn("_named", F.lit(True))
    out = policies.join(named, ["policy_id", "active_id"], "left")
    return _ended(out, F.col("_named"), F.lit("wall_timeout"), now).drop("_named")


def next_run(schedules: DataFrame, policies: DataFrame, now: Column) -> DataFrame:
    """Per schedule the policy that runs next, ``(schedule_id, policy_id, attempts, cursor)``: the first from the cursor on that may.

    Attempts count within one window: those noted under another ``window_key`` are void.
    ``schedules(schedule_id, window_key, window_end, cursor, size)``; ``policies(schedule_id,
    policy_id, position, noted_key, attempts, runs, next_at, wall_ms, paused)``.
    """
    both = policies.join(schedules, "schedule_id")
    both = both.withColumn("attempts", F.when(F.col("noted_key").eqNullSafe(F.col("window_key")), F.col("attempts")).otherwise(0))
    free = (F.col("runs") < RUNS) & (F.col("attempts") < ATTEMPTS) & (F.coalesce("next_at", F.lit(0)) <= now) & (now + F.col("wall_ms") <= F.col("window_end")) & ~F.col("paused")
    turn = F.pmod(F.col("position") - F.col("cursor"), F.col("size"))
    first = both.filter(free).groupBy("schedule_id").agg(F.min_by(F.struct("policy_id", "position", "attempts", "size"), turn).alias("_p"))
    return first.select("schedule_id", "_p.policy_id", (F.col("_p.attempts") + 1).alias("attempts"), F.pmod(F.col("_p.position") + 1, F.col("_p.size")).alias("cursor"))


def _write(state, row):
    used = state or 0
    fits = row["smallest"] >= 0 and row["bytes"] <= row["limit"] - used
    used += row["bytes"] if fits else 0
    return used, (row["run_id"], row["batch_id"], row["bytes"], used, None if fits else "followup_write_budget")


def write_budget(writes: DataFrame, limits: DataFrame) -> DataFrame:
    """``(run_id, batch_id, bytes, used, refusal)`` of the batches of ``writes(run_id, batch_id, bytes)`` in order of batch_id.

    A batch is written whole or not at all: what exceeds the rest of its run's ``limits(run_id, limit)``,
    or holds a negative size, is rolled back and uses nothing.
    """
    batches = writes.groupBy("run_id", "batch_id").agg(F.sum("bytes").alias("bytes"), F.min("bytes").alias("smallest")).join(limits.select("run_id", "limit"), "run_id")
    of = lambda c: batches.schema[c].dataType.simpleString()
    return ordered_fold(batches, ["run_id"], ["batch_id"], _write, f"run_id {of('run_id')}, batch_id {of('batch_id')}, bytes long, used long, refusal string")
