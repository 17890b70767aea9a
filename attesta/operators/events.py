"""Memory events: versioned appends, corrections and current assertions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attesta.operators.folds import ordered_fold
from attesta.operators.timeline import ranked


def _step(state, row):
    version, seen = state or (0, {})
    key, print_, expected = row["idempotency_key"], row["fingerprint"], row["expected_version"]
    if key in seen:
        at, first = seen[key]
        made = (at, "replayed") if first == print_ else (0, "idempotency_conflict")
    elif expected is not None and expected == expected and int(expected) != version:
        made = (0, "version_conflict")
    else:
        version += 1
        if row["again"]:
            seen[key] = (version, print_)
        made = (version, "recorded")
    return (version, seen), (row["context_id"], row["arrival"], key, *made)


def record_deltas(requests: DataFrame) -> DataFrame:
    """Outcome of each request ``(context_id, arrival, idempotency_key, fingerprint, expected_version)``.

    Within a context, in order of arrival: a known key with the same fingerprint is replayed at its
    version, with another one refused; an expected version that isn't the current one is refused;
    else the next version is recorded. The fold reads a context as a stream and remembers those keys
    alone that come more than once.
    """
    kind = {c: requests.schema[c].dataType.simpleString() for c in ("context_id", "arrival", "idempotency_key")}
    again = F.count("*").over(Window.partitionBy("context_id", "idempotency_key")) > 1
    rows = requests.select(*kind, "fingerprint", "expected_version").withColumn("again", again)
    return ordered_fold(rows, ["context_id"], ["arrival"], _step, ", ".join(f"{c} {t}" for c, t in kind.items()) + ", version long, outcome string").withColumn("version", F.nullif("version", F.lit(0)))


def without_superseded(events: DataFrame, id_: str, supersedes: str) -> DataFrame:
    """Events that no other names in its ``supersedes`` list."""
    named = events.select(F.explode(supersedes).alias(id_)).distinct()
    return events.join(named, id_, "left_anti")


def current_assertions(events: DataFrame, keys: Sequence[str], id_: str, supersedes: str, recorded: str, version: str) -> DataFrame:
    """The newest assertion of each key among those not superseded: superseded ones go before the rank."""
    order = [F.desc(recorded), F.desc(version), F.desc(id_)]
    return ranked(without_superseded(events, id_, supersedes), keys, order).filter("rn = 1").drop("rn")


def academic_events(events: DataFrame, bindings: DataFrame) -> DataFrame:
    """Assertions about the only target of their context; retracted ones are left out after the rank."""
    one = bindings.filter("active").groupBy("owner_id", "context_id").agg(F.count_distinct("entity_id").alias("n"), F.min("entity_id").alias("target_id")).filter("n = 1").drop("n")
    bound = events.withColumn("entity_id", F.nullif(F.col("entity_id"), F.lit(""))).join(one, ["owner_id", "context_id"], "left").withColumn("target_id", F.coalesce("entity_id", "target_id")).filter("target_id is not null")
    now = current_assertions(bound, ["owner_id", "target_id", "event_type", "requirement_key"], "id", "supersedes", "recorded_at", "version")
    return now.filter(~F.coalesce("retracted", F.lit(False)))


def reconcile(events: DataFrame, keys: Sequence[str], dimension: str, value: str, at: str, tie: str) -> DataFrame:
    """One state per dimension: each event changes its own dimension only, the newest wins."""
    newest = ranked(events, [*keys, dimension], [F.desc(at), F.desc(tie)]).filter("rn = 1")
    return newest.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(dimension), F.col(value))))).alias("state"))


def matching_receipts(actions: DataFrame, receipts: DataFrame) -> DataFrame:
    """Receipts of an action: same connection, course and activity; discussion and parent only where both name them."""
    a, r = actions.alias("a"), receipts.alias("r")
    loose = lambda c: F.col(f"a.{c}").isNull() | F.col(f"r.{c}").isNull() | (F.col(f"a.{c}") == F.col(f"r.{c}"))
    on = (F.col("a.connection_id") == F.col("r.connection_id")) & (F.col("a.course_id") == F.col("r.course_id")) & (F.col("a.activity_id") == F.col("r.activity_id")) & loose("discussion_id") & loose("parent_id")
    return a.join(r, on).select("a.*", F.col("r.receipt_id"))


def change_log(events: DataFrame, keys: Sequence[str], at: str, tie: str, state: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(at, tie)
    return events.withColumns({"from_state": F.lag(state).over(w), "to_state": F.col(state)})
