"""Bitemporal preferences: what held at an instant, by what was known then."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def within(scope: Column, other: Column) -> Column:
    """Every entry of ``scope`` is in ``other``."""
    return F.forall(F.map_entries(scope), lambda e: F.coalesce(F.try_element_at(other, e["key"]) == e["value"], F.lit(False)))


def status(rows: DataFrame, at: Column) -> DataFrame:
    """Each row's ``status`` at the instant; the first that applies of: future, superseded, withdrawal, expired, requires_review, legacy_requires_review, current.

    Only a user's own report that had begun and was recorded supersedes, and what it superseded
    stays so after it has expired.
    """
    begun = (F.coalesce("valid_from", at) <= at) & (F.col("recorded_at") <= at)
    gone = rows.filter(begun & (F.col("evidence_kind") == "user_report")).select(F.explode("supersedes").alias("id")).distinct().withColumn("_gone", F.lit(True))
    ladder = (
        F.when(~begun, "future")
        .when(F.col("_gone").isNotNull(), "superseded")
        .when(F.col("state") == "withdrawn", "withdrawal")
        .when(F.col("valid_until") <= at, "expired")
        .when(F.col("evidence_kind") != "user_report", "requires_review")
        .when(F.col("key").isNull(), "legacy_requires_review")
        .otherwise("current")
    )
    return rows.join(gone, "id", "left").withColumn("status", ladder).drop("_gone")


def resolve(rows: DataFrame, scope: dict[str, str], at: Column, complete: bool = True) -> DataFrame:
    """Current preferences that apply to ``scope``: narrower ones dominate wider ones of the same key.

    ``dominated``, ``conflict`` (several undominated ones of a key) and ``applicable``; an
    incomplete history gives no applicable preference. Rows of different owners or contexts, where
    there are such columns, have nothing to do with each other.
    """
    own = [c for c in ("owner_id", "context_id") if c in rows.columns]
    wanted = F.create_map(*[F.lit(x) for kv in scope.items() for x in kv]) if scope else F.create_map().cast("map<string,string>")
    seen = status(rows, at).filter(within(F.col("scope"), wanted))
    live = seen.filter("status = 'current'")
    a, b = live.alias("a"), live.select("id", "key", "scope", *own).alias("b")
    wider = within(F.col("a.scope"), F.col("b.scope")) & (F.size("b.scope") > F.size("a.scope"))
    for c in own:
        wider = wider & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    beaten = a.join(b, (F.col("a.key") == F.col("b.key")) & wider, "left_semi").select(F.col("id")).withColumn("dominated", F.lit(True))
    out = seen.join(beaten, "id", "left").withColumn("dominated", F.coalesce("dominated", F.lit(False)))
    top = (F.col("status") == "current") & ~F.col("dominated")
    rivals = F.count_if(top).over(Window.partitionBy("key", *own))
    return out.withColumns({"conflict": top & (rivals > 1), "applicable": top & (rivals == 1) & F.lit(complete)})


def problems(rows: DataFrame) -> DataFrame:
    """``violations`` of each preference: interval order, a withdrawal's form, repeated or unknown targets of ``supersedes``."""
    known = rows.select(F.col("id").alias("_t"), F.col("key").alias("_tk"), F.col("scope").alias("_ts"))
    targets = rows.select("id", "key", "scope", F.explode("supersedes").alias("_t")).join(known, "_t", "left")
    same = F.col("_tk").eqNullSafe(F.col("key")) & within(F.col("_ts"), F.col("scope")) & within(F.col("scope"), F.col("_ts"))
    bad = targets.groupBy("id").agg(F.count_if(F.col("_tk").isNull()).alias("_unknown"), F.count_if(F.col("_tk").isNotNull() & ~same).alias("_other"))
    checks = F.array(
        F.when(F.col("valid_until") <= F.col("valid_from"), F.lit("interval_order")),
        F.when((F.col("state") == "withdrawn") & (F.size("supersedes") == 0), F.lit("withdrawal_without_target")),
        F.when(F.size(F.array_distinct("supersedes")) != F.size("supersedes"), F.lit("repeated_target")),
        F.when(F.col("_unknown") > 0, F.lit("unknown_target")),
        F.when(F.col("_other") > 0, F.lit("other_scope_or_key")),
    )
    return rows.join(bad, "id", "left").withColumn("violations", F.array_compact(checks)).drop("_unknown", "_other")
