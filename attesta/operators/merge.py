"""Monotone merges: what is weaker never replaces what is stronger."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.schema import COVERAGE_RETRY, COVERAGE_STRENGTH, COVERAGE_WORST


def ranked_by(value: Column, ranks: Mapping[str, int], other: int = 0) -> Column:
    out = F.lit(other)
    for name, rank in ranks.items():
        out = F.when(value == name, rank).otherwise(out)
    return out


def worst_coverage(coverage: str = "coverage") -> Column:
    """Aggregate: the worst coverage of a group."""
    return F.max_by(F.col(coverage), ranked_by(F.col(coverage), COVERAGE_WORST, len(COVERAGE_WORST)))


def strength(coverage: Column, chars: Column) -> Column:
    """Import strength: coverage first, then how much text there is."""
    return ranked_by(coverage, COVERAGE_STRENGTH).cast("long") * 1_000_000_000 + F.least(F.coalesce(chars, F.lit(0)).cast("long"), F.lit(999_999_999).cast("long"))


def keep_strongest(df: DataFrame, keys: Sequence[str], score: Column, arrival: str) -> DataFrame:
    """The strongest row of each key; of equally strong ones the first to arrive."""
    whole = F.struct(*df.columns)
    return df.withColumn("_s", score).groupBy(*keys).agg(F.min_by(whole, F.struct(-F.col("_s"), F.col(arrival))).alias("_r")).select("_r.*")


def retry_wins(prior_coverage: Column, prior_blocks: Column, coverage: Column, blocks: Column) -> Column:
    """Whether a second extraction replaces the first: better coverage, or as good and more blocks."""
    a, b = ranked_by(prior_coverage, COVERAGE_RETRY), ranked_by(coverage, COVERAGE_RETRY)
    return (b > a) | ((b == a) & (blocks > prior_blocks))


def merge_pages(prior: DataFrame, run: DataFrame, keys: Sequence[str], page: str, chars: str) -> DataFrame:
    """Pages of two extractions: of each page the one with more characters, the prior one if equal."""
    both = prior.withColumn("_run", F.lit(0)).unionByName(run.withColumn("_run", F.lit(1)))
    return keep_strongest(both, [*keys, page], F.col(chars).cast("long"), "_run").drop("_run")


def next_page(pages: Column, truncated: Column, page_count: Column) -> Column:
    """The first missing page, else the first truncated one, else null."""
    gaps = F.array_except(F.sequence(F.lit(1), F.greatest(page_count, F.lit(1))), pages)
    return F.coalesce(F.array_min(F.when(page_count > 0, gaps)), F.array_min(truncated))


def gaps(df: DataFrame, keys: Sequence[str], number: str) -> DataFrame:
    """Numbers that are missing between 1 and the largest of each key, one row each."""
    per = df.groupBy(*keys).agg(F.collect_set(F.col(number).cast("long")).alias("_have"), F.max(F.col(number).cast("long")).alias("_top"))
    return per.select(*keys, F.explode(F.array_except(F.sequence(F.lit(1).cast("long"), F.greatest("_top", F.lit(1))), "_have")).alias("missing"))


def counters_agree(df: DataFrame, counters: Mapping[str, Column]) -> DataFrame:
    """``violations``: names of counters that differ from what is counted again."""
    wrong = [F.when(~F.col(name).eqNullSafe(again), F.lit(name)) for name, again in counters.items()]
    return df.withColumn("violations", F.array_compact(F.array(*wrong)))


def merged_coverage(prior: Column, run: Column, run_failed: Column) -> Column:
    """Never promoted by a run that failed; otherwise the better of both."""
    better = ranked_by(run, COVERAGE_STRENGTH) > ranked_by(prior, COVERAGE_STRENGTH)
    return F.when(run_failed, prior).when(better | prior.isNull(), run).otherwise(prior)
