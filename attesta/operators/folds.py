"""Folds over the rows of a key in order, for rules in which each row's outcome decides the next one's."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame


def ordered_fold(df: DataFrame, keys: Sequence[str], order: Sequence[str], step: Callable, schema: str) -> DataFrame:
    """One row out for each row in: ``state, out = step(state, row)``, from ``None`` at the first row of each key.

    Rows are shuffled by key and sorted within their partition, where Spark spills what doesn't fit;
    a task reads them as a stream and holds one batch and one state, so a key of any size is folded.
    """
    names = [part.strip().split(" ")[0] for part in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                own = tuple(row[k] for k in keys)
                if own != key:
                    key, state = own, None
                state, made = step(state, row)
                out.append(made)
            yield pd.DataFrame(out, columns=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
