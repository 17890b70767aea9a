"""Keeping rows out of a shuffle by a bitmap of their keys' hashes.

The bitmap has a fixed size and may let rows through that are not wanted, never the reverse; the
join that follows decides. Once very many keys fill it, it saves less and results stay the same.
Only the hash of a row's key goes to Python; the row stays where it is.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the bitmap: 2 MB.
BITS = 24


def bitmap(hashes: DataFrame, bits: int = BITS) -> bytes:
    """The bitmap of the hashes in the only column of ``hashes``."""
    bit = F.col(hashes.columns[0]).bitwiseAND(F.lit((1 << bits) - 1))
    parts = hashes.select(bit.alias("bit")).groupBy(F.expr("bit div 32768").alias("chunk")).agg(F.bitmap_construct_agg(F.col("bit") % 32768).alias("bits")).collect()  # the bitmap's own size at most
    full = bytearray(1 << (bits - 3))
    for r in parts:
        full[r.chunk * 4096 : (r.chunk + 1) * 4096] = r.bits
    return bytes(full)


def split_by(df: DataFrame, key: Column, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of ``df`` whose ``key`` may be in the only column of ``wanted``, and those where it is not."""
    full = df.sparkSession.sparkContext.broadcast(bitmap(wanted.select(F.xxhash64(wanted.columns[0]))))

    @F.pandas_udf("boolean")
    def held(key_hash: pd.Series) -> pd.Series:
        bit = key_hash.to_numpy() & ((1 << BITS) - 1)
        return pd.Series((np.frombuffer(full.value, np.uint8)[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1)

    hit = held(F.xxhash64(key))
    return df.filter(hit), df.filter(~hit)


def without(df: DataFrame, key: Column, gone: DataFrame) -> DataFrame:
    """``df`` without the rows whose ``key`` (never null) is in the only column of ``gone``; only rows that may be are shuffled."""
    gone = gone.toDF("key").distinct()
    maybe, rest = split_by(df, key, gone)
    left = maybe.select(key.alias("key"), F.struct("*").alias("row")).join(gone, "key", "left_anti")
    return rest.union(left.select("row.*"))
