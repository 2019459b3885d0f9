"""Bounded samples by a seeded hash."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE = 1 << 40


def bounded_sample(df: DataFrame, key: str, rows: int, seed: int) -> DataFrame:
    """About ``rows`` rows, the same ones in any partitioning: those whose seeded hash of ``key`` is small enough.

    One count sets the bound, so nothing is sorted and no task or driver gets more than its share; all rows where there are
    no more than ``rows``.
    """
    n = df.count()
    if n <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(SCALE)) < int(SCALE * rows / n))
