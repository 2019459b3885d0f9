"""Use all cores on small inputs without shuffling large ones."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from .ship import ship

_SHUFFLES = re.compile(r"\b(Join|Aggregate|Sort|Window|Repartition\w*|RebalancePartitions|Distinct|Deduplicate|GlobalLimit|Intersect|Except)\b")


def spread(df: DataFrame, per_core: int = 1) -> DataFrame:
    """Repartition only when a scan gives fewer partitions than there are cores (small files).

    At scale the scan already has enough splits and nothing is shuffled.  Frames with a shuffle of their own are left alone: asking
    for their partitions would run it.
    """
    ship(df.sparkSession)
    if _SHUFFLES.search(df._jdf.queryExecution().optimizedPlan().toString()):
        return df
    want = df.sparkSession.sparkContext.defaultParallelism * per_core
    return df.repartition(want) if df._jdf.queryExecution().toRdd().getNumPartitions() < want else df
