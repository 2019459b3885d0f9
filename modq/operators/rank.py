"""Ranks and running sums that need no group in one task."""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_in_group(df: DataFrame, group: list[str], bucket: Column, order: list[Column], name: str = "rank") -> DataFrame:
    """Row number within ``group`` by (bucket, order): rows are ranked within buckets, buckets are offset by their counts.

    ``bucket`` must grow with the order and have a bounded number of values; only its counts meet per group.
    """
    b = "__bucket"
    rows = df.withColumn(b, bucket)
    before = Window.partitionBy(*group).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy(*group, b).agg(F.count("*").alias("__n"))
    offsets = counts.select(*group, b, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    inside = rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*group, b).orderBy(*order)))
    keys = [*group, b]
    joined = inside.join(offsets.withColumnsRenamed({k: f"__o_{k}" for k in keys}), [inside[k].eqNullSafe(F.col(f"__o_{k}")) for k in keys])
    return joined.select(*df.columns, (F.col("__rn") + F.col("__offset")).alias(name))


def running_sums(df: DataFrame, score: str, sums: list[str], buckets: int = 1024) -> DataFrame:
    """Sums of ``sums`` over all rows with at least the row's ``score``, by buckets of about equal numbers of distinct scores.

    Bucket bounds are approximate quantiles, so crowded scores spread over buckets; any bounds give the same sums.
    """
    b = "__bucket"
    at = [k / buckets for k in range(1, buckets)]
    bounds = sorted(set(df.select(score).approxQuantile(score, at, 0.25 / buckets)))  # at most ``buckets``
    bucketed = Bucketizer(splits=[float("-inf"), *bounds, float("inf")], inputCol=score, outputCol=b, handleInvalid="keep") if bounds else None
    rows = bucketed.transform(df) if bucketed else df.withColumn(b, F.lit(0.0))
    after = Window.orderBy(F.desc(b)).rowsBetween(Window.unboundedPreceding, -1)  # at most ``buckets`` rows
    totals = rows.groupBy(b).agg(*[F.sum(c).alias(c) for c in sums])
    above = totals.select(b, *[F.coalesce(F.sum(c).over(after), F.lit(0)).alias(f"__above_{c}") for c in sums])
    inside = Window.partitionBy(b).orderBy(F.desc(score)).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    own = rows.withColumns({f"__in_{c}": F.sum(c).over(inside) for c in sums}).join(above, b)
    return own.select(*df.columns, *[(F.col(f"__in_{c}") + F.col(f"__above_{c}")).alias(f"cum_{c}") for c in sums])


def exact_quantiles(df: DataFrame, column: str, fractions: tuple[float, ...]) -> DataFrame:
    """One row ``q0, q1, ...``: exact quantiles with linear interpolation, without all values in one task.

    Values are counted, counts are summed by ``running_sums``, and only the values at the wanted ranks are kept.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("v")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    ranked = running_sums(counts, "v", ["n"]).crossJoin(F.broadcast(total))  # one row
    first, past = F.col("total") - F.col("cum_n"), F.col("total") - F.col("cum_n") + F.col("n")
    out = []
    for k, q in enumerate(fractions):
        rank = F.lit(q) * (F.col("total") - 1)
        low, high = F.floor(rank), F.ceil(rank)
        out += [F.max(F.when((first <= low) & (low < past), F.col("v"))).alias(f"low{k}"), F.max(F.when((first <= high) & (high < past), F.col("v"))).alias(f"high{k}"), F.max(rank - low).alias(f"part{k}")]
    one = ranked.agg(*out)
    return one.select(*[(F.col(f"low{k}") + (F.col(f"high{k}") - F.col(f"low{k}")) * F.col(f"part{k}")).alias(f"q{k}") for k in range(len(fractions))])
