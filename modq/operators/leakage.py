"""Leakage between splits, remediation and shift."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlaps(df: DataFrame, keys: dict[str, Column], splits: tuple[str, ...], split: str = "split") -> DataFrame:
    """``pair, kind, value``: distinct values that two splits share; pairs in the order of ``splits``.

    One aggregate per (kind, value) collects which splits have it, a set no larger than ``splits``; there is no self join.
    """
    flat = df.where(F.col(split).isin(*splits)).select(F.col(split).alias("s"), *[c.cast("string").alias(k) for k, c in keys.items()])
    pairs = ", ".join(f"'{k}', `{k}`" for k in keys)
    long = flat.select("s", F.expr(f"stack({len(keys)}, {pairs}) AS (kind, value)")).where("value IS NOT NULL AND value <> ''")
    sets = long.groupBy("kind", "value").agg(*[F.max((F.col("s") == s).cast("int")).alias(f"in_{k}") for k, s in enumerate(splits)])
    both = F.filter(
        F.array(*[F.when((F.col(f"in_{i}") == 1) & (F.col(f"in_{j}") == 1), F.lit(f"{splits[i]}<->{splits[j]}")) for i, j in combinations(range(len(splits)), 2)]),
        F.isnotnull,
    )
    return sets.select(F.explode(both).alias("pair"), "kind", "value")


def is_clean(found: DataFrame) -> DataFrame:
    """One row: whether no split shares anything."""
    return found.agg((F.count("*") == 0).alias("is_clean"), F.count("*").alias("n_overlaps"))


def banned_values(df: DataFrame, key: str, held_out: tuple[str, ...], split: str = "split") -> DataFrame:
    return df.where(F.col(split).isin(*held_out) & F.col(key).isNotNull()).select(key).distinct()


def remediate(df: DataFrame, key: str = "text", train: str = "train", held_out: tuple[str, ...] = ("dev", "test"), split: str = "split") -> tuple[DataFrame, DataFrame]:
    """Train rows that stay and train rows whose key occurs in a held-out split; the planner broadcasts a small side itself."""
    own, banned = df.where(F.col(split) == train), banned_values(df, key, held_out, split)
    return own.join(banned, key, "left_anti"), own.join(banned, key, "left_semi")


def remediation_counts(df: DataFrame, key: str = "text", train: str = "train", held_out: tuple[str, ...] = ("dev", "test"), split: str = "split") -> DataFrame:
    """One row: train rows before, removed, and left."""
    own, (kept, _) = df.where(F.col(split) == train), remediate(df, key, train, held_out, split)
    one = own.agg(F.count("*").alias("original")).crossJoin(F.broadcast(kept.agg(F.count("*").alias("final"))))  # one row each
    return one.select("original", (F.col("original") - F.col("final")).alias("removed"), "final")


def positive_rates(df: DataFrame, label: str = "hate_label", split: str = "split") -> DataFrame:
    return df.groupBy(split).agg(F.coalesce(F.avg(F.col(label).cast("double")), F.lit(0.0)).alias("positive_rate"), F.count("*").alias("n"))


def shift(df: DataFrame, label: str = "hate_label", split: str = "split") -> DataFrame:
    """Rates of positives per split, test minus train, and test over train (infinite where train has none)."""
    rate = {s: F.coalesce(F.avg(F.when(F.col(split) == s, F.col(label).cast("double"))), F.lit(0.0)).alias(s) for s in ("train", "dev", "test")}
    one = df.agg(*rate.values())
    return one.select(
        *[F.col(s).alias(f"{s}_positive_rate") for s in rate],
        (F.col("test") - F.col("train")).alias("absolute_difference"),
        F.when(F.col("train") != 0, F.col("test") / F.col("train")).otherwise(F.lit(float("inf"))).alias("relative_ratio"),
    )
