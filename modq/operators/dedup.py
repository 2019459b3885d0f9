"""Exact, normalised and multi-key duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoint import cut
from ..functions.text import normalize_text
from ..spread import spread


def keep_first(df: DataFrame, key: str, order: str = "row_idx") -> DataFrame:
    """First row per key in input order.

    The aggregate is combined before the shuffle, so a key that holds a third of all rows costs one row a task.  Rows
    without key are all kept.
    """
    firsts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias(order)).select(order)
    return df.join(firsts.unionByName(df.where(F.col(key).isNull()).select(order)), order, "left_semi")


def removed_duplicates(df: DataFrame, key: str, order: str = "row_idx") -> DataFrame:
    """``order, key, first``: rows dropped by ``keep_first`` with the row that stays."""
    firsts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("first_row"), F.count("*").alias("n")).where("n > 1")
    return df.select(order, key).join(firsts.select(key, "first_row"), key).where(F.col(order) != F.col("first_row"))


def greedy_keep(df: DataFrame, keys: tuple[str, str] = ("content_id", "text"), order: str = "row_idx") -> DataFrame:
    """Sequential first-wins over two keys: a row stays unless a row that stayed has its id or its text.

    Dropped rows block nothing.  Rounds give the sequential result in parallel: undecided rows that are first among the
    undecided of both their keys stay, all that share a key with them go, until none is left.  Null keys block nothing.
    """
    a, b = keys
    todo = cut(df.select(F.col(order).alias("o"), F.sha2(F.col(a).cast("string"), 256).alias("a"), F.sha2(F.col(b).cast("string"), 256).alias("b")))
    kept = None
    while not todo.isEmpty():
        first_a = todo.where("a IS NOT NULL").groupBy("a").agg(F.min("o").alias("fa"))
        first_b = todo.where("b IS NOT NULL").groupBy("b").agg(F.min("o").alias("fb"))
        ranked = todo.join(first_a, "a", "left").join(first_b, "b", "left")
        now = cut(ranked.where("o = coalesce(fa, o) AND o = coalesce(fb, o)").select("o", "a", "b"))
        kept = now.select("o") if kept is None else kept.unionByName(now.select("o"))
        rest = todo.join(now.select("o"), "o", "left_anti").join(now.select("a").where("a IS NOT NULL"), "a", "left_anti")
        todo = cut(rest.join(now.select("b").where("b IS NOT NULL"), "b", "left_anti"))
    if kept is None:
        return df
    return df.join(kept.withColumnRenamed("o", order), order, "left_semi")


def near_groups(df: DataFrame, text: str = "text") -> DataFrame:
    """Number of groups of equal normalised text and of the rows in them; empty normalised text is a group too."""
    sizes = spread(df.where(F.col(text).isNotNull()).select(text)).select(normalize_text(F.col(text)).alias("norm")).groupBy("norm").agg(F.count("*").alias("n")).where("n > 1")
    return sizes.agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("examples"))


def key_duplicates(df: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """``kind, value, n``: values of each key that occur more than once, in one pass."""
    flat = df.select(*[c.cast("string").alias(k) for k, c in keys.items()])
    pairs = ", ".join(f"'{k}', `{k}`" for k in keys)
    long = flat.select(F.expr(f"stack({len(keys)}, {pairs}) AS (kind, value)")).where("value IS NOT NULL")
    return long.groupBy("kind", "value").agg(F.count("*").alias("n")).where("n > 1")
