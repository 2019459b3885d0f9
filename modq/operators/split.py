"""Leakage-safe stratified splitting of groups."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoint import cut
from ..functions.text import normalize_text
from ..spread import spread
from .rank import rank_in_group


@dataclass(frozen=True)
class SplitConfig:
    train: float = 0.7
    validation: float = 0.15
    seed: int = 42

    def __post_init__(self) -> None:
        if not (0 < self.train < 1 and 0 < self.validation < 1 and self.train + self.validation < 1):
            raise ValueError("fractions must lie in (0, 1) and leave a share for test")


def _keyed(df: DataFrame, text: str, order: str) -> DataFrame:
    """The rows with ``group_key``: the normalised text, or a key of their own.

    Rows without text are left out before, as a filter on the key would be pushed down and compute it twice.
    """
    with_norm = spread(df).withColumn("group_key", normalize_text(F.col(text)))
    alone = F.concat(F.lit("__empty__"), F.col(order).cast("string"))
    return with_norm.withColumn("group_key", F.when(F.col("group_key") == "", alone).otherwise(F.col("group_key")))


def split_groups(df: DataFrame, config: SplitConfig = SplitConfig(), text: str = "text", score: str = "toxicity", order: str = "row_idx") -> DataFrame:
    """``group_key, stratum, split``: every group of equal normalised text in one split, each stratum in the given shares.

    Texts that normalise to nothing are groups of their own.  Membership follows a seeded hash of the group, so it does not depend
    on partitioning; a stratum's ranks are computed in buckets of that hash.
    """
    keyed = _keyed(df.where(F.col(text).isNotNull()), text, order).select("group_key", F.col(score).alias("s"))
    groups = keyed.groupBy("group_key").agg((F.coalesce(F.max("s"), F.lit(0.0)) >= 0.5).cast("int").alias("stratum"))
    hashed = groups.withColumn("h", F.sha2(F.concat_ws("|", "group_key", F.lit(str(config.seed))), 256))
    hashed = cut(hashed)  # read three times below
    groups = hashed
    ranked = rank_in_group(hashed, ["stratum"], F.left("h", F.lit(3)), [F.col("h"), F.col("group_key")])
    sizes = groups.groupBy("stratum").agg(F.count("*").alias("n"))  # two rows
    n = F.col("n")
    first = F.floor(n * config.train + 0.5)
    second = F.floor(n * (config.train + config.validation) + 0.5)
    name = F.when(F.col("rank") <= first, "train").when(F.col("rank") <= second, "validation").otherwise("test")
    return ranked.join(F.broadcast(sizes), "stratum").select("group_key", "stratum", name.alias("split"))


def split_rows(df: DataFrame, config: SplitConfig = SplitConfig(), text: str = "text", score: str = "toxicity", order: str = "row_idx") -> DataFrame:
    """The rows with their ``split``."""
    return _keyed(df, text, order).join(split_groups(df, config, text, score, order).select("group_key", "split"), "group_key").drop("group_key")
