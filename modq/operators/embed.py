"""Embedding fusion and inputs with a modality left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fuse(text: DataFrame, image: DataFrame, key: str = "id") -> DataFrame:
    """Text embedding first, image embedding second, joined by id."""
    return text.join(image, key).select(key, F.concat("text_emb", "image_emb").alias("fused"))


def element_means(df: DataFrame, column: str) -> DataFrame:
    """``pos, mean`` of an array column by position; combined before the shuffle, one row per dimension after it."""
    return df.select(F.posexplode(column).alias("pos", "x")).groupBy("pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def mean_vector(df: DataFrame, column: str) -> DataFrame:
    """One row with the mean vector."""
    return element_means(df, column).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda s: s["mean"]).alias(f"{column}_mean"))


def without_modality(df: DataFrame, train: DataFrame, keep: str) -> DataFrame:
    """Inputs where the other half is the training mean, never zeros; ``keep`` is ``text`` or ``image``."""
    other = "image" if keep == "text" else "text"
    mean = F.broadcast(mean_vector(train, f"{other}_emb"))  # one row
    halves = {keep: F.transform(f"{keep}_emb", lambda x: x.cast("double")), other: F.col(f"{other}_emb_mean")}
    return df.crossJoin(mean).withColumn("fused", F.concat(halves["text"], halves["image"])).drop(f"{other}_emb_mean")


def positive_probability(logit0: Column, logit1: Column) -> Column:
    """Softmax of two logits, second class."""
    return 1 / (1 + F.exp(logit0 - logit1))


def masked_mean(tokens: Column, mask: Column) -> Column:
    """Mean of token vectors where the mask is 1 (at least 1e-9 of them)."""
    total = F.greatest(F.aggregate(mask, F.lit(0.0), lambda a, x: a + x.cast("double")), F.lit(1e-9))
    weighted = F.zip_with(tokens, mask, lambda v, m: F.transform(v, lambda x: x.cast("double") * m))
    zero = F.transform(tokens[0], lambda x: F.lit(0.0))
    return F.transform(F.aggregate(weighted, zero, lambda a, v: F.zip_with(a, v, lambda x, y: x + y)), lambda x: x / total)
