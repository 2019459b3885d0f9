"""End-to-end preparation of raw text rows, and remediation of image-and-text splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..checkpoint import cut
from ..functions.text import content_id, normalize_text
from ..operators.dedup import keep_first
from ..operators.leakage import overlaps, remediate
from ..operators.split import SplitConfig, split_rows
from ..operators.validate import classify_raw


class LeakageError(RuntimeError):
    """Splits share values after splitting."""


def prepare(raw: DataFrame, config: SplitConfig = SplitConfig()) -> DataFrame:
    """Validate, drop copies, split by group, and refuse to go on if any split shares an id or a normalised text."""
    valid = classify_raw(raw).where("status = 'valid'").select("row_idx", "text", "labels", "content_id")
    unique = keep_first(valid, "content_id")
    scored = unique.withColumn("toxicity", F.col("labels.toxicity"))
    done = cut(split_rows(scored, config).drop("toxicity"))
    shared = overlaps(done, {"id": F.col("content_id"), "text": normalize_text(F.col("text"))}, ("train", "validation", "test"))
    if not shared.isEmpty():
        raise LeakageError("splits share values")
    return done


def remediate_splits(rows: DataFrame) -> DataFrame:
    """All splits with leaked train rows left out; dev and test stay as they are."""
    kept, _ = remediate(rows)
    return kept.select(*rows.columns).unionByName(rows.where("split IN ('dev', 'test')"))


def dataset_version(name: Column, split: Column, n: Column) -> Column:
    """``name@split:0-n``."""
    return F.concat(name, F.lit("@"), split, F.lit(":0-"), n.cast("string"))


def with_ids(rows: DataFrame) -> DataFrame:
    """Rows with the id that follows from their text."""
    return rows.withColumn("content_id", content_id(F.col("text")))
