"""Extension: first-wins dropping of copies over a stream of deliveries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_id


def drop_copies(stream: DataFrame, time: str = "ingested_at", late: str = "7 days") -> DataFrame:
    """Rows whose text has not been seen within the watermark; state is dropped behind it."""
    return stream.withColumn("text_id", content_id(F.col("text"))).withWatermark(time, late).dropDuplicatesWithinWatermark(["text_id"])


def arrivals(stream: DataFrame, time: str = "ingested_at", window: str = "1 day", late: str = "7 days") -> DataFrame:
    """Rows per source and window, closed when the watermark has passed."""
    return stream.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), "source").agg(F.count("*").alias("n"))
