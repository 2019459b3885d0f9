"""Error analysis, complementarity, percentiles (T1k-T3k, A20, A21)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rank import exact_quantiles

# fixed values: names of the reported outcomes
OUTCOMES = (
    "text_wrong_image_wrong_fusion_correct", "text_correct_image_wrong_fusion_wrong", "image_correct_text_wrong_fusion_wrong",
    "all_three_correct", "all_three_wrong",
)


def worst_errors(df: DataFrame, k: int = 5, threshold: float = 0.5, y: str = "y_true", p: str = "y_prob", order: str = "row_idx") -> DataFrame:
    """The ``k`` most certain false positives and false negatives; ties in input order.

    Each kind is a top-k of its own, which keeps k rows a task instead of ranking all errors in one.
    """
    def top(kind: str, wrong, by) -> DataFrame:
        return df.where(wrong).orderBy(by, F.asc(order)).limit(k).withColumn("kind", F.lit(kind))

    hit = F.col(p) >= threshold
    return top("false_positive", (F.col(y) == 0) & hit, F.desc(p)).unionByName(top("false_negative", (F.col(y) == 1) & ~hit, F.asc(p)))


def with_outcome(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Rows with ``outcome``: which of the three models are right, null for the three combinations not reported."""
    right = {m: (F.col(f"{m}_p") >= threshold).cast("int") == F.col("y_true") for m in ("text", "image", "fusion")}
    t, i, f = right["text"], right["image"], right["fusion"]
    outcome = (
        F.when(~t & ~i & f, OUTCOMES[0]).when(t & ~i & ~f, OUTCOMES[1]).when(i & ~t & ~f, OUTCOMES[2]).when(t & i & f, OUTCOMES[3]).when(~t & ~i & ~f, OUTCOMES[4])
    )
    scored = df.where("y_true IS NOT NULL AND text_p IS NOT NULL AND image_p IS NOT NULL AND fusion_p IS NOT NULL")
    return scored.withColumn("outcome", outcome).withColumns({f"{m}_right": c.cast("int") for m, c in right.items()})


def complementarity(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row: how many rows each outcome has, and each model's accuracy (0 without rows)."""
    rows = with_outcome(df, threshold)
    return rows.agg(
        F.count("*").alias("n"), *[F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES],
        *[F.coalesce(F.avg(f"{m}_right"), F.lit(0.0)).alias(f"{m}_accuracy") for m in ("text", "image", "fusion")],
    )


def outcome_rows(df: DataFrame, threshold: float = 0.5, order: str = "row_idx") -> DataFrame:
    """``order, outcome``: the rows of the outcomes in which the models differ."""
    return with_outcome(df, threshold).where(F.col("outcome").isin(*OUTCOMES[:3])).select(order, "outcome")


def latency_summary(df: DataFrame, column: str) -> DataFrame:
    """Percentiles with linear interpolation, mean and throughput per second for times in milliseconds."""
    rows = df.where(F.col(column).isNotNull())
    mean = rows.agg(F.avg(column).alias("mean"), F.when(F.avg(column) != 0, 1000 / F.avg(column)).alias("per_second"), F.count(column).alias("n"))
    return exact_quantiles(rows, column, (0.5, 0.95, 0.99)).withColumnsRenamed({"q0": "p50", "q1": "p95", "q2": "p99"}).crossJoin(F.broadcast(mean))  # one row each
