"""Classifier metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rank import running_sums

# fixed values: swept thresholds and names of metrics in reports
THRESHOLDS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
NAMES = ("accuracy", "precision", "recall", "f1", "macro_f1", "false_positive_rate", "false_negative_rate", "positive_prediction_rate")


def at_least(score: Column, threshold: float | Column) -> Column:
    return (score >= threshold).cast("int")


def _over(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / b).otherwise(0.0)


def _f1(tp: Column, fp: Column, fn: Column) -> Column:
    return _over(2.0 * tp, 2 * tp + fp + fn)


def threshold_metrics(df: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS, y: str = "y_true", p: str = "y_prob") -> DataFrame:
    """Confusion counts and metrics per threshold, all from one pass over the rows; a zero denominator gives 0."""
    rows = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    counts = []
    for k, t in enumerate(thresholds):
        hit, pos = F.col(p) >= F.lit(float(t)), F.col(y) == 1
        counts += [F.count_if(hit & pos).alias(f"tp{k}"), F.count_if(hit & ~pos).alias(f"fp{k}")]
    one = rows.agg(F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg"), *counts)
    pieces = ", ".join(f"{float(t)!r}D, tp{k}, fp{k}" for k, t in enumerate(thresholds))
    long = one.select("pos", "neg", F.expr(f"stack({len(thresholds)}, {pieces}) AS (threshold, tp, fp)"))
    tp, fp, fn, tn, n = F.col("tp"), F.col("fp"), F.col("pos") - F.col("tp"), F.col("neg") - F.col("fp"), F.col("pos") + F.col("neg")
    has_pos, has_neg = (F.col("pos") + fp > 0), (F.col("neg") + fn > 0)  # labels present in truth or prediction
    macro = _over(F.when(has_pos, _f1(tp, fp, fn)).otherwise(0.0) + F.when(has_neg, _f1(tn, fn, fp)).otherwise(0.0), has_pos.cast("int") + has_neg.cast("int"))
    return long.select(
        "threshold", tn.alias("true_negative"), fp.alias("false_positive"), fn.alias("false_negative"), tp.alias("true_positive"), n.alias("n"),
        _over(tp + tn, n).alias("accuracy"), _over(tp, tp + fp).alias("precision"), _over(tp, F.col("pos")).alias("recall"), _f1(tp, fp, fn).alias("f1"),
        macro.alias("macro_f1"), _over(fp, F.col("neg")).alias("false_positive_rate"), _over(fn, F.col("pos")).alias("false_negative_rate"),
        _over(tp + fp, n).alias("positive_prediction_rate"),
    )


def select_threshold(sweep: DataFrame, metric: str = "f1") -> DataFrame:
    """The threshold with the highest metric; the smallest of equal ones."""
    return sweep.agg(F.max(F.struct(F.col(metric), -F.col("threshold"))).alias("best")).select((-F.col("best.col2")).alias("threshold"), F.col(f"best.{metric}").alias(metric))


def curve(df: DataFrame, y: str = "y_true", p: str = "y_prob") -> DataFrame:
    """``score, tp, fp, cum_tp, cum_fp``: one point per distinct score, so that ties share a step."""
    rows = df.where(F.col(y).isNotNull() & F.col(p).isNotNull())
    steps = rows.groupBy(F.col(p).alias("score")).agg(F.count_if(F.col(y) == 1).alias("tp"), F.count_if(F.col(y) != 1).alias("fp"))
    return running_sums(steps, "score", ["tp", "fp"])


def precision_recall_points(df: DataFrame, y: str = "y_true", p: str = "y_prob") -> DataFrame:
    points = curve(df, y, p)
    pos = points.agg(F.sum("tp").alias("pos"))
    return points.crossJoin(F.broadcast(pos)).select("score", (F.col("cum_tp") / (F.col("cum_tp") + F.col("cum_fp"))).alias("precision"), _over(F.col("cum_tp"), F.col("pos")).alias("recall"))


def areas(df: DataFrame, y: str = "y_true", p: str = "y_prob") -> DataFrame:
    """``pr_auc`` (step sum over distinct scores) and ``roc_auc`` (with half credit for ties); NaN with one class only."""
    c = curve(df, y, p)
    tp, fp, ctp, cfp = (F.col(x).cast("double") for x in ("tp", "fp", "cum_tp", "cum_fp"))
    one = c.agg(
        F.sum(tp).alias("pos"), F.sum(fp).alias("neg"), F.sum(tp * ctp / (ctp + cfp)).alias("step"), F.sum(fp * (ctp - tp / 2)).alias("below"),
    )
    both = (F.col("pos") > 0) & (F.col("neg") > 0)
    nan = F.lit(float("nan"))
    return one.select(F.when(both, F.col("step") / F.col("pos")).otherwise(nan).alias("pr_auc"), F.when(both, F.col("below") / (F.col("pos") * F.col("neg"))).otherwise(nan).alias("roc_auc"))


def class_weights(df: DataFrame, y: str = "y_true") -> DataFrame:
    """``total / (2 * count)`` per class."""
    one = df.where(F.col(y).isNotNull()).agg(F.count_if(F.col(y) == 0).alias("n0"), F.count_if(F.col(y) == 1).alias("n1"))
    total = F.col("n0") + F.col("n1")
    return one.select(*[(total / (2 * F.greatest(F.col(f"n{k}"), F.lit(1)))).alias(f"weight_{k}") for k in (0, 1)])


def compare(baseline: DataFrame, candidate: DataFrame, names: tuple[str, ...] = NAMES) -> DataFrame:
    """``metric, baseline, candidate, absolute, relative`` of two one-row metric tables; NaN relative where the baseline is 0."""
    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.expr(f"stack({len(names)}, " + ", ".join(f"'{m}', CAST({m} AS DOUBLE)" for m in names) + f") AS (metric, {name})"))

    a, b = F.col("baseline"), F.col("candidate")
    return long(baseline, "baseline").join(long(candidate, "candidate"), "metric").select(
        "metric", "baseline", "candidate", (b - a).alias("absolute"), F.when(a != 0, (b - a) / a).otherwise(F.lit(float("nan"))).alias("relative")
    )
