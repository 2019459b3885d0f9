import math
import random

import pytest

from modq.operators import analysis, embed, metrics

_RNG = random.Random(11)
Y = [int(_RNG.random() < 0.4) for _ in range(37)]
P = [round(min(1.0, max(0.0, 0.25 + 0.4 * y + _RNG.gauss(0, 0.25))), 3) for y in Y]


def frame(spark, y, p):
    return spark.createDataFrame([(i, *v) for i, v in enumerate(zip(y, p))], "row_idx long, y_true int, y_prob double").repartition(3)


def average_precision(y, p):
    total, pos, prev = 0.0, sum(y), 0.0
    for t in sorted(set(p), reverse=True):
        tp = sum(a for a, b in zip(y, p) if b >= t)
        n = sum(b >= t for b in p)
        total += (tp / pos - prev) * tp / n
        prev = tp / pos
    return total


def roc(y, p):
    pairs = [(a > b) + 0.5 * (a == b) for a, i in zip(p, y) if i for b, j in zip(p, y) if not j]
    return sum(pairs) / len(pairs)


def test_areas(spark):
    row = metrics.areas(frame(spark, Y, P)).first()
    assert row.pr_auc == pytest.approx(average_precision(Y, P)) and row.roc_auc == pytest.approx(roc(Y, P))


def test_areas_with_ties_agree_with_brute_force(spark):
    rng = random.Random(2)
    y = [rng.randint(0, 1) for _ in range(200)]
    p = [rng.choice([0.0, 0.1, 0.25, 0.5, 0.7, 1.0, rng.random()]) for _ in y]
    row = metrics.areas(frame(spark, y, p)).first()
    assert row.pr_auc == pytest.approx(average_precision(y, p)) and row.roc_auc == pytest.approx(roc(y, p))


def test_one_class(spark):
    df = frame(spark, [0, 0], [0.1, 0.2])
    row = metrics.threshold_metrics(df, (0.5,)).first()
    assert row.false_positive_rate == 0.0 and row.f1 == 0.0 and row.macro_f1 == 1.0
    assert math.isnan(metrics.areas(df).first().pr_auc)


def test_empty(spark):
    df = frame(spark, Y, P).where("false")
    assert metrics.threshold_metrics(df, (0.5,)).first().n == 0
    assert math.isnan(metrics.areas(df).first().roc_auc)


def test_ties_take_the_smaller_threshold(spark):
    sweep = spark.createDataFrame([(0.75, 0.41), (0.25, 0.66), (0.5, 0.2), (0.45, 0.66)], "threshold double, f1 double")
    assert metrics.select_threshold(sweep).first().threshold == 0.25


def test_class_weights(spark):
    row = metrics.class_weights(spark.createDataFrame([(0,)] * 30 + [(1,)] * 10, "y_true int")).first()
    assert row.weight_0 == pytest.approx(40 / 60) and row.weight_1 == pytest.approx(2.0)


def test_worst_errors(spark):
    rows = [("c0", 0), ("c1", 1)]
    df = frame(spark, [0, 1, 0, 1], [0.9, 0.1, 0.05, 0.05])
    got = [(r.kind, r.row_idx) for r in analysis.worst_errors(df).collect()]
    assert got == [("false_positive", 0), ("false_negative", 3), ("false_negative", 1)] and rows


def test_complementarity(spark):
    cols = "row_idx long, y_true int, text_p double, image_p double, fusion_p double"
    data = [(0, 1, 0.1, 0.1, 0.9), (1, 1, 0.9, 0.1, 0.1), (2, 1, 0.1, 0.9, 0.1), (3, 1, 0.9, 0.9, 0.9), (4, 1, 0.1, 0.1, 0.1)]
    row = analysis.complementarity(spark.createDataFrame(data, cols)).first()
    assert [row[o] for o in analysis.OUTCOMES] == [1] * 5 and row.text_accuracy == pytest.approx(0.4)
    empty = analysis.complementarity(spark.createDataFrame([], cols)).first()
    assert empty.n == 0 and empty.text_accuracy == 0.0


def test_comparison_with_a_zero_baseline(spark):
    a = spark.createDataFrame([(0.0, 0.5)], "f1 double, recall double")
    b = spark.createDataFrame([(0.2, 0.25)], "f1 double, recall double")
    got = {r.metric: r for r in metrics.compare(a, b, ("f1", "recall")).collect()}
    assert math.isnan(got["f1"].relative) and got["recall"].relative == pytest.approx(-0.5)


def test_latency(spark):
    row = analysis.latency_summary(spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4)], "ms double"), "ms").first()
    assert row.p50 == 2.5 and row.per_second == pytest.approx(400)


def test_embeddings(spark):
    train = spark.createDataFrame([(1, [1.0, 2.0], [10.0]), (2, [3.0, 4.0], [20.0])], "id long, text_emb array<float>, image_emb array<float>")
    assert embed.mean_vector(train, "text_emb").first()[0] == [2.0, 3.0]
    fused = {r.id: r.fused for r in embed.fuse(train.select("id", "text_emb"), train.select("id", "image_emb")).collect()}
    assert fused[1] == [1.0, 2.0, 10.0]
    assert [r.fused for r in embed.without_modality(train, train, "image").orderBy("id").collect()] == [[2.0, 3.0, 10.0], [2.0, 3.0, 20.0]]
    assert [r.fused for r in embed.without_modality(train, train, "text").orderBy("id").collect()][0] == [1.0, 2.0, 15.0]
    pooled = spark.sql("SELECT array(array(1D, 2D), array(3D, 4D), array(9D, 9D)) AS t, array(1, 1, 0) AS m").select(embed.masked_mean(*map(__import__("pyspark").sql.functions.col, ("t", "m"))))
    assert pooled.first()[0] == [2.0, 3.0]
