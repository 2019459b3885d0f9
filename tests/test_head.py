import numpy as np
from pyspark.sql import functions as F

from modq.operators.analysis import latency_summary
from modq.plans import head


def data(n=400, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, 6))
    return x, (x[:, 0] * x[:, 1] > 0).astype(np.int64)


def test_head_learns_what_a_line_cannot_and_is_deterministic():
    (x, y), (dx, dy) = data(), data(200, 1)
    config = head.HeadConfig(hidden=32, rate=0.01, dropout=0.0)
    a, b = head.train_head(x, y, dx, dy, config), head.train_head(x, y, dx, dy, config)
    assert head.f1(dy, a.probability(dx)) > 0.85 and np.array_equal(a.w1, b.w1)
    assert a.parameters() == 6 * 32 + 32 + 32 * 2 + 2


def test_metric_that_is_never_better_returns_the_start():
    x, y = data(50)
    config = head.HeadConfig(hidden=4, epochs=3)
    got = head.train_head(x, y, x, y, config, metric=lambda *_: float("nan"))
    assert np.array_equal(got.w1, head.Head.new(6, config).w1)


def test_scores_do_not_depend_on_batches_and_keep_nulls(spark):
    x, y = data(60)
    model = head.Head.new(6, head.HeadConfig(hidden=4))
    df = spark.createDataFrame([(i, v.tolist(), int(t)) for i, (v, t) in enumerate(zip(x, y))] + [(999, None, 1)], "id long, fused array<double>, y int")
    one = {r.id: r.probability for r in head.score(df.coalesce(1), model).collect()}
    many = {r.id: r.probability for r in head.score(df.repartition(9), model).collect()}
    assert one == many and one[999] is None
    assert np.allclose([one[i] for i in range(60)], model.probability(x))
    got, labels = head.collect_rows(df, "fused", "y", most=10)
    again, _ = head.collect_rows(df.repartition(7), "fused", "y", most=10)
    assert 0 < len(got) == len(labels) <= 10 and np.array_equal(got, again)


def test_encoder_sees_only_its_column(spark):
    df = spark.createDataFrame([(1, "ab", "secret"), (2, "c", "secret")], "id long, text string, image_path string")
    out = head.encode(df, "text", lambda batch: [[float(len(t))] for t in batch], "emb")
    assert {r.id: r.emb for r in out.select("id", "emb").collect()} == {1: [2.0], 2: [1.0]}


def test_timings(spark):
    row = latency_summary(head.timings(spark, lambda: None, runs=5, warm=1), "ms").first()
    assert row.n == 5 and row.p50 >= 0 and F is not None
