import random

import pytest
from pyspark.sql import functions as F

from modq.functions.text import normalize_text
from modq.operators import dedup, leakage, split


def greedy(rows):
    ids, texts, kept = set(), set(), []
    for k, i, t in rows:
        if (i is not None and i in ids) or (t is not None and t in texts):
            continue
        kept.append(k)
        ids.add(i), texts.add(t)
    return kept


def test_greedy_keeps_what_a_sequential_pass_keeps(spark):
    rng = random.Random(5)
    for n in (0, 1, 3, 60):
        rows = [(k, rng.choice(["a", "b", "c", "d", None]) and f"i{rng.randint(0, 25)}", f"t{rng.randint(0, 25)}") for k in range(n)]
        df = spark.createDataFrame(rows, "row_idx long, content_id string, text string").repartition(3)
        assert sorted(r.row_idx for r in dedup.greedy_keep(df).collect()) == greedy(rows)
    rows = [(1, "i1", "t1"), (2, "i2", "t1"), (3, "i2", "t2")]
    df = spark.createDataFrame(rows, "row_idx long, content_id string, text string")
    assert sorted(r.row_idx for r in dedup.greedy_keep(df).collect()) == [1, 3]


def test_keep_first_and_removed(spark):
    df = spark.createDataFrame([(2, "a"), (1, "a"), (3, "b"), (4, None), (5, None)], "row_idx long, k string")
    assert sorted(r.row_idx for r in dedup.keep_first(df, "k").collect()) == [1, 3, 4, 5]
    assert [tuple(r) for r in dedup.removed_duplicates(df, "k").select("row_idx", "first_row").collect()] == [(2, 1)]


def test_near_groups_count_empty_normalised_text(spark):
    df = spark.createDataFrame([("Hello, World!!",), ("hello world",), ("!!!",), ("???",), (None,)], "text string")
    assert tuple(dedup.near_groups(df).first()) == (2, 4)


def test_key_duplicates(spark):
    df = spark.createDataFrame([("1", "cap", "h1"), ("2", "cap", "h2"), ("3", "x", "h2"), ("3", "x", "h2")], "i string, t string, h string")
    got = dedup.key_duplicates(df, {"id": F.col("i"), "text": F.col("t"), "hash": F.col("h"), "pair": F.concat_ws("|", "t", "h")})
    assert {(r.kind, r.value, r.n) for r in got.collect()} == {("id", "3", 2), ("text", "cap", 2), ("text", "x", 2), ("hash", "h2", 3), ("pair", "x|h2", 2)}


def rows(spark, *r):
    return spark.createDataFrame(list(r), "split string, content_id string, text string")


def test_leakage_by_id_and_text(spark):
    df = rows(spark, ("train", "a", "Hello, World!!"), ("test", "b", "hello world"), ("validation", "a", "other"), ("train", "c", "!!!"), ("test", "d", "???"))
    got = leakage.overlaps(df, {"id": F.col("content_id"), "text": normalize_text(F.col("text"))}, ("train", "validation", "test"))
    assert {(r.pair, r.kind, r.value) for r in got.collect()} == {("train<->validation", "id", "a"), ("train<->test", "text", "hello world")}
    assert leakage.is_clean(got).first().is_clean is False
    assert leakage.is_clean(got.where("false")).first().is_clean is True


def test_remediation(spark):
    df = rows(spark, ("train", "t1", "leaked"), ("train", "t2", "clean"), ("dev", "d1", "leaked"), ("train", "t3", None))
    kept, removed = leakage.remediate(df)
    assert sorted(r.content_id for r in kept.collect()) == ["t2", "t3"] and [r.content_id for r in removed.collect()] == ["t1"]


def test_shift(spark):
    df = spark.createDataFrame([(s, int(i < n)) for s, n in (("train", 10), ("dev", 10), ("test", 25)) for i in range(100)], "split string, hate_label int")
    row = leakage.shift(df).first()
    assert row.absolute_difference == pytest.approx(0.15) and row.relative_ratio == pytest.approx(2.5)
    assert leakage.shift(df.where("split = 'test'")).first().relative_ratio == float("inf")


def test_split_is_grouped_stratified_and_independent_of_partitions(spark):
    data = [(i, f"text {i}", 0.9 if i % 2 else 0.1) for i in range(40)] + [(100, "TEXT 3!", 0.9), (101, "!!!", 0.1), (102, "??", None)]
    df = spark.createDataFrame(data, "row_idx long, text string, toxicity double")
    a = {r.group_key: (r.stratum, r.split) for r in split.split_groups(df).collect()}
    b = {r.group_key: (r.stratum, r.split) for r in split.split_groups(df.repartition(9)).collect()}
    assert a == b and len(a) == 42
    per_row = split.split_rows(df).where("row_idx IN (3, 100)").select("split").distinct()
    assert per_row.count() == 1
    train = [s for s, name in a.values() if name == "train"]
    assert abs(sum(train) / len(train) - 0.5) < 0.15


def test_split_config_is_checked():
    with pytest.raises(ValueError):
        split.SplitConfig(train=0.9, validation=0.2)
