import random
import re
import unicodedata

from pyspark.sql import functions as F

from modq.functions import text


def plain(t):
    t = unicodedata.normalize("NFKC", t).lower().strip()
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", "", t)).strip()


def test_normalize_agrees_with_a_restatement(spark):
    rng = random.Random(3)
    pool = "aÀßéĳﬁＡｂ１٣ ​ \xa0\t\n.,!?'_-كابتİΣσςñ½²ﻻ٪😀"
    texts = ["Hello, World!!", "!!!", "", " x "] + ["".join(rng.choice(pool) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").repartition(5)
    got = {r.i: r.n for r in rows.select("i", text.normalize_text(F.col("t")).alias("n")).collect()}
    assert {i: plain(t) for i, t in enumerate(texts)} == got


def test_nulls_stay_null(spark):
    rows = spark.createDataFrame([(None,)], "t string")
    assert rows.select(text.normalize_text(F.col("t")), text.content_id(F.col("t")), text.excerpt(F.col("t"))).first() == (None, None, None)


def test_check_text(spark):
    cases = [("مرحبا", (True, True, False, True, None)), ("   ", (True, False, False, False, "empty")), (None, (False, False, False, False, "missing")),
             ("a�b", (True, True, True, False, None)), ("hello", (True, True, False, False, None))]
    rows = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string")
    got = {r.i: tuple(r.c) for r in rows.select("i", text.check_text(F.col("t")).alias("c")).collect()}
    assert got == {i: c[1] for i, c in enumerate(cases)}


def test_excerpt_is_short_and_on_one_line(spark):
    rows = spark.createDataFrame([("x" * 500,), (" a\nb ",)], "t string")
    long, short = (r[0] for r in rows.select(text.excerpt(F.col("t"))).collect())
    assert len(long) <= 103 and long.endswith("...") and short == "a b"
