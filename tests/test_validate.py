import json
from functools import reduce

import pytest
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modq import catalogue
from modq.functions import schema
from modq.functions.images import jpeg_size
from modq.operators import validate
from modq.plans.prepare import prepare

SCORES = dict.fromkeys(schema.LABELS, 0.1)


def raw(spark, *rows):
    return spark.createDataFrame([(i, r if isinstance(r, str) or r is None else json.dumps(r)) for i, r in enumerate(rows)], "row_idx long, payload string")


def status(spark, *rows):
    return [r.status for r in validate.classify_raw(raw(spark, *rows)).orderBy("row_idx").collect()]


def test_classes_of_raw_rows(spark):
    good = {"text": "fine", **SCORES}
    missing = {k: v for k, v in good.items() if k != "threat"}
    assert status(spark, good, {**good, "extra": 1}, missing, {**good, "toxicity": 2.0}, good) == ["valid", "valid", "malformed", "invalid", "valid"]
    assert status(spark, {**good, "toxicity": "not-a-number"}, {**good, "toxicity": "0.5"}, {**good, "toxicity": "nan"}, {**good, "toxicity": True}) == ["malformed", "valid", "invalid", "valid"]
    assert status(spark, {**good, "toxicity": "1.0d"}, {**good, "toxicity": "1_0"}, {**good, "toxicity": None}) == ["malformed", "invalid", "malformed"]
    assert status(spark, {**good, "text": "   "}, {**good, "text": 5}, "{broken", "[1]", None) == ["invalid", "malformed", "malformed", "malformed", "malformed"]


def test_every_missing_field_is_named_in_order(spark):
    row = validate.classify_raw(raw(spark, {"toxicity": 0.1})).first()
    assert row.reasons == [f"missing field: {f}" for f in schema.RAW_FIELDS if f != "toxicity"]


def test_counts_and_first_examples(spark):
    rows = raw(spark, *(["{"] * 25), {"text": "a", **SCORES})
    c = validate.classify_raw(rows.repartition(7))
    assert validate.status_counts(c).first().asDict() == {"total_rows": 26, "valid_rows": 1, "malformed_rows": 25, "invalid_rows": 0}
    assert [r.row_idx for r in validate.first_examples(c, "malformed").collect()] == list(range(20))


def test_distribution_of_nothing_is_zero(spark):
    rows = spark.createDataFrame([], "labels struct<" + ", ".join(f"{n}: double" for n in schema.LABELS) + ">")
    assert {(r.mean, r.fraction_ge_half) for r in validate.label_distribution(rows).collect()} == {(0.0, 0.0)}


def multimodal(spark, **changes):
    row = {"example_id": "t1", "text": "نص", "image_path": "a.jpg", "source_img_path": "x/a.jpg", "hate_label": 0, "prop_label": 1, "hate_fine_grained_label": 4, "split": "train", "dataset_version": "v1", **changes}
    return spark.createDataFrame([row], "example_id string, text string, image_path string, source_img_path string, hate_label int, prop_label int, hate_fine_grained_label int, split string, dataset_version string")


@pytest.mark.parametrize("changes, good", [({}, True), ({"hate_label": 2}, False), ({"hate_fine_grained_label": 99}, False), ({"split": "validation"}, False), ({"text": " "}, False), ({"hate_label": None}, False)])
def test_multimodal_contract(spark, changes, good):
    assert multimodal(spark, **changes).select(schema.valid_multimodal()).first()[0] is good


def test_label_names(spark):
    name = schema.label_name(F.lit(4), schema.FINE_NAMES), schema.label_name(F.lit(10), schema.FINE_NAMES)
    assert spark.range(1).select(*name).first() == ("other", None)


def test_missing_picture_does_not_make_a_row_invalid(spark):
    blobs = spark.createDataFrame([], "path string, content binary")
    row = validate.multimodal_report(multimodal(spark), blobs).where("split_name = 'train'").first()
    assert (row.valid_rows, row.images_missing, row.malformed_rows) == (1, 1, 0)


def test_registered_picture_counts(spark, tmp_path):
    head = bytearray(b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x04\x00\x08\x03")
    rows = [multimodal(spark, image_path=x) for x in ("a.jpg", "a.jpg", "b.jpg", "none.jpg")] + [multimodal(spark, image_path="b.jpg", text=" ")]
    reduce(DataFrame.unionByName, rows).write.parquet(f"{tmp_path}/multimodal_examples.parquet")
    blobs = spark.createDataFrame([("a.jpg", head), ("b.jpg", bytearray(b"garbage"))], "path string, content binary")
    blobs.write.parquet(f"{tmp_path}/image_blobs.parquet")
    report = catalogue.QUERIES["multimodal_report"](spark, str(tmp_path))
    got = {tuple(r) for r in report.select("split_name", "valid_rows", "images_ok", "images_corrupted", "images_missing").collect()}
    assert got == {("train", 4, 2, 1, 1), (None, 4, 2, 1, 1)}


def test_jpeg_header():
    head = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08\x00\x04\x00\x08\x03"
    assert jpeg_size(head) == (8, 4)
    assert jpeg_size(b"garbage") is None and jpeg_size(None) is None and jpeg_size(b"\xff\xd8\xff") is None


def test_prepare_end_to_end(spark):
    texts = [f"text number {i}" for i in range(40)]
    rows = [{"text": t, **SCORES, "toxicity": 0.9 if i % 2 else 0.1} for i, t in enumerate(texts)]
    out = prepare(raw(spark, *rows, rows[0]))
    assert out.count() == 40
    sizes = {r.split: r.n for r in out.groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert sizes["train"] == 28 and abs(sizes["validation"] - 6) <= 1 and abs(sizes["test"] - 6) <= 1
