import hashlib
import json

import pytest

from modq.operators.split import SplitConfig
from modq.plans import config, manifest, ml
from modq.sources import readers, sinks
from modq.streaming.dedup import drop_copies

LABELS = ", ".join(f"{n}: double" for n in ("toxicity", "severe_toxicity", "obscene", "threat", "insult", "identity_attack", "sexual_explicit"))


def test_content_hash_ignores_order(spark):
    a = spark.createDataFrame([("b", "y"), ("a", "x")], "content_id string, text string")
    want = hashlib.sha256(b"a|x\nb|y").hexdigest()
    assert manifest.content_hash(a) == want == manifest.content_hash(a.repartition(3))
    assert manifest.content_hash(a.where("content_id = 'a'")) != want
    assert manifest.folded_hash(a).first() == manifest.folded_hash(a.repartition(2)).first()


def test_manifest(spark):
    rows = [(s, i, t, (0.9,) * 7) for s, i, t in (("train", "a", "x"), ("train", "b", "y"), ("validation", "c", "z"), ("test", "d", "w"))]
    out = manifest.build_manifest(spark.createDataFrame(rows, f"split string, content_id string, text string, labels struct<{LABELS}>"), {"dataset_name": "n"})
    assert len(out) == 12 and out["num_records"] == 4 and out["label_distribution_fraction_ge_0.5"]["threat"] == 1.0


def test_paged_reader_reads_ranges_and_stops():
    def fetch(url):
        at, n = map(int, url.split("/")[1:])
        return [{"text": str(k), **({"row_idx": 900} if k == 3 else {})} for k in range(at, min(at + n, 25))]

    reader = readers.PagedReader({"url": "x/{offset}/{length}", "rows": "40", "page": "10", "partitions": "2"}, fetch)
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert len(rows) == 25 and rows[3][0] == 900 and rows[4] == (4, json.dumps({"text": "4"}))


def test_json_lines_and_split_files(spark, tmp_path):
    (tmp_path / "train.jsonl").write_text('{"text": "a"}\n\n{"text": "b c"}\n', encoding="utf-8")
    assert readers.json_lines(spark, str(tmp_path / "train.jsonl")).count() == 2
    (tmp_path / "bad.jsonl").write_text("{broken\n")
    assert readers.json_lines(spark, str(tmp_path / "bad.jsonl"), strict=False).count() == 1
    with pytest.raises(Exception):
        readers.json_lines(spark, str(tmp_path / "bad.jsonl")).collect()
    from pyspark.sql.types import StructType

    got = readers.split_files(spark, str(tmp_path), StructType.fromDDL("text string")).collect()
    assert {r.split for r in got} == {"train"}


def test_blobs_and_target(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"123")
    assert readers.blobs(spark, str(tmp_path)).first().sha == hashlib.sha256(b"123").hexdigest()
    rows = spark.createDataFrame([(1, "a", "x", (0.1,) * 7, "v1"), (2, "b", "y", (0.2,) * 7, "v2")], f"row_idx long, content_id string, text string, labels struct<{LABELS}>, dataset_version string")
    assert {(r.id, r.score, r.dataset_version) for r in readers.load_target(rows, "insult").collect()} == {("a", 0.1, "v2"), ("b", 0.2, "v2")}


def test_writing_twice_needs_force(spark, tmp_path):
    df = spark.createDataFrame([("train", 1)], "split string, x int")
    sinks.write_splits(df, str(tmp_path / "out"))
    with pytest.raises(Exception):
        sinks.write_splits(df, str(tmp_path / "out"))
    sinks.write_splits(df, str(tmp_path / "out"), force=True)
    sinks.write_json({"b": 1, "a": "é"}, tmp_path / "r.json")
    assert (tmp_path / "r.json").read_text(encoding="utf-8").startswith('{\n  "a": "é"')


def test_settings(tmp_path):
    c = config.settings("terms", {"model_version": "v2", "tfidf": {"min_df": 1, "ngram_range": [1, 2]}})
    assert c["model_version"] == "v2" and c["tfidf.min_df"] == 1 and c["tfidf.ngram_range"] == (1, 2) and c["decision_threshold.selection_metric"] == "f1"
    for wrong in ({"nope": 1}, {"tfidf": {"min_df": 1.5}}, {"tfidf": {"sublinear_tf": "perhaps"}}):
        with pytest.raises(ValueError):
            config.settings("terms", wrong)
    (tmp_path / "run.yaml").write_text("log_level: DEBUG\n", encoding="utf-8")
    assert config.run_settings(str(tmp_path / "run.yaml"), {"MODQ_ENVIRONMENT": "staging"}) == {"log_level": "DEBUG", "environment": "staging"}
    with pytest.raises(ValueError):
        config.run_settings(None, {"MODQ_ENVIRONMENT": "moon"})
    assert SplitConfig().seed == 42


def test_model_learns_from_training_rows_only_and_survives_saving(spark, tmp_path):
    good, bad = "lovely calm day with tea", "awful stupid noise again today"
    train = spark.createDataFrame([(i, f"{bad if i % 2 else good}", i % 2) for i in range(12)], "id long, text string, y int")
    model = ml.fit(train)
    assert "unseen" not in dict(model.terms)
    docs = spark.createDataFrame([(1, "stupid noise"), (2, "calm tea"), (3, "unseen"), (4, None)], "id long, text string")
    got = {r.id: r for r in ml.predict(model, docs).collect()}
    assert got[1].label == 1 and got[2].label == 0 and all(0 <= r.probability <= 1 for r in got.values()) and len(got) == 4
    sinks.save_model(model, str(tmp_path), {"c": 1}, 0.42, spark)
    again, cfg, threshold = sinks.load_model(ml.TermModel, str(tmp_path), spark)
    assert threshold == 0.42 and cfg == {"c": 1}
    assert {r.id: round(r.probability, 9) for r in ml.predict(again, docs).collect()} == {k: round(r.probability, 9) for k, r in got.items()}


def test_stream_drops_copies(spark, tmp_path):
    from datetime import datetime

    rows = [(1, "a", datetime(2024, 1, 1)), (2, "a", datetime(2024, 1, 2)), (3, "b", datetime(2024, 1, 2))]
    df = spark.createDataFrame(rows, "row_idx long, text string, ingested_at timestamp")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = drop_copies(stream).writeStream.format("memory").queryName("kept").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.text for r in spark.sql("SELECT text FROM kept").collect()) == ["a", "b"]
