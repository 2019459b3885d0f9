"""Plans read only what they need, push filters to the scan and pair no table with itself row by row."""

import re
from pathlib import Path

import pytest

from modq import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


def plan(df) -> str:
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def columns_read(text: str) -> set[str]:
    return {c for schema in re.findall(r"ReadSchema: struct<(.*)>", text) for c in re.findall(r"(?:^|,)(\w+):", re.sub(r"struct<[^>]*>", "", schema))}


@pytest.mark.parametrize(
    "name, columns",
    [
        ("content_id", {"row_idx", "text"}),
        ("remediate_kept", {"row_idx", "text", "split"}),
        ("exact_dedup_keep_first", {"row_idx", "text"}),
        ("positive_rate_shift", {"hate_label", "split"}),
        ("threshold_sweep", {"y_true", "fusion_p"}),
        ("near_dup_groups_raw", {"text"}),
    ],
)
def test_only_needed_columns_are_read(spark, name, columns):
    assert columns_read(plan(catalogue.QUERIES[name](spark, DATA))) <= columns


def test_filters_reach_the_scan(spark):
    text = plan(catalogue.QUERIES["remediate_kept"](spark, DATA))
    assert re.search(r"PushedFilters: \[.*EqualTo\(split,train\)", text) and re.search(r"PushedFilters: \[.*In\(split, \[dev,test\]\)", text)


@pytest.mark.parametrize("name", ["leakage_overlaps", "leakage_overlaps_text", "multi_key_duplicates", "stratified_group_split", "complementarity_counts", "threshold_sweep", "pr_auc"])
def test_no_pairing_of_all_rows(spark, name):
    text = plan(catalogue.QUERIES[name](spark, DATA))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_threshold_sweep_is_one_pass_without_python(spark):
    text = plan(catalogue.QUERIES["threshold_sweep"](spark, DATA))
    assert text.count("Scan parquet") <= 2 and "Python" not in text  # one scan, named twice
