"""Readers: JSON lines, per-split files, blobs, paged rows."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from ..ship import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def json_lines(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """``payload`` of every non-blank line; with ``strict`` broken JSON fails the job, else it stays for classification."""
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0).select(F.col("value").alias("payload"))
    return lines.where(F.parse_json("payload").isNotNull()) if strict else lines


def split_files(spark: SparkSession, folder: str, schema: StructType, splits: tuple[str, ...] = ("train", "dev", "test")) -> DataFrame:
    """Rows of ``FOLDER/SPLIT.jsonl``; the split is the file's, missing files count as empty."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    parts = []
    for s in splits:
        path = hadoop(f"{folder}/{s}.jsonl")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            parts.append(spark.read.schema(schema).json(f"{folder}/{s}.jsonl").withColumn("split", F.lit(s)))
    out = spark.createDataFrame([], schema).withColumn("split", F.lit(None).cast("string")) if not parts else parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def blobs(spark: SparkSession, path: str) -> DataFrame:
    """``path, content, sha`` of files."""
    return spark.read.format("binaryFile").load(path).select("path", "content", F.sha2("content", 256).alias("sha"))


def load_target(examples: DataFrame, target: str) -> DataFrame:
    """``id, text, score, dataset_version`` of one target score; the version is that of the last row."""
    last = examples.agg(F.max_by("dataset_version", "row_idx").alias("dataset_version"))
    return examples.select(F.col("content_id").alias("id"), "text", F.col(f"labels.{target}").alias("score")).crossJoin(F.broadcast(last))


def fetch_page(url: str, timeout: float = 30.0) -> list[dict]:
    """Rows of one page of an HTTP rows interface; an ``error`` key raises."""
    with urllib.request.urlopen(url, timeout=timeout) as answer:
        body = json.load(answer)
    if "error" in body:
        raise RuntimeError(body["error"])
    return [r["row"] for r in body.get("rows", [])]


class _Range(InputPartition):
    def __init__(self, start: int, stop: int) -> None:
        self.start, self.stop = start, stop


class PagedSource(DataSource):
    """Paged HTTP rows as a data source: options ``url`` (with {offset} and {length}), ``rows``, ``page``, ``partitions``."""

    @classmethod
    def name(cls) -> str:
        return "paged_rows"

    def schema(self) -> str:
        return "row_idx long, payload string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return PagedReader(self.options)


class PagedReader(DataSourceReader):
    """Each partition reads its own range of pages; an empty page ends it.  A row's own ``row_idx`` wins over its position."""

    def __init__(self, options: dict, fetch: Callable[[str], list[dict]] = fetch_page) -> None:
        self.url, self.rows = options["url"], int(options.get("rows", 8000))
        self.page, self.parts = int(options.get("page", 100)), int(options.get("partitions", 8))
        self.fetch = fetch

    def partitions(self) -> list[InputPartition]:
        pages = -(-self.rows // self.page)
        each = max(1, -(-pages // self.parts)) * self.page
        return [_Range(a, min(self.rows, a + each)) for a in range(0, self.rows, each)]

    def read(self, partition: _Range) -> Iterator[tuple[int, str]]:
        at = partition.start
        while at < partition.stop:
            rows = self.fetch(self.url.format(offset=at, length=min(self.page, partition.stop - at)))
            if not rows:
                return
            for k, row in enumerate(rows[: partition.stop - at]):
                yield int(row.get("row_idx", at + k)), json.dumps(row, ensure_ascii=False)
            at += len(rows)


def expected_counts(df: DataFrame, expected: dict[str, int], split: str = "split") -> DataFrame:
    """``split, expected, actual`` side by side; a difference is no error."""
    want = df.sparkSession.createDataFrame(list(expected.items()), "split string, expected long")
    have = df.groupBy(F.col(split).alias("split")).agg(F.count("*").alias("actual"))
    return want.join(have, "split", "full_outer").select("split", F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("actual", F.lit(0)).alias("actual"))
