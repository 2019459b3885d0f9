"""Content hashes and manifests."""

from __future__ import annotations

import hashlib
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.schema import LABELS
from ..operators.validate import label_distribution

PREPROCESSING_VERSION = "1"


def content_hash(examples: DataFrame, key: str = "content_id", text: str = "text") -> str:
    """SHA-256 over ``id|text`` lines sorted by id (then text), independent of input order.

    The digest is sequential, so sorted rows stream through the driver one partition at a time; memory stays bounded.
    """
    rows = examples.select(F.coalesce(key, F.lit("")).alias("k"), F.coalesce(text, F.lit("")).alias("t")).orderBy("k", "t")
    digest, first = hashlib.sha256(), True
    for r in rows.toLocalIterator(prefetchPartitions=True):
        digest.update(("" if first else "\n").encode() + f"{r.k}|{r.t}".encode("utf-8", "surrogatepass"))
        first = False
    return digest.hexdigest()


def folded_hash(examples: DataFrame, key: str = "content_id", text: str = "text") -> DataFrame:
    """An order-independent digest without a global sort: row hashes folded by exclusive or and sum, one row.

    The distributed form of ``content_hash``; a row's hash is the first 60 bits of the SHA-256 of its ``id|text`` line.
    """
    line = F.concat(F.coalesce(key, F.lit("")), F.lit("|"), F.coalesce(text, F.lit("")))
    h = F.conv(F.left(F.sha2(line, 256), F.lit(15)), 16, 10).cast("long")
    return examples.agg(F.count("*").alias("n"), F.bit_xor(h).alias("xor"), F.sum(h.cast("decimal(38,0)")).cast("string").alias("total"))


def manifest_counts(examples: DataFrame) -> DataFrame:
    """``key, value``: record count, split sizes and label shares of a manifest."""
    sizes = examples.groupBy(F.concat(F.lit("split:"), F.coalesce("split", F.lit(""))).alias("key")).agg(F.count("*").cast("double").alias("value"))
    shares = label_distribution(examples).select(F.concat(F.lit("share:"), "label").alias("key"), F.col("fraction_ge_half").alias("value"))
    return sizes.unionByName(shares).unionByName(sizes.agg(F.sum("value").alias("value")).select(F.lit("num_records").alias("key"), F.coalesce("value", F.lit(0.0)).alias("value")))


def multimodal_counts(duplicates: DataFrame, leaks: DataFrame, remediation: DataFrame) -> DataFrame:
    """``key, value``: duplicates by kind, overlaps by pair and kind, and rows of each step of remediation."""
    parts = (
        duplicates.groupBy(F.concat(F.lit("duplicates:"), "kind").alias("key")).agg(F.count("*").alias("value")),
        leaks.groupBy(F.concat_ws(":", F.lit("overlaps"), "pair", "kind").alias("key")).agg(F.count("*").alias("value")),
        remediation.select(F.expr("stack(3, 'original', original, 'removed', removed, 'final', final) AS (key, value)")),
    )
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def build_manifest(examples: DataFrame, facts: dict[str, Any], seed: int = 42) -> dict[str, Any]:
    """Facts given (name, version, source, licence, date, raw hash) with hash, counts, label shares and split sizes."""
    facts_of = {r.key: r.value for r in manifest_counts(examples).collect()}  # splits and labels only
    shares = {k.split(":", 1)[1]: v for k, v in facts_of.items() if k.startswith("share:")}
    sizes = {k.split(":", 1)[1]: int(v) for k, v in facts_of.items() if k.startswith("split:")}
    return {
        **{k: facts.get(k) for k in ("dataset_name", "dataset_version", "source_url", "license", "retrieval_date", "raw_data_hash")},
        "processed_data_hash": content_hash(examples),
        "num_records": sum(sizes.values()),
        "label_distribution_fraction_ge_0.5": {n: shares[n] for n in LABELS},
        "split_sizes": sizes,
        "preprocessing_version": PREPROCESSING_VERSION,
        "random_seed": seed,
    }


def build_multimodal_manifest(facts: dict[str, Any], report: DataFrame, duplicates: DataFrame, leaks: DataFrame, remediation: dict | None = None, shift: DataFrame | None = None) -> dict[str, Any]:
    """Reports reduced to counts; remediation and shift sections where given."""
    per = {r.split_name or "all": r.asDict() for r in report.collect()}
    kinds = {r.kind: r.n for r in duplicates.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    pairs = {f"{r.pair}:{r.kind}": r.n for r in leaks.groupBy("pair", "kind").agg(F.count("*").alias("n")).collect()}
    out = {**facts, "validation_summary": per, "duplicate_summary": kinds, "leakage_summary": {"is_clean": not pairs, "overlaps": pairs}}
    if remediation is not None:
        out["remediation"] = remediation
    if shift is not None:
        out["distribution_shift"] = shift.first().asDict()
    return out
