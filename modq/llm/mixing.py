"""Problem 9: mixing sources to target weights.

Method: subset-sum budget fitting.  Documents are counted by exact token length per source.  A source's budget is first
met by whole passes over its documents; the rest is taken in proportion from every length and the last part is fitted by
bounded-knapsack dynamic programming over the remaining counts; documents are then selected by seeded rank within their
length.

Defined results: documents without source, or of a source without target, count for the total and are not used; null texts
have no tokens and are never used; a source without documents reaches nothing; a null or non-positive ``max_repeats`` or
share counts as 0; empty tables give no rows.

Scale: one narrow pass counts tokens; only (source, length, count) reaches the driver, whose number of rows is bounded by
sources x distinct lengths.  Ranks are computed within buckets of a hash, so no task gets all documents of one length.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import cut, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BUCKETS = 1024


@lru_cache(maxsize=2)
def tokenizer(path: str):
    import tiktoken

    pattern = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("mix", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """``doc_id, source, n_tokens``."""
    docs = spread(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["doc_id", "source", "n_tokens"])

    return docs.mapInArrow(count, "doc_id long, source string, n_tokens long")


def fit_subset(lengths: dict[int, int], budget: int) -> dict[int, int]:
    """How many documents of each length to take so that their sum comes as near to ``budget`` as possible from below.

    ``lengths``: length -> number of documents.  In proportion first, then largest first down to a few lengths' worth, then
    bounded knapsack over what is left.
    """
    lengths = {n: c for n, c in lengths.items() if n > 0 and c > 0}
    total = sum(n * c for n, c in lengths.items())
    if budget >= total:
        return dict(lengths)
    take = {n: c * budget // total for n, c in lengths.items()}
    rest = budget - sum(n * c for n, c in take.items())
    for n in sorted(lengths, reverse=True):
        if rest <= 4 * max(lengths):
            break
        more = min(lengths[n] - take[n], (rest - 3 * max(lengths)) // n)
        if more > 0:
            take[n] += more
            rest -= more * n
    for n, c in _knapsack({n: lengths[n] - take[n] for n in lengths}, rest).items():
        take[n] += c
    return {n: c for n, c in take.items() if c}


def _knapsack(counts: dict[int, int], budget: int) -> dict[int, int]:
    """Bounded knapsack: the largest reachable sum up to ``budget`` and the counts that make it."""
    if budget <= 0:
        return {}
    reached = np.zeros(budget + 1, dtype=bool)
    reached[0] = True
    by = np.full(budget + 1, -1, dtype=np.int64)  # the chunk that first reached a sum
    chunks: list[tuple[int, int]] = []
    for n in sorted(counts, reverse=True):
        left, size = min(counts[n], budget // n), 1
        while left > 0 and not reached[budget]:  # binary splitting
            k = min(size, left)
            w = k * n
            new = np.zeros_like(reached)
            new[w:] = reached[: budget + 1 - w]
            new &= ~reached
            by[new] = len(chunks)
            reached |= new
            chunks.append((n, k))
            left, size = left - k, size * 2
    s = int(np.flatnonzero(reached)[-1])
    out: dict[int, int] = {}
    while s:
        n, k = chunks[by[s]]
        out[n] = out.get(n, 0) + k
        s -= n * k
    return out


def plan_mix(counted: DataFrame, targets: DataFrame, total: int | None = None) -> list[dict]:
    """Per target source: budget, whole passes, extra documents per length, and whether the share can be reached."""
    rows = counted.groupBy("source", "n_tokens").agg(F.count("*").alias("n")).collect()  # sources x distinct lengths
    by: dict[str | None, dict[int, int]] = {}
    for r in rows:
        by.setdefault(r.source, {})[r.n_tokens] = r.n
    everything = sum(n * c for lengths in by.values() for n, c in lengths.items())
    total = everything if total is None else total
    plan = []
    for t in targets.where("source IS NOT NULL").select("source", "target_share", "max_repeats").collect():
        lengths = by.get(t.source, {})
        own = sum(n * c for n, c in lengths.items())
        share, repeats = max(t.target_share or 0.0, 0.0), max(t.max_repeats or 0, 0)
        budget = round(share * total)
        passes = min(repeats, budget // own) if own else 0
        extra = fit_subset(lengths, budget - passes * own) if passes < repeats else {}
        plan.append(
            {"source": t.source, "target_share": share, "max_repeats": repeats, "own_tokens": own, "budget": budget, "passes": passes,
             "extra": extra, "used_tokens": passes * own + sum(n * c for n, c in extra.items()), "reachable": own * repeats >= share * total}
        )
    return plan


def plan_report(counted: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target source with the share it reaches."""
    plan = plan_mix(counted, targets)
    used = sum(p["used_tokens"] for p in plan)
    schema = "source string, target_share double, max_repeats int, own_tokens long, target_tokens long, used_tokens long, actual_share double, reachable boolean"
    rows = [
        (p["source"], p["target_share"], p["max_repeats"], p["own_tokens"], p["budget"], p["used_tokens"], p["used_tokens"] / used if used else 0.0, p["reachable"])
        for p in plan
    ]
    return counted.sparkSession.createDataFrame(rows, schema)


def select_mix(documents: DataFrame, targets: DataFrame, seed: int = 0, path: str = TOKENIZER) -> DataFrame:
    """``doc_id, source, n_tokens, n_uses``: how often each document of a target source is used (at least once)."""
    counted = cut(token_counts(documents, path))
    spark = counted.sparkSession
    plan = plan_mix(counted, targets)
    extras = spark.createDataFrame(
        [(p["source"], n, p["passes"], p["extra"].get(n, 0)) for p in plan for n in {**p["extra"], **{-1: 0}}], "source string, n_tokens long, passes int, n_extra long"
    )
    passes = extras.where("n_tokens = -1").select("source", "passes")
    extra = extras.where("n_tokens > 0").select("source", "n_tokens", "n_extra")
    rank_by = F.xxhash64(F.lit(seed), "doc_id")
    docs = (
        counted.where("n_tokens > 0 AND doc_id IS NOT NULL").join(passes, "source").join(extra, ["source", "n_tokens"], "left")
        .select("doc_id", "source", "n_tokens", "passes", F.coalesce("n_extra", F.lit(0)).alias("n_extra"), rank_by.alias("h"))
        .withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 54), F.lit(BUCKETS)))
    )
    group = ["source", "n_tokens"]
    before = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = docs.where("n_extra > 0").groupBy(*group, "bucket").agg(F.count("*").alias("n")).select(*group, "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy(*group, "bucket").orderBy("h", "doc_id")
    ranked = docs.where("n_extra > 0").withColumn("rank", F.row_number().over(inside)).join(offsets, [*group, "bucket"])
    uses = ranked.select("doc_id", "source", "n_tokens", (F.col("passes") + (F.col("rank") + F.col("offset") <= F.col("n_extra")).cast("int")).alias("n_uses"))
    plain = docs.where("n_extra = 0").select("doc_id", "source", "n_tokens", F.col("passes").alias("n_uses"))
    return uses.unionByName(plain).where("n_uses > 0")
