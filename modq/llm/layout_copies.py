"""Problem 2: duplicates hidden by formatting differences.

Method: every text is streamed through a skip-and-fold lookup table into two rolling polynomial hashes (mod 2^64, odd
bases, per-character random codes); canonical strings are never materialised.  Rows with equal hashes are compared with
the group's first row by a two-pointer comparison that skips and folds on the fly.

Defined results: null and blank texts and payloads that are no JSON object with a string ``text`` belong to no group; a
text of punctuation only equals every other such text; rows without ``row_idx`` are left out; exact copies count.
Texts are processed whole, in slices of bounded size.

Scale: the grouping shuffles 24 bytes a row with map-side combine.  Groups of ``HOT_ROWS`` rows or more (and of
more than rows / MAX_BROADCAST_KEYS) are joined by a broadcast of their keys, of which there are at most MAX_BROADCAST_KEYS at any
size, and the comparison is salted by group size, so no task gets a whole hot group.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut, nonblank, spread

HOT_ROWS = 20_000
MAX_BROADCAST_KEYS = 100_000
SLICE_CHARS = 1_000_000
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def skipped(c: str) -> bool:
    """Whitespace and punctuation (with the symbols that serve as punctuation in ASCII) are disregarded."""
    return c.isspace() or unicodedata.category(c)[0] == "P" or c in "$+<=>^`|~"


@lru_cache(maxsize=1)
def fold_table() -> tuple[np.ndarray, dict[int, list[int]]]:
    """Code point -> folded code point, 0 for skipped ones; letters that fold to several are in the dict."""
    table = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    several = {}
    for cp in range(sys.maxunicode + 1):
        c = chr(cp)
        if skipped(c):
            table[cp] = 0
        elif len(f := c.casefold()) == 1:
            table[cp] = ord(f)
        else:
            several[cp] = [ord(x) for x in f]
    table[0] = 0x110000  # NUL is no case of skipping
    return table, several


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = x.astype(np.uint64) + np.uint64(seed)
    for shift, mult in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(mult)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=2)
def _powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.full(n, base, dtype=np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)


def hash_texts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of every text's folded code points."""
    table, several = fold_table()
    cps = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    many = np.isin(cps, np.fromiter(several, dtype=np.uint32)) if cps.size and cps.max() > 127 else np.zeros(0, bool)
    if many.any():
        counts = np.ones(len(cps), dtype=np.int64)
        counts[many] = [len(several[c]) for c in cps[many].tolist()]
        at = np.repeat(np.arange(len(cps)), counts)
        step = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
        folded = table[cps[at]]
        wide = many[at]
        folded[wide] = [several[c][k] for c, k in zip(cps[at[wide]].tolist(), step[wide].tolist())]
        row = row[at]
    else:
        folded = table[cps]
    keep = folded != 0
    folded, row = folded[keep], row[keep]
    sizes = np.bincount(row, minlength=len(texts))
    start = np.cumsum(sizes) - sizes
    pos = np.arange(len(row)) - start[row]
    longest = int(sizes.max()) if len(sizes) else 1
    hashes = []
    for k, base in enumerate(BASES):
        power = _powers(base, 1 << max(10, (longest + 1).bit_length()))
        with np.errstate(over="ignore"):
            total = np.concatenate([[np.uint64(0)], np.cumsum(_mix(folded, k + 1) * power[pos], dtype=np.uint64)])
            hashes.append((total[start + sizes] - total[start] + sizes.astype(np.uint64)).view(np.int64))
    return hashes[0], hashes[1]


def same_disregarding_layout(a: str, b: str) -> bool:
    """Two-pointer comparison: skip what is disregarded, fold the rest, stop at the first difference."""
    if a == b:
        return True
    table, several = fold_table()

    def folded(t: str) -> Iterator[int]:
        for c in map(ord, t):
            if c in several:
                yield from several[c]
            elif x := table_list[c] if c < 65536 else int(table[c]):
                yield x

    table_list = _bmp()
    ia, ib = folded(a), folded(b)
    for x in ia:
        if x != next(ib, None):
            return False
    return next(ib, None) is None


@lru_cache(maxsize=1)
def _bmp() -> list[int]:
    return fold_table()[0][:65536].tolist()


def texts_of(moderation: DataFrame, raw: DataFrame) -> DataFrame:
    """``row_idx, text`` of both tables; payloads are parsed strictly in the JVM."""
    parsed = raw.select("row_idx", F.try_parse_json("payload").alias("v")).where("schema_of_variant(v) LIKE 'OBJECT%'")
    text = F.expr("try_variant_get(v, '$.text', 'variant')")
    strings = parsed.where(F.expr("schema_of_variant(try_variant_get(v, '$.text', 'variant')) = 'STRING'"))
    return moderation.select("row_idx", "text").unionByName(
        strings.select("row_idx", F.expr("try_variant_get(v, '$.text', 'string')").alias("text"))
    )


def with_hashes(rows: DataFrame) -> DataFrame:
    """``row_idx, text, h1, h2``."""
    rows = rows.select(F.col("row_idx").cast("long").alias("row_idx"), "text").where(F.col("row_idx").isNotNull() & nonblank("text"))
    schema = pa.schema([("row_idx", pa.int64()), ("text", pa.string()), ("h1", pa.int64()), ("h2", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo, texts = 0, batch.column(1).to_pylist()
            sizes = np.cumsum([len(t) for t in texts])
            while lo < len(texts):  # slices of bounded size, at least one text
                done = int(sizes[lo - 1]) if lo else 0
                hi = max(lo + 1, int(np.searchsorted(sizes, done + SLICE_CHARS)))
                h1, h2 = hash_texts(texts[lo:hi])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(texts[lo:hi], pa.string()), pa.array(h1), pa.array(h2)], schema=schema
                )
                lo = hi

    return spread(rows).mapInArrow(run, "row_idx long, text string, h1 long, h2 long")


def layout_groups(rows: DataFrame) -> DataFrame:
    """``row_idx, first_row_idx, n``: every row of a group of two or more, with the group's smallest row and its size."""
    hashed = with_hashes(rows)
    reps = cut(hashed.groupBy("h1", "h2").agg(F.min("row_idx").alias("first_row_idx"), F.count("*").alias("n")).where("n > 1"))
    # a group is hot from HOT_ROWS rows on, or from a fixed part of all rows, so at most MAX_BROADCAST_KEYS groups are hot at any size
    limit = max(HOT_ROWS, reps.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // MAX_BROADCAST_KEYS)
    hot = reps.where(F.col("n") >= limit)
    members = hashed.join(F.broadcast(hot), ["h1", "h2"]).unionByName(
        hashed.join(F.broadcast(hot.select("h1", "h2")), ["h1", "h2"], "left_anti").join(reps.where(F.col("n") < limit), ["h1", "h2"])
    ) if not hot.isEmpty() else hashed.join(reps, ["h1", "h2"])
    members = members.select("row_idx", "text", "first_row_idx", "n")
    salts = F.ceil(F.col("n") / HOT_ROWS).cast("int")
    firsts = members.where("row_idx = first_row_idx").select(
        "first_row_idx", F.col("text").alias("first_text"), F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt")
    )
    salted = members.withColumn("salt", F.pmod(F.xxhash64("row_idx"), salts).cast("int"))
    pairs = salted.join(firsts, ["first_row_idx", "salt"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same = [same_disregarding_layout(x, y) for x, y in zip(b.column(3).to_pylist(), b.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(same, pa.bool_())], names=["row_idx", "first_row_idx", "n", "same"])

    checked = cut(
        pairs.select("row_idx", "first_row_idx", "n", "text", "first_text").mapInArrow(
            compare, "row_idx long, first_row_idx long, n long, same boolean"
        )
    )
    odd = checked.where("NOT same")
    good = checked.where("same")
    if odd.isEmpty():
        return good.select("row_idx", "first_row_idx", "n")
    # true collisions of 128 bits: exact grouping of those rows alone, by their folded code points
    folded = F.udf(_folded, "string")
    other = odd.join(rows, "row_idx").select("row_idx", "first_row_idx", folded("text").alias("key"))
    regrouped = other.groupBy("first_row_idx", "key").agg(F.min("row_idx").alias("first"), F.count("*").alias("n")).where("n > 1")
    fixed = good.groupBy("first_row_idx").agg(F.count("*").alias("n")).where("n > 1")
    return (
        good.select("row_idx", "first_row_idx").join(fixed, "first_row_idx").select("row_idx", "first_row_idx", "n")
    ).unionByName(other.join(regrouped, ["first_row_idx", "key"]).select("row_idx", F.col("first").alias("first_row_idx"), "n"))


def _folded(text: str) -> str:
    table, several = fold_table()
    return "".join("".join(map(chr, several[c])) if c in several else chr(table[c]) if 0 < table[c] < 0x110000 else "" for c in map(ord, text))


def collapse(rows: DataFrame) -> DataFrame:
    """One record per distinct text: its smallest ``row_idx`` and its number of copies (1 for texts without a copy)."""
    groups = layout_groups(rows)
    ids = rows.where(F.col("row_idx").isNotNull() & nonblank("text")).select(F.col("row_idx").cast("long").alias("row_idx"))
    return (
        ids.join(groups, "row_idx", "left")
        .where("first_row_idx IS NULL OR first_row_idx = row_idx")
        .select("row_idx", F.coalesce("n", F.lit(1)).cast("long").alias("n_copies"))
    )
