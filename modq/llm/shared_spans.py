"""Problem 10: long exact spans shared between records.

Method: a compressed FM-index per shard.  Backward search over wavelet trees gives the matching statistics of streamed
passages; intervals above the threshold are reported.

Sharding: texts are winnowed over rolling hashes of ``GRAM`` characters with a window of ``length - GRAM + 1``, so every shared
span of ``length`` characters holds a common anchor.  Anchors that occur in two or more different texts send the passage around
them (all spans of the threshold's length that hold the anchor lie in it) to the anchor's shard.  A shard's index is built over
its passages by prefix doubling up to ``DEPTH`` characters or half the threshold, if that is more, which is exact for patterns of that length; blocks of half the
threshold are searched backwards, and only those found elsewhere are extended to maximal spans.

Copies of whole texts are collapsed first.  A hot anchor's passages are cut into blocks of ``HOT_PASSAGES``, and each pair of
blocks is a shard of its own, so no task gets a whole hot group.

Defined results: null texts and texts shorter than the threshold share nothing; spans are of code points; rows without
``doc_id`` are left out; a text repeated within one record is no sharing; empty tables give no rows.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import cut, map_batches, spread
from .words import mix

LENGTH = 250
GRAM = 64
DEPTH = 256
SHARD_PASSAGES = 3_000
HOT_PASSAGES = 1_500
BASE = 0x9E3779B97F4A7C15


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    up, down = np.full(n, BASE, np.uint64), np.full(n, pow(BASE, -1, 2**64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def prefix_sums(cps: np.ndarray) -> np.ndarray:
    up, _ = _powers(1 << max(12, int(len(cps)).bit_length()))
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(cps.astype(np.uint64), 7) * up[: len(cps)], dtype=np.uint64)])


def rolling(cps: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` characters from each position on."""
    sums = prefix_sums(cps)
    _, down = _powers(1 << max(12, int(len(cps)).bit_length()))
    return mix((sums[k:] - sums[:-k]) * down[: len(cps) - k + 1], k)


def _sliding(x: np.ndarray, w: int, op: np.ufunc) -> np.ndarray:
    """Minimum or maximum of every ``w`` neighbours, in log(w) passes."""
    size = 1
    while size * 2 <= w:
        x = op(x[:-size], x[size:])
        size *= 2
    return op(x[: len(x) - (w - size)], x[w - size :]) if w > size else x


def anchors(text: str, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of a text's anchors: at least one in every ``length`` characters."""
    if len(text) < length:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = rolling(code_points(text), GRAM)
    w = length - GRAM + 1
    low = _sliding(h, w, np.minimum)
    padded = np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)])
    at = np.flatnonzero(_sliding(padded, w, np.maximum) == h)
    run = np.concatenate([[False], (np.diff(at) == 1) & (h[at[1:]] == h[at[:-1]])])  # one character repeated on and on
    if run.any():
        last = np.concatenate([~run[1:], [True]])
        at = at[~run | last | (at % 50 == 0)]
    return at, h[at]


class WaveletTree:
    """Rank over a sequence of symbols: packed bits by level with counts every 64 bits."""

    def __init__(self, symbols: np.ndarray, n_symbols: int) -> None:
        self.levels = max(1, int(n_symbols - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        now = symbols
        for level in range(self.levels - 1, -1, -1):
            bit = (now >> level & 1).astype(np.uint8)
            packed = np.packbits(np.concatenate([bit, np.zeros(-len(bit) % 64 + 64, np.uint8)]), bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]))
            self.zeros.append(int(len(bit) - bit.sum()))
            now = np.concatenate([now[bit == 0], now[bit == 1]])
        self.first = self._walk(np.arange(n_symbols), np.zeros(n_symbols, np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            word = at >> 6
            part = self.words[k][word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
            ones = self.counts[k][word] + np.bitwise_count(part)
            at = np.where(symbol >> (self.levels - 1 - k) & 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before position ``at``."""
        return self._walk(symbol, at) - self.first[symbol]


class FmIndex:
    """Index of several texts joined by a separator that no pattern holds."""

    def __init__(self, texts: list[np.ndarray], depth: int = DEPTH) -> None:
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.start = np.cumsum(sizes + 1) - (sizes + 1)
        alphabet = np.unique(np.concatenate(texts))
        joined = np.zeros(int((sizes + 1).sum()), np.int64)
        self.owner = np.repeat(np.arange(len(texts)), sizes + 1)
        for t, s in zip(texts, self.start.tolist()):
            joined[s : s + len(t)] = np.searchsorted(alphabet, t) + 1
        self.symbols, n = joined, len(joined)
        rank, k = joined, 1
        while True:
            order = np.argsort(rank, kind="stable") if k == 1 else np.argsort(rank * (n + 1) + np.concatenate([rank[k // 2 :] + 1, np.zeros(k // 2, np.int64)]), kind="stable")
            key = rank[order] if k == 1 else (rank * (n + 1) + np.concatenate([rank[k // 2 :] + 1, np.zeros(k // 2, np.int64)]))[order]
            fresh = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
            rank = np.empty(n, np.int64)
            rank[order] = fresh
            if fresh[-1] == n - 1 or k >= depth:
                break
            k *= 2
        self.suffixes = order
        self.tree = WaveletTree(joined[order - 1], len(alphabet) + 1)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(joined, minlength=len(alphabet) + 1))])[:-1]

    def search_back(self, ends: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search of the ``steps`` characters before each end; those that occur twice or more, with their suffix interval."""
        alive = np.arange(len(ends))
        lo, hi = np.zeros(len(ends), np.int64), np.full(len(ends), len(self.symbols), np.int64)
        for s in range(1, steps + 1):
            c = self.symbols[ends[alive] - s]
            lo, hi = self.before[c] + self.tree.rank(c, lo), self.before[c] + self.tree.rank(c, hi)
            keep = hi - lo > 1
            alive, lo, hi = alive[keep], lo[keep], hi[keep]
            if not len(alive):
                break
        return alive, lo, hi


def _agree(sums: np.ndarray, down: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
    return (sums[a + n] - sums[a]) * down[a] == (sums[b + n] - sums[b]) * down[b]


def shared_in_shard(passages: pd.DataFrame, length: int = LENGTH) -> pd.DataFrame:
    """``a, b, a_start, b_start, n``: maximal spans of at least ``length`` shared by passages of different texts."""
    empty = pd.DataFrame({c: np.zeros(0, np.int64) for c in ("a", "b", "a_start", "b_start", "n")})
    # near a text's begin several passages start at 0: the longest holds the others
    passages = passages.assign(size=passages["passage"].str.len()).sort_values(["class_id", "at", "size"], ascending=[True, True, False], kind="stable")
    passages = passages.drop_duplicates(["class_id", "at"])
    texts = [code_points(t) for t in passages["passage"]]
    ids, offset = passages["class_id"].to_numpy(np.int64), passages["at"].to_numpy(np.int64)
    if len(set(ids.tolist())) < 2:
        return empty
    half = length // 2
    index = FmIndex(texts, max(DEPTH, half))
    ends = np.concatenate([s + np.arange(half, len(t) + 1, half) for t, s in zip(texts, index.start.tolist())])
    alive, lo, hi = index.search_back(ends, half)
    sums = prefix_sums(index.symbols.astype(np.uint32))
    _, down = _powers(1 << max(12, len(index.symbols).bit_length()))
    stops = index.start + np.array([len(t) for t in texts])
    parts = []
    for piece in np.array_split(np.arange(len(alive)), max(1, int((hi - lo).sum()) // 2_000_000)):  # bounded memory
        sizes = hi[piece] - lo[piece]
        if not sizes.sum():
            continue
        at = np.repeat(lo[piece] - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))
        b = index.suffixes[at]
        a = np.repeat(ends[alive[piece]] - half, sizes)
        oa, ob = index.owner[a], index.owner[b]
        keep = ids[oa] < ids[ob]
        a, b, oa, ob = a[keep], b[keep], oa[keep], ob[keep]
        left_most = np.minimum(a - index.start[oa], b - index.start[ob])
        right_most = np.minimum(stops[oa] - a, stops[ob] - b)
        left, right = np.zeros(len(a), np.int64), np.full(len(a), half, np.int64)
        step = 1 << int(max(left_most.max(initial=0), right_most.max(initial=0), 1)).bit_length()
        while step:
            t = left + step
            ok = t <= left_most
            ok[ok] = _agree(sums, down, a[ok] - t[ok], b[ok] - t[ok], t[ok])
            left[ok] = t[ok]
            t = right + step
            ok = t <= right_most
            ok[ok] = _agree(sums, down, a[ok], b[ok], t[ok])
            right[ok] = t[ok]
            step >>= 1
        keep = left + right >= length
        a, b, oa, ob, left, right = (x[keep] for x in (a, b, oa, ob, left, right))
        part = pd.DataFrame({"a": ids[oa], "b": ids[ob], "a_start": offset[oa] + a - left - index.start[oa], "b_start": offset[ob] + b - left - index.start[ob], "n": left + right, "pa": a - left, "pb": b - left}).drop_duplicates(["a", "b", "a_start", "b_start", "n"])
        # exact comparison of what the hashes say
        same = np.ones(len(part), bool)
        pa, pb, n = part["pa"].to_numpy(), part["pb"].to_numpy(), part["n"].to_numpy()
        for j in range(int(n.max(initial=0))):
            on = j < n
            same[on] &= index.symbols[pa[on] + j] == index.symbols[pb[on] + j]
        parts.append(part[same].drop(columns=["pa", "pb"]))
    return pd.concat(parts).drop_duplicates().astype(np.int64) if parts else empty


def text_classes(documents: DataFrame) -> DataFrame:
    """``doc_id, class_id, text``: whole-text copies share the class of their smallest ``doc_id``."""
    docs = documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.sha2("text", 256).alias("key"))
    ids = docs.groupBy("key").agg(F.min("doc_id").alias("class_id"))
    return docs.join(ids, "key").select("doc_id", "class_id", "text")


def shard_passages(classes: DataFrame, length: int = LENGTH) -> DataFrame:
    """``shard, class_id, at, passage``: passages around anchors that two or more texts have."""

    def batch(cols: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {"class_id": [], "g": [], "at": [], "passage": []}
        for cid, text in zip(cols["class_id"], cols["text"]):
            at, g = anchors(text, length)
            for p, h in zip(at.tolist(), g.view(np.int64).tolist()):
                lo = max(0, p - (length - GRAM))
                out["class_id"].append(cid)
                out["g"].append(h)
                out["at"].append(lo)
                out["passage"].append(text[lo : p + length])
        return out

    texts = classes.where((F.col("doc_id") == F.col("class_id")) & (F.length("text") >= length)).select("class_id", "text")
    every = map_batches(spread(texts), batch, "class_id long, g long, at long, passage string")
    common = cut(
        every.select("g", "class_id").groupBy("g").agg(F.count("*").alias("n"), F.min("class_id").alias("x"), F.max("class_id").alias("y")).where("x < y").select("g", "n")
    )
    total = common.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-int(total) // SHARD_PASSAGES))
    found = every.join(common, "g")
    mild = found.where(F.col("n") <= HOT_PASSAGES).select(F.concat(F.lit("s"), F.pmod(F.xxhash64("g"), F.lit(shards))).alias("shard"), "class_id", "at", "passage")
    # hot anchors: every pair of blocks is a shard
    blocks = F.ceil(F.col("n") / HOT_PASSAGES).cast("int")
    hot = found.where(F.col("n") > HOT_PASSAGES).withColumn("blocks", blocks).withColumn("mine", F.pmod(F.xxhash64("class_id", "at"), F.col("blocks")).cast("int"))
    paired = hot.select("g", "class_id", "at", "passage", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    hot = paired.select(F.concat_ws(":", F.lit("h"), "g", F.least("mine", "other"), F.greatest("mine", "other")).alias("shard"), "class_id", "at", "passage")
    return mild.unionByName(hot)


def shared_spans(classes: DataFrame, length: int = LENGTH) -> DataFrame:
    """``a, b, a_start, b_start, n``: spans between different texts (class ids, a < b), whole within a passage."""
    found = shard_passages(classes, length).groupBy("shard").applyInPandas(
        lambda pdf: shared_in_shard(pdf, length), "a long, b long, a_start long, b_start long, n long"
    )
    return found.distinct()


def sharing_pairs(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id_a, doc_id_b``: every pair of documents with a common span of ``length`` characters, copies included."""
    classes = text_classes(documents)
    long_enough = classes.where(F.length("text") >= length).select("doc_id", "class_id")
    between = shared_spans(classes, length).select("a", "b").distinct()
    pairs = between.unionByName(long_enough.groupBy("class_id").agg(F.count("*").alias("n")).where("n > 1").select(F.col("class_id").alias("a"), F.col("class_id").alias("b")))
    members = pairs.join(long_enough.select(F.col("class_id").alias("a"), F.col("doc_id").alias("x")), "a").join(
        long_enough.select(F.col("class_id").alias("b"), F.col("doc_id").alias("y")), "b"
    )
    return members.where("a < b OR x < y").select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))


def span_classes(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """Spans between class representatives with their text's start and length, and the number of copies on both sides."""
    classes = text_classes(documents)
    copies = classes.groupBy("class_id").agg(F.count("*").alias("copies"))
    spans = shared_spans(classes, length)
    return spans.join(copies.select(F.col("class_id").alias("a"), F.col("copies").alias("a_copies")), "a").join(
        copies.select(F.col("class_id").alias("b"), F.col("copies").alias("b_copies")), "b"
    )


def shared_share(documents: DataFrame, length: int = LENGTH) -> DataFrame:
    """``doc_id, n_chars, shared_chars, share``: how much of each document also stands in another one."""
    classes = text_classes(documents)
    spans = cut(shared_spans(classes, length))
    own = spans.select(F.col("a").alias("class_id"), F.col("a_start").alias("s"), (F.col("a_start") + F.col("n")).alias("e")).unionByName(
        spans.select(F.col("b").alias("class_id"), F.col("b_start").alias("s"), (F.col("b_start") + F.col("n")).alias("e"))
    ).groupBy("class_id", "s").agg(F.max("e").alias("e"))
    before = Window.partitionBy("class_id").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.coalesce(F.max("e").over(before), F.lit(0))
    covered = own.withColumn("reach", reach).groupBy("class_id").agg(F.sum(F.greatest(F.lit(0), F.col("e") - F.greatest("s", "reach"))).alias("covered"))
    copies = classes.groupBy("class_id").agg(F.count("*").alias("copies"))
    n = F.length("text")
    full = classes.select("doc_id", "class_id", n.cast("long").alias("n_chars")).join(copies, "class_id").join(covered, "class_id", "left")
    shared = F.when((F.col("copies") > 1) & (F.col("n_chars") >= length), F.col("n_chars")).otherwise(F.coalesce("covered", F.lit(0)))
    return full.select("doc_id", "n_chars", shared.cast("long").alias("shared_chars")).withColumn("share", F.when(F.col("n_chars") > 0, F.col("shared_chars") / F.col("n_chars")).otherwise(0.0))
