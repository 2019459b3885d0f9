"""Problem 1: same or near-same records across splits.

Method: winnowing fingerprints.  Texts are brought to words with case, punctuation, whitespace and look-alike characters
disregarded; equal ones form a class.  Each class's rolling hashes over ``K`` words are winnowed to window minima, and the
minima are joined across splits on the diagonals that an alignment may use; pairs whose sketches allow it and that have as many
collinear seeds as the allowed edits must leave are extended by alignment (bit-parallel edit distance over words).  Records with
the same picture overlap too.

Lossless: a text of n words and e = floor(limit * n) edits keeps runs of at least five words once n >= 20, and a window of
``WINDOW`` hashes of ``K`` = 4 words lies inside one; shorter texts give all hashes of three words.  ``least_seeds`` is the
number of seeds that any allowed set of edits leaves.  A sketch has 64 bits, each the parity of the words that fall to it: an edit
removes one word, adds one or both, so two texts within e edits differ in 2e bits at most, and texts that only share phrases in
far more.  It is compared inside the join, so pairs that only share phrases are never written; above some 100 words it says little.

Hot fingerprints: minima are taken in the order (hot, hash); hot hashes are those of more than 1 / ``HOT_SHARE`` of all classes,
so there are at most HOT_SHARE x hashes per class of them, whatever the size of the data, and the broadcast set is checked against
``MAX_HOT``.  The most frequent hot hashes of a text are not joined on at all, as many as the least number of common seeds
allows; they count as common then.  Copies are collapsed first, so a third of all rows being copies gives one class.

Defined results: null and blank texts, texts of punctuation only and null splits overlap nothing; a null image path shows no
picture; rows without ``row_idx`` are left out; empty tables give no rows.  Texts are processed whole.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import cut, map_batches, release, spread
from .lookalike import _TO_ARABIC, _TO_LATIN, plain_form
from .words import mix, shingles, word_numbers, words

LIMIT_PERCENT = 15
K, WINDOW, LONG = 4, 2, 20
K_SHORT, SHORT = 3, 24
HOT_SHARE = 2000
MAX_HOT = 500_000
TRAIN, EVAL = ("train",), ("dev", "test")


def plain_words(text: str | None) -> list[str]:
    return words(plain_form(text).translate(_TO_LATIN).translate(_TO_ARABIC)) if text else []


def edits_allowed(n: int) -> int:
    return n * LIMIT_PERCENT // 100


def least_seeds(n: int, long_family: bool) -> int:
    """Common seeds that two texts within the limit must have on the allowed diagonals; ``n`` words in the longer one.

    Seeds are counted by pairs of positions, so a repeated hash counts at least as often as it is aligned.
    """
    e = edits_allowed(n)
    if long_family:
        return max(1, -(-(n - e - (K + WINDOW - 2) * (e + 1)) // WINDOW))
    return max(1, n - K_SHORT + 1 - K_SHORT * e)


def within_limit(a: list[str], b: list[str]) -> bool:
    """At most ``LIMIT_PERCENT`` percent of the longer text's words inserted, removed or replaced."""
    most = edits_allowed(max(len(a), len(b)))
    return abs(len(a) - len(b)) <= most and word_distance(a, b) <= most


def word_distance(a: list[str], b: list[str]) -> int:
    """Edit distance over words, bit-parallel in integers of any length (Myers 1999, Hyyro 2003)."""
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a)
    m = len(b)
    full, top = (1 << m) - 1, 1 << (m - 1)
    where: dict[str, int] = {}
    for i, w in enumerate(b):
        where[w] = where.get(w, 0) | 1 << i
    pos, neg, score = full, 0, m
    for w in a:
        eq = where.get(w, 0)
        d0 = (((eq & pos) + pos) ^ pos) | eq | neg
        hp = neg | (full & ~(d0 | pos))
        hn = pos & d0
        if hp & top:
            score += 1
        elif hn & top:
            score -= 1
        hp = (hp << 1 | 1) & full
        hn = hn << 1 & full
        pos = hn | (full & ~(d0 | hp))
        neg = hp & d0
    return score


def _hashes(h: np.ndarray, k: int) -> np.ndarray:
    return shingles(h, k).view(np.int64)


def digest(column: "str | F.Column") -> "F.Column":
    """128 bits of SHA-256; the hexadecimal spelling is four times as long."""
    return F.substring(F.unhex(F.sha2(column, 256)), 1, 16)


def text_classes(rows: DataFrame) -> DataFrame:
    """``row_idx, split, plain``: words of every non-blank text of a train or evaluation row."""
    some = rows.where(F.col("split").isin(*TRAIN, *EVAL) & F.col("row_idx").isNotNull() & F.col("text").isNotNull())

    def batch(cols: dict[str, list]) -> dict[str, list]:
        plain = [" ".join(plain_words(t)) for t in cols["text"]]
        keep = [i for i, p in enumerate(plain) if p]
        return {"row_idx": [cols["row_idx"][i] for i in keep], "is_train": [cols["split"][i] in TRAIN for i in keep], "plain": [plain[i] for i in keep]}

    some = some.select(F.col("row_idx").cast("long").alias("row_idx"), "split", "text")
    return map_batches(spread(some), batch, "row_idx long, is_train boolean, plain string").withColumn("key", digest("plain"))


def all_hashes(classes: DataFrame) -> DataFrame:
    """``g``: every rolling hash of every class once (for finding hot ones)."""

    def batch(cols: dict[str, list]) -> dict[str, list]:
        lists = [p.split(" ") for p in cols["plain"]]
        h, sizes = word_numbers(lists)
        every = _hashes(h, K)
        parts = [np.unique(every[end - n : end - K + 1]) for n, end in zip(sizes.tolist(), np.cumsum(sizes).tolist()) if n >= LONG]
        return {"g": np.concatenate(parts) if parts else np.zeros(0, np.int64)}

    return map_batches(classes.select("plain"), batch, "g long")


def minima(g: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Of every two neighbouring hashes, whether the first one is the minimum in the order (hot, hash); ``hot`` is sorted."""
    if len(g) < 2:
        return np.zeros(0, bool)
    rank = hot[np.minimum(np.searchsorted(hot, g), len(hot) - 1)] == g if len(hot) else np.zeros(len(g), bool)
    return (rank[:-1] < rank[1:]) | ((rank[:-1] == rank[1:]) & (g[:-1] <= g[1:]))


def chosen(first_wins: np.ndarray) -> np.ndarray:
    """Positions that are a minimum of a window of two (all of them where there is no window)."""
    keep = np.zeros(len(first_wins) + 1, bool)
    keep[:-1] |= first_wins
    keep[1:] |= ~first_wins
    return np.flatnonzero(keep) if len(first_wins) else np.zeros(1, np.int64)


@lru_cache(maxsize=10_000)
def spare_seeds(n: int) -> int:
    """How many seeds of a text of ``n`` words can be left out: any partner within the limit still shares another one."""
    longest = next(m for m in range(n, 2 * n + 2) if m - edits_allowed(m) > n)  # too long to be a partner
    return min(least_seeds(m, True) for m in range(n, longest)) - 1


def sketches(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64 bits a text: in each, whether the number of words that fall to it is odd.  An edit changes two bits at most."""
    bits = np.uint64(1) << (mix(h, 64) >> np.uint64(58))
    return np.bitwise_xor.reduceat(bits, np.cumsum(sizes) - sizes).view(np.int64) if len(h) else np.zeros(0, np.int64)


def fingerprints(classes: DataFrame, hot: dict[int, int], spared: bool) -> DataFrame:
    """``class_id, n, long_family, left_out, sketch, g, at``: the winnowed hashes of classes of seven words or more.

    ``spared`` leaves out the most frequent hot hashes of a class, as many (``left_out``) as ``spare_seeds`` allows; one side of
    the join is enough for that.
    """
    ordered = sorted(hot)
    shared = classes.sparkSession.sparkContext.broadcast((np.array(ordered, np.int64), np.array([hot[g] for g in ordered], np.int64)))

    def batch(cols: dict[str, list]) -> dict[str, list]:
        known, often = shared.value
        out: dict[str, list] = {c: [] for c in ("class_id", "n", "long_family", "left_out", "sketch", "g", "at")}
        lists = [p.split(" ") for p in cols["plain"]]
        h, sizes = word_numbers(lists)
        every_short, every_long = _hashes(h, K_SHORT), _hashes(h, K)  # of the whole batch; texts take their slices
        wins, sketch = minima(every_long, known), sketches(h, sizes)
        for i, (n, end) in enumerate(zip(sizes.tolist(), np.cumsum(sizes).tolist())):
            if edits_allowed(n + n // 5) == 0:  # no longer text within the limit either: only copies
                continue
            families = []
            if n < SHORT:
                short = every_short[end - n : end - K_SHORT + 1]
                families.append((False, 0, short, np.arange(len(short))))
            if n >= LONG:
                at = chosen(wins[end - n : end - K])
                seeds, left_out = every_long[end - n : end - K + 1][at], 0
                if spared and len(known):
                    k = np.minimum(np.searchsorted(known, seeds), len(known) - 1)
                    count = np.where(known[k] == seeds, often[k], 0)
                    top = np.argsort(-count, kind="stable")[: spare_seeds(n)]
                    top = top[count[top] > 0]
                    seeds, at, left_out = np.delete(seeds, top), np.delete(at, top), len(top)
                families.append((True, left_out, seeds, at))
            for long_family, left_out, seeds, at in families:
                for c, value in zip(out, (cols["class_id"][i], n, long_family, left_out, int(sketch[i]), seeds, at.astype(np.int32))):
                    out[c].append(value)
        return out

    schema = "class_id long, n int, long_family boolean, left_out int, sketch long, g array<long>, at array<int>"
    arrays = map_batches(classes.select("class_id", "plain"), batch, schema)
    return arrays.select("class_id", "n", "long_family", "left_out", "sketch", F.inline(F.arrays_zip("g", "at")))


def hot_hashes(classes: DataFrame) -> dict[int, int]:
    """Hot hashes with the number of classes that have them."""
    n = classes.count()
    hot = all_hashes(classes).groupBy("g").agg(F.count("*").alias("c")).where(F.col("c") > max(50, n // HOT_SHARE))
    return {r.g: r.c for r in hot.orderBy(F.desc("c"), "g").limit(MAX_HOT).collect()}  # beyond it only the order suffers


def seed_pairs(classes: DataFrame) -> DataFrame:
    """``a, b``: classes (train side, evaluation side) with enough common seeds and sketches that allow the limit."""
    hot = hot_hashes(classes)
    release(classes.sparkSession)
    a, b = fingerprints(classes.where("train"), hot, True), fingerprints(classes.where("evals"), hot, False)
    a = a.select(F.col("class_id").alias("a"), F.col("n").alias("na"), "left_out", "long_family", F.col("sketch").alias("sa"), "g", F.col("at").alias("pa"))
    b = b.select(F.col("class_id").alias("b"), F.col("n").alias("nb"), "long_family", F.col("sketch").alias("sb"), "g", F.col("at").alias("pb"))
    longer = F.greatest("na", "nb")
    edits = F.floor(longer * LIMIT_PERCENT / 100)
    seeds = a.join(b, ["long_family", "g"]).where(
        (F.col("a") != F.col("b")) & (F.abs(F.col("na") - F.col("nb")) <= edits) & (F.abs(F.col("pa") - F.col("pb")) <= edits)
        & (F.bit_count(F.col("sa").bitwiseXOR(F.col("sb"))) <= 2 * edits)
    )
    n, e = F.col("n"), F.floor(F.col("n") * LIMIT_PERCENT / 100)
    need_long = F.ceil((n - e - (K + WINDOW - 2) * (e + 1)) / WINDOW)
    need_short = n - K_SHORT + 1 - K_SHORT * e
    need = F.greatest(F.lit(1), F.when(F.col("long_family"), need_long).otherwise(need_short).cast("long"))  # least_seeds
    counted = seeds.groupBy("a", "b", "long_family").agg(F.count("*").alias("common"), F.max(longer).alias("n"), F.max("left_out").alias("left_out"))
    return counted.where(F.col("common") >= F.greatest(F.lit(1), need - F.col("left_out"))).select("a", "b").distinct()


def near_pairs(classes: DataFrame) -> DataFrame:
    """``a, b``: classes (train side, evaluation side) that are not equal but within the limit."""
    pairs = cut(seed_pairs(classes))
    release(classes.sparkSession)
    text = classes.select("class_id", "plain")
    both = pairs.join(text.select(F.col("class_id").alias("a"), F.col("plain").alias("ta")), "a").join(
        text.select(F.col("class_id").alias("b"), F.col("plain").alias("tb")), "b"
    )  # one text of a pair is shuffled with it, not both

    def align(cols: dict[str, list]) -> dict[str, list]:
        keep = [i for i, (x, y) in enumerate(zip(cols["ta"], cols["tb"])) if within_limit(x.split(" "), y.split(" "))]
        return {c: [cols[c][i] for i in keep] for c in ("a", "b")}

    return map_batches(both.select("a", "b", "ta", "tb"), align, "a long, b long")


def text_overlaps(rows: DataFrame) -> DataFrame:
    """``train_row, eval_row``: pairs with the same or nearly the same text."""
    texts = cut(text_classes(rows))
    grouped = texts.groupBy("key").agg(
        F.min("row_idx").alias("class_id"), F.first("plain").alias("plain"), F.max("is_train").alias("train"), F.max(~F.col("is_train")).alias("evals")
    )
    classes = cut(grouped)
    member = cut(texts.select("row_idx", "is_train", "key").join(classes.select("key", "class_id"), "key").select("row_idx", "is_train", "class_id"))
    del texts, grouped
    release(rows.sparkSession)
    near = near_pairs(classes.select("class_id", "plain", "train", "evals"))
    same = classes.where("train AND evals").select(F.col("class_id").alias("a"), F.col("class_id").alias("b"))
    return (
        near.unionByName(same)
        .join(member.where("is_train").select(F.col("class_id").alias("a"), F.col("row_idx").alias("train_row")), "a")
        .join(member.where("NOT is_train").select(F.col("class_id").alias("b"), F.col("row_idx").alias("eval_row")), "b")
        .select("train_row", "eval_row")
    )


def path_key(path: "F.Column") -> "F.Column":
    """One spelling of a path: forward slashes, no empty or ``.`` steps."""
    p = F.regexp_replace(F.trim(path), r"\\", "/")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(p, r"/(\./)+", "/"), "/+", "/"), r"^(\./)+", "")


def picture_overlaps(rows: DataFrame, blobs: DataFrame) -> DataFrame:
    """``train_row, eval_row``: pairs that show the same picture.

    Rows of one path have one blob, so a picture is the hash of its blob, or its path where there is no blob.
    """
    content = blobs.where("path IS NOT NULL").groupBy(path_key(F.col("path")).alias("path")).agg(F.min(digest("content")).alias("sha"))
    shown = (
        rows.where(F.col("split").isin(*TRAIN, *EVAL) & F.col("row_idx").isNotNull() & (F.length(F.trim("image_path")) > 0))
        .select(F.col("row_idx").cast("long").alias("row_idx"), F.col("split").isin(*TRAIN).alias("is_train"), path_key(F.col("image_path")).alias("path"))
        .join(content, "path", "left")
        .select("row_idx", "is_train", F.coalesce("sha", digest(F.concat(F.lit("path:"), "path"))).alias("picture"))
    )
    a = shown.where("is_train").select("picture", F.col("row_idx").alias("train_row"))
    b = shown.where("NOT is_train").select("picture", F.col("row_idx").alias("eval_row"))
    return a.join(b, "picture").select("train_row", "eval_row")


def find_overlaps(rows: DataFrame, blobs: DataFrame) -> DataFrame:
    """``train_row, eval_row, by_text, by_picture``: every overlapping pair once."""
    text = text_overlaps(rows).withColumns({"by_text": F.lit(True), "by_picture": F.lit(False)})
    picture = picture_overlaps(rows, blobs).withColumns({"by_text": F.lit(False), "by_picture": F.lit(True)})
    return text.unionByName(picture).groupBy("train_row", "eval_row").agg(F.max("by_text").alias("by_text"), F.max("by_picture").alias("by_picture"))


def overlap_report(rows: DataFrame, blobs: DataFrame) -> DataFrame:
    """Per evaluation split and source: pairs, evaluation rows that overlap, and their share (coverage)."""
    own = rows.where(F.col("split").isin(*EVAL)).select(
        F.col("row_idx").cast("long").alias("eval_row"), "split", F.split("source_img_path", "/")[0].alias("source")
    )
    pairs = find_overlaps(rows, blobs).groupBy("eval_row").agg(F.count("*").alias("n_pairs"), F.max("by_text").alias("by_text"), F.max("by_picture").alias("by_picture"))
    n = F.col("n_pairs")
    return (
        own.join(pairs, "eval_row", "left").groupBy("split", "source")
        .agg(F.count("*").alias("n_rows"), F.count(n).alias("n_overlapping"), F.coalesce(F.sum(n), F.lit(0)).alias("n_pairs"),
             F.count_if("by_text").alias("n_by_text"), F.count_if("by_picture").alias("n_by_picture"))
        .withColumn("coverage", F.col("n_overlapping") / F.col("n_rows"))
    )
