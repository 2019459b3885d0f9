"""Problem 7: abusive, hateful or sexual content.

Method: a classifier chain.  Toxicity categories are predicted one after the other by linear models over word n-grams; each later
model also gets the earlier categories' log-odds, which in training come from out-of-fold predictions, so that a later link
learns to trust them only as far as they hold on unseen rows; folds go by text, and n-grams are chosen anew without each fold.  The last link, trained on the toxicity score of one table and the
hate label of the other, gives a row's score.  Labels are noisy; n-grams count only with a clear excess of labelled rows, and
n-grams of quoting, reporting or harmless use are those that lower the rate among rows that have an abusive n-gram.

The models are fitted on the driver on a bounded sample: ``SAMPLE_ROWS`` labelled rows of each table, chosen by a seeded hash.  Scoring is one narrow pass over all rows.

Defined results: null and blank texts score 0; labels that are null, NaN or out of range are not used for fitting; without any
labelled row every text scores 0; repeated rows score alike.  Texts are scored whole.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.sample import bounded_sample
from .base import map_batches, spread
from .lookalike import _FOLD, _SPACE, _TO_ARABIC, _TO_LATIN, _UNSEEN
from .words import _dropped

SAMPLE_ROWS = 30_000
CHAIN = ("insult", "threat", "identity_attack", "obscene", "sexual_explicit", "severe_toxicity", "toxicity")
FINAL = "abusive"
FOLDS = 3
MOST_WORDS = 3
THRESHOLD = 0.3
RIDGE = 1.0
#: An n-gram needs so many labelled rows, and so many standard deviations more of them than chance gives.
LEAST_HITS, LEAST_EXCESS = 5, 4.0

_REPEATED = re.compile(r"([^\W\d_])\1{2,}")
_DIGIT_IN_WORD = re.compile(r"(?<=[a-z])[013457$@!](?=[a-z])")
# fixed values: signs written for letters
_LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "$": "s", "@": "a", "!": "i"}
_LEET_SIGN = re.compile(r"[013457$@!](?=[a-z])")
_MASKED = re.compile(r"(?<=\w)\*+(?=\w)")
_ACCENT = re.compile("[\u0300-\u036f]")
_MARKS = re.compile("[ً-ْٰـ]")


def score_words(text: str | None, slots: dict[str, str]) -> list[str]:
    """Words with layout, look-alikes, stretched letters and signs for letters undone; list words become their slot."""
    if not text:
        return []
    if text.isascii():
        t = text.lower()
    else:
        t = text.translate(_one_form())
        t = (unicodedata.normalize("NFC", t) if _ACCENT.search(t) else t).casefold()
    if _LEET_SIGN.search(t):
        t = _DIGIT_IN_WORD.sub(lambda m: _LEET[m.group()], t)
    if "*" in t:
        t = _MASKED.sub("", t)  # masked letters: what is left stays one word
    stretched = _REPEATED.search(t) is not None
    ws = (t.translate(_ascii_dropped()) if t.isascii() else t.translate(_dropped())).split()
    if stretched:
        ws = [_REPEATED.sub(r"\1", w) if len(w) > 3 else w for w in ws]
    return [slots.get(w, w) for w in ws]


@lru_cache(maxsize=1)
def _one_form() -> dict[int, str | None]:
    """One table for all: compatibility forms folded, invisible characters and vowel marks dropped, look-alikes replaced."""
    table: dict[int, str | None] = {}
    for cp in range(0x80, 0x10000):
        c = chr(cp)
        if _FOLD.match(c):
            table[cp] = unicodedata.normalize("NFKC", c)
        elif _SPACE.match(c):
            table[cp] = " "
        elif _MARKS.match(c) or _UNSEEN.match(c):
            table[cp] = None
    return {**table, **{k: chr(v) for k, v in (*_TO_LATIN.items(), *_TO_ARABIC.items())}}


@lru_cache(maxsize=1)
def _ascii_dropped() -> dict[int, None]:
    return {cp: None for cp in _dropped() if cp < 128}


def ngrams(ws: list[str]) -> set[str]:
    """N-grams of one text; they are made anew where needed, not kept for the whole sample."""
    out = set(ws)
    for k in range(2, MOST_WORDS + 1):
        out.update(" ".join(ws[i : i + k]) for i in range(len(ws) - k + 1))
    return out


def word_slots(lexicon: DataFrame) -> dict[str, str]:
    """One-word terms of the word list by category, the list being small and fixed; names of persons are left out."""
    rows = lexicon.where("term IS NOT NULL AND category IN ('group_name')").select("term", "category").collect()
    return {ws[0]: f"<{r.category}>" for r in rows if len(ws := score_words(r.term, {})) == 1}


def sample_rows(moderation: DataFrame, multimodal: DataFrame, rows: int = SAMPLE_ROWS) -> list:
    """``text`` and labels of the bounded training sample."""
    first = moderation.where("text IS NOT NULL AND labels IS NOT NULL").select("row_idx", "text", *[F.col(f"labels.{c}").alias(c) for c in CHAIN], F.lit(None).cast("int").alias("hate"))
    second = multimodal.where("text IS NOT NULL AND hate_label IN (0, 1)").select("row_idx", "text", *[F.lit(None).cast("double").alias(c) for c in CHAIN], F.col("hate_label").alias("hate"))
    out = []
    for part in (first, second):
        own = bounded_sample(part, "row_idx", rows, 7).collect()
        out += sorted(own, key=lambda r: (r.row_idx is None, r.row_idx, r.text))[:rows]
    return out


def _labels(rows: list) -> dict[str, np.ndarray]:
    def binary(v: float | None) -> float:
        return math.nan if v is None or not 0 <= v <= 1 else float(v >= 0.5)

    out = {c: np.array([binary(r[c]) for r in rows]) for c in CHAIN}
    hate = np.array([math.nan if r["hate"] is None else float(r["hate"]) for r in rows])
    out[FINAL] = np.where(np.isnan(hate), out["toxicity"], hate)
    return out


def _present(ws: list[str], known: "dict | set", firsts: set[str]) -> set[str]:
    """The known n-grams of a text; words that begin none of them cost one lookup."""
    found = set()
    for k, w in enumerate(ws):
        if w in firsts:
            gram = w
            if gram in known:
                found.add(gram)
            for x in ws[k + 1 : k + MOST_WORDS]:
                gram = f"{gram} {x}"
                if gram in known:
                    found.add(gram)
    return found


def _firsts(grams: "dict | set") -> set[str]:
    return {g.split(" ", 1)[0] for g in grams}


def choose_features(lists: list[list[str]], y: np.ndarray) -> dict[str, int]:
    """N-grams with a clear excess of labelled rows, then those that lower the rate among rows that have one of these."""
    known = np.flatnonzero(~np.isnan(y))
    base = float(np.clip(y[known].mean(), 1e-3, 0.999)) if len(known) else 0.5
    hits: Counter = Counter()
    for i in known[y[known] == 1]:
        hits.update(ngrams(lists[i]))
    hits = Counter({g: c for g, c in hits.items() if c >= LEAST_HITS})
    total: Counter = Counter()
    firsts = _firsts(hits)
    for i in known:
        total.update(_present(lists[i], hits, firsts))

    def excess(p: int, n: int, rate: float) -> float:
        return (p - n * rate) / math.sqrt(n * rate * (1 - rate) + 1)

    up = {g for g, p in hits.items() if excess(p, total[g], base) >= LEAST_EXCESS and p / total[g] >= max(0.3, 2 * base)}
    firsts = _firsts(up)
    near = [i for i in known if _present(lists[i], up, firsts)]
    rate = float(np.clip(y[near].mean(), 1e-3, 0.999)) if near else 0.5
    n_near, p_near = Counter(), Counter()
    for i in near:
        own = ngrams(lists[i])
        n_near.update(own)
        if y[i]:
            p_near.update(own)
    down = {g for g, n in n_near.items() if n >= 4 and excess(p_near[g], n, rate) <= -3}
    return {g: k for k, g in enumerate(sorted(up | down))}


class Linear:
    """Logistic regression over sparse 0/1 features and a few dense ones, ridge penalty, full-batch adaptive steps."""

    def __init__(self, n_sparse: int, n_dense: int) -> None:
        self.w, self.d, self.b = np.zeros(n_sparse), np.zeros(n_dense), 0.0

    def logit(self, rid: np.ndarray, ind: np.ndarray, n: int, dense: np.ndarray) -> np.ndarray:
        return np.bincount(rid, weights=self.w[ind], minlength=n) + dense @ self.d + self.b

    def fit(self, rid: np.ndarray, ind: np.ndarray, dense: np.ndarray, y: np.ndarray, use: np.ndarray, steps: int = 120) -> "Linear":
        n, keep = len(y), use[rid]
        r, i, target, weight = rid[keep], ind[keep], np.nan_to_num(y), use.astype(float)
        rate = float(np.clip((target * weight).sum() / max(weight.sum(), 1), 1e-3, 0.999))
        self.b = math.log(rate / (1 - rate))
        hw, hd, hb = np.full(len(self.w), 1e-6), np.full(len(self.d), 1e-6), 1e-6
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(self.logit(r, i, n, dense), -30, 30)))
            e = (p - target) * weight
            gw = np.bincount(i, weights=e[r], minlength=len(self.w)) + RIDGE * self.w
            gd, gb = dense.T @ e + self.d, e.sum()
            hw, hd, hb = hw + gw**2, hd + gd**2, hb + gb**2
            self.w -= 0.5 * gw / np.sqrt(hw)
            self.d -= 0.2 * gd / np.sqrt(hd)
            self.b -= 0.3 * gb / math.sqrt(hb)
        return self


class Chain:
    """The fitted chain: features, slots and one linear model per link."""

    def __init__(self, slots: dict[str, str], features: dict[str, int], links: list[tuple[str, Linear]]) -> None:
        self.slots, self.features, self.links = slots, features, links

    def sparse(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        rid, ind, firsts = [], [], self._words()
        for i, t in enumerate(texts):
            found = _present(score_words(t, self.slots), self.features, firsts)
            rid.extend([i] * len(found))
            ind.extend(self.features[g] for g in found)
        return np.array(rid, dtype=np.int64), np.array(ind, dtype=np.int64)

    def _words(self) -> set[str]:
        if not hasattr(self, "_first"):
            self._first = _firsts(self.features)
        return self._first

    def scores(self, texts: list[str | None]) -> dict[str, np.ndarray]:
        rid, ind = self.sparse(texts)
        n, logits, out = len(texts), [], {}
        for k, (name, model) in enumerate(self.links):
            dense = np.array(logits).T if logits else np.zeros((n, 0))
            z = model.logit(rid, ind, n, dense)
            logits.append(np.clip(z, -6, 6))
            out[name] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        blank = np.array([not t or t.isspace() for t in texts])
        return {k: np.where(blank, 0.0, v) for k, v in out.items()}


def _matrix(lists: list[list[str]], features: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every n-gram that is a feature."""
    firsts = _firsts(features)
    ind = [sorted(features[g] for g in _present(ws, features, firsts)) for ws in lists]
    return np.repeat(np.arange(len(lists)), [len(x) for x in ind]), np.array([k for x in ind for k in x], dtype=np.int64)


def fit_chain(rows: list, slots: dict[str, str]) -> Chain:
    """Later links see log-odds of models that saw neither the row nor any copy of its text, in their features or their weights."""
    y = _labels(rows)
    lists = [[sys.intern(w) for w in score_words(r["text"], slots)] for r in rows]
    any_label = np.where(np.isnan(y[FINAL]), np.nan, np.nanmax([np.nan_to_num(y[c]) for c in (*CHAIN, FINAL)], axis=0)) if rows else np.zeros(0)
    fold = np.array([zlib.crc32(" ".join(ws).encode("utf-8", "surrogatepass")) % FOLDS for ws in lists], dtype=np.int64)
    features = choose_features(lists, any_label)
    whole = _matrix(lists, features)
    parts = []
    for f in range(FOLDS):
        own = choose_features(lists, np.where(fold == f, np.nan, any_label))
        parts.append((len(own), *_matrix(lists, own)))
    links, logits = [], []
    for name in (*CHAIN, FINAL):
        dense = np.array(logits).T if logits else np.zeros((len(rows), 0))
        usable = ~np.isnan(y[name])
        links.append((name, Linear(len(features), dense.shape[1]).fit(*whole, dense, y[name], usable)))
        z = np.zeros(len(rows))
        for f, (n, rid, ind) in enumerate(parts):
            part = Linear(n, dense.shape[1]).fit(rid, ind, dense, y[name], usable & (fold != f), steps=80)
            own = fold == f
            z[own] = part.logit(rid, ind, len(rows), dense)[own]
        logits.append(np.clip(z, -6, 6))
    return Chain(slots, features, links)


def score_texts(rows: DataFrame, chain: Chain, keys: list[str]) -> DataFrame:
    """``keys``, one score per category and ``abusive``, for every row."""
    kinds, shared = dict(rows.dtypes), rows.sparkSession.sparkContext.broadcast(chain)  # bounded by the sample
    names = [n for n, _ in chain.links]

    def batch(cols: dict[str, list]) -> dict[str, list]:
        scores = shared.value.scores(cols["text"])
        return {**{k: cols[k] for k in keys}, **{n: scores[n].tolist() for n in names}}

    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), *(f"{n} double" for n in names)])
    return map_batches(spread(rows.select(*keys, "text")), batch, schema)


def train(moderation: DataFrame, multimodal: DataFrame, lexicon: DataFrame, rows: int = SAMPLE_ROWS) -> Chain:
    return fit_chain(sample_rows(moderation, multimodal, rows), word_slots(lexicon))
