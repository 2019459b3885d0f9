"""Problem 5: missing or wrong document language labels.

Method: error-correcting output codes.  Each language (Arabic in Latin letters being a class of its own) has a codeword; one
binary n-gram classifier per bit predicts that bit, and loss-weighted decoding chooses the nearest codeword: the class whose
bits cost the least logistic loss.  A small gap to the second nearest flags ambiguity.  Margins add up over words, so the same
classifiers score every word; a Viterbi pass with a price for changing finds the segments of mixed texts.

The classifiers are fitted on the driver on a bounded sample (``SAMPLE_ROWS`` labelled rows chosen by a seeded hash) in
two rounds; rows whose label contradicts the first round clearly are left out of the second, as labels are partly wrong.

Defined results: null and blank texts and texts without words have no language; handles, hashtags and emoji are no words; a
label in any usual spelling counts as its language, any other label as none; repeated rows repeat; without any labelled row no
language is given.  Texts are processed whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.sample import bounded_sample
from .abuse import _one_form
from .base import map_batches, nonblank, spread

SAMPLE_ROWS = 8_000
SEED = 5
WINDOW = 5
LEAST_SEGMENT = 5
BITS = 15
BUCKETS = 1 << 16
#: One word says at most 8: a segment of five words between two of another language can gain 40, its two changes must cost less.
CHANGE = 14.0
RIDGE = 0.3
MOST_SAY = 8.0
AMBIGUOUS = 2.0
CLASSES = ("ar", "ar_latin", "en", "fr", "es", "de", "fa")

# fixed values: usual spellings of the languages' labels
LABELS = {
    "ar": ("ar", "ara", "arabic"), "en": ("en", "eng", "english"), "fr": ("fr", "fra", "fre", "french"),
    "es": ("es", "spa", "spanish"), "de": ("de", "deu", "ger", "german"), "fa": ("fa", "fas", "per", "persian", "farsi"),
}
SPELLED = {s: code for code, spellings in LABELS.items() for s in spellings}

_SKIP = re.compile(r"(?<!\w)[@#]\w+")
_WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
_SEPARATE = re.compile("[\u0300-\u036f\u0653-\u0655]")
_ARABIC = re.compile("[؀-ۿ]")


def label_code(label: Column) -> Column:
    """A delivered label as a language code, or null."""
    known = F.create_map(*[F.lit(x) for pair in SPELLED.items() for x in pair])
    return F.try_element_at(known, F.lower(F.trim(F.split(label, "[-_]")[0])))


def codewords() -> np.ndarray:
    """A code of +1/-1 of ``BITS`` columns, chosen greedily from seeded candidates for the largest least distance."""
    rng = np.random.default_rng(SEED)
    best, score = None, -1
    for _ in range(400):
        code = rng.choice([-1, 1], size=(len(CLASSES), BITS))
        between = (code[:, None] != code[None]).sum(2) + BITS * np.eye(len(CLASSES), dtype=int)
        balanced = (np.abs(code.sum(0)) < len(CLASSES)).all()
        if balanced and between.min() > score:
            best, score = code, between.min()
    return best


def text_words(text: str | None) -> list[str]:
    """Words in one form of characters, without handles, hashtags and numbers."""
    if not text:
        return []
    if not text.isascii():
        text = text.translate(_one_form())  # one table for all: compatibility forms, invisible characters, vowel marks, look-alikes
        text = unicodedata.normalize("NFC", text) if _SEPARATE.search(text) else text
    return [w for w in _WORD.findall(_SKIP.sub(" ", text).casefold()) if not w.isdigit()]


def word_features(w: str) -> list[int]:
    """Hashed features of a word: itself, its ends and its inner three- and four-grams."""
    p = f"<{w}>"
    grams = {"=" + w, *(p[i : i + k] for k in (2, 3, 4) for i in range(max(0, len(p) - k) + 1))}
    return [_stable(g) for g in grams]


def _stable(s: str) -> int:
    h = 0xCBF29CE484222325
    for b in s.encode("utf-8", "replace"):
        h = ((h ^ b) * 0x100000001B3) & 0xFFFFFFFFFFFFFFFF
    return (h ^ h >> 29) & (BUCKETS - 1)


class Coder:
    """Fitted bit classifiers; scores words by class."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray, code: np.ndarray) -> None:
        self.weights, self.bias, self.code, self.known, self.known_costs = weights, bias, code, {}, {}

    def word_margins(self, w: str) -> np.ndarray:
        m = self.known.get(w)
        if m is None:
            m = self.known[w] = self.weights[word_features(w)].sum(0)
            if len(self.known) > 200_000:  # a cache, not a limit
                self.known.clear()
        return m

    def costs(self, margins: np.ndarray) -> np.ndarray:
        """Loss-weighted decoding: logistic loss of every class's codeword."""
        return np.logaddexp(0, -margins[..., None, :] * self.code).sum(-1)

    def word_cost(self, w: str) -> np.ndarray:
        """A word's cost by class beyond its cheapest class; one word has bounded say."""
        c = self.known_costs.get(w)
        if c is None:
            c = self.costs(self.word_margins(w) + self.bias)
            c = np.minimum(c - c.min(), MOST_SAY)
            if len(self.known_costs) < 200_000:  # a cache, not a limit
                self.known_costs[w] = c
        return c

    def batch_costs(self, lists: list[list[str]]) -> np.ndarray:
        """Costs of all words of several texts, one after the other; every distinct word is scored once."""
        index: dict[str, int] = {}
        ids = np.array([index.setdefault(w, len(index)) for ws in lists for w in ws], dtype=np.int64)
        new = [w for w in index if w not in self.known_costs]
        for lo in range(0, len(new), 20_000):
            part = [word_features(w) for w in new[lo : lo + 20_000]]
            begins = np.cumsum([0, *map(len, part[:-1])])
            margins = np.add.reduceat(self.weights[np.array([f for fs in part for f in fs])], begins, axis=0)
            c = self.costs(margins + self.bias)
            c = np.minimum(c - c.min(1, keepdims=True), MOST_SAY)
            if len(self.known_costs) > 200_000:  # a cache, not a limit
                self.known_costs = {w: self.known_costs[w] for w in index if w in self.known_costs}
            self.known_costs.update(zip(new[lo : lo + 20_000], c))
        return np.array([self.known_costs[w] for w in index])[ids] if index else np.zeros((0, len(CLASSES)))

    def batch_segments(self, lists: list[list[str]]) -> tuple[list[list[tuple[int, int, int, float]]], np.ndarray]:
        """(first word, words, class, confidence) of each text's maximal runs in one language, and each text's whole costs."""
        cost = self.batch_costs(lists)
        sizes = np.array([len(ws) for ws in lists], dtype=np.int64)
        ends, some = np.cumsum(sizes), np.flatnonzero(sizes)
        whole = np.zeros((len(lists), len(CLASSES)))
        if len(some):
            whole[some] = np.add.reduceat(cost, (ends - sizes)[some], axis=0)
        best = whole.argmin(1)
        least = whole.min(1)
        conf = 1 / np.exp(np.clip(least[:, None] - whole, -50, 50)).sum(1)
        out: list[list[tuple[int, int, int, float]]] = [[] for _ in lists]
        for k in some[least[some] <= CHANGE].tolist():  # every word's cheapest class costs 0, so no change can pay
            out[k] = [(0, int(sizes[k]), int(best[k]), float(conf[k]))]
        hard = some[least[some] > CHANGE]
        hard = hard[np.argsort(sizes[hard], kind="stable")]
        for lo in range(0, len(hard), 256):
            for k, path in zip(hard[lo : lo + 256].tolist(), self._paths(cost, (ends - sizes)[hard[lo : lo + 256]], sizes[hard[lo : lo + 256]])):
                own = cost[ends[k] - sizes[k] : ends[k]]
                begins = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]]))
                sums = np.add.reduceat(own, begins, axis=0)
                n = np.diff(np.append(begins, len(path)))
                chosen = path[begins]
                c = 1 / np.exp(np.clip(sums[np.arange(len(begins)), chosen][:, None] - sums, -50, 50)).sum(1)
                out[k] = list(zip(begins.tolist(), n.tolist(), chosen.tolist(), c.tolist()))
        return out, whole

    @staticmethod
    def _paths(cost: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
        """Cheapest class of every word of several texts (shortest first), where a change costs ``CHANGE``."""
        n, steps = len(sizes), int(sizes[-1])
        total, back = cost[starts].copy(), np.full((steps, n, len(CLASSES)), -1, np.int8)
        for t in range(1, steps):
            on = int(np.searchsorted(sizes, t, side="right"))  # texts from here on have a word t
            now = total[on:]
            least = now.argmin(1)
            move = now[np.arange(n - on), least] + CHANGE
            back[t, on:] = np.where(now <= move[:, None], -1, least[:, None])
            total[on:] = np.minimum(now, move[:, None]) + cost[starts[on:] + t]
        path, now = np.zeros((steps, n), np.int8), total.argmin(1)
        for t in range(steps - 1, -1, -1):
            path[t] = now
            step = back[t, np.arange(n), now]
            now = np.where((step >= 0) & (sizes > t), step, now)
        return [path[:s, k].astype(np.int64) for k, s in enumerate(sizes.tolist())]

    def segments(self, text: str | None) -> list[tuple[int, int, int, float]]:
        return self.word_segments(text_words(text))

    def word_segments(self, ws: list[str]) -> list[tuple[int, int, int, float]]:
        return self.batch_segments([ws])[0][0]

    def batch_languages(self, texts: list[str | None]) -> list[list[tuple[str, int, float, bool]]]:
        """(language, words, confidence, ambiguous) of each text: of every language with a segment, or the nearest one of a short text."""
        lists = [text_words(t) for t in texts]
        parts, whole = self.batch_segments(lists)
        out = []
        for ws, found, cost in zip(lists, parts, whole):
            by: dict[str, list[tuple[int, float]]] = {}
            for _, n, k, conf in found:
                if n >= LEAST_SEGMENT:
                    by.setdefault(CLASSES[k].split("_")[0], []).append((n, conf))
            if not by and found:
                order = np.argsort(cost)
                conf = float(1 / np.exp(np.clip(cost[order[0]] - cost, -50, 50)).sum())
                out.append([(CLASSES[order[0]].split("_")[0], len(ws), conf, bool(cost[order[1]] - cost[order[0]] < AMBIGUOUS))])
                continue
            own = []
            for lang, some in by.items():
                n = sum(p for p, _ in some)
                conf = sum(p * c for p, c in some) / n
                own.append((lang, n, conf, conf < 0.9))
            out.append(own)
        return out

    def languages(self, text: str | None) -> list[tuple[str, int, float, bool]]:
        return self.batch_languages([text])[0]


def _fit(ids: np.ndarray, starts: np.ndarray, target: np.ndarray, vocab: list[str], code: np.ndarray, steps: int = 90) -> Coder:
    """Bit classifiers over windows of words: ``ids`` are the windows' words one after the other, ``starts`` their begins."""
    feats = [word_features(w) for w in vocab]
    sizes = np.array([len(f) for f in feats])
    ind = np.fromiter((f for fs in feats for f in fs), dtype=np.int64, count=int(sizes.sum()))
    used, at = np.unique(ind, return_inverse=True)
    word_start = np.cumsum(sizes) - sizes
    by_feature = np.argsort(at, kind="stable")
    feature_start = np.searchsorted(at[by_feature], np.arange(len(used)))
    word_of = np.repeat(np.arange(len(vocab)), sizes)[by_feature]
    by_word = np.argsort(ids, kind="stable")
    seen, seen_start = np.unique(ids[by_word], return_index=True)
    n_words = np.diff(np.append(starts, len(ids))).astype(np.float32)[:, None]
    window_of = np.repeat(np.arange(len(starts)), n_words[:, 0].astype(int))[by_word]
    share = np.bincount(target, minlength=len(CLASSES)) / len(target)
    weight = (1 / np.sqrt(np.maximum(share, 1e-4)) / len(CLASSES))[target].astype(np.float32)[:, None]  # rare classes count more
    want = code[target].astype(np.float32)
    w, b = np.zeros((len(used), BITS), np.float32), np.zeros(BITS, np.float32)
    hw, hb = np.full_like(w, 1e-6), np.full_like(b, 1e-6)
    for _ in range(steps):
        margins = np.add.reduceat(w[at], word_start)
        m = np.add.reduceat(margins[ids], starts) + b * n_words
        e = -want * weight / (1 + np.exp(np.clip(want * m, -30, 30)))
        per_word = np.zeros((len(vocab), BITS), np.float32)
        per_word[seen] = np.add.reduceat(e[window_of], seen_start)
        gw = np.add.reduceat(per_word[word_of], feature_start) + RIDGE * w
        gb = (e * n_words).sum(0)
        hw, hb = hw + gw**2, hb + gb**2
        w -= 0.25 * gw / np.sqrt(hw)
        b -= 0.02 * gb / np.sqrt(hb)
    full = np.zeros((BUCKETS, BITS), np.float32)
    full[used] = w
    return Coder(full, b, code)


def fit_coder(rows: list[tuple[str, str]]) -> Coder | None:
    """Fit on (text, language) rows, cut into windows of ``WINDOW`` words."""
    vocab: dict[str, int] = {}
    ids, starts, target = [], [], []
    for text, lang in rows:
        ws = text_words(text)
        for i in range(0, len(ws), WINDOW):
            part = ws[i : i + WINDOW]
            latin = sum(not _ARABIC.search(w) for w in part) > len(part) / 2
            if lang == "fa" and latin or lang not in ("ar", "fa") and not latin:
                continue  # the window's script contradicts the label
            starts.append(len(ids))
            ids.extend(vocab.setdefault(w, len(vocab)) for w in part)
            target.append(CLASSES.index("ar_latin" if lang == "ar" and latin else lang))
    if not starts:
        return None
    code, words = codewords(), list(vocab)
    ids, starts, y = np.array(ids), np.array(starts), np.array(target)
    first = _fit(ids, starts, y, words, code)
    margins = np.array([first.word_margins(w) for w in words]) + first.bias
    first.known.clear()
    costs = np.add.reduceat(first.costs(margins)[ids], starts)
    keep = np.flatnonzero(costs[np.arange(len(y)), y] - costs.min(1) < 3.0)
    if not len(keep):
        return first
    ends = np.append(starts, len(ids))
    kept = np.concatenate([ids[ends[i] : ends[i + 1]] for i in keep])
    sizes = (ends[1:] - ends[:-1])[keep]
    return _fit(kept, np.cumsum(sizes) - sizes, y[keep], words, code)


def train(rows: DataFrame, n: int = SAMPLE_ROWS) -> Coder | None:
    labelled = rows.where(nonblank("text")).select("row_idx", "text", label_code(F.col("lang")).alias("code")).where("code IS NOT NULL")
    own = bounded_sample(labelled, "row_idx", n, SEED).collect()
    return fit_coder([(r.text, r.code) for r in sorted(own, key=lambda r: (r.row_idx is None, r.row_idx, r.text))[:n]])


def detect(rows: DataFrame, coder: Coder | None, id_col: str = "row_idx") -> DataFrame:
    """``id, code, lang, n_words, confidence, ambiguous, n_langs``: one row per language of every row with words."""
    kind = dict(rows.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, code string, lang string, n_words int, confidence double, ambiguous boolean, n_langs int"
    if coder is None:
        return rows.sparkSession.createDataFrame([], schema)
    shared = rows.sparkSession.sparkContext.broadcast((coder.weights.astype(np.float32), coder.bias, coder.code))  # BUCKETS x BITS
    some = rows.where(nonblank("text") & F.col(id_col).isNotNull()).select(id_col, label_code(F.col("lang")).alias("code"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Coder(*shared.value)
        for b in batches:
            at, out = [], []
            for i, langs in enumerate(own.batch_languages(b.column(2).to_pylist())):
                at.extend([i] * len(langs))
                out.extend((*x, len(langs)) for x in langs)
            take = pa.array(at, pa.int64())
            cols = list(zip(*out)) if out else [[]] * 5
            kinds = (pa.string(), pa.int32(), pa.float64(), pa.bool_(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(take), b.column(1).take(take), *(pa.array(c, k) for c, k in zip(cols, kinds))],
                names=[id_col, "code", "lang", "n_words", "confidence", "ambiguous", "n_langs"],
            )

    return spread(some).mapInArrow(run, schema)


def segments(rows: DataFrame, coder: Coder | None, id_col: str = "row_idx") -> DataFrame:
    """``id, first_word, n_words, lang, confidence``: every segment of at least ``LEAST_SEGMENT`` words of every row."""
    kind = dict(rows.dtypes)[id_col]
    schema = f"`{id_col}` {kind}, first_word int, n_words int, lang string, confidence double"
    if coder is None:
        return rows.sparkSession.createDataFrame([], schema)
    shared = rows.sparkSession.sparkContext.broadcast((coder.weights.astype(np.float32), coder.bias, coder.code))  # BUCKETS x BITS

    def batch(cols: dict[str, list]) -> dict[str, list]:
        own = Coder(*shared.value)
        parts, _ = own.batch_segments([text_words(t) for t in cols["text"]])
        found = [(key, first, n, CLASSES[k].split("_")[0], conf) for key, own_parts in zip(cols[id_col], parts) for first, n, k, conf in own_parts if n >= LEAST_SEGMENT]
        return dict(zip((id_col, "first_word", "n_words", "lang", "confidence"), zip(*found))) if found else {c: [] for c in (id_col, "first_word", "n_words", "lang", "confidence")}

    return map_batches(spread(rows.where(nonblank("text") & F.col(id_col).isNotNull()).select(id_col, "text")), batch, schema)


def wrong_labels(found: DataFrame) -> DataFrame:
    """Rows in one language whose label is missing or names another, and every language of mixed rows."""
    return found.where((F.col("n_langs") > 1) | F.col("code").isNull() | (F.col("code") != F.col("lang")))
