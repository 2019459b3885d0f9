"""Training of the personal-information model: ``python -m modq.llm.pii_train DATA_DIR [MINUTES] [PROCESSES]``.

Texts come from a bounded sample (``SAMPLE_ROWS`` distinct texts of moderation_examples, those with the smallest seeded hash).  Labelled
spans are made by construction: in real texts the seed forms below and the word list find places of personal information, and
most of their values are replaced by generated ones of the same kind (``pii_names``); sentences around generated values, and
decoys that look alike and are none, are put between the sentences of other texts.  The model therefore sees each name, street or
number about once and cannot be a list of them.

Loss: negative log-likelihood of the CRF over windows; Adam on gradients averaged over processes; the saved weights are a running
average.  A tenth of the texts is held out; ``main`` prints precision and recall of (text, kind) there.
"""

from __future__ import annotations

import hashlib
import multiprocessing as mp
import re
import sys
import time
from collections import Counter
from pathlib import Path

import numpy as np

from . import pii, pii_names
from .pii import KINDS, SYMBOLS, TAGS, BiLstmCrf

SAMPLE_ROWS = 40_000
STEPS = 160
# fixed values: forms of address before a family name
TITLES = ("mr", "mrs", "ms", "miss", "dr", "prof", "mme", "mlle", "herr", "frau", "sr", "sra", "señor", "señora", "sir")
_WORD = re.compile(r"[A-Za-zÀ-ÿ]+(?:[-'’][A-Za-zÀ-ÿ]+)*")
_W = r"[A-ZÀ-Ý][A-Za-zÀ-ÿ]+(?:[-'’][A-Za-zÀ-ÿ]+)*"
_NAME_PAIR = re.compile(rf"\b(?P<g>{_W}) (?=(?:[A-Z]\. )?(?P<f>{_W}))|\b(?P<f2>{_W}), (?=(?P<g2>{_W}))")

# seed forms: they find the places in real texts whose values are then replaced by generated ones; scoring never sees them
EMAIL = re.compile(
    r"[A-Za-z0-9][\w.+\-]*(?:\s?(?:@|[(\[]\s?at\s?[)\]])\s?| at )[A-Za-z][\w\-]*(?:(?:\.|\s?[(\[]\s?dot\s?[)\]]\s?| dot )[A-Za-z][\w\-]*)+", re.IGNORECASE
)
PHONE = re.compile(r"(?<![\w#])(?:\+\d|\(\d{2,5}\)|00\d|0\d|1[.\-]\d{3}[.\-]|\d{3}-\d{4}(?!\d|-\d))(?:[ ().\-/]{0,2}\d)*(?!\d)")
NUMBER = re.compile(r"[A-Za-z]{0,4}\d[\dA-Za-z]*(?:[ \-/.]\d[\dA-Za-z]*)*(?:-?[A-Za-z])?")
STREET = r"(?:st|street|rd|road|ave|avenue|blvd|boulevard|lane|ln|close|crescent|drive|dr|way|row|court|place|square|terrace|rise|hill|gardens)"
_TOWN = r"(?:, \d [A-Za-z]\b)?(?:, (?:\d{4,5} )?(?-i:[A-ZÀ-Ý])[^\W\d_]+(?: (?-i:[A-ZÀ-Ý])[^\W\d_]+)?(?: \d{4,5})?)?"
ADDRESS = re.compile(
    rf"(?:(?:(?:flat|apt\.?|apartment|unit|suite) \d+\w?, ?)?\d+[a-z]?,? (?!on\b|in\b|at\b|of\b|the\b|to\b|and\b)(?:[^\W\d_][\w'’\-]* ){{1,3}}{STREET}\b\.?"
    r"|\d+[a-z]?,? (?:rue|avenue|boulevard|place|chemin|quai|impasse)\b(?: (?!on\b|in\b|at\b)[^\W\d_]+){1,2}(?: (?-i:[A-ZÀ-Ý])[^\W\d_]+){0,2}"
    r"|\b(?:calle|avenida|plaza|paseo) (?:[^\W\d_]+ ){1,4}\d+|[^\W\d_]+(?:straße|strasse|gasse|allee|weg|platz|ufer) \d+"
    r"|\b(?:am|im|an der|auf der|auf dem|zum|zur) (?-i:[A-ZÄÖÜ])[^\W\d_]+ \d+"
    r"|\bp\.? ?o\.? ?box \d+|\b(?:postfach|apartado(?: de correos)?|bo[iî]te postale|b\.?p\.?) \d+)" + _TOWN,
    re.IGNORECASE,
)
ID_WORDS = re.compile(
    r"(?:passport|passeport|pasaporte|reisepass|ssn|social security|s[ée]curit[ée] sociale|seguridad social|tax id|tax number|steuer\w*|national id"
    r"|id card|identity card|\bdni\b|\bnie\b|\bnif\b|ausweis\w*|driving licen[cs]e|driver'?s licen[cs]e|licen[cs]e|licencia|permis|f[üu]hrerschein\w*|identidad|identit[ée])"
    r"\b[^\d.!?]{0,24}(?:\bno\. ?)?$",
    re.IGNORECASE,
)


def family_like(w: str, common: frozenset[str]) -> bool:
    return len(w) >= 3 and w.lower() not in common and w.lower() not in TITLES



def learn_words(texts: list[str], given: set[str], family: set[str], rounds: int = 3) -> tuple[frozenset[str], frozenset[str]]:
    """Given names (those listed and those before family names) and common words (mostly written small).

    The list is incomplete: given names come from words before known family names, and family names from words after known
    given names, in turn.
    """
    small, large, pairs = Counter(), Counter(), Counter()
    for t in texts:
        t = EMAIL.sub("@", t)
        ws = [m.group() for m in _WORD.finditer(t)]
        for w in ws:
            (large if w[0].isupper() else small)[w.lower()] += 1
        for m in _NAME_PAIR.finditer(t):
            first, last = (m["g"], m["f"]) if m["g"] else (m["g2"], m["f2"])
            pairs[first.lower(), last.lower()] += 1
    common = {w for w, n in small.items() if n >= 5 and n >= large[w] and w not in family}  # names are mostly written large
    names, families = set(given), set(family)
    for _ in range(rounds):
        before, after = Counter(), Counter()
        for (w, x), n in pairs.items():
            if x in families and w not in families and len(w) > 2 and w not in TITLES:
                before[w] += n
            if w in names and x not in common and x not in names and len(x) > 3:
                after[x] += n
        names |= {w for w, n in before.items() if n >= 2 and w not in common and n >= 0.02 * (large[w] + small[w])}
        families |= {x for x, n in after.items() if n >= 3 and n >= 0.1 * (large[x] + small[x])}
    return frozenset(names), frozenset(common - names)


def label_spans(t: str, given: frozenset[str], common: frozenset[str]) -> list[tuple[int, int, str]]:
    """Labelled spans of a plain text."""
    out = [(m.start(), m.end(), "email") for m in EMAIL.finditer(t)]

    def free(a: int, b: int) -> bool:
        return all(b <= x or a >= y for x, y, _ in out)

    out += [(m.start(), m.end(), "address") for m in ADDRESS.finditer(t) if free(*m.span())]
    for m in NUMBER.finditer(t):
        if sum(c.isdigit() for c in m.group()) >= 5 and free(*m.span()) and ID_WORDS.search(t[max(0, m.start() - 45) : m.start()]):
            out.append((*m.span(), "id_number"))
    for m in PHONE.finditer(t):
        if 7 <= sum(c.isdigit() for c in m.group()) <= 15 and free(*m.span()):
            out.append((m.start(), m.start() + len(m.group().rstrip(" ().-/")), "phone"))
    ws = [(m.group(), *m.span()) for m in _WORD.finditer(t)]
    i = 0
    while i < len(ws):
        w, a, b = ws[i]
        low = w.lower()
        nxt = ws[i + 1] if i + 1 < len(ws) else None
        third = ws[i + 2] if i + 2 < len(ws) else None
        end = None
        gap = t[b : nxt[1]] if nxt else ""
        initial = len(w) == 1 and w.isupper() and (not a or t[a - 1] in " (\n") and nxt is not None and nxt[0][0].isupper()
        titled = low in TITLES and gap in ((" ",) if low in ("señor", "señora", "sir", "miss", "herr", "frau") else (" ", ". ", "."))
        if nxt and (titled or initial and gap in (". ", ".")) and family_like(nxt[0], common):
            end, used = nxt[2], 2
        elif nxt and low in given and gap == " " and family_like(nxt[0], common) and nxt[0][0].isupper() == w[0].isupper():
            end, used = nxt[2], 2
        elif third and low in given and gap == " " and len(nxt[0]) == 1 and t[nxt[2] : third[1]] in (". ", ".") and family_like(third[0], common):
            end, used = third[2], 3
        elif nxt and gap == ", " and nxt[0].lower() in given and family_like(w, common) and w[0].isupper() == nxt[0][0].isupper() and low not in given:
            end, used = nxt[2], 2
        if end and free(a, end):
            out.append((a, end, "person_name"))
            i += used
        else:
            i += 1
    return sorted(out)


def tags_of(n: int, spans: list[tuple[int, int, str]]) -> np.ndarray:
    y = np.zeros(n, np.int8)
    for a, b, kind in spans:
        k = KINDS.index(kind)
        y[a:b] = 2 * k + 2
        y[a] = 2 * k + 1
    return y


def gradients(m: BiLstmCrf, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean negative log-likelihood of a batch (time x batch) and its gradients; the CRF runs in scaled probabilities."""
    steps, n = x.shape
    k, tags = m.hidden, len(TAGS)
    kept = {"f": [], "b": []}
    hidden = np.concatenate([m.run(x, d, kept[d]) for d in "fb"], axis=2)
    e = hidden @ m.p["out"] + m.p["out_bias"]
    trans, start = m.p["trans"], m.p["start"]
    top = e.max(2, keepdims=True)
    p, move = np.exp(e - top), np.exp(trans)
    alpha, beta, scale = np.empty_like(p), np.empty_like(p), np.empty((steps, n, 1), np.float32)
    for t in range(steps):
        a = (np.exp(start) if t == 0 else alpha[t - 1] @ move) * p[t]
        scale[t] = a.sum(1, keepdims=True)
        alpha[t] = a / scale[t]
    beta[-1] = 1
    for t in range(steps - 2, -1, -1):
        beta[t] = (p[t + 1] * beta[t + 1]) @ move.T / scale[t + 1]
    de = alpha * beta
    ahead = p[1:] * beta[1:] / scale[1:]
    d_trans = (alpha[:-1].reshape(-1, tags).T @ ahead.reshape(-1, tags)) * move
    z = np.log(scale[:, :, 0]).sum(0) + top[:, :, 0].sum(0)
    rows, times = np.arange(n), np.arange(steps)
    gold = start[y[0]] + e[times[:, None], rows, y].sum(0) + trans[y[:-1], y[1:]].sum(0)
    np.subtract.at(d_trans, (y[:-1].ravel(), y[1:].ravel()), 1)
    de[times[:, None], rows, y] -= 1
    de /= n
    g = {"trans": d_trans / n, "start": de[0].sum(0), "out_bias": de.sum((0, 1)), "out": hidden.reshape(-1, 2 * k).T @ de.reshape(-1, tags)}
    one = np.zeros((steps * n, SYMBOLS), np.float32)
    one[np.arange(steps * n), x.ravel()] = 1
    g["table"] = np.zeros_like(m.p["table"])
    d_hidden = de @ m.p["out"].T
    for j, d in enumerate("fb"):
        rec, back = m.p[f"rec_{d}"], m.p[f"rec_{d}"].T.copy()
        dz_all, before = np.empty((steps, n, 4 * k), np.float32), np.empty((steps, n, k), np.float32)
        dh, dc = np.zeros((n, k), np.float32), np.zeros((n, k), np.float32)
        for t, h, c, gate, u, tc in reversed(kept[d]):
            i, f, o = gate[:, :k], gate[:, k : 2 * k], gate[:, 2 * k :]
            dh = dh + d_hidden[t, :, j * k : j * k + k]
            dc = dc + dh * o * (1 - tc * tc)
            dz, slope = dz_all[t], gate * (1 - gate)
            dz[:, :k], dz[:, k : 2 * k], dz[:, 2 * k : 3 * k], dz[:, 3 * k :] = dc * u, dc * c, dh * tc, dc * i * (1 - u * u)
            dz[:, : 3 * k] *= slope
            before[t] = h
            dh, dc = dz @ back, dc * f
        flat = dz_all.reshape(-1, 4 * k)
        g[f"rec_{d}"] = before.reshape(-1, k).T @ flat
        by_symbol = one.T @ flat
        g[f"in_{d}"], g[f"bias_{d}"] = m.p["table"].T @ by_symbol, by_symbol.sum(0)
        g["table"] += by_symbol @ m.p[f"in_{d}"].T
    return float((z - gold).mean()), g


class Examples:
    """Windows of texts whose spans are known."""

    def __init__(self, cases: list, plain: list[str], hard: list, given: tuple[str, ...], family: tuple[str, ...], seed: int) -> None:
        self.cases, self.plain, self.hard, self.m = cases, plain, hard, pii_names.Maker(seed, given, family)

    def text(self) -> tuple[str, list[tuple[int, int, str]]]:
        m, r = self.m, self.m.rng.random()
        if self.hard and m.chance(0.2):
            return pii_names.refilled(m, *m.one(self.hard), 0.4)
        if m.chance(0.1):  # a sentence alone
            piece, own = pii_names.carrier(m, m.one(KINDS))
            return (piece, [own]) if m.chance(0.4) else (pii_names.decoy(m), []) if m.chance(0.3) else (m.one(pii_names.sentences(m.one(self.plain))), [])
        if r < 0.33 and self.cases:
            t, spans = m.one(self.cases)
            t, spans = pii_names.refilled(m, t, spans, 0.7)
            if m.chance(0.15):
                t, spans = pii_names.inserted(m, t, spans, pii_names.decoy(m), [])
            return t, spans
        t, spans = m.one(self.plain), []
        if r < 0.58:
            return pii_names.named(m, t)
        if r < 0.73:
            kind = m.one((*KINDS, "person_name", "person_name"))
            piece, own = pii_names.carrier(m, kind)
            t, spans = pii_names.inserted(m, t, spans, piece, [own])
        elif r < 0.84:
            t, spans = pii_names.inserted(m, t, spans, pii_names.decoy(m), [])
        return t, spans

    def cased(self, t: str) -> str:
        r = self.m.rng.random()
        if r < 0.85:
            return t
        other = t.lower() if r < 0.9 else t.upper() if r < 0.93 else t.swapcase() if r < 0.96 else "".join(c.upper() if self.m.chance(0.3) else c.lower() for c in t)
        return other if len(other) == len(t) else t

    def batch(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        x, y, rng = np.full((n, STEPS), SYMBOLS - 1, np.int16), np.zeros((n, STEPS), np.int8), self.m.rng
        for k in range(n):
            t, spans = self.text()
            lo = 0
            if len(t) > STEPS:
                lo = int(rng.integers(0, len(t) - STEPS + 1))
                if spans and rng.random() < 0.8:
                    a, b, _ = spans[int(rng.integers(len(spans)))]
                    lo = min(max(0, int(rng.integers(b - STEPS, a + 1))) if b - a < STEPS else a, len(t) - STEPS)
            part = self.cased(t)[lo : lo + STEPS]
            x[k, : len(part)] = pii.symbols(part)
            y[k, : len(part)] = tags_of(len(t), spans)[lo : lo + STEPS]
        return x.T.copy(), y.T.copy()


_own: Examples | None = None


def _start(cases: list, plain: list[str], hard: list, given: tuple, family: tuple) -> None:
    global _own
    _own = Examples(cases, plain, hard, given, family, mp.current_process()._identity[0] + 100 * len(hard))


def _step(task: tuple[dict, int]) -> tuple[float, dict]:
    m = BiLstmCrf()
    m.p = task[0]
    return gradients(m, *_own.batch(task[1]))


def labelled(texts: list[str], given: set[str], family: set[str], learn_from: list[str] | None = None) -> tuple[list, list[str]]:
    """Plain texts with the spans that the seed forms find, and those without any; names are learned from these texts or others."""
    plain = [pii.plain_text(t) for t in texts]
    names, common = learn_words(plain if learn_from is None else [pii.plain_text(t) for t in learn_from], given, family)
    cases, rest = [], []
    for t in plain:
        spans = label_spans(t, names, common)
        if spans:
            cases.append((t, spans))
        elif t:
            rest.append(t)
    return cases, rest


def train(cases: list, plain: list[str], hard: list, given: tuple[str, ...], family: tuple[str, ...], minutes: float = 8.0, processes: int = 8, batch: int = 48, begin: BiLstmCrf | None = None) -> BiLstmCrf:
    m, average = begin or BiLstmCrf(), BiLstmCrf()
    average.p = {k: v.copy() for k, v in m.p.items()}
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in m.p.items()}
    began, step, mean = time.time(), 0, 0.0
    with mp.get_context("fork").Pool(processes, _start, (cases, plain, hard, given, family)) as pool:
        while (done := (time.time() - began) / (minutes * 60)) < 1:
            rate = 0.0002 + (0.012 if begin is None else 0.003) * 0.5 * (1 + np.cos(np.pi * done)) * min(1, (step + 1) / 50)
            parts = pool.map(_step, [(m.p, batch)] * processes, chunksize=1)
            step += 1
            mean = 0.98 * mean + 0.02 * float(np.mean([p[0] for p in parts]))
            for k in m.p:
                g = np.clip(np.mean([p[1][k] for p in parts], axis=0), -1, 1)
                a, b = state[k]
                a += 0.1 * (g - a)
                b += 0.002 * (g * g - b)
                m.p[k] = (m.p[k] - rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.998**step)) + 1e-6)).astype(np.float32)
                average.p[k] += max(0.004, 1 / (step + 1)) * (m.p[k] - average.p[k])
            if step % 200 == 0:
                print(step, round(time.time() - began), round(mean / (1 - 0.98**step), 4), flush=True)
    return average


def measured(m: BiLstmCrf, texts: list[str], truth: list[list[tuple[int, int, str]]]) -> dict[str, tuple[int, int, int]]:
    """Per kind: true (text, kind), found, and both."""
    found = pii.spans_of(texts, m)
    out = {}
    for kind in KINDS:
        want = {i for i, s in enumerate(truth) if any(k == kind for *_, k in s)}
        have = {i for i, s in enumerate(found) if any(k == kind for *_, k in s)}
        out[kind] = (len(want), len(have), len(want & have))
    return out


def mistakes(m: BiLstmCrf, cases: list, plain: list[str]) -> list:
    """Training texts in which the model does not find just the labelled spans; the second part of training sees them more often."""
    every = [*cases, *((t, []) for t in plain)]
    return [(t, spans) for (t, spans), found in zip(every, pii.spans_of([t for t, _ in every], m)) if sorted(spans) != found]


def sample(data: str) -> tuple[list[str], set[str], set[str]]:
    import pandas as pd

    lexicon = pd.read_parquet(f"{data}/lexicon.parquet")
    given, family = (set(lexicon.term[lexicon.category == c].str.lower()) for c in ("given_name", "family_name"))
    texts = pd.read_parquet(f"{data}/moderation_examples.parquet", columns=["text"]).text.dropna().drop_duplicates().tolist()
    texts.sort(key=lambda t: hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest())
    return texts[:SAMPLE_ROWS], given, family


def main(data: str, minutes: float = 8.0, processes: int = 8, resume: bool = False) -> None:
    texts, given, family = sample(data)
    cases, plain = labelled(texts, given, family)
    n_case, n_plain = len(cases) // 10, len(plain) // 10
    names = tuple(g.capitalize() for g in sorted(given)), tuple(f.title() for f in sorted(family))
    target = Path(__file__).parent / "models" / "pii.npz"
    own, rest = cases[n_case:], plain[n_plain:]
    m = BiLstmCrf.load(target) if resume else train(own, rest, [], *names, 0.6 * minutes, processes)
    m = train(own, rest, mistakes(m, own, rest), *names, minutes if resume else 0.4 * minutes, processes, begin=m)
    m.save(target)
    held = [*cases[:n_case], *((t, []) for t in plain[:n_plain])]
    print(measured(BiLstmCrf.load(target), [t for t, _ in held], [s for _, s in held]))


if __name__ == "__main__":
    main(sys.argv[1], float(sys.argv[2]) if len(sys.argv) > 2 else 8.0, int(sys.argv[3]) if len(sys.argv) > 3 else 8, "resume" in sys.argv)
