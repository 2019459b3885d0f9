"""Problem 3: personal information inside free text.

Method: a character-level bidirectional LSTM with CRF transitions, trained in numpy from labelled spans (``pii_train``).  Text is
brought to plain characters with a map back to the original offsets; every text is scored whole in overlapping windows, the
windows' scores are averaged with weights that fall towards their edges, and one Viterbi pass over the reconciled scores of the
whole text gives kinds and ends of its spans.  No pattern, word list or cue decides where a span is or ends; ``well_formed`` only
refuses spans that cannot be what they are called (a phone number without digits).

The trained weights lie in ``models/pii.npz``; ``python -m modq.llm.pii_train`` makes them again from a bounded sample
of rows (see there).  ``find_pii`` takes any other model as a parameter.

Defined results: null and blank texts have no spans; spans do not overlap; repeated rows repeat; empty tables give no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lstm_kernel
from .base import nonblank, spread
from .lookalike import _TO_LATIN, _UNSEEN

KINDS = ("email", "phone", "id_number", "address", "person_name")
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
WINDOW, OVERLAP, PATHS = 384, 48, 512
#: Characters scored at once, so that the kernel's gates stay in a core's cache, but this many texts at least.
CELLS, LEAST = 3_000, 12
#: So many blanks are taken to follow every text, so that its end is read alike whatever its neighbours in a batch are.
BLANKS = 4
SYMBOLS = 99
HIDDEN, WIDTH = 24, 12
#: What beginning a span costs beside its learned price; set on rows that were not trained on, where it halves the false names.
BEGIN = 1.5

@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Code point -> plain code point of the same meaning (0: invisible, left out), and plain code point -> symbol."""
    plain = np.arange(0x110000, dtype=np.uint32)
    plain[0] = 0x20
    for cp in range(0x80, 0x10000):
        if _UNSEEN.match(chr(cp)) or 0xFE00 <= cp <= 0xFE0F:
            plain[cp] = 0
    for c, a in _TO_LATIN.items():
        plain[c] = a if isinstance(a, int) else ord(a)
    plain[0xFF01:0xFF5F] = np.arange(0x21, 0x7F)
    for zero in (0x660, 0x6F0):
        plain[zero : zero + 10] = np.arange(48, 58)
    plain[[0xA0, 0x1680, *range(0x2000, 0x200B), 0x202F, 0x205F, 0x3000, 9, 10, 13]] = 0x20
    symbol = np.full(0x110000, 97, dtype=np.int16)  # ASCII by itself, other letters by case, everything else as one
    symbol[32:127] = np.arange(95)
    for cp in range(0xAA, 0x2C00):
        c = chr(cp)
        if c.isalpha():
            symbol[cp] = 96 if c.isupper() else 95
    return plain, symbol


def plain_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Plain code points of all texts one after the other with single spaces, their offsets in their text, and each text's end."""
    cps = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    plain, row = _tables()[0][cps], np.repeat(np.arange(len(texts)), sizes)
    at = np.arange(len(cps)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    seen = plain != 0
    plain, row, at = plain[seen], row[seen], at[seen]
    space = plain == 0x20
    single = np.ones(len(plain), bool)
    single[1:] = ~(space[1:] & space[:-1] & (row[1:] == row[:-1]))
    return plain[single], at[single], np.cumsum(np.bincount(row[single], minlength=len(texts)))


def plain_text(text: str) -> str:
    return plain_codes([text])[0].tobytes().decode("utf-32-le", "surrogatepass")


def symbols(text: str) -> np.ndarray:
    return _tables()[1][np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class BiLstmCrf:
    """Weights and scoring; the backward pass is in ``pii_train``."""

    NAMES = ("table", "in_f", "in_b", "bias_f", "bias_b", "rec_f", "rec_b", "out", "out_bias", "trans", "start")

    def __init__(self, hidden: int = HIDDEN, seed: int = 3) -> None:
        rng, h, t = np.random.default_rng(seed), hidden, len(TAGS)
        self.p: dict[str, np.ndarray] = {"table": rng.normal(0, 1, (SYMBOLS, WIDTH))}
        for d in "fb":
            self.p[f"in_{d}"] = rng.normal(0, 1, (WIDTH, 4 * h)) / np.sqrt(WIDTH)
            self.p[f"rec_{d}"] = rng.normal(0, 1, (h, 4 * h)) / np.sqrt(h)
            self.p[f"bias_{d}"] = np.repeat([0.0, 1.0, 0.0, 0.0], h)  # forget gates start open
        self.p["out"] = rng.normal(0, 1, (2 * h, t)) / np.sqrt(2 * h)
        self.p.update(out_bias=np.zeros(t), trans=np.zeros((t, t)), start=np.zeros(t))
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    @property
    def hidden(self) -> int:
        return self.p["rec_f"].shape[0]

    def run(self, x: np.ndarray, d: str, keep: list | None = None, state: np.ndarray | None = None) -> np.ndarray:
        """Hidden states (time x batch) of one direction for symbols ``x`` (time x batch), from ``state`` (hidden, cell) or nothing."""
        k = self.hidden
        table, rec = self.p["table"] @ self.p[f"in_{d}"] + self.p[f"bias_{d}"], self.p[f"rec_{d}"]
        steps, n = x.shape
        h, c = (np.zeros((n, k), np.float32) if state is None else np.repeat(state[i : i + 1], n, axis=0) for i in (0, 1))
        out = np.empty((steps, n, k), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = table[x[t]] + h @ rec
            g = _sigmoid(z[:, : 3 * k])
            u = np.tanh(z[:, 3 * k :])
            before, c = c, g[:, k : 2 * k] * c + g[:, :k] * u
            tc = np.tanh(c)
            if keep is not None:
                keep.append((t, h, before, g, u, tc))
            h = g[:, 2 * k :] * tc
            out[t] = h
        if state is not None:
            state[:] = h[0], c[0]
        return out

    def after(self) -> np.ndarray:
        """The backward direction's state before a text's end: it has read blanks."""
        state = np.zeros((2, self.hidden), np.float32)
        self.run(np.full((BLANKS, 1), SYMBOLS - 1), "b", state=state)
        return state

    def emissions(self, x: np.ndarray) -> np.ndarray:
        """Tag scores (time x batch x tags) in numpy."""
        return np.concatenate([self.run(x, "f"), self.run(x, "b", state=self.after())], axis=2) @ self.p["out"] + self.p["out_bias"]

    def score(self, x: np.ndarray) -> np.ndarray:
        """The same by the compiled kernel, where there is one."""
        if not hasattr(self, "_session"):
            self._session, self._after = lstm_kernel.session(self.p), self.after()
        if self._session is None:
            return self.emissions(x)
        h = self.hidden
        state = np.zeros((2, 2, x.shape[1], h), np.float32)  # hidden and cell, direction, batch
        state[:, 1] = self._after[:, None]
        y = self._session.run(None, {"x": x.astype(np.int64), "h": state[0], "c": state[1]})[0]
        e = y[:, 0] @ self.p["out"][:h]  # one small product a step, which no library spreads over threads
        e += y[:, 1] @ self.p["out"][h:]
        e += self.p["out_bias"]
        return e

    def __getstate__(self) -> dict:
        return {"p": self.p}

    def viterbi(self, e: np.ndarray, lengths: np.ndarray) -> list[np.ndarray | None]:
        """Best tags of every sequence of a batch (time x tags x batch, shortest first); None where O throughout is best.

        The forward pass keeps scores only; paths are traced back where the best score beats that of the path without spans.
        """
        steps, k, n = e.shape
        trans, start = self.p["trans"].copy(), self.p["start"].copy()
        trans[:, 1::2] -= BEGIN
        start[1::2] -= BEGIN
        free, inner = [0, *range(1, k, 2)], list(range(2, k, 2))  # O and the begins follow any tag, an inner tag only its own kind
        best, buffer, into = np.empty_like(e), np.empty((k, len(free), n), np.float32), np.empty((len(free), n), np.float32)
        weights, stay, enter = trans[:, free][:, :, None].copy(), trans[inner, inner][:, None], trans[[c - 1 for c in inner], inner][:, None]
        best[0] = start[:, None] + e[0]
        best[0, 2::2] = -1e9
        for t in range(1, steps):
            before, now = best[t - 1], best[t]
            np.add(before[:, None, :], weights, out=buffer)
            np.maximum.reduce(buffer, axis=0, out=into)
            now[0], now[1::2] = into[0], into[1:]
            np.maximum(before[1::2] + enter, before[2::2] + stay, out=now[2::2])
            now += e[t]
        last = best[lengths - 1, :, np.arange(n)]
        outside = start[0] + np.cumsum(e[:, 0] + trans[0, 0], axis=0)[lengths - 1, np.arange(n)] - trans[0, 0]
        out: list[np.ndarray | None] = [None] * n
        some = np.flatnonzero(last.max(1) > outside + 1e-3)
        paths, allowed = np.zeros((steps, len(some)), np.int8), trans.copy()
        for c in range(2, k, 2):
            allowed[[a for a in range(k) if a not in (c - 1, c)], c] = -1e9
        now = last[some].argmax(1)
        for t in range(steps - 1, -1, -1):
            on = lengths[some] - 1
            now = np.where(on > t, (best[t][:, some] + allowed[:, now]).argmax(0), now) if t < steps - 1 else now
            paths[t] = now
        for j, c in enumerate(some.tolist()):
            out[c] = paths[: lengths[c], j]
        return out

    def decode(self, texts: list[np.ndarray]) -> list[np.ndarray | None]:
        """Tags of every text, None where there is no span: windows are scored in batches, reconciled, and decoded by text."""
        out: list[np.ndarray | None] = [None] * len(texts)
        order = sorted(range(len(texts)), key=lambda k: len(texts[k]))
        short = [k for k in order if len(texts[k]) <= WINDOW]
        for lo in range(0, len(short), PATHS):  # one window each
            part = short[lo : lo + PATHS]
            sizes = [len(texts[k]) for k in part]
            e = np.zeros((sizes[-1], len(TAGS), len(part)), np.float32)
            for a, b in batches(sizes):
                own = self._windows([texts[k] for k in part[a:b]])
                e[: sizes[b - 1], :, a:b] = own[: sizes[b - 1]].transpose(0, 2, 1)
            self._paths(out, part, e, sizes)
        lo = len(short)
        while lo < len(order):  # several windows each; at least one text, of similar lengths
            hi = lo + 1
            while hi < len(order) and (hi - lo + 1) * len(texts[order[hi]]) <= PATHS * WINDOW:
                hi += 1
            part, lo = order[lo:hi], hi
            sizes = [len(texts[k]) for k in part]
            sums, weight = np.zeros((sizes[-1], len(TAGS), len(part)), np.float32), np.full((sizes[-1], 1, len(part)), 1e-9, np.float32)
            windows = sorted((min(WINDOW, n - at), j, at) for j, n in enumerate(sizes) for at in range(0, n - OVERLAP, WINDOW - OVERLAP))
            for a, b in batches([n for n, *_ in windows]):
                some = windows[a:b]
                e = self._windows([texts[part[j]][at : at + n] for n, j, at in some])
                for w, (n, j, at) in enumerate(some):
                    ramp = np.minimum(np.arange(1, n + 1), np.arange(WINDOW, WINDOW - n, -1)).astype(np.float32)[:, None]
                    sums[at : at + n, :, j] += e[:n, w] * ramp
                    weight[at : at + n, :, j] += ramp
            self._paths(out, part, sums / weight, sizes)
        return out

    def _windows(self, parts: list[np.ndarray]) -> np.ndarray:
        x = np.full((len(parts), max(map(len, parts))), SYMBOLS - 1, np.int16)
        for j, s in enumerate(parts):
            x[j, : len(s)] = s
        return self.score(x.T)

    def _paths(self, out: list, where: list[int], e: np.ndarray, lengths: list[int]) -> None:
        for k, path in zip(where, self.viterbi(e, np.array(lengths))):
            out[k] = path

    def save(self, path: str | Path) -> None:
        np.savez_compressed(path, **{k: v.astype(np.float16) for k, v in self.p.items()})

    @staticmethod
    def load(path: str | Path) -> "BiLstmCrf":
        model = BiLstmCrf()
        with np.load(path) as z:
            model.p = {k: z[k].astype(np.float32) for k in BiLstmCrf.NAMES}
        return model


def batches(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of ascending ``sizes`` of ``CELLS`` characters with their padding, or of ``LEAST``."""
    lo = 0
    while lo < len(sizes):
        hi = min(lo + LEAST, len(sizes))
        while hi < len(sizes) and (hi + 1 - lo) * sizes[hi] <= CELLS:
            hi += 1
        yield lo, hi
        lo = hi


@lru_cache(maxsize=2)
def default_model() -> BiLstmCrf:
    return BiLstmCrf.load(Path(__file__).parent / "models" / "pii.npz")


def well_formed(kind: str, span: str) -> bool:
    """Whether a span can be what it is called; it moves no span and adds none."""
    digits = sum(c.isdigit() for c in span)
    letters = sum(c.isalpha() for c in span)
    if kind == "email":
        return letters >= 4 and ("@" in span or " at " in span.lower().replace("(", " ").replace("[", " ").replace(")", " ").replace("]", " "))
    if kind == "phone":
        return 7 <= digits <= 15 and letters == 0
    if kind == "id_number":
        return digits >= 4
    if kind == "address":
        return digits >= 1 and letters >= 3
    return len(span.replace(",", " ").replace(".", " ").split()) >= 2 and digits == 0


def spans_of(texts: list[str], model: BiLstmCrf) -> list[list[tuple[int, int, str]]]:
    """Spans (start, end, kind) in the offsets of the original texts, in order and without overlap."""
    if len(once := dict.fromkeys(texts)) < len(texts):  # copies in a slice are scored once
        once = dict(zip(once, spans_of(list(once), model)))
        return [once[t] for t in texts]
    plain, offset, ends = plain_codes(texts)
    coded, begin = _tables()[1][plain], np.concatenate([[0], ends[:-1]]).astype(np.int64) if texts else []
    filled = [k for k in range(len(texts)) if ends[k] > begin[k]]
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    for k, path in zip(filled, model.decode([coded[begin[k] : ends[k]] for k in filled])):
        if path is None:
            continue
        t, kept = plain[begin[k] : ends[k]].tobytes().decode("utf-32-le", "surrogatepass"), offset[begin[k] : ends[k]]
        kinds = (path + 1) // 2  # 0 for O, else the kind's number
        begins = (path % 2 == 1) | (kinds != np.concatenate([[0], kinds[:-1]]))
        for s in np.flatnonzero(begins & (kinds > 0)).tolist():
            e = s + 1
            while e < len(path) and kinds[e] == kinds[s] and path[e] % 2 == 0:
                e += 1
            a, b, kind = s, e, KINDS[kinds[s] - 1]
            while a < b and t[a].isspace():
                a += 1
            while b > a and t[b - 1].isspace():
                b -= 1
            if a < b and well_formed(kind, t[a:b]):
                out[k].append((int(kept[a]), int(kept[b - 1]) + 1, kind))
    return out


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every span replaced by its kind's placeholder, the rest unchanged."""
    out, last = [], 0
    for a, b, kind in sorted(spans):
        if a >= last:
            out += [text[last:a], f"[{kind.upper()}]"]
            last = b
    return "".join([*out, text[last:]])


def find_pii(rows: DataFrame, model: BiLstmCrf | None = None, id_col: str = "row_idx", slice_rows: int = 4_000) -> DataFrame:
    """``id_col, kinds, redacted`` of every row with personal information: one narrow pass, no shuffle on large scans."""
    some = rows.where(F.col(id_col).isNotNull() & nonblank("text")).select(F.col(id_col).cast("long").alias(id_col), "text")
    shared = rows.sparkSession.sparkContext.broadcast(model or default_model())  # weights of fixed size
    schema = pa.schema([(id_col, pa.int64()), ("kinds", pa.list_(pa.string())), ("redacted", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, slice_rows):
                part = b.slice(lo, slice_rows)
                ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
                found = [(i, t, s) for i, t, s in zip(ids, texts, spans_of(texts, own)) if s]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f[0] for f in found], pa.int64()), pa.array([sorted({k for *_, k in f[2]}) for f in found], pa.list_(pa.string())), pa.array([redact(f[1], f[2]) for f in found], pa.string())],
                    schema=schema,
                )

    return spread(some).mapInArrow(run, f"`{id_col}` long, kinds array<string>, redacted string")
