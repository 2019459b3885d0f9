"""Words as 64-bit numbers, for operators on word shingles."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd

_SPACE = re.compile(r"\s+")


@lru_cache(maxsize=1)
def _dropped() -> dict[int, None]:
    """Punctuation and symbols, which are disregarded."""
    return {cp: None for cp in range(0x30000) if unicodedata.category(chr(cp))[0] in "PS"}


def words(text: str | None) -> list[str]:
    """Words with case, punctuation and whitespace disregarded; null has none."""
    if not text:
        return []
    return text.casefold().translate(_dropped()).split()


def mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser (splitmix) of ``x`` under a seed."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x1234567) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def word_numbers(lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """All words of several texts as one array of hashes, and the texts' sizes."""
    flat = [w for ws in lists for w in ws]
    sizes = np.array([len(ws) for ws in lists], dtype=np.int64)
    if not flat:
        return np.zeros(0, np.uint64), sizes
    codes, unique = pd.factorize(np.array(flat, dtype=object))
    return pd.util.hash_array(unique.astype(object), categorize=False)[codes], sizes


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each position on (the last ``k - 1`` positions are missing)."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(h) - k + 1, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(k):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j]
    return mix(out, k)
