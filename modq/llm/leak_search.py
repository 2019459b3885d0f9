"""Problem 8: evaluation texts leaking into training text.

Method: size-partitioned MinHash containment search, verified by exact shingle containment.  Documents are cut into
passages that overlap by a run's length, so that every run of ``run`` words lies whole in one passage; long items are cut the
same way.  Items are partitioned by their number of five-word shingles; for each partition the number of hash functions
follows from the least similarity a leaked run can have there and the allowed chance of missing it (``MISS``).  A candidate
shares one minimum with a passage; it is verified by comparing runs of words.

Defined results: null, empty and short texts (fewer than ``run`` words) leak nothing; repeated documents are each reported;
repeated item words count once; empty tables give no rows.  Documents are processed whole.

Scale: documents are scanned once per block of items and never shuffled; the item index is broadcast in blocks of at most
``BLOCK_WORDS`` words, so its size does not grow with the data.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import spread
from .words import mix, shingles, word_numbers, words

RUN = 12
SHINGLE = 5
PASSAGE = 32
MISS = 1e-7
SIZE_CLASSES = (12, 20, 28)
BLOCK_WORDS = 200_000
SLICE_WORDS = 300_000


def functions_needed(largest: int, run: int = RUN) -> int:
    """Hash functions for items of at most ``largest`` shingles, so that a run is missed with chance ``MISS`` at most."""
    shared = run - SHINGLE + 1
    similarity = shared / (largest + (PASSAGE - SHINGLE + 1) - shared)
    return math.ceil(math.log(MISS) / math.log(1 - similarity))


def passages(n_words: int, run: int = RUN) -> list[int]:
    """Starts of passages of ``PASSAGE`` words, each overlapping the next by ``run`` words."""
    step = PASSAGE - run
    return list(range(0, max(1, n_words - run + 1), step)) if n_words >= run else []


class ItemIndex:
    """Minima of one block of items, by hash function."""

    def __init__(self, items: list[tuple[int, str]], run: int = RUN) -> None:
        self.run, self.ids, self.runs = run, [], {}
        minima: dict[int, list[tuple[int, int]]] = {}
        for item_id, text in items:
            ws = words(text)
            for at in range(len(ws) - run + 1):
                self.runs.setdefault(" ".join(ws[at : at + run]), set()).add(item_id)
            h, _ = word_numbers([ws])
            for start in passages(len(ws), run):
                sh = np.unique(shingles(h[start : start + PASSAGE], SHINGLE))
                size = next((c for c in SIZE_CLASSES if len(sh) <= c), SIZE_CLASSES[-1])
                for k in range(functions_needed(size, run)):
                    minima.setdefault(k, []).append(int(mix(sh, k + 100).min()))
        self.minima = {k: np.unique(np.array(v, dtype=np.uint64)) for k, v in minima.items()}

    def search(self, doc_words: list[list[str]]) -> list[tuple[int, int, int]]:
        """(document, item, leaked words) for documents given as word lists."""
        h, sizes = word_numbers(doc_words)
        first = np.cumsum(sizes) - sizes
        starts, ends, owner = [], [], []
        for d, n in enumerate(sizes.tolist()):
            for s in passages(n, self.run):
                starts.append(first[d] + s)
                ends.append(first[d] + min(s + PASSAGE, n) - SHINGLE + 1)
                owner.append(d)
        if not starts or not self.minima:
            return []
        sh = shingles(h, SHINGLE)
        bounds = np.empty(2 * len(starts), dtype=np.int64)
        bounds[::2], bounds[1::2] = starts, ends
        hit = np.zeros(len(starts), dtype=bool)
        padded = np.append(sh, np.uint64(2**64 - 1))  # an end may equal the length
        for k, known in self.minima.items():
            low = np.minimum.reduceat(np.append(mix(sh, k + 100), padded[-1:]), bounds)[::2]
            hit |= known[np.minimum(np.searchsorted(known, low), len(known) - 1)] == low
        found: dict[tuple[int, int], set[int]] = {}
        for p in np.flatnonzero(hit):
            d = owner[p]
            ws, s = doc_words[d], int(starts[p] - first[d])
            for at in range(s, min(s + PASSAGE, len(ws)) - self.run + 1):
                for item in self.runs.get(" ".join(ws[at : at + self.run]), ()):
                    found.setdefault((d, item), set()).update(range(at, at + self.run))
        return [(d, item, len(at)) for (d, item), at in found.items()]


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The stated query set, streamed in blocks of bounded size."""
    block, size = [], 0
    for r in items.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "text").orderBy("item_id").toLocalIterator():
        n = len(r.text.split())
        if block and size + n > BLOCK_WORDS:
            yield block
            block, size = [], 0
        block.append((r.item_id, r.text))
        size += n
    if block:
        yield block


def find_leaks(documents: DataFrame, items: DataFrame, run: int = RUN) -> DataFrame:
    """``doc_id, item_id, leaked_words``: documents holding at least ``run`` consecutive words of an item."""
    docs = spread(documents.where("doc_id IS NOT NULL AND text IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    schema = "doc_id long, item_id long, leaked_words long"
    sc = documents.sparkSession.sparkContext

    def against(block: list[tuple[int, str]]) -> DataFrame:
        shared = sc.broadcast(block)

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(shared.value, run)
            for b in batches:
                ids, texts, lo = b.column(0).to_pylist(), b.column(1).to_pylist(), 0
                while lo < len(ids):
                    part, n = [], 0
                    while lo + len(part) < len(ids) and (not part or n < SLICE_WORDS):
                        part.append(words(texts[lo + len(part)]))
                        n += len(part[-1])
                    rows = [(ids[lo + d], item, n_leaked) for d, item, n_leaked in index.search(part)]
                    lo += len(part)
                    cols = list(zip(*rows)) if rows else [[], [], []]
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "leaked_words"])

        return docs.mapInArrow(search, schema)

    parts = [against(b) for b in _blocks(items)]
    if not parts:
        return documents.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, parts)


def leak_report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """``item_id, split, n_documents``: how often each item leaked, with 0 for those that did not."""
    n = find_leaks(documents, items).groupBy("item_id").agg(F.count("*").alias("n_documents"))
    return items.select("item_id", "split").join(n, "item_id", "left").fillna(0, ["n_documents"])
