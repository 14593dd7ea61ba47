"""Benchmark decontamination by size-partitioned MinHash containment search.

Short test items are sought inside long documents.  The MinHash of a whole long document says
nothing about a short item, so both sides are partitioned by size: an item of L shingles
belongs to class c with 2^c <= L < 2^(c+1), and for each class a document is cut into windows
of 2^(c+2) shingles that overlap by half.  Every run of L shingles then lies inside one window,
whose Jaccard similarity to a contained item is about 1/4 or more.  A window and an item that
share one of ``PERMUTATIONS`` minima are a candidate; a candidate is verified by the exact
share of the item's distinct shingles that the whole document holds.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from .rows import pick, place, plain
from .text import mixed, rolling_shingles, words_of
from .vectors import word_hashes

PERMUTATIONS = 32
#: Items that are searched for at once; more are taken block by block.
BLOCK = 50_000
_RNG = np.random.default_rng(20240229)
_ODD = _RNG.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _RNG.integers(1, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def _permuted(h: np.ndarray) -> np.ndarray:
    """(shingles, permutations) hashes."""
    return h[:, None] * _ODD[None, :] + _SHIFT[None, :]


def _grams(words: list[bytes], size: int) -> set[tuple[bytes, ...]]:
    size = min(size, len(words))
    return set(zip(*(words[i:] for i in range(size)), strict=False)) if words else set()


class Index:
    """MinHash minima of one block of items, by shingle length and size class."""

    def __init__(self, items: list[tuple[int | None, str | None]], shingle: int):
        self.shingle, self.items = shingle, []
        minima: dict = defaultdict(lambda: defaultdict(set))
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            own = rolling_shingles(word_hashes(text), shingle)
            size = min(shingle, len(words))
            at = len(self.items)
            self.items.append((item_id, size, _grams(words, size)))
            for m in _permuted(np.unique(own)).min(axis=0).tolist():
                minima[size, int(np.log2(len(own)))][m].add(at)
        self.tables: dict[int, list] = defaultdict(list)
        for (size, c), by in sorted(minima.items()):
            values = np.array(sorted(by), np.uint64)
            seen = np.zeros(1 << 20, bool)
            seen[values >> np.uint64(44)] = True
            self.tables[size].append((c, values, seen, [sorted(by[int(v)]) for v in values]))

    def candidates(self, of_words: np.ndarray) -> set[int]:
        """Positions in ``items`` of those that share a minimum with a window of the document."""
        found: set[int] = set()
        for size, classes in self.tables.items():
            if len(of_words) < size:
                continue
            h, have = rolling_shingles(of_words, size), classes[0][0]
            step = 2 << have
            rows = max(1, 16384 // step) * step
            minima = np.concatenate([np.minimum.reduceat(_permuted(h[at : at + rows]), np.arange(0, len(h[at : at + rows]), step), axis=0) for at in range(0, len(h), rows)])
            for c, values, seen, who in classes:
                while have < c:  # two blocks make one of the next class
                    if len(minima) % 2:
                        minima = np.concatenate((minima, minima[-1:]))
                    minima, have = np.minimum(minima[::2], minima[1::2]), have + 1
                windows = np.minimum(minima, np.concatenate((minima[1:], minima[-1:]))).ravel()
                windows = windows[seen[windows >> np.uint64(44)]]
                if not len(windows):
                    continue
                place = np.searchsorted(values, windows)
                place[place == len(values)] = 0
                for p in np.unique(place[values[place] == windows]).tolist():
                    found.update(who[p])
        return found

    def contained(self, text: str | None, threshold: float) -> list[tuple[int | None, float]]:
        """(item_id, containment) of the items whose containment is at least ``threshold``."""
        out, grams, words = [], {}, None
        for at in sorted(self.candidates(word_hashes(text))):
            words = words_of(text) if words is None else words
            item_id, size, own = self.items[at]
            if size not in grams:
                grams[size] = _grams(words, size) if len(words) >= size else set()
            share = len(own & grams[size]) / len(own)
            if share >= threshold:
                out.append((item_id, share))
        return out


def _indexes(benchmark: DataFrame, shingle: int) -> Iterator[Index]:
    """Indexes of blocks of at most ``BLOCK`` items; the benchmark is a stated query set."""
    items = pick(benchmark, item_id="long", text="string")
    block = []
    for row in items.toLocalIterator():
        block.append((row["item_id"], row["text"]))
        if len(block) == BLOCK:
            yield Index(block, shingle)
            block = []
    yield Index(block, shingle)


def search(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """(doc_id, item_id, containment): a row for each row of ``docs`` and each contained item.

    containment is the share of the item's distinct ``shingle``-word shingles that the document
    holds; an item of fewer words is one shingle of its length.  Items without words are
    contained nowhere, documents without words contain nothing.  Repeated documents and items
    get a row each; null ids stay null.  Empty tables give an empty result.
    """
    schema = "doc_id long, item_id long, containment double"
    out = None
    for index in _indexes(benchmark, shingle):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = sent.value
            for batch in batches:
                rows = [(d.as_py(), *x) for d, t in zip(batch.column(0), batch.column(1), strict=True) for x in own.contained(t.as_py(), threshold)]
                yield pa.record_batch([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64())], names=["doc_id", "item_id", "containment"])

        part = pick(docs, doc_id="long", text="string").mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs``, all columns, that contain no item (see :func:`search`)."""
    at, rows = place(docs, "text"), plain(docs)
    for index in _indexes(benchmark, shingle):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = sent.value
            for batch in batches:
                yield batch.filter(pa.array([not own.contained(t.as_py(), threshold) for t in batch.column(at).cast(pa.string())], pa.bool_()))

        rows = rows.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema]))
    return rows.toDF(*docs.columns)
