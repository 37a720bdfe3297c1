"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact verification.

A document is contaminated by an item of n words if some window of n of its words (all of them, if it has fewer) has
a weighted Jaccard similarity of at least 0.8 with the item, over five-word shingles with their multiplicities. Words
are `[^\\x20\\x09-\\x0D]+` with A-Z in lower case. An item with fewer than five words has no shingle and takes no part.

A window can be that similar only if enough of its shingles are shingles of some item, so windows with fewer are
never fingerprinted; that screen loses nothing. The other windows get a 64-bit SimHash. Fingerprints are cut into
blocks; two that differ in at most `radius` bits differ in at most radius // blocks bits in some block, so probing
each block with all values that near finds every item within the radius. At similarity 0.8 two fingerprints differ in
10 bits on average with a standard deviation of 3; the radius of 20 leaves out about 1 in 5,000 of the windows that
are just at the threshold, and no equal text. What is found is verified on the words themselves.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm._common import LOWER, SLICE_BYTES, map_arrow, mix64, record_batch, slices, span_hashes, text_buffer, word_spans

WORDS = 5
THRESHOLD = 0.8
RADIUS = 20
BLOCKS = 7
#: Words of items that one pass over the documents takes along; more items take more passes.
PASS_WORDS = 2_000_000

_CUTS = [64 * i // BLOCKS for i in range(BLOCKS + 1)]
_WEIGHTS = mix64(np.arange(1, WORDS + 1, dtype=np.uint64))


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _hash_words(words: list[bytes]) -> np.ndarray:
    raw = np.frombuffer(b" ".join(words), np.uint8)
    starts, stops, _ = word_spans(raw, np.array([0, len(raw)]))
    return span_hashes(raw, starts, stops)


def _shingles(hashes: np.ndarray) -> np.ndarray:
    """Hash of the five words that start at each word; the last four positions mean nothing."""
    out = np.zeros_like(hashes)
    for k in range(WORDS):
        out[: len(hashes) - k] += hashes[k:] * _WEIGHTS[k] if k else hashes * _WEIGHTS[0]
    return mix64(out)


def _signs(shingles: np.ndarray) -> np.ndarray:
    return np.unpackbits(shingles.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).astype(np.int32)


def _fingerprints(counts: np.ndarray, n: int) -> np.ndarray:
    """Bits set in over half of n shingles, from counts of set bits."""
    return np.packbits(counts * 2 > n, axis=1).view(">u8")[:, 0].astype(np.uint64)


def weighted_jaccard(a: list[bytes], b: list[bytes]) -> float:
    """Exact similarity of two word sequences over five-word shingles with multiplicities."""
    x, y = (Counter(zip(*(w[k:] for k in range(WORDS)))) for w in (a, b))
    both = sum((x & y).values())
    return both / (sum(x.values()) + sum(y.values()) - both) if x or y else 0.0


class Screen:
    """The items of one pass, with their shingle set and the multi-index over their fingerprints."""

    def __init__(self, items: list[tuple[int, str]], threshold: float = THRESHOLD, radius: int = RADIUS):
        self.threshold, self.radius = threshold, radius
        self.items = [(i, w) for i, w in ((i, _words(t)) for i, t in sorted(items, key=lambda x: (x[0] is None, x[0] or 0, x[1] or ""))) if len(w) >= WORDS]
        self.length = np.array([len(w) for _, w in self.items], np.int64)
        parts, prints = [], []
        for _, words in self.items:
            shingles = _shingles(_hash_words(words))[: len(words) - WORDS + 1]
            parts.append(shingles)
            prints.append(_fingerprints(_signs(shingles).sum(axis=0)[None], len(shingles))[0])
        self.known = np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)
        self.filter = np.zeros(1 << 22, bool)
        self.filter[(self.known & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        self.prints = np.array(prints, np.uint64)
        self.lengths = sorted(set(self.length.tolist()))
        self.least = min((self._need(n - WORDS + 1, n - WORDS + 1) for n in self.lengths), default=0)
        self.index, self.near = [], []
        for k in range(BLOCKS):
            width = _CUTS[k + 1] - _CUTS[k]
            key = self.length << 16 | self._block(self.prints, k)
            order = np.argsort(key, kind="stable")
            self.index.append((key[order], order))
            self.near.append(np.array([sum(1 << b for b in c) for e in range(radius // BLOCKS + 1) for c in combinations(range(width), e)], np.int64))

    def _need(self, window: int, item: int) -> int:
        """Common shingles that the threshold takes, for so many shingles on either side."""
        return int(np.ceil((window + item) * self.threshold / (1 + self.threshold) - 1e-9))

    @staticmethod
    def _block(prints: np.ndarray, k: int) -> np.ndarray:
        return (prints >> np.uint64(64 - _CUTS[k + 1]) & np.uint64((1 << (_CUTS[k + 1] - _CUTS[k])) - 1)).astype(np.int64)

    def candidates(self, prints: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) of items of n words: exactly those within the radius."""
        windows, items = [], []
        for k, ((keys, order), near) in enumerate(zip(self.index, self.near)):
            probe = (np.int64(n) << 16 | self._block(prints, k)[:, None] ^ near).ravel()
            low, high = np.searchsorted(keys, probe, "left"), np.searchsorted(keys, probe, "right")
            hit = np.flatnonzero(high > low)
            count = (high - low)[hit]
            at = np.repeat(low[hit] - np.cumsum(count) + count, count) + np.arange(count.sum())
            windows.append(np.repeat(hit // len(near), count))
            items.append(order[at])
        pairs = np.unique(np.stack([np.concatenate(windows), np.concatenate(items)], axis=1), axis=0)
        near = np.bitwise_count(prints[pairs[:, 0]] ^ self.prints[pairs[:, 1]]) <= self.radius
        return pairs[near, 0], pairs[near, 1]

    def document(self, words: list[bytes], shingles: np.ndarray, hits: np.ndarray) -> dict[int, tuple[float, int, int]]:
        """item -> (similarity, first word, words) of the best window, the earliest on ties."""
        found: dict[int, tuple[float, int, int]] = {}
        total = np.concatenate([[0], np.cumsum(hits)])
        tried: dict[tuple[int, bytes], float] = {}
        for n in self.lengths:
            size = min(n, len(words))
            m = size - WORDS + 1
            need = self._need(m, n - WORDS + 1)
            if m < need:
                continue
            starts = np.flatnonzero(total[m:] - total[:-m] >= need)
            while len(starts):
                part = starts[starts < starts[0] + 20_000]
                starts = starts[len(part) :]
                first, last = int(part[0]), int(part[-1]) + m
                run = np.zeros((last - first + 1, 64), np.int32)
                np.cumsum(_signs(shingles[first:last]), axis=0, out=run[1:])
                prints = _fingerprints(run[part - first + m] - run[part - first], m)
                for w, item in zip(*(x.tolist() for x in self.candidates(prints, n))):
                    at = int(part[w])
                    window = words[at : at + size]
                    key = (item, b" ".join(window))
                    if key not in tried:
                        tried[key] = weighted_jaccard(window, self.items[item][1])
                    if tried[key] >= self.threshold and (item not in found or tried[key] > found[item][0]):
                        found[item] = (tried[key], at, size)
        return found

    def scan(self, column: pa.Array) -> Iterator[tuple[int, int, float, int, int]]:
        """(row, item_id, similarity, first word, words) for the texts of a column."""
        raw, ends = text_buffer(column)
        if not len(self.items) or not len(raw):
            return
        raw = LOWER[raw]
        starts, stops, rows = word_spans(raw, ends)
        if len(starts) < WORDS:
            return
        shingles = _shingles(span_hashes(raw, starts, stops))
        whole = np.zeros(len(rows), bool)
        whole[: 1 - WORDS] = rows[: 1 - WORDS] == rows[WORDS - 1 :]
        maybe = np.flatnonzero(self.filter[(shingles & np.uint64((1 << 22) - 1)).astype(np.int64)] & whole)
        at = np.minimum(np.searchsorted(self.known, shingles[maybe]), len(self.known) - 1)
        hit = np.zeros(len(rows), bool)
        hit[maybe[self.known[at] == shingles[maybe]]] = True
        counts = np.bincount(rows[hit], minlength=len(column))
        cuts = np.searchsorted(rows, np.arange(len(column) + 1))
        least = np.where(np.diff(cuts) >= self.lengths[-1], self.least, 1)  # a shorter text needs fewer
        for row in np.flatnonzero(counts >= least).tolist():
            a, b = int(cuts[row]), int(cuts[row + 1])
            words = raw[ends[row] : ends[row + 1]].tobytes().split()
            here = slice(a, b - WORDS + 1)
            for item, (similarity, first, size) in sorted(self.document(words, shingles[here], hit[here]).items()):
                yield row, self.items[item][0], similarity, first, size


def _passes(items: DataFrame, id_col: str, text_col: str, pass_words: int) -> Iterator[list[tuple[int, str]]]:
    """The items in bounded lists: at most about `pass_words` words each, or one item."""
    rows = items.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).where(F.col(text_col).isNotNull())
    held, words = [], 0
    for item_id, text in rows.toLocalIterator():
        held.append((item_id, text))
        words += len(text.split())
        if words >= pass_words:
            yield held
            held, words = [], 0
    if held:
        yield held


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD, pass_words: int = PASS_WORDS) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words) of the best window for each contaminated row and item.

    Null and empty texts, on either side, match nothing. Null ids are kept as null; repeated rows each give their
    rows; extra columns are ignored. Empty tables give an empty table. Documents are read once for each pass of items.
    """
    kind = "doc_id long, item_id long, similarity double, first_word long, n_words long"
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int64()), ("n_words", pa.int64())])
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = spark.createDataFrame([], kind)
    for held in _passes(items, item_id_col, item_text_col, pass_words):
        shared = spark.sparkContext.broadcast(Screen(held, threshold))  # bounded by pass_words

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, "text", SLICE_BYTES // 2):
                    found = list(shared.value.scan(part.column(1)))
                    if found:
                        row, item, similarity, first, size = zip(*found)
                        yield record_batch(schema, doc_id=part.column(0).take(pa.array(row)), item_id=item, similarity=similarity, first_word=first, n_words=size)

        out = out.union(map_arrow(source, work, kind))
    return out


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD, pass_words: int = PASS_WORDS) -> DataFrame:
    """The rows of docs that no item contaminates, with all their columns; no shuffle."""
    at = docs.columns.index(text_col)
    for held in _passes(items, item_id_col, item_text_col, pass_words):
        shared = docs.sparkSession.sparkContext.broadcast(Screen(held, threshold))

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch, text_col, SLICE_BYTES // 2):
                    keep = np.ones(part.num_rows, bool)
                    keep[[row for row, *_ in shared.value.scan(part.column(at))]] = False
                    yield part.filter(pa.array(keep))

        docs = map_arrow(docs, work, docs.schema)
    return docs
