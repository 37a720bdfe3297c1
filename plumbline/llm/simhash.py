"""SimHash near-duplicate groups through Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits (the last is padded to 23). Every 23-bit word lies
within 3 bits of exactly one word of the perfect binary Golay code. The keys of a segment are the codeword indices of
the segment and of all words one bit away: 1 key, or 6 where the segment is 3 bits from its codeword. Segments that
differ in at most one bit share a key.

Pigeonhole for a radius of 3: with errors (a, b, c), either one segment is equal and another one holds one error at
most, or all three hold exactly one. Hence exact(i) x fuzzy(j) for the six ordered pairs, of 30 or 35 bits, and for the
last case fuzzy(0) x half of segment 1 x half of segment 2, as one error leaves a half of its segment equal: four keys of
32 or 33 bits for each codeword index. These are 60 keys at most, and every kind has at least 2^30 values, so that
unrelated fingerprints seldom meet. All rows of a key are verified by the exact Hamming distance; within a key a spanning forest of the
verified links is emitted instead of all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, permutations, product, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm._common import join_unique, map_arrow, materialize, slices
from plumbline.llm.components import components

RADIUS = 3
SHINGLE_WORDS = 3
_SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Generator polynomial x^11+x^10+x^6+x^5+x^4+x^2+1 of the (23, 12, 7) code: fixed value.
_GOLAY = 0b110001110101


def fingerprint(text: str | bytes | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of the word shingles, repeats included; 0 for null or a text without words."""
    if text is None:
        return 0
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text
    words = raw.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    k = min(shingle_words, len(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    cuts = map(slice, starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, cuts), repeat(42)), np.uint64, len(words) - k + 1)
    if len(hashes) < 64:
        counts = np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    else:
        by_byte = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
        counts = np.concatenate([np.bincount(by_byte[:, i], minlength=256) @ _BITS for i in range(8)])
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def row_key(id_col: str, text_col: str) -> tuple[Column, Column]:
    """128 bits that identify a row's id and text."""
    doc_id, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    return F.xxhash64(doc_id, doc_id.isNull(), text), F.xxhash64(F.lit("k2"), text, text.isNull(), doc_id)


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, k1, k2, fp): one row per row of docs; (k1, k2) identify id and text, fp is a signed long."""
    schema = pa.schema([("doc_id", pa.int64()), ("k1", pa.int64()), ("k2", pa.int64()), ("fp", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                fps = np.fromiter((fingerprint(t, shingle_words) for t in part.column(3).to_pylist()), np.uint64, part.num_rows)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(fps.view(np.int64))], schema=schema)

    k1, k2 = row_key(id_col, text_col)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), k1.alias("k1"), k2.alias("k2"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(source, work, "doc_id long, k1 long, k2 long, fp long")


@lru_cache(maxsize=1)
def _decoder() -> np.ndarray:
    """Codeword index of the nearest codeword, for each of the 2^23 words."""
    data = np.arange(1 << 12, dtype=np.int64)
    codes = np.zeros_like(data)
    for bit in range(12):
        codes ^= np.where(data >> bit & 1, _GOLAY << bit, 0)
    errors = np.array([sum(1 << b for b in c) for k in range(4) for c in combinations(range(23), k)], np.int64)
    nearest = np.full(1 << 23, -1, np.int16)
    for e in errors:
        nearest[codes ^ e] = data
    return nearest


def _fuzzy(words: np.ndarray, width: int) -> np.ndarray:
    """(n, 6) codeword indices of the words and all words one bit away; -1 pads. Sorted, distinct."""
    near = _decoder()
    every = np.stack([near[words], *(near[words ^ (1 << b)] for b in range(width))], axis=1)
    every.sort(axis=1)
    every[:, 1:][every[:, 1:] == every[:, :-1]] = -1
    every[:, ::-1].sort(axis=1)
    return every[:, :6].astype(np.int64)


def link_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) pairs: any two fingerprints within 3 bits share a key."""
    bits = fps.view(np.uint64)
    exact = [(bits >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in _SEGMENTS]
    fuzzy = [_fuzzy(x, n) for x, (_, n) in zip(exact, _SEGMENTS)]
    rows, keys = [], []

    def add(tag: int, wide: np.ndarray, narrow: np.ndarray, keep: np.ndarray) -> None:
        row = np.nonzero(keep)[0]
        rows.append(row)
        keys.append((np.int64(tag) << 48 | wide << 16 | narrow)[keep])

    for tag, (i, j) in enumerate(permutations(range(3), 2)):
        add(tag, exact[i][:, None], fuzzy[j], fuzzy[j] >= 0)
    halves = [(x >> n // 2, x & (1 << n // 2) - 1) for x, (_, n) in zip(exact, _SEGMENTS)]
    for tag, (x, y) in enumerate(product(halves[1], halves[2]), 6):
        add(tag, fuzzy[0] << 12 | x[:, None], y[:, None], fuzzy[0] >= 0)
    return np.concatenate(rows), np.concatenate(keys)


def _forest(members: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Edges (member, root) that connect members linked through steps of at most `radius` bits.

    A breadth-first search: each reached fingerprint is compared with those not yet reached only, so a dense group
    costs little more than its size, and memory is a few arrays of the group's length.
    """
    out, left = [], np.unique(members).view(np.uint64)
    while len(left) > 1:
        root, left, frontier, reached = left[0], left[1:], [left[0]], []
        while frontier and len(left):
            at = frontier.pop()
            near = np.bitwise_count(left ^ at) <= radius
            if near.any():
                got, left = left[near], left[~near]
                frontier.extend(got)
                reached.append(got)
        if reached:
            v = np.concatenate(reached).view(np.int64)
            out.append((v, np.full(len(v), np.array(root).view(np.int64))))
    return out


def link_groups(batches: Iterator[pa.RecordBatch], radius: int = RADIUS, small: int = 6) -> Iterator[pa.RecordBatch]:
    """Verified links from rows (key, fp) sorted by key; a key's rows may span batches."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def solve(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.append(heads, len(key)))
        us, vs = [], []
        width = np.repeat(sizes, sizes)
        for step in range(1, small):
            at = np.flatnonzero((width[:-step] <= small) & (key[:-step] == key[step:])) if step < len(key) else np.empty(0, np.int64)
            if not len(at):
                break
            x, y = fp[at], fp[at + step]
            ok = (np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64)) <= radius) & (x != y)
            us.append(x[ok])
            vs.append(y[ok])
        for i in np.flatnonzero(sizes > small):
            for u, v in _forest(fp[heads[i] : heads[i] + sizes[i]], radius):
                us.append(u)
                vs.append(v)
        if us and sum(map(len, us)):
            u, v = np.concatenate(us), np.concatenate(vs)
            pairs = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], schema=schema)

    for batch in batches:
        key, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if not len(key):
            continue
        cut = int(np.searchsorted(key, key[-1], side="left"))
        if cut or (held and held[-1][0][-1] != key[-1]):
            held.append((key[:cut], fp[:cut]))
            yield from solve(*(np.concatenate(x) for x in zip(*held)))
            held = []
        held.append((key[cut:], fp[cut:]))
    if held:
        yield from solve(*(np.concatenate(x) for x in zip(*held)))


def near_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v): links that connect all fingerprints (column fp) within `radius` bits, transitively the same groups."""
    if radius > RADIUS:
        raise ValueError("the Golay keys guarantee a radius of 3 bits at most")
    schema = pa.schema([("key", pa.int64()), ("fp", pa.int64())])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for start in range(0, len(fp), 2000):
                part = np.ascontiguousarray(fp[start : start + 2000])
                row, key = link_keys(part)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[row])], schema=schema)

    keys = map_arrow(fps.select("fp").distinct(), keyed, "key long, fp long")
    sorted_keys = keys.repartition("key").sortWithinPartitions("key")
    return map_arrow(sorted_keys, lambda it: link_groups(it, radius), "u long, v long").distinct()


def _grouped(docs: DataFrame, id_col: str, text_col: str, radius: int) -> DataFrame:
    """(doc_id, k1, k2, fp, group_fp, component_id) for each row; group_fp is the group's least fingerprint."""
    fps = materialize(fingerprints(docs, id_col, text_col))
    least = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.count("*").alias("rows")))
    comps = materialize(components(near_links(fps, radius)))
    rooted = least.join(comps, least.fp == comps.node).select("fp", "root", "least_id")
    grouped = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    linked = rooted.join(grouped, "root").select(F.col("fp").alias("linked_fp"), "root", "component_id")
    classes = least.join(linked, F.col("fp") == F.col("linked_fp"), "left").select(
        "fp",
        "rows",
        F.coalesce("root", "fp").alias("group_fp"),
        F.when(F.col("root").isNull(), F.col("least_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
    total = least.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    return join_unique(fps, materialize(classes), "fp", "rows", total).select("doc_id", "k1", "k2", "fp", "group_fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) for each row of docs.

    component_id is the least id reachable over links of at most `radius` differing bits, itself included. Null and
    word-less texts have fingerprint 0 and are linked like any other. Rows with a null id keep a row; they take part
    in linking, and their component_id is null only if no linked row has an id. Repeated rows each keep a row. Other
    columns are ignored. An empty table gives an empty table.
    """
    return _grouped(docs, id_col, text_col, radius).select("doc_id", "fp", "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row of each group, with all columns of docs: the one with the least id (null last), then the least key.

    Null and word-less texts are one group. Of repeated rows one stays. An empty table gives an empty table. The choice is made on ids and hashes; the documents themselves are shuffled once.
    """
    choice = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")
    keep = _grouped(docs, id_col, text_col, radius).groupBy("group_fp").agg(F.min(choice).alias("kept")).select("kept.k1", "kept.k2")
    k1, k2 = row_key(id_col, text_col)
    name1, name2 = (f"__{n}_{len(docs.columns)}" for n in ("k1", "k2"))
    once = docs.withColumns({name1: k1, name2: k2}).dropDuplicates([name1, name2])
    return once.join(keep, (once[name1] == keep.k1) & (once[name2] == keep.k2), "left_semi").select(*docs.columns)
