"""Exact top-k inner products through a vector-approximation file.

The index holds blocks of vectors: their ids, their integer components, and for every component a cell number of a few
bits on the block's grid. A search scans the cells of a block; one matrix product gives an upper and a lower bound of
every score. The k-th best lower bound discards most vectors, the rest are read exactly in the order of their upper
bounds until the next bound lies below the k-th exact score. Nothing is approximate in the result.

Work: each task goes through its blocks with a slice of the queries and keeps k rows a query, so what is shuffled is k
rows for each query and task.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm._common import map_arrow, materialize, shared_dir

#: Bits of a cell number, and vectors in a block.
BITS = 6
BLOCK_ROWS = 8192
#: Bytes of query components that one pass over the index takes along; more queries take more passes.
SLICE_BYTES = 16 << 20
_EXACT = float(1 << 53)
_LONG = (1 << 63) - 1


def _matrices(ids: pa.Array, vectors: pa.Array, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, whole numbers) by vector length; rows that are null or hold null or non-finite components are left out."""
    offsets = vectors.offsets.to_numpy().astype(np.int64)
    values = vectors.values.to_numpy(zero_copy_only=False).astype(np.float64)
    length = np.diff(offsets)
    ok = vectors.is_valid().to_numpy(zero_copy_only=False) & ids.is_valid().to_numpy(zero_copy_only=False)
    numbers = ids.fill_null(0).to_numpy(zero_copy_only=False)
    for n in np.unique(length[ok]).tolist():
        rows = np.flatnonzero(ok & (length == n))
        got = values[offsets[rows][:, None] + np.arange(n)] if n else np.empty((len(rows), 0))
        fine = np.isfinite(got).all(axis=1)
        yield numbers[rows[fine]], np.floor(scale * got[fine])


def _as_integers(x: np.ndarray) -> np.ndarray:
    """int64 where that holds them, else Python integers."""
    return x.astype(np.int64) if not x.size or np.abs(x).max() < 2.0**62 else np.array([[int(v) for v in row] for row in x], object)


def build_index(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, bits: int = BITS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The written index over floor(scale * component): a row for each block.

    Vectors that are null, hold null or non-finite components, or have a null id take no part. Vectors of several
    lengths go to blocks of their own. Other columns are ignored, an empty table gives an empty index. Columns: dims, low (least component), step (width of a cell), ids, cells,
    exact (components as doubles, which hold the floor of a scaled double exactly).
    """
    schema = pa.schema([("dims", pa.int32()), ("low", pa.float64()), ("step", pa.float64()), ("ids", pa.binary()), ("cells", pa.binary()), ("exact", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, x in _matrices(batch.column(0), batch.column(1), scale):
                for a in range(0, len(ids), block_rows):
                    part = x[a : a + block_rows]
                    low, high = (float(part.min()), float(part.max())) if part.size else (0.0, 0.0)
                    step = 1.0
                    while (high - low) // step >= 1 << bits:
                        step *= 2
                    cells = np.floor((part - low) / step).astype(np.uint8)
                    one = [part.shape[1], low, step, ids[a : a + block_rows].astype("<i8").tobytes(), cells.tobytes(), part.astype("<f8").tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(one, schema)], schema=schema)

    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    return materialize(map_arrow(source, work, "dims int, low double, step double, ids binary, cells binary, exact binary"))


class _Best:
    """The k best (score, id) of each query so far: highest score first, then least id."""

    def __init__(self, n: int, k: int):
        self.rows: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        self.k = k

    def floor(self, q: int) -> float:
        return float(self.rows[q][-1][0]) if len(self.rows[q]) == self.k else -np.inf

    def add(self, q: int, scores: list[int], ids: list[int]) -> None:
        self.rows[q] = sorted([*self.rows[q], *zip(scores, ids)], key=lambda r: (-r[0], r[1]))[: self.k]


def _search_block(best: _Best, numbers: list[int], qids: np.ndarray, q: np.ndarray, low: float, step: float, ids: np.ndarray, cells: np.ndarray, exact: np.ndarray) -> None:
    """Improve `best` (for queries `numbers`) by one block."""
    k, n = best.k, len(ids)
    order = np.argsort(ids, kind="stable")
    plain = q.shape[1] == 0 or np.abs(exact).max(initial=0) * np.abs(q).max(initial=0) * q.shape[1] < _EXACT
    whole = None if plain else _as_integers(exact)
    cells = cells.astype(np.float64)
    for a in range(0, len(numbers), 256):
        part = q[a : a + 256]
        with np.errstate(over="ignore", invalid="ignore"):
            inner = cells @ part.T
            gain = np.maximum(part, 0).sum(axis=1) * (step - 1)
            loss = np.minimum(part, 0).sum(axis=1) * (step - 1)
            base = step * inner + low * part.sum(axis=1)
        upper, lower = base + gain, base + loss
        if not plain:  # rounding, and overflow of bounds, must not hide a vector
            slack = 1e-9 * (np.abs(exact).max() + step) * np.abs(part).sum(axis=1)
            upper, lower = np.nan_to_num(upper + slack, nan=np.inf), np.nan_to_num(lower - slack, nan=-np.inf)
        left, right = np.searchsorted(ids[order], qids[a : a + 256], "left"), np.searchsorted(ids[order], qids[a : a + 256], "right")
        for j in np.flatnonzero(right > left).tolist():  # a query's own rows
            upper[order[left[j] : right[j]], j] = lower[order[left[j] : right[j]], j] = -np.inf
        sure = np.partition(lower, n - k, axis=0)[n - k] if n > k else np.full(len(part), -np.inf)
        for j in range(len(part)):
            number = numbers[a + j]
            rows = np.flatnonzero((upper[:, j] >= max(sure[j], best.floor(number))) & (upper[:, j] > -np.inf))
            rows = rows[np.argsort(-upper[rows, j], kind="stable")]
            for b in range(0, len(rows), 32):
                if upper[rows[b], j] < best.floor(number):
                    break
                some = rows[b : b + 32]
                if plain:
                    scores = (exact[some] @ part[j]).astype(np.int64).tolist()
                else:
                    own = [int(v) for v in part[j]]
                    scores = [max(-_LONG - 1, min(_LONG, sum(int(x) * y for x, y in zip(whole[r], own)))) for r in some]
                best.add(number, scores, ids[some].tolist())


def search(index: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all indexed vectors for each query, all if there are fewer.

    The score is the inner product of the whole numbers floor(scale * component), saturated to the range of a long.
    Ties go to the smaller id. Rows with a query's own id are no candidates for it; only vectors of the query's length
    are. Equal query rows are one query; rows of one id with different vectors are several. Other columns are ignored, an
    empty table gives an empty one. Queries come to the driver slice_bytes at a time; each slice is a pass over the index,
    whose k rows a query are written before the next slice is read, so one slice is held at a time.
    """
    spark = index.sparkSession
    source = queries.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    rows = source.where("vec_id is not null and embedding is not null").distinct()
    kind = "number long, query_id long, vec_id long, score long"
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    spark.createDataFrame([], kind).write.parquet(path)
    first, held, size = 0, [], 0
    by_query = Window.partitionBy("number").orderBy(F.desc("score"), "vec_id")

    def one_pass(first: int, held: list) -> None:
        ids = pa.array([r[0] for r in held], pa.int64())
        groups: dict[int, tuple[list[int], np.ndarray, np.ndarray]] = {}
        for dims in {len(r[1]) for r in held}:
            at = [i for i, r in enumerate(held) if len(r[1]) == dims and all(v is not None and np.isfinite(v) for v in r[1])]
            vectors = np.floor(scale * np.array([held[i][1] for i in at], np.float64).reshape(len(at), dims))
            groups[dims] = (at, np.array([held[i][0] for i in at], np.int64), vectors)
        shared = spark.sparkContext.broadcast((ids.to_pylist(), groups))  # bounded by slice_bytes

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            all_ids, groups = shared.value
            best = _Best(len(all_ids), k)
            for batch in batches:
                for dims, low, step, ids, cells, exact in zip(*(c.to_pylist() for c in batch.columns)):
                    if dims not in groups:
                        continue
                    numbers, qids, vectors = groups[dims]
                    ids = np.frombuffer(ids, "<i8")
                    _search_block(best, numbers, qids, vectors, low, step, ids, np.frombuffer(cells, np.uint8).reshape(len(ids), dims), np.frombuffer(exact, "<f8").reshape(len(ids), dims))
            out = [(first + q, all_ids[q], i, s) for q, rows in enumerate(best.rows) for s, i in rows]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["number", "query_id", "vec_id", "score"])

        ranked = map_arrow(index, work, kind).withColumn("rank", F.row_number().over(by_query)).where(F.col("rank") <= k)
        ranked.select("number", "query_id", "vec_id", "score").write.mode("append").parquet(path)
        shared.destroy()

    for r in rows.toLocalIterator():
        held.append((r.vec_id, r.embedding))
        size += 8 * len(r.embedding) + 32
        if size >= slice_bytes:
            one_pass(first, held)
            first, held, size = first + len(held), [], 0
    if held:
        one_pass(first, held)
    ranked = spark.read.schema(kind).parquet(path).withColumn("rank", F.row_number().over(by_query))
    return ranked.select("query_id", "rank", "vec_id", "score")
