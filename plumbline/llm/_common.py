"""Helpers shared by the training-data operators: shared-folder tables, Arrow slicing, word spans."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import ship

_FALLBACK: dict[str, str] = {}
_LIBC: list = []

#: Text bytes that one vectorised step handles; a single longer text is a step of its own.
SLICE_BYTES = 1 << 21


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a temporary one in local mode only, where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not re.match(r"local(\[|$)", master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        root = _FALLBACK.setdefault(app, tempfile.mkdtemp(prefix="plumbline-"))
    return f"{root}/plumbline-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts lineage, survives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_unique(rows: DataFrame, table: DataFrame, key: str, times: str, total: int) -> DataFrame:
    """Inner join of rows with a table that has one row a key, whatever share of the rows a key has.

    `times` is the table's column of how many of the `total` rows have the key. Keys of at least one row in 2^14 (so
    2^14 keys at most) and 1,024 rows are joined by broadcast, where the rows stay; the others by shuffle.
    """
    hot = F.col(times) >= max(1024, total >> 14)
    near = rows.join(F.broadcast(table.where(hot)), key)
    far = rows.join(F.broadcast(table.where(hot).select(key)), key, "left_anti").join(table.where(~hot), key)
    return near.unionByName(far)


#: Bytes of an Arrow batch at most: texts come in small pieces.
BATCH_BYTES = 4 << 20
_UNITS = {"": 1, "b": 1, **{f"{u}{end}": 1 << 10 * k for k, u in enumerate("kmgtp", 1) for end in ("", "b")}}
#: Numbers of malloc's settings (M_MMAP_THRESHOLD, M_TRIM_THRESHOLD): fixed values.
_MMAP_THRESHOLD, _TRIM_THRESHOLD = -3, -1


def size_of(text: str) -> int:
    """The bytes of a Spark setting such as 64m or 4194304b."""
    number, unit = re.fullmatch(r"\s*(\d+)\s*([a-z]*)\s*", text.lower()).groups()
    return int(number) * _UNITS[unit]


def _reuse_memory() -> None:
    """Let malloc keep numpy's arrays of a few MB for the next ones, where the C library can be told so."""
    if not _LIBC:
        _LIBC.append(ctypes.CDLL(None))
        if hasattr(_LIBC[0], "mallopt"):
            _LIBC[0].mallopt(_MMAP_THRESHOLD, 8 << 20)
            _LIBC[0].mallopt(_TRIM_THRESHOLD, 64 << 20)


#: What a worker process holds from one task to the next, by name.
HELD: dict[str, dict] = {}


def _let_go(keep: str | None) -> None:
    """Drop what earlier stages hold in this process; a worker process lives on between stages."""
    for name, held in HELD.items():
        if name != keep:
            held.clear()


def _give_back() -> None:
    """Free memory to the system: a worker process lives on between tasks."""
    _POWERS.clear()
    pa.default_memory_pool().release_unused()
    if hasattr(_LIBC[0], "malloc_trim"):
        _LIBC[0].malloc_trim(0)


def map_arrow(df: DataFrame, work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema, keep: str | None = None) -> DataFrame:
    """mapInArrow in batches of BATCH_BYTES or one row, with this package sent to the workers; memory is given back
    after each partition, but for what is in HELD under the name `keep`, which stays until another stage comes.

    Where the session's own bound on Arrow batches is higher, it is lowered for the session: Spark reads it when a plan
    runs, so it can't be put back here.
    """
    spark = df.sparkSession
    ship(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if size_of(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, BATCH_BYTES)

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _reuse_memory()
        _let_go(keep)
        yield from work(batches)
        _give_back()

    return df.mapInArrow(tidy, schema)


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n+1 offsets of a string column, without copying; null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_null(column.type) or column.null_count:
        column = column.cast(pa.string()).fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32) if offsets else np.zeros(1, np.int32)
    ends = ends[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if not len(ends):
        ends = np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece holds at most `limit` text bytes, or one row."""
    if not batch.num_rows:
        return
    _, ends = text_buffer(batch.column(batch.schema.get_field_index(column)))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(ends, ends[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


#: A-Z to a-z, every other byte to itself.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def word_spans(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte start and end of every word `[^\\x20\\x09-\\x0D]+`, and the row it is in."""
    inside = (raw != np.uint8(0x20)) & (raw - np.uint8(0x09) > np.uint8(4))  # below 0x09 the difference wraps round
    first = inside.copy()
    last = inside.copy()
    if len(raw):
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        cuts = ends[1:-1]
        cuts = cuts[(cuts > 0) & (cuts < len(raw))]
        first[cuts] = inside[cuts]
        last[cuts - 1] = inside[cuts - 1]
    starts = np.flatnonzero(first)
    stops = np.flatnonzero(last) + 1
    rows = np.repeat(np.arange(len(ends) - 1), np.diff(np.searchsorted(starts, ends)))
    return starts, stops, rows


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, base in (("up", _BASE), ("down", inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps)
    return _POWERS["up"], _POWERS["down"]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit values (the finaliser of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hashes(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span: one running polynomial sum over the buffer, no per-word work."""
    up, down = _powers(len(raw) + 1)
    total = np.empty(len(raw) + 1, np.uint64)
    total[0] = 0
    np.add(raw, np.uint64(1), out=total[1:])
    total[1:] *= up[: len(raw)]
    np.cumsum(total[1:], out=total[1:])
    return mix64((total[stops] - total[starts]) * down[starts] + (stops - starts).astype(np.uint64))


def record_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [columns[f.name] if isinstance(columns[f.name], pa.Array) else pa.array(columns[f.name], f.type) for f in schema],
        schema=schema,
    )
