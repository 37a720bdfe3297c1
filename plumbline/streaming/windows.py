"""Event-time aggregation over streams: an extension, as the query language has no streams of its own.

The same functions take a stream or a table, so that a plan can be tested on a table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def _marked(df: DataFrame, time: str, late: str) -> DataFrame:
    df = df.withColumn(time, F.col(time).cast("timestamp"))
    return df.withWatermark(time, late) if df.isStreaming else df


def tumbling(df: DataFrame, time: str, size: str, keys: Sequence[str] = (), late: str = "10 minutes", **aggregates: Column) -> DataFrame:
    return sliding(df, time, size, size, keys, late, **aggregates)


def sliding(df: DataFrame, time: str, size: str, step: str, keys: Sequence[str] = (), late: str = "10 minutes", **aggregates: Column) -> DataFrame:
    """Columns window_start, window_end, the keys and the aggregates."""
    grouped = _marked(df, time, late).groupBy(F.window(time, size, step), *keys)
    return _flat(grouped.agg(*(a.alias(n) for n, a in aggregates.items())), "window", keys, list(aggregates))


def sessions(df: DataFrame, time: str, gap: str, keys: Sequence[str], late: str = "10 minutes", **aggregates: Column) -> DataFrame:
    grouped = _marked(df, time, late).groupBy(F.session_window(time, gap), *keys)
    return _flat(grouped.agg(*(a.alias(n) for n, a in aggregates.items())), "session_window", keys, list(aggregates))


def _flat(df: DataFrame, window: str, keys: Sequence[str], names: list[str]) -> DataFrame:
    bounds = [F.col(f"{window}.{e}").cast("timestamp_ntz").alias(f"window_{e}") for e in ("start", "end")]
    return df.select(*bounds, *keys, *names)


def first_of_each(df: DataFrame, time: str, keys: Sequence[str], late: str = "10 minutes") -> DataFrame:
    """Rows without repeats of the keys; on a stream, repeats within the watermark."""
    df = _marked(df, time, late)
    return df.dropDuplicatesWithinWatermark(list(keys)) if df.isStreaming else df.dropDuplicates(list(keys))


def write_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Run what has arrived to its end, exactly once into Parquet files."""
    return df.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)
