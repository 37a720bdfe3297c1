"""Hash functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.nulls import col


def hash_(text, algorithm: str = "MD5") -> Column:
    text = col(text)
    return {"MD5": F.md5(text), "SHA1": F.sha1(text), "SHA256": F.sha2(text, 256)}[algorithm]


def hash_code(*values) -> Column:
    """64 bits; the value is this engine's own."""
    return F.xxhash64(*map(col, values))
