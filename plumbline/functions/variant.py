"""Semi-structured values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.nulls import col


def from_json(text) -> Column:
    return F.parse_json(col(text))


def get(v, key: str | int) -> Column:
    path = f"$[{key}]" if isinstance(key, int) else f"$['{key}']"
    return F.try_variant_get(col(v), path, "variant")


def to(v, kind: str) -> Column:
    return F.try_variant_get(col(v), "$", kind)


def to_many(v, kind: str) -> Column:
    return F.try_variant_get(col(v), "$", f"array<{kind}>")


def to_variant(x) -> Column:
    """Of any value: Spark turns lists and structs alone into a variant, so it goes in a struct and is taken out again."""
    return F.variant_get(F.to_variant_object(F.struct(col(x).alias("v"))), "$.v", "variant")


def to_json(v) -> Column:
    return F.to_json(col(v))
