"""Reducers of groupBy and aggregate: Column -> aggregate Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.nulls import col


def sum_(c) -> Column:
    return F.sum(col(c))


plus = sum_


def count(c=None) -> Column:
    return F.count(F.lit(1) if c is None else col(c))


size = count


def count_distinct(c) -> Column:
    return F.count_distinct(col(c))


def average(c) -> Column:
    return F.avg(col(c))


mean = avg = average


def min_(c) -> Column:
    return F.min(col(c))


def max_(c) -> Column:
    return F.max(col(c))


def first(c) -> Column:
    return F.any_value(col(c))


def std_dev_sample(c) -> Column:
    return F.stddev_samp(col(c))


std_dev = std_dev_sample


def std_dev_population(c) -> Column:
    return F.stddev_pop(col(c))


def variance_sample(c) -> Column:
    return F.var_samp(col(c))


def variance_population(c) -> Column:
    return F.var_pop(col(c))


def variance(c, sample: bool = True) -> Column:
    return variance_sample(c) if sample else variance_population(c)


def median(c) -> Column:
    return F.median(col(c))


def mode(c) -> Column:
    return F.mode(col(c), True)


def percentile(name: str, p: float, ascending: bool = True, continuous: bool = True) -> Column:
    """Of a column by name: the SQL form is the only one with an order."""
    kind, order = ("cont", "") if continuous else ("disc", "" if ascending else " DESC")
    share = p if ascending or not continuous else 1 - p
    return F.expr(f"CAST(percentile_{kind}({share!r}D) WITHIN GROUP (ORDER BY `{name}`{order}) AS DOUBLE)")


def join_strings(c, separator: str = "", order_by=None, descending: bool = False) -> Column:
    """In the order of a key, or of the texts themselves: rows have no order of their own."""
    item = F.struct((col(c) if order_by is None else col(order_by)).alias("k"), col(c).cast("string").alias("v"))
    items = F.sort_array(F.collect_list(F.when(col(c).isNotNull(), item)), not descending)
    return F.array_join(F.transform(items, lambda x: x["v"]), separator)


def list_(c) -> Column:
    return F.collect_list(col(c))


def row_mapper(value, key) -> Column:
    return F.struct(col(value).alias("value"), col(key).alias("key"))


wavg_row_mapper = row_mapper


def corr(a, b) -> Column:
    return F.corr(col(a), col(b))


def covar_sample(a, b) -> Column:
    return F.covar_samp(col(a), col(b))


def covar_population(a, b) -> Column:
    return F.covar_pop(col(a), col(b))


def max_by(value, key, k: int | None = None) -> Column:
    if k is None:
        return F.max_by(col(value), col(key))
    rows = F.sort_array(F.collect_list(F.struct(col(key).alias("k"), col(value).alias("v"))), False)
    return F.transform(F.slice(rows, 1, k), lambda x: x["v"])


def min_by(value, key, k: int | None = None) -> Column:
    if k is None:
        return F.min_by(col(value), col(key))
    rows = F.sort_array(F.collect_list(F.struct(col(key).alias("k"), col(value).alias("v"))), True)
    return F.transform(F.slice(rows, 1, k), lambda x: x["v"])


def wavg(value, weight) -> Column:
    return F.sum(col(value) * col(weight)) / F.sum(col(weight))


def and_(c) -> Column:
    return F.bool_and(col(c))


def or_(c) -> Column:
    return F.bool_or(col(c))


def is_distinct(c) -> Column:
    return F.count_distinct(col(c)) == F.count(col(c))


def unique_value_only(c) -> Column:
    return F.when(F.count_distinct(col(c)) == 1, F.any_value(col(c), True))


def hash_code(c) -> Column:
    """The same for any order of the values; no group is held in one row."""
    return F.xxhash64(F.sum(F.xxhash64(col(c)).cast("decimal(20,0)")), F.count(col(c)))
