"""Functions of lists (array columns) and maps. Places count from 0; lists hold no nulls once compacted."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.nulls import col

Fn = Callable[[Column], Column]


def _size(c) -> Column:
    return F.coalesce(F.size(col(c)), F.lit(0))


def list_(*values) -> Column:
    return F.array(*map(col, values))


def compact(c) -> Column:
    return F.array_compact(col(c))


def size(c) -> Column:
    return _size(c).cast("bigint")


count = size


def is_empty(c) -> Column:
    return _size(c) == 0


def is_not_empty(c) -> Column:
    return _size(c) > 0


def at(c, i) -> Column:
    c, i = col(c), col(i)
    message = F.concat(F.lit("The system is trying to get an element at offset "), i.cast("string"), F.lit(" where the collection is of size "), _size(c).cast("string"))
    return F.when((i < 0) | (i >= _size(c)), F.raise_error(message)).otherwise(F.get(c, i))


def add(c, value, index=None) -> Column:
    if index is None:
        return F.array_append(col(c), col(value))
    out_of = (col(index) < 0) | (col(index) > _size(c))
    return F.when(out_of, F.raise_error(F.lit("index out of bounds"))).otherwise(F.array_insert(col(c), col(index) + 1, col(value)))


def first(c) -> Column:
    return F.get(col(c), F.lit(0))


head = first


def last(c) -> Column:
    return F.try_element_at(col(c), F.lit(-1))


def init(c) -> Column:
    return F.slice(col(c), F.lit(1), F.greatest(_size(c) - 1, F.lit(0)))


def tail(c) -> Column:
    return F.slice(col(c), F.lit(2), F.greatest(_size(c), F.lit(1)))


def take(c, n) -> Column:
    return F.slice(col(c), F.lit(1), F.greatest(col(n), F.lit(0)))


limit = take


def drop(c, n) -> Column:
    n = F.greatest(col(n), F.lit(0))
    return F.slice(col(c), n + 1, F.greatest(_size(c), F.lit(1)))


def slice_(c, start, end) -> Column:
    start = F.greatest(col(start), F.lit(0))
    return F.slice(col(c), start + 1, F.greatest(col(end) - start, F.lit(0)))


def concatenate(a, b) -> Column:
    return F.concat(col(a), col(b))


def contains(c, value) -> Column:
    """value: a value, or a condition on an element."""
    if callable(value) and not isinstance(value, Column):
        return exists(c, value)
    return F.coalesce(F.array_contains(col(c), col(value)), F.lit(False))


def distinct(c) -> Column:
    return F.array_distinct(col(c))


remove_duplicates = distinct


def remove_duplicates_by(c, key: Fn) -> Column:
    c = col(c)
    keys = F.transform(c, key)
    return F.filter(c, lambda x, i: F.array_position(keys, key(x)) == i + 1)


def remove_all(c, other) -> Column:
    other = col(other)
    return F.filter(col(c), lambda x: ~F.array_contains(other, x))


remove_all_optimized = remove_all


def exists(c, f: Fn) -> Column:
    return F.coalesce(F.exists(col(c), lambda x: F.coalesce(f(x), F.lit(False))), F.lit(False))


def for_all(c, f: Fn) -> Column:
    return F.coalesce(F.forall(col(c), lambda x: F.coalesce(f(x), F.lit(False))), F.lit(True))


def filter_(c, f: Fn) -> Column:
    return F.filter(col(c), f)


def find(c, f: Fn) -> Column:
    return F.get(F.filter(col(c), f), F.lit(0))


def map_(c, f: Fn) -> Column:
    """The elements' images; null ones drop."""
    return F.array_compact(F.transform(col(c), f))


def fold(c, f: Callable[[Column, Column], Column], start) -> Column:
    """f takes (element, accumulator)."""
    return F.aggregate(col(c), col(start), lambda acc, x: f(x, acc))


def index_of(c, value) -> Column:
    return (F.coalesce(F.array_position(col(c), col(value)), F.lit(0)) - 1).cast("bigint")


def reverse(c) -> Column:
    return F.reverse(col(c))


def sort(c, key: Fn | None = None, descending: bool = False) -> Column:
    """Ascending by value or key; equal keys keep their order."""
    c = col(c)
    if key is None:
        return F.reverse(F.array_sort(c)) if descending else F.array_sort(c)

    def order(a: Column, b: Column) -> Column:
        x, y = (b, a) if descending else (a, b)
        by_key = F.when(x["k"] < y["k"], -1).when(x["k"] > y["k"], 1)
        return by_key.otherwise(F.when(a["i"] < b["i"], -1).otherwise(1))

    keyed = F.transform(c, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("v")))
    return F.transform(F.array_sort(keyed, order), lambda x: x["v"])


sort_by = sort


def sort_by_reversed(c, key: Fn) -> Column:
    return sort(c, key, descending=True)


def zip_(a, b) -> Column:
    """Pairs up to the shorter list's end."""
    a, b = col(a), col(b)
    n = F.least(_size(a), _size(b))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: pair(x, y))


def pair(first_, second) -> Column:
    return F.struct(col(first_).alias("first"), col(second).alias("second"))


def range_(start, stop=None, step=1) -> Column:
    """start (0 if only one bound is given) up to but without stop."""
    start, stop = (F.lit(0), col(start)) if stop is None else (col(start), col(stop))
    step = col(step)
    end = F.when(step > 0, stop - 1).otherwise(stop + 1)
    some = ((step > 0) & (start < stop)) | ((step < 0) & (start > stop))
    return F.when(some, F.sequence(start.cast("bigint"), F.when(some, end).otherwise(start).cast("bigint"), step.cast("bigint"))).otherwise(F.array().cast("array<bigint>"))


def and_(c) -> Column:
    return for_all(c, lambda x: x)


def or_(c) -> Column:
    return exists(c, lambda x: x)


def is_distinct(c) -> Column:
    return F.size(F.array_distinct(col(c))) == F.size(col(c))


def unique_value_only(c) -> Column:
    return F.when(F.size(F.array_distinct(col(c))) == 1, F.get(col(c), F.lit(0)))


def greatest(c) -> Column:
    return F.array_max(col(c))


def least(c) -> Column:
    return F.array_min(col(c))


def max_(c, comparator: Callable[[Column, Column], Column] | None = None) -> Column:
    return F.array_max(col(c)) if comparator is None else last(F.array_sort(col(c), comparator))


def min_(c, comparator: Callable[[Column, Column], Column] | None = None) -> Column:
    return F.array_min(col(c)) if comparator is None else first(F.array_sort(col(c), comparator))


def sum_(c) -> Column:
    """Null for an empty list."""
    return F.when(_size(c) > 0, F.aggregate(col(c).cast("array<double>"), F.lit(0.0), lambda a, x: a + x))


def product(c) -> Column:
    return F.when(_size(c) > 0, F.aggregate(col(c).cast("array<double>"), F.lit(1.0), lambda a, x: a * x))


def average(c) -> Column:
    return sum_(c) / F.when(_size(c) > 0, F.size(col(c)))


mean = average


def _moment(c) -> Column:
    c = col(c).cast("array<double>")
    m = average(c)
    return F.aggregate(c, F.lit(0.0), lambda a, x: a + (x - m) * (x - m))


def variance_sample(c) -> Column:
    return F.when(_size(c) > 1, _moment(c) / (F.size(col(c)) - 1))


def variance_population(c) -> Column:
    return F.when(_size(c) > 0, _moment(c) / F.size(col(c)))


def variance(c, sample: bool = True) -> Column:
    return variance_sample(c) if sample else variance_population(c)


def std_dev_sample(c) -> Column:
    return F.sqrt(variance_sample(c))


std_dev = std_dev_sample


def std_dev_population(c) -> Column:
    return F.sqrt(variance_population(c))


def _sorted(c) -> Column:
    return F.array_sort(F.array_compact(col(c).cast("array<double>")))


def percentile(c, p: float, ascending: bool = True, continuous: bool = True) -> Column:
    s = _sorted(c)
    n = F.size(s)
    if not continuous:
        place = F.greatest(F.ceil(F.lit(p) * n), F.lit(1))
        return F.when(n > 0, F.get(s, (place - 1 if ascending else n - place).cast("int")))
    at_ = F.lit(p if ascending else 1 - p) * (n - 1)
    low, high = F.get(s, F.floor(at_).cast("int")), F.get(s, F.ceil(at_).cast("int"))
    return F.when(n > 0, low + (high - low) * (at_ - F.floor(at_)))


def median(c) -> Column:
    return percentile(c, 0.5)


def mode(c) -> Column:
    """The most frequent element, the smallest on ties."""
    c = col(c)
    counted = F.transform(F.array_distinct(c), lambda x: F.struct((-F.size(F.filter(c, lambda y: y == x))).alias("n"), x.alias("v")))
    return F.array_min(counted)["v"]


def _joint(xs, ys, f) -> Column:
    xs, ys = col(xs).cast("array<double>"), col(ys).cast("array<double>")
    mx, my = average(xs), average(ys)
    return F.aggregate(F.zip_with(xs, ys, lambda x, y: f(x - mx, y - my)), F.lit(0.0), lambda a, x: a + x)


def covar_population(xs, ys) -> Column:
    return _joint(xs, ys, lambda x, y: x * y) / F.size(col(xs))


def covar_sample(xs, ys) -> Column:
    return _joint(xs, ys, lambda x, y: x * y) / (F.size(col(xs)) - 1)


def corr(xs, ys) -> Column:
    return _joint(xs, ys, lambda x, y: x * y) / F.sqrt(_joint(xs, ys, lambda x, y: x * x) * _joint(xs, ys, lambda x, y: y * y))


def max_by(c, key: Fn) -> Column:
    return F.array_max(F.transform(col(c), lambda x: F.struct(key(x).alias("k"), x.alias("v"))))["v"]


def min_by(c, key: Fn) -> Column:
    return F.array_min(F.transform(col(c), lambda x: F.struct(key(x).alias("k"), x.alias("v"))))["v"]


def new_map(pairs) -> Column:
    """From a list of pairs; of equal keys the last wins."""
    return F.map_from_entries(col(pairs))


def get(m, key) -> Column:
    return F.try_element_at(col(m), col(key))


def put(m, key, value) -> Column:
    return F.map_concat(col(m), F.create_map(col(key), col(value)))


def put_all(m, pairs) -> Column:
    return F.map_concat(col(m), F.map_from_entries(col(pairs)))


def keys(m) -> Column:
    return F.map_keys(col(m))


def values(m) -> Column:
    return F.map_values(col(m))
