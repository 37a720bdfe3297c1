"""Comparison and boolean functions with the null rules of the query language.

Columns are optional unless said otherwise. Equality of two optional columns is null-safe; ordering comparisons with a
null operand are false; `not equal` keeps rows in which one side is null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def equal(a, b, optional: bool = True) -> Column:
    """Null-safe equality; optional=False is the plain `=` of mapping joins. None is the empty collection."""
    if a is None and b is None:
        return F.lit(True)
    if a is None or b is None:
        return col(b if a is None else a).isNull()
    return col(a).eqNullSafe(col(b)) if optional else col(a) == col(b)


eq = equal
is_ = equal


def not_equal(a, b) -> Column:
    return ~equal(a, b)


def not_equal_ansi(a, b) -> Column:
    return col(a) != col(b)


def _ordered(a, b, compared: Column) -> Column:
    return F.coalesce(compared, F.lit(False))


def less_than(a, b) -> Column:
    return _ordered(a, b, col(a) < col(b))


def less_than_equal(a, b) -> Column:
    return _ordered(a, b, col(a) <= col(b))


def greater_than(a, b) -> Column:
    return _ordered(a, b, col(a) > col(b))


def greater_than_equal(a, b) -> Column:
    return _ordered(a, b, col(a) >= col(b))


def between(value, lower, upper) -> Column:
    return F.coalesce(col(value).between(col(lower), col(upper)), F.lit(False))


def in_(value, collection) -> Column:
    """Membership in a list of values or an array column; false for an empty list and for a null needle."""
    if isinstance(collection, Column):
        return F.coalesce(F.array_contains(collection, col(value)), F.lit(False))
    values = [v for v in collection if v is not None]
    return F.coalesce(col(value).isin(values), F.lit(False)) if values else F.lit(False)


def and_(*values) -> Column:
    out = col(values[0])
    for v in values[1:]:
        out = out & col(v)
    return out


def or_(*values) -> Column:
    out = col(values[0])
    for v in values[1:]:
        out = out | col(v)
    return out


def xor(a, b) -> Column:
    return col(a) != col(b)


def not_(value) -> Column:
    return ~col(value)


def is_empty(value) -> Column:
    return col(value).isNull()


def is_not_empty(value) -> Column:
    return col(value).isNotNull()


def coalesce(*values) -> Column:
    return F.coalesce(*map(col, values))


def if_(condition, then, otherwise) -> Column:
    """Both branches are evaluated lazily; a null condition takes the second one."""
    return F.when(col(condition), col(then)).otherwise(col(otherwise))


def match(value, *cases: tuple[Column, object], default=None) -> Column:
    """The first case whose condition holds."""
    out = None
    for condition, result in cases:
        out = F.when(condition, col(result)) if out is None else out.when(condition, col(result))
    return col(default) if out is None else out.otherwise(col(default))


#: Order of the kinds of values that can't be compared with each other: fixed values.
KINDS = ("number", "date", "boolean", "string")


def compare(a, b, kind_a: str | None = None, kind_b: str | None = None) -> Column:
    """-1, 0 or 1; across kinds the order of the kinds decides."""
    if kind_a and kind_b and kind_a != kind_b:
        return F.lit(1 if KINDS.index(kind_a) > KINDS.index(kind_b) else -1).cast("bigint")
    a, b = col(a), col(b)
    return F.when(a < b, -1).when(a > b, 1).when(a.isNull() | b.isNull(), None).otherwise(0).cast("bigint")


def to_one(value, is_list: bool = False) -> Column:
    """Identity for a row's value; the only element of a list, or an error."""
    value = col(value)
    if not is_list:
        return value
    message = F.concat(F.lit("Cannot cast a collection of size "), F.coalesce(F.size(value), F.lit(0)).cast("string"), F.lit(" to multiplicity [1]"))
    return F.when(F.coalesce(F.size(value), F.lit(0)) == 1, F.get(value, F.lit(0))).otherwise(F.raise_error(message))


def to_one_many(value) -> Column:
    value = col(value)
    return F.when(F.coalesce(F.size(value), F.lit(0)) > 0, value).otherwise(F.raise_error(F.lit("Cannot cast a collection of size 0 to multiplicity [1..*]")))


def trust_one(value) -> Column:
    return col(value)


def sql_true() -> Column:
    return F.lit(True)


def sql_false() -> Column:
    return F.lit(False)


def sql_null() -> Column:
    return F.lit(None)


def current_user_id() -> Column:
    return F.current_user()


def let(value) -> Column:
    return col(value)


def evaluate_and_deactivate(value) -> Column:
    return col(value)


def cast(value, to: str) -> Column:
    return col(value).cast(to)


def extract_enum_value(name: str, values: list[str]) -> Column:
    if name not in values:
        raise ValueError(f"no value {name!r} in the enumeration")
    return F.lit(name)
