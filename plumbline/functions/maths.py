"""Mathematical functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from plumbline.functions.nulls import col


def _guarded(bad: Column, message: str, value: Column) -> Column:
    return F.when(bad, F.raise_error(F.lit(message)).cast("double")).otherwise(value)


def abs_(x) -> Column:
    return F.abs(col(x))


def acos(x) -> Column:
    return _guarded(F.abs(col(x)) > 1, "Unable to compute acos", F.acos(col(x)))


def asin(x) -> Column:
    return _guarded(F.abs(col(x)) > 1, "Unable to compute asin", F.asin(col(x)))


def sqrt(x) -> Column:
    return _guarded(col(x) < 0, "Unable to compute sqrt of a negative number", F.sqrt(col(x)))


def atan(x) -> Column:
    return F.atan(col(x))


def atan2(y, x) -> Column:
    return F.atan2(col(y), col(x))


def cbrt(x) -> Column:
    return F.cbrt(col(x))


def ceiling(x) -> Column:
    return F.ceil(col(x)).cast("bigint")


def floor(x) -> Column:
    return F.floor(col(x)).cast("bigint")


def cos(x) -> Column:
    return F.cos(col(x))


def cosh(x) -> Column:
    return F.cosh(col(x))


def cot(x) -> Column:
    return F.cot(col(x))


def sin(x) -> Column:
    return F.sin(col(x))


def sinh(x) -> Column:
    return F.sinh(col(x))


def tan(x) -> Column:
    return F.tan(col(x))


def tanh(x) -> Column:
    return F.tanh(col(x))


def exp(x) -> Column:
    return F.exp(col(x))


def log(x) -> Column:
    return F.log(col(x))


def log10(x) -> Column:
    return F.log10(col(x))


def pow_(x, y) -> Column:
    return F.pow(col(x), col(y))


def pi() -> Column:
    return F.pi()


def sign(x) -> Column:
    return F.sign(col(x)).cast("bigint")


def to_degrees(x) -> Column:
    return F.degrees(col(x))


def to_radians(x) -> Column:
    return F.radians(col(x))


def to_float(x) -> Column:
    return col(x).cast("double")


def to_decimal(x, integral: bool = False) -> Column:
    return col(x).cast("decimal(38,0)" if integral else "decimal(38,18)")


def bit_and(a, b) -> Column:
    return col(a).bitwiseAND(col(b))


def bit_or(a, b) -> Column:
    return col(a).bitwiseOR(col(b))


def bit_xor(a, b) -> Column:
    return col(a).bitwiseXOR(col(b))


def bit_not(a) -> Column:
    return F.bitwise_not(col(a))


def _shift(x, bits: int, shifted) -> Column:
    if bits > 62:
        return F.raise_error(F.lit("Unsupported number of bits to shift - max bits allowed is 62")).cast("bigint")
    return shifted(col(x).cast("bigint"), bits)


def bit_shift_left(x, bits: int) -> Column:
    return _shift(x, bits, F.shiftleft)


def bit_shift_right(x, bits: int) -> Column:
    return _shift(x, bits, F.shiftright)


def divide(a, b, scale: int | None = None) -> Column:
    """Always a double; x/0 is an infinity and 0/0 not a number. With a scale: rounded half up, as a decimal."""
    a, b = col(a).cast("double"), col(b).cast("double")
    if scale is not None:
        return F.round((a / b).cast("decimal(38,18)"), scale)
    at_zero = F.when(a > 0, float("inf")).when(a < 0, float("-inf")).when(a == 0, float("nan"))
    return F.when(b == 0, at_zero).otherwise(F.try_divide(a, b))


def divide_round(a, b, scale: int) -> Column:
    return F.bround(divide(a, b), scale)


def mod(a, b) -> Column:
    """With the sign of the divisor."""
    a, b = col(a), col(b)
    return ((a % b) + b) % b


def rem(a, b) -> Column:
    """With the sign of the dividend."""
    a, b = col(a), col(b)
    return F.when(b == 0, F.raise_error(F.lit("Cannot divide by zero")).cast("double")).otherwise(a % b)


def round_(x, scale: int | None = None) -> Column:
    """Half to even; without a scale an integer."""
    return F.bround(col(x), 0).cast("bigint") if scale is None else F.bround(col(x), scale)


def plus(*xs) -> Column:
    return reduce(lambda a, b: a + b, map(col, xs))


def minus(x, *xs) -> Column:
    return reduce(lambda a, b: a - b, map(col, xs), col(x)) if xs else -col(x)


sub = minus


def times(*xs) -> Column:
    return reduce(lambda a, b: a * b, map(col, xs))


def max_(*xs) -> Column:
    return F.greatest(*map(col, xs))


def min_(*xs) -> Column:
    return F.least(*map(col, xs))


def wide_plus(a, b) -> Column:
    """Integer sum at the edge of 64 bits."""
    return col(a).cast("decimal(38,0)") + col(b).cast("decimal(38,0)")
