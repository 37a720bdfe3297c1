"""Windows: over(partition, sort, frame) and the functions on it.

Ranking functions and lag/lead take the window without its frame, which Spark rejects there.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

UNBOUNDED = None


def unbounded() -> None:
    return UNBOUNDED


@dataclass(frozen=True)
class Frame:
    """kind "rows", "range" or "interval"; None is unbounded; negative is preceding."""

    kind: str
    lower: float | None
    upper: float | None
    unit: str = ""

    def __post_init__(self):
        if self.lower is not None and self.upper is not None and self.lower > self.upper:
            raise ValueError("Invalid window frame boundary - lower bound of window frame cannot be greater than the upper bound!")


def rows(lower: int | None, upper: int | None) -> Frame:
    return Frame("rows", lower, upper)


def range_(lower: float | None, upper: float | None, unit: str = "") -> Frame:
    """Numbers on the sort key, or so many units of time (DAYS, MONTHS, ...) before and after it."""
    return Frame("interval" if unit else "range", lower, upper, unit)


@dataclass(frozen=True)
class Over:
    partition: tuple[str, ...]
    sort: tuple[tuple[str, bool], ...]  # (column, ascending): null is the largest value
    frame: Frame | None = None

    def plain(self) -> WindowSpec:
        spec = Window.partitionBy(*self.partition)
        if self.sort:
            spec = spec.orderBy(*(F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_first() for c, up in self.sort))
        return spec

    def framed(self) -> WindowSpec:
        spec, frame = self.plain(), self.frame
        if frame is None:
            return spec
        low = Window.unboundedPreceding if frame.lower is None else frame.lower
        high = Window.unboundedFollowing if frame.upper is None else frame.upper
        if frame.kind == "rows":
            return spec.rowsBetween(int(low), int(high))
        if any(x not in (None, int(x or 0)) for x in (frame.lower, frame.upper)):
            raise ValueError("a fractional range needs apply(): its bounds are written in SQL")
        return spec.rangeBetween(int(low), int(high))

    def sql(self) -> str:
        parts = []
        if self.partition:
            parts.append("PARTITION BY " + ", ".join(f"`{c}`" for c in self.partition))
        if self.sort:
            fractional = self.frame is not None and self.frame.kind == "range"
            key = lambda c: f"CAST(`{c}` AS DOUBLE)" if fractional else f"`{c}`"
            parts.append("ORDER BY " + ", ".join(key(c) + (" ASC NULLS LAST" if up else " DESC NULLS FIRST") for c, up in self.sort))
        if self.frame is not None:
            parts.append(f"{'ROWS' if self.frame.kind == 'rows' else 'RANGE'} BETWEEN {self._bound(self.frame.lower, True)} AND {self._bound(self.frame.upper, False)}")
        return " ".join(parts)

    def _bound(self, x: float | None, lower: bool) -> str:
        if x is None:
            return "UNBOUNDED PRECEDING" if lower else "UNBOUNDED FOLLOWING"
        if x == 0:
            return "CURRENT ROW"
        size = f"INTERVAL '{abs(x)}' {self.frame.unit.removesuffix('S')}" if self.frame.kind == "interval" else f"{abs(x)}" + ("D" if self.frame.kind == "range" else "")
        return f"{size} {'PRECEDING' if x < 0 else 'FOLLOWING'}"

    def apply(self, aggregate: str) -> Column:
        """An aggregate in SQL text over this window: any frame, time intervals and fractions among them."""
        return F.expr(f"{aggregate} OVER ({self.sql()})")


def over(partition: Sequence[str] | str = (), sort: Sequence[tuple[str, bool] | str] | str = (), frame: Frame | None = None) -> Over:
    partition = (partition,) if isinstance(partition, str) else tuple(partition)
    sort = (sort,) if isinstance(sort, str) else tuple(sort)
    return Over(partition, tuple((s, True) if isinstance(s, str) else s for s in sort), frame)


def row_number(w: Over) -> Column:
    return F.row_number().over(w.plain()).cast("bigint")


def rank(w: Over) -> Column:
    return F.rank().over(w.plain()).cast("bigint")


def dense_rank(w: Over) -> Column:
    return F.dense_rank().over(w.plain()).cast("bigint")


def percent_rank(w: Over) -> Column:
    return F.percent_rank().over(w.plain())


def cumulative_distribution(w: Over) -> Column:
    return F.cume_dist().over(w.plain())


def ntile(w: Over, n: int) -> Column:
    return F.ntile(n).over(w.plain()).cast("bigint")


def lag(w: Over, c: str, n: int = 1) -> Column:
    return F.lag(c, n).over(w.plain())


def lead(w: Over, c: str, n: int = 1) -> Column:
    return F.lead(c, n).over(w.plain())


def offset(w: Over, c: str, n: int) -> Column:
    return lead(w, c, n) if n >= 0 else lag(w, c, -n)


def first(w: Over, c: str) -> Column:
    return F.first(c).over(w.framed())


def last(w: Over, c: str) -> Column:
    return F.last(c).over(w.framed())


def nth(w: Over, c: str, n: int) -> Column:
    return F.nth_value(c, n).over(w.framed())


def reduce(w: Over, aggregate: Column) -> Column:
    """Any reducer of aggs over the window."""
    return aggregate.over(w.framed())


def average_rank(w: Over) -> Column:
    """Rank with ties sharing the mean of their places."""
    same = Window.partitionBy(*w.partition, *(c for c, _ in w.sort))
    return F.rank().over(w.plain()) + (F.count(F.lit(1)).over(same) - 1) / 2


def z_score(w: Over, c: str) -> Column:
    spec = w.framed()
    return (F.col(c) - F.avg(c).over(spec)) / F.greatest(F.stddev_pop(c).over(spec), F.lit(1e-10))
