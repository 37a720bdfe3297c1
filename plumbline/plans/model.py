"""Classes, associations and mappings; class extents with navigation, all as DataFrame plans.

An extent is a frame with one column a mapped property (and `$name` columns that only the mapping uses). Navigations
are joins that are made when a path is asked for, once a path: a to-one or to-many step in a projection is a left
join, a step in a condition on many values is a semi join. Steps that nobody asks for are never joined.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators import ranks
from plumbline.operators.relation import Rel, Row, order
from plumbline.sources.readers import Database

LATEST = "%latest"
Date = dt.date | dt.datetime | str | Column


@dataclass(frozen=True)
class Temporal:
    """One dimension of a table's versions: rows hold from `start` (included) to `end`, or the other way round.

    snapshot: the table holds one state a date instead.
    """

    start: str = ""
    end: str = ""
    thru_inclusive: bool = False
    infinity: dt.datetime | None = None
    snapshot: str = ""

    def at(self, date: Date) -> Column:
        if self.snapshot:
            if isinstance(date, str) and date == LATEST:
                raise ValueError("%latest is not supported on a snapshot table")
            return F.col(f"`{self.snapshot}`") == _date(date).cast("date")
        if not (self.start and self.end):
            raise ValueError("a temporal table needs both its start and its end column")
        start, end = F.col(f"`{self.start}`"), F.col(f"`{self.end}`")
        if isinstance(date, str) and date == LATEST:
            if self.infinity is None:
                raise ValueError("%latest needs the infinity date of the table")
            return end == F.lit(self.infinity).cast("timestamp_ntz")
        d = _date(date)
        return (start < d) & (end >= d) if self.thru_inclusive else (start <= d) & (end > d)

    def within(self, first: Date, last: Date) -> Column:
        """Versions that hold at some time from first to last, both included."""
        if self.snapshot:
            return F.col(f"`{self.snapshot}`").between(_date(first).cast("date"), _date(last).cast("date"))
        start, end = F.col(f"`{self.start}`"), F.col(f"`{self.end}`")
        return (start < _date(last)) & (end >= _date(first)) if self.thru_inclusive else (start <= _date(last)) & (end > _date(first))


def _date(d: Date) -> Column:
    return d if isinstance(d, Column) else F.lit(d).cast("timestamp_ntz")


@dataclass
class ClassDef:
    name: str
    properties: dict[str, str]
    supers: tuple[str, ...] = ()
    constraints: dict[str, Callable[[Row], Column]] = field(default_factory=dict)
    temporal: str = ""  # "", "business", "processing" or "bitemporal"


@dataclass
class Mapping:
    """How a class is read. source: a table name, a function of the database, or ("class", name) for another class.

    properties: a column name or a function of the source row, for each property. keys: `$name` columns for joins.
    """

    source: str | tuple[str, str] | Callable[[Database], Rel]
    properties: dict[str, str | Callable[[Row], Column]]
    keys: dict[str, str | Callable[[Row], Column]] = field(default_factory=dict)
    filter: Callable[[Row], Column] | None = None
    distinct: bool = False
    group_by: Sequence[str] = ()
    enums: dict[str, dict[str, Sequence]] = field(default_factory=dict)  # property -> name -> source codes
    business: Temporal | None = None
    processing: Temporal | None = None
    sub_class: str = ""


@dataclass
class Association:
    source: str
    property: str
    target: str
    many: bool
    keys: Sequence[tuple[str, str]]  # (source column, target column)
    condition: Callable[[Row, Row], Column] | None = None
    value: str = ""  # the target's property, where the property holds plain values


class Model:
    def __init__(self, database: Database):
        self.database = database
        self.classes: dict[str, ClassDef] = {}
        self.mappings: dict[str, list[Mapping]] = {}
        self.associations: dict[tuple[str, str], Association] = {}

    def add_class(self, name: str, /, **properties: str) -> ClassDef:
        self.classes[name] = ClassDef(name, properties)
        return self.classes[name]

    def map(self, name: str, *mappings: Mapping) -> None:
        """Several mappings of one class are a union."""
        self.mappings.setdefault(name, []).extend(mappings)

    def associate(self, source: str, property: str, target: str, many: bool, keys: Sequence[tuple[str, str]], back: str = "", back_many: bool = True, condition: Callable[[Row, Row], Column] | None = None, value: str = "") -> None:
        self.associations[source, property] = Association(source, property, target, many, keys, condition, value)
        if back:
            reverse = (lambda a, b: condition(b, a)) if condition else None
            self.associations[target, back] = Association(target, back, source, back_many, [(b, a) for a, b in keys], reverse)

    def include(self, other: Model) -> None:
        """The other model's classes, mappings and associations, behind this one's own."""
        self.classes = other.classes | self.classes
        self.mappings = {**other.mappings, **self.mappings}
        self.associations = other.associations | self.associations

    def sub_classes(self, name: str) -> list[str]:
        return [c.name for c in self.classes.values() if name in c.supers]

    def step(self, cls: str, property: str) -> Association:
        todo = [cls]
        while todo:
            at = todo.pop(0)
            if (at, property) in self.associations:
                return self.associations[at, property]
            todo += self.classes[at].supers if at in self.classes else ()
        raise KeyError(f"{cls} has no association {property!r}")

    # extents

    def _frame(self, name: str, when: Callable[[Mapping], list[Column]], each: DataFrame | None = None) -> DataFrame:
        """each: a frame of a few dates, `$date`; every row then stands beside those for which its conditions hold."""
        frames, more = [], [] if each is None else ["$date"]
        for m in self.mappings.get(name, []):
            if isinstance(m.source, tuple):
                rel = Rel(self._frame(m.source[1], when, each))
            else:
                rel = self.database.table(m.source) if isinstance(m.source, str) else m.source(self.database)
            df = rel.df
            if each is not None and "$date" not in df.columns:
                df = df.crossJoin(F.broadcast(each))  # the caller's list of dates
            for condition in when(m):
                df = df.where(condition)
            if m.filter:
                df = df.where(m.filter(Row(df)))
            row = Row(df)
            columns = {n: (row[f] if isinstance(f, str) else f(row)) for n, f in {**m.properties, **{f"${k}": v for k, v in m.keys.items()}}.items()}
            for n, codes in m.enums.items():
                columns[n] = decode(columns[n], codes)
            if m.group_by:
                df = df.groupBy(*m.group_by, *more).agg(*(c.alias(n) for n, c in columns.items() if n not in m.group_by))
                columns = {n: F.col(f"`{n}`") for n in columns}
            df = df.select(*(c.alias(n) for n, c in columns.items()), *([F.lit(m.sub_class).alias("$class")] if m.sub_class else []), *more)
            frames.append(df.distinct() if m.distinct else df)
        if not self.mappings.get(name):
            for sub in self.sub_classes(name):
                df = self._frame(sub, when, each)
                frames.append(df if "$class" in df.columns else df.withColumn("$class", F.lit(sub)))
        if not frames:
            raise KeyError(f"{name} is not mapped")
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

    def all(self, name: str, *dates: Date) -> Extent:
        """The extent, at a date for temporal classes: (business) or (processing) or (processing, business)."""
        return Extent(self, name, self._frame(name, self._when(name, dates)), dates)

    def _when(self, name: str, dates: tuple[Date, ...]) -> Callable[[Mapping], list[Column]]:
        kind = self.classes[name].temporal if name in self.classes else ""
        if kind == "bitemporal" and len(dates) == 1:
            raise ValueError("a bitemporal class takes a processing and a business date")

        def when(m: Mapping) -> list[Column]:
            out = []
            business = dates[-1] if dates and kind in ("business", "bitemporal") else None
            processing = dates[0] if dates and kind in ("processing", "bitemporal") else None
            if m.business and business is not None:
                out.append(m.business.at(business))
            if m.processing and processing is not None:
                out.append(m.processing.at(processing))
            return out

        return when

    def all_versions(self, name: str) -> Extent:
        return Extent(self, name, self._frame(name, lambda m: []), ())

    def all_versions_in_range(self, name: str, first: Date, last: Date) -> Extent:
        return Extent(self, name, self._frame(name, lambda m: [t.within(first, last) for t in (m.business or m.processing,) if t]), ())

    def all_for_each_date(self, name: str, dates: Sequence[Date]) -> DataFrame:
        """The extents at each of a list of dates, with the date as column `$date`: one scan, whatever their number."""
        each = self.database.spark.range(1).select(F.explode(F.array_distinct(F.array(*map(_date, dates)))).alias("$date"))
        return self._frame(name, self._when(name, (F.col("`$date`"),)), each)

    def violations(self, name: str, *dates: Date) -> DataFrame:
        """Rows that break a constraint, with the names of those broken."""
        extent = self.all(name, *dates)
        broken = F.array_compact(F.array(*(F.when(~F.coalesce(f(Row(extent.df)), F.lit(False)), F.lit(n)) for n, f in self.classes[name].constraints.items())))
        return extent.df.withColumn("defects", broken).where(F.size("defects") > 0)


def decode(code: Column, codes: dict[str, Sequence]) -> Column:
    """Source codes to enumeration names; unknown codes are null."""
    out = None
    for name, sources in codes.items():
        hit = code.isin(list(sources))
        out = F.when(hit, F.lit(name)) if out is None else out.when(hit, F.lit(name))
    return out


def encoded(code: Column, codes: dict[str, Sequence], name: str) -> Column:
    """The test "decoded value is `name`" on the source codes, so that it reaches the files."""
    return code.isin(list(codes[name]))


def embed(prefix: str, inner: Mapping) -> dict[str, str | Callable[[Row], Column]]:
    """The properties of another class's mapping on the same table, to be inlined under a property."""
    return {f"{prefix}.{n}": f for n, f in inner.properties.items()}


def extend(base: Mapping, **changes) -> Mapping:
    """A mapping that takes over another one's properties, keys and enumerations, with its own in front."""
    for name in ("properties", "keys", "enums"):
        changes[name] = getattr(base, name) | changes.get(name, {})
    return replace(base, **changes)


class Extent:
    """A class extent with the paths that have been joined to it."""

    def __init__(self, model: Model, cls: str, df: DataFrame, dates: tuple[Date, ...] = (), joined: dict[str, str] | None = None):
        self.model, self.cls, self.df, self.dates = model, cls, df, dates
        self.joined: dict[str, str] = joined or {}

    def _with(self, df: DataFrame, **changes) -> Extent:
        out = Extent(self.model, self.cls, df, self.dates, dict(self.joined))
        for k, v in changes.items():
            setattr(out, k, v)
        return out

    def at(self, path: str) -> Column:
        """A property, or one behind joined steps: extent.at("firm.legalName")."""
        return F.col(f"`{path}`")

    def _target(self, step: Association) -> Extent:
        # the date context goes along, into the joined side: rows without a version stay, with nulls
        kind = self.model.classes[step.target].temporal if step.target in self.model.classes else ""
        dates = self.dates if kind and len(self.dates) == (2 if kind == "bitemporal" else 1) else ()
        return self.model.all(step.target, *dates)

    def navigate(self, *paths: str) -> Extent:
        """Left joins for the steps of the paths that are not there yet."""
        out = self
        for path in paths:
            at, cls = "", self.cls
            for name in path.split("."):
                where = f"{at}.{name}" if at else name
                step = self.model.step(cls, name)
                if where not in out.joined:
                    target = self._target(step).df
                    side = target.select(*(F.col(f"`{c}`").alias(f"{where}.{c}") for c in target.columns))
                    on = reduce(lambda a, b: a & b, (F.col(f"`{at}.{a}`" if at else f"`{a}`") == F.col(f"`{where}.{b}`") for a, b in step.keys))
                    if step.condition:
                        on = on & step.condition(_Side(at), _Side(where))
                    out = out._with(out.df.join(side, on, "left"), joined={**out.joined, where: step.target})
                at, cls = where, step.target
        return out

    def _demand(self, paths: Sequence[str]) -> Extent:
        steps = sorted({p.rpartition(".")[0] for p in paths if "." in p})
        return self.navigate(*steps)

    def project(self, **paths: str | Callable[[Extent], Column]) -> Rel:
        """Columns by property path; to-many steps give a row for each value, and one with null where there is none.

        A function gets the extent with the paths of the other columns joined.
        """
        out = self._demand([p for p in paths.values() if isinstance(p, str)])
        return Rel(out.df.select(*((out.at(p) if isinstance(p, str) else p(out)).alias(n) for n, p in paths.items())))

    def filter(self, condition: Callable[[Extent], Column], *paths: str) -> Extent:
        """A condition on own properties, or on to-one paths that are named: these are joined first."""
        out = self._demand(paths)
        return out._with(out.df.where(condition(out)))

    def exists(self, property: str, condition: Callable[[Extent], Column] | None = None, negate: bool = False) -> Extent:
        """Rows with (or without) a value of a to-many property for which the condition holds: no row is repeated."""
        step = self.model.step(self.cls, property)
        target = self._target(step)
        side = target.df.where(condition(target)) if condition else target.df
        side = side.select(*(F.col(f"`{b}`").alias(f"__{i}") for i, (_, b) in enumerate(step.keys))).distinct()
        on = reduce(lambda a, b: a & b, (F.col(f"`{a}`") == F.col(f"__{i}") for i, (a, _) in enumerate(step.keys)))
        return self._with(self.df.join(side, on, "left_anti" if negate else "left_semi"))

    def is_empty(self, property: str) -> Extent:
        return self.exists(property, negate=True)

    def with_aggregate(self, name: str, property: str, aggregate: Callable[[Extent], Column], condition: Callable[[Extent], Column] | None = None, default=None) -> Extent:
        """An aggregate over a to-many property: the children are grouped by their keys before the join."""
        step = self.model.step(self.cls, property)
        target = self._target(step)
        child = target.df.where(condition(target)) if condition else target.df
        grouped = child.groupBy(*(F.col(f"`{b}`").alias(f"__{i}") for i, (_, b) in enumerate(step.keys))).agg(aggregate(target).alias(name))
        on = reduce(lambda a, b: a & b, (F.col(f"`{a}`") == F.col(f"__{i}") for i, (a, _) in enumerate(step.keys)))
        df = self.df.join(grouped, on, "left").drop(*(f"__{i}" for i in range(len(step.keys))))
        return self._with(df if default is None else df.fillna({name: default}))

    def group_by(self, keys: dict[str, str], **aggregates: tuple[str, Callable[[Column], Column]]) -> Rel:
        """group_by({"nation": "nation.name"}, total=("orders.price", aggs.sum_))."""
        out = self._demand([*keys.values(), *(p for p, _ in aggregates.values())])
        return Rel(ranks.aggregate(out.df, [out.at(p).alias(n) for n, p in keys.items()], {n: f(out.at(p)) for n, (p, f) in aggregates.items()}))

    def sub_type(self, name: str) -> Extent:
        return self._with(self.df.where(F.col("`$class`") == name), cls=name)

    def sort(self, *keys: str | tuple[str, bool]) -> Extent:
        return self._with(self.df.orderBy(*order(keys)))

    def limit(self, n: int) -> Extent:
        return self._with(self.df.limit(n))

    def otherwise(self, embedded: str, path: str) -> Column:
        """The embedded column, or the joined one where it is null."""
        return F.coalesce(F.col(f"`{embedded}`"), F.col(f"`{path}`"))


class _Side:
    def __init__(self, prefix: str):
        self._prefix = prefix

    def __getattr__(self, name: str) -> Column:
        return F.col(f"`{self._prefix}.{name}`" if self._prefix else f"`{name}`")

    __getitem__ = __getattr__


def with_temporal(m: Mapping, business: Temporal | None = None, processing: Temporal | None = None) -> Mapping:
    return replace(m, business=business, processing=processing)
