"""Rel: a fluent relation over a DataFrame, with the language's naming, ordering and null rules.

Every method builds a DataFrame plan; nothing runs until the frame is used. Conditions and expressions are functions
of a row (`lambda r: r.price > 3`), where `r.name` is the column.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.classic.column import Column as ClassicColumn

from plumbline.operators import ranks
from plumbline.operators.windows import Over

#: Between the values of several pivot columns, and before the aggregate's name: fixed value.
SEPARATOR = "__|__"


class Row:
    """Columns by attribute or by index; alias tells the sides of a join apart."""

    def __init__(self, df: DataFrame, alias: str | None = None):
        object.__setattr__(self, "_df", df)
        object.__setattr__(self, "_alias", alias)

    def __getattr__(self, name: str) -> Column:
        if name not in self._df.columns:
            raise AttributeError(f"no column {name!r} among {self._df.columns}")
        return F.col(f"{self._alias}.`{name}`" if self._alias else f"`{name}`")

    __getitem__ = __getattr__


def ascending(name: str) -> tuple[str, bool]:
    return name, True


def descending(name: str) -> tuple[str, bool]:
    return name, False


def order(keys: Sequence[str | tuple[str, bool]]) -> list[Column]:
    """Null is the largest value: last when ascending, first when descending."""
    pairs = [(k, True) if isinstance(k, str) else k for k in keys]
    return [F.col(f"`{c}`").asc_nulls_last() if up else F.col(f"`{c}`").desc_nulls_first() for c, up in pairs]


#: Comparisons by the expression's name, and whether the second operand is the larger one; the sides that a join may cut
#: (0 left, 1 right), as it gives no row of theirs without a match: fixed values.
_LARGER = {"LessThan": True, "LessThanOrEqual": True, "GreaterThan": False, "GreaterThanOrEqual": False}
_CUT = {"inner": (0, 1), "left": (1,), "right": (0,), "full": (), "left_semi": (0, 1), "left_anti": (1,)}


def _join(left: DataFrame, right: DataFrame, condition: Column, how: str) -> DataFrame:
    """The join of the frames "l" and "r"; for a condition without an equality, of the rows whose ranges of values meet.

    For want of a key Spark compares all pairs. Of `l.a < r.b` only rows with a below the largest b, and with b above the
    smallest a, can have a match: the others are left out before, by one row of bounds a side.
    """
    joined = left.join(right, condition, how)
    plan, jvm = joined._jdf.queryExecution().analyzed(), joined.sparkSession._jvm
    if plan.condition().isEmpty():
        return joined
    if not plan.right().outputSet().subsetOf(right._jdf.queryExecution().analyzed().outputSet()):  # one frame on both sides
        if len(set(right.columns)) < len(right.columns):
            return joined
        return _join(left, right.select(*(F.col(f"`{c}`").alias(c) for c in right.columns)).alias("r"), condition, how)
    outputs = plan.left().outputSet(), plan.right().outputSet()

    def side(e) -> int | None:
        return next((i for i in (0, 1) if not e.references().isEmpty() and e.references().subsetOf(outputs[i])), None)

    def column(e) -> Column:
        return ClassicColumn(jvm.org.apache.spark.sql.classic.ExpressionUtils.column(e))

    matching, compared, todo = [left, right], [], [plan.condition().get()]
    while todo:
        e = todo.pop()
        name, at = e.nodeName(), side(e)
        if name == "And":
            todo += [e.left(), e.right()]
        elif at is not None:
            matching[at] = matching[at].where(column(e))
        elif name in ("EqualTo", "EqualNullSafe", *_LARGER) and None not in (side(e.left()), side(e.right())):
            if name not in _LARGER:
                return joined
            small, large = (e.left(), e.right()) if _LARGER[name] else (e.right(), e.left())
            compared.append((side(small), small, large, name.endswith("Equal")))
    if not compared or not ranks.repeatable(plan):
        return joined
    sides = [left, right]
    for i in _CUT[how]:
        sides[i] = matching[i]
        for at, small, large, equal in compared:
            own, other = (small, large) if at == i else (large, small)
            bound = matching[1 - i].select((F.max if at == i else F.min)(column(other))).scalar()
            a, b = (column(own), bound) if at == i else (bound, column(own))
            sides[i] = sides[i].where(a <= b if equal else a < b)
    return sides[0].join(sides[1], condition, how)


class Rel:
    def __init__(self, df: DataFrame):
        self.df = df

    @property
    def row(self) -> Row:
        return Row(self.df)

    def columns(self) -> list[tuple[str, str]]:
        return self.df.dtypes

    # rows and columns

    def filter(self, condition: Callable[[Row], Column]) -> Rel:
        return Rel(self.df.filter(condition(self.row)))

    def select(self, *names: str) -> Rel:
        return Rel(self.df.select(*(f"`{n}`" for n in names)))

    def project(self, **columns: Callable[[Row], Column]) -> Rel:
        return Rel(self.df.select(*(f(self.row).alias(n) for n, f in columns.items())))

    def extend(self, **columns: Callable[[Row], Column]) -> Rel:
        for n in columns:
            if n in self.df.columns:
                raise ValueError(f"the relation already has a column {n!r}")
        return Rel(self.df.withColumns({n: f(self.row) for n, f in columns.items()}))

    def extend_over(self, window: Over, **columns: Callable[[Over], Column]) -> Rel:
        """Window columns; several on one window share its sort."""
        return Rel(self.df.withColumns({n: f(window) for n, f in columns.items()}))

    def extend_total(self, **aggregates: Column) -> Rel:
        """Aggregates of the whole relation beside each row: one small row, joined by broadcast instead of one task."""
        return Rel(self.df.crossJoin(F.broadcast(ranks.aggregate(self.df, [], aggregates))))

    def rename(self, **names: str) -> Rel:
        """rename(old="new"): renamed columns move to the end."""
        kept = [F.col(f"`{c}`") for c in self.df.columns if c not in names]
        return Rel(self.df.select(*kept, *(F.col(f"`{old}`").alias(new) for old, new in names.items())))

    def cast(self, **kinds: str) -> Rel:
        return Rel(self.df.select(*(F.col(f"`{n}`").cast(k).alias(n) for n, k in kinds.items())))

    def distinct(self, *names: str) -> Rel:
        return Rel((self.select(*names).df if names else self.df).distinct())

    def limit(self, n: int) -> Rel:
        return Rel(self.df.limit(n))

    take = limit

    def drop(self, n: int) -> Rel:
        return Rel(self.df.offset(n))

    def slice(self, start: int, stop: int) -> Rel:
        return Rel((self.df.offset(start) if start else self.df).limit(max(0, stop - start)))

    def first(self) -> Rel:
        return self.limit(1)

    head = first

    def sort(self, *keys: str | tuple[str, bool]) -> Rel:
        return Rel(self.df.orderBy(*order(keys)))

    def sort_by(self, key: Callable[[Row], Column], descending: bool = False) -> Rel:
        k = key(self.row)
        return Rel(self.df.orderBy(k.desc_nulls_first() if descending else k.asc_nulls_last()))

    def sort_by_reversed(self, key: Callable[[Row], Column]) -> Rel:
        return self.sort_by(key, descending=True)

    def map(self, f: Callable[[Row], Column], name: str = "value") -> Rel:
        """One column of values; null ones drop."""
        return Rel(self.df.select(f(self.row).alias(name)).where(F.col(name).isNotNull()))

    def size(self, name: str = "size") -> Rel:
        return Rel(self.df.agg(F.count(F.lit(1)).alias(name)))

    def exists(self, condition: Callable[[Row], Column]) -> Rel:
        return Rel(self.df.agg(F.coalesce(F.bool_or(condition(self.row)), F.lit(False)).alias("exists")))

    # lists and variants

    def flatten(self, name: str, variant_of: str | None = None) -> Rel:
        """A row for each element, the other columns repeated; an empty or null list drops the row."""
        items = F.col(f"`{name}`")
        if variant_of:
            items = F.try_variant_get(items, "$", f"array<{variant_of}>")
        return Rel(self.df.select(*(F.explode(items).alias(c) if c == name else F.col(f"`{c}`") for c in self.df.columns)))

    def lateral(self, inner: Callable[[Callable[[str], Column]], DataFrame], how: str = "inner") -> Rel:
        """inner makes a frame from this row; its columns are reached as outer("name")."""
        return Rel(self.df.lateralJoin(inner(lambda n: F.col(n).outer()), how=how))

    def top_per(self, keys: Sequence[str], n: int, *by: str | tuple[str, bool]) -> Rel:
        """The n first rows of each key: a window limit, which Spark applies before and after the shuffle."""
        w = Window.partitionBy(*keys).orderBy(*order(by))
        return Rel(self.df.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= n).drop("__n"))

    # groups

    def group_by(self, keys: Sequence[str], **aggregates: Column) -> Rel:
        return Rel(ranks.aggregate(self.df, [F.col(f"`{k}`") for k in keys], aggregates))

    def group_by_functions(self, keys: dict[str, Callable[[Row], Column]], **aggregates: Column) -> Rel:
        return Rel(ranks.aggregate(self.df, [f(self.row).alias(n) for n, f in keys.items()], aggregates))

    def aggregate(self, **aggregates: Column) -> Rel:
        return Rel(ranks.aggregate(self.df, [], aggregates))

    def pivot(self, on: Sequence[str], values: Sequence | None = None, using: Sequence[str] = (), **aggregates: Column) -> Rel:
        """Columns `value__|__name`; the other columns, but those that aggregates use, are the groups.

        Given values keep only their rows; otherwise the values that there are, null ones left out, in ascending order.
        """
        parts = [F.col(f"`{c}`").cast("string") for c in on]
        key = F.concat_ws(SEPARATOR, *parts)
        for p in parts:
            key = F.when(p.isNotNull(), key)
        static = [c for c in self.df.columns if c not in on and c not in using]
        df = self.df.withColumn("__key", key).where(F.col("__key").isNotNull())
        if values is None:
            values = [r[0] for r in df.select("__key").distinct().orderBy("__key").collect()]  # a column each
        else:
            values = [SEPARATOR.join(map(str, v)) if isinstance(v, tuple) else str(v) for v in values]
            df = df.where(F.col("__key").isin(list(values)))
        wide = df.groupBy(*(f"`{c}`" for c in static)).pivot("__key", list(values)).agg(*(a.alias(n) for n, a in aggregates.items()))
        made = wide.columns[len(static) :]
        names = [f"{v}{SEPARATOR}{n}" for v in values for n in aggregates]
        return Rel(wide.select(*(F.col(f"`{c}`") for c in static), *(F.col(f"`{old}`").alias(new) for old, new in zip(made, names))))

    # two relations

    def concatenate(self, other: Rel) -> Rel:
        return Rel(self.df.union(other.df))

    def _sides(self, other: Rel, prefix: str | None) -> tuple[DataFrame, DataFrame]:
        right = other.df
        if prefix is not None:
            right = right.select(*(F.col(f"`{c}`").alias(prefix + c) for c in right.columns))
        clash = set(self.df.columns) & set(right.columns)
        if clash:
            raise ValueError(f"both sides have columns {sorted(clash)}: use a prefix")
        return self.df.alias("l"), right.alias("r")

    def join(self, other: Rel, kind: str, condition: Callable[[Row, Row], Column], prefix: str | None = None) -> Rel:
        """kind: INNER, LEFT, RIGHT, FULL. The condition sees the right side under its prefixed names."""
        left, right = self._sides(other, prefix)
        how = {"INNER": "inner", "LEFT": "left", "RIGHT": "right", "FULL": "full"}[kind]
        return Rel(_join(left, right, condition(Row(self.df, "l"), Row(right, "r")), how))

    def join_using(self, other: Rel, kind: str, *keys: str) -> Rel:
        return Rel(self.df.join(other.df, list(keys), kind.lower()))

    def cross(self, other: Rel, prefix: str | None = None) -> Rel:
        """Every pair; Spark broadcasts a side that it has sized as small and deals out both otherwise."""
        left, right = self._sides(other, prefix)
        return Rel(left.crossJoin(right))

    def semi(self, other: Rel, condition: Callable[[Row, Row], Column]) -> Rel:
        """Rows for which the other side has a match (exists, isNotEmpty)."""
        return Rel(_join(self.df.alias("l"), other.df.alias("r"), condition(Row(self.df, "l"), Row(other.df, "r")), "left_semi"))

    def anti(self, other: Rel, condition: Callable[[Row, Row], Column]) -> Rel:
        """Rows for which the other side has no match (isEmpty)."""
        return Rel(_join(self.df.alias("l"), other.df.alias("r"), condition(Row(self.df, "l"), Row(other.df, "r")), "left_anti"))

    def tds_contains(self, other: Rel, *names: str) -> Rel:
        return Rel(self.df.join(other.df.select(*names).distinct(), list(names), "left_semi"))

    def as_of_join(self, other: Rel, left_time: str, op: str, right_time: str, keys: Sequence[tuple[str, str]] = (), prefix: str | None = None, slots: int | None = None) -> Rel:
        """Each row with the closest right row for which `left_time op right_time` holds; rows without one are kept.

        Both sides are put in one sequence a key, and the last right row before each left row is carried along: one
        shuffle on the keys and no pairs. `slots` splits the time line as well, so that one key, or no key at all, is
        not one task: a slot's carried row then comes from a small table with the last row of each earlier slot.
        """
        left, right = self.df, other.df
        if prefix is not None:
            right = right.select(*(F.col(f"`{c}`").alias(prefix + c) for c in right.columns))
            right_time, keys = prefix + right_time, [(a, prefix + b) for a, b in keys]
        clash = set(left.columns) & set(right.columns)
        if clash:
            raise ValueError(f"both sides have columns {sorted(clash)}: use a prefix")
        backward, strict = op in (">", ">="), op in (">", "<")
        # with equal times a right row stands before the left row unless the comparison is strict
        right_tag = 2 if strict else 0
        names = [f"__k{i}" for i in range(len(keys))]
        pack = lambda df: F.struct(*(F.col(f"`{c}`") for c in df.columns))
        l_rows = left.select(*(F.col(f"`{a}`").alias(n) for (a, _), n in zip(keys, names)), F.col(f"`{left_time}`").alias("__t"), F.lit(1).alias("__tag"), pack(left).alias("__l"))
        r_rows = right.select(*(F.col(f"`{b}`").alias(n) for (_, b), n in zip(keys, names)), F.col(f"`{right_time}`").alias("__t"), F.lit(right_tag).alias("__tag"), pack(right).alias("__r"))
        r_rows = r_rows.where(F.col("__t").isNotNull())
        rows = l_rows.unionByName(r_rows, allowMissingColumns=True)
        time = F.col("__t").asc_nulls_first() if backward else F.col("__t").desc_nulls_first()
        sortable = not re.search(r"\b(?:map<|variant)", dict(rows.dtypes)["__r"])
        tie = F.col("__r") if sortable else F.to_json("__r")  # among right rows of one time, a fixed one
        parts: list = [*names]
        if slots is not None:
            number = F.col("__t").cast("timestamp").cast("double") if "timestamp" in dict(rows.dtypes)["__t"] else F.col("__t").cast("double")
            cuts = rows.select(number.alias("t")).approxQuantile("t", [i / slots for i in range(1, slots)], 0.01)
            slot = F.lit(0)
            for c in sorted(set(cuts)):
                slot = slot + F.when(number >= c, 1).otherwise(0)
            rows = rows.withColumn("__slot", F.coalesce(slot if backward else -slot, F.lit(0)))
            parts.append("__slot")
        w = Window.partitionBy(*(parts or [F.lit(0)])).orderBy(time, F.col("__tag"), tie)
        found = rows.withColumn("__m", F.last("__r", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
        if slots is not None:
            # the last right row of each slot, carried over the slots after it
            closest = F.max_by("__r", F.when(F.col("__r").isNotNull(), F.struct((number if backward else -number).alias("n"), tie)))
            ends = rows.groupBy(*names, "__slot").agg(closest.alias("__end"))
            before = Window.partitionBy(*(names or [F.lit(0)])).orderBy("__slot").rowsBetween(Window.unboundedPreceding, -1)
            carried = ends.select(*(F.col(n).alias(f"{n}c") for n in names), F.col("__slot").alias("__slotc"), F.last("__end", ignorenulls=True).over(before).alias("__c"))
            same = F.lit(True)
            for n in [*names, "__slot"]:
                same = same & F.col(n).eqNullSafe(F.col(f"{n}c"))
            found = found.join(carried, same, "left").withColumn("__m", F.coalesce("__m", "__c"))
        matched = F.col("__t").isNotNull()
        for n in names:
            matched = matched & F.col(n).isNotNull()
        return Rel(
            found.where("__tag = 1").select(
                *(F.col(f"__l.`{c}`").alias(c) for c in left.columns),
                *(F.when(matched, F.col(f"__m.`{c}`")).alias(c) for c in right.columns),
            )
        )

    # results

    def write(self, path: str | None = None, format: str = "parquet", mode: str = "overwrite") -> int | DataFrame:
        """The row count; with a path the rows are written there first."""
        if path is not None:
            self.df.write.mode(mode).format(format).save(path)
            return self.df.sparkSession.read.format(format).load(path).count()
        return self.df.count()

    def _shown(self, limit: int | None):
        return (self.df if limit is None else self.df.limit(limit)).toLocalIterator()

    def to_csv(self, limit: int | None = None) -> str:
        """All rows as one text on the driver, or as many as the caller asks for; `write` is for large relations."""
        rows = self._shown(limit)
        show = lambda v: "" if v is None else str(v)
        return "\n".join([",".join(self.df.columns), *(",".join(map(show, r)) for r in rows)]) + "\n"

    def to_text(self, limit: int | None = None) -> str:
        rows = self._shown(limit)
        show = lambda v: "null" if v is None else str(v)
        return "\n".join(["#TDS", "   " + ",".join(self.df.columns), *("   " + ",".join(map(show, r)) for r in rows), "#"])

    def json_rows(self) -> DataFrame:
        """One JSON object a row."""
        return self.df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def concatenate_all(*relations: Rel) -> Rel:
    out = relations[0]
    for r in relations[1:]:
        out = out.concatenate(r)
    return out
