"""Exact percentiles of groups of any size: no task holds the values of a large group.

Spark's percentile keeps every value of a group, in a map that each scan task makes and one task reads. That stays as it is
for groups of up to `HOT` rows. In the others a value is found by its rank, 16 bits of it at a time: rows are counted by group
and by the first bits of the value, put in order as whole numbers; running totals of these counts, 65,536 at most a group, say
in which the rank lies; the next pass counts the rows that begin so by 16 bits more. After four passes the value is known.
What travels with the tasks is a row for each rank of a large group, of which there are fewer than rows / HOT.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.classic.column import Column as ClassicColumn

#: Rows with a value from which on a group's percentiles are found by rank.
HOT = 1 << 19
#: Bits that are left over after each pass: fixed values.
_SHIFTS = (48, 32, 16, 0)
_NUMERIC = re.compile(r"tinyint|smallint|int|bigint|float|double|decimal\(.*\)")
_KINDS = ("Percentile", "PercentileCont", "PercentileDisc", "Median")


def repeatable(plan) -> bool:
    """Whether a plan gives the same rows when it is run again: no random values, no limit that may take other rows."""
    nodes = [plan]
    for node in nodes:
        nodes += [node.children().apply(i) for i in range(node.children().size())]
    return plan.deterministic() and not any(re.search("Limit|Offset|Tail|Sample", node.nodeName()) for node in nodes)


class _Share(NamedTuple):
    """A percentile: the share, whether the largest value comes first, whether it is one of the values."""

    share: float
    reverse: bool
    discrete: bool

    def ranks(self, total: Column) -> list[Column]:
        """Numbers of the ordered values, from 0, that it is made of."""
        if self.discrete:
            found = [F.greatest(F.ceil(total * F.lit(self.share)), F.lit(1)) - 1]
        else:
            found = [f((total - 1) * F.lit(self.share)) for f in (F.floor, F.ceil)]
        return [(total - 1 - x if self.reverse else x).cast("long") for x in found]

    def value(self, total: Column, found: list[Column]) -> Column:
        if self.discrete:
            return found[0]
        low, high = found
        at = (total - 1) * F.lit(self.share)
        return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)


def _share(e, jvm) -> _Share | None:
    """Of an aggregate expression that is a percentile of numbers; None if it isn't, or counts only some rows."""
    if e.getClass().getSimpleName() != "AggregateExpression" or e.isDistinct() or e.filter().isDefined():
        return None
    f = e.aggregateFunction()
    kind, parts = f.getClass().getSimpleName(), f.children()
    if kind not in _KINDS or not _NUMERIC.fullmatch(parts.apply(0).dataType().simpleString()):
        return None
    if kind == "Median":
        return _Share(0.5, False, False)
    if not _NUMERIC.fullmatch(parts.apply(1).dataType().simpleString()) or kind == "PercentileDisc" and f.legacyCalculation():
        return None
    value = lambda x: float(str(x.eval(jvm.org.apache.spark.sql.catalyst.InternalRow.empty())))
    if kind == "Percentile" and not (parts.apply(2).foldable() and value(parts.apply(2)) == 1):
        return None
    return _Share(value(parts.apply(1)), f.reverse(), kind == "PercentileDisc")


def _same(left: Sequence[Column], right: Sequence[Column]) -> Column:
    out = F.lit(True)
    for a, b in zip(left, right):
        out = out & a.eqNullSafe(b)
    return out


def _large(df: DataFrame, keys: Sequence[Column], value: Column, shares: Sequence[_Share], prefix: str) -> DataFrame:
    """For each group of over HOT values: its keys, how many it has, and its percentiles, under names with the prefix."""
    names = [f"{prefix}k{i}" for i in range(len(keys))]
    columns = [F.col(n) for n in names]
    base = df.select(*(k.alias(n) for k, n in zip(keys, names)), value.cast("double").alias("x")).where("x is not null")
    total = F.col("total")
    wanted = [r for s in shares for r in s.ranks(total)]
    ranks = [f"r{i}" for i in range(len(wanted))]
    found = base.groupBy(*names).agg(F.count("x").alias("total")).where(total > HOT).select(*names, "total", *(r.alias(n) for r, n in zip(wanted, ranks)))
    # bits of the value with zero's sign dropped, turned round below zero: in the order of the values, NaN last
    whole = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), F.col("x") + F.lit(0.0)).cast("long")
    for i, shift in enumerate(_SHIFTS):
        target = found.select(*(F.col(n).alias(f"t_{n}") for n in found.columns))
        match = _same(columns, [F.col(f"t_{n}") for n in names])
        if i:  # the values from the least to the largest that begin alike
            match = match & (F.col("x") >= F.col("t_low")) & (F.col("x") <= F.col("t_high"))
        rows = base.join(F.broadcast(target), match).withColumn("bits", whole)
        order = F.col("bits").bitwiseXOR(F.shiftright("bits", 63).bitwiseAND(F.lit((1 << 63) - 1)))
        rows = rows.withColumn("bits", F.shiftright(order, shift) if shift else order)
        carried = [F.max(f"t_{n}").alias(n) for n in ("total", *ranks)]
        counts = rows.groupBy(*names, "bits").agg(F.count("x").alias("n"), F.min("x").alias("low"), F.max("x").alias("high"), *carried)
        w = Window.partitionBy(*names, F.shiftright("bits", 16) if i else F.lit(0)).orderBy("bits")
        before = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
        counts = counts.withColumn("before", before).select("*", *((F.col(n) - F.col("before")).alias(f"in_{n}") for n in ranks))
        here = [F.when((F.col(f"in_{n}") >= 0) & (F.col(f"in_{n}") < F.col("n")), F.col(f"in_{n}")).alias(n) for n in ranks]
        found = counts.select(*names, "low", "high", "total", *here).where(F.coalesce(*ranks).isNotNull())
    at = iter([F.max(F.when(F.col(n).isNotNull(), F.col("low"))) for n in ranks])
    values = [s.value(F.max("total"), [next(at) for _ in s.ranks(total)]) for s in shares]
    return found.groupBy(*names).agg(F.max("total").alias(f"{prefix}n"), *(v.alias(f"{prefix}{i}") for i, v in enumerate(values)))


def aggregate(df: DataFrame, keys: Sequence[Column], aggregates: dict[str, Column]) -> DataFrame:
    """df grouped by the keys and aggregated, with percentiles of large groups found by rank."""
    made = [a.alias(n) for n, a in aggregates.items()]
    plain = df.groupBy(*keys).agg(*made)
    jvm, plan = df.sparkSession._jvm, plain._jdf.queryExecution().analyzed()
    if plan.nodeName() != "Aggregate":
        return plain
    utils = jvm.org.apache.spark.sql.classic.ExpressionUtils
    column = lambda e: ClassicColumn(utils.column(e))
    parts = lambda e: [e.children().apply(i) for i in range(e.children().size())]
    every = plan.aggregateExpressions()
    outputs = [every.apply(i) for i in range(every.size() - len(made), every.size())]
    shares: dict[str, tuple[object, list[_Share]]] = {}  # by the text of the value
    todo = list(outputs)
    while todo:
        e = todo.pop()
        if (share := _share(e, jvm)) is None:
            todo += parts(e)
        else:
            value = parts(e.aggregateFunction())[0]
            listed = shares.setdefault(value.toString(), (value, []))[1]
            if share not in listed:
                listed.append(share)
    if not shares or not repeatable(plan.child()):
        return plain
    groups = plan.groupingExpressions()
    groups = [groups.apply(i) for i in range(groups.size())]
    own = [column(g.child() if g.nodeName() == "Alias" else g) for g in groups]
    wide, prefixes = df, {}
    for i, (text, (value, wanted)) in enumerate(shares.items()):
        prefixes[text] = prefix = f"__p{i}_"
        large = _large(df, own, column(value), wanted, prefix)
        wide = wide.join(F.broadcast(large), _same(own, [F.col(f"{prefix}k{j}") for j in range(len(own))]), "left")

    def change(e):
        if (share := _share(e, jvm)) is not None:
            f = e.aggregateFunction()
            value, *rest = parts(f)
            prefix, number = prefixes[value.toString()], shares[value.toString()][1].index(share)
            small = utils.expression(F.when(F.col(f"{prefix}n").isNull(), column(value))._jc)
            f = f.withNewChildren(jvm.PythonUtils.toSeq([small, *rest]))
            kept = column(e.withNewChildren(jvm.PythonUtils.toSeq([f])))
            return utils.expression(F.coalesce(F.max(f"{prefix}{number}"), kept)._jc)
        old = parts(e)
        new = [change(x) for x in old]
        return e.withNewChildren(jvm.PythonUtils.toSeq(new)) if any(a is not b for a, b in zip(old, new)) else e

    return wide.groupBy(*keys).agg(*(column(change(e.child())).alias(n) for e, n in zip(outputs, aggregates)))
