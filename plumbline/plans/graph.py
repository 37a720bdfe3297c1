"""Graph fetch: a tree of properties as nested structs, and as JSON.

Children are grouped by their keys and joined to their parents, from the leaves up: no correlated subquery, and one
shuffle a level. The value of an empty to-many property is an empty list. An embedded child is made of the row's own
columns; a list of plain values is an association to a class of which one property is wanted; the properties in a branch
`@Sub` are null for rows of other classes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.relation import Row
from plumbline.plans.model import Extent

#: A tree: property -> None for a value, or the tree of its target.
Tree = dict[str, "Tree | None"]


def _columns(extent: Extent, tree: Tree) -> tuple[DataFrame, list[Column]]:
    df, out = extent.df, []
    for name, sub in tree.items():
        if name.startswith("@"):
            names = list(sub or {})
            df, columns = _columns(extent._with(df, cls=name[1:]), sub or {})
            out += [F.when(F.col("`$class`") == name[1:], c).alias(n) for n, c in zip(names, columns)]
            continue
        if sub is None and name in df.columns:
            out.append(F.col(f"`{name}`").alias(name))
            continue
        own = [c for c in df.columns if c.startswith(f"{name}.")]
        if sub is not None and own and name not in extent.joined:
            out.append(_embedded(own, f"{name}.", sub).alias(name))
            continue
        step = extent.model.step(extent.cls, name)
        if sub is None and not step.value:
            raise KeyError(f"{name} is no plain property of {extent.cls}")
        child, columns = _columns(extent._target(step), sub or {step.value: None})
        keys = [f"__{name}_{i}" for i in range(len(step.keys))]
        node = F.struct(*columns) if sub is not None else columns[0]
        value = F.sort_array(F.collect_list(node)) if step.many else F.any_value(node)
        grouped = child.groupBy(*(F.col(f"`{b}`").alias(k) for k, (_, b) in zip(keys, step.keys))).agg(value.alias(f"__{name}"))
        on = reduce(lambda a, b: a & b, (F.col(f"`{a}`") == F.col(k) for k, (a, _) in zip(keys, step.keys)))
        df = df.join(grouped, on, "left").drop(*keys)
        got = F.col(f"__{name}")
        out.append((F.coalesce(got, F.array()) if step.many else got).alias(name))
    return df, out


def _embedded(columns: list[str], prefix: str, tree: Tree) -> Column:
    """A struct of the row's own columns; null where all of them are."""
    fields = [(_embedded(columns, f"{prefix}{n}.", sub) if sub else F.col(f"`{prefix}{n}`")).alias(n) for n, sub in tree.items()]
    some = reduce(lambda a, b: a | b, (F.col(f"`{c}`").isNotNull() for c in columns if c.startswith(prefix)))
    return F.when(some, F.struct(*fields))


def graph_fetch(extent: Extent, tree: Tree) -> DataFrame:
    """A column for each entry of the tree."""
    df, columns = _columns(extent, tree)
    return df.select(*columns)


def graph_fetch_checked(extent: Extent, tree: Tree) -> DataFrame:
    """Columns `defects` (names of broken constraints) and `value`."""
    constraints = extent.model.classes[extent.cls].constraints
    broken = [F.when(~F.coalesce(f(Row(extent.df)), F.lit(False)), F.lit(n)) for n, f in constraints.items()]
    defects = F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")
    df, columns = _columns(extent._with(extent.df.withColumn("__defects", defects)), tree)
    return df.select(F.col("__defects").alias("defects"), F.struct(*columns).alias("value"))


def serialize(df: DataFrame, remove_nulls: bool = False, include_type: str | None = None, as_array: bool = False) -> DataFrame:
    """Column `json`: an object a row, or one array of all rows (which one task builds: for small results)."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    if include_type:
        columns = [F.lit(include_type).alias("@type"), *columns]
    options = {"ignoreNullFields": "true" if remove_nulls else "false"}
    rows = df.select(F.to_json(F.struct(*columns), options).alias("json"))
    if as_array:
        return rows.agg(F.concat(F.lit("["), F.coalesce(F.array_join(F.sort_array(F.collect_list("json")), ","), F.lit("")), F.lit("]")).alias("json"))
    return rows
