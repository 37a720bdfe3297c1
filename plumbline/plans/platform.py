"""Execution, plans, metadata lookups and assertions of the query language under their Python names."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.testing import assertDataFrameEqual

from plumbline.operators.relation import Rel
from plumbline.plans.language import Engine
from plumbline.plans.model import Mapping, Model


def execute(model: Model, text: str, **parameters: Any) -> DataFrame:
    return Engine(model).run(text, **parameters)


def execution_plan(rel: Rel | DataFrame, formatted: bool = True) -> str:
    """The plan as text."""
    df = rel.df if isinstance(rel, Rel) else rel
    run = df._jdf.queryExecution()
    return run.toString() if formatted else run.simpleString()


plan_to_string = execution_plan


def _scans(df: DataFrame) -> list:
    """The leaves of the plan that Spark has chosen, before any is run."""
    leaves = df._jdf.queryExecution().sparkPlan().collectLeaves()
    return [leaves.apply(i) for i in range(leaves.size())]


def scan_columns(rel: Rel | DataFrame) -> dict[str, list[str]]:
    """The columns that a query reads of each source, join keys and conditions included; what is pruned is not listed.

    A source is the file or folder that is scanned, or the leaf's kind where there is none (`LocalTableScan`, `Range`).
    """
    out: dict[str, set[str]] = {}
    for leaf in _scans(rel.df if isinstance(rel, Rel) else rel):
        columns = leaf.output()
        paths = leaf.relation().location().rootPaths() if leaf.getClass().getSimpleName() == "FileSourceScanExec" else None
        sources = [paths.apply(i).toString() for i in range(paths.size())] if paths else [leaf.nodeName()]
        for source in sources:
            out.setdefault(source, set()).update(columns.apply(i).name() for i in range(columns.size()))
    return {source: sorted(names) for source, names in sorted(out.items())}


def scan_relations(rel: Rel | DataFrame) -> list[str]:
    """The sources that a query reads."""
    return list(scan_columns(rel))


def concatenate_temporal_queries(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, frames)


def object_reference_in(keys: Sequence[Column], references: Sequence[Sequence]) -> Column:
    """Rows whose primary key is one of the references."""
    if not references:
        return F.lit(False)
    return F.struct(*keys).isin([F.struct(*map(F.lit, r)) for r in references])


# lookups in a model


def root_class_mapping_by_class(model: Model, cls: str) -> Mapping:
    return model.mappings[cls][0]


def class_mappings(model: Model, cls: str) -> list[Mapping]:
    return list(model.mappings.get(cls, []))


def property_mappings_by_property_name(mapping: Mapping, name: str) -> str | Callable:
    return mapping.properties[name]


def main_table(mapping: Mapping) -> str:
    if not isinstance(mapping.source, str):
        raise ValueError("the mapping doesn't read a table")
    return mapping.source


def all_super_classes(model: Model, cls: str) -> list[str]:
    out, todo = [], [cls]
    while todo:
        at = todo.pop(0)
        out.append(at)
        todo += model.classes[at].supers if at in model.classes else ()
    return out


def instance_of(model: Model, cls: str, other: str) -> bool:
    return other in all_super_classes(model, cls)


def data_type_to_sql_text(kind: str) -> str:
    return kind.upper()


# assertions


def fail(message: str = "Assert failed") -> None:
    raise AssertionError(message)


def assert_(condition: bool, message: str = "Assert failed") -> bool:
    if not condition:
        fail(message)
    return True


def assert_eq_within_tolerance(expected: float, actual: float, delta: float) -> bool:
    return assert_(abs(expected - actual) <= abs(delta), f"expected {expected} within {delta}, got {actual}")


def assert_error(run: Callable[[], Any], message: str = "") -> bool:
    try:
        run()
    except Exception as error:  # whatever the query raises is what is asserted about
        return assert_(message in str(error), f"expected {message!r} in {error}")
    return fail("no error was raised")


def assert_tds_equivalent(expected: Rel, actual: Rel, tolerance: float = 1e-9) -> bool:
    assertDataFrameEqual(actual.df, expected.df, rtol=tolerance)
    return True
