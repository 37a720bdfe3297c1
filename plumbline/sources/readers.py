"""Sources: stored tables, inline relations, JSON objects, CSV seed blocks, SQL text, views."""

from __future__ import annotations

import base64
import re
import urllib.parse
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.relation import Rel

#: Type names of the language and their Spark types: fixed values.
TYPES = {
    "String": "string", "Integer": "bigint", "Float": "double", "Number": "double", "Decimal": "decimal(38,18)", "Boolean": "boolean",
    "StrictDate": "date", "Date": "timestamp_ntz", "DateTime": "timestamp_ntz", "Variant": "variant",
}


class Database:
    """Named tables and views; a table is read when it is used."""

    def __init__(self, spark: SparkSession, tables: dict[str, str | DataFrame] | None = None):
        self.spark = spark
        self._tables: dict[str, str | DataFrame] = dict(tables or {})
        self._views: dict[str, Callable[[Database], Rel]] = {}

    @classmethod
    def of_folder(cls, spark: SparkSession, folder: str, names: list[str]) -> Database:
        return cls(spark, {n: f"{folder}/{n}.parquet" for n in names})

    def add_view(self, name: str, build: Callable[[Database], Rel]) -> None:
        self._views[name] = build

    def table(self, name: str) -> Rel:
        """A scan; filters and column choices reach the files."""
        if name in self._views:
            return self._views[name](self)
        found = self._tables[name]
        return Rel(self.spark.read.parquet(found) if isinstance(found, str) else found)

    def replace(self, **tables: str | DataFrame) -> Database:
        """The same store with other tables in place of some."""
        out = Database(self.spark, self._tables | tables)
        out._views = dict(self._views)
        return out

    def schema(self, name: str) -> list[tuple[str, str]]:
        return self.table(name).columns()


def _cell(text: str, kind: str):
    text = text.strip()
    if text in ("", "null"):
        return None
    if kind == "string" and len(text) > 1 and text[0] == text[-1] and text[0] in "'\"":
        return text[1:-1]
    return text


def tds(spark: SparkSession, text: str) -> Rel:
    """Rows written inline: a header of `name` or `name:Type`, then a line a row. A header alone is an empty relation."""
    lines = [x.strip() for x in text.strip().removeprefix("#TDS").removesuffix("#").strip().splitlines() if x.strip()]
    heads = [h.strip().partition(":")[::2] for h in lines[0].split(",")]
    rows = [[_cell(c, "string") for c in re.split(r",(?=(?:[^']*'[^']*')*[^']*$)", line)] for line in lines[1:]]
    kinds = [TYPES[k.strip()] if k else _guess([r[i] for r in rows]) for i, (_, k) in enumerate(heads)]
    frame = spark.createDataFrame(rows, ", ".join(f"`{n.strip()}` string" for n, _ in heads))
    return Rel(frame.select(*(F.col(f"`{n.strip()}`").cast(k).alias(n.strip()) if k != "variant" else F.parse_json(f"`{n.strip()}`").alias(n.strip()) for (n, _), k in zip(heads, kinds))))


def _guess(cells: list[str | None]) -> str:
    """Integer, double, boolean, date or text: the first that all cells fit."""
    found = [c for c in cells if c is not None]
    patterns = (("bigint", r"[-+]?\d+"), ("double", r"[-+]?\d*\.\d+(?:[eE][-+]?\d+)?|[-+]?\d+"), ("boolean", r"true|false"), ("date", r"\d{4}-\d\d-\d\d"), ("timestamp_ntz", r"\d{4}-\d\d-\d\d[T ]\d\d:.*"))
    for kind, pattern in patterns:
        if found and all(re.fullmatch(pattern, c) for c in found):
            return kind
    return "string"


def source_url(spark: SparkSession, url: str) -> Rel:
    """JSON objects as one variant column `data`: an array, a line each, or objects with any white space between.

    Lines of a file are read in parallel; a file that isn't a line an object is one value and one row to begin with.
    """
    if url.startswith("data:"):
        head, _, body = url.partition(",")
        text = base64.b64decode(body).decode() if head.endswith(";base64") else urllib.parse.unquote(body)
        lines = spark.createDataFrame([(text,)], "value string")
    else:
        lines = spark.read.text(url)
        if lines.where("try_parse_json(value) is null and trim(value) != ''").limit(1).count() or lines.where("schema_of_variant(try_parse_json(value)) like 'ARRAY%'").limit(1).count():
            lines = spark.read.text(url, wholetext=True)
    loose = F.regexp_replace(F.trim("value"), r"\}\s*\{", "},{")
    as_array = F.when(loose.startswith("["), loose).otherwise(F.concat(F.lit("["), loose, F.lit("]")))
    parsed = lines.where(F.trim("value") != "").select(F.try_variant_get(F.parse_json(as_array), "$", "array<variant>").alias("items"))
    return Rel(parsed.select(F.explode("items").alias("data")))


def csv_seed(spark: SparkSession, text: str) -> dict[str, DataFrame]:
    """Blocks `schema`, `table`, header, rows, with an empty line between; the tables by their qualified names."""
    out = {}
    for block in re.split(r"\n\s*\n", text.strip()):
        schema, table, header, *rows = [x.strip() for x in block.splitlines() if x.strip("- \t")]
        names = [h.strip() for h in header.split(",")]
        cells = [[_cell(c, "string") for c in r.split(",")] for r in rows]
        frame = spark.createDataFrame(cells, ", ".join(f"`{n}` string" for n in names))
        kinds = [_guess([r[i] for r in cells]) for i in range(len(names))]
        out[f"{schema}.{table}"] = frame.select(*(F.col(f"`{n}`").cast(k).alias(n) for n, k in zip(names, kinds)))
    return out


def execute_in_db(spark: SparkSession, sql: str, **tables: DataFrame) -> Rel:
    """SQL text as a relation; tables are passed by name."""
    return Rel(spark.sql(sql, **tables) if tables else spark.sql(sql))


def values(spark: SparkSession, items: list, kind: str, name: str = "value") -> Rel:
    """A list of values as a relation of one column."""
    return Rel(spark.createDataFrame([(x,) for x in items], f"`{name}` {kind}"))


def scalar(spark: SparkSession, **columns) -> Rel:
    """A relation of one row without a table."""
    return Rel(spark.range(1).select(*(c.alias(n) for n, c in columns.items())))


def json_properties(rel: Rel, **kinds: str) -> Rel:
    """Typed properties of the variant column `data`; a missing one is null."""
    return Rel(rel.df.select(*(F.try_variant_get("data", f"$.{n}", k).alias(n) for n, k in kinds.items())))
