"""Statements about stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def create_schema_statement(name: str) -> str:
    return f"CREATE SCHEMA IF NOT EXISTS `{name}`"


def drop_schema_statement(name: str) -> str:
    return f"DROP SCHEMA IF EXISTS `{name}` CASCADE"


def create_table_statement(table: str, columns: list[tuple[str, str]]) -> str:
    body = ", ".join(f"`{n}` {k}" for n, k in columns)
    return f"CREATE TABLE {table} ({body}) USING parquet"


def drop_table_statement(table: str) -> str:
    return f"DROP TABLE IF EXISTS {table}"


def drop_and_create_schema(spark: SparkSession, name: str) -> None:
    spark.sql(drop_schema_statement(name))
    spark.sql(create_schema_statement(name))


def drop_and_create_table(df: DataFrame, table: str) -> None:
    df.write.mode("overwrite").saveAsTable(table)


def tables(spark: SparkSession, schema: str = "default") -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables(schema))


def columns(spark: SparkSession, table: str) -> list[tuple[str, str]]:
    return [(c.name, c.dataType) for c in spark.catalog.listColumns(table)]


def schemas(spark: SparkSession) -> list[str]:
    return sorted(d.name for d in spark.catalog.listDatabases())
