"""Queries that take whole tables: fixtures with keys beyond the bounds of their namesakes."""

import json

from plumbline import queries


def whole(spark, name, tables, folder):
    for table, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{table}.parquet")
    for table in set(queries.TABLES) - set(tables):
        spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").limit(0).write.parquet(f"{folder}/{table}.parquet")
    return queries.queries()[name](spark, str(folder)).collect()


def test_join_theta(spark, tmp_path):
    suppliers, parts = [(k,) for k in range(1, 31)], [(k, k % 50 + 1) for k in range(1, 401)]
    got = whole(spark, "join_theta", {"supplier": (suppliers, "s_suppkey long"), "part": (parts, "p_partkey long, p_size long")}, tmp_path)
    want = sorted((s, p) for (s,) in suppliers for p, size in parts if s * 4 < p and size > s)
    assert sorted(map(tuple, got)) == want and max(s for s, _ in want) > 10 and max(p for _, p in want) > 50


def test_graph_fetch_nested(spark):
    folder = "/root/testdata/sf0.001"
    got = {r.id: sorted(map(tuple, r.orders)) for r in queries.queries()["graph_fetch_nested"](spark, folder).collect()}
    want = {r.c_custkey: [] for r in spark.read.parquet(f"{folder}/customer.parquet").collect()}
    for r in spark.read.parquet(f"{folder}/orders.parquet").collect():
        want[r.o_custkey].append((r.o_orderkey, r.o_totalprice))
    assert got == {k: sorted(v) for k, v in want.items()} and any(k % 10 for k in got)


def test_graph_serialize(spark):
    folder = "/root/testdata/sf0.001"
    got = sorted(json.loads(r.json)["id"] for r in queries.queries()["graph_serialize"](spark, folder).collect())
    assert got == sorted(r.c_custkey for r in spark.read.parquet(f"{folder}/customer.parquet").collect()) and got[-1] > 100
