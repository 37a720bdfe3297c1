"""Relation operators on literal rows: null order, naming, frames, as-of edges, sources."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from plumbline.functions import nulls, variant
from plumbline.operators import aggs, windows as w
from plumbline.operators.relation import Rel, ascending, concatenate_all, descending
from plumbline.sources import ddl, readers
from plumbline.streaming import windows as streams


def rel(spark, rows, schema):
    return Rel(spark.createDataFrame(rows, schema))


def rows(r):
    return [tuple(x) for x in (r.df if isinstance(r, Rel) else r).collect()]


def test_null_is_the_largest_value(spark):
    r = rel(spark, [(2,), (None,), (1,)], "x int")
    assert rows(r.sort(ascending("x"))) == [(1,), (2,), (None,)]
    assert rows(r.sort(descending("x"))) == [(None,), (2,), (1,)]
    assert rows(r.sort_by_reversed(lambda t: t.x)) == [(None,), (2,), (1,)]


def test_rename_moves_to_the_end(spark):
    r = rel(spark, [(1, 2, 3)], "a int, b int, c int").rename(a="z")
    assert r.df.columns == ["b", "c", "z"] and rows(r) == [(2, 3, 1)]


def test_slices(spark):
    r = rel(spark, [(i,) for i in range(10)], "x int").sort("x")
    assert rows(r.slice(2, 4)) == [(2,), (3,)] and rows(r.drop(8)) == [(8,), (9,)] and rows(r.head()) == [(0,)] and rows(r.slice(0, 0)) == []


@pytest.mark.parametrize("kind", ["INNER", "LEFT", "RIGHT", "FULL", "semi", "anti"])
def test_joins_without_an_equality(spark, kind):
    """Only rows whose ranges of values meet are compared; the result is that of all pairs."""
    left = [(i, float("nan") if i == 7 else None if i % 5 == 0 else i / 2) for i in range(40)]
    right = [(i, None if i % 7 == 0 else i % 9, -i) for i in range(30)]
    a, b = rel(spark, left, "a int, x double"), rel(spark, right, "b int, y int, z int")
    low = lambda p, q: p is not None and q is not None and p <= q and p == p
    for condition, holds in (
        (lambda t, v: (t.x <= v.y) & (v.b >= t.a - 3) & (v.z < -4) & (t.a > 1), lambda t, v: low(t[1], v[1]) and v[0] >= t[0] - 3 and v[2] < -4 and t[0] > 1),
        (lambda t, v: (t.a > v.b + 25) | (v.y > t.a), lambda t, v: t[0] > v[0] + 25 or v[1] is not None and v[1] > t[0]),
        (lambda t, v: t.a < v.z, lambda t, v: False),
    ):
        pairs = [(t, v) for t in left for v in right if holds(t, v)]
        lone = [t for t in left if t not in [p for p, _ in pairs]], [v for v in right if v not in [q for _, q in pairs]]
        if kind in ("semi", "anti"):
            got, want = getattr(a, kind)(b, condition), [t for t in left if (t in lone[0]) == (kind == "anti")]
        else:
            got, want = a.join(b, kind, condition), [p + q for p, q in pairs]
            want += [t + (None,) * 3 for t in lone[0] if kind in ("LEFT", "FULL")] + [(None,) * 2 + v for v in lone[1] if kind in ("RIGHT", "FULL")]
        assert sorted(map(str, rows(got))) == sorted(map(str, want))
    same = getattr(a, kind)(a, lambda t, v: t.a < v.x) if kind in ("semi", "anti") else a.join(a, kind, lambda t, v: t.a < v.o_x, prefix="o_")
    larger = lambda t: sum(v[1] is not None and (t[0] < v[1] or v[1] != v[1]) for v in left)
    matched = sum(v[1] is not None and (v[1] > 0 or v[1] != v[1]) for v in left)
    pairs, lone = sum(map(larger, left)), sum(not larger(t) for t in left)
    assert same.df.count() == {"INNER": pairs, "LEFT": pairs + lone, "RIGHT": pairs + 40 - matched, "FULL": pairs + lone + 40 - matched, "semi": 40 - lone, "anti": lone}[kind]
    bounds = {"INNER": 2, "LEFT": 1, "RIGHT": 1, "FULL": 0, "semi": 2, "anti": 1}[kind]
    theta = lambda t, v: t.a < v.b
    plan = (getattr(a, kind)(b, theta) if kind in ("semi", "anti") else a.join(b, kind, theta)).df._jdf.queryExecution().analyzed().toString()
    assert plan.count("scalar-subquery#") == bounds
    assert "scalar-subquery" not in a.join(b.limit(3), "INNER", theta).df._jdf.queryExecution().analyzed().toString()


def test_name_clashes_are_errors(spark):
    r = rel(spark, [(1,)], "a int")
    with pytest.raises(ValueError, match="prefix"):
        r.join(r, "INNER", lambda t, v: t.a == v.a)
    with pytest.raises(ValueError):
        r.extend(a=lambda t: t.a)
    with pytest.raises(AttributeError):
        r.filter(lambda t: t.nothing == 1)


def test_map_drops_nulls_and_flatten_drops_empty_lists(spark):
    assert rows(rel(spark, [(1,), (None,)], "x int").map(lambda t: t.x + 1)) == [(2,)]
    r = rel(spark, [("a", [1, 2]), ("b", []), ("c", None)], "k string, xs array<int>")
    assert rows(r.flatten("xs")) == [("a", 1), ("a", 2)]
    v = rel(spark, [("a", "[1, 2]")], "k string, j string").project(k=lambda t: t.k, xs=lambda t: variant.from_json(t.j)).flatten("xs", "int")
    assert rows(v) == [("a", 1), ("a", 2)]


def test_pivot_names_and_null_keys(spark):
    r = rel(spark, [("NYC", 2011, 5), ("NYC", 2011, 2), ("SAN", 2012, 7), (None, 2011, 9), ("SAN", None, 1)], "city string, year int, trees int")
    out = r.pivot(["year"], using=["trees"], sum=F.sum("trees"), n=F.count("trees"))
    assert out.df.columns == ["city", "2011__|__sum", "2011__|__n", "2012__|__sum", "2012__|__n"]
    assert sorted(rows(out), key=str) == [("NYC", 7, 2, None, None), ("SAN", None, None, 7, 1), (None, 9, 1, None, None)]
    only = r.pivot(["city", "year"], [("NYC", 2011)], using=["trees"], sum=F.sum("trees"))
    assert only.df.columns == ["NYC__|__2011__|__sum"] and rows(only) == [(7,)]


def plain_asof(left, right, op):
    test = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}[op]
    out = []
    for k, t in left:
        near = [r for r in right if t is not None and k is not None and r[0] == k and r[1] is not None and test(t, r[1])]
        best = (max if op[0] == ">" else min)(near, key=lambda r: r[1], default=(None, None, None))
        out.append((k, t, best[1], best[2]))
    return sorted(out, key=str)


@pytest.mark.parametrize("op", [">", ">=", "<", "<="])
@pytest.mark.parametrize("slots", [None, 3])
def test_as_of_join(spark, op, slots):
    left = [(k, t) for k in "ab" for t in (1, 5, 5, 7, 20)] + [("none", 4), (None, 4), ("a", None)]
    right = [(k, t, f"{k}{t}") for k in "ab" for t in (0, 5, 6, 19)] + [(None, 1, "x"), ("a", None, "y"), ("c", 3, "z")]
    joined = rel(spark, left, "k string, t int").as_of_join(rel(spark, right, "k string, t int, v string"), "t", op, "t", keys=[("k", "k")], prefix="r_", slots=slots)
    got = [(k, t, rt, v) for k, t, rk, rt, v in rows(joined)]
    assert sorted(got, key=str) == plain_asof(left, right, op)


def test_window_bounds(spark):
    with pytest.raises(ValueError, match="Invalid window frame boundary"):
        w.rows(1, 0)
    r = rel(spark, [(1, 10.0), (2, 20.0), (3, 30.0), (None, 40.0)], "k int, v double")
    x = w.over((), "k", w.range_(-0.5, 1.5))
    assert sorted(rows(r.extend_over(x, s=lambda o: o.apply("sum(v)"))), key=str) == [(1, 10.0, 30.0), (2, 20.0, 50.0), (3, 30.0, 30.0), (None, 40.0, 40.0)]


def test_reducers(spark):
    r = rel(spark, [("a", 1, 2.0), ("a", 3, 4.0), ("b", None, 1.0)], "k string, x int, y double")
    out = r.group_by(
        ["k"], n=aggs.count(), nx=aggs.count(F.col("x")), s=aggs.sum_(F.col("x")), w=aggs.wavg(F.col("y"), F.col("x")), j=aggs.join_strings(F.col("x"), "-", F.col("y"), True),
        top=aggs.max_by(F.col("x"), F.col("y"), 2), u=aggs.unique_value_only(F.col("k")), d=aggs.is_distinct(F.col("x")), p=aggs.percentile("y", 0.5),
    ).sort("k")
    assert rows(out) == [("a", 2, 2, 4, 3.5, "3-1", [3, 1], "a", True, 3.0), ("b", 1, 0, None, None, "", [None], "b", True, 1.0)]


def test_sets_and_null_safe_join(spark):
    a, b = rel(spark, [(1,), (None,)], "x int"), rel(spark, [(1,), (None,), (2,)], "y int")
    assert sorted(rows(a.join(b, "INNER", lambda t, v: nulls.equal(t.x, v.y))), key=str) == [(1, 1), (None, None)]
    assert rows(a.join(b, "INNER", lambda t, v: nulls.equal(t.x, v.y, optional=False))) == [(1, 1)]
    assert len(rows(concatenate_all(a, a, a))) == 6 and len(rows(concatenate_all(a, a).distinct())) == 2


def test_sources(spark, tmp_path):
    assert rows(readers.tds(spark, "#TDS\na, b\n1, x\n2, null\n#")) == [(1, "x"), (2, None)]
    assert rows(readers.tds(spark, "#TDS\na:Integer, d:StrictDate\n#")) == []
    assert readers.tds(spark, "#TDS\na:Integer, d:StrictDate\n1, 2020-01-02\n#").columns() == [("a", "bigint"), ("d", "date")]
    for name, text in (("array", '[{"n": 1}, {"n": 2}]'), ("lines", '{"n": 1}\n{"n": 2}\n'), ("loose", '{\n "n": 1\n}\n {"n":\n2}')):
        (tmp_path / name).write_text(text)
        assert sorted(rows(readers.json_properties(readers.source_url(spark, str(tmp_path / name)), n="int"))) == [(1,), (2,)], name
    seed = readers.csv_seed(spark, "s\nt\nid,name\n1,a\n2,\n\ns\nu\nx\n1.5")
    assert sorted(seed) == ["s.t", "s.u"] and rows(seed["s.t"]) == [(1, "a"), (2, None)]
    db = readers.Database(spark, {"t": seed["s.t"]})
    assert rows(db.replace(t=seed["s.u"]).table("t")) == [(1.5,)] and db.schema("t") == [("id", "bigint"), ("name", "string")]
    assert rows(readers.values(spark, [1, 2], "int")) == [(1,), (2,)] and rows(readers.scalar(spark, x=F.lit(1))) == [(1,)]
    assert rel(spark, [(1, None)], "a int, b string").to_csv() == "a,b\n1,\n" and "#TDS" in rel(spark, [(1,)], "a int").to_text()
    assert rel(spark, [(1,), (2,)], "a int").write(str(tmp_path / "out")) == 2
    assert rows(rel(spark, [(1, None)], "a int, b string").json_rows()) == [('{"a":1,"b":null}',)]
    assert ddl.create_table_statement("t", [("a", "int")]) == "CREATE TABLE t (`a` int) USING parquet"


def test_streams_agree_with_tables(spark, tmp_path):
    events = [(i, dt.datetime(2024, 1, 1, i // 4, 15 * (i % 4)), f"u{i % 2}", float(i)) for i in range(20)]
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    table = spark.createDataFrame(events, "id long, ts timestamp, user string, value double")
    table.write.parquet(path)
    late = spark.createDataFrame([(99, dt.datetime(2024, 1, 3), "u0", 0.0)], table.schema)  # moves the watermark on
    late.write.mode("append").parquet(path)
    stream = spark.readStream.schema(table.schema).parquet(path)
    query = streams.write_table(streams.tumbling(stream, "ts", "1 hour", ["user"], n=F.count(F.lit(1))), out, str(tmp_path / "check"))
    query.awaitTermination(120)
    want = sorted(map(tuple, streams.tumbling(table, "ts", "1 hour", ["user"], n=F.count(F.lit(1))).collect()))
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == want and len(want) == 10
    assert streams.first_of_each(table, "ts", ["user"]).count() == 2
