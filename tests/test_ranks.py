"""Percentiles of large groups, found by rank, against Spark's own, which hold a group in one task."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import aggs, ranks
from plumbline.operators.relation import Rel


def frame(spark):
    rng = random.Random(5)
    odd = [0.0, -0.0, float("nan"), float("inf"), float("-inf"), 5e-324, -5e-324, 1.7e308, -1.7e308, 1.0, 1.0 + 2**-52, -3.5]
    rows = [(k, rng.choice(odd) if rng.random() < 0.3 else rng.uniform(-1e6, 1e6) * 10.0 ** rng.randrange(-9, 9), rng.randrange(-9, 9)) for k in (1, 1, None) for _ in range(300)]
    rows += [(2, 7.25, 4)] * 150 + [(3, 1.5, 2), (3, None, 8), (3, 2.5, None)] + [(4, None, None)] * 200
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k int, x double, n int").selectExpr("k", "x", "n", "cast(n * 0.37 as decimal(9, 2)) d").repartition(3)


@pytest.mark.parametrize("keys", [["k"], []])
def test_percentiles_of_large_groups(spark, monkeypatch, keys):
    monkeypatch.setattr(ranks, "HOT", 100)
    df = frame(spark)
    shares = (0.0, 0.1, 0.5, 0.73, 1.0)
    made = {f"x{i}": aggs.percentile("x", s) for i, s in enumerate(shares)} | {f"n{i}": aggs.percentile("n", s, False, False) for i, s in enumerate(shares)}
    made |= {f"a{i}": aggs.percentile("n", s, True, False) for i, s in enumerate(shares)} | {"m": F.round(aggs.median(F.col("d") * 2) + F.count("x"), 3), "down": aggs.percentile("x", 0.3, False), "s": aggs.sum_(F.col("n"))}
    want = df.groupBy(*keys).agg(*(c.alias(n) for n, c in made.items()))
    got = (Rel(df).group_by(keys, **made) if keys else Rel(df).aggregate(**made)).df
    assert got.schema.simpleString() == want.schema.simpleString()
    assert "doubleToLongBits" in got._jdf.queryExecution().analyzed().toString()
    show = lambda t: sorted(str([x + 0.0 if isinstance(x, float) else x for x in r]) for r in t.collect())
    assert show(got) == show(want) and len(show(got)) == (5 if keys else 1)


def test_percentiles_of_expressions_and_no_rows(spark, monkeypatch):
    monkeypatch.setattr(ranks, "HOT", 100)
    df, p = frame(spark), F.percentile(F.abs("n"), F.lit(0.4))
    got = Rel(df).group_by_functions({"odd": lambda r: r.k % 2 == 1}, p=p)
    assert sorted(map(str, got.df.collect())) == sorted(map(str, df.groupBy((F.col("k") % 2 == 1).alias("odd")).agg(p.alias("p")).collect()))
    assert Rel(df.where("false")).aggregate(p=p).df.collect() == [(None,)] and Rel(df.where("false")).group_by(["k"], p=p).df.collect() == []
    total = Rel(df.select("n")).extend_total(p=p).df
    assert total.count() == df.count() and [r[0] for r in total.select("p").distinct().collect()] == [df.agg(p).first()[0]]


def test_extents_and_text_queries(spark, monkeypatch):
    from plumbline.plans.language import Engine
    from plumbline.plans.model import Model
    from plumbline.sources.readers import Database

    monkeypatch.setattr(ranks, "HOT", 100)
    df = frame(spark)
    db = Database(spark, {"t": df})
    got = Engine(Model(db)).run("#>{db.t}#->groupBy(~[k], ~[p: x|$x.n : y|$y->percentile(0.4), q: x|$x.n : y|$y->percentile(0.4, false, false)])")
    want = df.groupBy("k").agg(F.percentile("n", F.lit(0.4)).alias("p"), aggs.percentile("n", 0.4, False, False).alias("q"))
    assert "doubleToLongBits" in got._jdf.queryExecution().analyzed().toString()
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
