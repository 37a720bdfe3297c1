import datetime as dt

import pytest
from pyspark.sql import functions as F

from plumbline.operators.relation import Rel
from plumbline.plans import platform
from plumbline.plans.model import Mapping, Model
from plumbline.sources.readers import Database


def test_platform(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id int, k string")
    m = Model(Database(spark, {"t": t}))
    m.add_class("A")
    m.add_class("B").supers = ("A",)
    m.map("B", Mapping("t", {"k": "k"}))
    assert platform.execute(m, "#>{db.t}#->filter(x|$x.id == 2)->select(~k)").collect()[0].k == "b"
    assert "Physical Plan" in platform.execution_plan(Rel(t))
    assert platform.all_super_classes(m, "B") == ["B", "A"] and platform.instance_of(m, "B", "A") and not platform.instance_of(m, "A", "B")
    assert platform.main_table(platform.root_class_mapping_by_class(m, "B")) == "t" and platform.property_mappings_by_property_name(m.mappings["B"][0], "k") == "k"
    assert t.where(platform.object_reference_in([F.col("id"), F.col("k")], [(1, "a"), (2, "x")])).count() == 1
    assert t.where(platform.object_reference_in([F.col("id")], [])).count() == 0
    assert platform.concatenate_temporal_queries([t, t]).count() == 4
    assert platform.assert_eq_within_tolerance(1.0, 1.01, 0.1) and platform.assert_error(lambda: 1 / 0, "division")
    assert platform.assert_tds_equivalent(Rel(t), Rel(t.orderBy(F.desc("id"))))
    for bad in (lambda: platform.fail("x"), lambda: platform.assert_(False), lambda: platform.assert_error(lambda: 1)):
        with pytest.raises(AssertionError):
            bad()


def test_parameters(spark):
    t = spark.createDataFrame([(1, "a", dt.date(2024, 1, 1)), (2, "b'", dt.date(2024, 2, 1)), (3, None, None)], "id int, k string, d date")
    m = Model(Database(spark, {"t": t}))
    ids = lambda text, **p: sorted(r.id for r in platform.execute(m, text, **p).collect())
    assert ids("#>{db.t}#->filter(x|$x.id >= $low)->select(~id)", low=2) == [2, 3]
    assert ids("#>{db.t}#->filter(x|$x.k == $k)->select(~id)", k="b'") == [2]
    assert ids("#>{db.t}#->filter(x|$x.k == $k)->select(~id)", k=None) == [3]
    assert ids("#>{db.t}#->filter(x|$x.d > $d)->select(~id)", d=dt.date(2024, 1, 15)) == [2]
    assert ids("#>{db.t}#->filter(x|$x.id->in($ids))->select(~id)", ids=[1, 3, 9]) == [1, 3]
    assert ids("#>{db.t}#->filter(x|$x.k->in($ks))->select(~id)", ks=["a", "b"]) == [1]
    assert platform.execute(m, "#>{db.t}#->aggregate(~[s: x|$x.k : y|$y->joinStrings($sep)])", sep="|").collect()[0].s == "a|b'"
    later = platform.execute(m, "let n = 10; #>{db.t}#->extend(~far: x|$x.id + $n)->extend(over(~id->ascending()), ~run: {p,w,r|$r.id * $n} : y|$y->sum())->select(~[far, run]);")
    assert sorted(map(tuple, later.collect())) == [(11, 10), (12, 30), (13, 60)]
    assert ids("#>{db.t}#->limit($n)->select(~id)", n=0) == []
    assert ids("$r->filter(x|$x.id < 3)->select(~id)", r=Rel(t)) == [1, 2]
    with pytest.raises(KeyError):
        platform.execute(m, "#>{db.t}#->filter(x|$x.id >= $low)", high=2)


def test_scanned_columns(spark, tmp_path):
    spark.range(5).selectExpr("id a", "id * 2 b", "id c").write.parquet(str(tmp_path / "x"))
    spark.range(5).selectExpr("id k", "id v", "id w").write.parquet(str(tmp_path / "y"))
    x, y = (Rel(spark.read.parquet(str(tmp_path / n))) for n in "xy")
    query = x.filter(lambda r: r.c > 1).join(y, "INNER", lambda a, b: a.a == b.k).select("b", "v")
    got = platform.scan_columns(query)
    assert {p.rpartition("/")[2]: c for p, c in got.items()} == {"x": ["a", "b", "c"], "y": ["k", "v"]}
    assert platform.scan_relations(query) == sorted(got)
    assert platform.scan_columns(spark.range(3)) == {"Range": ["id"]}
