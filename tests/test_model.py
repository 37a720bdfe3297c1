"""Classes, navigation, graph fetch, versions: literal rows with orphans, null keys and childless parents."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from plumbline.plans import graph
from plumbline.plans.model import Mapping, Model, Temporal, encoded
from plumbline.sources.readers import Database


@pytest.fixture()
def model(spark):
    person = spark.createDataFrame([(1, "Ann", 10, 31), (2, "Bob", 10, None), (3, "Cy", None, 50), (4, "D'Arcy", 99, 20)], "ID int, NAME string, FIRM_ID int, AGE int")
    firm = spark.createDataFrame([(10, "Acme", 7, "P"), (11, "Empty", None, "X")], "ID int, LEGAL string, BOSS int, KIND string")
    address = spark.createDataFrame([(1, 1, "NY"), (2, 1, "LA"), (3, 2, "NY"), (4, None, "SF")], "ID int, PERSON_ID int, CITY string")
    m = Model(Database(spark, {"person": person, "firm": firm, "address": address}))
    m.add_class("Person", name="String", age="Integer").constraints = {"adult": lambda r: r.age >= 18}
    m.add_class("Firm", legalName="String")
    m.add_class("Address", city="String")
    m.map("Person", Mapping("person", {"name": "NAME", "age": "AGE"}, {"id": "ID", "firm": "FIRM_ID"}))
    m.map("Firm", Mapping("firm", {"legalName": "LEGAL", "kind": "KIND"}, {"id": "ID"}, enums={"kind": {"PUBLIC": ["P", "Q"], "PRIVATE": ["R"]}}))
    m.map("Address", Mapping("address", {"city": "CITY"}, {"person": "PERSON_ID"}))
    m.associate("Person", "firm", "Firm", False, [("$firm", "$id")], back="employees")
    m.associate("Person", "addresses", "Address", True, [("$id", "$person")], back="person", back_many=False)
    return m


def rows(x):
    return sorted((tuple(r) for r in (x.df if hasattr(x, "df") else x).collect()), key=lambda r: [str(v) for v in r])


def test_navigation_in_projections(model):
    assert rows(model.all("Person").project(n="name", f="firm.legalName")) == [("Ann", "Acme"), ("Bob", "Acme"), ("Cy", None), ("D'Arcy", None)]
    assert rows(model.all("Person").project(n="name", c="addresses.city")) == [("Ann", "LA"), ("Ann", "NY"), ("Bob", "NY"), ("Cy", None), ("D'Arcy", None)]
    assert rows(model.all("Firm").project(f="legalName", c="employees.addresses.city")) == [("Acme", "LA"), ("Acme", "NY"), ("Acme", "NY"), ("Empty", None)]


def test_unasked_steps_are_not_joined(model):
    plan = model.all("Person").project(n="name").df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_filters_do_not_repeat_rows(model):
    assert rows(model.all("Person").exists("addresses").project(n="name")) == [("Ann",), ("Bob",)]
    assert rows(model.all("Person").exists("addresses", lambda a: a.at("city") == "LA").project(n="name")) == [("Ann",)]
    assert rows(model.all("Person").is_empty("addresses").project(n="name")) == [("Cy",), ("D'Arcy",)]
    assert rows(model.all("Person").filter(lambda p: p.at("firm.legalName") == "Acme", "firm.legalName").project(n="name")) == [("Ann",), ("Bob",)]


def test_aggregates_over_children(model):
    counted = model.all("Firm").with_aggregate("n", "employees", lambda e: F.count("name"), default=0).with_aggregate("old", "employees", lambda e: F.max("age"))
    assert rows(counted.df.select("legalName", "n", "old")) == [("Acme", 2, 31), ("Empty", 0, None)]
    assert rows(model.all("Person").group_by({"f": "firm.legalName"}, n=("name", F.count))) == [("Acme", 2), (None, 2)]


def test_enums(model):
    assert rows(model.all("Firm").project(f="legalName", k="kind")) == [("Acme", "PUBLIC"), ("Empty", None)]
    codes = {"PUBLIC": ["P", "Q"]}
    assert rows(model.database.table("firm").filter(lambda r: encoded(r.KIND, codes, "PUBLIC")).select("ID")) == [(10,)]


def test_graph_fetch(model):
    tree = {"legalName": None, "employees": {"name": None, "addresses": {"city": None}}}
    got = sorted(json.loads(r.json)["legalName"] + r.json[-1] for r in graph.serialize(graph.graph_fetch(model.all("Firm"), tree)).collect())
    assert got == ["Acme}", "Empty}"]
    acme, empty = sorted((json.loads(r.json) for r in graph.serialize(graph.graph_fetch(model.all("Firm"), tree)).collect()), key=lambda x: x["legalName"])
    assert acme["employees"] == [{"name": "Ann", "addresses": [{"city": "LA"}, {"city": "NY"}]}, {"name": "Bob", "addresses": [{"city": "NY"}]}] and empty["employees"] == []
    (cy,) = [json.loads(r.json) for r in graph.serialize(graph.graph_fetch(model.all("Person").filter(lambda p: p.at("name") == "Cy"), {"name": None, "firm": {"legalName": None}}), include_type="Person").collect()]
    assert cy == {"@type": "Person", "name": "Cy", "firm": None}
    (whole,) = graph.serialize(graph.graph_fetch(model.all("Address"), {"city": None}), as_array=True).collect()
    assert [x["city"] for x in json.loads(whole.json)] == ["LA", "NY", "NY", "SF"]
    checked = {r.value["name"]: r.defects for r in graph.graph_fetch_checked(model.all("Person"), {"name": None}).collect()}
    assert checked == {"Ann": [], "Bob": ["adult"], "Cy": [], "D'Arcy": []}


def test_inheritance_and_include(model, spark):
    m = Model(model.database)
    m.include(model)
    m.add_class("Party", name="String")
    m.classes["Person"].supers = ("Party",)
    assert rows(m.all("Party").project(n="name", k="$class"))[0] == ("Ann", "Person")
    assert len(rows(m.all("Party").sub_type("Person").project(f="firm.legalName"))) == 4


@pytest.fixture()
def versions(spark):
    t = lambda y: dt.datetime(y, 1, 1)
    product = spark.createDataFrame([(1, "a1", t(2010), t(2015)), (1, "a2", t(2015), t(9999)), (2, "b1", t(2012), t(9999))], "id int, name string, from_z timestamp_ntz, thru_z timestamp_ntz")
    order = spark.createDataFrame([(100, 1), (101, 2), (102, 3)], "id int, product int")
    m = Model(Database(spark, {"product": product, "order": order}))
    m.add_class("Product", name="String").temporal = "business"
    m.add_class("Order", id="Integer").temporal = "business"
    m.map("Product", Mapping("product", {"name": "name"}, {"id": "id"}, business=Temporal("from_z", "thru_z", infinity=t(9999))))
    m.map("Order", Mapping("order", {"id": "id"}, {"product": "product"}))
    m.associate("Order", "product", "Product", False, [("$product", "$id")])
    return m, t


def test_versions(versions):
    m, t = versions
    assert rows(m.all("Product", t(2011)).project(n="name")) == [("a1",)]
    assert rows(m.all("Product", t(2015)).project(n="name")) == [("a2",), ("b1",)]
    assert rows(m.all("Product", "%latest").project(n="name")) == [("a2",), ("b1",)]
    assert len(rows(m.all_versions("Product").project(n="name"))) == 3
    assert rows(m.all_versions_in_range("Product", t(2009), t(2011)).project(n="name")) == [("a1",)]
    assert len(m.all_for_each_date("Product", [t(2011), t(2016)]).collect()) == 3
    # the date goes along a navigation; orders without a version at that date stay
    assert rows(m.all("Order", t(2011)).project(i="id", p="product.name")) == [(100, "a1"), (101, None), (102, None)]


def test_version_rules(spark):
    day = dt.datetime(2015, 1, 1)
    t = spark.createDataFrame([(day, dt.datetime(2016, 1, 1)), (dt.datetime(2014, 1, 1), day)], "f timestamp_ntz, t timestamp_ntz")
    assert t.where(Temporal("f", "t").at(day)).count() == 1 and t.where(Temporal("f", "t", thru_inclusive=True).at(day)).first()[1] == day
    assert spark.createDataFrame([(day.date(),)], "s date").where(Temporal(snapshot="s").at(day)).count() == 1
    for bad, date in ((Temporal("f"), day), (Temporal("f", "t"), "%latest"), (Temporal(snapshot="s"), "%latest")):
        with pytest.raises(ValueError):
            bad.at(date)
    m = Model(Database(spark))
    m.add_class("B").temporal = "bitemporal"
    with pytest.raises(ValueError):
        m.all("B", day)


def test_ranges_of_versions(spark):
    at = lambda d: dt.datetime(2020, 1, d)
    versions = spark.createDataFrame([(1, at(1), at(5)), (2, at(5), at(9)), (3, at(9), at(20))], "id int, a timestamp_ntz, b timestamp_ntz")
    m = Model(Database(spark, {"v": versions, "s": spark.createDataFrame([(d, dt.date(2020, 1, d)) for d in range(1, 9)], "id int, d date")}))
    for name, temporal in (("From", Temporal("a", "b")), ("Thru", Temporal("a", "b", thru_inclusive=True))):
        m.add_class(name, id="Integer").temporal = "business"
        m.map(name, Mapping("v", {"id": "id"}, business=temporal))
    m.add_class("Day", id="Integer").temporal = "business"
    m.map("Day", Mapping("s", {"id": "id"}, business=Temporal(snapshot="d")))
    ids = lambda name, *d: sorted(r.id for r in m.all_versions_in_range(name, *map(at, d)).df.collect())
    assert ids("From", 5, 9) == [2, 3] and ids("Thru", 5, 9) == [1, 2] and ids("Day", 3, 5) == [3, 4, 5]
    each = m.all_for_each_date("From", [at(2), at(9), at(9), at(25)]).collect()
    assert sorted((r.id, r["$date"]) for r in each) == [(1, at(2)), (3, at(9))]
