"""Queries as text against the same plans in Python or plain expectations."""

import datetime as dt

import pytest

from plumbline.plans.language import Engine, Parser
from plumbline.plans.model import Mapping, Model
from plumbline.sources.readers import Database


@pytest.fixture(scope="module")
def engine(spark):
    emp = spark.createDataFrame([(1, "Ann", "A", 10.0, 7), (2, "Bob", "A", 30.0, 7), (3, "Cy", "B", 20.0, None), (4, "D'Arcy", "B", None, 9)], "id int, name string, dept string, pay double, firm int")
    firm = spark.createDataFrame([(7, "Acme"), (8, "Empty")], "id int, legal string")
    quote = spark.createDataFrame([("A", 1, 5.0), ("A", 3, 6.0), ("B", 9, 7.0)], "k string, t int, price double")
    m = Model(Database(spark, {"emp": emp, "firm": firm, "quote": quote}))
    m.add_class("Firm", legalName="String")
    m.add_class("Person", name="String")
    m.map("Firm", Mapping("firm", {"legalName": "legal"}, {"id": "id"}))
    m.map("Person", Mapping("emp", {"name": "name", "pay": "pay"}, {"firm": "firm"}))
    m.associate("Person", "firm", "Firm", False, [("$firm", "$id")], back="people")
    return Engine(m)


CASES = [
    ("#>{db.emp}#->filter(x|$x.pay > 10 && $x.dept == 'A')->select(~[id, name])", [(2, "Bob")]),
    ("#>{db.emp}#->filter(x|$x.dept != 'A')->project(~[n: x|$x.name->toUpper(), k: x|$x.pay * 2 + 1])", [("CY", 41.0), ("D'ARCY", None)]),
    ("#>{db.emp}#->filter(x|$x.pay == [])->select(~id)", [(4,)]),
    ("#>{db.emp}#->groupBy(~[dept], ~[n: x|$x : y|$y->count(), total: x|$x.pay : y|$y->sum(), names: x|$x.name : y|$y->joinStrings('+')])", [("A", 2, 40.0, "Ann+Bob"), ("B", 2, 20.0, "Cy+D'Arcy")]),
    ("#>{db.emp}#->aggregate(~[d: x|$x.dept : y|$y->distinct()->count()])", [(2,)]),
    ("#>{db.emp}#->extend(~big: x|if($x.pay >= 20, |'yes', |'no'))->select(~[id, big])", [(1, "no"), (2, "yes"), (3, "yes"), (4, "no")]),
    ("#>{db.emp}#->extend(over(~dept, ~pay->descending()), ~[r: {p,w,r|$p->rank($w, $r)}, b: {p,w,r|$p->lag($r).name}])->select(~[id, r, b])", [(1, 2, "Bob"), (2, 1, None), (3, 2, "D'Arcy"), (4, 1, None)]),
    ("#>{db.emp}#->extend(over(~dept, ~id->ascending(), rows(unbounded(), 0)), ~s: {p,w,r|$r.pay} : y|$y->sum())->select(~[id, s])", [(1, 10.0), (2, 40.0), (3, 20.0), (4, 20.0)]),
    ("#>{db.emp}#->sort([~pay->descending(), ~id->ascending()])->slice(1, 3)->select(~id)", [(2,), (3,)]),
    ("#>{db.emp}#->rename(~pay, ~salary)->select(~[salary, id])->sort(~id->ascending())->limit(1)", [(10.0, 1)]),
    ("#>{db.emp}#->join(#>{db.firm}#->rename(~id, ~fid), JoinKind.LEFT, {t,v|$t.firm == $v.fid})->select(~[id, legal])", [(1, "Acme"), (2, "Acme"), (3, None), (4, None)]),
    ("#>{db.emp}#->select(~dept)->distinct()->concatenate(#>{db.quote}#->select(~k))->size()", [(5,)]),
    ("#>{db.emp}#->asOfJoin(#>{db.quote}#, {t,v|$t.id >= $v.q_t}, {t,v|$t.dept == $v.q_k}, 'q_')->select(~[id, q_price])", [(1, 5.0), (2, 5.0), (3, None), (4, None)]),
    ("#>{db.emp}#->select(~[dept, pay])->pivot(~[dept], ~[total: x|$x.pay : y|$y->sum()])", [(40.0, 20.0)]),
    ("#>{db.emp}#->project(~[s: x|'n=' + $x.name, l: x|$x.name->length(), i: x|$x.dept->in(['A', 'C'])])->limit(1)", [("n=Ann", 3, True)]),
    ("Person.all()->filter(p|$p.firm.legalName == 'Acme')->project(~[n: p|$p.name, f: p|$p.firm.legalName])", [("Ann", "Acme"), ("Bob", "Acme")]),
    ("Firm.all()->filter(f|$f.people->exists(e|$e.pay > 20))->project(~[f: x|$x.legalName])", [("Acme",)]),
    ("Firm.all()->filter(f|$f.people->isEmpty())->project(~[f: x|$x.legalName])", [("Empty",)]),
    ("Person.all()->groupBy(~[f: p|$p.firm.legalName], ~[n: p|$p.name : y|$y->count()])", [("Acme", 2), (None, 2)]),
    ("[3, 1, 2]->sort()->map(x|$x * 2)->joinStrings(',')", [("2,4,6",)]),
    ("%2020-01-31->adjust(1, DurationUnit.MONTHS)", [(dt.datetime(2020, 2, 29),)]),
    ("%2019-12-31->dateDiff(%2020-01-01, DurationUnit.YEARS)", [(1,)]),
    ("'a-b'->split('-')->at(1)", [("b",)]),
    ("-(1 + 2) * 3 / 2", [(-4.5,)]),
    ("5->mod(3) == 2 && !(1 > 2)", [(True,)]),
]


@pytest.mark.parametrize(("text", "want"), CASES, ids=range(len(CASES)))
def test_query(engine, text, want):
    key = lambda r: [str(v) for v in r]
    assert sorted(map(tuple, engine.run(text).collect()), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("text", ["#>{db.emp}#->filter(x|", "1 +", "a b", "'open", "#>{db.emp}#->select(~[id)"])
def test_errors_have_a_place(text):
    with pytest.raises(SyntaxError):
        Parser(text).parse()


def test_unknown_names(engine):
    with pytest.raises(NameError):
        engine.run("#>{db.emp}#->explode()")
    with pytest.raises((NameError, KeyError)):
        engine.run("'a'->noSuchThing()")
