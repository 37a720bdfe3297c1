"""Queries over the star tables, one or more for each operator family, each with the SQL that says what it means."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import calendars, collections as lists, dates, hashing, maths, nulls, strings, variant
from plumbline.operators import aggs, windows as w
from plumbline.operators.relation import Rel, ascending, descending
from plumbline.plans import graph
from plumbline.plans.language import Engine
from plumbline.plans.model import Mapping, Model, Temporal, embed, extend
from plumbline.session import ship
from plumbline.sources import readers
from plumbline.streaming import windows as streams

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"]
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None):
    """Register a function (spark, tables) -> Rel or DataFrame under its name, with its SQL."""

    def register(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            db = readers.Database.of_folder(spark, sf_dir, TABLES)
            got = f(spark, db)
            return got.df if isinstance(got, Rel) else got

        _QUERIES[f.__name__] = run
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _r(c, n: int = 4):
    return F.round(c, n)


# relation core


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
    round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_quantity), 4) AS avg_qty, count(*) AS count_order
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(spark, db):
    rows = db.table("lineitem").filter(lambda r: nulls.less_than_equal(r.l_shipdate, F.lit(dt.datetime(1998, 9, 2)).cast("timestamp_ntz")))
    return rows.group_by(
        ["l_returnflag", "l_linestatus"],
        sum_qty=_r(aggs.sum_(F.col("l_quantity")), 2),
        sum_base_price=_r(aggs.sum_(F.col("l_extendedprice")), 2),
        sum_disc_price=_r(aggs.sum_(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2),
        avg_qty=_r(aggs.average(F.col("l_quantity"))),
        count_order=aggs.count(),
    )


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 150000 AND o_orderstatus = 'F'")
def filter_where(spark, db):
    return db.table("orders").filter(lambda r: (r.o_totalprice > 150000) & nulls.equal(r.o_orderstatus, "F")).select("o_orderkey", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) AS charge FROM lineitem")
def project_expr(spark, db):
    return db.table("lineitem").project(l_orderkey=lambda r: r.l_orderkey, l_linenumber=lambda r: r.l_linenumber, charge=lambda r: _r(r.l_extendedprice * (1 - r.l_discount) * (1 + r.l_tax), 6))


@query("SELECT *, CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS kind FROM part")
def extend_col(spark, db):
    return db.table("part").extend(kind=lambda r: nulls.if_(r.p_size > 25, "large", "small"))


@query("SELECT n_regionkey, n_nationkey AS id, n_name AS nation FROM nation")
def rename_cols(spark, db):
    return db.table("nation").rename(n_nationkey="id", n_name="nation")


@query("SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_cols(spark, db):
    return db.table("orders").distinct("o_orderstatus", "o_orderpriority")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS FIRST, o_orderkey LIMIT 25")
def sort_limit(spark, db):
    return db.table("orders").select("o_orderkey", "o_totalprice").sort(descending("o_totalprice"), ascending("o_orderkey")).limit(25)


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 20 OFFSET 10")
def slice_window(spark, db):
    return db.table("customer").select("c_custkey", "c_name").sort("c_custkey").slice(10, 30)


@query("SELECT c_custkey FROM customer ORDER BY c_custkey OFFSET 100")
def drop_rows(spark, db):
    return db.table("customer").select("c_custkey").sort("c_custkey").drop(100)


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus IS NOT DISTINCT FROM 'F')")
def not_equal_null_safe(spark, db):
    return db.table("orders").filter(lambda r: nulls.not_equal(r.o_orderstatus, "F")).select("o_orderkey")


@query("""SELECT p_partkey, p_size BETWEEN 10 AND 20 AS mid, p_brand IN ('Brand#11', 'Brand#12', 'Brand#23') AS chosen,
    CAST(CASE WHEN p_size < 25 THEN -1 WHEN p_size > 25 THEN 1 ELSE 0 END AS BIGINT) AS side FROM part""")
def in_between(spark, db):
    return db.table("part").project(
        p_partkey=lambda r: r.p_partkey,
        mid=lambda r: nulls.between(r.p_size, 10, 20),
        chosen=lambda r: nulls.in_(r.p_brand, ["Brand#11", "Brand#12", "Brand#23"]),
        side=lambda r: nulls.compare(r.p_size, 25),
    )


@query("SELECT CAST(count(*) AS BIGINT) AS size FROM lineitem")
def relation_size(spark, db):
    return db.table("lineitem").size()


@query("SELECT upper(n_name) AS value FROM nation WHERE n_regionkey = 1")
def map_values(spark, db):
    return db.table("nation").filter(lambda r: r.n_regionkey == 1).map(lambda r: strings.to_upper(r.n_name))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_totalprice AS BIGINT) AS o_totalprice FROM (SELECT o_orderkey, floor(o_totalprice) AS o_totalprice FROM orders)")
def cast_relation(spark, db):
    return db.table("orders").project(o_orderkey=lambda r: r.o_orderkey, o_totalprice=lambda r: F.floor(r.o_totalprice)).cast(o_orderkey="string", o_totalprice="bigint")


# groups


@query("SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey")
def group_by_basic(spark, db):
    return db.table("orders").group_by(["o_custkey"], n=aggs.count(), total=_r(aggs.sum_(F.col("o_totalprice")), 2))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) >= 10")
def group_by_having(spark, db):
    return db.table("orders").group_by(["o_custkey"], n=aggs.count()).filter(lambda r: r.n >= 10)


@query("SELECT year(o_orderdate) AS y, o_orderpriority AS p, max(o_totalprice) AS top, min(o_totalprice) AS low FROM orders GROUP BY ALL")
def group_by_functions(spark, db):
    return db.table("orders").group_by_functions({"y": lambda r: dates.year(r.o_orderdate), "p": lambda r: r.o_orderpriority}, top=aggs.max_(F.col("o_totalprice")), low=aggs.min_(F.col("o_totalprice")))


@query("""SELECT count(*) AS n, count(DISTINCT l_partkey) AS parts, round(avg(l_discount), 8) AS mean, max(l_shipdate) AS last FROM lineitem""")
def agg_global(spark, db):
    return db.table("lineitem").aggregate(n=aggs.count(), parts=aggs.count_distinct(F.col("l_partkey")), mean=_r(aggs.mean(F.col("l_discount")), 8), last=aggs.max_(F.col("l_shipdate")))


@query("""SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(stddev_pop(l_quantity), 6) AS sdp, round(var_samp(l_quantity), 4) AS v,
    round(var_pop(l_quantity), 4) AS vp, median(l_quantity) AS mid FROM lineitem GROUP BY l_returnflag""")
def agg_stats(spark, db):
    q = F.col("l_quantity")
    return db.table("lineitem").group_by(["l_returnflag"], sd=_r(aggs.std_dev(q), 6), sdp=_r(aggs.std_dev_population(q), 6), v=_r(aggs.variance(q)), vp=_r(aggs.variance(q, False)), mid=aggs.median(q))


@query("""SELECT l_linestatus, round(quantile_cont(l_extendedprice, 0.9), 4) AS p90, quantile_disc(l_extendedprice, 0.25) AS d25,
    round(quantile_cont(l_extendedprice, 0.1), 4) AS top90 FROM lineitem GROUP BY l_linestatus""")
def agg_percentile(spark, db):
    p = lambda share, *a: aggs.percentile("l_extendedprice", share, *a)
    return db.table("lineitem").group_by(["l_linestatus"], p90=_r(p(0.9)), d25=p(0.25, True, False), top90=_r(p(0.9, False)))


@query("SELECT n_regionkey, string_agg(n_name, ', ' ORDER BY n_name) AS names, string_agg(n_name, '' ORDER BY n_nationkey) AS run FROM nation GROUP BY n_regionkey")
def agg_string(spark, db):
    return db.table("nation").group_by(["n_regionkey"], names=aggs.join_strings(F.col("n_name"), ", "), run=aggs.join_strings(F.col("n_name"), "", F.col("n_nationkey")))


@query("""SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 6) AS r, round(covar_samp(l_quantity, l_extendedprice), 2) AS cs,
    round(covar_pop(l_quantity, l_extendedprice), 2) AS cp FROM lineitem GROUP BY l_returnflag""")
def agg_bivariate(spark, db):
    a, b = F.col("l_quantity"), F.col("l_extendedprice")
    return db.table("lineitem").group_by(["l_returnflag"], r=_r(aggs.corr(a, b), 6), cs=_r(aggs.covar_sample(a, b), 2), cp=_r(aggs.covar_population(a, b), 2))


@query("SELECT l_suppkey, round(sum(l_discount * l_quantity) / sum(l_quantity), 8) AS weighted FROM lineitem GROUP BY l_suppkey")
def agg_wavg(spark, db):
    return db.table("lineitem").group_by(["l_suppkey"], weighted=_r(aggs.wavg(F.col("l_discount"), F.col("l_quantity")), 8))


@query("""SELECT p_brand, arg_max(p_partkey, p_retailprice * 1000000 + p_partkey) AS dearest, arg_min(p_partkey, p_retailprice * 1000000 + p_partkey) AS cheapest
    FROM part GROUP BY p_brand""")
def agg_max_by(spark, db):
    key = F.col("p_retailprice") * 1000000 + F.col("p_partkey")
    return db.table("part").group_by(["p_brand"], dearest=aggs.max_by(F.col("p_partkey"), key), cheapest=aggs.min_by(F.col("p_partkey"), key))


@query("""SELECT o_custkey, bool_and(o_totalprice > 1000) AS every, bool_or(o_totalprice > 300000) AS some,
    count(DISTINCT o_orderpriority) = count(o_orderpriority) AS different,
    CASE WHEN count(DISTINCT o_orderstatus) = 1 THEN any_value(o_orderstatus) END AS only_status FROM orders GROUP BY o_custkey""")
def agg_boolean_unique(spark, db):
    return db.table("orders").group_by(
        ["o_custkey"],
        every=aggs.and_(F.col("o_totalprice") > 1000),
        some=aggs.or_(F.col("o_totalprice") > 300000),
        different=aggs.is_distinct(F.col("o_orderpriority")),
        only_status=aggs.unique_value_only(F.col("o_orderstatus")),
    )


@query("SELECT o_orderpriority, min(m) AS mode_status FROM (SELECT *, max(n) OVER (PARTITION BY o_orderpriority) AS top FROM (SELECT o_orderpriority, o_orderstatus AS m, count(*) AS n FROM orders GROUP BY ALL)) WHERE n = top GROUP BY o_orderpriority")
def agg_mode(spark, db):
    return db.table("orders").group_by(["o_orderpriority"], mode_status=aggs.mode(F.col("o_orderstatus")))


# joins


@query("SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def join_inner(spark, db):
    return db.table("customer").join(db.table("nation"), "INNER", lambda t, v: t.c_nationkey == v.n_nationkey).select("c_custkey", "c_name", "n_name")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 200000")
def join_left(spark, db):
    return db.table("customer").join(db.table("orders"), "LEFT", lambda t, v: (t.c_custkey == v.o_custkey) & (v.o_totalprice > 200000)).select("c_custkey", "o_orderkey")


@query("SELECT s_suppkey, n_name FROM (SELECT * FROM supplier WHERE s_acctbal > 5000) RIGHT JOIN nation ON s_nationkey = n_nationkey")
def join_right(spark, db):
    rich = db.table("supplier").filter(lambda r: r.s_acctbal > 5000)
    return rich.join(db.table("nation"), "RIGHT", lambda t, v: t.s_nationkey == v.n_nationkey).select("s_suppkey", "n_name")


@query("SELECT c_custkey, s_suppkey FROM (SELECT * FROM customer WHERE c_acctbal < 0) FULL JOIN (SELECT * FROM supplier WHERE s_acctbal < 2000) ON c_custkey = s_suppkey")
def join_full(spark, db):
    left = db.table("customer").filter(lambda r: r.c_acctbal < 0)
    right = db.table("supplier").filter(lambda r: r.s_acctbal < 2000)
    return left.join(right, "FULL", lambda t, v: t.c_custkey == v.s_suppkey).select("c_custkey", "s_suppkey")


@query("SELECT n.n_name, r.r_regionkey AS reg_r_regionkey, r.r_name AS reg_r_name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey")
def join_prefix(spark, db):
    return db.table("nation").join(db.table("region"), "INNER", lambda t, v: t.n_regionkey == v.reg_r_regionkey, prefix="reg_").select("n_name", "reg_r_regionkey", "reg_r_name")


@query("SELECT s_suppkey, p_partkey FROM supplier JOIN part ON s_suppkey * 4 < p_partkey AND p_size > s_suppkey")
def join_theta(spark, db):
    return db.table("supplier").join(db.table("part"), "INNER", lambda t, v: (t.s_suppkey * 4 < v.p_partkey) & (v.p_size > t.s_suppkey)).select("s_suppkey", "p_partkey")


@query("SELECT a.n_name, b.n_name AS o_n_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_self(spark, db):
    return db.table("nation").join(db.table("nation"), "INNER", lambda t, v: (t.n_regionkey == v.o_n_regionkey) & (t.n_nationkey < v.o_n_nationkey), prefix="o_").select("n_name", "o_n_name")


@query("""SELECT a.k, b.x FROM (SELECT nullif(n_regionkey, 0) AS k FROM nation) a JOIN (SELECT nullif(r_regionkey, 0) AS j, r_name AS x FROM region) b
    ON a.k IS NOT DISTINCT FROM b.j""")
def join_null_safe(spark, db):
    a = db.table("nation").project(k=lambda r: F.nullif(r.n_regionkey, F.lit(0)))
    b = db.table("region").project(j=lambda r: F.nullif(r.r_regionkey, F.lit(0)), x=lambda r: r.r_name)
    return a.join(b, "INNER", lambda t, v: nulls.equal(t.k, v.j)).select("k", "x")


@query("SELECT n_regionkey, r_name FROM (SELECT n_regionkey FROM nation) JOIN (SELECT r_regionkey AS n_regionkey, r_name FROM region) USING (n_regionkey)")
def join_using(spark, db):
    return db.table("nation").select("n_regionkey").join_using(db.table("region").rename(r_regionkey="n_regionkey"), "INNER", "n_regionkey")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
def semi_exists(spark, db):
    return db.table("customer").semi(db.table("orders"), lambda t, v: (t.c_custkey == v.o_custkey) & (v.o_totalprice > 250000)).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_empty(spark, db):
    return db.table("customer").anti(db.table("orders"), lambda t, v: t.c_custkey == v.o_custkey).select("c_custkey")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(spark, db):
    return db.table("region").cross(db.table("nation")).select("r_name", "n_name")


_ASOF = """SELECT l.event_id, l.ts, r.ts AS seen_ts, r.value AS seen_value FROM (SELECT event_id, ts, user_id FROM events WHERE event_type = 'purchase') l
    ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'click' GROUP BY ALL) r ON l.user_id = r.user_id AND l.ts {} r.ts"""


def _asof(db, op, **more):
    left = db.table("events").filter(lambda r: r.event_type == "purchase").select("event_id", "ts", "user_id")
    right = db.table("events").filter(lambda r: r.event_type == "click").group_by(["user_id", "ts"], value=aggs.max_(F.col("value")))
    return left.as_of_join(right, "ts", op, "ts", keys=[("user_id", "user_id")], prefix="seen_", **more).select("event_id", "ts", "seen_ts", "seen_value")


@query(_ASOF.format(">="))
def asof_join(spark, db):
    return _asof(db, ">=")


@query(_ASOF.format(">"))
def asof_join_strict(spark, db):
    return _asof(db, ">")


@query(_ASOF.format("<="))
def asof_join_forward(spark, db):
    return _asof(db, "<=")


@query("""SELECT l.event_id, r.ts AS seen_ts, r.value AS seen_value FROM (SELECT event_id, ts FROM events WHERE event_type = 'purchase') l
    ASOF LEFT JOIN (SELECT ts, max(value) AS value FROM events WHERE event_type = 'click' GROUP BY ts) r ON l.ts >= r.ts""")
def asof_join_no_key(spark, db):
    """Without a key the time line is cut into slots, so that it isn't one task."""
    left = db.table("events").filter(lambda r: r.event_type == "purchase").select("event_id", "ts")
    right = db.table("events").filter(lambda r: r.event_type == "click").group_by(["ts"], value=aggs.max_(F.col("value")))
    return left.as_of_join(right, "ts", ">=", "ts", prefix="seen_", slots=16).select("event_id", "seen_ts", "seen_value")


@query("""SELECT c_custkey, o_orderkey, o_totalprice FROM (SELECT c_custkey, o_orderkey, o_totalprice,
    row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM customer JOIN orders ON o_custkey = c_custkey) WHERE n <= 2""")
def lateral_top(spark, db):
    orders = db.table("orders").select("o_custkey", "o_orderkey", "o_totalprice").top_per(["o_custkey"], 2, descending("o_totalprice"), "o_orderkey")
    return db.table("customer").select("c_custkey").join(orders, "INNER", lambda t, v: t.c_custkey == v.o_custkey).select("c_custkey", "o_orderkey", "o_totalprice")


@query("SELECT r_name, n.n_name FROM region, LATERAL (SELECT n_name FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey > 10) n")
def lateral_join(spark, db):
    nations = db.table("nation").df
    return db.table("region").lateral(lambda outer: nations.where((F.col("n_regionkey") == outer("r_regionkey")) & (F.col("n_nationkey") > 10)).select("n_name")).select("r_name", "n_name")


# set operations


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def concatenate(spark, db):
    return db.table("customer").project(k=lambda r: r.c_nationkey).concatenate(db.table("supplier").project(k=lambda r: r.s_nationkey))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(spark, db):
    return db.table("customer").project(k=lambda r: r.c_nationkey).concatenate(db.table("supplier").project(k=lambda r: r.s_nationkey)).distinct()


@query("SELECT n_nationkey, n_name FROM nation WHERE (n_nationkey, n_name) IN (SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2)")
def tds_contains(spark, db):
    some = db.table("nation").filter(lambda r: r.n_regionkey == 2).select("n_nationkey", "n_name")
    return db.table("nation").select("n_nationkey", "n_name").tds_contains(some, "n_nationkey", "n_name")


# windows


@query("""SELECT o_orderkey, row_number() OVER x AS rn, rank() OVER y AS rk, dense_rank() OVER y AS dr, round(percent_rank() OVER y, 8) AS pr,
    round(cume_dist() OVER y, 8) AS cd, ntile(4) OVER x AS tile FROM orders
    WINDOW x AS (PARTITION BY o_custkey ORDER BY o_orderdate NULLS LAST, o_orderkey NULLS LAST), y AS (PARTITION BY o_custkey ORDER BY o_orderpriority DESC NULLS FIRST)""")
def win_rank(spark, db):
    x, y = w.over("o_custkey", ["o_orderdate", "o_orderkey"]), w.over("o_custkey", [descending("o_orderpriority")])
    rows = db.table("orders").extend_over(x, rn=w.row_number, tile=lambda o: w.ntile(o, 4))
    rows = rows.extend_over(y, rk=w.rank, dr=w.dense_rank, pr=lambda o: _r(w.percent_rank(o), 8), cd=lambda o: _r(w.cumulative_distribution(o), 8))
    return rows.select("o_orderkey", "rn", "rk", "dr", "pr", "cd", "tile")


@query("""SELECT event_id, lag(value) OVER x AS before, lead(value, 2) OVER x AS after, first_value(value) OVER x AS f,
    nth_value(value, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS n2
    FROM events WINDOW x AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def win_lag_lead(spark, db):
    x = w.over("user_id", ["ts", "event_id"])
    whole = w.over("user_id", ["ts", "event_id"], w.rows(w.unbounded(), w.unbounded()))
    rows = db.table("events").extend_over(x, before=lambda o: w.lag(o, "value"), after=lambda o: w.offset(o, "value", 2), f=lambda o: w.first(o, "value"))
    return rows.extend_over(whole, n2=lambda o: w.nth(o, "value", 2)).select("event_id", "before", "after", "f", "n2")


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), 4) AS running, count(*) OVER (PARTITION BY user_id) AS n FROM events")
def win_running(spark, db):
    rows = db.table("events").extend_over(w.over("user_id", ["ts", "event_id"]), running=lambda o: _r(w.reduce(o, F.sum("value"))))
    return rows.extend_over(w.over("user_id"), n=lambda o: w.reduce(o, aggs.count())).select("event_id", "running", "n")


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING), 6) AS near FROM events")
def win_rows_frame(spark, db):
    return db.table("events").extend_over(w.over("user_id", ["ts", "event_id"], w.rows(-3, 1)), near=lambda o: _r(w.reduce(o, F.avg("value")), 6)).select("event_id", "near")


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 2 DAY PRECEDING AND CURRENT ROW), 4) AS recent FROM events")
def win_range_interval(spark, db):
    return db.table("events").extend_over(w.over("user_id", "ts", w.range_(-2, 0, "DAYS")), recent=lambda o: _r(o.apply("sum(value)"))).select("event_id", "recent")


@query("SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near, count(*) OVER (PARTITION BY p_brand ORDER BY CAST(p_size AS DOUBLE) RANGE BETWEEN 0.5 PRECEDING AND 1.5 FOLLOWING) AS half FROM part")
def win_range_number(spark, db):
    rows = db.table("part").extend_over(w.over("p_brand", "p_size", w.range_(-2, 2)), near=lambda o: w.reduce(o, aggs.count()))
    return rows.extend_over(w.over("p_brand", "p_size", w.range_(-0.5, 1.5)), half=lambda o: o.apply("count(*)")).select("p_partkey", "near", "half")


@query("SELECT c_custkey, round((c_acctbal - avg(c_acctbal) OVER x) / greatest(stddev_pop(c_acctbal) OVER x, 1e-10), 6) AS z FROM customer WINDOW x AS (PARTITION BY c_nationkey)")
def win_zscore(spark, db):
    return db.table("customer").extend_over(w.over("c_nationkey"), z=lambda o: _r(w.z_score(o, "c_acctbal"), 6)).select("c_custkey", "z")


@query("SELECT s_suppkey, round(s_acctbal / (SELECT sum(s_acctbal) FROM supplier), 8) AS share FROM supplier")
def extend_total(spark, db):
    rows = db.table("supplier").extend_total(total=F.sum("s_acctbal"))
    return rows.project(s_suppkey=lambda r: r.s_suppkey, share=lambda r: _r(maths.divide(r.s_acctbal, r.total), 8))


@query("SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n = 1")
def win_filter(spark, db):
    return db.table("orders").top_per(["o_custkey"], 1, descending("o_totalprice"), "o_orderkey").select("o_orderkey")


@query("SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) + (count(*) OVER (PARTITION BY p_brand, p_size) - 1) / 2.0 AS mean_rank FROM part")
def win_average_rank(spark, db):
    return db.table("part").extend_over(w.over("p_brand", "p_size"), mean_rank=w.average_rank).select("p_partkey", "mean_rank")


# pivots and lists


@query("""SELECT l_returnflag, round(sum(l_quantity) FILTER (l_linestatus = 'F'), 2) AS "F__|__qty", round(sum(l_quantity) FILTER (l_linestatus = 'O'), 2) AS "O__|__qty"
    FROM lineitem WHERE l_linestatus IN ('F', 'O') GROUP BY l_returnflag""")
def pivot_static(spark, db):
    return db.table("lineitem").select("l_returnflag", "l_linestatus", "l_quantity").pivot(["l_linestatus"], ["F", "O"], using=["l_quantity"], qty=_r(F.sum("l_quantity"), 2))


@query("""SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS "F__|__n", round(max(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS "F__|__top",
    count(*) FILTER (o_orderstatus = 'O') AS "O__|__n", round(max(o_totalprice) FILTER (o_orderstatus = 'O'), 2) AS "O__|__top",
    count(*) FILTER (o_orderstatus = 'P') AS "P__|__n", round(max(o_totalprice) FILTER (o_orderstatus = 'P'), 2) AS "P__|__top" FROM orders GROUP BY o_orderpriority""")
def pivot_dynamic(spark, db):
    rows = db.table("orders").select("o_orderpriority", "o_orderstatus", "o_totalprice")
    out = rows.pivot(["o_orderstatus"], using=["o_totalprice"], n=F.count("o_totalprice"), top=_r(F.max("o_totalprice"), 2))
    return Rel(out.df.fillna(0, [c for c in out.df.columns if c.endswith("__n")]))


@query("""SELECT count(*) FILTER (l_returnflag = 'A' AND l_linestatus = 'F') AS "A__|__F__|__n", count(*) FILTER (l_returnflag = 'N' AND l_linestatus = 'O') AS "N__|__O__|__n" FROM lineitem""")
def pivot_composite(spark, db):
    rows = db.table("lineitem").select("l_returnflag", "l_linestatus", "l_quantity")
    return rows.pivot(["l_returnflag", "l_linestatus"], [("A", "F"), ("N", "O")], using=["l_quantity"], n=F.count("l_quantity"))


@query("SELECT n_regionkey, unnest(string_split(n_name, 'A')) AS part FROM nation")
def flatten_array(spark, db):
    return db.table("nation").project(n_regionkey=lambda r: r.n_regionkey, part=lambda r: strings.split(r.n_name, "A")).flatten("part")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, json_extract(props, '$.none') IS NULL AS missing FROM events")
def variant_get(spark, db):
    return db.table("events").project(
        event_id=lambda r: r.event_id,
        k=lambda r: variant.to(variant.get(variant.from_json(r.props), "k"), "bigint"),
        missing=lambda r: nulls.is_empty(variant.get(variant.from_json(r.props), "none")),
    )


@query("""SELECT l_orderkey, list_sort(list(l_linenumber)) AS numbers FROM lineitem GROUP BY l_orderkey""")
def list_collect(spark, db):
    return Rel(db.table("lineitem").df.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_linenumber")).alias("numbers")))


@query("""WITH t AS (SELECT n_nationkey, CAST(range(n_nationkey + 1) AS BIGINT[]) AS c FROM nation) SELECT n_nationkey,
    CAST(list_sum(list_transform(c, lambda x: x * x)) AS DOUBLE) AS squares, len(list_filter(c, lambda x: x % 2 = 0)) AS evens, c[1:3] AS head3, c[-1] AS last,
    list_position(c, 3) IS NOT NULL AS has3, CAST(coalesce(list_position(c, 5), 0) - 1 AS BIGINT) AS place5, array_to_string(list_transform(c, lambda x: CAST(x AS VARCHAR)), '-') AS joined,
    list_aggregate(c, 'median') AS mid FROM t""")
def list_higher_order(spark, db):
    rows = db.table("nation").project(n_nationkey=lambda r: r.n_nationkey, c=lambda r: lists.range_(r.n_nationkey + 1))
    return rows.project(
        n_nationkey=lambda r: r.n_nationkey,
        squares=lambda r: lists.sum_(lists.map_(r.c, lambda x: x * x)),
        evens=lambda r: lists.size(lists.filter_(r.c, lambda x: x % 2 == 0)),
        head3=lambda r: lists.take(r.c, 3),
        last=lambda r: lists.last(r.c),
        has3=lambda r: lists.contains(r.c, F.lit(3).cast("bigint")),
        place5=lambda r: lists.index_of(r.c, F.lit(5).cast("bigint")),
        joined=lambda r: strings.join_strings(F.transform(r.c, lambda x: x.cast("string")), "-"),
        mid=lambda r: lists.median(r.c),
    )


@query("SELECT n_nationkey, CAST(n_nationkey * 2 AS INTEGER) AS twice, CAST(2 AS BIGINT) AS n_keys, n_name AS name FROM nation")
def map_ops(spark, db):
    m = lambda r: lists.put(F.create_map(F.lit("a"), r.n_nationkey), "b", r.n_nationkey * 2)
    return db.table("nation").project(
        n_nationkey=lambda r: r.n_nationkey,
        twice=lambda r: lists.get(m(r), "b"),
        n_keys=lambda r: lists.size(lists.keys(m(r))),
        name=lambda r: lists.get(lists.new_map(F.array(lists.pair("n", r.n_name))), "n"),
    )


# scalar functions


@query("""SELECT p_partkey, upper(p_name) AS up, length(p_name) AS n, substr(p_name, 3, 4) AS part, instr(p_name, 'a') AS a_at, replace(p_brand, '#', '-') AS brand,
    lpad(CAST(p_size AS VARCHAR), 4, '0') AS padded, split_part(p_type, ' ', 2) AS second, starts_with(p_type, 'PROMO') AS promo, contains(p_name, 'ee') AS has_ee,
    reverse(p_brand) AS back, levenshtein(p_brand, 'Brand#11') AS far, CAST(ascii(p_name) AS BIGINT) AS code, repeat(left(p_brand, 2), 3) AS rep,
    regexp_matches(p_brand, '^(?:Brand#[1-3].)$') AS m, lower(left(p_brand, 1)) || substr(p_brand, 2) AS low, md5(p_name) AS hashed, base64(encode(p_brand)) AS b64 FROM part""")
def string_family(spark, db):
    return db.table("part").project(
        p_partkey=lambda r: r.p_partkey,
        up=lambda r: strings.to_upper(r.p_name),
        n=lambda r: strings.length(r.p_name),
        part=lambda r: strings.substring(r.p_name, 3, 4),
        a_at=lambda r: strings.index_of(r.p_name, "a"),
        brand=lambda r: strings.replace(r.p_brand, "#", "-"),
        padded=lambda r: strings.lpad(r.p_size.cast("string"), 4, "0"),
        second=lambda r: strings.split_part(r.p_type, " ", 1),
        promo=lambda r: strings.starts_with(r.p_type, "PROMO"),
        has_ee=lambda r: strings.contains(r.p_name, "ee"),
        back=lambda r: strings.reverse_string(r.p_brand),
        far=lambda r: strings.levenshtein_distance(r.p_brand, "Brand#11"),
        code=lambda r: strings.ascii_(r.p_name),
        rep=lambda r: strings.repeat_string(strings.left(r.p_brand, 2), 3),
        m=lambda r: strings.matches(r.p_brand, "Brand#[1-3]."),
        low=lambda r: strings.to_lower_first_character(r.p_brand),
        hashed=lambda r: hashing.hash_(r.p_name, "MD5"),
        b64=lambda r: strings.encode_base64(r.p_brand),
    )


@query("""SELECT n_nationkey, round(jaro_winkler_similarity(n_name, 'FRANCE'), 8) AS near FROM nation""")
def string_jaro_winkler(spark, db):
    return db.table("nation").project(n_nationkey=lambda r: r.n_nationkey, near=lambda r: _r(strings.jaro_winkler_similarity(r.n_name, F.lit("FRANCE")), 8))


@query("""SELECT p_partkey, len(regexp_extract_all(p_name, '[aeiou]')) AS vowels, regexp_replace(p_name, '[aeiou]', '_', 'g') AS masked, regexp_replace(p_name, '[aeiou]', '_') AS first_masked,
    regexp_extract_all(p_brand, '[0-9]') AS digits FROM part""")
def regexp_family(spark, db):
    return db.table("part").project(
        p_partkey=lambda r: r.p_partkey,
        vowels=lambda r: strings.regexp_count(r.p_name, "[aeiou]"),
        masked=lambda r: strings.regexp_replace(r.p_name, "[aeiou]", "_"),
        first_masked=lambda r: strings.regexp_replace(r.p_name, "[aeiou]", "_", replace_all=False),
        digits=lambda r: strings.regexp_extract(r.p_brand, "[0-9]", True),
    )


@query("""SELECT l_orderkey, l_linenumber, CAST(ceil(l_extendedprice) AS BIGINT) AS up, CAST(floor(l_extendedprice) AS BIGINT) AS down, round(sqrt(l_quantity), 8) AS root,
    round(ln(l_extendedprice), 8) AS log, round(exp(l_discount), 8) AS e, round(pow(l_quantity, 2), 4) AS squared, ((l_linenumber % -3) + -3) % -3 AS m, l_linenumber % 3 AS r,
    round(l_quantity / l_linenumber, 8) AS ratio, CAST(sign(l_discount - 0.05) AS BIGINT) AS s, l_linenumber & 3 AS b, xor(l_linenumber, 5) AS x, round(sin(l_tax), 8) AS sine,
    round(degrees(l_tax), 6) AS deg, greatest(l_tax, l_discount) AS top, CAST(round_even(l_quantity / 4, 0) AS BIGINT) AS even FROM lineitem""")
def math_family(spark, db):
    return db.table("lineitem").project(
        l_orderkey=lambda r: r.l_orderkey,
        l_linenumber=lambda r: r.l_linenumber,
        up=lambda r: maths.ceiling(r.l_extendedprice),
        down=lambda r: maths.floor(r.l_extendedprice),
        root=lambda r: _r(maths.sqrt(r.l_quantity), 8),
        log=lambda r: _r(maths.log(r.l_extendedprice), 8),
        e=lambda r: _r(maths.exp(r.l_discount), 8),
        squared=lambda r: _r(maths.pow_(r.l_quantity, 2)),
        m=lambda r: maths.mod(r.l_linenumber, F.lit(-3)),
        r=lambda r: r.l_linenumber % 3,
        ratio=lambda r: _r(maths.divide(r.l_quantity, r.l_linenumber), 8),
        s=lambda r: maths.sign(r.l_discount - 0.05),
        b=lambda r: maths.bit_and(r.l_linenumber, F.lit(3)),
        x=lambda r: maths.bit_xor(r.l_linenumber, F.lit(5)),
        sine=lambda r: _r(maths.sin(r.l_tax), 8),
        deg=lambda r: _r(maths.to_degrees(r.l_tax), 6),
        top=lambda r: maths.max_(r.l_tax, r.l_discount),
        even=lambda r: maths.round_(r.l_quantity / 4),
    )


@query("""SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, monthname(o_orderdate) AS mname, dayname(o_orderdate) AS dname,
    quarter(o_orderdate) AS q, isodow(o_orderdate) AS dow, dayofyear(o_orderdate) AS doy, week(o_orderdate) AS wk,
    CAST(date_trunc('month', o_orderdate) AS DATE) AS month_start, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter_start, CAST(date_trunc('week', o_orderdate) AS DATE) AS week_start,
    CAST(o_orderdate + INTERVAL 3 MONTH AS TIMESTAMP) AS later, strftime(o_orderdate, '%Y/%m/%d') AS shown FROM orders""")
def date_family(spark, db):
    d = lambda f: lambda r: f(r.o_orderdate)
    return db.table("orders").project(
        o_orderkey=lambda r: r.o_orderkey,
        y=d(dates.year),
        m=d(dates.month_number),
        mname=d(dates.month),
        dname=d(dates.day_of_week),
        q=d(dates.quarter_number),
        dow=d(dates.day_of_week_number),
        doy=d(dates.day_of_year),
        wk=d(dates.week_of_year),
        month_start=d(dates.first_day_of_month),
        quarter_start=d(dates.first_day_of_quarter),
        week_start=d(dates.first_day_of_week),
        later=lambda r: dates.adjust(r.o_orderdate, 3, "MONTHS"),
        shown=lambda r: dates.format_date(r.o_orderdate, "yyyy/MM/dd"),
    )


@query("""SELECT l_orderkey, l_linenumber, date_diff('year', o_orderdate, l_shipdate) AS years, date_diff('month', o_orderdate, l_shipdate) AS months, date_diff('day', o_orderdate, l_shipdate) AS days,
    CAST(date_sub('hour', o_orderdate, l_shipdate) AS BIGINT) AS hours, CAST(date_sub('minute', l_shipdate, o_orderdate) AS BIGINT) AS back_minutes
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def date_diff_family(spark, db):
    rows = db.table("lineitem").join(db.table("orders"), "INNER", lambda t, v: t.l_orderkey == v.o_orderkey)
    gap = lambda unit: lambda r: dates.date_diff(r.o_orderdate, r.l_shipdate, unit)
    return rows.project(
        l_orderkey=lambda r: r.l_orderkey,
        l_linenumber=lambda r: r.l_linenumber,
        years=gap("YEARS"),
        months=gap("MONTHS"),
        days=gap("DAYS"),
        hours=gap("HOURS"),
        back_minutes=lambda r: dates.date_diff(r.l_shipdate, r.o_orderdate, "MINUTES"),
    )


@query("""SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS six_hours, time_bucket(INTERVAL 2 WEEK, ts, TIMESTAMP '1969-12-29') AS two_weeks,
    time_bucket(INTERVAL 5 MONTH, ts, TIMESTAMP '1970-01-01') AS five_months, count(*) AS n FROM events GROUP BY ALL""")
def time_bucket(spark, db):
    return db.table("events").group_by_functions(
        {
            "six_hours": lambda r: dates.time_bucket(r.ts, 6, "HOURS"),
            "two_weeks": lambda r: dates.time_bucket(r.ts, 2, "WEEKS"),
            "five_months": lambda r: dates.time_bucket(r.ts, 5, "MONTHS"),
        },
        n=aggs.count(),
    )


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'open' ELSE 'other' END AS state FROM orders")
def case_if(spark, db):
    return db.table("orders").project(o_orderkey=lambda r: r.o_orderkey, state=lambda r: nulls.match(r.o_orderstatus, (r.o_orderstatus == "F", "done"), (r.o_orderstatus == "O", "open"), default="other"))


@query("""SELECT n_nationkey, CAST(list_reduce(list_prepend(0, [n_nationkey, n_regionkey]), lambda a, x: a * 10 + x) AS INTEGER) AS folded, list_reverse([n_nationkey, n_regionkey]) AS back,
    list_sort([n_nationkey, n_regionkey]) AS up, list_concat([n_nationkey], [n_regionkey]) AS both, list_distinct([n_regionkey, n_regionkey]) AS once,
    n_nationkey > n_regionkey AS every, list_sort([n_nationkey, n_regionkey])[-1] AS top FROM nation""")
def list_family(spark, db):
    c = lambda r: lists.list_(r.n_nationkey, r.n_regionkey)
    return db.table("nation").project(
        n_nationkey=lambda r: r.n_nationkey,
        folded=lambda r: lists.fold(c(r), lambda x, acc: acc * 10 + x, F.lit(0)),
        back=lambda r: lists.reverse(c(r)),
        up=lambda r: lists.sort(c(r)),
        both=lambda r: lists.concatenate(F.array(r.n_nationkey), F.array(r.n_regionkey)),
        once=lambda r: lists.distinct(F.array(r.n_regionkey, r.n_regionkey)),
        every=lambda r: lists.for_all(F.array(r.n_nationkey), lambda x: x > r.n_regionkey),
        top=lambda r: lists.greatest(c(r)),
    )


@query("""SELECT vec_id, CAST(list_sum(embedding) AS DOUBLE) IS NOT NULL AS some, len(embedding) AS n, round(list_max(embedding)::DOUBLE, 6) AS top, CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS at
    FROM embeddings""")
def list_statistics(spark, db):
    return db.table("embeddings").project(
        vec_id=lambda r: r.vec_id,
        some=lambda r: lists.sum_(r.embedding).isNotNull(),
        n=lambda r: lists.size(r.embedding),
        top=lambda r: _r(lists.greatest(r.embedding).cast("double"), 6),
        at=lambda r: lists.index_of(r.embedding, lists.greatest(r.embedding)),
    )


@query("""SELECT c_custkey, 'Customer ' || c_custkey || ': ' || printf('%.2f', c_acctbal) AS shown, sha256(c_name) AS hashed, upper(left(c_name, 1)) || substr(c_name, 2) AS first_up,
    CAST(replace(substr(c_name, -4), '#', '0') AS BIGINT) AS parsed FROM customer""")
def format_and_parse(spark, db):
    return db.table("customer").project(
        c_custkey=lambda r: r.c_custkey,
        shown=lambda r: strings.format_("Customer %s: %.2f", r.c_custkey, r.c_acctbal),
        hashed=lambda r: hashing.hash_(r.c_name, "SHA256"),
        first_up=lambda r: strings.to_upper_first_character(r.c_name),
        parsed=lambda r: strings.parse_integer(strings.replace(strings.right(r.c_name, 4), "#", "0")),
    )


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) = DATE '1996-01-02' AS on_day, o_orderdate >= TIMESTAMP '1997-01-01' AS after, CAST(epoch(o_orderdate) AS BIGINT) AS epoch,
    date_trunc('day', o_orderdate) AS midnight, CAST(date_trunc('year', o_orderdate) AS DATE) AS year_start, CAST(o_orderdate AS DATE) - CAST(isodow(o_orderdate) - 1 AS INTEGER) AS monday,
    strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000+0000') AS iso FROM orders""")
def date_boundaries(spark, db):
    d = lambda f, *a: lambda r: f(*a, r.o_orderdate)
    return db.table("orders").project(
        o_orderkey=lambda r: r.o_orderkey,
        on_day=lambda r: dates.is_on_day(r.o_orderdate, F.lit("1996-01-02")),
        after=lambda r: dates.is_on_or_after_day(r.o_orderdate, F.lit("1997-01-01")),
        epoch=d(dates.to_epoch_value),
        midnight=d(dates.first_hour_of_day),
        year_start=d(dates.first_day_of_year),
        monday=d(dates.most_recent_day_of_week, "Monday"),
        iso=lambda r: strings.to_string(dates.first_millisecond_of_second(r.o_orderdate), "datetime"),
    )


@query("""SELECT event_id, CAST(CAST(json_extract(props, '$.k') AS BIGINT) * 2 AS BIGINT) AS twice FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) > 50""")
def variant_filter(spark, db):
    rows = db.table("events").project(event_id=lambda r: r.event_id, k=lambda r: variant.to(variant.get(variant.from_json(r.props), "k"), "bigint"))
    return rows.filter(lambda r: nulls.greater_than(r.k, 50)).project(event_id=lambda r: r.event_id, twice=lambda r: r.k * 2)


# classes


def star(db) -> Model:
    """The star tables as classes."""
    m = Model(db)
    m.add_class("Region", name="String")
    m.add_class("Nation", name="String")
    customer = m.add_class("Customer", name="String", balance="Float", segment="String")
    customer.constraints = {"positiveBalance": lambda r: r.balance >= 0, "named": lambda r: F.length(r.name) > 0}
    m.add_class("Order", status="String", price="Float")
    m.map("Region", Mapping("region", {"name": "r_name"}, {"id": "r_regionkey"}))
    m.map("Nation", Mapping("nation", {"name": "n_name"}, {"id": "n_nationkey", "region": "n_regionkey"}))
    m.map("Customer", Mapping("customer", {"id": "c_custkey", "name": "c_name", "balance": "c_acctbal", "segment": "c_mktsegment"}, {"nation": "c_nationkey"}))
    statuses = {"DONE": ["F"], "ACTIVE": ["O", "P"]}
    m.map("Order", Mapping("orders", {"id": "o_orderkey", "price": "o_totalprice", "status": "o_orderstatus", "date": "o_orderdate"}, {"customer": "o_custkey"}, enums={"status": statuses}))
    m.associate("Nation", "region", "Region", False, [("$region", "$id")], back="nations")
    m.associate("Customer", "nation", "Nation", False, [("$nation", "$id")], back="customers")
    m.associate("Order", "customer", "Customer", False, [("$customer", "id")], back="orders")
    return m


@query("SELECT o_orderkey AS id, c_name AS customer, n_name AS nation, r_name AS region FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey")
def nav_to_one(spark, db):
    return star(db).all("Order").project(id="id", customer="customer.name", nation="customer.nation.name", region="customer.nation.region.name")


@query("SELECT c_custkey AS id, o_totalprice AS price FROM customer LEFT JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING'")
def nav_to_many(spark, db):
    return star(db).all("Customer").filter(lambda c: c.at("segment") == "BUILDING").project(id="id", price="orders.price")


@query("SELECT c_custkey AS id FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 280000) AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def nav_exists(spark, db):
    rich = star(db).all("Customer").exists("orders", lambda o: o.at("price") > 280000)
    return rich.filter(lambda c: c.at("nation.$region") == 1, "nation.$region").project(id="id")


@query("SELECT c_custkey AS id, coalesce(n, 0) AS n, top FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) ON o_custkey = c_custkey")
def nav_aggregate(spark, db):
    done = lambda o: o.at("status") == "DONE"
    c = star(db).all("Customer").with_aggregate("n", "orders", lambda o: F.count("id"), done, default=0).with_aggregate("top", "orders", lambda o: F.max("price"), done)
    return Rel(c.df).select("id", "n", "top")


@query("SELECT r_name AS region, round(sum(c_acctbal), 2) AS balance FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def nav_group_by(spark, db):
    return star(db).all("Customer").group_by({"region": "nation.region.name"}, balance=("balance", lambda c: _r(F.sum(c), 2)))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus IN ('F') THEN 'DONE' WHEN o_orderstatus IN ('O', 'P') THEN 'ACTIVE' END AS status FROM orders")
def enum_mapping(spark, db):
    return star(db).all("Order").project(id="id", status="status")


@query("""SELECT r_name AS name, coalesce((SELECT list_sort(list({'name': n_name})) FROM nation WHERE n_regionkey = r_regionkey), []) AS nations FROM region""")
def graph_fetch(spark, db):
    return graph.graph_fetch(star(db).all("Region"), {"name": None, "nations": {"name": None}})


@query("""SELECT '{"id":' || c_custkey || ',"name":"' || c_name || '","nation":{"name":"' || n_name || '"}}' AS json FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def graph_serialize(spark, db):
    return graph.serialize(graph.graph_fetch(star(db).all("Customer"), {"id": None, "name": None, "nation": {"name": None}}))


@query("SELECT c_custkey AS id FROM customer WHERE NOT (c_acctbal >= 0)")
def constraint_violations(spark, db):
    return Rel(star(db).violations("Customer")).filter(lambda r: F.array_contains(r.defects, "positiveBalance")).select("id")


@query("SELECT 'C-' || c_custkey AS code, upper(c_mktsegment) AS segment, CASE WHEN c_acctbal > 5000 THEN 'gold' ELSE 'plain' END AS tier FROM customer WHERE c_acctbal > 0")
def m2m_chain(spark, db):
    m = star(db)
    m.add_class("Account", code="String", segment="String", amount="Float")
    m.add_class("Client", code="String", segment="String", tier="String")
    m.map("Account", Mapping(("class", "Customer"), {"code": lambda r: F.concat(F.lit("C-"), r.id.cast("string")), "segment": "segment", "amount": "balance"}, filter=lambda r: r.balance > 0))
    m.map("Client", Mapping(("class", "Account"), {"code": "code", "segment": lambda r: strings.to_upper(r.segment), "tier": lambda r: nulls.if_(r.amount > 5000, "gold", "plain")}))
    return m.all("Client").project(code="code", segment="segment", tier="tier")


@query("SELECT c_name AS name, c_acctbal AS balance, 'Buyer' AS kind, c_mktsegment AS segment FROM customer UNION ALL SELECT s_name, s_acctbal, 'Seller', NULL FROM supplier")
def union_mapping(spark, db):
    m = Model(db)
    m.add_class("Party", name="String", balance="Float")
    m.map("Party", Mapping("customer", {"name": "c_name", "balance": "c_acctbal", "segment": "c_mktsegment"}, sub_class="Buyer"))
    m.map("Party", Mapping("supplier", {"name": "s_name", "balance": "s_acctbal"}, sub_class="Seller"))
    return m.all("Party").project(name="name", balance="balance", kind="$class", segment="segment")


@query("SELECT DISTINCT l_suppkey AS supplier, l_returnflag AS flag FROM lineitem WHERE l_quantity > 45")
def mapping_filter_distinct(spark, db):
    m = Model(db)
    m.add_class("Seller", supplier="Integer", flag="String")
    m.map("Seller", Mapping("lineitem", {"supplier": "l_suppkey", "flag": "l_returnflag"}, filter=lambda r: r.l_quantity > 45, distinct=True))
    return m.all("Seller").project(supplier="supplier", flag="flag")


@query("SELECT o_custkey AS customer, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey")
def mapping_group_by(spark, db):
    m = Model(db)
    m.add_class("Sales", customer="Integer", total="Float")
    m.map("Sales", Mapping("orders", {"customer": "o_custkey", "total": lambda r: _r(F.sum(r.o_totalprice), 2)}, group_by=["o_custkey"]))
    return Rel(m.all("Sales").df.select("customer", "total"))


@query("SELECT n_name AS name, count(*) AS customers FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_name")
def database_view(spark, db):
    def build(d):
        joined = d.table("nation").join(d.table("customer"), "INNER", lambda t, v: t.n_nationkey == v.c_nationkey)
        return joined.rename(n_name="name").group_by(["name"], customers=aggs.count())

    db.add_view("nation_customers", build)
    return db.table("nation_customers")


def _versions(db) -> Model:
    """Orders as versions: an order's row holds from its date until the customer's next order."""

    def versions(d):
        x = w.over("o_custkey", ["o_orderdate", "o_orderkey"])
        end = lambda o: F.coalesce(w.lead(o, "o_orderdate"), F.lit(dt.datetime(9999, 12, 31)).cast("timestamp_ntz"))
        return d.table("orders").extend_over(x, thru=end)

    m = star(db)
    m.add_class("Version", id="Integer").temporal = "business"
    m.map("Version", Mapping(versions, {"id": "o_orderkey"}, {"customer": "o_custkey"}, business=Temporal("o_orderdate", "thru", infinity=dt.datetime(9999, 12, 31))))
    return m


_VERSIONS = "WITH v AS (SELECT *, coalesce(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey), TIMESTAMP '9999-12-31') AS thru FROM orders) "


@query(_VERSIONS + "SELECT o_orderkey AS id FROM v WHERE o_orderdate <= TIMESTAMP '1996-06-30' AND thru > TIMESTAMP '1996-06-30'")
def milestone_asof(spark, db):
    return _versions(db).all("Version", dt.datetime(1996, 6, 30)).project(id="id")


@query(_VERSIONS + "SELECT o_orderkey AS id FROM v WHERE thru = TIMESTAMP '9999-12-31'")
def milestone_latest(spark, db):
    return _versions(db).all("Version", "%latest").project(id="id")


@query(_VERSIONS + "SELECT o_orderkey AS id FROM v WHERE o_orderdate <= TIMESTAMP '1995-12-31' AND thru > TIMESTAMP '1995-01-01'")
def milestone_range(spark, db):
    return _versions(db).all_versions_in_range("Version", dt.datetime(1995, 1, 1), dt.datetime(1995, 12, 31)).project(id="id")


@query("""SELECT CAST(sum(CASE WHEN year(o_orderdate) = 1996 AND dayofyear(o_orderdate) <= dayofyear(DATE '1996-08-15') THEN 1 ELSE 0 END) AS DOUBLE) AS ytd,
    CAST(sum(CASE WHEN year(o_orderdate) = 1996 AND month(o_orderdate) = 8 AND day(o_orderdate) <= 15 THEN 1 ELSE 0 END) AS DOUBLE) AS mtd,
    CAST(sum(CASE WHEN year(o_orderdate) = 1995 THEN 1 ELSE 0 END) AS DOUBLE) AS prior_year,
    CAST(sum(CASE WHEN o_orderdate::DATE > DATE '1995-08-15' AND o_orderdate::DATE <= DATE '1996-08-15' THEN 1 ELSE 0 END) AS DOUBLE) AS p12mtd FROM orders""")
def calendar_ytd(spark, db):
    calendar = calendars.plain_calendar(spark, dt.date(1990, 1, 1), dt.date(2026, 12, 31))
    df = calendars.with_calendar(db.table("orders").df, calendar, F.col("o_orderdate"), F.lit(dt.date(1996, 8, 15)))
    total = lambda name: F.coalesce(F.sum(calendars.value(name, F.lit(1))), F.lit(0.0))
    return df.agg(total("ytd").alias("ytd"), total("mtd").alias("mtd"), total("priorYear").alias("prior_year"), total("p12mtd").alias("p12mtd"))


@query("""SELECT c_custkey AS id, n_name AS nation, coalesce(list_sort(list({'id': o_orderkey, 'price': o_totalprice}) FILTER (o_orderkey IS NOT NULL)), []) AS orders
    FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL""")
def graph_fetch_nested(spark, db):
    tree = graph.graph_fetch(star(db).all("Customer"), {"id": None, "nation": {"name": None}, "orders": {"id": None, "price": None}})
    return tree.select("id", F.col("nation.name").alias("nation"), "orders")


@query("SELECT c_name AS name, CASE WHEN c_acctbal < 0 THEN ['positiveBalance'] ELSE [] END AS defects FROM customer")
def graph_fetch_checked(spark, db):
    return graph.graph_fetch_checked(star(db).all("Customer"), {"name": None}).select(F.col("value.name").alias("name"), "defects")


@query("SELECT n_name AS name, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE')")
def nav_filter_to_one(spark, db):
    return star(db).all("Nation").filter(lambda n: nulls.in_(n.at("region.name"), ["ASIA", "EUROPE"]), "region.name").project(name="name", region="region.name")


@query("SELECT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 290000)")
def nav_is_empty(spark, db):
    return star(db).all("Customer").exists("orders", lambda o: o.at("price") > 290000, negate=True).project(id="id")


@query("SELECT r_name AS name, count(c_custkey) AS customers FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY r_name")
def nav_count_two_steps(spark, db):
    return star(db).all("Region").group_by({"name": "name"}, customers=("nations.customers.id", F.count))


@query("SELECT s_name AS name, n_name AS nation, 'Seller' AS kind FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT c_name, n_name, 'Buyer' FROM customer JOIN nation ON c_nationkey = n_nationkey")
def inheritance_extent(spark, db):
    """A class without a mapping is the union of its subclasses, and its own associations hold for all of them."""
    m = star(db)
    m.add_class("Party", name="String")
    m.add_class("Buyer", name="String").supers = ("Party",)
    m.add_class("Seller", name="String").supers = ("Party",)
    m.map("Buyer", Mapping("customer", {"name": "c_name"}, {"nation": "c_nationkey"}))
    m.map("Seller", Mapping("supplier", {"name": "s_name"}, {"nation": "s_nationkey"}))
    m.associate("Party", "nation", "Nation", False, [("$nation", "$id")])
    return m.all("Party").project(name="name", nation="nation.name", kind="$class")


@query("SELECT s_suppkey AS id, coalesce(CASE WHEN s_acctbal > 5000 THEN 'rich' END, n_name) AS label FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def embedded_otherwise(spark, db):
    m = star(db)
    m.add_class("Seller", id="Integer")
    m.map("Seller", Mapping("supplier", {"id": "s_suppkey", "own": lambda r: F.when(r.s_acctbal > 5000, "rich")}, {"nation": "s_nationkey"}))
    m.associate("Seller", "nation", "Nation", False, [("$nation", "$id")])
    sellers = m.all("Seller").navigate("nation")
    return sellers.project(id="id", label=lambda s: s.otherwise("own", "nation.name"))


@query(_VERSIONS + """SELECT CAST(d AS TIMESTAMP) AS d, o_orderkey AS id FROM v, (VALUES (DATE '1995-03-01'), (DATE '1997-03-01')) t(d) WHERE o_orderdate <= d AND thru > d""")
def milestone_each_date(spark, db):
    return _versions(db).all_for_each_date("Version", [dt.datetime(1995, 3, 1), dt.datetime(1997, 3, 1)]).select(F.col("`$date`").alias("d"), "id")


@query("SELECT o_orderkey AS id FROM orders WHERE CAST(o_orderdate AS DATE) = DATE '1995-06-14'")
def milestone_snapshot(spark, db):
    m = Model(db)
    m.add_class("Snap", id="Integer").temporal = "business"
    m.map("Snap", Mapping(lambda d: d.table("orders").extend(day=lambda r: dates.date_part(r.o_orderdate)), {"id": "o_orderkey"}, business=Temporal(snapshot="day")))
    return m.all("Snap", dt.datetime(1995, 6, 14)).project(id="id")


@query("""SELECT l_orderkey AS k, l_linenumber AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    WHERE l_shipdate > TIMESTAMP '1995-01-01' AND l_shipdate <= TIMESTAMP '1996-01-01' AND o_orderdate <= TIMESTAMP '1995-06-01' AND l_shipdate + INTERVAL 1 YEAR > TIMESTAMP '1995-06-01'""")
def milestone_bitemporal(spark, db):
    def versions(d):
        rows = d.table("lineitem").join(d.table("orders"), "INNER", lambda t, v: t.l_orderkey == v.o_orderkey)
        return rows.filter(lambda r: r.l_shipdate > F.lit(dt.datetime(1995, 1, 1)).cast("timestamp_ntz")).extend(gone=lambda r: dates.adjust(r.l_shipdate, 1, "YEARS"), far=lambda r: F.lit(dt.datetime(9999, 12, 31)).cast("timestamp_ntz"))

    m = Model(db)
    m.add_class("Line", k="Integer").temporal = "bitemporal"
    m.map("Line", Mapping(versions, {"k": "l_orderkey", "n": "l_linenumber"}, processing=Temporal("l_shipdate", "far"), business=Temporal("o_orderdate", "gone")))
    return m.all("Line", dt.datetime(1996, 1, 1), dt.datetime(1995, 6, 1)).project(k="k", n="n")


_CALENDAR_SQL = """WITH o AS (SELECT CAST(o_orderdate AS DATE) AS d FROM orders), e AS (SELECT DATE '1996-08-15' AS e)
    SELECT CAST(count(*) FILTER (year(d) = 1995 AND dayofyear(d) <= dayofyear(e)) AS DOUBLE) AS pytd,
    CAST(count(*) FILTER (year(d) = 1996 AND quarter(d) = 3 AND d <= e) AS DOUBLE) AS qtd,
    CAST(count(*) FILTER (d >= e - 28 AND d <= e) AS DOUBLE) / 4 AS p4wa,
    CAST(count(*) FILTER (date_trunc('week', d) = date_trunc('week', e)) AS DOUBLE) AS cw,
    CAST(count(*) FILTER (date_trunc('week', d) = date_trunc('week', e) - INTERVAL 7 DAY) AS DOUBLE) AS pw,
    CAST(count(*) FILTER (year(d) = 1996 AND month(d) = 7 AND day(d) <= 15) AS DOUBLE) AS pmtd,
    CAST(count(*) FILTER (year(d) = 1995 AND month(d) = 8 AND day(d) <= 15) AS DOUBLE) AS pymtd,
    CAST(count(*) FILTER (year(d) = 1994) AS DOUBLE) AS CYMinus2,
    CAST(count(*) FILTER (d = e - 1) AS DOUBLE) AS priorDay,
    round(CAST(count(*) FILTER (year(d) = 1996) AS DOUBLE) / (dayofyear(e) / 366.0), 6) AS annualized,
    round(CAST(count(*) FILTER (year(d) = 1996 AND month(d) <= 7) AS DOUBLE) / 7, 6) AS pma FROM o, e GROUP BY e"""


@query(_CALENDAR_SQL)
def calendar_functions(spark, db):
    calendar = calendars.plain_calendar(spark, dt.date(1990, 1, 1), dt.date(2026, 12, 31))
    df = calendars.with_calendar(db.table("orders").df, calendar, F.col("o_orderdate"), F.lit(dt.date(1996, 8, 15)))
    names = ["pytd", "qtd", "p4wa", "cw", "pw", "pmtd", "pymtd", "CYMinus2", "priorDay", "annualized", "pma"]
    return df.agg(*(_r(F.coalesce(F.sum(calendars.value(n, F.lit(1))), F.lit(0.0)), 6).alias(n) for n in names))


@query("""SELECT p_partkey AS id, {'brand': p_brand, 'size': {'number': p_size}} AS item, {'text': p_type} AS kind FROM part""")
def graph_embedded(spark, db):
    """Embedded children: one from the mapping's own columns, one inlined from another class's mapping."""
    m = Model(db)
    m.add_class("Part", id="Integer")
    kind = Mapping("part", {"text": "p_type"})
    m.map("Part", Mapping("part", {"id": "p_partkey", "item.brand": "p_brand", "item.size.number": "p_size", **embed("kind", kind)}))
    return graph.graph_fetch(m.all("Part"), {"id": None, "item": {"brand": None, "size": {"number": None}}, "kind": {"text": None}})


@query("SELECT r_name AS name, coalesce(list_sort(list(n_name)), []) AS nations FROM region LEFT JOIN nation ON n_regionkey = r_regionkey GROUP BY ALL")
def graph_value_list(spark, db):
    """A list of plain values, which live in another table."""
    m = star(db)
    m.associate("Region", "names", "Nation", True, [("$id", "$region")], value="name")
    return graph.graph_fetch(m.all("Region"), {"name": None, "names": None}).withColumnRenamed("names", "nations")


@query("SELECT c_name AS name, c_mktsegment AS segment, NULL::DOUBLE AS balance FROM customer UNION ALL SELECT s_name, NULL, s_acctbal FROM supplier")
def graph_sub_types(spark, db):
    m = Model(db)
    m.add_class("Party", name="String")
    m.add_class("Client", segment="String").supers = ("Party",)
    m.add_class("Vendor", balance="Float").supers = ("Party",)
    m.map("Client", Mapping("customer", {"name": "c_name", "segment": "c_mktsegment"}))
    m.map("Vendor", Mapping("supplier", {"name": "s_name", "balance": "s_acctbal"}))
    return graph.graph_fetch(m.all("Party"), {"name": None, "@Client": {"segment": None}, "@Vendor": {"balance": None}})


@query("SELECT c_name AS name, c_acctbal AS balance, upper(c_mktsegment) AS segment FROM customer WHERE c_acctbal > 0")
def mapping_extends(spark, db):
    m = Model(db)
    m.add_class("Client", name="String")
    base = Mapping("customer", {"name": "c_name", "segment": "c_mktsegment"}, filter=lambda r: r.c_acctbal > 0)
    m.map("Client", extend(base, properties={"balance": "c_acctbal", "segment": lambda r: strings.to_upper(r.c_mktsegment)}))
    return m.all("Client").project(name="name", balance="balance", segment="segment")


# sources


@query("SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'a, b', 1.5::DOUBLE), (2, NULL, 2.0), (3, 'c', NULL)) t(id, name, x)")
def tds_literal(spark, db):
    return readers.tds(spark, "#TDS\n id:Integer, name:String, x:Float\n 1, 'a, b', 1.5\n 2, null, 2.0\n 3, c, \n#")


@query("SELECT * FROM (VALUES ('Ann', CAST(31 AS BIGINT)), ('Bob', NULL)) t(name, age)")
def source_url_json(spark, db):
    rel = readers.source_url(spark, 'data:application/json,[{"name": "Ann", "age": 31}, {"name": "Bob"}]')
    return readers.json_properties(rel, name="string", age="bigint")


@query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def sql_relation(spark, db):
    return readers.execute_in_db(spark, "SELECT n_regionkey, count(*) AS n FROM {nation} GROUP BY n_regionkey", nation=db.table("nation").df)


# queries as text


@query("SELECT o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders WHERE o_totalprice > 50000 AND o_orderstatus <> 'P' GROUP BY o_custkey")
def text_group_by(spark, db):
    return Engine(Model(db)).run("#>{db.orders}#->filter(x|$x.o_totalprice > 50000 && $x.o_orderstatus != 'P')->groupBy(~[o_custkey], ~[n: x|$x : y|$y->count(), top: x|$x.o_totalprice : y|$y->max()])")


@query("SELECT c_custkey, upper(c_mktsegment) AS segment, CASE WHEN c_acctbal > 0 THEN 'in' ELSE 'out' END AS side FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment LIKE 'B%'")
def text_join(spark, db):
    return Engine(Model(db)).run("""#>{db.customer}#->join(#>{db.nation}#, JoinKind.INNER, {t,v|$t.c_nationkey == $v.n_nationkey})
        ->filter(x|$x.c_mktsegment->startsWith('B'))->project(~[c_custkey: x|$x.c_custkey, segment: x|$x.c_mktsegment->toUpper(), side: x|if($x.c_acctbal > 0, |'in', |'out')])""")


@query("SELECT o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS FIRST) AS r, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS FIRST ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) > 300000 AS big FROM orders")
def text_window(spark, db):
    return Engine(Model(db)).run("""#>{db.orders}#->extend(over(~o_custkey, ~o_totalprice->descending()), ~r: {p,w,r|$p->rank($w, $r)})
        ->extend(over(~o_custkey, ~o_totalprice->descending(), rows(-1, 0)), ~s: {p,w,r|$r.o_totalprice} : y|$y->sum())->project(~[o_orderkey: x|$x.o_orderkey, r: x|$x.r, big: x|$x.s > 300000])""")


@query("SELECT o_orderkey AS id, c_name AS customer, n_name AS nation FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'")
def text_navigation(spark, db):
    return Engine(star(db)).run("Order.all()->filter(o|$o.customer.nation.region.name == 'ASIA')->project(~[id: o|$o.id, customer: o|$o.customer.name, nation: o|$o.customer.nation.name])")


@query("SELECT o_custkey, round(quantile_cont(o_totalprice, 0.5), 4) AS mid, quantile_disc(o_totalprice, 0.25) AS low FROM orders WHERE o_totalprice > 1000 GROUP BY o_custkey")
def text_let_percentile(spark, db):
    return Engine(Model(db)).run("""let least = 1000; let some = #>{db.orders}#->filter(x|$x.o_totalprice > $least);
        $some->groupBy(~[o_custkey], ~[mid: x|$x.o_totalprice : y|$y->percentile(0.5), low: x|$x.o_totalprice : y|$y->percentile(0.25, true, false)])
        ->project(~[o_custkey: x|$x.o_custkey, mid: x|$x.mid->round(4), low: x|$x.low])""")


@query("SELECT r_name, n_name FROM region, LATERAL (SELECT n_name FROM nation WHERE n_regionkey = r_regionkey AND n_nationkey > 10) n")
def text_lateral(spark, db):
    return Engine(Model(db)).run("#>{db.region}#->lateral({r|#>{db.nation}#->filter(n|$n.n_regionkey == $r.r_regionkey && $n.n_nationkey > 10)->select(~n_name)})->select(~[r_name, n_name])")


@query("""SELECT '{"id":' || c_custkey || ',"name":"' || c_name || '","nation":{"name":"' || n_name || '"}}' AS json FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING'""")
def text_graph_fetch(spark, db):
    return Engine(star(db)).run("Customer.all()->filter(c|$c.segment == 'BUILDING')->graphFetch(#{Customer{id, name, nation{name}}}#)->serialize(#{Customer{id, name, nation{name}}}#)")


@query("SELECT c_custkey AS id, c_name AS name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5 OFFSET 2")
def text_class_sort(spark, db):
    return Engine(star(db)).run("Customer.all()->sortBy(c|$c.id)->sortByReversed(c|$c.balance)->slice(2, 7)->project(~[id: c|$c.id, name: c|$c.name])")


@query("SELECT n_nationkey, n_nationkey * 10 + 1 AS k FROM nation ORDER BY n_name DESC LIMIT 4")
def text_eval_sort_by(spark, db):
    return Engine(Model(db)).run("let f = {n|$n * 10 + 1}; #>{db.nation}#->sortByReversed(x|$x.n_name)->limit(4)->project(~[n_nationkey: x|$x.n_nationkey, k: x|$f->eval($x.n_nationkey)])")


# every other function of a family


@query("""SELECT event_id, day(ts) AS dom, hour(ts) AS h, minute(ts) AS mi, CAST(second(ts) AS BIGINT) AS s, year(ts) AS y, monthname(ts) AS mname, quarter(ts) AS q, week(ts) AS wk,
    dayofyear(ts) AS doy, dayname(ts) AS dname, isodow(ts) AS dow, month(ts) AS mnum, CAST(ts AS DATE) AS whole_day, date_trunc('day', ts) AS day_start, date_trunc('hour', ts) AS hour_start,
    date_trunc('minute', ts) AS minute_start, date_trunc('second', ts) AS second_start, CAST(date_trunc('year', ts) AS DATE) AS year_start, CAST(date_trunc('quarter', ts) AS DATE) AS quarter_start,
    CAST(date_trunc('month', ts) AS DATE) AS month_start, CAST(date_trunc('week', ts) AS DATE) AS week_start FROM events""")
def date_parts(spark, db):
    return db.table("events").project(
        event_id=lambda r: r.event_id,
        dom=lambda r: dates.day_of_month(r.ts),
        h=lambda r: dates.hour(r.ts),
        mi=lambda r: dates.minute(r.ts),
        s=lambda r: dates.second(r.ts),
        y=lambda r: dates.year(r.ts),
        mname=lambda r: dates.month(r.ts),
        q=lambda r: dates.quarter(r.ts),
        wk=lambda r: dates.week_of_year(r.ts),
        doy=lambda r: dates.day_of_year(r.ts),
        dname=lambda r: dates.day_of_week(r.ts),
        dow=lambda r: dates.day_of_week_number(r.ts),
        mnum=lambda r: dates.month_number(r.ts),
        whole_day=lambda r: dates.date_part(r.ts),
        day_start=lambda r: dates.first_hour_of_day(r.ts),
        hour_start=lambda r: dates.first_minute_of_hour(r.ts),
        minute_start=lambda r: dates.first_second_of_minute(r.ts),
        second_start=lambda r: dates.first_millisecond_of_second(r.ts),
        year_start=lambda r: dates.first_day_of_year(r.ts),
        quarter_start=lambda r: dates.first_day_of_quarter(r.ts),
        month_start=lambda r: dates.first_day_of_month(r.ts),
        week_start=lambda r: dates.first_day_of_week(r.ts),
    )


@query("""SELECT o_orderkey, d = DATE '1996-07-01' AS on_day, d > DATE '1996-07-01' AS after_day, d < DATE '1996-07-01' AS before_day, d >= DATE '1996-07-01' AS from_day, d <= DATE '1996-07-01' AS to_day,
    d - CAST((isodow(d) + 2) % 7 AS INTEGER) AS friday, d - CAST((isodow(d) + 1) % 7 + 1 AS INTEGER) AS friday_before, CAST(floor(epoch(o_orderdate)) AS BIGINT) AS epoch,
    CAST(epoch_ms(o_orderdate) AS BIGINT) AS epoch_ms, date_trunc('second', o_orderdate) AS back, year(d) * 4 + quarter(d) AS quarters, quarter(d) AS q2,
    CAST(o_orderdate + INTERVAL 90 MINUTE AS TIMESTAMP) AS later, greatest(d, DATE '1996-01-01') AS latest, least(d, DATE '1996-01-01') AS earliest
    FROM (SELECT *, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def date_compare(spark, db):
    day = F.lit(dt.date(1996, 7, 1))
    return db.table("orders").project(
        o_orderkey=lambda r: r.o_orderkey,
        on_day=lambda r: dates.is_on_day(r.o_orderdate, day),
        after_day=lambda r: dates.is_after_day(r.o_orderdate, day),
        before_day=lambda r: dates.is_before_day(r.o_orderdate, day),
        from_day=lambda r: dates.is_on_or_after_day(r.o_orderdate, day),
        to_day=lambda r: dates.is_on_or_before_day(r.o_orderdate, day),
        friday=lambda r: dates.most_recent_day_of_week("Friday", r.o_orderdate),
        friday_before=lambda r: dates.previous_day_of_week("Friday", r.o_orderdate),
        epoch=lambda r: dates.to_epoch_value(r.o_orderdate),
        epoch_ms=lambda r: dates.to_epoch_value(r.o_orderdate, "MILLISECONDS"),
        back=lambda r: dates.from_epoch_value(dates.to_epoch_value(r.o_orderdate)),
        quarters=lambda r: dates.year(r.o_orderdate) * 4 + dates.quarter_number(r.o_orderdate),
        q2=lambda r: dates.quarter(r.o_orderdate),
        later=lambda r: dates.adjust_temporal(r.o_orderdate, 90, "MINUTES"),
        latest=lambda r: dates.max_(dates.date_part(r.o_orderdate), F.lit(dt.date(1996, 1, 1))),
        earliest=lambda r: dates.min_(dates.date_part(r.o_orderdate), F.lit(dt.date(1996, 1, 1))),
    )


@query("""SELECT CAST(date_trunc('year', current_date) AS DATE) AS this_year, CAST(date_trunc('quarter', current_date) AS DATE) AS this_quarter, CAST(date_trunc('month', current_date) AS DATE) AS this_month,
    current_date > DATE '2020-01-01' AS is_today, TRUE AS is_now, TRUE AS with_month, FALSE AS with_day, TRUE AS with_hour, TRUE AS with_minute, FALSE AS with_second, TRUE AS with_subsecond, FALSE AS precise,
    DATE '2021-03-04' AS made, TIMESTAMP '2021-03-04 05:06:00' AS made_time, '2021-03' AS partial, '2021/03/04' AS shown, DATE '2021-03-04' AS read_date,
    TIMESTAMP '2021-03-04 05:06:07' AS read_time, TIMESTAMP '2021-03-04 05:06:07' AS read_format, '2021-03-04 00:06' AS in_zone, TIMESTAMP '2021-03-04 05:06:07' AS parsed, CAST(1 AS BIGINT) AS n""")
def date_constants(spark, db):
    lit = dates.DateLiteral
    made = dates.date(2021, 3, 4, 5, 6)
    return db.table("region").aggregate(n=F.count_if(F.col("r_regionkey") == 0)).project(
        n=lambda r: r.n,
        this_year=lambda r: dates.first_day_of_this_year(),
        this_quarter=lambda r: dates.first_day_of_this_quarter(),
        this_month=lambda r: dates.first_day_of_this_month(),
        is_today=lambda r: dates.today() > F.lit(dt.date(2020, 1, 1)),
        is_now=lambda r: dates.now() > F.lit(dt.datetime(2020, 1, 1)).cast("timestamp_ntz"),
        with_month=lambda r: dates.has_month(lit("%2021-03")),
        with_day=lambda r: dates.has_day(lit("%2021-03")),
        with_hour=lambda r: dates.has_hour(lit("%2021-03-04T05")),
        with_minute=lambda r: dates.has_minute(lit("%2021-03-04T05:06")),
        with_second=lambda r: dates.has_second(lit("%2021-03-04T05:06")),
        with_subsecond=lambda r: dates.has_subsecond(lit("%2021-03-04T05:06:07.123")),
        precise=lambda r: dates.has_subsecond_with_at_least_precision(lit("%2021-03-04T05:06:07.123"), 4),
        made=lambda r: dates.date(2021, 3, 4),
        made_time=lambda r: made,
        partial=lambda r: dates.date(2021, 3),
        shown=lambda r: dates.format_date(made, "yyyy/MM/dd"),
        read_date=lambda r: dates.convert_date_format(F.lit("2021-03-04")),
        read_time=lambda r: dates.convert_date_time_format(F.lit("2021-03-04 05:06:07")),
        read_format=lambda r: dates.parse_date_format(F.lit("04.03.2021 05:06:07"), "dd.MM.yyyy HH:mm:ss"),
        in_zone=lambda r: dates.convert_time_zone_format(made, "America/New_York", "yyyy-MM-dd HH:mm"),
        parsed=lambda r: strings.parse_date(F.lit("2021-03-04T05:06:07")),
    )


@query("""SELECT l_orderkey, l_linenumber, abs(l_discount - 0.05) AS a, round(acos(l_tax), 8) AS ac, round(asin(l_tax), 8) AS asn, round(atan(l_tax), 8) AS at, round(atan2(l_tax, l_quantity), 8) AS at2,
    round(cbrt(l_quantity), 8) AS cb, round(cos(l_tax), 8) AS co, round(cosh(l_tax), 8) AS ch, round(cot(l_quantity), 6) AS ct, round(sinh(l_tax), 8) AS sh, round(tan(l_tax), 8) AS tn, round(tanh(l_tax), 8) AS th,
    round(log10(l_quantity), 8) AS lg, round(pi(), 8) AS p, round(radians(l_quantity), 8) AS rad, l_linenumber | 8 AS bo, ~l_linenumber AS bn, CAST(l_linenumber AS BIGINT) << 3 AS bl, CAST(l_linenumber AS BIGINT) >> 1 AS br,
    l_linenumber % 3 AS rm, l_quantity + l_tax + 1 AS pl, l_quantity - l_tax AS mi, -l_quantity AS neg, l_quantity * 2 * l_linenumber AS ti, CAST(l_linenumber AS DOUBLE) AS fl, l_linenumber - 1 AS sb,
    CAST(l_linenumber AS DECIMAL(38,0)) = l_linenumber AS de, least(l_tax, l_discount) AS low, round(l_quantity / 8, 3) AS dr FROM lineitem""")
def math_more(spark, db):
    return db.table("lineitem").project(
        l_orderkey=lambda r: r.l_orderkey,
        l_linenumber=lambda r: r.l_linenumber,
        a=lambda r: maths.abs_(r.l_discount - 0.05),
        ac=lambda r: _r(maths.acos(r.l_tax), 8),
        asn=lambda r: _r(maths.asin(r.l_tax), 8),
        at=lambda r: _r(maths.atan(r.l_tax), 8),
        at2=lambda r: _r(maths.atan2(r.l_tax, r.l_quantity), 8),
        cb=lambda r: _r(maths.cbrt(r.l_quantity), 8),
        co=lambda r: _r(maths.cos(r.l_tax), 8),
        ch=lambda r: _r(maths.cosh(r.l_tax), 8),
        ct=lambda r: _r(maths.cot(r.l_quantity), 6),
        sh=lambda r: _r(maths.sinh(r.l_tax), 8),
        tn=lambda r: _r(maths.tan(r.l_tax), 8),
        th=lambda r: _r(maths.tanh(r.l_tax), 8),
        lg=lambda r: _r(maths.log10(r.l_quantity), 8),
        p=lambda r: _r(maths.pi(), 8),
        rad=lambda r: _r(maths.to_radians(r.l_quantity), 8),
        bo=lambda r: maths.bit_or(r.l_linenumber, F.lit(8)),
        bn=lambda r: maths.bit_not(r.l_linenumber),
        bl=lambda r: maths.bit_shift_left(r.l_linenumber, 3),
        br=lambda r: maths.bit_shift_right(r.l_linenumber, 1),
        rm=lambda r: maths.rem(r.l_linenumber, 3).cast("int"),
        pl=lambda r: maths.plus(r.l_quantity, r.l_tax, 1),
        mi=lambda r: maths.minus(r.l_quantity, r.l_tax),
        neg=lambda r: maths.minus(r.l_quantity),
        ti=lambda r: maths.times(r.l_quantity, 2, r.l_linenumber),
        fl=lambda r: maths.to_float(r.l_linenumber),
        sb=lambda r: maths.sub(r.l_linenumber, 1),
        de=lambda r: maths.to_decimal(r.l_linenumber, True) == r.l_linenumber,
        low=lambda r: maths.min_(r.l_tax, r.l_discount),
        dr=lambda r: maths.divide_round(r.l_quantity, 8, 3),
    )


@query("""SELECT p_partkey, lower(p_name) AS low, trim('  ' || p_brand || ' ') AS t, ltrim('  ' || p_brand) AS lt, rtrim(p_brand || '  ') AS rt, rpad(p_brand, 12, '*') AS rp, ends_with(p_brand, '1') AS ends,
    CAST(from_base64(base64(encode(p_brand))) AS VARCHAR) AS decoded, chr(65 + p_size % 26) AS c, p_brand = 'Brand#11' AS b, CAST(p_size AS DOUBLE) / 2 AS f, CAST(p_size || '.25' AS DECIMAL(5,2)) AS de,
    regexp_matches(p_name, '[aeiou]{2}') AS two, CAST(instr(p_brand, '#') - 1 AS BIGINT) AS place, '''' || p_brand || '''' AS shown, '[' || p_brand || ',' || p_size || ']' AS listed,
    upper(p_brand) = lower(p_brand) AS numeric, right(p_brand, 2) AS tail, left(p_name, 3) AS head, ['Brand', substr(p_brand, 6)] AS pieces, CAST(3 AS BIGINT) AS n_chunks, TRUE AS guid FROM part""")
def string_more(spark, db):
    return db.table("part").project(
        p_partkey=lambda r: r.p_partkey,
        low=lambda r: strings.to_lower(r.p_name),
        t=lambda r: strings.trim(F.concat(F.lit("  "), r.p_brand, F.lit(" "))),
        lt=lambda r: strings.ltrim(F.concat(F.lit("  "), r.p_brand)),
        rt=lambda r: strings.rtrim(F.concat(r.p_brand, F.lit("  "))),
        rp=lambda r: strings.rpad(r.p_brand, 12, "*"),
        ends=lambda r: strings.ends_with(r.p_brand, "1"),
        decoded=lambda r: strings.decode_base64(strings.encode_base64(r.p_brand)),
        c=lambda r: strings.char(r.p_size % 26 + 65),
        b=lambda r: strings.parse_boolean((r.p_brand == "Brand#11").cast("string")),
        f=lambda r: strings.parse_float(r.p_size.cast("string")) / 2,
        de=lambda r: strings.parse_decimal(F.concat(r.p_size.cast("string"), F.lit(".25D"))),
        two=lambda r: strings.regexp_like(r.p_name, "[aeiou]{2}"),
        place=lambda r: strings.regexp_index_of(r.p_brand, "#"),
        shown=lambda r: strings.to_representation(r.p_brand),
        listed=lambda r: strings.make_string(F.array(r.p_brand, r.p_size.cast("string")), "[", ",", "]"),
        numeric=lambda r: strings.is_numeric(r.p_brand),
        tail=lambda r: strings.right(r.p_brand, 2),
        head=lambda r: strings.left(r.p_name, 3),
        pieces=lambda r: F.transform(strings.split(r.p_brand, "#"), lambda x, i: F.when(i == 0, x).otherwise(F.concat(F.lit("#"), x))),
        n_chunks=lambda r: lists.size(strings.chunk(F.left(r.p_brand, F.lit(8)), 3)),
        guid=lambda r: strings.length(strings.generate_guid()) == 36,
    )


@query("""WITH t AS (SELECT n_nationkey, [n_nationkey, n_regionkey, 7] AS c FROM nation) SELECT n_nationkey, list_concat(c, [9]) AS added, c[1:2] AS init, c[2:] AS tail, c[1] AS head, c[3:] AS dropped, c[2:2] AS sliced,
    list_distinct([c[1], c[1]]) AS once, list_filter(c, lambda x: x <> 7) AS without, c[1] AS found, [c[1] % 2 = 0] AS evens, CAST(list_min(c) AS INTEGER) AS least, list_contains(c, 3) AS has3,
    c[1] > 2 OR c[2] > 2 AS some, c[1] > 2 AND c[2] > 2 AS every, len(list_distinct(c)) = 3 AS different, list_reverse(list_sort(c)) AS down, [c[1]] AS firsts, CAST(n_nationkey AS INTEGER) AS val, n_nationkey * 3 AS put_all,
    CAST(3 AS BIGINT) AS n, FALSE AS nothing, TRUE AS something, CAST(7 AS INTEGER) AS unique_value, list_avg([CAST(c[1] AS DOUBLE), CAST(c[2] AS DOUBLE)]) AS mean, list_max(c) AS top FROM t""")
def list_more(spark, db):
    rows = db.table("nation").project(n_nationkey=lambda r: r.n_nationkey, c=lambda r: lists.list_(r.n_nationkey, r.n_regionkey, 7))
    two = lambda r: F.slice(r.c, 1, 2)
    m = lambda r: lists.put_all(F.create_map(F.lit("a"), r.n_nationkey), F.array(lists.pair("b", r.n_nationkey * 3)))
    return rows.project(
        n_nationkey=lambda r: r.n_nationkey,
        added=lambda r: lists.add(r.c, F.lit(9)),
        init=lambda r: lists.init(r.c),
        tail=lambda r: lists.tail(r.c),
        head=lambda r: lists.head(r.c),
        dropped=lambda r: lists.drop(r.c, 2),
        sliced=lambda r: lists.slice_(r.c, 1, 2),
        once=lambda r: lists.remove_duplicates(F.array(lists.at(r.c, 0), lists.first(r.c))),
        without=lambda r: lists.remove_all_optimized(r.c, F.array(F.lit(7))),
        found=lambda r: lists.find(r.c, lambda x: x == r.n_nationkey),
        evens=lambda r: lists.map_(lists.limit(r.c, 1), lambda x: x % 2 == 0),
        least=lambda r: lists.least(r.c),
        has3=lambda r: lists.contains(r.c, lambda x: x == 3),
        some=lambda r: lists.or_(F.transform(two(r), lambda x: x > 2)),
        every=lambda r: lists.and_(F.transform(two(r), lambda x: x > 2)),
        different=lambda r: lists.is_distinct(r.c),
        down=lambda r: lists.sort_by_reversed(r.c, lambda x: x),
        firsts=lambda r: F.transform(lists.zip_(r.c, F.array(F.lit("x"))), lambda p: p["first"]),
        val=lambda r: lists.first(lists.values(lists.new_map(F.array(lists.pair("k", r.n_nationkey))))),
        put_all=lambda r: lists.get(m(r), "b"),
        n=lambda r: lists.count(r.c),
        nothing=lambda r: lists.is_empty(r.c),
        something=lambda r: lists.is_not_empty(r.c),
        unique_value=lambda r: lists.unique_value_only(F.array(F.lit(7), F.lit(7))),
        mean=lambda r: lists.average(two(r)),
        top=lambda r: lists.max_(r.c),
    )


@query("""SELECT p_partkey, p_size = 5 AS eq, p_size = 5 AS same, p_size >= 25 AS ge, p_size < 25 AS lt, p_size <= 25 AS le, p_size > 25 AS gt, NOT (p_size > 25) AS neg, p_name IS NOT NULL AS there, p_name IS NULL AS missing,
    (p_size > 25) <> (p_size < 40) AS one_of, p_size <> 5 AS ne, p_size AS one, coalesce(nullif(p_brand, 'Brand#11'), 'none') AS some, [p_size] AS many, p_size AS trusted, p_name AS evaluated, 'RED' AS red, TRUE AS yes, FALSE AS no,
    CAST(NULL AS INTEGER) AS nothing, TRUE AS someone FROM part""")
def null_and_flow(spark, db):
    return db.table("part").project(
        p_partkey=lambda r: r.p_partkey,
        eq=lambda r: nulls.eq(r.p_size, 5),
        same=lambda r: nulls.is_(r.p_size, 5),
        ge=lambda r: nulls.greater_than_equal(r.p_size, 25),
        lt=lambda r: nulls.less_than(r.p_size, 25),
        le=lambda r: nulls.less_than_equal(r.p_size, 25),
        gt=lambda r: nulls.greater_than(r.p_size, 25),
        neg=lambda r: nulls.not_(r.p_size > 25),
        there=lambda r: nulls.is_not_empty(r.p_name),
        missing=lambda r: nulls.is_empty(r.p_name),
        one_of=lambda r: nulls.xor(r.p_size > 25, r.p_size < 40),
        ne=lambda r: nulls.not_equal_ansi(r.p_size, 5),
        one=lambda r: nulls.to_one(r.p_size),
        some=lambda r: nulls.coalesce(F.nullif(r.p_brand, F.lit("Brand#11")), "none"),
        many=lambda r: nulls.to_one_many(F.array(r.p_size)),
        trusted=lambda r: nulls.trust_one(r.p_size),
        evaluated=lambda r: nulls.evaluate_and_deactivate(r.p_name),
        red=lambda r: nulls.extract_enum_value("RED", ["RED", "BLUE"]),
        yes=lambda r: nulls.sql_true(),
        no=lambda r: nulls.sql_false(),
        nothing=lambda r: nulls.sql_null().cast("int"),
        someone=lambda r: strings.length(nulls.current_user_id()) > 0,
    )


@query("""SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sds, round(var_samp(l_quantity), 4) AS vs, round(var_pop(l_quantity), 4) AS vp, CAST(sum(l_linenumber) AS BIGINT) AS total,
    round(sum(l_tax * l_quantity) / sum(l_quantity), 8) AS w, min(l_linenumber) AS low, count(*) > 0 AS hashed, round(avg(l_quantity), 4) AS mean, count(*) AS rows FROM lineitem GROUP BY l_returnflag""")
def agg_more(spark, db):
    q = F.col("l_quantity")
    return db.table("lineitem").group_by(
        ["l_returnflag"],
        sds=_r(aggs.std_dev_sample(q), 6),
        vs=_r(aggs.variance_sample(q)),
        vp=_r(aggs.variance_population(q)),
        total=aggs.plus(F.col("l_linenumber")),
        w=_r(aggs.wavg(F.col("l_tax"), q), 8),
        low=aggs.min_(F.col("l_linenumber")),
        hashed=aggs.hash_code(F.col("l_orderkey")).isNotNull(),
        mean=_r(aggs.average(q)),
        rows=aggs.size(),
    )


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, [CAST(json_extract(props, '$.k') AS BIGINT), 1] AS many, event_type AS kind FROM events""")
def variant_more(spark, db):
    made = lambda r: variant.to_variant(F.array(variant.to(variant.get(variant.from_json(r.props), "k"), "bigint"), F.lit(1).cast("bigint")))
    return db.table("events").project(
        event_id=lambda r: r.event_id,
        k=lambda r: variant.to(variant.get(made(r), 0), "bigint"),
        many=lambda r: variant.to_many(made(r), "bigint"),
        kind=lambda r: variant.to(variant.to_variant(r.event_type), "string"),
    )


_CALENDAR_REST = """WITH o AS (SELECT CAST(o_orderdate AS DATE) AS d FROM orders), e AS (SELECT DATE '1996-08-15' AS e),
    t AS (SELECT d, e, floor((dayofyear(d) - 1) / 7) + 1 AS wd, floor((dayofyear(e) - 1) / 7) + 1 AS we FROM o, e)
    SELECT count(*) FILTER (d = e)::DOUBLE AS "reportEndDay", count(*) FILTER (year(d) = 1996 AND wd = we AND d <= e)::DOUBLE AS wtd,
    count(*) FILTER (year(d) = 1996 AND month(d) = 8 AND d <= e)::DOUBLE AS mtd, count(*) FILTER (date_trunc('week', d) = date_trunc('week', e))::DOUBLE AS cw_fm,
    count(*) FILTER (date_trunc('week', d) = date_trunc('week', e) - INTERVAL 7 DAY)::DOUBLE AS pw_fm,
    count(*) FILTER (date_trunc('week', d) = date_trunc('week', e) - INTERVAL 7 DAY AND isodow(d) <= isodow(e))::DOUBLE AS pwtd,
    count(*) FILTER (year(d) = 1996 AND quarter(d) = 2 AND d - DATE '1996-04-01' <= e - DATE '1996-07-01')::DOUBLE AS pqtd,
    count(*) FILTER (year(d) = 1995 AND wd = we AND isodow(d) <= isodow(e))::DOUBLE AS pywtd,
    count(*) FILTER (year(d) = 1995 AND quarter(d) = 3 AND d - DATE '1995-07-01' <= e - DATE '1996-07-01')::DOUBLE AS pyqtd,
    count(*) FILTER (year(d) = 1995)::DOUBLE AS "priorYear", count(*) FILTER (year(d) = 1993)::DOUBLE AS "CYMinus3",
    count(*) FILTER (d >= e - 28 AND d <= e)::DOUBLE AS p4wtd, count(*) FILTER (d >= e - 84 AND d <= e)::DOUBLE AS p12wtd, count(*) FILTER (d >= e - 364 AND d <= e)::DOUBLE AS p52wtd,
    round(count(*) FILTER (d >= e - 84 AND d <= e) / 12, 6) AS p12wa, round(count(*) FILTER (d >= e - 364 AND d <= e) / 52, 6) AS p52wa,
    count(*) FILTER (d > e - INTERVAL 12 MONTH AND d <= e)::DOUBLE AS p12mtd, round(count(*) FILTER (year(d) = 1996 AND month(d) = 8) / (dayofyear(max(e)) / 31), 6) AS cme,
    round(count(*) FILTER (year(d) = 1996 AND dayofyear(d) <= dayofyear(e) - isodow(e)) / (dayofyear(max(e)) - isodow(max(e))) * 5, 6) AS pwa, 0.0::DOUBLE AS pywa,
    count(*) FILTER (year(d) = 1996 AND d <= e)::DOUBLE AS ytd FROM t"""


@query(_CALENDAR_REST)
def calendar_rest(spark, db):
    calendar = calendars.plain_calendar(spark, dt.date(1990, 1, 1), dt.date(2026, 12, 31))
    df = calendars.with_calendar(db.table("orders").df, calendar, F.col("o_orderdate"), F.lit(dt.date(1996, 8, 15)))
    names = "reportEndDay wtd mtd cw_fm pw_fm pwtd pqtd pywtd pyqtd priorYear CYMinus3 p4wtd p12wtd p52wtd p12wa p52wa p12mtd cme pwa pywa ytd".split()
    return df.agg(*(_r(F.coalesce(F.sum(calendars.value(n, F.lit(1))), F.lit(0.0)), 6).alias(n) for n in names))


@query("""SELECT c_custkey, first_value(c_acctbal) OVER x AS f, last_value(c_acctbal) OVER (PARTITION BY c_nationkey ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l,
    lead(c_acctbal) OVER x AS after, dense_rank() OVER x AS d, round(percent_rank() OVER x, 8) AS p, round(cume_dist() OVER x, 8) AS cd FROM customer WINDOW x AS (PARTITION BY c_nationkey ORDER BY c_custkey)""")
def win_more(spark, db):
    x = w.over("c_nationkey", "c_custkey")
    whole = w.over("c_nationkey", "c_custkey", w.rows(w.unbounded(), w.unbounded()))
    rows = db.table("customer").extend_over(x, f=lambda o: w.first(o, "c_acctbal"), after=lambda o: w.lead(o, "c_acctbal"), d=lambda o: w.dense_rank(o), p=lambda o: _r(w.percent_rank(o), 8), cd=lambda o: _r(w.cumulative_distribution(o), 8))
    return rows.extend_over(whole, l=lambda o: w.last(o, "c_acctbal")).select("c_custkey", "f", "l", "after", "d", "p", "cd")


@query("SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 1")
def relation_first(spark, db):
    return db.table("customer").sort(descending("c_acctbal"), ascending("c_custkey")).first().select("c_custkey")


@query("SELECT c_custkey, c_name FROM customer ORDER BY -c_custkey LIMIT 7")
def relation_sort_by(spark, db):
    return db.table("customer").sort_by_reversed(lambda r: r.c_custkey).head().concatenate(db.table("customer").sort_by(lambda r: -r.c_custkey).slice(1, 7)).select("c_custkey", "c_name")


# extension: event time


@query("""SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total
    FROM events GROUP BY ALL""")
def tumbling_window(spark, db):
    return streams.tumbling(db.table("events").df, "ts", "1 hour", ["event_type"], n=F.count(F.lit(1)), total=_r(F.sum("value")))


@query("""WITH t AS (SELECT *, CASE WHEN ts - lag(ts) OVER x < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW x AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM t)
    SELECT min(ts) AS window_start, max(ts) + INTERVAL 30 MINUTE AS window_end, user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def session_window(spark, db):
    return streams.sessions(db.table("events").df, "ts", "30 minutes", ["user_id"], n=F.count(F.lit(1)))
