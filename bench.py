"""One JSON line: seconds for each headline query, on local[$BENCH_CPUS] over $BENCH_SF_DIR, and DuckDB's for its SQL."""

from __future__ import annotations

import json
import os
import statistics
import time

import duckdb

from plumbline.queries import TABLES, oracle_sql, queries
from plumbline.session import session

HEADLINE = [
    "pricing_summary", "filter_where", "project_expr", "group_by_basic", "agg_stats", "agg_percentile", "join_inner", "join_left", "semi_exists",
    "asof_join", "asof_join_no_key", "lateral_top", "win_rank", "win_rows_frame", "win_range_interval", "win_zscore", "pivot_dynamic", "variant_get",
    "string_family", "math_family", "date_family", "date_diff_family", "time_bucket", "nav_to_one", "nav_aggregate", "graph_serialize", "m2m_chain",
    "milestone_asof", "calendar_ytd", "session_window",
]


def median(run, runs: int) -> float:
    """Of warm runs: the first one compiles and is left out."""
    times = []
    for _ in range(1 + runs):
        began = time.perf_counter()
        run()
        times.append(time.perf_counter() - began)
    return round(statistics.median(times[1:]), 4)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "5"))
    spark = session("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    found, sql = queries(), oracle_sql()
    took = {name: median(lambda name=name: found[name](spark, sf_dir).write.format("noop").mode("overwrite").save(), runs) for name in HEADLINE}
    spark.stop()
    # the same files, as many threads, into a table
    con = duckdb.connect(config={"threads": int(cpus)})
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    duck = {name: median(lambda name=name: con.execute(f"CREATE OR REPLACE TEMP TABLE result AS {sql[name]}"), runs) for name in HEADLINE}
    print(
        json.dumps(
            {
                "metric": "headline queries, median of warm runs, summed", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
                "sf": os.path.basename(sf_dir.rstrip("/")), "runs": runs, "duckdb_value": round(sum(duck.values()), 3), "duckdb": duck,
            }
        )
    )


if __name__ == "__main__":
    main()
