"""Headline queries, one JSON line. BENCH_SF_DIR names the tables, BENCH_CPUS the local cores."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from canvass.queries import QUERIES  # noqa: E402
from canvass.session import build_session  # noqa: E402

HEADLINES = (
    "flt01", "agg01", "agg02", "agg03", "agg04", "agg06", "agg07", "agg09", "agg14", "agg16", "agg17", "agg20",
    "agg27", "src04", "src05", "src15", "rte01", "rte03", "rte06", "tgt01", "tgt04", "tgt07", "tgt08", "scl03",
    "scl14", "win04", "cmp02", "cmp04", "gen04", "sel01", "sel03", "rep01",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/region.parquet").count()  # start the executors before timing
    times: dict[str, float] = {}
    for name in only or HEADLINES:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
