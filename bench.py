"""Times the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_WARM (default 10).  The mapped graph is stored
before the clock starts, as a build step; each query runs once cold (parse, plan, execute, all rows to a sink), and then
BENCH_WARM times more, of which the median is given.
"""

from __future__ import annotations

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession

from sparkweave import catalog
from sparkweave.engine import Engine

HEADLINE = ("scan_s_by_po", "scan_so_by_p", "scan_so", "join_star3", "join_chain", "join_tree", "join_cycle", "join_unknown_pred", "filter_reaches", "dup_count", "group_union_join", "group_optional", "stats_sp", "limit_n", "upd_rename_o")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    began = time.time()
    Engine.from_tables(spark, sf_dir)
    load = time.time() - began

    def timed(name: str) -> float:
        began = time.time()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.time() - began, 3)

    seconds = {name: timed(name) for name in HEADLINE}
    times = int(os.environ.get("BENCH_WARM", "10"))
    warm = {name: median(timed(name) for _ in range(times)) for name in HEADLINE} if times else {}
    rows = {name: catalog.QUERIES[name](spark, sf_dir).count() for name in HEADLINE}
    print(json.dumps({"metric": "graph queries, total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "warm_median": warm, "rows": rows, "load_sec": round(load, 3), "spark": spark.version, "cores": cpus, "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"), "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
