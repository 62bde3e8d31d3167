"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the data and the cores. Every query runs to the end into a
no-op sink; streaming queries run when they are built, so building counts as well. A table that is
one small file is one task to Spark; the tables are first copied as one part file a core, as tables
of any size are stored, and that is not timed.
"""

from __future__ import annotations

import json
import os
import sys
import time

from foliomill.plans.catalog import CATALOG
from foliomill.session import session
from foliomill.sources import tables, workspace

HEADLINE = (
    "quality_report", "clean_corpus", "clean_stats_report", "html_to_markdown", "convert_corpus",
    "detect_format", "route_files", "pdf_flavour", "quality_warnings", "heading_outline",
    "job_status", "job_detail", "list_jobs", "job_card", "bundle_names", "file_state",
    "time_limit_breaches", "counter_drift", "unreferenced_outputs", "stream_clean",
    "stream_job_status",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(
        "bench", f"local[{cpus}]", spark__ui__enabled="false", spark__driver__memory="16g",
        spark__sql__shuffle__partitions=cpus,
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1_000_000).selectExpr("sum(id)").collect()
    parted = workspace.fresh(spark, "bench")
    for name in ("documents", "pages", "events", "orders", "lineitem"):
        tables.read(spark, folder, name).repartition(int(cpus)).write.parquet(f"{parted}/{name}.parquet")
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        started = time.perf_counter()
        CATALOG[name](spark, parted).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - started, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
