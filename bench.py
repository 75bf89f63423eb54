"""Time the headline queries: one JSON line of seconds per query."""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINE = [
    "bm25_topk", "bm25_cascade", "hybrid_score", "query_nodes_filter", "query_edges_filter", "index_status", "avg_confidence", "resolve_refs", "shared_types", "structural_diff",
    "pagerank_k", "impact_bfs", "simple_paths", "range_merge", "budget_allocation", "memory_search", "anti_patterns", "session_summary", "html_extract", "env_scan", "skeletons",
]


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    own = tempfile.mkdtemp(prefix="bench-")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", f"file://{own}/shared").config("spark.sql.warehouse.dir", f"{own}/warehouse").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from ctxgraph.queries import QUERIES

    spark.range(1000).selectExpr("sum(id)").collect()  # start the executor threads
    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    shutil.rmtree(own, ignore_errors=True)
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": folder.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
