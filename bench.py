"""Headline queries, timed: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma-separated).
"""

from __future__ import annotations

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

HEADLINE = [
    "b02_enqueue_documents",
    "b13_purge_document",
    "c01_chunk_by_tokens",
    "c02_collapse_chunks",
    "c03_chunk_markdown",
    "c05_scan_chunks",
    "c07_scan_summary",
    "d08_render_card",
    "e06_merge_edges",
    "f03_edge_degree",
    "f06_ego_nodes",
    "f14_connected_components",
    "f16_graph_parity",
    "g07_match_aliases",
    "g12_vector_top_k",
    "g18_bm25_top_k",
    "h05_render_transcript",
    "i07_normalize_results",
    "i20_validate_transitions",
    "j01_stream_ingest",
]


def main() -> None:
    from corpusloom import cases
    from corpusloom.plans.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(cpus, "bench", int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    cases.load_all()
    # one small job, so that the first query does not pay for starting the executor
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for name in names:
        start = time.perf_counter()
        cases.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
