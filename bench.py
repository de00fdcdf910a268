"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = os.path.dirname(os.path.abspath(__file__)) + os.pathsep + os.environ.get("PYTHONPATH", "")

HEADLINE = (
    "kw_search_papers", "kw_search_literature", "rag_format_context", "tier_search_ligands", "agg_tf_postings",
    "sim_minmax_topk", "knn_embedding", "cosine_std", "forward_network", "backward_network", "cross_network",
    "agg_class_compare", "agg_merge_pages", "jaccard_pairs", "seg_paragraphs", "chunk_text", "stream_sessions", "resolve_name",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from scholia.queries import QUERIES

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds, cold = {}, {}
    for name in HEADLINE:
        for kept in (cold, seconds):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            kept[name] = round(time.perf_counter() - began, 3)
    out = {"metric": "headline_total_warm", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "cold": cold, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus)}
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
