"""Time the headline queries: prints one JSON line.

``BENCH_SF_DIR`` (default /root/testdata/sf0.1) and ``BENCH_CPUS`` (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import time

from clausework.plans import REGISTRY
from clausework.session import build_session

HEADLINE = (
    "multigram_index",
    "bm25_score",
    "two_stage_lexical",
    "dense_exact_knn",
    "rrf_fuse",
    "head_admission",
    "hash_vectors",
    "structural_units",
    "leaf_derivation",
    "finding_rules",
    "contains_gold",
    "allowlist_decision",
    "quota_ledger",
    "usage_summary",
    "gap_completion",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus))
    spark.read.parquet(f"{sf_dir}/region.parquet").count()  # start the session before timing
    times = {}
    for name in (n for n in HEADLINE if n in REGISTRY):
        start = time.time()
        REGISTRY[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
