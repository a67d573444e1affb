"""Time the headline queries, and two of them over every playlist; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cadenza.plans.queries import QUERIES  # noqa: E402
from cadenza.session import get_spark  # noqa: E402

HEADLINE = (
    "coverage_summary",
    "filter_50_percent",
    "artist_diversity_summary",
    "holdout_split",
    "cooccurrence_counts",
    "cf_neighbors",
    "cf_scores_topk",
    "stage1_recall_grid",
    "rank_fused_top10",
    "metrics_by_variant",
)
#: Also timed, but not part of the sum: without the cap of 1000 cases.
UNCAPPED = ("cf_scores_topk_whole", "metrics_by_variant_whole")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_spark("bench", memory=os.environ.get("BENCH_MEMORY", "12g"))
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["coverage_summary"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start-up isn't counted
    times = {}
    for name in (*HEADLINE, *UNCAPPED):
        spark.catalog.clearCache()  # nothing is kept from one query to the next
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline queries, wall clock", "value": round(sum(times[n] for n in HEADLINE), 3), "unit": "sec", "queries": times, "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf}))


if __name__ == "__main__":
    main()
