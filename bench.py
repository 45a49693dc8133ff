"""Times the headline queries on ``$BENCH_SF_DIR`` with ``local[$BENCH_CPUS]`` and prints one JSON line.

Every query is written in full to the no-op sink, so no column or row is optimised away.
"""

from __future__ import annotations

import json
import os
import sys
import time

from workload.check import local_session
from workload.queries import QUERIES

HEADLINE = [
    "clean_ratings",
    "merge_feedback",
    "item_popularity",
    "fallback_all",
    "user_genre_profile",
    "anchor_items",
    "content_score",
    "hybrid_rerank",
    "hybrid_from_candidates",
    "hybrid_precomputed",
    "ranking_metrics",
    "route_requests",
    "serve_batch",
    "latest_profile_rating",
    "als_fit",
    "als_candidates_all",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus)
    # One small query first, so that the first timing does not carry the session's start.
    QUERIES["user_bucket"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    scale = os.path.basename(folder.rstrip("/"))
    print(json.dumps({"metric": "headline_queries", "value": total, "unit": "sec", "queries": seconds, "sf": scale}))


if __name__ == "__main__":
    main()
