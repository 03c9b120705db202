"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

HEADLINE = (
    "full_build", "apply_delta", "top_page", "search_with_snippets", "search_statistics", "match_all_terms",
    "match_boolean", "match_phrase", "match_sloppy", "match_wildcard", "match_fuzzy", "rank_boosted", "acl_search",
    "tree_delta", "commits_added", "vocabulary", "author_ranking", "charcount_percentiles", "snippet",
    "stream_coalesce",
)


def main() -> None:
    from lodeseek.checks.queries import QUERIES
    from lodeseek.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", cores=os.environ.get("BENCH_CPUS", "8"))
    spark.conf.set("spark.sql.shuffle.partitions", os.environ.get("BENCH_CPUS", "8"))
    QUERIES["repo_catalog"](spark, folder).count()  # starts the executors
    seconds = {}
    for name in HEADLINE:
        best = float("inf")
        for _ in range(3):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - start)
        seconds[name] = round(best, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
