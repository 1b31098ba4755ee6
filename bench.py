"""Headline queries, timed: prints one JSON line.

Every query writes its whole result to the ``noop`` sink, so nothing is pruned
away as it would be by a count.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sitegraph.catalog import all_queries  # noqa: E402
from sitegraph.session import build_session  # noqa: E402

HEADLINE = ("html_nodes", "html_tokens", "find_all", "node_text", "render", "extract_links", "seek", "mine_pages",
            "crawl", "link_state_fold", "visit_decision", "product_upsert", "page_changes")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", cpus, **{"spark.sql.shuffle.partitions": cpus})
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    # start the JVM's and Python's workers outside the clock
    queries["html_nodes"](spark, sf_dir).limit(1).collect()
    seconds: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
