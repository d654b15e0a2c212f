"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is fully executed with the no-op sink (every row and column is
computed, nothing is collected).  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sifter.plans import catalog  # noqa: E402
from sifter.session import build_session  # noqa: E402

HEADLINE = [
    "priority_cap",             # flagship: anti-join, keep, per-sender cap, priority top-k
    "html_to_text",             # HTML body -> text over every message
    "best_link",                # anchors, link scoring, per-row argmax
    "lookup_page",              # best link of kept high-relevance mail joined to crawled pages
    "token_windows",            # overlapping windows over every text
    "assign_batches",           # distributed global batch numbering
    "batch_pack",               # triage prompts
    "positional_verdict_join",  # model output JSON -> per-message verdicts with failure rules
    "top_n_per_sender",
    "triage_report",
    "inbox_actions",
    "flatten_mime",             # raw payload JSON -> decoded bodies
    "digest_sink",              # one complete run
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=cpus * 2,
                          extra={"spark.driver.memory": "16g"})
    qs = catalog.queries()
    # warm-up (JVM, codegen caches) on a cheap query; not counted
    qs["normalize_sender"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for key in HEADLINE:
        t0 = time.perf_counter()
        qs[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[key] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
