"""Bench: run the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; print one JSON line.

Every query is forced to completion with the no-op sink (full computation, nothing collected).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "aspect_lexicon_counts",   # flagship: sentences x keyword aspect x lexicon label
    "sentence_explode",
    "lexicon_score",
    "tfidf_l2",
    "lr_predict",
    "model_compare",
    "topic_words",
    "aspects_summary",
    "analyze_reviews",
    "encode_fixed",
    "crawl_report",
    "stream_counts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    from reviewlens.plans import registry
    from reviewlens.session import build_session

    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=max(8, 2 * int(cpus)))
    qs = registry.queries()
    times: dict[str, float] = {}
    for name in names:
        t0 = time.time()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
