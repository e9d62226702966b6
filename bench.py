"""Bench: headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

Each query runs to completion into Spark's no-op sink (full computation, no
driver collection).  The first query also writes the derived token table
once; later queries read it, as a production pipeline would.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "clean_tokens", "partition_stats", "unseen_tokens", "word_ambiguity", "baseline_scores",
    "match_flags", "score_slices", "tag_confusion", "diff_accuracy", "align_sentences",
    "word_context_units", "word_context_chars", "word_context_span", "sentence_splits",
    "vocabulary", "encode_lines", "error_report", "config_grid",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from lexspark.session import get_session
    spark = get_session(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2, app="lexspark-bench")
    from lexspark.plans.queries import QUERIES
    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
