"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8) and
BENCH_QUERIES (comma-separated names, default below) select what is run.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import registry  # noqa: E402
from checks.compare import session  # noqa: E402

HEADLINE = ("numbers_pass_rate,build_library,library_pass_rates,augment_train,clean_pert_pairs,"
            "prompt_frames,synonym_replace_ratio,template_paraphrase,join_peer_first_match,"
            "filter_cascade,cosine_from_tokens,classification_report,robustness_report,"
            "reward_total,ema_baseline,label_probs_from_logits,verbalizer_build,score_text")


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = os.environ.get("BENCH_QUERIES", HEADLINE).split(",")
    registry.load()
    spark = session()
    spark.range(1).count()  # start-up is not part of any query
    times = {}
    for name in names:
        start = time.perf_counter()
        # computes every column of every row without moving it to the driver
        registry.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, total wall time",
                      "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
