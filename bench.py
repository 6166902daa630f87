"""Headline wall times at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is fully materialised with a no-op sink (``write.format('noop')``) so the whole plan
runs without collecting rows to the driver."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from seqcorpus.plans.catalog import REGISTRY  # noqa: E402
from seqcorpus.plans.session import local_session  # noqa: E402

HEADLINE = {
    "vocab_build": "agg_04_finalize_vocab",          # AGG-01 + AGG-04
    "encode": "jn_01_encode",                        # JN-01
    "encode_stats": "agg_05_encode_stats",           # flagship
    "token_budget_batches": "bat_01_token_budget_batches",  # BAT-01, 4500 tokens, multiple 8
    "complete_blocks": "win_07_token_blocks_complete",      # WIN-07, B = 1024
    "corpus_bleu": "agg_09_corpus_bleu",             # AGG-08 + AGG-09
}


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores=cpus, shuffle_partitions=max(8, int(cpus) * 2) if cpus != "*" else 16)
    # warm-up: JVM, Python workers and parquet footers
    REGISTRY["src_01_read_lines"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name, q in HEADLINE.items():
        t0 = time.time()
        REGISTRY[q](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_total_wall", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))
    spark.stop()


if __name__ == "__main__":
    main()
