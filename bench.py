"""Headline-query bench.

Runs the bench queries at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]`` and prints one JSON line with seconds per query.  Each
query is executed in full through the ``noop`` sink (no driver collect); the
best of ``$BENCH_REPEAT`` runs (default 2) is reported, after one warm-up.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from keelson.plans.registry import BENCH, load_all  # noqa: E402
from keelson.session import get_session  # noqa: E402


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    spark = get_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus))
    queries, _ = load_all()
    names = [n for n in (sys.argv[1:] or BENCH) if n in queries]

    def run(name):
        t0 = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    run(names[0])  # JVM and parquet-footer warm-up
    timings = {}
    for name in names:
        timings[name] = round(min(run(name) for _ in range(repeat)), 3)
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_query_seconds_total", "value": round(sum(timings.values()), 3),
                      "unit": "sec", "queries": timings, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
