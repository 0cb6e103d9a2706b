"""Time every registered query over the whole tables and print one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores, BENCH_RUNS the timed runs of each
query (the median counts, after one run to warm up).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from chronoloom.registry import queries
from chronoloom.session import local_session


def _seconds(query, spark, folder: str) -> float:
    started = time.perf_counter()
    query(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main(names: list[str]) -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cpus=cpus, shuffle_partitions=cpus)
    registered = queries()
    times: dict[str, float] = {}
    for name in names or registered:
        _seconds(registered[name], spark, folder)
        times[name] = round(
            statistics.median(_seconds(registered[name], spark, folder) for _ in range(runs)), 3
        )
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total warm seconds over all registered queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main(sys.argv[1:])
