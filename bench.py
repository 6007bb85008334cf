"""Times every batch query at one scale; prints one JSON line.

BENCH_SF_DIR, BENCH_CPUS and BENCH_QUERIES (comma-separated names) select what
runs. Each query is executed in full into the no-op sink, the best of
BENCH_REPEATS runs counts.
"""

from __future__ import annotations

import json
import os
import time

from answergauge.plans import all_queries
from answergauge.session import build_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = int(os.environ.get("BENCH_REPEATS", "1"))


def main() -> None:
    spark = build_session(
        "bench", f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        })
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else list(queries)

    queries[names[0]].run(spark, SF_DIR).collect()  # warm-up, not timed
    seconds: dict[str, float] = {}
    for name in names:
        runs = []
        for _ in range(REPEATS):
            start = time.perf_counter()
            queries[name].run(spark, SF_DIR).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs), 3)
    print(json.dumps({
        "metric": "total seconds of all queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
