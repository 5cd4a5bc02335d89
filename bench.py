"""Times the headline queries and prints one JSON line.

Each query is planned and run in full three times in one session; every result
is counted together with a hash of all its columns, so that no column is
pruned. The better of the two warm times is reported; the sum is the headline
figure. The first times are listed as cold.
"""

import json
import os
import time

from pyspark.sql import functions as F

from wakecross.plans.queries import QUERIES
from wakecross.session import local_session

HEADLINE = [
    "point_index", "harbour_cells", "ping_pairs_reference_window", "ping_pairs_corrected_window",
    "ping_pairs_shared_cells", "encounter_heatmap", "encounter_topk", "tumbling_lines", "line_segments",
    "line_pairs", "line_pairs_shared_cells", "pairs_outside_harbours", "zoom_info",
]


def run(spark, name: str, sf_dir: str) -> tuple[float, int]:
    start = time.perf_counter()
    frame = QUERIES[name](spark, sf_dir)
    row = frame.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64(*frame.columns)).alias("h")).first()
    return time.perf_counter() - start, row.n


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")))
    times, cold, rows = {}, {}, {}
    for name in HEADLINE:
        cold[name], _ = run(spark, name, sf_dir)
        times[name], rows[name] = min(run(spark, name, sf_dir) for _ in range(2))
    rounded = {name: round(value, 3) for name, value in times.items()}
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": rounded,
        "cold": {name: round(value, 3) for name, value in cold.items()},
        "rows": rows,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
