"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line: the best of three runs of each, after one to warm up.

Then each query at a tenth of that size, if there is such a folder beside it: `slope` is the power of the input by which its time grows, so 0 is a fixed cost and 1 in proportion.
"""

from __future__ import annotations

import json
import math
import os
import re
import time

from pyspark.sql import SparkSession

HEADLINE = (
    "facet_intersect_count facet_union facet_difference filter_mask has_batch search_batch_ordered named_intersect dense_count dense_intersect auto_intersect plan_choice shard_intersect_count ring_route ring_remap "
    "positional_id keyer_lookup index_dense expanded_search phrase_match context_dedup adhoc_intersect_count permitted_candidates"
).split()


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from idsets.queries import queries

    own = queries()

    def timed(where: str) -> dict[str, float]:
        times = {}
        for name in HEADLINE:
            best = None
            for k in range(4):
                start = time.perf_counter()
                own[name](spark, where).write.format("noop").mode("overwrite").save()
                took = time.perf_counter() - start
                if k:
                    best = took if best is None else min(best, took)
            times[name] = round(best, 3)
        return times

    times = timed(sf_dir)
    out = {"metric": "headline queries, total of best times", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}
    smaller = re.sub(r"sf(0\.|)(\d+)$", lambda m: f"sf{float('0.' + m[2] if m[1] else m[2]) / 10:g}", sf_dir.rstrip("/"))
    if smaller != sf_dir.rstrip("/") and os.path.isdir(smaller):
        small = timed(smaller)
        out |= {"smaller": os.path.basename(smaller), "smaller_queries": small, "slope": {n: round(math.log10(max(times[n], 1e-3) / max(small[n], 1e-3)), 2) for n in times}}
    print(json.dumps(out), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
