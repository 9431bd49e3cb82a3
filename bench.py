"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON."""

import json
import os
import statistics
import time

HEADLINE = "steps_daily steps_summary steps_summary_adjusted percentile_times_daily cadence_daily bouts_summary impute_missing_cascade asof_nearest_tolerance enmo_daily wear_stats windows_origin_start infer_freq hmm_transition features_all info_pivot".split()


def main() -> None:
    from strideway.plans.catalogue import QUERIES
    from strideway.session import build

    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = build(f"local[{cpus}]", spark__ui__enabled="false", spark__sql__shuffle__partitions=cpus, spark__driver__memory="8g", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    times = {}
    for name in HEADLINE:
        took = []
        for _ in range(runs + 1):  # the first run compiles
            began = time.time()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            took.append(time.time() - began)
        times[name] = round(statistics.median(took[1:]), 3)
    print(json.dumps({"metric": "median seconds of warm runs, summed over queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
