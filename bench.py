"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR  folder of the input tables (default /root/testdata/sf0.1)
    BENCH_CPUS    local cores (default 8)
    BENCH_RUNS    timed runs per query; the median counts (default 3)
"""

import json
import os
import statistics
import time

from plyclock.plans.queries import QUERIES, bind
from plyclock.session import local_session

HEADLINE = [
    "join_moves_players",
    "outcome_avg_move_time",
    "outcome_sum_share",
    "outcome_stats_avg",
    "outcome_hist_total",
    "rating_all_move_times",
    "rating_avg_move_time",
    "rating_fastest5",
    "rating_slowest5",
    "score_all_move_times",
    "score_fastest5",
    "score_slowest5",
    "top5_rating_bar_fast",
    "fit_rating_time",
    "fit_score_time",
    "fit_score_sine_best",
    "pgn_move_times",
    "score_moves_fold",
]


def run(df):
    df.write.format("noop").mode("overwrite").save()


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(cores, shuffle_partitions=cores)
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        query = bind(QUERIES[name])
        run(query(spark, sf_dir))
        times = []
        for _ in range(runs):
            start = time.perf_counter()
            run(query(spark, sf_dir))
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
    print(json.dumps({
        "metric": "total of median query times",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
