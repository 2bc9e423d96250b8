"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8) and
BENCH_QUERIES (names, or "all") choose what is run. Every query is run once to
warm up and then timed; its rows go to Spark's no-op sink, so that all of them
are computed and none are collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from brinewave.plans.catalog import ENTRIES  # noqa: E402
from brinewave.session import build_session  # noqa: E402

HEADLINE = [
    "click_trains",
    "train_membership",
    "slot_interval_modes",
    "interval_table",
    "gap_sessions",
    "detector_counts",
    "segment_levels",
    "attitude_compensation",
    "train_bearing_lines",
    "value_counts",
    "step_and_bias",
    "round_trip_errors",
    "long_channel_stats",
    "teager_energy",
    "local_peaks",
    "auto_threshold",
    "spectrogram",
    "long_averaged_density",
    "tonal_frames",
    "band_passed",
    "impulse_detections",
    "delays_max_energy",
    "detection_bearings",
    "directions_far_field",
    "decoded_frames",
    "pcm_stats",
    "recording_counts",
    "recording_tracks",
]


def run(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    ENTRIES[name].run(spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(ENTRIES) if chosen == "all" else chosen.split() or HEADLINE
    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__driver__memory="12g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        if chosen != "all":
            run(spark, name, folder)
        times[name] = round(run(spark, name, folder), 3)
        print(f"{times[name]:8.3f} {name}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
