"""Time the headline queries: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import time

from sensorloom import plans
from sensorloom.session import forget_levels, local_session

HEADLINE = (
    "d1_grid_resample", "c1_asof_backward", "c2_asof_nearest", "e6_trailing_level", "e8_centred_outlier",
    "e19_fill_short_gaps", "f2_flat_line", "f3_attenuated_signal", "d13_robust_centre_and_spread", "d24_histogram",
    "j3_cusum", "d18_notice_groups", "f15_screen_table", "k10_held_out_check", "c6_newest_version",
    "l1_flow_closure", "l11_diagnosis", "m7_score_card", "n7_drift", "q12_cooldown",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("sensorloom-bench", os.environ.get("BENCH_CPUS", "8"))
    queries = plans.queries()
    queries["d1_grid_resample"](spark, folder).count()  # start the JVM's engines once
    timed = {}
    for name in HEADLINE:
        forget_levels()  # every query pays for its own levels
        begun = time.time()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        timed[name] = round(time.time() - begun, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(timed.values()), 3), "unit": "sec",
        "queries": timed, "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
