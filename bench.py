"""Time the headline queries and print one JSON line.

Each query is planned and executed in full, its result handed to the ``noop``
sink: one untimed run, then the median of three. ``BENCH_SF_DIR`` and
``BENCH_CPUS`` choose the data and the number of cores.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from innsight.catalog import queries  # noqa: E402
from innsight.session import local_session  # noqa: E402

HEADLINE = (
    "q01_available_rooms",
    "q04_occupancy_by_category",
    "q07_frequent_clients",
    "q08_top_services",
    "q10_invoices_collected",
    "q13_avg_stay_by_category",
    "q16_repeat_cancellers",
    "q17_bookings_by_country",
    "q21_room_audit",
    "q24_monthly_occupancy",
    "q25_revenue_by_category",
    "q27_vip_top_services",
    "q30_longest_stay_per_category",
    "p_i_monthly_income",
    "r1_booking_totals",
    "r2_account_totals",
    "dq_row_rules",
    "p_d_check_availability",
    "p_a_book_bookings",
    "p_e_service_consumption",
    "p_j_propose_upgrades",
    "t_c_room_state_log",
    "s1_room_state_log",
)
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    spark = local_session(cpus, "innsight-bench", partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    known = queries()

    def once(name: str) -> float:
        start = time.perf_counter()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in HEADLINE:
        once(name)
        seconds[name] = round(statistics.median(once(name) for _ in range(RUNS)), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "innsight headline queries, median wall time summed",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
