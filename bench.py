"""Time the headline queries; prints one JSON line.

Each query is run once to warm up and once timed, into Spark's no-op sink, so that the whole result
is computed and nothing is gathered on the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidewell.plans import QUERIES, load_all  # noqa: E402
from tidewell.session import build_session  # noqa: E402

HEADLINE = (
    "JN2_risk_progression",
    "TOP2_session_history",
    "AGG3_peak_risk_users",
    "WIN9_trend_record",
    "WIN16_anomaly_scan",
    "WIN18_recovery_timeline",
    "WIN23_risk_evolution",
    "ALT7_alert_set",
    "TW8_twin_row",
    "TW11_reasoning_report",
    "TOP7_diversified",
    "AGG1_session_index",
    "AGG10_numeric_profile",
    "DQ9_gate_roll_up",
    "TXT12_emotions",
    "TXT18_transcript_metrics",
    "TXT21_text_feature_table",
    "EV1_classification",
    "EV3_roc_auc",
    "MTH5_dimension_scaling",
    "GR9_central_nodes",
    "GR10_degrees",
    "GR11_connected_components",
    "MUT1_upsert_latest",
    "STR7_bursts",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench", os.environ.get("BENCH_CPUS", "8"))
    load_all()
    times: dict[str, float] = {}
    cold: dict[str, float] = {}
    for name in HEADLINE:
        for store in (cold, times):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            store[name] = round(time.perf_counter() - start, 3)
        print(f"{name} cold {cold[name]} warm {times[name]}", file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_warm_total", "value": total, "unit": "sec", "queries": times, "cold": cold, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
