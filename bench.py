"""Time the headline queries; one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import time

from flowwarden import registry
from flowwarden.session import local_session

HEADLINE = [
    "flagship_packets_to_severity",
    "a1_flow_build",
    "s1_event_xml_scan",
    "m5_flow_score",
    "w1_host_sequence",
    "m9_batch_scoring",
    "l4_ttl_dedup",
    "l10_full_alert_chain",
    "a12_event_stats_document",
    "a5_alert_terms",
    "a8_hourly_histogram",
    "f1_network_search",
    "t2_page_by_time",
    "r1_port_scan",
    "r3_beacon",
    "r5_compromise_chain",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()
    # start the JVM's code paths and the Python workers on one small query each
    for name in ("a8_hourly_histogram", "l4_ttl_dedup"):
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
