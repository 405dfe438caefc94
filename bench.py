"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and once timed, into a sink that discards rows. Also
reported: lines and scans per second of the full scan.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from wardlake.queries import QUERIES, scan_results  # noqa: E402
from wardlake.session import local_session  # noqa: E402
from wardlake.sources import derived as d  # noqa: E402
from wardlake.sources import files as fs  # noqa: E402

HEADLINE = ("secrets_gate", "secrets_strict", "code_issues", "cve_findings", "advanced_findings",
            "source_tokens", "risk_score", "policy_result", "listening_ports",
            "runtime_anomalies", "rollback_decision")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, name="bench")
    spark.sparkContext.setLogLevel("ERROR")
    runs = {"scan_result": scan_results, **{name: QUERIES[name] for name in HEADLINE}}
    seconds, cold = {}, {}
    for name, fn in runs.items():
        for attempt in (cold, seconds):
            start = time.perf_counter()
            fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
            attempt[name] = round(time.perf_counter() - start, 3)
    lines = fs.explode_lines(d.scan_files(spark, sf_dir)).count()
    scans = d.requests(spark, sf_dir).count()
    print(json.dumps({
        "metric": "total warm time of the headline queries",
        "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "cold": cold, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": cpus,
        "lines_per_sec": round(lines / seconds["scan_result"]),
        "scans_per_sec": round(scans / seconds["scan_result"], 1),
        "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions")}))


if __name__ == "__main__":
    main()
