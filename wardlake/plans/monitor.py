"""Snapshots in, rollback requests out."""

from __future__ import annotations

from pyspark.sql import DataFrame

from wardlake.operators import runtime


def monitor(net: DataFrame, processes: DataFrame, files: DataFrame) -> DataFrame:
    anomalies = runtime.runtime_anomalies(net, processes, files)
    return runtime.rollback_requests(runtime.rollback_decision(anomalies))
