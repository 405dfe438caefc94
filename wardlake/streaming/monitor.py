"""Host monitoring on streams of snapshot lines.

The line checks are the batch predicates applied to a stream. The port checks and the
rollback counter need state per host; both run in ``applyInPandasWithState``. A tick may
arrive over several batches, so its rows wait in state until the watermark passes the tick;
then ticks are worked off in time order. State per host is its baseline, one counter and
the ticks still open. How late rows may be is for the caller to say: hosts share the watermark,
and rows behind it are dropped (a query's progress counts them in numRowsDroppedByWatermark).
When input ends, ``end_rows`` moves the watermark past the last ticks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from wardlake.operators import runtime
from wardlake.schemas import SNAPSHOT_LINE

ANOMALY_SCHEMA = ("host string, tick_ts timestamp, anomaly_type string, severity string, "
                  "description string, details string, action string")
DECISION_SCHEMA = "host string, tick_ts timestamp, n_anomalies int, n_critical int, rollback boolean"
STATE_SCHEMA = "state string"


def read_snapshots(spark: SparkSession, path: str, schema=SNAPSHOT_LINE,
                   source: str = "parquet", **options: str) -> DataFrame:
    return spark.readStream.format(source).schema(schema).options(**options).load(path)


def end_rows(snapshots: DataFrame, lateness: str) -> DataFrame:
    """End-of-input rows for a table that a stream has read, one per host, to be appended to it.

    They are later than every tick by more than ``lateness``, have nulls besides host and tick,
    and are never reported themselves.
    """
    after = F.expr(f"interval 1 day + interval {lateness}")
    newest = snapshots.agg(F.max("tick_ts") + after).first()[0]
    ends = snapshots.select("host").distinct().withColumn(
        "tick_ts", F.lit(newest).cast("timestamp"))
    return ends.select(*(
        c if c in ("host", "tick_ts") else F.lit(None).cast(t).alias(c) for c, t in snapshots.dtypes))


def stream_reverse_shell(net: DataFrame) -> DataFrame:
    """Every matching line as it arrives (the batch form keeps the first per tick)."""
    return net.where(runtime.is_reverse_shell()).select(
        "host", "tick_ts", "seq", F.lit("REVERSE_SHELL").alias("anomaly_type"), "line")


def stream_suspicious_process(processes: DataFrame) -> DataFrame:
    return runtime.process_lines(processes).where(runtime.is_suspicious_process()).select(
        "host", "tick_ts", "seq", F.lit("SUSPICIOUS_PROCESS").alias("anomaly_type"), "line")


def _micros(ts: pd.Timestamp) -> int:
    return int(pd.Timestamp(ts).value // 1000)


def _stamp(micros: int) -> pd.Timestamp:
    return pd.Timestamp(micros * 1000)


def _load(state: GroupState, empty: dict) -> dict:
    return json.loads(state.get[0]) if state.exists else empty


def _ripe(open_ticks: dict, watermark_ms: int) -> list[str]:
    return sorted((t for t in open_ticks if int(t) < watermark_ms * 1000), key=int)


def _wait(state: GroupState, data: dict, open_ticks: dict) -> None:
    """Stores the state and asks to be called when the earliest open tick is complete."""
    state.update((json.dumps(data),))
    if open_ticks:
        due = min(int(t) for t in open_ticks) // 1000 + 1
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))


def _port_anomaly(ports: list[int]) -> tuple[str, str, str] | None:
    bad = [p for p in ports if p in runtime.SUSPICIOUS_PORTS]
    if bad:
        return ("SUSPICIOUS_PORT", "New suspicious port opened",
                f"Port {bad[0]} opened (not in baseline)")
    if len(ports) >= runtime.PORT_SCAN_PORTS:
        return ("PORT_SCAN", "Multiple new ports opened",
                "New ports: [" + " ".join(map(str, ports)) + "]")
    return None


def _follow_ports(key: tuple, batches: Iterator[pd.DataFrame],
                  state: GroupState) -> Iterator[pd.DataFrame]:
    data = _load(state, {"baseline": None, "open": {}})
    waiting = data["open"]
    for batch in batches:
        for tick, seq, at, port in zip(batch["tick_ts"], batch["seq"], batch["at"],
                                       batch["port"], strict=True):
            seen = waiting.setdefault(str(_micros(tick)), {})
            if port >= 0:
                place = [int(seq), int(at)]
                seen[str(port)] = min(seen.get(str(port), place), place)
    rows = []
    for tick in _ripe(waiting, state.getCurrentWatermarkMs()):
        seen = waiting.pop(tick)
        ports = [int(p) for p in sorted(seen, key=lambda p: seen[p])]
        if data["baseline"] is None:
            data["baseline"] = ports
            continue
        known = set(data["baseline"])
        found = _port_anomaly([p for p in ports if p not in known])
        if found:
            kind, description, details = found
            rows.append((key[0], _stamp(int(tick)), kind, "HIGH", description, details,
                         "INVESTIGATE"))
    _wait(state, data, waiting)
    names = ["host", "tick_ts", "anomaly_type", "severity", "description", "details", "action"]
    yield pd.DataFrame(rows, columns=names).astype({"tick_ts": "datetime64[ns]"})


def stream_port_anomalies(net: DataFrame, lateness: str) -> DataFrame:
    """New suspicious ports and port scans per completed tick.

    Lines without a listening port still open their tick (port -1): the first tick of a
    host is its baseline even when nothing listens.
    """
    ports = F.regexp_extract_all("line", F.lit(r":([0-9]+)(?:[\t\n\f\r ]|\z)"), F.lit(1))
    listed = F.when(F.col("line").contains("LISTEN") & (F.size(ports) > 0), ports).otherwise(
        F.array(F.lit("-1")))
    rows = (net.withWatermark("tick_ts", lateness)
            .select("host", "tick_ts", "seq", F.posexplode(listed).alias("at", "digits"))
            .select("host", "tick_ts", "seq", "at",
                    F.coalesce(F.col("digits").try_cast("bigint"), F.lit(0)).alias("port")))
    return rows.groupBy("host").applyInPandasWithState(
        _follow_ports, ANOMALY_SCHEMA, STATE_SCHEMA, "append",
        GroupStateTimeout.EventTimeTimeout)


def _follow_rollbacks(key: tuple, batches: Iterator[pd.DataFrame],
                      state: GroupState) -> Iterator[pd.DataFrame]:
    data = _load(state, {"count": 0, "open": {}})
    waiting = data["open"]
    for batch in batches:
        for tick, severity in zip(batch["tick_ts"], batch["severity"], strict=True):
            tally = waiting.setdefault(str(_micros(tick)), [0, 0])
            tally[0] += 1
            tally[1] += severity == "CRITICAL"
    rows = []
    for tick in _ripe(waiting, state.getCurrentWatermarkMs()):
        total, critical = waiting.pop(tick)
        rollback = critical > 0
        if not critical:
            data["count"] += total
            if data["count"] >= runtime.ROLLBACK_AFTER:
                rollback, data["count"] = True, 0
        rows.append((key[0], _stamp(int(tick)), total, critical, rollback))
    _wait(state, data, waiting)
    names = ["host", "tick_ts", "n_anomalies", "n_critical", "rollback"]
    yield pd.DataFrame(rows, columns=names).astype({"tick_ts": "datetime64[ns]"})


def stream_rollback(anomalies: DataFrame, lateness: str) -> DataFrame:
    """Rollback decision per completed tick, from a stream of anomalies."""
    rows = anomalies.withWatermark("tick_ts", lateness).select("host", "tick_ts", "severity")
    return rows.groupBy("host").applyInPandasWithState(
        _follow_rollbacks, DECISION_SCHEMA, STATE_SCHEMA, "append",
        GroupStateTimeout.EventTimeTimeout)


def append_log(stream: DataFrame, path: str, checkpoint: str,
               interval: str | None = None) -> DataStreamWriter:
    """Append-only JSON log; every tick interval, or once over what is available."""
    writer = (stream.writeStream.format("json").outputMode("append")
              .option("path", path).option("checkpointLocation", checkpoint))
    return (writer.trigger(processingTime=interval) if interval
            else writer.trigger(availableNow=True))
