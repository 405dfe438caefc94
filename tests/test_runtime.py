import datetime as dt

from pyspark.sql import functions as F

from tests.conftest import SF
from tests.test_scan import same
from wardlake.operators import runtime as r
from wardlake.sources import derived as d
from wardlake.streaming import monitor as sm

T0 = dt.datetime(2024, 1, 1)
ANOMALY = ("host string, tick_ts timestamp, anomaly_type string, severity string, "
           "description string, details string, action string")


def ticks(spark, rows, schema="host string, tick_ts timestamp, seq int, line string"):
    return spark.createDataFrame([(h, T0 + dt.timedelta(minutes=m), *rest) for h, m, *rest in rows],
                                 schema)


def listen(port):
    return f"tcp 0 0 0.0.0.0:{port} 0.0.0.0:* LISTEN"


def test_ports(spark):
    net = ticks(spark, [("h", 0, 1, listen(22)), ("h", 1, 1, listen(22)), ("h", 1, 2, listen(31337)),
                        ("h", 1, 3, listen(4444)), ("h", 2, 1, "tcp :9999 ESTABLISHED"),
                        *(("h", 3, i, listen(9000 + i)) for i in (3, 1, 2, 5, 4)),
                        ("g", 0, 1, "nothing"), ("g", 1, 1, listen(6667))])
    got = {(a.host, a.tick_ts.minute): (a.anomaly_type, a.details)
           for a in r.network_anomalies(r.new_ports(net)).collect()}
    assert got == {("h", 1): ("SUSPICIOUS_PORT", "Port 31337 opened (not in baseline)"),
                   ("h", 3): ("PORT_SCAN", "New ports: [9001 9002 9003 9004 9005]"),
                   ("g", 1): ("SUSPICIOUS_PORT", "Port 6667 opened (not in baseline)")}


def test_lines_and_files(spark):
    procs = ticks(spark, [("h", 0, 0, "USER xmrig header"), ("h", 0, 2, "x XMRig"), ("h", 0, 1, "y minerd"),
                          ("h", 1, 1, "python -m SimpleHTTPServer")])
    assert [a.details for a in r.suspicious_process(procs).collect()] == ["Process: y minerd"]
    mtimes = spark.createDataFrame(
        [("h", T0, "/home/u/.ssh/authorized_keys", T0 - dt.timedelta(seconds=59)),
         ("h", T0, "/etc/shadow", T0 - dt.timedelta(seconds=60)),
         ("g", T0, "/home/u/v/.ssh/authorized_keys", T0)],
        "host string, tick_ts timestamp, path string, mtime timestamp")
    assert [a.details for a in r.critical_file_modified(mtimes).collect()] == [
        "File: /home/*/.ssh/authorized_keys"]


def test_every_third_calm_tick_rolls_back_and_critical_ones_do_not_count(spark):
    rows = [("h", m, "PORT_SCAN", "HIGH", "", "", "") for m in (0, 1500, 1501, 4000, 4001, 9000, 9001)]
    rows.append(("h", 2000, "REVERSE_SHELL", "CRITICAL", "", "", ""))
    got = r.rollback_decision(ticks(spark, rows, ANOMALY)).orderBy("tick_ts").collect()
    assert [a.rollback for a in got] == [False, False, True, True, False, False, True, False]


def test_last_stable_commit(spark):
    scans = spark.createDataFrame(
        [("r", T0, "a", True), ("r", T0 + dt.timedelta(days=2), "b", False),
         ("r", T0 + dt.timedelta(days=3), "c", True)],
        "repo_path string, scan_ts timestamp, commit_hash string, passed boolean")
    asks = spark.createDataFrame(
        [("r", T0), ("r", T0 + dt.timedelta(days=2, hours=1)), ("r", T0 + dt.timedelta(days=3)),
         ("r", T0 + dt.timedelta(days=3, seconds=1))], "repo_path string, rollback_ts timestamp")
    got = r.last_stable_commit(scans, asks).orderBy("rollback_ts").collect()
    assert [x.stable_commit for x in got] == [None, "a", "a", "c"]


def test_streams_equal_the_batch_form(spark, tmp_path):
    """Snapshots arriving over several batches give what the batch operators give."""
    net = d.net_snapshots(spark, SF)
    days = sorted(x[0] for x in net.select(F.to_date("tick_ts")).distinct().collect())
    for i in range(0, len(days), 10):
        part = net.where(F.to_date("tick_ts").isin(days[i:i + 10])).coalesce(1)
        part.write.mode("append").parquet(str(tmp_path / "net"))
    sm.end_rows(net, "0 seconds").coalesce(1).write.mode("append").parquet(str(tmp_path / "net"))
    stream = sm.read_snapshots(spark, str(tmp_path / "net"), maxFilesPerTrigger="1",
                               latestFirst="false")
    sm.append_log(sm.stream_port_anomalies(stream, "0 seconds"), str(tmp_path / "out"),
                  str(tmp_path / "cp")).start().awaitTermination()
    got = spark.read.schema(sm.ANOMALY_SCHEMA).json(str(tmp_path / "out"))
    batch = r.network_anomalies(r.new_ports(net))
    assert batch.count() > 10
    assert same(got, batch)
