"""Host monitoring over snapshot tables: one row per line, keyed by (host, tick_ts).

A host's first tick is its baseline; the ticks after it are checked. Everything is an
aggregation by host and tick (or a join of such aggregates), so a host with a third of all
rows is folded before it is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlake.functions import text as tx
from wardlake.rules import spell

TICK = ["host", "tick_ts"]

# What the checks look for, their severities, texts and actions.
REVERSE_SHELL_PATTERNS = ("/bin/sh", "/bin/bash", "nc -e", "ncat", "python.*socket",
                          "perl.*socket")
SUSPICIOUS_PORTS = (4444, 5555, 6667, 31337, 12345, 1337, 6666, 7777)
SUSPICIOUS_PROCESSES = ("cryptominer", "xmrig", "minerd", "cgminer", "nc -l", "ncat -l",
                        "python -m SimpleHTTPServer", "python -m http.server")
CRITICAL_FILES = ("/etc/passwd", "/etc/shadow", "/etc/sudoers", "/root/.ssh/authorized_keys",
                  "/home/*/.ssh/authorized_keys")
RECENT_SECONDS = 60
PORT_SCAN_PORTS = 5
ROLLBACK_AFTER = 3
ROLLBACK_REASON = "Runtime anomalies detected"
CHECKS = ("REVERSE_SHELL", "SUSPICIOUS_PORT", "PORT_SCAN", "SUSPICIOUS_PROCESS",
          "CRITICAL_FILE_MODIFIED")


def _anomaly(rows: DataFrame, kind: str, severity: str, description: str, details: Column,
             action: str) -> DataFrame:
    return rows.select(*TICK, F.lit(kind).alias("anomaly_type"), F.lit(severity).alias("severity"),
                       F.lit(description).alias("description"), details.alias("details"),
                       F.lit(action).alias("action"))


# --- stateless line checks (also used on streams) ------------------------------------------

def is_reverse_shell() -> Column:
    return F.col("line").rlike(spell("|".join(REVERSE_SHELL_PATTERNS)))


def is_suspicious_process() -> Column:
    """The listing is lower-cased, the names are not: one with capitals never matches."""
    return tx.contains_any(tx.fold_case(F.col("line")), SUSPICIOUS_PROCESSES)


def process_lines(snapshots: DataFrame) -> DataFrame:
    """Process lines: the header (seq 0) and blank lines are not processes."""
    return snapshots.where((F.col("seq") > 0) & (F.col("line") != ""))


def _first_line(lines: DataFrame) -> DataFrame:
    return lines.groupBy(*TICK).agg(F.min_by("line", "seq").alias("line"))


def reverse_shell(net: DataFrame) -> DataFrame:
    found = _first_line(net.where(is_reverse_shell()))
    return _anomaly(found, "REVERSE_SHELL", "CRITICAL", "Potential reverse shell detected",
                    F.concat(F.lit("Suspicious process: "), "line"), "ROLLBACK_REQUIRED")


def suspicious_process(processes: DataFrame) -> DataFrame:
    found = _first_line(process_lines(processes).where(is_suspicious_process()))
    return _anomaly(found, "SUSPICIOUS_PROCESS", "CRITICAL", "Suspicious process detected",
                    F.concat(F.lit("Process: "), "line"), "ROLLBACK_REQUIRED")


# --- ports ---------------------------------------------------------------------------------

def port_rows(net: DataFrame) -> DataFrame:
    """Every listening port mentioned, one row per mention (a line end counts as space)."""
    listening = net.where(F.col("line").contains("LISTEN"))
    ports = F.regexp_extract_all("line", F.lit(r":([0-9]+)(?:[\t\n\f\r ]|\z)"), F.lit(1))
    rows = listening.select(*TICK, "seq", F.posexplode(ports).alias("at", "digits"))
    return rows.select(*TICK, "seq", "at",
                       F.coalesce(F.col("digits").try_cast("bigint"), F.lit(0)).alias("port"))


def listening_ports(net: DataFrame) -> DataFrame:
    """Distinct ports per tick; ``first_seen`` orders them by first mention."""
    return port_rows(net).groupBy(*TICK, "port").agg(
        F.min(F.struct("seq", "at")).alias("first_seen"))


def first_ticks(snapshots: DataFrame) -> DataFrame:
    return snapshots.groupBy("host").agg(F.min("tick_ts").alias("first_tick"))


def port_baseline(net: DataFrame, ports: DataFrame | None = None) -> DataFrame:
    """Ports of each host's first tick.

    A port belongs to it when the first tick that shows the port is the host's first tick:
    both are minima, folded before the shuffle.
    """
    ports = listening_ports(net) if ports is None else ports
    shown = ports.groupBy("host", "port").agg(F.min("tick_ts").alias("shown"))
    return (shown.join(first_ticks(net), "host").where(F.col("shown") == F.col("first_tick"))
            .select("host", "port"))


def process_baseline(processes: DataFrame) -> DataFrame:
    lines = process_lines(processes).groupBy("host", "line").agg(
        F.min("tick_ts").alias("shown"))
    return (lines.join(first_ticks(processes), "host")
            .where(F.col("shown") == F.col("first_tick")).select("host", "line"))


def new_ports(net: DataFrame) -> DataFrame:
    """Ports that are not in the host's baseline."""
    ports = listening_ports(net)
    return ports.join(port_baseline(net, ports), ["host", "port"], "left_anti").select(
        *TICK, "port", "first_seen")


def suspicious_ports(ports: DataFrame) -> DataFrame:
    return ports.where(F.col("port").isin(*SUSPICIOUS_PORTS))


def port_summary(new: DataFrame) -> DataFrame:
    """Per tick: number of new ports, the first suspicious one, and all of them in order."""
    bad = F.col("port").isin(*SUSPICIOUS_PORTS)
    return new.groupBy(*TICK).agg(
        F.count("*").alias("n_new"),
        F.min(F.when(bad, F.struct("first_seen", "port"))).alias("bad"),
        # Distinct port numbers of one tick: bounded by the port range.
        F.array_sort(F.collect_list(F.struct("first_seen", "port"))).alias("ports"))


def suspicious_port(new: DataFrame) -> DataFrame:
    found = port_summary(new).where(F.col("bad").isNotNull())
    return _anomaly(found, "SUSPICIOUS_PORT", "HIGH", "New suspicious port opened",
                    F.format_string("Port %d opened (not in baseline)", F.col("bad.port")),
                    "INVESTIGATE")


def _port_list() -> Column:
    return F.concat(F.lit("New ports: ["), F.array_join(F.transform(
        "ports", lambda p: p["port"].cast("string")), " "), F.lit("]"))


def port_scan(new: DataFrame) -> DataFrame:
    """Many new ports, none of them suspicious."""
    found = port_summary(new).where(F.col("bad").isNull() & (F.col("n_new") >= PORT_SCAN_PORTS))
    return _anomaly(found, "PORT_SCAN", "HIGH", "Multiple new ports opened", _port_list(),
                    "INVESTIGATE")


def network_anomalies(new: DataFrame) -> DataFrame:
    """Both port checks from one summary."""
    bad = F.col("bad").isNotNull()
    found = port_summary(new).where(bad | (F.col("n_new") >= PORT_SCAN_PORTS))
    out = found.select(
        *TICK, F.when(bad, "SUSPICIOUS_PORT").otherwise("PORT_SCAN").alias("anomaly_type"),
        F.lit("HIGH").alias("severity"),
        F.when(bad, "New suspicious port opened").otherwise("Multiple new ports opened")
        .alias("description"),
        F.when(bad, F.format_string("Port %d opened (not in baseline)", F.col("bad.port")))
        .otherwise(_port_list()).alias("details"), F.lit("INVESTIGATE").alias("action"))
    return out


# --- files ---------------------------------------------------------------------------------

def glob_regex(glob: str) -> str:
    """A path glob as an anchored regex; a star stays within one directory."""
    special = {"*": "[^/]*", "?": "[^/]"}
    return r"\A" + "".join(special.get(c, c if c.isalnum() or c in "/_" else "\\" + c)
                           for c in glob) + r"\z"


def critical_file_modified(files: DataFrame) -> DataFrame:
    """First watched glob (in list order) with a file changed in the last minute."""
    order = F.lit(None).cast("int")
    for i, glob in reversed(list(enumerate(CRITICAL_FILES))):
        order = F.when(F.col("path").rlike(glob_regex(glob)), i).otherwise(order)
    age = F.unix_micros("tick_ts") - F.unix_micros("mtime")
    hits = (files.where(age < RECENT_SECONDS * 1_000_000).withColumn("glob", order)
            .where(F.col("glob").isNotNull()))
    first = hits.groupBy(*TICK).agg(F.min("glob").alias("glob"))
    globs = F.array(*(F.lit(g) for g in CRITICAL_FILES))
    return _anomaly(first, "CRITICAL_FILE_MODIFIED", "CRITICAL",
                    "Critical system file modified",
                    F.concat(F.lit("File: "), F.element_at(globs, F.col("glob") + 1)),
                    "ROLLBACK_REQUIRED")


# --- composition ---------------------------------------------------------------------------

def runtime_anomalies(net: DataFrame, processes: DataFrame, files: DataFrame) -> DataFrame:
    """All checks on every tick after a host's first one."""
    found = (reverse_shell(net).unionByName(network_anomalies(new_ports(net)))
             .unionByName(suspicious_process(processes))
             .unionByName(critical_file_modified(files)))
    return (found.join(first_ticks(net), "host")
            .where(F.col("tick_ts") > F.col("first_tick")).drop("first_tick"))


def check_order() -> Column:
    return F.array_position(F.array(*(F.lit(c) for c in CHECKS)), F.col("anomaly_type"))


def tick_summary(anomalies: DataFrame) -> DataFrame:
    """Per host and tick: how many anomalies, how many critical, and the list (at most 4)."""
    item = F.struct("anomaly_type", "severity", "description", "details", "action")
    return anomalies.groupBy(*TICK).agg(
        F.count("*").alias("n_anomalies"),
        F.count_if(F.col("severity") == "CRITICAL").alias("n_critical"),
        F.transform(F.array_sort(F.collect_list(F.struct(
            check_order().alias("check"), item.alias("item")))), lambda e: e["item"])
        .alias("anomalies"))


def _counted(count: Column, tick: Column) -> Column:
    """The counter after a tick: critical ticks leave it alone, the others add their anomalies,
    and a full counter starts anew."""
    added = count + tick["n_anomalies"].cast("int")
    return F.when(tick["n_critical"] > 0, count).otherwise(
        F.when(added >= ROLLBACK_AFTER, 0).otherwise(added))


def rollback_decision(anomalies: DataFrame) -> DataFrame:
    """Whether a tick triggers a rollback.

    Critical ticks always do. Others do when the anomalies counted since the last time reach
    ``ROLLBACK_AFTER``. The counter has few states, so what a day does to it is a small table
    (from each state to the state after the day): days are folded side by side, then each
    host's days, one small row each, in order, and then each day knows where it starts.
    """
    states = range(ROLLBACK_AFTER)
    ticks = tick_summary(anomalies)
    # Ticks of one host and day: bounded by the tick interval.
    days = (ticks.groupBy("host", F.to_date("tick_ts").alias("day"))
            .agg(F.sort_array(F.collect_list(F.struct("tick_ts", "n_anomalies", "n_critical",
                                                      "anomalies"))).alias("ticks"))
            .withColumn("after", F.array(*(F.aggregate("ticks", F.lit(c), _counted)
                                           for c in states))))
    hosts = days.groupBy("host").agg(
        F.sort_array(F.collect_list(F.struct("day", "after"))).alias("days"))
    start = F.struct(F.lit(0).alias("count"),
                     F.array().cast("array<struct<day:date,start:int>>").alias("starts"))
    walked = F.aggregate("days", start, lambda state, d: F.struct(
        F.get(d["after"], state["count"]).alias("count"),
        F.concat(state["starts"], F.array(F.struct(
            d["day"].alias("day"), state["count"].alias("start")))).alias("starts")))
    starts = hosts.select("host", F.inline(walked["starts"]))
    told = F.aggregate(
        "ticks", F.struct(F.col("start").alias("count"),
                          F.array().cast("array<boolean>").alias("full")),
        lambda state, t: F.struct(
            _counted(state["count"], t).alias("count"),
            F.concat(state["full"], F.array(
                (t["n_critical"] > 0)
                | (state["count"] + t["n_anomalies"] >= ROLLBACK_AFTER))).alias("full")))
    rows = (days.join(starts, ["host", "day"]).withColumn("full", told["full"])
            .select("host", F.inline(F.arrays_zip("ticks", F.col("full").alias("rollback")))))
    return rows.select("host", "ticks.tick_ts", "ticks.n_anomalies", "ticks.n_critical",
                       "rollback", "ticks.anomalies")


def rollback_requests(decisions: DataFrame) -> DataFrame:
    return decisions.where("rollback").select(
        *TICK, F.lit(ROLLBACK_REASON).alias("reason"), "anomalies")


def _rfc3339() -> Column:
    """UTC, whatever the session's zone."""
    utc = F.to_utc_timestamp("tick_ts", F.current_timezone())
    return F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def dispatch_payload() -> Column:
    """Body of the workflow call for a rollback request."""
    return F.to_json(F.struct(F.lit("main").alias("ref"), F.struct(
        "reason", F.lit("critical").alias("severity"), _rfc3339().alias("timestamp"))
        .alias("inputs")))


def webhook_payload() -> Column:
    """The rollback request itself as JSON; each anomaly carries the tick's time."""
    return F.to_json(F.struct("reason", _rfc3339().alias("timestamp"), F.transform(
        "anomalies", lambda a: F.struct(
            _rfc3339().alias("timestamp"), a["anomaly_type"].alias("anomaly_type"),
            a["severity"].alias("severity"), a["description"].alias("description"),
            a["details"].alias("details"), a["action"].alias("action"))).alias("anomalies")))


def last_stable_commit(scans: DataFrame, rollbacks: DataFrame) -> DataFrame:
    """Latest passing scan strictly before each rollback, per repository.

    scans: repo_path, commit_hash, scan_ts, passed; rollbacks: repo_path, rollback_ts.
    An as-of join without pairs: both sides are laid on one time line, and the last passing
    commit is carried forward, within a day and then from the days before.
    """
    scan_rows = scans.where("passed").select(
        "repo_path", F.col("scan_ts").alias("ts"), F.lit(1).alias("kind"), "commit_hash")
    ask_rows = rollbacks.select("repo_path", F.col("rollback_ts").alias("ts"),
                                F.lit(0).alias("kind"),
                                F.lit(None).cast("string").alias("commit_hash"))
    line = scan_rows.unionByName(ask_rows).withColumn("day", F.to_date("ts"))
    # At equal times a rollback (kind 0) comes first: the scan is not before it.
    in_day = (Window.partitionBy("repo_path", "day").orderBy("ts", "kind", "commit_hash")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    days = line.groupBy("repo_path", "day").agg(
        F.max_by("commit_hash", F.when(F.col("kind") == 1, F.struct("ts", "commit_hash")))
        .alias("last"))
    earlier = (Window.partitionBy("repo_path").orderBy("day")
               .rowsBetween(Window.unboundedPreceding, -1))
    carried = days.select("repo_path", "day",
                          F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    within = line.withColumn("within", F.last("commit_hash", ignorenulls=True).over(in_day))
    return (within.where(F.col("kind") == 0).join(carried, ["repo_path", "day"], "left")
            .select("repo_path", F.col("ts").alias("rollback_ts"),
                    F.coalesce("within", "carried").alias("stable_commit")))
