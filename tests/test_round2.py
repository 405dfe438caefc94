"""Rules, scores and decisions outside what the tables plant."""

import re

import pytest
from pyspark.sql import functions as F

from wardlake.operators import runtime, scoring, secrets
from wardlake.operators.findings import SECRET_FAMILY
from wardlake.rules import Rule, spell
from wardlake.session import scratch_dir
from wardlake.sources import files as fs


@pytest.mark.parametrize("regex,text,hit", [
    (r'token\s*=\s*"[0-9a-f]{8}"', 'token = "deadbeef"', True),
    (r'token[\s:]*=\s*"[0-9a-f]{8}"', 'token :="deadbeef"', True),
    (r"a\Sb", "a b", False), (r"a\Sb", "axb", True), (r"a[\S]b", "a\tb", False),
    (r"a[^\s]b", "axb", True), (r"a\\sb", r"a\sb", True), (r"\[\s\]", "[ ]", True)])
def test_space_in_user_rules(spark, make_files, regex, text, hit):
    rule = Rule(0, "secret", "USER", regex)
    lines = fs.explode_lines(make_files(("a.py", text)))
    assert bool(secrets.secret_candidates(lines, [rule]).count()) is hit


def test_spelled_rules_stay_valid():
    assert re.compile(spell(r"x\s[^\s]\\s").replace("(?d)", ""))


def decided(spark, *ticks):
    rows = [("h", f"2024-01-{day:02d} {hour:02d}:00:00", kind, severity)
            for day, hour, n, severity in ticks for kind in list(runtime.CHECKS)[:n]]
    anomalies = spark.createDataFrame(
        rows, "host string, t string, anomaly_type string, severity string").select(
        "host", F.col("t").cast("timestamp").alias("tick_ts"), "anomaly_type", "severity",
        *(F.lit("").alias(c) for c in ("description", "details", "action")))
    got = runtime.rollback_decision(anomalies).orderBy("tick_ts").collect()
    assert [r.n_anomalies for r in got] == [t[2] for t in ticks]
    return [r.rollback for r in got]


def test_counter_takes_all_anomalies_of_a_tick(spark):
    calm = "HIGH"
    assert decided(spark, (1, 0, 2, calm), (1, 4, 2, calm), (1, 8, 2, calm)) == [False, True, False]
    assert decided(spark, (1, 0, 1, calm), (2, 0, 1, calm), (4, 0, 1, calm)) == [False, False, True]
    assert decided(spark, (1, 0, 2, calm), (1, 4, 1, "CRITICAL"), (2, 0, 1, calm), (3, 0, 2, calm),
                   (3, 4, 3, calm)) == [False, True, True, False, True]


def test_payload_is_in_utc(spark):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        row = spark.sql("select timestamp '2024-01-01 05:00:00 UTC' as tick_ts, 'x' as reason")
        assert '"timestamp":"2024-01-01T05:00:00Z"' in row.select(
            runtime.dispatch_payload()).first()[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_scores_of_large_and_small_scans(spark):
    def finding(repo, i, severity, confidence):
        return (repo, "b", "c", SECRET_FAMILY, ((0, ["f"], i, 0), severity, confidence, None))

    rows = [finding("large", i, "HIGH", 0.7) for i in range(2000)]
    rows += [finding("small", i, "MEDIUM", 0.1 * (i % 3)) for i in range(90)]
    table = spark.createDataFrame(rows, """repo_path string, branch string, commit_hash string,
        family int, f struct<pos struct<rank int, path_arr array<string>, at int, ordinal int>,
        severity string, confidence double, cvss double>""")
    got = {r.repo_path: r.base for r in scoring.score_base(table).collect()}
    exact = 0.0
    for i in range(90):
        exact += 10.0 * (0.1 * (i % 3))
    assert got["small"] == exact and got["large"] > scoring.SATURATED


def test_no_made_up_scratch_folder():
    class Elsewhere:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            applicationId, master = "somewhere", "yarn"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_dir(Elsewhere)
