import json

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from wardlake import sinks
from wardlake.operators import code, deps, policy, rego, report, scoring, secrets
from wardlake.operators.findings import (code_issues_of, cves_of, scan_findings, secrets_of)
from wardlake.plans import scan as plan
from wardlake.sources import derived as d
from wardlake.sources import files as fs


def same(a, b):
    cols = sorted(a.columns)
    return (a.select(cols).exceptAll(b.select(cols)).isEmpty()
            and b.select(cols).exceptAll(a.select(cols)).isEmpty())


@pytest.fixture(scope="module")
def found(spark):
    return scan_findings(d.scan_files(spark, SF)).persist()


def test_one_pass_equals_the_separate_operators(spark, found):
    files = d.scan_files(spark, SF)
    assert same(secrets_of(found), secrets.secrets_gate(files))
    assert same(code_issues_of(found), code.code_issues(files))
    assert same(cves_of(found), deps.cve_findings(files))


def test_code_checks(make_files):
    files = make_files(
        ("a.py", "x = eval(y)\n# eval(y)\nmyeval(y)\néeval(z)"), ("b.py", 'run("EVAL", eval(x))'),
        ("agent.py", "os.system('netstat -an')"), ("other.py", "os.system('netstat -an')"),
        ("c.py", 'exec.Command("/bin/sh", "sh", "-c", cmd)'),
        ("d.py", 'execute("select %s" % x)\nexecute("select %s", ?)'),
        ("e.py", "ip = 10.1.2.3\nlocal = 127.0.0.1\nx1.2.3.4"))
    got = sorted((r.file, r.line, r.type) for r in code.code_issues(files).collect())
    assert got == [
        ("a.py", 1, "EVAL"), ("a.py", 1, "UNSAFE_DESERIALIZATION"),
        ("a.py", 3, "UNSAFE_DESERIALIZATION"), ("a.py", 4, "EVAL"),
        ("a.py", 4, "UNSAFE_DESERIALIZATION"), ("b.py", 1, "UNSAFE_DESERIALIZATION"),
        ("d.py", 1, "SQL_INJECTION"), ("e.py", 1, "HARDCODED_IP"),
        ("other.py", 1, "SHELL_INJECTION")]


def brute_score(findings):
    """The ordered sum in plain Python over all findings of one scan."""
    score, types = 0.0, set()
    confidences = []
    for f in findings:
        if f["family"] == 0:
            score += {"CRITICAL": 30.0, "HIGH": 20.0, "MEDIUM": 10.0}.get(f["severity"], 0.0) * f["confidence"]
            types.add(f["type"])
            confidences.append(f["confidence"])
        elif f["family"] == 1:
            score += 25 if f["cvss"] >= 9 else 15 if f["cvss"] >= 7 else 10 if f["cvss"] >= 4 else 5
        else:
            score += {"CRITICAL": 20, "HIGH": 15, "MEDIUM": 8, "LOW": 3}[f["severity"]]
    if len(types) >= 3:
        score += 10
    if confidences and max(confidences) <= 0.6:
        score *= 0.7
    return min(int(score), 100)


def test_score_equals_a_plain_loop(spark, found):
    rows = found.select("repo_path", "family", "f.*").collect()
    by_repo = {}
    for r in sorted(rows, key=lambda r: (r.family, tuple(r.pos))):
        by_repo.setdefault(r.repo_path, []).append(r.asDict())
    got = {r.repo_path: r.risk_score
           for r in scoring.risk_score(d.requests(spark, SF), found).collect()}
    assert len(got) == d.requests(spark, SF).count()
    for repo, score in got.items():
        assert score == brute_score(by_repo.get(repo, [])), repo


def test_score_of_a_scan_with_very_many_findings(spark, make_files):
    lines = "\n".join(f"h = 10.0.{i // 250}.{i % 250 + 1}" for i in range(2000))
    files = make_files(("a.py", lines), ("b.py", "x = 1"))
    requests = files.select("repo_path", "branch", "commit_hash").distinct().withColumn(
        "scan_ts", F.lit("2024-01-01").cast("timestamp"))
    found = scan_findings(files)
    assert scoring.risk_score(requests, found).first().risk_score == 100
    documents = {r.file: r for r in plan.scan(requests, files).collect()}
    assert set(documents) == {None, "a.py"}
    issues = [(i.file, i.line) for i in documents["a.py"].code_issues]
    assert issues == [("a.py", i + 1) for i in range(2000)]
    assert documents[None].summary == documents["a.py"].summary
    assert documents[None].policy_result.violations == [
        "Risk score 100 exceeds prod threshold of 50"]
    assert documents["a.py"].policy_result.violations == []


def test_documents_of_a_scan_with_25000_findings(spark, make_files):
    line = 'aws = "AKIA{:016d}"'
    files = make_files(*(
        (f"f{n}.py", "\n".join(line.format(n * 2500 + i) for i in range(2500))) for n in range(10)))
    requests = files.select("repo_path", "branch", "commit_hash").distinct().withColumn(
        "scan_ts", F.lit("2024-01-01").cast("timestamp"))
    documents = {r.file: r for r in plan.scan(requests, files).collect()}
    assert len(documents) == 11
    assert documents[None].summary.startswith("Scan completed: 25000 secrets, 0 CVEs, 0 code")
    assert documents[None].policy_result.violations == [
        "Risk score 100 exceeds prod threshold of 50"]
    for n in range(10):
        assert documents[f"f{n}.py"].policy_result.violations == [
            f"Critical secret detected: AWS_KEY in f{n}.py:{i + 1}" for i in range(2500)]
    judged = {r.file: r.violations for r in report.validate_policy(
        plan.scan(requests, files)).collect()}
    assert judged == {f: r.policy_result.violations for f, r in documents.items()}


def test_level_and_environment(spark):
    rows = spark.createDataFrame(
        [("main", None, 70), ("x-staging", None, 69), ("dev", None, 30), ("main", "qa", 29), ("m", "", 50)],
        "branch string, deploy_env string, s int")
    env = policy.deploy_env(F.col("branch"), F.col("deploy_env"))
    got = [tuple(r) for r in rows.select(
        scoring.risk_level(F.col("s")), env, policy.env_threshold(env)).collect()]
    assert got == [("CRITICAL", "prod", 50), ("HIGH", "staging", 70), ("MEDIUM", "dev", 100),
                   ("LOW", "qa", 100), ("HIGH", "dev", 100)]


def test_scan_result_documents_round_trip(spark, tmp_path):
    results = plan.scan(d.requests(spark, SF), d.scan_files(spark, SF)).persist()
    path = str(tmp_path / "results")
    sinks.write_scan_results(results, path)
    back = fs.read_scan_results(spark, path)
    assert same(back, results)
    doc = json.loads(results.select(sinks.scan_result_json().alias("j")).first().j)
    assert set(doc) >= {"repo_path", "risk_score", "passed", "policy_result", "summary"}
    # No raw secret leaves the plan.
    assert not results.where(F.to_json("secrets").rlike("AKIA[0-9A-Z]{16}")).count()
    judged = report.validate_policy(back)
    stored = results.select("repo_path", "passed").join(
        judged.select("repo_path", F.col("passed").alias("again")), "repo_path")
    assert stored.where("passed <> again").isEmpty()
    said = "file is null or size(policy_result.violations) + size(policy_result.warnings) > 0"
    assert judged.count() == results.where(said).count()
    text = report.markdown_report(results).where("repo_path = 'repo0' and file is null").first().markdown
    assert text.startswith("# Security scan: repo0\n\nScan completed: ")
    assert plan.incremental_scan(d.requests(spark, SF), results).isEmpty()


def test_rego_rules(spark):
    rows = spark.createDataFrame(
        [(69, 0, 0, None, True, None), (40, 0, 1, "a", True, None), (40, 0, 1, "", True, None),
         (70, 0, 0, "a", None, None)],
        "risk_score int, n_critical_secrets int, n_critical_cves int, approved_by string, "
        "dependencies_scanned boolean, scanners map<string,struct<status:string>>")
    got = rows.select(rego.allow().alias("a"), rego.deny_dependency_scan().alias("d"),
                      F.size(F.array_compact(F.array(*rego.deny_scanners()))).alias("n")).collect()
    assert [r.a for r in got] == [True, True, False, False]
    assert [r.d is None for r in got] == [True, True, True, False]
    assert [r.n for r in got] == [3, 3, 3, 3]


def test_read_files_from_disk(spark, tmp_path):
    (tmp_path / "sub dir").mkdir()
    (tmp_path / "sub dir" / "a+b.py").write_bytes(b"x = eval(y)\n\xff")
    (tmp_path / "package.json").write_text('{"lodash": "4.16.1"}')
    files = fs.read_files(spark, str(tmp_path), "main", "c1")
    got = fs.with_rel_path(files).select("rel_path").collect()
    assert {r.rel_path for r in got} == {"sub dir/a+b.py", "package.json"}
    assert {r.cve for r in deps.cve_findings(files).collect()} == {"CVE-2021-23337"}
    if "test_" not in str(tmp_path):
        assert code.code_issues(files).count() == 2


def test_pipeline_reads_the_text_once(spark):
    other = SF.replace("sf0.001", "sf0.01")  # not the cached table of the other tests
    plan_text = scan_findings(d.scan_files(spark, other))._jdf.queryExecution().toString()
    scans = [x for x in plan_text.split("== Physical Plan ==")[1].split("\n") if "FileScan" in x]
    assert sum("text" in x.split("ReadSchema")[1] for x in scans) == 1


def test_read_several_repositories(spark, tmp_path):
    for name in ("one", "two"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "requirements.txt").write_text("django==2.2\n")
    files = fs.read_repositories(spark, [
        {"repo_path": str(tmp_path / n), "branch": n, "commit_hash": "c"} for n in ("one", "two")])
    got = sorted((r.branch, r.cve) for r in deps.cve_findings(files).collect())
    assert got == [("one", "CVE-2023-24580"), ("two", "CVE-2023-24580")]
