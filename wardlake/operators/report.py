"""Result documents: nested rows, summaries, reports.

A document holds arrays, and one repository may own a third of all findings, so there is a
document for each file of a scan, which is bounded as the file is, and one without a file that
carries what is said about the scan as a whole. Every scan has that shape, whatever its size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.operators import anomalies, policy
from wardlake.operators.findings import (CODE_FAMILY, CVE_FAMILY, SECRET_FAMILY)
from wardlake.operators.scoring import scored_scans
from wardlake.schemas import CODE_ISSUE, CVE, SCAN_KEY, SCAN_RESULT, SECRET

def summary() -> Column:
    verdict = F.when(F.col("passed"), "APPROVED").otherwise("BLOCKED")
    return F.format_string(
        "Scan completed: %d secrets, %d CVEs, %d code issues. Risk level: %s (%d/100). "
        "Deployment %s.", F.col("n_secrets"), F.col("n_cves"), F.col("n_code_issues"),
        F.col("risk_level"), F.col("risk_score"), verdict)


def scan_report(requests: DataFrame, findings: DataFrame, **policy_options) -> DataFrame:
    """One flat row per scan: score, level, verdict, counts, summary. No unbounded column."""
    verdicts = policy.with_verdict(scored_scans(requests, findings), **policy_options)
    return verdicts.withColumn("summary", summary())


def gate_exit_code() -> Column:
    return F.when(F.col("passed"), 0).otherwise(1)


def _collect(slot: int, payload: Column) -> Column:
    """Payloads of one slot in order; rows of other slots are null and not collected."""
    picked = F.when(F.col("slot") == slot, F.struct("rule", "pos", payload.alias("item")))
    return F.transform(F.array_sort(F.collect_list(picked)), lambda e: e["item"])


def _fields(schema, **renamed: str) -> Column:
    return F.struct(*(F.col(f"f.{renamed.get(n, n)}").alias(n) for n in schema.names))


def _texts(*messages: Column) -> Column:
    return F.array_compact(F.array(*messages))


def _empty(name: str) -> Column:
    return F.array().cast(SCAN_RESULT[name].dataType)


def _messages(whole_scan: Column, with_anomalies: bool) -> tuple[Column, Column]:
    """Violations and warnings of one document, in the order of the checks.

    From its own arrays, and for the scan's own document from the counts and the verdict.
    """
    critical_secrets = F.filter("secrets", lambda s: s["severity"] == "CRITICAL")
    violations = F.concat(
        _texts(F.when(whole_scan, policy.risk_message())),
        F.transform(critical_secrets, lambda s: policy.secret_message(
            s["type"], s["file"], s["line"])),
        F.transform(F.filter("cves", lambda c: c["cvss"] >= policy.CRITICAL_CVSS),
                    policy.cve_message))
    warnings = F.concat(
        F.transform(F.filter("cves", lambda c: (c["cvss"] >= policy.HIGH_CVSS)
                             & (c["cvss"] < policy.CRITICAL_CVSS)), policy.cve_message),
        _texts(F.when(whole_scan, policy.code_message())),
        F.when(whole_scan, anomalies.anomaly_warnings())
        .otherwise(F.array().cast("array<string>")) if with_anomalies
        else F.array().cast("array<string>"))
    return violations, warnings


def scan_result(requests: DataFrame, findings: DataFrame, with_anomalies: bool = True,
                **policy_options) -> DataFrame:
    """Nested results (see ``SCAN_RESULT``): per scan a row without a file and one per file.

    ``findings`` is read by three branches (statistics, score, arrays): pass a written table.
    """
    report = scan_report(requests, findings, **policy_options)
    arrays = (findings.select(*SCAN_KEY, F.col("f.file").alias("file"),
                              F.col("family").alias("slot"), F.lit(0).alias("rule"),
                              F.col("f.pos").alias("pos"), "f")
              .groupBy(*SCAN_KEY, "file").agg(
                  _collect(SECRET_FAMILY, _fields(SECRET)).alias("secrets"),
                  _collect(CVE_FAMILY, _fields(CVE, cve="type")).alias("cves"),
                  _collect(CODE_FAMILY, _fields(CODE_ISSUE)).alias("code_issues")))
    arrays = arrays.select(*SCAN_KEY, "file", *(
        F.col(n).cast(SCAN_RESULT[n].dataType).alias(n) for n in ("secrets", "cves", "code_issues")))
    scans = requests.select(*SCAN_KEY, F.lit(None).cast("string").alias("file"), *(
        _empty(n).alias(n) for n in ("secrets", "cves", "code_issues")))
    violations, warnings = _messages(F.col("file").isNull(), with_anomalies)
    return report.join(arrays.unionByName(scans), SCAN_KEY).select(
        F.col("scan_ts").alias("timestamp"), *SCAN_KEY, "file", "risk_score", "risk_level",
        "passed", "secrets", "cves", "code_issues",
        F.struct("passed", violations.alias("violations"), warnings.alias("warnings"))
        .alias("policy_result"), "summary")


def _with_messages_only(results: DataFrame) -> DataFrame:
    """Verdicts and messages; files without any are left out."""
    said = F.size("violations") + F.size("warnings") > 0
    return results.where(F.col("file").isNull() | said)


def policy_result(requests: DataFrame, findings: DataFrame, **policy_options) -> DataFrame:
    """passed + ordered violations and warnings, of the scan and of each file with some."""
    result = scan_result(requests, findings, with_anomalies=False, **policy_options)
    return _with_messages_only(result.select(*SCAN_KEY, "file", "policy_result.*"))


def validate_policy(results: DataFrame, **options) -> DataFrame:
    """Policy over stored results: their score is taken as given, nothing is rescanned."""
    def critical(name: str, condition) -> Column:
        return F.sum(F.size(F.filter(name, condition))).alias(f"n_critical_{name}")

    counts = results.groupBy(*SCAN_KEY).agg(
        F.max("risk_score").alias("risk_score"),
        critical("secrets", lambda x: x["severity"] == "CRITICAL"),
        critical("cves", lambda x: x["cvss"] >= policy.CRITICAL_CVSS),
        critical("code_issues", lambda x: x["severity"] == "CRITICAL")
        .alias("n_critical_code"))
    verdicts = policy.with_verdict(counts, **options)
    violations, warnings = _messages(F.col("file").isNull(), with_anomalies=False)
    judged = results.select(*SCAN_KEY, "file", "secrets", "cves").join(verdicts, SCAN_KEY)
    return _with_messages_only(judged.select(
        *SCAN_KEY, "file", "passed", violations.alias("violations"), warnings.alias("warnings")))


def markdown_report(results: DataFrame) -> DataFrame:
    """Text per scan and file: summary, then one bullet per finding and message."""
    def bullets(title: str, items: Column) -> Column:
        return F.when(F.size(items) > 0, F.concat(
            F.lit(f"\n\n## {title}\n"), F.array_join(items, "\n"))).otherwise("")

    secrets = F.transform("secrets", lambda s: F.format_string(
        "- %s (%s) in %s:%d", s["type"], s["severity"], s["file"], s["line"]))
    cves = F.transform("cves", lambda c: F.format_string(
        "- %s (%s) in %s", c["cve"], c["severity"], c["package"]))
    issues = F.transform("code_issues", lambda i: F.format_string(
        "- %s (%s) in %s:%d", i["type"], i["severity"], i["file"], i["line"]))

    def plain(name: str) -> Column:
        return F.transform(F.col("policy_result")[name], lambda m: F.concat(F.lit("- "), m))

    text = F.concat(
        F.lit("# Security scan: "), F.col("repo_path"), F.lit("\n\n"), F.col("summary"),
        bullets("Secrets", secrets), bullets("CVEs", cves), bullets("Code issues", issues),
        bullets("Violations", plain("violations")), bullets("Warnings", plain("warnings")))
    return results.select(*SCAN_KEY, "file", text.alias("markdown"))
