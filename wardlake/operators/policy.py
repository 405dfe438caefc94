"""Deployment policy over scored scans.

The verdict needs only counts. Messages are rows; arrays of messages are built from rows
by ``report.in_parts``, which bounds what one row may hold.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.operators import anomalies
from wardlake.operators.findings import CVE_FAMILY, SECRET_FAMILY
from wardlake.schemas import SCAN_KEY

# Highest score (exclusive) per environment.
THRESHOLDS = {"prod": 50, "staging": 70, "dev": 100}
CRITICAL_CVSS, HIGH_CVSS = 9.0, 7.0
CRITICAL_CODE = 3
VIOLATION, WARNING = "violation", "warning"


def deploy_env(branch: Column, explicit: Column) -> Column:
    """An explicit environment wins; otherwise the branch name decides."""
    by_branch = (F.when(branch.contains("main") | branch.contains("master"), "prod")
                 .when(branch.contains("staging"), "staging").otherwise("dev"))
    return F.coalesce(F.nullif(explicit, F.lit("")), by_branch)


def env_threshold(env: Column, thresholds: Mapping[str, int] = THRESHOLDS) -> Column:
    """Unknown environments get the threshold of dev."""
    return (F.when(env == "prod", thresholds["prod"])
            .when(env == "staging", thresholds["staging"]).otherwise(thresholds["dev"]))


def with_verdict(scored: DataFrame, thresholds: Mapping[str, int] = THRESHOLDS) -> DataFrame:
    explicit = F.col("deploy_env") if "deploy_env" in scored.columns else F.lit(None).cast(
        "string")
    out = scored.withColumn("env", deploy_env(F.col("branch"), explicit))
    out = out.withColumn("threshold", env_threshold(F.col("env"), thresholds))
    passed = ((F.col("risk_score") < F.col("threshold")) & (F.col("n_critical_secrets") == 0)
              & (F.col("n_critical_cves") == 0))
    return out.withColumn("passed", passed)


def risk_message() -> Column:
    return F.when(F.col("risk_score") >= F.col("threshold"), F.format_string(
        "Risk score %d exceeds %s threshold of %d", F.col("risk_score"), F.col("env"),
        F.col("threshold")))


def code_message() -> Column:
    return F.when(F.col("n_critical_code") >= CRITICAL_CODE, F.format_string(
        "%d critical code patterns detected", F.col("n_critical_code")))


def secret_message(kind: Column, file: Column, line: Column) -> Column:
    return F.format_string("Critical secret detected: %s in %s:%d", kind, file, line)


def cve_message(cve: Column) -> Column:
    """``cve`` is a struct with the fields of a CVE finding."""
    lead = F.when(cve["cvss"] >= CRITICAL_CVSS, "Critical CVE detected").otherwise(
        "High severity CVE")
    return F.format_string("%s: %s (CVSS %.1f) in %s", lead, cve["cve"], cve["cvss"],
                           cve["package"])


def risk_messages(verdicts: DataFrame) -> DataFrame:
    return (verdicts.select(*SCAN_KEY, risk_message().alias("message"))
            .where(F.col("message").isNotNull()))


def secret_messages(findings: DataFrame) -> DataFrame:
    """One violation per critical secret."""
    hit = (F.col("family") == SECRET_FAMILY) & (F.col("f.severity") == "CRITICAL")
    message = secret_message(F.col("f.type"), F.col("f.file"), F.col("f.line"))
    return findings.where(hit).select(*SCAN_KEY, "f.pos", message.alias("message"))


def cve_messages(findings: DataFrame) -> DataFrame:
    """CVSS 9 and above is a violation, 7 and above a warning."""
    hit = (F.col("family") == CVE_FAMILY) & (F.col("f.cvss") >= HIGH_CVSS)
    kind = F.when(F.col("f.cvss") >= CRITICAL_CVSS, VIOLATION).otherwise(WARNING)
    cve = F.struct(F.col("f.type").alias("cve"), "f.cvss", "f.package")
    return findings.where(hit).select(*SCAN_KEY, "f.pos", kind.alias("kind"),
                                      cve_message(cve).alias("message"))


def code_messages(verdicts: DataFrame) -> DataFrame:
    return (verdicts.select(*SCAN_KEY, code_message().alias("message"))
            .where(F.col("message").isNotNull()))
