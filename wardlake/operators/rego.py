"""The declarative policy's rules as columns over one row per scan.

Inputs are the columns of ``scan_report`` plus the request's ``approved_by``,
``emergency_approved``, ``environment``, ``scanners`` and ``dependencies_scanned``.
An undefined input makes a condition false, so every condition is coalesced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake.schemas import SCAN_KEY

# Score bounds, environments, scanners and messages.
ALLOW_BELOW, APPROVAL_FROM = 70, 30
MAX_RISK = {"production": 50, "staging": 70, "development": 100}
REQUIRED_SCANNERS = ("secrets", "cve", "code_analysis")
EVAL_TEXT = "eval() usage is forbidden in production code"
SHELL_TEXT = "Shell injection vulnerability detected - deployment blocked"
UNSCANNED_TEXT = "All dependencies must be scanned for CVEs"
HOURS_TEXT = "Production deployments outside business hours require emergency approval"


def _holds(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def allow() -> Column:
    score, no_secret = F.col("risk_score"), F.col("n_critical_secrets") == 0
    clean = (score < ALLOW_BELOW) & no_secret & (F.col("n_critical_cves") == 0)
    approved = ((score >= APPROVAL_FROM) & (score < ALLOW_BELOW) & no_secret
                & (F.col("approved_by") != ""))
    return _holds(clean) | _holds(approved)


def deny_patterns() -> list[Column]:
    return [F.when(F.col("n_eval") > 0, F.lit(EVAL_TEXT)),
            F.when(F.col("n_shell") > 0, F.lit(SHELL_TEXT))]


def deny_dependency_scan() -> Column:
    """Denied when there is no CVE list at all; an empty list is a scan."""
    return F.when(~_holds(F.col("dependencies_scanned")), F.lit(UNSCANNED_TEXT))


def deny_hours(business_hours: Column | None = None) -> Column:
    """By default every hour is a business hour, so this never fires."""
    open_now = F.lit(True) if business_hours is None else _holds(business_hours)
    outside = ((F.col("branch") == "main") & ~open_now
               & ~_holds(F.col("emergency_approved")))
    return F.when(_holds(outside), F.lit(HOURS_TEXT))


def max_risk() -> Column:
    value = F.lit(None).cast("int")
    for name, bound in MAX_RISK.items():
        value = F.when(F.col("environment") == name, bound).otherwise(value)
    return value


def env_thresholds(spark: SparkSession) -> DataFrame:
    """The environments' score limits as a table; append to it or pass your own."""
    return spark.createDataFrame(list(MAX_RISK.items()), "environment string, max_risk int")


def env_threshold_join(scans: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Adds ``max_risk`` by ``environment``; null where the table has none."""
    return scans.join(thresholds.dropDuplicates(["environment"]), "environment", "left")


def deny_scanners() -> list[Column]:
    return [F.when(~_holds(F.col("scanners")[s]["status"] == "passed"),
                   F.lit(f"Required scanner '{s}' did not pass")) for s in REQUIRED_SCANNERS]


def denials(business_hours: Column | None = None) -> Column:
    """All denial messages of a scan; at most seven."""
    return F.array_compact(F.array(*deny_patterns(), deny_dependency_scan(),
                                   deny_hours(business_hours), *deny_scanners()))


def policy_merge(policy: DataFrame, denied: DataFrame) -> DataFrame:
    """Adds denials (scan key, ``denials``) to policy results; the scan's own row has them."""
    joined = policy.join(denied.select(*SCAN_KEY, "denials"), SCAN_KEY, "left")
    none = F.array().cast("array<string>")
    denied_list = F.coalesce("denials", none)
    added = F.when(F.col("file").isNull(), denied_list).otherwise(none)
    return joined.select(
        *SCAN_KEY, "file", (F.col("passed") & (F.size(denied_list) == 0)).alias("passed"),
        F.concat("violations", added).alias("violations"), "warnings")
