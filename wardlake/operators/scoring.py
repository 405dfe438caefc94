"""Risk scores per scan.

The score is a left-to-right sum of doubles in finding order, so it cannot be a plain
``sum``. It is also capped, and contributions are never negative: a scan whose plain sum, in
whatever order, is past ``SATURATED`` scores 100. That sum is taken first, partly before the
shuffle; only the other scans, which can't have many contributions, are folded in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlake.functions import paths
from wardlake.operators.findings import CODE_FAMILY, CVE_FAMILY, SECRET_FAMILY
from wardlake.schemas import SCAN_KEY

# Points per severity or CVSS band, adjustments and the cap.
SECRET_POINTS = {"CRITICAL": 30.0, "HIGH": 20.0, "MEDIUM": 10.0}
CVSS_POINTS = ((9.0, 25.0), (7.0, 15.0), (4.0, 10.0))
CVSS_REST = 5.0
CODE_POINTS = {"CRITICAL": 20.0, "HIGH": 15.0, "MEDIUM": 8.0, "LOW": 3.0}
DIVERSITY_TYPES, DIVERSITY_POINTS = 3, 10.0
LOW_CONFIDENCE, LOW_CONFIDENCE_FACTOR = 0.6, 0.7
MAX_SCORE = 100
LEVELS = (("CRITICAL", 70), ("HIGH", 50), ("MEDIUM", 30))

SATURATED = MAX_SCORE / LOW_CONFIDENCE_FACTOR + 1


def _points(severity: Column, table: dict[str, float]) -> Column:
    value = F.lit(0.0)
    for name, points in table.items():
        value = F.when(severity == name, points).otherwise(value)
    return value


def contribution() -> Column:
    """Points one finding adds."""
    cvss = F.col("f.cvss")
    cve = F.lit(CVSS_REST)
    for bound, points in reversed(CVSS_POINTS):
        cve = F.when(cvss >= bound, points).otherwise(cve)
    secret = _points(F.col("f.severity"), SECRET_POINTS) * F.col("f.confidence")
    code = _points(F.col("f.severity"), CODE_POINTS)
    return (F.when(F.col("family") == SECRET_FAMILY, secret)
            .when(F.col("family") == CVE_FAMILY, cve).otherwise(code))


def score_base(findings: DataFrame) -> DataFrame:
    """Ordered sum of contributions per scan; any sum past saturation for the rest."""
    points = (findings.select(*SCAN_KEY, "family", "f.pos", contribution().alias("points"))
              .where(F.col("points") > 0.0))
    totals = points.groupBy(*SCAN_KEY).agg(F.sum("points").alias("total"))
    unsaturated = points.join(totals.where(F.col("total") < SATURATED), SCAN_KEY, "left_semi")
    # A running sum adds row by row in order, and never falls: its maximum is the last one.
    in_order = (Window.partitionBy(*SCAN_KEY).orderBy("family", "pos")
                .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    exact = (unsaturated.withColumn("running", F.sum("points").over(in_order))
             .groupBy(*SCAN_KEY).agg(F.max("running").alias("base")))
    return totals.join(exact, SCAN_KEY, "left").select(
        *SCAN_KEY, F.coalesce("base", "total").alias("base"))


def scan_stats(findings: DataFrame) -> DataFrame:
    """Counts and extremes per scan.

    First by file extension (needed for the concentration check), then by scan; both
    aggregate before they shuffle.
    """
    f, family = F.col("f"), F.col("family")
    is_secret, critical = family == SECRET_FAMILY, F.col("f.severity") == "CRITICAL"
    ext = F.when(is_secret, paths.dotted_extension(f["file"])).otherwise("")

    def count_of(condition: Column) -> Column:
        return F.count(F.when(condition, 1))

    by_ext = findings.groupBy(*SCAN_KEY, ext.alias("ext")).agg(
        count_of(is_secret).alias("n_secrets"),
        count_of(family == CVE_FAMILY).alias("n_cves"),
        count_of(family == CODE_FAMILY).alias("n_code_issues"),
        count_of(is_secret & critical).alias("n_critical_secrets"),
        count_of((family == CODE_FAMILY) & critical).alias("n_critical_code"),
        count_of((family == CVE_FAMILY) & (f["cvss"] >= 9.0)).alias("n_critical_cves"),
        count_of((family == CODE_FAMILY) & (f["type"] == "EVAL")).alias("n_eval"),
        count_of((family == CODE_FAMILY) & (f["type"] == "SHELL_INJECTION")).alias("n_shell"),
        # A set of rule names: bounded by the rule list, not by the findings.
        F.collect_set(F.when(is_secret, f["type"])).alias("types"),
        F.max(F.when(is_secret, f["confidence"])).alias("max_confidence"),
        F.min(F.when(is_secret, f["confidence"])).alias("min_confidence"))
    totals = [c for c in by_ext.columns if c.startswith("n_")]
    return by_ext.groupBy(*SCAN_KEY).agg(
        *(F.sum(c).alias(c) for c in totals),
        F.size(F.array_distinct(F.flatten(F.collect_set("types")))).alias("n_secret_types"),
        F.max("max_confidence").alias("max_confidence"),
        F.min("min_confidence").alias("min_confidence"),
        F.max(F.struct("n_secrets", "ext")).alias("top_ext"))


def final_score() -> Column:
    """From ``base``, ``n_secrets``, ``n_secret_types`` and ``max_confidence``."""
    base = F.coalesce(F.col("base"), F.lit(0.0))
    diverse = base + F.when(F.col("n_secret_types") >= DIVERSITY_TYPES,
                            DIVERSITY_POINTS).otherwise(0.0)
    all_low = (F.col("n_secrets") > 0) & (F.col("max_confidence") <= LOW_CONFIDENCE)
    adjusted = diverse * F.when(all_low, LOW_CONFIDENCE_FACTOR).otherwise(1.0)
    return F.least(F.floor(adjusted).cast("int"), F.lit(MAX_SCORE))


def risk_level(score: Column) -> Column:
    level = F.lit("LOW")
    for name, bound in reversed(LEVELS):
        level = F.when(score >= bound, name).otherwise(level)
    return level


COUNTS = ("n_secrets", "n_cves", "n_code_issues", "n_critical_secrets", "n_critical_code",
          "n_critical_cves", "n_eval", "n_shell", "n_secret_types")


def scored_scans(requests: DataFrame, findings: DataFrame) -> DataFrame:
    """Every requested scan with its statistics, score and level; scans without findings too."""
    joined = (requests.join(scan_stats(findings), SCAN_KEY, "left")
              .join(score_base(findings), SCAN_KEY, "left"))
    filled = joined.fillna(0, subset=list(COUNTS))
    scored = filled.withColumn("risk_score", final_score())
    return scored.withColumn("risk_level", risk_level(F.col("risk_score")))


def risk_score(requests: DataFrame, findings: DataFrame) -> DataFrame:
    return scored_scans(requests, findings).select(*SCAN_KEY, "risk_score", "risk_level")
