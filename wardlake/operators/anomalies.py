"""Unusual shapes of a scan's secret findings, reported as warnings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.schemas import SCAN_KEY

# Bounds and texts of the three checks.
CONCENTRATION = 0.8
HIGH_CONFIDENCE = 0.8
ALL_HIGH_TEXT = "All findings have high confidence - verify if legitimate"
MAJORITY_TEXT = "Majority critical secrets - high-risk scenario"


def filetype_warning() -> Column:
    """One extension holds more than 80 % of the secrets (only one can)."""
    share = F.col("top_ext.n_secrets").cast("double") / F.col("n_secrets").cast("double")
    return F.when((F.col("n_secrets") > 0) & (share > CONCENTRATION), F.concat(
        F.lit("80%+ secrets in "), F.col("top_ext.ext"),
        F.lit(" files - potential targeted leak")))


def all_high_warning() -> Column:
    return F.when((F.col("n_secrets") > 2) & (F.col("min_confidence") >= HIGH_CONFIDENCE),
                  F.lit(ALL_HIGH_TEXT))


def majority_warning() -> Column:
    """More critical secrets than half of all, the half rounded down."""
    return F.when(F.col("n_critical_secrets") > F.floor(F.col("n_secrets") / 2),
                  F.lit(MAJORITY_TEXT))


def anomaly_warnings() -> Column:
    """The scan's warnings, in check order, from the columns of ``scored_scans``."""
    return F.array_compact(F.array(filetype_warning(), all_high_warning(), majority_warning()))


def scan_anomalies(scored: DataFrame) -> DataFrame:
    """One row per warning, with its place in the order of the checks."""
    return scored.select(*SCAN_KEY, F.posexplode(anomaly_warnings()).alias("pos", "warning"))
