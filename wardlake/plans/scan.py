"""The deployment-gate scan: files and requests in, results out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.operators import report
from wardlake.operators.findings import scan_findings
from wardlake.schemas import SCAN_KEY
from wardlake.session import scratch_dir


def stored_table(rows: DataFrame, path: str | None = None) -> DataFrame:
    """Writes rows once and goes on from the table.

    Findings are tiny next to the text they come from, and statistics, score and arrays each
    read them. From a written table those reads are cheap, an executor lost later costs no
    rescan, and the planner knows the table's size.
    """
    spark = rows.sparkSession
    path = path or f"{scratch_dir(spark)}/findings"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def scan(requests: DataFrame, files: DataFrame,
         findings_path: str | None = None, **policy_options) -> DataFrame:
    findings = stored_table(scan_findings(files), findings_path)
    return report.scan_result(requests, findings, **policy_options)


def scan_key_hash() -> Column:
    return F.sha2(F.concat(*SCAN_KEY), 256)


def incremental_scan(requests: DataFrame, stored: DataFrame) -> DataFrame:
    """Requests without a stored result for the same repository, branch and commit."""
    seen = stored.select(scan_key_hash().alias("scan_hash")).distinct()
    return (requests.withColumn("scan_hash", scan_key_hash())
            .join(seen, "scan_hash", "left_anti"))
