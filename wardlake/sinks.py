"""Writers for results and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.operators import runtime
from wardlake.schemas import SCAN_KEY, SCAN_RESULT, SECRET


def scan_result_json() -> Column:
    """One JSON document per scan result row."""
    return F.to_json(F.struct(*SCAN_RESULT.names))


def write_scan_results(results: DataFrame, path: str) -> None:
    """Appends result documents as JSON lines."""
    results.select(*SCAN_RESULT.names).write.mode("append").json(path)


def secrets_report(secrets: DataFrame) -> DataFrame:
    """``{"secrets": [...]}`` per repository and file, fields named as the scanner names them."""
    renamed = {"type": "secret_type", "match": "matched_text"}
    item = F.struct(*(F.col(n).alias(renamed.get(n, n)) for n in SECRET.names))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct(
        "line", "type", item.alias("item")))),
        lambda e: e["item"])
    return secrets.groupBy(*SCAN_KEY, "file").agg(ordered.alias("secrets")).select(
        *SCAN_KEY, "file", F.to_json(F.struct("secrets"), {"pretty": "true"}).alias("report"))


def write_rollback_log(requests: DataFrame, path: str) -> None:
    """Appends rollback requests, one JSON document per line."""
    requests.select(runtime.webhook_payload().alias("value")).write.mode("append").text(path)


def write_table(rows: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """A findings table as parquet."""
    rows.write.mode("append").partitionBy(*partition_by).parquet(path)
