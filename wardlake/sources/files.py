"""File tables: one row per file, keyed by scan; and their lines."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake.functions import paths
from wardlake.functions.text import drop_trailing_cr
from wardlake.schemas import FILE, SCAN_KEY, SCAN_RESULT


def read_files(spark: SparkSession, root: str, branch: str = "", commit_hash: str = "",
               repo_path: str | None = None) -> DataFrame:
    """Every file below ``root``. Bytes are kept as they are, valid UTF-8 or not."""
    found = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root))
    path = F.regexp_replace("path", r"\Afile:/{0,2}(?=/)", "")
    return found.select(
        F.lit(repo_path if repo_path is not None else root.rstrip("/")).alias("repo_path"),
        F.lit(branch).alias("branch"),
        F.lit(commit_hash).alias("commit_hash"),
        F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))).alias("path"),
        F.col("content").cast("string").alias("content"),
    )


def read_repositories(spark: SparkSession, requests: Iterable[dict]) -> DataFrame:
    """Files of several requests (dicts with repo_path, branch, commit_hash)."""
    tables = [read_files(spark, r["repo_path"], r.get("branch", ""), r.get("commit_hash", ""))
              for r in requests]
    files = tables[0]
    for other in tables[1:]:
        files = files.unionByName(other)
    return files


def read_file_table(spark: SparkSession, path: str) -> DataFrame:
    """A parquet table already in the ``files`` layout."""
    return spark.read.schema(FILE).parquet(path)


def read_scan_results(spark: SparkSession, path: str) -> DataFrame:
    """Stored scan results, one JSON document per line."""
    return spark.read.schema(SCAN_RESULT).json(path)


def parse_scan_results(documents: DataFrame, column: str = "document") -> DataFrame:
    """Scan results held as JSON text in a column."""
    return documents.select(F.from_json(column, SCAN_RESULT).alias("r")).select("r.*")


def spread(table: DataFrame, *keys: str) -> DataFrame:
    """Repartitions a table read in fewer splits than there are cores (say one row group).

    Decided from the scan's split count, without running anything. Tables of many splits,
    as any large one is, come back unchanged.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    if table.rdd.getNumPartitions() >= cores:
        return table
    return table.repartition(cores, *keys)


def with_rel_path(files: DataFrame) -> DataFrame:
    return files.withColumn("rel_path", paths.relative_path(F.col("repo_path"), F.col("path")))


def gate_files(files: DataFrame) -> DataFrame:
    return files.where(~paths.gate_skips(F.col("path")))


def strict_files(files: DataFrame) -> DataFrame:
    """Strict profile: directory pruning, extension list, and only valid UTF-8."""
    kept = with_rel_path(files).where(~paths.strict_skips(F.col("rel_path")))
    if "content" in files.columns:
        kept = kept.where(F.is_valid_utf8("content"))
    return kept.select(*files.columns)


def api_source_files(files: DataFrame) -> DataFrame:
    return files.where(paths.is_api_source(F.col("path")))


def repo_source_files(files: DataFrame) -> DataFrame:
    return (with_rel_path(files).where(paths.is_repo_source(F.col("rel_path")))
            .select(*files.columns))


def manifest_files(files: DataFrame) -> DataFrame:
    return with_rel_path(files).where(paths.is_manifest(F.col("rel_path")))


def explode_lines(files: DataFrame, strip_cr: bool = False, *carry: str) -> DataFrame:
    """Lines with 1-based numbers. The file's text itself is not carried along."""
    rows = with_rel_path(files).select(
        *SCAN_KEY, "path", "rel_path", *carry,
        F.posexplode(F.split("content", "\n")).alias("pos", "text"))
    text = drop_trailing_cr(F.col("text")) if strip_cr else F.col("text")
    return rows.select(*SCAN_KEY, "path", "rel_path", *carry,
                       (F.col("pos") + 1).alias("line"), text.alias("text"))
