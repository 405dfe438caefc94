"""Token counts from a cache that is keyed by what is counted.

A row of the cache is (digest of the normalised content, digest of the tokenizer file, count).
Documents are joined to it by both; only distinct contents that it lacks are encoded, and their
counts are appended. A copied text is encoded once however often it occurs, a new version of
the tokenizer never meets old counts, and a run that was broken off goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake.llm.common import stored
from wardlake.llm.tokens import encoder, file_digest

CACHE = "content binary, tokenizer string, n_tokens long"
LIMIT = 1024


def as_it_is(text: Column) -> Column:
    """Null is empty. Byte-level files have no normaliser: every code point counts."""
    return F.coalesce(text, F.lit(""))


def read_cache(spark: SparkSession, path: str, tokenizer_digest: str) -> DataFrame:
    """Counts of this tokenizer file, one row per content (two runs may have added the same)."""
    try:
        rows = spark.read.schema(CACHE).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        rows = spark.createDataFrame([], CACHE)
    return (rows.where(F.col("tokenizer") == tokenizer_digest)
            .groupBy("content").agg(F.max("n_tokens").alias("n_tokens")))


def encode_misses(contents: DataFrame, tokenizer: str, tokenizer_digest: str) -> DataFrame:
    """Counts for rows (content, text), in the layout of the cache."""
    def count(batches):
        library = encoder(tokenizer)
        for batch in batches:
            n = [len(library.encode(t.as_py())) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([tokenizer_digest] * len(n), pa.string()),
                 pa.array(n, pa.int64())], names=["content", "tokenizer", "n_tokens"])

    return contents.mapInArrow(count, CACHE)


def token_counts(docs: DataFrame, tokenizer: str, cache: str, limit: int = LIMIT,
                 normalise: Callable[[Column], Column] = as_it_is, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` per row of ``docs``; ``cache`` grows.

    ``cache`` is a folder that all executors share. ``normalise`` says which texts count as the
    same, so it must not change the count. Null and empty texts have no tokens. Repeated rows
    get the same count each. An empty table gives an empty result; other columns are ignored.
    """
    spark, version = docs.sparkSession, file_digest(tokenizer)
    text = normalise(F.col(text_col))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"),
                       F.unhex(F.sha2(text, 256)).alias("content"))
    distinct = base.groupBy("content").agg(F.first("text").alias("text"))
    misses = distinct.join(read_cache(spark, cache, version), "content", "left_anti")
    (encode_misses(misses.select("content", "text"), tokenizer, version)
     .write.mode("append").parquet(cache))
    keyed = stored(base.select("doc_id", "content", F.octet_length("text").cast("long")
                               .alias("n_bytes")), "keys")
    return (keyed.join(read_cache(spark, cache, version), "content", "left")
            .select("doc_id", "n_bytes", "n_tokens",
                    (F.col("n_tokens") > limit).alias("over_limit")))
