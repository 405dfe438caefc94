"""A corpus made ready for training: quality rules, line dedup, near-duplicate removal, a mix of
sources, packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the
last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake.llm import line_dedup, line_frequency, mixing, packing, simhash
from wardlake.llm.common import digest, stored
from wardlake.llm.queries import documents, tokenizer_path

#: Words of a block in the mix: long, as documents are cut where a block is left out.
MIX_BLOCK = 256


def _with_text(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The columns of ``docs`` from ``row``, with ``text`` and its length brought up to date."""
    def column(name: str) -> Column:
        if name == "text":
            return F.col("text")
        if name == "n_chars":
            return F.length("text").cast(docs.schema[name].dataType).alias(name)
        return F.col(f"row.{name}")

    return rows.select(*(column(c) for c in docs.columns))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, without their host's boilerplate lines."""
    judged = line_frequency.quality_rules(docs, with_rows=True)
    return _with_text(docs, judged.where("kept"))


def shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; lines that many share stay in one of them."""
    return _with_text(docs, line_dedup.line_dedup(docs, with_rows=True))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the smallest id.

    The SimHash operator (op7) with its contract's parameters: 3-word shingles, fingerprints
    linked at 2 or fewer differing bits, groups as connected components; no other check.
    """
    kept = (simhash.near_duplicates(docs, width=simhash.SHINGLE, distance=simhash.DISTANCE)
            .where("representative")
            .select(F.col("doc_id").alias("k_id"), F.col("d1").alias("k1"),
                    F.col("d2").alias("k2")).distinct())
    d1, d2 = digest(F.coalesce("text", F.lit("")))
    # Rows alike in id and text are one document; what else they hold may differ.
    return (docs.withColumns({"d1": d1, "d2": d2})
            .join(kept, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("d1") == F.col("k1"))
                  & (F.col("d2") == F.col("k2")), "left_semi")
            .dropDuplicates(["doc_id", "d1", "d2"]).select(*docs.columns))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each time that the mix takes a document, with the words taken."""
    mixed = mixing.mixed_documents(docs, block=MIX_BLOCK)
    if "n_chars" not in docs.columns:
        return mixed
    kind = docs.schema["n_chars"].dataType
    return mixed.withColumn("n_chars", F.length("text").cast(kind))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: a row for each piece of a document."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("quality_rules", quality_rules), ("line_dedup", shared_lines),
          ("simhash_near_dedup", near_duplicates), ("source_mix", source_mix),
          ("best_fit_packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is a written table for the next."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: Token ids and connected groups are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None
