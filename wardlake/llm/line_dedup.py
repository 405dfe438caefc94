"""Lines that many documents share, kept once.

Normalised lines are exploded and hashed, distinct documents are counted per hash, lines of
hashes at the threshold are dropped by position, and the rest is put together in order. Only
hashes and positions are shuffled for the counts; a line that a third of all documents hold is
counted with partial sums and met again in a join that Spark can split. Hashes have 128 bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.llm.common import BLANKS, ascii_lower, digest, split_lines, stored, without_positions

MIN_CHARS, MIN_DOCS = 40, 5


def stripped(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
               id_col: str = "doc_id", text_col: str = "text",
               with_rows: bool = False) -> DataFrame:
    """``doc_id, text, n_lines, n_dropped`` per row of ``docs``; ``text`` is what stays, and with
    ``with_rows`` the ``row`` as it was.

    A line's key is the line without blanks at both ends, A-Z lower-cased. Keys of at least
    ``min_chars`` code points in at least ``min_docs`` documents lose all their lines, except
    in the largest id that holds them. Null texts are one empty line. Rows with the same id are
    one document when counting; each is cleaned by itself. Null ids are one document, never the
    largest unless alone. Empty tables give empty results; other columns are ignored.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    t1, t2 = digest("text")
    exploded = base.select("doc_id", t1.alias("t1"), t2.alias("t2"),
                           F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    h1, h2 = digest(ascii_lower(stripped(F.col("line"))))
    long_lines = stored(
        exploded.where(F.length(stripped(F.col("line"))) >= min_chars)
        .select("doc_id", "t1", "t2", "pos", h1.alias("h1"), h2.alias("h2")), "lines")
    common = (long_lines.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("one"))
              .groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))
              .where(F.col("n") >= min_docs).drop("n"))
    drops = (long_lines.join(common, ["h1", "h2"])
             .where(~F.col("doc_id").eqNullSafe(F.col("last")))
             .groupBy(F.col("doc_id").alias("d_id"), F.col("t1").alias("d1"),
                      F.col("t2").alias("d2"))
             .agg(F.sort_array(F.collect_set("pos")).alias("drop")))
    row = [F.struct(*(docs[c] for c in docs.columns)).alias("row")] if with_rows else []
    whole = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *row)
    met = whole.withColumns({"t1": t1, "t2": t2}).join(
        drops, F.col("doc_id").eqNullSafe(F.col("d_id")) & (F.col("t1") == F.col("d1"))
        & (F.col("t2") == F.col("d2")), "left")
    lines = split_lines(F.col("text"))
    kept = (F.when(F.col("drop").isNull(), F.coalesce("text", F.lit("")))
            .otherwise(F.array_join(without_positions(lines, F.col("drop")), "\n")))
    return met.select("doc_id", kept.alias("text"), F.size(lines).cast("long").alias("n_lines"),
                      F.coalesce(F.size("drop"), F.lit(0)).cast("long").alias("n_dropped"),
                      *(["row"] if with_rows else []))
