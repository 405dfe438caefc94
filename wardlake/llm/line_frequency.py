"""Quality rules over words and lines, with the frequency of lines across a host's documents.

Base measures come from each text alone. Then normalised lines are hashed and distinct
documents are counted per host and hash; a line above the limits is boilerplate and is removed
from the host's documents, and documents that this depletes are rejected. Documents with equal
texts count once, so a page that was copied often isn't taken for boilerplate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.llm.common import (BLANKS, WORD, count_words, digest, split_lines, stored,
                                 without_positions, words)

MIN_WORDS, MAX_REPEATED_PERCENT, WINDOW = 20, 30, 8
SYMBOLS = r"[#*$%&|<>]"
#: A line is above the limits in at least so many documents that are more than this share of
#: the host's; a document is depleted with fewer words left than either bound.
LINE_DOCS, LINE_SHARE, LEFT_WORDS, LEFT_SHARE = 10, 0.1, 10, 0.3


def base_measures(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Counts of each text, beside the columns named in ``keep``.

    Step by step, so that each array is a column before lambdas look into it. Equal windows lie
    side by side after sorting by (hash, position); a repeated window at p, with the next one
    at q, adds min(window, q - p) words.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    found = words(text)
    counted = docs.select(
        *keep, F.size(found).cast("long").alias("n_words"),
        F.aggregate(found, F.lit(0), lambda a, w: a + F.length(w)).cast("long")
        .alias("word_chars"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.transform(found, lambda w: F.xxhash64(w)).alias("w"))
    window = F.transform(F.sequence(F.lit(0), F.size("w") - WINDOW),
                         lambda i: F.xxhash64(*(F.get("w", i + k) for k in range(WINDOW))))
    sums = counted.withColumn("s", F.when(F.size("w") > WINDOW, window)).drop("w")
    ordered = sums.withColumn("o", F.when(
        F.size(F.array_distinct("s")) < F.size("s"),
        F.array_sort(F.transform("s", lambda h, i: F.struct(h.alias("h"), i.alias("p")))))).drop("s")
    twins = F.zip_with("o", F.slice("o", 2, F.size("o")),
                       lambda a, b: F.when(a["h"] == b["h"], F.array(a["p"], b["p"])))
    starts = ordered.withColumn(
        "p", F.sort_array(F.array_distinct(F.flatten(F.array_compact(twins))))).drop("o")
    widths = F.zip_with("p", F.slice("p", 2, F.size("p")),
                        lambda p, q: F.least(F.lit(WINDOW), F.coalesce(q - p, F.lit(WINDOW))))
    covered = F.aggregate(widths, F.lit(0), lambda a, x: a + x)
    return starts.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("p")


def base_failed() -> Column:
    return ((F.col("n_words") < MIN_WORDS)
            | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words")))


def normal_line(line: Column) -> Column:
    """Trimmed, lower-cased, runs of blanks as one space."""
    return F.lower(F.regexp_replace(F.btrim(line, F.lit(BLANKS)), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]",
                                    " "))


def lines_above(docs: DataFrame, line_docs: int = LINE_DOCS,
                line_share: float = LINE_SHARE) -> DataFrame:
    """``doc_id, host, d1, d2, gone``: positions and words of the lines above the limits, for
    the documents that have any. ``docs`` has ``doc_id, host, text`` and the text's digest."""
    key = ["host", "h1", "h2"]
    exploded = docs.where(F.col("text").isNotNull()).select(
        "doc_id", "host", "d1", "d2", F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    h1, h2 = digest(normal_line(F.col("line")))
    rows = stored(exploded.where(F.col("line").rlike(WORD)).select(
        "doc_id", "host", "d1", "d2", "pos", h1.alias("h1"), h2.alias("h2"),
        count_words(F.col("line")).alias("w")), "lines")
    texts = (docs.groupBy("host", "d1", "d2").agg(F.lit(1).alias("one"))
             .groupBy(F.col("host").alias("of")).agg(F.count("*").alias("texts")))
    often = (rows.groupBy(*key, "d1", "d2").agg(F.lit(1).alias("one"))
             .groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") >= line_docs))
    above = (often.join(texts, F.col("host").eqNullSafe(F.col("of")))
             .where(F.col("n") > line_share * F.col("texts"))
             .select(F.col("host").alias("of"), "h1", "h2"))
    return (rows.join(above.withColumnsRenamed({"h1": "a1", "h2": "a2"}),
                      (F.col("h1") == F.col("a1")) & (F.col("h2") == F.col("a2"))
                      & F.col("host").eqNullSafe(F.col("of")))
            .groupBy("doc_id", "host", "d1", "d2")
            .agg(F.sort_array(F.collect_set(F.struct("pos", "w"))).alias("gone")))


def quality_rules(docs: DataFrame, line_docs: int = LINE_DOCS, line_share: float = LINE_SHARE,
                  left_words: int = LEFT_WORDS, left_share: float = LEFT_SHARE,
                  id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                  with_rows: bool = False) -> DataFrame:
    """``doc_id, host``, base measures, ``base_failed, n_boilerplate`` (words in lines above the
    limits), ``kept`` per row of ``docs``, and with ``with_rows`` the ``text`` without those lines
    and the ``row`` as it was.

    Null and empty texts have no words and fail. Documents without a host share one. Rows alike
    in id, host and text get the same result each. An empty table gives an empty result; other
    columns are ignored.
    """
    d1, d2 = digest(F.coalesce(F.col(text_col), F.lit("")))
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"),
                       F.col(text_col).alias("text"), d1.alias("d1"), d2.alias("d2"),
                       F.struct(*(docs[c] for c in docs.columns)).alias("row"))
    key = ["doc_id", "host", "d1", "d2"]
    gone = lines_above(base, line_docs, line_share).withColumnsRenamed({k: f"g_{k}" for k in key})
    # Written, so that a filter on the result isn't worked out inside the arrays' lambdas.
    measures = stored(base_measures(base.drop("row"), tuple(key)), "measures")
    met = measures.join(gone, _same(key, "g_"), "left")
    removed = F.aggregate("gone", F.lit(0).cast("long"), lambda a, x: a + x["w"])
    left = F.col("n_words") - F.col("n_boilerplate")
    depleted = (F.col("n_boilerplate") > 0) & (
        (left < left_words) | (left < left_share * F.col("n_words")))
    out = (met.withColumn("n_boilerplate", F.coalesce(removed, F.lit(0).cast("long")))
           .withColumn("base_failed", base_failed())
           .withColumn("kept", ~F.col("base_failed") & ~depleted))
    columns = ["doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines",
               "n_repeat_words", "n_boilerplate", "base_failed", "kept"]
    if not with_rows:
        return out.select(*columns)
    judged = out.dropDuplicates(key).select(
        *(F.col(k).alias(f"j_{k}") for k in key), *columns[2:], "gone")
    rest = F.array_join(without_positions(
        split_lines(F.col("text")), F.transform("gone", lambda x: x["pos"])), "\n")
    return base.join(judged, _same(key, "j_")).select(
        *columns, F.when(F.col("gone").isNull(), F.col("text")).otherwise(rest).alias("text"),
        "row")


def _same(key: list[str], prefix: str) -> Column:
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"{prefix}{k}"))
    return same
