"""What several operators share: row keys, words, lines, written intermediate tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.session import scratch_dir

BLANKS = " \t\n\x0b\f\r"
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def stored(rows: DataFrame, name: str) -> DataFrame:
    """Writes rows to the shared folder and goes on from there.

    Work before it isn't repeated by later reads or after a lost executor.
    """
    path = f"{scratch_dir(rows.sparkSession)}/{name}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def digest(*columns: Column) -> tuple[Column, Column]:
    """128 bits of xxHash as two longs: chance agreement stays out of reach at any corpus size."""
    return F.xxhash64(*columns), F.xxhash64(F.lit(0x5EED), *columns)


def words(text: Column) -> Column:
    """Runs without blanks, in order."""
    return F.filter(F.split(text, BLANK + "+"), lambda w: w != "")


def count_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(text, UPPER, LOWER)


def split_lines(text: Column) -> Column:
    """At \\n; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def without_positions(lines: Column, positions: Column) -> Column:
    """An array without the elements at ascending 0-based positions, in linear time: the runs
    between them, joined."""
    fences = F.concat(F.array(F.lit(-1)), positions, F.array(F.size(lines)))

    def runs(of: Column) -> Column:
        fence = of["fences"]
        return F.flatten(F.transform(
            F.sequence(F.lit(1), F.size(fence) - 1),
            lambda i: F.slice(of["lines"], F.get(fence, i - 1) + 2,
                              F.get(fence, i) - F.get(fence, i - 1) - 1)))

    # A struct in an array of one: both are worked out once, not for each run.
    return F.get(F.transform(F.array(F.struct(lines.alias("lines"), fences.alias("fences"))),
                             runs), 0)
