"""String predicates and scalar functions shared by the scanners."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardlake.rules import UNICODE_SPACE

# The Unicode White_Space characters, for trimming as the scanners trim.
WHITE_SPACE = "".join(map(chr, (
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def contains_any(text: Column, words: Iterable[str]) -> Column:
    return any_of(text.contains(w) for w in words)


def has_word(text: Column, words: Iterable[str]) -> Column:
    """Same as :func:`contains_any` in one regex: ``text`` is computed once. For hits."""
    return text.rlike("|".join(re.escape(w) for w in words))


def ends_with_any(text: Column, suffixes: Iterable[str]) -> Column:
    return any_of(text.endswith(s) for s in suffixes)


def fold_case(text: Column) -> Column:
    """Simple lower-casing. U+0130 maps to one plain i, which Java's full mapping would not do."""
    return F.lower(F.replace(text, F.lit("İ"), F.lit("i")))


def strip_space(text: Column) -> Column:
    return F.trim(text, F.lit(WHITE_SPACE))


def is_comment(line: Column) -> Column:
    return line.rlike(rf"\A[{UNICODE_SPACE}]*(?://|#|/\*|\*)")


def drop_trailing_cr(line: Column) -> Column:
    shorter = F.substring(line, F.lit(1), F.char_length(line) - 1)
    return F.when(line.endswith("\r"), shorter).otherwise(line)


def shannon_entropy(text: Column) -> Column:
    """Bits per symbol. Counts are of characters, the divisor is the length in bytes.

    Terms are added in order of first appearance, which fixes the floating-point sum.
    """
    size = F.octet_length(text).cast("double")

    def add_term(total: Column, ch: Column) -> Column:
        count = F.char_length(text) - F.char_length(F.replace(text, ch, F.lit("")))
        p = count.cast("double") / size
        return total - p * F.log2(p)

    total = F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), add_term)
    return F.when(F.octet_length(text) == 0, F.lit(0.0)).otherwise(total)


def mask_gate(secret: Column) -> Column:
    """First and last four characters, dots between; short secrets vanish."""
    return F.when(F.octet_length(secret) <= 8, F.lit("***")).otherwise(
        F.concat(F.substring(secret, 1, 4), F.lit("..."), F.right(secret, F.lit(4))))


def mask_strict(secret: Column) -> Column:
    """One star per hidden byte."""
    size = F.octet_length(secret)
    return F.when(size <= 8, F.repeat(F.lit("*"), size)).otherwise(
        F.concat(F.substring(secret, 1, 4), F.repeat(F.lit("*"), size - 8),
                 F.right(secret, F.lit(4))))


def match_hash(secret: Column) -> Column:
    return F.sha2(secret, 256)
