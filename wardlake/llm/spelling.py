"""Spelling variants: words one edit apart, grouped under their most frequent form.

Words: maximal runs ``[A-Za-z\\u00C0-\\u00FF]+`` of each text (null: none) with A-Z lower-cased.
A run whose h (unsigned crc32 of UTF-8 ``<doc_id>:<run>``) 97 divides loses its code point
h % length (the contract's planted misspellings; runs of a row with a null doc_id lose none).
The vocabulary is the distinct results of at least ``MIN_LENGTH`` code points seen at least
``MIN_COUNT`` times (n) in all texts. Near words differ by exactly one inserted, deleted or
replaced code point. A word's form is its near word of largest n (ties: smallest in code point
order) if that n is at least twice its own; its root follows forms to the end (n at least doubles
on every step, so a chain ends).

Method (sorted-list dynamic programming): a near pair whose shorter word has m code points
keeps one of three parts of it whole (see ``blocks``): its first m - c code points, its last
m - a, or its first a with its last c (a = c = ceil(m/3)). Words are dealt to blocks by those
keys, for m their own length and one less, so every near pair meets in some block.
In a block, each word is a query that scans the block's sorted list: edit-matrix rows, banded to
one edit, are reused for the prefix a word shares with the previous one (their LCP), and when
a row has no cell within one edit, the whole range of words with that prefix is skipped by
bisection; suffix blocks are scanned on reversed words. A block is one array row, scanned in
an Arrow-batched pandas UDF; roots come from pointer jumping over written tables.

Edge cases: an empty or wordless table gives no rows; ties in n are broken by code point
order; repeated rows count each time; other columns of the input are not read.
"""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardlake.llm.common import LOWER, UPPER, stored

RUN = "[A-Za-zÀ-ÿ]+"
MIN_LENGTH = 5
MIN_COUNT = 3
PLANT = 97


def spelled(docs: DataFrame) -> DataFrame:
    """One row per run: doc_id, word (after lower-casing and the planted deletion)."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(
        F.coalesce("text", F.lit("")), F.lit(RUN), F.lit(0))).alias("run"))
    run = F.translate("run", UPPER, LOWER)
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), run))
    at = (h % F.char_length(run)).cast("int")
    cut = F.concat(F.substring(run, 1, at), F.substring(run, at + 2, 1 << 30))
    return runs.select("doc_id", F.when(h % PLANT == 0, cut).otherwise(run).alias("word"))


def vocabulary(docs: DataFrame) -> DataFrame:
    words = spelled(docs).where(F.char_length("word") >= MIN_LENGTH)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= MIN_COUNT)


def blocks(vocab: DataFrame) -> DataFrame:
    """(block, word): every word in the three blocks of each shorter length m it can pair at:
    its length and one less.

    For m, parts a = c = ceil(m/3) and b = m - a - c; blocks share the first m - c code points,
    or the last m - a, or the first a together with the last c. One edit at position p keeps
    the first if p >= a + b, the second if p < a, the third otherwise.
    """
    size = F.char_length("word")
    keys = []
    for shorter in (size, size - 1):
        a = F.ceil(shorter / 3).cast("int")
        start = F.substring("word", 1, shorter - a)
        end = F.reverse(F.substring(F.reverse("word"), 1, shorter - a))
        ends = F.concat(F.substring("word", 1, a), F.lit("\u0002"),
                        F.reverse(F.substring(F.reverse("word"), 1, a)))
        for side, part in (("p", start), ("s", end), ("b", ends)):
            keys.append(F.when(shorter >= MIN_LENGTH, F.concat_ws(
                "\u0001", F.lit(side), shorter.cast("string"), part)))
    return vocab.select(F.explode(F.array_compact(F.array(*keys))).alias("block"), "word")


def _step(row: tuple[int, int, int], query: str, ch: str, t: int) -> tuple[int, int, int]:
    """Row t+1 of the edit matrix of ``query`` against a word prefix ending in ``ch``, from row
    t, banded to one edit: a row holds the cells of columns t-1, t, t+1 (beyond the query or
    the band: 2, that is, two edits or more)."""
    x, y, z = row
    last = len(query)
    left = min(y + 1, x + (query[t - 1] != ch) if t >= 1 else 2, 2) if t <= last else 2
    middle = min(z + 1, left + 1, y + (query[t] != ch), 2) if t + 1 <= last else 2
    right = min(middle + 1, z + (query[t + 1] != ch), 2) if t + 2 <= last else 2
    return left, middle, right


def near_in_sorted(words: list[str], queries: list[str] | None = None) -> list[tuple[str, str]]:
    """All (query, word) one edit apart, ``words`` sorted, by the banded, prefix-sharing scan.

    Rows of the edit matrix are kept per prefix of the word last looked at; the next word
    reuses those of the prefix it shares (their LCP). A row without a cell within one edit
    ends the scan of every word with that prefix: the range is skipped by bisection.
    """
    found = []
    for query in words if queries is None else queries:
        size = len(query)
        rows = [(2, 0, 1 if size >= 1 else 2)]
        held = ""  # the prefix whose rows are in ``rows``
        at = 0
        while at < len(words):
            word = words[at]
            shared = 0
            limit = min(len(held), len(word))
            while shared < limit and held[shared] == word[shared]:
                shared += 1
            del rows[shared + 1:]
            skipped = False
            for t in range(shared, len(word)):
                row = _step(rows[-1], query, word[t], t)
                rows.append(row)
                if row[0] > 1 and row[1] > 1 and row[2] > 1:
                    prefix = word[:t + 1]
                    held = prefix
                    following = prefix[:-1] + chr(ord(prefix[-1]) + 1)
                    at = bisect_left(words, following, at + 1)
                    skipped = True
                    break
            if skipped:
                continue
            held = word
            place = size - len(word) + 1
            if 0 <= place <= 2 and rows[-1][place] == 1:
                found.append((query, word))
            at += 1
    return found


def block_pairs(block: str, members: list[str]) -> list[tuple[str, str]]:
    """Near pairs of one block, both ways. Only words of the block's shorter length m are
    queries (the other word of a pair has m or m + 1 code points). Words of a suffix block are
    scanned reversed (one edit apart either way), so that their shared part is a prefix."""
    side, shorter, _ = block.split("\u0001", 2)
    backwards = side == "s"
    words = sorted({w[::-1] for w in members} if backwards else set(members))
    queries = [w for w in words if len(w) == int(shorter)]
    pairs = near_in_sorted(words, queries)
    if backwards:
        pairs = [(a[::-1], b[::-1]) for a, b in pairs]
    return pairs + [(b, a) for a, b in pairs]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("word", T.StringType()),
                                         T.StructField("near", T.StringType())])))
def _pairs_of_blocks(blocks: pd.Series, members: pd.Series) -> pd.Series:
    return pd.Series([block_pairs(b, list(m)) for b, m in zip(blocks, members)])


def near_pairs(vocab: DataFrame) -> DataFrame:
    """(word, near): every near pair in both orders, once. A block's words travel as one array
    row (a block holds the words sharing a key of at least three code points), and many blocks
    go to Python in one Arrow batch."""
    dealt = blocks(vocab).groupBy("block").agg(F.collect_list("word").alias("members"))
    pairs = dealt.select(F.explode(_pairs_of_blocks("block", "members")).alias("p"))
    return pairs.select("p.word", "p.near").distinct()


def variants(docs: DataFrame) -> DataFrame:
    """Per vocabulary word: word, form, root, n, n_near, form_n."""
    vocab = stored(vocabulary(docs), "spelling_vocabulary")
    pairs = stored(near_pairs(vocab), "spelling_pairs")
    counted = pairs.join(vocab.select(F.col("word").alias("near"), F.col("n").alias("near_n")),
                         "near")
    best = counted.groupBy("word").agg(
        F.count("*").alias("n_near"),
        F.min_by(F.struct("near", "near_n"),
                 F.struct(-F.col("near_n"), F.col("near"))).alias("best"))
    rows = vocab.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(F.col("best.near_n") >= 2 * F.col("n"), F.col("best.near")).alias("form"),
        F.when(F.col("best.near_n") >= 2 * F.col("n"), F.col("best.near_n")).alias("form_n"))
    rows = stored(rows, "spelling_forms")
    return rows.join(roots(rows), "word").select("word", "form", "root", "n", "n_near", "form_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) by pointer jumping: each round a word's pointer moves to its pointer's."""
    jump = forms.select("word", F.coalesce("form", "word").alias("to"))
    while True:
        ahead = jump.alias("a").join(jump.alias("b"), F.col("a.to") == F.col("b.word"), "left") \
            .select(F.col("a.word").alias("word"), F.col("a.to").alias("was"),
                    F.coalesce(F.col("b.to"), F.col("a.to")).alias("to"))
        ahead = stored(ahead, "spelling_jump")
        if ahead.where(F.col("was") != F.col("to")).limit(1).count() == 0:
            return ahead.select("word", F.col("to").alias("root"))
        jump = ahead.select("word", "to")
