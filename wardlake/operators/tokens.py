"""Source files as token rows, comments and strings kept whole.

One lexer per language, as a regular expression whose alternatives are tried in order: line and
block comments, strings (triple-quoted, template and raw ones where the language has them),
character literals, a word with its opening parenthesis, a number, any other sign; each with
the blanks before it. Its matches cover the file without gaps, so positions are running sums.

A piece of text moves a place by a *reach*: the newlines in it and the bytes after the last of
them, in one long. Reaches add up from left to right inside the file's row, block by block
(:func:`places_before`), so that the work per token does not grow with the file, no token is
shuffled and no Python worker is involved.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.functions import paths
from wardlake.schemas import SCAN_KEY

LEXED_EXTENSIONS = ("rs", "js", "ts", "py", "go")

# Literal forms, with loops unrolled and possessive so that long ones are matched without
# backtracking or deep recursion.
LINE_HASH = r"#[^\n]*+"
LINE_SLASH = r"//[^\n]*+"
BLOCK = r"/\*[^*]*+(?:\*++[^*/][^*]*+)*+\*++/"
DOUBLE = r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"'
LONG_DOUBLE = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
SINGLE = r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"
TEMPLATE = r"`[^`\\]*+(?:\\.[^`\\]*+)*+`"
RAW = r"`[^`]*+`"
TRIPLE = r'"""[^"]*+(?:"{1,2}+[^"]++)*+"""' + "|" + r"'''[^']*+(?:'{1,2}+[^']++)*+'''"
CHARACTER = r"'(?:\\[^'\n]++|[^'\\\n])'"
_TAIL = (r"[A-Za-z_$][A-Za-z0-9_$]*+\(?", r"[0-9]++", r"[^\s]")
TOKEN_REGEX = {
    "py": "|".join((LINE_HASH, TRIPLE, SINGLE, DOUBLE, *_TAIL)),
    "js": "|".join((LINE_SLASH, BLOCK, SINGLE, TEMPLATE, DOUBLE, *_TAIL)),
    "rs": "|".join((LINE_SLASH, BLOCK, LONG_DOUBLE, CHARACTER, *_TAIL)),
    "go": "|".join((LINE_SLASH, BLOCK, RAW, DOUBLE, CHARACTER, *_TAIL)),
}
TOKEN_REGEX["ts"] = TOKEN_REGEX["js"]

#: What ``\s`` is in the lexers.
BLANKS = " \t\n\x0b\f\r"

#: Elements that one block adds up, and how often totals of blocks are put in blocks again. The
#: totals of the last level, 2^20 elements each, are added up as one block.
BLOCK, LEVELS = 16, 5

#: One newline of a reach; what is below it counts bytes.
LINE = 1 << 32


def reach(text: Column) -> Column:
    """The newlines of a text and the bytes after the last one (all bytes without any)."""
    lines = F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))
    tail = F.octet_length(F.substring_index(text, "\n", -1))
    return F.when(text.contains("\n"), lines.cast("long") * LINE + tail).otherwise(
        F.octet_length(text).cast("long"))


def moved(place: Column, by: Column) -> Column:
    """A place moved on by a reach: bytes start anew after a newline."""
    return F.when(by < LINE, place + by).otherwise(
        F.shiftleft(F.shiftright(place, 32), 32) + by)


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value worked out once: it is the one element of an array."""
    return F.get(F.transform(F.array(value), body), 0)


def _block_places(reaches: Column, start: Column) -> Column:
    def add(places: Column, by: Column) -> Column:
        return F.array_append(places, moved(F.element_at(places, -1), by))

    return F.slice(F.aggregate(reaches, F.array(start), add), F.lit(1), F.size(reaches))


def places_before(reaches: Column, levels: int = LEVELS) -> Column:
    """For each of an array's reaches, the place to which those before it lead from 0.

    An array that grows is copied with each element, so only blocks are built that way. Each
    starts at its own place, which the totals of the blocks before it give, in blocks again.
    """
    nowhere = F.lit(0).cast("long")
    if not levels:
        return _bound(reaches, lambda all_: _block_places(all_, nowhere))

    def blocks(all_: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.greatest(F.size(all_), F.lit(1)), F.lit(BLOCK))
        return F.transform(firsts, lambda first: F.slice(all_, first, F.lit(BLOCK)))

    def joined(parts: Column) -> Column:
        totals = F.transform(parts, lambda part: F.aggregate(part, nowhere, moved))
        return F.flatten(F.zip_with(parts, places_before(totals, levels - 1), _block_places))

    return _bound(reaches, lambda all_: _bound(blocks(all_), joined))


def source_tokens(files: DataFrame) -> DataFrame:
    """(path, token, line, byte column) for every token of the supported languages.

    A piece is a token with the blanks before it. Pieces cover the file up to its trailing
    blanks, so a token stands where the pieces before it and its own blanks lead. A file
    without tokens gives a row without token, line and column.
    """
    language = paths.bare_extension(files["path"])
    pieces = F.lit(None).cast("array<string>")
    for name, regex in TOKEN_REGEX.items():
        # The pattern is a constant, so a task compiles it once and not for each file.
        pieces = F.when(language == name, F.regexp_extract_all(
            "content", F.lit(rf"(?s)\s*+(?:{regex})"), F.lit(0))).otherwise(pieces)
    lexed = files.where(language.isin(*LEXED_EXTENSIONS)).select(
        *SCAN_KEY, "path", pieces.alias("piece"))
    lexed = lexed.withColumn("piece", F.when(F.size("piece") == 0, F.array(
        F.lit(None).cast("string"))).otherwise(F.col("piece")))
    before = places_before(F.transform("piece", reach))
    rows = (lexed.withColumn("before", before)
            .select(*SCAN_KEY, "path", F.inline(F.arrays_zip("piece", "before"))))
    token = F.ltrim("piece", F.lit(BLANKS))
    blanks = F.substring("piece", F.lit(1), F.octet_length("piece") - F.octet_length(token))
    return (rows.select(*SCAN_KEY, "path", token.alias("token"),
                        moved(F.col("before"), reach(blanks)).alias("place"))
            .select(*SCAN_KEY, "path", "token",
                    (F.shiftright("place", 32) + 1).cast("int").alias("line"),
                    (F.col("place") % LINE + 1).cast("int").alias("column")))
