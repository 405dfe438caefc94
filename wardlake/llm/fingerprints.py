"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A sketch has cells of (count, XOR of digests, XOR of their checks); each digest goes to three of
them. Subtracting the sketches of two versions cancels what both have. A cell that is left with
one digest gives it away, taking it out uncovers others, and so the digests that differ are
recovered without either text. The fingerprint of a document is its smallest sketch, enough for
small edits. If that fails, the pair is tried again with a larger sketch, dealt over many small
tables by digest; cells and rounds are per table, so that work stays near in proportion to text.

All of it is expressions over arrays in a document's own row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlake.llm.common import digest

#: Words of a line that make a paragraph at most; cells of the fingerprint and of a larger
#: sketch's tables, try by try; digests a table is meant for.
WORDS, SMALL, LARGE, LOAD = 32, 12, (18, 36), 6
#: Rounds of taking out at most: each empties a good part of a table that can be emptied.
ROUNDS = 12
_PARAGRAPH = r"[^\x20\x09-\x0D]+(?:[\x20\x09\x0B-\x0D]+[^\x20\x09-\x0D]+){0,%d}"


def paragraphs(text: Column, most_words: int = WORDS) -> Column:
    """Lines, and of longer lines runs of ``most_words`` words."""
    return F.regexp_extract_all(text, F.lit(_PARAGRAPH % (most_words - 1)), F.lit(0))


def digests(text: Column, most_words: int = WORDS) -> Column:
    """Distinct paragraph digests, in order."""
    return F.sort_array(F.array_distinct(
        F.transform(paragraphs(text, most_words), lambda p: F.xxhash64(p))))


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), use), 0)


def _dealt(keys: Column, cells: int, level: int) -> Column:
    """Digests with their check and the bits of their cells, one in each third of the sketch."""
    third = cells // 3

    def bit(h: Column, nth: int) -> Column:
        slot = F.pmod(F.shiftright(h, 20 * nth), F.lit(third)).cast("int") + nth * third
        return F.call_function("shiftleft", F.lit(1).cast("long"), slot)

    def deal(k: Column) -> Column:
        return _let(F.xxhash64(F.lit(level), k), lambda h: F.struct(
            k.alias("k"), F.xxhash64(k).alias("c"),
            bit(h, 0).bitwiseOR(bit(h, 1)).bitwiseOR(bit(h, 2)).alias("cells")))

    return F.transform(keys, deal)


def _put(cell: Column, at: Column, items: Column, sign) -> Column:
    """A cell with the items that go to it."""
    def add(a: Column, x: Column) -> Column:
        return F.when(F.getbit(x["cells"], at) == 1, F.struct(
            (a["n"] + sign(x)).alias("n"), a["k"].bitwiseXOR(x["k"]).alias("k"),
            a["c"].bitwiseXOR(x["c"]).alias("c"))).otherwise(a)

    return F.aggregate(items, cell, add)


def sketch(keys: Column, cells: int = SMALL, level: int = 0) -> Column:
    """Cells of an array of distinct digests."""
    empty = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("k"),
                     F.lit(0).cast("long").alias("c"))
    return _let(_dealt(keys, cells, level), lambda items: F.transform(
        F.sequence(F.lit(0), F.lit(cells - 1)), lambda i: _put(empty, i, items, lambda x: 1)))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct(
        (x["n"] - y["n"]).alias("n"), x["k"].bitwiseXOR(y["k"]).alias("k"),
        x["c"].bitwiseXOR(y["c"]).alias("c")))


def peel(cells: Column, size: int, level: int = 0) -> Column:
    """The digests in a subtracted sketch, or null if it can't be emptied."""
    def lone(state: Column) -> Column:
        return F.filter(state, lambda x: (F.abs(x["n"]) == 1) & (F.xxhash64(x["k"]) == x["c"]))

    def take(state: Column, found: Column) -> Column:
        signs = F.map_from_entries(F.transform(found, lambda x: F.struct(x["k"], x["n"])))
        signed = F.zip_with(
            _dealt(F.map_keys(signs), size, level), F.map_values(signs), lambda i, n: F.struct(
                i["k"].alias("k"), i["c"].alias("c"), i["cells"].alias("cells"), n.alias("n")))
        return F.struct(
            _let(signed, lambda took: F.transform(state["cells"], lambda c, i: _put(
                c, i, took, lambda x: -x["n"]))).alias("cells"),
            F.concat(state["keys"], F.map_keys(signs)).alias("keys"), F.lit(True).alias("on"))

    def stop(state: Column) -> Column:
        return F.struct(state["cells"].alias("cells"), state["keys"].alias("keys"),
                        F.lit(False).alias("on"))

    def next_round(state: Column, _) -> Column:
        found = F.array_distinct(lone(state["cells"]))
        return F.when(state["on"], _let(found, lambda f: F.when(F.size(f) > 0, take(state, f))
                                        .otherwise(stop(state)))).otherwise(state)

    start = F.struct(cells.alias("cells"), F.array().cast("array<bigint>").alias("keys"),
                     F.lit(True).alias("on"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, next_round)
    return _let(end, lambda e: F.when(F.forall(e["cells"], lambda x: (x["n"] == 0) & (x["k"] == 0)),
                                      e["keys"]))


def _table(a: Column, b: Column) -> Column:
    """What differs between two small sets of digests, by ever larger sketches."""
    tries = [peel(subtract(sketch(a, cells, level), sketch(b, cells, level)), cells, level)
             for level, cells in enumerate(LARGE, 1)]
    return F.coalesce(*tries, F.concat(F.array_except(a, b), F.array_except(b, a)))


def differing(a: Column, b: Column, sketch_a: Column, sketch_b: Column) -> Column:
    """Digests that one of two documents has, from their sketches.

    The stored sketches first. If they can't be emptied, the digests are dealt over tables for a
    few each, and a table is tried with a larger sketch by itself if need be; should that fail
    at every size (about one table in ten thousand), its digests are compared.
    """
    tables = F.greatest(F.lit(1), F.ceil((F.size(a) + F.size(b)) / LOAD)).cast("int")

    def each(x: Column) -> Column:
        def mine(keys: str, ends: str, t: Column) -> Column:
            begin = F.get(x[ends], t - 1)
            return F.slice(x[keys], begin + 1, F.get(x[ends], t) - begin)

        return F.flatten(F.transform(F.sequence(F.lit(1), F.size(x["a_ends"]) - 1), lambda t: _let(
            F.struct(mine("a", "a_ends", t).alias("a"), mine("b", "b_ends", t).alias("b")),
            lambda pair: _table(pair["a"], pair["b"]))))

    dealt = _let(tables, lambda n: F.struct(a.alias("a"), _ends(a, n).alias("a_ends"),
                                            b.alias("b"), _ends(b, n).alias("b_ends")))
    return F.coalesce(peel(subtract(sketch_a, sketch_b), SMALL), _let(dealt, each))


def _ends(keys: Column, tables: Column) -> Column:
    """Where the runs of ascending digests end that go to each table: a binary search each."""
    steps = F.transform(F.sequence(F.ceil(F.log2(F.size(keys) + F.lit(1.0))).cast("int"), F.lit(0)),
                        lambda e: F.call_function("shiftleft", F.lit(1), e))

    def end(x: Column, t: Column) -> Column:
        # Digests as numbers from 0 to 2**63, so that bounds stay within a long.
        bound = t.cast("long") * F.floor(F.lit(float(1 << 63)) / x["n"]).cast("long")
        return F.aggregate(x["steps"], F.lit(0), lambda lo, s: F.when(
            F.coalesce(F.shiftright(F.get(x["keys"], lo + s - 1), 1) + (1 << 62) < bound, F.lit(False)),
            lo + s).otherwise(lo))

    whole = F.struct(keys.alias("keys"), tables.alias("n"), steps.alias("steps"))
    return _let(whole, lambda x: F.transform(F.sequence(F.lit(0), x["n"]), lambda t: F.when(
        t == 0, F.lit(0)).when(t == x["n"], F.size(x["keys"])).otherwise(end(x, t))))


def likeness(a: Column, b: Column, sketch_a: Column, sketch_b: Column) -> Column:
    """Shared paragraphs out of all (twice the shared over the sum); two empty ones are alike."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(
        1.0 - F.size(differing(a, b, sketch_a, sketch_b)) / total)


def as_text(cells: Column) -> Column:
    """A sketch as hex: per cell two digits of the count, sixteen of digests, eight of checks."""
    return F.array_join(F.transform(cells, lambda x: F.concat(
        F.lpad(F.hex(F.pmod(x["n"], F.lit(256))), 2, "0"), F.lpad(F.hex(x["k"]), 16, "0"),
        F.substring(F.lpad(F.hex(x["c"]), 16, "0"), 9, 8))), "")


def with_next(docs: DataFrame, columns: list[str], buckets: int) -> DataFrame:
    """Adds ``next``, a struct of the columns of the following row by (id, digest of the text).

    The last row is followed by the first; null ids come last. Rows are dealt over ranges of ids
    that a sketch of quantiles bounds, and each range also gets the first rows of the next one,
    so no task sees more than its range and text is shuffled once.
    """
    bounds = sorted({int(x) for x in docs.approxQuantile(
        "doc_id", [i / buckets for i in range(1, buckets)], 0.2 / buckets)})
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "d1", "d2")
    first = docs.agg(F.min(place).alias("first")).first()["first"]
    if first is None:
        return docs.withColumn("next", F.struct(*columns))
    steps = F.array(*(F.lit(1 << i) for i in reversed(range(len(bounds).bit_length()))))
    table = F.array(*map(F.lit, bounds)) if bounds else F.array().cast("array<bigint>")
    # Binary search: how many bounds are no greater than the id.
    mine = F.aggregate(steps, F.lit(0), lambda lo, s: F.when(
        F.coalesce(F.get(table, lo + s - 1) <= F.col("doc_id"), F.lit(False)), lo + s).otherwise(lo))
    bucket = F.when(F.col("doc_id").isNull(), F.lit(len(bounds))).otherwise(mine)
    starts = (F.get(table, F.col("bucket") - 1) == F.col("doc_id")) & (F.col("bucket") > 0)
    is_first = F.col("doc_id").eqNullSafe(F.lit(first["doc_id"]).cast("long")) & (
        F.col("d1") == first["d1"]) & (F.col("d2") == first["d2"])

    def copy(to: Column, guest: int) -> Column:
        return F.struct(to.alias("bucket"), F.lit(guest).alias("guest"))

    copies = F.concat(
        F.array(copy(F.col("bucket"), 0)),
        F.when(F.coalesce(starts, F.lit(False)), F.array(copy(F.col("bucket") - 1, 1)))
        .otherwise(F.array().cast("array<struct<bucket:int,guest:int>>")),
        F.when(is_first, F.array(copy(F.lit(len(bounds)), 2)))
        .otherwise(F.array().cast("array<struct<bucket:int,guest:int>>")))
    dealt = (docs.withColumn("bucket", bucket.cast("int")).withColumn("to", F.explode(copies))
             .drop("bucket").select("*", "to.bucket", "to.guest").drop("to"))
    order = Window.partitionBy("bucket").orderBy("guest", F.col("doc_id").asc_nulls_last(), "d1", "d2")
    following = [F.lead(c).over(order).alias(c) for c in columns]
    return (dealt.withColumn("next", F.struct(*following)).where(F.col("guest") == 0)
            .drop("bucket", "guest"))


def edited(text: Column, following: Column) -> Column:
    """The last half replaced by as much of the beginning of another text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half),
                    F.substring(following, F.lit(1), half))


def fingerprints(docs: DataFrame, most_words: int = WORDS, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``doc_id, text, keys, sketch`` per row of ``docs``: paragraph digests and the fingerprint.

    Null texts are empty; these have a sketch of empty cells. Equal texts have equal
    fingerprints. Repeated rows have a result each. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    keyed = base.withColumn("keys", digests(F.col("text"), most_words))
    return keyed.withColumn("sketch", sketch(F.col("keys")))


def edit_likeness(docs: DataFrame, most_words: int = WORDS, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """Each document's fingerprint beside that of an edited version and of the next document."""
    spark = docs.sparkSession
    d1, d2 = digest("text")
    rows = fingerprints(docs, most_words, id_col, text_col).withColumns({"d1": d1, "d2": d2})
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = with_next(rows.select("doc_id", "text", "keys", "d1", "d2"), ["text", "keys"], buckets)
    changed = (met.withColumn("edited", edited(F.col("text"), F.col("next.text")))
               .select("doc_id", F.length("text").cast("long").alias("n_chars"),
                       F.sha2("edited", 256).alias("edited_sha256"), "keys",
                       F.col("next.keys").alias("next_keys"),
                       digests(F.col("edited"), most_words).alias("edited_keys")))
    sketched = changed.withColumns({"sketch": sketch(F.col("keys")),
                                    "edited_sketch": sketch(F.col("edited_keys")),
                                    "next_sketch": sketch(F.col("next_keys"))})
    return sketched.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("keys"), F.col("edited_keys"), F.col("sketch"), F.col("edited_sketch"))
        .alias("near_edited"),
        likeness(F.col("keys"), F.col("next_keys"), F.col("sketch"), F.col("next_sketch"))
        .alias("near_next"))
