"""Sources mixed to target weights.

Each source is one stream of words in a fixed order, packed into blocks of equal length. Output
slots of a source are dealt to shards at random: the sources' counts in a shard are a multinomial
draw, held to totals that meet the targets. Slot q of a source takes block perm(q mod blocks) of
its q div blocks-th pass, where perm is a pseudorandom permutation of the block indexes that
differs by source and pass; blocks then meet slots by index. No state passes from row to row:
places in a stream are sums over hash buckets, so a source with a third of all documents is
spread, and reruns agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlake.llm.common import count_words, digest, stored, words

WEIGHTS, MOST, BLOCK, SHARD, SEED = (1, 2, 3), 3, 32, 4096, 20
#: Slots that one row spreads to at a time.
_RUN = 4096
# Primes just below 2**31. A source has fewer blocks (longer ones if need be), so
# steps of such a prime visit each block index once.
_STEPS = (2147483647, 2147483629, 2147483587, 2147483579)


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          source_col: str = "source") -> DataFrame:
    """``doc_id, d1, d2, source, size``: words of each text, without the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d1, d2 = digest(text)
    return docs.select(F.col(id_col).alias("doc_id"), d1.alias("d1"), d2.alias("d2"),
                       F.col(source_col).alias("source"), count_words(text).alias("size"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``sid, source, source_size, target``: one row per source.

    Sources by code point, null last, weigh ``weights`` in turn and share all words by weight;
    a target stops at ``most`` times its source's size, and the excess is shared by the others.
    Rounds of that take one row of sums to the driver each.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.get(F.array(*(F.lit(float(w)) for w in weights)),
                   F.pmod(F.col("sid"), F.lit(len(weights))))
    rows = stored(totals.withColumn("sid", nth).withColumn("weight", weight), "sources")
    limit = most * F.col("source_size")
    share = 0.0  # words for each unit of weight
    while True:
        full = limit <= share * F.col("weight")
        sums = rows.agg(F.sum("source_size").alias("all"),
                        F.sum(F.when(full, limit)).alias("held"),
                        F.sum(F.when(~full, F.col("weight"))).alias("weight")).first()
        if not sums["all"] or not sums["weight"]:
            break
        rest = (sums["all"] - (sums["held"] or 0)) / sums["weight"]
        if rest <= share:
            break
        share = rest
    target = F.least(limit.cast("double"), share * F.col("weight"))
    return rows.select("sid", "source", "source_size", target.alias("target"))


def streams(sizes: DataFrame, sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds ``sid`` and ``start``, the place of the document's first word in its source."""
    spark = sizes.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    named = (sizes.where(F.col("size") > 0)
             .join(sources.select("sid", F.col("source").alias("of")),
                   F.col("source").eqNullSafe(F.col("of")))
             .withColumn("bucket", F.pmod(F.xxhash64("doc_id", "d1", "d2"), F.lit(buckets))))
    sums = named.groupBy("sid", "bucket").agg(F.sum("size").alias("n"))
    ahead = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("sid", "bucket", F.coalesce(F.sum("n").over(ahead), F.lit(0))
                          .alias("ahead"))
    within = (Window.partitionBy("sid", "bucket").orderBy("doc_id", "d1", "d2")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (named.withColumn("upto", F.sum("size").over(within)).join(offsets, ["sid", "bucket"])
            .select("doc_id", "d1", "d2", "sid", "size",
                    (F.col("ahead") + F.col("upto") - F.col("size")).alias("start")))


def slots(sources: DataFrame, block: int = BLOCK, shard: int = SHARD, most: int = MOST,
          seed: int = SEED) -> DataFrame:
    """``sid, slot, shard, block``: every output slot with the shard and the block it takes."""
    blocks = F.ceil(F.col("source_size") / block)
    # As many slots as give the target at the source's mean block length, the last being short.
    wanted = F.least(most * blocks, F.round(F.col("target") * blocks / F.col("source_size")))
    quota = (sources.where(F.col("source_size") > 0)
             .select("sid", blocks.cast("long").alias("blocks"), wanted.cast("long").alias("slots")))
    shards = -(-(quota.agg(F.sum("slots")).first()[0] or 1) // shard)
    tasks = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = (quota.where(F.col("slots") > 0)
            .withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slots") - 1,
                                                      F.lit(_RUN).cast("long"))))
            .repartition(tasks, "sid", "first"))
    each = runs.withColumn("slot", F.explode(F.sequence(
        F.col("first"), F.least(F.col("first") + _RUN, F.col("slots")) - 1)))
    lap = F.floor(F.col("slot") / F.col("blocks"))
    jump = F.pmod(F.xxhash64(F.lit(seed), "sid", lap), F.col("blocks"))
    # i -> jump + step * i visits each index once, as the prime step shares no factor with the
    # number of blocks; products stay within a long.
    step = F.get(F.array(*map(F.lit, _STEPS)), F.pmod(
        F.xxhash64(F.lit(seed), F.lit("step"), "sid", lap), F.lit(len(_STEPS)))) % F.col("blocks")
    index = F.pmod(jump + step * F.pmod(F.col("slot"), F.col("blocks")), F.col("blocks"))
    dealt = F.pmod(F.xxhash64(F.lit(seed), F.lit("shard"), "sid", "slot"), F.lit(shards))
    return each.select("sid", "slot", dealt.alias("shard"), index.cast("long").alias("block"))


def _block_words(places: DataFrame, block: int) -> DataFrame:
    """One row per document and block of its stream that it reaches into, with the words."""
    first = F.floor(F.col("start") / block)
    last = F.floor((F.col("start") + F.col("size") - 1) / block)
    each = places.withColumn("block", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("start"), F.col("block") * block) - F.col("start")
    end = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - F.col("start")
    return each.select("doc_id", "d1", "d2", "sid", "block", begin.alias("begin"),
                       end.alias("end"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST,
        block: int = BLOCK, shard: int = SHARD, seed: int = SEED, id_col: str = "doc_id",
        text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, ...]:
    """(sizes, sources, parts): ``parts`` has the pieces of documents in each output block,
    ``doc_id, d1, d2, shard, slot, sid, block, begin, end`` (words, end exclusive).

    Rows alike in id, source and text lie side by side in their stream and are one document that
    is as often there; documents without words have no parts. Null sources are one source.
    """
    sizes = stored(sized(docs, id_col, text_col, source_col), "sizes")
    sources = targets(sizes, weights, most)
    places = streams(sizes, sources, block)
    taken = slots(sources, block, shard, most, seed)
    # Both sides are spread out from few rows, which Spark would take for a small side.
    parts = _block_words(places, block).join(taken.hint("merge"), ["sid", "block"])
    return sizes, sources, parts


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` per row of ``docs``.

    No document is taken more than ``most`` times, as each pass over a source's blocks takes a
    block once. Null texts and those without words have size 0. Repeated rows share what is taken
    of them evenly, the first ones getting what is left over. An empty table gives no rows.
    """
    sizes, sources, parts = mix(docs, **options)
    key = ["sid", "doc_id", "d1", "d2"]
    words_of = parts.groupBy(*key).agg(F.sum(F.col("end") - F.col("begin")).alias("words"))
    rows = sizes.join(sources.withColumnRenamed("source", "of"),
                      F.col("source").eqNullSafe(F.col("of")))
    counted = (rows.groupBy(*key, "size", "source_size", "target").agg(F.count("*").alias("rows"))
               .withColumnsRenamed({"sid": "s", "doc_id": "id", "d1": "e1", "d2": "e2"}))
    met = counted.join(words_of, (F.col("s") == F.col("sid"))
                       & F.col("id").eqNullSafe(F.col("doc_id"))
                       & (F.col("e1") == F.col("d1")) & (F.col("e2") == F.col("d2")), "left")
    total = F.coalesce("words", F.lit(0).cast("long"))
    nth = F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows")))
    return (met.select(F.col("id").alias("doc_id"), "size", "source_size", "target",
                       total.alias("total"), "rows", nth.alias("nth"))
            .select("doc_id", "size", "source_size", "target",
                    (F.floor(F.col("total") / F.col("rows"))
                     + (F.col("nth") <= F.col("total") % F.col("rows")).cast("long"))
                    .cast("long").alias("taken")))


def _lap_text(text: Column, runs: Column) -> Column:
    """A text's words in runs (begin, end), blank-joined."""
    found = words(text)
    return F.array_join(F.flatten(F.transform(
        runs, lambda r: F.slice(found, r["begin"] + 1, r["end"] - r["begin"]))), " ")


def mixed_documents(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                    source_col: str = "source", **options) -> DataFrame:
    """``docs`` as the mix has them: a row for each pass that takes words of a document.

    A pass that takes all its words has the text as it is; one that takes some of its blocks has
    their words, joined by blanks. ``docs`` has distinct rows here.
    """
    _, _, parts = mix(docs, text_col=text_col, id_col=id_col, source_col=source_col, **options)
    ordered = Window.partitionBy("sid", "doc_id", "d1", "d2", "block").orderBy("slot")
    laps = (parts.withColumn("lap", F.row_number().over(ordered))
            .groupBy("sid", "doc_id", "d1", "d2", "lap")
            .agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias("runs"),
                 F.sum(F.col("end") - F.col("begin")).alias("words")))
    d1, d2 = digest(F.coalesce(F.col(text_col), F.lit("")))
    laps = laps.withColumnsRenamed({"doc_id": "l_id", "d1": "l1", "d2": "l2"}).drop("sid")
    met = docs.withColumns({"e1": d1, "e2": d2}).join(
        laps, F.col(id_col).eqNullSafe(F.col("l_id")) & (F.col("e1") == F.col("l1"))
        & (F.col("e2") == F.col("l2")))
    whole = F.col("words") == count_words(F.col(text_col))
    text = F.when(whole, F.col(text_col)).otherwise(_lap_text(F.col(text_col), F.col("runs")))
    return met.withColumn(text_col, text).select(*docs.columns)
