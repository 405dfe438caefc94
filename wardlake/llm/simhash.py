"""Near duplicates by SimHash.

Fingerprints are 64 bits, each the majority of that bit in the hashes of the text's word
shingles. Two fingerprints within ``distance`` bits of each other are linked, and linked
documents form components. Links are found among distinct fingerprints: these are split into
blocks, of which a close pair shares all but ``distance``, so every choice of that many blocks is
a key to join on, and pairs that meet are verified.

A bucket with many different fingerprints (a large group of near copies) isn't paired out. Its
fingerprints are met another exact way: each is dealt to all patterns within ``distance`` / 2 bits,
and those that meet at a pattern hang on its smallest one. Work there grows with the number of
fingerprints, not with its square.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.llm.common import digest, stored

BITS, SHINGLE, DISTANCE, BLOCKS, SEED = 64, 3, 2, 5, 42
#: Above so many fingerprints in a bucket, patterns take the place of pairs.
PAIRED = 24
#: For sets of shingles: bands and MinHash values in each, and pairs up to fewer in a bucket, as
#: there the star of a bucket is followed by what it left out.
BANDS, ROWS, FEW = 40, 6, 4
_CHUNK, _STEP = 1 << 16, 256


def shingle_hashes(text: str, width: int = SHINGLE) -> list[int]:
    """XXH64 of each run of ``width`` words; bytes.split() cuts at the same blanks as the words."""
    found = text.encode().lower().split()
    if not found:
        return []
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = min(width, len(found)) - 1
    hash_of = xxhash.xxh64_intdigest
    return [hash_of(joined[a:b], SEED)
            for a, b in zip(starts[:len(found) - last].tolist(), ends[last:].tolist(), strict=True)]


def majority(hashes: list[int]) -> int:
    """The fingerprint as a signed long; zero without hashes."""
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        raw = np.array(hashes[at:at + _CHUNK], ">u8").view(np.uint8)
        ones += np.unpackbits(raw.reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes))
    return int.from_bytes(bits.tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, width: int = SHINGLE, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """``doc_id, d1, d2, fp`` per row; d1 and d2 are a digest of the text. Null texts are empty."""
    def of(batches):
        for batch in batches:
            values = [majority(shingle_hashes(t.as_py() or "", width)) for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(values, pa.int64())],
                names=["doc_id", "d1", "d2", "fp"])

    d1, d2 = digest(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), d1.alias("d1"),
                       d2.alias("d2"), F.col(text_col).alias("text")).mapInArrow(
        of, "doc_id long, d1 long, d2 long, fp long")


def _masks(parts: int) -> list[int]:
    """Disjoint runs of bits that make up the whole, as signed longs."""
    bounds = [BITS * i // parts for i in range(parts + 1)]
    return [((1 << b) - (1 << a)) for a, b in zip(bounds, bounds[1:])]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def block_keys(fp: Column, distance: int, blocks: int) -> Column:
    """A struct (which blocks, their bits) for each choice of the blocks that a close pair shares."""
    masks = _masks(blocks)
    keys = [F.struct(F.lit(i).alias("of"), fp.bitwiseAND(F.lit(_signed(sum(chosen)))).alias("bits"))
            for i, chosen in enumerate(combinations(masks, blocks - distance))]
    return F.array(*keys)


def links(prints: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS,
          paired: int = PAIRED) -> DataFrame:
    """``a, b`` (a < b): links between distinct fingerprints ``fp``, enough of them to connect
    all that are within ``distance``."""
    dealt = prints.select("fp", F.explode(block_keys(F.col("fp"), distance, blocks)).alias("key"))
    met = dealt.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    # Most keys have one fingerprint; the rest goes on from a small written table.
    shared = stored(dealt.join(met, "key"), "buckets")
    grouped = (shared.where(F.col("n") <= paired).groupBy("key")
               .agg(F.sort_array(F.collect_list("fp")).alias("fps")))
    pairs = (grouped.select("fps", F.posexplode("fps").alias("i", "a"))
             .select("a", F.explode(F.slice("fps", F.col("i") + 2, F.size("fps"))).alias("b"))
             .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance))
    crowded = shared.where(F.col("n") > paired).select("fp").distinct()
    return pairs.union(_by_pattern(crowded, distance)).distinct()


def _by_pattern(prints: DataFrame, distance: int) -> DataFrame:
    """The same links, without pairs: two fingerprints within ``distance`` (even) share a pattern
    within half of it of both, and those that share one are within ``distance``."""
    half = distance // 2
    flips = [_signed(sum(1 << i for i in chosen))
             for k in range(half + 1) for chosen in combinations(range(BITS), k)]
    flip = F.explode(F.array(*map(F.lit, flips)))
    dealt = prints.select("fp", flip.alias("flip")).select(
        "fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("pattern"))
    # At most len(flips) fingerprints are that near to a pattern.
    groups = (dealt.groupBy("pattern").agg(F.collect_list("fp").alias("fps"))
              .where(F.size("fps") > 1).withColumn("a", F.array_min("fps")))
    return (groups.select("a", F.explode("fps").alias("b")).where(F.col("a") < F.col("b"))
            .where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance))


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node that each linked node reaches.

    Each round takes the smallest label around a node, then the label's own label, and is a
    written table; only the number of changed labels comes to the driver. A node has at most as
    many links as there are near patterns, so no key of the first join is hot; labels are, and
    meet in a join that Spark can split.
    """
    both = stored(edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
                  .union(edges.select("b", "a")), "links")
    labels = stored(both.groupBy("node").agg(
        F.least(F.col("node"), F.min("other")).alias("root")), "labels")
    while True:
        around = (both.join(labels.select(F.col("node").alias("other"), "root"), "other")
                  .groupBy("node").agg(F.min("root").alias("near")))
        nearer = stored(labels.join(around, "node").select(
            "node", F.col("root").alias("before"), F.least("root", "near").alias("root")), "nearer")
        up = nearer.select(F.col("node").alias("root"), F.col("root").alias("up"))
        labels = stored(nearer.join(up, "root").select(
            "node", "before", F.least("root", "up").alias("root")), "labels")
        if labels.where(F.col("root") != F.col("before")).isEmpty():
            return labels.select("node", "root")
        labels = labels.select("node", "root")


def near_duplicates(docs: DataFrame, width: int = SHINGLE, distance: int = DISTANCE,
                    blocks: int = BLOCKS, paired: int = PAIRED, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``doc_id, d1, d2, fp, component_id, representative`` per row of ``docs``.

    ``component_id`` is the smallest id of the rows that are linked, directly or through others;
    ``representative`` is true for rows that are alike in id and text with the component's
    smallest row. Rows without words have fingerprint 0. A null id is never the component's,
    unless all are null. Repeated rows are in one component. An empty table gives an empty
    result; other columns are ignored.
    """
    found = stored(fingerprints(docs, width, id_col, text_col), "fingerprints")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "d1", "d2")
    prints = stored(found.groupBy("fp").agg(F.min(row).alias("first")), "prints")
    return _classes(found, prints, links(prints, distance, blocks, paired))


def _classes(found: DataFrame, prints: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows of ``found`` with the smallest row of their component, from ``fp, first`` and links."""
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "d1", "d2")
    roots = components(edges)
    rooted = stored(
        prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
        .select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
    firsts = stored(rooted.groupBy("root").agg(F.min("first").alias("head")), "heads")
    heads = rooted.join(firsts, "root").select("fp", "head")
    return (found.join(stored(heads, "classes"), "fp")
            .select("doc_id", "d1", "d2", "fp", F.col("head.doc_id").alias("component_id"),
                    (row == F.col("head")).alias("representative")))


def shingle_sets(docs: DataFrame, width: int, bands: int, rows: int, id_col: str,
                 text_col: str) -> DataFrame:
    """``doc_id, d1, d2, fp, size, blocks, sketch`` per row: a hash of the text's set of shingles,
    its size, for each band a hash of ``rows`` MinHash values, and a bit of each value. Null
    texts are empty."""
    rng = np.random.default_rng(SEED)
    factors = rng.integers(1 << 63, size=bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    offsets = rng.integers(1 << 63, size=bands * rows, dtype=np.uint64) * np.uint64(2)
    mixers = rng.integers(1 << 63, size=rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def one(text: str) -> tuple[int, int, np.ndarray, np.ndarray]:
        found = shingle_set(text, width)
        least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(found), _STEP):
            mixed = found[at:at + _STEP, None] * factors
            mixed += offsets
            np.minimum(least, mixed.min(axis=0), out=least)
        blocks = ((least ^ least >> np.uint64(29)).reshape(bands, rows) * mixers).sum(
            axis=1, dtype=np.uint64)
        print_of = xxhash.xxh64_intdigest(found.tobytes(), SEED)
        # Products with an odd factor, so that the bit isn't the same as a small value's.
        bits = (least * mixers[0] >> np.uint64(63)).astype(np.uint8)
        sketch = np.packbits(np.pad(bits, (0, -len(bits) % BITS))).view(np.int64)
        return _signed(print_of), len(found), blocks.view(np.int64), sketch

    longs = pa.list_(pa.int64())

    def of(batches):
        for batch in batches:
            values = [one(t.as_py() or "") for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], *(pa.array([v[i] for v in values], kind) for i, kind in
                                       enumerate((pa.int64(), pa.int64(), longs, longs)))],
                names=["doc_id", "d1", "d2", "fp", "size", "blocks", "sketch"])

    return _digested(docs, id_col, text_col).mapInArrow(
        of, "doc_id long, d1 long, d2 long, fp long, size long, blocks array<long>, "
            "sketch array<long>")


def shingle_set(text: str, width: int) -> np.ndarray:
    return np.unique(np.array(shingle_hashes(text, width), np.uint64))


def _digested(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    d1, d2 = digest(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), d1.alias("d1"),
                       d2.alias("d2"), F.col(text_col).alias("text"))


def _sets_of(docs: DataFrame, prints: DataFrame, width: int) -> DataFrame:
    """``fp, shingles`` for the distinct sets ``prints`` (fp, first), made again from the text of
    their first rows: only sets that meet another are ever shuffled or written."""
    def of(batches):
        for batch in batches:
            sets = [shingle_set(t.as_py() or "", width).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["fp", "shingles"])

    keys = prints.select("fp", F.col("first.doc_id").alias("k_id"), F.col("first.d1").alias("k1"),
                         F.col("first.d2").alias("k2"))
    rows = docs.join(keys, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("d1") == F.col("k1"))
                     & (F.col("d2") == F.col("k2"))).select("fp", "text")
    # Rows alike in id and text come once.
    return rows.mapInArrow(of, "fp long, shingles array<long>").groupBy("fp").agg(
        F.first("shingles").alias("shingles"))


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    def side(name: str) -> DataFrame:
        return sets.select(F.col("fp").alias(name), F.col("shingles").alias(f"{name}_set"))

    both = F.size(F.array_intersect("a_set", "b_set"))
    union = F.size("a_set") + F.size("b_set") - both
    return (pairs.join(side("a"), "a").join(side("b"), "b")
            .where(both / union >= similarity).select("a", "b"))


def most_bits(similarity: float, values: int) -> int:
    """Sketch bits that differ at a similarity: half of the MinHash values that do, and five
    deviations more, which one pair in three million exceeds."""
    share = (1 - similarity) / 2
    return int(np.ceil(values * share + 5 * np.sqrt(values * share * (1 - share))))


def similar_links(docs: DataFrame, prints: DataFrame, width: int, similarity: float, most: int,
                  paired: int = FEW) -> DataFrame:
    """``a, b``: verified links among ``fp, size, blocks, sketch, first``.

    In a bucket of up to ``paired`` fingerprints all pairs are verified. A larger one is mostly
    one group of copies: first all hang on the one that meets the most others, and what is
    connected by then needs no more links. What is left is met with the whole bucket by the
    fingerprints outside its largest component, so pairs inside a component are never made.
    """
    dealt = prints.select("fp", "size", "sketch", F.posexplode("blocks").alias("of", "bits"))
    met = dealt.groupBy("of", "bits").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    shared = stored(dealt.join(met, ["of", "bits"]), "buckets")
    hubs = stored(shared.groupBy("fp").agg(F.sum("n").alias("hub")), "hubs")
    met_sets = prints.join(hubs, "fp", "left_semi").select("fp", "first")
    sets = stored(_sets_of(docs, met_sets, width), "sets")
    member = F.struct("fp", "size", "sketch")

    def likely(a: str, b: str) -> Column:
        """Sizes and sketches of two members don't rule their similarity out."""
        apart = F.aggregate(F.zip_with(f"{a}.sketch", f"{b}.sketch",
                                       lambda x, y: F.bit_count(x.bitwiseXOR(y))),
                            F.lit(0), lambda n, x: n + x)
        small, large = F.least(f"{a}.size", f"{b}.size"), F.greatest(f"{a}.size", f"{b}.size")
        return (small >= (similarity - 1e-9) * large) & (apart <= most)

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.least("a.fp", "b.fp").alias("a"),
                            F.greatest("a.fp", "b.fp").alias("b")).distinct()

    few = (shared.where(F.col("n") <= paired).groupBy("of", "bits")
           .agg(F.collect_list(member).alias("members")))
    pairs = (few.select("members", F.posexplode("members").alias("i", "a"))
             .select("a", F.explode(F.slice("members", F.col("i") + 2, F.size("members"))).alias("b")))
    crowded = stored(shared.where(F.col("n") > paired).join(hubs, "fp")
                     .select("of", "bits", "hub", member.alias("b")), "members")
    heads = crowded.groupBy("of", "bits").agg(F.max(F.struct("hub", "b"))["b"].alias("a"))
    stars = crowded.join(heads, ["of", "bits"]).where(F.col("a.fp") != F.col("b.fp")).select("a", "b")
    found = stored(_verified(ordered(pairs.union(stars).where(likely("a", "b"))), sets, similarity),
                   "pairs")
    roots = components(found).select(F.col("node").alias("fp"), "root")
    rooted = stored(crowded.join(roots, F.col("b.fp") == F.col("fp"), "left").select(
        "of", "bits", "b", F.coalesce("root", "b.fp").alias("root")), "crowded")
    sizes = rooted.groupBy("of", "bits", "root").agg(F.count("*").alias("m"))
    largest = sizes.groupBy("of", "bits").agg(F.max(F.struct("m", "root"))["root"].alias("main"))
    outside = (rooted.join(largest, ["of", "bits"]).where(F.col("root") != F.col("main"))
               .select(F.col("of").alias("a_of"), F.col("bits").alias("a_bits"),
                       F.col("b").alias("a"), F.col("root").alias("a_root")))
    rest = rooted.join(outside, (F.col("of") == F.col("a_of")) & (F.col("bits") == F.col("a_bits"))
                       & (F.col("root") != F.col("a_root")) & likely("a", "b"))
    return found.union(_verified(ordered(rest), sets, similarity))


def similar_documents(docs: DataFrame, width: int = 5, similarity: float = 0.8, bands: int = BANDS,
                      rows: int = ROWS, paired: int = FEW, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """``doc_id, d1, d2, fp, component_id, representative`` per row, as ``near_duplicates``, by
    sets of ``width``-word shingles whose Jaccard similarity is ``similarity`` or more.

    Pairs meet if all ``rows`` MinHash values of one of ``bands`` bands agree, with chance
    1 - (1 - s ** rows) ** bands at a similarity of s: with 40 bands of 6, a lone pair at 0.8 is
    missed 5 times in a million, at 0.85 6 times in a billion; sketches rule out one in three
    million. What is left is verified by the whole sets: no pair below ``similarity`` is linked.
    """
    found = stored(shingle_sets(docs, width, bands, rows, id_col, text_col), "fingerprints")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "d1", "d2")
    prints = stored(found.groupBy("fp").agg(F.first("size").alias("size"),
                                            F.first("blocks").alias("blocks"),
                                            F.first("sketch").alias("sketch"), F.min(row).alias("first")), "prints")
    edges = similar_links(_digested(docs, id_col, text_col), prints, width, similarity,
                          most_bits(similarity, bands * rows), paired)
    return _classes(found.drop("size", "blocks", "sketch"), prints.select("fp", "first"), edges)


def hex_print(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), BITS // 4, "0")
