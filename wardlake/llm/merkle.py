"""A Merkle manifest of a table: ternary trees kept as a postorder append log.

Leaf of a row: H of its fields doc_id, source, lang, n_chars, text, each written ``-`` if null,
else ``<UTF-8 byte count>:<value>`` (integers in decimal). H is the lowercase hex SHA-256 of its
inputs concatenated, digests as hex text.

Trees: per group (a source), leaves ascend by doc_id (nulls first, ties by leaf, so equal rows
are interchangeable). While a group has more than one node, each run of three consecutive nodes
(the last run: fewer, even one) becomes their H. The lone node left is the group's subroot (a
lone leaf is its own). The subroots, ordered by source (null first, then UTF-8 bytewise), make
one more tree of the same shape; its top is the root.

Method: aligned builders. Node k of level l covers leaves [k*3^l, (k+1)*3^l), so a level is one
grouping by (group, k div 3) with at most three rows a key, whatever the size of a source. Nodes
go into the log at their postorder positions, worked out in closed form from subtree sizes
(``postorder``); a child finds its parent by that position, and the proof of a leaf is the
chain of the runs' other members, level by level, carried down from the top by those positions.
Leaves are numbered without a window over a source (``numbered``): range-partitioned, counted
per partition, offset by the partitions before.

Edge cases: null fields are ``-``; an empty table gives no rows; repeated rows give equal leaves
and each its own row; a lone row is leaf, subroot and root at once with proof H(""). Tampering
(the contract's check of proofs): where 2 divides the unsigned crc32 of the decimal doc_id, the
text loses its ``\\n`` characters (null text and null doc_id stay as they are); ``folded_root``
folds that leaf with the untampered siblings and ``verified`` tells whether it meets the root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardlake.llm.common import stored

ARITY = 3
#: Sources of the top tree that may be broadcast to the leaves; more are joined by shuffle.
BROADCAST_SOURCES = 100_000
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def H(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(text: Column) -> Column:
    return H(*(field(text if name == "text" else F.col(name)) for name in FIELDS))


def tampered(text: Column) -> Column:
    hit = (F.crc32(F.col("doc_id").cast("string")) % 2 == 0) & F.col("doc_id").isNotNull()
    return F.when(hit, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def group_key(source: Column) -> Column:
    """A string that orders as the contract does: null first, then UTF-8 bytewise."""
    return F.when(source.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), source))


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``k`` (0-based rank within ``g`` by ``order``) and ``n`` (rows of the group).

    No window over a group: rows are range-partitioned by (g, order) and sorted, positions in a
    partition come from ``monotonically_increasing_id``, and each (partition, group) is offset by
    the counts of the partitions before it (a table of at most partitions + groups rows).
    ``order`` must make equal keys interchangeable rows.
    """
    keys = ["g", *order]
    sorted_rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    pid = F.spark_partition_id().cast("long")
    placed = sorted_rows.select(
        "*", pid.alias("_pid"),
        (F.monotonically_increasing_id() - F.shiftleft(pid, 33)).alias("_at"))
    placed = stored(placed, "merkle_placed")
    counts = placed.groupBy("_pid", "g").agg(F.min("_at").alias("_first"),
                                             F.count("*").alias("_count"))
    earlier = Window.partitionBy("g").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(
        "_pid", "g", "_first", F.coalesce(F.sum("_count").over(earlier), F.lit(0)).alias("_before"),
        F.sum("_count").over(Window.partitionBy("g")).alias("n"))
    out = placed.join(counts, ["_pid", "g"])
    return out.withColumn("k", F.col("_before") + F.col("_at") - F.col("_first")).drop(
        "_pid", "_at", "_first", "_before")


def levels_above(n: str) -> Column:
    """Levels over the leaves of a group of n: the least L with ceil(n / 3^L) = 1."""
    p = f"cast(pow({ARITY}, j) as bigint)"
    return F.expr(f"aggregate(sequence(0, 36), 0, (acc, j) -> acc + if(({n} + {p} - 1) div {p} > 1, 1, 0))")


def postorder(level: str, k: str, n: str, top: str) -> Column:
    """Closed-form postorder position of node (level, k) in a tree over n leaves with ``top``
    levels: nodes whose spans end before its first leaf, plus its descendants."""
    s = f"({k} * cast(pow({ARITY}, {level}) as bigint))"
    e = f"least(({k} + 1) * cast(pow({ARITY}, {level}) as bigint), {n})"
    p = f"cast(pow({ARITY}, j) as bigint)"
    return F.expr(f"""aggregate(sequence(0, {top}), 0L, (acc, j) -> acc + ({s} div {p}))
        + aggregate(sequence(0, {level}), 0L, (acc, j) ->
            acc + if(j < {level}, ({e} + {p} - 1) div {p} - ({s} div {p}), 0L))""")


def build(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """From level-0 nodes (g, n, k, h): the log (g, pos, level, k, h) and, per level, its nodes
    with the strings of their run's others (``left``, ``right``; null at a group's top)."""
    nodes = nodes.withColumn("top", levels_above("n")).withColumn("level", F.lit(0))
    most = nodes.agg(F.max("top")).first()[0] or 0
    done: list[DataFrame] = []
    current = nodes
    for level in range(most + 1):
        live = current.where(F.col("level") < F.col("top"))
        runs = live.groupBy("g", "n", "top", (F.col("k") / ARITY).cast("long").alias("parent")).agg(
            F.array_sort(F.collect_list(F.struct("k", "h"))).alias("run"))
        runs = stored(runs, f"merkle_runs_{level}")
        members = runs.select(
            "g", "n", "top", "run", F.posexplode("run").alias("at", "node")).select(
            "g", "n", "top", F.col("node.k").alias("k"), F.col("node.h").alias("h"),
            F.array_join(F.slice(F.col("run.h"), 1, F.col("at")), "").alias("left"),
            F.array_join(F.slice(F.col("run.h"), F.col("at") + 2, ARITY), "").alias("right"))
        # Tops stay in their level without run strings.
        tops = current.where(F.col("level") >= F.col("top")).select(
            "g", "n", "top", "k", "h", F.lit(None).cast("string").alias("left"),
            F.lit(None).cast("string").alias("right"))
        done.append(members.unionByName(tops).withColumn("level", F.lit(level)))
        current = runs.select("g", "n", "top", F.col("parent").alias("k"),
                              H(F.array_join(F.col("run.h"), "")).alias("h"),
                              F.lit(level + 1).alias("level"))
        if level == most:
            break
    per_level = [lv.withColumn("pos", postorder("level", "k", "n", "top")) for lv in done]
    log = per_level[0].select("g", "pos", "level", "k", "h")
    for lv in per_level[1:]:
        log = log.unionByName(lv.select("g", "pos", "level", "k", "h"))
    return log, per_level


def paths(per_level: list[DataFrame]) -> DataFrame:
    """Level-0 nodes with ``path``: (left, right) of their run at each level up to the top.

    Carried down from the top: a node takes its parent's path, found at the parent's postorder
    position, behind its own run strings.
    """
    parent_pos = postorder("(level + 1)", "(k div 3)", "n", "top")
    above = None
    empty = F.array().cast("array<struct<left:string,right:string>>")
    for lv in reversed(per_level):
        rows = lv.withColumn("parent_pos", F.when(F.col("left").isNotNull(), parent_pos))
        if above is None:
            rows = rows.withColumn("up", empty)
        else:
            rows = rows.join(above, ["g", "parent_pos"], "left")
        rows = rows.select(
            "g", "n", "top", "level", "k", "h", "pos",
            F.when(F.col("left").isNull(), empty).otherwise(F.concat(
                F.array(F.struct("left", "right")), F.coalesce("up", empty))).alias("path"))
        above = stored(rows.select("g", F.col("pos").alias("parent_pos"), F.col("path").alias("up")),
                       "merkle_paths")
        last = rows
    return last


def fold(start: Column, path: Column) -> Column:
    return F.aggregate(path, start, lambda acc, p: H(p["left"], acc, p["right"]))


def manifest(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified; the log of
    nodes is written beside (see module text)."""
    rows = docs.select(*(F.col(c) for c in FIELDS)).select(
        "doc_id", group_key(F.col("source")).alias("g"), leaf(F.col("text")).alias("h"),
        leaf(tampered(F.col("text"))).alias("tampered"))
    leaves = numbered(rows, ["doc_id", "h"])
    log, per_source = build(leaves.select("g", "n", "k", "h"))
    # The manifest itself: every node at its postorder position, written in that order.
    stored(log.repartitionByRange("g", "pos").sortWithinPartitions("g", "pos"), "merkle_log")
    leaf_paths = paths(per_source)

    tops = None
    for lv in per_source:
        found = lv.where(F.col("left").isNull()).select("g", F.col("h").alias("subroot"))
        tops = found if tops is None else tops.unionByName(found)
    tops = stored(tops, "merkle_subroots")
    sources = numbered(tops.select(F.lit("").alias("g"), F.col("g").alias("source_key"),
                                   F.col("subroot").alias("h")), ["source_key"])
    n_sources = sources.count()
    _, per_top = build(sources.select("g", "n", "k", "h"))
    top_paths = paths(per_top).select("k", F.col("path").alias("top_path"))
    # One value: the top of the tree over all sources.
    root = per_top[-1].where(F.col("left").isNull()).select("h").first()
    by_source = sources.select(F.col("source_key").alias("g"), "k", F.col("h").alias("subroot"),
                               F.lit(root[0] if root else None).cast("string").alias("root")) \
        .join(top_paths, "k").drop("k")
    if n_sources <= BROADCAST_SOURCES:
        by_source = F.broadcast(by_source)
    placed = leaves.select("g", "k", "doc_id", "h", "tampered")
    out = placed.join(leaf_paths.where(F.col("level") == 0).select("g", "k", "path"), ["g", "k"])
    out = out.join(by_source, "g")
    full = F.concat(F.col("path"), F.col("top_path"))
    proof = H(F.coalesce(F.array_join(F.transform(full, lambda p: F.concat(p["left"], p["right"])),
                                      ""), F.lit("")))
    folded = fold(F.col("tampered"), full)
    return out.select("doc_id", F.col("h").alias("leaf"), "subroot", "root",
                      proof.alias("proof_sha256"), folded.alias("folded_root"),
                      (folded == F.col("root")).alias("verified"))
