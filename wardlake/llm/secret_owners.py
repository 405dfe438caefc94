"""Secrets in texts, told from copied examples by who else has them.

Base kinds are plain patterns and always reported. Further candidates (keys of known vendors,
long mixed strings) are hashed where they are found, so no secret leaves its task in the clear;
distinct repositories and owners are counted per hash over the whole corpus. A value that many
owners have is a widely copied example; one that few have, and that looks alive, is reported.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.llm.common import digest, stored


class Kind(NamedTuple):
    name: str
    pattern: str
    least: int = 0  # shorter values are no finding, but what they match is used up
    group: int = 0  # which group of the pattern is the value


# Patterns of the base kinds, in order.
BASE = (
    Kind("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
         r"([A-Za-z0-9+/_.=-]+)", 6, 2),
    Kind("access", "AKIA[A-Z0-9]+", 20),
    Kind("hex", "[0-9a-f]+", 24))
# Prefixes and lengths of vendors' keys; mixed strings as random keys have them.
ADDED = (
    Kind("vendor", r"gh[pousr]_[A-Za-z0-9]{36,255}|github_pat_[A-Za-z0-9_]{40,255}"
         r"|xox[abprs]-[A-Za-z0-9-]{10,255}|AIza[A-Za-z0-9_-]{35}|sk_live_[A-Za-z0-9]{16,255}"
         r"|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Kind("mixed", r"(?<![A-Za-z0-9+/_-])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])"
         r"(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{32,256}(?![A-Za-z0-9+/_-])"))
KINDS = BASE + ADDED
#: Words that stand in examples, and how many different characters a live key has at least.
EXAMPLE_WORDS = r"(?i)example|sample|dummy|placeholder|changeme|your|xxxx|0000|1234567|abcdef"
LEAST_DIFFERENT, OWNERS = 8, 2
_FOUND = ("array<struct<start:int,kind:int,end:int,h1:bigint,h2:bigint,alive:boolean>>")


def _alive(value: Column) -> Column:
    different = F.size(F.array_distinct(F.split(F.substring(value, 1, 4096), "")))
    return ~value.rlike(EXAMPLE_WORDS) & (different >= LEAST_DIFFERENT)


def _found(text: Column, nth: int, kind: Kind) -> Column:
    """Findings of one kind, leftmost first: what lies between matches has their places."""
    def matches(group: int) -> Column:
        return F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(group))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["match"])
        h1, h2 = digest(x["value"])
        finding = F.struct(start.alias("start"), F.lit(nth).alias("kind"), end.alias("end"),
                           h1.alias("h1"), h2.alias("h2"), _alive(x["value"]).alias("alive"))
        longer = F.concat(state["found"], F.array(finding))
        found = F.when(F.length(x["value"]) >= kind.least, longer).otherwise(state["found"])
        return F.struct(end.alias("at"), found.alias("found"))

    parts = F.arrays_zip(F.split(text, kind.pattern).alias("gap"), matches(0).alias("match"),
                         matches(kind.group).alias("value"))
    # One more gap than matches.
    told = F.slice(parts, 1, F.size(parts) - 1)
    none = F.array().cast(_FOUND)
    state = F.aggregate(told, F.struct(F.lit(0).alias("at"), none.alias("found")), step)
    return F.when(text.rlike(kind.pattern), state["found"]).otherwise(none)


def _listed(findings: Column) -> Column:
    """``kind:start:end`` by start, then kind, comma-joined."""
    names = F.array(*(F.lit(k.name) for k in KINDS))
    return F.array_join(F.transform(F.array_sort(findings), lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def secrets(docs: DataFrame, owners: int = OWNERS, id_col: str = "doc_id",
            text_col: str = "text", owner_col: str = "source",
            repository_col: str | None = None) -> DataFrame:
    """``doc_id, findings, spans, base_spans`` and counts ``n_*`` per row of ``docs``.

    ``findings`` are the base kinds and those added by ownership: an array of (start, kind, end,
    owners, repositories, copied), places in code points, end exclusive; kind numbers ``KINDS``.
    ``copied`` values have more than ``owners`` owners. A repository is a document where no
    column names it. Null and empty texts have no findings; no owner is one owner; repeated rows
    count once and get the same findings each. Other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    base = docs.select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
        F.col(owner_col).alias("owner"),
        F.col(repository_col or id_col).cast("string").alias("repository"))
    d1, d2 = digest(text)
    found = stored(base.select(
        "doc_id", d1.alias("d1"), d2.alias("d2"), "owner", "repository",
        F.concat(*(_found(text, i, k) for i, k in enumerate(KINDS))).alias("found")), "found")
    each = found.where(F.size("found") > 0).select(
        "doc_id", "d1", "d2", "owner", "repository", F.explode("found").alias("s"))
    # Sums by ever fewer keys: a value that a third of all documents have is spread until the end.
    value = ["s.h1", "s.h2"]
    spread = (each.groupBy(*value, "owner", "repository").agg(F.lit(1).alias("one"))
              .groupBy("h1", "h2", "owner").agg(F.count("*").alias("repositories"))
              .groupBy("h1", "h2").agg(F.count("*").alias("owners"),
                                       F.sum("repositories").alias("repositories")))
    judged = (each.select("doc_id", "d1", "d2", "s", "s.h1", "s.h2").join(spread, ["h1", "h2"])
              .withColumn("copied", F.col("owners") > owners)
              .where((F.col("s.kind") < len(BASE)) | (F.col("s.alive") & ~F.col("copied"))))
    kept = judged.groupBy(F.col("doc_id").alias("k_id"), F.col("d1").alias("k1"),
                          F.col("d2").alias("k2")).agg(F.collect_set(F.struct(
                              "s.start", "s.kind", "s.end", "owners", "repositories",
                              "copied")).alias("findings"))
    met = found.join(kept, F.col("doc_id").eqNullSafe(F.col("k_id")) & (F.col("d1") == F.col("k1"))
                     & (F.col("d2") == F.col("k2")), "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int,owners:bigint,"
                          "repositories:bigint,copied:boolean>>")
    out = met.select("doc_id", F.array_sort(F.coalesce("findings", none)).alias("findings"))

    def number(kind: int) -> Column:
        return F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("long")

    return out.select(
        "doc_id", "findings", _listed(F.col("findings")).alias("spans"),
        _listed(F.filter("findings", lambda s: s["kind"] < len(BASE))).alias("base_spans"),
        *(number(i).alias(f"n_{k.name}") for i, k in enumerate(KINDS)),
        F.size(F.filter("findings", lambda s: s["copied"])).cast("long").alias("n_copied"))
