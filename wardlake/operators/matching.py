"""Lines against rules: the theta join at the heart of every scanner.

Rules are configuration, known when the plan is built, so the join is unrolled: one
guarded predicate per rule inside a single projection, then an explode of the rules
that hit. Lines never meet the rules in a shuffle or a pair table, every regex is a
constant (compiled once per task), and the anchors decide most lines without a regex.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.functions.text import contains_any
from wardlake.rules import Rule, spell

# Rules per generated array: keeps each generated expression small enough for the JIT.
RULES_PER_ARRAY = 16


def rule_hits(rule: Rule, text: Column, folded: Column, unicode_space: bool) -> Column:
    """Cheapest test first: literals, then the guard, then the pattern itself."""
    hit = text.rlike(spell(rule.regex, unicode_space))
    if rule.guard:
        hit = text.rlike(spell(rule.guard)) & hit
    if rule.anchors:
        hit = contains_any(folded if rule.fold else text, rule.anchors) & hit
    return hit


def match_rules(lines: DataFrame, rules: Sequence[Rule], unicode_space: bool = False,
                gates: Mapping[str, Column] | None = None,
                extract: Collection[str] = (), extra: Sequence[Column] = ()) -> DataFrame:
    """One row per (line, rule that hits); ``rule`` is the position in ``rules``.

    ``extra`` holds further conditions; they count on from the last rule.
    ``gates`` holds, per rule family, a condition lines must meet to be tried at all.
    Families in ``extract`` also get ``match``, the text of the leftmost match.
    """
    gates = gates or {}
    text, folded = F.col("text"), F.col("_folded")
    tested = lines
    if any(r.fold for r in rules):
        tested = tested.withColumn("_folded", F.lower("text"))
    tries = []
    for i, rule in enumerate(rules):
        hit = rule_hits(rule, text, folded, unicode_space)
        if rule.family in gates:
            hit = gates[rule.family] & hit
        found = [F.lit(i).alias("rule")]
        if extract:
            pattern = spell(rule.regex, unicode_space)
            found.append((F.regexp_extract(text, pattern, rule.group)
                          if rule.family in extract else F.lit(None).cast("string"))
                         .alias("match"))
        tries.append(F.when(hit, F.struct(*found)))
    for i, condition in enumerate(extra, len(rules)):
        tries.append(F.when(condition, F.struct(F.lit(i).alias("rule"))))
    chunks = [F.array_compact(F.array(*tries[i:i + RULES_PER_ARRAY]))
              for i in range(0, len(tries), RULES_PER_ARRAY)]
    hits = chunks[0] if len(chunks) == 1 else F.concat(*chunks)
    return tested.select(*lines.columns, F.inline(hits))


def rule_value(rules: Sequence[Rule], field: str, rule: str = "rule") -> Column:
    """Lookup of a rule attribute: a constant array indexed by the rule's position."""
    values = F.array(*(F.lit(getattr(r, field)) for r in rules))
    return F.element_at(values, F.col(rule) + 1)


def with_rule_columns(hits: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    return (hits.withColumn("ordinal", rule_value(rules, "ordinal"))
            .withColumn("type", rule_value(rules, "type")))


def match_start(rules: Sequence[Rule], unicode_space: bool = False) -> Column:
    """1-based byte column of the leftmost match of the row's rule."""
    text, rule = F.col("text"), F.col("rule")
    start = F.coalesce(*(
        F.when(rule == i, F.regexp_instr(text, F.lit(spell(r.regex, unicode_space))))
        for i, r in enumerate(rules)))
    return F.octet_length(F.substring(text, F.lit(1), start - 1)) + 1
