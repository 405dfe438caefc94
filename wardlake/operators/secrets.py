"""Secret findings, in two profiles.

``gate`` is the deployment gate: context filters, repository-wide dedup, dotted masks.
``strict`` filters on the line's words only, dedups per file and masks with stars.
The raw match lives only inside a task: what is shuffled or returned is mask and hash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.functions import paths, text as tx
from wardlake.operators.matching import match_rules, rule_value, with_rule_columns
from wardlake.rules import SECRET_RULES, Rule
from wardlake.schemas import SCAN_KEY
from wardlake.sources.files import explode_lines, gate_files, strict_files

# Word lists of the context filters and confidence factors.
TEST_PATH_PARTS = ("_test.go", "test_", "example", "mock")
ALWAYS_REPORTED = ("AWS_KEY", "GITHUB_TOKEN", "PRIVATE_KEY")
DOC_SUFFIXES = (".md", ".txt")
PLACEHOLDERS = ("example", "sample", "test", "dummy", "fake", "placeholder", "your_", "xxx")
PASSWORD_NAMES = ("const", "var", "password_", "passwordfield")
DOC_CONTEXTS = ("readme", "documentation", "example", "sample", "test", "demo", "placeholder",
                "your_", "replace_with", "fake", "mock")
CONSOLE_URL = "console.developers.google.com"
SECRET_WORDS = ("secret", "key", "token", "password", "auth", "bearer")
SAMPLE_WORDS = ("example", "test", "sample", "demo")
COMMENT_MARKS = ("//", "#", "/*", "*")


def secret_candidates(lines: DataFrame, rules: Sequence[Rule] = SECRET_RULES,
                      unicode_space: bool = False) -> DataFrame:
    """Lines x rules where the rule hits, with the first match per line and rule."""
    hits = match_rules(lines, rules, unicode_space, extract={r.family for r in rules})
    return with_rule_columns(hits, rules)


# --- context filters: true means "not a finding" ---------------------------------------

def fp_comment() -> Column:
    return tx.is_comment(F.col("text"))


def fp_password() -> Column:
    low = tx.fold_case(F.col("text"))
    no_value = low.contains("password") & ~F.col("text").contains("=")
    return (F.col("type") == "PASSWORD") & (no_value | tx.has_word(low, PASSWORD_NAMES))


def fp_test_path() -> Column:
    in_tests = tx.has_word(F.col("path"), TEST_PATH_PARTS)
    return in_tests & ~F.col("type").isin(*ALWAYS_REPORTED)


def fp_docs() -> Column:
    return tx.ends_with_any(F.col("path"), DOC_SUFFIXES)


def fp_placeholder() -> Column:
    return tx.has_word(tx.fold_case(F.col("match")), PLACEHOLDERS)


def doc_context() -> Column:
    """The line talks about documentation or examples."""
    low = tx.fold_case(F.col("text"))
    return tx.has_word(low, DOC_CONTEXTS) | (
        (F.col("type") == "GOOGLE_API_KEY") & low.contains(CONSOLE_URL))


likely_fp = fp_strict = doc_context


def gate_false_positive() -> Column:
    """All filters of the gate profile, cheapest first.

    The condition on ``rule`` ties the predicate to hits: without it the optimizer would push
    the line checks below the rule match and run them on every line of every file.
    """
    drop = fp_docs() | fp_comment() | fp_test_path() | fp_password() | fp_placeholder()
    return F.when(F.col("rule") >= 0, drop).otherwise(False)


def strict_false_positive() -> Column:
    return F.when(F.col("rule") >= 0, fp_strict()).otherwise(False)


# --- confidence ----------------------------------------------------------------------

def _when(condition: Column, amount: float) -> Column:
    return F.when(condition, F.lit(amount)).otherwise(F.lit(0.0))


def confidence(rules: Sequence[Rule] = SECRET_RULES, strict: bool = False) -> Column:
    """How likely the match is a real secret, in [0, 1]. Needs an ``entropy`` column.

    The order of the double additions decides the last bits, and thresholds downstream see
    them (0.5 + 0.2 + 0.1 is below 0.8), so the factors are added in exactly this order.
    """
    line, low = F.col("text"), tx.fold_case(F.col("text"))
    size, entropy = F.octet_length("match"), F.col("entropy")
    factors = [
        _when(tx.has_word(low, SECRET_WORDS), 0.2),
        _when(line.contains("=") & (line.contains('"') | line.contains("'")), 0.15),
        rule_value(rules, "confidence_boost"),
    ]
    if not strict:
        factors += [_when(tx.has_word(low, SAMPLE_WORDS), -0.3),
                    _when(tx.has_word(low, COMMENT_MARKS), -0.2)]
    factors += [
        _when(doc_context(), -0.4),
        F.when(entropy > 4.0, 0.2).when(entropy > 3.0, 0.1).when(entropy < 2.0, -0.2)
        .otherwise(0.0),
        F.when(size < 10, -0.1).when(size > 50, 0.1).otherwise(0.0),
    ]
    total = F.lit(0.5)
    for factor in factors:
        total = total + factor
    return F.greatest(F.least(total, F.lit(1.0)), F.lit(0.0))


def with_confidence(cands: DataFrame, rules: Sequence[Rule] = SECRET_RULES,
                    strict: bool = False) -> DataFrame:
    return (cands.withColumn("entropy", tx.shannon_entropy(F.col("match")))
            .withColumn("confidence", confidence(rules, strict)))


# --- dedup and full pipelines ----------------------------------------------------------

FINDING_FIELDS = ("file", "line", "type", "severity", "match", "match_hash", "confidence")


def as_findings(cands: DataFrame, rules: Sequence[Rule], strict: bool = False) -> DataFrame:
    """Finding columns plus the walk position (path_arr, line, ordinal)."""
    severity = rule_value(rules, "strict_severity" if strict else "severity")
    mask = tx.mask_strict if strict else tx.mask_gate
    return with_confidence(cands, rules, strict).select(
        *SCAN_KEY, paths.path_order(F.col("rel_path")).alias("path_arr"),
        F.col("rel_path").alias("file"), "line", "ordinal", "type",
        severity.alias("severity"), mask(F.col("match")).alias("match"),
        tx.match_hash(F.col("match")).alias("match_hash"), "confidence")


def keep_first(findings: DataFrame, keys: Sequence[str]) -> DataFrame:
    """First finding per key in walk order.

    ``min`` over a struct that starts with the position: partial aggregation keeps one row
    per key and map task, so copies of one secret are folded before the shuffle.
    """
    payload = ["path_arr", "line", "ordinal"] + [
        c for c in findings.columns if c not in {"path_arr", "line", "ordinal", *keys}]
    first = findings.groupBy(*keys).agg(F.min(F.struct(*payload)).alias("first"))
    return first.select(*keys, "first.*").select(*findings.columns)


def dedup_gate(findings: DataFrame) -> DataFrame:
    """Once per repository and match, whatever the rule."""
    return keep_first(findings, [*SCAN_KEY, "match_hash"])


def dedup_strict(findings: DataFrame) -> DataFrame:
    """Once per file and match."""
    return keep_first(findings, [*SCAN_KEY, "file", "match_hash"])


def secrets_gate(files: DataFrame, rules: Sequence[Rule] = SECRET_RULES) -> DataFrame:
    cands = secret_candidates(explode_lines(gate_files(files)), rules)
    kept = cands.where(~gate_false_positive())
    return dedup_gate(as_findings(kept, rules)).select(*SCAN_KEY, *FINDING_FIELDS)


def secrets_strict(files: DataFrame, rules: Sequence[Rule] = SECRET_RULES) -> DataFrame:
    lines = explode_lines(strict_files(files), True)
    kept = secret_candidates(lines, rules, unicode_space=True).where(~strict_false_positive())
    found = dedup_strict(as_findings(kept, rules, strict=True))
    return found.select(*SCAN_KEY, *FINDING_FIELDS)
