"""Dangerous code patterns, with the context checks that let legitimate uses pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.functions import paths, text as tx
from wardlake.operators.matching import match_rules, rule_value, with_rule_columns
from wardlake.rules import CODE_RULES, Rule
from wardlake.schemas import SCAN_KEY
from wardlake.sources.files import explode_lines, gate_files

# Literal texts that mark a legitimate use.
EVAL_MENTIONS = ('"EVAL"', "'EVAL'", "eval\\(", "eval.*usage")
MONITOR_COMMANDS = ("netstat", "ss -", "ps aux", "lsof", "top", "df -h", "free -m",
                    "systemctl status", "journalctl", "docker ps", "kubectl get")
MONITOR_PATHS = ("agent", "monitor")
FIXED_SHELL = '"sh", "-c"'
BOUND_SQL = ("prepare", "?", "$1", "bind")
LOCAL_ADDRESSES = ("127.0.0.1", "0.0.0.0", "localhost", "192.168.")


def code_issue_candidates(lines: DataFrame, rules: Sequence[Rule] = CODE_RULES) -> DataFrame:
    return with_rule_columns(match_rules(lines, rules), rules)


# --- context checks: true means "legitimate" --------------------------------------------

def legit_comment() -> Column:
    return tx.is_comment(F.col("text"))


def legit_eval() -> Column:
    return (F.col("type") == "EVAL") & tx.has_word(F.col("text"), EVAL_MENTIONS)


def legit_shell_monitor() -> Column:
    return ((F.col("type") == "SHELL_INJECTION")
            & tx.has_word(F.col("text"), MONITOR_COMMANDS)
            & tx.has_word(F.col("path"), MONITOR_PATHS))


def legit_shell_static() -> Column:
    line, low = F.col("text"), tx.fold_case(F.col("text"))
    return ((F.col("type") == "SHELL_INJECTION") & line.contains(FIXED_SHELL)
            & ~tx.has_word(low, ("input", "user")) & ~line.contains("+"))


def legit_sql_bound() -> Column:
    return (F.col("type") == "SQL_INJECTION") & tx.has_word(
        tx.fold_case(F.col("text")), BOUND_SQL)


def legit_ip() -> Column:
    return (F.col("type") == "HARDCODED_IP") & tx.has_word(F.col("text"), LOCAL_ADDRESSES)


def legitimate() -> Column:
    """All checks; tied to ``rule`` so that they run on hits, not on every line."""
    drop = (legit_ip() | legit_eval() | legit_comment() | legit_sql_bound()
            | legit_shell_monitor() | legit_shell_static())
    return F.when(F.col("rule") >= 0, drop).otherwise(False)


def as_issues(cands: DataFrame, rules: Sequence[Rule] = CODE_RULES) -> DataFrame:
    return cands.select(
        *SCAN_KEY, paths.path_order(F.col("rel_path")).alias("path_arr"),
        F.col("rel_path").alias("file"), "line", "ordinal", "type",
        rule_value(rules, "severity").alias("severity"),
        rule_value(rules, "description").alias("description"))


def code_issues(files: DataFrame, rules: Sequence[Rule] = CODE_RULES) -> DataFrame:
    """Every hit is reported: code issues are not deduplicated, so nothing is shuffled."""
    cands = code_issue_candidates(explode_lines(gate_files(files)), rules)
    return as_issues(cands.where(~legitimate()), rules).select(
        *SCAN_KEY, "file", "line", "type", "severity", "description")
