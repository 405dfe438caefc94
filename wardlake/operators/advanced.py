"""Advanced, multi-language findings: line patterns, data flow, crypto, and call sites.

Call sites come from lexing, not parsing: each file is scanned once per detector that applies,
from left to right, stepping over comments and strings; a node takes its bracketed arguments
or block whole at any depth (recursive groups). Nested calls and chains of unwraps are reported
once, where they start, and only common literal forms are told apart (no raw strings, no nested
block comments). The scan runs per file in an Arrow-batched pandas UDF, since Spark's regular
expressions have no recursion; it is linear in the file's length.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.functions import paths, text as tx
from wardlake.operators.matching import match_rules, match_start, rule_value
from wardlake.rules import (DANGEROUS_SINKS, PATTERN_RULES, USER_INPUTS, WEAK_CRYPTO_WORDS, Rule)
from wardlake.schemas import ADVANCED_FINDING, SCAN_KEY
from wardlake.sources.files import api_source_files, explode_lines

PATTERN_CONFIDENCE = 0.8
CONTEXT = 50


def analyzed_lines(files: DataFrame) -> DataFrame:
    return explode_lines(files, True)


def _as_finding(rows: DataFrame, *, column: Column, kind: Column | str, severity: Column | str,
                description: Column | str, confidence: Column | float, context: Column,
                vulnerability: Column | str) -> DataFrame:
    def lit(v):
        return v if isinstance(v, Column) else F.lit(v)

    return rows.select(
        *SCAN_KEY, F.col("path").alias("file"), "line", column.cast("int").alias("column"),
        lit(kind).alias("finding_type"), lit(severity).alias("severity"),
        lit(description).alias("description"), lit(confidence).alias("confidence"),
        context.alias("code_context"), lit(vulnerability).alias("vulnerability_class"))


def adv_patterns(lines: DataFrame, rules: Sequence[Rule] = PATTERN_RULES) -> DataFrame:
    """First match per line and rule; the column counts bytes."""
    hits = match_rules(lines, rules, unicode_space=True)
    return _as_finding(
        hits, column=match_start(rules, unicode_space=True), kind=rule_value(rules, "type"),
        severity=rule_value(rules, "severity"), description=rule_value(rules, "description"),
        confidence=PATTERN_CONFIDENCE, context=tx.strip_space(F.col("text")),
        vulnerability=rule_value(rules, "vulnerability_class"))


def tainted_flow(lines: DataFrame) -> DataFrame:
    """User input and a dangerous call on one line."""
    text = F.col("text")
    hits = lines.where(tx.contains_any(text, DANGEROUS_SINKS)
                       & tx.contains_any(text, USER_INPUTS))
    return _line_report(hits, LINE_REPORTS[0], 0)


def weak_crypto(lines: DataFrame) -> DataFrame:
    """Names of weak algorithms, once per line."""
    return _line_report(lines.where(tx.contains_any(F.col("text"), WEAK_CRYPTO_WORDS)),
                        LINE_REPORTS[1], 1)


def _line_report(hits: DataFrame, report: _Report, column: int) -> DataFrame:
    return _as_finding(
        hits, column=F.lit(column), kind=report.type, severity=report.severity,
        description=report.description, confidence=report.confidence,
        context=tx.strip_space(F.col("text")), vulnerability=report.vulnerability_class)


# --- call sites --------------------------------------------------------------------------

# Comments and string literals, with loops possessive so that long ones are matched without
# backtracking.
DOUBLE = r'"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"'
LONG_DOUBLE = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
SINGLE = r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'"
BACKTICK = r"`[^`\\]*+(?:\\.[^`\\]*+)*+`"
SLASH_COMMENTS = r"//[^\n]*+|/\*(?:[^*]|\*(?!/))*+\*/"
TRIPLE = r'"""(?:[^"]|"(?!""))*+"""|' + r"'''(?:[^']|'(?!''))*+'''"
# A character literal, so that a lifetime's quote does not open a string.
CHARACTER = r"'(?:\\[^\n]|[^'\\\n])'"

# Balanced parentheses (strings inside them skipped) and braces, at any depth: recursive groups
# of the ``regex`` module, defined once in front of every detector's pattern.
_DEFINE = (rf"(?(DEFINE)(?P<args>\((?:[^()\"'`]++|{DOUBLE}|{SINGLE}|{BACKTICK}|(?&args))*+\))"
           r"(?P<block>\{(?:[^{}]++|(?&block))*+\}))")
_ARGS = r"(?&args)"
_BLOCK = r"(?&block)"
# A step of a method chain other than unwrap and expect.
_LINK = rf"(?:!?{_ARGS}|\[[^\[\]]*+\]|\?|\s*+\.(?!unwrap\(\)|expect\()\w++)"


@dataclass(frozen=True)
class CallSite:
    """One detector: where it applies, what to skip, and the node it reports."""
    type: str
    extensions: tuple[str, ...]
    hints: tuple[str, ...]
    skip: str
    node: str
    severity: str
    description: str
    confidence: float
    vulnerability_class: str
    must_contain: tuple[tuple[str, ...], ...] = ()


# Finding types, severities, texts, confidences and classes.
CALL_SITES = {
    "rust_unsafe_blocks": CallSite(
        "unsafe_block", ("rs",), ("unsafe",), rf"{SLASH_COMMENTS}|{LONG_DOUBLE}|{CHARACTER}",
        rf"(?<![\w])unsafe\s*(?:{_BLOCK}|\{{)",
        "MEDIUM", "Unsafe block allows raw pointer operations", 0.9, "Memory Safety"),
    "rust_unwrap": CallSite(
        "unwrap_usage", ("rs",), ("unwrap()", "expect("),
        rf"{SLASH_COMMENTS}|{LONG_DOUBLE}|{CHARACTER}",
        rf"(?<![\w.])[A-Za-z_][\w:]*+(?:{_LINK}*+\s*+\.(?:unwrap\(\)|expect{_ARGS}))++",
        "LOW", "Use of unwrap() or expect() may cause panics", 0.7, "Error Handling"),
    "js_eval": CallSite(
        "eval_usage", ("js", "ts"), ("eval(",), rf"{SLASH_COMMENTS}|{DOUBLE}|{SINGLE}|{BACKTICK}",
        rf"(?<![\w$.])(?<!function )eval(?:{_ARGS}|\()",
        "HIGH", "Use of eval() can execute arbitrary code", 0.95, "Code Injection"),
    "js_innerhtml_concat": CallSite(
        "xss_innerhtml", ("js", "ts"), ("innerHTML",),
        rf"{SLASH_COMMENTS}|{DOUBLE}|{SINGLE}|{BACKTICK}",
        rf"(?<![\w$.])[A-Za-z_$][\w$.]*+(?:\[[^\[\]\n]*+\][\w$.]*+)*+\s*=(?![=>])"
        rf"(?:[^;\n\"'`]|{DOUBLE}|{SINGLE}|{BACKTICK})*+",
        "HIGH", "Potential XSS via innerHTML with string concatenation", 0.85,
        "Cross-Site Scripting", must_contain=(("innerHTML",), ("+",))),
    "py_dynamic_exec": CallSite(
        "dynamic_execution", ("py",), ("exec(", "eval("),
        rf"#[^\n]*+|{TRIPLE}|{DOUBLE}|{SINGLE}",
        rf"(?<![\w.])(?<!def )(?:exec|eval)(?:{_ARGS}|\()",
        "CRITICAL", "Use of exec() or eval() allows code execution", 0.95, "Code Injection"),
    "go_sql_concat": CallSite(
        "sql_injection", ("go",), ("Query(", "Exec("),
        rf"{SLASH_COMMENTS}|{DOUBLE}|`[^`]*+`|{CHARACTER}",
        rf"(?<![\w.])(?:[A-Za-z_][\w.]*)?(?:Query|Exec){_ARGS}",
        "HIGH", "Potential SQL injection via string concatenation", 0.8, "SQL Injection",
        must_contain=((" + ", " fmt.Sprintf"),)),
}


HIT = ("array<struct<site:int,start:int,line:int,column:int,node:string,"
       "context:string>>")
_compiled: dict[str, object] = {}


def _scanner(site: CallSite):
    """The detector's pattern: a comment or string to step over, or a node."""
    import regex

    if site.type not in _compiled:
        _compiled[site.type] = regex.compile(
            rf"{_DEFINE}(?:{site.skip})|(?P<node>{site.node})", regex.ASCII | regex.DOTALL)
    return _compiled[site.type]


def scan_file(content: str, extension: str | None, sites: Sequence[CallSite]) -> list[dict]:
    """Nodes of the detectors that apply to a file, in one pass each, linear in its length.

    From left to right, a comment or string is stepped over and a node is taken whole (nodes
    inside it are not reported on their own); lines and byte columns are running counts.
    """
    found = []
    for index, site in enumerate(sites):
        if extension not in site.extensions or not any(h in content for h in site.hints):
            continue
        at, line, column = 0, 1, 0  # column: bytes since the last newline before ``at``
        for match in _scanner(site).finditer(content):
            node = match.group("node")
            if node is None:
                continue
            start = match.start()
            passed = content[at:start]
            newline = passed.rfind("\n")
            if newline >= 0:
                line += passed.count("\n")
                column = len(passed[newline + 1:].encode("utf-8"))
            else:
                column += len(passed.encode("utf-8"))
            at = start
            found.append({"site": index, "start": start, "line": line, "column": column + 1,
                          "node": node, "context": content[max(start - CONTEXT, 0):
                                                           start + len(node) + CONTEXT]})
    return found


def _hits(sites: Sequence[CallSite]) -> Callable[[Column, Column], Column]:
    @F.pandas_udf(HIT)
    def hits(content: pd.Series, extension: pd.Series) -> pd.Series:
        return pd.Series([[] if c is None else scan_file(c, e, sites)
                          for c, e in zip(content, extension)])
    return hits


def _applies(site: CallSite) -> Column:
    return (paths.bare_extension(F.col("path")).isin(*site.extensions)
            & tx.contains_any(F.col("content"), site.hints))


def _node_qualifies(site: CallSite, node: Column) -> Column:
    missing = [~tx.contains_any(node, words) for words in site.must_contain]
    return ~tx.any_of([F.lit(False), *missing])


def call_sites(files: DataFrame, site: CallSite) -> DataFrame:
    """Call sites of one detector, from files of its language that contain a hint."""
    hits = _hits([site])
    nodes = files.where(_applies(site)).select(
        *SCAN_KEY, "path", F.explode(hits(F.col("content"), paths.bare_extension(F.col("path"))))
        .alias("hit"))
    nodes = nodes.where(_node_qualifies(site, F.col("hit.node")))
    return _as_finding(
        nodes.withColumn("line", F.col("hit.line")), column=F.col("hit.column"),
        kind=site.type, severity=site.severity, description=site.description,
        confidence=site.confidence, context=F.col("hit.context"),
        vulnerability=site.vulnerability_class)


@dataclass(frozen=True)
class _Report:
    type: str
    severity: str
    description: str
    confidence: float
    vulnerability_class: str


LINE_REPORTS = (
    _Report("tainted_data_flow", "CRITICAL", "User input flows to dangerous function", 0.9,
            "Injection"),
    _Report("weak_crypto", "MEDIUM", "Use of weak cryptographic algorithm", 0.7,
            "Cryptography"),
)


def advanced_findings(files: DataFrame, rules: Sequence[Rule] = PATTERN_RULES) -> DataFrame:
    """All analyses in one read of the source files; findings are not deduplicated.

    A file becomes pieces: its lines (task 0) and the nodes of every detector that applies
    (task 1 and up, one scan of the file each). Pieces of either kind then meet the tests meant
    for them.
    """
    sites = list(CALL_SITES.values())
    task, text = F.col("task"), F.col("text")
    todo = api_source_files(files).select(*SCAN_KEY, "path", "content")
    any_site = tx.any_of([_applies(s) for s in sites])
    hits = _hits(sites)(F.when(any_site, F.col("content")), paths.bare_extension(F.col("path")))
    empty = F.lit(None).cast("string")
    lines = F.transform(F.split("content", "\n"), lambda piece, i: F.struct(
        F.lit(0).alias("task"), (i + 1).alias("line"), F.lit(None).cast("int").alias("column"),
        piece.alias("piece"), empty.alias("context")))
    nodes = F.transform(hits, lambda h: F.struct(
        (h["site"] + 1).alias("task"), h["line"].alias("line"), h["column"].alias("column"),
        h["node"].alias("piece"), h["context"].alias("context")))
    rows = todo.select(*SCAN_KEY, "path", F.explode(F.concat(lines, nodes)).alias("p")).select(
        *SCAN_KEY, "path", "p.task", F.col("p.line").alias("at_line"),
        F.col("p.column").alias("node_column"), F.col("p.context").alias("node_context"),
        F.when(F.col("p.task") == 0, tx.drop_trailing_cr(F.col("p.piece")))
        .otherwise(F.col("p.piece")).alias("text"))
    for i, site in enumerate(sites, 1):
        if site.must_contain:
            rows = rows.where((task != i) | _node_qualifies(site, text))

    on_line = task == 0
    qualified = [(task == i) for i in range(1, len(sites) + 1)]
    found = match_rules(rows, rules, unicode_space=True, gates={"pattern": on_line}, extra=[
        on_line & tx.contains_any(text, DANGEROUS_SINKS) & tx.contains_any(text, USER_INPUTS),
        on_line & tx.contains_any(text, WEAK_CRYPTO_WORDS), *qualified])

    patterns = [_Report(r.type, r.severity, r.description, PATTERN_CONFIDENCE,
                        r.vulnerability_class) for r in rules]
    reports = [*patterns, *LINE_REPORTS, *sites]
    tainted, crypto = len(rules), len(rules) + 1
    rule = F.col("rule")
    column = (F.when(rule < tainted, match_start(rules, unicode_space=True))
              .when(rule == tainted, 0).when(rule == crypto, 1)
              .otherwise(F.col("node_column")))
    confidence = rule_value(reports, "confidence")
    return _as_finding(
        found.withColumn("line", F.col("at_line")), column=column,
        kind=rule_value(reports, "type"), severity=rule_value(reports, "severity"),
        description=rule_value(reports, "description"), confidence=confidence,
        context=F.when(on_line, tx.strip_space(text)).otherwise(F.col("node_context")),
        vulnerability=rule_value(reports, "vulnerability_class"))


def advanced_result(findings: DataFrame) -> DataFrame:
    """Envelope per repository and file: its findings, the scan's total, scan type.

    ``findings`` is read twice: pass a written table.
    """
    totals = findings.groupBy(*SCAN_KEY).agg(F.count("*").alias("total_findings"))
    files = findings.groupBy(*SCAN_KEY, "file").agg(
        F.sort_array(F.collect_list(F.struct(*ADVANCED_FINDING.names))).alias("findings"))
    return files.join(totals, SCAN_KEY).withColumn("scan_type", F.lit("advanced_ast_based"))


def line_count(content: Column) -> Column:
    """Lines as the analyzer counts them: a final newline starts no further line."""
    newlines = F.char_length(content) - F.char_length(F.replace(content, F.lit("\n"), F.lit("")))
    return F.when(content == "", 0).otherwise(
        newlines + F.when(content.endswith("\n"), 0).otherwise(1))


def scan_metrics(files: DataFrame) -> DataFrame:
    return files.groupBy(*SCAN_KEY).agg(
        F.count("*").alias("files_processed"),
        F.sum(line_count(F.col("content"))).alias("total_lines"))


def language_stats(files: DataFrame) -> DataFrame:
    """Number of files per language (by extension)."""
    language = paths.bare_extension(F.col("path"))
    counts = files.groupBy(*SCAN_KEY, language.alias("language")).agg(
        F.count("*").cast("int").alias("n_files"))
    return counts


def language_stats_map(stats: DataFrame) -> DataFrame:
    """The counts as one map per repository; its size is the number of languages."""
    return stats.groupBy(*SCAN_KEY).agg(F.map_from_entries(F.array_sort(F.collect_list(
        F.struct("language", "n_files")))).alias("language_stats"))
