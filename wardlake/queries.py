"""The registered queries: every operator over inputs derived from the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardlake import sinks
from wardlake.functions import paths, text as tx
from wardlake.operators import (advanced, anomalies, code, deps, policy, rego, report, runtime,
                                scoring, secrets, tokens)
from wardlake.operators.findings import scan_findings
from wardlake.operators.matching import match_rules, match_start, rule_value, with_rule_columns
from wardlake.plans import scan as scan_plan
from wardlake.rules import CODE_RULES, PATTERN_RULES, SECRET_RULES, Rule
from wardlake.schemas import SCAN_KEY
from wardlake.session import scratch_dir
from wardlake.sources import derived as d
from wardlake.sources import files as fs
from wardlake.streaming import monitor as stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
AT = ["path", "line", "type"]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def define(name: str, fn: Query) -> None:
    QUERIES[name] = fn


def _tick() -> Column:
    return F.date_format("tick_ts", "yyyy-MM-dd HH:mm:ss").alias("tick")


# --- sources -------------------------------------------------------------------------------

define("scan_files", lambda s, p: d.code_files(s, p).select(
    *SCAN_KEY, "path", F.octet_length("content").cast("bigint").alias("n_bytes")))
define("skip_filter_gate", lambda s, p: fs.gate_files(d.tree_files(s, p)).select("path"))
define("skip_filter_strict", lambda s, p: fs.strict_files(d.tree_files(s, p)).select("path"))
define("source_filter_api", lambda s, p: fs.api_source_files(d.tree_files(s, p)).select("path"))
define("source_filter_repo", lambda s, p: fs.repo_source_files(d.tree_files(s, p)).select("path"))
define("explode_lines", lambda s, p: fs.explode_lines(d.code_files(s, p)).select(
    "path", "line", "text"))
define("dependency_manifests", lambda s, p: fs.manifest_files(d.manifests(s, p)).select(
    "repo_path", F.col("rel_path").alias("manifest"), "content"))
define("net_snapshots", lambda s, p: d.net_snapshots(s, p).select("host", _tick(), "seq", "line"))
define("process_snapshots", lambda s, p: runtime.process_lines(d.process_snapshots(s, p)).select(
    "host", _tick(), "seq", "line"))
define("file_mtime_snapshots", lambda s, p: d.file_mtimes(s, p).select(
    "host", _tick(), "path",
    (F.unix_micros("tick_ts") - F.unix_micros("mtime")).alias("age_micros")))
define("relative_path", lambda s, p: fs.with_rel_path(d.tree_files(s, p)).select(
    "path", "rel_path"))


# --- secrets -------------------------------------------------------------------------------

def gate_candidates(s: SparkSession, p: str) -> DataFrame:
    return secrets.secret_candidates(fs.explode_lines(fs.gate_files(d.code_files(s, p))))


def strict_candidates(s: SparkSession, p: str) -> DataFrame:
    lines = fs.explode_lines(fs.strict_files(d.code_files(s, p)), True)
    return secrets.secret_candidates(lines, unicode_space=True)


def gate_kept(s: SparkSession, p: str) -> DataFrame:
    return gate_candidates(s, p).where(~secrets.gate_false_positive())


def strict_kept(s: SparkSession, p: str) -> DataFrame:
    return strict_candidates(s, p).where(~secrets.strict_false_positive())


define("secret_candidates", lambda s, p: gate_candidates(s, p).select(
    *AT, F.sha2("match", 256).alias("hash"), F.octet_length("match").alias("n_bytes")))
for _name in ("fp_comment", "fp_password", "fp_test_path", "fp_docs", "fp_placeholder",
              "likely_fp"):
    define(_name, lambda s, p, f=_name: gate_candidates(s, p).select(
        *AT, getattr(secrets, f)().alias("dropped")))
define("fp_strict", lambda s, p: strict_candidates(s, p).select(
    *AT, secrets.fp_strict().alias("dropped")))
define("shannon_entropy", lambda s, p: gate_candidates(s, p).select(
    *AT, F.round(tx.shannon_entropy(F.col("match")), 9).alias("entropy")))
define("confidence_gate", lambda s, p: secrets.with_confidence(gate_kept(s, p)).select(
    *AT, "confidence"))
define("confidence_strict", lambda s, p: secrets.with_confidence(
    strict_kept(s, p), strict=True).select(*AT, "confidence"))
define("severity_secret_gate", lambda s, p: gate_candidates(s, p).select(
    *AT, rule_value(SECRET_RULES, "severity").alias("severity")))
define("severity_secret_strict", lambda s, p: strict_candidates(s, p).select(
    *AT, rule_value(SECRET_RULES, "strict_severity").alias("severity")))
define("mask_gate", lambda s, p: gate_candidates(s, p).select(
    *AT, tx.mask_gate(F.col("match")).alias("masked")))
define("mask_strict", lambda s, p: strict_candidates(s, p).select(
    *AT, tx.mask_strict(F.col("match")).alias("masked")))
define("match_hash", lambda s, p: gate_candidates(s, p).select(
    *AT, tx.match_hash(F.col("match")).alias("hash")))

SECRET_OUT = ["repo_path", "file", "line", "type", "severity", "match", "match_hash",
              "confidence"]


def _gate_findings(s: SparkSession, p: str) -> DataFrame:
    return secrets.as_findings(gate_kept(s, p), SECRET_RULES)


def _strict_findings(s: SparkSession, p: str) -> DataFrame:
    return secrets.as_findings(strict_kept(s, p), SECRET_RULES, strict=True)


define("dedup_secrets_gate", lambda s, p: secrets.dedup_gate(_gate_findings(s, p)).select(
    "repo_path", "file", "line", "type", "match_hash"))
define("dedup_secrets_strict", lambda s, p: secrets.dedup_strict(_strict_findings(s, p)).select(
    "repo_path", "file", "line", "type", "match_hash"))
define("secrets_gate", lambda s, p: secrets.secrets_gate(d.code_files(s, p)).select(*SECRET_OUT))
define("secrets_strict", lambda s, p: secrets.secrets_strict(d.code_files(s, p)).select(
    *SECRET_OUT))

USER_RULES = (Rule(0, "secret", "USER_TOKEN", r'token\s*=\s*"[0-9a-f]{40}"'),)


@query
def user_rule(s: SparkSession, p: str) -> DataFrame:
    """A user's rule over the unmodified documents."""
    docs = d.table(s, p, "documents").select(
        F.lit("").alias("repo_path"), F.lit("").alias("branch"), F.lit("").alias("commit_hash"),
        F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    found = secrets.secret_candidates(fs.explode_lines(docs), USER_RULES)
    return found.select(F.col("path").cast("bigint").alias("doc_id"), "line", "type",
                        tx.match_hash(F.col("match")).alias("hash"))


# --- code issues ---------------------------------------------------------------------------

def code_candidates(s: SparkSession, p: str) -> DataFrame:
    return code.code_issue_candidates(fs.explode_lines(fs.gate_files(d.code_files(s, p))))


define("code_issue_candidates", lambda s, p: code_candidates(s, p).select(*AT))
for _name in ("legit_comment", "legit_eval", "legit_shell_monitor", "legit_shell_static",
              "legit_sql_bound", "legit_ip"):
    define(_name, lambda s, p, f=_name: code_candidates(s, p).select(
        *AT, getattr(code, f)().alias("dropped")))
define("code_severity", lambda s, p: code_candidates(s, p).select(
    *AT, rule_value(CODE_RULES, "severity").alias("severity")))
define("code_description", lambda s, p: code_candidates(s, p).select(
    *AT, rule_value(CODE_RULES, "description").alias("description")))
define("code_issues", lambda s, p: code.code_issues(d.code_files(s, p)).select(
    "repo_path", "file", "line", "type", "severity", "description"))


# --- advanced ------------------------------------------------------------------------------

def _adv_lines(s: SparkSession, p: str) -> DataFrame:
    return advanced.analyzed_lines(fs.api_source_files(d.code_files(s, p)))


def _adv_hits(s: SparkSession, p: str) -> DataFrame:
    return with_rule_columns(match_rules(_adv_lines(s, p), PATTERN_RULES, unicode_space=True),
                             PATTERN_RULES)


ADV_OUT = ["repo_path", "file", "line", "column", "finding_type", "severity", "description",
           "confidence", "code_context", "vulnerability_class"]
define("adv_patterns", lambda s, p: advanced.adv_patterns(_adv_lines(s, p)).select(*ADV_OUT))
define("match_column", lambda s, p: _adv_hits(s, p).select(
    *AT, match_start(PATTERN_RULES, unicode_space=True).alias("column")))
for _name, _field in (("adv_severity", "severity"), ("adv_description", "description"),
                      ("vulnerability_class", "vulnerability_class")):
    define(_name, lambda s, p, f=_field: _adv_hits(s, p).select(
        *AT, rule_value(PATTERN_RULES, f).alias(f)))
define("tainted_flow", lambda s, p: advanced.tainted_flow(_adv_lines(s, p)).select(*ADV_OUT))
define("weak_crypto", lambda s, p: advanced.weak_crypto(_adv_lines(s, p)).select(*ADV_OUT))
define("source_tokens", lambda s, p: tokens.source_tokens(d.code_files(s, p)).select(
    "path", "token", "line", "column"))
for _name in advanced.CALL_SITES:
    define(_name, lambda s, p, k=_name: advanced.call_sites(
        fs.api_source_files(d.code_files(s, p)), advanced.CALL_SITES[k]).select(*ADV_OUT))


def _all_advanced(s: SparkSession, p: str) -> DataFrame:
    return advanced.advanced_findings(d.code_files(s, p))


define("code_context", lambda s, p: _all_advanced(s, p).select(
    "file", "line", "finding_type", "code_context"))
define("analyze_dispatch", lambda s, p: d.code_files(s, p).select(
    "path", paths.bare_extension(F.col("path")).alias("language"),
    paths.is_api_source(F.col("path")).alias("analyzed"),
    F.array_contains(F.array(*(F.lit(e) for e in tokens.LEXED_EXTENSIONS)),
                     paths.bare_extension(F.col("path"))).alias("lexed")))
define("advanced_findings", lambda s, p: _all_advanced(s, p).select(*ADV_OUT))
define("advanced_result", lambda s, p: advanced.advanced_result(
        scan_plan.stored_table(_all_advanced(s, p))).select(
    "repo_path", "file", "total_findings", "scan_type",
    F.array_join(F.array_sort(F.transform("findings", lambda f: F.concat_ws(
        ":", f["finding_type"], f["file"], f["line"], f["column"]))), " ").alias("listing")))
define("scan_metrics", lambda s, p: advanced.scan_metrics(
    fs.repo_source_files(d.code_files(s, p))).select(
        "repo_path", "files_processed", "total_lines"))
define("language_stats", lambda s, p: advanced.language_stats(d.code_files(s, p)).select(
    "repo_path", "language", "n_files"))


# --- joins ---------------------------------------------------------------------------------

@query
def rule_theta_join(s: SparkSession, p: str) -> DataFrame:
    rules = [*SECRET_RULES, *CODE_RULES]
    lines = fs.explode_lines(fs.gate_files(d.code_files(s, p)))
    return with_rule_columns(match_rules(lines, rules), rules).select(*AT)


@query
def rule_attribute_lookup(s: SparkSession, p: str) -> DataFrame:
    return code_candidates(s, p).select(
        *AT, rule_value(CODE_RULES, "severity").alias("severity"),
        rule_value(CODE_RULES, "description").alias("description"))


CVE_OUT = ["repo_path", "manifest", "package", "severity", "cve", "description", "cvss"]
define("advisory_theta_join", lambda s, p: deps.cve_findings(d.manifests(s, p)).select(
    "repo_path", "manifest", "cve"))
define("cve_findings", lambda s, p: deps.cve_findings(d.manifests(s, p)).select(*CVE_OUT))


@query
def incremental_scan(s: SparkSession, p: str) -> DataFrame:
    """Requests left to do when the production branches already have results."""
    requests = d.requests(s, p).select(*SCAN_KEY)
    stored = requests.where(F.col("branch").isin("main", "master"))
    return scan_plan.incremental_scan(requests, stored).select(
        "repo_path", "branch", "scan_hash")


# --- score, anomalies, policy --------------------------------------------------------------

def _found(s: SparkSession, p: str) -> DataFrame:
    """Findings of all repositories, written once because statistics and score both read them."""
    return scan_plan.stored_table(scan_findings(d.scan_files(s, p)))


def _scored(s: SparkSession, p: str) -> DataFrame:
    return scoring.scored_scans(d.requests(s, p), _found(s, p))


def _verdicts(s: SparkSession, p: str) -> DataFrame:
    return policy.with_verdict(_scored(s, p))


def _joined(result: DataFrame) -> DataFrame:
    return result.select("repo_path", "file", "passed",
                         F.array_join("violations", " | ").alias("violations"),
                         F.array_join("warnings", " | ").alias("warnings"))


define("risk_score", lambda s, p: _scored(s, p).select("repo_path", "risk_score"))
define("risk_level", lambda s, p: _scored(s, p).select("repo_path", "risk_level"))
define("risk_score_only", lambda s, p: scoring.risk_score(
    d.requests(s, p), _found(s, p)).select("repo_path", "risk_score", "risk_level"))
for _name, _fn in (("anomaly_filetype", anomalies.filetype_warning),
                   ("anomaly_all_high_conf", anomalies.all_high_warning),
                   ("anomaly_majority_critical", anomalies.majority_warning)):
    define(_name, lambda s, p, f=_fn: _scored(s, p).select(
        "repo_path", f().alias("warning")).where("warning is not null"))
define("scan_anomalies", lambda s, p: anomalies.scan_anomalies(_scored(s, p)).select(
    "repo_path", "pos", "warning"))
define("scan_counts", lambda s, p: _scored(s, p).select(
    "repo_path", "n_secrets", "n_cves", "n_code_issues"))
define("scan_summary", lambda s, p: report.scan_report(
    d.requests(s, p), _found(s, p)).select("repo_path", "summary"))


def scan_results(s: SparkSession, p: str) -> DataFrame:
    return scan_plan.scan(d.requests(s, p), d.scan_files(s, p))


@query
def scan_result(s: SparkSession, p: str) -> DataFrame:
    """The flagship: the nested result, its arrays rendered as text for comparison."""
    r = scan_results(s, p)
    return r.select(
        "repo_path", "branch", "commit_hash", "file", "risk_score", "risk_level", "passed",
        F.array_join(F.transform("secrets", lambda x: F.concat_ws(
            ":", x["file"], x["line"], x["type"], x["severity"], x["match"])), " ")
        .alias("secrets"),
        F.array_join(F.transform("cves", lambda x: F.concat_ws(
            ":", x["cve"], x["package"], x["severity"])), " ").alias("cves"),
        F.array_join(F.transform("code_issues", lambda x: F.concat_ws(
            ":", x["file"], x["line"], x["type"], x["severity"])), " ").alias("code_issues"),
        F.array_join("policy_result.violations", " | ").alias("violations"),
        F.array_join("policy_result.warnings", " | ").alias("warnings"), "summary")


define("scan_result_json", lambda s, p: scan_results(s, p).select(
    "repo_path", "file", sinks.scan_result_json().alias("document")))


@query
def scan_results_json(s: SparkSession, p: str) -> DataFrame:
    """Documents written and read back with the declared schema."""
    docs = scan_results(s, p).select(sinks.scan_result_json().alias("document"))
    return fs.parse_scan_results(docs).groupBy("repo_path", "risk_score", "passed").agg(
        F.sum(F.size("secrets")).alias("n_secrets"), F.sum(F.size("cves")).alias("n_cves"),
        F.sum(F.size("code_issues")).alias("n_code_issues"))


@query
def secrets_report_json(s: SparkSession, p: str) -> DataFrame:
    return sinks.secrets_report(secrets.secrets_strict(d.code_files(s, p))).select(
        "repo_path", "file", "report")


define("deploy_env", lambda s, p: d.requests(s, p).select(
    "repo_path", policy.deploy_env(F.col("branch"), F.col("deploy_env")).alias("env")))
define("env_threshold", lambda s, p: policy.with_verdict(d.requests(s, p).select(
    *SCAN_KEY, "deploy_env", F.lit(0).alias("risk_score"), F.lit(0).alias("n_critical_secrets"),
    F.lit(0).alias("n_critical_cves"))).select("repo_path", "env", "threshold"))
define("policy_risk", lambda s, p: policy.risk_messages(_verdicts(s, p)).select(
    "repo_path", "message"))
define("policy_critical_secret", lambda s, p: policy.secret_messages(
    scan_findings(d.scan_files(s, p))).select("repo_path", "message"))
define("policy_cve", lambda s, p: policy.cve_messages(
    scan_findings(d.scan_files(s, p))).select("repo_path", "kind", "message"))
define("policy_code", lambda s, p: policy.code_messages(_verdicts(s, p)).select(
    "repo_path", "message"))
def _policy(s: SparkSession, p: str) -> DataFrame:
    return report.policy_result(d.requests(s, p), _found(s, p))


define("policy_result", lambda s, p: _joined(_policy(s, p)))


@query
def validate_policy(s: SparkSession, p: str) -> DataFrame:
    """Results stored as JSON documents, read back and judged again."""
    path = scratch_dir(s) + "/results"
    sinks.write_scan_results(scan_results(s, p), path)
    return _joined(report.validate_policy(fs.read_scan_results(s, path)))


define("rego_allow", lambda s, p: _scored(s, p).select("repo_path", rego.allow().alias("allow")))
define("rego_deny_pattern", lambda s, p: _scored(s, p).select(
    "repo_path", F.explode(F.array_compact(F.array(*rego.deny_patterns()))).alias("message")))
define("rego_deny_dependency_scan", lambda s, p: d.requests(s, p).select(
    "repo_path", rego.deny_dependency_scan().alias("message")).where("message is not null"))
define("rego_deny_hours", lambda s, p: d.requests(s, p).select(
    "repo_path", rego.deny_hours(F.lit(False)).alias("message")).where("message is not null"))
define("rego_max_risk", lambda s, p: d.requests(s, p).select(
    "repo_path", "environment", rego.max_risk().alias("max_risk")))
define("env_threshold_join", lambda s, p: rego.env_threshold_join(
    d.requests(s, p), rego.env_thresholds(s)).select("repo_path", "environment", "max_risk"))
define("rego_required_scanners", lambda s, p: d.requests(s, p).select(
    "repo_path", F.explode(F.array_compact(F.array(*rego.deny_scanners()))).alias("message")))


@query
def policy_merge(s: SparkSession, p: str) -> DataFrame:
    denied = _scored(s, p).withColumn("denials", rego.denials())
    return _joined(rego.policy_merge(_policy(s, p), denied))


# --- runtime -------------------------------------------------------------------------------

ANOMALY_OUT = ["anomaly_type", "severity", "description", "details", "action"]


def _anomalies(rows: DataFrame) -> DataFrame:
    return rows.select("host", _tick(), *ANOMALY_OUT)


def _new(s: SparkSession, p: str) -> DataFrame:
    return runtime.new_ports(d.net_snapshots(s, p))


def _runtime(s: SparkSession, p: str) -> DataFrame:
    return runtime.runtime_anomalies(d.net_snapshots(s, p), d.process_snapshots(s, p),
                                     d.file_mtimes(s, p))


def _decisions(s: SparkSession, p: str) -> DataFrame:
    return runtime.rollback_decision(_runtime(s, p))


define("listening_ports", lambda s, p: runtime.listening_ports(d.net_snapshots(s, p)).select(
    "host", _tick(), "port", F.col("first_seen.seq").alias("first_seq")))
define("port_baseline", lambda s, p: runtime.port_baseline(d.net_snapshots(s, p)))
define("process_baseline", lambda s, p: runtime.process_baseline(d.process_snapshots(s, p)))
define("new_ports", lambda s, p: _new(s, p).select("host", _tick(), "port"))
define("suspicious_ports", lambda s, p: runtime.suspicious_ports(_new(s, p)).select(
    "host", _tick(), "port"))
define("reverse_shell", lambda s, p: _anomalies(runtime.reverse_shell(d.net_snapshots(s, p))))
define("suspicious_port", lambda s, p: _anomalies(runtime.suspicious_port(_new(s, p))))
define("port_scan", lambda s, p: _anomalies(runtime.port_scan(_new(s, p))))
define("suspicious_process", lambda s, p: _anomalies(
    runtime.suspicious_process(d.process_snapshots(s, p))))
define("critical_file_modified", lambda s, p: _anomalies(
    runtime.critical_file_modified(d.file_mtimes(s, p))))
define("runtime_anomalies", lambda s, p: _anomalies(_runtime(s, p)))
define("rollback_decision", lambda s, p: _decisions(s, p).select(
    "host", _tick(), "n_anomalies", "n_critical", "rollback"))
define("rollback_requests", lambda s, p: runtime.rollback_requests(_decisions(s, p)).select(
    "host", _tick(), "reason",
    F.array_join(F.transform("anomalies", lambda a: a["anomaly_type"]), " ").alias("kinds")))
define("rollback_dispatch_payload", lambda s, p: runtime.rollback_requests(_decisions(s, p))
       .select("host", _tick(), runtime.dispatch_payload().alias("payload")))
define("webhook_payload", lambda s, p: runtime.rollback_requests(_decisions(s, p)).select(
    "host", _tick(), runtime.webhook_payload().alias("payload")))


@query
def rollback_log(s: SparkSession, p: str) -> DataFrame:
    """Requests appended to the log and read back."""
    path = scratch_dir(s) + "/rollbacks"
    sinks.write_rollback_log(runtime.rollback_requests(_decisions(s, p)), path)
    return s.read.text(path).select(
        F.get_json_object("value", "$.reason").alias("reason"),
        F.get_json_object("value", "$.timestamp").alias("timestamp"))


# --- streams -------------------------------------------------------------------------------

def _event_stream(s: SparkSession, p: str, line: str) -> DataFrame:
    """Snapshot lines straight from a stream over the events table."""
    schema = d.table(s, p, "events").schema
    events = (s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(p))
    return d.event_ticks(events).selectExpr("host", "tick_ts", "seq", f"{line} as line")


def _run(stream_df: DataFrame, schema: str) -> DataFrame:
    """Runs a stream over what is there and reads its log."""
    s, base = stream_df.sparkSession, scratch_dir(stream_df.sparkSession)
    stream.append_log(stream_df, base + "/log", base + "/checkpoint").start().awaitTermination()
    return s.read.schema(schema).json(base + "/log")


LINE_SCHEMA = "host string, tick_ts timestamp, seq int, anomaly_type string, line string"
define("stream_reverse_shell", lambda s, p: _run(
    stream.stream_reverse_shell(_event_stream(s, p, d.NET_LINE)), LINE_SCHEMA)
    .select("host", _tick(), "seq", "line"))
define("stream_suspicious_process", lambda s, p: _run(
    stream.stream_suspicious_process(_event_stream(s, p, d.PROCESS_LINE)), LINE_SCHEMA)
    .select("host", _tick(), "seq", "line"))
LATENESS = "0 seconds"  # the tables arrive whole


@query
def stream_port_anomalies(s: SparkSession, p: str) -> DataFrame:
    """Every tick's anomalies; the input's end closes the last ticks."""
    lines, path = d.net_snapshots(s, p), scratch_dir(s) + "/ends"
    stream.end_rows(lines, LATENESS).write.parquet(path)
    ends = stream.read_snapshots(s, path, lines.schema)
    net = _event_stream(s, p, d.NET_LINE).unionByName(ends)
    return _anomalies(_run(stream.stream_port_anomalies(net, LATENESS), stream.ANOMALY_SCHEMA))


@query
def stream_rollback(s: SparkSession, p: str) -> DataFrame:
    """Decisions over a log of anomalies, read as a stream."""
    base = scratch_dir(s)
    rows = _runtime(s, p).select("host", "tick_ts", *ANOMALY_OUT)
    sinks.write_table(rows, base + "/anomalies")
    sinks.write_table(stream.end_rows(s.read.schema(rows.schema).parquet(base + "/anomalies"),
                                      LATENESS), base + "/anomalies")
    anomalies_in = stream.read_snapshots(s, base + "/anomalies", rows.schema)
    return _run(stream.stream_rollback(anomalies_in, LATENESS), stream.DECISION_SCHEMA).select(
        "host", _tick(), "n_anomalies", "n_critical", "rollback")


# --- documented outputs --------------------------------------------------------------------

define("gate_exit_code", lambda s, p: _verdicts(s, p).select(
    "repo_path", report.gate_exit_code().alias("exit_code")))
define("markdown_report", lambda s, p: report.markdown_report(scan_results(s, p)).select(
    "repo_path", "file", "markdown"))


@query
def last_stable_commit(s: SparkSession, p: str) -> DataFrame:
    """Passing scans and rollbacks per host, taken from the events of a host."""
    ev = d.event_ticks(d.table(s, p, "events"))
    scans = ev.where("event_type <> 'error'").selectExpr(
        "host as repo_path", "tick_ts as scan_ts", "seq", "value >= 60 as passed")
    scans = scans.groupBy("repo_path", "scan_ts").agg(
        F.md5(F.min("seq").cast("string")).alias("commit_hash"),
        F.min_by("passed", "seq").alias("passed"))
    rollbacks = ev.where("event_type = 'error'").select(
        F.col("host").alias("repo_path"), F.col("tick_ts").alias("rollback_ts")).distinct()
    found = runtime.last_stable_commit(scans, rollbacks)
    return found.select("repo_path", F.date_format("rollback_ts", "yyyy-MM-dd HH:mm:ss")
                        .alias("tick"), "stable_commit")
