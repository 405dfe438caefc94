"""One SQL text per registered query that DuckDB can answer."""

from __future__ import annotations

from oracles.sql import (BAD_PORTS, BARE_EXT, CVE_TAIL, DIRS, DOT_EXT, FP,
                         LEGIT, LIKELY, MASK_GATE, MASK_STRICT, RISK_MSG, SECRET_MSG, SITES, SKIP_GATE,
                         SKIP_GATE_EXT, STRICT_DIRS, STRICT_EXTS, UNNEST_LINES, build)

TICK = "strftime(tick, '%Y-%m-%d %H:%M:%S') AS tick"
AN = f"host, {TICK}, anomaly_type, severity, description, details, action"
SEC = ("repo_path, rel_path AS file, line, type, {sev} AS severity, masked AS match, hash AS match_hash, "
       "confidence")
ORACLES: dict[str, str] = {}


def add(name: str, body: str, *needs: str) -> None:
    ORACLES[name] = build(body, *needs)


add("scan_files", "SELECT repo_path, branch, commit_hash, path, strlen(content)::BIGINT AS n_bytes FROM files", "files")
add("skip_filter_gate", f"SELECT path FROM tree WHERE NOT ({SKIP_GATE} OR {SKIP_GATE_EXT})", "tree")
add("skip_filter_strict", f"SELECT path FROM tree WHERE NOT (list_has_any({DIRS}, {STRICT_DIRS}) OR {BARE_EXT.format('rel_path')} IN {STRICT_EXTS})", "tree")
add("source_filter_api", f"SELECT path FROM tree WHERE {DOT_EXT.format('path')} IN ('.rs','.go','.py','.js','.ts','.java','.cpp','.c','.h')", "tree")
add("source_filter_repo", f"SELECT path FROM tree WHERE {BARE_EXT.format('rel_path')} IN ('rs','js','ts','py','go','java') AND NOT list_has_any({DIRS}, ['.git','node_modules','target','__pycache__','.cargo'])", "tree")
add("explode_lines", "SELECT path, line, text FROM (" + UNNEST_LINES.format(key="repo_path", src="files") + ")", "files")
add("dependency_manifests", "SELECT repo_path, rel_path AS manifest, content FROM manifests WHERE rel_path IN ('package.json','requirements.txt','go.mod','Gemfile','pom.xml')", "manifests")
add("net_snapshots", f"SELECT host, {TICK}, seq, line FROM net", "net")
add("process_snapshots", f"SELECT host, {TICK}, seq, line FROM proc_lines", "proc_lines")
add("file_mtime_snapshots", f"SELECT host, {TICK}, path, (epoch_us(tick) - epoch_us(mtime))::BIGINT AS age_micros FROM mtimes", "mtimes")
add("relative_path", "SELECT path, rel_path FROM tree", "tree")

add("secret_candidates", "SELECT path, line, type, sha256(match) AS hash, strlen(match)::INTEGER AS n_bytes FROM gate_cand", "gate_cand")
for _n, _c in FP.items():
    add(_n, f"SELECT path, line, type, {_c} AS dropped FROM gate_cand", "gate_cand")
add("likely_fp", f"SELECT path, line, type, {LIKELY} AS dropped FROM gate_cand", "gate_cand")
add("fp_strict", f"SELECT path, line, type, {LIKELY} AS dropped FROM strict_cand", "strict_cand")
add("shannon_entropy", "SELECT path, line, type, round(entropy, 9) AS entropy FROM gate_cand", "gate_cand")
add("confidence_gate", "SELECT path, line, type, confidence FROM gate_kept", "gate_kept")
add("confidence_strict", "SELECT path, line, type, confidence FROM strict_kept", "strict_kept")
add("severity_secret_gate", "SELECT path, line, type, severity FROM gate_cand", "gate_cand")
add("severity_secret_strict", "SELECT path, line, type, strict_severity AS severity FROM strict_cand", "strict_cand")
add("mask_gate", f"SELECT path, line, type, {MASK_GATE} AS masked FROM gate_cand", "gate_cand")
add("mask_strict", f"SELECT path, line, type, {MASK_STRICT} AS masked FROM strict_cand", "strict_cand")
add("match_hash", "SELECT path, line, type, sha256(match) AS hash FROM gate_cand", "gate_cand")
add("dedup_secrets_gate", "SELECT repo_path, rel_path AS file, line, type, hash AS match_hash FROM secrets_gate", "secrets_gate")
add("dedup_secrets_strict", "SELECT repo_path, rel_path AS file, line, type, hash AS match_hash FROM secrets_strict", "secrets_strict")
add("secrets_gate", f"SELECT {SEC.format(sev='severity')} FROM secrets_gate", "secrets_gate")
add("secrets_strict", f"SELECT {SEC.format(sev='strict_severity')} FROM secrets_strict", "secrets_strict")
ORACLES["user_rule"] = r"""
SELECT doc_id, line, 'USER_TOKEN' AS type, sha256(regexp_extract(text, 'token\s*=\s*"[0-9a-f]{40}"', 0)) AS hash FROM (
  SELECT doc_id, unnest(range(1, len(parts) + 1))::INTEGER AS line, unnest(parts) AS text FROM (
    SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents))
WHERE regexp_matches(text, 'token\s*=\s*"[0-9a-f]{40}"')"""

add("code_issue_candidates", "SELECT path, line, type FROM code_cand", "code_cand")
for _n, _c in LEGIT.items():
    add(_n, f"SELECT path, line, type, {_c} AS dropped FROM code_cand", "code_cand")
add("code_severity", "SELECT path, line, type, severity FROM code_cand", "code_cand")
add("code_description", "SELECT path, line, type, description FROM code_cand", "code_cand")
add("rule_attribute_lookup", "SELECT path, line, type, severity, description FROM code_cand", "code_cand")
add("code_issues", "SELECT repo_path, rel_path AS file, line, type, severity, description FROM issues", "issues")

add("adv_patterns", "SELECT * FROM adv_patterns", "adv_patterns")
add("match_column", "SELECT path, line, type, col::INTEGER AS \"column\" FROM adv_hits", "adv_hits")
add("adv_severity", "SELECT path, line, type, severity FROM adv_hits", "adv_hits")
add("adv_description", "SELECT path, line, type, description FROM adv_hits", "adv_hits")
add("vulnerability_class", "SELECT path, line, type, vulnerability_class FROM adv_hits", "adv_hits")
add("tainted_flow", "SELECT * FROM tainted", "tainted")
add("weak_crypto", "SELECT * FROM crypto", "crypto")
add("source_tokens", r"""SELECT path, token, (nl + 1)::INTEGER AS line, (off - line_start + 1)::INTEGER AS "column" FROM tokens WHERE NOT regexp_matches(token, '^\s+$')""", "tokens")
for _n in SITES:
    add(_n, f"SELECT * FROM {_n}_x", f"{_n}_x")
add("code_context", "SELECT file, line, finding_type, code_context FROM advanced", "advanced")
add("analyze_dispatch", f"SELECT path, {BARE_EXT.format('path')} AS language, {DOT_EXT.format('path')} IN ('.rs','.go','.py','.js','.ts','.java','.cpp','.c','.h') AS analyzed, "
    f"{BARE_EXT.format('path')} IN ('rs','js','ts','py','go') AS lexed FROM files", "files")
add("advanced_findings", "SELECT * FROM advanced", "advanced")
add("advanced_result", """SELECT repo_path, file, sum(count(*)) OVER (PARTITION BY repo_path)::BIGINT AS total_findings, 'advanced_ast_based' AS scan_type,
  string_agg(e, ' ' ORDER BY e) AS listing FROM (SELECT repo_path, file, concat_ws(':', finding_type, file, line, "column") AS e FROM advanced) GROUP BY repo_path, file""", "advanced")
add("scan_metrics", rf"""SELECT repo_path, count(*) AS files_processed, sum(len(string_split(content, chr(10))) - CASE WHEN ends_with(content, chr(10)) THEN 1 ELSE 0 END)::BIGINT AS total_lines
  FROM files WHERE {BARE_EXT.format('rel_path')} IN ('rs','js','ts','py','go','java') AND NOT list_has_any({DIRS}, ['.git','node_modules','target','__pycache__','.cargo']) GROUP BY repo_path""", "files")
add("language_stats", f"SELECT repo_path, {BARE_EXT.format('path')} AS language, count(*)::INTEGER AS n_files FROM files GROUP BY ALL", "files")

add("rule_theta_join", "SELECT path, line, type FROM gate_cand0 UNION ALL SELECT path, line, type FROM code_cand", "gate_cand0", "code_cand")
add("advisory_theta_join", "SELECT repo_path, manifest, cve FROM cves", "cves")
add("cve_findings", "SELECT repo_path, manifest, package, severity, cve, description, cvss FROM cves", "cves")
add("incremental_scan", "SELECT repo_path, branch, sha256(repo_path || branch || commit_hash) AS scan_hash FROM requests WHERE branch NOT IN ('main', 'master')", "requests")

add("risk_score", "SELECT repo_path, risk_score FROM scored", "scored")
add("risk_level", "SELECT repo_path, risk_level FROM scored", "scored")
add("risk_score_only", "SELECT repo_path, risk_score, risk_level FROM scored", "scored")
for _i, _n in enumerate(("anomaly_filetype", "anomaly_all_high_conf", "anomaly_majority_critical")):
    add(_n, f"SELECT repo_path, warning FROM anomalies WHERE pos = {_i}", "anomalies")
add("scan_anomalies", "SELECT repo_path, (row_number() OVER (PARTITION BY repo_path ORDER BY pos) - 1)::INTEGER AS pos, warning FROM anomalies", "anomalies")
add("scan_counts", "SELECT repo_path, n_secrets, n_cves, n_code_issues FROM scored", "scored")
SUMMARY = ("'Scan completed: ' || n_secrets || ' secrets, ' || n_cves || ' CVEs, ' || n_code_issues || ' code issues. Risk level: ' || risk_level || "
           "' (' || risk_score || '/100). Deployment ' || CASE WHEN passed THEN 'APPROVED' ELSE 'BLOCKED' END || '.'")
add("scan_summary", f"SELECT repo_path, {SUMMARY} AS summary FROM verdicts", "verdicts")
add("scan_result", f"""
SELECT v.repo_path, v.branch, v.commit_hash, nullif(p.file, '') AS file, v.risk_score, v.risk_level, v.passed,
  coalesce(s.e, '') AS secrets, coalesce(c.e, '') AS cves, coalesce(i.e, '') AS code_issues, p.violations,
  concat_ws(' | ', nullif(p.warnings, ''), CASE WHEN p.file = '' THEN a.e END) AS warnings,
  {SUMMARY.replace('passed', 'v.passed')} AS summary
FROM verdicts v JOIN said p USING (repo_path)
LEFT JOIN (SELECT repo_path, rel_path AS file, string_agg(concat_ws(':', rel_path, line, type, severity, masked), ' ' ORDER BY line, ordinal) AS e FROM secrets_gate GROUP BY ALL) s ON s.repo_path = p.repo_path AND s.file = p.file
LEFT JOIN (SELECT repo_path, manifest AS file, string_agg(concat_ws(':', cve, package, severity), ' ' ORDER BY ordinal) AS e FROM cves GROUP BY ALL) c ON c.repo_path = p.repo_path AND c.file = p.file
LEFT JOIN (SELECT repo_path, rel_path AS file, string_agg(concat_ws(':', rel_path, line, type, severity), ' ' ORDER BY line, ordinal) AS e FROM issues GROUP BY ALL) i ON i.repo_path = p.repo_path AND i.file = p.file
LEFT JOIN (SELECT repo_path, string_agg(warning, ' | ' ORDER BY pos) AS e FROM anomalies GROUP BY ALL) a ON a.repo_path = p.repo_path""", "verdicts", "said", "secrets_gate", "cves", "issues", "anomalies")
add("scan_results_json", "SELECT repo_path, risk_score, passed, n_secrets::BIGINT AS n_secrets, n_cves::BIGINT AS n_cves, n_code_issues::BIGINT AS n_code_issues FROM verdicts", "verdicts")
add("deploy_env", "SELECT repo_path, CASE WHEN contains(branch, 'main') OR contains(branch, 'master') THEN 'prod' WHEN contains(branch, 'staging') THEN 'staging' ELSE 'dev' END AS env FROM requests", "requests")
add("env_threshold", "SELECT repo_path, env, threshold FROM verdicts", "verdicts")
add("policy_risk", f"SELECT repo_path, {RISK_MSG} AS message FROM verdicts WHERE risk_score >= threshold", "verdicts")
add("policy_critical_secret", f"SELECT repo_path, {SECRET_MSG} AS message FROM secrets_gate WHERE severity = 'CRITICAL'", "secrets_gate")
add("policy_cve", f"SELECT repo_path, CASE WHEN cvss >= 9 THEN 'violation' ELSE 'warning' END AS kind, CASE WHEN cvss >= 9 THEN 'Critical CVE detected: ' ELSE 'High severity CVE: ' END || {CVE_TAIL} AS message FROM cves WHERE cvss >= 7", "cves")
add("policy_code", "SELECT repo_path, n_critical_code || ' critical code patterns detected' AS message FROM verdicts WHERE n_critical_code >= 3", "verdicts")
add("policy_result", "SELECT * FROM policy", "policy")
add("validate_policy", "SELECT * FROM policy", "policy")
add("rego_allow", """SELECT repo_path, coalesce(risk_score < 70 AND n_critical_secrets = 0 AND n_critical_cves = 0, false)
  OR coalesce(risk_score >= 30 AND risk_score < 70 AND n_critical_secrets = 0 AND approved_by <> '', false) AS allow FROM scored""", "scored")
add("rego_deny_pattern", "SELECT repo_path, message FROM denials WHERE n < 3", "denials")
add("rego_deny_dependency_scan", "SELECT repo_path, message FROM denials WHERE n = 3", "denials")
add("rego_deny_hours", "SELECT repo_path, 'Production deployments outside business hours require emergency approval' AS message FROM requests WHERE branch = 'main' AND NOT emergency_approved", "requests")
add("rego_max_risk", "SELECT repo_path, environment, CASE environment WHEN 'production' THEN 50 WHEN 'staging' THEN 70 WHEN 'development' THEN 100 END AS max_risk FROM requests", "requests")
ORACLES["env_threshold_join"] = ORACLES["rego_max_risk"]
add("rego_required_scanners", "SELECT repo_path, message FROM denials WHERE n = 4", "denials")
add("policy_merge", """SELECT p.repo_path, file, passed AND m IS NULL AS passed, concat_ws(' | ', nullif(violations, ''), CASE WHEN file IS NULL THEN m END) AS violations, warnings
  FROM policy p LEFT JOIN (SELECT repo_path, string_agg(message, ' | ' ORDER BY n) AS m FROM denials GROUP BY repo_path) USING (repo_path)""", "policy", "denials")

add("listening_ports", f"SELECT host, {TICK}, port, seq AS first_seq FROM ports", "ports")
add("port_baseline", "SELECT host, port FROM port_base", "port_base")
add("process_baseline", "SELECT DISTINCT p.host, p.line FROM proc_lines p JOIN (SELECT host, min(tick) AS t0 FROM proc GROUP BY host) f ON p.host = f.host AND p.tick = f.t0", "proc_lines", "proc")
add("new_ports", f"SELECT host, {TICK}, port FROM fresh", "fresh")
add("suspicious_ports", f"SELECT host, {TICK}, port FROM fresh WHERE port IN {BAD_PORTS}", "fresh")
for _n, _t in (("reverse_shell", "an_shell"), ("suspicious_port", "an_port"), ("port_scan", "an_scan"),
               ("suspicious_process", "an_proc"), ("critical_file_modified", "an_file"), ("runtime_anomalies", "an_all")):
    add(_n, f"SELECT {AN} FROM {_t}", _t)
add("rollback_decision", f"SELECT host, {TICK}, n AS n_anomalies, crit AS n_critical, rollback FROM decided", "decided")
add("rollback_requests", f"SELECT host, {TICK}, 'Runtime anomalies detected' AS reason, kinds FROM decided WHERE rollback", "decided")
STAMP = "strftime(tick, '%Y-%m-%dT%H:%M:%SZ')"
add("rollback_dispatch_payload", f"""SELECT host, {TICK}, '{{"ref":"main","inputs":{{"reason":"Runtime anomalies detected","severity":"critical","timestamp":"' || {STAMP} || '"}}}}' AS payload FROM decided WHERE rollback""", "decided")
add("rollback_log", f"SELECT 'Runtime anomalies detected' AS reason, {STAMP} AS timestamp FROM decided WHERE rollback", "decided")
add("stream_reverse_shell", f"SELECT host, {TICK}, seq, line FROM net WHERE regexp_matches(line, '/bin/sh|/bin/bash|nc -e|ncat|python.*socket|perl.*socket')", "net")
add("stream_suspicious_process", f"SELECT host, {TICK}, seq, line FROM proc_lines WHERE contains(lower(line), 'xmrig')", "proc_lines")
add("stream_port_anomalies", f"SELECT {AN} FROM (SELECT * FROM an_port UNION ALL SELECT * FROM an_scan)", "an_port", "an_scan")
add("stream_rollback", f"SELECT host, {TICK}, n::INTEGER AS n_anomalies, crit::INTEGER AS n_critical, rollback FROM decided", "decided")

add("gate_exit_code", "SELECT repo_path, CASE WHEN passed THEN 0 ELSE 1 END AS exit_code FROM verdicts", "verdicts")
add("last_stable_commit", """
SELECT a.host AS repo_path, strftime(a.tick, '%Y-%m-%d %H:%M:%S') AS tick, b.commit_hash AS stable_commit
FROM (SELECT DISTINCT host, tick FROM ev WHERE event_type = 'error') a
ASOF LEFT JOIN (SELECT * FROM (SELECT host, tick, md5(min(event_id)::VARCHAR) AS commit_hash, min_by(value >= 60, event_id) AS ok FROM ev WHERE event_type <> 'error' GROUP BY ALL) WHERE ok) b
ON a.host = b.host AND a.tick > b.tick""", "ev")
