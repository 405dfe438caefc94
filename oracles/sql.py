"""DuckDB SQL that answers the registered queries on the same tables, independently.

Only the derived inputs (which line is planted in which document) are shared with the
package; patterns, filters and formulas are written out again here in RE2 / DuckDB terms.
"""

from __future__ import annotations

from wardlake.sources import derived as d

Q = "'"


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _cols(spec: dict[str, str]) -> str:
    return ", ".join(f"{sql} AS {name}" for name, sql in spec.items())


def _has(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {_lit(w)})" for w in words) + ")"


def _values(rows: list[tuple], names: str) -> str:
    body = ", ".join("(" + ", ".join(_lit(v) if isinstance(v, str) else str(v) for v in r) + ")"
                     for r in rows)
    return f"SELECT * FROM (VALUES {body}) AS t({names})"


# ordinal, type, pattern, severity (gate), severity (strict), confidence added
SECRETS = [
    (0, "AWS_KEY", r"AKIA[0-9A-Z]{16}", "CRITICAL", "CRITICAL", 0.25),
    (1, "AWS_SECRET", r'(?i)aws[_-]?secret[_-]?access[_-]?key["\s:=]+[A-Za-z0-9/+=]{40}', "HIGH", "CRITICAL", 0.25),
    (2, "GITHUB_TOKEN", r"gh[pousr]_[A-Za-z0-9]{36,}", "CRITICAL", "HIGH", 0.25),
    (3, "GITLAB_TOKEN", r"glpat-[A-Za-z0-9_-]{20,}", "HIGH", "HIGH", 0.25),
    (4, "PRIVATE_KEY", r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----", "CRITICAL", "CRITICAL", 0.25),
    (5, "GENERIC_API_KEY", r'(?i)api[_-]?key["\s:=]+[a-z0-9]{20,}', "HIGH", "LOW", 0.0),
    (6, "PASSWORD", r'(?i)password["\s:=]+[^"\s]{8,}', "HIGH", "LOW", 0.0),
    (7, "DATABASE_URL", r"""(?i)(postgres|mysql|mongodb)://[^\s"']+""", "HIGH", "LOW", 0.0),
    (8, "JWT_TOKEN", r"eyJ[A-Za-z0-9-_=]+\.eyJ[A-Za-z0-9-_=]+\.?[A-Za-z0-9-_.+/=]*", "HIGH", "MEDIUM", 0.15),
    (9, "BEARER_TOKEN", r"(?i)bearer\s+[A-Za-z0-9-_=]+\.[A-Za-z0-9-_=]+\.[A-Za-z0-9-_=]*", "HIGH", "MEDIUM", 0.15),
    (10, "STRIPE_KEY", r"sk_(?:live|test)_[A-Za-z0-9]{24,}", "HIGH", "CRITICAL", 0.25),
    (11, "TWILIO_KEY", r"SK[A-Za-z0-9]{32}", "HIGH", "LOW", 0.25),
    (12, "SENDGRID_KEY", r"SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}", "HIGH", "LOW", 0.25),
    (13, "MAILGUN_KEY", r"key-[A-Za-z0-9]{32}", "HIGH", "LOW", 0.15),
    (14, "SLACK_TOKEN", r"xox[baprs]-[0-9a-zA-Z]{10,48}", "HIGH", "HIGH", 0.25),
    (15, "DISCORD_TOKEN", r"[MN][A-Za-z0-9_-]{23,}\.[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{27,}", "HIGH", "HIGH", 0.25),
    (16, "GOOGLE_API_KEY", r"AIza[0-9A-Za-z-_]{35}", "HIGH", "MEDIUM", 0.25),
    (17, "AZURE_KEY", r'(?i)azure[_-]?key["\s:=]+[A-Za-z0-9+/=]{44}', "HIGH", "MEDIUM", 0.15),
]
CODE = [
    (0, "EVAL", r"\beval\s*\(", "CRITICAL", "Dangerous eval() usage - potential code injection"),
    (1, "EXEC", r"\bexec\s*\(|os\.exec|subprocess\.call", "HIGH", "Direct command execution - review for injection risks"),
    (2, "SHELL_INJECTION", r"os\.system|shell=True|/bin/(bash|sh)", "CRITICAL", "Shell command with user input - high injection risk"),
    (3, "SQL_INJECTION", r"""execute\s*\(\s*["'].*%s|["']\s*\+\s*\w+\s*\+\s*["']""", "HIGH", "Potential SQL injection - use parameterized queries"),
    (4, "UNSAFE_DESERIALIZATION", r"pickle\.loads|yaml\.load\(|eval\(|Marshal\.load", "CRITICAL", "Unsafe deserialization - can lead to RCE"),
    (5, "HARDCODED_IP", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "MEDIUM", "Hardcoded IP address detected"),
]
PATTERNS = [
    (0, "dangerous_eval", r"(?i)(eval|exec|Function|setTimeout|setInterval)\s*\(\s*.*\+.*\)", "CRITICAL", "Dangerous use of eval/exec with dynamic content", "Code Injection"),
    (1, "unsafe_deserialization", r"(?i)(pickle\.loads|yaml\.load|Marshal\.load|JSON\.parse\s*\(\s*.*\))", "HIGH", "Unsafe deserialization of untrusted data", "Deserialization"),
    (2, "sql_injection_advanced", r"execute\s*\(\s*.*\$[0-9]+.*\)|query\s*\(\s*.*\{.*\}.*\)", "HIGH", "Potential SQL injection via parameterized queries", "SQL Injection"),
    (3, "xss_vector", r"innerHTML\s*=\s*.*\+.*|document\.write\s*\(\s*.*\+.*\)", "HIGH", "Potential XSS via DOM manipulation", "Cross-Site Scripting"),
    (4, "path_traversal", r"\.\./|\.\.\\|~|%2e%2e", "MEDIUM", "Path traversal vulnerability", "Directory Traversal"),
    (5, "command_injection", r"(?i)(exec|system|popen|spawn)\s*\(\s*.*\$[a-zA-Z_][a-zA-Z0-9_]*.*\)", "CRITICAL", "Command injection vulnerability", "Code Injection"),
]
ADVISORIES = [
    (0, r"express.*3\.", "express", "HIGH", "CVE-2022-24999", 7.5, "express <4.17.3 - DoS vulnerability"),
    (1, r"lodash.*4\.16", "lodash", "CRITICAL", "CVE-2021-23337", 9.1, "Prototype pollution"),
    (2, r"django.*2\.", "django", "HIGH", "CVE-2023-24580", 7.5, "SQL injection vulnerability"),
]
KEY = "repo_path, branch, commit_hash"
SKIP_GATE = _has("path", [".git", "node_modules", "vendor", ".venv", "__pycache__", "dist", "build"])
SKIP_GATE_EXT = r"regexp_matches(path, '\.(jpg|png|gif|pdf|zip|exe|so|dylib|dll)$')"
STRICT_DIRS = "['.git','node_modules','target','.cargo','__pycache__','build','dist']"
STRICT_EXTS = "('jpg','jpeg','png','gif','bmp','ico','pdf','zip','tar','gz','exe','dll','so','dylib')"
REL = "substr(path, length(repo_path) + 2)"
DIRS = "list_slice(string_split(rel_path, '/'), 1, -2)"
DOT_EXT = r"regexp_extract({}, '\.[^./]*$', 0)"
BARE_EXT = r"regexp_extract({}, '[^/]\.([^./]*)$', 1)"
LOW = "lower(replace(text, 'İ', 'i'))"
COMMENT = r"regexp_matches(text, '^\s*(//|#|/\*|\*)')"
DOC_WORDS = ["readme", "documentation", "example", "sample", "test", "demo", "placeholder",
             "your_", "replace_with", "fake", "mock"]
LIKELY = f"({_has(LOW, DOC_WORDS)} OR (type = 'GOOGLE_API_KEY' AND contains({LOW}, 'console.developers.google.com')))"
FP = {
    "fp_comment": COMMENT,
    "fp_password": f"(type = 'PASSWORD' AND ((contains({LOW}, 'password') AND NOT contains(text, '=')) OR {_has(LOW, ['const', 'var', 'password_', 'passwordfield'])}))",
    "fp_test_path": f"({_has('path', ['_test.go', 'test_', 'example', 'mock'])} AND type NOT IN ('AWS_KEY','GITHUB_TOKEN','PRIVATE_KEY'))",
    "fp_docs": "(ends_with(path, '.md') OR ends_with(path, '.txt'))",
    "fp_placeholder": _has("lower(match)", ["example", "sample", "test", "dummy", "fake", "placeholder", "your_", "xxx"]),
}
ANY_FP = "(" + " OR ".join(FP.values()) + ")"
LEGIT = {
    "legit_comment": COMMENT,
    "legit_eval": "(type = 'EVAL' AND (contains(text, '\"EVAL\"') OR contains(text, '''EVAL''') OR contains(text, 'eval\\(') OR contains(text, 'eval.*usage')))",
    "legit_shell_monitor": f"(type = 'SHELL_INJECTION' AND {_has('text', ['netstat', 'ss -', 'ps aux', 'lsof', 'top', 'df -h', 'free -m', 'systemctl status', 'journalctl', 'docker ps', 'kubectl get'])} AND {_has('path', ['agent', 'monitor'])})",
    "legit_shell_static": f"(type = 'SHELL_INJECTION' AND contains(text, '\"sh\", \"-c\"') AND NOT {_has(LOW, ['input', 'user'])} AND NOT contains(text, '+'))",
    "legit_sql_bound": f"(type = 'SQL_INJECTION' AND {_has(LOW, ['prepare', '?', '$1', 'bind'])})",
    "legit_ip": f"(type = 'HARDCODED_IP' AND {_has('text', ['127.0.0.1', '0.0.0.0', 'localhost', '192.168.'])})",
}
ANY_LEGIT = "(" + " OR ".join(LEGIT.values()) + ")"
ENTROPY = ("list_reduce(list_prepend(CAST(0.0 AS DOUBLE), list_transform(list_distinct(string_split(match, '')), "
           "lambda c: -((length(match) - length(replace(match, c, '')))::DOUBLE / strlen(match)) * "
           "log2((length(match) - length(replace(match, c, '')))::DOUBLE / strlen(match)))), "
           "lambda a, x: a + x)")


def _confidence(strict: bool) -> str:
    """Chain of double additions in the fixed order."""
    def step(cond: str, v: str) -> str:
        return f"CASE WHEN {cond} THEN CAST({v} AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"

    terms = ["CAST(0.5 AS DOUBLE)",
             step(_has(LOW, ["secret", "key", "token", "password", "auth", "bearer"]), "0.2"),
             step("contains(text, '=') AND (contains(text, '\"') OR contains(text, ''''))", "0.15"),
             "CAST(boost AS DOUBLE)"]
    if not strict:
        terms += [step(_has(LOW, ["example", "test", "sample", "demo"]), "-0.3"),
                  step(_has(LOW, ["//", "#", "/*", "*"]), "-0.2")]
    terms += [step(LIKELY, "-0.4"),
              "CASE WHEN entropy > 4.0 THEN CAST(0.2 AS DOUBLE) WHEN entropy > 3.0 THEN CAST(0.1 AS DOUBLE) "
              "WHEN entropy < 2.0 THEN CAST(-0.2 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END",
              "CASE WHEN strlen(match) < 10 THEN CAST(-0.1 AS DOUBLE) WHEN strlen(match) > 50 "
              "THEN CAST(0.1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"]
    chain = terms[0]
    for t in terms[1:]:
        chain = f"({chain} + {t})"
    return f"greatest(least({chain}, CAST(1.0 AS DOUBLE)), CAST(0.0 AS DOUBLE))"


MASK_GATE = ("CASE WHEN strlen(match) <= 8 THEN '***' ELSE left(match, 4) || '...' || "
             "right(match, 4) END")
MASK_STRICT = ("CASE WHEN strlen(match) <= 8 THEN repeat('*', strlen(match)::BIGINT) ELSE left(match, 4) || "
               "repeat('*', (strlen(match) - 8)::BIGINT) || right(match, 4) END")
UNNEST_LINES = ("SELECT {key}, path, rel_path, unnest(range(1, len(parts) + 1))::INTEGER AS line, "
                "unnest(parts) AS text FROM (SELECT *, string_split(content, chr(10)) AS parts FROM {src})")
STRIP_CR = "SELECT * REPLACE (CASE WHEN ends_with(text, chr(13)) THEN left(text, length(text) - 1) ELSE text END AS text) FROM {src}"

# name -> (dependencies, SQL)
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, sql: str, *deps: str) -> None:
    CTES[name] = (deps, sql)


cte("files", f"SELECT *, {REL} AS rel_path FROM (SELECT {_cols(d.file_columns())} FROM documents)")
cte("tree", f"SELECT *, {REL} AS rel_path FROM (SELECT {_cols({**d.KEY_COLUMNS, 'path': d.TREE_PATH, 'content': 'text'})} FROM documents)")
cte("manifests", f"SELECT *, {REL} AS rel_path FROM (SELECT DISTINCT {_cols(d.MANIFEST_COLUMNS)} FROM documents)")
cte("requests", f"SELECT *, {_cols(d.POLICY_COLUMNS)} FROM (SELECT DISTINCT {_cols(d.REQUEST_COLUMNS)} FROM documents)")
cte("secret_rules", _values(SECRETS, "ordinal, type, re, severity, strict_severity, boost"))
cte("code_rules", _values(CODE, "ordinal, type, re, severity, description"))
cte("pattern_rules", _values(PATTERNS, "ordinal, type, re, severity, description, vulnerability_class"))
cte("advisories", _values(ADVISORIES, "ordinal, re, package, severity, cve, cvss, description"))
cte("gate_files", f"SELECT * FROM files WHERE NOT ({SKIP_GATE} OR {SKIP_GATE_EXT})", "files")
cte("gate_lines", UNNEST_LINES.format(key=KEY, src="gate_files"), "gate_files")
cte("strict_files", f"SELECT * FROM files WHERE NOT (list_has_any({DIRS}, {STRICT_DIRS}) OR {BARE_EXT.format('rel_path')} IN {STRICT_EXTS})", "files")
cte("strict_lines0", UNNEST_LINES.format(key=KEY, src="strict_files"), "strict_files")
cte("strict_lines", STRIP_CR.format(src="strict_lines0"), "strict_lines0")
cte("gate_cand0", "SELECT l.*, r.ordinal, r.type, r.severity, r.strict_severity, r.boost, regexp_extract(l.text, r.re, 0) AS match "
    "FROM gate_lines l JOIN secret_rules r ON regexp_matches(l.text, r.re)", "gate_lines", "secret_rules")
cte("gate_cand", f"SELECT *, {ENTROPY} AS entropy FROM gate_cand0", "gate_cand0")
cte("strict_cand0", "SELECT l.*, r.ordinal, r.type, r.severity, r.strict_severity, r.boost, regexp_extract(l.text, r.re, 0) AS match "
    "FROM strict_lines l JOIN secret_rules r ON regexp_matches(l.text, r.re)", "strict_lines", "secret_rules")
cte("strict_cand", f"SELECT *, {ENTROPY} AS entropy FROM strict_cand0", "strict_cand0")
cte("gate_kept", f"SELECT *, {_confidence(False)} AS confidence, {MASK_GATE} AS masked, sha256(match) AS hash FROM gate_cand WHERE NOT {ANY_FP}", "gate_cand")
cte("strict_kept", f"SELECT *, {_confidence(True)} AS confidence, {MASK_STRICT} AS masked, sha256(match) AS hash FROM strict_cand WHERE NOT {LIKELY}", "strict_cand")
cte("secrets_gate", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_path, branch, commit_hash, hash "
    "ORDER BY string_split(rel_path, '/'), line, ordinal) AS rn FROM gate_kept) WHERE rn = 1", "gate_kept")
cte("secrets_strict", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo_path, branch, commit_hash, rel_path, hash "
    "ORDER BY line, ordinal) AS rn FROM strict_kept) WHERE rn = 1", "strict_kept")
cte("code_cand", "SELECT l.*, r.ordinal, r.type, r.severity, r.description FROM gate_lines l JOIN code_rules r "
    "ON regexp_matches(l.text, r.re)", "gate_lines", "code_rules")
cte("issues", f"SELECT * FROM code_cand WHERE NOT {ANY_LEGIT}", "code_cand")
cte("cves", "SELECT m.repo_path, m.branch, m.commit_hash, m.rel_path AS manifest, a.package, a.severity, a.cve, a.description, "
    "a.cvss::DOUBLE AS cvss, a.ordinal FROM manifests m JOIN advisories a ON regexp_matches(m.content, a.re) "
    "WHERE m.rel_path IN ('package.json','requirements.txt','go.mod','Gemfile','pom.xml')", "manifests", "advisories")
cte("contrib", """
SELECT repo_path, 0 AS fam, string_split(rel_path, '/') AS p, line, ordinal,
       (CASE severity WHEN 'CRITICAL' THEN 30.0 WHEN 'HIGH' THEN 20.0 WHEN 'MEDIUM' THEN 10.0 ELSE 0.0 END)::DOUBLE * confidence AS points
FROM secrets_gate
UNION ALL SELECT repo_path, 1, [manifest], 0, ordinal, (CASE WHEN cvss >= 9 THEN 25 WHEN cvss >= 7 THEN 15 WHEN cvss >= 4 THEN 10 ELSE 5 END)::DOUBLE FROM cves
UNION ALL SELECT repo_path, 2, string_split(rel_path, '/'), line, ordinal,
       (CASE severity WHEN 'CRITICAL' THEN 20 WHEN 'HIGH' THEN 15 WHEN 'MEDIUM' THEN 8 ELSE 3 END)::DOUBLE FROM issues""",
    "secrets_gate", "cves", "issues")
cte("base", "SELECT repo_path, list_reduce(list_prepend(CAST(0.0 AS DOUBLE), list(points ORDER BY fam, p, line, ordinal)), lambda a, x: a + x) AS base "
    "FROM contrib GROUP BY repo_path", "contrib")
cte("secret_stats", f"""SELECT repo_path, count(*) AS n_secrets, count(*) FILTER (severity = 'CRITICAL') AS n_critical_secrets,
  count(DISTINCT type) AS n_types, max(confidence) AS maxc, min(confidence) AS minc FROM secrets_gate GROUP BY repo_path""", "secrets_gate")
cte("ext_stats", f"SELECT repo_path, {DOT_EXT.format('rel_path')} AS ext, count(*) AS n FROM secrets_gate GROUP BY ALL", "secrets_gate")
cte("top_ext", "SELECT repo_path, max(n) AS n_top, max_by(ext, n) AS ext FROM ext_stats GROUP BY repo_path", "ext_stats")
cte("cve_stats", "SELECT repo_path, count(*) AS n_cves, count(*) FILTER (cvss >= 9) AS n_critical_cves FROM cves GROUP BY repo_path", "cves")
cte("code_stats", "SELECT repo_path, count(*) AS n_code_issues, count(*) FILTER (severity = 'CRITICAL') AS n_critical_code, "
    "count(*) FILTER (type = 'EVAL') AS n_eval, count(*) FILTER (type = 'SHELL_INJECTION') AS n_shell FROM issues GROUP BY repo_path", "issues")
cte("scored0", """
SELECT q.*, coalesce(n_secrets, 0) AS n_secrets, coalesce(n_critical_secrets, 0) AS n_critical_secrets, coalesce(n_types, 0) AS n_types, maxc, minc,
  n_top, ext, coalesce(n_cves, 0) AS n_cves, coalesce(n_critical_cves, 0) AS n_critical_cves, coalesce(n_code_issues, 0) AS n_code_issues,
  coalesce(n_critical_code, 0) AS n_critical_code, coalesce(n_eval, 0) AS n_eval, coalesce(n_shell, 0) AS n_shell, coalesce(base, CAST(0 AS DOUBLE)) AS base
FROM requests q LEFT JOIN secret_stats USING (repo_path) LEFT JOIN top_ext USING (repo_path) LEFT JOIN cve_stats USING (repo_path)
LEFT JOIN code_stats USING (repo_path) LEFT JOIN base USING (repo_path)""",
    "requests", "secret_stats", "top_ext", "cve_stats", "code_stats", "base")
cte("scored1", """SELECT *, least(trunc((base + CASE WHEN n_types >= 3 THEN CAST(10 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) *
  CASE WHEN n_secrets > 0 AND maxc <= 0.6 THEN CAST(0.7 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END), 100)::INTEGER AS risk_score FROM scored0""", "scored0")
cte("scored", """SELECT *, CASE WHEN risk_score >= 70 THEN 'CRITICAL' WHEN risk_score >= 50 THEN 'HIGH' WHEN risk_score >= 30 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
  CASE WHEN contains(branch, 'main') OR contains(branch, 'master') THEN 'prod' WHEN contains(branch, 'staging') THEN 'staging' ELSE 'dev' END AS env
  FROM scored1""", "scored1")
cte("verdicts0", "SELECT *, CASE env WHEN 'prod' THEN 50 WHEN 'staging' THEN 70 ELSE 100 END AS threshold FROM scored", "scored")
cte("verdicts", "SELECT *, risk_score < threshold AND n_critical_secrets = 0 AND n_critical_cves = 0 AS passed FROM verdicts0", "verdicts0")
cte("anomalies", """
SELECT repo_path, 0 AS pos, '80%+ secrets in ' || ext || ' files - potential targeted leak' AS warning FROM scored WHERE n_secrets > 0 AND n_top::DOUBLE / n_secrets::DOUBLE > 0.8
UNION ALL SELECT repo_path, 1, 'All findings have high confidence - verify if legitimate' FROM scored WHERE n_secrets > 2 AND minc >= 0.8
UNION ALL SELECT repo_path, 2, 'Majority critical secrets - high-risk scenario' FROM scored WHERE n_critical_secrets > n_secrets // 2""", "scored")
RISK_MSG = "'Risk score ' || risk_score || ' exceeds ' || env || ' threshold of ' || threshold"
SECRET_MSG = "'Critical secret detected: ' || type || ' in ' || rel_path || ':' || line"
CVE_TAIL = "cve || ' (CVSS ' || printf('%.1f', cvss) || ') in ' || package"
cte("violations", f"""
SELECT repo_path, '' AS file, 1 AS rule, [''] AS p, 0 AS line, 0 AS ordinal, {RISK_MSG} AS message FROM verdicts WHERE risk_score >= threshold
UNION ALL SELECT repo_path, rel_path, 2, string_split(rel_path, '/'), line, ordinal, {SECRET_MSG} FROM secrets_gate WHERE severity = 'CRITICAL'
UNION ALL SELECT repo_path, manifest, 3, [''], 0, ordinal, 'Critical CVE detected: ' || {CVE_TAIL} FROM cves WHERE cvss >= 9""",
    "verdicts", "secrets_gate", "cves")
cte("warnings", f"""
SELECT repo_path, manifest AS file, 3 AS rule, ordinal, 'High severity CVE: ' || {CVE_TAIL} AS message FROM cves WHERE cvss >= 7 AND cvss < 9
UNION ALL SELECT repo_path, '', 4, 0, n_critical_code || ' critical code patterns detected' FROM verdicts WHERE n_critical_code >= 3""", "cves", "verdicts")
cte("docs", """SELECT v.repo_path, '' AS file FROM verdicts v
UNION SELECT repo_path, rel_path FROM secrets_gate UNION SELECT repo_path, manifest FROM cves
UNION SELECT repo_path, rel_path FROM issues""", "verdicts", "secrets_gate", "cves", "issues")
cte("said", """SELECT repo_path, file, passed, coalesce(v, '') AS violations, coalesce(w, '') AS warnings
FROM docs JOIN verdicts USING (repo_path)
LEFT JOIN (SELECT repo_path, file, string_agg(message, ' | ' ORDER BY rule, p, line, ordinal) AS v FROM violations GROUP BY ALL) USING (repo_path, file)
LEFT JOIN (SELECT repo_path, file, string_agg(message, ' | ' ORDER BY rule, ordinal) AS w FROM warnings GROUP BY ALL) USING (repo_path, file)""",
    "docs", "verdicts", "violations", "warnings")
cte("policy", """SELECT repo_path, nullif(file, '') AS file, passed, violations, warnings FROM said
WHERE file = '' OR violations <> '' OR warnings <> ''""", "said")
cte("denials", """
SELECT repo_path, 1 AS n, 'eval() usage is forbidden in production code' AS message FROM scored WHERE n_eval > 0
UNION ALL SELECT repo_path, 2, 'Shell injection vulnerability detected - deployment blocked' FROM scored WHERE n_shell > 0
UNION ALL SELECT repo_path, 3, 'All dependencies must be scanned for CVEs' FROM scored WHERE NOT dependencies_scanned
UNION ALL SELECT repo_path, 4, 'Required scanner ''cve'' did not pass' FROM scored WHERE cve_status <> 'passed'""", "scored")

# --- advanced
cte("src_files", rf"SELECT * FROM files WHERE {DOT_EXT.format('path')} IN ('.rs','.go','.py','.js','.ts','.java','.cpp','.c','.h')", "files")
cte("adv_lines0", UNNEST_LINES.format(key=KEY, src="src_files"), "src_files")
cte("adv_lines", STRIP_CR.format(src="adv_lines0"), "adv_lines0")
cte("adv_hits", "SELECT l.*, r.type, r.severity, r.description, r.vulnerability_class, strlen(left(text, instr(text, regexp_extract(text, r.re, 0)) - 1)) + 1 AS col "
    "FROM adv_lines l JOIN pattern_rules r ON regexp_matches(l.text, r.re)", "adv_lines", "pattern_rules")
FIND = "repo_path, path AS file, line, {col}::INTEGER AS \"column\", {type} AS finding_type, {sev} AS severity, {desc} AS description, {conf}::DOUBLE AS confidence, {ctx} AS code_context, {cls} AS vulnerability_class"
cte("adv_patterns", "SELECT " + FIND.format(col="col", type="type", sev="severity", desc="description", conf="0.8", ctx="trim(text, chr(9) || chr(32) || chr(13))", cls="vulnerability_class") + " FROM adv_hits", "adv_hits")
cte("tainted", "SELECT " + FIND.format(col="0", type="'tainted_data_flow'", sev="'CRITICAL'", desc="'User input flows to dangerous function'", conf="0.9", ctx="trim(text, chr(9) || chr(32) || chr(13))", cls="'Injection'")
    + f" FROM adv_lines WHERE {_has('text', ['eval(', 'exec(', 'system('])} AND {_has('text', ['req.', 'request.', 'input'])}", "adv_lines")
cte("crypto", "SELECT " + FIND.format(col="1", type="'weak_crypto'", sev="'MEDIUM'", desc="'Use of weak cryptographic algorithm'", conf="0.7", ctx="trim(text, chr(9) || chr(32) || chr(13))", cls="'Cryptography'")
    + " FROM adv_lines WHERE regexp_matches(text, 'MD5|md5|SHA1|sha1|DES|des|RC4|rc4')", "adv_lines")

STR2, STR1, TICK = r'"[^"\\\n]*(?:\\.[^"\\\n]*)*"', r"'[^'\\\n]*(?:\\.[^'\\\n]*)*'", r"`[^`]*`"
LONG2 = r'"[^"\\]*(?:\\.[^"\\]*)*"'
CHAR = r"'(?:\\[^\n]|[^'\\\n])'"
COMMENTS = r"//[^\n]*|/\*(?:[^*]|\*[^/])*\*/"
FLAT = rf"(?:[^()\"'`]|{STR2}|{STR1}|{TICK})*"
ARGS = rf"\({FLAT}(?:\({FLAT}(?:\({FLAT}\){FLAT})*\){FLAT})*\)"
WORD = r"[A-Za-z0-9_$.]+"
SITES = {
    "rust_unsafe_blocks": ("unsafe_block", "('rs')", rf"{COMMENTS}|{LONG2}|{CHAR}", r"unsafe\s*\{[^{}]*\}",
                           "MEDIUM", "Unsafe block allows raw pointer operations", 0.9, "Memory Safety", "true"),
    "rust_unwrap": ("unwrap_usage", "('rs')", rf"{COMMENTS}|{LONG2}|{CHAR}", rf"[A-Za-z_][A-Za-z0-9_:]*(?:\.[a-z]+{ARGS})*?\.(?:unwrap\(\)|expect{ARGS})",
                    "LOW", "Use of unwrap() or expect() may cause panics", 0.7, "Error Handling", "true"),
    "js_eval": ("eval_usage", "('js','ts')", rf"{COMMENTS}|{STR2}|{STR1}|{TICK}", rf"eval{ARGS}",
                "HIGH", "Use of eval() can execute arbitrary code", 0.95, "Code Injection", "true"),
    "js_innerhtml_concat": ("xss_innerhtml", "('js','ts')", rf"{COMMENTS}|{STR2}|{STR1}|{TICK}",
                            rf"[A-Za-z_$][A-Za-z0-9_$.]*\s*=(?:[^=>;\n\"'`]|{STR2}|{STR1}|{TICK})(?:[^;\n\"'`]|{STR2}|{STR1}|{TICK})*",
                            "HIGH", "Potential XSS via innerHTML with string concatenation", 0.85, "Cross-Site Scripting",
                            "contains(tok, 'innerHTML') AND contains(tok, '+')"),
    "py_dynamic_exec": ("dynamic_execution", "('py')", rf"#[^\n]*|{STR2}|{STR1}", rf"(?:exec|eval){ARGS}",
                        "CRITICAL", "Use of exec() or eval() allows code execution", 0.95, "Code Injection", "true"),
    "go_sql_concat": ("sql_injection", "('go')", rf"{COMMENTS}|{STR2}|{TICK}|{CHAR}", rf"[A-Za-z_][A-Za-z0-9_.]*(?:Query|Exec){ARGS}",
                      "HIGH", "Potential SQL injection via string concatenation", 0.8, "SQL Injection",
                      "(contains(tok, ' + ') OR contains(tok, ' fmt.Sprintf'))"),
}
for key, (kind, exts, skip, node, sev, desc, conf, cls, cond) in SITES.items():
    rx = f"(?s){skip}|{node}|{WORD}|."
    cte(f"{key}_t", f"""SELECT *, sum(length(tok)) OVER w AS s FROM (
      SELECT repo_path, path, content, unnest(range(1, len(toks) + 1)) AS i, unnest(toks) AS tok FROM (
        SELECT *, regexp_extract_all(content, {_lit(rx)}) AS toks FROM src_files WHERE {BARE_EXT.format('path')} IN {exts}))
      WINDOW w AS (PARTITION BY path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""", "src_files")
    start = "coalesce(s, 0)::BIGINT"
    pre = f"left(content, {start})"
    cte(f"{key}_x", "SELECT " + FIND.replace(" line,", f" (length({pre}) - length(replace({pre}, chr(10), '')) + 1)::INTEGER AS line,").format(
        col=f"strlen(string_split({pre}, chr(10))[-1]) + 1", type=_lit(kind), sev=_lit(sev), desc=_lit(desc), conf=conf,
        ctx=f"substr(content, greatest({start} - 50, 0) + 1, {start} + length(tok) + 50 - greatest({start} - 50, 0))", cls=_lit(cls))
        + f" FROM {key}_t WHERE regexp_matches(tok, {_lit('(?s)^(?:' + node + ')$')}) AND {cond}", f"{key}_t")
cte("advanced", " UNION ALL ".join(f"SELECT * FROM {t}" for t in ["adv_patterns", "tainted", "crypto", *(f"{k}_x" for k in SITES)]),
    "adv_patterns", "tainted", "crypto", *(f"{k}_x" for k in SITES))
# Each language's token grammar, alternatives in order (block comments, triple
# quotes, template, raw and character literals, then words, numbers, signs, blank runs).
T_BLOCK = r"/\*[^*]*(?:\*+[^*/][^*]*)*\*+/"
T_TRIPLE = r'"""[^"]*(?:"{1,2}[^"]+)*"""' + "|" + r"'''[^']*(?:'{1,2}[^']+)*'''"
T_TEMPLATE = r"`[^`\\]*(?:\\.[^`\\]*)*`"
T_CHAR = r"'(?:\\[^'\n]+|[^'\\\n])'"
T_TAIL = r"[A-Za-z_$][A-Za-z0-9_$]*\(?|[0-9]+|[^\s]|\s+"
TOKENS = {
    "py": rf"#[^\n]*|{T_TRIPLE}|{STR1}|{STR2}|{T_TAIL}",
    "js": rf"//[^\n]*|{T_BLOCK}|{STR1}|{T_TEMPLATE}|{STR2}|{T_TAIL}",
    "rs": rf"//[^\n]*|{T_BLOCK}|{LONG2}|{T_CHAR}|{T_TAIL}",
    "go": rf"//[^\n]*|{T_BLOCK}|{TICK}|{STR2}|{T_CHAR}|{T_TAIL}",
}
TOKENS["ts"] = TOKENS["js"]
cte("tokens0", " UNION ALL ".join(
    f"SELECT path, regexp_extract_all(content, {_lit('(?s)' + rx)}) AS toks FROM files WHERE {BARE_EXT.format('path')} = '{e}'" for e, rx in TOKENS.items()), "files")
cte("tokens1", "SELECT path, unnest(range(1, len(toks) + 1)) AS i, unnest(toks) AS token FROM tokens0", "tokens0")
cte("tokens2", """SELECT *, coalesce(sum(len(string_split(token, chr(10))) - 1) OVER w, 0) AS nl, coalesce(sum(strlen(token)) OVER w, 0) AS off,
  strlen(token) - strlen(string_split(token, chr(10))[-1]) AS lead FROM tokens1
  WINDOW w AS (PARTITION BY path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""", "tokens1")
cte("tokens", """SELECT *, coalesce(max(CASE WHEN contains(token, chr(10)) THEN off + lead END) OVER w, 0) AS line_start FROM tokens2
  WINDOW w AS (PARTITION BY path ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""", "tokens2")

# --- runtime
EV = {k: v.replace("get_json_object(props, '$.k')", "json_extract_string(props, '$.k')") for k, v in d.EVENT_COLUMNS.items()}
cte("ev", f"SELECT *, date_trunc('hour', ts) - to_hours(hour(ts) % 4) AS tick FROM (SELECT {_cols(EV)}, ts FROM events)")
cte("net", f"SELECT host, tick, event_id::INTEGER AS seq, {d.NET_LINE} AS line FROM ev", "ev")
cte("proc", f"SELECT host, tick, event_id::INTEGER AS seq, {d.PROCESS_LINE} AS line FROM ev", "ev")
cte("proc_lines", "SELECT * FROM proc WHERE seq > 0 AND line <> ''", "proc")
cte("mtimes", f"SELECT host, tick, {d.WATCHED_PATH} AS path, tick - to_microseconds(round(value * 30000000)::BIGINT) AS mtime FROM ev", "ev")
cte("first_tick", "SELECT host, min(tick) AS t0 FROM net GROUP BY host", "net")
cte("ports", r"SELECT host, tick, port, min(seq) AS seq FROM (SELECT host, tick, seq, unnest(regexp_extract_all(line, ':(\d+)(?:\s|$)', 1))::BIGINT AS port FROM net WHERE contains(line, 'LISTEN')) GROUP BY ALL", "net")
cte("port_base", "SELECT DISTINCT p.host, p.port FROM ports p JOIN first_tick f ON p.host = f.host AND p.tick = f.t0", "ports", "first_tick")
cte("fresh", "SELECT p.* FROM ports p ANTI JOIN port_base b ON p.host = b.host AND p.port = b.port", "ports", "port_base")
BAD_PORTS = "(4444, 5555, 6667, 31337, 12345, 1337, 6666, 7777)"
cte("port_sum", f"SELECT host, tick, count(*) AS n, min_by(port, seq) FILTER (port IN {BAD_PORTS}) AS bad, string_agg(port::VARCHAR, ' ' ORDER BY seq) AS list FROM fresh GROUP BY ALL", "fresh")
AN = "host, tick, '{t}' AS anomaly_type, '{s}' AS severity, '{de}' AS description, {det} AS details, '{a}' AS action"
cte("an_shell", "SELECT " + AN.format(t="REVERSE_SHELL", s="CRITICAL", de="Potential reverse shell detected", det="'Suspicious process: ' || min_by(line, seq)", a="ROLLBACK_REQUIRED")
    + " FROM net WHERE regexp_matches(line, '/bin/sh|/bin/bash|nc -e|ncat|python.*socket|perl.*socket') GROUP BY host, tick", "net")
cte("an_port", "SELECT " + AN.format(t="SUSPICIOUS_PORT", s="HIGH", de="New suspicious port opened", det="'Port ' || bad || ' opened (not in baseline)'", a="INVESTIGATE") + " FROM port_sum WHERE bad IS NOT NULL", "port_sum")
cte("an_scan", "SELECT " + AN.format(t="PORT_SCAN", s="HIGH", de="Multiple new ports opened", det="'New ports: [' || list || ']'", a="INVESTIGATE") + " FROM port_sum WHERE bad IS NULL AND n >= 5", "port_sum")
cte("an_proc", "SELECT " + AN.format(t="SUSPICIOUS_PROCESS", s="CRITICAL", de="Suspicious process detected", det="'Process: ' || min_by(line, seq)", a="ROLLBACK_REQUIRED")
    + f" FROM proc_lines WHERE {_has('lower(line)', ['cryptominer', 'xmrig', 'minerd', 'cgminer', 'nc -l', 'ncat -l', 'python -m SimpleHTTPServer', 'python -m http.server'])} GROUP BY host, tick", "proc_lines")
cte("globs", _values([(0, "/etc/passwd", "^/etc/passwd$"), (1, "/etc/shadow", "^/etc/shadow$"), (2, "/etc/sudoers", "^/etc/sudoers$"),
                      (3, "/root/.ssh/authorized_keys", r"^/root/\.ssh/authorized_keys$"), (4, "/home/*/.ssh/authorized_keys", r"^/home/[^/]*/\.ssh/authorized_keys$")], "i, pattern, re"))
cte("an_file", "SELECT " + AN.format(t="CRITICAL_FILE_MODIFIED", s="CRITICAL", de="Critical system file modified", det="'File: ' || min_by(pattern, i)", a="ROLLBACK_REQUIRED")
    + " FROM mtimes JOIN globs ON regexp_matches(path, re) WHERE tick - mtime < INTERVAL 60 SECOND GROUP BY host, tick", "mtimes", "globs")
cte("an_all", "SELECT a.* FROM (" + " UNION ALL ".join(f"SELECT *, {i} AS ord FROM {t}" for i, t in enumerate(["an_shell", "an_port", "an_scan", "an_proc", "an_file"]))
    + ") a JOIN first_tick f ON a.host = f.host WHERE a.tick > f.t0", "an_shell", "an_port", "an_scan", "an_proc", "an_file", "first_tick")
cte("tick_sum", "SELECT host, tick, count(*) AS n, count(*) FILTER (severity = 'CRITICAL') AS crit, string_agg(anomaly_type, ' ' ORDER BY ord) AS kinds FROM an_all GROUP BY ALL", "an_all")
cte("decided", "SELECT *, crit > 0 OR row_number() OVER (PARTITION BY host, crit > 0 ORDER BY tick) % 3 = 0 AS rollback FROM tick_sum", "tick_sum")


def build(body: str, *needs: str) -> str:
    """WITH clause holding ``needs`` and all they depend on, then the body."""
    done: list[str] = []

    def add(name: str) -> None:
        for dep in CTES[name][0]:
            add(dep)
        if name not in done:
            done.append(name)

    for n in needs:
        add(n)
    return "WITH " + ", ".join(f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in done) + " " + body
