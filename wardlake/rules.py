"""Rule and advisory tables.

A rule is plain data: users append their own ``Rule`` objects (or load them from a
table with :func:`rules_from_table`) and pass the longer list to any operator.

Spelling of ``regex``: Java syntax, restricted so that RE2 gives the same matches.

* ``\\s`` and ``\\S``, inside a class or not, stand for the profile's whitespace
  (``spell`` expands them), because engines disagree on what it contains.
* Under ``(?i)`` the letters s and k also match U+017F and U+212A, as Unicode simple
  folding does; Java folds ASCII only, so those letters are spelled as classes.
* ``.`` must exclude only the newline; ``spell`` prefixes ``(?d)`` for that.
* ``\\b`` is spelled with ASCII look-arounds.

``anchors`` are literals at least one of which occurs in every line the regex can
match (lower-cased when ``fold`` is set). They are byte-wise ``contains`` tests that
spare most lines the regex; a rule without anchors is always tried. ``guard`` is a
second, cheap regex with the same "necessary" meaning. ``group`` is the capture group
that holds the match.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

# Whitespace members inside a character class: ASCII set, and the Unicode White_Space set.
ASCII_SPACE = r"\t\n\f\r "
UNICODE_SPACE = (
    r"\t\n\x{0B}\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
)


@dataclass(frozen=True)
class Rule:
    ordinal: int
    family: str
    type: str
    regex: str
    severity: str = "HIGH"
    strict_severity: str = "LOW"
    description: str = ""
    vulnerability_class: str = ""
    confidence_boost: float = 0.0
    anchors: tuple[str, ...] = ()
    fold: bool = False
    guard: str = ""
    group: int = 0


@dataclass(frozen=True)
class Advisory:
    ordinal: int
    pattern: str
    package: str
    severity: str
    cve: str
    cvss: float
    description: str
    anchors: tuple[str, ...] = ()


def spell(regex: str, unicode_space: bool = False) -> str:
    """The pattern handed to Spark's regex functions: ``\\s`` and ``\\S`` spelled out.

    Outside a class they become a class, inside one ``\\s`` becomes its members and ``\\S`` a
    nested class (a union, as Java reads it).
    """
    space = UNICODE_SPACE if unicode_space else ASCII_SPACE
    out, at, in_class = [], 0, 0
    while at < len(regex):
        pair = regex[at:at + 2]
        if pair in (r"\s", r"\S"):
            one = f"[{space}]" if pair == r"\s" else f"[^{space}]"
            out.append(space if in_class and pair == r"\s" else one)
        elif pair[0] == "\\":
            out.append(pair)
        else:
            if pair[0] == "[":
                in_class += 1
            elif pair[0] == "]" and in_class:
                in_class -= 1
            out.append(pair[0])
            at -= 1
        at += 2
    return "(?d)" + "".join(out)


# ---------------------------------------------------------------------------
# Secret patterns, their severities in the two profiles and the
# confidence each pattern's specificity adds.
# ---------------------------------------------------------------------------
SECRET_RULES: tuple[Rule, ...] = (
    Rule(0, "secret", "AWS_KEY", r"AKIA[0-9A-Z]{16}",
         "CRITICAL", "CRITICAL", confidence_boost=0.25, anchors=("AKIA",)),
    Rule(1, "secret", "AWS_SECRET",
         r'(?i)aw[s\x{17F}][_-]?[s\x{17F}]ecret[_-]?acce[s\x{17F}][s\x{17F}][_-]?[k\x{212A}]ey'
         r'["\s:=]+[A-Za-z0-9/+=\x{17F}\x{212A}]{40}',
         "HIGH", "CRITICAL", confidence_boost=0.25, anchors=("ecret",), fold=True),
    Rule(2, "secret", "GITHUB_TOKEN", r"gh[pousr]_[A-Za-z0-9]{36,}",
         "CRITICAL", "HIGH", confidence_boost=0.25,
         anchors=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule(3, "secret", "GITLAB_TOKEN", r"glpat-[A-Za-z0-9_-]{20,}",
         "HIGH", "HIGH", confidence_boost=0.25, anchors=("glpat-",)),
    Rule(4, "secret", "PRIVATE_KEY", r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----",
         "CRITICAL", "CRITICAL", confidence_boost=0.25, anchors=("PRIVATE KEY-----",)),
    Rule(5, "secret", "GENERIC_API_KEY",
         r'(?i)api[_-]?[k\x{212A}]ey["\s:=]+[a-z0-9\x{17F}\x{212A}]{20,}',
         "HIGH", "LOW", anchors=("api",), fold=True),
    Rule(6, "secret", "PASSWORD",
         r'(?i)pa[s\x{17F}][s\x{17F}]word["\s:=]+[^"\s]{8,}',
         "HIGH", "LOW", anchors=("word",), fold=True),
    Rule(7, "secret", "DATABASE_URL",
         r'''(?i)(?:po[s\x{17F}]tgre[s\x{17F}]|my[s\x{17F}]ql|mongodb)://[^\s"']+''',
         "HIGH", "LOW", anchors=("://",)),
    Rule(8, "secret", "JWT_TOKEN",
         r"eyJ[A-Za-z0-9-_=]+\.eyJ[A-Za-z0-9-_=]+\.?[A-Za-z0-9-_.+/=]*",
         "HIGH", "MEDIUM", confidence_boost=0.15, anchors=(".eyJ",)),
    Rule(9, "secret", "BEARER_TOKEN",
         r"(?i)bearer[\s]+[A-Za-z0-9-_=\x{17F}\x{212A}]+\.[A-Za-z0-9-_=\x{17F}\x{212A}]+"
         r"\.[A-Za-z0-9-_=\x{17F}\x{212A}]*",
         "HIGH", "MEDIUM", confidence_boost=0.15, anchors=("bearer",), fold=True),
    Rule(10, "secret", "STRIPE_KEY", r"sk_(?:live|test)_[A-Za-z0-9]{24,}",
         "HIGH", "CRITICAL", confidence_boost=0.25, anchors=("sk_",)),
    Rule(11, "secret", "TWILIO_KEY", r"SK[A-Za-z0-9]{32}",
         "HIGH", "LOW", confidence_boost=0.25, anchors=("SK",)),
    Rule(12, "secret", "SENDGRID_KEY", r"SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}",
         "HIGH", "LOW", confidence_boost=0.25, anchors=("SG.",)),
    Rule(13, "secret", "MAILGUN_KEY", r"key-[A-Za-z0-9]{32}",
         "HIGH", "LOW", confidence_boost=0.15, anchors=("key-",)),
    Rule(14, "secret", "SLACK_TOKEN", r"xox[baprs]-[0-9a-zA-Z]{10,48}",
         "HIGH", "HIGH", confidence_boost=0.25, anchors=("xox",)),
    Rule(15, "secret", "DISCORD_TOKEN",
         # Tried only where a run of token characters starts, with possessive runs: one long
         # blob is then read once instead of once per M or N. Group 1 is the token
         # [MN][A-Za-z0-9_-]{23,}\.[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{27,}
         r"(?<![A-Za-z0-9_-])[A-LO-Za-z0-9_-]*+"
         r"([MN][A-Za-z0-9_-]{23,}+\.[A-Za-z0-9_-]{6,}+\.[A-Za-z0-9_-]{27,})",
         "HIGH", "HIGH", confidence_boost=0.25, group=1,
         guard=r"\.[A-Za-z0-9_-]{6,}+\.[A-Za-z0-9_-]{27}"),
    Rule(16, "secret", "GOOGLE_API_KEY", r"AIza[0-9A-Za-z-_]{35}",
         "HIGH", "MEDIUM", confidence_boost=0.25, anchors=("AIza",)),
    Rule(17, "secret", "AZURE_KEY",
         r'(?i)azure[_-]?[k\x{212A}]ey["\s:=]+[A-Za-z0-9+/=\x{17F}\x{212A}]{44}',
         "HIGH", "MEDIUM", confidence_boost=0.15, anchors=("azure",), fold=True),
)

# ---------------------------------------------------------------------------
# Dangerous code patterns, severities and descriptions.
# ---------------------------------------------------------------------------
CODE_RULES: tuple[Rule, ...] = (
    Rule(0, "code", "EVAL", r"(?<![0-9A-Za-z_])eval[\s]*\(", "CRITICAL",
         description="Dangerous eval() usage - potential code injection", anchors=("eval",)),
    Rule(1, "code", "EXEC", r"(?<![0-9A-Za-z_])exec[\s]*\(|os\.exec|subprocess\.call", "HIGH",
         description="Direct command execution - review for injection risks",
         anchors=("exec", "subprocess.call")),
    Rule(2, "code", "SHELL_INJECTION", r"os\.system|shell=True|/bin/(?:bash|sh)", "CRITICAL",
         description="Shell command with user input - high injection risk",
         anchors=("os.system", "shell=True", "/bin/")),
    Rule(3, "code", "SQL_INJECTION",
         r"""execute[\s]*\([\s]*["'].*%s|["'][\s]*\+[\s]*\w+[\s]*\+[\s]*["']""", "HIGH",
         description="Potential SQL injection - use parameterized queries",
         anchors=("execute", "+")),
    Rule(4, "code", "UNSAFE_DESERIALIZATION",
         r"pickle\.loads|yaml\.load\(|eval\(|Marshal\.load", "CRITICAL",
         description="Unsafe deserialization - can lead to RCE",
         anchors=("pickle.loads", "yaml.load(", "eval(", "Marshal.load")),
    Rule(5, "code", "HARDCODED_IP",
         r"(?<![0-9A-Za-z_])(?:\d{1,3}\.){3}\d{1,3}(?![0-9A-Za-z_])", "MEDIUM",
         description="Hardcoded IP address detected",
         guard=r"[0-9]\.[0-9]{1,3}\.[0-9]"),
)

# ---------------------------------------------------------------------------
# Advanced line patterns. Only the start of the first match is
# reported, so runs are written with negated classes: same start, no backtracking.
# ---------------------------------------------------------------------------
PATTERN_RULES: tuple[Rule, ...] = (
    Rule(0, "pattern", "dangerous_eval",
         r"(?i)(?:eval|exec|function|[s\x{17F}]ettimeout|[s\x{17F}]etinterval)[\s]*"
         r"\([^+\n]*\+[^)\n]*\)",
         "CRITICAL", description="Dangerous use of eval/exec with dynamic content",
         vulnerability_class="Code Injection", anchors=("+",)),
    Rule(1, "pattern", "unsafe_deserialization",
         r"(?i)pic[k\x{212A}]le\.load[s\x{17F}]|yaml\.load|mar[s\x{17F}]hal\.load"
         r"|j[s\x{17F}]on\.par[s\x{17F}]e[\s]*\([^)\n]*\)",
         "HIGH", description="Unsafe deserialization of untrusted data",
         vulnerability_class="Deserialization", anchors=(".load", "on.par"), fold=True),
    Rule(2, "pattern", "sql_injection_advanced",
         r"execute[\s]*\([^\n]*?\$[0-9][^)\n]*\)|query[\s]*\([^{\n]*\{[^}\n]*\}[^)\n]*\)",
         "HIGH", description="Potential SQL injection via parameterized queries",
         vulnerability_class="SQL Injection", anchors=("execute", "query")),
    Rule(3, "pattern", "xss_vector",
         r"innerHTML[\s]*=[^+\n]*\+|document\.write[\s]*\([^+\n]*\+[^)\n]*\)",
         "HIGH", description="Potential XSS via DOM manipulation",
         vulnerability_class="Cross-Site Scripting", anchors=("innerHTML", "document.write")),
    Rule(4, "pattern", "path_traversal", r"\.\./|\.\.\\|~|%2e%2e",
         "MEDIUM", description="Path traversal vulnerability",
         vulnerability_class="Directory Traversal", anchors=("../", "..\\", "~", "%2e%2e")),
    Rule(5, "pattern", "command_injection",
         r"(?i)(?:exec|[s\x{17F}]y[s\x{17F}]tem|popen|[s\x{17F}]pawn)[\s]*"
         r"\([^\n]*?\$[a-z_\x{17F}\x{212A}][^)\n]*\)",
         "CRITICAL", description="Command injection vulnerability",
         vulnerability_class="Code Injection", anchors=("$",)),
)

# Literals whose presence marks a line as using weak cryptography.
WEAK_CRYPTO_WORDS = ("MD5", "md5", "SHA1", "sha1", "DES", "des", "RC4", "rc4")

# The two halves of the one-line data-flow check.
DANGEROUS_SINKS = ("eval(", "exec(", "system(")
USER_INPUTS = ("req.", "request.", "input")

# ---------------------------------------------------------------------------
# Known vulnerable dependencies, and where manifests are looked for.
# ---------------------------------------------------------------------------
ADVISORIES: tuple[Advisory, ...] = (
    Advisory(0, r"express.*3\.", "express", "HIGH", "CVE-2022-24999", 7.5,
             "express <4.17.3 - DoS vulnerability", anchors=("express",)),
    Advisory(1, r"lodash.*4\.16", "lodash", "CRITICAL", "CVE-2021-23337", 9.1,
             "Prototype pollution", anchors=("lodash",)),
    Advisory(2, r"django.*2\.", "django", "HIGH", "CVE-2023-24580", 7.5,
             "SQL injection vulnerability", anchors=("django",)),
)
MANIFESTS = ("package.json", "requirements.txt", "go.mod", "Gemfile", "pom.xml")


def advisory_rules(advisories: tuple[Advisory, ...]) -> tuple[Rule, ...]:
    """Advisories seen as line rules (``.`` stops at a newline, so a match never spans lines)."""
    return tuple(
        Rule(a.ordinal, "advisory", a.cve, a.pattern, a.severity,
             description=a.description, anchors=a.anchors)
        for a in advisories
    )


def rules_from_table(table: DataFrame, limit: int = 5000) -> tuple[Rule, ...]:
    """Read a user's rule table into rules. The table is configuration: its size is checked.

    Required columns: ordinal, family, type, regex. Optional ones are the other fields of
    :class:`Rule` except ``anchors``.
    """
    optional = [c for c in ("severity", "strict_severity", "description",
                            "vulnerability_class", "confidence_boost") if c in table.columns]
    rows = (table.select("ordinal", "family", "type", "regex", *optional)
            .limit(limit + 1).collect())
    if len(rows) > limit:
        raise ValueError(f"rule table has more than {limit} rows; pass it in several lists")
    given = [{k: v for k, v in r.asDict().items() if v is not None} for r in rows]
    return tuple(sorted((Rule(**g) for g in given), key=lambda r: r.ordinal))
