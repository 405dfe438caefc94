"""Explicit schemas. Nothing in this package infers a schema on read."""

from __future__ import annotations

from pyspark.sql import types as T

SCAN_KEY = ["repo_path", "branch", "commit_hash"]

_S, _I, _D, _B, _TS = (T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType(),
                       T.TimestampType())


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in fields.items()])


REQUEST = _struct(
    repo_path=_S, branch=_S, commit_hash=_S, scan_ts=_TS, deploy_env=_S, environment=_S,
    approved_by=_S, emergency_approved=_B,
    scanners=T.MapType(_S, _struct(status=_S)),
)
FILE = _struct(repo_path=_S, branch=_S, commit_hash=_S, path=_S, content=_S)

SECRET = _struct(file=_S, line=_I, type=_S, severity=_S, match=_S, confidence=_D)
CVE = _struct(package=_S, severity=_S, cve=_S, description=_S, cvss=_D)
CODE_ISSUE = _struct(file=_S, line=_I, type=_S, severity=_S, description=_S)
POLICY_RESULT = _struct(passed=_B, violations=T.ArrayType(_S), warnings=T.ArrayType(_S))
SCAN_RESULT = _struct(
    timestamp=_TS, repo_path=_S, branch=_S, commit_hash=_S, file=_S, risk_score=_I, risk_level=_S,
    passed=_B, secrets=T.ArrayType(SECRET), cves=T.ArrayType(CVE),
    code_issues=T.ArrayType(CODE_ISSUE), policy_result=POLICY_RESULT, summary=_S,
)
ADVANCED_FINDING = _struct(
    file=_S, line=_I, column=_I, finding_type=_S, severity=_S, description=_S,
    confidence=_D, code_context=_S, vulnerability_class=_S,
)

SNAPSHOT_LINE = _struct(host=_S, tick_ts=_TS, seq=_I, line=_S)
FILE_MTIME = _struct(host=_S, tick_ts=_TS, path=_S, mtime=_TS)
ANOMALY = _struct(host=_S, tick_ts=_TS, anomaly_type=_S, severity=_S, description=_S,
                  details=_S, action=_S)
ANOMALY_ITEM = _struct(anomaly_type=_S, severity=_S, description=_S, details=_S, action=_S)
ROLLBACK = _struct(host=_S, tick_ts=_TS, reason=_S, anomalies=T.ArrayType(ANOMALY_ITEM))
