"""All gate findings of a scan in one pass over its lines.

Secrets, dependencies and code issues are three rule families tried on the same exploded
lines, so the files are read once. The result is one row per finding:

    <scan key>, family (0 secrets, 1 cves, 2 code issues), f struct<walk position, payload>

One aggregation folds duplicates of every family: secrets by match hash within the
repository, advisories by manifest, code issues not at all (their key is their place).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardlake.functions import paths, text as tx
from wardlake.operators import code, secrets
from wardlake.operators.matching import match_rules, rule_value, with_rule_columns
from wardlake.rules import (ADVISORIES, CODE_RULES, MANIFESTS, SECRET_RULES, Advisory, Rule,
                            advisory_rules)
from wardlake.schemas import SCAN_KEY
from wardlake.sources.files import explode_lines, with_rel_path

SECRET_FAMILY, CVE_FAMILY, CODE_FAMILY = 0, 1, 2


def scan_findings(files: DataFrame, secret_rules: Sequence[Rule] = SECRET_RULES,
                  code_rules: Sequence[Rule] = CODE_RULES,
                  advisories: Sequence[Advisory] = ADVISORIES) -> DataFrame:
    rules = [*secret_rules, *advisory_rules(advisories), *code_rules]
    n_secret, n_advisory = len(secret_rules), len(advisories)

    looked_at = (with_rel_path(files)
                 .withColumn("scanned", ~paths.gate_skips(F.col("path")))
                 .withColumn("is_manifest", paths.is_manifest(F.col("rel_path")))
                 .where("scanned or is_manifest").drop("rel_path"))
    lines = explode_lines(looked_at, False, "scanned", "is_manifest")
    hits = match_rules(lines, rules, gates={"secret": F.col("scanned"),
                                            "code": F.col("scanned"),
                                            "advisory": F.col("is_manifest")},
                       extract={"secret"})

    rule = F.col("rule")
    family = (F.when(rule < n_secret, SECRET_FAMILY)
              .when(rule < n_secret + n_advisory, CVE_FAMILY).otherwise(CODE_FAMILY))
    typed = with_rule_columns(hits, rules).withColumn("family", family)
    wrong = (F.when(F.col("family") == SECRET_FAMILY, secrets.gate_false_positive())
             .when(F.col("family") == CODE_FAMILY, code.legitimate()).otherwise(False))
    scored = secrets.with_confidence(typed.where(~wrong), rules)

    is_secret, is_cve = F.col("family") == SECRET_FAMILY, F.col("family") == CVE_FAMILY
    score = F.when(is_secret, F.col("confidence"))
    place = F.concat_ws(":", "rel_path", "line", "ordinal")
    fold_key = (F.when(is_secret, tx.match_hash(F.col("match")))
                .when(is_cve, F.concat_ws(":", "rel_path", "ordinal")).otherwise(place))
    # Dependencies come in the order of the manifest list, whatever their place in a file.
    position = F.struct(
        F.when(is_cve, F.array_position(F.array(*(F.lit(m) for m in MANIFESTS)),
                                        F.col("rel_path")).cast("int")).otherwise(0)
        .alias("rank"),
        F.when(is_cve, F.array().cast("array<string>"))
        .otherwise(paths.path_order(F.col("rel_path"))).alias("path_arr"),
        F.when(is_cve, 0).otherwise(F.col("line")).alias("at"), F.col("ordinal"))

    def advisory_value(field: str, kind: str) -> Column:
        values = [F.lit(getattr(a, field)).cast(kind) for a in advisories]
        at = F.col("rule") - n_secret + 1
        return F.when(is_cve, F.element_at(F.array(*values), at)) if values else F.lit(
            None).cast(kind)

    finding = F.struct(
        position.alias("pos"), F.col("rel_path").alias("file"), F.col("line"), F.col("type"),
        rule_value(rules, "severity").alias("severity"),
        F.when(is_secret, tx.mask_gate(F.col("match"))).alias("match"),
        F.when(is_secret, tx.match_hash(F.col("match"))).alias("match_hash"),
        score.alias("confidence"),
        F.when(~is_secret, rule_value(rules, "description")).alias("description"),
        advisory_value("package", "string").alias("package"),
        advisory_value("cvss", "double").alias("cvss"))
    folded = (scored.select(*SCAN_KEY, "family", fold_key.alias("fold_key"), finding.alias("f"))
              .groupBy(*SCAN_KEY, "family", "fold_key").agg(F.min("f").alias("f")))
    return folded.select(*SCAN_KEY, "family", "f")


def secrets_of(findings: DataFrame) -> DataFrame:
    return findings.where(F.col("family") == SECRET_FAMILY).select(
        *SCAN_KEY, "f.file", "f.line", "f.type", "f.severity", "f.match", "f.match_hash",
        "f.confidence")


def cves_of(findings: DataFrame) -> DataFrame:
    return findings.where(F.col("family") == CVE_FAMILY).select(
        *SCAN_KEY, F.col("f.file").alias("manifest"), "f.package", "f.severity",
        F.col("f.type").alias("cve"), "f.description", "f.cvss")


def code_issues_of(findings: DataFrame) -> DataFrame:
    return findings.where(F.col("family") == CODE_FAMILY).select(
        *SCAN_KEY, "f.file", "f.line", "f.type", "f.severity", "f.description")
