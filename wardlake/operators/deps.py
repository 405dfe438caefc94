"""Known-vulnerable dependencies named in a repository's manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardlake.functions.text import contains_any
from wardlake.rules import ADVISORIES, Advisory, spell
from wardlake.schemas import SCAN_KEY
from wardlake.sources.files import manifest_files

CVE_FIELDS = ("package", "severity", "cve", "description", "cvss")


def cve_findings(files: DataFrame, advisories: Sequence[Advisory] = ADVISORIES) -> DataFrame:
    """One row per (manifest, advisory) whose pattern occurs in the manifest."""
    content = F.col("content")

    def applies(a: Advisory):
        hit = content.rlike(spell(a.pattern))
        return contains_any(content, a.anchors) & hit if a.anchors else hit

    found = F.array_compact(F.array(*(
        F.when(applies(a), F.struct(
            F.lit(a.ordinal).alias("ordinal"),
            *(F.lit(getattr(a, f)).alias(f) for f in CVE_FIELDS)))
        for a in advisories)))
    return (manifest_files(files)
            .select(*SCAN_KEY, F.col("rel_path").alias("manifest"), F.inline(found))
            .select(*SCAN_KEY, "manifest", *CVE_FIELDS))
