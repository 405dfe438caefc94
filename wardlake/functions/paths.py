"""Path predicates: which files a scan looks at."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardlake.rules import MANIFESTS

# Directory names and file extensions each profile leaves out or keeps.
GATE_SKIP_PARTS = (".git", "node_modules", "vendor", ".venv", "__pycache__", "dist", "build")
GATE_SKIP_SUFFIXES = (".jpg", ".png", ".gif", ".pdf", ".zip", ".exe", ".so", ".dylib", ".dll")
STRICT_SKIP_DIRS = (".git", "node_modules", "target", ".cargo", "__pycache__", "build", "dist")
STRICT_SKIP_EXTS = ("jpg", "jpeg", "png", "gif", "bmp", "ico", "pdf", "zip", "tar", "gz", "exe",
                    "dll", "so", "dylib")
API_SOURCE_EXTS = (".rs", ".go", ".py", ".js", ".ts", ".java", ".cpp", ".c", ".h")
REPO_SKIP_DIRS = (".git", "node_modules", "target", "__pycache__", ".cargo")
REPO_SOURCE_EXTS = ("rs", "js", "ts", "py", "go", "java")


def relative_path(base: Column, full: Column) -> Column:
    """``full`` below ``base``; the full path when it lies elsewhere."""
    root = F.concat(F.rtrim(base, F.lit("/")), F.lit("/"))
    below = F.substring(full, F.char_length(root) + 1, F.char_length(full))
    return F.when(full.startswith(root), below).otherwise(full)


def path_order(path: Column) -> Column:
    """Sort key of a directory walk: names are compared level by level."""
    return F.split(path, "/")


def dotted_extension(path: Column) -> Column:
    """From the last dot of the file name on, dot included; dot files count as all extension."""
    return F.regexp_extract(path, r"\.[^./]*\z", 0)


def bare_extension(path: Column) -> Column:
    """Extension without its dot; a leading dot does not start an extension."""
    return F.regexp_extract(path, r"[^/]\.([^./]*)\z", 1)


def _either(words: tuple[str, ...]) -> str:
    return "(?:" + "|".join(re.escape(w) for w in words) + ")"


def _in_directory(rel_path: Column, names: tuple[str, ...]) -> Column:
    # A directory is a whole path element followed by a slash.
    return rel_path.rlike(f"(?:\\A|/){_either(names)}/")


def gate_skips(path: Column) -> Column:
    """Substring test on the whole path, so ``builder.go`` and ``.github/`` are left out too."""
    return path.rlike(f"{_either(GATE_SKIP_PARTS)}|{_either(GATE_SKIP_SUFFIXES)}\\z")


def strict_skips(rel_path: Column) -> Column:
    """Exact directory names below the root, exact extensions."""
    return _in_directory(rel_path, STRICT_SKIP_DIRS) | bare_extension(rel_path).isin(
        *STRICT_SKIP_EXTS)


def is_api_source(path: Column) -> Column:
    return dotted_extension(path).isin(*API_SOURCE_EXTS)


def is_repo_source(rel_path: Column) -> Column:
    return bare_extension(rel_path).isin(*REPO_SOURCE_EXTS) & ~_in_directory(
        rel_path, REPO_SKIP_DIRS)


def is_manifest(rel_path: Column) -> Column:
    """One of the five dependency files, at the repository root only."""
    return rel_path.isin(*MANIFESTS)
