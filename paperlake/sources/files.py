"""Folders of papers: scanning, ignoring, fingerprints, and differences between scans."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

__all__ = ["DEFAULT_IGNORE", "detect_changed", "detect_removed", "filter_ignored", "fingerprint_files", "glob_to_regex", "parse_targets", "read_files", "route_sources", "scan_corpus", "skip_unchanged"]

#: Patterns that are always ignored (fixed values).
DEFAULT_IGNORE = ("**/.git/**", "**/__pycache__/**", "**/~$*", "**/*.tmp", "**/.#*", "**/Thumbs.db", "**/.DS_Store")


def scan_corpus(spark: SparkSession, root: str) -> DataFrame:
    """(path, modified_at, size, content) of all PDF, BibTeX and Markdown files below a folder."""
    suffixes = "*.{[pP][dD][fF],[bB][iI][bB],[mM][dD]}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", suffixes).load(root)
    return files.select("path", F.col("modificationTime").alias("modified_at"), F.col("length").alias("size"), "content")


def read_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(path, modified_at, size, content) of files given by name."""
    literal = [re.sub(r"([\\*?\[\]{}])", r"\\\1", p) for p in paths]
    files = spark.read.format("binaryFile").load(literal)
    return files.select("path", F.col("modificationTime").alias("modified_at"), F.col("length").alias("size"), "content")


def glob_to_regex(pattern: str) -> str:
    """A pattern of an ignore file as a regular expression over relative paths with ``/``."""
    body, out, i = pattern.rstrip("/"), "", 0
    anchored = "/" in body
    body = body.lstrip("/")
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("/**", i) and i + 3 == len(body):
            out, i = out + "/.*", i + 3
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(body[i]), i + 1
    return f"^{'' if anchored else '(?:.*/)?'}{out}(?:/.*)?$"


def filter_ignored(files: DataFrame, root: str, patterns: Sequence[str] = ()) -> DataFrame:
    """Files below ``root`` that no pattern ignores; the last pattern that matches wins, ``!`` takes back. Schemes and hosts of paths don't count."""
    scheme = r"^[a-zA-Z][a-zA-Z0-9+.-]*:(//[^/]*)?"
    clean = re.sub(scheme, "", root).rstrip("/") + "/"
    plain = F.regexp_replace("path", scheme, "")
    relative = F.when(plain.startswith(clean), F.substring(plain, len(clean) + 1, 1 << 20))
    ignored: Column = F.lit(False)
    for p in (*DEFAULT_IGNORE, *(x.strip() for x in patterns if x.strip() and not x.startswith("#"))):
        ignored = F.when(relative.rlike(glob_to_regex(p.removeprefix("!"))), F.lit(not p.startswith("!"))).otherwise(ignored)
    return files.filter(relative.isNotNull() & ~ignored)


def fingerprint_files(files: DataFrame) -> DataFrame:
    """Snapshot (path, sha256, size, modified_at)."""
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.length("content").cast("long").alias("size"), "modified_at")


def detect_changed(now: DataFrame, before: DataFrame) -> DataFrame:
    """Rows of the new snapshot whose path is new or whose digest differs."""
    old = before.select("path", F.col("sha256").alias("_old"))
    return now.join(old, "path", "left").filter(~F.col("sha256").eqNullSafe(F.col("_old"))).drop("_old")


def detect_removed(now: DataFrame, before: DataFrame) -> DataFrame:
    """Rows of the old snapshot whose path is gone."""
    return before.join(now.select("path"), "path", "left_anti")


def skip_unchanged(files: DataFrame, parsed: DataFrame) -> DataFrame:
    """Files for which no parse of the same content exists."""
    return files.join(parsed.select("path", "sha256"), ["path", "sha256"], "left_anti")


def parse_targets(files: DataFrame, changed: DataFrame | None = None) -> DataFrame:
    """All files, or those in a table of changed paths."""
    return files if changed is None else files.join(changed.select("path"), "path", "left_semi")


def route_sources(refs: DataFrame) -> DataFrame:
    """``refs`` (reference) with its ``kind`` and canonical ``source_ref``."""
    r = F.trim("reference")
    from ..functions.text import normalize_arxiv_id, remote_pdf_ref

    arxiv = normalize_arxiv_id(r)
    kind = (
        F.when(r.startswith("bytes://"), "bytes").when(r.rlike(r"(?i)^(arxiv:|https?://(www\.)?arxiv\.org/)") & arxiv.isNotNull(), "arxiv")
        .when(r.rlike(r"(?i)^https?://"), "url").when(r.rlike(r"(?i)^zotero:"), "library").otherwise("local")
    )
    return refs.withColumn("kind", kind).withColumn(
        "source_ref", F.when(F.col("kind") == "arxiv", F.concat(F.lit("arxiv://"), arxiv)).when(F.col("kind") == "url", F.coalesce(remote_pdf_ref(r), r)).otherwise(r)
    )
