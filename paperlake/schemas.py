"""Schemas of the graph's tables and of its inputs."""

from __future__ import annotations

__all__ = ["BIB", "EVIDENCE", "EXTRACTION", "ITEM", "PAPER", "REGISTRY", "SNAPSHOT"]

EVIDENCE = "array<struct<text:string,evidence_text:string,page:bigint,section:string>>"
#: Extraction records as tables; list fields may be missing.
EXTRACTION = (
    "paper_id string, title string, year bigint, source_path string, source_stem string, tasks array<string>, methods array<string>, datasets array<string>, metrics array<string>, "
    f"contributions {EVIDENCE}, claims {EVIDENCE}, limitations {EVIDENCE}"
)
PAPER = "id string, title string, year bigint, authors string, venue string, doi string, metadata_only boolean, source_path string, source_stem string, content_hash string, source_ref string, zotero_key string, workspace_id string"
ITEM = "id string, text string, paper_id string, page bigint, section string, evidence_text string, workspace_id string"
BIB = "bib_key string, entry_type string, title string, year bigint, authors array<string>, venue string, doi string, citations string, source_file string, source_stem string, zotero_key string, zotero_version bigint, url string"
REGISTRY = "workspace_id string, source_path string, paper_id string, content_hash string, source_ref string, zotero_key string, doi string, assigned_at timestamp, updated_at timestamp"
SNAPSHOT = "path string, sha256 string, size bigint, modified_at timestamp"
