"""Ids and slugs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import author_surname, non_empty

__all__ = ["entity_id", "evidence_id", "item_id", "metadata_slug", "path_stem", "path_stem_slug", "slug"]


def slug(c: Column, limit: int = 48) -> Column:
    """Lower case, other characters as one underscore, cut; ``unknown`` if nothing is left."""
    strip = lambda x: F.regexp_replace(x, "^_+|_+$", "")
    return F.coalesce(non_empty(strip(F.substring(strip(F.regexp_replace(F.lower(c), "[^a-zA-Z0-9_]+", "_")), 1, limit))), F.lit("unknown"))


def metadata_slug(title: Column, doi: Column, year: Column, author: Column) -> Column:
    """``doi_...`` if there is a DOI, else surname, year and title of a paper; 80 characters at most."""
    plain = non_empty(F.regexp_replace(F.regexp_replace(F.lower(F.trim(doi)), "[^a-z0-9]+", "_"), "^_+|_+$", ""))
    name = F.coalesce(F.when(F.trim(author) != "", slug(author_surname(author), 24)), F.lit("unknown"))
    known = F.when(year > 0, year.cast("string")).otherwise("unknown")
    words = slug(F.substring(F.coalesce(non_empty(title), F.lit("untitled")), 1, 80), 40)
    return F.substring(F.coalesce(F.concat(F.lit("doi_"), plain), F.concat_ws("_", name, known, words)), 1, 80)


def entity_id(kind: Column, name: Column, workspace: Column) -> Column:
    """Type and 12 hex characters of the digest of workspace, type and folded name."""
    folded = F.regexp_replace(F.lower(F.trim(name)), r"(?U)\s+", " ")
    return F.concat(F.lower(kind), F.lit("_"), F.substring(F.sha2(F.concat_ws(":", workspace, kind, folded), 256), 1, 12))


def item_id(kind: Column, paper_id: Column, position: Column) -> Column:
    """``claim_<paper>_007`` for position 7."""
    return F.concat_ws("_", kind, paper_id, F.when(position < 1000, F.lpad(position.cast("string"), 3, "0")).otherwise(position.cast("string")))


def evidence_id(kind: Column, paper_id: Column, position: Column) -> Column:
    return F.concat(F.lit("evidence_"), item_id(kind, paper_id, position))


def path_stem(path: Column) -> Column:
    """Name of a file without folders and the last suffix; slashes of both kinds count."""
    name = F.element_at(F.split(path, r"[/\\]"), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def path_stem_slug(path: Column) -> Column:
    """Slug of the stem; notes lose their suffix."""
    stem = path_stem(path)
    stem = F.when(F.lower(path).endswith(".md"), F.regexp_replace(stem, "[_-]notes$", "")).otherwise(stem)
    return F.coalesce(non_empty(F.lower(F.regexp_replace(F.regexp_replace(stem, "[^a-zA-Z0-9_]+", "_"), "^_+|_+$", ""))), F.lit("paper_unknown"))
