"""From a folder of papers to a graph, and changes of the folder after that."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import path_stem
from ..operators import graph, linking, resolve
from ..sources import files, records
from ..streaming import incremental
from .stages import settle

__all__ = ["Indexed", "canonical_graph", "complete_records", "index_pipeline", "paper_files", "parsed_files", "process_folder", "remove_paths", "shown_metadata", "titled", "with_metadata"]

_EMPTY = "workspace_id string, source_path string, paper_id string, content_hash string, source_ref string, zotero_key string, doi string, assigned_at timestamp, updated_at timestamp"


@dataclass
class Indexed:
    """Tables that an index run leaves."""

    snapshot: DataFrame
    registry: DataFrame
    sections: DataFrame
    entries: DataFrame
    nodes: DataFrame
    edges: DataFrame
    stats: DataFrame | None = None


def canonical_graph(
    records: DataFrame, papers: DataFrame, entries: DataFrame, registry: DataFrame | None = None, references: DataFrame | None = None, enrichment: DataFrame | None = None,
    catalog: DataFrame | None = None, decisions: DataFrame | None = None, workspace: str = "default", vectors: DataFrame | None = None, cite_by_links: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and statistics of extraction ``records`` and bibliography ``entries``.

    Names become canonical in the order of paper ids; ``papers`` (paper_id, path, title, zotero_key, doi), under the
    registry's values, are linked to entries; a linked paper takes the entry's metadata, under that of
    ``enrichment`` (paper_id, title, year, authors, venue, doi); the other entries become papers of their own;
    citations come from entries and from ``references`` (ref_id, paper_id, doi, title, year, authors). An entry cites by
    its key or stem, where that is a paper's id; with ``cite_by_links`` for the paper that it is linked to, by whatever rule. ``vectors``
    (paper_id, embedding) of papers of the build are counted.
    """
    full, found = resolve.canonical_records(records, catalog, decisions)
    full = settle(full)
    known = settle(papers if registry is None else linking.registry_attributes(papers, registry))
    links = settle(linking.link_bib(known, entries))
    only = settle(linking.bib_only_papers(entries, known, links))
    stand = known.select("paper_id").union(only.select("paper_id"))
    at = links.select("paper_id", "bib_ord").union(only.select("paper_id", "bib_ord"))
    from_bib = settle(linking.citations_from_bib(entries, stand, at if cite_by_links else None))
    shown = settle(shown_metadata(full, only, entries, at, enrichment))
    own = shown.join(only.select("paper_id"), "paper_id", "left_anti")
    people = lambda df: df.select("paper_id", F.filter(F.split("authors", r"\s*;\s*"), lambda a: a != "").alias("authors"), "venue")
    cites, from_references = from_bib, None
    if references is not None:
        from_references = settle(linking.citations_from_references(references, shown))
        cites = linking.merge_citations(from_bib, from_references)
    records_ = full.drop("title", "year").join(own.select("paper_id", "title", "year"), "paper_id")
    extra = people(shown).join(shown.select("paper_id", "title", "year", "doi"), "paper_id").join(only.select("paper_id"), "paper_id", "left_semi")
    nodes, edges = graph.build_graph(records_, settle(cites), extra, people(shown), workspace)
    nodes, edges = settle(with_metadata(nodes, shown)), settle(edges)
    told = None if vectors is None else vectors.join(stand, "paper_id", "left_semi")
    return nodes, edges, graph.build_stats(nodes, edges, found, links, from_bib, from_references, told, decisions)


_TEXTS = ("authors", "venue", "doi")


def shown_metadata(records: DataFrame, only: DataFrame, entries: DataFrame, at: DataFrame, enrichment: DataFrame | None = None) -> DataFrame:
    """(paper_id, title, year, authors, venue, doi) of papers of ``records`` and of bibliographies (``only``), under the values of the entry they are ``at`` (paper_id, bib_ord)."""
    meta = entries.join(at, "bib_ord").select("paper_id", "title", F.coalesce("year", F.lit(-1)).alias("year"), F.array_join(F.coalesce("authors", F.array().cast("array<string>")), "; ").alias("authors"), "venue", "doi")
    blank = [F.lit("").alias(c) for c in _TEXTS]
    bare = records.select("paper_id", "title", F.coalesce("year", F.lit(-1)).alias("year"), *blank)
    return linking.overlay_metadata(bare.unionByName(only.select("paper_id", "title", "year", *blank)), meta, enrichment)


def with_metadata(nodes: DataFrame, shown: DataFrame) -> DataFrame:
    """Paper nodes with authors, venue and DOI as shown."""
    out = nodes.join(shown.select(F.col("paper_id").alias("id"), *[F.col(c).alias(f"_{c}") for c in _TEXTS]), "id", "left")
    paper = F.col("type") == "Paper"
    return out.withColumns({c: F.when(paper, F.coalesce(f"_{c}", c)).otherwise(F.col(c)) for c in _TEXTS}).select(*nodes.columns)


def remove_paths(done: Indexed, gone: DataFrame, workspace: str = "default") -> Indexed:
    """What an index run left, without the files ``gone`` (path): their snapshot and registry rows, sections, entries, and papers with all that hangs on them.

    Papers that entries of a removed bibliography stood for stay until the graph is built again.
    """
    lost = done.registry.join(gone.select(F.col("path").alias("source_path")), "source_path", "left_semi").select("paper_id", "workspace_id")
    nodes, edges = graph.delete_papers(done.nodes, done.edges, lost)
    return Indexed(
        done.snapshot.join(gone.select("path"), "path", "left_anti"), done.registry.join(gone.select(F.col("path").alias("source_path")), "source_path", "left_anti"), done.sections.join(gone.select("path"), "path", "left_anti"),
        done.entries.join(gone.select(F.col("path").alias("source_file")), "source_file", "left_anti"), nodes, edges,
    )


def process_folder(spark: SparkSession, root: str, before: Indexed, extracted: DataFrame | None = None, **options) -> tuple[Indexed, DataFrame]:
    """What an index run leaves after changes of the folder, and the changes (path, op): removals first, then, if any file is new or differs, a new build that keeps ids.

    ``upkeep.IndexStore`` keeps the tables in a folder instead and works on what changed alone.
    """
    now = settle(files.fingerprint_files(files.filter_ignored(files.scan_corpus(spark, root), root, options.get("ignore", ()))))
    changes = settle(incremental.process_changes(now, before.snapshot))
    left = remove_paths(before, changes.filter("op = 'deleted'").select("path"), options.get("workspace", "default"))
    if changes.isEmpty():
        return before, changes
    return index_pipeline(spark, root, extracted, registry=settle(left.registry), **options), changes


def paper_files(snapshot: DataFrame, workspace: str = "default") -> DataFrame:
    """Files of a snapshot that are papers, as ``assign_paper_ids`` takes them."""
    return snapshot.filter(~F.lower("path").endswith(".bib")).select(F.lit(workspace).alias("workspace_id"), F.col("path").alias("source_path"), F.col("sha256").alias("content_hash"), F.col("path").alias("source_ref"))


def parsed_files(found: DataFrame, given: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sections and entries of files (path, content); ``given`` (source_path, paper_id) has the ids of notes."""
    texts = found.select("path", F.decode("content", "UTF-8").alias("text"))
    notes = records.markdown_sections(texts.filter(F.lower("path").endswith(".md"))).drop("paper_id")
    parsed = records.parse_bibtex(texts.filter(F.lower("path").endswith(".bib")))
    order = F.shiftleft(F.pmod(F.xxhash64("source_file"), F.lit(1 << 40)), 20) + F.col("bib_ord")
    return notes.join(given.select(F.col("source_path").alias("path"), "paper_id"), "path"), parsed.withColumns({"bib_ord": order, "zotero_key": F.lit(None).cast("string")})


def titled(given: DataFrame, sections: DataFrame) -> DataFrame:
    """(paper_id, title, source_stem, path) of papers: the note's title, else the file's stem."""
    titles = sections.groupBy("paper_id").agg(F.min("title").alias("title"))
    return given.join(titles, "paper_id", "left").select("paper_id", F.coalesce("title", path_stem(F.col("source_path"))).alias("title"), path_stem(F.col("source_path")).alias("source_stem"), F.col("source_path").alias("path"))


def complete_records(known: DataFrame, extracted: DataFrame | None) -> DataFrame:
    """An extraction record for each paper of ``known``, empty where ``extracted`` has none."""
    bare = known.select("paper_id", "title", "source_stem")
    empty = F.array().cast("array<string>")
    full = records.stub_extractions(bare, extracted.join(known.select("paper_id"), "paper_id", "left_semi")) if extracted is not None else bare
    items = "array<struct<text:string,evidence_text:string,page:bigint,section:string>>"
    for name, kind in [*((k, "array<string>") for k in ("tasks", "methods", "datasets", "metrics")), *((k, items) for k in ("contributions", "claims", "limitations")), ("year", "bigint")]:
        value = F.col(name) if name in full.columns else F.lit(None).cast(kind)
        full = full.withColumn(name, F.coalesce(value, empty) if kind == "array<string>" else value)
    return full


def index_pipeline(spark: SparkSession, root: str, extracted: DataFrame | None = None, registry: DataFrame | None = None, references: DataFrame | None = None, workspace: str = "default", ignore: tuple[str, ...] = (), vectors: DataFrame | None = None) -> Indexed:
    """Scan, parse notes and bibliographies, link, and build the graph.

    ``extracted`` has extraction records by paper_id; papers without one become papers with empty lists.
    ``references`` (ref_id, paper_id, doi, title, year, authors) are those of parsed papers, if any.
    """
    found = files.filter_ignored(files.scan_corpus(spark, root), root, ignore)
    snapshot = settle(files.fingerprint_files(found))
    registry = spark.createDataFrame([], _EMPTY) if registry is None else registry
    given = settle(incremental.assign_paper_ids(paper_files(snapshot, workspace), registry))
    registry = settle(incremental.upsert_registry(registry, given.withColumns({"zotero_key": F.lit(""), "doi": F.lit("")})))
    sections, entries = (settle(x) for x in parsed_files(found, given))
    known = titled(given, sections)
    full = settle(complete_records(known, extracted))
    papers_ = known.select("paper_id", "path", "title", F.lit("").alias("zotero_key"), F.lit("").alias("doi"))
    nodes, edges, stats = canonical_graph(full, papers_, entries, registry, references, workspace=workspace, vectors=vectors)
    return Indexed(snapshot, registry, sections, entries, nodes, edges, stats)
