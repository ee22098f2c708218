"""An index of a folder of papers that is kept up to date by its changes.

``IndexStore`` keeps the tables of ``index_pipeline`` as Parquet, each in ``buckets`` partitions by a hash of its key, and
``update`` brings them up to the folder's state. The result is that of a full build with the registry's ids; the work follows
the change:

- files: a listing alone is read of all; contents are read of files whose time or size differs, and parsed where the digest does;
- names: new names are compared with all, old ones aren't compared again; the canonical names of parts that a new, changed or
  removed name belongs to are worked out anew, of all other names they stay;
- links of papers to bibliography entries: papers that are new, or whose entry is gone, meet all entries; the others meet new entries;
- nodes and edges of papers: those of papers whose record, canonical names or shown metadata changed; shared nodes that these
  papers' edges touch; contrasts and extensions with one of these papers at an end;
- citations and papers of bibliographies: worked out anew, as joins of entries by key, only if an entry, a link or a record changed.

A table's change is two sets of rows, gone and new. Only partitions with a key of either are written, by dynamic partition
overwrite, each with its other rows; ``written`` counts them. A run that dies may leave tables at different states; the snapshot is written
last, so the next ``update`` finds the same changes again, and applying them once more does no harm, as rows are compared with what is there.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph, infer, linking, resolve
from ..operators.profiles import first_by
from ..sources import files
from ..streaming import incremental
from .index import _EMPTY, complete_records, paper_files, parsed_files, shown_metadata, titled, with_metadata
from .stages import settle

__all__ = ["IndexStore", "Update"]

_ITEM = "array<struct<text:string,evidence_text:string,page:bigint,section:string>>"
#: Tables with their columns; the first is the key by which they are dealt.
_TABLES = {
    "snapshot": "path string, sha256 string, size bigint, modified_at timestamp",
    "registry": _EMPTY.replace("workspace_id string, source_path string", "source_path string, workspace_id string"),
    "sections": "path string, paper_id string, title string, name string, page bigint, text string",
    "entries": "source_file string, bib_key string, entry_type string, title string, year bigint, authors array<string>, venue string, doi string, citations string, source_stem string, bib_ord bigint, zotero_key string",
    "records": f"paper_id string, title string, note_title string, source_stem string, year bigint, tasks array<string>, methods array<string>, datasets array<string>, metrics array<string>, contributions {_ITEM}, claims {_ITEM}, limitations {_ITEM}",
    "names": "paper_ord string, entity_type string, name string, canonical string",
    "parts": "name string, entity_type string, part string",
    "links": "paper_id string, bib_ord bigint, rule int",
    "only": "paper_id string, bib_ord bigint, title string, year bigint",
    "shown": "paper_id string, title string, year bigint, authors string, venue string, doi string",
    "nodes": "owner string, " + graph.NODE_COLUMNS,
    "mentions": "target string, kind string, name string, owner string, workspace_id string",
    "edges": "owner string, workspace_id string, type string, source string, target string",
}
_MENTIONED = ("Method", "Task", "Dataset", "Metric", "Author", "Venue")
_CROSS = ("CITES", "CONTRASTS_WITH", "EXTENDS")


@dataclass
class Update:
    """What an update did: changes (path, op), how many files were read and parsed, and rows written by table."""

    changes: DataFrame
    files_read: int = 0
    files_parsed: int = 0
    written: dict[str, int] = field(default_factory=dict)


class IndexStore:
    """Tables of an index in the folder ``path``."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, workspace: str = "default", listed: int = 10_000) -> None:
        self.spark, self.path, self.buckets, self.workspace, self.listed = spark, path.rstrip("/"), buckets, workspace, listed
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        self.fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _raw(self, name: str) -> DataFrame:
        where = f"{self.path}/{name}"
        if not self.fs.exists(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)):
            return self.spark.createDataFrame([], _TABLES[name] + ", bucket int")
        return self.spark.read.schema(_TABLES[name] + ", bucket int").parquet(where)

    def table(self, name: str) -> DataFrame:
        key = _TABLES[name].split(" ", 1)[0]
        return self._raw(name).filter(F.col(key).isNotNull()).drop("bucket")

    def apply(self, name: str, gone: DataFrame, new: DataFrame, done: Update | None = None) -> int:
        """Take rows away from a table and add others; both have its columns. Rows that are in both stay. Returns how many rows were written."""
        columns = [c.strip().split(" ")[0] for c in _TABLES[name].replace(_ITEM, "items").split(",")]
        bucket = F.pmod(F.xxhash64(columns[0]), F.lit(self.buckets)).cast("int")
        signed = lambda df, n: df.select(*columns, F.lit(n).alias("_n"))
        summed = lambda df: df.groupBy(*columns).agg(F.sum("_n").alias("_n"))
        net = settle(summed(signed(gone, -1).union(signed(new, 1))).filter("_n <> 0"))
        touched = sorted(r["b"] for r in net.select(bucket.alias("b")).distinct().collect())  # at most ``buckets``
        if not touched:
            return 0
        here = F.col("bucket").isin(touched)
        kept = signed(self._raw(name).filter(here & F.col(columns[0]).isNotNull()), 1)
        rows = summed(kept.union(net.select(*columns, "_n"))).filter("_n > 0").withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("_n").cast("int")))).drop("_n").withColumn("bucket", bucket)
        # a row without a key for each partition, so that one that lost all rows is overwritten too
        marks = self.spark.range(self.buckets).filter(F.col("id").isin(touched)).select(*[F.lit(None).cast(net.schema[c].dataType).alias(c) for c in columns], F.col("id").cast("int").alias("bucket"))
        rows.union(marks).repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/{name}")
        count = self._raw(name).filter(here & F.col(columns[0]).isNotNull()).count()
        if done is not None:
            done.written[name] = done.written.get(name, 0) + count
        return count

    def _listing(self, root: str, ignore: tuple[str, ...]) -> DataFrame:
        return settle(files.filter_ignored(files.scan_corpus(self.spark, root), root, ignore).select("path", "modified_at", "size"))

    def _contents(self, root: str, wanted: DataFrame) -> DataFrame:
        """(path, modified_at, size, content) of the wanted files. Up to ``listed`` of them are opened by name, more are picked from a scan of files as new as the oldest."""
        paths = [r.path for r in wanted.select("path").limit(self.listed + 1).collect()]
        if len(paths) <= self.listed:
            return files.read_files(self.spark, paths) if paths else self.spark.createDataFrame([], "path string, modified_at timestamp, size bigint, content binary")
        least = wanted.agg(F.min("modified_at")).first()[0]
        return files.scan_corpus(self.spark, root).filter(F.col("modified_at") >= F.lit(least)).join(wanted.select("path"), "path", "left_semi")

    def update(self, root: str, extracted: DataFrame | None = None, ignore: tuple[str, ...] = ()) -> Update:
        """Bring the tables up to the folder's state. ``extracted`` has extraction records by paper_id that are new or changed; others stay while their paper does."""
        before = self.table("snapshot")
        now = self._listing(root, ignore)
        old = before.select("path", F.col("modified_at").alias("_m"), F.col("size").alias("_s"), F.col("sha256").alias("_old"))
        maybe = settle(now.join(old, "path", "left").filter(~(F.col("modified_at").eqNullSafe(F.col("_m")) & F.col("size").eqNullSafe(F.col("_s")))))
        content = settle(self._contents(root, maybe))
        fresh = settle(files.fingerprint_files(content))
        changed = settle(files.detect_changed(fresh, before))
        removed = settle(files.detect_removed(now, before))
        changes = removed.select("path", F.lit("deleted").alias("op")).union(changed.select("path", F.lit("changed").alias("op")))
        done = Update(changes, content.count(), changed.count())
        stale = removed.select("path").union(changed.select("path"))

        registry = self.table("registry")
        lost = settle(registry.join(removed.select(F.col("path").alias("source_path")), "source_path", "left_semi"))
        given = settle(incremental.assign_paper_ids(paper_files(changed, self.workspace), registry))
        mine = registry.join(given.select("workspace_id", "source_path"), ["workspace_id", "source_path"], "left_semi")
        self.apply("registry", lost.union(mine.select(*lost.columns)), incremental.upsert_registry(mine, given.withColumns({"zotero_key": F.lit(""), "doi": F.lit("")})), done)

        sections, entries = parsed_files(content.join(changed.select("path"), "path", "left_semi"), given)
        self.apply("sections", self.table("sections").join(stale, "path", "left_semi"), sections, done)
        gone_entries = settle(self.table("entries").join(stale.withColumnRenamed("path", "source_file"), "source_file", "left_semi"))
        new_entries = settle(entries)
        self.apply("entries", gone_entries, new_entries, done)

        papers = self._records(lost, given, extracted, done)
        if not (papers.isEmpty() and gone_entries.isEmpty() and new_entries.isEmpty()):
            names = self._names(papers, done)
            self._graph(papers, names, gone_entries, new_entries, done)
        times = before.join(fresh.select("path"), "path", "left_semi")
        self.apply("snapshot", before.join(removed.select("path"), "path", "left_semi").union(times), fresh, done)
        return done

    def _records(self, lost: DataFrame, given: DataFrame, extracted: DataFrame | None, done: Update) -> DataFrame:
        """Ids of papers whose record changed; records of the others aren't read but for what ``extracted`` has."""
        stored = self.table("records")
        registry = self.table("registry")
        ids = given.select("paper_id")
        if extracted is not None:
            ids = ids.union(extracted.join(registry.select("paper_id"), "paper_id", "left_semi").select("paper_id")).distinct()
        ids = settle(ids)
        at = registry.join(ids, "paper_id", "left_semi").select("paper_id", "source_path")
        known = titled(at, self.table("sections").join(ids, "paper_id", "left_semi"))
        # a changed file keeps the extraction that its paper has; records without one have a stem
        had = stored.join(ids, "paper_id", "left_semi").filter("source_stem is null").drop("source_stem", "note_title")
        own = had if extracted is None else extracted.unionByName(had.join(extracted.select("paper_id"), "paper_id", "left_anti"), allowMissingColumns=True)
        full = settle(complete_records(known, own).join(known.select("paper_id", F.col("title").alias("note_title")), "paper_id").select(*stored.columns))
        old = settle(stored.join(lost.select("paper_id").union(ids).distinct(), "paper_id", "left_semi"))
        self.apply("records", old, full, done)
        differs = old.exceptAll(full).select("paper_id").union(full.exceptAll(old).select("paper_id")).distinct()
        return settle(differs)

    def _names(self, papers: DataFrame, done: Update) -> DataFrame:
        """Ids of papers whose canonical names changed."""
        stored = settle(self.table("names"))
        mine = lambda df: resolve.name_occurrences(df).select("entity_type", "paper_ord", F.trim("name").alias("name")).filter("name <> ''").distinct()
        own = papers.withColumnRenamed("paper_id", "paper_ord")
        now = settle(mine(self.table("records").join(papers, "paper_id", "left_semi")))
        was = stored.join(own, "paper_ord", "left_semi")
        cols = ["entity_type", "paper_ord", "name"]
        changed = was.select(*cols).exceptAll(now.select(*cols)).union(now.select(*cols).exceptAll(was.select(*cols)))
        changed = settle(changed)
        if changed.isEmpty():
            return papers.limit(0)
        closed = settle(resolve.touched_names(changed.select("entity_type", "name"), self.table("parts")))
        among = lambda df: df.join(closed, ["entity_type", "name"], "left_semi")
        rest = stored.join(own, "paper_ord", "left_anti")
        found, part = resolve.canonicalise_parts(settle(among(rest.select(*cols).union(now.select(*cols)))))
        found, part = settle(found), settle(part)
        old = settle(among(stored))
        self.apply("names", old, found, done)
        self.apply("parts", among(self.table("parts")), part, done)
        columns = ["paper_ord", "entity_type", "name", "canonical"]
        differs = old.select(*columns).exceptAll(found.select(*columns)).union(found.select(*columns).exceptAll(old.select(*columns)))
        return settle(differs.select(F.col("paper_ord").alias("paper_id")).distinct())

    def _links(self, papers: DataFrame, gone: DataFrame, new: DataFrame, done: Update) -> DataFrame:
        """Ids of papers whose link changed. A link is the best of its hits by rule and order, so hits on new entries are put beside those that stay."""
        stored = settle(self.table("links"))
        entries = self.table("entries")
        registry = self.table("registry")
        every = self.table("records").select("paper_id", F.lit("").alias("path"), F.col("note_title").alias("title"), F.lit("").alias("zotero_key"), F.lit("").alias("doi"))
        every = settle(linking.registry_attributes(every, registry))
        open_ = settle(papers.union(stored.join(gone.select("bib_ord"), "bib_ord", "left_semi").select("paper_id")).distinct())
        anew = linking.link_bib(every.join(open_, "paper_id", "left_semi"), entries)
        stay = stored.join(open_, "paper_id", "left_anti")
        beside = linking.link_bib(every.join(open_, "paper_id", "left_anti"), new)
        both = first_by(stay.select("paper_id", "rule", "bib_ord").union(beside.select("paper_id", "rule", "bib_ord")), ["paper_id"], "rule", "bib_ord")
        better = both.join(beside.select("paper_id"), "paper_id", "left_semi")
        fresh = settle(anew.select("paper_id", "rule", "bib_ord").union(better))
        old = settle(stored.join(open_.union(beside.select("paper_id")).distinct(), "paper_id", "left_semi"))
        self.apply("links", old, fresh, done)
        columns = ["paper_id", "rule", "bib_ord"]
        differs = old.select(*columns).exceptAll(fresh.select(*columns)).union(fresh.select(*columns).exceptAll(old.select(*columns)))
        return settle(differs.select("paper_id").distinct())

    def _graph(self, papers: DataFrame, named: DataFrame, gone: DataFrame, new: DataFrame, done: Update) -> None:
        linked = self._links(papers, gone, new, done)
        entries, links = self.table("entries"), settle(self.table("links"))
        bibliography = not (gone.isEmpty() and new.isEmpty() and linked.isEmpty() and papers.isEmpty())
        lone = settle(self.table("only"))
        if bibliography:
            known = self.table("records").select("paper_id")
            only = linking.bib_only_papers(entries, known, links).select("paper_id", "bib_ord", "title", F.coalesce("year", F.lit(-1)).alias("year"))
            only = settle(only)
            self.apply("only", lone, only, done)
        else:
            only = lone
        columns = ["paper_id", "bib_ord", "title", "year"]
        lone_changed = lone.select(*columns).exceptAll(only.select(*columns)).union(only.select(*columns).exceptAll(lone.select(*columns))).select("paper_id")

        # papers whose shown metadata may differ: those above, and those whose entry was parsed again
        at = links.select("paper_id", "bib_ord").union(only.select("paper_id", "bib_ord"))
        reread = at.join(gone.select("bib_ord").union(new.select("bib_ord")).distinct(), "bib_ord", "left_semi").select("paper_id")
        maybe = settle(papers.union(named).union(linked).union(lone_changed).union(reread).distinct())
        among = lambda df, key="paper_id": df.join(maybe.withColumnRenamed("paper_id", key), key, "left_semi")
        records = settle(resolve.with_canonical(among(self.table("records")), among(self.table("names"), "paper_ord")))
        mine = among(only)
        shown = settle(shown_metadata(records, mine, among_entries(entries, at, maybe), among(at)))
        self.apply("shown", among(self.table("shown")), shown, done)

        own = records.drop("title", "year").join(shown.select("paper_id", "title", "year"), "paper_id")
        nodes, edges = graph.extraction_graph(own, self.workspace)
        extra = shown.join(mine.select("paper_id"), "paper_id", "left_semi")
        lonely = extra.select(F.col("paper_id").alias("id"), "title", F.coalesce("year", F.lit(-1)).alias("year"), "authors", "venue", "doi", F.lit(True).alias("metadata_only"), F.lit(self.workspace).alias("workspace_id"))
        nodes = nodes.unionByName(graph.paper_nodes(lonely))
        people = shown.select("paper_id", F.filter(F.split("authors", r"\s*;\s*"), lambda a: a != "").alias("authors"), "venue")
        more_nodes, more_edges = graph.metadata_graph(people, self.workspace)
        nodes, edges = settle(with_metadata(nodes.unionByName(more_nodes), shown)), settle(edges.unionByName(more_edges))

        shared = F.col("type").isin(*_MENTIONED)
        owner = F.when(F.col("type") == "Paper", F.col("id")).otherwise(F.col("paper_id"))
        self.apply("nodes", among(self.table("nodes"), "owner"), first_by(nodes.filter(~shared), ["type", "id"], F.col("metadata_only").asc_nulls_last(), "title").withColumn("owner", owner), done)
        # an edge's owner is its paper: the source, or, of evidence, the item's
        holder = nodes.filter(F.col("paper_id").isNotNull()).select(F.col("id").alias("source"), F.col("paper_id").alias("_p")).distinct()
        mine_edges = settle(edges.join(holder, "source", "left").withColumn("owner", F.coalesce("_p", "source")).drop("_p"))
        stored = among(self.table("edges"), "owner").filter(~F.col("type").isin(*_CROSS))
        self.apply("edges", stored, mine_edges, done)
        self._mentions(own, people, maybe, done)
        self._cross(papers, named, maybe, bibliography, only, done)

    def _mentions(self, own: DataFrame, people: DataFrame, maybe: DataFrame, done: Update) -> None:
        """Nodes that papers share, with the smallest of the names that papers have for them."""
        old = settle(self.table("mentions").join(maybe.withColumnRenamed("paper_id", "owner"), "owner", "left_semi"))
        new = settle(graph.entity_mentions(own, people, self.workspace))
        self.apply("mentions", old, new, done)
        targets = old.select("target").union(new.select("target")).distinct()
        names = self.table("mentions").join(targets, "target", "left_semi").groupBy(F.col("target").alias("id"), "kind", "workspace_id").agg(F.min("name").alias("name"))
        rows = graph.entity_nodes(names).withColumn("owner", F.col("id"))
        self.apply("nodes", self.table("nodes").join(targets.withColumnRenamed("target", "owner"), "owner", "left_semi"), rows, done)

    def _cross(self, papers: DataFrame, named: DataFrame, maybe: DataFrame, bibliography: bool, only: DataFrame, done: Update) -> None:
        """Edges between papers."""
        stored = settle(self.table("edges").filter(F.col("type").isin(*_CROSS)))
        touched = settle(papers.union(named).distinct())
        full = settle(resolve.with_canonical(self.table("records"), self.table("names")).select("paper_id", "tasks", "methods"))
        ends = lambda df: df.join(touched.withColumnRenamed("paper_id", "source"), "source", "left_semi").select(*df.columns).union(df.join(touched.withColumnRenamed("paper_id", "target"), "target", "left_semi").select(*df.columns)).distinct()
        contrasts = infer.infer_contrasts(full, touched)
        both = contrasts.union(contrasts.select(F.col("target").alias("source"), F.col("source").alias("target")))
        gone, new = [ends(stored.filter("type = 'CONTRASTS_WITH'"))], [graph.graph_edges(both, "CONTRASTS_WITH", self.workspace)]
        if bibliography:
            stand = self.table("records").select("paper_id").union(only.select("paper_id"))
            cites = settle(linking.citations_from_bib(self.table("entries"), stand))
            was = stored.filter("type = 'CITES'")
            gone += [was]
            new += [graph.graph_edges(cites, "CITES", self.workspace)]
            moved = was.select("source", "target").exceptAll(cites).union(cites.exceptAll(was.select("source", "target")))
        else:
            cites = settle(stored.filter("type = 'CITES'").select("source", "target"))
            moved = cites.limit(0)
        pairs = settle(moved.union(ends(cites.union(stored.filter("type = 'EXTENDS'").select("source", "target")))).distinct())
        extends = stored.filter("type = 'EXTENDS'")
        gone += [extends.join(pairs, ["source", "target"], "left_semi").select(*extends.columns)]
        new += [graph.graph_edges(infer.infer_extends(full, cites.join(pairs, ["source", "target"], "left_semi")), "EXTENDS", self.workspace)]
        rows = lambda xs: reduce(DataFrame.unionByName, xs)
        self.apply("edges", rows(gone), rows(new).withColumn("owner", F.col("source")), done)

    def graph(self) -> tuple[DataFrame, DataFrame]:
        """Nodes and edges."""
        return self.table("nodes").drop("owner"), self.table("edges").drop("owner")


def among_entries(entries: DataFrame, at: DataFrame, papers: DataFrame) -> DataFrame:
    """Entries of the papers, by (paper_id, bib_ord)."""
    return entries.join(at.join(papers, "paper_id", "left_semi").select("bib_ord").distinct(), "bib_ord", "left_semi")
