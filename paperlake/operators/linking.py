"""Linking papers to bibliography entries, references to papers, and names to papers.

Cascades of rules run as one equi-join a rule, tagged with the rule's priority; the best hit of each
left row is kept. Rules that compare texts meet only rows that share a blocking key.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import path_stem
from ..functions.text import author_surname, character_bag, common_share, non_empty, normalize_paper_ref, normalize_text, ratio_bound, sequence_ratio, split_citation_keys, titles_compatible
from ..plans.stages import settle
from .profiles import first_by

__all__ = [
    "bib_only_papers", "citations_from_bib", "citations_from_references", "did_you_mean", "link_bib", "match_references", "merge_citations", "missing_ids", "overlay_metadata", "registry_attributes", "resolve_identity", "resolve_paper_ref",
]


def _hits(left: DataFrame, right: DataFrame, rule: int, left_key: Column, right_key: Column, keep: list[str], ids: list[str]) -> DataFrame:
    """Rows of both sides with one non-empty key."""
    a = left.select(*ids, non_empty(left_key).alias("_k")).filter("_k is not null")
    b = right.select(*keep, non_empty(right_key).alias("_k")).filter("_k is not null")
    return a.join(b, "_k").drop("_k").withColumn("rule", F.lit(rule))


def _grams(title: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(title) - 2, F.lit(1))), lambda i: F.substring(title, i, 3)))


_END = 16  # characters of a cut word that are looked up


def _keys(title: Column) -> Column:
    """What a title of two words or more leaves in each that holds it: its inner words, the end of a word, the start of a word."""
    words = F.split(title, " ")
    inner = F.transform(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), lambda w: F.concat(F.lit("w"), w))
    return F.array_distinct(F.concat(inner, F.array(F.concat(F.lit("e"), F.right(F.element_at(words, 1), F.lit(_END))), F.concat(F.lit("s"), F.left(F.element_at(words, -1), F.lit(_END))))))


def _units(title: Column) -> Column:
    """The words of a title with all their ends and starts up to ``_END`` characters, each marked."""
    words = F.split(title, " ")
    cut = lambda mark, side: F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.least(F.length(w), F.lit(_END)), F.lit(1))), lambda n: F.concat(F.lit(mark), side(w, n)))))
    return F.array_distinct(F.concat(F.transform(words, lambda w: F.concat(F.lit("w"), w)), cut("e", F.right), cut("s", F.left)))


def _within(small: DataFrame, large: DataFrame, s_title: str, l_title: str, s_ids: list[str], l_ids: list[str], keys, units) -> DataFrame:
    """Pairs in which the large title has the small one's rarest key among its units; a key that no title has tells that none holds the small one.

    Exploded rows are many more than the planner's sizes tell, so none of them is broadcast.
    """
    rows = large.select(*l_ids, l_title, F.explode(units(F.col(l_title))).alias("_u")).hint("merge")
    asked = small.select(*s_ids, s_title, F.explode(keys(F.col(s_title))).alias("_u")).hint("merge")
    seen = rows.select("_u").hint("merge").join(asked.select("_u").distinct().hint("merge"), "_u", "left_semi").groupBy("_u").agg(F.count("*").alias("_n"))
    rare = first_by(asked.join(seen.hint("merge"), "_u", "left").withColumn("_n", F.coalesce("_n", F.lit(0))), s_ids, "_n", "_u").filter("_n > 0")
    return rare.select(*s_ids, s_title, "_u").hint("merge").join(rows, "_u").drop("_u")


def _contained(a: DataFrame, b: DataFrame, a_title: str, b_title: str, a_ids: list[str], b_ids: list[str]) -> DataFrame:
    """A superset of the pairs of normalised titles of which one holds the other.

    A title within another may be cut in words at its ends, but its inner words are whole words of the other, its first
    word ends one of the other's and its last word starts one. So titles of two words or more meet titles with the rarest of
    these, single words titles with the rarest of their runs of three characters; titles under three characters meet equal ones.
    """
    columns = [*a_ids, a_title, *b_ids, b_title]
    out = a.join(b, F.col(a_title) == F.col(b_title)).select(*columns)
    for small, large, args in ((a, b, (a_title, b_title, a_ids, b_ids)), (b, a, (b_title, a_title, b_ids, a_ids))):
        many = F.contains(F.col(args[0]), F.lit(" "))
        out = out.union(_within(small.filter(many), large.filter(F.contains(F.col(args[1]), F.lit(" "))), *args, _keys, _units).select(*columns))
        out = out.union(_within(small.filter(~many & (F.length(args[0]) >= 3)), large.filter(F.length(args[1]) >= 3), *args, _grams, _grams).select(*columns))
    return out.distinct()


def link_bib(papers: DataFrame, entries: DataFrame) -> DataFrame:
    """(paper_id, bib_ord, rule) of ``papers`` (paper_id, path, title, zotero_key, doi) and ``entries`` (bib_ord, ...).

    Rules in order: file stem, library key in the stem, registry key, DOI, key equal to the id, compatible
    title. Within a rule the first entry wins. Empty keys never match, not even each other.
    """
    keep, ids = ["bib_ord"], ["paper_id"]
    stem = path_stem(F.col("path"))
    library = non_empty(F.regexp_extract(stem, "^zotero_(.+)$", 1))
    c = F.col
    fold = lambda x: F.lower(F.trim(x))
    found = [
        _hits(papers, entries, 1, c("paper_id"), c("source_stem"), keep, ids), _hits(papers, entries, 1, stem, c("source_stem"), keep, ids),
        *[_hits(papers, entries, 2, library, c(k), keep, ids) for k in ("zotero_key", "bib_key")], *[_hits(papers, entries, 3, c("zotero_key"), c(k), keep, ids) for k in ("zotero_key", "bib_key")],
        _hits(papers, entries, 4, fold(c("doi")), fold(c("doi")), keep, ids), *[_hits(papers, entries, 5, c("paper_id"), c(k), keep, ids) for k in ("bib_key", "zotero_key")],
    ]
    hits = found[0]
    for f in found[1:]:
        hits = hits.union(f)
    hits = settle(hits)
    rest = papers.join(hits.select("paper_id"), "paper_id", "left_anti").select("paper_id", normalize_text(c("title")).alias("pt")).filter("pt <> ''")
    titled = entries.select("bib_ord", normalize_text(c("title")).alias("et")).filter("et <> ''")
    by_title = _contained(settle(rest), settle(titled), "pt", "et", ids, keep).filter(titles_compatible(c("pt"), c("et"))).select("paper_id", "bib_ord", F.lit(6).alias("rule"))
    return first_by(hits.union(by_title), ["paper_id"], "rule", "bib_ord")


def bib_only_papers(entries: DataFrame, papers: DataFrame, linked: DataFrame | None = None) -> DataFrame:
    """Entries that belong to no paper, as papers: id is the key, else the library key, else the stem; the first entry of an id wins."""
    known = papers.select("paper_id")
    if linked is not None:
        keys = entries.join(linked.select("bib_ord"), "bib_ord", "left_semi")
        known = known.union(keys.select("bib_key")).union(keys.select("zotero_key"))
    known = known.filter("paper_id is not null and paper_id <> ''").distinct()
    rest = entries
    for k in ("bib_key", "zotero_key", "source_stem"):
        rest = rest.join(known.withColumnRenamed("paper_id", k), k, "left_anti")
    pid = F.coalesce(*[non_empty(F.col(k)) for k in ("bib_key", "zotero_key", "source_stem")])
    return first_by(rest.withColumn("paper_id", pid).filter("paper_id is not null"), ["paper_id"], "bib_ord").select("paper_id", *entries.columns)


def citations_from_bib(entries: DataFrame, papers: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """(source, target) from the citation lists of entries.

    An entry stands for the paper whose id is its key, else its stem; of several entries with a key the last one's stem
    counts for all. With ``links`` (paper_id, bib_ord) it stands for the linked paper instead, by which more entries cite.
    Unknown papers and papers that cite themselves are left out.
    """
    ids = papers.select("paper_id").distinct()
    if links is not None:
        at = entries.join(links.select("paper_id", "bib_ord"), "bib_ord").select("bib_key", "paper_id", "citations", "bib_ord")
    else:
        known = lambda c: entries.join(ids, F.col(c) == F.col("paper_id"), "left_semi")
        by_key = known("bib_key").select("bib_key", F.col("bib_key").alias("paper_id")).distinct()
        stems = known("source_stem").filter("bib_key is not null").select("bib_key", F.col("source_stem").alias("paper_id"), "bib_ord").join(by_key, "bib_key", "left_anti")
        by_stem = first_by(stems, ["bib_key"], F.when(F.col("bib_key") == "", F.col("bib_ord")), F.desc("bib_ord")).select("bib_key", "paper_id")
        at = entries.select("bib_key", "citations", "bib_ord").join(by_key.union(by_stem), "bib_key")
    cited = at.select(F.col("paper_id").alias("source"), F.explode(split_citation_keys(F.col("citations"))).alias("key"))
    keys = first_by(at.filter("bib_key <> ''"), ["bib_key"], F.desc("bib_ord")).select(F.col("bib_key").alias("key"), F.col("paper_id").alias("to"))
    named = cited.join(keys, "key", "left").withColumn("target", F.coalesce("to", "key"))
    return named.join(ids.withColumnRenamed("paper_id", "target"), "target", "left_semi").filter("source <> target").select("source", "target").distinct()


def match_references(references: DataFrame, papers: DataFrame) -> DataFrame:
    """(ref_id, paper_id, method) of ``references`` (ref_id, doi, title, year, authors array) and ``papers`` (paper_id, doi, title, year, authors).

    Rules in order: DOI; a title within the other, years equal or one unknown; ratio of titles 0.72 in one year;
    a shared surname, years equal or the paper's unknown. Within a rule the smallest paper id wins.
    """
    c = F.col
    fold = lambda x: F.lower(F.trim(x))
    r = references.select("ref_id", fold(c("doi")).alias("rd"), normalize_text(F.coalesce("title", F.lit(""))).alias("rt"), c("year").alias("ry"), "authors")
    p = papers.select("paper_id", fold(c("doi")).alias("pd"), normalize_text(F.coalesce("title", F.lit(""))).alias("pt"), c("year").alias("py"), F.split(F.coalesce("authors", F.lit("")), ";").alias("pa"))
    r, p = settle(r), settle(p)  # titles are folded once
    unknown = c("py").isNull() | (c("py") == -1)
    # the hits of a rule are written, as all later rules leave out the references that have one
    doi = settle(r.filter("rd <> ''").join(p.filter("pd <> ''"), c("rd") == c("pd")).select("ref_id", "paper_id", F.lit(1).alias("rule")))
    left = r.join(doi.select("ref_id"), "ref_id", "left_anti")
    met = _contained(left.filter("rt <> ''"), p.filter("pt <> ''"), "rt", "pt", ["ref_id", "ry"], ["paper_id", "py"])
    title = settle(met.filter((F.contains("pt", "rt") | F.contains("rt", "pt")) & (c("ry").isNull() | unknown | (c("ry") == c("py")))).select("ref_id", "paper_id", F.lit(2).alias("rule")))
    left = left.join(title.select("ref_id"), "ref_id", "left_anti")
    # one year, lengths and characters that allow the ratio: all that an exact filter can tell of it
    bagged = left.filter("rt <> '' and ry is not null and ry <> 0").withColumn("rb", character_bag(c("rt")))
    close = bagged.join(p.filter("pt <> ''").withColumn("pb", character_bag(c("pt"))), c("ry") == c("py")).filter(ratio_bound(c("rt"), c("pt"), c("rb"), c("pb"), 0.72))
    fuzzy = settle(close.filter(sequence_ratio(c("rt"), c("pt")) >= 0.72).select("ref_id", "paper_id", F.lit(3).alias("rule")))
    left = left.join(fuzzy.select("ref_id"), "ref_id", "left_anti")
    names = lambda a: F.array_distinct(F.filter(F.transform(a, author_surname), lambda s: s != ""))
    x = left.filter("ry is not null and ry <> 0").select("ref_id", "ry", F.explode(names(c("authors"))).alias("s"))
    y = p.select("paper_id", "py", F.explode(names(c("pa"))).alias("s"))
    surname = x.join(y, "s").filter(unknown | (c("ry") == c("py"))).select("ref_id", "paper_id", F.lit(4).alias("rule"))
    best = first_by(doi.union(title).union(fuzzy).union(surname), ["ref_id"], "rule", "paper_id")
    name = F.element_at(F.array(*map(F.lit, ("doi", "title", "fuzzy_title_year", "author_year"))), c("rule"))
    return best.select("ref_id", "paper_id", name.alias("method"))


def citations_from_references(references: DataFrame, papers: DataFrame) -> DataFrame:
    """(source, target) of references with the citing ``source``; a reference whose best match is the citing paper is dropped."""
    hits = match_references(references, papers).join(references.select("ref_id", F.col("paper_id").alias("source")), "ref_id")
    return hits.select("source", F.col("paper_id").alias("target")).filter("source <> target").distinct()


def merge_citations(*pairs: DataFrame) -> DataFrame:
    out = pairs[0].select("source", "target")
    for p in pairs[1:]:
        out = out.union(p.select("source", "target"))
    return out.distinct()


def resolve_identity(new: DataFrame, registry: DataFrame) -> DataFrame:
    """``new`` (ref, zotero_key, doi, content_hash, source_ref) with the ``paper_id`` of the registry: by library key, DOI, hash, reference, in this order; null where none."""
    c = F.col
    fold = lambda x: F.lower(F.trim(x))
    keys = [("zotero_key", c("zotero_key")), ("doi", fold(c("doi"))), ("content_hash", c("content_hash")), ("source_ref", c("source_ref"))]
    hits = None
    for rule, (_, key) in enumerate(keys, 1):
        h = _hits(new, registry, rule, key, key, ["paper_id"], ["ref"])
        hits = h if hits is None else hits.union(h)
    best = first_by(hits, ["ref"], "rule", "paper_id").select("ref", "paper_id", "rule")
    return new.join(best, "ref", "left")


def resolve_paper_ref(refs: DataFrame, registry: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """``refs`` (ref) with ``paper_id``: an alias, an id, or a file by full path, name or stem, without regard to case and kind of slash."""
    plain = lambda x: F.lower(F.translate(x, "\\", "/"))
    key = plain(normalize_paper_ref(F.col("ref")))
    base = refs.select("ref")
    path = plain(F.col("source_path"))
    hits = _hits(base, registry, 2, normalize_paper_ref(F.col("ref")), F.col("paper_id"), ["paper_id"], ["ref"])
    for rule, column in ((3, path), (4, F.element_at(F.split(path, "/"), -1)), (5, path_stem(path))):
        hits = hits.union(_hits(base, registry, rule, key, column, ["paper_id"], ["ref"]))
    if aliases is not None:
        hits = hits.union(_hits(base, aliases, 1, normalize_paper_ref(F.col("ref")), F.col("alias"), ["paper_id"], ["ref"]))
    return refs.join(first_by(hits, ["ref"], "rule", "paper_id").select("ref", "paper_id"), "ref", "left")


_HELD = 100_000  # queries whose best ratios a task keeps at once


def _suggested(queries: DataFrame, papers: DataFrame, least: float, top: int) -> DataFrame:
    """(query, paper_id, ratio, ratios): each task's best papers of each query, and, once a batch, how many ratios it worked out.

    A task takes pairs as the join gives them, those of a batch by falling bound of the ratio (characters in common), and skips a pair
    whose bound is below the ``top``-th best ratio that the query has there. So no pairs are shuffled.
    """
    names = [papers.select("paper_id", F.lower(c).alias("name")) for c in (F.col("paper_id"), F.col("title"), path_stem(F.col("source_path")))]
    n = names[0].union(names[1]).union(names[2]).filter("name is not null and name <> ''").distinct().withColumn("_l", F.length("name"))
    low, high = least / (2 - least), (2 - least) / least
    q = queries.select("query", F.lower("query").alias("q")).distinct().withColumn("_n", F.length("q"))
    q = q.select("query", "q", F.explode(F.sequence(F.ceil(F.col("_n") * low - 1e-9).cast("int"), F.floor(F.col("_n") * high + 1e-9).cast("int"))).alias("_l"))
    near = q.withColumn("qb", character_bag(F.col("q"))).join(n.withColumn("nb", character_bag(F.col("name"))), "_l").filter(ratio_bound(F.col("name"), F.col("q"), F.col("nb"), F.col("qb"), least))
    bounded = near.select("query", "q", "paper_id", "name", common_share(F.col("name"), F.col("q"), F.col("nb"), F.col("qb")).alias("bound"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[str, dict[str, float]] = {}
        matcher = SequenceMatcher(None)
        for batch in batches:
            done, out = 0, []
            for r in batch.sort_by([("bound", "descending")]).to_pylist():
                held = best.setdefault(r["query"], {})
                floor = sorted(held.values())[-top] if len(held) >= top else least
                if r["bound"] < floor:
                    continue
                matcher.set_seqs(r["name"], r["q"])
                if matcher.quick_ratio() < floor:
                    continue
                done += 1
                ratio = matcher.ratio()
                if ratio >= floor:
                    out.append((r["query"], r["paper_id"], ratio))
                    if ratio > held.get(r["paper_id"], 0.0):
                        held[r["paper_id"]] = ratio
                        if len(held) > top:  # enough for the bound; ties were handed on
                            del held[min(held, key=held.get)]
            if len(best) > _HELD:
                best = {}
            yield pa.RecordBatch.from_pylist([{"query": a, "paper_id": b, "ratio": c, "ratios": 0} for a, b, c in out] + [{"query": None, "paper_id": None, "ratio": None, "ratios": done}], schema=_SUGGESTED)

    return bounded.mapInArrow(run, "query string, paper_id string, ratio double, ratios long")


_SUGGESTED = pa.schema([("query", pa.string()), ("paper_id", pa.string()), ("ratio", pa.float64()), ("ratios", pa.int64())])


def did_you_mean(queries: DataFrame, papers: DataFrame, least: float = 0.6, top: int = 3) -> DataFrame:
    """(query, paper_id, ratio, rank): the nearest papers by id, title or file stem.

    Names meet the queries whose length allows the ratio; of these the ratio is worked out where characters in common leave
    room for a place among the ``top``, see ``_suggested``.
    """
    best = _suggested(queries, papers, least, top).filter("query is not null").groupBy("query", "paper_id").agg(F.max("ratio").alias("ratio"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("ratio"), "paper_id"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= top)


def missing_ids(wanted: DataFrame, papers: DataFrame) -> DataFrame:
    return wanted.select("paper_id").distinct().join(papers.select("paper_id"), "paper_id", "left_anti")


def overlay_metadata(papers: DataFrame, bib: DataFrame, enrichment: DataFrame | None = None) -> DataFrame:
    """``papers`` (paper_id, title, year, authors, venue, doi) under bibliography values, under enrichment values that aren't empty."""
    out = papers
    for extra in (bib, enrichment):
        if extra is None:
            continue
        e = extra.select("paper_id", *[F.col(c).alias(f"_{c}") for c in ("title", "year", "authors", "venue", "doi")])
        text = {c: F.coalesce(non_empty(F.col(f"_{c}")), F.col(c)) for c in ("title", "authors", "venue", "doi")}
        out = out.join(e, "paper_id", "left").withColumns(text | {"year": F.coalesce(F.when(F.col("_year") > 0, F.col("_year")), F.col("year"))}).select(*out.columns)
    return out


def registry_attributes(papers: DataFrame, registry: DataFrame) -> DataFrame:
    """``papers`` (paper_id, path, zotero_key, doi) with the registry's values first; of several entries the first path counts."""
    r = first_by(registry, ["paper_id"], "source_path").select("paper_id", F.col("source_path").alias("_path"), F.col("zotero_key").alias("_zotero_key"), F.col("doi").alias("_doi"))
    out = papers.join(r, "paper_id", "left")
    return out.withColumns({c: F.coalesce(non_empty(F.col(f"_{c}")), F.col(c)) for c in ("path", "zotero_key", "doi")}).select(*papers.columns)
