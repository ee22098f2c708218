"""Registered queries of sources, text functions, linking and upkeep, with rows for every branch, and SQL twins."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids, text
from ..operators import compare, documents, graph, infer, linking, profiles, search, traverse
from ..sources import files, records as sources
from ..streaming import incremental
from .catalog import add as _add
from .catalog import line as _line
from .catalog import paper_profiles as _profiles
from .catalog import values as _values
from .index import canonical_graph, index_pipeline, process_folder, remove_paths
from .queries import _EDGES, _headed
from .stages import scratch, settle
from .surrogate import PAPER_EDGES, citations, corpus_graph, records, table

__all__: list[str] = []


def _s(c: str) -> Column:
    return F.col(c).cast("string")


def _pick(k: Column, *choices: Column | str) -> Column:
    """The choice of a number from 0."""
    return F.element_at(F.array(*[F.lit(x) if isinstance(x, str) else x for x in choices]), (k + 1).cast("int"))


# text functions

@_add("f3_safe_merge", """WITH p AS (SELECT p_partkey, list_distinct(string_split(a, ' ')) AS x, list_distinct(string_split(b, ' ')) AS y, a, b FROM (SELECT p_partkey, p_name AS a, CASE p_partkey % 3 WHEN 0 THEN p_type || ' ' || p_name WHEN 1 THEN substr(p_name, 1, 3) ELSE lead(p_name) OVER (ORDER BY p_partkey) END AS b FROM part))
SELECT p_partkey, a = b OR length(a) > 3 AND length(b) > 3 AND 2 * len(list_intersect(x, y)) >= least(len(x), len(y)) AS merges FROM p WHERE b IS NOT NULL""", cte=False)
def _(spark, sf):
    p = table(spark, sf, "part")
    after = p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("_next"))
    k = F.col("p_partkey") % 3
    b = F.when(k == 0, F.concat_ws(" ", "p_type", "p_name")).when(k == 1, F.substring("p_name", 1, 3)).otherwise(F.col("_next"))
    rows = p.join(after, "p_partkey", "left").withColumn("_b", b).filter("_b is not null")
    return rows.select("p_partkey", text.safe_merge(F.col("p_name"), F.col("_b")).alias("merges"))


@_add("f4_sequence_ratio")
def _(spark, sf):
    """Each part's name against its type and name; tests compare it with the standard library."""
    return table(spark, sf, "part").select("p_partkey", F.round(text.sequence_ratio(F.col("p_name"), F.lower(F.concat_ws(" ", "p_type", "p_name"))), 6).alias("ratio"))


@_add("f5_author_surname", "SELECT c_custkey, lower(c_mktsegment) AS surname FROM customer", cte=False)
def _(spark, sf):
    """Surname first with a comma, or last without."""
    name = F.when(F.col("c_custkey") % 2 == 0, F.concat("c_mktsegment", F.lit(" , "), "c_name")).otherwise(F.concat(F.lit(" "), "c_name", F.lit("  "), "c_mktsegment"))
    return table(spark, sf, "customer").select("c_custkey", text.author_surname(name).alias("surname"))


@_add("f8_normalize_paper_ref", "SELECT s_suppkey, s_name AS ref FROM supplier", cte=False)
def _(spark, sf):
    ref = _pick(F.col("s_suppkey") % 3, F.col("s_name"), F.concat(F.lit(" paper_"), "s_name"), F.concat(F.lit("\t"), "s_name", F.lit("\n")))
    return table(spark, sf, "supplier").select("s_suppkey", text.normalize_paper_ref(ref).alias("ref"))


@_add("f9_path_stem_slug", "SELECT c_custkey, CASE c_custkey % 4 WHEN 3 THEN 'paper_unknown' ELSE lower(replace(c_name, '#', '_')) || CASE c_custkey % 4 WHEN 2 THEN '_notes' ELSE '' END END AS slug FROM customer", cte=False)
def _(spark, sf):
    """A note with a suffix, one with another, a file that keeps it, and a name without letters."""
    path = _pick(F.col("c_custkey") % 4, F.concat(F.lit("/a/b/"), "c_name", F.lit("_notes.md")), F.concat(F.lit("a\\"), "c_name", F.lit("-notes.MD")), F.concat("c_name", F.lit("_notes.pdf")), F.lit("/x/###.md"))
    return table(spark, sf, "customer").select("c_custkey", ids.path_stem_slug(path).alias("slug"))


_AX = "SELECT page_id, page_id % 8 AS k, '2401.' || lpad(CAST(page_id AS VARCHAR), 5, '0') AS ax, url FROM pages"


def _arxiv(spark, sf) -> DataFrame:
    ax = F.concat(F.lit("2401."), F.lpad(_s("page_id"), 5, "0"))
    forms = ("arxiv://{}", "ARXIV:{}", "https://arxiv.org/abs/{}v2", "http://www.arxiv.org/pdf/{}.pdf", "https://arxiv.org/html/{}/", "{}", "see {} there")
    ref = _pick(F.col("page_id") % 8, *[F.concat(F.lit(f.split("{}")[0]), ax, F.lit(f.split("{}")[1])) for f in forms], F.col("url"))
    return table(spark, sf, "pages").select("page_id", ref.alias("ref"))


@_add("f10_normalize_arxiv_id", f"SELECT page_id, CASE WHEN k = 2 THEN ax || 'v2' WHEN k < 6 THEN ax END AS id FROM ({_AX})", cte=False)
def _(spark, sf):
    return _arxiv(spark, sf).select("page_id", text.normalize_arxiv_id(F.col("ref")).alias("id"))


@_add("f11_remote_pdf_ref", f"SELECT page_id, CASE k WHEN 0 THEN 'https://x.org/a/' || page_id || '.PDF#p2' WHEN 1 THEN NULL WHEN 2 THEN 'arxiv://' || ax || 'v2' WHEN 3 THEN 'arxiv://' || ax WHEN 4 THEN 'arxiv://' || ax WHEN 7 THEN 'http://y.org/pdf/' || page_id END AS ref FROM ({_AX})", cte=False)
def _(spark, sf):
    k, i = F.col("page_id") % 8, _s("page_id")
    odd = F.when(k == 0, F.concat(F.lit(" https://x.org/a/"), i, F.lit(".PDF#p2"))).when(k == 1, F.lit("ftp://x.org/a.pdf")).when(k == 7, F.concat(F.lit("http://y.org/pdf/"), i)).otherwise(F.col("ref"))
    return _arxiv(spark, sf).select("page_id", text.remote_pdf_ref(odd).alias("ref"))


@_add("f12_coerce_extraction", """SELECT 'e' || event_id AS paper_id, CASE event_id % 3 WHEN 2 THEN NULL ELSE 2000 + event_id % 20 END AS year,
  CASE event_id % 4 WHEN 0 THEN event_type || '; x' WHEN 1 THEN event_type WHEN 2 THEN event_type || '; n' ELSE '' END AS methods, CASE event_id % 4 WHEN 0 THEN event_type || '|why|7|S' WHEN 1 THEN event_type || '|' || event_type || '|1|' WHEN 2 THEN 'a|a|1|; b|b|1|' ELSE '' END AS claims FROM events""", cte=False)
def _(spark, sf):
    """Lists, objects and bare strings; years within texts; pages as texts."""
    e, k, i = F.col("event_type"), F.col("event_id") % 4, _s("event_id")
    q = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    methods = _pick(k, q('["', e, '", {"name": " x "}, ""]'), q('"', e, '"'), q('[{"name": "', e, '"}, {"text": "n"}]'), "null")
    claims = _pick(k, q('[{"text": "', e, '", "evidence_text": "why", "page": "p. 7", "section": "S"}]'), q('"', e, '"'), '["a", {"text": "b", "page": 0}, {"page": 3}]', "null")
    year = _pick(F.col("event_id") % 3, q('"published in ', (2000 + F.col("event_id") % 20).cast("string"), ' or so"'), (2000 + F.col("event_id") % 20).cast("string"), '"12"')
    rows = table(spark, sf, "events").select(q('{"paper_id": "e', i, '", "title": "t", "year": ', year, ', "methods": ', methods, ', "claims": ', claims, "}").alias("value"))
    told = F.array_join(F.transform("claims", lambda c: F.concat_ws("|", c["text"], c["evidence_text"], c["page"].cast("string"), c["section"])), "; ")
    return sources.raw_extractions(rows).select("paper_id", "year", F.array_join("methods", "; ").alias("methods"), told.alias("claims"))


@_add("f17_venue_of", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_orderstatus WHEN 1 THEN o_orderpriority WHEN 2 THEN 'last' ELSE '' END AS venue FROM orders", cte=False)
def _(spark, sf):
    k, none = F.col("o_orderkey") % 4, F.lit(None).cast("string")
    first, second, third = F.when(k == 0, F.col("o_orderstatus")).otherwise(F.lit("")), F.when(k <= 1, F.col("o_orderpriority")), F.when(k == 2, "last").otherwise(none)
    return table(spark, sf, "orders").select("o_orderkey", text.venue_of(first, second, third).alias("venue"))


@_add("f18_titles_compatible", "WITH t AS (SELECT p_partkey, p_name AS a, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' of the ' || p_type WHEN 2 THEN '' ELSE 'x' END AS b, repeat('long title ', 2) || p_name AS c FROM part) SELECT p_partkey, a <> '' AND b <> '' AND a = b AS short, length(c) >= 24 AS long FROM t", cte=False)
def _(spark, sf):
    n = F.col("p_name")
    b = _pick(F.col("p_partkey") % 4, n, F.concat(n, F.lit(" of the "), "p_type"), "", "x")
    c = F.concat(F.lit("long title long title "), n)
    return table(spark, sf, "part").select("p_partkey", text.titles_compatible(n, b).alias("short"), text.titles_compatible(F.concat(F.lit("a "), c), c).alias("long"))


@_add("f20_join_evidence", "SELECT paper_id, text, coalesce(nullif(evidence_text, 'src1'), '') AS evidence_text, page, section FROM lim")
def _(spark, sf):
    gone = F.transform("limitations", lambda i: i.withField("evidence_text", F.nullif(i["evidence_text"], F.lit("src1"))))
    rows = _profiles(spark, sf).select("paper_id", gone.alias("_l")).select("paper_id", F.explode(text.join_evidence(F.col("_l"))).alias("i"))
    return rows.select("paper_id", "i.text", "i.evidence_text", "i.page", "i.section")


@_add("f21_first_evidence_text", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN source WHEN 1 THEN lang ELSE text END AS evidence FROM documents", cte=False)
def _(spark, sf):
    k = F.col("doc_id") % 3
    return table(spark, sf, "documents").select("doc_id", text.first_evidence_text(F.when(k == 0, F.col("source")).when(k == 1, ""), F.when(k == 1, F.col("lang")).when(k == 2, ""), F.col("text")).alias("evidence"))


@_add("f6_slug_branches", """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN 'doi_10_1000_' || lower(c_mktsegment) || '_' || c_custkey WHEN 1 THEN lower(c_mktsegment) || '_' || (1990 + c_custkey % 30) || '_' || lower(replace(c_name, '#', '_')) ELSE lower(c_mktsegment) || '_unknown_untitled' END AS slug FROM customer""", cte=False)
def _(spark, sf):
    """By DOI; by surname, year and title; with year and title unknown."""
    k = F.col("c_custkey") % 3
    doi = F.when(k == 0, F.concat(F.lit(" 10.1000/"), "c_mktsegment", F.lit("."), _s("c_custkey"))).otherwise(F.lit(""))
    out = ids.metadata_slug(F.when(k == 1, F.col("c_name")).otherwise(F.lit("")), doi, F.when(k == 1, 1990 + F.col("c_custkey") % 30).otherwise(-1), F.concat("c_mktsegment", F.lit(", Jane")))
    return table(spark, sf, "customer").select("c_custkey", out.alias("slug"))


# lookups

@_add("p1_workspace_scope", "SELECT doc_id FROM documents WHERE doc_id % 3 <> 1", cte=False)
def _(spark, sf):
    space = _pick(F.col("doc_id") % 3, F.lit("default"), F.lit("other"), F.lit(None).cast("string"))
    return profiles.workspace_scope(table(spark, sf, "documents").select("doc_id", space.alias("workspace_id"))).select("doc_id")


@_add("p2_validate_workspace", "SELECT doc_id, CASE doc_id % 5 WHEN 1 THEN 'default' WHEN 2 THEN 'default' WHEN 3 THEN lang ELSE source END AS workspace_id, doc_id % 5 < 4 AS good FROM (SELECT doc_id, lang, CASE doc_id % 5 WHEN 4 THEN 'bad name!' ELSE regexp_replace(source, '[^a-zA-Z0-9_-]', '_', 'g') END AS source FROM documents)", cte=False)
def _(spark, sf):
    name = _pick(F.col("doc_id") % 5, F.regexp_replace("source", "[^a-zA-Z0-9_-]", "_"), F.lit(None).cast("string"), "  ", F.concat(F.lit(" "), "lang"), "bad name!")
    good, bad = profiles.validate_workspace(table(spark, sf, "documents").select("doc_id", name.alias("workspace_id")))
    return good.withColumn("good", F.lit(True)).union(bad.withColumn("good", F.lit(False)))


_JOINED = "coalesce((SELECT string_agg({c}, '; ' ORDER BY {o}) FROM {t} u WHERE u.paper_id = p.paper_id), '') AS {n}"


@_add("p8_summarize_papers", "SELECT paper_id, title, " + ", ".join(_JOINED.format(c=c, o=o, t=t, n=n) for c, o, t, n in (("name", "name", "task", "tasks"), ("name", "name", "uses", "methods"), ("name", "name", "data", "datasets"), ("name", "name", "metric", "metrics"), ("text", "ord", "contrib", "contributions"), ("text", "ord", "lim", "limitations"), ("text", "ord", "claim", "claims"))) + " FROM paper p")
def _(spark, sf):
    s = profiles.summarize_papers(_profiles(spark, sf))
    texts = {c: F.array_join(F.transform(c, lambda i: i["text"]), "; ") for c in ("contributions", "limitations", "claims")}
    return s.withColumns({c: _line(c) for c in ("tasks", "methods", "datasets", "metrics")} | texts)


@_add("p16_attach_provenance", "SELECT 'd' || doc_id AS paper_id, CASE doc_id % 4 WHEN 3 THEN NULL ELSE 'in/' || doc_id END AS source_path, CASE doc_id % 4 WHEN 0 THEN 'own' WHEN 3 THEN NULL ELSE 's' || doc_id END AS source_stem, CASE WHEN doc_id % 4 < 3 THEN sha256(text) END AS content_hash, CASE WHEN doc_id % 4 < 3 THEN lang END AS slug, CASE WHEN doc_id % 4 < 3 THEN '10.1/' || doc_id END AS doi FROM documents", cte=False)
def _(spark, sf):
    """A stem of its own, an empty one, none, and a paper that was never parsed."""
    k, i = F.col("doc_id") % 4, _s("doc_id")
    d = table(spark, sf, "documents").withColumn("paper_id", F.concat(F.lit("d"), i))
    extracted = d.select("paper_id", F.when(k == 0, "own").when(k == 1, "").alias("source_stem"))
    parsed = d.filter(k < 3).select("paper_id", F.concat(F.lit("in/"), i).alias("source_path"), F.concat(F.lit("s"), i).alias("source_stem"), F.sha2("text", 256).alias("content_hash"), F.col("lang").alias("slug"), F.concat(F.lit("10.1/"), i).alias("doi"))
    return profiles.attach_provenance(extracted, parsed)


# documents

def _laid_out(spark, sf) -> DataFrame:
    """Lines of the conversations' pages: headings of even turns in large type, of odd ones in small type."""
    p = _headed(spark, sf)
    head = p.select("doc", "page", F.lit(0).alias("line_no"), F.substring_index("text", "\n", 1).alias("text"), F.when(F.col("page") % 2 == 0, 14.0).otherwise(9.0).alias("size"))
    return head.union(p.select("doc", "page", F.lit(1), F.expr("substring(text, instr(text, '\n') + 1)"), F.lit(10.0)))


_H = ["Abstract", "1. Introduction", "2 Related Work", "Methods", "Results", "Discussion", "Conclusion", "References"]
_N = ["Abstract", "Introduction", "RelatedWork", "Method", "Experiment", "Discussion", "Conclusion", "References"]
_PLACES = f"WITH h AS (SELECT conv_id AS doc, turn, {_N}[least(turn, 7) + 1] AS name, length({_H}[least(turn, 7) + 1] || chr(10) || text) AS l FROM conversations), o AS (SELECT *, coalesce(sum(l + 1) OVER (PARTITION BY doc ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM h), rx AS (SELECT doc, name, min(pos) AS pos FROM o GROUP BY 1, 2), ly AS (SELECT doc, name, min(pos) AS pos FROM o WHERE turn % 2 = 0 GROUP BY 1, 2)"


@_add("d2_section_starts_layout", _PLACES + " SELECT doc, name, CAST(pos AS BIGINT) AS pos FROM ly", cte=False)
def _(spark, sf):
    return documents.section_starts_layout(documents.pages_to_documents(_headed(spark, sf)), _laid_out(spark, sf))


def _starts(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Documents, and starts found by text in those with an even id and by layout in those not divisible by three."""
    docs = settle(documents.pages_to_documents(_headed(spark, sf)))
    by_text = documents.section_starts_regex(docs.filter("doc % 2 = 0"))
    by_layout = settle(documents.section_starts_layout(docs.filter("doc % 3 <> 0"), _laid_out(spark, sf)))
    return docs, settle(documents.merge_section_starts(by_text, by_layout))


_MERGED = _PLACES + ", m AS (SELECT doc, name, min(pos) AS pos, CASE WHEN doc % 2 = 0 AND doc % 3 <> 0 THEN 'merged' WHEN doc % 2 = 0 THEN 'regex' ELSE 'blocks' END AS detection FROM (SELECT * FROM rx WHERE doc % 2 = 0 UNION ALL SELECT * FROM ly WHERE doc % 3 <> 0) GROUP BY 1, 2)"


@_add("d3_merge_section_starts", _MERGED + " SELECT doc, name, CAST(pos AS BIGINT) AS pos, detection FROM m", cte=False)
def _(spark, sf):
    return _starts(spark, sf)[1]


@_add("d11_section_meta", _MERGED + " SELECT doc, coalesce(max(detection), 'none') AS detection, max(detection) IS NULL AS fallback, coalesce(string_agg(name, '; ' ORDER BY pos, name), 'FullText') AS section_names FROM (SELECT DISTINCT doc FROM h) LEFT JOIN m USING (doc) GROUP BY 1", cte=False)
def _(spark, sf):
    docs, starts = _starts(spark, sf)
    return documents.section_meta(docs, starts, documents.split_sections(docs, starts)).withColumn("section_names", F.array_join("section_names", "; "))


@_add("d7_section_text", "SELECT conv_id AS doc, trim('Methods' || chr(10) || arg_min(text, turn), ' ' || chr(9) || chr(10) || chr(13)) AS text FROM conversations WHERE turn = 3 GROUP BY 1", cte=False)
def _(spark, sf):
    docs = documents.pages_to_documents(_headed(spark, sf))
    return documents.section_text(documents.split_sections(docs, documents.section_starts_regex(docs)), "method", "Background")


# linking

_C = "SELECT c_custkey AS i, c_custkey % 8 AS k, c_name, c_mktsegment FROM customer"


def _library(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Customers as papers and as entries, tied by another rule for each remainder of the key; the last has no entry."""
    c, i, k = table(spark, sf, "customer"), _s("c_custkey"), F.col("c_custkey") % 8
    when = lambda *pairs: F.coalesce(*[F.when(k == n, v) for n, v in pairs], F.lit(""))
    title = F.concat(F.lit("a long title about "), "c_name")
    papers = c.select(
        F.when(k == 5, F.concat(F.lit("key"), i)).otherwise(F.concat(F.lit("p"), i)).alias("paper_id"),
        when((0, F.concat(F.lit("/in/stem"), i, F.lit(".pdf"))), (1, F.concat(F.lit("/in/zotero_Z"), i, F.lit(".pdf")))).alias("path"),
        when((6, title), (7, "c_name")).alias("title"), when((2, F.concat(F.lit("Z"), i))).alias("zotero_key"), when((3, F.concat(F.lit("10.1/AB"), i)), (4, F.lit("10.9/none"))).alias("doi"),
    )
    entries = c.filter(k < 7).select(
        F.col("c_custkey").alias("bib_ord"), F.concat(F.lit("key"), i).alias("bib_key"), when((0, F.concat(F.lit("stem"), i))).alias("source_stem"),
        when((1, F.concat(F.lit("Z"), i)), (2, F.concat(F.lit("Z"), i))).alias("zotero_key"), when((3, F.concat(F.lit("10.1/ab"), i))).alias("doi"),
        when((6, F.concat(F.lit("On: "), title, F.lit(" (revised)"))), (4, "c_mktsegment")).alias("title"),
    )
    return papers, entries


_ID = "CASE k WHEN 5 THEN 'key' ELSE 'p' END || i"


@_add("j1_link_bib", f"SELECT {_ID} AS paper_id, i AS bib_ord, k AS r FROM ({_C}) WHERE k NOT IN (4, 7)", cte=False)
def _(spark, sf):
    linked = linking.link_bib(*_library(spark, sf))
    # the rule of each remainder, from 1 to 6
    told = _pick(F.col("rule") - 1, F.lit(0), F.lit(1), F.lit(2), F.lit(3), F.lit(5), F.lit(6))
    return linked.select("paper_id", "bib_ord", told.cast("long").alias("r"))


@_add("j2_bib_only_papers", f"SELECT 'key' || i AS paper_id, i AS bib_ord FROM ({_C}) WHERE k = 4", cte=False)
def _(spark, sf):
    papers, entries = _library(spark, sf)
    twice = entries.union(entries.filter("bib_ord % 8 = 4").withColumn("bib_ord", F.col("bib_ord") + 1_000_000_000))
    return linking.bib_only_papers(twice, papers, settle(linking.link_bib(papers, entries))).select("paper_id", "bib_ord")


def _references(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Customers as papers, and a reference to each: by DOI, part of a title, a title with another word, a surname, or nothing."""
    c, i, k = table(spark, sf, "customer"), _s("c_custkey"), F.col("c_custkey") % 6
    year = F.col("c_custkey").cast("long")
    title = F.concat(F.lit("the study of subject "), i, F.lit(" and its use"))
    papers = c.select(F.concat(F.lit("p"), i).alias("paper_id"), F.when(k == 0, F.concat(F.lit("10.1/AB"), i)).otherwise("").alias("doi"), title.alias("title"), F.when(k == 1, -1).otherwise(year).alias("year"), F.concat(F.lit("Doe"), i, F.lit(", Jane; Roe, R.")).alias("authors"))
    refs = c.select(
        F.concat(F.lit("r"), i).alias("ref_id"), F.when(k == 5, F.concat(F.lit("p"), i)).otherwise(F.lit("citing")).alias("paper_id"), F.when(k == 0, F.concat(F.lit("10.1/ab"), i)).otherwise("").alias("doi"),
        F.when(k.isin(1, 5), F.concat(F.lit("Study of subject "), i, F.lit(" and its"))).when(k == 2, F.concat(F.lit("The studies of subject "), i, F.lit(" and their use"))).when(k == 4, F.lit("zzz qqq")).otherwise(F.lit("")).alias("title"),
        year.alias("year"), F.when(k == 3, F.array(F.concat(F.lit("Jane Doe"), i))).otherwise(F.array().cast("array<string>")).alias("authors"),
    )
    return refs, papers


_R = "SELECT c_custkey AS i, c_custkey % 6 AS k FROM customer"


@_add("j4_match_references", f"SELECT 'r' || i AS ref_id, 'p' || i AS paper_id, CASE k WHEN 0 THEN 'doi' WHEN 1 THEN 'title' WHEN 5 THEN 'title' WHEN 2 THEN 'fuzzy_title_year' ELSE 'author_year' END AS method FROM ({_R}) WHERE k <> 4 AND NOT (k = 2 AND i = 0) AND NOT (k = 3 AND i = 0)", cte=False)
def _(spark, sf):
    refs, papers = _references(spark, sf)
    return linking.match_references(refs.drop("paper_id"), papers)


@_add("j5_citations_from_references", f"SELECT 'citing' AS source, 'p' || i AS target FROM ({_R}) WHERE k < 4", cte=False)
def _(spark, sf):
    return linking.citations_from_references(*_references(spark, sf))


@_add("j11_resolve_identity", "WITH f AS (SELECT sha256(text) AS h, min('d' || lpad(CAST(doc_id AS VARCHAR), 12, '0')) AS first FROM documents GROUP BY 1) SELECT doc_id AS ref, CASE WHEN doc_id % 5 = 4 THEN NULL WHEN doc_id % 5 = 2 THEN first ELSE 'd' || lpad(CAST(doc_id AS VARCHAR), 12, '0') END AS paper_id, CASE WHEN doc_id % 5 < 4 THEN CAST(doc_id % 5 + 1 AS INTEGER) END AS rule FROM documents JOIN f ON sha256(text) = h", cte=False)
def _(spark, sf):
    """By library key, DOI, content, reference, or not at all; a weaker key of another paper doesn't count."""
    i, k = _s("doc_id"), F.col("doc_id") % 5
    d = table(spark, sf, "documents").withColumn("_h", F.sha2("text", 256))
    pid = F.concat(F.lit("d"), F.lpad(i, 12, "0"))
    registry = d.select(pid.alias("paper_id"), F.concat(F.lit("Z"), i).alias("zotero_key"), F.concat(F.lit("10.1/AB"), i).alias("doi"), F.col("_h").alias("content_hash"), F.concat(F.lit("ref:"), i).alias("source_ref"))
    new = d.select(
        F.col("doc_id").alias("ref"), F.when(k == 0, F.concat(F.lit("Z"), i)).otherwise("").alias("zotero_key"), F.when(k == 1, F.concat(F.lit(" 10.1/ab"), i)).when(k == 0, F.lit("10.1/ab0")).otherwise("").alias("doi"),
        F.when(k == 2, F.col("_h")).alias("content_hash"), F.when(k == 3, F.concat(F.lit("ref:"), i)).otherwise("ref:none").alias("source_ref"),
    )
    return linking.resolve_identity(new, registry).select("ref", "paper_id", "rule")


@_add("j12_resolve_paper_ref", "SELECT c_custkey AS i, CASE WHEN c_custkey % 6 < 5 THEN 'p' || c_custkey END AS paper_id FROM customer", cte=False)
def _(spark, sf):
    """By alias, id, full path, file name or stem, with either slash and any case; the last is unknown."""
    c, i = table(spark, sf, "customer"), _s("c_custkey")
    registry = c.select(F.concat(F.lit("p"), i).alias("paper_id"), F.concat(F.lit("C:\\In\\"), F.regexp_replace("c_name", "#", "_"), F.lit(".pdf")).alias("source_path"))
    aliases = c.select(F.concat(F.lit("old"), i).alias("alias"), F.concat(F.lit("p"), i).alias("paper_id"))
    name = F.regexp_replace("c_name", "#", "_")
    ref = _pick(F.col("c_custkey") % 6, F.concat(F.lit("paper_old"), i), F.concat(F.lit("p"), i), F.concat(F.lit("c:/in/"), F.upper(name), F.lit(".PDF")), F.concat(name, F.lit(".pdf")), F.lower(name), F.concat(F.lit("no"), i))
    refs = c.select(F.col("c_custkey").alias("i"), ref.alias("ref"))
    return linking.resolve_paper_ref(refs, registry, aliases).select("i", "paper_id")


@_add("j13_did_you_mean")
def _(spark, sf):
    """Names of suppliers with a letter missing; tests compare with the standard library."""
    s = table(spark, sf, "supplier")
    papers = s.select(F.concat(F.lit("p"), _s("s_suppkey")).alias("paper_id"), F.col("s_name").alias("title"), F.lit("").alias("source_path"))
    q = s.select(F.concat(F.substring("s_name", 1, 3), F.substring("s_name", 5, 40)).alias("query"))
    return linking.did_you_mean(q, papers).select("query", "paper_id", F.round("ratio", 6).alias("ratio"), "rank")


@_add("j15_overlay_metadata", """SELECT paper_id, CASE WHEN o_orderkey % 3 = 0 THEN 'bib ' || o_orderkey ELSE title END AS title, CASE WHEN o_orderkey % 5 = 0 THEN 1900 WHEN o_orderkey % 3 = 0 AND o_orderkey % 2 = 0 THEN 1950 ELSE year END AS year,
  CASE WHEN o_orderkey % 3 = 0 THEN 'A; B' ELSE '' END AS authors, CASE WHEN o_orderkey % 5 = 0 THEN 'new venue' WHEN o_orderkey % 3 = 0 THEN 'venue' ELSE '' END AS venue, '' AS doi FROM paper""")
def _(spark, sf):
    """Entries for every third paper, with a year for every second of these; enrichment for every fifth, without a title."""
    papers = profiles.list_papers(corpus_graph(spark, sf)[0]).drop("workspace_id")
    k = F.substring("paper_id", 2, 20).cast("long")
    bib = papers.filter(k % 3 == 0).select("paper_id", F.concat(F.lit("bib "), k.cast("string")).alias("title"), F.when(k % 2 == 0, 1950).otherwise(-1).alias("year"), F.lit("A; B").alias("authors"), F.lit("venue").alias("venue"), F.lit("").alias("doi"))
    more = papers.filter(k % 5 == 0).select("paper_id", F.lit("").alias("title"), F.lit(1900).alias("year"), F.lit("").alias("authors"), F.lit("new venue").alias("venue"), F.lit(None).cast("string").alias("doi"))
    return linking.overlay_metadata(papers, bib, more)


@_add("j17_registry_attributes", "SELECT CAST(c_custkey AS VARCHAR) AS paper_id, CASE WHEN c_custkey % 2 = 0 THEN 'a/' || c_custkey ELSE 'own' END AS path, CASE WHEN c_custkey % 4 = 0 THEN 'Z' ELSE 'own' END AS zotero_key, 'own' AS doi FROM customer", cte=False)
def _(spark, sf):
    i = _s("c_custkey")
    c = table(spark, sf, "customer")
    papers = c.select(i.alias("paper_id"), *[F.lit("own").alias(x) for x in ("path", "zotero_key", "doi")])
    rows = lambda p, z: c.filter("c_custkey % 2 = 0").select(i.alias("paper_id"), F.concat(F.lit(p), i).alias("source_path"), z.alias("zotero_key"), F.lit("").alias("doi"))
    return linking.registry_attributes(papers, rows("b/", F.lit("later")).union(rows("a/", F.when(F.col("c_custkey") % 4 == 0, "Z").otherwise(""))))


# comparison and search

@_add("a8_gap_support", """WITH c AS (SELECT *, doc_id % 50 AS paper, min(doc_id) OVER (PARTITION BY lang, source) AS leader FROM documents), g AS (SELECT leader, count(*) AS n_items, count(DISTINCT paper) AS paper_count, string_agg(DISTINCT 'p' || paper, '; ' ORDER BY 'p' || paper) AS supporting_papers, arg_min(text, doc_id) AS r,
  string_agg('p' || paper || '|' || CASE WHEN doc_id % 2 = 0 THEN source ELSE text END, '; ' ORDER BY doc_id) AS evidence FROM c GROUP BY 1)
SELECT leader, CASE n_items WHEN 1 THEN r ELSE r || ' (reported across ' || n_items || ' papers)' END AS gap, n_items, paper_count, supporting_papers, sha256(evidence) AS evidence FROM g WHERE paper_count >= 2""", cte=False)
def _(spark, sf):
    """Documents of one language and source as clusters."""
    w = Window.partitionBy("lang", "source")
    rows = table(spark, sf, "documents").select(
        F.col("doc_id").alias("item_ord"), F.min("doc_id").over(w).alias("leader"), F.concat(F.lit("p"), (F.col("doc_id") % 50).cast("string")).alias("paper_id"), F.lit("t").alias("title"), F.lit(1).alias("page"), F.lit("s").alias("section"),
        F.col("text").alias("limitation"), F.when(F.col("doc_id") % 2 == 0, F.col("source")).otherwise("").alias("evidence_text"),
    )
    told = F.sha2(F.array_join(F.transform("evidence", lambda e: F.concat(e["paper_id"], F.lit("|"), e["text"])), "; "), 256)
    return compare.gap_support(rows, 2).select("leader", "gap", "n_items", "paper_count", F.array_join("supporting_papers", "; ").alias("supporting_papers"), told.alias("evidence"))


@_add("c2_research_gaps")
def _(spark, sf):
    """Parts as limitations that suppliers report; tests compare with one pass in order."""
    p = table(spark, sf, "part")
    rows = p.select(F.col("p_partkey").alias("item_ord"), (F.col("p_partkey") % 40).cast("string").alias("paper_id"), F.lit("t").alias("title"), F.concat_ws(" ", "p_name", "p_type").alias("limitation"), F.col("p_brand").alias("evidence_text"), F.lit(1).alias("page"), F.lit("s").alias("section"))
    return compare.research_gaps(rows, "ring", 2).select("leader", "gap", "n_items", "paper_count")


@_add("u5_dedupe_in_channel", "SELECT event_type AS query, CAST(user_id AS VARCHAR) AS paper_id, row_number() OVER (PARTITION BY event_type ORDER BY v DESC, CAST(user_id AS VARCHAR)) - 1 AS rank FROM (SELECT event_type, user_id, max(value) AS v FROM events GROUP BY 1, 2)", cte=False)
def _(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_type").alias("query"), _s("user_id").alias("paper_id"), "value")
    return search.ranked(rows, F.desc("value"), "paper_id")


@_add("k4_matrix_channel", """, q AS (SELECT unnest(['Brand#12', '1-URGENT', 'supplier#000000003']) AS query), f AS (SELECT p.paper_id, title, concat_ws(' ', title, (SELECT string_agg(name, ' ' ORDER BY name) FROM task u WHERE u.paper_id = p.paper_id), (SELECT string_agg(name, ' ' ORDER BY name) FROM uses u WHERE u.paper_id = p.paper_id), (SELECT string_agg(name, ' ' ORDER BY name) FROM data u WHERE u.paper_id = p.paper_id), (SELECT string_agg(text, ' ' ORDER BY ord) FROM lim u WHERE u.paper_id = p.paper_id)) AS blob FROM paper p)
SELECT query, paper_id, row_number() OVER (PARTITION BY query ORDER BY title, paper_id) - 1 AS rank FROM q, f WHERE contains(lower(blob), lower(query))""")
def _(spark, sf):
    return search.matrix_channel(_profiles(spark, sf), _values(spark, "query", "Brand#12", "1-URGENT", "supplier#000000003"))


@_add("k4_entity_channel", """, q AS (SELECT unnest(['Brand#12', 'bolt']) AS query) SELECT query, paper_id, row_number() OVER (PARTITION BY query ORDER BY title, paper_id) - 1 AS rank FROM (SELECT DISTINCT query, paper_id, title FROM q, uses JOIN paper USING (paper_id) WHERE contains(lower(name), lower(query)))""")
def _(spark, sf):
    return search.entity_channel(profiles.find_papers_by_entity(*corpus_graph(spark, sf), _values(spark, "query", "Brand#12", "bolt")))


@_add("t2_explore_graph", _EDGES + "SELECT DISTINCT source AS seed, target AS paper_id, relationship, direction, 1 AS hop FROM adj")
def _(spark, sf):
    return traverse.explore_graph(corpus_graph(spark, sf)[1], records(spark, sf).select("paper_id"))


@_add("t1_neighbors_with_titles", _EDGES + "SELECT DISTINCT a.source AS seed, a.target AS paper_id, relationship, direction, title, coalesce((SELECT string_agg(name, '; ' ORDER BY name) FROM task u WHERE u.paper_id = a.target), '') AS tasks, coalesce((SELECT string_agg(name, '; ' ORDER BY name) FROM uses u WHERE u.paper_id = a.target), '') AS methods, (SELECT count(*) FROM lim u WHERE u.paper_id = a.target) AS limitation_count FROM adj a JOIN paper p ON p.paper_id = a.target")
def _(spark, sf):
    nodes, edges = corpus_graph(spark, sf, nodes=("Paper", "Method", "Task"), edges=(*profiles.ITEM_EDGES, "USES", "TARGETS", *PAPER_EDGES))
    return traverse.paper_neighbors(edges, records(spark, sf).select("paper_id"), nodes=nodes)


@_add("k5_boost_of_two_hops", ", step AS (SELECT source, target, 0.7 AS w FROM cites UNION ALL SELECT target, source, 0.8 FROM cites), one AS (SELECT source, target, min(w) AS w FROM step GROUP BY 1, 2), two AS (SELECT a.source AS seed, b.target, arg_min(b.w, (a.target, b.w)) AS w FROM one a JOIN one b ON a.target = b.source WHERE b.target <> a.source AND (a.source, b.target) NOT IN (SELECT (source, target) FROM one) GROUP BY 1, 2) SELECT source AS seed, target AS paper_id, w::DOUBLE AS boost FROM one UNION ALL SELECT seed, target, w::DOUBLE / 2 FROM two")
def _(spark, sf):
    seeds = records(spark, sf).select("paper_id")
    return search.graph_distance_boost(traverse.expand_graph(corpus_graph(spark, sf, nodes=(), edges=("CITES",))[1], seeds, 2, ("CITES", "CITED_BY")))


# hubs: tasks and methods that a large share of all papers has

_PARTS = "WITH m AS (SELECT 'p' || p_partkey AS paper_id, p_partkey, unnest(string_split(p_name, ' ')) AS name FROM part), t AS (SELECT 'p' || p_partkey AS paper_id, unnest([p_type, p_brand]) AS name FROM part), s AS (SELECT paper_id, string_agg(DISTINCT name, ' ' ORDER BY name) AS ms FROM m GROUP BY 1)"


def _hub_papers(spark, sf):
    """Parts as papers: tasks are their type and brand, methods the words of their name."""
    p = table(spark, sf, "part")
    key = F.concat(F.lit("p"), F.col("p_partkey").cast("string"))
    return infer.paper_classes(p.select(key.alias("paper_id"), F.array("p_type", "p_brand").alias("tasks"), F.split("p_name", " ").alias("methods"), "p_partkey"))


def _asked_parts(spark, sf, name="paper_id"):
    return table(spark, sf, "part").filter("p_partkey % 20 = 0").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias(name))


def _part_name(papers):
    return papers.dropDuplicates(["part"]).select("part", F.array_join("methods", " ").alias("methods"))


@_add("j7_contrast_parts", _PARTS + ", g AS (SELECT t.name AS task, ms AS methods, count(*) AS n_papers FROM t JOIN s USING (paper_id) GROUP BY 1, 2) SELECT *, CAST(sum(n_papers) OVER (PARTITION BY task) - n_papers AS BIGINT) AS n_against FROM g", cte=False)
def _(spark, sf):
    papers = _hub_papers(spark, sf)
    return infer.contrast_parts(papers).join(_part_name(papers), "part").drop("part")


@_add("j7_contrasts_of_hub_tasks", _PARTS + """, a AS (SELECT 'p' || p_partkey AS paper_id FROM part WHERE p_partkey % 20 = 0)
SELECT DISTINCT least(x.paper_id, y.paper_id) AS source, greatest(x.paper_id, y.paper_id) AS target FROM a JOIN t x USING (paper_id) JOIN t y ON y.name = x.name JOIN s p ON p.paper_id = x.paper_id JOIN s q ON q.paper_id = y.paper_id WHERE p.ms <> q.ms""", cte=False)
def _(spark, sf):
    return infer.expand_contrasts(_hub_papers(spark, sf), _asked_parts(spark, sf))


@_add("j10_shared_method_classes", _PARTS + ", u AS (SELECT DISTINCT paper_id, name FROM m), g AS (SELECT name AS method, ms AS methods, count(*) AS n_papers FROM u JOIN s USING (paper_id) GROUP BY 1, 2) SELECT *, CAST(sum(n_papers) OVER (PARTITION BY method) - n_papers AS BIGINT) AS n_others FROM g", cte=False)
def _(spark, sf):
    papers = _hub_papers(spark, sf)
    return infer.shared_method_classes(papers).join(_part_name(papers), "part").drop("part")


@_add("j10_shared_hub_methods", _PARTS + ", u AS (SELECT DISTINCT paper_id, p_partkey, name FROM m) SELECT a.paper_id AS source, b.paper_id AS target, name AS method FROM u a JOIN u b USING (name) WHERE a.p_partkey % 20 = 0 AND a.paper_id <> b.paper_id", cte=False)
def _(spark, sf):
    return infer.expand_shared_methods(_hub_papers(spark, sf), _asked_parts(spark, sf))


def _hub_edges(spark, sf):
    """Parts cite the part of the next line of an order; they share their brand and size as methods."""
    key = lambda c: F.concat(F.lit("p"), F.col(c).cast("string"))
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", key("l_partkey").alias("at"))
    next_ = line.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("at").alias("to"))
    cites = line.join(next_, ["l_orderkey", "l_linenumber"]).select(F.lit("CITES").alias("type"), F.col("at").alias("source"), F.col("to").alias("target")).filter("source <> target").distinct()
    size = F.concat(F.lit("size "), F.col("p_size").cast("string"))
    return cites.union(table(spark, sf, "part").select(F.lit("USES"), key("p_partkey"), F.explode(F.array("p_brand", size))))


_HUB_STEP = """WITH h AS (SELECT 'p' || p_partkey AS paper_id, unnest([p_brand, 'size ' || p_size]) AS m FROM part),
c AS (SELECT DISTINCT 'p' || a.l_partkey AS source, 'p' || b.l_partkey AS target FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_partkey <> b.l_partkey),
adj AS (SELECT source, target FROM c UNION SELECT target, source FROM c UNION SELECT a.paper_id, b.paper_id FROM h a JOIN h b USING (m) WHERE a.paper_id <> b.paper_id),
one AS (SELECT source AS seed, target AS paper_id FROM adj WHERE CAST(substr(source, 2) AS BIGINT) % 20 = 0),
two AS (SELECT DISTINCT o.seed, b.target AS paper_id FROM one o JOIN adj b ON b.source = o.paper_id WHERE b.target <> o.seed) """


@_add("t3_reach_counts", _HUB_STEP + "SELECT paper_id, 1 AS hop, count(*) AS n_seeds FROM one GROUP BY 1 UNION ALL SELECT paper_id, 2, count(*) FROM two ANTI JOIN one USING (seed, paper_id) GROUP BY 1", cte=False)
def _(spark, sf):
    return traverse.reach_counts(_hub_edges(spark, sf), _asked_parts(spark, sf))


# upkeep

@_add("i9_pending_extraction", "SELECT 'u' || user_id AS paper_id FROM (SELECT user_id, min(ts) AS a, max(ts) AS b FROM events GROUP BY 1) WHERE user_id % 6 IN (0, 1, 5)", cte=False)
def _(spark, sf):
    """Forced; never extracted; never parsed; parsed with the present content; parsed before; parsed after the extraction."""
    u = table(spark, sf, "events").groupBy("user_id").agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    k = F.col("user_id") % 6
    rows = u.select(
        F.concat(F.lit("u"), _s("user_id")).alias("paper_id"), (k == 0).alias("forced"), F.when(k.isin(1), None).when(k == 5, F.col("a")).otherwise(F.col("b")).alias("extracted_at"),
        F.when(k == 2, None).when(k == 5, F.expr("b + interval 1 second")).otherwise(F.col("a")).alias("parsed_at"), F.when(k == 3, "now").otherwise("old").alias("parsed_sha"), F.lit("now").alias("current_sha"),
    )
    return incremental.pending_extraction(rows)


_AV = "SELECT 'Author' AS kind, 'AUTHORED_BY' AS type, 'p' || c_custkey AS source, name FROM (SELECT c_custkey, unnest([c_name, 'Same Person']) AS name FROM customer) UNION ALL SELECT 'Venue', 'PUBLISHED_IN', 'p' || c_custkey, c_mktsegment FROM customer WHERE c_custkey % 2 = 0"


def _people(spark, sf) -> DataFrame:
    c = table(spark, sf, "customer")
    return c.select(F.concat(F.lit("p"), _s("c_custkey")).alias("paper_id"), F.array("c_name", F.lit("Same Person"), F.lit(" ")).alias("authors"), F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).otherwise("").alias("venue"))


@_add("i11_authors_and_venues", f"SELECT DISTINCT type, source, lower(kind) || '_' || substr(sha256('default:' || kind || ':' || lower(name)), 1, 12) AS target FROM ({_AV})", cte=False)
def _(spark, sf):
    return graph.metadata_graph(_people(spark, sf))[1].select("type", "source", "target")


@_add("i11_author_nodes", f"SELECT DISTINCT kind AS type, name FROM ({_AV})", cte=False)
def _(spark, sf):
    return graph.metadata_graph(_people(spark, sf))[0].select("type", "name")


@_add("i17_upsert_registry", """SELECT 'default' AS workspace_id, 'd/' || doc_id AS source_path, 'p' || doc_id AS paper_id, CASE WHEN doc_id % 3 = 0 THEN 'new' ELSE 'old' END AS content_hash, 'ref' AS source_ref, CASE WHEN doc_id % 6 = 0 THEN 'Z' ELSE '' END AS zotero_key, '' AS doi,
  CASE WHEN doc_id % 4 = 0 AND doc_id % 3 = 0 THEN 2 ELSE 1 END AS assigned, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS updated FROM documents WHERE doc_id % 4 <> 0 OR doc_id % 3 = 0""", cte=False)
def _(spark, sf):
    """Known paths that stay, known ones with new values and empty ones, and new paths."""
    d, i, k = table(spark, sf, "documents"), _s("doc_id"), F.col("doc_id")
    base = [F.lit("default").alias("workspace_id"), F.concat(F.lit("d/"), i).alias("source_path"), F.concat(F.lit("p"), i).alias("paper_id")]
    at = lambda n: F.timestamp_seconds(F.lit(n))
    old = d.filter(k % 4 != 0).select(*base, F.lit("old").alias("content_hash"), F.lit("ref").alias("source_ref"), F.lit("").alias("zotero_key"), F.lit("").alias("doi"), at(1).alias("assigned_at"), at(1).alias("updated_at"))
    new = d.filter(k % 3 == 0).select(*base, F.lit("new").alias("content_hash"), F.when(k % 4 == 0, "ref").otherwise("").alias("source_ref"), F.when(k % 6 == 0, "Z").otherwise("").alias("zotero_key"), F.lit("").alias("doi"))
    out = incremental.upsert_registry(old, new, at(2))
    return out.select("workspace_id", "source_path", "paper_id", "content_hash", "source_ref", "zotero_key", "doi", F.unix_seconds("assigned_at").cast("int").alias("assigned"), F.unix_seconds("updated_at").cast("int").alias("updated"))


@_add("i10_merge_graph", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_name END AS name FROM customer", cte=False)
def _(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return graph.merge_graph(c, c.filter("id % 3 = 0").withColumn("name", F.lit("new")), "id")


@_add("s8_valid_extractions", "SELECT 'd' || doc_id AS paper_id, doc_id % 5 IN (0, 4) AS good FROM documents WHERE doc_id % 5 > 0 OR true", cte=False)
def _(spark, sf):
    """A good record; an item without text; one without evidence; page 0; no items at all."""
    k = F.col("doc_id") % 5
    item = F.struct(F.when(k != 1, F.col("lang")).alias("text"), F.when(k != 2, F.col("source")).alias("evidence_text"), F.when(k == 3, 0).otherwise(1).cast("long").alias("page"), F.lit("").alias("section"))
    none = F.array().cast("array<struct<text:string,evidence_text:string,page:bigint,section:string>>")
    rows = table(spark, sf, "documents").select(F.concat(F.lit("d"), _s("doc_id")).alias("paper_id"), F.when(k < 4, F.array(item)).alias("limitations"), none.alias("contributions"), F.when(k == 4, None).otherwise(none).alias("claims"))
    good, bad = sources.valid_extractions(rows)
    return good.select("paper_id", F.lit(True).alias("good")).union(bad.select("paper_id", F.lit(False)))


@_add("s17_extraction_inputs", """WITH s AS (SELECT conv_id, turn, '[' || role || ', pages ' || turn || '-' || (turn + 1) || ']' || chr(10) || substr(text, 1, 20) AS t FROM conversations), n AS (SELECT 'brand' AS k, p_brand AS name FROM part UNION SELECT 'name', p_name FROM part), r AS (SELECT k, name, row_number() OVER (PARTITION BY k ORDER BY name) AS i FROM n)
SELECT CAST(conv_id AS VARCHAR) AS paper_id, string_agg(t, chr(10) || chr(10) ORDER BY turn) AS prompt_text, (SELECT string_agg(l, chr(10) ORDER BY l) FROM (SELECT k || ': ' || string_agg(name, ', ' ORDER BY name) AS l FROM r WHERE i <= 30 GROUP BY k)) AS known_names FROM s GROUP BY 1""", cte=False)
def _(spark, sf):
    sections = table(spark, sf, "conversations").select(_s("conv_id").alias("paper_id"), F.col("turn").alias("pos"), F.col("role").alias("name"), F.col("turn").alias("page_start"), (F.col("turn") + 1).alias("page_end"), "text")
    p = table(spark, sf, "part")
    known = p.select(F.lit("brand").alias("entity_type"), F.col("p_brand").alias("name")).union(p.select(F.lit("name"), "p_name")).distinct()
    return sources.extraction_inputs(sections, known, 20, 30)


# files

def _written(lines: DataFrame, path: str, suffix: str) -> str:
    """A file with a suffix for each group ``g`` of lines (g, n, line), in the order of n."""
    spread = lines.repartition("g").sortWithinPartitions("g", "n").select("g", "line")
    plain = {"extension": suffix, "sep": "\x01", "quote": "\x00", "escape": "\x00", "comment": "\x02", "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    spread.write.mode("append").partitionBy("g").options(**plain).csv(path)
    return path


def _notes(spark, sf) -> DataFrame:
    """A note a nation: its name, then a section a customer."""
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    heads = n.join(c, F.col("n_nationkey") == F.col("c_nationkey"), "left_semi").select(F.col("n_nationkey").alias("g"), F.lit(-1).cast("long").alias("n"), F.concat(F.lit("# "), "n_name").alias("line"))
    body = F.explode(F.array(F.concat(F.lit("## "), "c_name"), F.concat(F.lit("works in "), "c_mktsegment")))
    return heads.union(c.select(F.col("c_nationkey").alias("g"), F.col("c_custkey").alias("n"), body.alias("line")).select("g", (F.col("n") * 2 + (~F.col("line").startswith("##")).cast("long")).alias("n"), "line"))


_NOTES = "WITH s AS (SELECT c_nationkey AS g, n_name, c_name, c_mktsegment, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) + 1 AS page FROM customer JOIN nation ON n_nationkey = c_nationkey)"
_FILE = _NOTES + ", f AS (SELECT g, '# ' || any_value(n_name) || chr(10) || string_agg('## ' || c_name || chr(10) || 'works in ' || c_mktsegment || chr(10), '' ORDER BY page) AS content FROM s GROUP BY 1)"


@_add("s4_read_markdown_notes", _NOTES + " SELECT n_name AS title, n_name AS name, CAST(1 AS BIGINT) AS page, '' AS text FROM s GROUP BY 1, 2 UNION ALL SELECT n_name, c_name, page, 'works in ' || c_mktsegment FROM s", cte=False)
def _(spark, sf):
    return sources.read_markdown_notes(spark, _written(_notes(spark, sf), scratch(spark, "notes"), "md")).select("title", "name", "page", "text")


def _entries(spark, sf) -> DataFrame:
    """A bibliography a nation, with an entry a supplier that cites the two before it; nested braces, quotes and bare values."""
    i = F.col("s_suppkey")
    form = _pick(
        i % 3, F.concat(F.lit(" title = {The {Big} "), "s_name", F.lit("}, year={1990}, author = {Doe, Jane and Roe, R.}, journal={J {of} X}")),
        F.concat(F.lit(' title = "The '), "s_name", F.lit('", year = 1991, author="Doe, Jane and Roe, R.", booktitle = {C}')), F.concat(F.lit(" title={The "), "s_name", F.lit("}, year = \"in 1992\", publisher={P}, school={S}")),
    )
    line = F.concat(F.lit("@Article{k"), i.cast("string"), F.lit(","), form, F.lit(", doi={10.1/"), i.cast("string"), F.lit("}, citations={k"), (i - 1).cast("string"), F.lit("; k"), (i - 2).cast("string"), F.lit("}}"))
    return table(spark, sf, "supplier").select(F.col("s_nationkey").alias("g"), i.alias("n"), line.alias("line"))


_BIB = """WITH b AS (SELECT 'k' || s_suppkey AS bib_key, 'article' AS entry_type, 'The ' || CASE s_suppkey % 3 WHEN 0 THEN '{Big} ' ELSE '' END || s_name AS title, 1990 + s_suppkey % 3 AS year, CASE s_suppkey % 3 WHEN 2 THEN '' ELSE 'Doe, Jane; Roe, R.' END AS authors, ['J {of} X', 'C', 'P'][s_suppkey % 3 + 1] AS venue,
  '10.1/' || s_suppkey AS doi, 'k' || (s_suppkey - 1) || '; k' || (s_suppkey - 2) AS citations, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS INTEGER) AS bib_ord, s_suppkey AS i FROM supplier)"""


@_add("s5_read_bibtex", _BIB + " SELECT * EXCLUDE (i) FROM b", cte=False)
def _(spark, sf):
    read = sources.read_bibtex(spark, _written(_entries(spark, sf), scratch(spark, "bib"), "bib"))
    return read.select("bib_key", "entry_type", "title", "year", F.array_join("authors", "; ").alias("authors"), "venue", "doi", "citations", "bib_ord")


def _items(spark, sf) -> DataFrame:
    """Customers as items of a library: with both spellings of the DOI, some without a title, a date or authors."""
    i, k = F.col("c_custkey"), F.col("c_custkey") % 4
    person = lambda kind, first, last: F.struct(kind.alias("creatorType"), first.alias("firstName"), last.alias("lastName"))
    people = F.array(person(F.lit("author"), F.lit("Jane"), F.col("c_name")), person(F.lit("editor"), F.lit("No"), F.lit("Body")), person(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("Solo")))
    data = F.struct(
        F.concat(F.lit("K"), _s("c_custkey")).alias("key"), F.when(k != 3, F.concat(F.lit(" On "), "c_name")).alias("title"), F.when(k == 1, "book").alias("itemType"), F.when(k == 0, "2001-05-03").when(k == 1, "May 2002").alias("date"),
        F.when(k == 0, F.concat(F.lit("10.1/"), _s("c_custkey"))).alias("DOI"), F.when(k == 1, F.concat(F.lit("10.2/"), _s("c_custkey"))).alias("doi_"), F.when(k == 2, F.col("c_mktsegment")).alias("proceedingsTitle"), F.when(k == 0, people).alias("creators"), i.alias("version"), F.lit("http://u").alias("url"),
    )
    return table(spark, sf, "customer").select(F.col("c_nationkey").alias("g"), data.alias("data"))


_ITEMS = "SELECT 'K' || c_custkey AS bib_key, CASE c_custkey % 4 WHEN 1 THEN 'book' ELSE 'misc' END AS entry_type, 'On ' || c_name AS title, CASE c_custkey % 4 WHEN 0 THEN CAST(2001 AS BIGINT) END AS year, CASE c_custkey % 4 WHEN 0 THEN 'Jane ' || c_name || '; Solo' ELSE '' END AS authors, CASE c_custkey % 4 WHEN 2 THEN c_mktsegment ELSE '' END AS venue, CASE c_custkey % 4 WHEN 0 THEN '10.1/' || c_custkey WHEN 1 THEN '10.2/' || c_custkey ELSE '' END AS doi, c_custkey AS zotero_version, 'http://u' AS url FROM customer WHERE c_custkey % 4 < 3"
_ITEM_COLUMNS = ("bib_key", "entry_type", "title", "year", "venue", "doi", "zotero_version", "url")


@_add("s6_read_library_export", _ITEMS, cte=False)
def _(spark, sf):
    """A file a nation, as a list or as an object with items."""
    listed = F.to_json(F.collect_list("data"))
    files_ = _items(spark, sf).groupBy("g").agg(listed.alias("l")).select("g", F.regexp_replace(F.when(F.col("g") % 2 == 0, F.col("l")).otherwise(F.concat(F.lit('{"items": '), "l", F.lit("}"))), '"doi_"', '"doi"').alias("value"))
    path = scratch(spark, "export")
    files_.repartition("g").write.partitionBy("g").text(path)
    return sources.read_library_export(spark, path).select(*_ITEM_COLUMNS, F.array_join("authors", "; ").alias("authors"))


@_add("s7_read_library_delta", _ITEMS, cte=False)
def _(spark, sf):
    feed = _items(spark, sf).select(F.regexp_replace(F.to_json(F.struct("data")), '"doi_"', '"doi"').alias("value"))
    return sources.read_library_delta(feed).select(*_ITEM_COLUMNS, F.array_join("authors", "; ").alias("authors"))


@_add("s8_read_extractions", "SELECT 'd' || doc_id AS paper_id, lang AS title, CAST(2000 + doc_id % 20 AS BIGINT) AS year, source AS methods, doc_id % 3 > 0 AS good FROM documents", cte=False)
def _(spark, sf):
    """A folder of JSON files with a list of records each; every third has an item on page 0."""
    item = F.struct(F.col("lang").alias("text"), F.lit("e").alias("evidence_text"), F.when(F.col("doc_id") % 3 == 0, 0).otherwise(2).alias("page"), F.lit("s").alias("section"))
    rec = F.struct(F.concat(F.lit("d"), _s("doc_id")).alias("paper_id"), F.col("lang").alias("title"), (2000 + F.col("doc_id") % 20).alias("year"), F.array("source").alias("methods"), F.array(item).alias("claims"))
    path = scratch(spark, "extracted")
    table(spark, sf, "documents").groupBy(F.crc32(_s("doc_id").cast("binary")).alias("g")).agg(F.to_json(F.collect_list(rec)).alias("value")).withColumn("g", F.col("g") % 8).groupBy("g").agg(F.regexp_replace(F.array_join(F.collect_list("value"), ","), r"\],\[", ",").alias("value")).repartition("g").write.partitionBy("g").text(path)
    good, bad = sources.read_extractions(spark, path)
    cut = lambda df, ok: df.select("paper_id", "title", "year", F.array_join("methods", "; ").alias("methods"), F.lit(ok).alias("good"))
    return cut(good, True).union(cut(bad, False))


def _folder(spark, sf) -> str:
    root = _written(_notes(spark, sf), scratch(spark, "papers"), "md")
    _written(_notes(spark, sf).filter("g = 1").withColumn("g", F.lit(-1)), root, "tmp")
    return _written(_entries(spark, sf), root, "bib")


def _group() -> Column:
    return F.regexp_extract("path", r"/g=(-?\d+)/", 1).cast("int")


@_add("s1_scan_corpus", _FILE + " SELECT g, 'md' AS kind, sha256(content) AS sha256, strlen(content) AS size FROM f", cte=False)
def _(spark, sf):
    """Notes alone; the bibliographies are scanned too and left out by their suffix, temporary files aren't scanned."""
    found = files.fingerprint_files(files.scan_corpus(spark, _folder(spark, sf)))
    return found.select(_group().alias("g"), F.element_at(F.split("path", r"\."), -1).alias("kind"), "sha256", "size").filter("kind = 'md'")


@_add("s2_filter_ignored", _FILE + " SELECT g FROM f WHERE g NOT IN (3, 4) AND NOT (g BETWEEN 10 AND 19) OR g = 12", cte=False)
def _(spark, sf):
    root = _folder(spark, sf)
    found = files.scan_corpus(spark, root).filter(F.col("path").endswith(".md"))
    base = F.regexp_extract("path", r"^(.*?)/g=", 1)
    where = found.select(base.alias("b")).first()["b"]
    return files.filter_ignored(found, where, ["# a remark", "g=3/", "/g=4/**", "g=1?", "!g=12"]).select(_group().alias("g"))


def _indexed(spark, sf):
    return index_pipeline(spark, _folder(spark, sf))


@_add("i15_index_pipeline", _BIB + """, n AS (SELECT DISTINCT n_name FROM nation JOIN customer ON c_nationkey = n_nationkey)
SELECT 'Paper' AS type, n_name AS name, false AS metadata_only FROM n UNION ALL SELECT 'Paper', title, true FROM b UNION ALL SELECT 'Author', unnest(['Doe, Jane', 'Roe, R.']), NULL UNION ALL SELECT DISTINCT 'Venue', venue, NULL FROM b
UNION ALL SELECT 'CITES', a.bib_key || ' ' || c.bib_key, NULL FROM b a JOIN b c ON c.i IN (a.i - 1, a.i - 2)""", cte=False)
def _(spark, sf):
    done = _indexed(spark, sf)
    nodes = done.nodes.select("type", F.coalesce("title", "name").alias("name"), "metadata_only")
    return nodes.union(done.edges.filter("type = 'CITES'").select("type", F.concat_ws(" ", "source", "target"), F.lit(None).cast("boolean")))


@_add("i13_remove_paths", _FILE + " SELECT 'snapshot' AS store, count(*) + (SELECT count(DISTINCT s_nationkey) FROM supplier WHERE s_nationkey % 2 = 1) AS n FROM f WHERE g % 2 = 1 UNION ALL SELECT 'registry', count(*) FROM f WHERE g % 2 = 1 UNION ALL SELECT 'sections', sum(k) FROM (SELECT count(*) + 1 AS k FROM s WHERE g % 2 = 1 GROUP BY g) UNION ALL SELECT 'entries', count(*) FROM supplier WHERE s_nationkey % 2 = 1 UNION ALL SELECT 'papers', count(*) FROM f WHERE g % 2 = 1", cte=False)
def _(spark, sf):
    """Files of nations with an even key are gone, notes and bibliographies."""
    done = _indexed(spark, sf)
    left = remove_paths(done, done.snapshot.filter(_group() % 2 == 0).select("path"))
    notes = left.nodes.filter("type = 'Paper' and not metadata_only")
    out = None
    for name, rows in (("snapshot", left.snapshot), ("registry", left.registry), ("sections", left.sections), ("entries", left.entries), ("papers", notes)):
        one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("store"), "n")
        out = one if out is None else out.union(one)
    return out


_BUILD = """
WITH r AS (SELECT o_orderkey AS i, 'p' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS paper_id, o_custkey, o_orderpriority FROM orders),
l AS (SELECT DISTINCT r.i, r.paper_id, p_type AS t, CASE r.i % 3 WHEN 0 THEN p_type WHEN 1 THEN lower(p_type) ELSE substr(p_type, 1, 1) || lower(substr(p_type, 2)) || '.' END AS spelled FROM r JOIN lineitem ON l_orderkey = r.i JOIN part ON p_partkey = l_partkey),
canon AS (SELECT t, arg_min(spelled, paper_id) AS name FROM l GROUP BY 1), uses AS (SELECT DISTINCT paper_id, name FROM l JOIN canon USING (t)),
seg AS (SELECT r.paper_id, r.i, substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 12) AS t, CASE r.i % 2 WHEN 0 THEN upper(substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 12)) ELSE substr(sha256(CAST(c_custkey AS VARCHAR)), 1, 12) END AS spelled FROM r JOIN customer ON c_custkey = o_custkey), segc AS (SELECT t, arg_min(spelled, paper_id) AS name FROM seg GROUP BY 1)"""


def _build(spark, sf, cite_by_links=False):
    """Orders as papers with two or three spellings of a name, entries for every second with a year for every fourth, references for every fifth. Entries cite by key or stem, which leaves out those linked by DOI, unless ``cite_by_links``."""
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    i = F.col("o_orderkey")
    pid = F.concat(F.lit("p"), F.lpad(i.cast("string"), 9, "0"))
    small = F.lower("p_type")
    spelled = _pick(F.col("l_orderkey") % 3, F.col("p_type"), small, F.concat(F.substring("p_type", 1, 1), F.substring(small, 2, 40), F.lit(".")))
    methods = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set(spelled).alias("methods"))
    word = F.substring(F.sha2(_s("c_custkey"), 256), 1, 12)  # customers' names are too much alike to stay apart
    segment = F.when(i % 2 == 0, F.upper(word)).otherwise(word)
    none = F.array().cast("array<string>")
    items = F.array().cast("array<struct<text:string,evidence_text:string,page:bigint,section:string>>")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(methods, "o_orderkey", "left").select(
        i.alias("_i"), pid.alias("paper_id"), F.concat(F.lit("Order "), i.cast("string")).alias("title"), F.lit(2000).cast("long").alias("year"), F.array(segment).alias("tasks"), F.coalesce("methods", none).alias("methods"), none.alias("datasets"), none.alias("metrics"),
        *[items.alias(k) for k in ("contributions", "claims", "limitations")],
    )
    rows = settle(rows)
    k = F.col("_i")
    papers = rows.select("paper_id", F.lit("").alias("path"), "title", F.lit("").alias("zotero_key"), F.lit("").alias("doi"))
    registry = rows.select("paper_id", F.concat(F.lit("/in/s"), k.cast("string"), F.lit(".pdf")).alias("source_path"), F.lit("").alias("zotero_key"), F.when(k % 4 == 2, F.concat(F.lit("10.1/"), k.cast("string"))).otherwise("").alias("doi"))
    entries = rows.filter(k % 2 == 0).select(
        k.alias("bib_ord"), F.concat(F.lit("b"), k.cast("string")).alias("bib_key"), F.when(k % 4 == 0, F.col("paper_id")).otherwise("").alias("source_stem"), F.lit("").alias("zotero_key"),
        F.when(k % 4 == 2, F.concat(F.lit("10.1/"), k.cast("string"))).otherwise("").alias("doi"), F.lit("").alias("title"), F.when(k % 4 == 0, 1980).cast("long").alias("year"), F.array(F.lit("Doe, J.")).alias("authors"), F.lit("V").alias("venue"),
        F.concat(F.lit("b"), (k - 2).cast("string"), F.lit("; b"), (k - 4).cast("string"), F.lit("; nobody")).alias("citations"),
    )
    alone = entries.filter("bib_ord % 20 = 0").withColumns({"bib_ord": F.col("bib_ord") + 10**12, "bib_key": F.concat(F.lit("x"), "bib_key"), "source_stem": F.lit(""), "title": F.lit("alone"), "citations": F.col("bib_key")})
    refs = rows.filter(k % 5 == 1).select(F.concat(F.lit("r"), k.cast("string")).alias("ref_id"), "paper_id", F.concat(F.lit("10.1/"), (k + 1).cast("string")).alias("doi"), F.lit("").alias("title"), F.lit(None).cast("long").alias("year"), none.alias("authors"))
    return canonical_graph(rows.drop("_i"), papers, settle(entries.union(alone)), registry, refs, cite_by_links=cite_by_links)


@_add("i14_build_graph", _BUILD + """
SELECT paper_id, 'Order ' || i AS title, CASE WHEN i % 4 = 0 THEN 1980 ELSE 2000 END AS year, CASE WHEN i % 2 = 0 THEN 'Doe, J.' ELSE '' END AS authors, CASE WHEN i % 2 = 0 THEN 'V' ELSE '' END AS venue, CASE WHEN i % 4 = 2 THEN '10.1/' || i ELSE '' END AS doi,
  coalesce((SELECT string_agg(name, '; ' ORDER BY name) FROM uses u WHERE u.paper_id = r.paper_id), '') AS methods, (SELECT name FROM seg JOIN segc USING (t) WHERE seg.paper_id = r.paper_id) AS tasks FROM r
UNION ALL SELECT 'xb' || i, 'alone', 1980, 'Doe, J.', 'V', '', '', '' FROM r WHERE i % 20 = 0""", cte=False)
def _(spark, sf):
    nodes, edges, _ = _build(spark, sf)
    return profiles.paper_profiles(nodes, edges).select("paper_id", "title", "year", "authors", "venue", "doi", _line("methods").alias("methods"), _line("tasks").alias("tasks"))


@_add("i14_build_citations", _BUILD + """
SELECT a.paper_id AS source, b.paper_id AS target FROM r a JOIN r b ON b.i = a.i - 2 WHERE a.i % 2 = 0 UNION SELECT a.paper_id, b.paper_id FROM r a JOIN r b ON b.i = a.i - 4 WHERE a.i % 2 = 0 UNION SELECT 'xb' || i, paper_id FROM r WHERE i % 20 = 0 UNION SELECT a.paper_id, b.paper_id FROM r a JOIN r b ON b.i = a.i + 1 WHERE a.i % 5 = 1 AND b.i % 4 = 2""", cte=False)
def _(spark, sf):
    """Citations of all entries with a paper, by whatever rule they are linked."""
    return _build(spark, sf, cite_by_links=True)[1].filter("type = 'CITES'").select("source", "target")


@_add("i14_build_statistics", _BUILD + """, cb AS (SELECT a.i, b.i FROM r a JOIN r b ON b.i = a.i - 4 WHERE a.i % 4 = 0), n AS (SELECT count(*) AS n FROM r)
SELECT (SELECT n FROM n) + (SELECT count(*) FROM r WHERE i % 20 = 0) AS papers, (SELECT count(*) FROM r WHERE i % 20 = 0) AS bib_only, (SELECT count(*) FROM r WHERE i % 2 = 0) AS bib_linked, (SELECT count(*) FROM cb) + (SELECT count(*) FROM r WHERE i % 20 = 0) AS cites_from_bib,
  (SELECT count(*) FROM r a JOIN r b ON b.i = a.i + 1 WHERE a.i % 5 = 1 AND b.i % 4 = 2) AS cites_from_references, (SELECT count(*) FROM (SELECT * FROM l JOIN canon USING (t) WHERE spelled <> name)) + (SELECT count(*) FROM seg JOIN segc USING (t) WHERE spelled <> name) AS entities_resolved,
  (SELECT count(*) FROM (SELECT * FROM l JOIN canon USING (t) WHERE spelled = name)) + (SELECT count(*) FROM seg JOIN segc USING (t) WHERE spelled = name) AS entities_new""", cte=False)
def _(spark, sf):
    return _build(spark, sf)[2].select("papers", "bib_only", "bib_linked", "cites_from_bib", "cites_from_references", "entities_resolved", "entities_new")


@_add("i5_process_folder", """WITH f AS (SELECT DISTINCT c_nationkey AS g, 'md' AS kind FROM customer UNION ALL SELECT DISTINCT s_nationkey, 'bib' FROM supplier)
SELECT g, kind, 'changed' AS op FROM f WHERE g % 5 = 0 OR g % 7 = 3 UNION ALL SELECT g, kind, 'deleted' FROM f WHERE g % 7 = 3""", cte=False)
def _(spark, sf):
    """Some files had other contents before, some another name."""
    root = _folder(spark, sf)
    done = index_pipeline(spark, root)
    suffix = F.element_at(F.split("path", r"\."), -1)
    old = done.snapshot.withColumns({"sha256": F.when(_group() % 5 == 0, "other").otherwise(F.col("sha256")), "path": F.when(_group() % 7 == 3, F.concat("path", F.lit(".old."), suffix)).otherwise(F.col("path"))})
    _, changes = process_folder(spark, root, replace(done, snapshot=settle(old)))
    return changes.select(_group().alias("g"), suffix.alias("kind"), "op")


@_add("i16_rebuild", "SELECT event_type, count(*) AS n FROM events GROUP BY 1", cte=False)
def _(spark, sf):
    """Built, cleared and built again from other rows."""
    path, e = scratch(spark, "derived"), table(spark, sf, "events")
    count = lambda df: df.groupBy("event_type").agg(F.count("*").alias("n"))
    incremental.rebuild(count(e.filter("value > 1")), path)
    incremental.clear(spark, path)
    incremental.rebuild(count(e), path)
    return spark.read.parquet(path)
