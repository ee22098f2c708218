"""Structure of documents: pages, sections, titles and references."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .profiles import first_by

__all__ = [
    "SECTIONS", "guess_title", "merge_section_starts", "page_for_offset", "pages_to_documents", "parse_references", "reference_meta", "section_meta", "section_starts_layout", "section_starts_regex", "section_text", "split_references", "split_sections",
]

#: Names of sections and the headings that begin them (fixed values).
SECTIONS = {
    "Abstract": "abstract",
    "Introduction": r"(?:\d+\.?\s*)?(?:I{1,3}\.?\s*)?introduction",
    "RelatedWork": r"(?:\d+\.?\s*)?(?:related work|prior work|literature review|previous work)",
    "Background": r"(?:\d+\.?\s*)?(?:background|preliminaries)",
    "Method": r"(?:\d+\.?\s*)?(?:methods?|methodology|materials and methods|approach)",
    "Experiment": r"(?:\d+\.?\s*)?(?:experiments?|evaluation|results|experimental setup)",
    "Discussion": r"(?:\d+\.?\s*)?discussion",
    "Conclusion": r"(?:\d+\.?\s*)?(?:conclusion|conclusions)",
    "References": r"(?:\d+\.?\s*)?(?:references|bibliography)",
    "Acknowledgments": r"(?:\d+\.?\s*)?acknowledgments?",
}
LIMIT = 20_000
#: Lines that are no title, marks of references, and their parts (fixed values).
_TITLE_SKIP = r"(?i)^(abstract|introduction|\d+\.|arxiv|doi|http|www\.|@|university|proceedings|journal|vol\.|pp\.)"
_MARK = r"^\[?\d+\]?\.?\s+"
_DOI = r"(?i)\b(10\.\d{4,}/[^\s\]}>,;]+)"
_ARXIV = r"(?i)\barxiv[:\s]*(\d{4}\.\d{4,5})\b"
_YEAR = r"\b((?:19|20)\d{2})\b"
_AUTHORS = r"^([A-Z][A-Za-z\-']+(?:\s+[A-Z]\.)?(?:\s*,\s*[A-Z][A-Za-z\-']+(?:\s+[A-Z]\.)?)*)\s*[,.]"


def pages_to_documents(pages: DataFrame) -> DataFrame:
    """(doc, full_text) of ``pages`` (doc, page, text), joined by line feeds in page order."""
    ordered = F.array_sort(F.collect_list(F.struct("page", F.coalesce("text", F.lit("")).alias("text"))))
    return pages.groupBy("doc").agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "\n").alias("full_text"))


def section_starts_regex(docs: DataFrame) -> DataFrame:
    """(doc, name, pos) with the first offset, from 0, of each heading that has a line to itself.

    As blank lines before a heading belong to it, an offset may point at the first of them. Characters
    outside the basic plane count as one, like all others.
    """
    text = F.regexp_replace(F.regexp_replace("full_text", r"[\x1c-\x1f]", " "), r"[\x{10000}-\x{10FFFF}]", "\ufffd")
    hits = [F.struct(F.lit(name).alias("name"), F.regexp_instr(text, F.lit(rf"(?imdU)^\s*{heading}\s*$")).alias("at")) for name, heading in SECTIONS.items()]
    rows = docs.select("doc", F.explode(F.array(*hits)).alias("h")).filter("h.at > 0")
    return rows.select("doc", F.col("h.name").alias("name"), (F.col("h.at") - 1).cast("long").alias("pos"))


def section_starts_layout(docs: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc, name, pos) of headings in larger type, for ``lines`` (doc, page, line_no, text, size).

    A heading is a line of 80 characters at most, at least 1.12 times the size at the lower quartile. Offsets
    are looked up forwards in the text, line by line, which needs each document's lines in order. A document's text and its
    lines meet in one group, so the text is there once. Of rows with one ``doc`` the first text counts.
    """
    import re

    patterns = [(name, re.compile(rf"^{p}$", re.IGNORECASE)) for name, p in SECTIONS.items()]
    none = pd.DataFrame({"doc": [], "name": [], "pos": []}, dtype=object)  # columns of floats, the default, don't become strings

    def find(group: pd.DataFrame, texts: pd.DataFrame) -> pd.DataFrame:
        if group.empty or texts.empty:
            return none
        group = group.sort_values(["page", "line_no"])
        text, sizes = texts["full_text"].iloc[0] or "", sorted(group["size"])
        least = sizes[len(sizes) // 4] * 1.12
        at, taken, best = 0, set(), {}
        for line, size in zip(group["text"], group["size"], strict=True):
            if not line or size < least or len(line) > 80:
                continue
            pos = text.find(line, at)
            while pos in taken:
                pos = text.find(line, pos + 1)
            if pos < 0:
                continue
            at = pos + len(line)
            name = next((n for n, p in patterns if p.match(" ".join(line.split()))), None)
            if name:
                taken.add(pos)
                best[name] = min(pos, best.get(name, pos))
        return pd.DataFrame({"doc": [group["doc"].iloc[0]] * len(best), "name": list(best), "pos": list(best.values())}) if best else none

    kind = docs.schema["doc"].dataType.simpleString()
    stripped = lines.withColumn("text", F.trim("text")).filter("text <> '' and size is not null")
    return stripped.select("doc", "page", "line_no", "text", "size").groupBy("doc").cogroup(docs.select("doc", "full_text").groupBy("doc")).applyInPandas(find, f"doc {kind}, name string, pos bigint")


def merge_section_starts(regex: DataFrame, layout: DataFrame | None = None) -> DataFrame:
    """(doc, name, pos, detection): the smaller offset of each name, and which ways found any in the document."""
    both = regex.withColumn("_w", F.lit("regex"))
    if layout is not None:
        both = both.unionByName(layout.withColumn("_w", F.lit("blocks")))
    way = both.groupBy("doc").agg(F.min("_w").alias("_a"), F.max("_w").alias("_b"))
    how = way.select("doc", F.when(F.col("_a") != F.col("_b"), "merged").otherwise(F.col("_a")).alias("detection"))
    return both.groupBy("doc", "name").agg(F.min("pos").alias("pos")).join(how, "doc")


def page_for_offset(offsets: DataFrame, pages: DataFrame, column: str = "pos") -> DataFrame:
    """``offsets`` (doc, pos) with ``page``: the first page whose end, pages parted by one character, is at or behind the offset; else the last."""
    w = Window.partitionBy("doc").orderBy("page").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = pages.withColumn("_end", F.sum(F.length(F.coalesce("text", F.lit(""))) + 1).over(w)).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("page", "_end"))).alias("_p"))
    hit = F.filter("_p", lambda p: p["_end"] >= F.col(column))
    page = F.coalesce(F.get(hit, F.lit(0))["page"], F.element_at("_p", -1)["page"], F.lit(1))
    return offsets.join(ends, "doc", "left").withColumn("page", page).drop("_p")


def split_sections(docs: DataFrame, starts: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """(doc, pos, name, text, page_start, page_end): from each start to the next, trimmed and cut; without starts one ``FullText``."""
    w = Window.partitionBy("doc").orderBy("pos", "name")
    bounded = starts.select("doc", "name", "pos").withColumn("_next", F.lead("pos").over(w)).join(docs.select("doc", "full_text"), "doc")
    end = F.coalesce("_next", F.length("full_text"))
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    cut = bounded.select("doc", "name", F.col("pos").cast("long").alias("pos"), end.cast("long").alias("_end"), F.substring(strip(F.substring("full_text", F.col("pos") + 1, end - F.col("pos"))), 1, LIMIT).alias("text"))
    whole = docs.join(starts.select("doc"), "doc", "left_anti").filter(strip(F.col("full_text")) != "").select(
        "doc", F.lit("FullText").alias("name"), F.lit(0).cast("long").alias("pos"), F.length("full_text").cast("long").alias("_end"), F.substring("full_text", 1, LIMIT).alias("text")
    )
    out = cut.unionByName(whole)
    if pages is None:
        return out.withColumns({"page_start": F.lit(1).cast("long"), "page_end": F.lit(1).cast("long")}).drop("_end")
    first = page_for_offset(out, pages).withColumnRenamed("page", "page_start")
    return page_for_offset(first.withColumn("_last", F.col("_end") - 1), pages, "_last").withColumnRenamed("page", "page_end").drop("_end", "_last")


def guess_title(docs: DataFrame) -> DataFrame:
    """(doc, title): of the first 20 lines with text the first of over 8 characters that isn't boilerplate, else the first."""
    lines = F.filter(F.transform(F.split("full_text", r"\r\n|\r|\n"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    good = F.filter(F.slice(lines, 1, 20), lambda x: (F.length(x) > 8) & ~x.rlike(_TITLE_SKIP))
    return docs.select("doc", F.substring(F.coalesce(F.get(good, F.lit(0)), F.get(lines, F.lit(0))), 1, 300).alias("title"))


def section_text(sections: DataFrame, *names: str) -> DataFrame:
    """(doc, text) of each document's first section with one of the names."""
    wanted = sections.filter(F.lower("name").isin(*[n.lower() for n in names]))
    return wanted.groupBy("doc").agg(F.min_by("text", "pos").alias("text"))


def split_references(sections: DataFrame) -> DataFrame:
    """(doc, ref_no, raw) of reference sections (doc, text): an entry begins at ``[n]`` or ``n.``, a heading line is dropped.

    If that gives one entry of a text of over 80 characters, lines that begin with ``[n]`` part it.
    """
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    body = F.regexp_replace("text", r"(?iU)^\s*(?:references|bibliography)[^\S\r\n]*(?:\r\n|\r|\n|$)", "")
    lines = F.filter(F.transform(F.split(body, r"\r\n|\r|\n"), strip), lambda x: x != "")

    def grow(entries: Column, line: Column) -> Column:
        """A marked line, like the first, begins an entry; others go on with the last."""
        new = F.concat(entries, F.array(strip(F.regexp_replace(line, _MARK, ""))))
        last = F.concat_ws(" ", F.element_at(entries, -1), line)
        return F.when((F.size(entries) == 0) | line.rlike(_MARK), new).otherwise(F.concat(F.slice(entries, 1, F.size(entries) - 1), F.array(last)))

    found = sections.select("doc", "text", F.aggregate(lines, F.array().cast("array<string>"), grow).alias("_e"))
    parts = F.split("text", r"\n\s*(?=\[\d+\])")
    again = (F.size("_e") == 1) & (F.length("text") > 80) & (F.size(parts) > 1)
    whole = F.when(again, F.transform(parts, strip)).when(F.size("_e") == 0, F.array(strip(F.col("text")))).otherwise(F.col("_e"))
    out = found.select("doc", F.posexplode(F.filter(whole, lambda x: x != "")).alias("e", "raw"))
    return out.select("doc", (F.col("e") + 1).cast("int").alias("ref_no"), "raw")


def parse_references(entries: DataFrame) -> DataFrame:
    """``entries`` with doi, arxiv_id, year (the last), leading authors, and what is left as title."""
    raw = F.col("raw")
    found = F.regexp_extract(raw, _DOI, 1)
    doi = F.regexp_replace(found, "[.,;]+$", "")
    lead = F.regexp_extract(raw, _AUTHORS, 1)
    authors = F.filter(F.transform(F.split(lead, r",\s*"), lambda a: F.trim(a)), lambda a: a != "")
    years = F.regexp_extract_all(raw, F.lit(_YEAR), F.lit(1))
    rows = entries.select("*", doi.alias("doi"), F.regexp_extract(raw, _ARXIV, 1).alias("arxiv_id"), F.get(F.reverse(years), F.lit(0)).cast("long").alias("year"), authors.alias("authors"))
    bare = F.when(F.col("doi") != "", F.replace(raw, F.col("doi"), F.lit(" "))).otherwise(raw)
    bare = F.aggregate("authors", bare, lambda s, a: F.replace(s, a, F.lit(" ")))
    bare = F.when(F.col("year").isNotNull(), F.regexp_replace(bare, F.concat(F.lit(r"\b"), F.col("year").cast("string"), F.lit(r"\b")), F.lit(" "))).otherwise(bare)
    title = F.regexp_replace(F.regexp_replace(bare, r"(?U)\s+", " "), r"^[ .,;]+|[ .,;]+$", "")
    title = F.when((F.length(title) > 120) & F.contains(title, F.lit(". ")), F.substring_index(title, ". ", 1)).otherwise(title)
    return rows.withColumns({"title": F.substring(title, 1, 300), "raw": F.substring("raw", 1, 2000)})


def reference_meta(references: DataFrame) -> DataFrame:
    """(doc, count, parsed): entries, and those with a DOI, title or authors."""
    some: Column = (F.col("doi") != "") | (F.col("title") != "") | (F.size("authors") > 0)
    return references.groupBy("doc").agg(F.count("*").alias("count"), F.count_if(some).alias("parsed"))


def section_meta(docs: DataFrame, starts: DataFrame, sections: DataFrame) -> DataFrame:
    """(doc, detection, fallback, section_names) of each document."""
    names = sections.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda s: s["name"]).alias("section_names"))
    how = first_by(starts, ["doc"], "pos").select("doc", "detection")
    out = docs.select("doc").join(how, "doc", "left").join(names, "doc", "left")
    return out.select("doc", F.coalesce("detection", F.lit("none")).alias("detection"), F.col("detection").isNull().alias("fallback"), F.coalesce("section_names", F.array().cast("array<string>")).alias("section_names"))

