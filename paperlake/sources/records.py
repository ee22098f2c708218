"""Readers of notes, bibliographies, library feeds and extraction records, and small stores."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ids import path_stem, path_stem_slug
from ..functions.text import coerce_items, coerce_names, coerce_year, non_empty, venue_of
from ..schemas import EXTRACTION

__all__ = [
    "entity_catalog", "extraction_inputs", "library_items", "markdown_sections", "merge_catalog", "parse_bibtex", "raw_extractions", "read_bibtex", "read_extractions", "read_library_delta",
    "read_library_export", "read_markdown_notes", "stub_extractions", "upsert_embeddings", "valid_extractions",
]

SECTION_LIMIT = 20_000


def _texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def markdown_sections(notes: DataFrame) -> DataFrame:
    """Sections of ``notes`` (path, text): paper_id, title, name, page (their number), text.

    A section runs from a heading of level 1 to 6 to the next; text before the first is dropped. A note
    without headings is one ``FullText``; the title is the first heading.
    """
    lines = notes.select("path", "text", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    name = F.regexp_extract("line", r"^#{1,6}\s+(.+?)\s*$", 1)
    w = Window.partitionBy("path").orderBy("n")
    marked = lines.withColumn("name", non_empty(name)).withColumn("page", F.sum(F.col("name").isNotNull().cast("int")).over(w))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("name").isNull(), F.struct("n", "line")))), lambda s: s["line"]), "\n")
    parts = marked.filter("page > 0").groupBy("path", "page").agg(F.max("name").alias("name"), F.substring(F.trim(F.regexp_replace(body, r"^\s+|\s+$", "")), 1, SECTION_LIMIT).alias("text"))
    plain = notes.filter(~F.col("text").rlike(r"(?m)^#{1,6}\s+.+?\s*$") & (F.trim(F.regexp_replace("text", r"^\s+|\s+$", "")) != ""))
    whole = plain.select("path", F.lit(1).cast("long").alias("page"), F.lit("FullText").alias("name"), F.substring(F.regexp_replace("text", r"^\s+|\s+$", ""), 1, SECTION_LIMIT).alias("text"))
    out = parts.select("path", F.col("page").cast("long").alias("page"), "name", "text").unionByName(whole)
    title = F.first("name").over(Window.partitionBy("path").orderBy("page"))
    return out.select(path_stem_slug(F.col("path")).alias("paper_id"), "path", title.alias("title"), "name", "page", "text")


def read_markdown_notes(spark: SparkSession, path: str) -> DataFrame:
    return markdown_sections(_texts(spark, path))


def _fields(block: str) -> dict[str, str]:
    """Fields of the inside of one entry; values may hold braces within braces."""
    out: dict[str, str] = {}
    i, n = 0, len(block)
    while i < n:
        equals = block.find("=", i)
        if equals < 0:
            break
        name = block[i:equals].strip(" \t\r\n,")
        i = equals + 1
        while i < n and block[i].isspace():
            i += 1
        if i < n and block[i] == "{":
            depth, start = 0, i
            while i < n:
                depth += (block[i] == "{") - (block[i] == "}")
                i += 1
                if depth == 0:
                    break
            value = block[start + 1 : i - 1] if depth == 0 else block[start + 1 :]
        elif i < n and block[i] == '"':
            end = i + 1
            while end < n and (block[end] != '"' or block[end - 1] == "\\"):
                end += 1
            value, i = block[i + 1 : end], end + 1
        else:
            ends = [x for x in (block.find(",", i), block.find("\n", i)) if x >= 0]
            end = min(ends, default=n)
            value, i = block[i:end], end
        if name.replace("_", "").isalnum():
            out[name.lower()] = value.strip()
    return out


class _Entries:
    """UDTF over the text of one file: only matching braces needs a loop, the rest is columns."""

    def eval(self, text: str | None) -> Iterator[tuple]:
        import re

        for k, m in enumerate(re.finditer(r"@(\w+)\s*\{\s*([^,\s#]+)\s*,", text or "")):
            depth, end = 1, m.end()
            while end < len(text) and depth:
                depth += (text[end] == "{") - (text[end] == "}")
                end += 1
            yield k, m[1].lower(), m[2], _fields(text[m.end() : end - (depth == 0)])


def parse_bibtex(files: DataFrame) -> DataFrame:
    """Entries of ``files`` (path, text), in order ``bib_ord`` within a file."""
    entries = F.udtf(_Entries, returnType="bib_ord int, entry_type string, bib_key string, fields map<string,string>")
    spark = files.sparkSession
    spark.udtf.register("bib_entries_of", entries)
    rows = spark.sql("SELECT f.path, e.* FROM {files} f, LATERAL bib_entries_of(f.text) e", files=files)
    f = lambda k: F.coalesce(F.col("fields")[k], F.lit(""))
    cited = F.trim(f("citations"))
    return rows.select(
        "bib_key", "entry_type", f("title").alias("title"), non_empty(F.regexp_extract(f("year"), r"(\d{4})", 1)).cast("long").alias("year"),
        F.filter(F.transform(F.split(f("author"), r"(?i)\s+and\s+"), lambda a: F.trim(a)), lambda a: a != "").alias("authors"),
        venue_of(*[f(k) for k in ("journal", "booktitle", "publisher", "school", "institution")]).alias("venue"), f("doi").alias("doi"),
        F.when(cited.startswith("{") & cited.endswith("}"), F.expr("substring(trim(fields['citations']), 2, length(trim(fields['citations'])) - 2)")).otherwise(cited).alias("citations"),
        F.col("path").alias("source_file"), path_stem(F.col("path")).alias("source_stem"), "bib_ord",
    )


def read_bibtex(spark: SparkSession, path: str) -> DataFrame:
    return parse_bibtex(_texts(spark, path))


_CREATORS = "array<struct<creatorType:string,firstName:string,lastName:string,name:string>>"
_ITEM = f"key string, title string, itemType string, date string, DOI string, publicationTitle string, proceedingsTitle string, publisher string, url string, version bigint, creators {_CREATORS}"


def library_items(items: DataFrame) -> DataFrame:
    """Bibliography rows of library items (a struct column ``data``); items without a title are dropped.

    Years are integers, null unless the date begins with four digits.
    """
    d = lambda k: F.coalesce(F.col(f"data.{k}"), F.lit(""))
    people = F.filter(F.coalesce("data.creators", F.array().cast(_CREATORS)), lambda c: c["creatorType"].isNull() | (c["creatorType"] == "author"))
    name = lambda c: F.trim(F.coalesce(non_empty(c["name"]), F.concat_ws(" ", non_empty(c["firstName"]), non_empty(c["lastName"]))))
    return items.filter(F.trim(d("title")) != "").select(
        F.col("data.key").alias("bib_key"), F.coalesce(F.col("data.itemType"), F.lit("misc")).alias("entry_type"), F.trim(d("title")).alias("title"),
        F.when(F.substring(d("date"), 1, 4).rlike("^[0-9]{4}$"), F.substring(d("date"), 1, 4).cast("long")).alias("year"),
        F.filter(F.transform(people, name), lambda x: x != "").alias("authors"), venue_of(d("publicationTitle"), d("proceedingsTitle"), d("publisher")).alias("venue"),
        d("DOI").alias("doi"), F.lit("").alias("citations"), F.lit("").alias("source_file"), F.lit("").alias("source_stem"),
        F.col("data.key").alias("zotero_key"), F.col("data.version").alias("zotero_version"), d("url").alias("url"),
    )


def read_library_export(spark: SparkSession, path: str) -> DataFrame:
    """A JSON export: a list of items, or an object with ``items``."""
    raw = _texts(spark, path).withColumn("text", _one_doi("text"))
    listed = F.coalesce(F.from_json(F.get_json_object("text", "$.items"), f"array<struct<{_ddl(_ITEM)}>>"), F.from_json("text", f"array<struct<{_ddl(_ITEM)}>>"))
    return library_items(raw.select(F.explode(listed).alias("data")))


def _one_doi(column: str) -> Column:
    """Both spellings of the field as one: names of columns don't tell them apart."""
    return F.regexp_replace(column, r'"doi"\s*:', '"DOI":')


def _ddl(fields: str) -> str:
    out, depth, part = [], 0, ""
    for c in fields + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            name, kind = part.split(None, 1)
            out.append(f"{name}:{kind}")
            part = ""
        else:
            part += c
    return ",".join(out)


def read_library_delta(feed: DataFrame) -> DataFrame:
    """Rows of a versioned feed (column ``value``: JSON with ``data``)."""
    return library_items(feed.select(F.from_json(_one_doi("value"), f"data struct<{_ddl(_ITEM)}>").alias("_v")).select("_v.data"))


def valid_extractions(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good and rejected records: an id, pages from 1, and text, evidence and section in each item."""
    item = lambda i: i["text"].isNotNull() & i["evidence_text"].isNotNull() & i["section"].isNotNull() & (i["page"] >= 1)
    good: Column = F.col("paper_id").isNotNull()
    for c in ("contributions", "claims", "limitations"):
        good = good & F.coalesce(F.forall(c, item), F.lit(True))
    flagged = records.withColumn("_good", F.coalesce(good, F.lit(False)))
    return flagged.filter("_good").drop("_good"), flagged.filter("not _good").drop("_good")


def read_extractions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Good and rejected records of a folder of JSON files, one record each."""
    return valid_extractions(spark.read.schema(EXTRACTION).option("multiLine", "true").json(path))


def raw_extractions(lines: DataFrame) -> DataFrame:
    """Records from loosely shaped JSON (column ``value``): lists may be strings or objects, years and pages text."""
    g = lambda k: F.get_json_object("value", f"$.{k}")
    names = [coerce_names(g(k)).alias(k) for k in ("tasks", "methods", "datasets", "metrics")]
    items = [coerce_items(g(k)).alias(k) for k in ("contributions", "claims", "limitations")]
    return lines.select(g("paper_id").alias("paper_id"), g("title").alias("title"), coerce_year(g("year")).alias("year"), *names, *items)


def stub_extractions(parsed: DataFrame, extracted: DataFrame) -> DataFrame:
    """``extracted`` and an empty record for each parsed paper (paper_id, title, source_stem) that has none."""
    missing = parsed.join(extracted.select("paper_id"), "paper_id", "left_anti")
    stubs = missing.select("paper_id", F.coalesce(non_empty(F.col("title")), F.col("source_stem")).alias("title"), "source_stem")
    return extracted.unionByName(stubs, allowMissingColumns=True)


def extraction_inputs(sections: DataFrame, catalog: DataFrame, limit: int = 8_000, names: int = 100) -> DataFrame:
    """(paper_id, prompt_text, known_names) for an external extractor: sections with page headers, cut, and known names."""
    text = F.format_string("[%s, pages %d-%d]\n%s", "name", "page_start", "page_end", F.substring("text", 1, limit))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", text.alias("t")))), lambda s: s["t"]), "\n\n")
    rank = F.row_number().over(Window.partitionBy("entity_type").orderBy("name"))
    known = catalog.withColumn("_r", rank).filter(F.col("_r") <= names).groupBy("entity_type").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("t"))
    digest = known.agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(": ", "entity_type", "t"))), "\n").alias("known_names"))
    # one row, of at most ``names`` names a type
    return sections.groupBy("paper_id").agg(body.alias("prompt_text")).crossJoin(F.broadcast(digest))


def upsert_embeddings(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Vectors by paper_id, new ones first."""
    return stored.join(new.select("paper_id"), "paper_id", "left_anti").unionByName(new)


def entity_catalog(profiles: DataFrame) -> DataFrame:
    """(entity_type, name) of all methods, tasks and datasets."""
    parts = [profiles.select(F.lit(kind).alias("entity_type"), F.explode(column).alias("name")) for kind, column in (("method", "methods"), ("task", "tasks"), ("dataset", "datasets"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).filter("name <> ''").distinct()


def merge_catalog(stored: DataFrame, new: DataFrame) -> DataFrame:
    return stored.unionByName(new).distinct()
