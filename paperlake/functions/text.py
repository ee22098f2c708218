"""Text functions on columns. All but ``sequence_ratio`` stay in the JVM."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "acronym", "author_surname", "character_bag", "coerce_items", "coerce_names", "coerce_page", "coerce_year", "contains_fold", "cosine_similarity", "embedding_text", "estimate_tokens", "first_evidence_text", "join_evidence",
    "keyword_score", "length_bound", "non_empty", "normalize_arxiv_id", "normalize_paper_ref", "normalize_text", "ratio_bound", "remote_pdf_ref", "safe_merge", "sequence_ratio", "split_citation_keys", "titles_compatible", "tokens_of", "truncate_evidence", "venue_of", "words_of",
]

SPACES = r"(?U)\s+"


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def non_empty(c: Column) -> Column:
    """Null for an empty string."""
    return F.nullif(c, F.lit(""))


def normalize_text(c: Column) -> Column:
    """Lower case, signs as spaces, single spaces."""
    return _trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)[^\w\s]", " "), SPACES, " "))


def words_of(c: Column) -> Column:
    """Words of a normalised text; none for an empty one."""
    return F.filter(F.split(normalize_text(c), " "), lambda w: w != "")


def acronym(c: Column) -> Column:
    """First letters of the words of the normalised text."""
    return F.array_join(F.transform(words_of(c), lambda w: F.substring(w, 1, 1)), "")


def safe_merge(a: Column, b: Column) -> Column:
    """May two normalised keys be one name: equal, or both longer than 3 and half of the smaller set of words shared."""
    x, y = (F.array_distinct(F.filter(F.split(k, " "), lambda w: w != "")) for k in (a, b))
    smaller = F.least(F.size(x), F.size(y))
    shared = F.size(F.array_intersect(x, y))
    return (a == b) | ((F.length(a) > 3) & (F.length(b) > 3) & ((smaller == 0) | (shared * 2 >= smaller)))


def length_bound(a: Column, b: Column, least: float) -> Column:
    """False only where ``sequence_ratio`` can't reach ``least``; filters pairs before the costly ratio."""
    return 2 * F.least(F.length(a), F.length(b)) >= least * (F.length(a) + F.length(b))


_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "


def character_bag(key: Column) -> Column:
    """How often each common character occurs, and all others together."""
    counts = [F.length(key) - F.length(F.replace(key, F.lit(x), F.lit(""))) for x in _LETTERS]
    total = counts[0]
    for c in counts[1:]:
        total = total + c
    return F.array(*counts, F.length(key) - total)


def common_share(a: Column, b: Column, bag_a: Column, bag_b: Column) -> Column:
    """An upper bound of the ratio: characters in common, twice, over both lengths."""
    shared = F.aggregate(F.zip_with(bag_a, bag_b, lambda x, y: F.least(x, y)), F.lit(0), lambda s, v: s + v)
    return 2.0 * shared / (F.length(a) + F.length(b))


def ratio_bound(a: Column, b: Column, bag_a: Column, bag_b: Column, least: float) -> Column:
    """False only where the ratio can't reach ``least``: characters in common bound the matches."""
    shared = F.aggregate(F.zip_with(bag_a, bag_b, lambda x, y: F.least(x, y)), F.lit(0), lambda s, v: s + v)
    return length_bound(a, b, least) & (2 * shared >= least * (F.length(a) + F.length(b)))


def _ratios(least: float):
    def ratios(a: pd.Series, b: pd.Series) -> pd.Series:
        matcher = SequenceMatcher(None)
        out, last = [], None
        for x, y in zip(a, b, strict=True):
            if x is None or y is None:
                out.append(None)
                continue
            if y != last:  # the matcher keeps an index of its second text
                matcher.set_seq2(y)
                last = y
            matcher.set_seq1(x)
            bounded = least > 0 and (matcher.real_quick_ratio() < least or matcher.quick_ratio() < least)
            out.append(0.0 if bounded else matcher.ratio())
        return pd.Series(out, dtype="float64")

    return ratios


def sequence_ratio(a: Column, b: Column, least: float = 0.0) -> Column:
    """``difflib`` similarity of two strings. Order matters; no built-in equals it, so pairs should be blocked first.

    Where bounds tell that it can't reach ``least`` it isn't computed, and is 0.
    """
    return F.pandas_udf(_ratios(least), "double")(a, b)


def author_surname(c: Column) -> Column:
    """Lower-case part before a comma, else the last word."""
    t = _trim(c)
    return F.lower(F.when(F.contains(t, F.lit(",")), _trim(F.substring_index(t, ",", 1))).otherwise(F.element_at(F.split(t, SPACES), -1)))


def normalize_paper_ref(c: Column) -> Column:
    """Trimmed, without the prefix ``paper_``."""
    return F.regexp_replace(_trim(c), "^paper_", "")


def normalize_arxiv_id(c: Column) -> Column:
    """The bare id of the usual forms of an arXiv reference, else null."""
    return non_empty(F.regexp_extract(_trim(c), r"(?i)^(?:arxiv://|arxiv:|https?://(?:www\.)?arxiv\.org/(?:abs|pdf|html)/)?(\d{4}\.\d{4,5}(?:v\d+)?)(?:\.pdf)?/?$", 1))


def remote_pdf_ref(url: Column) -> Column:
    """``arxiv://id`` for arXiv addresses, an address that looks like a PDF as it is, else null."""
    t = _trim(url)
    arxiv = F.when(t.rlike(r"(?i)arxiv\.org/"), normalize_arxiv_id(F.regexp_replace(t, r"[?#].*$", "")))
    path = F.regexp_replace(t, r"[?#].*$", "")
    return F.coalesce(F.concat(F.lit("arxiv://"), arxiv), F.when(t.rlike(r"^(?i)https?://") & path.rlike(r"(?i)\.pdf$|/pdf/"), t))


def coerce_year(c: Column) -> Column:
    """First year 19xx or 20xx in a text."""
    return F.try_to_number(non_empty(F.regexp_extract(c, r"((?:19|20)\d{2})", 1)), F.lit("9999")).cast("long")


def coerce_page(c: Column) -> Column:
    """A page of 1 or more from a string with digits, else 1."""
    return F.greatest(F.coalesce(non_empty(F.regexp_extract(c, r"(\d+)", 1)).try_cast("bigint"), F.lit(1)), F.lit(1))


def coerce_names(raw: Column) -> Column:
    """Names from raw JSON: a list of strings or of objects with ``name``, one object, or a bare string."""
    texts = F.from_json(raw, "array<string>")
    name = lambda x: F.when(x.startswith("{"), F.coalesce(F.get_json_object(x, "$.name"), F.get_json_object(x, "$.text"))).otherwise(x)
    listed = F.transform(texts, lambda x: _trim(name(x)))
    one = F.array(_trim(name(F.regexp_replace(raw, r'^"|"$', ""))))
    return F.filter(F.when(raw.startswith("["), listed).when(raw.isNull() | (raw == "null"), F.array().cast("array<string>")).otherwise(one), lambda x: x.isNotNull() & (x != ""))


def coerce_items(raw: Column) -> Column:
    """Evidence items from raw JSON: a list of objects or strings; a string is its own evidence."""
    texts = F.when(raw.startswith("["), F.from_json(raw, "array<string>")).when(raw.isNull() | (raw == "null"), F.array().cast("array<string>")).otherwise(F.array(F.regexp_replace(raw, r'^"|"$', "")))

    def item(x: Column) -> Column:
        get = lambda k: F.when(x.startswith("{"), F.get_json_object(x, f"$.{k}"))
        text = F.coalesce(get("text"), F.when(~x.startswith("{"), x), F.lit(""))
        return F.struct(text.alias("text"), F.coalesce(get("evidence_text"), text).alias("evidence_text"), coerce_page(F.coalesce(get("page"), F.lit("1"))).alias("page"), F.coalesce(get("section"), F.lit("")).alias("section"))

    return F.filter(F.transform(texts, item), lambda i: i["text"] != "")


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 for empty vectors, other lengths or a zero norm."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) > 0) & (F.size(a) == F.size(b)) & (norms > 0), dot(a, b) / norms).otherwise(0.0)


def tokens_of(query: Column) -> Column:
    """Lower-case words of a query."""
    return F.filter(F.split(F.lower(_trim(query)), SPACES), lambda t: t != "")


def keyword_score(query: Column, blob: Column) -> Column:
    """Query words found in the text, over the root of their number times the text's words."""
    tokens = tokens_of(query)
    text = F.lower(blob)
    hits = F.size(F.filter(tokens, lambda t: F.contains(text, t)))
    n = F.size(F.filter(F.split(text, SPACES), lambda w: w != ""))
    return F.when(hits > 0, hits / F.sqrt(F.size(tokens) * F.greatest(n, F.lit(1)))).otherwise(0.0)


def embedding_text(title: Column, tasks: Column, methods: Column, datasets: Column, contributions: Column, limitations: Column) -> Column:
    """Title, names and texts of a paper in one line."""
    plain = lambda xs: F.coalesce(xs, F.array().cast("array<string>"))
    texts = lambda items: plain(F.transform(items, lambda i: i["text"]))
    parts = F.concat(F.array(F.coalesce(title, F.lit(""))), plain(tasks), plain(methods), plain(datasets), texts(contributions), texts(limitations))
    return F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), " ")


def split_citation_keys(c: Column) -> Column:
    """Keys parted by comma or semicolon."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"[,;]\s*"), _trim), lambda x: x != "")


def venue_of(*fields: Column) -> Column:
    """First field that isn't empty, else an empty string."""
    return F.coalesce(*[non_empty(f) for f in fields], F.lit(""))


def titles_compatible(a: Column, b: Column) -> Column:
    """Normalised titles that are equal, or of which one of 24 characters or more lies in the other."""
    shorter = F.when(F.length(a) <= F.length(b), a).otherwise(b)
    longer = F.when(F.length(a) <= F.length(b), b).otherwise(a)
    return (a != "") & (b != "") & ((a == b) | ((F.length(shorter) >= 24) & F.contains(longer, shorter)))


def estimate_tokens(c: Column) -> Column:
    """A quarter of the JSON's length."""
    return F.floor(F.length(F.to_json(c)) / 4).cast("long")


def join_evidence(items: Column) -> Column:
    """Uniform items; missing evidence is empty."""
    return F.transform(items, lambda i: F.struct(i["text"].alias("text"), F.coalesce(i["evidence_text"], F.lit("")).alias("evidence_text"), i["page"].alias("page"), i["section"].alias("section")))


def truncate_evidence(items: Column, limit: int = 200) -> Column:
    """Evidence texts over the limit are cut to it, dots included."""
    cut = lambda e: F.when(F.length(e) > limit, F.concat(F.substring(e, 1, limit - 3), F.lit("..."))).otherwise(e)
    return F.transform(items, lambda i: i.withField("evidence_text", cut(i["evidence_text"])))


def first_evidence_text(evidence: Column, limitation: Column, text: Column) -> Column:
    return F.coalesce(non_empty(evidence), non_empty(limitation), text)


def contains_fold(text: Column, part: Column) -> Column:
    """Substring test without regard to case; an empty part is in every text."""
    return F.contains(F.lower(text), F.lower(part))
