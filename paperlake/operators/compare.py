"""Comparisons, literature matrices, outlines and research gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import first_evidence_text
from .profiles import limitation_topic_match, topic_match
from .resolve import leader_clusters

__all__ = ["cluster_limitations", "comparison_markdown", "comparison_rows", "gap_support", "literature_matrix", "outline_methods", "related_work_outline", "research_gaps"]

SIMILAR = "Similar profile to other papers in this set"


def comparison_rows(profiles: DataFrame) -> DataFrame:
    """A row a paper with joined lists and what no other paper of the set has.

    A value is a paper's own if one paper id alone has it; values are counted once for all papers, and fall together before
    they are shuffled.
    """
    tagged = lambda k: F.transform(F.coalesce(F.col(k), F.array().cast("array<string>")), lambda v: F.struct(F.lit(k).alias("kind"), v.alias("value")))
    own = profiles.select("paper_id", F.inline(F.concat(tagged("methods"), tagged("datasets"), tagged("metrics"))))
    lone = own.groupBy("kind", "value").agg(F.min("paper_id").alias("paper_id"), F.max("paper_id").alias("_m")).filter("paper_id = _m")
    listed = lambda k: F.array_join(F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("value")))), ", ")
    part = lambda k: F.when(listed(k) != "", F.concat(F.lit(f"{k}: "), listed(k)))
    diff = lone.groupBy("paper_id").agg(F.concat_ws("; ", part("methods"), part("datasets"), part("metrics")).alias("difference"))
    texts = lambda c: F.array_join(F.filter(F.transform(c, lambda i: i["text"]), lambda t: t != ""), "; ")
    return profiles.join(diff, "paper_id", "left").select(
        "paper_id", "title", F.array_join("tasks", ", ").alias("task"), F.array_join("methods", ", ").alias("method"), F.array_join("datasets", ", ").alias("dataset"), F.array_join("metrics", ", ").alias("metric"),
        texts(F.col("contributions")).alias("contribution"), texts(F.col("limitations")).alias("limitation"), F.coalesce("difference", F.lit(SIMILAR)).alias("difference"),
    )


def literature_matrix(profiles: DataFrame, topic: str) -> DataFrame:
    return comparison_rows(topic_match(profiles, topic))


def comparison_markdown(rows: DataFrame, *group: str) -> DataFrame:
    """One table of Markdown for each ``group`` of rows, papers by id."""
    cells = [F.coalesce(F.col(c), F.lit("")) for c in ("title", "task", "method", "dataset", "metric", "contribution", "limitation", "difference")]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("paper_id", line.alias("l")))), lambda s: s["l"]), "\n")
    head = "| Paper | Task | Method | Dataset | Metric | Contribution | Limitation | Difference |\n|---|---|---|---|---|---|---|---|\n"
    return rows.groupBy(*group).agg(F.concat(F.lit(head), body).alias("markdown"))


def related_work_outline(profiles: DataFrame, topic: str) -> DataFrame:
    """Rows (kind, title, paper_id, methods) of an outline, to be read by kind, then title without regard to case.

    Kind 0 has a section a task, kind 1 the papers with limitations, kind 2 the positioning against all papers. Papers
    without a task are under ``General``, without a method under ``unspecified method``. A section of all papers is
    a row a paper, so it is no group of its own.
    """
    p = topic_match(profiles, topic)
    or_one = lambda c, v: F.when(F.size(c) > 0, F.col(c)).otherwise(F.array(F.lit(v)))
    tasks = p.select(F.lit(0).alias("kind"), F.explode(F.array_distinct(or_one("tasks", "General"))).alias("title"), "paper_id", or_one("methods", "unspecified method").alias("methods"))
    none = F.lit(None).cast("array<string>")
    limits = p.filter(F.size("limitations") > 0).select(F.lit(1), F.lit("Limitations of existing studies"), "paper_id", none)
    return tasks.union(limits).union(p.select(F.lit(2), F.lit("Positioning of the present study"), "paper_id", none))


def outline_methods(outline: DataFrame) -> DataFrame:
    """(title, method, n_papers, papers) of the task sections of an outline: the papers of each method."""
    rows = outline.filter("kind = 0").select("title", "paper_id", F.explode("methods").alias("method"))
    return rows.groupBy("title", "method").agg(F.count_distinct("paper_id").alias("n_papers"), F.array_join(F.array_sort(F.collect_set("paper_id")), ",").alias("papers"))


def cluster_limitations(items: DataFrame, threshold: float = 0.55) -> DataFrame:
    """``items`` (item_ord, limitation, ...) with the ``leader`` (item_ord) of their cluster; blank texts are dropped."""
    return leader_clusters(items.filter(F.trim("limitation") != ""), "item_ord", "limitation", threshold)


def gap_support(clustered: DataFrame, min_papers: int = 1) -> DataFrame:
    """Gaps (leader, gap, n_items, paper_count, supporting_papers, evidence) with enough papers, largest clusters first.

    A gap is called by its leader's text, or by the first text there is if that is null. Empty texts stay empty, null ones null.
    """
    text = first_evidence_text(F.col("evidence_text"), F.col("limitation"), F.col("limitation"))
    first = F.min_by("limitation", F.when(F.col("limitation").isNotNull(), F.col("item_ord")))
    proof = F.transform(F.array_sort(F.collect_list(F.struct("item_ord", "paper_id", "title", "page", "section", text.alias("text")))), lambda s: F.struct(s["paper_id"], s["title"], s["page"], s["section"], s["text"]))
    g = clustered.groupBy("leader").agg(
        F.coalesce(F.max(F.when(F.col("item_ord") == F.col("leader"), F.col("limitation"))), first).alias("_r"), F.count("*").alias("n_items"), F.count_distinct("paper_id").alias("paper_count"),
        F.array_sort(F.collect_set("paper_id")).alias("supporting_papers"), proof.alias("evidence"),
    )
    gap: Column = F.when(F.col("n_items") == 1, F.col("_r")).otherwise(F.concat("_r", F.lit(" (reported across "), F.col("n_items").cast("string"), F.lit(" papers)")))
    return g.filter(F.col("paper_count") >= min_papers).withColumn("gap", gap).drop("_r").orderBy(F.desc("n_items"), "leader")


def research_gaps(limitations: DataFrame, topic: str, min_papers: int = 1, threshold: float = 0.55) -> DataFrame:
    """Clusters of the limitations (item_ord, paper_id, title, limitation, evidence_text, page, section) that hold the topic."""
    return gap_support(cluster_limitations(limitation_topic_match(limitations, topic), threshold), min_papers)
