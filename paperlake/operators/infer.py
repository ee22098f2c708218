"""Relations that follow from shared tasks and methods."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stages import settle

__all__ = ["contrast_parts", "expand_contrasts", "expand_shared_methods", "infer_contrasts", "infer_extends", "paper_classes", "shared_method_classes", "shared_method_pairs"]


def _sets(profiles: DataFrame) -> DataFrame:
    clean = lambda c: F.array_sort(F.array_distinct(F.array_compact(F.coalesce(c, F.array().cast("array<string>")))))
    return profiles.filter(F.col("paper_id").isNotNull()).select("paper_id", clean(F.col("tasks")).alias("tasks"), clean(F.col("methods")).alias("methods"))


def infer_contrasts(profiles: DataFrame, touched: DataFrame | None = None) -> DataFrame:
    """Unordered pairs (source < target) that share a task and have different, non-empty sets of methods; with ``touched`` (paper_id) those with one of these papers.

    The join is on the task; the output itself has a row for each such pair. Method sets travel as one hash
    until the pairs are distinct.
    """
    s = _sets(profiles).filter(F.size("methods") > 0).select("paper_id", F.explode("tasks").alias("task"), F.xxhash64("methods").alias("m"))
    a, b = s.select(F.col("paper_id").alias("source"), "task", F.col("m").alias("ma")), s.select(F.col("paper_id").alias("target"), "task", F.col("m").alias("mb"))
    if touched is None:
        return a.join(b, "task").filter("source < target AND ma <> mb").select("source", "target").distinct()
    near = a.join(touched.select(F.col("paper_id").alias("source")), "source", "left_semi").join(b, "task").filter("source <> target AND ma <> mb")
    return near.select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).distinct()


def infer_extends(profiles: DataFrame, cites: DataFrame) -> DataFrame:
    """Citations between papers that share a task and a method, or whose cited paper has no methods."""
    s = _sets(profiles)
    a, b = s.select(F.col("paper_id").alias("source"), F.col("tasks").alias("ta"), F.col("methods").alias("ma")), s.select(F.col("paper_id").alias("target"), F.col("tasks").alias("tb"), F.col("methods").alias("mb"))
    pairs = cites.select("source", "target").distinct().join(a, "source").join(b, "target")
    return pairs.filter(F.arrays_overlap("ta", "tb") & ((F.size(F.array_except("mb", "ma")) == 0) | F.arrays_overlap("ma", "mb"))).select("source", "target")


def shared_method_pairs(profiles: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """(source, target, method) of different papers with one method; ``seeds`` (paper_id) bounds the sources."""
    m = _sets(profiles).select("paper_id", F.explode("methods").alias("method"))
    a = m if seeds is None else m.join(seeds.select("paper_id").distinct(), "paper_id", "left_semi")
    return a.withColumnRenamed("paper_id", "source").join(m.withColumnRenamed("paper_id", "target"), "method").filter("source <> target").select("source", "target", "method").distinct()


_BLOCK = 8_192  # members of a task or method that a task meets at once


def _blocked(left: DataFrame, right: DataFrame, *keys: str, size: int = 0) -> DataFrame:
    """``left`` joined with ``right`` by keys that a large share of all rows has, in blocks of both sides.

    A key's rows are dealt to blocks of about ``size`` by a hash, and each block of one side meets each of the other, so that a hub
    is many groups of bounded size instead of one. Keys with a block a side are joined as they are.
    """
    size = size or _BLOCK
    blocks = lambda df, n: df.groupBy(*keys).agg(F.ceil(F.count("*") / size).cast("int").alias(n))
    n = settle(blocks(left, "_na").join(blocks(right, "_nb"), list(keys)))
    dealt = lambda df, own, other, at, to: df.join(n, list(keys)).withColumns({at: F.pmod(F.xxhash64(*df.columns), F.col(own)), to: F.explode(F.sequence(F.lit(0), F.col(other) - 1))}).drop("_na", "_nb")
    a = dealt(left, "_na", "_nb", "_a", "_b").withColumns({c: F.col(c).cast("int") for c in ("_a", "_b")})
    b = dealt(right, "_nb", "_na", "_b", "_a").withColumns({c: F.col(c).cast("int") for c in ("_a", "_b")})
    return a.hint("merge").join(b.hint("merge"), [*keys, "_a", "_b"]).drop("_a", "_b")


def paper_classes(profiles: DataFrame) -> DataFrame:
    """(paper_id, class_id, part, tasks, methods): papers of equal tasks and methods share a class, those of equal methods a part.

    Both are SHA-256 of the sets, so they need no join and stay the same when other papers change. Rows of one paper
    are united; null sets are empty and null names left out; rows without a paper_id are left out.
    """
    united = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    papers = _sets(profiles).groupBy("paper_id").agg(united("tasks"), united("methods"))
    digest = lambda *columns: F.sha2(F.to_json(F.struct(*columns)), 256)
    return papers.select("paper_id", digest("tasks", "methods").alias("class_id"), digest("methods").alias("part"), "tasks", "methods")


def contrast_parts(papers: DataFrame) -> DataFrame:
    """(task, part, n_papers, n_against): the contrasts of ``paper_classes`` rows, without a row for any pair.

    Within a task each paper contrasts with those of all other parts, of which there are ``n_against``; the members of
    a part are its rows in ``paper_classes``. A task of all papers has as many rows as it has different sets of methods.
    """
    parts = papers.filter(F.size("methods") > 0).select(F.explode("tasks").alias("task"), "part").groupBy("task", "part").agg(F.count("*").alias("n_papers"))
    whole = parts.groupBy("task").agg(F.sum("n_papers").alias("_n"))
    return parts.join(whole, "task").select("task", "part", "n_papers", (F.col("_n") - F.col("n_papers")).alias("n_against"))


def expand_contrasts(papers: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """The pairs of ``infer_contrasts`` from ``paper_classes`` rows: all, or those with one of ``asked`` (paper_id).

    Classes meet by task and each pair of them is kept once; members are put in last, so that a pair of papers arises
    once, however many tasks it shares.
    """
    able = papers.filter((F.size("methods") > 0) & (F.size("tasks") > 0))
    classes = able.dropDuplicates(["class_id"]).select("class_id", "part", F.explode("tasks").alias("task"))
    member = able.select("paper_id", "class_id")
    here = member if asked is None else member.join(asked.select("paper_id").distinct(), "paper_id", "left_semi")
    near = classes if asked is None else classes.join(here.select("class_id").distinct(), "class_id", "left_semi")
    met = near.select(F.col("class_id").alias("a"), F.col("part").alias("pa"), "task").join(classes.select(F.col("class_id").alias("b"), F.col("part").alias("pb"), "task"), "task")
    pairs = met.filter("pa <> pb" if asked is not None else "pa <> pb AND a < b").select("a", "b").distinct()
    there = member.withColumn("_asked", F.lit(False)) if asked is None else member.join(asked.select("paper_id", F.lit(True).alias("_asked")).distinct(), "paper_id", "left").withColumn("_asked", F.coalesce("_asked", F.lit(False)))
    rows = pairs.join(here.select(F.col("class_id").alias("a"), F.col("paper_id").alias("x")), "a").join(there.select(F.col("class_id").alias("b"), F.col("paper_id").alias("y"), "_asked"), "b")
    return rows.filter("NOT (_asked AND y < x)").select(F.least("x", "y").alias("source"), F.greatest("x", "y").alias("target"))


def shared_method_classes(papers: DataFrame) -> DataFrame:
    """(method, part, n_papers, n_others): who shares a method, without a row for any pair; ``n_others`` papers of other parts use it too."""
    parts = papers.groupBy("part").agg(F.first("methods").alias("methods"), F.count("*").alias("n_papers")).select(F.explode("methods").alias("method"), "part", "n_papers")
    whole = parts.groupBy("method").agg(F.sum("n_papers").alias("_n"))
    return parts.join(whole, "method").select("method", "part", "n_papers", (F.col("_n") - F.col("n_papers")).alias("n_others"))


def expand_shared_methods(papers: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """The rows of ``shared_method_pairs`` from ``paper_classes`` rows; ``asked`` (paper_id) bounds the sources.

    Papers meet by their method, in blocks where many share one; as those have no repeated rows, neither has the result, and nothing
    is shuffled after the join.
    """
    m = papers.select("paper_id", F.explode("methods").alias("method"))
    a = m if asked is None else m.join(asked.select("paper_id").distinct(), "paper_id", "left_semi")
    return _blocked(a.withColumnRenamed("paper_id", "source"), m.withColumnRenamed("paper_id", "target"), "method").filter("source <> target").select("source", "target", "method")
