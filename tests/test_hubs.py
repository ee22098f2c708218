"""Hub tasks and methods: factored forms equal the pairs when written out, and stay small when they aren't."""

import random

import pytest
from pyspark.sql import functions as F

from paperlake.operators import infer, traverse

RECORD = "paper_id string, tasks array<string>, methods array<string>, extra int"


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.fixture(scope="module")
def records(spark):
    rnd = random.Random(5)
    made = [(f"p{i:03}", ["all", *rnd.sample("abc", rnd.randint(0, 2))], rnd.sample("uvwx", rnd.randint(0, 3)), i) for i in range(90)]
    made += [("q0", None, ["u"], 0), ("q1", ["all"], None, 1), (None, ["all"], ["u"], 2), made[3], ("q2", [], [], 3), ("q3", ["all", None], ["u", None, "u"], 4)]
    return spark.createDataFrame(made, RECORD).repartition(5)


def test_contrasts_expanded(spark, records):
    papers = infer.paper_classes(records)
    assert papers.count() == papers.select("paper_id").distinct().count() == 94
    want = rows(infer.infer_contrasts(records), "source", "target")
    assert len(want) > 1000 and rows(infer.expand_contrasts(papers), "source", "target") == want
    asked = spark.createDataFrame([("p001",), ("p002",), ("p001",), ("q3",), ("none",)], "paper_id string")
    some = {"p001", "p002", "q3"}
    assert rows(infer.expand_contrasts(papers, asked), "source", "target") == [p for p in want if some & set(p)]
    assert infer.expand_contrasts(infer.paper_classes(records.limit(0))).count() == 0


def test_contrasts_counted(spark, records):
    """``n_against`` is the number of contrasts of a paper within the task."""
    papers = infer.paper_classes(records)
    one = records.withColumn("tasks", F.array(F.lit("all")))
    pairs = infer.infer_contrasts(one)
    degree = pairs.select(F.explode(F.array("source", "target")).alias("paper_id")).groupBy("paper_id").count()
    parts = infer.contrast_parts(infer.paper_classes(one))
    got = infer.paper_classes(one).join(parts, "part").select("paper_id", "n_against")
    assert rows(got.filter("n_against > 0"), "*") == rows(degree, "*")
    assert infer.contrast_parts(papers).agg(F.sum("n_papers")).first()[0] == papers.filter("size(methods) > 0").select(F.explode("tasks")).count()
    # 2,000 papers with one task and three sets of methods: three rows instead of 1.3 million pairs
    many = spark.range(2000).withColumn("id", F.col("id").cast("string")).select(F.concat(F.lit("p"), "id").alias("paper_id"), F.array(F.lit("t")).alias("tasks"), F.array(F.expr("concat('m', id % 3)")).alias("methods"))
    assert rows(infer.contrast_parts(infer.paper_classes(many)), "n_papers", "n_against") == [(666, 1334), (667, 1333), (667, 1333)]


def test_shared_methods_expanded(spark, records):
    papers = infer.paper_classes(records)
    want = rows(infer.shared_method_pairs(records), "source", "target", "method")
    assert rows(infer.expand_shared_methods(papers), "source", "target", "method") == want
    asked = spark.createDataFrame([("p001",), ("p001",), ("q3",)], "paper_id string")
    assert rows(infer.expand_shared_methods(papers, asked), "source", "target", "method") == [r for r in want if r[0] in ("p001", "q3")]
    # papers of other parts: those that share the method less those of the same part
    others = {(r.method, r.part): r.n_others for r in infer.shared_method_classes(papers).collect()}
    part = {r.paper_id: (r.part, r.methods) for r in papers.collect()}
    assert others == {(m, k): sum(m in ms and k2 != k for k2, ms in part.values()) for k, own in part.values() for m in own}


def _graph(spark, seed):
    rnd = random.Random(seed)
    papers = [f"n{i:03}" for i in range(150)]
    edges = [(rnd.choice(("CITES", "CITES", "EXTENDS", "CONTRASTS_WITH")), rnd.choice(papers), rnd.choice(papers)) for _ in range(60)]
    edges += [("USES", p, "hub") for p in papers if rnd.random() < 0.3] + [("USES", rnd.choice(papers), f"m{rnd.randrange(40)}") for _ in range(60)]
    return spark.createDataFrame(edges, "type string, source string, target string").repartition(3), papers


@pytest.mark.parametrize("relations", [traverse.RELATIONS, ("CITES", "CITED_BY")])
def test_reach_expanded(spark, relations):
    """150 seeds, so several words with their highest bits; a method of a third of all papers; nulls and seeds without edges."""
    edges, papers = _graph(spark, 2)
    seeds = spark.createDataFrame([(p,) for p in papers] + [(papers[0],), ("alone",), (None,)], "paper_id string").coalesce(1)
    found = traverse.reach(edges, seeds, 3, relations)
    columns = ("seed", "paper_id", "hop", "relationship", "via_method", "parent")
    want = rows(traverse.expand_graph(edges, seeds.filter("paper_id is not null"), 3, relations), *columns)
    assert rows(found.rows(), *columns) == want
    assert rows(found.pairs(), "seed", "paper_id", "hop") == sorted((r[:3] for r in want), key=str)
    counts = {}
    for _, p, h, *_ in want:
        counts[p, h] = counts.get((p, h), 0) + 1
    assert {(r.paper_id, r.hop): r.n_seeds for r in found.counts().collect()} == counts
    asked = spark.createDataFrame([(papers[5],), ("alone",)], "seed string")
    assert rows(found.rows(asked), *columns) == [r for r in want if r[0] == papers[5]]


def test_a_hub_is_passed_once_for_all_seeds(spark):
    """A method of all of 640 papers: words instead of 408,960 pairs."""
    edges = spark.range(640).select(F.lit("USES").alias("type"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("source"), F.lit("hub").alias("target"))
    found = traverse.reach(edges, edges.select(F.col("source").alias("paper_id")).coalesce(1), 1)
    words = found.seeds.select("block").distinct().count()
    assert words <= 14 and found.hubs.count() == words and found.nodes.filter("hop = 1").count() == 640 * words
    assert {r.n_seeds for r in found.counts().collect()} == {639}
    assert traverse.reach(edges, edges.limit(0).select(F.col("source").alias("paper_id"))).pairs().count() == 0
    assert traverse.reach(edges.limit(0), edges.select(F.col("source").alias("paper_id"))).rows().count() == 0


def test_hubs_meet_in_blocks(spark, records, monkeypatch):
    """Blocks of 7 rows, so that a hub is many groups; the pairs stay the same."""
    papers = infer.paper_classes(records)
    pairs = rows(infer.expand_shared_methods(papers), "source", "target", "method")
    monkeypatch.setattr(infer, "_BLOCK", 7)
    assert rows(infer.expand_shared_methods(papers), "source", "target", "method") == pairs
    many = spark.range(500).select(F.lit("hub").alias("k"), F.col("id").alias("x"))
    met = infer._blocked(many, many.withColumnRenamed("x", "y"), "k", size=50)
    assert met.count() == met.distinct().count() == 250_000


@pytest.mark.parametrize("relations", [traverse.RELATIONS, ("CITES", "CITED_BY"), ("CITES",), ("SHARED_METHOD",)])
@pytest.mark.parametrize("seed", [2, 3])
def test_reach_counted_by_classes(spark, relations, seed):
    edges, papers = _graph(spark, seed)
    seeds = spark.createDataFrame([(p,) for p in papers[::2]] + [(papers[0],), ("alone",), (None,)], "paper_id string").coalesce(1)
    counts = traverse.reach_counts(edges, seeds, 3, relations)
    assert rows(counts, "paper_id", "hop", "n_seeds") == rows(traverse.reach(edges, seeds, 3, relations).counts(), "paper_id", "hop", "n_seeds")


def test_a_class_keeps_its_words_once(spark, monkeypatch):
    """640 papers in two classes: a few words for each class and hop, not for each paper."""
    edges = spark.range(640).select(F.lit("USES").alias("type"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("source"), F.explode(F.array(F.lit("hub"), F.expr("concat('m', id % 2)"))).alias("target"))
    kept = []

    def settle(df, f=traverse.settle):
        out = f(df)
        kept.extend([out.count()] if "word" in out.columns else [])
        return out

    monkeypatch.setattr(traverse, "settle", settle)
    counts = traverse.reach_counts(edges, edges.select(F.col("source").alias("paper_id")).coalesce(1), 2)
    assert {(r.hop, r.n_seeds) for r in counts.collect()} == {(1, 639)} and counts.count() == 640
    assert kept and max(kept) <= 2 * 14
