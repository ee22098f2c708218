"""Titles within titles: nothing is lost, and few pairs meet."""

import random

from pyspark.sql import functions as F

from paperlake.operators import linking


def met(spark, a, b):
    rows = lambda xs, k, t: spark.createDataFrame(list(enumerate(xs)), f"{k} int, {t} string")
    return linking._contained(rows(a, "i", "x"), rows(b, "j", "y"), "x", "y", ["i"], ["j"])


def test_no_contained_title_is_lost(spark):
    rng = random.Random(4)
    words = ["a", "of", "net", "nets", "subnet", "graph", "graphs", "paragraph", "deep", "é", "x" * 20 + "yz", "q" + "x" * 20]
    title = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(1, 5)))
    cut = lambda t: " ".join(t[rng.randint(0, 3) :][: rng.randint(3, 30)].split())
    a = [title() for _ in range(120)]
    b = [cut(rng.choice(a)) for _ in range(80)] + [title() for _ in range(40)]
    a, b = [t for t in a if len(t) >= 3], [t for t in b if len(t) >= 3]
    want = {(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x in y or y in x}
    found = met(spark, a, b).filter(F.contains("x", "y") | F.contains("y", "x"))
    assert {(r.i, r.j) for r in found.collect()} == want and len(want) > 200


def test_titles_that_differ_at_their_ends_do_not_meet(spark):
    """Each has words in common with all others, but a word, or the start of one, that none of them has."""
    papers = [f"a long title about customer {i:09}" for i in range(300)] + [f"the study of subject {i} and its use" for i in range(300, 600)]
    others = [f"on a long title about customer {i:09} revised" for i in range(200, 300)] + [f"study of subject {i} and its" for i in range(500, 800)] + ["automobile"] * 50
    rows = met(spark, papers, others).collect()
    assert {(r.x, r.y) for r in rows if r.x in r.y or r.y in r.x} == {(x, y) for x in papers for y in others if x in y or y in x}
    assert len(rows) < 2_000
