"""An index kept by its changes equals a full build, and its work follows the change."""

import random

from paperlake.plans.index import index_pipeline
from paperlake.plans.upkeep import IndexStore

METHODS = ["graph neural network", "Graph Neural Networks", "GNN", "residual mixer", "Residual Mixers", "sparse router", "tree search"]
TASKS = ["routing", "traffic forecast", "Traffic forecasts"]


def write_paper(root, k, rnd):
    (root / f"note{k:02}.md").write_text(f"# Paper {k} {rnd.choice(['on roads', 'of trees'])}\ntext {rnd.random()}\n## Method\nx\n")


def write_bib(root, k, rnd):
    entries = [f"@article{{note{j:02}, title={{Paper {j} on roads}}, author={{Doe, J. and Writer{k}}}, journal={{J{k}}}, year={2000 + j}, citations={{note{(j + 1) % 8:02}; lone{k}_{j}}}}}" for j in range(k * 3, k * 3 + 3)]
    entries.append(f"@article{{lone{k}_{k * 3}, title={{Alone {k}}}, author={{Poe, E.}}, year=1999, citations={{lone{k}_{k * 3 + 1}, lone{1 - k}_{3 - k * 3}}}}}")
    (root / f"refs{k}.bib").write_text("\n".join(rnd.sample(entries, len(entries) - (rnd.random() < 0.3))))


def extraction(spark, store, rnd):
    rows = [(r.paper_id, f"Paper {r.source_path[-5:-3]}", 2020, [rnd.choice(TASKS)], rnd.sample(METHODS, 2), [], []) for r in store.table("registry").collect() if r.source_path.endswith(".md") and rnd.random() < 0.7]
    return spark.createDataFrame(rows, "paper_id string, title string, year bigint, tasks array<string>, methods array<string>, datasets array<string>, metrics array<string>")


def rows_of(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def same_as_full(spark, store, root, extracted):
    full = index_pipeline(spark, root, extracted, registry=store.table("registry"))
    nodes, edges = store.graph()
    for mine, theirs in ((nodes, full.nodes), (edges, full.edges), (store.table("sections"), full.sections), (store.table("entries"), full.entries)):
        assert rows_of(mine) == rows_of(theirs.select(*mine.columns))
    assert rows_of(store.table("snapshot")) == rows_of(full.snapshot.select(*store.table("snapshot").columns))


def test_random_changes(spark, tmp_path):
    """After each of two random changes the tables equal those of a full build; one file is read for each that differs, and few partitions are written."""
    rnd = random.Random(21)
    folder = tmp_path / "papers"
    folder.mkdir()
    root = f"file:{folder}"
    for k in range(7):
        write_paper(folder, k, rnd)
    for k in (0, 1):
        write_bib(folder, k, rnd)
    store = IndexStore(spark, f"file:{tmp_path}/store", buckets=32)
    first = store.update(root)
    assert first.files_read == first.files_parsed == 9
    known = extraction(spark, store, rnd)
    extra = spark.createDataFrame([("p_none", "t", 1, ["a"], ["b"], [], [])], known.schema)
    for step in range(2):
        for _ in range(2):
            what = rnd.choice(["paper", "bib", "gone"])
            if what == "paper":
                write_paper(folder, rnd.randint(0, 9), rnd)
            elif what == "bib":
                write_bib(folder, rnd.randint(0, 1), rnd)
            else:
                victims = sorted(folder.iterdir())
                victims[rnd.randrange(len(victims))].unlink()
        (folder / f"new{step}.md").write_text(f"# New {step}\nx")
        done = store.update(root, known if step == 0 else None)
        assert 1 <= done.files_read <= 3 and done.files_parsed == done.changes.filter("op = 'changed'").count()
        assert done.written["sections"] < store.table("sections").count()
        same_as_full(spark, store, root, known.unionByName(extra))
    none = store.update(root, known)
    assert none.files_read == 0 and none.changes.count() == 0 and none.written == {}
