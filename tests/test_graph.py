"""Graph operators on six papers, with results worked out by hand, and properties."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperlake.functions import ids, text
from paperlake.operators import compare, graph, infer, linking, profiles, resolve, search, traverse
from paperlake.plans import queries as plans
from paperlake.plans.facade import Library
from paperlake.schemas import EXTRACTION

ITEM = lambda t, e=None: (t, e or t, 1, "Discussion")


@pytest.fixture(scope="module")
def records(spark):
    rows = [
        ("mobility_gnn_2024", "Mobility prediction with graphs", 2024, ["mobility prediction"], ["Graph Neural Network", "GRU"], ["GPS trajectory"], ["MAE", "RMSE"], [ITEM("graphs help")], [ITEM("it works")], [ITEM("rare event data is missing")]),
        ("event_forecasting_2025", "Event forecasting", 2025, ["event forecasting"], ["Transformer"], ["event logs"], ["F1"], [], [], [ITEM("needs many logs")]),
        ("spatial_temporal_transformer_2025", "Spatial transformer", 2025, ["trajectory prediction"], ["Transformer"], ["GPS trajectory"], ["RMSE"], [], [], [ITEM("EVENTS are ignored")]),
        ("bysgnn_2023", "Busy GNN for visits", 2023, ["POI visit forecasting"], ["Graph Neural Network", "attention"], ["SafeGraph POI"], ["MAE", "RMSE"], [ITEM("attention on POI")], [ITEM("better visits")], [ITEM("one city only")]),
        ("stgcn_2018", "Spatio temporal graphs", 2018, ["traffic forecasting"], ["graph convolutional", "Graph Neural Network"], ["METR-LA"], ["MAE", "RMSE"], [], [], [ITEM("fixed graph")]),
        ("gman_2020", "Multi attention", 2020, ["traffic forecasting"], ["attention", "Graph Neural Network"], ["METR-LA"], ["MAE"], [], [], []),
    ]
    full = [(r[0], r[1], r[2], None, None, *r[3:]) for r in rows]
    return spark.createDataFrame(full, EXTRACTION)


@pytest.fixture(scope="module")
def cites(spark):
    return spark.createDataFrame([("bysgnn_2023", "stgcn_2018"), ("bysgnn_2023", "gman_2020"), ("mobility_gnn_2024", "bysgnn_2023"), ("gman_2020", "gman_2020"), ("gman_2020", "nobody")], "source string, target string")


@pytest.fixture(scope="module")
def library(records, cites):
    nodes, edges = graph.build_graph(records, cites)
    return Library(nodes.cache(), edges.cache())


def pairs(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_build(library, records):
    kinds = dict(pairs(graph.type_histogram(library.nodes), "type", "n"))
    assert kinds == {"Paper": 6, "Task": 5, "Method": 5, "Dataset": 4, "Metric": 3, "Limitation": 5, "Contribution": 2, "Claim": 2, "Evidence": 9}
    assert pairs(library.edges.filter("type = 'CITES'"), "source", "target") == [("bysgnn_2023", "gman_2020"), ("bysgnn_2023", "stgcn_2018"), ("mobility_gnn_2024", "bysgnn_2023")]
    assert library.stats().first().contrasts_with == 2


def test_profiles_equal_records(library, records):
    want = {r.paper_id: (sorted(r.methods), r.tasks, len(r.limitations)) for r in records.collect()}
    assert {r.paper_id: (r.methods, r.tasks, len(r.limitations)) for r in library.profiles.collect()} == want


def test_inference(records, cites):
    assert pairs(infer.infer_contrasts(records), "source", "target") == [("gman_2020", "stgcn_2018")]
    assert infer.infer_extends(records, cites.filter("source <> target")).count() == 0
    shared = pairs(infer.shared_method_pairs(records), "source", "target")
    assert ("bysgnn_2023", "gman_2020") in shared and all((b, a) in shared for a, b in shared)


def test_lookups(library):
    assert {r.paper_id for r in library.limitations("event").collect()} == {"mobility_gnn_2024", "spatial_temporal_transformer_2025"}
    assert library.limitations("").count() == 5
    assert {r.paper_id for r in library.papers_by_method("GNN").collect()} == {"mobility_gnn_2024", "bysgnn_2023", "stgcn_2018", "gman_2020"}
    assert library.papers_by_method("GNN", fuzzy=False).count() == 0
    assert {r.paper_id for r in library.papers_by_task("traffic").collect()} == {"stgcn_2018", "gman_2020"}
    assert [r.paper_id for r in library.matrix("GNN").collect()] == ["bysgnn_2023"]
    assert [r.paper_id for r in library.missing("mobility_gnn_2024", "nonexistent_paper").collect()] == ["nonexistent_paper"]
    assert library.claims().count() == 2


def test_suggestions(library):
    top = library.suggestions("mobility_gnn_224").orderBy("rank").first()
    assert top.paper_id == "mobility_gnn_2024" and top.ratio == pytest.approx(0.9697, abs=1e-4)


def test_neighbors_and_expansion(library, spark):
    got = pairs(traverse.paper_neighbors(library.edges, spark.createDataFrame([("bysgnn_2023",)], "paper_id string")), "paper_id", "relationship", "direction")
    assert got == [("gman_2020", "CITES", "out"), ("mobility_gnn_2024", "CITED_BY", "in"), ("stgcn_2018", "CITES", "out")]
    found = {r.paper_id: (r.hop, r.relationship, r.via_method) for r in library.expand("mobility_gnn_2024").collect()}
    assert found == {p: (1, "SHARED_METHOD", "Graph Neural Network") for p in ("bysgnn_2023", "stgcn_2018", "gman_2020")}


def test_hops_are_distances(spark):
    rnd = random.Random(1)
    links = {(f"n{rnd.randrange(25)}", f"n{rnd.randrange(25)}") for _ in range(45)}
    edges = spark.createDataFrame([("default", "CITES", a, b) for a, b in links if a != b], "workspace_id string, type string, source string, target string")
    near = {}
    for a, b in links:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    distance, level = {"n0": 0}, ["n0"]
    while level:
        level = sorted({y for x in level for y in near.get(x, ()) if y not in distance})
        distance |= {y: 1 + min(distance[x] for x in near[y] if x in distance) for y in level}
    got = {r.paper_id: r.hop for r in traverse.expand_graph(edges, spark.createDataFrame([("n0",)], "paper_id string"), 3, ("CITES", "CITED_BY")).collect()}
    assert got == {k: v for k, v in distance.items() if 0 < v <= 3}
    ends = spark.createDataFrame([("n0", f"n{i}") for i in range(25)] + [("n0", "far")], "source string, target string")
    paths = {r.target: (r.hops, r.path) for r in traverse.shortest_path(edges, ends).collect()}
    assert {k: v for k, (v, _) in paths.items() if v is not None} == distance
    assert all(len(p) == h + 1 for h, p in paths.values() if h is not None) and paths["far"] == (None, None)


def test_paths_have_no_limit(spark, monkeypatch):
    chain = spark.createDataFrame([(f"n{i:02}", f"n{i + 1:02}") for i in range(22)], "source string, target string")
    far = traverse.shortest_path(chain, spark.createDataFrame([("n00", "n22")], "source string, target string")).first()
    assert (far.hops, far.path) == (22, [f"n{i:02}" for i in range(23)])
    monkeypatch.setattr(plans, "citations", lambda spark, data: chain)
    monkeypatch.setattr(plans, "records", lambda spark, data: chain.selectExpr("source AS paper_id"))
    monkeypatch.setattr(plans, "corpus_graph", lambda spark, data: (None, chain.selectExpr("'CITES' AS type", "*")))
    tasks = chain.selectExpr("source AS paper_id", "array('t') AS tasks")
    monkeypatch.setattr(plans, "records", lambda spark, data: tasks)
    got = {(r.source, r.target): r.hops for r in plans.queries()["t5_shortest_path"](spark, "").collect()}
    assert got == {(f"n{i:02}", "n00"): i for i in range(22)}


def test_embeddings_against_brute_force(spark, monkeypatch):
    rows = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()
    unit = {r.vec_id: np.array(r.embedding, dtype=float) / np.linalg.norm(np.array(r.embedding, dtype=float)) for r in rows}
    want = set()
    for q in unit:
        if q % 20 == 0:
            scores = {str(k): round(float(unit[q] @ v), 9) for k, v in unit.items()}
            want |= {(str(q), k, i) for i, k in enumerate(sorted((k for k in scores if scores[k] > 0), key=lambda k: (-scores[k], k)))}
    assert len({q for q, _, _ in want}) == 25
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").cast("string").alias("paper_id"), "embedding", "vec_id")
    q = e.filter("vec_id % 20 = 0").select(F.col("paper_id").alias("query"), F.col("embedding").alias("vector"))
    monkeypatch.setattr(search, "_QUERIES", 7)
    monkeypatch.setattr(search, "_VECTORS", 60)
    every = [(r["query"], r.paper_id, r["rank"]) for r in search.embedding_channel(e, q).collect()]
    assert len(every) == len(want) and set(every) == want
    ragged = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", []), ("d", None), ("e", [1.0, 1.0, 1.0]), ("f", [1.0, 1.0])], "paper_id string, embedding array<double>")
    few = search.embedding_channel(ragged, ragged.select(F.col("paper_id").alias("query"), F.col("embedding").alias("vector")))
    assert pairs(few, "query", "paper_id", "rank") == [("a", "a", 0), ("a", "f", 1), ("e", "e", 0), ("f", "a", 1), ("f", "f", 0)]
    want = {w for w in want if w[2] < 100}
    got = [(r["query"], r.paper_id, r["rank"]) for r in plans.queries()["k3_embedding_channel"](spark, "/root/testdata/sf0.001").collect()]
    assert len(got) == len(want) and set(got) == want


def test_comparison(library):
    diff = {r.paper_id: r.difference for r in library.compare("event_forecasting_2025", "gman_2020").collect()}
    assert diff["event_forecasting_2025"] == "methods: Transformer; datasets: event logs; metrics: F1"
    md = compare.comparison_markdown(library.compare("gman_2020").withColumn("g", F.lit(1)), "g").first().markdown
    assert md.count("\n") == 2 and "| Multi attention | traffic forecasting |" in md


def test_outline_and_gaps(library, spark):
    rows = library.outline("mobility").orderBy("kind", F.lower("title")).collect()
    assert [(r.title, r.paper_id) for r in rows] == [(t, "mobility_gnn_2024") for t in ("mobility prediction", "Limitations of existing studies", "Positioning of the present study")]
    assert sorted((r.method, r.papers) for r in compare.outline_methods(library.outline("mobility")).collect()) == [("GRU", "mobility_gnn_2024"), ("Graph Neural Network", "mobility_gnn_2024")]
    assert library.gaps("event").count() == 2


def test_fusion_order_and_scores(spark):
    channel = lambda *xs: spark.createDataFrame([("q", x, i) for i, x in enumerate(xs)], "query string, paper_id string, rank int")
    got = [(r.paper_id, r.score) for r in search.reciprocal_rank_fusion([channel("a", "b"), channel("b", "c")]).orderBy("place").collect()]
    assert got == [("b", pytest.approx(1 / 61 + 1 / 60)), ("a", pytest.approx(1 / 60)), ("c", pytest.approx(1 / 61))]
    hits = library_search(spark)
    assert hits[0] == "p2"


def library_search(spark):
    rows = [("p1", "Deep nets", 2020, None, None, ["vision"], ["CNN"], ["X"], ["F1"], [], [], []), ("p2", "Graph nets", 2021, None, None, ["mobility"], ["Graph Net"], ["Y"], ["F1"], [], [], [])]
    lib = Library(*graph.build_graph(spark.createDataFrame(rows, EXTRACTION), spark.createDataFrame([], "source string, target string")))
    return [r.paper_id for r in lib.search("graph").orderBy("rank").collect()]


def test_delete_and_views(library, spark):
    nodes, edges = graph.delete_papers(library.nodes, library.edges, spark.createDataFrame([("mobility_gnn_2024", None)], "paper_id string, workspace_id string"))
    assert nodes.filter("paper_id = 'mobility_gnn_2024' or id = 'mobility_gnn_2024'").count() == 0 and edges.filter("source = 'mobility_gnn_2024'").count() == 0
    assert nodes.filter("name = 'GRU'").count() == 1
    drawn, links, groups = library.viewer()
    assert links.count() == links.select("id").distinct().count() and groups.filter("group = 'papers/gman_2020'").count() == 1
    ego_nodes, ego_edges = traverse.ego_subgraph(library.nodes, library.edges, spark.createDataFrame([("gman_2020",)], "paper_id string"))
    assert {"bysgnn_2023", "stgcn_2018", "gman_2020"} <= {r.id for r in ego_nodes.collect()} and ego_edges.count() == 4 + 1 + 1 + 2 - 1 + 1


def test_text_functions(spark):
    row = spark.range(1).select(
        text.normalize_text(F.lit(" Graph-Convolutional  Network (GCN) ")).alias("key"), text.acronym(F.lit("Graph Neural Network")).alias("ac"), text.author_surname(F.lit("Jane Q. Doe")).alias("s"),
        text.normalize_arxiv_id(F.lit("https://arxiv.org/abs/2401.12345v2")).alias("ax"), text.remote_pdf_ref(F.lit("https://arxiv.org/html/2501.13956")).alias("ref"), text.split_citation_keys(F.lit("a, b;c,")).alias("cited"),
        text.coerce_year(F.lit("published 2019, revised")).alias("y"), text.coerce_names(F.lit('["A", {"name": "B"}, ""]')).alias("names"), text.titles_compatible(F.lit("a short"), F.lit("a short one")).alias("t"),
        text.sequence_ratio(F.lit("graph convolutional networks"), F.lit("graph convolutional network")).alias("ratio"), text.cosine_similarity(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0))).alias("cos"),
        ids.path_stem_slug(F.lit("/a/My Paper_notes.md")).alias("stem"), ids.metadata_slug(F.lit("On Graphs"), F.lit("10.1/AB"), F.lit(2020), F.lit("")).alias("doi"), ids.metadata_slug(F.lit("On Graphs"), F.lit(""), F.lit(2020), F.lit("Doe, J.")).alias("slug"),
    ).first()
    assert (row.key, row.ac, row.s, row.ax, row.ref) == ("graph convolutional network gcn", "gnn", "doe", "2401.12345v2", "arxiv://2501.13956")
    assert (row.cited, row.y, row.names, row.t) == (["a", "b", "c"], 2019, ["A", "B"], False)
    assert row.ratio == pytest.approx(SequenceMatcher(None, "graph convolutional networks", "graph convolutional network").ratio()) and row.cos == pytest.approx(0.5**0.5)
    assert (row.stem, row.doi, row.slug) == ("my_paper", "doi_10_1_ab", "doe_2020_on_graphs")


def test_resolution(spark):
    catalog = spark.createDataFrame([("method", n) for n in ("Graph Neural Network", "Graph Convolutional Network", "GRU")], "entity_type string, name string")
    names = spark.createDataFrame([("method", n) for n in ("GNN", "STGCN", "graph convolutional networks", "gru", "Other")], "entity_type string, name string")
    got = {r.name: r.canonical for r in resolve.resolve_entity_names(names, catalog).collect()}
    assert got == {"GNN": "Graph Neural Network", "STGCN": "STGCN", "graph convolutional networks": "Graph Convolutional Network", "gru": "GRU", "Other": "Other"}


def sequential_names(occurrences):
    """One pass in order, as a twin of the rounds."""
    import re

    key = lambda s: re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", s.lower())).strip()
    catalog, out = set(), {}
    for ord_ in sorted({o for o, _ in occurrences}):
        fresh = set()
        for name in sorted({n for o, n in occurrences if o == ord_}):
            k, names, best = key(name), sorted(catalog), None
            best = next((c for c in names if key(c) == k), None) or (next((c for c in names if len(k) <= 4 and "".join(w[0] for w in key(c).split()) == k), None))
            if best is None:
                scored = []
                for c in names:
                    ck = key(c)
                    a, b = set(k.split()), set(ck.split())
                    fits = k == ck or len(k) > 3 and len(ck) > 3 and len(a & b) / min(len(a), len(b)) >= 0.5
                    score = SequenceMatcher(None, k, ck).ratio()
                    if score >= 0.82 and fits:
                        scored.append((-score, c))
                scored.sort()
                best = scored[0][1] if scored and (-scored[0][0] >= 0.92 or len(scored) == 1) else name
            out[ord_, name] = best
            fresh.add(best)
        catalog |= {n for n in fresh}
    return out


def test_rounds_equal_one_pass(spark):
    rnd = random.Random(3)
    base = ["graph neural network", "graph neural networks", "graph neural net", "GNN", "gru", "GRU", "graph conv network", "neural graph network"]
    occ = [(rnd.randrange(8), rnd.choice(base)) for _ in range(30)]
    frame = spark.createDataFrame([("method", o, n) for o, n in occ], "entity_type string, paper_ord int, name string")
    assert {(r.paper_ord, r.name): r.canonical for r in resolve.canonicalise_batch(frame).collect()} == sequential_names(occ)


def test_leaders_equal_one_pass(spark):
    rnd = random.Random(4)
    words = ["data", "is", "small", "one", "city", "only", "graph", "fixed"]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(2, 4)))) for i in range(40)]
    leaders, want = [], {}
    for i, t in items:
        want[i] = next((j for j, r in leaders if SequenceMatcher(None, t, r).ratio() >= 0.55), i)
        if want[i] == i:
            leaders.append((i, t))
    frame = spark.createDataFrame(items, "item_ord bigint, limitation string")
    assert {r.item_ord: r.leader for r in compare.cluster_limitations(frame).collect()} == want


def test_linking(spark):
    entries = spark.createDataFrame(
        [(0, "k0", "stem_a", None, "", "First title that nobody has"), (1, "k1", "", "Z1", "10.1/X", "A long title about graphs and more of it"), (2, "k2", "", None, "", "unlinked entry"), (3, "k2", "", None, "", "again")],
        "bib_ord int, bib_key string, source_stem string, zotero_key string, doi string, title string",
    )
    papers = spark.createDataFrame(
        [("p1", "/x/stem_a.pdf", "", "", ""), ("p2", "/x/zotero_Z1.pdf", "", "", ""), ("p3", "/x/c.pdf", "", "", "10.1/x"), ("p4", "/x/d.pdf", "a long title about graphs and more", "", ""), ("p5", "", "nothing", "", "")],
        "paper_id string, path string, title string, zotero_key string, doi string",
    )
    linked = linking.link_bib(papers, entries)
    assert pairs(linked, "paper_id", "bib_ord", "rule") == [("p1", 0, 1), ("p2", 1, 2), ("p3", 1, 4), ("p4", 1, 6)]
    only = linking.bib_only_papers(entries, papers, linked)
    assert pairs(only, "paper_id", "title") == [("k2", "unlinked entry")]
    bib = spark.createDataFrame([(0, "a", "", "b, c"), (1, "b", "", ""), (2, "c", "", "c; x")], "bib_ord int, bib_key string, source_stem string, citations string")
    known = spark.createDataFrame([("a",), ("b",), ("c",)], "paper_id string")
    assert pairs(linking.citations_from_bib(bib, known), "source", "target") == [("a", "b"), ("a", "c")]


def test_references_match_by_rule(spark):
    papers = spark.createDataFrame(
        [("p1", "10.1/a", "Deep graphs", 2020, "Doe, Jane"), ("p2", "", "Attention for traffic forecasting", 2019, "Roe, Max; Poe, E."), ("p3", "", "x", -1, "")], "paper_id string, doi string, title string, year bigint, authors string"
    )
    refs = spark.createDataFrame(
        [("r1", "10.1/A", "other", 1990, [], "p9"), ("r2", "", "attention for traffic", 2019, [], "p9"), ("r3", "", "Attention of traffic forecasts", 2019, [], "p9"), ("r4", "", "no such thing here", 2019, ["E. Poe"], "p9"), ("r5", "", "zzz", 1900, [], "p9"), ("r6", "10.1/a", "", None, [], "p1")],
        "ref_id string, doi string, title string, year bigint, authors array<string>, paper_id string",
    )
    got = pairs(linking.match_references(refs.drop("paper_id"), papers), "ref_id", "paper_id", "method")
    assert got == [("r1", "p1", "doi"), ("r2", "p2", "title"), ("r3", "p2", "fuzzy_title_year"), ("r4", "p2", "author_year"), ("r6", "p1", "doi")]
    assert pairs(linking.citations_from_references(refs, papers), "source", "target") == [("p9", "p1"), ("p9", "p2")]


def test_paper_refs(spark):
    registry = spark.createDataFrame([("p_1", "C:\\papers\\Deep Nets.pdf"), ("p_2", "/in/b.md")], "paper_id string, source_path string")
    refs = spark.createDataFrame([("deep nets",), ("c:/papers/deep nets.pdf",), ("b.md",), ("paper_p_2",), ("nope",)], "ref string")
    got = {r.ref: r.paper_id for r in linking.resolve_paper_ref(refs, registry).collect()}
    assert got == {"deep nets": "p_1", "c:/papers/deep nets.pdf": "p_1", "b.md": "p_2", "paper_p_2": "p_2", "nope": None}
