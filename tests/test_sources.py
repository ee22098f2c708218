"""Sources, document structure and upkeep."""

import json

from pyspark.sql import functions as F

from paperlake.operators import documents
from paperlake.sources import files, records
from paperlake.streaming import incremental


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_scan_ignore_and_snapshots(spark, tmp_path):
    for name, body in {"a.md": "# T", "sub/b.BIB": "@a{k, title={x}}", "c.txt": "no", "d.tmp": "no", ".git/e.md": "no", "skip/f.md": "x", "skip/keep.md": "y"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True, parents=True)
        (tmp_path / name).write_text(body)
    root = f"file:{tmp_path}"
    kept = files.filter_ignored(files.scan_corpus(spark, root), root, ["skip/*", "!skip/keep.md"])
    names = sorted(r.path.rpartition("/")[2] for r in kept.collect())
    assert names == ["a.md", "b.BIB", "keep.md"]
    shot = files.fingerprint_files(kept).cache()
    assert incremental.process_changes(shot, shot).count() == 0
    before = shot.filter(~F.col("path").endswith("a.md")).union(spark.createDataFrame([(f"{root}/gone.md", "s", 1, None)], shot.schema))
    ops = {(r.path.rpartition("/")[2], r.op) for r in incremental.process_changes(shot, before).collect()}
    assert ops == {("a.md", "changed"), ("gone.md", "deleted")}


def test_markdown(spark):
    notes = spark.createDataFrame([("/n/my_notes.md", "lead\n# Title\nintro\n## One\n\na\nb\n## Two\n### Three\nx"), ("/n/plain.md", " only text \n")], "path string, text string")
    got = rows(records.markdown_sections(notes), "paper_id", "title", "page", "name", "text")
    assert got == [("my", "Title", 1, "Title", "intro"), ("my", "Title", 2, "One", "a\nb"), ("my", "Title", 3, "Two", ""), ("my", "Title", 4, "Three", "x"), ("plain", "FullText", 1, "FullText", "only text")]


def test_bibtex(spark):
    bib = '@article{k1,\n title = {A {Nested {Deep}} title}, author = "Doe, J. and Roe, M.", year = 2024, journal={NeurIPS},\n doi={10.1/x}, citations={k2, k3}\n}\n@misc{k2, title={B}, year={in 1999}}\n@broken{k3, title={C'
    got = records.parse_bibtex(spark.createDataFrame([("/b/lib.bib", bib), ("/b/none.bib", None)], "path string, text string")).orderBy("bib_ord").collect()
    assert [(r.bib_key, r.title, r.year) for r in got] == [("k1", "A {Nested {Deep}} title", 2024), ("k2", "B", 1999), ("k3", "C", None)]
    assert got[0].authors == ["Doe, J.", "Roe, M."] and (got[0].venue, got[0].doi, got[0].citations, got[0].source_stem) == ("NeurIPS", "10.1/x", "k2, k3", "lib")


def test_library_feed(spark):
    item = {"data": {"key": "A1", "title": "T", "itemType": "journalArticle", "creators": [{"creatorType": "author", "firstName": "J", "lastName": "Doe"}, {"creatorType": "editor", "lastName": "X"}], "date": "2021-05", "DOI": "10.1/z", "version": 7}}
    feed = spark.createDataFrame([(json.dumps(item),), (json.dumps({"data": {"key": "B", "title": ""}}),)], "value string")
    got = records.read_library_delta(feed).collect()
    assert len(got) == 1 and (got[0].bib_key, got[0].authors, got[0].year, got[0].doi, got[0].zotero_version) == ("A1", ["J Doe"], 2021, "10.1/z", 7)


def test_extractions(spark):
    raw = spark.createDataFrame([(json.dumps({"paper_id": "p", "title": "t", "year": "in 2020", "methods": "GRU", "tasks": [{"name": "x"}, "y"], "claims": ["it works", {"text": "a", "page": "p. 3"}]}),)], "value string")
    r = records.raw_extractions(raw).first()
    assert (r.year, r.methods, r.tasks, [(c.text, c.evidence_text, c.page) for c in r.claims]) == (2020, ["GRU"], ["x", "y"], [("it works", "it works", 1), ("a", "a", 3)])
    frame = spark.createDataFrame([("p", [("t", "e", 1, "s")], [], []), ("q", [("t", "e", 0, "s")], [], [])], "paper_id string, contributions array<struct<text:string,evidence_text:string,page:bigint,section:string>>, claims array<struct<text:string,evidence_text:string,page:bigint,section:string>>, limitations array<struct<text:string,evidence_text:string,page:bigint,section:string>>")
    good, bad = records.valid_extractions(frame)
    assert rows(good, "paper_id") == [("p",)] and rows(bad, "paper_id") == [("q",)]


def test_sections_and_pages(spark):
    pages = spark.createDataFrame([("d", 1, "A long enough title\nAbstract\nwe do"), ("d", 2, "1. Introduction\nhello\n\nRelated Work\nmore \U0001F600"), ("d", 3, "References\n[1] Doe, J. Title one. 2020. 10.1234/a\n[2] Roe, M. Title two. arXiv: 2401.12345, 2021."), ("e", 1, "nothing here")], "doc string, page int, text string")
    docs = documents.pages_to_documents(pages)
    starts = documents.merge_section_starts(documents.section_starts_regex(docs))
    sections = documents.split_sections(docs, starts, pages).cache()
    got = [(r.doc, r.name, r.page_start, r.page_end) for r in sections.orderBy("doc", "pos").collect()]
    assert got == [("d", "Abstract", 1, 1), ("d", "Introduction", 1, 2), ("d", "RelatedWork", 2, 2), ("d", "References", 2, 3), ("e", "FullText", 1, 1)]
    assert documents.guess_title(docs).filter("doc = 'd'").first().title == "A long enough title"
    refs = documents.parse_references(documents.split_references(documents.section_text(sections, "references"))).orderBy("ref_no").collect()
    assert [(r.doi, r.arxiv_id, r.year) for r in refs] == [("10.1234/a", "", 2020), ("", "2401.12345", 2021)] and refs[0].authors == ["Doe"]
    meta = {r.doc: (r.detection, r.fallback, len(r.section_names)) for r in documents.section_meta(docs, starts, sections).collect()}
    assert meta == {"d": ("regex", False, 4), "e": ("none", True, 1)}


def test_layout_headings(spark):
    docs = spark.createDataFrame([("d", "see Related Work\nRelated Work\nbody text")], "doc string, full_text string")
    lines = spark.createDataFrame([("d", 1, 0, "see Related Work", 10.0), ("d", 1, 1, "Related Work", 14.0), ("d", 1, 2, "body text", 10.0), ("d", 1, 3, "tail", 10.0)], "doc string, page int, line_no int, text string, size double")
    assert [r.name for r in documents.section_starts_layout(docs, lines).collect()] == ["RelatedWork"]


def test_layout_without_headings(spark):
    """Documents without lines, without a text, without a heading in large type, and one with it."""
    docs = spark.createDataFrame([(0, "Methods\nx"), (2, "plain\nMethods"), (3, "a\nMethods\nb"), (4, None)], "doc long, full_text string")
    lines = spark.createDataFrame([(d, 1, n, t, s) for d in (1, 2, 3, 4) for n, (t, s) in enumerate([("a", 10.0), ("Methods", 14.0 if d == 3 else 10.0), ("b", 10.0)])], "doc long, page int, line_no int, text string, size double")
    found = documents.section_starts_layout(docs, lines)
    assert rows(found, "doc", "name", "pos") == [(3, "Method", 2)]
    merged = documents.merge_section_starts(documents.section_starts_regex(docs.filter("doc < 3")), found)
    assert rows(merged, "doc", "name", "pos", "detection") == [(0, "Method", 0, "regex"), (2, "Method", 6, "regex"), (3, "Method", 2, "blocks")]


def test_section_meta_without_layout(spark):
    """Starts by text and layout, by layout alone, and none at all: lines, but no heading in large type."""
    docs = spark.createDataFrame([("a", "Methods\nx\nResults\ny"), ("b", "x\nMethods"), ("c", "x\ny")], "doc string, full_text string")
    lines = spark.createDataFrame([(d, 1, n, t, s) for d, big in (("a", "Results"), ("b", "Methods"), ("c", None), ("e", None)) for n, t in enumerate(["x", big or "y", "y"]) for s in [14.0 if t == big else 10.0]], "doc string, page int, line_no int, text string, size double")
    starts = documents.merge_section_starts(documents.section_starts_regex(docs.filter("doc = 'a'")), documents.section_starts_layout(docs, lines))
    meta = documents.section_meta(docs, starts, documents.split_sections(docs, starts))
    assert rows(meta, "doc", "detection", "fallback", "section_names") == [("a", "merged", False, ["Method", "Experiment"]), ("b", "blocks", False, ["Method"]), ("c", "none", True, ["FullText"])]


def test_registry(spark):
    new = spark.createDataFrame([("w", "/a", "h1", "ref"), ("w", "/b", "h2", None)], "workspace_id string, source_path string, content_hash string, source_ref string")
    known = spark.createDataFrame([("w", "/a", "p_old", "", None, "", "", None, None)], "workspace_id string, source_path string, paper_id string, content_hash string, source_ref string, zotero_key string, doi string, assigned_at timestamp, updated_at timestamp")
    got = incremental.assign_paper_ids(new, known)
    assert rows(got, "source_path", "is_new") == [("/a", False), ("/b", True)] and got.filter("source_path = '/a'").first().paper_id == "p_old"
    merged = incremental.upsert_registry(known, got.withColumns({"zotero_key": F.lit("z"), "doi": F.lit("")}))
    assert rows(merged, "source_path", "content_hash", "zotero_key") == [("/a", "h1", "z"), ("/b", "h2", "z")]


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text("# A")
    seen = []
    for _ in range(2):
        q = incremental.follow_files(spark, str(tmp_path / "in"), str(tmp_path / "ck"), lambda df, n: seen.extend(r.path.rpartition("/")[2] for r in df.collect()))
        q.awaitTermination(120)
        (tmp_path / "in/b.md").write_text("# B")
    assert sorted(seen) == ["a.md", "b.md"]
    (tmp_path / "feed").mkdir()
    schema = "bib_key string, title string, doi string, url string, zotero_version bigint"
    for k, version in enumerate((3, 5)):
        spark.createDataFrame([("x", f"v{version}", "", "", version)], schema).write.mode("append").json(str(tmp_path / "feed"))
        feed = spark.readStream.schema(schema).json(str(tmp_path / "feed"))
        incremental.follow_library(feed, str(tmp_path / "lib"), str(tmp_path / "ck2")).awaitTermination(120)
        assert [(r.title, r.zotero_version) for r in incremental.library_table(spark, str(tmp_path / "lib")).collect()] == [(f"v{version}", version)]
        assert spark.read.parquet(str(tmp_path / f"lib/v={k}")).count() == 1
    incremental.clear(spark, str(tmp_path / "lib/v=0"))
    assert spark.read.parquet(str(tmp_path / "lib/v=0")).count() == 0


def test_index_a_folder(spark, tmp_path):
    from paperlake.plans.facade import Library
    from paperlake.plans.index import index_pipeline, process_folder

    (tmp_path / "alpha.md").write_text("# Alpha paper\ntext\n## Method\nx")
    bib = "@article{alpha_key, title={Alpha paper}, author={Doe, J. and Roe, M.}, journal={J}, year=2020, citations={beta_key}}\n@article{beta_key, title={Beta paper}, author={Poe, E.}, year=2018}"
    (tmp_path / "alpha.bib").write_text(bib)
    done = index_pipeline(spark, f"file:{tmp_path}")
    got = {r.title: (r.year, r.metadata_only) for r in done.nodes.filter("type = 'Paper'").collect()}
    assert got == {"Alpha paper": (2020, False), "Beta paper": (2018, True)}
    alpha = done.registry.first().paper_id
    # the entry is linked by its title, but neither its key nor its stem is a paper's id
    assert done.edges.filter("type = 'CITES'").count() == 0
    assert {r.name for r in done.nodes.filter("type = 'Author'").collect()} == {"Doe, J.", "Roe, M.", "Poe, E."}
    assert done.stats.select("bib_linked", "bib_only", "cites_from_bib").first() == (1, 1, 0)
    same, none = process_folder(spark, f"file:{tmp_path}", done)
    assert none.count() == 0 and same is done
    (tmp_path / "alpha.bib").unlink()
    (tmp_path / "gamma.md").write_text("# Gamma paper\ntext")
    after, changes = process_folder(spark, f"file:{tmp_path}", done)
    assert sorted((r.path.rpartition("/")[2], r.op) for r in changes.collect()) == [("alpha.bib", "deleted"), ("gamma.md", "changed")]
    assert {r.title: r.id for r in after.nodes.filter("type = 'Paper'").collect()}["Alpha paper"] == alpha and after.edges.filter("type = 'CITES'").count() == 0
    assert after.nodes.filter("type = 'Paper'").count() == 2
    (tmp_path / "gamma.md").unlink()
    (tmp_path / "alpha.bib").write_text(bib)
    again = index_pipeline(spark, f"file:{tmp_path}", registry=done.registry)
    assert again.registry.first().paper_id == alpha and Library(again.nodes, again.edges).papers().count() == 2


def test_quiet_period(spark, tmp_path):
    """Bursts are told once, deletions win, and a restart goes on with the state that is there."""
    from paperlake.streaming.incremental import coalesce_stream

    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        seen = []

        def tell(batch, number):
            seen.extend((r.path, r.op) for r in batch.collect())

        def step(k, rows):
            spark.createDataFrame([(p, op, t / 1000) for p, op, t in rows], "path string, op string, t double").selectExpr("path", "op", "timestamp_millis(cast(t * 1000 as bigint)) AS at").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
            feed = spark.readStream.schema("path string, op string, at timestamp").json(str(tmp_path / "in"))
            q = coalesce_stream(feed).writeStream.foreachBatch(tell).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
            q.awaitTermination(180)
            got = sorted(seen)
            seen.clear()
            return got

        assert step(0, [("a", "changed", 1000), ("a", "changed", 1200), ("b", "changed", 1100), ("b", "deleted", 1300), ("z", "changed", 1400)]) == []
        assert step(1, [("a", "changed", 1600), ("z", "changed", 1850)]) == [("b", "deleted")]  # a's burst goes on
        assert step(2, [("z", "changed", 2300), ("late", "changed", 100)]) == [("a", "changed")]  # the late row is behind the watermark
        assert step(3, [("y", "changed", 9000)]) == [("z", "changed")]
    finally:
        spark.conf.unset(provider)
