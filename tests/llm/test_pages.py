"""Chat, WARC, HTML and the pipeline."""

import base64
import gzip
import hashlib
import html
import random
import re
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paperlake.llm.chat import op2_chat
from paperlake.llm.html import main_text, op6_html
from paperlake.llm.scratch import scratch_path
from paperlake.llm.warc import WarcError, member_bytes, op3_warc, read_warc, record_bytes, records, write_warc


def rendered(turns):
    return "".join(f"<|{r or 'user'}|>\n{t or ''}<|end|>\n" for r, t in turns)


def spans(turns):
    at, out = 0, []
    for r, t in turns:
        start = at + len(f"<|{r or 'user'}|>\n")
        end = start + len(t or "") + 7
        if r == "assistant":
            out.append(f"{start}:{end}")
        at = end + 1
    return ",".join(out)


@pytest.fixture(scope="module")
def talk(spark):
    rnd = random.Random(1)
    rows = []
    for c in range(700):
        opening = ("user", "hi") if c % 3 else ("system", f"only {c}")
        turns = [opening] + [(rnd.choice(["assistant", "user"]), rnd.choice(["yes", "no", "é ok"])) for _ in range(rnd.randint(0, 4))]
        rows += [(c, k, r, t, "clash") for k, (r, t) in enumerate(turns)]
    rows += [(9001, 0, None, None, ""), (9002, 0, None, None, ""), (9002, 1, "assistant", None, ""), (9003, None, "user", "no turn", ""), (None, 0, "user", "no id", "")]
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, side string")


def test_preferences_against_brute_force(talk):
    by = {}
    for r in talk.collect():
        by.setdefault(r.conv_id, []).append((-1 if r.turn is None else r.turn, r.role or "", r.text or "", r.role, r.text))
    by = {c: [(x[3], x[4]) for x in sorted(v, key=lambda x: x[:3])] for c, v in by.items()}
    got = op2_chat(talk).collect()
    seen = [r.chosen_id for r in got] + [r.rejected_id for r in got if r.rejected is not None]
    assert sorted(map(str, seen)) == sorted(map(str, by))
    lone = {}
    for r in got:
        c, d = by[r.chosen_id], by[r.rejected_id] if r.rejected is not None else []
        n = next((k for k, (x, y) in enumerate(zip(c, d)) if x != y), min(len(c), len(d)))
        assert r.n_prompt_turns == n and r.prompt == rendered(c[:n]) and r.chosen == rendered(c[n:]) and r.chosen_mask == spans(c[n:])
        if r.rejected is not None:
            assert c[0] == d[0] and r.rejected == rendered(d[n:]) and r.rejected_mask == spans(d[n:]) and r.chosen_id < r.rejected_id
            assert all(r.rejected[int(a) : int(b)].endswith("<|end|>") for a, b in (s.split(":") for s in r.rejected_mask.split(",") if s))
        else:
            lone[c[0]] = lone.get(c[0], 0) + 1
    assert max(lone.values()) == 1  # of one first turn at most one finds no partner


def test_preferences_of_nothing(talk):
    assert op2_chat(talk.limit(0)).count() == 0


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(i, f"http://h{i % 4}.example/{i}", "<p>same</p>" if i % 3 == 0 else f"<p>é {i}</p>" * (i % 7), 1) for i in range(60)]
    rows += [(100, None, None, 1), (101, "http://x", "", 1), (102, "a\r\nb", "WARC/1.1\r\n\r\n\x1f\x8b\x08" + "z" * 70_000, 1), (5, "http://again", "<p>same</p>", 1), (None, "http://null", "<p>null id</p>", 1)]
    return spark.createDataFrame(rows, "page_id bigint, url string, html string, payload int")


def test_warc_round_trip(pages):
    rows = pages.collect()
    first = {}
    for r in rows:
        if r.page_id is not None:
            first[r.html or ""] = min(first.get(r.html or "", r.page_id), r.page_id)
    want = []
    for r in rows:
        data = (r.html or "").encode()
        key = first.get(r.html or "")
        again = r.page_id is not None and key != r.page_id
        want.append((r.page_id, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if again else "response", key if again else None))
    got = [tuple(r) for r in op3_warc(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert op3_warc(pages.limit(0)).count() == 0


def test_warc_splits_filters_and_damage(spark, tmp_path):
    rows = [{"record_type": "response", "record_id": i, "target_uri": f"http://e/{i}", "payload": bytes([i % 251]) * (i * 37 % 900), "refers_to": None} for i in range(120)]
    for r in rows:
        r["payload_bytes"], r["payload_digest"] = len(r["payload"]), base64.b32encode(hashlib.sha1(r["payload"]).digest()).decode()
    frame = spark.createDataFrame([tuple(r[k] for k in ("record_type", "record_id", "target_uri", "payload_bytes", "payload_digest", "refers_to", "payload")) for r in rows], "record_type string, record_id bigint, target_uri string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary")
    path = scratch_path(spark, "warc")
    write_warc(frame.repartition(2), path)
    for split in (700, 5_000, 1 << 20):
        back = {r.record_id: bytes(r.payload) for r in read_warc(spark, path, splitBytes=split).collect()}
        assert back == {r["record_id"]: r["payload"] for r in rows}
    few = read_warc(spark, path).filter("record_id in (3, 7) and record_type = 'response'")
    assert {r.record_id for r in few.collect()} == {3, 7} and read_warc(spark, path).filter("record_type = 'revisit'").count() == 0
    assert read_warc(spark, path, payload="false").filter("payload is not null").count() == 0
    plain = tmp_path / "a.warc"
    plain.write_bytes(b"".join(record_bytes(r) for r in rows))
    with pa.OSFile(str(plain)) as f:
        heads = [h["warc-record-id"] for h, b in records(f, 0, plain.stat().st_size, False, lambda h: h["warc-record-id"].endswith("5>"), False)]
    assert len(heads) == 12
    assert {r.record_id for r in read_warc(spark, f"file://{plain}").collect()} == set(range(120))
    cut = tmp_path / "b.warc"
    cut.write_bytes(plain.read_bytes()[:-200])
    with pa.OSFile(str(cut)) as f, pytest.raises(WarcError):
        list(records(f, 0, cut.stat().st_size, False))


def test_warc_skips_what_is_not_wanted(tmp_path):
    rows = [{"record_type": "response", "record_id": i, "target_uri": "u", "payload": random.Random(i).randbytes(20_000), "refers_to": None} for i in range(40)]
    for r in rows:
        r["payload_bytes"], r["payload_digest"] = len(r["payload"]), base64.b32encode(hashlib.sha1(r["payload"]).digest()).decode()
    members = [member_bytes(record_bytes(r)) for r in rows]
    assert [gzip.decompress(m) for m in members] == [record_bytes(r) for r in rows]
    broken = [m if i % 4 == 0 else m[:-9_000] + b"\xff" * 9_000 for i, m in enumerate(members)]
    path = tmp_path / "a.warc.gz"
    path.write_bytes(b"".join(broken))
    wanted = lambda h: h["warc-record-id"].strip("<>").rpartition(":")[2] in {str(i) for i in range(0, 40, 4)}
    with pa.OSFile(str(path)) as f:
        got = [h["warc-record-id"] for h, b in records(f, 0, path.stat().st_size, True, wanted) if rows[int(h["warc-record-id"].strip("<>").rpartition(":")[2])]["payload"] in b]
        heads = list(records(f, 0, path.stat().st_size, True, payload=False))
        with pytest.raises((WarcError, zlib.error)):
            list(records(f, 0, path.stat().st_size, True))
    assert len(got) == 10 and len(heads) == 40
    path.write_bytes(b"".join(gzip.compress(record_bytes(r)) for r in rows))  # lengths that no member tells
    with pa.OSFile(str(path)) as f:
        assert len(list(records(f, 0, path.stat().st_size, True, wanted))) == 10 and len(list(records(f, 0, path.stat().st_size, True, payload=False))) == 40


ARTICLE = "<p>It was the best of times, it was the worst of times, and it was the age of all of us in the town.</p>"


JAPANESE = "昔々ある所に大きな町があり、人々は毎日市場に出かけて魚や野菜を買い、夜になると川のほとりで歌を歌って過ごしていた。" * 2


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("   ", ""), ("<html><body></body></html>", ""),
        ("<article><h1>T &amp; x</h1><p>Sthe.</p></article>", "T & x Sthe."),
        ("<nav><a href=x>Home</a></nav><article><h1>A\n  b</h1><p>c<br>d<b>e</b></article><footer>&copy; f</footer>", "A b c de"),
        ("<article><p>one</p><script>var t='</p>'</script><style>p{}</style><!-- <p>no</p> --><aside>side</aside><form>Name <input></form><div class=\"comments\"><p>first!</p></div></article>", "one"),
        (f"<body class='has-sidebar'><div id=sidebar>{ARTICLE}</div><div class=content><h2>Head</h2>{ARTICLE}<p>Short.</p>{ARTICLE}</div><div class=cookie-notice>{ARTICLE}</div>", "Head " + " ".join([ARTICLE[3:-4], "Short.", ARTICLE[3:-4]])),
        ("<article><p>a<p>b<li>c</article><p>out of it</p>", "a b c"),
        ("<article>1 < 2 and x&#233;&nbsp;y &am</article>", "1 < 2 and xé y &am"),
        (f"<article><h1>T</h1><div class='social-science'>{ARTICLE}</div><div class='social'><a href=x>Share</a> this</div><div class=post-comments>{ARTICLE}</div></article>", "T " + ARTICLE[3:-4]),
        (f"<article><div class='article-header'><h1>Head</h1></div>{ARTICLE}<div class='share-buttons'>tell all</div></article>", "Head " + ARTICLE[3:-4]),
        (f"<div class=story><div class=article-header><h1>Head</h1></div>{ARTICLE}<div class=related-articles><p>More of it</p></div><div class='site-footer'>{ARTICLE}</div></div>", "Head " + ARTICLE[3:-4]),
        (f"<div class='layout-with-sidebar'><div class='main-header'>Site of ours</div><article class='post has-comments'><h1>T</h1>{ARTICLE}</article><article class='comment'>{ARTICLE}</article><div class=ad300x250>{ARTICLE}</div></div>", "T " + ARTICLE[3:-4]),
        (f"<table><tr><td class=leftNav>{ARTICLE}</td><td><p>{ARTICLE[3:-4] * 2}</p><div class=alert-info>{ARTICLE}</div></td></tr></table>", ARTICLE[3:-4] * 2),
        (f"<div class=siteFooter>{ARTICLE}</div><div class=widget>{ARTICLE * 3}</div><div class=col><p>{ARTICLE[3:-4] * 3}</p></div>", ARTICLE[3:-4] * 3),
        (f"<div class=nav><a href=x>家</a></div><div class=text><h1>題</h1><p>{JAPANESE}</p><p>短い文。</p><p>{JAPANESE}</p></div><div class=footer>会社概要</div>", f"題 {JAPANESE} 短い文。 {JAPANESE}"),
        (f"<article><p>{JAPANESE}</p><ul><li><a href=a>一</a> <a href=b>二</a></li></ul></article>", JAPANESE),
    ],
)
def test_main_text(page, text):
    assert main_text(page) == text


SHORT = ("He came at noon.", "Nobody saw him at the gate.", "The dog was asleep in the sun.", "He sat down and waited for her.", "It was two when she came.", "They had not met in years.", "So they talked until the night.", "Then he left.")
NAV = "<nav><a href=a>Home</a> <a href=b>News</a></nav>"
FOOT = "<div class=footer><p>All rights reserved by the company that owns this site and its writers.</p></div>"
LONG = ARTICLE[3:-4]
STORY = "".join(f"<p>{x}</p>" for x in SHORT)
FAQ = "<h2>Questions</h2><dl><dt>Is it open?</dt><dd>Yes, it is open to all.</dd><dt>When?</dt><dd>From nine to five.</dd></dl>"
FAQ_TEXT = "Questions Is it open? Yes, it is open to all. When? From nine to five."
TALK = "".join(f"<div class=item><b>{n}</b> {k} hours ago<p>{LONG}</p><a href=#>Reply</a></div>" for k, n in enumerate(("Ann", "Bob", "Cy"), 1))


@pytest.mark.parametrize("menu", [("", ""), (NAV, ""), (NAV, FOOT), (NAV + "<form><label>Search</label><input></form>", FOOT)])
@pytest.mark.parametrize(("body", "text"), [(STORY, " ".join(SHORT)), (f"<div class=story>{STORY}</div>", " ".join(SHORT)), (FAQ, FAQ_TEXT), ("<h1>Closed today</h1><p>Back on Monday.</p>", "Closed today Back on Monday."), ("<div>Closed today.</div>", "Closed today.")])
def test_short_pages_are_not_empty(menu, body, text):
    assert main_text(f"<html><body>{menu[0]}{body}{menu[1]}</body></html>") == text


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<body><form id=aspnetForm action=x>{NAV}<h1>T</h1>{ARTICLE}<p>{LONG * 2}</p><input type=hidden></form></body>", f"T {LONG} {LONG * 2}"),
        (f"<body><form id=f>{NAV}{STORY}</form></body>", " ".join(SHORT)),
        (f"<body>{ARTICLE * 3}<form><p>Write to us, and tell us what you think of this.</p><label>Name</label><input></form></body>", " ".join([LONG] * 3)),
        *[(f"<body>{NAV}<div class='{c}'><h1>T</h1>{ARTICLE}{ARTICLE}</div>{FOOT}</body>", f"T {LONG} {LONG}") for c in ("opinion-comment", "press-release-notice", "weather-alert", "restaurant-menu", "two-column-sidebar")],
        (f"<article><h1>T</h1>{ARTICLE}<p><a href=a>The first report of the day</a> and <a href=b>the second report of it</a></p></article>", f"T {LONG} The first report of the day and the second report of it"),
        (f"<body><h1>T</h1>{ARTICLE * 2}<div class=discussion>{TALK}</div></body>", f"T {LONG} {LONG}"),
        (f"<body><article>{ARTICLE}</article><section id=user-reviews><div class=r><p>Ann, 5 stars</p><p>{LONG}</p></div></section></body>", LONG),
        (f"<body>{ARTICLE * 2}<div><h3>What you say</h3>{TALK}</div></body>", None),
        (f"<article>{ARTICLE}<div class=reader-comments>{ARTICLE}</div></article>", LONG),
        (f"<body><div class=reviews><h1>A film</h1>{ARTICLE * 2}</div></body>", f"A film {LONG} {LONG}"),
        (f"<body>{NAV}<div class=menu><ul><li>Soup of the day</li><li>Fish</li></ul></div>{ARTICLE * 2}</body>", f"{LONG} {LONG}"),
        (f"<body>{NAV}<div><p>Short one.</p><p>Short two.</p><p>{LONG * 2}</p><p>An end.</p></div>{FOOT}</body>", f"Short one. Short two. {LONG * 2} An end."),
    ],
)
def test_prose_against_names_and_forms(page, text):
    got = main_text(page)
    assert got == text if text is not None else got.startswith(f"{LONG} {LONG}") and "Ann" not in got and got.count(LONG) == 2


@pytest.mark.parametrize("change", [("<article>", "<div>", "</article>", "</div>"), ("<article>", "", "</article>", ""), ("<article>", "<form><div>", "</article>", "</div></form>")])
def test_pages_without_article_elements(spark, change):
    """The driver's pages with their article tags taken away or replaced give the same texts."""
    equal = total = 0
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        if r.html:
            total += 1
            equal += main_text(r.html.replace(change[0], change[1]).replace(change[2], change[3])) == main_text(r.html)
    assert equal >= 0.99 * total


def test_main_text_is_linear_and_total():
    for page in ("<" * 20_000, "<a b='" * 5_000, "<div>" * 5_000 + "x", "<p>" * 20_000, "</p>" * 20_000, "<!--" * 5_000, "<script>" * 5_000, "&" * 20_000):
        assert isinstance(main_text(page), str)


def test_pages_give_their_articles(spark):
    """On the driver's pages the text is what stands between the tags of the article, read here by plain replacement."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in op6_html(rows).collect()}
    equal = 0
    for r in rows.collect():
        inner = re.search(r"(?s)<article>(.*)</article>", r.html or "")
        parts = re.split(r"</?(?:p|h1|br)>", inner[1]) if inner else []
        text = [" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in parts]
        equal += " ".join(x for x in text if x) == got[r.page_id]
    assert equal >= 0.99 * len(got)


def test_html_empty_table_and_other_columns(spark):
    rows = spark.createDataFrame([(1, None, None, "t"), (2, "u", ARTICLE, None), (2, "u", ARTICLE, None), (None, "", "<article>a\tb</article>", "x")], "page_id bigint, url string, html string, text string")
    assert sorted(map(str, op6_html(rows).select("page_id", "text", "n_chars").collect())) == sorted(
        ["Row(page_id=1, text='', n_chars=0)", *[f"Row(page_id=2, text='{ARTICLE[3:-4]}', n_chars={len(ARTICLE) - 7})"] * 2, "Row(page_id=None, text='a b', n_chars=3)"]
    )
    assert op6_html(rows.limit(0)).count() == 0


def test_html_rows(pages):
    got = op6_html(pages).collect()
    assert len(got) == 65 and all(r.n_chars == len(r.text) for r in got)


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    extra = spark.createDataFrame([(None, None, None, None, None), (10**6, "", "en", "s", 0), (10**6 + 1, 'clean text with password = "Abcdefgh12345" in it', "en", "s", 48), (10**6 + 2, "a b c d e f g", "en", "s", 13), (10**6 + 3, "A b c d e f g", "en", "s", 13)], docs.schema)
    docs = docs.unionByName(extra).unionByName(extra.filter("doc_id = 1000002"))
    sf = "/root/testdata/sf0.001"
    kept = p.toxicity(spark, docs, sf).cache()
    assert kept.columns == docs.columns and kept.count() >= 0.8 * docs.count()
    one = p.jaccard(spark, kept, sf).cache()
    ids = {r.doc_id for r in one.filter("doc_id >= 1000000 or doc_id is null").collect()}
    assert ids == {None, 10**6, 10**6 + 1, 10**6 + 2} and one.filter("doc_id = 1000002").count() == 1
    masked = p.secrets(spark, one, sf).cache()
    row = masked.filter("doc_id = 1000001").first()
    assert row.text == "clean text with [SECRET] in it" or row.text.startswith("clean text with [SECRET]") and row.n_chars == len(row.text)
    assert masked.count() == one.count()
    mixed = p.mixing(spark, masked, sf).cache()
    assert mixed.columns == docs.columns and mixed.groupBy("doc_id", "text").count().agg(F.max("count")).first()[0] <= 2
    assert p.sentencepiece(spark, mixed, sf).count() == mixed.count()
    assert [name for name, _ in p.STAGES] == ["toxicity", "jaccard", "secrets", "mixing", "sentencepiece"]
    for _, stage in p.STAGES:
        assert stage(spark, docs.limit(0), sf).count() == 0
