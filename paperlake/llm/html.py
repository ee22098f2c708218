"""Main text of web pages by two-pass block rules.

A page is cut into blocks at block-level tags. Blocks in menus, headers, footers, sidebars, notices,
adverts, scripts, styles and comments, as elements, roles or class names tell, are boilerplate.
A class name tells it as a whole or as a compound of known words (``site-footer``, ``nav-wrapper``), not by
a word in it (``social-science``, ``article-header``). Weak names are outvoted by a long block with few links, and names that only end like
boilerplate (``restaurant-menu``) by prose in all their blocks together. A form is boilerplate, but for one that holds most of the
page's text, some of it prose. Reader comments are told by names, or by structure: like elements side by side, with marks like "Reply".

The first pass labels the others by length, density of stop words and density of links; short
blocks and those between the limits stay open, but short blocks of one parent that are prose together are text. On a page in a language
without stop words here, as its whole text tells, length and links alone decide. In the second pass an open block takes the label of its
nearest decided neighbour, of the same parent if there is one. Inside an ``article`` or ``main`` element only neighbours there count that aren't
boilerplate by their markup, and what stays open is text; outside, a tie is boilerplate. If no block of a page is text after that,
its open blocks with few links are, so that a page of short lines isn't empty.

Character references are decoded, white space within a block becomes one space, blocks are joined by
one space in page order. Null and empty pages have an empty text. Markup that isn't closed ends where
its parent ends; a tag that isn't closed is text. The work for a page is linear in its length.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

__all__ = ["Block", "blocks_of", "extract_text", "label_blocks", "main_text", "op6_html"]

#: Stop words of four languages.
STOP = frozenset(
    "a about after all also an and are as at be been but by can for from had has have he her his i in into is it its more no not of on one or she so than that the their them there they this to was we were what when which who will with you "
    "aber als am an auch auf aus bei bin bis das dass dem den der des die doch ein eine einem einen einer er es für haben hat ich ihr im in ist ja kann mit nach nicht noch nur oder sein sich sie sind so über um und uns vom von vor war was wenn wer wie wir zu zum zur "
    "au aux avec ce ces cette comme dans de des du elle elles en entre est et été être il ils je la le les leur lui mais ne nous on ont ou où par pas plus pour qu que qui sa se ses si son sont sur te tu un une vous "
    "al como con cuando de del desde donde el ella en entre era es esta este fue ha hasta la las le lo los más me mi muy no nos o para pero por porque que se ser si sin sobre son su sus también te tiene un una y ya".split()
)
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option optgroup p pre search section summary table tbody td tfoot th thead title tr ul head button select label".split())
_VOID = frozenset("hr br img input meta link area base col embed source track wbr param".split())
_RAW = frozenset("script style textarea noscript template iframe noframes xmp svg math object video audio canvas".split())
_BAD = frozenset("nav aside footer menu head title button select dialog fieldset search".split())
_ROLES = frozenset("navigation banner complementary contentinfo search form dialog alertdialog alert menu menubar toolbar".split())
#: Words of class names and ids that make boilerplate, and weak ones, which a long block of prose outvotes.
_STRONG = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense sponsor sponsored banner cookie cookies consent gdpr notice notices alert popup modal newsletter subscribe signup login "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead topbar comment comments respond replies disqus".split()
)
_WEAK = frozenset("promo promotion rail header overlay subscription reply share sharing social related recommended recommendations widget widgets toolbar".split())
#: Words that may stand beside those in a compound name.
_BESIDE = frozenset(
    "user users reader readers customer facebook fb latest recent my new "
    "area aside bar block body bottom box button buttons center col column container content count danger desktop error fixed form global group holder icons info inner item items label left link links list main message mobile module number outer page panel "
    "popular post posts articles stories primary right row secondary section site slot space sticky success text thread title toggle top unit warning web wrap wrapper wide".split()
)
#: What these words head belongs to the article, and words that tell of something else in an element.
_OWN = frozenset("article chapter entry post section story content".split())
_ABOUT = frozenset("has with no without show hide open closed".split())
_IN_MAIN = frozenset({"header"})
#: Elements whose text belongs with that of the elements beside them.
_LINES = frozenset("p li dt dd h1 h2 h3 h4 h5 h6 blockquote pre td th figcaption".split())
_COMMENT = frozenset("comment comments respond reply replies disqus".split())
#: Words that mark comments in any compound, and names of places where readers talk.
_COMMENTS = frozenset("comments replies disqus".split())
_TALK = frozenset("discussion discussions reviews responses feedback opinions thread conversation forum guestbook".split())
#: What stands by a comment in four languages, by itself or in a short line; and marks of time, that count where readers talk.
_REPLY = re.compile(r"(?i)(?:\A|\W)(?:reply|reply to|report|says|wrote|upvote|antworten|antwort|sagt|schrieb|melden|répondre|a écrit|signaler|responder|dice|escribió|denunciar)(?:\W|\Z)")
_WHEN = re.compile(r"(?i)\b(?:ago|yesterday|today|il y a|hace|vor \d+|gestern|heute|hier|ayer|stars?|sterne?|étoiles|estrellas)\b|\d{1,2}[:.]\d{2}|\d{4}-\d{2}-\d{2}|\d/5")
_CLOSES_P = _BLOCK - {"body", "html", "head", "option", "optgroup", "button", "select", "label"}
_TAG = re.compile(r"""<(?:!--|(/?)([a-zA-Z][^\s<>/]*)((?:[^<>"']|"[^"<]*"|'[^'<]*')*+)>|(/?)([a-zA-Z][^\s<>/]*)([^<>]*)>|[!?][^<>]*>)""")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
_WORD = re.compile(r"\w+")


class _Element:
    """A block-level element: its parent, what it looks like, and what its names tell."""

    __slots__ = ("at", "linked", "looks", "marks", "odd", "parent", "size", "talk", "times")

    def __init__(self, at: int, parent: _Element | None, looks: str = "", talk: bool = False, odd: bool = False) -> None:
        self.at, self.parent, self.looks = at, parent, looks
        self.talk = talk or parent is not None and parent.talk
        self.odd = self if odd else parent.odd if parent is not None else None
        self.marks = self.times = self.size = self.linked = 0


@dataclass
class Block:
    """Text of a block and what the rules ask of it.

    ``weak`` marks a boilerplate name that prose outvotes, ``odd`` one that only ends like boilerplate, ``form`` a form around it; ``group`` numbers the
    article or main element around it, 0 for none. ``element`` is the block element that it stands in, ``tag`` that element's name.
    """

    parts: list[str] = field(default_factory=list)
    bad: bool = False
    weak: bool = False
    group: int = 0
    heading: bool = False
    linked: int = 0
    links: int = 0
    text: str = ""
    odd: bool = False
    form: bool = False
    tag: str = ""
    element: _Element | None = None

    @property
    def density(self) -> float:
        return self.linked / max(1, len(self.text))

    def stop_words(self) -> tuple[int, int]:
        """Number of stop words and of words."""
        words = _WORD.findall(self.text.lower())
        return sum(w in STOP for w in words), len(words)

    def stop_density(self) -> float:
        stop, words = self.stop_words()
        return stop / max(1, words)


def _named(name: str, group: int) -> int:
    """3 if a class name or id is one of boilerplate, 2 if it only ends like one, 1 if weakly so, else 0.

    A compound counts if all its words are known, one at least as boilerplate, or if it has a word that marks comments. ``article-header``
    and its like are the article's own, and ``has-sidebar`` is about another element.
    """
    words = [w.lower() for w in _TOKEN.findall(name) if len(w) > 1]
    if not words or not _ABOUT.isdisjoint(words) or words[-1] in _WEAK and words[0] in _OWN and len(words) > 1:
        return 0
    strong, weak = (any(w in k and not (group and w in _IN_MAIN) for w in words) for k in (_STRONG, _WEAK))
    if not strong and not weak:
        return 0
    known = all(w in _STRONG or w in _WEAK or w in _BESIDE or w in _OWN for w in words)
    if strong and (known or not _COMMENTS.isdisjoint(words)):
        return 3
    if words[-1] in _STRONG:
        return 2
    return 1 if known else 0


def _attributes(name: str, raw: str, group: int) -> int:
    """Do the attributes make the element boilerplate? As ``_named`` tells."""
    told = 0
    for m in _ATTRIBUTE.finditer(raw):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _HIDDEN.search(value):
            return 3
        if key == "role" and value.lower() in _ROLES:
            return 3
        if key in ("class", "id") and name not in ("html", "body", "main"):
            for x in value.split():
                if name != "article":
                    told = max(told, _named(x, group))
                elif not _COMMENT.isdisjoint(w.lower() for w in _TOKEN.findall(x)):
                    told = max(told, _named(x, group))
    return told


def _looks(name: str, raw: str) -> tuple[str, bool]:
    """Tag and class of an element, by which like ones are told, and whether its names tell that readers talk there."""
    values = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)}
    named = f"{values.get('class', '')} {values.get('id', '')}".split()
    talk = any(w and w[-1] in _TALK and all(x in _TALK or x in _BESIDE for x in w) for w in ([y.lower() for y in _TOKEN.findall(x) if len(y) > 1] for x in named))
    return f"{name}.{values.get('class', '')}", talk


def blocks_of(page: str) -> list[Block]:
    """Blocks with text, in page order."""
    found: list[Block] = []
    stack: list[tuple[str, bool, bool, int, bool, _Element]] = []
    open_names: dict[str, int] = {}
    now = Block()
    anchor, groups, at, size, elements = 0, 0, 0, len(page), 1
    outer = ("", False, False, 0, False, _Element(0, None))
    now.element = outer[-1]

    def cut() -> None:
        nonlocal now
        now.text = " ".join("".join(now.parts).split())
        if now.text:
            found.append(now)
        name, bad, weak, group, form, element = stack[-1] if stack else outer
        now = Block(bad=bad, weak=weak, group=group, heading=name in ("h1", "h2", "h3", "h4", "h5", "h6"), odd=element.odd is not None, form=form, tag=name, element=element)

    def say(text: str) -> None:
        if text:
            text = unescape(text) if "&" in text else text
            now.parts.append(text)
            if anchor:
                now.linked += len(text.strip())

    def close(name: str) -> None:
        nonlocal anchor
        while stack:
            top = stack.pop()[0]
            open_names[top] -= 1
            if top == name:
                break
        anchor = 0

    while at < size:
        m = _TAG.search(page, at)
        if m is None:
            say(page[at:])
            break
        say(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            if m[0] == "<!--":
                end = page.find("-->", at)
                at = size if end < 0 else end + 3
            continue
        closing, raw = bool(m[1] or m[4]), m[3] or m[6] or ""
        if closing:
            if name == "a":
                anchor = 0
            elif name in _BLOCK:
                if open_names.get(name):
                    close(name)
                cut()
            continue
        if name in _RAW and not raw.endswith("/"):
            end = re.compile(rf"</{name}\b[^>]*>?", re.IGNORECASE).search(page, at)
            at = end.end() if end else size
            if name in ("svg", "math", "object", "video", "audio", "canvas", "iframe"):
                now.parts.append(" ")
            continue
        if name == "br":
            now.parts.append(" ")
        elif name == "a":
            anchor = 1
            now.links += 1
        elif name in _BLOCK:
            if name in _CLOSES_P and stack and stack[-1][0] == "p":
                close("p")
            if name in ("li", "dt", "dd", "td", "th", "tr", "option") and stack and stack[-1][0] == name:
                close(name)
            _, bad, weak, group, form, parent = stack[-1] if stack else outer
            if name == "body" and open_names.get("head"):
                close("head")
                bad = weak = False
            if name in ("article", "main") and not group and not bad:
                groups += 1
                group = groups
            told = _attributes(name, raw, group) if raw else 0
            bad = bad or name in _BAD or name == "header" and not group or told == 3
            weak = weak or told == 1
            form = form or name == "form"
            if name not in _VOID and not raw.endswith("/"):
                looks, talk = _looks(name, raw) if raw else (name, False)
                stack.append((name, bad, weak, group, form, _Element(elements, parent, looks, talk, told == 2)))
                elements += 1
                open_names[name] = open_names.get(name, 0) + 1
            cut()
    cut()
    return found


def _decided(b: Block, listed: bool) -> bool | None:
    """First pass: text, boilerplate, or open. ``listed``: the page is in a language with stop words here."""
    if b.bad:
        return False
    n, links = len(b.text), b.density
    if b.weak:
        return n >= 200 and links <= 0.1 and (not listed or b.stop_density() >= 0.15)
    if b.group:
        if links > 0.66 and b.links > 1 and b.tag != "p":
            return False
        return True if n >= 60 and links <= 0.5 else None
    if links > 0.5 or links > 0.33 and n < 200 or b.text.startswith("©"):
        return False
    if n < 70 or b.heading:
        return None
    if not listed:
        return True if n >= 100 and links <= 0.2 else None
    stop = b.stop_density()
    return True if stop >= 0.25 or n >= 200 and stop >= 0.15 else None


def _listed(blocks: list[Block]) -> bool:
    """Has the prose of the page stop words, so that blocks without them are suspect?"""
    counts = [b.stop_words() for b in blocks if not b.bad and len(b.text) >= 70 and b.density <= 0.33]
    return sum(s for s, _ in counts) >= 0.05 * sum(w for _, w in counts)


def _prose(blocks: list[Block], listed: bool, least: int, links: float) -> bool:
    """Are blocks, taken together, prose of ``least`` characters with few links?"""
    size = sum(len(b.text) for b in blocks)
    if size < least or sum(b.linked for b in blocks) > links * size:
        return False
    counts = [b.stop_words() for b in blocks] if listed else []
    return not listed or sum(s for s, _ in counts) >= 0.15 * sum(w for _, w in counts)


def _comments(blocks: list[Block]) -> list[bool]:
    """Is each block in a reader's comment, as the structure tells: two elements or more that look alike, side by side, with marks of comments; where names tell of talk, one."""
    chain: dict[int, _Element] = {}
    for b in blocks:
        e = b.element
        while e is not None and e.at not in chain:
            chain[e.at] = e
            e = e.parent
        if len(b.text) <= 60 and not b.bad and not b.heading:
            b.element.marks += bool(_REPLY.search(b.text))
            b.element.times += bool(b.element.talk and _WHEN.search(b.text))
    order = sorted(chain)
    for at in reversed(order):
        e = chain[at]
        if e.parent is not None:
            e.parent.marks += e.marks
            e.parent.times += e.times
    alike: dict[tuple[int, str], list[_Element]] = {}
    for at in order:
        e = chain[at]
        if e.parent is not None and (e.marks or e.times):
            alike.setdefault((e.parent.at, e.looks), []).append(e)
    talked = {e.at for es in alike.values() if len(es) >= 2 or es[0].talk for e in es}
    for at in order:
        e = chain[at]
        if e.parent is not None and e.parent.at in talked:
            talked.add(at)
    return [b.element.at in talked for b in blocks]


def _settle(blocks: list[Block], listed: bool, forms: bool) -> list[Block]:
    """Blocks as the first pass takes them: what forms, names and structure say is weighed against prose. ``forms``: lines of text in forms count as the page's."""
    talked = _comments(blocks)
    rest = [b for b, t in zip(blocks, talked, strict=True) if not t and not b.bad]
    plain = any(_decided(b, listed) for b in rest)
    framed = [b for b in rest if b.form]
    layout = sum(len(b.text) for b in framed) > sum(len(b.text) for b in rest if not b.form) and any(_decided(b, listed) for b in framed)
    odd: dict[int, list[Block]] = {}
    for b in rest:
        if b.odd:
            odd.setdefault(b.element.odd.at, []).append(b)
    kept = {at for at, bs in odd.items() if _prose(bs, listed, 140, 0.1)}
    return [replace(b, bad=b.bad or t and plain or b.form and not layout and not (forms and b.tag in _LINES) or b.odd and b.element.odd.at not in kept) for b, t in zip(blocks, talked, strict=True)]


def label_blocks(blocks: list[Block]) -> list[bool]:
    """Is each block main text? Both passes; of a page that has no text outside forms, once more with lines of text in them."""
    out = _labelled(blocks, False)
    return out if any(out) or not any(b.form for b in blocks) else _labelled(blocks, True)


def _labelled(blocks: list[Block], forms: bool) -> list[bool]:
    listed = _listed(blocks)
    blocks = _settle(blocks, listed, forms)
    first = [_decided(b, listed) for b in blocks]
    count = len(blocks)
    family = [(e.parent if b.tag in _LINES and e.parent is not None else e).at for b in blocks for e in (b.element,)]
    runs: dict[int, list[int]] = {}
    for i, b in enumerate(blocks):
        if first[i] is None and not b.group and not b.heading:
            runs.setdefault(family[i], []).append(i)
    for run in runs.values():
        if len(run) > 1 and _prose([blocks[i] for i in run], listed, 140, 0.2):
            for i in run:
                first[i] = True
    out = [bool(x) for x in first]
    near: list[list[int | None]] = [[None] * count, [None] * count]
    for side, order in ((0, range(count)), (1, range(count - 1, -1, -1))):
        last: dict[int, int] = {}
        kin: dict[int, int] = {}
        outside = None
        for i in order:
            group = blocks[i].group
            near[side][i] = last.get(group) if group else kin.get(family[i], outside)
            if first[i] is not None:
                outside = i
                if not blocks[i].bad and not (blocks[i].weak and not first[i]):
                    last[group] = kin[family[i]] = i
    for i, b in enumerate(blocks):
        if first[i] is not None:
            continue
        before, after = near[0][i], near[1][i]
        if not b.group:  # neighbours of the same parent come first
            own = [j for j in (before, after) if j is not None and family[j] == family[i] and not blocks[j].bad]
            before, after = (j if not own or j in own else None for j in (before, after))
        choice = [(abs(i - j), first[j]) for j in (before, after) if j is not None]
        if not choice:
            out[i] = bool(b.group)
        elif len(choice) == 2 and choice[0][0] == choice[1][0]:
            out[i] = bool(choice[0][1] or choice[1][1]) if b.group or b.heading and choice[1][1] else bool(choice[0][1] and choice[1][1])
        else:
            out[i] = bool(min(choice)[1])
    if not any(out):
        out = [not b.bad and not b.weak and x is None for b, x in zip(blocks, first, strict=True)]
    if not any(out):
        out = [not b.bad and not b.text.startswith("©") and b.density <= 0.33 for b in blocks]
    return out


def main_text(page: str | None) -> str:
    """The article of one page."""
    if not page:
        return ""
    blocks = blocks_of(page)
    return " ".join(b.text for b, good in zip(blocks, label_blocks(blocks), strict=True) if good)


def _extract(pages: pa.Array) -> pa.Array:
    return pa.array([main_text(x.as_py()) for x in pages], pa.string())


def extract_text(html: Column) -> Column:
    """Main text of an html column, in Arrow batches."""
    return F.arrow_udf(_extract, "string")(html)


def op6_html(pages: DataFrame) -> DataFrame:
    """Main text of each page; one scan, rows independent, no shuffle."""
    return pages.select("page_id", "url", extract_text(F.col("html")).alias("text")).withColumn("n_chars", F.length("text").cast("long"))
