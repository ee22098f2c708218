"""Secret scans: fixed patterns, and literals that source or configuration text assigns to sensitive names.

The lexer finds the places where a name gets a value and reads the value as the text's syntax has it:

- targets: ``name = ``, ``name: ``, ``"name": ``, ``name: type = ``, ``:=``, ``=>``, ``+=``, ``.=``, ``?=``, subscripts (``d["name"] = ``), options
  (``--name value``), XML elements, ``key="name" value=``, and calls with name and value (``define("name", "value")``);
- strings: one, two or three quotes, back quotes, prefixes (raw, bytes, formatted), escapes; what stands in ``${}`` or, in formatted strings,
  ``{}``, is no literal but a name. Strings are joined by ``+``, ``.``, ``..``, ``&`` or by standing next to each other, in brackets and after operators over lines;
- bare values: to white space or a separator of the syntax around them, and the lines of a YAML block.

Names assigned before stand for their literals (constant propagation), so ``K = "..."; password = K`` finds the literal
where it is written; an assignment of anything else, a call for one, makes a name unknown again. A literal counts by the
target's name, its length, its variety of characters and its entropy, a phrase of words only for names of passwords; see ``score_literal``.
Literals that lie within a base span aren't told twice; those that reach beyond one are spans of their own, and ``redact``
masks overlapping spans together.

A joined value keeps counts of characters in at most 256 classes and links to the values it joins, and a value whose literals have been told
isn't walked again, so time and memory are in proportion to the text. Nulls and empty texts have no spans. Offsets are in code points, end exclusive.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

__all__ = ["KINDS", "assignments", "base_spans", "find_secrets", "op8_secrets", "redact", "score_literal", "secret_spans"]

#: Kinds of spans, in order of preference among spans with one start.
KINDS = ("assign", "access", "hex", "literal")

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")

_NAME = r"[A-Za-z_][A-Za-z0-9_]*+(?:(?:\.|-|->|::)[A-Za-z_][A-Za-z0-9_]*+)*+"
#: Where a value may begin: after a target and its operator, in a call, after an option, in an element.
_ANCHOR = re.compile(
    rf"""\([ \t]*["'](?P<call>{_NAME})["'][ \t]*,[ \t]*(?=[rbfuRBFU]{{0,2}}["'`])"""
    rf"""|<(?P<tag>[A-Za-z][^<>\n]*+)>(?P<inner>[^<>]*+)</"""
    rf"""|(?<![A-Za-z0-9_-])--(?P<option>{_NAME})(?:=|[ \t]+(?=[^\s-]))"""
    rf"""|(?<![A-Za-z0-9_.-])(?P<quote>["'`]?)(?P<name>{_NAME})["'`]?(?P<sub>[ \t]*\])?[ \t]*(?P<op>:=|=>|[+.?]=|=(?![=~])|:(?!:|//))"""
)
_TYPE = re.compile(r"""[ \t]*[&*]?[A-Za-z_][A-Za-z0-9_.]*+(?:<[^<>\n=]{0,60}>|\[[^\[\]\n]{0,60}\])?[?&*]*(?:[ \t]*\|[ \t]*[A-Za-z_]+)*[ \t]*=(?=[ \t]+\S|["'`(])""")
_BLOCK = re.compile(r"[ \t]*[|>][+-]?[ \t]*\n((?:[ \t]+[^\n]*+(?:\n|\Z))+)")
_LINE = re.compile(r"[^\s][^\n]*")
_STRING = re.compile(r"""([rbfuRBFU]{0,2}|[@$])("{3}|'{3}|["'`])""")
_END = {'"': re.compile(r'(?:[^"\\\n]|\\.)*+"', re.DOTALL), "'": re.compile(r"(?:[^'\\\n]|\\.)*+'", re.DOTALL), "`": re.compile(r"(?:[^`\\]|\\.)*+`", re.DOTALL)}
_FILLED = {True: re.compile(r"\$?\{([^{}\n]*)\}"), False: re.compile(r"\$\{([^{}\n]*)\}|\{\{([^{}\n]*)\}\}")}
_JOINED = re.compile(r"""[ \t]*(?:\\?\n[ \t]*)?(?:\+(?![=+])|\.{1,2}(?=[ \t]*["'$])|(?<=[ \t])&(?=[ \t]+["'A-Za-z]))\s*+""")
_NEXT = re.compile(r"""[ \t]*(?:\\\n[ \t]*)?(?=[rbfuRBFU]{0,2}["'])""")
_WITHIN = re.compile(r"""(?:\s|#[^\n]*|//[^\n]*)*""")
_BARE = re.compile(r"""[^\s"'`]+""")
_CUT = re.compile(r"""[;&,](?=[A-Za-z_][A-Za-z0-9_.-]*["']?[ \t]*[=:]|\Z)""")
_TERM = re.compile(rf"\$?({_NAME})")
_SUM = re.compile(rf"\$?{_NAME}(?:\+\$?{_NAME})*")
_SCHEME = re.compile(r"(?i:bearer|basic|token)[ \t]+(?=[A-Za-z0-9])")
_PATH = re.compile(r"(?:~|\.{1,2})?/(?:[a-z0-9_.-]+/)*[a-z0-9_.-]*|[A-Za-z]:\\.*|[a-z][a-z0-9+.-]*://[^@]*")
_WORD = re.compile(rf"""[ \t]*["']?({_NAME})(?=["' \t\n,;/]|\Z)""")
_KEYED = re.compile(rf"""\b(?:name|key|id)[ \t]*=[ \t]*["']({_NAME})["']""")

#: Parts of a target name that make its literal sensitive, with their weight.
_SENSITIVE = {
    "password": 3, "passwd": 3, "pwd": 3, "passphrase": 3, "pass_phrase": 3, "secret": 3, "token": 3, "apikey": 3, "api_key": 3, "credential": 3, "credentials": 3, "private_key": 3,
    "access_key": 3, "auth": 2, "authorization": 3, "bearer": 2, "signing_key": 3, "encryption_key": 3, "client_key": 3, "connection_string": 2, "dsn": 1, "key": 1, "salt": 1,
}
#: No text without one of these has a sensitive name.
_GATE = re.compile(r"passw|pwd|pass_?phrase|secret|token|key|credential|auth|bearer|connection_?string|dsn|salt", re.IGNORECASE)
#: Last parts of names that tell about a secret and don't hold it.
_DESCRIBES = frozenset("field label hint help name names type url uri endpoint host path file filename length size min max policy prompt message error placeholder regex pattern count limit ttl expiry header column input format title text description".split())
#: Last parts of names whose literals may be phrases, and words that tell of a message to a reader.
_PHRASED = ("password", "passwd", "pwd", "passphrase", "pass_phrase", "secret", "mnemonic")
_MESSAGE = frozenset("password passwords passphrase token secret key enter your please must invalid required incorrect forgot reset confirm change show hide wrong missing cannot and".split())
_PHRASE = re.compile(r"[A-Za-z0-9'_-]+(?: [A-Za-z0-9'_-]+){2,}\Z")
_PLACEHOLDER = re.compile(r"(?i)\A(?:x+|\*+|\.+|-+|<.*>|\$\{.*\}|\{\{.*\}\}|%\w+%|changeme|change_me|example.*|placeholder|your[_-].*|none|null|true|false|todo|test|dummy)\Z")
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_HEAD = 200


def _plain(name: str) -> str:
    return re.sub(r"[^A-Za-z0-9]+", "_", _CAMEL.sub("_", name)).lower()


def _target_weight(name: str) -> int:
    parts = f"_{_plain(name)}_"
    if parts.rstrip("_").rpartition("_")[2] in _DESCRIBES:
        return 0
    return max((w for k, w in _SENSITIVE.items() if f"_{k}_" in parts or (w == 3 and parts.endswith(f"{k}_"))), default=0)


class _Value:
    """What a name stands for: literals (text, start, end) and other values, with the first characters, the length and the counts of characters of all."""

    __slots__ = ("counts", "head", "n", "parts", "spaced", "told")

    def __init__(self, parts: list) -> None:
        self.parts, self.told, self.n, self.head, self.spaced = parts, False, 0.0, "", False
        counts: dict[int, float] = {}
        for x in parts:
            if isinstance(x, _Value):
                n, head, spaced, own = x.n, x.head, x.spaced, x.counts
            else:
                n, head, spaced = len(x[0]), x[0][:_HEAD], " " in x[0].strip()
                own = {}
                for c, k in Counter(x[0]).items():
                    at = ord(c) if c < "\x80" else 128 + (ord(c) & 127)
                    own[at] = own.get(at, 0) + k
            self.n += n
            self.spaced |= spaced
            self.head = self.head + head if len(self.head) < _HEAD else self.head
            for at, k in own.items():
                counts[at] = counts.get(at, 0) + k
        self.head = self.head[:_HEAD]
        if self.n > 1e12:  # sums of sums grow without bound, shares of characters don't
            counts = {at: k / self.n * 1e6 for at, k in counts.items()}
            self.n = 1e6
        self.counts = counts

    def leaves(self, again: bool = False) -> Iterator[tuple[str, int, int]]:
        """Literals below, each value once; those of values that were told are left out unless asked for ``again``."""
        stack, seen = [iter((self,))], set()
        while stack:
            for x in stack[-1]:
                if not isinstance(x, _Value):
                    yield x
                elif not (x.told and not again) and id(x) not in seen:
                    seen.add(id(x))
                    x.told = x.told or not again
                    stack.append(iter(x.parts))
                    break
            else:
                stack.pop()


def _score(name: str, value: _Value) -> float:
    weight = _target_weight(name)
    if not weight or value.n < 8 or len(value.counts) < 4 or _PLACEHOLDER.match(value.head):
        return 0.0
    if value.spaced:
        words = value.head.strip().split(" ")
        packed = any(len(w) >= 20 and re.search("[0-9]", w) and re.search("[A-Za-z]", w) for w in words)
        if not packed and not (_plain(name).endswith(_PHRASED) and _PHRASE.match(value.head.strip()) and _MESSAGE.isdisjoint(w.lower() for w in words)):
            return 0.0
    entropy = -sum(k / value.n * math.log2(k / value.n) for k in value.counts.values())
    ascii_ = "".join(chr(c) for c in value.counts if c < 128)
    classes = sum(bool(re.search(p, ascii_)) for p in ("[a-z]", "[A-Z]", "[0-9]")) + (any(c >= 128 for c in value.counts) or bool(re.search("[^A-Za-z0-9]", ascii_)))
    return weight / 6 + min(value.n, 24) / 144 + min(classes, 3) / 18 + min(entropy, 4.0) / 24


def score_literal(name: str, literal: str) -> float:
    """0 to 1: how likely the literal, assigned to this name, is a secret.

    The weight of the name (0 to 3) counts for half; length from 8 characters, classes of characters and entropy a
    character for the rest. A name without weight, one that ends in a word like ``label`` or ``path``, a placeholder and
    less than four different characters score 0; so does a literal with spaces, but for three words or more, none of them
    a message's, of a name that ends as one of a password, and for one with a long word of letters and digits.
    """
    return _score(name, _Value([(literal, 0, len(literal))]))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, leftmost and without overlap within a kind."""
    found = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


class _Lexer:
    """Values of one text. ``known`` has what names stand for so far."""

    def __init__(self, text: str) -> None:
        self.text, self.known, self.unclosed = text, {}, {}

    def string(self, at: int, end: int) -> tuple[list, int] | None:
        """Parts of a string that begins at ``at``, and where it ends."""
        m = _STRING.match(self.text, at, end)
        if m is None:
            return None
        mark, begin = m[2], m.end()
        if len(mark) == 3 or mark == "`":
            if begin >= self.unclosed.get((mark, end), end + 1):
                return None
            stop = self.text.find(mark, begin, end) if len(mark) == 3 else (q.end() - 1 if (q := _END[mark].match(self.text, begin, end)) else -1)
            if stop < 0:
                self.unclosed[mark, end] = begin
                return None
        else:
            q = _END[mark].match(self.text, begin, end)
            if q is None:
                return None
            stop = q.end() - 1
        parts, last = [], begin
        for gap in _FILLED["f" in m[1].lower() or m[1] == "$"].finditer(self.text, begin, stop):
            if gap.start() > last:
                parts.append((self.text[last : gap.start()], last, gap.start()))
            name = (gap[1] or "").strip()
            if name in self.known:
                parts.append(self.known[name])
            last = gap.end()
        if stop > last:
            parts.append((self.text[last:stop], last, stop))
        return parts, stop + len(mark)

    def bare(self, at: int, end: int) -> tuple[list, int, bool]:
        """Parts of a value without quotes, where it ends, and whether it is a call or the like, whose result isn't known."""
        m = _SCHEME.match(self.text, at, end)
        at = m.end() if m else at
        m = _BARE.match(self.text, at, end)
        if m is None:
            return [], at, True
        stop = m.end()
        if cut := _CUT.search(self.text, at, stop):
            stop = cut.start()
        name = _TERM.match(self.text, at, stop)
        if name and self.text[name.end() : name.end() + 1] in ("(", "["):
            return [], name.end(), True
        while stop > at and self.text[stop - 1] in ",;)]}>":
            stop -= 1
        word = self.text[at:stop]
        if not word or word[0] in "([{<|>#" or _PATH.fullmatch(word):
            return [], m.end(), True
        if _SUM.fullmatch(word):
            names = [x.lstrip("$") for x in word.split("+")]
            found = [self.known[x] for x in names if x in self.known]
            if found or not any(c.isdigit() for c in word) or word[0] == "$":
                return found, stop, False
        return [(word, at, stop)], stop, False

    def value(self, at: int, end: int) -> tuple[list, int, bool]:
        """Parts of the value that begins at ``at``, where it ends, and whether all of it was read."""
        text, parts, depth, whole = self.text, [], 0, True
        m = re.compile(r"""[ \t]*(?:\\?\n\s*(?=[rbfuRBFU]{0,2}["'`]))?""").match(text, at, end)
        at = m.end()
        while True:
            while at < end and text[at] == "(":
                depth += 1
                at = _WITHIN.match(text, at + 1, end).end()
            if found := self.string(at, end):
                parts += found[0]
                at = found[1]
            else:
                more, at, lost = self.bare(at, end)
                parts += more
                if lost:
                    return parts, at, bool(parts) and whole
            if depth:
                at_ = _WITHIN.match(text, at, end).end()
                if _STRING.match(text, at_, end):
                    at = at_
                    continue
            if m := _JOINED.match(text, at, end):
                at = m.end()
                if depth:
                    at = _WITHIN.match(text, at, end).end()
            elif (m := _NEXT.match(text, at, end)) and found:
                at = m.end()
            else:
                return parts, at, True
            if at >= end:
                return parts, at, True

    def scan(self, begin: int, end: int, depth: int = 0) -> Iterator[tuple[str, _Value]]:
        """(target, value) in order; strings are looked through too, two deep."""
        text, at, keyed = self.text, begin, ("", -1)
        while m := _ANCHOR.search(text, at, end):
            at = m.end()
            bound = None
            if m["tag"] is not None:
                name = n[1] if (n := _KEYED.search(m["tag"])) else re.match(r"[^\s/]*", m["tag"])[0]
                inner = _LINE.search(text, m.start("inner"), m.end("inner"))
                parts = [(inner[0].rstrip(), inner.start(), inner.start() + len(inner[0].rstrip()))] if inner else []
                at = m.start("inner") if not _target_weight(name) else at
                if n or not parts:  # attributes and what stands inside are looked at on their own
                    at = m.start() + 1 if not n else at
            elif m["call"] is not None:
                name, (parts, stop, _) = m["call"], self.value(at, end)
                at = stop
                if not text.startswith(")", _WITHIN.match(text, at, end).end()):
                    parts = []
            elif m["option"] is not None:
                name, (parts, at, _) = m["option"], self.value(at, end)
            else:
                name, op = m["name"], m["op"]
                bound = f"[{name}]" if m["sub"] else name
                if op == ":" and (block := _BLOCK.match(text, at, end)):
                    parts = [(x[0].rstrip(), x.start(), x.start() + len(x[0].rstrip())) for x in _LINE.finditer(text, block.start(1), block.end(1))]
                    at = block.end()
                else:
                    if op == ":" and (typed := _TYPE.match(text, at, end)):
                        at = typed.end()
                    parts, at, _ = self.value(at, end)
                if op in ("+=", ".=") and bound in self.known:
                    parts = [self.known[bound], *parts]
                last = name.rpartition(".")[2].lower()
                if last in ("name", "key") and (word := _WORD.match(text, m.end(), end)):
                    keyed = (word[1], at)
                elif last == "value" and 0 <= m.start() - keyed[1] <= 80:
                    name = keyed[0]
            if parts:
                value = _Value(parts)
                if bound is not None:
                    self.known[bound] = value
                yield name, value
                if depth < 2:
                    for x in parts:
                        if isinstance(x, tuple) and ("=" in x[0] or ":" in x[0]) and _GATE.search(x[0]):
                            yield from self.scan(x[1], x[2], depth + 1)
            elif bound is not None:
                self.known.pop(bound, None)


def assignments(text: str) -> Iterator[tuple[str, list[tuple[str, int, int]]]]:
    """(name, all distinct literals that reach it) in order, each literal with where it is written."""
    for name, value in _Lexer(text).scan(0, len(text)):
        yield name, list(value.leaves(again=True))


def _union(spans: list[tuple[str, int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the stretches that spans, sorted by start, cover together."""
    starts, ends = [], []
    for _, a, b in spans:
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def secret_spans(text: str | None, threshold: float = 0.7) -> list[tuple[str, int, int]]:
    """Base spans and, with a score of ``threshold`` or more, literals that base spans don't cover whole."""
    if not text:
        return []
    base = base_spans(text)
    if threshold > 0 and not _GATE.search(text):
        return base
    starts, ends = _union(base)

    def covered(a: int, b: int) -> bool:
        k = bisect_right(starts, a) - 1
        return k >= 0 and b <= ends[k]

    added = set()
    for name, value in _Lexer(text).scan(0, len(text)):
        if not value.told and _score(name, value) >= threshold:
            added.update(("literal", a, b) for _, a, b in value.leaves() if b > a and not covered(a, b))
    return sorted([*base, *added], key=lambda x: (x[1], KINDS.index(x[0]), x[2])) if added else base


def redact(text: str, spans: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str:
    """The text with each span, overlapping ones together, replaced by a mark."""
    out, at = [], 0
    for _, start, end in sorted(spans, key=lambda x: x[1:]):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
_RESULT = pa.struct([("spans", pa.list_(_SPAN)), ("redacted", pa.string())])
_RESULT_DDL = "struct<spans:array<struct<kind:string,start:bigint,end:bigint>>,redacted:string>"


def find_secrets(text: Column, threshold: float = 0.7, redacted: bool = False) -> Column:
    """Struct of ``spans`` and, if asked for, the text with them masked (null where there are none)."""

    def scan(texts: pa.Array) -> pa.Array:
        out = []
        for x in texts:
            value = x.as_py()
            spans = secret_spans(value, threshold)
            out.append({"spans": [dict(zip(("kind", "start", "end"), s, strict=True)) for s in spans], "redacted": redact(value, spans) if redacted and spans else None})
        return pa.array(out, _RESULT)

    return F.arrow_udf(scan, _RESULT_DDL)(text)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_secrets(documents: DataFrame) -> DataFrame:
    """Spans of secrets in each whole text; one scan, rows independent, no shuffle."""
    found = documents.select("doc_id", find_secrets(F.col("text"))["spans"].alias("s"))
    count = lambda kind: F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("s", lambda x: x["kind"] != "literal")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("s")).alias("spans"),
    )


