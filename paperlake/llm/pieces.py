"""SentencePiece models as lattices, encoded by a max-plus scan.

A text is a lattice whose arcs are pieces; its encoding is the path with the greatest sum of weights. In a
UNIGRAM model an arc weighs its piece's score. In a BPE model the path is the result of merging, which is
the only path whose neighbouring pieces all stay two when they are merged alone, so arcs weigh 0 and a
step between other neighbours minus infinity. Either way a chunk of a text is a matrix over the states
that can cross its bounds (how far the piece that is open at the bound reaches beyond it and, for BPE,
which piece it is). Matrices combine by the max-plus product, which is associative; once the states at a
chunk's bounds are known, the chunk is traced back without its neighbours.

Between a piece's end and a space mark nothing can span where no piece has a mark behind another
character. At such a cut all states but one are closed, so stretches between cuts are encoded alone and
kept for reuse.
"""

from __future__ import annotations

import re
import string
from array import array
from dataclasses import dataclass, field

__all__ = ["Matrix", "PieceModel", "State", "load_model", "product"]

SPACE = "▁"
#: (characters beyond the bound, piece or -1)
State = tuple[int, int]
#: weight of the best path for each (entry, exit); a missing pair has none
Matrix = dict[State, dict[State, float]]
START: State = (0, -1)
_KEPT, _PAIRS = 200_000, 700_000  # entries of a generation and of the pairs, about 50 MB each


def product(a: Matrix, b: Matrix) -> Matrix:
    """Max-plus product."""
    out: Matrix = {}
    for entry, row in a.items():
        best: dict[State, float] = {}
        for middle, x in row.items():
            for leave, y in b.get(middle, {}).items():
                if x + y > best.get(leave, float("-inf")):
                    best[leave] = x + y
        if best:
            out[entry] = best
    return out


@dataclass
class PieceModel:
    """A vocabulary with scores. ``bpe`` tells which weights arcs have."""

    ids: dict[str, int]
    score: list[float]
    text: list[str]
    byte: dict[int, int]
    unknown: int
    bpe: bool
    prefix: bool
    collapse: bool
    escape: bool
    longest: int = 0
    cuts: bool = True
    _fits: dict[int, dict[int, bool]] = field(default_factory=dict)
    _pairs: int = 0
    _stretch: dict[str, bytes] = field(default_factory=dict)
    _older: dict[str, bytes] = field(default_factory=dict)
    _trie: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        back = {i: bytes((b,)) for b, i in self.byte.items()} | {self.unknown: " ⁇ ".encode()}
        self._bytes = [back[i] if i in back else t.encode() for i, t in enumerate(self.text)]
        self._length = [len(t) for t in self.text]
        self._shorter: list[int | None] = [None] * len(self.text)
        for p, i in self.ids.items():
            if len(p) > 1:
                self._shorter[i] = next((self.ids[p[:k]] for k in range(len(p) - 1, 0, -1) if p[:k] in self.ids), self.lone(p[0]))
        for p, i in self.ids.items():
            children = self._trie
            for c in p[:-1]:
                children = children.setdefault(c, [None, {}])[1]
            children.setdefault(p[-1], [None, {}])[0] = i
        self.longest = max(map(len, self.ids), default=1)
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self._cutter = _cutter(list(self.ids), bool(self.byte))
        self.lowest = min((self.score[i] for i in self.ids.values()), default=0.0) - 10.0

    # normal form

    def normalise(self, text: str) -> str:
        """The text with spaces as marks, for models whose normaliser leaves characters alone."""
        if self.collapse:
            text = " ".join(x for x in text.split(" ") if x)
        if text and self.prefix:
            text = " " + text
        return text.replace(" ", SPACE) if self.escape else text

    # arcs

    def lone(self, char: str) -> int:
        """A negative id that stands for a character without a piece."""
        return -2 - ord(char)

    def piece(self, i: int) -> str:
        return self.text[i] if i >= 0 else chr(-2 - i)

    def arcs(self, text: str, at: int) -> list[int]:
        """Pieces that begin at a character, shortest first; a character without a piece is an arc by itself."""
        children, out = self._trie, []
        for c in text[at : at + self.longest]:
            node = children.get(c)
            if node is None:
                break
            i, children = node
            if i is not None:
                out.append(i)
            elif not out:
                out.append(self.lone(c))
        return out or [self.lone(text[at])]

    def weight(self, i: int) -> float:
        return 0.0 if self.bpe else self.score[i] if i >= 0 else self.lowest

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging the best pair, leftmost first, until none is left."""
        parts = list(text)
        while len(parts) > 1:
            best, where = None, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or self.score[i] > best):
                    best, where = self.score[i], k
            if best is None:
                break
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return parts

    def fits(self, a: int, b: int) -> bool:
        """May piece b follow piece a? In a BPE model, only if merging both alone gives them back."""
        if not self.bpe:
            return True
        follows = self._fits.setdefault(a, {})
        known = follows.get(b)
        if known is None:
            self._pairs += 1
            if self._pairs > _PAIRS:
                self._fits.clear()
                self._pairs, follows = 1, self._fits.setdefault(a, {})
            x, y = [self.piece(a)] if a != -1 else [], self.piece(b)
            known = follows[b] = self.merged("".join(x) + y) == [*x, y]
        return known

    # scan

    def run(self, text: str, begin: int, end: int, entry: State) -> list[dict[int, tuple[float, int, int]]]:
        """Best weight and origin of each (position, last piece) from one entry state; positions count from ``begin``.

        Arcs may reach beyond ``end``. A UNIGRAM model keeps one last piece for each position.
        """
        table: list[dict[int, tuple[float, int, int]]] = [{} for _ in range(end - begin + self.longest + 1)]
        over, last = entry
        if over >= len(table):
            return table
        table[over][last] = (0.0, -1, -1)
        for at in range(over, end - begin):
            here = table[at]
            if not here:
                continue
            for i in self.arcs(text, begin + at):
                best, origin = float("-inf"), -1
                for a, (w, _, _) in here.items():
                    if w > best and self.fits(a, i):
                        best, origin = w, a
                if best == float("-inf"):
                    continue
                to = table[at + (len(self.text[i]) if i >= 0 else 1)]
                w = best + self.weight(i)
                if self.bpe:
                    to[i] = (w, at, origin)
                else:
                    old = next(iter(to.values()), None)
                    if old is None or w > old[0]:
                        to.clear()
                        to[i] = (w, at, origin)
        return table

    def exits(self, table: list[dict[int, tuple[float, int, int]]], size: int) -> dict[State, float]:
        """States at the end of a chunk of ``size`` characters."""
        out: dict[State, float] = {}
        for over in range(self.longest + 1):
            if size + over < len(table):
                for i, (w, at, _) in table[size + over].items():
                    if at < size:
                        key = (over, i if self.bpe else -1)
                        out[key] = max(w, out.get(key, float("-inf")))
        return out

    def entries(self, text: str, begin: int) -> list[State]:
        """All states in which a chunk that begins here can be entered."""
        if begin == 0:
            return [START]
        found: dict[State, None] = {}
        for at in range(max(0, begin - self.longest), begin):
            for i in self.arcs(text, at):
                over = at + (len(self.text[i]) if i >= 0 else 1) - begin
                if over >= 0:
                    found[over, i if self.bpe else -1] = None
        return list(found)

    def matrix(self, text: str, begin: int, end: int) -> Matrix:
        """Transfer matrix of the chunk; ``text`` has ``longest`` characters around it.

        With a cut inside, every entry passes it in one state: the stretch before the cut is run for each
        entry, the one behind the last cut once, and what lies between has no choice of states.
        """
        first, last = self._bounds(text, begin, end)
        if first is None:
            return {e: x for e in self.entries(text, begin) if (x := self.exits(self.run(text, begin, end, e), end - begin))}
        tail = self.exits(self.run(text, last, end, START), end - last) if last < end else {START: 0.0}
        middle = 0.0 if self.bpe else self._weight(text[first:last])
        out: Matrix = {}
        for e in self.entries(text, begin):
            if first == begin:
                reach = 0.0 if e[0] == 0 else None
            else:
                reach = self.exits(self.run(text[:first], begin, first, e), first - begin)
                reach = max((w for (over, _), w in reach.items() if over == 0), default=None)
            if reach is not None:
                out[e] = {x: reach + middle + w for x, w in tail.items()}
        return out

    def _bounds(self, text: str, begin: int, end: int) -> tuple[int | None, int]:
        """First and last cut in ``begin .. end``: a mark behind another character."""
        if not self.cuts:
            return None, end
        is_cut = lambda k: k == 0 or k < len(text) and text[k] == SPACE and text[k - 1] != SPACE
        first = next((k for k in range(begin, end) if is_cut(k)), None)
        if first is None:
            return None, end
        return first, next(k for k in range(end, first - 1, -1) if k == first or k < end and is_cut(k))

    def _weight(self, text: str) -> float:
        return sum(self.weight(i) for s in self.stretches(text) for i in self._trace(s, 0, len(s), START, None)) if text else 0.0

    def trace(self, text: str, begin: int, end: int, entry: State, leave: State | None) -> bytes:
        """Ids, four bytes each, of the pieces that begin in the chunk on the best path between two states; ``leave`` None is the end of the text."""
        first, last = self._bounds(text, begin, end)
        pack = lambda pieces: array("i", self.final(pieces)).tobytes()
        if first is None or first == last:
            return pack(self._trace(text, begin, end, entry, leave))
        head = pack(self._trace(text[:first], begin, first, entry, None)) if first > begin else b""
        return head + self.packed(text[first:last]) + pack(self._trace(text, last, end, START, leave))

    def join(self, parts: list[bytes]) -> bytes:
        """Ids of a text from those of its chunks; a run of unknown characters over a bound counts once."""
        out: list[bytes] = []
        unknown = array("i", [self.unknown]).tobytes()
        for p in parts:
            if not self.byte and out and out[-1][-4:] == unknown and p[:4] == unknown:
                p = p[4:]
            if p:
                out.append(p)
        return b"".join(out)

    def _trace(self, text: str, begin: int, end: int, entry: State, leave: State | None) -> list[int]:
        size = end - begin
        table = self.run(text, begin, end, entry)
        over, last = leave if leave is not None else (0, -1)
        at = size + over
        choice = table[at]
        if leave is None or not self.bpe:
            options = [(w, i) for i, (w, o, _) in choice.items() if o < size or at == entry[0]]
            if not options:
                raise ValueError("no path between these states")
            last = max(options)[1]
        out: list[int] = []
        while True:
            _, origin, before = table[at][last]
            if origin < 0:
                break
            out.append(last)
            at, last = origin, before
        return out[::-1]

    def _walk(self, text: str) -> list[int]:
        """``_trace`` of a whole stretch of a BPE model, depth first.

        Weights are 0 or minus infinity and no position is reached by two last pieces, so the first path to
        the end is the best, and a position that leads nowhere is never tried again.
        """
        fits, shorter, length, trie, longest, size = self._fits, self._shorter, self._length, self._trie, self.longest, len(text)
        out: list[int] = []
        dead: set[int] = set()
        at, a = 0, -1
        while at < size:
            children, i = trie, None
            for c in text[at : at + longest]:
                node = children.get(c)
                if node is None:
                    break
                found, children = node
                if found is not None:
                    i = found
            if i is None:
                i = -2 - ord(text[at])
            follows = fits.get(a)
            if follows is None:
                follows = fits[a] = {}
            while True:
                if i is None:
                    dead.add(at)
                    i = out.pop()
                    at -= length[i] if i >= 0 else 1
                    a = out[-1] if out else -1
                    i = shorter[i] if i >= 0 else None
                    follows = fits.setdefault(a, {})
                    continue
                end = at + (length[i] if i >= 0 else 1)
                if not dead or end not in dead:
                    ok = follows.get(i)
                    if self.fits(a, i) if ok is None else ok:
                        break
                i = shorter[i] if i >= 0 else None
            out.append(i)
            at, a = end, i
        return out

    # whole texts

    def stretches(self, text: str) -> list[str]:
        """Text between cuts."""
        if not self.cuts:
            return [text]
        return self._cutter.findall(text)

    def packed(self, text: str) -> bytes:
        """Ids of a normalised text, four bytes each; stretches seen lately are looked up."""
        found = self.stretches(text)
        get = self._stretch.get
        parts = [get(s) for s in found]
        if None in parts:
            parts = [self._pack(s) if p is None else p for s, p in zip(found, parts, strict=True)]
        return b"".join(parts)

    def _pack(self, stretch: str) -> bytes:
        """Two generations of stretches are kept: what the older one holds is used again before it goes."""
        known = self._stretch.get(stretch)
        if known is not None:
            return known
        known = self._older.get(stretch)
        if known is None:
            ids = self._walk(stretch) if self.bpe else self._trace(stretch, 0, len(stretch), START, None)
            known = array("i", self.final(ids)).tobytes()
        if len(stretch) <= 64:
            if len(self._stretch) >= _KEPT:
                self._older = self._stretch
                self._stretch = {}
            self._stretch[stretch] = known
        return known

    def final(self, pieces: list[int]) -> list[int]:
        """Ids of the model: characters without a piece become bytes, or the unknown id (once for a run of them)."""
        if not pieces or min(pieces) >= 0:
            return pieces
        out: list[int] = []
        run = False
        for i in pieces:
            if i >= 0:
                out.append(i)
                run = False
            elif self.byte:
                out += [self.byte[b] for b in chr(-2 - i).encode("utf-8", "surrogatepass")]
            elif not run:
                out.append(self.unknown)
                run = True
        return out

    def encode(self, text: str) -> list[int]:
        return array("i", self.packed(self.normalise(text))).tolist()

    def decode(self, ids: list[int]) -> str:
        """Text of ids. It is the text that was encoded, but for marks in it, which become spaces, and spaces that the model drops."""
        table = self._bytes
        out = b"".join([table[i] for i in ids])
        text = out.decode("utf-8", "replace")
        if self.escape:
            text = text.replace(SPACE, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


def _cutter(pieces: list[str], fine: bool) -> re.Pattern[str]:
    """Stretches of a text, cut where no piece can span: before marks behind other characters and, if ``fine``,
    between a Latin letter and a sign that no piece has behind one, and around line ends that no longer piece holds."""
    if not fine:
        return re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
    letter = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
    inside = {c for p in pieces if len(p) > 1 for c in p}
    behind = {b for p in pieces for a, b in zip(p, p[1:]) if re.match(f"[{letter}]", a)}
    lone = "".join(c for c in "\n\r\t" if c not in inside) or "\0"
    sign = "".join(re.escape(c) for c in string.punctuation if c not in behind)
    other = f"[^{letter}{SPACE}{lone}]"
    return re.compile(rf"[{lone}]|(?s:(?=.)){SPACE}*{other}*(?:[{letter}]+(?:[^{letter}{SPACE}{lone}{sign}]{other}*)?)*")


def _fields(data: bytes):
    """(number, value) of a serialised message."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            size = number() if kind == 2 else 4 if kind == 5 else 8
            yield key >> 3, data[at : at + size]
            at += size


def load_model(data: bytes, model_type: int | None = None) -> PieceModel:
    """A model from the bytes of a ``.model`` file.

    Models with a character map or with space marks behind words are refused. ``model_type`` (1 UNIGRAM,
    2 BPE) overrides that of the file.
    """
    import struct

    pieces: list[tuple[str, float, int]] = []
    kind, prefix, collapse, escape, suffix, map_size = 1, True, True, True, 0, 0
    for k, v in _fields(data):
        if k == 1:
            f = dict(_fields(v))
            pieces.append((f.get(1, b"").decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, 1)))
        elif k == 2:
            f = dict(_fields(v))
            kind, suffix = f.get(3, 1), f.get(24, 0)
        elif k == 3:
            f = dict(_fields(v))
            map_size, prefix, collapse, escape = len(f.get(2, b"")), bool(f.get(3, 1)), bool(f.get(4, 1)), bool(f.get(5, 1))
    kind = model_type or kind
    if kind not in (1, 2) or suffix or map_size:
        raise ValueError("only UNIGRAM and BPE models with an identity normaliser are read")
    ids = {p: i for i, (p, _, t) in enumerate(pieces) if t in (1, 4)}
    byte = {int(p[3:5], 16): i for i, (p, _, t) in enumerate(pieces) if t == 6}
    unknown = next((i for i, (_, _, t) in enumerate(pieces) if t == 2), 0)
    text = [p if t in (1, 4, 5) else "" for p, _, t in pieces]
    return PieceModel(ids, [s for _, s, _ in pieces], text, byte, unknown, kind == 2, prefix, collapse, escape)
