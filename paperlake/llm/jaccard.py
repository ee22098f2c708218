"""Exact Jaccard self-join on word shingles as a T-occurrence search, and its connected components.

Two sets of n and m shingles reach a similarity t only if they share at least ``ceil(t * n)`` of the
first's shingles. Shingles fall into short and long inverted lists. As in DivideSkip (Li, Lu and Lu,
2008), long lists are set aside: candidates come from merging short lists only, and the long ones are
probed by binary search for the candidates that remain.

1. ``shingle_rows``: one scan gives each text its number of shingles, a 64-bit class of its set (equal
   sets are one class from here on), a bitmap of parities, and a sketch of how many texts hold a shingle:
   a fixed number of counters, added up over all texts. Counters far above the mean mark long lists;
   the marks are a bitmap of fixed size, the only thing that is broadcast. They only order the work:
   whatever they say, no pair is lost, and a list they miss is at most some thousands of sets longer
   than the mean.
2. ``postings``: each class is posted under its first ``n - ceil(t * n) + 1`` shingles, short lists
   first, which loses no pair. Postings travel as packed arrays by range of hashes, are merged in
   order of the hash, and lists with one class drop out. The number of ranges follows the number of
   shingles, so that a range stays small; a list longer than ``_LIST`` is cut into blocks, and all pairs
   of its blocks become lists.
3. ``candidate_edges``: in a list, classes are candidates whose sizes allow t and whose bitmaps do. A bit of
   a bitmap is the parity of the shingles hashed to it, so two bitmaps differ in no more bits than the sets
   differ in shingles: what is dropped can't reach t. A bitmap has one to two bits a shingle; of two of
   different length the longer is folded, which keeps it a bitmap of parities. A list gives the edges of
   a spanning forest, so a group of copies costs its size, not its square.
4. ``verified_links``: the whole sets of each group of candidates that hang together are searched for
   links: a set is looked up in an index of the sets not reached yet, by merging their short lists and
   probing their long ones. Large groups are searched within small blocks first, then between one set of
   each linked part, then, if parts remain, between all pairs of blocks; no link that could join two
   components is left out.

All steps are exact but for clashes of 64-bit hashes, by which shingles and sets are compared. Nothing per
text is collected; lists, groups and components live in tables in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .scratch import materialise
from .words import mix, slices, words_of

__all__ = ["jaccard_components", "op9_jaccard", "shingles"]

_COUNTERS, _SLICES = 1 << 22, 64
_FLUSH = 1 << 20
_ALWAYS = 1_000_000  # ids that may be broadcast, 16 MB
_RANGE = 1 << 21  # shingles posted in a range of hashes, 32 MB
_LIST = 1 << 16  # classes of a list before it is cut
_PAIRS = 1 << 16  # pairs of bitmaps compared at once
_SMALL, _BLOCK = 1 << 16, 2_000_000  # elements of the sets of a block: 512 KB, 16 MB
_FACTORS = mix(np.arange(1, 6, dtype=np.uint64)) | np.uint64(1)


def shingles(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the shingles of one text, from the hashes of its words; all words as one if there are fewer."""
    if not len(words):
        return words
    with np.errstate(over="ignore"):
        k = min(width, len(words))
        h = np.full(len(words) - k + 1, np.uint64(k) * np.uint64(0x9FB21C651E98DF25))
        for i in range(k):
            h = mix(h + words[i : len(words) - k + 1 + i] * _FACTORS[i % 5]) if i >= 5 else h + words[i : len(words) - k + 1 + i] * _FACTORS[i]
    return np.unique(mix(h))


def _class(s: np.ndarray) -> np.uint64:
    with np.errstate(over="ignore"):
        return mix(np.array([mix(s + np.uint64(1)).sum(dtype=np.uint64) + np.uint64(len(s))]))[0]


def _parities(s: np.ndarray) -> bytes:
    """A bit for each residue of the shingles, set if an odd number has it: 64 bits or the least power of two from n on."""
    bits = max(64, 1 << (len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch in batches:
        for part in slices(batch):
            w = words_of(part.column("text"), lower=True)
            ends = np.cumsum(w.counts)
            yield part, [shingles(w.hash[e - c : e], width) for e, c in zip(ends.tolist(), w.counts.tolist(), strict=True)]


_ROWS = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("class", pa.int64()), ("bits", pa.binary()), ("slice", pa.int32()), ("counts", pa.binary())])
_ROWS_DDL = "doc_id bigint, n bigint, class bigint, bits binary, slice int, counts binary"


def shingle_rows(docs: DataFrame, width: int) -> DataFrame:
    """A row for each text, and for each task its share of the sketch in slices (those rows have ``slice``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(_COUNTERS, dtype=np.uint32)
        held: list[np.ndarray] = []
        size = 0
        for part, sets in _sets(batches, width):
            n = np.array([len(s) for s in sets], dtype=np.int64)
            cls = np.array([_class(s) if len(s) else 0 for s in sets], dtype=np.uint64)
            bits = [_parities(s) if len(s) else None for s in sets]
            none = pa.nulls(len(sets))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), pa.array(n), pa.array(cls.view(np.int64)), pa.array(bits, pa.binary()), none.cast(pa.int32()), none.cast(pa.binary())], schema=_ROWS
            )
            held += sets
            size += int(n.sum())
            if size >= _FLUSH:
                counters += np.bincount((np.concatenate(held) >> np.uint64(42)).astype(np.int64), minlength=_COUNTERS).astype(np.uint32)
                held, size = [], 0
        if size:
            counters += np.bincount((np.concatenate(held) >> np.uint64(42)).astype(np.int64), minlength=_COUNTERS).astype(np.uint32)
        codec = pa.Codec("zstd", compression_level=1)
        packed = [codec.compress(x.tobytes(), asbytes=True) for x in np.split(counters, _SLICES)]
        none = pa.nulls(_SLICES, pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, pa.nulls(_SLICES, pa.binary()), pa.array(range(_SLICES), pa.int32()), pa.array(packed, pa.binary())], schema=_ROWS)

    return docs.select("doc_id", "text").mapInArrow(run, _ROWS_DDL)


def _long_lists(sketch: DataFrame) -> bytes:
    """Bitmap of the counters far above the mean: 512 KB, whatever the input."""

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(_COUNTERS // _SLICES, dtype=np.uint64)
        codec = pa.Codec("zstd")
        for batch in batches:
            for x in batch.column("counts"):
                total += np.frombuffer(codec.decompress(x.as_buffer(), total.nbytes // 2), dtype=np.uint32)
        mean = total.mean()
        marks = total > mean + max(48.0, 8 * mean**0.5)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(marks, bitorder="little").tobytes()], pa.binary())], names=["slice", "marks"])

    rows = {r["slice"]: bytes(r["marks"]) for r in sketch.groupBy("slice").applyInArrow(add, "slice int, marks binary").collect()}
    return b"".join(rows.get(i, bytes(_COUNTERS // _SLICES // 8)) for i in range(_SLICES))


def _prefix(s: np.ndarray, marks: np.ndarray, percent: int) -> np.ndarray:
    n = len(s)
    k = n - -(-n * percent // 100) + 1
    at = s >> np.uint64(42)
    long = (marks[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
    short = s[long == 0]
    return short[:k] if len(short) >= k else np.concatenate((short, s[long == 1][: k - len(short)]))


def postings(docs: DataFrame, marks: bytes, width: int, percent: int, parts: int) -> DataFrame:
    """(bucket, blob, class): packed (hash, class) of the lists with at least two classes in a bucket, and a row for each of its classes.

    Buckets from ``parts`` on hold two blocks of a list longer than ``_LIST``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(marks)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        long = np.frombuffer(shared.value, dtype=np.uint8)
        seen: set[int] = set()
        held: list[np.ndarray] = []
        classes: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            token, cls = np.concatenate(held), np.concatenate(classes)
            bucket = (token % np.uint64(parts)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            which, at = np.unique(bucket[order], return_index=True)
            pairs = np.stack((token[order], cls[order]), axis=1)
            blobs = [x.tobytes() for x in np.split(pairs, at[1:])]
            return pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "blob"])

        for _, sets in _sets(batches, width):
            for s in sets:
                if len(s) and (c := int(_class(s))) not in seen:
                    seen.add(c)
                    held.append(_prefix(s, long, percent))
                    classes.append(np.full(len(held[-1]), c, dtype=np.uint64))
                    size += len(held[-1])
            if size >= _FLUSH:
                yield flush()
                held, classes, size = [], [], 0
        if size:
            yield flush()

    def merge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs = [np.frombuffer(x.as_buffer(), dtype=np.uint64).reshape(-1, 2) for b in batches for x in b.column("blob")]
        both = np.concatenate(blobs)
        order = np.lexsort((both[:, 1], both[:, 0]))
        token, cls = both[order, 0], both[order, 1]
        new = np.ones(len(token), dtype=bool)
        new[1:] = (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])
        token, cls = token[new], cls[new]
        edges = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1], [True])))
        length = np.repeat(np.diff(edges), np.diff(edges))
        near = (length > 1) & (length <= _LIST)
        if near.any():
            yield from rows(key[0].as_py(), token[near], cls[near])
        for at in np.flatnonzero(np.diff(edges) > _LIST).tolist():
            whole = cls[edges[at] : edges[at + 1]]
            k = -(-len(whole) // _LIST)
            block = (mix(whole) % np.uint64(k)).astype(np.int64)
            for i in range(k):
                for j in range(i + 1, k):
                    two = whole[(block == i) | (block == j)]
                    name = parts + int(mix(np.array([token[edges[at]] + np.uint64(i * k + j)]))[0] >> np.uint64(2))
                    yield from rows(name, np.full(len(two), token[edges[at]]), two)

    def rows(bucket: int, token: np.ndarray, cls: np.ndarray) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "blob", "class"]
        yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int64()), pa.array([np.stack((token, cls), axis=1).tobytes()], pa.binary()), pa.nulls(1, pa.int64())], names=names)
        own = np.unique(cls).view(np.int64)
        for at in range(0, len(own), _LIST):
            part = own[at : at + _LIST]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), bucket)), pa.nulls(len(part), pa.binary()), pa.array(part)], names=names)

    packed = docs.select("doc_id", "text").mapInArrow(post, "bucket int, blob binary")
    return packed.groupBy("bucket").applyInArrow(merge, "bucket bigint, blob binary, class bigint")


def _fold(bits: np.ndarray, width: int) -> np.ndarray:
    while bits.shape[1] > width:
        half = bits.shape[1] // 2
        bits = bits[:, :half] ^ bits[:, half:]
    return bits


def _roots(size: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index that edges (a, b) connect with each of ``size`` indices."""
    root = np.arange(size)
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while (root[root] != root).any():
            root = root[root]


class _Bitmaps:
    """Sizes and bitmaps of the classes of a bucket, and the bound they put on similarities."""

    def __init__(self, n: np.ndarray, bits: list[pa.Buffer], percent: int) -> None:
        self.n, self.percent = n, percent
        self.width = np.array([len(x) // 8 for x in bits], dtype=np.int64)
        self.row = np.zeros(len(n), dtype=np.int64)
        self.levels = {}
        for width in np.unique(self.width).tolist():
            at = np.flatnonzero(self.width == width)
            self.row[at] = np.arange(len(at))
            self.levels[width] = np.frombuffer(b"".join(bits[i] for i in at.tolist()), dtype=np.uint64).reshape(len(at), width)

    def allow(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """May the pairs reach the similarity? False only where they can't."""
        out = np.zeros(len(i), dtype=bool)
        for at in range(0, len(i), _PAIRS):
            a, b = i[at : at + _PAIRS], j[at : at + _PAIRS]
            total = self.n[a] + self.n[b]
            least = np.minimum(self.n[a], self.n[b])
            fits = 100 * least >= self.percent * (total - least)
            apart = np.zeros(len(a), dtype=np.int64)
            key = self.width[a] << 32 | self.width[b]
            for k in np.unique(key[fits]).tolist():
                some = np.flatnonzero(fits & (key == k))
                wide, other = k >> 32, k & 0xFFFFFFFF
                width = min(wide, other)
                step = max(1, (1 << 22) // max(wide, other))
                for s in range(0, len(some), step):
                    few = some[s : s + step]
                    x = _fold(self.levels[wide][self.row[a[few]]], width) ^ _fold(self.levels[other][self.row[b[few]]], width)
                    apart[few] = np.bitwise_count(x).sum(axis=1, dtype=np.int64)
            out[at : at + _PAIRS] = fits & (apart * (100 + self.percent) <= total * (100 - self.percent))
        return out


def _forest(slots: np.ndarray, known: _Bitmaps) -> Iterator[tuple[int, np.ndarray]]:
    """Edges (slot, slots) that join, within one list sorted by size, all members that candidates connect."""
    n = known.n[slots]
    low = np.searchsorted(n * 100, n * known.percent, "left")  # sizes from t * n
    high = np.searchsorted(n * known.percent, n * 100, "right")  # to n / t
    free = np.ones(len(n), dtype=bool)
    left = len(n)
    for seed in range(len(n)):
        if not free[seed]:
            continue
        free[seed] = False
        left -= 1
        queue = [seed]
        while queue and left:
            i = queue.pop()
            at = np.flatnonzero(free[low[i] : high[i]]) + low[i]
            at = at[known.allow(np.full(len(at), slots[i]), slots[at])] if len(at) else at
            if len(at):
                free[at] = False
                left -= len(at)
                queue += at.tolist()
                yield int(slots[i]), slots[at]


def candidate_edges(lists: DataFrame, classes: DataFrame, percent: int, parts: int) -> DataFrame:
    """Distinct edges (a, b), a < b, that connect all classes between which a list leaves a chain of candidates.

    A bucket gives fewer than it has classes, however many pairs its lists hold.
    """

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        own = table.filter(table.column("class").is_valid()).combine_chunks()
        cls = own.column("class").to_numpy()
        order = np.argsort(cls)
        cls = cls[order]
        met = [np.zeros((0, 2), dtype=np.int64)]
        if len(cls):
            bits = own.column("bits").chunk(0)
            known = _Bitmaps(own.column("n").to_numpy()[order], [bits[i].as_buffer() for i in order.tolist()], percent)
            both = np.concatenate([np.frombuffer(x.as_buffer(), dtype=np.uint64).reshape(-1, 2) for x in table.column("blob") if x.is_valid])
            slot = np.searchsorted(cls, both[:, 1].view(np.int64))
            order = np.lexsort((slot, known.n[slot], both[:, 0]))
            token, slot = both[order, 0], slot[order]
            edges = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1], [True])))
            start, length = edges[:-1], np.diff(edges)
            two = np.unique(np.stack((slot[start[length == 2]], slot[start[length == 2] + 1]), axis=1), axis=0)
            met.append(two[known.allow(two[:, 0], two[:, 1])])
            done: set[bytes] = set()
            for s, k in zip(start[length > 2].tolist(), length[length > 2].tolist(), strict=True):
                members = slot[s : s + k]
                if (name := members.tobytes()) in done:
                    continue
                done.add(name)
                for i, at in _forest(members, known):
                    met.append(np.stack((np.full(len(at), i), at), axis=1))
        pairs = np.concatenate(met)
        root = _roots(len(cls), pairs[:, 0], pairs[:, 1])
        hung = np.flatnonzero(root != np.arange(len(cls)))
        return pa.table({"a": cls[root[hung]], "b": cls[hung]})

    blobs = lists.filter("blob is not null").select("bucket", "blob", F.lit(None).cast("bigint").alias("class"), F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("binary").alias("bits"))
    members = lists.filter("blob is null").select("bucket", "class").join(classes.select("class", "n", "bits"), "class")
    whole = blobs.unionByName(members.select("bucket", F.lit(None).cast("binary").alias("blob"), "class", "n", "bits"))
    return whole.groupBy("bucket").applyInArrow(meet, "a bigint, b bigint").distinct()


def _fetch(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(class, set) for wanted (doc_id, class): the whole set, sorted and packed."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in _sets(batches, width):
            kept = [s for s in sets if len(s)]
            cls = np.array([_class(s) for s in kept], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cls), pa.array([s.tobytes() for s in kept], pa.binary())], names=["class", "set"])

    ids = wanted.select(F.col("doc_id").alias("_id"))
    ids = F.broadcast(ids) if ids.count() <= _ALWAYS else ids
    found = docs.select("doc_id", "text").join(ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    return found.mapInArrow(pack, "class bigint, set binary")


class _Index:
    """Inverted lists over some of the sets of a block."""

    def __init__(self, sets: list[np.ndarray], members: np.ndarray) -> None:
        self.members = members
        sizes = np.array([len(sets[m]) for m in members])
        token = np.concatenate([sets[m] for m in members])
        doc = np.repeat(np.arange(len(members)), sizes)
        order = np.argsort(token, kind="stable")
        token, self.doc = token[order], doc[order]
        head = np.concatenate(([True], token[1:] != token[:-1]))
        self.token = token[head]
        self.start = np.append(np.flatnonzero(head), len(token))

    def overlaps(self, s: np.ndarray, sets: list[np.ndarray], need: int) -> np.ndarray:
        """Shared elements of ``s`` with each member; exact where they reach ``need``, else maybe less than they are."""
        at = np.minimum(np.searchsorted(self.token, s), len(self.token) - 1)
        at = at[self.token[at] == s]
        if len(at) < need:
            return np.zeros(len(self.members), dtype=np.int64)
        length = self.start[at + 1] - self.start[at]
        order = np.argsort(length, kind="stable")
        at, length = at[order], length[order]
        # the longest lists are set aside, fewer than the overlap needed, so that members must show up in a short one
        short = max(1, len(at) - max(0, need - 1))
        short = max(short, int(np.searchsorted(length, 64)))
        count = self._merge(at[:short], length[:short])
        aside = len(at) - short
        if not aside:
            return count
        probed = np.flatnonzero(count >= max(1, need - aside))
        if len(probed) * aside * 16 > int(length[short:].sum()):
            return count + self._merge(at[short:], length[short:])
        rest = self.token[np.sort(at[short:])]
        for i in probed.tolist():
            t = sets[self.members[i]]
            count[i] += int((t[np.minimum(np.searchsorted(t, rest), len(t) - 1)] == rest).sum())
        return count

    def _merge(self, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        first = np.concatenate(([0], np.cumsum(length)[:-1]))
        where = np.arange(int(length.sum())) + np.repeat(self.start[at] - first, length)
        return np.bincount(self.doc[where], minlength=len(self.members))


def _links(sets: list[np.ndarray], label: np.ndarray, percent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(index, indices) of each set that begins a component of a block and those that links connect with it.

    A set is searched among those not reached yet. Sets with one label are connected already.
    """
    size = np.array([len(s) for s in sets])
    free = np.ones(len(sets), dtype=bool)
    order = np.argsort(label, kind="stable")
    first, last = np.searchsorted(label[order], label, "left"), np.searchsorted(label[order], label, "right")
    index = _Index(sets, np.arange(len(sets)))
    left = len(sets)
    for seed in range(len(sets)):
        if not free[seed]:
            continue
        queue = order[first[seed] : last[seed]].tolist()
        free[queue] = False
        left -= len(queue)
        component = [np.array(queue)]
        while queue and left:
            i = queue.pop()
            if 2 * left < len(index.members):
                index = _Index(sets, np.flatnonzero(free))
            both = index.overlaps(sets[i], sets, -(-percent * len(sets[i]) // 100))
            m = index.members
            at = m[(100 * both >= percent * (size[i] + size[m] - both)) & free[m] & (both > 0)]
            if len(at):
                reached = np.concatenate([order[first[x] : last[x]] for x in at[np.unique(first[at], return_index=True)[1]].tolist()])
                free[reached] = False
                left -= len(reached)
                queue += reached.tolist()
                component.append(reached)
        if len(component) > 1 or len(component[0]) > 1:
            yield seed, np.concatenate(component)


def _search(dealt: DataFrame, percent: int, parts: int) -> DataFrame:
    """(a, b) for each set b of (class, set, label, _group) that links or labels within its group connect with others; a is one of them, itself for one.

    Groups share a task as buckets have it.
    """

    def search(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("_group", "ascending"), ("class", "ascending")]).combine_chunks()
        group, cls, label = (table.column(c).to_numpy() for c in ("_group", "class", "label"))
        packed = table.column("set").chunk(0) if table.num_rows else pa.array([], pa.binary())
        edges = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True]))) if len(group) else np.zeros(1, int)
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            sets = [np.frombuffer(packed[i].as_buffer(), dtype=np.uint64) for i in range(s, e)]
            for i, at in _links(sets, label[s:e], percent) if e - s > 1 else ():
                a.append(np.full(len(at), cls[s + i]))
                b.append(cls[s:e][at])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    columns = dealt.select("class", "label", "set", "_group", F.pmod("_group", F.lit(4 * parts)).alias("_bucket"))
    return columns.groupBy("_bucket").applyInArrow(search, "a bigint, b bigint")


def verified_links(groups: DataFrame, sets: DataFrame, percent: int, parts: int, small: int = _SMALL, block: int = _BLOCK) -> DataFrame:
    """Edges (a, b) within groups (node, component) of candidates that connect what all links connect, and nothing else.

    Groups with more than ``small`` elements in their sets are dealt to blocks of about that size and
    searched there; then one set of each part that is linked so far, again in blocks; then, for the groups
    that are still in parts, all pairs of blocks. There are eight of these blocks at most until one would
    exceed ``block`` elements; so each task holds two such blocks at most, or one set.
    """
    sized = sets.select("class", (F.octet_length("set") / 8).alias("_n"))
    own = groups.select(F.col("node").alias("class"), "component").join(sized, "class")
    count = lambda df: df.groupBy("component").agg(F.sum("_n").alias("_all"))
    blocks = lambda size: F.ceil(F.col("_all") / size).cast("int")
    place = lambda salt, k: F.pmod(F.xxhash64("class", F.lit(salt)), k).cast("int")
    own = materialise(own.join(count(own).filter(F.col("_all") > small), "component", "left"), "members")
    dealt = own.join(sets, "class").select("class", F.col("class").alias("label"), "set", F.xxhash64("component", F.coalesce(place(0, blocks(small)), F.lit(0))).alias("_group"))
    first = _search(dealt, percent, parts)
    own = own.filter("_all is not null")
    if own.isEmpty():
        return first
    first = materialise(first, "links")

    def labelled(members: DataFrame, column: str, links: DataFrame, name: str) -> DataFrame:
        """``members`` with the label that the links give their ``column``, which else stays."""
        at = links.select(F.col("b").alias("_b"), F.col("a").alias("_a"))
        found = members.join(at, members[column] == F.col("_b"), "left")
        return materialise(found.select("class", "component", "_n", F.coalesce("_a", column).alias("label")), name)

    now = labelled(own, "class", first, "parts")
    heads = now.filter("class = label").drop("label")
    heads = heads.join(count(heads), "component").join(sets, "class")
    second = materialise(_search(heads.select("class", F.col("class").alias("label"), "set", F.xxhash64("component", place(1, blocks(small))).alias("_group")), percent, parts), "links")
    now = labelled(now, "label", second, "parts")
    open_ = now.groupBy("component").agg(F.sum("_n").alias("_all"), F.min("label").alias("_low"), F.max("label").alias("_high")).filter("_low < _high").select("component", "_all")
    rest = now.join(open_, "component").withColumn("_k", F.greatest(F.least(F.lit(8), blocks(small)), blocks(block)))
    mine = place(2, F.col("_k"))
    others = F.filter(F.sequence(F.lit(0), F.col("_k") - 1), lambda x: (x != mine) | (F.col("_k") == 1))
    pairs = rest.join(sets, "class").select("class", "label", "set", "component", mine.alias("_mine"), F.explode(others).alias("_other"))
    third = _search(pairs.select("class", "label", "set", F.xxhash64("component", F.least("_mine", "_other"), F.greatest("_mine", "_other")).alias("_group")), percent, parts)
    return first.union(second).union(third)


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, class, component_id) for ``docs`` (doc_id, text).

    ``component_id`` is the smallest doc_id reachable by links of similarity ``percent`` / 100 or more.
    Texts without words, null ones too, have no shingles and are their own component. Repeated rows
    have equal sets, so they are one class. Other columns of ``docs`` are not read.
    """
    rows = materialise(shingle_rows(docs, width), "shingles")
    texts = rows.filter("slice is null").select("doc_id", "n", "class", "bits")
    marks = _long_lists(rows.filter("slice is not null").select("slice", "counts"))
    classes = materialise(texts.filter("n > 0").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.max("n").alias("n"), F.max("bits").alias("bits")), "classes")
    posted = (classes.agg(F.sum("n")).first()[0] or 0) * (100 - percent) // 100
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-posted // _RANGE))
    lists = materialise(postings(docs, marks, width, percent, parts), "lists")
    groups = materialise(connected_components(candidate_edges(lists, classes, percent, parts)), "groups")
    wanted = groups.select(F.col("node").alias("class")).join(classes.select("class", "doc_id"), "class")
    sets = materialise(_fetch(docs, materialise(wanted, "wanted"), width).dropDuplicates(["class"]), "sets")
    linked = connected_components(verified_links(groups, sets, percent, parts)).withColumnRenamed("node", "class")
    named = classes.join(linked, "class", "left").select("class", "doc_id", F.coalesce("component", "class").alias("component"))
    least = named.groupBy("component").agg(F.min("doc_id").alias("least"))
    labels = materialise(named.join(least, "component").select("class", "least"), "labels")
    return texts.join(labels, "class", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("class")).alias("class"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id")
    )


def op9_jaccard(documents: DataFrame) -> DataFrame:
    """Shingles of each document and the component of documents linked at 0.8 on five-word shingles."""
    return jaccard_components(documents).select("doc_id", "n_shingles", "component_id")
