"""Conversation trie, whitening and sharding: brute force, odd rows, exact inverses."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from paperlake.llm.sharding import Shuffle, number_rows, op13_sharding, shard_rows
from paperlake.llm.trie import ORACLE, number_turns, op11_trie, prefix_trie
from paperlake.llm.whitening import MissingPairs, feast, inertia, leading_intervals, op12_whitening

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TURNS = "conv_id bigint, turn bigint, role string, text string, depth int, key string, n_convs bigint, pos bigint, n bigint"


def trie_of(rows):
    """Nodes of the rebuilt conversations, by a dict of prefixes."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - int(math.fmod(c, 20)), [])[:h] + turns[h:]
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    out = []
    for node, ids in members.items():
        below = [x for x in members if x[: len(node)] == node]
        kids = {x for x in below if len(x) == len(node) + 1}
        leaf = [x for x in below if not any(y[: len(x)] == x and len(y) > len(x) for y in below)]
        saved = sum((len(members[x]) - 1) * len(WORD.findall(x[-1][1])) for x in below if x)
        ends = ",".join(str(c) for c in sorted(ids) if len(built[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(ids), len(node), parent, len(ids), len(kids), len(leaf), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(frame):
    return sorted((tuple(r) for r in frame.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


def conversations(seed, count, longest):
    rnd, rows = random.Random(seed), []
    for c in range(count):
        body = [(rnd.choice(["user", "assistant"]), rnd.choice(["a b", "c", "d e f", ""])) for _ in range(rnd.choice([1, 2, 3, 5, longest]))]
        if c % 3 == 0:
            body = [("system", "be brief"), *body[: rnd.randint(0, 2)]]
        rows += [(c + (c > 40) * 7, t, *x) for t, x in enumerate(body)]
    return rows


def frame_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, 3, 4) for r in rows], TURNS)


def test_trie_against_brute_force(spark):
    rows = conversations(1, 70, 30)
    rows += [(500, None, None, None), (500, 0, "user", "x"), (500, 0, "user", "x"), (500, 0, "assistant", "é 日本"), (None, 0, "user", "lost"), (501, 1, "user", "w " * 9000), (-7, 0, "user", "a"), (-7, 1, "user", "b"), (520, 0, "user", "p"), (520, 1, "a", "q"), (520, 2, "a", "r"), (521, 0, "x", "y")]
    assert found(op11_trie(frame_of(spark, rows))) == trie_of(rows)


def test_trie_bands_and_hot_conversation(spark):
    """A long conversation over several levels of bands and ranges, and one that a third of all share."""
    long = [(0, t, "user", str(t % 7)) for t in range(210)] + [(20, t, "user", str(t % 7)) for t in range(150)]
    rows = long + [(c, t, "user", f"hot {t}") for c in range(40, 100) for t in range(5)]
    for band in (2, 8):
        turns = number_turns(frame_of(spark, rows))
        members = turns.groupBy("conv_id").agg(F.max("pos").alias("length"))
        got = prefix_trie(turns.withColumnRenamed("pos", "depth"), members, band)
        plain = {r[:2]: r for r in found(got)}
        assert plain[(0, 0)][3:6] == (62, 2, 2) and plain[(0, 150)][3] == 2 and plain[(0, 151)][3] == 1 and len(plain) == 1 + 210 + 5
        assert plain[(40, 5)][6] == 59 * 2 and plain[(40, 1)][6] == 59 * 2 * 5
    assert found(op11_trie(frame_of(spark, rows))) == trie_of(rows)


def test_trie_sql_twin_and_empty(spark, tmp_path):
    rows = conversations(2, 30, 9)
    db = duckdb.connect()
    table = pa.table({k: pa.array([r[i] for r in rows], pa.string() if i > 1 else pa.int64()) for i, k in enumerate(("conv_id", "turn", "role", "text"))})
    db.register("conversations", table)
    twin = db.sql(ORACLE)
    assert sorted(twin.fetchall(), key=str) == trie_of(rows)
    assert op11_trie(frame_of(spark, rows).limit(0)).count() == 0
    assert op11_trie(frame_of(spark, [(3, None, None, None)])).count() == len(trie_of([(3, None, None, None)]))


def integers(vectors):
    return np.floor(np.asarray(vectors, dtype=np.float32).astype(np.float64) * 1024).astype(np.int64) + 100_000


def test_whitening_against_eigenvalues(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((400, 12)) * np.linspace(1, 2, 12)
    base[100:200] = base[100]
    rows = [(i, [float(np.float32(x)) for x in v], 1, 0) for i, v in enumerate(base)]
    bad = [(900, None, 1, 0), (901, [1.0] * 11 + [None], 1, 0), (902, [float("nan")] * 12, 1, 0), (903, [float("inf")] * 12, 1, 0)]
    rows += [(None, rows[0][1], None, None), rows[5]]
    frame = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<float>, label int, component int").repartition(5)
    got = op12_whitening(frame).toPandas()
    x = integers([r[1] for r in rows])
    n, y = len(x), x - x.sum(axis=0) / len(x)
    values, basis = np.linalg.eigh(y.T @ y / n)
    values, basis = values[::-1][:8], basis[:, ::-1][:, :8]
    white = y @ basis / np.sqrt(values)
    assert len(got) == 8 * n and got["n"].eq(n).all() and (got["identity_error"] < 1e-9).all() and got["identity_error"].nunique() == 1
    deviation = ((n * x - x.sum(axis=0)) ** 2).sum(axis=1)
    for k in range(8):
        part = got[got.component == k + 1]
        part = part[part.vec_id.notna()].drop_duplicates("vec_id").sort_values("vec_id")
        mine = part.whitened.to_numpy()
        sign = np.sign(mine @ white[:400, k])
        assert np.abs(mine * sign - white[:400, k]).max() < 1e-9
        assert (part.deviation.to_numpy() == deviation[:400]).all()
        assert np.abs(part.explained / (values[k] / (y**2).sum() * n) - 1).max() < 1e-12


def test_whitening_odd_tables(spark):
    kind = "vec_id bigint, embedding array<float>, label int"
    assert op12_whitening(spark.createDataFrame([], kind)).count() == 0
    assert op12_whitening(spark.createDataFrame([(1, None, 1), (2, [], 1)], kind)).count() == 0
    assert op12_whitening(spark.createDataFrame([(1, [1.0, 2.0], 1)] * 3, kind)).count() == 0
    line = op12_whitening(spark.createDataFrame([(1, [1.0, 2.0], 1), (2, [2.0, 4.0], 1)], kind)).collect()
    assert [abs(round(r.whitened, 9)) for r in line] == [1.0, 1.0] and {r.component for r in line} == {1}
    with pytest.raises(ValueError):
        op12_whitening(spark.createDataFrame([(1, [1.0, 2.0], 1), (2, [2.0], 1)], kind))


def test_feast_intervals():
    rng = np.random.default_rng(7)
    q, _ = np.linalg.qr(rng.standard_normal((40, 40)))
    for spectrum in (np.arange(1, 41), 2.0 ** -np.arange(40), np.repeat([9.0, 9.0 - 1e-7, 3.0, 1.0], 10), np.r_[[4.0] * 3, np.zeros(37)]):
        m = q @ np.diag(spectrum) @ q.T
        m = (m + m.T) / 2
        exact = np.linalg.eigvalsh(m)[::-1]
        for s in (0.5, 2.2, 3.5, 8.99):
            assert inertia(m, s) == (exact > s).sum()
        pairs = [feast(m, *x) for x in leading_intervals(m, 8)]
        values = np.sort(np.concatenate([p[0] for p in pairs]))[::-1]
        assert len(values) >= min(8, (exact > 1e-9).sum())
        assert np.abs(values[:8] - exact[: len(values)][:8]).max() < 1e-13 * exact[0]
        for v, b in pairs:
            assert np.abs(b.T @ b - np.eye(b.shape[1])).max() < 1e-12 and np.abs(m @ b - b * v).max() < 1e-12 * exact[0]
    with pytest.raises(MissingPairs):
        feast(np.diag(np.arange(1.0, 9)), 2.5, 4.5, 3, rounds=5)


def test_shuffle_is_a_permutation():
    for rows in (1, 2, 5, 40, 41, 1000, 4097, 65_537):
        s = Shuffle(rows, 7, seed=9)
        p = s.permute(np.arange(rows))
        assert sorted(p.tolist()) == list(range(rows)) and (s.invert(p) == np.arange(rows)).all()
        assert s.number(*s.place(rows - 1)) == rows - 1
    big = Shuffle((1 << 60) - 5)
    x = np.random.default_rng(0).integers(0, big.rows, 1000)
    assert (big.invert(big.permute(x)) == x).all()
    p = Shuffle(100_000).permute(np.arange(100_000))
    assert abs(np.corrcoef(np.arange(100_000), p)[0, 1]) < 0.02 and not (p == Shuffle(100_000, seed=1).permute(np.arange(100_000))).all()
    with pytest.raises(ValueError):
        Shuffle(5).permute(np.array([5]))


def test_sharding(spark):
    texts = ["", None, "é日本", "x" * 40_000, "same"] + ["same"] * 300 + [f"t{i}" for i in range(200)]
    rows = [(i, t, "en", "s", 1, 2, 3) for i, t in enumerate(texts)] + [(4, "same", "en", "s", 1, 2, 3)] * 9000 + [(None, None, None, None, None, None, None)] * 3
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, shard int, row_number int").repartition(4)
    got = op13_sharding(frame).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r[0], 16 + len((r[1] or "").encode()), zlib.crc32((r[1] or "").encode())) for r in rows)
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(40)) and max(counts.values()) - min(counts.values()) <= 1
    for k in range(40):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(counts[k]))
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)} and sorted(r.row_number for r in got) == list(range(len(rows)))
    s = Shuffle(len(rows))
    assert all(s.place(r.row_number) == (r.shard, r.slot) for r in got[:200])
    again = Counter(tuple(r) for r in op13_sharding(frame.repartition(3)).collect())
    assert again == Counter(tuple(r) for r in got)
    assert op13_sharding(frame.limit(0)).count() == 0
    assert sorted((r.shard, r.slot) for r in op13_sharding(frame.limit(3)).collect())[0][1] == 0
    with pytest.raises(ValueError):
        number_rows(frame.select(F.col("doc_id").alias("_n")))
    assert shard_rows(frame.select("doc_id"), 3, 1).columns == ["doc_id", "row_number", "shard", "slot"]


def pairs_of(rows):
    """Deepest shared prefixes first, a turn at a time: what comes from the heavy child before the others, by id."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        digest = None if text is None else hashlib.md5(text.encode()).hexdigest()
        own[c].append(((turn is not None, turn or 0), (role is not None, role or ""), (digest is not None, digest or ""), (role, text)))
    own = {c: tuple(x[3] for x in sorted(v, key=lambda x: x[:3])) for c, v in own.items()}
    members = Counter(t[:d] for t in own.values() for d in range(1, len(t) + 1))
    least = {}
    for c in sorted(own):
        for d in range(1, len(own[c]) + 1):
            least.setdefault(own[c][:d], c)
    heavy = {}
    for node in sorted((x for x in members if members[x] > 1 and len(x) > 1), key=lambda x: (members[x], -least[x])):
        heavy[node[:-1]] = node
    open_, found = set(own), {}
    for d in range(max(map(len, own.values())), 0, -1):
        at = defaultdict(list)
        for c in open_:
            if len(own[c]) >= d:
                at[own[c][:d]].append(c)
        for node, here in at.items():
            here.sort(key=lambda c: (own[c][: d + 1] != heavy.get(node, ()), c))
            for a, b in zip(here[::2], here[1::2]):
                found[min(a, b)] = (max(a, b), d)
                open_ -= {a, b}
    return {**{c: (None, 0) for c in open_}, **found}


def test_pairs_by_deepest_prefix(spark):
    from paperlake.llm.chat import ORACLE as TWIN
    from paperlake.llm.chat import op2_chat

    seen = [(c, 0, "system", "be brief") for c in (1, 2, 3, 4)] + [(c, 1, "user", "q" if c in (1, 3) else f"q{c}") for c in (1, 2, 3, 4)] + [(c, 2, "assistant", f"r{c}") for c in (1, 2, 3, 4)]
    got = {r.pair_id: (r.rejected_id, r.n_prompt_turns) for r in op2_chat(frame_of(spark, seen)).collect()}
    assert got == {1: (3, 2), 2: (4, 1)}
    clash = [(1, 0, None, "a"), (2, 0, "a", None), (3, 0, "a", ""), (4, 0, None, "a"), (5, 0, "", "a")]
    got = {r.pair_id: r.rejected_id for r in op2_chat(frame_of(spark, clash)).collect()}
    assert got == {1: 4, 2: None, 3: None, 5: None}

    rnd, rows = random.Random(12), []
    for c in range(90):
        rows += [(c, t, "user", f"{'s' if t == 0 else ''}{rnd.randint(0, 1 + (t > 2))}") for t in range(rnd.randint(1, 7))]
    rows += [(c, t, "user", f"long {t}") for c in range(100, 130) for t in range(c - 98)]  # each shares all turns of the one before
    rows += [(c, t, "user", "hot") for c in range(200, 251) for t in range(2)] + [(None, 0, "user", "hot")]
    expected = pairs_of([r for r in rows if r[0] is not None])
    rows.pop()
    got = {r.pair_id: (r.rejected_id, r.n_prompt_turns) for r in op2_chat(frame_of(spark, rows).repartition(5)).collect()}
    assert got == expected
    assert sum(p is None for p, _ in got.values()) <= 4
    db = duckdb.connect()
    db.register("conversations", pa.table({k: pa.array([r[i] for r in rows], pa.string() if i > 1 else pa.int64()) for i, k in enumerate(("conv_id", "turn", "role", "text"))}))
    twin = {r[0]: (r[2], r[3]) for r in db.sql(TWIN).fetchall()}
    assert twin == expected
    assert op2_chat(frame_of(spark, [(None, 0, "user", "hot"), *rows[-4:]])).count() == 2
