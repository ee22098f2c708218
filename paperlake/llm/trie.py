"""Prefix trie of conversations with totals of subtrees, by a depth-band rollup.

``number_turns`` numbers the turns of each conversation, ``shared_openings`` replaces openings by those of other
conversations, and ``prefix_trie`` makes a node of each distinct sequence of first turns. A node's key is 128 bits: the
exclusive or of hashes of (depth, role, text) along the path, so a parent's key is the node's own without its last
turn, and equal prefixes meet by a plain aggregate with partial results. Keys run along each conversation
as a scan over ranges of (conversation, turn), so a conversation with a third of all turns is dealt over many tasks.

``rollup`` adds values of nodes over their subtrees. Depths are cut in bands of ``BAND``. Each node sends its value to
the root of its band; the roots of bands, with these sums, are a trie of a ``BAND``-th of the depth, which is rolled up in
the same way; then each node gets the finished totals of the band roots right below it on top of its own value, and explodes
to its ancestors within its band. A node is thus copied ``BAND`` times at most, and the number of rounds grows
with the logarithm of the depth.

Turns are in order of turn (null first), then role, then the MD5 of the text; null roles and texts are empty; repeated
rows count each. Rows without a conversation id are no conversation and are left out. No conversations give no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mixing import word_count
from .scan import running
from .scratch import materialise

__all__ = ["ORACLE", "number_turns", "op11_trie", "prefix_trie", "rollup", "shared_openings"]

BAND = 8
_IDS = 4096
_EMPTY = hashlib.sha256(b"").hexdigest()


def number_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, role, digest, words) for each turn; ``digest`` stands for the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    turns = conversations.filter("conv_id IS NOT NULL").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.md5(F.encode(text, "UTF-8")).alias("digest"), word_count(text).alias("words"))
    return running(turns, "conv_id", ["turn", "role", "digest"], {"pos": ("sum", F.lit(1).cast("long"))}).drop("turn")


def shared_openings(numbered: DataFrame, group: int = 20, most: int = 3) -> tuple[DataFrame, DataFrame]:
    """(rebuilt turns, conversations with ``length``): conversation c starts with the first h turns of c - c % group, then goes on with its own after its first h; h = crc32(c) % (most + 1)."""
    own = numbered.groupBy("conv_id").agg(F.count("*").alias("n"))
    own = own.withColumns({"h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1), "base": F.col("conv_id") - F.col("conv_id") % group})
    bases = own.filter("conv_id = base").select("base", F.col("n").alias("_base_n"))
    plan = own.join(bases, "base", "left").select("conv_id", "base", "h", "n", F.least("h", F.coalesce("_base_n", F.lit(0))).alias("borrowed"))
    plan = materialise(plan.withColumn("length", F.col("borrowed") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "plan")
    turn = ["role", "digest", "words"]
    # a base lends its first turns to the group's conversations at most
    heads = numbered.filter((F.col("conv_id") % group == 0) & (F.col("pos") <= most)).select(F.col("conv_id").alias("base"), "pos", *turn)
    lent = plan.filter("borrowed > 0").join(heads, "base").filter("pos <= borrowed").select("conv_id", F.col("pos").alias("depth"), *turn)
    kept = numbered.join(plan.select("conv_id", "h", "borrowed"), "conv_id").filter("pos > h").select("conv_id", (F.col("borrowed") + F.col("pos") - F.col("h")).alias("depth"), *turn)
    return lent.union(kept), plan.select("conv_id", "length")


def rollup(nodes: DataFrame, paths: DataFrame, values: Sequence[str], band: int = BAND) -> DataFrame:
    """(key, values summed over subtrees) for ``nodes`` (key, parent, depth, conv_id, values).

    ``paths`` (conv_id, depth, key) has, from depth 0 on, the keys along the path of each node's conv_id.
    """
    of = lambda d: F.expr(f"{d} div {band}")
    lists = paths.groupBy("conv_id", of("depth").alias("_band")).agg(F.sort_array(F.collect_list(F.struct("depth", "key"))).alias("_all"))
    chained = nodes.withColumn("_band", of("depth")).join(lists, ["conv_id", "_band"])
    up = F.slice(F.col("_all.key"), F.lit(1), (F.col("depth") % band + 1).cast("int"))
    chained = materialise(chained.select("key", "parent", "depth", "conv_id", *values, up.alias("_up")), "bands")
    sums = [F.sum(v).alias(v) for v in values]
    if (chained.agg(F.max("depth")).first()[0] or 0) >= band:
        own = chained.groupBy(F.get("_up", F.lit(0)).alias("key")).agg(*sums)
        tops = chained.filter(F.col("depth") % band == 0)
        grand = paths.filter(F.col("depth") % band == 0).select("conv_id", of("depth").alias("depth"), "key")
        parents = grand.select("conv_id", (F.col("depth") + 1).alias("_next"), F.col("key").alias("parent"))
        roots = tops.select("key", "conv_id", of("depth").alias("depth")).join(own, "key")
        roots = roots.join(parents, (roots["conv_id"] == parents["conv_id"]) & (roots["depth"] == parents["_next"]), "left").select(roots["key"], "parent", roots["depth"], roots["conv_id"], *values)
        done = rollup(roots, grand, values, band)
        below = done.join(tops.filter("depth > 0").select("key", "parent"), "key").groupBy(F.col("parent").alias("key")).agg(*[F.sum(v).alias(f"_b_{v}") for v in values])
        chained = chained.join(below, "key", "left").select("key", "_up", *[(F.col(v) + F.coalesce(f"_b_{v}", F.lit(0))).alias(v) for v in values])
    summed = chained.select(F.explode("_up").alias("key"), *values).groupBy("key").agg(*sums)
    return materialise(summed, "totals")


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the pieces of each node, which come in order, one piece in memory at a time."""
    key, state, done = None, None, []
    for b in batches:
        for k, piece in zip(b.column("key").to_pylist(), b.column("ids").to_pylist(), strict=True):
            if state is None or k != key:
                if state is not None:
                    done.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256(piece.encode())
            else:
                state.update(f",{piece}".encode())
        if done:
            yield _digests(done)
            done = []
    if state is not None:
        yield _digests([(key, state.hexdigest())])


def _digests(rows: list[tuple[dict, str]]) -> pa.RecordBatch:
    kind = pa.struct([("a", pa.int64()), ("b", pa.int64())])
    return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], kind), pa.array([d for _, d in rows], pa.string())], ["key", "ends_sha256"])


def prefix_trie(turns: DataFrame, members: DataFrame, band: int = BAND) -> DataFrame:
    """A row for each node of the trie of ``turns`` (conv_id, depth from 1, role, digest, words); ``members`` (conv_id, length) has all conversations, turnless ones too."""
    salted = lambda salt: F.xxhash64("depth", "role", "digest", F.lit(salt))
    hashed = turns.withColumns({"_h1": salted(1), "_h2": salted(2)})
    keyed = running(hashed.select("conv_id", "depth", "words", "_h1", "_h2"), "conv_id", ["depth"], {"_k1": ("xor", F.col("_h1")), "_k2": ("xor", F.col("_h2"))})
    parent = F.struct(F.col("_k1").bitwiseXOR(F.col("_h1")).alias("a"), F.col("_k2").bitwiseXOR(F.col("_h2")).alias("b"))
    keyed = keyed.select("conv_id", "depth", F.struct(F.col("_k1").alias("a"), F.col("_k2").alias("b")).alias("key"), parent.alias("parent"), "words")
    root = F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    zero = members.select("conv_id", F.lit(0).cast("long").alias("depth"), root.alias("key"), F.lit(None).cast("struct<a:bigint,b:bigint>").alias("parent"), F.lit(0).cast("long").alias("words"))
    paths = materialise(keyed.union(zero), "paths")

    nodes = paths.groupBy("key").agg(F.max("depth").alias("depth"), F.max("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("words").alias("words"))
    children = paths.filter("depth > 0").select("key", "parent").distinct().groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = materialise(nodes.withColumns({"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("words")}), "nodes")
    totals = rollup(nodes.select("key", "parent", "depth", "conv_id", "n_leaves", "saved_tokens"), paths.select("conv_id", "depth", "key"), ["n_leaves", "saved_tokens"], band)

    ended = paths.join(members, "conv_id").filter("depth = length")
    pieces = ended.groupBy("key", F.expr(f"conv_id div {_IDS}").alias("piece")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))
    ends = pieces.repartition("key").sortWithinPartitions("key", "piece").select("key", "ids").mapInArrow(_hashed, "key struct<a:bigint,b:bigint>, ends_sha256 string")

    above = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    # nodes right below the root, as many as there are first turns, need no join
    first = nodes.filter("depth = 0").select("conv_id").first()
    deep = nodes.filter("depth > 1").join(above, "parent", "left")
    flat = nodes.filter("depth <= 1").withColumn("parent_conv_id", F.when(F.col("depth") == 1, F.lit(first[0] if first else None).cast("long")))
    columns = ["key", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children"]
    return deep.select(columns).union(flat.select(columns)).join(totals, "key").join(ends, "key", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.col("n_children").cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(_EMPTY)).alias("ends_sha256")
    )


def op11_trie(conversations: DataFrame) -> DataFrame:
    """Nodes of the trie of all conversations with shared openings, with totals of their subtrees."""
    return prefix_trie(*shared_openings(number_turns(conversations)))


ORACLE = r"""
WITH RECURSIVE crc(i, v, s) AS (
  SELECT i, CAST(i AS BIGINT), 0 FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, s + 1 FROM crc WHERE s < 8),
tab AS (SELECT list(v ORDER BY i) AS l FROM crc WHERE s = 8),
t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, count(*) AS n, conv_id - conv_id % 20 AS base,
    xor(list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1), lambda i: CAST(ascii(CAST(conv_id AS VARCHAR)[i]) AS BIGINT)), lambda a, b: xor(a >> 8, tab.l[1 + (xor(a, b) & 255)])), 4294967295) % 4 AS h
  FROM t, tab GROUP BY conv_id, tab.l),
p AS (SELECT c.conv_id, c.base, c.h, least(c.h, coalesce(b.n, 0)) AS g, least(c.h, coalesce(b.n, 0)) + greatest(c.n - c.h, 0) AS m FROM c LEFT JOIN c b ON b.conv_id = c.base),
r AS (
  SELECT p.conv_id, pos AS d, role, text FROM p JOIN t ON t.conv_id = p.base AND pos <= g
  UNION ALL SELECT conv_id, g + pos - h, role, text FROM p JOIN t USING (conv_id) WHERE pos > h),
k AS (
  SELECT conv_id, d, text, list({'r': role, 't': md5(text)}) OVER (PARTITION BY conv_id ORDER BY d) AS seq FROM r
  UNION ALL SELECT conv_id, 0, '', CAST([] AS STRUCT(r VARCHAR, t VARCHAR)[]) FROM p),
n AS (
  SELECT d, seq, min(conv_id) AS conv_id, count(*) AS n_convs, max(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)) AS w,
    coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (d = (SELECT m FROM p WHERE p.conv_id = k.conv_id)), '') AS ends
  FROM k GROUP BY d, seq),
u AS (SELECT n.*, (SELECT count(*) FROM n x WHERE x.d = n.d + 1 AND x.seq[:n.d] = n.seq) AS kids, a.conv_id AS up FROM n LEFT JOIN n a ON a.d = n.d - 1 AND a.seq = n.seq[:n.d - 1]),
s AS (
  SELECT a.d, a.seq, sum(CASE WHEN v.kids = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((v.n_convs - 1) * v.w) AS saved
  FROM u v JOIN k a ON a.conv_id = v.conv_id AND a.d <= v.d GROUP BY a.d, a.seq)
SELECT u.conv_id, u.d AS depth, CASE WHEN u.d > 0 THEN up END AS parent_conv_id, n_convs, kids AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(ends) AS ends_sha256
FROM u JOIN s USING (d, seq)
"""
