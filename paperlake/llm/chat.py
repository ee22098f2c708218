"""Chat formatting: preference pairs from conversations that begin alike.

``pair_conversations`` pairs conversations by their deepest shared prefix of turns: in the trie of all conversations each node
pairs what its subtree leaves over, and what it leaves over itself, one conversation at most, goes one turn up. Order at a node:
first what comes from its heavy child (the child with most conversations, of two and more; among equals the one with the
smallest id), then the others by id. So along a heavy path, from the bottom up, conversations are paired as they stand, and
one may be left for the node above the path. A path from a leaf to the root changes heavy paths log2(conversations) times at most, which
bounds the rounds, whatever the depth. Numbers along a heavy path come from a range sort, so a prefix that a third of all
conversations share is dealt over many tasks. The smaller id is the chosen one. A conversation that finds no partner with
the same first turn is a pair without a rejected one.

``format_preferences`` lays the turns of both sides next to each other, takes the longest common prefix of
turns (role and text, nulls equal), renders it once as the prompt, and renders the rest of each side as
its completion. Masks are spans ``start:end`` in code points of a completion, comma-joined, that carry a loss:
the text and end mark of assistant turns. Equal conversations have empty completions.

A null role is rendered as ``user``, a null text as empty, but a null is no empty text and no role where prefixes are compared. Turns are
in order of turn, then role, then the text's MD5, nulls first; repeated rows count each. A null conversation id is one conversation.
Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mixing import running_sum
from .scan import running
from .scratch import materialise

__all__ = ["format_preferences", "op2_chat", "pair_conversations"]


def _digest(text: str) -> Column:
    return F.md5(F.encode(F.col(text), "UTF-8"))


def _prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, key, parent): 128 bits for each prefix of each conversation, made of hashes of (depth, role, text)."""
    bare = turns.select("conv_id", "turn", "role", _digest("text").alias("digest"))
    placed = running(bare, "conv_id", ["turn", "role", "digest"], {"depth": ("sum", F.lit(1).cast("long"))})
    hashed = lambda salt: F.xxhash64("depth", F.col("role").isNull(), "role", F.col("digest").isNull(), "digest", F.lit(salt))
    keyed = running(placed.select("conv_id", "depth", hashed(1).alias("_h1"), hashed(2).alias("_h2")), "conv_id", ["depth"], {"_k1": ("xor", F.col("_h1")), "_k2": ("xor", F.col("_h2"))})
    return keyed.select("conv_id", "depth", F.struct(F.col("_k1").alias("a"), F.col("_k2").alias("b")).alias("key"), F.struct(F.col("_k1").bitwiseXOR(F.col("_h1")).alias("a"), F.col("_k2").bitwiseXOR(F.col("_h2")).alias("b")).alias("parent"))


def pair_conversations(turns: DataFrame) -> DataFrame:
    """(pair_id, conv_id, side): side 0 is chosen, side 1 rejected; pair_id is the chosen id."""
    prefixes = materialise(_prefixes(turns), "prefixes")
    nodes = prefixes.groupBy("key").agg(F.count("*").alias("n"), F.min("conv_id").alias("_id"), F.max("depth").alias("depth"), F.max("parent").alias("parent")).filter("n > 1")
    nodes = materialise(nodes, "nodes")
    heavy = nodes.filter("depth > 1").groupBy("parent").agg(F.max_by("key", F.struct("n", -F.coalesce(F.col("_id"), F.lit(1 << 62)))).alias("key")).select("key", F.lit(0).alias("_light"))
    light = nodes.select("key").join(heavy, "key", "left").select("key", F.coalesce("_light", F.lit(1)).cast("long").alias("_light"))
    shared = prefixes.select("conv_id", "depth", "key").join(light, "key")
    head = F.when(F.col("_light") == 1, F.struct(F.col("depth").alias("top"), F.col("key").alias("key")))
    laid = running(shared, "conv_id", ["depth"], {"path": ("max", head), "level": ("sum", F.col("_light"))}).select("conv_id", "depth", "path", "level")
    laid = materialise(laid, "paths")

    deepest = laid.groupBy("conv_id").agg(F.max(F.struct("depth", "path", "level")).alias("_at")).select("conv_id", "_at.*")
    start = materialise(deepest, "starts")
    whole, items = None, None
    for level in range(start.agg(F.max("level")).first()[0] or 0, 0, -1):
        here = start.filter(F.col("level") == level).select("conv_id", "depth", "path")
        items = here if items is None else here.union(items)
        numbered = running_sum(items.withColumns({"_up": -F.col("depth"), "_one": F.lit(1)}), ["path", "_up", "conv_id"], "_one", "_at")
        first = numbered.groupBy("path").agg(F.min("_at").alias("_first"))
        placed = numbered.join(first, "path").withColumn("_c", F.expr("(_at - _first) div 2"))
        members = F.struct(F.col("conv_id").alias("id"), "depth")
        couples = materialise(placed.groupBy("path", "_c").agg(F.min(members).alias("a"), F.max(members).alias("b"), F.count("*").alias("_n")), f"pairs{level}")
        found = couples.filter("_n = 2").select(F.col("a.id").alias("pair_id"), F.col("b.id").alias("other"))
        whole = found if whole is None else whole.union(found)
        left = couples.filter("_n = 1 and path.top > 1").select(F.col("a.id").alias("_id"), (F.col("path.top") - 1).alias("_d"))
        items = materialise(left.join(laid, F.col("_id").eqNullSafe(laid["conv_id"]) & (F.col("_d") == laid["depth"])).select("conv_id", "depth", "path"), f"left{level}")
    everyone = prefixes.filter("depth = 1").select("conv_id")
    if whole is None:
        return everyone.select(F.col("conv_id").alias("pair_id"), "conv_id", F.lit(0).alias("side"))
    paired = whole.select("pair_id", F.col("pair_id").alias("conv_id"), F.lit(0).alias("side")).union(whole.select("pair_id", F.col("other").alias("conv_id"), F.lit(1)))
    alone = everyone.join(paired.select(F.col("conv_id").alias("_id")), F.col("conv_id").eqNullSafe(F.col("_id")), "left_anti")
    return paired.union(alone.select(F.col("conv_id").alias("pair_id"), "conv_id", F.lit(0)))


def _body(turn: Column) -> Column:
    return F.coalesce(turn["text"], F.lit(""))


def _head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(turn["role"], F.lit("user")), F.lit("|>\n"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), _body(t), F.lit("<|end|>\n"))), "")


def _mask(turns: Column) -> Column:
    """Spans of assistant turns, by a running offset."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        begin = acc["at"] + F.length(_head(t))
        end = begin + F.length(_body(t)) + 7
        span = F.array(F.concat_ws(":", begin.cast("string"), end.cast("string")))
        spans = F.when(t["role"] == "assistant", F.concat(acc["spans"], span)).otherwise(acc["spans"])
        return F.struct((end + 1).alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: F.array_join(acc["spans"], ","))


def format_preferences(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """A row for each pair: prompt, both completions and their masks; a missing rejected side is null."""
    sided = turns.alias("t").join(pairs.alias("p"), F.col("t.conv_id").eqNullSafe(F.col("p.conv_id")))
    turn = F.struct(F.col("t.turn").alias("turn"), F.col("t.role").alias("role"), _digest("t.text").alias("digest"), F.col("t.text").alias("text"))
    of = lambda k: F.sort_array(F.collect_list(F.when(F.col("p.side") == k, turn)))
    both = sided.groupBy("p.pair_id").agg(
        of(0).alias("c"), of(1).alias("r"), F.max(F.when(F.col("p.side") == 1, F.col("p.conv_id"))).alias("rejected_id"), (F.max("p.side") == 1).alias("_two")
    )
    shorter = F.least(F.size("c"), F.size("r"))
    differs = lambda i: ~(F.get("c", i)["role"].eqNullSafe(F.get("r", i)["role"]) & F.get("c", i)["text"].eqNullSafe(F.get("r", i)["text"]))
    first = F.array_min(F.filter(F.when(shorter > 0, F.sequence(F.lit(0), shorter - 1)).otherwise(F.array().cast("array<int>")), differs))
    laid = both.withColumn("n_prompt_turns", F.coalesce(first, shorter))
    rest = lambda side: F.slice(side, F.col("n_prompt_turns") + 1, F.size(side))
    laid = laid.withColumns({"_c": rest("c"), "_r": rest("r")})
    two = lambda c: F.when(F.col("_two"), c)
    return laid.select(
        "pair_id", F.col("pair_id").alias("chosen_id"), "rejected_id", "n_prompt_turns", _rendered(F.slice("c", 1, F.col("n_prompt_turns"))).alias("prompt"),
        _rendered(F.col("_c")).alias("chosen"), _mask(F.col("_c")).alias("chosen_mask"), two(_rendered(F.col("_r"))).alias("rejected"), two(_mask(F.col("_r"))).alias("rejected_mask"),
    )


def op2_chat(conversations: DataFrame) -> DataFrame:
    """All conversations as preference pairs with prompt, completions and masks."""
    turns = conversations.select("conv_id", "turn", "role", "text")
    return format_preferences(turns, pair_conversations(turns))


ORACLE = """
WITH RECURSIVE turns AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, md5(text) NULLS FIRST) AS d FROM conversations),
pre AS (SELECT conv_id, d, list({'r': role, 't': text}) OVER (PARTITION BY conv_id ORDER BY d) AS seq FROM turns),
node AS (SELECT d, seq, count(*) AS n, min(conv_id) AS least FROM pre GROUP BY d, seq HAVING count(*) > 1),
heavy AS (SELECT d, seq FROM (SELECT *, row_number() OVER (PARTITION BY seq[:d - 1] ORDER BY n DESC, least) AS r FROM node WHERE d > 1) WHERE r = 1),
sh AS (SELECT p.conv_id, p.d, p.seq, h.seq IS NOT NULL AS is_heavy FROM pre p JOIN node USING (d, seq) LEFT JOIN heavy h USING (d, seq)),
climb AS (
  SELECT DISTINCT conv_id, (SELECT max(d) + 1 FROM sh) AS d, CAST(NULL AS BIGINT) AS pair_id, 0 AS n FROM pre
  UNION ALL
  SELECT conv_id, d, CASE WHEN seq IS NOT NULL AND NOT (p % 2 = 1 AND p = n) THEN CASE WHEN p % 2 = 1 THEN least(conv_id, after) ELSE least(conv_id, before) END END, n
  FROM (
    SELECT *, lag(conv_id) OVER w AS before, lead(conv_id) OVER w AS after FROM (
      SELECT c.conv_id, c.d - 1 AS d, a.seq, coalesce(b.is_heavy, false) AS carried,
        row_number() OVER (PARTITION BY a.seq ORDER BY coalesce(b.is_heavy, false) DESC, c.conv_id) AS p, count(*) OVER (PARTITION BY a.seq) AS n
      FROM climb c LEFT JOIN sh a ON a.conv_id = c.conv_id AND a.d = c.d - 1 LEFT JOIN sh b ON b.conv_id = c.conv_id AND b.d = c.d
      WHERE c.pair_id IS NULL AND c.d > 1)
    WINDOW w AS (PARTITION BY seq ORDER BY p))),
found AS (SELECT conv_id, max(pair_id) AS pair_id FROM climb GROUP BY conv_id),
pairs AS (SELECT conv_id, coalesce(pair_id, conv_id) AS pair_id, CASE WHEN coalesce(pair_id, conv_id) = conv_id THEN 0 ELSE 1 END AS side FROM found),
t AS (
  SELECT pair_id, side, c.conv_id, role, text, row_number() OVER (PARTITION BY c.conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, md5(text) NULLS FIRST) - 1 AS i,
    '<|' || coalesce(role, 'user') || '|>' || chr(10) || coalesce(text, '') || '<|end|>' || chr(10) AS s, length('<|' || coalesce(role, 'user') || '|>') + 1 AS h, length(coalesce(text, '')) AS l
  FROM conversations c JOIN pairs USING (conv_id)),
size AS (SELECT pair_id, count(*) FILTER (side = 0) AS nc, count(*) FILTER (side = 1) AS nr, max(conv_id) FILTER (side = 1) AS rejected_id FROM t GROUP BY pair_id),
diff AS (
  SELECT a.pair_id, min(a.i) AS d FROM t a JOIN t b ON a.pair_id = b.pair_id AND a.i = b.i AND a.side = 0 AND b.side = 1
  WHERE a.role IS DISTINCT FROM b.role OR a.text IS DISTINCT FROM b.text GROUP BY a.pair_id),
cut AS (SELECT s.*, coalesce(d, least(nc, nr)) AS n FROM size s LEFT JOIN diff USING (pair_id)),
o AS (
  SELECT t.*, n, i < n AS shared, coalesce(sum(length(s)) FILTER (i >= n) OVER (PARTITION BY t.pair_id, side ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM t JOIN cut USING (pair_id))
SELECT c.pair_id, c.pair_id AS chosen_id, c.rejected_id, CAST(c.n AS INTEGER) AS n_prompt_turns,
  coalesce(string_agg(s, '' ORDER BY i) FILTER (side = 0 AND shared), '') AS prompt,
  coalesce(string_agg(s, '' ORDER BY i) FILTER (side = 0 AND NOT shared), '') AS chosen,
  coalesce(string_agg((pos + h) || ':' || (pos + h + l + 7), ',' ORDER BY i) FILTER (side = 0 AND NOT shared AND role = 'assistant'), '') AS chosen_mask,
  CASE WHEN nr > 0 THEN coalesce(string_agg(s, '' ORDER BY i) FILTER (side = 1 AND NOT shared), '') END AS rejected,
  CASE WHEN nr > 0 THEN coalesce(string_agg((pos + h) || ':' || (pos + h + l + 7), ',' ORDER BY i) FILTER (side = 1 AND NOT shared AND role = 'assistant'), '') END AS rejected_mask
FROM cut c JOIN o USING (pair_id) GROUP BY c.pair_id, c.rejected_id, c.n, nr
"""
