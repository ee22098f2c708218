"""Sharding by a Feistel permutation of global row numbers.

``number_rows`` gives each row a number from 0 in the order of all its columns. ``Shuffle`` permutes these numbers:
a balanced Feistel network permutes the smallest range of an even number of bits that holds them, and a number that
leaves the table is sent through again until it is back (cycle walking; the range has less than four times the
rows, so four passes at most are expected). The place ``p`` of a row in the shuffled table makes it row
``p div shards`` of shard ``p mod shards``: counts of shards differ by one at most, slots have no gaps, and no two
rows meet. Both ways can be computed for one number alone, from the number of rows, the number of shards and the
seed: ``place`` tells where a row is and ``number`` which row a slot holds, without a look at the data.

Equal rows are interchangeable, so they are counted before they are numbered and dealt out in blocks after; a row
that is a third of the table is no large task. Numbers come from a range sort of the counted rows with a sum of
each range's rows. The text isn't moved: its size and CRC-32 are.

A null text has size 16 and CRC-32 0, like an empty one. Null ids are rows like any. An empty table gives an empty table;
with fewer rows than shards some shards are empty.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .mixing import running_sum

__all__ = ["Shuffle", "number_rows", "op13_sharding", "shard_rows"]

SHARDS = 40
_PRIME = (1 << 31) - 1


@dataclass(frozen=True)
class Shuffle:
    """A permutation of 0 to ``rows - 1`` and the shards it deals them to."""

    rows: int
    shards: int = SHARDS
    seed: int = 0
    rounds: int = 6

    def __post_init__(self) -> None:
        if self.rows > 1 << 60 or self.shards < 1:
            raise ValueError("up to 2 ** 60 rows, and a shard at least")

    @property
    def half(self) -> int:
        """Bits of each half of a number."""
        return max(1, (max(self.rows - 1, 1).bit_length() + 1) // 2)

    def keys(self) -> list[tuple[int, int]]:
        """Factor and summand of each round, from the seed."""
        digests = (hashlib.sha256(f"{self.seed}:{k}".encode()).digest() for k in range(self.rounds))
        return [(1 + int.from_bytes(d[:8]) % (_PRIME - 1), int.from_bytes(d[8:16]) % _PRIME) for d in digests]

    def _mixed(self, x: np.ndarray, key: tuple[int, int]) -> np.ndarray:
        y = (x * key[0] + key[1]) % _PRIME  # below 2 ** 31, so no product leaves 64 bits
        y = (y * y + key[1]) % _PRIME
        return (y >> 3) & ((1 << self.half) - 1) if self.half <= 28 else y & ((1 << self.half) - 1)

    def _pass(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> self.half, x & ((1 << self.half) - 1)
        for key in reversed(self.keys()) if back else self.keys():
            if back:
                left, right = right ^ self._mixed(left, key), left
            else:
                left, right = right, left ^ self._mixed(right, key)
        return left << self.half | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        x = np.asarray(x, dtype=np.int64)
        if x.size and (x.min() < 0 or x.max() >= self.rows):
            raise ValueError(f"numbers lie in 0 to {self.rows - 1}")
        out = self._pass(x, back)
        while (away := np.flatnonzero(out >= self.rows)).size:
            out[away] = self._pass(out[away], back)
        return out

    def permute(self, x: np.ndarray) -> np.ndarray:
        return self._walk(np.atleast_1d(x), False)

    def invert(self, x: np.ndarray) -> np.ndarray:
        return self._walk(np.atleast_1d(x), True)

    def place(self, number: int) -> tuple[int, int]:
        """Shard and slot of a row number."""
        p = int(self.permute(np.array([number]))[0])
        return p % self.shards, p // self.shards

    def number(self, shard: int, slot: int) -> int:
        """Row number in a slot of a shard."""
        return int(self.invert(np.array([slot * self.shards + shard]))[0])


def number_rows(rows: DataFrame, name: str = "row_number", block: int = 4096) -> tuple[DataFrame, int]:
    """``rows`` with their numbers from 0 in the order of all columns, and how many there are."""
    columns = list(rows.columns)
    if clash := {name, "_n", "_upto", "_range"}.intersection(columns):
        raise ValueError(f"columns that are used inside: {sorted(clash)}")
    counted = rows.groupBy(*columns).agg(F.count("*").alias("_n"))
    summed = running_sum(counted, columns, "_n", "_upto")
    total = summed.agg(F.max("_upto")).first()[0] or 0
    start = F.col("_upto") - F.col("_n")
    single = summed.filter("_n = 1").select(*columns, start.alias(name))
    blocks = summed.filter("_n > 1").select(*columns, F.explode(F.sequence(start, F.col("_upto") - 1, F.lit(block))).alias("_from"), "_upto").repartition("_from")
    many = blocks.select(*columns, F.explode(F.sequence("_from", F.least(F.col("_from") + (block - 1), F.col("_upto") - 1))).alias(name))
    return single.union(many), total


def shard_rows(rows: DataFrame, shards: int = SHARDS, seed: int = 0, name: str = "row_number") -> DataFrame:
    """``rows`` with their number and their ``shard`` (int) and ``slot`` (long) after the shuffle."""
    numbered, total = number_rows(rows, name)
    shuffle = Shuffle(total, shards, seed)
    permuted = F.arrow_udf(lambda x: pa.array(shuffle.permute(x.to_numpy(zero_copy_only=False))), "long")
    placed = numbered.withColumn("_place", permuted(F.col(name)))
    return placed.withColumns({"shard": (F.col("_place") % shards).cast("int"), "slot": F.expr(f"_place div {shards}")}).drop("_place")


def op13_sharding(documents: DataFrame) -> DataFrame:
    """All documents in shards 0 to 39, by the law of rows: counts differ by one at most."""
    data = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    rows = documents.select("doc_id", (F.length(data) + 16).cast("long").alias("size"), F.crc32(data).alias("text_crc32"))
    out = shard_rows(rows)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")
