"""Running aggregates within groups, where one group may be most of the table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialise

__all__ = ["running"]

#: How a task's part is aggregated, and how two parts are put together.
_KINDS = {
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
    "xor": (F.bit_xor, lambda a, b: F.coalesce(a, F.lit(0)).bitwiseXOR(F.coalesce(b, F.lit(0)))),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
}


def running(df: DataFrame, group: str, order: Sequence[str], columns: dict[str, tuple[str, Column]]) -> DataFrame:
    """``df`` with aggregates up to and with each row of its group in this order; ``columns``: name to ("sum", "xor" or "max", column).

    Rows are dealt out by range of (group, order), so a large group is dealt over many tasks. What goes before a group's rows in a
    range comes from the ranges before: only the first and last group of a range can span ranges, two rows a range. A null
    group is one group.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    valued = df.withColumns({f"_v_{k}": c for k, (_, c) in columns.items()})
    dealt = materialise(valued.repartitionByRange(parts, group, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    within = Window.partitionBy("_range", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("_g").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    same = lambda left: (left["_range"] == F.col("_r")) & left[group].eqNullSafe(F.col("_g"))
    bounds = dealt.groupBy("_range").agg(F.min_by(F.struct(group), F.struct(group)).alias("_a"), F.max_by(F.struct(group), F.struct(group)).alias("_b"))
    edges = bounds.select(F.col("_range").alias("_r"), F.explode(F.array_distinct(F.array("_a", "_b"))).alias("_e")).select("_r", F.col(f"_e.{group}").alias("_g"))
    # two rows for each range at most: the number of partitions bounds both sides that are broadcast
    sums = dealt.join(F.broadcast(edges), same(dealt)).groupBy("_r", "_g").agg(*[_KINDS[f][0](f"_v_{k}").alias(f"_s_{k}") for k, (f, _) in columns.items()])
    carried = sums.select("_r", "_g", *[_KINDS[f][0](f"_s_{k}").over(before).alias(f"_c_{k}") for k, (f, _) in columns.items()])
    out = dealt.join(F.broadcast(carried), same(dealt), "left")
    out = out.withColumns({k: _KINDS[f][1](_KINDS[f][0](f"_v_{k}").over(within), F.col(f"_c_{k}")) for k, (f, _) in columns.items()})
    return out.drop("_range", "_r", "_g", *[f"_{p}_{k}" for p in "vc" for k in columns])
