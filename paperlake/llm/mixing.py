"""Mixing sources to target weights by entropy balancing.

Sources get shares of a budget of words by weight, up to a cap; the excess goes to the others
(``source_targets``). Within a source each document gets the rate ``min(cap, exp(lambda * x))``,
with x its size over the source's largest: among all rates between 0 and the cap that meet the
source's target, these have the least relative entropy to taking each document once. lambda is the
dual variable of the source's word constraint; Newton steps for all sources run side by side over
a histogram of sizes (``tilts``), kept inside a bracket, so that they always converge. Rates become
whole copies by systematic rounding along (source, size, hash of the id): a running sum of rates
crosses as many whole numbers as there are copies (``rounded_copies``). The hash has a fixed seed
and rates are summed as integers, so reruns agree.

A null text, like one without words, has size 0 and takes nothing. A null source is a source of its
own, the last. Only DataFrame functions are used. What grows with the input is shuffled: sums per
source have partial sums first, and the running sum is dealt out by range, which splits large
sources and sizes alike. Steps that need one number (totals, residuals) bring one row to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Rounds, materialise

__all__ = ["mix_sources", "op4_mixing", "rounded_copies", "running_sum", "source_targets", "tilts", "word_count"]

WORD = r"[^\x20\x09-\x0D]+"
_UNIT = 1 << 24


def word_count(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running_sum(df: DataFrame, order: Sequence[str], value: str, name: str, parts: int | None = None) -> DataFrame:
    """``df`` with the sum of an integer column up to and with each row, in this order, without one task that sees all rows.

    Rows are dealt out by range; each range sums its own, and the sums of whole ranges, one row a
    partition, are added from the side.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialise(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("_range").agg(F.sum(value).alias("_sum"))
    base = sums.select("_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    # one row for each partition of the ranges above: the number of partitions bounds it
    return dealt.join(F.broadcast(base), "_range").withColumn(name, F.col("_base") + F.sum(value).over(within)).drop("_range", "_base")


def source_targets(sources: DataFrame, share: float, cap: float, weights: Sequence[float]) -> DataFrame:
    """``sources`` (source, source_size) with ``target``.

    Weights go round by code point of the source, null last. ``share`` of all words is dealt out by
    weight; no target exceeds ``cap`` times its source, and the excess is dealt again until none does.
    """
    ranked = running_sum(
        sources.withColumns({"_null": F.col("source").isNull().cast("int"), "_one": F.lit(1)}), ["_null", "source"], "_one", "_rank"
    )
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    ranked = materialise(ranked.select("source", "source_size", "_max", weight.alias("_w"), (F.col("source_size") * cap).alias("_cap")), "sources")
    budget = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:  # the level only rises, and each round but the last fills another source
        full = F.col("_cap") <= F.col("_w") * F.lit(level)
        filled, open_weight = ranked.agg(F.sum(F.when(full, F.col("_cap"))), F.sum(F.when(~full, F.col("_w")))).first()
        if not open_weight:
            break
        new = (budget - (filled or 0.0)) / open_weight
        if new <= level:
            break
        level = new
    target = F.least(F.col("_cap"), F.col("_w") * F.lit(level))
    return ranked.select("source", "source_size", "_max", target.alias("target"))


def tilts(sizes: DataFrame, targets: DataFrame, cap: float, tolerance: float = 1e-9, rounds: int = 200) -> DataFrame:
    """``targets`` with ``tilt``, the dual variable of each source; null where the cap holds for all its documents.

    ``sizes`` is a histogram (source, size, n). Each round joins it with the tilts and sums the words
    and their derivative per source: one shuffle of partial sums.
    """
    dual = targets.select(
        "source", "source_size", "_max", "target", F.lit(0.0).alias("tilt"), F.lit(None).cast("double").alias("_low"), F.lit(None).cast("double").alias("_high"),
        (F.col("target") >= F.col("source_size") * cap * (1 - 1e-12)).alias("_full"), F.lit(1.0).alias("_off"),
    )
    kept = Rounds(sizes.sparkSession, "tilts")
    edge = F.log(F.lit(float(cap)))
    x = F.col("size") / F.col("_max")
    for _ in range(rounds):
        words = F.col("n") * F.col("size") * F.when(F.col("tilt") * x >= edge, F.lit(float(cap))).otherwise(F.exp(F.col("tilt") * x))
        slope = F.when(F.col("tilt") * x < edge, F.col("n") * F.col("size") * x * F.exp(F.col("tilt") * x)).otherwise(0.0)
        sums = (
            sizes.alias("h").join(dual.filter(~F.col("_full")).alias("d"), F.col("h.source").eqNullSafe(F.col("d.source")))
            .groupBy("d.source").agg(F.sum(words).alias("_f"), F.sum(slope).alias("_slope"))
        )
        gap = F.col("_f") - F.col("target")
        low = F.when(gap < 0, F.col("tilt")).otherwise(F.col("_low"))
        high = F.when(gap >= 0, F.col("tilt")).otherwise(F.col("_high"))
        newton = F.col("_newton")
        middle = (
            F.when(F.col("_low").isNull(), F.least(F.col("_high") * 2, F.lit(-1.0)))
            .when(F.col("_high").isNull(), F.greatest(F.col("_low") * 2, F.lit(1.0)))
            .otherwise((F.col("_low") + F.col("_high")) / 2)
        )
        inside = (F.col("_slope") > 0) & (F.coalesce(newton > F.col("_low"), F.lit(True))) & F.coalesce(newton < F.col("_high"), F.lit(True)) & (F.abs(newton - F.col("tilt")) < 50)
        stepped = (
            dual.alias("d").join(sums.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")), "left")
            .select("d.source", "source_size", "_max", "target", "tilt", low.alias("_low"), high.alias("_high"), "_full", (F.abs(gap) / F.col("target")).alias("_off"), (F.col("tilt") - gap / F.col("_slope")).alias("_newton"), "_slope")
        )
        near = F.col("_off") <= tolerance
        dual = kept.keep(
            stepped.select(
                "source", "source_size", "_max", "target",
                F.when(F.col("_off").isNull() | near, F.col("tilt")).when(inside, newton).otherwise(middle).alias("tilt"),
                "_low", "_high", "_full", F.col("_off"),
            )
        )
        worst = dual.agg(F.max("_off")).first()[0]
        if worst is None or worst <= tolerance:
            break
    else:
        raise ArithmeticError(f"no tilt within {tolerance} of its target after {rounds} rounds; off by {worst}")
    return dual.select("source", "source_size", "_max", "target", F.when(~F.col("_full"), F.round("tilt", 9)).alias("tilt"))


def rounded_copies(rated: DataFrame, order: Sequence[str], rate: str = "rate") -> DataFrame:
    """``rated`` with whole ``copies``: each rate's floor or ceiling, and about the right sum along any stretch of the order."""
    units = rated.withColumn("_units", F.round(F.col(rate) * _UNIT).cast("long"))
    summed = running_sum(units, order, "_units", "_upto")
    at = lambda c: F.floor((c + _UNIT // 2) / F.lit(_UNIT))
    return summed.withColumn("copies", (at(F.col("_upto")) - at(F.col("_upto") - F.col("_units"))).cast("long")).drop("_units", "_upto")


def mix_sources(docs: DataFrame, share: float = 1.5, cap: float = 2.0, weights: Sequence[float] = (5, 2, 1), id_column: str = "doc_id") -> DataFrame:
    """(id, source, size, source_size, target, rate, copies) for ``docs`` with columns id, source and size."""
    order_hash = F.xxhash64(F.col(id_column).cast("string"), F.lit(4))
    sized = materialise(docs.select(F.col(id_column).alias("id"), "source", F.col("size").cast("long").alias("size"), order_hash.alias("_hash")), "sized")
    histogram = materialise(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "histogram")
    sources = histogram.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.greatest(F.max("size"), F.lit(1)).alias("_max"))
    dual = tilts(histogram.filter("size > 0"), source_targets(sources, share, cap, weights), cap)
    rate = F.when(F.col("tilt").isNull(), F.lit(float(cap))).otherwise(F.least(F.lit(float(cap)), F.exp(F.col("tilt") * F.col("size") / F.col("_max"))))
    rated = sized.alias("a").join(dual.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")), "left").select(
        "id", "a.source", "size", "source_size", "target", "_hash", rate.alias("rate")
    )
    out = rounded_copies(rated.withColumn("_null", F.col("source").isNull().cast("int")), ["_null", "source", "size", "_hash"])
    return out.select(F.col("id").alias(id_column), "source", "size", "source_size", "target", "rate", "copies")


def op4_mixing(documents: DataFrame) -> DataFrame:
    """Words each document gives to a mix of 150 % of all words, sources weighing 5, 2, 1 in turn, none above twice its size."""
    mixed = mix_sources(documents.select("doc_id", "source", word_count(F.col("text")).alias("size")))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "rate", "copies")
