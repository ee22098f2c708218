"""Upkeep: registries, change feeds, library feeds and the streams that drive them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.text import non_empty
from ..operators.profiles import first_by, needs_extraction
from ..sources.files import detect_changed, detect_removed

__all__ = [
    "assign_paper_ids", "clear", "coalesce_changes", "coalesce_stream", "follow_files", "follow_library", "library_cursor", "library_delta_merge", "library_table", "pending_extraction", "process_changes", "rebuild", "skip_ingested_versions", "upsert_registry",
]


def assign_paper_ids(files: DataFrame, registry: DataFrame) -> DataFrame:
    """``files`` (workspace_id, source_path, content_hash, source_ref) with stable ids and whether they are new.

    An id, once given to a path, stays when the content changes. A new id is a digest of workspace, path and
    content, so that a task that runs twice gives the same one.
    """
    known = registry.select("workspace_id", "source_path", F.col("paper_id").alias("_id"), F.col("source_ref").alias("_ref"))
    new_id = F.concat(F.lit("p_"), F.substring(F.sha2(F.concat_ws("\x1f", "workspace_id", "source_path", "content_hash"), 256), 1, 32))
    return files.join(known, ["workspace_id", "source_path"], "left").select(
        "workspace_id", "source_path", "content_hash", F.coalesce("_id", new_id).alias("paper_id"), F.coalesce(non_empty(F.col("_ref")), F.col("source_ref")).alias("source_ref"), F.col("_id").isNull().alias("is_new")
    )


def upsert_registry(registry: DataFrame, new: DataFrame, now: Column | None = None) -> DataFrame:
    """Merge identity fields by (workspace_id, source_path): values that aren't empty overwrite, assigned_at stays, updated_at is ``now``."""
    now = F.current_timestamp() if now is None else now
    fields = ("paper_id", "content_hash", "source_ref", "zotero_key", "doi")
    n = new.select("workspace_id", "source_path", *[F.col(c).alias(f"_{c}") for c in fields], F.lit(True).alias("_new"))
    out = registry.join(n, ["workspace_id", "source_path"], "full_outer")
    merged = out.withColumns({c: F.coalesce(non_empty(F.col(f"_{c}")), F.col(c), F.col(f"_{c}")) for c in fields})
    stamped = merged.withColumns({"assigned_at": F.coalesce("assigned_at", now), "updated_at": F.when(F.col("_new"), now).otherwise(F.col("updated_at"))})
    return stamped.select("workspace_id", "source_path", *fields, "assigned_at", "updated_at")


def coalesce_changes(changes: DataFrame) -> DataFrame:
    """(path, op) of a batch of (path, op): a deletion beats changes of the same path."""
    return changes.groupBy("path").agg(F.when(F.bool_or(F.col("op") == "deleted"), "deleted").otherwise("changed").alias("op"))


class _Quiet(StatefulProcessor):
    """State of one path: what its last burst comes to, and when it may be told."""

    def __init__(self, quiet_ms: int) -> None:
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.burst = handle.getValueState("burst", "deleted boolean, until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        deleted, last = False, 0
        for batch in rows:
            deleted = deleted or bool((batch["op"] == "deleted").any())
            last = max(last, int(batch["at"].max().timestamp() * 1000))
        if self.burst.exists():
            was = self.burst.get()
            self.handle.deleteTimer(was[1])
            deleted, last = deleted or was[0], max(last, was[1] - self.quiet_ms)
        until = max(last + self.quiet_ms, timerValues.getCurrentWatermarkInMs() + 1)
        self.burst.update((deleted, until))
        self.handle.registerTimer(until)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        deleted, until = self.burst.get()
        self.burst.clear()
        yield pd.DataFrame({"path": [key[0]], "op": ["deleted" if deleted else "changed"], "at": [pd.Timestamp(until - self.quiet_ms, unit="ms")]})

    def close(self) -> None:
        pass


def coalesce_stream(changes: DataFrame, quiet: float = 0.5, late: str = "0 seconds") -> DataFrame:
    """(path, op, at) of a stream of (path, op, at): a path's burst of changes is told once, when none has come for ``quiet`` seconds of event time.

    A deletion beats the changes of its burst; ``at`` is the burst's last change. Each path has one small state, which goes when its burst is
    told; timers follow the watermark, ``late`` behind the newest change. A row that comes behind the watermark is left out by Spark.
    """
    marked = changes.select("path", "op", "at").withWatermark("at", late)
    return marked.groupBy("path").transformWithStateInPandas(_Quiet(int(quiet * 1000)), "path string, op string, at timestamp", "Append", "EventTime")


def library_delta_merge(stored: DataFrame, delta: DataFrame, full: bool = False) -> DataFrame:
    """Entries by bib_key, the newest version wins; a full sync replaces all."""
    rows = delta if full else stored.unionByName(delta, allowMissingColumns=True)
    return first_by(rows, ["bib_key"], F.col("zotero_version").desc_nulls_last(), F.xxhash64("title", "doi", "url"))


def library_cursor(entries: DataFrame) -> DataFrame:
    """One row: the version to ask from next."""
    return entries.agg(F.coalesce(F.max("zotero_version"), F.lit(0)).alias("cursor"))


def skip_ingested_versions(items: DataFrame, ingested: DataFrame) -> DataFrame:
    """Items whose (zotero_key, zotero_version) was not ingested yet."""
    return items.join(ingested.select("zotero_key", "zotero_version"), ["zotero_key", "zotero_version"], "left_anti")


def pending_extraction(papers: DataFrame) -> DataFrame:
    """Ids to extract; see ``needs_extraction``."""
    return needs_extraction(papers).filter("pending").select("paper_id").distinct().orderBy("paper_id")


def process_changes(now: DataFrame, before: DataFrame) -> DataFrame:
    """(path, op) that lead from one snapshot to the next: deletions, then files whose content differs."""
    return detect_removed(now, before).select("path", F.lit("deleted").alias("op")).union(detect_changed(now, before).select("path", F.lit("changed").alias("op")))


def rebuild(df: DataFrame, path: str) -> None:
    """Replace a derived table; ``df`` must not read it."""
    df.write.mode("overwrite").parquet(path)


def clear(spark: SparkSession, *paths: str) -> None:
    """Empty derived tables, their schemas stay."""
    for path in paths:
        spark.createDataFrame([], spark.read.parquet(path).schema).write.mode("overwrite").parquet(path)


def follow_files(spark: SparkSession, root: str, checkpoint: str, handle: Callable[[DataFrame, int], None], suffix: str = "*.md") -> StreamingQuery:
    """Hand each micro-batch of new files (path, sha256, size, modified_at, content) to ``handle``, once a file.

    The file source never reports deletions; ``process_changes`` on listings finds them.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", suffix).load(root)
    rows = files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size"), F.col("modificationTime").alias("modified_at"), "content")
    return rows.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow_library(feed: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Keep the rows of a stream of library entries in ``table``, a folder ``v=<batch>`` a micro-batch; ``library_table`` reads their newest versions.

    A batch writes its own rows alone, so its cost is its size, and one that runs twice writes the same.
    """

    def keep(batch: DataFrame, number: int) -> None:
        library_delta_merge(batch.limit(0), batch).write.mode("overwrite").parquet(f"{table}/v={number}")

    return feed.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def library_table(spark: SparkSession, table: str) -> DataFrame:
    """The entries that ``follow_library`` has kept, each at its newest version."""
    rows = spark.read.option("basePath", table).parquet(table).drop("v")
    return library_delta_merge(rows.limit(0), rows)
