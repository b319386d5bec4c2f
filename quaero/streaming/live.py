"""Streaming forms: running ask counts, running activity, redaction on the way in, and a watched folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.redaction import redacted
from ..sources import vault


def running_ask_counts(notes: DataFrame) -> DataFrame:
    """Each arriving note with its ordinal in its topic, by arrival; state is one count per topic.

    notes: topic_id, id, created_utc (a timestamp). Rows of one batch are numbered by (created_utc, id).
    """

    def number(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        before = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values(["created_utc", "id"], kind="stable")
        state.update((before + len(rows),))
        yield pd.DataFrame({"topic_id": key[0], "id": rows["id"], "ask_index": range(before + 1, before + 1 + len(rows))})

    kind = dict(notes.dtypes)
    return (
        notes.select("topic_id", "id", "created_utc")
        .groupBy("topic_id")
        .applyInPandasWithState(number, f"topic_id {kind['topic_id']}, id {kind['id']}, ask_index long", "n long", "append", "NoTimeout")
    )


def running_activity(notes: DataFrame, late: str = "14 days") -> DataFrame:
    """Notes per Monday-first week. Epoch is a Thursday, hence the offset; rows later than `late` are left to batch runs."""
    week = F.window("created_utc", "7 days", startTime="4 days")
    return notes.withWatermark("created_utc", late).groupBy(week.alias("w")).agg(F.count(F.lit(1)).alias("n_notes")).select(F.date_format("w.start", "yyyy-MM-dd").alias("monday"), "n_notes")


def redacted_stream(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The same redaction as in batch; it keeps no state."""
    return rows.withColumns({c: redacted(F.col(c)) for c in columns})


def watched(spark: SparkSession, root: str) -> DataFrame:
    """A stream that wakes for new files. It doesn't see changes and deletions of known paths: sync() lists for those."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).load(root).select("path")


def sync(spark: SparkSession, root: str, manifest: DataFrame, rows: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Parsed rows after a sync of the folder with a manifest, and the plan. Contents are read for candidates only.

    With an empty manifest it is a full rebuild, and the result is the same.
    """
    listing = vault.listed(spark, root).where(vault.file_kind(F.col("path")).isNotNull())
    known = manifest.select("path", F.col("mtime").alias("m_mtime"), F.col("size").alias("m_size"))
    candidates = listing.join(known, "path", "left").where(~F.coalesce((F.col("mtime") == F.col("m_mtime")) & (F.col("size") == F.col("m_size")), F.lit(False))).select("path")
    read = vault.listed(spark, root, content=True).join(candidates, "path", "left_semi")
    hashed = listing.join(read.select("path", F.sha2("content", 256).alias("hash")), "path", "left")
    plan = vault.sync_plan(hashed, manifest)
    fresh = vault.parsed(read.join(plan.where("action IN ('added', 'updated')").select("path"), "path", "left_semi").drop("content_hash"))
    if rows is None:
        return fresh, plan
    kept = rows.join(plan.where("action IN ('unchanged', 'touched')").select("path"), "path", "left_semi")
    return kept.unionByName(fresh), plan


def sync_on_change(spark: SparkSession, root: str, on_sync: Callable[[int], None], checkpoint: str):
    """A query that calls on_sync(batch) once per batch of new files; on_sync must be idempotent, as batches may replay."""

    def step(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            on_sync(number)

    return watched(spark, root).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
