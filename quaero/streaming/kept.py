"""Streams whose results are tables kept in a folder, by versions that are written once: running days, ordinals, changed files.

A version is written aside and renamed to its place, so a folder v=N is there as a whole or not at all (on a store whose rename isn't
atomic, give a file system that has one). A batch that Spark replays finds its version and changes nothing, or writes the same
again. No state is held in executors: a hot day or topic is summed by many tasks, and a late row counts on its own day,
however late. Checkpoint and folder belong together: with a new checkpoint take a new folder.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.activity import iso_week, ordinals
from ..sources import vault
from ..sources.store import sized, stored

#: Versions of counts that are summed into one base.
FAN = 16
CHANGES = "path string, action string, mtime timestamp, size long, hash string"


def _path(spark: SparkSession, name: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, folder: str) -> list[int]:
    """The numbers N of the folders v=N, in order."""
    path, fs = _path(spark, folder)
    if not fs.exists(path):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(path)]
    return sorted(int(n.removeprefix("v=")) for n in names if n.startswith("v="))


def put(rows: DataFrame, folder: str, version: int) -> None:
    """Write rows as a version that is seen as a whole; one that is there stays as it is."""
    spark = rows.sparkSession
    if version in versions(spark, folder):
        return
    aside = f"{folder}-aside/{uuid.uuid4().hex}"
    rows.write.parquet(aside)
    (source, fs), (parent, _), (target, _) = _path(spark, aside), _path(spark, folder), _path(spark, f"{folder}/v={version}")
    fs.mkdirs(parent)
    if not fs.rename(source, target):
        raise OSError(f"could not move {aside} to {folder}/v={version}")


class KeptCounts:
    """Counts by a key, as sums of what each batch counted.

    A batch adds a version of its own counts. Once FAN versions stand above the last base, they and it become the next base, so
    a read sums a base and fewer than FAN + 1 versions, whatever the number of batches.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, kind: str, fan: int = FAN):
        self.spark, self.folder, self.key, self.fan = spark, folder.rstrip("/"), key, fan
        self.schema = f"{key} {kind}, n_notes long"

    def upto(self) -> int:
        """The last batch in the base; -1 without one."""
        return max(versions(self.spark, f"{self.folder}/bases"), default=-1)

    def has(self, batch: int) -> bool:
        return batch <= self.upto() or batch in versions(self.spark, f"{self.folder}/parts")

    def counts(self, before: int | None = None) -> DataFrame:
        """key, n_notes of all batches, or of those before one that is not in the base yet."""
        base = self.upto()
        paths = [f"{self.folder}/bases/v={base}"] if base >= 0 else []
        paths += [f"{self.folder}/parts/v={v}" for v in versions(self.spark, f"{self.folder}/parts") if v > base and (before is None or v < before)]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths).groupBy(self.key).agg(F.sum("n_notes").alias("n_notes"))

    def add(self, rows: DataFrame, batch: int) -> None:
        if self.has(batch):
            return
        put(rows.groupBy(self.key).agg(F.count(F.lit(1)).alias("n_notes")), f"{self.folder}/parts", batch)
        if len([v for v in versions(self.spark, f"{self.folder}/parts") if v > self.upto()]) >= self.fan:
            put(self.counts(), f"{self.folder}/bases", batch)


class KeptActivity:
    """Notes per day and ISO week of a stream of notes (created, a text that starts with the day)."""

    def __init__(self, spark: SparkSession, folder: str, fan: int = FAN):
        self.kept = KeptCounts(spark, folder, "day", "string", fan)

    def add(self, notes: DataFrame, batch: int) -> None:
        self.kept.add(notes.select(F.substring("created", 1, 10).alias("day")), batch)

    def days(self) -> DataFrame:
        return self.kept.counts()

    def weeks(self) -> DataFrame:
        return self.days().groupBy(iso_week(F.col("day")).alias("week")).agg(F.sum("n_notes").alias("n_notes"))


class KeptOrdinals:
    """Each note of a stream with its ordinal in its topic by arrival; notes of a batch stand by (created_utc, id).

    An ordinal is the place in the batch, which ranges of the batch give (activity.ordinals), plus the topic's notes in the
    batches before. Notes without a topic form one. Ids may be of any type, topics of the given one.
    """

    def __init__(self, spark: SparkSession, folder: str, topic: str = "long", fan: int = FAN):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.kept = KeptCounts(spark, f"{self.folder}/counts", "topic_id", topic, fan)

    def add(self, notes: DataFrame, batch: int) -> None:
        if self.kept.has(batch):
            return
        rows = stored(notes.select("topic_id", "id", "created_utc"))
        placed = ordinals(rows, "topic_id", [F.col("created_utc").asc(), F.col("id").asc()], "place")
        before = self.kept.counts(batch).select(F.col("topic_id").alias("known"), "n_notes")
        met = placed.join(sized(before), F.col("topic_id").eqNullSafe(F.col("known")), "left")
        out = met.select("topic_id", "id", (F.col("place") + F.coalesce("n_notes", F.lit(0))).cast("long").alias("ask_index"))
        put(out, f"{self.folder}/asks", batch)
        self.kept.add(rows, batch)  # last: a batch that is counted has its rows

    def rows(self) -> DataFrame:
        """topic_id, id, ask_index of all notes so far."""
        return self.spark.read.parquet(*[f"{self.folder}/asks/v={v}" for v in versions(self.spark, f"{self.folder}/asks")])


def keep(stream: DataFrame, kept: KeptActivity | KeptOrdinals, checkpoint: str, **trigger):
    """The started query that adds each batch of the stream; without a trigger what is there now is taken and the query ends."""
    return stream.writeStream.foreachBatch(kept.add).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class FolderChanges:
    """The changes of a folder's files, found by listings, as a table and a stream.

    record() compares a listing with the manifest of the last one and adds a version of the changes: added, updated, removed,
    and touched (other time or size, same content). A change is in one version only. The manifest of a version follows from the one
    before and the changes, so a record that is broken off between the two is finished by the next. One recorder at a time.
    """

    def __init__(self, spark: SparkSession, root: str, folder: str):
        self.spark, self.root, self.folder = spark, root, folder.rstrip("/")

    def _changes(self, version: int) -> DataFrame:
        return self.spark.read.schema(CHANGES).parquet(f"{self.folder}/changes/v={version}")

    def manifest(self) -> DataFrame:
        """path, mtime, size, hash of the files as the last record saw them."""
        there = versions(self.spark, f"{self.folder}/manifests")
        if not there:
            return self.spark.createDataFrame([], CHANGES).drop("action")
        return self.spark.read.schema(CHANGES).parquet(f"{self.folder}/manifests/v={there[-1]}").drop("action")

    def _finish(self, version: int) -> None:
        changes = self._changes(version)
        kept = self.manifest().join(changes.select("path").hint("shuffle_merge"), "path", "left_anti")
        put(kept.unionByName(changes.where("action <> 'removed'").drop("action")), f"{self.folder}/manifests", version)

    def record(self) -> int | None:
        """The number of the version with what has changed since the last one; None if nothing has."""
        done = max(versions(self.spark, f"{self.folder}/manifests"), default=0)
        if max(versions(self.spark, f"{self.folder}/changes"), default=0) > done:
            self._finish(done + 1)
            done += 1
        known = self.manifest()
        listing = stored(vault.listed(self.spark, self.root))
        m = known.select("path", F.col("mtime").alias("m_mtime"), F.col("size").alias("m_size"))
        same = F.coalesce((F.col("mtime") == F.col("m_mtime")) & (F.col("size") == F.col("m_size")), F.lit(False))
        fresh = stored(listing.join(m.hint("shuffle_merge"), "path", "left").where(~same).select("path", "mtime"))
        # The reader leaves out the contents of files older than any that is new or changed.
        oldest = fresh.agg(F.min("mtime")).first()[0]
        read = listing.where("false").select("path", F.lit("").alias("hash"))
        if oldest is not None:
            contents = vault.listed(self.spark, self.root, content=True).where(F.col("mtime") >= F.lit(oldest))
            read = contents.join(sized(fresh.select("path")), "path", "left_semi").select("path", F.sha2("content", 256).alias("hash"))
        hashed = listing.join(stored(read).hint("shuffle_merge"), "path", "left")
        plan = vault.sync_plan(hashed, known).where("action <> 'unchanged'")
        changes = stored(plan.join(hashed.hint("shuffle_merge"), "path", "left").select("path", "action", "mtime", "size", "hash"))
        if changes.isEmpty():
            return None
        put(changes, f"{self.folder}/changes", done + 1)
        self._finish(done + 1)
        return done + 1

    def changes(self) -> DataFrame:
        """version, path, action, mtime, size, hash of all changes so far."""
        rows = self.spark.read.schema(f"{CHANGES}, v long").parquet(f"{self.folder}/changes")
        return rows.select(F.col("v").alias("version"), "path", "action", "mtime", "size", "hash")

    def stream(self) -> DataFrame:
        """The changes as a stream: each arrives once, and a restarted query goes on behind its last batch."""
        _, fs = _path(self.spark, self.folder)
        fs.mkdirs(_path(self.spark, f"{self.folder}/changes")[0])
        rows = self.spark.readStream.schema(f"{CHANGES}, v long").parquet(f"{self.folder}/changes")
        return rows.select(F.col("v").alias("version"), "path", "action", "mtime", "size", "hash")

    def watch(self, checkpoint: str, every: str = "10 seconds"):
        """The started query that records changes again and again."""
        ticks = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        return ticks.writeStream.foreachBatch(lambda _, __: self.record() and None).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
