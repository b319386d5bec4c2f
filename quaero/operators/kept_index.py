"""A search index kept up to date: segments of changed notes with tombstones, merged by size.

An update writes one segment: the changed notes, their trigrams, words and terms, and a tombstone for each deleted one. Only
they are read and indexed. A note counts in the latest segment that has it; what older segments hold of it is dead. Segments of
one level are merged into one of the next when FAN of them stand together, and dead postings go then, so there are about
FAN * log(updates) segments. Trigrams and terms lie in folders by their bucket, and a recall reads the buckets that its own terms
fall into. Words lie as their notes do, neither dealt nor sorted: a search by substrings reads all of them, as any may hold a piece.
An index can be told which kinds of postings to write (`kinds`); the others are made from a segment's notes when they are read.

Layout under the folder: notes/seg=, grams/seg=/bucket=, terms/seg=/bucket=, words/seg=, and state/v=, a list of the segments in order of age.
A state is written last, so an update that is broken off leaves the index as it was; one that is replayed (same or an
earlier number) changes nothing. One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import sized, stored
from . import search

FAN, BUCKETS = 4, 32
_STATE = "place int, seg string, level int, ids long, number long, kinds array<string>"
_POSTINGS = {"grams": "gram", "terms": "term", "words": "word"}
_MADE = {"grams": search.trigram_index, "terms": search.note_terms, "words": search.note_words}
_DEALT = ("grams", "terms")


class KeptIndex:
    """The index in a folder that the driver and all executors see."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS, fan: int = FAN, kinds: tuple[str, ...] = tuple(_POSTINGS)):
        self.spark, self.folder, self.buckets, self.fan, self.kinds = spark, folder.rstrip("/"), buckets, fan, kinds
        self._state: list[dict] | None = None

    # State

    def _version(self) -> int:
        """The newest state's number; 0 if there is none."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/state")
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return 0
        done = [s.getPath().getName() for s in fs.listStatus(path) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return max((int(n.removeprefix("v=")) for n in done), default=0)

    def segments(self) -> list[dict]:
        """The segments from the oldest on: seg, level, ids (rows), number (of the last update in it), kinds (of postings; null: all)."""
        if self._state is None:
            version = self._version()
            rows = self.spark.read.schema(_STATE).json(f"{self.folder}/state/v={version}").orderBy("place").collect() if version else []
            self._state = [r.asDict() for r in rows]
        return self._state

    def _keep(self, segments: list[dict]) -> None:
        rows = [(k, s["seg"], s["level"], s["ids"], s["number"], s["kinds"]) for k, s in enumerate(segments)]
        self.spark.createDataFrame(rows, _STATE).coalesce(1).write.mode("overwrite").json(f"{self.folder}/state/v={self._version() + 1}")
        self._state = segments

    # Writing

    def _write(self, notes: DataFrame, level: int, number: int, postings: dict[str, DataFrame] | None = None) -> dict:
        """A segment of these notes (with deleted); its postings are made of them if not given."""
        seg = uuid.uuid4().hex
        notes.write.parquet(f"{self.folder}/notes/seg={seg}")
        notes = self.spark.read.parquet(f"{self.folder}/notes/seg={seg}")
        alive = notes.where("NOT deleted")
        for kind in self.kinds:
            rows = postings[kind] if postings else _MADE[kind](alive)
            if kind in _DEALT:
                dealt = rows.withColumn("bucket", self._bucket(kind)).repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(8)))
                dealt.sortWithinPartitions("bucket", _POSTINGS[kind]).write.partitionBy("bucket").parquet(f"{self.folder}/{kind}/seg={seg}")
            else:
                rows.write.parquet(f"{self.folder}/{kind}/seg={seg}")
        return {"seg": seg, "level": level, "ids": notes.count(), "number": number, "kinds": list(self.kinds)}

    def _bucket(self, kind: str) -> Column:
        return F.pmod(F.xxhash64(_POSTINGS[kind]), F.lit(self.buckets)).cast("int")

    def update(self, changes: DataFrame, number: int) -> bool:
        """Index changed notes and drop deleted ones; False if update `number` has been applied before.

        changes: id (distinct), deleted, and for the others title, question, conclusion and whatever else notes have. Numbers grow.
        """
        segments = self.segments()
        if segments and max(s["number"] for s in segments) >= number:
            return False
        self._keep([*segments, self._write(changes, 0, number)])
        while (run := self._mergeable()) is not None:
            self._merge(*run)
        return True

    def _mergeable(self) -> tuple[int, int] | None:
        """The first FAN neighbours of one level."""
        levels = [s["level"] for s in self.segments()]
        for k in range(len(levels) - self.fan + 1):
            if len(set(levels[k : k + self.fan])) == 1:
                return k, k + self.fan
        return None

    def _merge(self, start: int, stop: int) -> None:
        """Segments start to stop become one of the next level; dead rows go, and tombstones too if nothing older is left."""
        segments = self.segments()
        some = segments[start:stop]
        notes = self._alive_rows(some)
        if start == 0:
            notes = notes.where("NOT deleted")
        one = self._write(notes.drop("seg"), some[0]["level"] + 1, some[-1]["number"], {kind: self._postings(kind, some).drop("seg") for kind in self.kinds})
        self._keep([*segments[:start], one, *segments[stop:]])

    # Reading

    def _rows(self, kind: str, segment: dict) -> DataFrame:
        """A segment's notes, or its postings, made of its notes if it does not keep them."""
        if kind == "notes" or segment["kinds"] is None or kind in segment["kinds"]:
            return self.spark.read.parquet(f"{self.folder}/{kind}/seg={segment['seg']}")
        made = _MADE[kind](self._rows("notes", segment).where("NOT deleted"))
        return made.withColumn("bucket", self._bucket(kind)) if kind in _DEALT else made

    def _read(self, kind: str, segments: list[dict]) -> DataFrame:
        parts = [self._rows(kind, s).withColumn("seg", F.lit(k)) for k, s in enumerate(segments)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p, allowMissingColumns=True)
        return out

    def _alive_rows(self, segments: list[dict]) -> DataFrame:
        """The rows of the notes, tombstones too, that no later segment has again."""
        rows = self._read("notes", segments)
        if len(segments) == 1:
            return rows
        last = rows.groupBy("id").agg(F.max("seg").alias("seg"))
        return rows.join(last.hint("shuffle_merge"), ["id", "seg"])

    def _dead(self, segments: list[dict]) -> DataFrame:
        """id, seg of what a later segment has again: as many rows as notes were changed since the last merges."""
        rows = self._read("notes", segments).select("id", "seg")
        last = rows.groupBy("id").agg(F.max("seg").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        return rows.join(last.hint("shuffle_merge"), "id").where("seg < last").select("id", "seg")

    def _postings(self, kind: str, segments: list[dict], keys: DataFrame | None = None) -> DataFrame:
        rows = self._read(kind, segments)
        if keys is not None:
            asked = keys.select(self._bucket(kind).alias("bucket")).distinct()
            rows = rows.where(F.col("bucket").isin([r.bucket for r in asked.collect()]))  # at most `buckets` numbers
        rows = rows.drop("bucket")
        if len(segments) == 1:
            return rows
        return rows.join(sized(self._dead(segments)), ["id", "seg"], "left_anti")

    def notes(self) -> DataFrame:
        """The notes as they are now."""
        return self._alive_rows(self.segments()).where("NOT deleted").drop("seg", "deleted")

    def grams(self, keys: DataFrame | None = None) -> DataFrame:
        """gram, id of the notes as they are now; of the buckets of keys (gram), if given."""
        return self._postings("grams", self.segments(), keys).select("gram", "id")

    def terms(self, keys: DataFrame | None = None) -> DataFrame:
        """term, id, weight likewise."""
        return self._postings("terms", self.segments(), keys).select("id", "term", "weight")

    def words(self) -> DataFrame:
        """word, id likewise: all of them, as any word may hold a piece."""
        return self._postings("words", self.segments()).select("word", "id")

    # Searching

    def bm25_search(self, queries: DataFrame, limit: int = 20) -> DataFrame:
        """As search.bm25_search over the notes as they are now."""
        return search.bm25_ranking(queries, stored(self.notes()), self.words(), limit)

    def keyword_recall(self, questions: DataFrame) -> DataFrame:
        """As search.keyword_recall over the notes as they are now."""
        asked = stored(questions.select(F.explode(search.terms(F.col("query"))).alias("term")).distinct())
        return search.keyword_recall(questions, stored(self.notes()), index=self.terms(asked))
