"""Hard-negative mining by coordinate pruning in length buckets (operator 13).

Vectors are sorted by label and length and cut into buckets; a bucket keeps, for each coordinate, the list of its unit
vectors sorted by that coordinate. Anchors come in blocks of a bounded size, and every task keeps the best of the buckets
that it has seen. A score t of interest asks a vector of the bucket for a cosine of at least c = t / (anchor length *
longest of the bucket). Over 1 the bucket is passed over. Else each of the anchor's focus coordinates, its largest ones, bounds
the same coordinate of the vector: for angles a = acos(anchor's coordinate) and b = acos(c) it lies between cos(a + b) and
cos(a - b). Those ranges are looked up in the sorted lists, the candidates of the shortest one are sifted by the others, and the
rest is scored exactly. Where no range is short, the whole bucket is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import shared_dir, written

#: Fixed values of the contract: scale of a component, positives of an anchor, negatives of a positive, and the least
#: and largest share (in hundredths) of the positive's score.
SCALE, POSITIVES, NEGATIVES, LEAST, MOST = 256, 5, 3, 50, 95
#: Components of this size and more have scores that a long may not hold.
HUGE = 1 << 20
#: Rows of a bucket, bytes of a block of anchors (broadcast), anchors scored together, focus coordinates, and the largest share
#: of a bucket whose candidates are looked at one by one.
BUCKET, BLOCK_BYTES, SLICE, FOCUS, SHORT = 1024, 8 << 20, 256, 5, 0.06
_SLACK = 1e-9
_NONE = np.iinfo(np.int64).min


def usable(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """row_key, id, label, parts (long components) and length of the rows that take part. rows: id, label and the vector."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * SCALE < HUGE))
    parts = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE))
    length = F.sqrt(F.aggregate("parts", F.lit(0.0), lambda a, x: a + x * x))
    good = rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col(vector).isNotNull()).where(fine)
    return good.select(F.monotonically_increasing_id().alias("row_key"), F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), parts.alias("parts")).withColumn("length", length)


def _matrix(parts: pa.Array, dimension: int) -> np.ndarray:
    """The components, missing ones as 0."""
    sizes = np.diff(parts.offsets.to_numpy())
    flat = parts.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(parts), dimension), np.int64)
    out[np.arange(dimension) < sizes[:, None]] = flat
    return out


class Vectors:
    """Rows of vectors: keys, ids, labels, lengths and integer components."""

    def __init__(self, batch: pa.RecordBatch | pa.Table, dimension: int):
        self.keys, self.ids, self.labels, self.lengths = (batch.column(n).to_numpy() for n in ("row_key", "id", "label", "length"))
        parts = batch.column("parts")
        self.parts = _matrix(parts.combine_chunks() if isinstance(parts, pa.ChunkedArray) else parts, dimension)
        self.units = self.parts / np.maximum(self.lengths, 1e-12)[:, None]
        self.longest = float(self.lengths.max(initial=0.0))

    def __len__(self) -> int:
        return len(self.ids)


class Bucket(Vectors):
    """A bucket with its sorted coordinate lists."""

    def __init__(self, batch: pa.RecordBatch, dimension: int):
        super().__init__(batch, dimension)
        self.order = np.argsort(self.units, axis=0)
        self.sorted = np.take_along_axis(self.units, self.order, 0)

    def scores(self, parts: np.ndarray, longest: float, rows=slice(None)) -> np.ndarray:
        """Exact inner products: in doubles where every one of them fits, else in longs."""
        own = self.parts[rows]
        if longest * self.longest < 2.0**52:
            return np.rint(parts.astype(np.float64) @ own.T.astype(np.float64)).astype(np.int64)
        return parts @ own.T

    def search(self, anchors: Vectors, focus: np.ndarray, some: np.ndarray, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """anchor, row and score of pairs, among them all of the given anchors that reach their least score (_NONE: all)."""
        bound = least[some] / np.maximum(anchors.lengths[some] * self.longest, 1e-12)
        alive = bound <= 1 + _SLACK  # else no vector of the bucket is long enough
        some, bound = some[alive], bound[alive]
        if not len(some):
            return
        bounded = bound > 0
        own, least_cosine = some[bounded], np.minimum(bound[bounded], 1.0)
        shortest = np.full(len(own), len(self) + 1)
        if len(own):
            coordinates = focus[own]
            a = np.arccos(np.clip(np.take_along_axis(anchors.units[own], coordinates, 1), -1, 1))
            b = np.arccos(least_cosine)[:, None]
            low, high = np.cos(np.minimum(a + b, np.pi)) - _SLACK, np.cos(np.maximum(a - b, 0)) + _SLACK
            start, stop = np.zeros(low.shape, np.int64), np.zeros(low.shape, np.int64)
            for f in np.unique(coordinates).tolist():
                at = coordinates == f
                start[at] = np.searchsorted(self.sorted[:, f], low[at], "left")
                stop[at] = np.searchsorted(self.sorted[:, f], high[at], "right")
            pick = np.argmin(stop - start, axis=1)
            shortest = (stop - start)[np.arange(len(own)), pick]
            for i in np.flatnonzero((shortest > 0) & (shortest <= len(self) * SHORT)).tolist():
                k = pick[i]
                rows = self.order[start[i, k] : stop[i, k], coordinates[i, k]]
                values = self.units[rows[:, None], coordinates[i]]
                rows = rows[((values >= low[i]) & (values <= high[i])).all(1)]
                if len(rows):
                    yield np.full(len(rows), own[i]), rows, self.scores(anchors.parts[own[i] : own[i] + 1], anchors.longest, rows)[0]
        whole = np.concatenate([some[~bounded], own[shortest > len(self) * SHORT]])
        for at in range(0, len(whole), SLICE):
            part = whole[at : at + SLICE]
            scores = self.scores(anchors.parts[part], anchors.longest)
            a, rows = np.nonzero(scores >= least[part][:, None])
            yield part[a], rows, scores[a, rows]


class Best:
    """The first k of each owner's (score, id), by score from above, then by id."""

    def __init__(self, owners: int, k: int):
        self.k = k
        self.scores = np.full((owners, k), _NONE)
        self.ids = np.full((owners, k), np.iinfo(np.int64).max)

    def add(self, owner: np.ndarray, score: np.ndarray, key: np.ndarray) -> None:
        last, last_id = self.scores[owner, -1], self.ids[owner, -1]
        better = (score > last) | ((score == last) & (key < last_id))
        owner, score, key = owner[better], score[better], key[better]
        if not len(owner):
            return
        touched = np.unique(owner)
        owner = np.concatenate([owner, np.repeat(touched, self.k)])
        score = np.concatenate([score, self.scores[touched].ravel()])
        key = np.concatenate([key, self.ids[touched].ravel()])
        order = np.lexsort((key, -score.astype(np.float64) if np.abs(score[score != _NONE]).max(initial=0) < 2**53 else ~score, owner))
        owner, score, key = owner[order], score[order], key[order]
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        place = np.arange(len(owner)) - np.repeat(first, np.diff(np.append(first, len(owner))))
        keep = place < self.k
        self.scores[owner[keep], place[keep]] = score[keep]
        self.ids[owner[keep], place[keep]] = key[keep]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """owner, score, id of what has been found."""
        owner, place = np.nonzero(self.scores != _NONE)
        return owner, self.scores[owner, place], self.ids[owner, place]


_ROW = "row_key long, id long, label long, parts array<long>, length double"


def _buckets(rows: DataFrame) -> DataFrame:
    """The rows sorted by label and from the longest on, in partitions; a row of arrays per bucket."""
    dealt = rows.repartitionByRange("label", F.desc("length"), "id").sortWithinPartitions("label", F.desc("length"), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            while held.num_rows >= BUCKET:
                yield closed(held.slice(0, BUCKET))
                held = held.slice(BUCKET).combine_chunks()
        if held is not None and held.num_rows:
            yield closed(held)

    def closed(table: pa.Table) -> pa.RecordBatch:
        columns = [table.column(n).combine_chunks() for n in ("row_key", "id", "label", "parts", "length")]
        edges = pa.array([0, table.num_rows], pa.int32())
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(edges, c) for c in columns], ["row_key", "id", "label", "parts", "length"])

    return dealt.select("row_key", "id", "label", "parts", "length").mapInArrow(run, "row_key array<long>, id array<long>, label array<long>, parts array<array<long>>, length array<double>")


def _each_bucket(batches: Iterator[pa.RecordBatch], dimension: int) -> Iterator[Bucket]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1)
            yield Bucket(pa.RecordBatch.from_arrays([c.flatten() for c in row.columns], row.schema.names), dimension)


def _focus(anchors: Vectors) -> np.ndarray:
    """The coordinates of each anchor that are largest by absolute value."""
    return np.argsort(-np.abs(anchors.units), axis=1)[:, :FOCUS]


def _positives(buckets: DataFrame, shared, dimension: int) -> DataFrame:
    """owner (place of an anchor), score, id: per task the best other rows of the anchor's label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = shared.value[0]
        focus, best = _focus(anchors), Best(len(anchors), POSITIVES)
        for bucket in _each_bucket(batches, dimension):
            some = np.flatnonzero(np.isin(anchors.labels, np.unique(bucket.labels)))
            for a, rows, scores in bucket.search(anchors, focus, some, best.scores[:, -1]):
                mine = (bucket.labels[rows] == anchors.labels[a]) & (bucket.keys[rows] != anchors.keys[a])
                best.add(a[mine], scores[mine], bucket.ids[rows[mine]])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in best.rows()], ["owner", "score", "id"])

    return buckets.mapInArrow(run, "owner long, score long, id long")


def _negatives(buckets: DataFrame, shared, dimension: int) -> DataFrame:
    """owner (place of an anchor and positive), score, id: per task the best rows of other labels in the positive's range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, scores = shared.value  # scores: of the positives, _NONE where there are fewer
        there = (scores != _NONE) & (scores >= 0)
        low = np.where(there, -((-LEAST * np.where(there, scores, 0)) // 100), np.iinfo(np.int64).max)
        high = np.where(there, MOST * np.where(there, scores, 0) // 100, _NONE)
        focus, best = _focus(anchors), Best(scores.size, NEGATIVES)
        asked = there.any(1)
        for bucket in _each_bucket(batches, dimension):
            only = bucket.labels[0] if bucket.labels[0] == bucket.labels[-1] else None
            some = np.flatnonzero(asked & (anchors.labels != only) if only is not None else asked)
            least = np.maximum(low, best.scores[:, -1].reshape(scores.shape)).min(1)
            for a, rows, found in bucket.search(anchors, focus, some, least):
                other = bucket.labels[rows] != anchors.labels[a]
                a, rows, found = a[other], rows[other], found[other]
                for k in range(scores.shape[1]):
                    fits = (found >= low[a, k]) & (found <= high[a, k])
                    best.add(a[fits] * scores.shape[1] + k, found[fits], bucket.ids[rows[fits]])
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in best.rows()], ["owner", "score", "id"])

    return buckets.mapInArrow(run, "owner long, score long, id long")


def _first(found: DataFrame, k: int) -> DataFrame:
    """The first k of each owner, of the k at most that each task gave, with their rank."""
    w = Window.partitionBy("owner").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, id_col: str = "id", label: str = "label", vector: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Scores are inner products of the components, each floor(256 * x). An anchor (is_anchor, over the id column "id") has as
    positives its first 5 other rows of the same label, by score from above, then by id; and each of these the first 3 rows of other labels
    whose score is 50 to 95 hundredths of its own. Rows with a null id, label or vector, or a component that is null, not finite
    or 4,096 and more (whose scores a long may not hold) take no part. Missing components of shorter vectors are 0. Equal rows are rows of their
    own, and so are anchors with equal ids. An empty table gives no rows; extra columns, whatever their names, are ignored.
    """
    spark = rows.sparkSession
    ready = written(usable(rows.select(F.col(id_col).alias("id"), F.col(label).alias("label"), F.col(vector).alias("embedding"))), "vectors")
    asked = ready.where(is_anchor)
    size = ready.agg(F.max(F.size("parts")).alias("d"), F.count_if(is_anchor).alias("n")).first()
    dimension, n_blocks = max(1, size.d or 0), -(-size.n * max(1, size.d or 0) * 8 // BLOCK_BYTES)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not size.n:
        return spark.createDataFrame([], schema)
    buckets = written(_buckets(ready), "buckets")
    out = f"{shared_dir(spark)}/hard_negatives"
    for block in range(n_blocks):
        mine = asked.where(F.pmod(F.xxhash64("row_key"), F.lit(n_blocks)) == block)
        anchors = Vectors(mine.select("row_key", "id", "label", "parts", "length").toArrow(), dimension)
        if not len(anchors):
            continue
        shared = spark.sparkContext.broadcast((anchors,))
        found = _first(_positives(buckets, shared, dimension), POSITIVES).toArrow()
        scores, ids = np.full((len(anchors), POSITIVES), _NONE), np.zeros((len(anchors), POSITIVES), np.int64)
        owner, rank = found.column("owner").to_numpy(), found.column("rank").to_numpy() - 1
        scores[owner, rank], ids[owner, rank] = found.column("score").to_numpy(), found.column("id").to_numpy()
        both = spark.sparkContext.broadcast((anchors, scores))
        pairs = spark.sparkContext.broadcast((anchors.ids, ids, scores))

        def named(batches: Iterator[pa.RecordBatch], pairs=pairs) -> Iterator[pa.RecordBatch]:
            anchor_ids, positive_ids, positive_scores = pairs.value
            for batch in batches:
                owner = batch.column(0).to_numpy()
                columns = [anchor_ids[owner // POSITIVES], positive_ids.ravel()[owner], batch.column(1).to_numpy(), batch.column(3).to_numpy(), positive_scores.ravel()[owner], batch.column(2).to_numpy()]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [c.split()[0] for c in schema.split(", ")])

        best = _first(_negatives(buckets, both, dimension), NEGATIVES).select("owner", "rank", "score", "id")
        best.mapInArrow(named, schema).write.mode("append").parquet(out)
        for x in (shared, both, pairs):
            x.unpersist()
    return spark.read.schema(schema).parquet(out)
