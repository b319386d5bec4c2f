"""An index of vectors: inverted lists around trained centres, each cut into rings by the angle to its centre.

Centres are fitted on a bounded sample (SAMPLE rows, dealt by a hash of the id); every row is in the index. A search looks into
the lists nearest to a query, as many as gave TARGET of the sample's true neighbours. The exact search goes on: by the
triangle inequality of angles no row of a ring can be nearer to the query than the ring's angles allow, so just those further rings
are read that could still hold one of the k best. Both ways score rows exactly.

Layout under the folder: centres/ (list, centre, probes), rows/list= (ring, id, embedding) and cells/ (list, ring, n, lo, hi).
Lists and rings are bounded in number, so what the driver and the tasks hold of centres and cells doesn't grow with the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import shared_folder, stored
from .vectors import BEST, BLOCK, best_of_blocks, k_best, unit_rows

#: Rows that centres are fitted on (about; at most twice as many), their greatest number, and rounds of the fit.
SAMPLE, LISTS, ROUNDS = 20_000, 1024, 10
#: Rings of a half turn.
RINGS = 64
#: Share of the sample's nearest neighbours that the probed lists must hold, of how many neighbours, for how many sample rows.
TARGET, NEAREST, TRIED = 0.95, 10, 500
#: Similarities are rounded to six places; a bound gives way by as much.
SLACK = 2e-6
#: Products of queries and cells that a task holds at a time.
HELD = 1 << 21


def _fitted(sample: np.ndarray, lists: int) -> np.ndarray:
    """Centres of unit length: spherical k-means from spread rows of the sample; an empty list keeps its centre."""
    centres = sample[np.linspace(0, len(sample) - 1, lists).astype(int)].copy()
    for _ in range(ROUNDS):
        near = np.concatenate([(part @ centres.T).argmax(1) for part in np.array_split(sample, max(1, len(sample) // 2048))])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-12), centres)
    return centres


def _probes(sample: np.ndarray, centres: np.ndarray) -> int:
    """The least number of nearest lists that hold TARGET of the NEAREST neighbours of TRIED sample rows."""
    tried = sample[np.linspace(0, len(sample) - 1, min(TRIED, len(sample))).astype(int)]
    same = tried @ sample.T
    near = np.argsort(-same, axis=1, kind="stable")[:, 1 : NEAREST + 1]  # the first is the row itself
    if not near.size:
        return 1
    home = np.concatenate([(part @ centres.T).argmax(1) for part in np.array_split(sample, max(1, len(sample) // 2048))])
    place = np.argsort(np.argsort(-(tried @ centres.T), axis=1), axis=1)  # place of each list for each tried row
    at = np.sort(np.take_along_axis(place, home[near], axis=1).ravel())
    return int(at[min(len(at) - 1, int(np.ceil(TARGET * len(at))) - 1)]) + 1


def usable(rows: DataFrame) -> DataFrame:
    """Rows with a vector without null parts."""
    return rows.where("embedding IS NOT NULL AND NOT exists(embedding, x -> x IS NULL)")


class VectorIndex:
    """The index in a folder that the driver and all executors see."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        rows = spark.read.parquet(f"{self.folder}/centres").orderBy("list").collect()  # at most LISTS
        self.centres = np.array([r.centre for r in rows], np.float64)
        self.probes = rows[0].probes if rows else 1

    @classmethod
    def build(cls, vectors: DataFrame, folder: str | None = None, lists: int | None = None) -> VectorIndex:
        """Fit the centres and write the index of vectors (id, embedding); rows without a whole vector are left out."""
        spark, folder = vectors.sparkSession, (folder or shared_folder(vectors.sparkSession)).rstrip("/")
        rows = usable(vectors).select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
        n = rows.count()
        share = min(1.0, SAMPLE / max(1, n))
        some = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < int(np.ceil(share * (1 << 20)))).limit(2 * SAMPLE).toPandas()
        lists = lists or int(min(LISTS, max(1, n**0.5)))
        if len(some):
            sample = unit_rows(some.sort_values("id")["embedding"])
            centres = _fitted(sample, min(lists, len(sample)))
            probes = _probes(sample, centres)
        else:
            centres, probes = np.zeros((0, 0)), 1
        kept = [(k, [float(x) for x in c], probes) for k, c in enumerate(centres)]
        spark.createDataFrame(kept, "list int, centre array<double>, probes int").coalesce(1).write.parquet(f"{folder}/centres")

        def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                if not len(pdf):
                    continue
                same = unit_rows(pdf["embedding"]) @ centres.T
                best = same.argmax(1)
                angle = np.arccos(np.clip(same[np.arange(len(best)), best], -1, 1))
                yield pd.DataFrame({"list": best, "ring": np.minimum((angle / np.pi * RINGS).astype(int), RINGS - 1), "angle": angle, "id": pdf["id"], "embedding": pdf["embedding"]})

        found = rows.mapInPandas(placed, "list int, ring int, angle double, id long, embedding array<double>")
        # Ranges go on into the ids, so a list with most of the rows is written by many tasks.
        found.repartitionByRange("list", "ring", "id").write.partitionBy("list").parquet(f"{folder}/rows")
        if kept:
            cells = cls._rows(spark, folder).groupBy("list", "ring").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("lo"), F.max("angle").alias("hi"))
            cells.coalesce(1).write.parquet(f"{folder}/cells")
        return cls(spark, folder)

    @staticmethod
    def _rows(spark: SparkSession, folder: str) -> DataFrame:
        return spark.read.schema("ring int, angle double, id long, embedding array<double>, list int").parquet(f"{folder}/rows")

    def _wanted(self, queries: DataFrame, further: bool, floor: float) -> DataFrame:
        """query_id, list, ring to look into: of the probed lists, or with `further` of the others, where rows as similar as
        the query's column `least` (or the floor) may be."""
        centres, probes = self.centres, min(self.probes, len(self.centres))
        cells = self.spark.read.parquet(f"{self.folder}/cells").orderBy("list", "ring").toPandas()  # at most LISTS * RINGS
        of, ring, lo, hi = (cells[c].to_numpy() for c in ("list", "ring", "lo", "hi"))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                step = max(1, HELD // max(1, len(of)))
                for a in range(0, len(pdf), step):
                    part = pdf.iloc[a : a + step]
                    same = unit_rows(part["embedding"]) @ centres.T
                    near = np.zeros(same.shape, bool)
                    np.put_along_axis(near, np.argsort(-same, axis=1, kind="stable")[:, :probes], True, axis=1)
                    angle = np.arccos(np.clip(same, -1, 1))[:, of]
                    most = np.cos(np.maximum(0.0, np.maximum(angle - hi, lo - angle)))
                    may = (near[:, of] != further) & (most >= part["least"].to_numpy()[:, None] - SLACK)
                    q, c = np.nonzero(may)
                    yield pd.DataFrame({"query_id": part["query_id"].to_numpy()[q], "list": of[c], "ring": ring[c]})

        asked = queries if "least" in queries.columns else queries.withColumn("least", F.lit(float(floor)))
        return stored(asked.select("query_id", "embedding", "least").mapInPandas(run, "query_id long, list int, ring int"))

    def _scored(self, wanted: DataFrame, queries: DataFrame, k: int, floor: float, skip_self: bool) -> DataFrame:
        """query_id, id, similarity: the best of each query in each piece of its cells.

        A cell's rows and its queries are dealt into pieces of about BLOCK, so a cell with most of either is many groups.
        """
        cells = self.spark.read.parquet(f"{self.folder}/cells").select("list", "ring", F.ceil(F.col("n") / BLOCK).cast("int").alias("pieces"))
        met = wanted.groupBy("list", "ring").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
        plan = F.broadcast(stored(met.join(F.broadcast(cells), ["list", "ring"])))  # at most LISTS * RINGS rows
        piece = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
        upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        rows = self._rows(self.spark, self.folder).drop("angle").join(plan, ["list", "ring"])
        rows = rows.select("list", "ring", piece("id", "pieces").alias("piece"), upto("blocks").alias("block"), "id", "embedding")
        asked = wanted.join(plan, ["list", "ring"]).join(queries.select("query_id", "embedding").hint("shuffle_hash"), "query_id")
        asked = asked.select("list", "ring", upto("pieces").alias("piece"), piece("query_id", "blocks").alias("block"), "query_id", "embedding")
        key = ["list", "ring", "piece", "block"]
        return asked.groupBy(*key).cogroup(rows.groupBy(*key)).applyInPandas(best_of_blocks(k, floor, skip_self), BEST)

    def neighbours(self, queries: DataFrame, k: int, floor: float = -1.0, skip_self: bool = False, exact: bool = True) -> DataFrame:
        """query_id, rank, id, similarity: the k most similar rows of each query at or above a floor.

        exact: the same rows as vectors.neighbours gives; else those of the probed lists. queries: query_id (distinct), embedding;
        without a whole vector a query finds nothing. An empty index finds nothing.
        """
        q = stored(usable(queries).select(F.col("query_id").cast("long").alias("query_id"), F.col("embedding").cast("array<double>").alias("embedding")))
        if not len(self.centres):
            return self.spark.createDataFrame([], "query_id long, rank long, id long, similarity double")
        first = k_best(self._scored(self._wanted(q, False, floor), q, k, floor, skip_self), k)
        if not exact:
            return first
        first = stored(first)
        last = first.where(F.col("rank") == k).select("query_id", F.col("similarity").alias("last"))
        bounds = q.join(last.hint("shuffle_merge"), "query_id", "left").withColumn("least", F.greatest(F.coalesce("last", F.lit(float(floor))), F.lit(float(floor))))
        more = self._scored(self._wanted(bounds, True, floor), q, k, floor, skip_self)
        return k_best(first.drop("rank").unionByName(more), k)
