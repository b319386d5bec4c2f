"""The index of vectors against exact search, and centroids kept up to date against a rebuild."""

import numpy as np
from pyspark.sql import functions as F

from quaero.operators import vector_index, vectors
from quaero.operators.vector_index import VectorIndex
from quaero.sources import tables

from .conftest import plain


def table(spark, matrix, first=0):
    return spark.createDataFrame([(first + i, [float(x) for x in v]) for i, v in enumerate(matrix)], "id long, embedding array<float>")


def clustered(rng, n, dimension=16, groups=30):
    return rng.normal(size=(groups, dimension))[rng.integers(0, groups, n)] + 0.35 * rng.normal(size=(n, dimension))


def rows(df):
    return sorted(plain(list(r)) for r in df.select("query_id", "rank", "id", "similarity").collect())


def test_exact_search_equals_all_pairs(spark):
    rng = np.random.default_rng(3)
    repeated = np.vstack([np.ones((300, 4)), rng.normal(size=(50, 4)), np.zeros((3, 4)), -np.ones((2, 4))])
    for matrix, k, floor, skip in ((clustered(rng, 900), 7, -1.0, True), (rng.normal(size=(300, 8)), 3, 0.5, False), (repeated, 7, -1.0, True)):
        v = table(spark, matrix)
        q = v.where("id % 9 = 0").withColumnRenamed("id", "query_id")
        assert rows(VectorIndex.build(v).neighbours(q, k, floor, skip)) == rows(vectors.neighbours(q, v, k, floor, skip))


def test_hot_cells_are_dealt_into_pieces(spark, monkeypatch):
    monkeypatch.setattr(vector_index, "BLOCK", 16)
    rng = np.random.default_rng(5)
    v = table(spark, np.vstack([np.tile(rng.normal(size=(1, 6)), (200, 1)), rng.normal(size=(100, 6))]))
    q = v.where("id % 3 = 0").withColumnRenamed("id", "query_id")
    index = VectorIndex.build(v)
    assert rows(index.neighbours(q, 5)) == rows(vectors.neighbours(q, v, 5))


def test_probed_lists_hold_nine_tenths(spark):
    v = table(spark, clustered(np.random.default_rng(8), 4000))
    q = v.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    index = VectorIndex.build(v)
    assert index.probes < len(index.centres) / 3
    true = {(r[0], r[2]) for r in rows(vectors.neighbours(q, v, 10))}
    found = {(r[0], r[2]) for r in rows(index.neighbours(q, 10, exact=False))}
    assert len(true & found) >= 0.9 * len(true)


def test_probed_lists_on_the_given_vectors(spark):
    v = tables.vectors(spark, "/root/testdata/sf0.1").select("id", "embedding")
    q = v.where("id % 10 = 0").withColumnRenamed("id", "query_id")
    true = {(r[0], r[2]) for r in rows(vectors.neighbours(q, v, 10))}
    found = {(r[0], r[2]) for r in rows(VectorIndex.build(v).neighbours(q, 10, exact=False))}
    assert len(true & found) >= 0.9 * len(true)


def test_missing_vectors_and_empty_tables(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [None, 1.0]), (4, [0.6, 0.8])], "id long, embedding array<double>")
    index = VectorIndex.build(v)
    assert rows(index.neighbours(v.withColumnRenamed("id", "query_id"), 5)) == [[1, 1, 1, 1.0], [1, 2, 4, 0.6], [4, 1, 4, 1.0], [4, 2, 1, 0.6]]
    assert index.neighbours(v.where("id > 9").withColumnRenamed("id", "query_id"), 5).isEmpty()
    assert VectorIndex.build(v.where("id > 9")).neighbours(v.withColumnRenamed("id", "query_id"), 5).isEmpty()


def test_an_index_is_opened_again(spark, tmp_path):
    v = table(spark, clustered(np.random.default_rng(1), 300))
    VectorIndex.build(v, str(tmp_path / "index"))
    q = v.where("id < 5").withColumnRenamed("id", "query_id")
    assert rows(VectorIndex(spark, str(tmp_path / "index")).neighbours(q, 4)) == rows(vectors.neighbours(q, v, 4))


def test_refreshed_centroids_equal_a_rebuild(spark, tmp_path):
    rng = np.random.default_rng(4)
    state = {i: (int(rng.integers(0, 12)), rng.normal(size=3)) for i in range(120)}

    def now():
        made = [(t, f"{i}:{hash(v.tobytes())}", [float(x) for x in v]) for i, (t, v) in state.items()]
        return spark.createDataFrame(made, "topic_id long, key string, embedding array<double>")

    def seen(df):
        return sorted(plain([r.topic_id, r.signature, [round(x, 6) for x in r.embedding]]) for r in df.collect())

    kept = now().limit(0).withColumn("signature", F.lit("")).select("topic_id", "signature", "embedding")
    for step in range(4):
        for i in rng.choice(list(state), 4).tolist():
            if step % 2:
                state.pop(i, None)
            elif i in state:
                state[i] = (int(rng.integers(0, 12)), state[i][1])
        state[1000 + step] = (20 + step, rng.normal(size=3))
        kept = vectors.refreshed_centroids(kept, now())
        kept.write.parquet(str(tmp_path / f"kept{step}"))
        kept = spark.read.parquet(str(tmp_path / f"kept{step}"))
        assert seen(kept) == seen(vectors.kept_centroids(now()))
