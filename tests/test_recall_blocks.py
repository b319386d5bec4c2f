"""Recall by blocks against sums over all pairs, with and without optional terms."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quaero.operators import recall_blocks, search, vectors

from .test_bounded import notes_of, rows


def summed(asked, notes):
    """Recall as one join of all postings."""
    each = asked.select("query_id", F.explode(search.terms(F.col("query"))).alias("term")).distinct()
    index = search.note_terms(notes)
    weighted, total = search.question_weights(each, index, notes)
    score = weighted.join(index, "term").groupBy("query_id", "id").agg(F.sum(F.col("weight") * F.col("idf")).alias("score"))
    return score.join(total, "query_id").where("score >= total * 0.25").select("query_id", "id", F.round("score", 6).alias("score"))


@pytest.mark.parametrize("share", [0.0, recall_blocks.OPTIONAL, 1.0])
def test_blocks_equal_sums_over_all_pairs(spark, monkeypatch, share):
    monkeypatch.setattr(recall_blocks, "NOTES", 60)
    monkeypatch.setattr(recall_blocks, "QUESTIONS", 20)
    monkeypatch.setattr(recall_blocks, "TILE_NOTES", 16)
    monkeypatch.setattr(recall_blocks, "TILE_QUESTIONS", 4)
    notes = notes_of(spark, random.Random(5), 300, [f"w{k:03d}" for k in range(60)])
    asked = notes.where("id % 5 = 0").select(F.col("id").alias("query_id"), F.concat_ws(" ", "question", F.lit("w000 unheard")).alias("query"))
    found = search.keyword_recall(asked, notes, share=share)
    assert rows(found.select("query_id", "id", "score")) == rows(summed(asked, notes))
    first = search.keyword_recall(asked, notes, share=share, limit=3)
    assert rows(first) == rows(found.where("rank <= 3"))


def test_postings_never_meet_questions_as_rows(spark):
    """The plan joins no postings with the questions' terms: rows are made in the blocks, of what is recalled alone."""
    notes = spark.createDataFrame([(i, f"the note{i}", "", "", 0, i) for i in range(50)], "id long, title string, question string, conclusion string, topic_id long, created_s long")
    plan = search.keyword_recall(notes.select(F.col("id").alias("query_id"), F.col("title").alias("query")), notes)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "salt" not in plan


@pytest.mark.parametrize(("k", "floor"), [(3, -1.0), (5, 0.4), (400, -1.0)])
def test_neighbours_by_tiles_equal_one_product(spark, monkeypatch, k, floor):
    for name, size in {"TILE": 8, "BLOCK": 32, "CHUNK": 50, "QUERIES": 30, "ROWS": 90}.items():
        monkeypatch.setattr(vectors, name, size)
    rng = np.random.default_rng(3)
    m = rng.integers(-2, 3, (300, 4)).astype(np.float32)  # many equal directions, and zero vectors
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "id long, embedding array<float>")
    unit = m / np.maximum(np.linalg.norm(m.astype(float), axis=1, keepdims=True), 1e-12)
    for skip in (False, True):
        want = []
        for q in range(0, 300, 5):
            same = np.round(unit @ unit[q], 6)
            order = [i for i in np.lexsort((np.arange(300), -same)) if same[i] >= floor and not (skip and i == q)][:k]
            want += [(q, r + 1, int(i)) for r, i in enumerate(order)]
        found = vectors.neighbours(table.where("id % 5 = 0").withColumnRenamed("id", "query_id"), table, k, floor, skip)
        assert sorted((r.query_id, r.rank, r.id) for r in found.collect()) == sorted(want)


def test_groups_of_neighbours_are_large(spark):
    """Rows are sent to every group of the other side, so their number must be small beside the rows."""
    assert vectors.QUERIES >= 16 * vectors.BLOCK and vectors.ROWS >= 8 * vectors.BLOCK
