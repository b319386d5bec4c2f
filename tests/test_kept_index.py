"""The kept index against a rebuild, over random updates, merges, replays and broken-off updates."""

import os
import random

from pyspark.sql import functions as F

from quaero.operators import search
from quaero.operators.kept_index import KeptIndex
from quaero.plans import recall_queries

NOTE = "id long, title string, question string, conclusion string, topic_id long, created_s long, deleted boolean"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_updates_equal_a_rebuild(spark, tmp_path):
    rnd = random.Random(3)
    text = lambda: " ".join(rnd.choices(WORDS, k=6))
    now = {}
    index = KeptIndex(spark, str(tmp_path / "index"), buckets=4, fan=2)
    queries = spark.createDataFrame([(1, "alpha beta"), (2, "theta"), (3, "kappa zz"), (4, "")], "query_id long, query string")
    for number in range(1, 7):
        changed = {i: (i, text(), text(), text(), i % 3, i * 10, False) for i in rnd.sample(range(25), 6)}
        gone = rnd.sample(sorted(set(now) - set(changed)), min(2, len(set(now) - set(changed))))
        changes = spark.createDataFrame([*changed.values(), *((i, None, None, None, None, None, True) for i in gone)], NOTE)
        assert index.update(changes, number)
        now = {i: r for i, r in (now | changed).items() if i not in gone}
        assert not index.update(changes, number)
    assert len(index.segments()) <= 4
    plain = spark.createDataFrame(list(now.values()), NOTE).drop("deleted")
    again = KeptIndex(spark, str(tmp_path / "index"), buckets=4, fan=2)  # as after a restart
    assert rows_of(again.notes().select(plain.columns)) == rows_of(plain)
    assert rows_of(again.grams()) == rows_of(search.trigram_index(plain).select("gram", "id"))
    assert rows_of(again.terms()) == rows_of(search.note_terms(plain).select("id", "term", "weight"))
    assert rows_of(again.bm25_search(queries)) == rows_of(search.bm25_search(queries, plain))
    assert rows_of(again.keyword_recall(queries)) == rows_of(search.keyword_recall(queries, plain))


def test_an_update_reads_and_indexes_only_its_notes(spark, tmp_path):
    index = KeptIndex(spark, str(tmp_path / "index"), fan=10)
    all_ = spark.range(50).select("id", *(F.concat(F.lit(f"{c} "), F.col("id").cast("string")).alias(c) for c in ("title", "question", "conclusion")), (F.col("id") % 5).alias("topic_id"), F.col("id").alias("created_s"), F.lit(False).alias("deleted"))
    index.update(all_, 1)
    first = index.segments()[0]["seg"]
    index.update(all_.where("id < 2"), 2)
    segments = index.segments()
    assert [s["ids"] for s in segments] == [50, 2] and segments[0]["seg"] == first
    assert spark.read.parquet(f"{index.folder}/grams/seg={segments[1]['seg']}").select("id").distinct().count() == 2
    asked = spark.createDataFrame([("tit",)], "gram string")
    scan = index._postings("grams", segments[:1], asked)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in scan or "PartitionFilters: [bucket" in scan


def test_a_broken_off_update_changes_nothing(spark, tmp_path, monkeypatch):
    index = KeptIndex(spark, str(tmp_path / "index"))
    note = lambda i, t: spark.createDataFrame([(i, t, t, t, 1, 1, False)], NOTE)
    index.update(note(1, "alpha"), 1)
    monkeypatch.setattr(KeptIndex, "_keep", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    try:
        index.update(note(2, "beta"), 2)
    except RuntimeError:
        pass
    monkeypatch.undo()
    again = KeptIndex(spark, str(tmp_path / "index"))
    assert [r.id for r in again.notes().collect()] == [1]
    assert again.update(note(2, "beta"), 2) and sorted(r.id for r in again.notes().collect()) == [1, 2]


def test_kinds_that_are_not_kept_are_made_when_read(spark, tmp_path):
    note = lambda i, t: (i, t, t, None, 1, 1, False)
    index = KeptIndex(spark, str(tmp_path / "index"), buckets=4, fan=2, kinds=("words",))
    index.update(spark.createDataFrame([note(1, "alpha beta"), note(2, "gamma"), note(3, "delta")], NOTE), 1)
    index.update(spark.createDataFrame([note(2, "alpha"), (3, None, None, None, None, None, True)], NOTE), 2)
    index.update(spark.createDataFrame([note(4, "epsilon")], NOTE), 3)
    assert not {"grams", "terms"} & set(os.listdir(index.folder)) and len(index.segments()) == 2
    again = KeptIndex(spark, str(tmp_path / "index"), buckets=4, fan=2)  # keeps all kinds from here on
    for _ in range(2):
        plain = again.notes()
        assert rows_of(again.grams()) == rows_of(search.trigram_index(plain).select("gram", "id"))
        assert rows_of(again.terms(spark.createDataFrame([("alpha",)], "term string")).where("term = 'alpha'")) == [(1, "alpha", 2.0), (2, "alpha", 2.0)]
        assert rows_of(again.words()) == rows_of(search.note_words(plain))
        again.update(spark.createDataFrame([note(5, "zeta"), note(1, "alpha eta")], NOTE), 4)
    assert len(again.segments()) == 1 and "grams" in os.listdir(again.folder)


def test_the_query_writes_only_the_postings_it_reads(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(recall_queries, "shared_folder", lambda _: str(tmp_path / "index"))
    recall_queries.kept_index_search(spark, "/root/testdata/sf0.001")
    assert sorted(os.listdir(tmp_path / "index")) == ["notes", "state", "words"]
    assert not [f for _, folders, _ in os.walk(tmp_path / "index/words") for f in folders if f.startswith("bucket=")]
