"""Recall by bounds against recall of all terms, laid-out pages against sorted rows, and the trained word model."""

import random

import numpy as np
from pyspark.sql import functions as F

from quaero.operators import activity, bounded_recall, search, word_vectors
from quaero.operators.page_layout import PageLayout

from .conftest import plain

NOTES = "id long, title string, question string, conclusion string, topic_id long, created_s long"


def notes_of(spark, rng, n, words):
    text = lambda k: " ".join(min(rng.choice(words), rng.choice(words), rng.choice(words)) for _ in range(rng.randrange(k)))
    rows = [(i, text(4), text(8), rng.choice([None, "", text(12)]), i % 5, rng.randrange(50)) for i in range(n)]
    return spark.createDataFrame(rows, NOTES)


def rows(df):
    return sorted(plain(list(r)) for r in df.collect())


def test_bounds_lose_no_note(spark):
    rng = random.Random(4)
    notes = notes_of(spark, rng, 400, [f"w{k:03d}" for k in range(80)])
    asked = notes.where("id % 7 = 0").select(F.col("id").alias("query_id"), F.concat_ws(" ", "title", "question", F.lit("unheard of w000 w001")).alias("query"))
    for blocks in (1, 5):
        assert rows(bounded_recall.bounded_recall(asked, notes, blocks=blocks)) == rows(search.keyword_recall(asked, notes))
    repeated = asked.unionByName(asked)
    assert rows(bounded_recall.bounded_recall(repeated, notes)) == rows(search.keyword_recall(asked, notes))


def test_frequent_terms_are_not_joined(spark):
    """A term that all notes have costs nothing while the rare one is needed; a question of that term alone needs it."""
    notes = spark.createDataFrame([(i, "the", f"the note{i}", "the", 0, i) for i in range(200)], NOTES)
    asked = spark.createDataFrame([(1, "the note7"), (2, "the"), (3, None), (4, "")], "query_id long, query string")
    assert rows(bounded_recall.recall_rows(asked, notes)) == [[1, 201, 1], [2, 200, 200]]
    found = bounded_recall.bounded_recall(asked, notes)
    assert rows(found) == rows(search.keyword_recall(asked, notes))
    assert [r.id for r in found.where("query_id = 1").collect()] == [7] and found.where("query_id = 2").count() == 200


def test_recall_of_empty_tables(spark):
    none, asked = spark.createDataFrame([], NOTES), spark.createDataFrame([(1, "a word")], "query_id long, query string")
    assert bounded_recall.bounded_recall(asked, none).isEmpty()
    assert bounded_recall.bounded_recall(asked.limit(0), none).isEmpty()


def timed(spark, n, days):
    rng = random.Random(n)
    some = [(i, rng.randrange(days), f"note {i}") for i in range(n)]
    return spark.createDataFrame([*some, (None, 3, "no id"), (n + 5, None, "no time")], "id long, day int, text string").selectExpr("id", "timestamp_seconds(day * 86400) AS created_utc", "text")


def test_pages_equal_sorted_rows(spark):
    table = timed(spark, 1000, 30)  # about 33 rows of one time
    layout = PageLayout.write(table, file_rows=90)
    want = [tuple(r) for r in table.where("id IS NOT NULL AND created_utc IS NOT NULL").orderBy(F.desc("created_utc"), F.desc("id")).select("id", "created_utc", "text").collect()]
    assert layout.n_rows() == len(want) == 1000
    for number in (0, 7, 50, 99, 100):
        got = sorted((r.place, r.id, r.created_utc, r.text) for r in layout.numbered(number, 10).collect())
        assert got == [(p, *want[p]) for p in range(number * 10, min(1000, number * 10 + 10))]
    for place in (9, 89, 500, 990, 999):
        before = (want[place][1], want[place][0])
        got = [tuple(r) for r in layout.page(10, before).select("id", "created_utc", "text").collect()]
        assert got == want[place + 1 : place + 12]
        assert rows(layout.page(10, before)) == rows(activity.page(table.where("id IS NOT NULL"), 10, before))
    assert [tuple(r) for r in layout.page(10).select("id", "created_utc", "text").collect()] == want[:11]


def test_deep_pages_read_few_files(spark):
    layout = PageLayout.write(timed(spark, 4000, 4000), file_rows=100)
    assert layout.files.count() >= 30
    least = layout.files.agg(F.min("n")).first()[0]
    for number in (0, 150, 399):
        last = layout.numbered(number, 10).orderBy("created_utc", "id").first()
        assert layout.files_of_number(number, 10).count() <= 1 + -(-10 // least)
        assert layout.files_of_page(10, (last.created_utc, last.id)).count() <= 2 + -(-11 // least)
    for number in (0, 150):  # after the last page nothing is read
        last = layout.numbered(number, 10).orderBy("created_utc", "id").first()
        plan = layout.page(10, (last.created_utc, last.id))._jdf.queryExecution().executedPlan().toString()
        assert "LessThanOrEqual(key_micros" in plan
    assert PageLayout.write(timed(spark, 0, 1)).page(10).isEmpty() and PageLayout.write(timed(spark, 0, 1)).numbered(0, 10).isEmpty()


def test_word_counts_against_loops(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(12))) for _ in range(40)] + ["", None, "a", "A b! a"]
    table = spark.createDataFrame([(t,) for t in texts], "text string")
    known = word_vectors.vocabulary(table, 6)
    places = {r.word: r.place for r in known.collect()}
    count: dict = {}
    for t in texts:
        w = (t or "").lower().replace("!", "").split()
        for i, x in enumerate(w):
            for y in w[i + 1 : i + 5]:
                if x in places and y in places:
                    key = tuple(sorted((places[x], places[y])))
                    count[key] = count.get(key, 0) + 1
    assert {(r.a, r.b): r.n for r in word_vectors.co_occurrences(table, known).collect()} == count


def test_model_knows_words_by_their_company(spark):
    """Two words that never stand together but have the same neighbours are near; word hashing can't tell that."""
    rng = random.Random(2)
    themes = {"cat feline": "purrs whiskers sleeps mouse paws", "car vehicle": "drives engine wheels road fuel"}
    texts = [f"{rng.choice(names.split())} {' '.join(rng.sample(others.split(), 3))}" for names, others in themes.items() for _ in range(300)]
    model = word_vectors.trained(spark.createDataFrame([(t,) for t in texts], "text string"), dimension=4)
    asked = spark.createDataFrame([(w, w) for w in ("cat", "feline", "car", "vehicle")] + [("none", "zzz"), ("null", None), ("cat", "cat")], "key string, text string")
    v = {r.key: np.array(r.embedding) for r in word_vectors.embedded_by(model, asked).collect()}
    assert len(v) == 6 and not v["none"].any() and not v["null"].any()
    assert v["cat"] @ v["feline"] > 0.8 and v["car"] @ v["vehicle"] > 0.8 and abs(v["cat"] @ v["car"]) < 0.2
    empty = word_vectors.trained(asked.where("false"))
    assert empty.isEmpty() and not np.array(word_vectors.embedded_by(empty, asked).first().embedding).any()
