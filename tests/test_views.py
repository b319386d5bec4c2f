"""Ordinals over ranges, conflicts as rows, and views with tags, by hand-made rows."""

import random

import pytest
from pyspark.sql import functions as F

from quaero.operators import activity as A
from quaero.operators import resolve
from quaero.operators import views as W

AT = "2026-01-01 00:00:00"


def test_ordinals_of_a_key_that_spans_ranges(spark):
    """One key holds most rows, some rows have no key, times tie: ordinals go on over the ends of ranges."""
    draw = random.Random(5)
    rows = [(draw.choice([7] * 8 + [1, 2, None]), draw.randrange(40), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "topic int, at int, id int")
    got = {r.id: (r.n, r.total) for r in A.ordinals(df, "topic", [F.desc("at"), F.asc("id")], "n", "total").collect()}
    want = {}
    for topic in (7, 1, 2, None):
        own = sorted((-at, i) for t, at, i in rows if t == topic)
        want |= {i: (k, len(own)) for k, (_, i) in enumerate(own, 1)}
    assert got == want


def test_ordinals_of_no_rows_and_repeated_rows(spark):
    df = spark.createDataFrame([(1, 1)] * 5, "k int, v int")
    assert sorted(r.n for r in A.ordinals(df, "k", [F.asc("v")], "n").collect()) == [1, 2, 3, 4, 5]
    assert A.ordinals(df.where("k = 2"), "k", [F.asc("v")], "n", "total").isEmpty()


@pytest.mark.parametrize(("n", "limit", "more"), [(5, 2, True), (2, 2, False), (0, 2, False), (3, 5, False)])
def test_next_only_if_more_follow(spark, n, limit, more):
    df = spark.range(n).withColumn("created_utc", F.lit(AT).cast("timestamp"))
    rows = A.page_with_next(df, limit).orderBy(F.desc("id")).collect()
    assert [r.id for r in rows] == list(range(n - 1, -1, -1))[:limit]
    assert {r.next for r in rows} <= ({f"{AT} {n - limit}"} if more else {None})


def test_decisions_about_conflicts(spark):
    files = spark.createDataFrame([("a", "x"), ("a", "yy"), ("b", "z"), ("b", "z2"), ("c", "one")], "id string, path string")
    copies = resolve.conflict_copies({"note": files})
    assert sorted((r.id, r.n_copies) for r in resolve.conflict_ids({"note": files}).collect()) == [("a", 2), ("b", 2)]
    wishes = spark.createDataFrame([("note", "a", "yy"), ("note", "b", "q"), ("note", "c", "one"), ("note", "d", None)], "kind string, id string, keep string")
    got = sorted((r.id, r.path, r.outcome) for r in resolve.settle(copies, wishes).na.fill("-").collect())
    assert got == [("a", "x", "discarded"), ("a", "yy", "kept"), ("b", "q", "rejected: not a copy"), ("c", "one", "rejected: no such conflict"), ("d", "-", "rejected: no such conflict")]


def _edges(spark, rows):
    return spark.createDataFrame(rows, "start string, resolved string")


def test_rows_with_tags_through_aliases(spark):
    notes = spark.createDataFrame(
        [("a", "long/path", ["old", "b"], 1), ("a", "p", ["old", "new", "b"], 1), ("n", "q", None, 2), ("e", "r", [], 3), (None, "s", ["b"], 3)],
        "id string, path string, tags array<string>, topic_id long",
    )
    merges = spark.createDataFrame([(1, 9)], "start long, resolved long")
    rows = W.note_rows(notes, merges, _edges(spark, [("old", "new")]))
    assert {r.id: (r.path, r.tags, r.topic_id) for r in rows.collect()} == {"a": ("p", ["new", "b"], 9), "n": ("q", [], 2), "e": ("r", [], 3)}
    assert {r.tag: r.n_notes for r in W.tag_usage(rows).collect()} == {"new": 1, "b": 1}
    assert {r.tag for r in W.tags_in_use(rows, _edges(spark, [("old", "new"), ("x", "unused")])).collect()} == {"new", "b", "unused"}


def test_search_filters_the_whole_ranking_by_tag(spark):
    """With a limit of one, the best note lacks the tag and the next one that has it is found, by an alias too."""
    notes = spark.createDataFrame([(1, "sqlite sqlite", ["x"]), (2, "about sqlite", ["y"]), (3, "other", ["y"])], "id long, title string, tags array<string>")
    notes = notes.withColumns({"question": F.lit(""), "conclusion": F.lit(None).cast("string"), "topic_id": F.lit(1), "created_s": F.col("id")})
    asked = spark.createDataFrame([(1, "sqlite", "why"), (2, "sqlite", None), (3, "sqlite", "none")], "query_id long, query string, tag string")
    got = W.tagged_search(asked, notes, _edges(spark, [("why", "y")]), limit=1).collect()
    assert sorted((r.query_id, r.rank, r.id) for r in got) == [(1, 1, 2), (2, 1, 1)]


def test_recall_says_whether_vectors_took_part(spark):
    notes = spark.createDataFrame([(1, 5, "first", 1), (2, 5, "later", 2), (3, 6, None, 3)], "id long, topic_id long, title string, created_s long")
    keyword = spark.createDataFrame([(0, 2, 1)], "query_id long, id long, rank long")
    near = spark.createDataFrame([(0, 3, 1)], "query_id long, id long, rank long")
    labels = W.topic_labels(notes, "created_s")
    row = lambda r: (r.rank, r.topic_id, r.label, r.ask_count, r.semantic)
    assert [row(r) for r in W.recall_result(keyword, notes, labels).collect()] == [(1, 5, "first", 2, False)]
    assert sorted(row(r) for r in W.recall_result(keyword, notes, labels, near).collect()) == [(1, 5, "first", 2, True), (2, 6, "", 1, True)]


def test_count_of_a_topic_after_each_save(spark):
    saved = spark.createDataFrame([(1, "a", None), (2, "a", "no"), (3, "a", None), (4, "b", None)], "request_id long, topic_id string, reject_reason string")
    notes = spark.createDataFrame([("a",), ("a",), ("z",)], "topic_id string")
    assert {r.request_id: r.ask_count for r in W.ask_counts_after(saved, notes).collect()} == {1: 3, 3: 4, 4: 1}


def test_export_keeps_nulls_and_line_breaks(spark):
    rows = spark.createDataFrame([(1, "a\nb"), (2, None)], "id int, text string")
    assert sorted(r.value for r in W.exported(rows).collect()) == ['{"id":1,"text":"a\\nb"}', '{"id":2,"text":null}']


def test_health_and_topic_pages_of_odd_tables(spark):
    files = spark.createDataFrame([("a", "notes/1"), ("a", "notes/2"), ("b", "notes/3")], "id string, path string")
    none = files.where("false")
    bad = spark.createDataFrame([("x",)], "path string")
    row = lambda tables, invalid: W.health_report(tables, invalid).first().asDict()
    assert row({"note": files, "topic": files.where("id = 'b'")}, bad.where("false")) == {"conflicts": 1, "invalid_files": 0, "notes": 2, "topics": 1, "ok": False}
    assert row({"note": none}, bad) == {"conflicts": 0, "invalid_files": 1, "notes": 0, "ok": False}
    assert row({"note": none}, bad.where("false"))["ok"] is True

    notes = spark.createDataFrame([(1, 7, "s", "2024-01-02"), (2, 7, "s", "2024-01-01"), (3, 8, None, None)], "id long, topic_id long, session_id string, created string")
    topics = spark.createDataFrame([(7, "seven", "2024"), (5, None, None)], "id long, label string, created string")
    chains = spark.createDataFrame([(5, 7), (6, 7), (7, 7)], "start long, resolved long")
    pages = {r.topic_id: tuple(r)[1:] for r in W.topic_pages(notes, topics, chains).collect()}
    assert pages == {7: ("seven", "2024", 2, 1, 2), 8: ("", "", 1, 0, 0)}
    assert sorted(map(tuple, W.merged_topics(topics, chains).collect())) == [(7, 5, ""), (7, 6, "")]
    assert {r.id: r.position for r in W.topic_positions(notes).collect()} == {1: 2, 2: 1, 3: 1}


def test_details_of_asked_notes(spark):
    rows = spark.createDataFrame([("a", "n/a.md", "A", ["t"], 1), ("b", "n/b.md", None, [], 1), ("c", "n/c.md", "C", [], None)], "id string, path string, body string, tags array<string>, topic_id long")
    labels = spark.createDataFrame([(1, "one"), (2, "two")], "topic_id long, label string")
    remarks = spark.createDataFrame([("a", "r2", "2", "x"), ("a", "r1", "2", "y"), ("a", "r3", None, "z"), ("gone", "r4", "1", "w"), (None, "r5", "1", "v")], "note_id string, id string, created string, body string")
    found = {r.id: r for r in W.note_details(rows, labels, remarks, spark.createDataFrame([("a",), ("a",), ("c",), ("zz",), (None,)], "id string")).collect()}
    assert set(found) == {"a", "c"} and (found["a"].label, found["a"].ask_count, found["a"].n_annotations, found["a"].markdown) == ("one", 2, 3, "A")
    assert (found["c"].label, found["c"].ask_count, found["c"].n_annotations) == ("", 0, 0)
    assert W.note_details(rows, labels, remarks).count() == 3 and W.note_details(rows.limit(0), labels, remarks).isEmpty()
    placed = sorted((r.place, r.id) for r in W.note_annotations(rows, remarks).collect())
    assert placed == [(1, "r3"), (2, "r1"), (3, "r2")]


def test_projects_and_labels_without_values(spark):
    notes = spark.createDataFrame([("git", "/w", "codex"), (None, "/w", "codex"), (None, "/w", "other"), (None, None, None), ("", "/w", "x")], "git_repo string, cwd string, agent string")
    assert sorted(tuple(r) for r in W.project_counts(notes).collect()) == [("", 2, 1), ("/w", 2, 2), ("git", 1, 1)]
    pairs = spark.createDataFrame([(1, 2), (2, 9), (None, 1)], "a long, b long")
    labels = spark.createDataFrame([(1, "one"), (2, None)], "topic_id long, label string")
    got = W.labelled_pairs(pairs, labels, "a", "b").select("a", "b", "label_a", "label_b").collect()
    assert sorted(map(tuple, got), key=str) == [(1, 2, "one", ""), (2, 9, "", ""), (None, 1, "", "one")]
