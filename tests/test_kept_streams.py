"""Kept streams: replays, late rows, restarts, compaction, and changes of a folder's files."""

import os
import random
import time

from pyspark.sql import functions as F

from quaero.streaming import kept


def notes(spark, rows):
    return spark.createDataFrame(rows, "topic_id long, id long, created string").withColumn("created_utc", F.col("created").cast("timestamp"))


def made(rng, n, first):
    return [(rng.choice([1, 1, 1, 2, None]), first + i, f"2024-0{rng.randint(1, 3)}-{rng.randint(10, 28)} 10:00:00") for i in range(n)]


def test_days_count_late_rows_and_survive_replays(spark, tmp_path):
    rng, seen = random.Random(2), []
    activity = kept.KeptActivity(spark, str(tmp_path / "days"), fan=3)
    for batch in range(7):
        rows = made(rng, 20, 100 * batch)
        seen += rows
        for _ in range(2):  # the second time is a replay
            activity.add(notes(spark, rows), batch)
    activity.add(notes(spark, made(rng, 5, 9000)), 2)  # a batch that a base holds already
    want = {}
    for _, _, created in seen:
        want[created[:10]] = want.get(created[:10], 0) + 1
    assert {r.day: r.n_notes for r in activity.days().collect()} == want
    assert activity.kept.upto() >= 2
    assert sum(r.n_notes for r in activity.weeks().collect()) == len(seen)
    activity.add(notes(spark, [(1, 1, "2019-01-01 00:00:00")]), 7)  # years late
    assert {r.day: r.n_notes for r in activity.days().collect()}["2019-01-01"] == 1


def test_ordinals_go_on_over_batches(spark, tmp_path):
    rng, n, want = random.Random(4), {}, {}
    kept_rows = kept.KeptOrdinals(spark, str(tmp_path / "asks"), fan=2)
    for batch in range(5):
        rows = made(rng, 30, 100 * batch)
        for topic, key, _ in sorted(rows, key=lambda r: (r[2], r[1])):
            n[topic] = n.get(topic, 0) + 1
            want[key] = (topic, n[topic])
        for _ in range(2):
            kept_rows.add(notes(spark, rows), batch)
    assert {r.id: (r.topic_id, r.ask_index) for r in kept_rows.rows().collect()} == want


def test_a_batch_broken_off_before_its_count_is_taken_up(spark, tmp_path, monkeypatch):
    ordinals = kept.KeptOrdinals(spark, str(tmp_path / "asks"))
    ordinals.add(notes(spark, [(1, 1, "2024-01-01 00:00:00")]), 0)
    monkeypatch.setattr(ordinals.kept, "add", lambda *_: None)
    ordinals.add(notes(spark, [(1, 2, "2024-01-01 00:00:00")]), 1)
    monkeypatch.undo()
    ordinals.add(notes(spark, [(1, 2, "2024-01-01 00:00:00")]), 1)
    ordinals.add(notes(spark, [(1, 3, "2024-01-01 00:00:00")]), 2)
    assert sorted((r.id, r.ask_index) for r in ordinals.rows().collect()) == [(1, 1), (2, 2), (3, 3)]


def test_changes_of_files_arrive_once_after_restarts_too(spark, tmp_path):
    root, state = tmp_path / "files", tmp_path / "kept"
    (root / "a").mkdir(parents=True)
    out = []

    def read():
        """A query of its own each time, that goes on from the checkpoint."""
        found = kept.FolderChanges(spark, str(root), str(state))
        step = lambda batch, _: out.extend((r.version, r.path, r.action) for r in batch.collect())
        found.stream().writeStream.foreachBatch(step).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
        fresh = sorted(out)
        out.clear()
        return fresh

    def write(name, text, at):
        (root / name).write_text(text)
        os.utime(root / name, (at, at))

    now = int(time.time()) - 1000
    record = lambda: kept.FolderChanges(spark, str(root), str(state)).record()
    write("a/one.md", "one", now)
    write("two.md", "two", now)
    write(".hidden", "x", now)
    assert record() == 1
    assert read() == [(1, "a/one.md", "added"), (1, "two.md", "added")]
    assert record() is None and read() == []
    write("a/one.md", "one, changed", now + 5)
    write("two.md", "two", now + 9)
    write("three.md", "three", now - 500)  # older than what is known
    assert record() == 2
    (root / "two.md").unlink()
    assert record() == 3
    assert read() == [(2, "a/one.md", "updated"), (2, "three.md", "added"), (2, "two.md", "touched"), (3, "two.md", "removed")]
    write("two.md", "two", now + 20)
    assert record() == 4
    assert read() == [(4, "two.md", "added")]
    assert sorted(r.path for r in kept.FolderChanges(spark, str(root), str(state)).manifest().collect()) == ["a/one.md", "three.md", "two.md"]


def test_a_record_broken_off_is_finished_by_the_next(spark, tmp_path, monkeypatch):
    root = tmp_path / "files"
    root.mkdir()
    (root / "x.md").write_text("x")
    found = kept.FolderChanges(spark, str(root), str(tmp_path / "kept"))
    monkeypatch.setattr(found, "_finish", lambda version: None)
    assert found.record() == 1
    monkeypatch.undo()
    assert found.record() is None
    assert [(r.version, r.path) for r in found.changes().collect()] == [(1, "x.md")]


def test_watch_records_by_itself(spark, tmp_path):
    root = tmp_path / "files"
    root.mkdir()
    (root / "x.md").write_text("x")
    found = kept.FolderChanges(spark, str(root), str(tmp_path / "kept"))
    query = found.watch(str(tmp_path / "state"), "1 second")
    try:
        for _ in range(60):
            if kept.versions(spark, f"{found.folder}/manifests"):
                break
            time.sleep(1)
    finally:
        query.stop()
    assert [(r.version, r.path, r.action) for r in found.changes().collect()] == [(1, "x.md", "added")]
