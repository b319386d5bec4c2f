"""Operators on literal rows and small folders: chains with cycles, edits, ingestion and streams."""

import os

from pyspark.sql import functions as F

from quaero.operators import activity, edits, resolve, search, vectors
from quaero.sources import vault
from quaero.streaming import live

UUID = "01a0d530-42ae-7731-8a1d-b4e07d9b837d"


def test_chains_and_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("w", "x")], "id string, to string")
    got = {r.start: r.resolved for r in resolve.follow(edges, "id", "to").collect()}
    assert got == {"a": "c", "b": "c", "x": "x", "y": "y", "w": "x"}
    long = spark.createDataFrame([(i, i + 1) for i in range(30)], "id long, to long")
    assert {r.resolved for r in resolve.follow(long, "id", "to").collect()} == {30}


def test_iso_weeks(spark):
    rows = spark.createDataFrame([("2027-01-01",), ("2026-12-28",), ("2027-01-04",)], "d string")
    assert [r.w for r in rows.select(activity.iso_week(F.col("d")).alias("w")).collect()] == ["2026-W53", "2026-W53", "2027-W01"]


def test_neighbours_equal_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    data = rng.normal(size=(60, 8))
    rows = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(data)], "id long, embedding array<float>")
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    got = vectors.neighbours(rows.where("id < 5").withColumnRenamed("id", "query_id"), rows, 3, skip_self=True)
    for q in range(5):
        same = unit @ unit[q]
        same[q] = -9
        assert [r.id for r in sorted(got.where(F.col("query_id") == q).collect(), key=lambda r: r.rank)] == list(np.argsort(-same)[:3])


REQUEST = "request_id long, session_id string, cwd string, title string, question string, conclusion string, key_points array<string>, open_questions array<string>, topic string, tags array<string>, new_tags array<string>, confirm_new boolean, created string"


def request(n, **changes):
    base = {"session_id": UUID, "cwd": "/p", "title": "t", "question": "q", "conclusion": "c token = abcdefgh12", "key_points": ["k"], "open_questions": [], "topic": "new", "tags": ["sqlite"], "new_tags": [], "confirm_new": False, "created": "2026-01-01T00:00:00Z"}
    base |= changes
    return (n, *base.values())


def test_save_batch(spark):
    rows = [
        request(1),
        request(2, session_id="x"),
        request(3, title="a\nb"),
        request(4, tags=["nope"]),
        request(5, tags=[], new_tags=["sqlite3"]),
        request(6, tags=[], new_tags=["sqlite3"], confirm_new=True),
        request(7, tags=[]),
        request(8, topic="T9"),
        request(9, topic="T1", tags=["db"]),
        request(10, new_tags=["SQLite"]),
    ]
    known = spark.createDataFrame([("sqlite",), ("rust",)], "tag string")
    aliases = spark.createDataFrame([("db", "sqlite")], "start string, resolved string")
    topics = spark.createDataFrame([("T1",), ("T2",)], "id string")
    chains = spark.createDataFrame([("T1", "T2")], "start string, resolved string")
    got = {r.request_id: r for r in edits.save_batch(spark.createDataFrame(rows, REQUEST), topics, chains, known, aliases).collect()}
    reasons = {k: r.reject_reason for k, r in got.items()}
    assert reasons == {1: None, 2: "session_id is not a UUID", 3: "title must be a single line", 4: "unknown tag: nope", 5: "near duplicate: sqlite3", 6: None, 7: "a note needs a tag", 8: "unknown topic: T9", 9: None, 10: None}
    assert got[1].conclusion == "c token = [REDACTED:secret]" and got[9].topic_id == "T2" and got[9].tags == ["sqlite"]
    assert got[5].near == ["sqlite"] and got[10].tags == ["sqlite"]


def test_long_frontmatter_fields(spark):
    """A million characters, escapes and list items are read without a deep recursion."""
    quoted = 'x\\"y' * 200_000
    single = "it''s " * 100_000
    items = "".join(f"  - tag{k}\n" for k in range(20_000))
    yaml = f'id: "{quoted}"\nlabel: \'{single}\'\ntags:\n{items}created: 2026'
    row = spark.createDataFrame([(yaml,)], "yaml string").select(vault.yaml_field(F.col("yaml"), "id").alias("id"), vault.yaml_field(F.col("yaml"), "label").alias("label"), vault.yaml_field(F.col("yaml"), "created").alias("created"), vault.yaml_list(F.col("yaml"), "tags").alias("tags")).first()
    assert row.id == quoted.replace('\\"', '"') and row.label == single.replace("''", "'") and row.created == "2026"
    assert len(row.tags) == 20_000 and row.tags[-1] == "tag19999"


def tags_in_turn(requests, known):
    """request_id -> (tags, reason, near), request by request; tags are in normal form."""
    known, out = set(known), {}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    for key, tags, new_tags, confirm, fine in sorted(requests):
        reason, near = None, None
        for t in tags:
            if reason is None and t not in known:
                reason = f"unknown tag: {t}"
        for t in new_tags:
            close = sorted(u for u in known if u != t and (u.replace("-", "") == t.replace("-", "") or 1 - distance(t, u) / max(len(t), len(u)) >= 0.8))
            if reason is None and t not in known and close and not confirm:
                reason, near = f"near duplicate: {t}", close
        final = list(dict.fromkeys(tags + new_tags))
        if reason is None and not 1 <= len(final) <= 5:
            reason = "more than 5 tags" if final else "a note needs a tag"
        if reason is None and fine:
            known |= set(new_tags)
        out[key] = (final, reason, near)
    return out


def test_tags_of_a_batch_count_in_order(spark):
    import random

    known = spark.createDataFrame([("sqlite",), ("rust-lang",)], "tag string")
    aliases = spark.createDataFrame([], "start string, resolved string")
    for seed in range(3):
        rnd = random.Random(seed)
        pool = ["sqlite", "sqlite3", "sqlites", "rustlang", "rust-lang", "python", "pythons", "pythone", "apython", "py-thon", "golang", "go-lang", "golangs", "dock", "docker", "dockers", "dockerss"]
        rows = [(k, rnd.choices(pool, k=rnd.choice([0, 0, 1])), rnd.choices(pool, k=rnd.choice([0, 1, 1, 2, 4])), rnd.random() < 0.2, rnd.random() < 0.9) for k in range(60)]
        rows += [(100 + k, [f"chain-{k - 1}xyz"] if k else [], [f"chain-{k}xyz"], True, True) for k in range(6)]
        df = spark.createDataFrame(rows, "request_id long, tags array<string>, new_tags array<string>, confirm_new boolean, fine boolean")
        got = {r.request_id: (r.tags, r.tag_reason, r.near) for r in edits.tag_policy_in_order(df, known, aliases).collect()}
        want = tags_in_turn(rows, ["sqlite", "rust-lang"])
        assert got == want
        assert sum(w[1] is None for w in want.values()) > 10 and any(w[2] for w in want.values())


def test_a_tag_often_refused_takes_few_rounds(spark, monkeypatch):
    known = spark.createDataFrame([("python",)], "tag string")
    aliases = spark.createDataFrame([], "start string, resolved string")
    rows = [(k, [], ["pythons"], False, True) for k in range(25)]  # near a known tag
    rows += [(100 + k, ["golang"], ["golang"], True, True) for k in range(25)]  # named as known before it is made
    rows += [(200, [], ["docker"], False, True)] + [(201 + k, [], ["dockers"], False, True) for k in range(25)]  # near a new tag
    rows += [(300, [], ["golang"], False, True), (301, [], ["pythons"], True, True), (302, ["golang"], ["pythons"], False, True)]
    written = []
    stored = edits.stored
    monkeypatch.setattr(edits, "stored", lambda df: written.append(1) or stored(df))
    df = spark.createDataFrame(rows, "request_id long, tags array<string>, new_tags array<string>, confirm_new boolean, fine boolean")
    got = {r.request_id: (r.tags, r.tag_reason, r.near) for r in edits.tag_policy_in_order(df, known, aliases).collect()}
    assert got == tags_in_turn(rows, ["python"])
    assert len(written) < 40


def test_few_tags_meet_that_are_not_near(spark):
    import random

    from quaero.functions import tags as tagfn

    rnd = random.Random(3)
    syllables = ["th", "er", "an", "in", "ti", "en", "ed", "qu", "le", "ou", "tion", "ing"]
    df = spark.createDataFrame([(w,) for w in {"".join(rnd.choices(syllables, k=rnd.choice([3, 4, 5]))) for _ in range(1500)} if len(w) < 15], "tag string")
    met, near = tagfn.meeting(df).distinct().count(), tagfn.near_pairs(df).count() / 2
    assert near <= met < 5 * near


def test_near_pairs_equal_all_pairs(spark):
    import random

    from quaero.functions import tags as tagfn

    rnd = random.Random(8)
    base = ["".join(rnd.choice("abc-") for _ in range(rnd.choice([1, 2, 4, 5, 6, 9, 10, 11, 15, 21, 26]))) for _ in range(60)]
    words = set(base)
    for w in base:
        for edits_ in range(1, 6):
            x = list(w)
            for _ in range(edits_):
                i = rnd.randrange(len(x) + 1)
                x[i : i + rnd.randrange(2)] = rnd.choice(["", "a", "z", "b"])
            words.add("".join(x) or "q")
    df = spark.createDataFrame([(w,) for w in words] + [(None,)], "tag string")
    got = {(r.tag, r.other) for r in tagfn.near_pairs(df).collect()}
    a, b = df.alias("a"), df.alias("b")
    close = (F.replace("a.tag", F.lit("-"), F.lit("")) == F.replace("b.tag", F.lit("-"), F.lit(""))) | (tagfn.similarity(F.col("a.tag"), F.col("b.tag")) >= 0.8)
    want = {tuple(r) for r in a.join(b, (F.col("a.tag") != F.col("b.tag")) & close).select("a.tag", "b.tag").collect()}
    assert got == want and len(want) > 100


def test_annotation_changes(spark):
    old = spark.createDataFrame([("a1", "n", "x", "1", None), ("a2", "n", "y", "1", None)], "id string, note_id string, body string, created string, updated string")
    changes = spark.createDataFrame([("a1", "update", " new ", 1, "2"), ("a2", "delete", None, 2, "2"), ("a9", "update", "z", 3, "2"), ("a1", "update", " ", 4, "3")], "id string, op string, body string, seq int, at string")
    after, bad = edits.apply_annotation_changes(old, changes)
    assert [(r.id, r.body, r.updated) for r in after.collect()] == [("a1", "new", "2")]
    assert {(r.id, r.reason) for r in bad.collect()} == {("a9", "unknown annotation"), ("a1", "annotation is empty")}


NOTE = """---
schema: 1
id: "{id}"
topic: T1
tags: [sqlite, rust]
source:
  agent: codex
  session_id: {session}
  cwd: /p
created: "2026-01-01T08:00:00+08:00"
---
# Title
## 问题

why?

## 结论

because

## 要点

- one
-
- two
"""


def write(root, path, text):
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "wb") as f:
        f.write(text if isinstance(text, bytes) else text.encode())


def test_folder_to_tables_and_sync(spark, tmp_path):
    root = str(tmp_path / "vault")
    write(root, "notes/2026/01/a.md", NOTE.format(id="N1", session=UUID))
    write(root, "notes/2026/01/bad.md", NOTE.format(id="N2", session="no"))
    write(root, "notes/2026/01/plain.md", "no frontmatter")
    write(root, "notes/2026/01/bytes.md", b"---\n\xff\xfe")
    write(root, "topics/t.md", "---\nschema: 1\nid: T1\nlabel: Loading\ncreated: x\n---\n")
    write(root, "tag-aliases/db.yml", "schema: 1\nfrom: db\nto: sqlite\ncreated: x\n")
    write(root, "annotations/N1/a.md", "---\nschema: 1\nid: A1\nnote: N1\ncreated: x\n---\n\n mine \n")
    write(root, ".git/x.md", "ignored")
    empty = spark.createDataFrame([], vault.MANIFEST)
    rows, plan = live.sync(spark, root, empty)
    rows = rows.cache()
    assert {r.action for r in plan.collect()} == {"added"}
    note = vault.notes_table(rows).collect()
    assert len(note) == 1 and note[0].id == "N1" and note[0].title == "Title" and note[0].question == "why?"
    assert note[0].key_points == ["one", "two"] and note[0].tags == ["sqlite", "rust"] and note[0].created_utc.hour == 0
    assert vault.topics_table(rows).first().label == "Loading"
    assert vault.aliases_table(rows).first().to_tag == "sqlite"
    assert vault.annotations_table(rows).first().body == "mine"
    bad = {r.path.split("/")[-1]: r.error for r in vault.invalid_files(rows).collect()}
    assert bad == {"bad.md": "session_id is not a UUID", "plain.md": "missing frontmatter", "bytes.md": "not UTF-8"}

    manifest = spark.createDataFrame(vault.manifest_of(rows).collect(), vault.MANIFEST)
    kept = spark.createDataFrame(rows.collect(), rows.schema)
    rows.unpersist()  # or the rebuild below would read it
    os.remove(os.path.join(root, "topics/t.md"))
    write(root, "notes/2026/01/a.md", NOTE.format(id="N1", session=UUID).replace("because", "changed it"))
    write(root, "notes/2026/02/n.md", NOTE.format(id="N3", session=UUID))
    after, plan = live.sync(spark, root, manifest, kept)
    actions = {r.path.split("/")[-1]: r.action for r in plan.collect()}
    assert actions["t.md"] == "removed" and actions["a.md"] == "updated" and actions["n.md"] == "added" and actions["db.yml"] == "unchanged"
    rebuilt, _ = live.sync(spark, root, empty)
    columns = ["path", "kind", "hash", "error"]
    assert sorted(map(str, after.select(columns).collect())) == sorted(map(str, rebuilt.select(columns).collect()))


def test_json_requests(spark):
    rows = spark.createDataFrame([('{"title": "t", "tags": ["a"]}',), ('{"title": "t", "extra": 1}',), ("broken",)], "value string")
    got = [r.error for r in vault.requests_from_json(rows).collect()]
    assert got == [None, "unknown field: extra", "not a JSON object"]


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    batch = lambda rows, mode: spark.createDataFrame(rows, "id long, topic_id long, created_utc timestamp, t string").coalesce(1).write.mode(mode).parquet(source)
    from datetime import datetime

    batch([(1, 7, datetime(2026, 1, 1), "token = abcdefgh12"), (2, 7, datetime(2026, 1, 2), "x")], "overwrite")
    batch([(3, 7, datetime(2026, 2, 20), "y"), (4, 8, datetime(2026, 2, 21), "z")], "append")
    stream = lambda: spark.readStream.schema("id long, topic_id long, created_utc timestamp, t string").option("maxFilesPerTrigger", 1).parquet(source)

    def run(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name).collect()

    counts = {(r.topic_id, r.id): r.ask_index for r in run(live.running_ask_counts(stream()), "asks")}
    assert sorted(counts[(7, i)] for i in (1, 2, 3)) == [1, 2, 3] and counts[(8, 4)] == 1
    weeks = {r.monday: r.n_notes for r in run(live.running_activity(stream(), "1 day"), "weeks")}
    assert weeks.get("2025-12-29") == 2
    assert "token = [REDACTED:secret]" in {r.t for r in run(live.redacted_stream(stream(), ["t"]), "safe")}


def test_search_in_blocks(spark, monkeypatch):
    notes = spark.createDataFrame([(i, f"title {i % 7}", f"ask {'abcdefg'[i % 5] * 3}", None, 1, i) for i in range(30)], "id long, title string, question string, conclusion string, topic_id long, created_s long")
    queries = spark.createDataFrame([(k, q) for k, q in enumerate(["aaa", "bbb title", "6", "", "ask ccc", "none", "title ask", "5"])], "query_id long, query string")
    run = lambda: (sorted(map(str, search.substring_matches(queries, notes).select("query_id", "id").collect())), sorted(map(str, search.bm25_search(queries, notes).collect())))
    whole = run()
    assert whole[0] and whole[1]
    monkeypatch.setattr(search, "QUERY_BLOCK", 3)
    assert run() == whole


def test_short_pieces_are_a_further_condition(spark):
    notes = spark.createDataFrame([(1, "Parquet go", "how", "body"), (2, "Parquet", "go", "body"), (3, "parquet", None, "We GO on \\\\E aaaa"), (4, "go", "x", None)], "id long, title string, question string, conclusion string").selectExpr("*", "id AS created_s")
    queries = spark.createDataFrame([(1, "parquet go"), (2, "go"), (3, "PARQUET"), (4, ""), (5, "\\\\E aa aaa"), (6, "zzzq go"), (7, "arquet pARQ")], "query_id long, query string")
    got = sorted((r.query_id, r.id) for r in search.substring_matches(queries, notes).collect())
    assert got == [(1, 1), (1, 3), (2, 1), (2, 3), (2, 4), (3, 1), (3, 2), (3, 3), (4, 1), (4, 2), (4, 3), (4, 4), (5, 3), (7, 1), (7, 2), (7, 3)]
    hits = {(r.piece, r.id): r.tf for r in search.piece_hits(spark.createDataFrame([("aaa",), ("\\\\e",), ("go o",)], "piece string"), notes).collect()}
    assert hits == {("aaa", 3): 2.0, ("go o", 3): 1.0} or hits == {("aaa", 3): 2.0, ("\\\\e", 3): 1.0, ("go o", 3): 1.0}
    assert search.bm25_search(queries.where("query_id < 0"), notes).count() == 0 and search.bm25_search(queries, notes.where("id < 0")).count() == 0


def in_turn(edges):
    """at -> ends and acceptance, request by request."""
    top, out = {}, {}

    def root(x):
        path = []
        while x in top:
            path.append(x)
            x = top[x]
        top.update(dict.fromkeys(path, x))
        return x

    for at, x, y in sorted(edges):
        a, b = root(x), root(y)
        out[at] = (a, b, a != b)
        if a != b:
            top[a] = b
    return out


def test_merges_in_rounds_equal_one_by_one(spark):
    import random

    from quaero.operators import forest

    for kind in range(6):
        rnd = random.Random(kind)
        n = 120
        ends = {
            0: [(k, k + 1) for k in range(n)],  # a path in order
            1: [(k + 1, k) for k in range(n)][::-1],
            2: rnd.sample([(k, k + 1) if rnd.random() < 0.5 else (k + 1, k) for k in range(n)], n),
            3: [(rnd.randrange(60), rnd.randrange(60)) for _ in range(200)],
            4: [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)],
            5: [(k, k) for k in range(5)] * 2 + [(0, k) for k in range(1, 60)] + [(k, 0) for k in range(30, 90)],
        }[kind]
        edges = [(10 * k, x, y) for k, (x, y) in enumerate(ends)]
        got = {r["at"]: (r.from_id, r.into_id, r.accepted) for r in forest.merged_in_turn(spark.createDataFrame(edges, "at long, x long, y long")).collect()}
        assert got == in_turn(edges), kind
    same = spark.createDataFrame([(1, "a", "a"), (2, "a", "a")], "at long, x string, y string")
    assert [(r.from_id, r.into_id, r.accepted) for r in forest.merged_in_turn(same).collect()] == [("a", "a", False)] * 2
    assert forest.merged_in_turn(same.limit(0)).isEmpty()


def test_merges_apply_in_turn(spark):
    import random

    rnd = random.Random(2)
    asked = [(1, "a", "b"), (2, "c", "a"), (3, "b", "c"), (4, "q", "p"), (9, "p", "q"), (5, "w", "x"), (8, "x", "y"), (6, "y", "z"), (7, "z", "w"), (10, "in", "a"), (11, "s", "s"), (12, "a", "q"), (13, "gone", "a"), (14, "a", "gone"), (15, "u", "gone"), (16, "u", "v")]
    asked += [(100 + k, f"n{rnd.randrange(40)}", f"n{rnd.randrange(40)}") for k in range(60)]
    edges = {"old": "b", "n3": "n4"}
    names = ({x for r in asked for x in r[1:]} | {"old"}) - {"gone"}
    top, expected = dict(edges), {}

    def root(x):
        while x in top:
            x = top[x]
        return x

    for seq, source, target in sorted(asked + [(20, "old", "in")]):
        if source not in names or target not in names:
            expected[seq] = ("unknown source" if source not in names else "unknown target",)
            continue
        a, b = root(source), root(target)
        expected[seq] = (a, b, "same topic" if a == b else None)
        if a != b:
            top[a] = b
    requests = spark.createDataFrame(asked + [(20, "old", "in")], "seq long, source string, target string")
    chains = spark.createDataFrame(list(edges.items()), "start string, resolved string")
    got = {r.seq: r for r in edits.merge_topics(requests, spark.createDataFrame([(t,) for t in names], "id string"), chains).collect()}
    assert got.keys() == expected.keys()
    for seq, want in expected.items():
        assert (want == (got[seq].reason,)) if len(want) == 1 else want == (got[seq].from_id, got[seq].into_id, got[seq].reason), seq
    assert [got[k].reason for k in (3, 7, 8, 9, 14, 15, 16)] == ["same topic", None, "same topic", "same topic", "unknown target", "unknown target", None]



def test_change_sums_follow_the_set_of_keys(spark):
    from quaero.operators import vectors

    rows = [(1, 10), (1, 11), (2, 11), (2, 10), (3, 10), (3, 12), (4, None), (None, 10)]
    out = {r.topic_id: r.signature for r in vectors.change_sums(spark.createDataFrame(rows, "topic_id long, id long")).collect()}
    assert out[1] == out[2] != out[3]
    assert out[4] == "1-0-0-0-0" and len(out) == 5
    assert vectors.change_sums(spark.createDataFrame([], "topic_id long, id long")).isEmpty()


def test_recalled_notes_are_the_topics_of_recalled_topics(spark):
    from quaero.operators import search

    notes = spark.createDataFrame([(1, "red fox", "red fox", "", 7, 5), (2, "blue", "blue", "", 7, 4), (3, "green", "green", "", 8, 3)], "id long, title string, question string, conclusion string, topic_id long, created_s long")
    ranking = search.keyword_recall(spark.createDataFrame([(1, "red fox"), (2, "fox")], "query_id long, query string"), notes)
    assert sorted(map(tuple, search.recalled_notes(ranking, notes).collect())) == [(7, 1, 2), (7, 2, 1)]


def test_watched_folder_wakes_once_per_batch_of_new_files(spark, tmp_path):
    root = tmp_path / "box"
    (root / "notes").mkdir(parents=True)
    seen = []

    def wake():
        query = live.sync_on_change(spark, str(root), seen.append, str(tmp_path / "state"))
        query.awaitTermination()

    (root / "notes" / "one.md").write_text("first")
    wake()
    wake()  # nothing new
    assert len(seen) == 1
    (root / "notes" / "two.md").write_text("second")
    wake()
    assert len(seen) == 2 and seen == sorted(set(seen))
    assert live.watched(spark, str(root)).isStreaming
