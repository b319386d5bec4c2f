"""Searches by the words that hold a piece against contains() over all pairs."""

import math
import random

from pyspark.sql import functions as F

from quaero.operators import search

NOTES = "id long, title string, question string, conclusion string, created_s long"


def made(spark, n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abÄß.") for _ in range(rng.choice([1, 2, 3, 4, 9, 30])))
    text = lambda k: rng.choice([" ", "\n", "\t "]).join(word() for _ in range(rng.randrange(k)))
    notes = [(i, text(3), text(6), rng.choice([None, text(30)]), rng.randrange(9)) for i in range(n)]
    some = " ".join(str(x) for r in notes for x in r[1:4] if x).split()
    cut = lambda w: w[(a := rng.randrange(len(w))) : a + rng.choice([3, 4, 6, 40])]
    asked = [(q, " ".join(cut(rng.choice(some)).upper() for _ in range(rng.choice([1, 1, 2, 3])))) for q in range(60)]
    return spark.createDataFrame(notes, NOTES), spark.createDataFrame([*asked, (99, "absent Ä"), (98, None)], "query_id long, query string")


def holds(notes, queries):
    low = lambda s: (s or "").lower()
    ascii_ = lambda s: "".join(c.lower() if c < "\x80" else c for c in s or "")
    out = []
    for q in queries:
        for n in notes:
            parts = (q.query or "\0" * 3).split()
            if all(any(low(p) in low(n[c]) for c in ("title", "question", "conclusion")) if len(p) >= 3 else any(ascii_(p) in ascii_(n[c]) for c in ("title", "conclusion")) for p in parts):
                out.append((q.query_id, n.id))
    return sorted(out)


def test_words_lose_no_match(spark, monkeypatch):
    monkeypatch.setattr(search, "KEY", 4)
    monkeypatch.setattr(search, "WINDOW", 8)
    notes, queries = made(spark, 120, 3)
    want = holds(notes.collect(), queries.where("query IS NOT NULL").collect())
    found = search.substring_matches(queries.where("query IS NOT NULL"), notes)
    assert found.columns == [*notes.columns, "query_id", "n_long"] or set(found.columns) == {*notes.columns, "query_id", "n_long"}
    assert sorted((r.query_id, r.id) for r in found.collect()) == want and len(want) > 60


def test_frequency_counts_each_note_once(spark):
    notes = spark.createDataFrame([(1, "catalog cat", "concat", "cat"), (2, "dog", "scatter", None), (3, "x", "", "")], "id long, title string, question string, conclusion string")
    words = search.note_words(notes)
    asked = spark.createDataFrame([("cat",), ("dog",), ("catalog",), ("bird",)], "piece string")
    held = search._holders(asked, words)
    assert {(r.piece, r.n_with) for r in search._frequency(asked, words, held).collect()} == {("cat", 2), ("dog", 1), ("catalog", 1)}


def test_a_common_piece_is_not_looked_for_in_every_note(spark):
    """All notes hold the first piece; only those that can hold the rarest one are read for a query."""
    notes = spark.createDataFrame([(i, "the common", f"note{i:03d}", "", i) for i in range(200)], NOTES)
    queries = notes.select(F.col("id").alias("query_id"), F.concat_ws(" ", "title", "question").alias("query"))
    words = search.note_words(notes)
    each = search._asked_pieces(queries)
    rarest = search._rarest(each, search._holders(each, words))
    assert {(r.query_id, r.piece) for r in rarest.collect()} == {(i, f"note{i:03d}") for i in range(200)}
    assert search.bm25_search(queries, notes).count() == 200


def test_rankings_of_repeated_queries_and_of_pieces_that_overlap_themselves(spark, monkeypatch):
    """Against BM25 in plain Python; equal queries are looked for once, and a limit leaves the same first notes."""
    rng = random.Random(5)
    text = lambda k: " ".join("".join(rng.choice("aaÄb.") for _ in range(rng.choice([2, 3, 5, 8]))) for _ in range(rng.randrange(k)))
    notes = [(i, text(4), text(6), rng.choice([None, text(12)]), rng.randrange(9)) for i in range(80)]
    asked = ["aaa", "aba aaa", "ÄÄ aÄa", "b.a", "aab aab", "aaaa a", "ab", "a."] * 3
    queries = [(q, s.upper() if q % 2 else s) for q, s in enumerate(asked)]
    low = [[(s or "").lower() for s in n[1:4]] for n in notes]
    size = [sum(max(0, len(s) - 2) for s in f) for f in low]
    hits = lambda s, p: sum(s.startswith(p, i) for i in range(len(s)))
    want = []
    for q, s in queries:
        long, short = [p for p in s.lower().split() if len(p) >= 3], [p for p in s.split() if len(p) < 3]
        ascii_ = lambda x: "".join(c.lower() if c < "\x80" else c for c in x or "")
        found = [k for k in range(80) if all(any(p in f for f in low[k]) for p in long) and all(ascii_(p) in ascii_(notes[k][1]) or ascii_(p) in ascii_(notes[k][3]) for p in short)]
        rows = []
        for k in found:
            score = 0.0
            for p in long:
                n, tf = sum(any(p in f for f in x) for x in low), sum(w * hits(f, p) for w, f in zip((3, 2, 1), low[k]))
                score += max(1e-6, math.log((80 - n + 0.5) / (n + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size[k] / (sum(size) / 80)))
            rows.append((-round(score, 6), -notes[k][4] if not long else 0, k))
        want += [(q, r, k, -x) for r, (x, _, k) in enumerate(sorted(rows), 1)]
    looked, whole = [], search._matches
    monkeypatch.setattr(search, "_matches", lambda parts, *a: (looked.append(parts.count()), whole(parts, *a))[1])
    n, q = spark.createDataFrame(notes, NOTES), spark.createDataFrame(queries, "query_id long, query string")
    got = sorted((r.query_id, r.rank, r.id, r.score) for r in search.bm25_ranking(q, n).collect())
    assert [g[:3] for g in got] == [w[:3] for w in want] and all(abs(g[3] - w[3]) < 2e-6 for g, w in zip(got, want)) and len(want) > 300
    assert looked == [len({tuple(p.lower() if len(p) >= 3 else p for p in s.split()) for _, s in queries})] and looked[0] < len(queries)
    assert sorted((r.query_id, r.rank, r.id, r.score) for r in search.bm25_search(q, n, 3).collect()) == [g for g in got if g[1] <= 3]
