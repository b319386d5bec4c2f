"""Operators 11, 12 and 13 against brute force on small fixtures, and held-out accuracy."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from quaero.llm import hard_negatives as H
from quaero.llm import lang_id, queries, spelling

from ..conftest import SMALL


def variants(docs):
    """The contract, word by word."""
    seen = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{word}".encode())
            if h % 97 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            seen[word] += 1
    n = {w: c for w, c in seen.items() if len(w) >= 5 and c >= 3}
    near = defaultdict(set)
    holes = defaultdict(set)
    for w in n:
        for i in range(len(w)):
            holes[i, w[:i], w[i + 1 :]].add(w)
            if (shorter := w[:i] + w[i + 1 :]) in n:
                near[w].add(shorter)
                near[shorter].add(w)
    for same in holes.values():
        for w in same:
            near[w] |= same - {w}
    form = {w: min(near[w], key=lambda x: (-n[x], x)) for w in n if near[w]}
    form = {w: f for w, f in form.items() if n[f] >= 2 * n[w]}
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n[form[w]] if w in form else None))
    return out


def typo(rnd, word, letters):
    i, kind = rnd.randrange(len(word) + 1), rnd.randrange(3)
    return word[:i] + (rnd.choice(letters) if kind else "") + word[i + (kind != 1) :]


@pytest.mark.parametrize("limit", [spelling.GROUP, 2, 7])
def test_spelling_variants_equal_brute_force(spark, limit):
    rnd = random.Random(limit)
    docs = [(None, None), (0, ""), (0, "12 --"), (1, "aaaaa AAAAA aaaaaa aaaaaaa aaaaaaaa " * 3), (2, "École école ÉCOLE Éçole×÷ " * 5)]
    base = ["".join(rnd.choice("abé") for _ in range(rnd.randrange(4, 11))) for _ in range(60)]
    words = base + [typo(rnd, w, "abcÿ") for w in base for _ in range(5)]
    docs += [(k, " ".join(rnd.choices(words, [1 / (i + 1) for i in range(len(words))], k=200))) for k in range(30)]
    docs += [(None, docs[-1][1]), docs[-1], (5, "x" * 300 + " " + "x" * 150 + "y" + "x" * 150 + " " + "x" * 299), (6, docs[-1][1])] * 3
    df = spark.createDataFrame([(k, t, "w", 1) for k, t in docs], "doc_id long, text string, word string, n long")
    got = [tuple(r) for r in spelling.spelling_variants(df, limit=limit).collect()]
    want = variants(docs)
    assert set(got) == want and len(got) == len(want)
    assert sum(1 for r in want if r[1] and r[2] != r[1]) > 0


def test_large_groups_use_the_column_built_index():
    rnd = random.Random(1)
    words = list({"pre" + "".join(rnd.choice("abcd") for _ in range(rnd.choice([4, 5]))) + "post" for _ in range(900)})
    counts = [rnd.randrange(3, 50) for _ in words]
    got = {r[0]: r[2:] for r in spelling.near_in_group(3, 7, "prepost", words, counts)}
    by = dict(zip(words, counts, strict=True))
    for w in words:
        others = [x for x in words if x != w and abs(len(x) - len(w)) <= 1 and min(len(x), len(w)) == 11 and one_edit(w, x)]
        # Words that agree up to the window's end belong to the next window.
        others = [x for x in others if not (len(x) != len(w) and min(x, w, key=len)[:7] == max(x, w, key=len)[:7])]
        if len(w) == 11 or others:
            best = min(others, key=lambda x: (-by[x], x), default=None)
            assert got.get(w) == ((len(others), best, by[best]) if others else None)


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def test_spelling_variants_of_the_small_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert {tuple(r) for r in queries.op11_spelling_variants(spark, SMALL).collect()} == variants(docs)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.spelling_variants(empty).isEmpty()


def mined(rows, is_anchor):
    rows = [(k, i, y, [math.floor(256 * x) for x in v]) for k, (i, y, v) in enumerate(rows) if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for k, i, y, v in rows:
        if not is_anchor(i):
            continue
        scored = sorted((-dot(v, w), j, m, z) for m, j, z, w in rows if m != k)
        for p in [s for s in scored if s[3] == y][:5]:
            fit = [s for s in scored if s[3] != y and 50 * -p[0] <= 100 * -s[0] <= 95 * -p[0]][:3]
            out += [(i, p[1], r, s[1], -p[0], -s[0]) for r, s in enumerate(fit, 1)]
    return sorted(out)


@pytest.mark.parametrize("shape", ["sphere", "lengths", "copies", "large"])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, shape):
    monkeypatch.setattr(H, "BUCKET", 64)
    monkeypatch.setattr(H, "BLOCK_BYTES", 2000)
    rnd = np.random.default_rng(3)
    v = rnd.normal(size=(400, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    if shape == "lengths":
        v *= np.exp(rnd.normal(size=(400, 1)) * 1.5)
    if shape == "copies":
        v[rnd.random(400) < 0.4] = v[0]
    if shape == "large":
        v *= 3000
    rows = [(i, int(rnd.integers(4)), x.tolist()) for i, x in enumerate(v)]
    rows += [(7, 1, None), (None, 1, [1.0] * 8), (9, None, [1.0] * 8), (10, 1, [math.nan] * 8), (10, 1, [None] + [1.0] * 7), (10, 1, [math.inf] * 8), (20, 2, [0.0] * 8), (20, 2, [0.5, 0.5]), (30, 1, []), (40, 0, v[40].tolist()), (40, 0, v[40].tolist())]
    df = spark.createDataFrame([(i, y, x, "s", 0) for i, y, x in rows], "id long, label int, embedding array<double>, score string, rank int")
    import pyspark.sql.functions as F

    got = sorted(tuple(r) for r in H.hard_negatives(df, F.col("id") % 10 == 0).collect())
    want = mined(rows, lambda i: i % 10 == 0)
    assert got == want and len(want) > 100
    assert H.hard_negatives(df.limit(0), F.col("id") % 10 == 0).isEmpty()


def test_short_ranges_are_sifted_and_exact():
    """With skewed lengths and high bounds the sorted lists leave few candidates, and none that counts is missed."""
    rnd = np.random.default_rng(5)
    parts = (rnd.normal(size=(2000, 16)) * 100).astype(np.int64)
    parts[:, 0] += rnd.integers(0, 4000, 2000)
    table = pa.table({"row_key": np.arange(2000), "id": np.arange(2000), "label": np.zeros(2000, np.int64), "length": np.sqrt((parts**2).sum(1).astype(float)), "parts": pa.array(parts.tolist(), pa.list_(pa.int64()))}).combine_chunks()
    batch = table.to_batches()[0]
    bucket, anchors = H.Bucket(batch, 16), H.Vectors(batch.slice(0, 50), 16)
    exact = anchors.parts @ bucket.parts.T
    least = np.sort(exact, axis=1)[:, -5]
    looked, found = 0, set()
    for a, rows, scores in bucket.search(anchors, H._focus(anchors), np.arange(50), least):
        looked += len(rows)
        assert (scores == exact[a, rows]).all()
        found |= set(zip(a[scores >= least[a]].tolist(), rows[scores >= least[a]].tolist(), strict=True))
    assert found == {(a, r) for a, r in zip(*np.nonzero(exact >= least[:, None]), strict=True)}
    assert looked < exact.size / 2


def test_hard_negatives_of_the_small_table(spark):
    rows = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    assert sorted(tuple(r) for r in queries.op13_hard_negatives(spark, SMALL).collect()) == mined(rows, lambda i: i % 50 == 0)


def test_language_id_on_held_out_rows(spark):
    found = queries.op12_language_id(spark, "/root/testdata/sf0.01").collect()
    true = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert len(found) == len(true)
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    held = [r for r in found if r.held_out and r.lang_pred != "und"]
    right = sum(r.lang_pred == true[r.doc_id] for r in held) / len(held)
    accepted = [r for r in held if r.accepted]
    assert right > 0.95, right
    assert len(accepted) > 0.8 * len(held) and sum(r.lang_pred == true[r.doc_id] for r in accepted) / len(accepted) >= 0.99


def test_language_id_of_odd_rows(spark):
    rnd = random.Random(2)
    words = {"x": "alpha beta gamma delta".split(), "y": "uno dos tres cuatro".split()}
    docs = [(k, " ".join(rnd.choices(words["xy"[k % 2]], k=rnd.choice([3, 30, 3000]))), "xy"[k % 2]) for k in range(300)]
    odd = [(None, None, "x"), (1000, "", "y"), (1001, "12 !", None), (1002, "alpha beta", None), (None, "dos tres", None), (1002, "alpha beta", None), (1003, "ab" * 3_000_000, None), (1004, "beta " * 1_000_000, None)]
    df = spark.createDataFrame([(*r, 0.5, True) for r in docs + odd], "doc_id long, text string, lang string, score double, accepted boolean")
    got = defaultdict(list)
    for r in lang_id.language_id(df).collect():
        got[r.doc_id].append(r)
    assert all(r.lang_pred == "xy"[k % 2] for k in range(300) for r in got[k])
    assert {r.lang_pred for r in got[None]} == {"und", "y"} and len(got[None]) == 2
    assert [r.lang_pred for r in got[1000] + got[1001]] == ["und", "und"] and got[1000][0].score == 0
    assert [r.lang_pred for r in got[1002]] == ["x", "x"] and got[1004][0].lang_pred == "x" and len(got[1003]) == 1
    bare = lang_id.language_id(df.withColumn("lang", df.lang.substr(9, 1)).where("lang IS NULL"))
    assert {r.lang_pred for r in bare.collect()} == {"und"}
    assert lang_id.language_id(df.limit(0)).isEmpty()


def test_whole_texts_count():
    """The average over a text is over all its words, in whatever chunks they come."""
    table = np.zeros((lang_id.BUCKETS, 2))
    ids, _ = lang_id.subwords([b"uno"])
    table[ids, 1] = 1.0
    model = lang_id.Identifier(("a", "b"), table, np.zeros(2))
    one, two = model.logits(pa.array(["uno " * 5000 + "zwei", "uno " * 10 + "zwei " * 100000]))
    assert one[1] > 0.9 > 0.1 > two[1]
