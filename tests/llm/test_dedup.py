"""Operators 1, 5 and 9 against brute force on small fixtures."""

import hashlib
import itertools
import random

import numpy as np
import pytest

from quaero.llm import decontaminate, near_dedup, suffix_dedup

from ..conftest import SMALL


def words(rnd, n):
    return " ".join(rnd.choice("alpha beta gamma delta eps zeta eta theta iota kappa la mu nu xi omi pi rho sig tau ups phi chi psi ome".split()) + str(rnd.randrange(40)) for _ in range(n))


def edited(rnd, text, n):
    out = text.split(" ")
    for k in rnd.sample(range(len(out)), n):
        out[k] = f"new{rnd.randrange(10**6)}"
    return " ".join(out)


def classes(texts):
    """Components of exact Jaccard 0.8 on 5-word shingles, and of equal texts."""
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    top = list(range(len(texts)))

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if (texts[i] or "") == (texts[j] or "") or both and both / len(sets[i] | sets[j]) >= 0.8:
                a, b = root(i), root(j)
                top[max(a, b)] = min(a, b)
    return {i: root(i) for i in range(len(texts))}


@pytest.mark.parametrize("block", [near_dedup.BLOCK, 3])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rnd = random.Random(4)
    base = [words(rnd, rnd.choice([6, 30, 90, 200])) for _ in range(25)]
    texts = [None, "", "  ", "one", "one", "two words", "Two Words"]
    for t in base:
        texts += [t, t] + [edited(rnd, t, k) for k in (1, 1, 2, 3) if len(t.split()) > 10 * k]
    group = words(rnd, 150)
    texts += [edited(rnd, group, 1) for _ in range(40)] + [edited(rnd, group, 2) for _ in range(40)]
    texts.append(" ".join([words(rnd, 8)] * 300))
    docs = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)], "doc_id long, text string, node long")
    got = {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()}
    assert got == classes(texts)


def test_near_duplicates_of_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert near_dedup.near_duplicates(empty).count() == 0
    rows = spark.createDataFrame([(None, "a b"), (5, "a b"), (5, "a b"), (3, "a b")], "doc_id long, text string")
    assert sorted(map(str, ((r.doc_id, r.class_id) for r in near_dedup.near_duplicates(rows).collect()))) == ["(3, 3)", "(5, 3)", "(5, 3)", "(None, None)"]


def test_dart_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    a, b = {k: float(w) for k, w in enumerate(rng.uniform(0.2, 4, 80))}, {}
    b = {k: w * float(rng.uniform(0.7, 1.3)) for k, w in a.items() if k > 8} | {1000 + k: 1.0 for k in range(10)}
    keys = set(a) | set(b)
    true = sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)
    rows = np.array([0] * len(a) + [1] * len(b))
    elements = near_dedup.mix(np.array([*a, *b], np.uint64) + np.uint64(12345))
    signs = near_dedup.dart_signatures(rows, elements, np.array([*a.values(), *b.values()]), 3, 2048)
    assert abs((signs[0] == signs[1]).mean() - true) < 0.05
    assert not signs[2].any()


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7)]
    got = {r.node: r.component for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {k: 100 for k in range(100, 160)}


def without(texts, width=400):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for d, x in enumerate(data):
        for i in range(len(x) - width + 1):
            seen.setdefault(x[i : i + width], []).append((d, i))
    out = []
    for d, x in enumerate(data):
        gone = bytearray(len(x))
        for i in range(len(x) - width + 1):
            if len(seen[x[i : i + width]]) > 1:
                gone[i : i + width] = b"\1" * width
        kept = bytes(b for b, g in zip(x, gone, strict=True) if not g)
        runs = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((len(x), sum(gone), runs, hashlib.sha256(kept).hexdigest()))
    return out


def repeats():
    rnd = random.Random(9)
    passage, other = words(rnd, 90), words(rnd, 120)
    texts = [None, "", "short", "é" * 390, "ab" * 700, "For " * 400, "x" * 401]
    for k in range(12):
        cut = passage[k * 3 : 480 + k * 11]
        texts.append(words(rnd, 30) + cut + words(rnd, rnd.randrange(5, 60)) + (other if k % 3 else "") + words(rnd, 5))
    whole = words(rnd, 300)
    return texts + [whole, whole, edited(rnd, whole, 3), words(rnd, 200), passage[:399], passage[:400], passage[5:405]]


@pytest.mark.parametrize("gathered", [suffix_dedup.GATHERED, 3, 0])
def test_repeats_equal_brute_force(spark, gathered):
    texts = repeats()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.without_repeats(docs, gathered=gathered).collect()}
    expected = without(texts)
    for i in range(len(texts)):
        assert got[i] == expected[i], (i, texts[i] and texts[i][:60])


def test_planted_passages_go_from_400_bytes_on(spark):
    """Passages of over 50 words in several documents: n_removed and the text tell what went, n_bytes is the input's size."""
    rnd = random.Random(12)
    long, short = words(rnd, 80), words(rnd, 52)
    assert len(short) < 400 <= len(long)
    texts = [f"{words(rnd, 40)} <{k}> {passage} <{k}> {words(rnd, 40 + k)}" for passage in (long, short) for k in range(6)]
    texts += [words(rnd, 150) for _ in range(6)]
    rows = sorted(suffix_dedup.without_repeats(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect())
    assert [r.n_bytes for r in rows] == [len(t) for t in texts]
    assert [r.n_removed > 0 for r in rows] == [True] * 6 + [False] * 12
    assert all(long not in r.text for r in rows) and all(r.text == t for r, t in zip(rows[6:], texts[6:], strict=True))
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows] == without(texts)


def test_a_frequent_context_is_dealt_into_parts(spark):
    line = words(random.Random(13), 90)[:400]
    rows = spark.createDataFrame([(k // 2, k // 2, line) for k in range(80)], "row_id long, row_key long, text string").repartition(16)
    bits = spark.sparkContext.broadcast(suffix_dedup.packed(np.ones(1 << suffix_dedup.SLOT_BITS, bool)))
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spans = suffix_dedup._counted(suffix_dedup._contexts(rows, bits), 3)
        found = spans.withColumn("task", suffix_dedup.F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(r[:4] for r in found) == sorted((k // 2, k // 2, 0, 400) for k in range(80))
    assert len({r.task for r in found}) > 2


def test_repeats_of_odd_tables(spark):
    assert suffix_dedup.without_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    text = words(random.Random(1), 100)
    rows = spark.createDataFrame([(1, text), (1, text), (None, text + "tail")], "doc_id long, text string")
    got = sorted((r.n_bytes, r.n_removed) for r in suffix_dedup.without_repeats(rows).collect())
    assert [b - g for b, g in got] == [0, 0, 4]


def test_deep_shallow_sorts():
    rnd = random.Random(2)
    for n in (1, 2, 3, 50, 200):
        strings = [("abc" * rnd.randrange(1, 12) + "".join(rnd.choice("ab") for _ in range(rnd.randrange(30)))).encode() for _ in range(n)]
        order, same = suffix_dedup.deep_shallow(strings)
        assert [strings[i] for i in order] == sorted(strings)
        for k in range(1, n):
            assert same[k] == suffix_dedup.common(strings[order[k - 1]], strings[order[k]])


def test_contamination(spark):
    rnd = random.Random(6)
    items = [(k, words(rnd, rnd.randrange(14, 50))) for k in range(20)] + [(50, "just four short words"), (51, "these six words make an item"), (52, None), (None, words(rnd, 20))]
    texts, expected = [None, "", words(rnd, 100)], {}
    for k, t in items[:20]:
        expected[len(texts)] = [k]
        texts.append(words(rnd, 40) + "\n" + t.upper() + ", " + words(rnd, 40))
        changed = t.split()
        for p in range(3, len(changed), 9):  # one word in nine substituted
            changed[p] = "other"
        expected[len(texts)] = [k]
        texts.append(words(rnd, 10) + " " + " ".join(changed))
        texts.append(words(rnd, 30) + " " + " ".join(t.split()[:6]) + " " + words(rnd, 30))
    expected[len(texts)] = [51]
    texts.append("here these six words make an item too")
    texts.append("just four short words")
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, seed string")
    bench = spark.createDataFrame([(k, t, 1) for k, t in items], "item_id long, text string, place int")
    got = {r.doc_id: list(r.item_ids) for r in decontaminate.contaminated(docs, bench).collect()}
    assert got == expected


def test_masks_meet_every_accepted_overlap():
    lost = []
    for n in range(decontaminate.LEAST_WORDS, decontaminate.STRETCH + 1):
        masks = [m for m, _, fitting in decontaminate._masks({n}) if fitting(np.array([n]))[0]]
        most = max(d for d in range(n) if (n - d) / n >= decontaminate.SHARE)
        for gone in itertools.combinations(range(n), most):
            if not any(set(gone).isdisjoint({at + k for k in m}) for m in masks for at in range(n - max(m))):
                lost.append((n, gone))
    assert lost == []


def test_contamination_with_substituted_words(spark):
    items, texts, rnd = [], [], random.Random(8)
    for n, gone in ((5, (2,)), (6, (3,)), (7, (0,)), (8, (5,)), (10, (1, 2)), (12, (3, 5)), (15, (3, 7, 11)), (16, (3, 7, 11))):
        own = [f"w{n}x{k}" for k in range(n)]
        items.append((n, " ".join(own)))
        texts.append((n, words(rnd, 20) + " " + " ".join("other" if k in gone else w for k, w in enumerate(own)) + " " + words(rnd, 20)))
    got = decontaminate.contaminated(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((r.doc_id, list(r.item_ids)) for r in got) == [(n, [n]) for n, _ in items]


def test_contamination_of_empty_tables(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    assert decontaminate.contaminated(docs.where("doc_id < 0"), bench).count() == 0
    assert decontaminate.contaminated(docs, bench.where("item_id < 0")).count() == 0


def test_contamination_by_salted_join(spark, monkeypatch):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    bench = spark.read.parquet(f"{SMALL}/benchmark.parquet")
    plain = sorted(map(str, decontaminate.contaminated(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", 0)
    assert sorted(map(str, decontaminate.contaminated(docs, bench).collect())) == plain


def test_contaminated_equals_brute_force_and_names_rows_without_ids(spark):
    rnd = random.Random(21)
    vocabulary = [f"v{k}" for k in range(300)]
    items = [(k, " ".join(rnd.choices(vocabulary, k=rnd.choice([5, 6, 7, 8, 9, 11, 16, 17, 30])))) for k in range(60)]
    docs = []
    for k in range(160):
        body = rnd.choices(vocabulary, k=rnd.randrange(0, 80))
        if k % 2:
            words_ = rnd.choice(items)[1].split()
            for at in rnd.sample(range(len(words_)), min(len(words_), rnd.randrange(0, 5))):
                words_[at] = rnd.choice(vocabulary)
            a = rnd.choice([0, 0, len(words_) // 3])
            at = rnd.randrange(len(body) + 1)
            body[at:at] = words_[a:]
        docs.append((k if k % 7 else None, " ".join(body)))
    docs += docs[1:3]
    expected = set()
    for key, text in docs:
        t = text.split()
        found = []
        for name, item in items:
            i = item.split()
            size = min(16, len(i))
            for d in range(-len(i), len(t) + 1):
                same = [0 <= k + d < len(t) and t[k + d] == w for k, w in enumerate(i)]
                if any(sum(same[k : k + size]) >= 0.8 * size for k in range(len(i) - size + 1)):
                    found.append(name)
                    break
        if found:
            expected.add((key, tuple(sorted(found)), text))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got = decontaminate.contaminated_rows(table, spark.createDataFrame(items, "item_id long, text string"))
    text_of = {r.k: r.text for r in table.select(near_dedup.F.expr("xxhash64(doc_id IS NULL, doc_id, text)").alias("k"), "text").collect()}
    rows = [(r.doc_id, tuple(r.item_ids), text_of[r.row_key]) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == expected
    assert len(expected) > 25 and any(k is None for k, _, _ in expected)


def test_repeated_ids_with_other_texts_stay_apart(spark):
    rnd = random.Random(6)
    a, b = words(rnd, 60), words(rnd, 60)
    rows = spark.createDataFrame([(1, a), (1, b), (2, a), (3, b + " end"), (4, "alone"), (None, a)], "doc_id long, text string").repartition(3)
    assert sorted(((r.doc_id is None, r.doc_id or 0, r.class_id or 0) for r in near_dedup.near_duplicates(rows).collect())) == [(False, 1, 1), (False, 1, 1), (False, 2, 1), (False, 3, 1), (False, 4, 4), (True, 0, 0)]


def test_weighted_classes_go_by_occurrences(spark):
    rnd = random.Random(8)
    line, tail = words(rnd, 12), words(rnd, 30)
    texts = [line + " " + tail, " ".join([line] * 30) + " " + tail, " ".join([line] * 29) + " " + tail, " ".join([line] * 28) + " other " + tail]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def shares(t):
        w = t.split()
        out = {}
        for i in range(len(w) - 4):
            out[tuple(w[i : i + 5])] = out.get(tuple(w[i : i + 5]), 0) + 1
        return out

    top = list(range(4))
    for i, j in itertools.combinations(range(4), 2):
        x, y = shares(texts[i]), shares(texts[j])
        both = sum(min(x.get(k, 0), y.get(k, 0)) for k in x)
        if both / (sum(x.values()) + sum(y.values()) - both) >= 0.8:
            top[j] = top[i]
    assert {r.doc_id: r.class_id for r in near_dedup.near_duplicates(rows, weighted=True).collect()} == dict(enumerate(top)) == {0: 0, 1: 1, 2: 1, 3: 1}


def test_long_texts_fall_into_overlapping_parts(spark, monkeypatch):
    rnd = random.Random(3)
    passage = words(rnd, 100)
    texts = [words(rnd, 300) + passage + words(rnd, 200), words(rnd, 700) + passage[50:] + words(rnd, 9), passage, words(rnd, 50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for part in (1000, 1399, 5000):
        data, starts, sizes = suffix_dedup._bytes_of(suffix_dedup.pa.array(texts))
        whole = suffix_dedup.windows(data, starts, sizes)
        monkeypatch.setattr(suffix_dedup, "PART", part)
        parts = suffix_dedup.windows(data, starts, sizes)
        assert {(d, a, k) for d, a, f, e, _ in zip(*whole) for k in range(f, e + 1)} == {(d, a, k) for d, a, f, e, _ in zip(*parts) for k in range(f, e + 1)}
        monkeypatch.undo()
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.without_repeats(docs).collect()}
    assert got == dict(enumerate(without(texts)))
