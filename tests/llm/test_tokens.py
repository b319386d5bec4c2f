"""Operators 2, 8 and 10 against the libraries, and the edge cases of texts."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from quaero.llm import bpe_automaton, token_counts, token_files

TEXTS = [
    None, "", " ", "  ", "\n", "\n\n a\n", "a▁b", "▁", "\ta\x00b", "<s>a</s>", "é  ñ　x", "a\r\nb ", "😀 👍🏽", "Å ﬁ", "<0x0A>", "x" * 3000, " " * 100,
    "<|endoftext|>x<|startoftext|>", "I'll don't THE'S", "ÎΣ ΑΣ Σ İI", "a\x1cb​c", "٣½Ⅷ²", "日本語テキスト 中文", "aaaa aaaaaaa aaaaaaaaaaaaaaaaa", "the the the the " * 200,
]


def texts():
    rnd = random.Random(3)
    made = ["".join(rnd.choice("abcdeehhinrstt aou\n") for _ in range(300)) for _ in range(30)]
    return TEXTS + made + ["".join(chr(rnd.choice([rnd.randrange(32, 1000), rnd.randrange(32, 127)])) for _ in range(200)) for _ in range(30)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, i, "x") for i, t in enumerate(texts())]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, pretoken string").repartition(3)


def test_token_counts(spark, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    got = {r.doc_id: r for r in token_counts.token_counts(docs, P.path("piece_bpe_32k.model")).collect()}
    assert len(got) == len(texts())
    for i, t in enumerate(texts()):
        n = len(sp.encode(t or ""))
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 4096), repr(t)


def test_token_counts_of_equal_ids_and_rows(spark):
    rows = [(1, "a b c"), (1, "a b c"), (1, "other words"), (None, "a b"), (None, None), (None, None), (2, "x" * 3000)]
    got = token_counts.token_counts(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), P.path("piece_bpe_32k.model")).collect()
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    assert sorted(map(str, ((r.doc_id, r.n_bytes, r.n_tokens) for r in got))) == sorted(str((i, len(t or ""), len(sp.encode(t or "")))) for i, t in rows)


def test_token_counts_of_many_texts_under_one_id(spark):
    """Rows are told apart by 64 bits of their texts, so none of 200,000 under one id is added to another."""
    rows = spark.range(200_000).selectExpr("5L AS doc_id", "concat('t', id, repeat(' w', int(id % 7))) AS text")
    got = token_counts.token_counts(rows, P.path("piece_bpe_32k.model")).groupBy("n_bytes").count().collect()
    want = rows.selectExpr("cast(octet_length(text) AS long) AS n_bytes").groupBy("n_bytes").count().collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in want}


def test_token_counts_of_no_documents(docs):
    assert token_counts.token_counts(docs.where("doc_id < 0"), P.path("piece_bpe_32k.model")).count() == 0


def test_automaton_equals_library(docs):
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    lib.no_truncation()
    lib.no_padding()
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r.doc_id: r for r in bpe_automaton.bpe_round_trip(docs, P.path("word_bpe_49k.json")).collect()}
    for i, t in enumerate(texts()):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i].n_tokens == len(ids), repr(t)
        assert got[i].ids_sha256 == digest(" ".join(map(str, ids)))
        assert got[i].decoded_sha256 == digest(lib.decode(ids, skip_special_tokens=False))


def test_stored_ids_are_decoded(spark, docs):
    lib = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    lib.no_truncation()
    lib.no_padding()
    stored = bpe_automaton.encoded(docs, P.path("word_bpe_49k.json")).withColumnRenamed("ids", "tokens")
    got = {r.doc_id: r.text for r in bpe_automaton.decoded(stored, P.path("word_bpe_49k.json"), ids="tokens").collect()}
    for i, t in enumerate(texts()):
        assert got[i] == lib.decode(lib.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False), repr(t)


def test_words_with_every_character_equal_the_library():
    """Every code point in text, alone and under a mark, in blocks of 64 texts; those without a character of their own by steps."""
    lib, own = Tokenizer.from_file(P.path("word_bpe_49k.json")), bpe_automaton.coder(P.path("word_bpe_49k.json"))
    points = [p for p in range(0x110000) if not 0xD800 <= p < 0xE000 and (p < 0x20000 or 0xE0000 <= p < 0xE0200 or p % 97 == 0)]
    for a in range(0, len(points), 64):
        texts = [f"a{chr(p)}a'{chr(p)}\u0301b 1{chr(p)}" for p in points[a : a + 64]]
        for text in texts:
            plain = lib.normalizer.normalize_str(text)
            assert own.words(text) == [plain[x:y] for _, (x, y) in lib.pre_tokenizer.pre_tokenize_str(plain)], repr(text)


def test_automaton_paths_spell_their_words():
    machine = bpe_automaton.automaton(P.path("word_bpe_49k.json"))
    rnd = random.Random(5)
    words = ["".join(rnd.choice("aabcdefghilmnoprstu") for _ in range(rnd.randrange(1, 20))) for _ in range(300)]
    for word, path in zip(words, machine.encode_words([w.encode() for w in words]), strict=True):
        assert "".join(machine.labels[i] for i in path) == word + machine.end


def test_token_files(docs):
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in token_files.token_files(docs, P.path("byte_bpe_50k.json")).collect()}
    at = 0
    for i, t in enumerate(texts()):
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes())), repr(t)
        at += len(ids)


def test_token_files_repeat_and_empty(spark, docs):
    rows = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None), (2, None)], "doc_id long, text string")
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in token_files.token_files(rows, P.path("byte_bpe_50k.json")).collect())
    assert got == [(0, None, 1), (1, 1, 3), (4, 1, 3), (7, 2, 1)]
    many = spark.createDataFrame([(None, f"t {k}") for k in range(50)] + [(7, "x")] * 3, "doc_id long, text string").repartition(4)
    assert sorted(r.start for r in token_files.token_files(many, P.path("byte_bpe_50k.json")).collect())[-1] == sum(len(Tokenizer.from_file(P.path("byte_bpe_50k.json")).encode(f"t {k}").ids) + 1 for k in range(50)) + 4
    assert token_files.token_files(docs.where("doc_id < 0"), P.path("byte_bpe_50k.json")).count() == 0


def test_grammar_round_trip_and_ranges():
    rng = np.random.default_rng(2)
    for size, kinds in ((0, 1), (1, 1), (2000, 3), (5000, 50), (4000, 1)):
        ids = rng.integers(0, kinds, size).astype("<u2")
        cut = np.sort(rng.integers(0, size + 1, 5))
        lengths = np.diff(np.concatenate([[0], cut, [size]]))
        shard = token_files.Shard(token_files.pack(np.arange(len(lengths)), lengths, ids))
        assert (shard.ids() == ids).all()
        for a, b in ((0, size), (size // 3, size // 2), (max(0, size - 7), size)):
            assert (shard.range(a, b) == ids[a:b]).all()


def test_packed_values():
    for top, kind in ((0, np.uint32), (1, np.uint32), (255, np.uint32), (4095, np.uint32), (4096, np.uint32), (65535, np.uint32), (1 << 20, np.uint32), (2**32 - 1, np.uint32), (1 << 40, np.uint64)):
        for n in (0, 1, 7, 8, 1001):
            values = np.random.default_rng(n).integers(0, top, n, np.uint64, endpoint=True).astype(kind)
            data = b"xx" + token_files.packed_values(values) + b"y"
            got, at = token_files.unpacked_values(data, 2, n)
            assert (got == values).all() and at == len(data) - 1


def test_a_full_shard_is_smaller_than_plain_ids():
    """Of 16 bits each; the texts are those of the tables."""
    import pyarrow.parquet as pq

    found = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"]).column(0).to_pylist()[:2500]
    ids = [np.append(x, 0).astype("<u2") for x in token_files.encoder(P.path("byte_bpe_50k.json")).encode([t or "" for t in found])]
    lengths, ids = np.array([len(x) for x in ids]), np.concatenate(ids)
    data = token_files.pack(np.arange(len(lengths)), lengths, ids)
    assert len(ids) > 500_000 and len(data) < 1.6 * len(ids)
    assert (token_files.Shard(data).ids() == ids).all()


def test_rules_stay_within_documents():
    ids = np.tile(np.array([7, 8], "<u2"), 500)
    lengths = np.full(1000, 1)
    rules, *_ = token_files.compress(ids, lengths)
    assert len(rules) == 0


def test_words_start_where_the_split_pattern_has_them():
    import unicodedata

    import regex

    pattern = regex.compile(P.PATTERN)
    rnd = random.Random(11)
    letters = "ab'stmdrevl 1 \n\t .!é　\x85é日९²"
    for _ in range(4000):
        made = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(12))) for _ in range(3)]
        whole = "".join(made)
        if whole and not any(unicodedata.category(c) == "Cn" for c in whole):
            cut = [*token_files.word_starts(made).tolist(), len(whole)]
            assert [whole[a:b] for a, b in zip(cut, cut[1:])] == [w for t in made for w in pattern.findall(t)], made


@pytest.mark.parametrize("kinds", [2, 5, 40, 300])
def test_no_frequent_pair_is_left(kinds):
    rng = np.random.default_rng(kinds)
    ids = rng.zipf(1.3, 30_000).clip(0, kinds).astype("<u2")
    lengths = np.array([10_000, 0, 1, 12_000, 7_999])
    for least in (2, 7, token_files.LEAST):
        rules, expands, firsts, symbols = token_files.compress(ids, lengths, least)
        sizes = np.concatenate([np.ones(int(ids.max()) + 1, np.int64), expands])[symbols]
        ends = set(np.cumsum(lengths).tolist())
        at, count, last = 0, {}, (None, -2)
        for k in range(len(symbols) - 1):
            at += int(sizes[k])
            pair = (int(symbols[k]), int(symbols[k + 1]))
            if at in ends or last == (pair, k - 1):
                last = (None, -2)
                continue
            count[pair] = count.get(pair, 0) + 1
            last = (pair, k)
        assert max(count.values(), default=0) < least
        assert (token_files.expand(symbols, rules, firsts, int(ids.max()) + 1) == ids).all()
        assert (token_files.expand(symbols, rules, firsts, int(ids.max()) + 1, expands) == ids).all()
