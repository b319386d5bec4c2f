"""BPE encoding and decoding with a tokenization automaton (operator 10).

The automaton's arcs are labelled with tokens, and its paths are exactly the tokenizations that the merges produce. It
starts as one state with a loop for each symbol; merges (u, v) are then compiled in one by one with a merge gadget: the
state S(u) that arcs u lead to gets a copy without arc v, arcs u are redirected to the copy, and each state that had an
arc u gets an arc uv to the state that v led to. All arcs with one label lead to one state, so a state is named by its
label, and the tables hold what each gadget changed:

- ``excluded[u, v] = rank``: since that merge, S(u) has no arc v;
- S(uv) is S(v) as it was when uv was made (``right``, ``made``);
- a state got its arc uv if it had its arc u at that time (``left``, ``made``).

A word is encoded by following arcs whose labels spell it; the path is unique, and so is the path of each prefix, so
one state per position is enough. All new words of a chunk run through the tables together. Decoding emits arc labels.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .letters import byte_letters, disputed, top_of, word_pattern
from .shared import chunks

FOREVER = np.int64(1) << 40
END, NOTHING = 256, 1023  # added to the byte that ends a word; behind it


class Lookup:
    """An open-addressing table from non-negative 64-bit keys to non-negative values, probed for whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, -1, np.int64)
        left = np.arange(len(keys))
        slots = self._slots(keys)
        while len(left):
            free = left[self.keys[slots[left]] < 0]
            _, first = np.unique(slots[free], return_index=True)
            put = free[first]
            self.keys[slots[put]], self.values[slots[put]] = keys[put], values[put]
            left = left[self.keys[slots[left]] != keys[left]]
            slots[left] = (slots[left] + 1) & ((1 << self.bits) - 1)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, or -1."""
        slots = self._slots(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.values[slots], -1)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[slots[open_]]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slots[open_[hit]]]
            open_ = open_[~hit & (found >= 0)]
        return out


class Automaton:
    """The compiled automaton of one vocabulary file with word ends."""

    #: Lengths up to which words share a block, and symbols of a block.
    TOGETHER, CELLS = (8, 16, 32), 200_000

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        size = max(self.labels) + 1
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.made = np.zeros(size, np.int64)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        pairs = np.array([(vocab[u], vocab[v], vocab[u + v]) for u, v in merges], np.int64).reshape(-1, 3)
        ranks = np.arange(1, len(pairs) + 1)
        self.excluded = Lookup(pairs[:, 0] << 20 | pairs[:, 1], ranks)
        self.left[pairs[:, 2]], self.right[pairs[:, 2]], self.made[pairs[:, 2]] = pairs[:, 0], pairs[:, 1], ranks
        # A gadget adds its arcs only if S(u) had an arc v just before; else its label never occurs, nor what is built on it.
        live = np.ones(size, bool)
        arc = self.arcs(pairs[:, 0], pairs[:, 1], ranks)
        for (u, v, uv), there in zip(pairs.tolist(), arc.tolist(), strict=True):
            live[uv] = there and live[u] and live[v]
        self._spell(vocab, live)

    def _spell(self, vocab: dict[str, int], live: np.ndarray) -> None:
        """The tree of the labels' spellings: next node by (node, symbol), and the label that ends at a node."""
        byte_of = {c: b for b, c in byte_letters().items()}
        tree: dict[tuple[int, int], int] = {}
        ends = [-1]
        for token, number in vocab.items():
            if token in self.special or not live[number]:
                continue
            last = token.endswith(self.end)
            symbols = [byte_of[c] for c in (token[: -len(self.end)] if last else token)]
            if last:
                symbols[-1] += END
            node = 0
            for s in symbols:
                node = tree.setdefault((node, s), len(ends))
                if node == len(ends):
                    ends.append(-1)
            ends[node] = number
        keys = np.array(list(tree), np.int64).reshape(-1, 2)
        self.next = Lookup(keys[:, 0] << 10 | keys[:, 1], np.fromiter(tree.values(), np.int64))
        self.label_at = np.array(ends, np.int64)

    def arcs(self, states: np.ndarray, labels: np.ndarray, before: np.ndarray | None = None) -> np.ndarray:
        """Whether each state (named by the label that leads to it; -1: the first state) has the arc, now or before a rank."""
        blocked = np.zeros(len(states), bool)
        rows = np.flatnonzero(states >= 0)
        limit = np.full(len(rows), FOREVER) if before is None else before[rows]
        state = states[rows]
        while len(rows):  # the state, then the state that it was copied from
            inner, label, till, known = np.arange(len(rows)), labels[rows], np.full(len(rows), FOREVER), limit
            while len(inner):  # the label, then the arc that it was made from
                rank = self.excluded(state[inner] << 20 | label)
                hit = (rank >= 0) & (rank < known[inner]) & (rank <= till)
                blocked[rows[inner[hit]]] = True
                on = ~hit & (self.left[label] >= 0)
                inner, till, label = inner[on], self.made[label[on]], self.left[label[on]]
            on = ~blocked[rows] & (self.right[state] >= 0)
            rows, limit, state = rows[on], np.minimum(limit[on], self.made[state[on]]), self.right[state[on]]
        return ~blocked

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """The labels on the path of each (non-empty) word. Words of like length run together, padded with no symbol."""
        out: list[list[int]] = [[]] * len(words)
        by_length: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            n = len(w)
            by_length.setdefault(next((top for top in self.TOGETHER if n <= top), n), []).append(k)
        for n, which in by_length.items():
            for at in range(0, len(which), max(1, self.CELLS // n)):
                some = which[at : at + max(1, self.CELLS // n)]
                length = np.fromiter((len(words[k]) for k in some), np.int64, len(some))
                symbols = np.frombuffer(b"".join([words[k].ljust(n, b"\0") for k in some]), np.uint8).reshape(len(some), n).astype(np.int64)
                symbols[np.arange(n) >= length[:, None]] = NOTHING
                symbols[np.arange(len(some)), length - 1] += END
                for k, path in zip(some, self._paths(symbols, length.tolist()), strict=True):
                    out[k] = path
        return out

    def _paths(self, symbols: np.ndarray, length: list[int]) -> list[list[int]]:
        many, n = symbols.shape
        state = np.full((many, n + 1), -2, np.int64)
        came = np.zeros((many, n + 1), np.int64)
        state[:, 0] = -1
        for i in range(n):
            rows = np.flatnonzero(state[:, i] >= -1)
            node = np.zeros(len(rows), np.int64)
            for j in range(i, n):
                node = self.next(node << 10 | symbols[rows, j])
                on = node >= 0
                rows, node = rows[on], node[on]
                if not len(rows):
                    break
                label = self.label_at[node]
                ends = np.flatnonzero(label >= 0)
                if not len(ends):
                    continue
                ok = ends[self.arcs(state[rows[ends], i], label[ends])]
                state[rows[ok], j + 1], came[rows[ok], j + 1] = label[ok], i
        labels, places = state.tolist(), came.tolist()
        paths = []
        for r in range(many):
            at, path = length[r], []
            while at:
                path.append(labels[r][at])
                at = places[r][at]
            paths.append(path[::-1])
        return paths


@functools.cache
def automaton(path: str) -> Automaton:
    return Automaton(path)


class Coder:
    """Splits texts as the library does, and keeps what the automaton made of the words seen last (bounded)."""

    KEPT, LONGEST, CHUNK = 60_000, 48, 2 << 20

    def __init__(self, path: str):
        self.path, self.machine = path, automaton(path)
        self.special = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.machine.special, key=len, reverse=True)) + ")")
        self.fixed = {token: str(number) for token, number in self.machine.special.items()}
        self.known: dict[str, str] = dict(self.fixed)
        self.older: dict[str, str] = {}
        self.labels = {str(number): label for number, label in self.machine.labels.items()}

    @functools.cached_property
    def library(self):
        import tokenizers

        return tokenizers.Tokenizer.from_file(self.path)

    def words(self, text: str) -> list[str]:
        """The words of a text; a special token's string is a word of its own. The split drops all white space, so its
        normal form needs no step. Normal form and split of a text with disputed characters are the library's."""
        out: list[str] = []
        for k, part in enumerate(self.special.split(text) if "<|" in text else (text,)):
            if k % 2:
                out.append(part)
            elif not part.isascii() and top_of(part) > 0xFF and disputed().search(part):
                plain = self.library.normalizer.normalize_str(part)
                out += [plain[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(plain)]
            elif part:
                plain = part if part.isascii() else unicodedata.normalize("NFC", part).replace("Σ", "σ")
                low = plain.lower()
                out += word_pattern(top_of(low)).findall(low)
        return out

    def decode(self, ids: str) -> str:
        """The labels of the arcs that decimal ids (joined by a blank) name."""
        return " ".join([self.labels[x] for x in ids.split(" ")]) if ids else ""

    def learn(self, words: set[str]) -> dict[str, str]:
        """The ids (decimal, joined by a blank) of the words not known yet.

        When enough words are kept, they become the older ones, of which those met again move on.
        """
        if len(self.known) > self.KEPT:
            self.known, self.older = dict(self.fixed), self.known
        known, older, fresh = self.known, self.older, []
        for w in words:
            if w not in known:
                if (value := older.get(w)) is None:
                    fresh.append(w)
                else:
                    known[w] = value
        made = {w: " ".join(map(str, p)) for w, p in zip(fresh, self.machine.encode_words([w.encode() for w in fresh]), strict=True)}
        self.known.update((w, v) for w, v in made.items() if len(w) <= self.LONGEST)
        return made


@functools.cache
def coder(path: str) -> Coder:
    return Coder(path)


def _coded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.Array, list[str]]]:
    """The ids of each text, decimal and joined by a blank."""
    own = coder(path)
    for batch in batches:
        for part in chunks(batch, "text", own.CHUNK):
            split = [own.words(t or "") for t in part.column(1).to_pylist()]
            extra = own.learn(set().union(*split))
            known = own.known
            rows = []
            for words in split:
                try:
                    rows.append(" ".join([known[w] for w in words]))
                except KeyError:  # a word too long to keep
                    rows.append(" ".join([known.get(w) or extra[w] for w in words]))
            yield part.column(0), rows


def _count(ids: str) -> int:
    return ids.count(" ") + 1 if ids else 0


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens and ids (decimal, joined by a blank) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, rows in _coded(batches, path):
            yield pa.RecordBatch.from_arrays([keys, pa.array(map(_count, rows), pa.int64()), pa.array(rows, pa.string())], ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids string")


def decoded(tokens: DataFrame, path: str, id_col: str = "doc_id", ids: str = "ids") -> DataFrame:
    """doc_id and text of each row of ids (decimal, joined by a blank; null: none): the arc labels that they name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = coder(path)
        for batch in batches:
            for part in chunks(batch, "ids", own.CHUNK):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([own.decode(x or "") for x in part.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return tokens.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(run, "doc_id long, text string")


def bpe_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each document; what is decoded are the ids just made.

    Null and empty texts have no tokens (digests of the empty string). Each row is coded by itself: repeated rows and
    ids give repeated rows, null ids stay null. An empty table gives no rows; extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        decode = coder(path).decode
        for keys, rows in _coded(batches, path):
            columns = [pa.array(map(_count, rows), pa.int64()), pa.array(map(digest, rows), pa.string()), pa.array([digest(decode(x)) for x in rows], pa.string())]
            yield pa.RecordBatch.from_arrays([keys, *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
