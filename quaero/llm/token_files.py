"""Token-id files with Re-Pair grammar compression (operator 8).

Documents are dealt by ranges of their id, encoded, closed with an end id and gathered into shards of whole documents.
Each shard is compressed by itself: frequent pairs of ids are replaced by nonterminals, round after round, until none is
left. A shard file holds the rules, the length each nonterminal expands to, and what is left of the sequence; the lengths lead from an id
position to its symbol, so a range is decoded without the rest.

Shard file, little-endian: magic ``RPR2``, six uint64 (documents, ids, rules, rounds, symbols left, first nonterminal),
then int64 document ids, ids per document, rule pairs, expansion lengths, first rule of each round, symbols. All but the
document ids are packed: a byte for the number of bits b of the largest value, the low 8 bits of each value (16, if b > 8 of
them are needed), and a bitmap for each further bit.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .letters import LETTER, NUMBER, WHITE, byte_letters, kinds_of_characters
from .shared import chunks, written

#: Ids at which a shard is closed, and text bytes that are encoded together.
SHARD_IDS = 1 << 20
#: With more places than this, pairs are counted by a hash first; with more than the second, places are put in order by marks.
SIFTED, MARKED = 100_000, 2_000
CHUNK = 4 << 20
MAGIC = b"RPR2"
#: A pair is frequent, and gets a rule, if it occurs so often in its shard, however large that is.
LEAST = 16


def packed_values(values: np.ndarray) -> bytes:
    """Non-negative integers: bits of the largest one, their low 8 or 16 bits, then a bitmap per further bit."""
    bits = int(values.max(initial=0)).bit_length()
    low = 8 if bits <= 12 else 16
    planes = [np.packbits((values >> values.dtype.type(k)) & values.dtype.type(1) != 0, bitorder="little").tobytes() for k in range(low, bits)]
    return b"".join([bytes([bits]), values.astype(f"<u{low // 8}").tobytes(), *planes])


def unpacked_values(data: bytes, at: int, n: int) -> tuple[np.ndarray, int]:
    """The n values packed from byte `at` on, and the place behind them."""
    bits = data[at]
    low = 8 if bits <= 12 else 16
    out = np.frombuffer(data, f"<u{low // 8}", n, at + 1).astype(np.uint32 if bits <= 32 else np.uint64)
    at += 1 + n * low // 8
    for k in range(low, bits):
        plane = np.unpackbits(np.frombuffer(data, np.uint8, -(-n // 8), at), count=n, bitorder="little")
        out |= plane.astype(out.dtype) << out.dtype.type(k)
        at += -(-n // 8)
    return out, at


def word_starts(texts: list[str], whole: str | None = None) -> np.ndarray:
    """The places (code points of the texts one after another, which is `whole` if given) at which the byte-level vocabulary's words start.

    The words fill each text. A run of letters, of numbers or of other characters is a word, with one blank before it if
    there is any; a run of white space is one word up to that blank, or its last character; and ``'s``, ``'t``, ``'m``,
    ``'d``, ``'re``, ``'ve`` and ``'ll`` are words where a word may start.
    """
    points = np.frombuffer(("".join(texts) if whole is None else whole).encode("utf-32-le"), np.uint32)
    n = len(points)
    kinds = kinds_of_characters()[points]
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    edge = np.zeros(n + 4, bool)  # a text starts here, or all texts end
    edge[0], edge[ends], edge[n:] = True, True, True
    white = kinds == WHITE
    turns = np.ones(n, bool)
    turns[1:] = kinds[1:] != kinds[:-1]
    glued = np.zeros(n, bool)
    glued[1:] = points[:-1] == ord(" ")
    last = np.zeros(n, bool)
    last[:-1] = ~white[1:]
    start = edge[:n] | (~white & turns & ~glued) | (white & (turns | (last & ~edge[1 : n + 1])))
    marks = np.flatnonzero(points == ord("'"))
    if len(marks):
        padded = np.concatenate([points, np.zeros(3, np.uint32)])
        before = kinds[marks - 1]
        free = edge[marks] | (before == LETTER) | (before == NUMBER) | ((before == WHITE) & ~glued[marks])
        first, second = padded[marks + 1], padded[marks + 2]
        short = free & ~edge[marks + 1] & np.isin(first, [ord(c) for c in "stmd"])
        long = np.zeros(len(marks), bool)
        for pair in ("re", "ve", "ll"):
            long |= (first == ord(pair[0])) & (second == ord(pair[1]))
        long &= free & ~edge[marks + 1] & ~edge[marks + 2]
        start[marks[short | long] + 1] = False
        behind = np.concatenate([marks[short] + 2, marks[long] + 3])
        behind = behind[behind < n]
        start[behind[kinds[behind] == LETTER]] = True
    return np.flatnonzero(start)


class Encoder:
    """Byte-level BPE of the tokenizers library, for whole columns of texts.

    The words of all texts are found at once; the library's model gives the ids of each distinct word. Words seen last
    are kept with their ids (bounded). A special string inside a text is an id of its own, as the library has it.
    """

    KEPT, LONGEST = 300_000, 48

    def __init__(self, path: str):
        import tokenizers

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        split = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or spec["normalizer"] or split["type"] != "ByteLevel" or split["add_prefix_space"]:
            raise ValueError("not a plain byte-level vocabulary")
        self.special = {t["content"]: np.array([t["id"]], "<u2") for t in spec["added_tokens"]}
        self.find = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")")
        self.model = tokenizers.Tokenizer.from_file(path).model
        self.letters = "".join(byte_letters()[b] for b in range(256))
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _ids(self, words: list[bytes]) -> list[bytes]:
        """The ids of each of these distinct words."""
        if len(self.known) > self.KEPT:
            self.known, self.older = {}, self.known
        known, older, letters, tokenize = self.known, self.older, self.letters, self.model.tokenize
        out = list(map(known.get, words))
        for k in [k for k, ids in enumerate(out) if ids is None]:
            w = words[k]
            if (ids := older.get(w)) is None:
                ids = array("H", [t.id for t in tokenize(w.decode("latin-1").translate(letters))]).tobytes()
            if len(w) <= self.LONGEST:
                known[w] = ids
            out[k] = ids
        return out

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of texts without special strings."""
        whole = "".join(texts)
        data = whole.encode()
        if not data:
            return [np.zeros(0, "<u2")] * len(texts)
        starts = word_starts(texts, whole)
        at = np.flatnonzero((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)[starts]
        cut = np.append(at, len(data)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(cut), pa.py_buffer(data)]).dictionary_encode()
        ids = self._ids(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        which = words.indices.to_numpy()
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 2
        first = np.cumsum(size) - size
        many = size[which]
        stop = np.cumsum(many)
        flat = np.frombuffer(b"".join(ids), "<u2")[np.repeat(first[which] - (stop - many), many) + np.arange(stop[-1])]
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        upto = np.concatenate([[0], stop])[np.searchsorted(starts, ends)]
        return np.split(flat, upto[:-1])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        pieces = [self.find.split(t) if self.special and "<" in t else [t] for t in texts]  # every second one is special
        plain = iter(self._plain([p for ps in pieces for p in ps[::2]]))
        return [next(plain) if len(ps) == 1 else np.concatenate([self.special[p] if k % 2 else next(plain) for k, p in enumerate(ps)]) for ps in pieces]


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def compress(ids: np.ndarray, lengths: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rules (pairs of symbols), their expansion lengths, the first rule of each round, and the symbols left.

    A round replaces the frequent pairs within documents; where two occurrences overlap, the more frequent pair wins.
    Rounds go on until no pair is frequent. From the second round on only places beside a new symbol, or with a pair that
    was still frequent, are counted: other pairs have become no more frequent. Nonterminals follow the largest id.
    """
    n = len(ids)
    symbols = ids.astype(np.uint32)
    closes = np.zeros(n, bool)
    closes[np.cumsum(lengths[lengths > 0]) - 1] = True
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)  # the neighbours of the symbols that are left
    left = np.ones(n, bool)
    base = int(ids.max(initial=0)) + 1
    sizes = np.ones(base, np.uint32)
    rules, firsts = [], []
    places = np.flatnonzero(~closes)  # the places whose pair may be frequent
    while True:
        a, b = symbols[places], symbols[after[places]]
        if len(places) > SIFTED:
            slot = (a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA77)) >> np.uint32(14)
            some = np.bincount(slot, minlength=1 << 18)[slot] >= least
            places, a, b = places[some], a[some], b[some]
        keys = pa.array(a.astype(np.uint64) << np.uint64(32) | b).dictionary_encode()
        which = keys.indices.to_numpy()
        # Of a run of equal pairs (aaa) every second occurrence counts.
        again = np.flatnonzero(which[1:] == which[:-1]) + 1
        again = again[after[places[again - 1]] == places[again]]
        first = np.flatnonzero(np.diff(again, prepend=-1) != 1)
        step = np.arange(len(again)) - np.repeat(first, np.diff(first, append=len(again)))
        odd = np.zeros(len(places), bool)
        odd[again[step & 1 == 0]] = True
        counts = np.bincount(which[~odd], minlength=len(keys.dictionary))
        often = counts[which] >= least
        if not often.any():
            break
        mine = often & ~odd
        taken, which = places[mine], which[mine]
        # The more frequent of two neighbours stays; between equals, the first code.
        weight = counts[which] * len(counts) - which
        near = np.flatnonzero(after[taken[:-1]] == taken[1:])
        lost = np.zeros(len(taken), bool)
        lost[near[weight[near] < weight[near + 1]]] = True
        lost[near[weight[near] > weight[near + 1]] + 1] = True
        taken, which = taken[~lost], which[~lost]
        use = np.bincount(which, minlength=len(counts)) > 0
        used, which = np.flatnonzero(use), (np.cumsum(use) - 1)[which]
        made = keys.dictionary.to_numpy()[used]
        pairs = np.column_stack([made >> np.uint64(32), made & np.uint64(0xFFFFFFFF)]).astype(np.uint32)
        firsts.append(len(sizes) - base)
        rules.append(pairs)
        gone = after[taken]
        symbols[taken] = len(sizes) + which
        sizes = np.concatenate([sizes, sizes[pairs[:, 0]] + sizes[pairs[:, 1]]])
        closes[taken] = closes[gone]
        left[gone] = False
        after[taken] = after[gone]
        inner = taken[after[taken] < n]
        before[after[inner]] = inner
        places = np.concatenate([places[often], taken, np.maximum(before[taken], 0)])
        places = places[left[places] & ~closes[places]]
        if len(places) > MARKED:
            look = np.zeros((n + 7) // 8 * 8, bool)
            look[places] = True
            some = np.flatnonzero(look.view(np.uint64))  # eight places together
            row, column = np.nonzero(look.reshape(-1, 8)[some])
            places = some[row] * 8 + column
        else:
            places = np.unique(places)
    return np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32), sizes[base:], np.array(firsts, np.uint32), symbols[left]


def _gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of flat that start there and are so long, one behind the other."""
    stop = np.cumsum(sizes)
    return flat[np.repeat(starts - (stop - sizes), sizes) + np.arange(int(stop[-1]) if len(stop) else 0)]


#: Expansions of all rules are laid out at once if they have at most so many ids for each one of the shard.
LAID_OUT = 4


def expand(symbols: np.ndarray, rules: np.ndarray, firsts: np.ndarray, base: int, expands: np.ndarray | None = None) -> np.ndarray:
    """The ids that symbols stand for. With the rules' lengths their expansions are laid out round by round, each from those
    before, and symbols are then looked up in one go; else, or if they'd be too long, the rules of the last round are
    undone first."""
    if expands is not None and int(expands.sum(dtype=np.int64)) <= LAID_OUT * SHARD_IDS:
        sizes = np.concatenate([np.ones(base, np.int64), expands.astype(np.int64)])
        starts = np.cumsum(sizes) - sizes
        flat = np.zeros(int(sizes.sum()), symbols.dtype)
        flat[:base] = np.arange(base)
        bounds = [*firsts.tolist(), len(rules)]
        for a, b in zip(bounds, bounds[1:], strict=False):
            parts = rules[a:b].ravel()
            made = _gathered(flat, starts[parts], sizes[parts])
            flat[starts[base + a] : starts[base + a] + len(made)] = made
        return _gathered(flat, starts[symbols], sizes[symbols])
    for first in firsts[::-1].tolist():
        made = np.flatnonzero(symbols >= base + first)
        if not len(made):
            continue
        out = np.repeat(symbols, np.where(symbols >= base + first, 2, 1))
        pair = rules[symbols[made] - np.uint32(base)]
        left = made + np.arange(len(made))
        out[left], out[left + 1] = pair[:, 0], pair[:, 1]
        symbols = out
    return symbols


def pack(keys: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    rules, expands, firsts, symbols = compress(ids, lengths)
    head = np.array([len(keys), len(ids), len(rules), len(firsts), len(symbols), int(ids.max(initial=0)) + 1], "<u8")
    return b"".join([MAGIC, head.tobytes(), keys.astype("<i8").tobytes(), *map(packed_values, (lengths.astype(np.uint64), rules.ravel(), expands, firsts, symbols))])


class Shard:
    """A shard file, read."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a shard file")
        docs, self.n_ids, rules, rounds, symbols, self.base = (int(x) for x in np.frombuffer(data, "<u8", 6, 4))
        self.keys = np.frombuffer(data, "<i8", docs, 4 + 48)
        at, parts = 4 + 48 + 8 * docs, []
        for n in (docs, 2 * rules, rules, rounds, symbols):
            part, at = unpacked_values(data, at, n)
            parts.append(part)
        self.lengths, self.rules = parts[0].astype(np.int64), parts[1].reshape(-1, 2)
        self.expands, self.firsts, self.symbols = parts[2:]

    def ids(self) -> np.ndarray:
        return expand(self.symbols, self.rules, self.firsts, self.base, self.expands)

    def range(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop of the shard; only the symbols that cover them are expanded."""
        sizes = np.ones(len(self.symbols), np.int64)
        made = self.symbols >= self.base
        sizes[made] = self.expands[self.symbols[made] - np.uint32(self.base)]
        ends = np.cumsum(sizes)
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
        before = int(ends[a - 1]) if a else 0
        return expand(self.symbols[a:b], self.rules, self.firsts, self.base)[start - before : stop - before]


def write_shards(docs: DataFrame, path: str, end_id: int = 0, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and write docs in ascending id order. Returns the files as read back: part, shard, n_ids, shard_file.

    Shards are ordered by (part, shard). Rows with equal ids stand in the order of their texts' hashes, so that many of
    them spread over partitions; rows with a null id come first and are stored as the least id. A null text is an empty one; each document has its end id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        coder = encoder(path)
        keys: list[int] = []
        pieces: list[np.ndarray] = []
        held = 0

        def close() -> pa.RecordBatch:
            lengths = np.array([len(p) + 1 for p in pieces], np.int64)
            ids = np.concatenate([x for p in pieces for x in (p, end)])
            data = pack(np.array(keys, np.int64), lengths, ids)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([len(ids)], pa.int64()), pa.array([data], pa.binary())], ["part", "shard", "n_ids", "shard_file"])

        end = np.array([end_id], "<u2")
        for batch in batches:
            for chunk in chunks(batch, "text", CHUNK):
                for key, ids in zip(chunk.column(0).to_pylist(), coder.encode([t or "" for t in chunk.column(1).to_pylist()]), strict=True):
                    keys.append(-(1 << 63) if key is None else key)
                    pieces.append(ids)
                    held += len(ids) + 1
                    if held >= SHARD_IDS:
                        yield close()
                        keys, pieces, held, number = [], [], 0, number + 1
        if keys:
            yield close()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    dealt = rows.repartitionByRange("doc_id", "text_hash").sortWithinPartitions("doc_id", "text_hash", "text")
    return written(dealt.select("doc_id", "text").mapInArrow(run, "part int, shard int, n_ids long, shard_file binary"), "token_files")


def token_files(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files read back.

    start is the number of ids of all documents before it. Repeated ids give repeated rows; an empty table gives no rows.
    """
    shards = write_shards(docs, path, id_col=id_col, text=text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, number, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                shard = Shard(data)
                ids = shard.ids().astype("<u4")
                ends = np.cumsum(shard.lengths)
                sums = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends.tolist(), shard.lengths.tolist(), strict=True)]
                some = len(sums)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * some, pa.int32()), pa.array([number] * some, pa.int32()), pa.array(shard.keys, pa.int64(), mask=shard.keys == -(1 << 63)), pa.array(ends - shard.lengths, pa.int64()), pa.array(shard.lengths, pa.int64()), pa.array(sums, pa.int64())],
                    ["part", "shard", "doc_id", "inside", "n_tokens", "ids_crc32"],
                )

    read = shards.select("part", "shard", "shard_file").mapInArrow(run, "part int, shard int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    # One row per part, of which there are as many as shuffle partitions; then the shards of each part by themselves.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    within = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("part", "shard", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("shard_start"))
    starts = starts.join(parts.hint("shuffle_merge"), "part").select("part", "shard", (F.col("part_start") + F.col("shard_start")).alias("before"))
    placed = read.join(starts.hint("shuffle_merge"), ["part", "shard"])
    return placed.select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
