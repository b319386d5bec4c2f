"""Removal of repeated byte strings by suffix sorting (operator 5).

Sorting every suffix of a corpus would move it many times over. Here each 400-byte window is filed under its anchor, the
64-byte string of least hash in it: equal windows have equal anchors at equal places. Anchors that occur once are done.
The others meet by anchor, laid on each other, and what stands to the right of the anchor (the suffix from there) and to
its left (backwards) is sorted with the lengths of common prefixes of neighbours; two windows are equal where both
common lengths reach far enough.

Groups are sorted deep-shallow: multikey quicksort to a shallow depth, and blind tries for the strings that agree so
far, which compare each string in full with one other only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import SLOT_BITS, bitmap, chunks, is_set, mix, packed, slot_of, written

#: Bytes of a window and of an anchor; a window has SPAN places for its anchor.
WIDTH, ANCHOR = 400, 64
SPAN = WIDTH - ANCHOR + 1
#: Depth of the multikey quicksort.
SHALLOW = 12
#: Anchors with more occurrences than this are not gathered: their windows are counted by a 128-bit digest instead.
GATHERED = 20_000

#: Bytes of a text that are looked at together; longer texts fall into parts that overlap, whatever their length.
PART = 4 << 20

_PLACES = np.uint64((1 << 28) - 1)
_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def windows(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, anchor place, first and last window start (places in data), and anchor hash, for each run of windows
    that share an anchor. data: the documents' bytes one after another."""
    if len(data) <= PART:
        return _windows(data, starts, sizes)
    found = []
    for doc, (start, size) in enumerate(zip(starts.tolist(), sizes.tolist(), strict=True)):
        for at in range(0, size - WIDTH + 1, PART - WIDTH + 1):
            piece = data[start + at : start + min(size, at + PART)]
            docs, *places, hashes = _windows(piece, np.zeros(1, np.int64), np.array([len(piece)]))
            found.append((docs + doc, *(p + start + at for p in places), hashes))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else _windows(data[:0], starts[:0], sizes[:0])


def _windows(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(data)
    if n < WIDTH:
        none = np.zeros(0, np.int64)
        return none, none, none, none, np.zeros(0, np.uint64)
    hashes = _TABLE[data]
    step = 1
    while step < ANCHOR:
        factor = np.uint64(0xD1342543DE82EF95) + np.uint64(2 * step)
        hashes = hashes[:-step] * factor + hashes[step:]
        step *= 2
    hashes = mix(hashes)
    least = (hashes & ~_PLACES) | np.arange(len(hashes), dtype=np.uint64)
    step = 1
    while step * 2 <= SPAN:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    if step < SPAN:
        least = np.minimum(least[: -(SPAN - step)], least[SPAN - step :])
    counts = np.maximum(sizes - WIDTH + 1, 0)
    doc = np.repeat(np.arange(len(sizes)), counts)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[doc]
    anchor = (least[at] & _PLACES).astype(np.int64)
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1 if len(at) else first
    return doc[first], anchor[first], at[first], at[last], hashes[anchor[first]]


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes of a text array (nulls: none), with the start and size of each text."""
    data = pc.fill_null(texts, "").cast(pa.large_binary())
    sizes = pc.binary_length(data).to_numpy(zero_copy_only=False).astype(np.int64)
    whole = np.frombuffer(b"".join(data.to_pylist()), np.uint8)
    return whole, np.cumsum(sizes) - sizes, sizes


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # the first low bytes agree, the first high bytes don't
    while high - low > 1:
        middle = (low + high) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle
    return low


def blind_sort(strings: list[bytes], index: list[int]) -> tuple[list[int], list[int]]:
    """Sorted order of the strings with these numbers, and the common prefix of each with the one before it (first: 0).

    A blind trie holds only branching depths and the byte at each branch. A string goes down by those bytes alone to some
    leaf, is compared with that leaf's string once, and is put in where they part.
    """
    at = lambda i, d: strings[i][d] if d < len(strings[i]) else -1
    root: list = [None, index[0]]  # [None, string] is a leaf (with equal strings behind it), [depth, {byte: node}] a branch
    for i in index[1:]:
        node = root
        while node[0] is not None:
            node = node[1].get(at(i, node[0])) or next(iter(node[1].values()))
        leaf = node[1]
        same = common(strings[i], strings[leaf])
        if same == len(strings[i]) == len(strings[leaf]):
            node.append(i)
            continue
        node = root
        while node[0] is not None and node[0] < same:
            node = node[1][at(i, node[0])]
        if node[0] == same:
            node[1][at(i, same)] = [None, i]
        else:
            below = node[:]
            node[:] = [same, {at(leaf, same): below, at(i, same): [None, i]}]
    order, lengths = [], []
    stack: list[tuple[list, int]] = [(root, 0)]
    while stack:
        node, shared = stack.pop()
        if node[0] is None:
            for k, i in enumerate(node[1:]):
                order.append(i)
                lengths.append(len(strings[i]) if k else shared)
        else:
            children = [node[1][b] for b in sorted(node[1])]
            stack += [(c, node[0]) for c in reversed(children[1:])]
            stack.append((children[0], shared))
    return order, lengths


def deep_shallow(strings: list[bytes], depth: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order, and the common prefix of each string with the one before it (first: 0). All agree up to depth."""
    order: list[int] = []
    lengths: list[int] = []
    limit = depth + SHALLOW
    stack = [(list(range(len(strings))), depth)]
    while stack:
        index, d = stack.pop()
        if len(index) == 1:
            part, inside = index, [0]
        elif d >= limit:
            part, inside = blind_sort(strings, index)
        else:
            char = [strings[i][d] if d < len(strings[i]) else -1 for i in index]
            pivot = char[len(char) // 2]
            less, more = [i for i, c in zip(index, char, strict=True) if c < pivot], [i for i, c in zip(index, char, strict=True) if c > pivot]
            equal = [i for i, c in zip(index, char, strict=True) if c == pivot]
            if more:
                stack.append((more, d))
            if pivot >= 0:
                stack.append((equal, d + 1))
            if pivot < 0 or less:
                if pivot < 0:  # these strings end here, so they are equal
                    part, inside = equal, [0] + [d] * (len(equal) - 1)
                    lengths.append(common(strings[order[-1]], strings[part[0]]) if order else 0)
                    lengths += inside[1:]
                    order += part
                else:
                    stack.append((less, d))
            continue
        lengths.append(common(strings[order[-1]], strings[part[0]]) if order else 0)
        lengths += inside[1:]
        order += part
    return np.array(order), np.array(lengths)


def repeated_offsets(rows: list[tuple[bytes, int, int]]) -> list[list[tuple[int, int]]]:
    """For each row (context, left, times) of one anchor: the runs (from, to) of window starts in its context that repeat.

    left: bytes of the context before the anchor; a context holds len - WIDTH + 1 windows. times: its occurrences.
    """
    many = len(rows)
    high = [left for _, left, _ in rows]
    low = [left - (len(c) - WIDTH) for c, left, _ in rows]
    if many == 1 or all(t > 1 for _, _, t in rows):
        return [[(0, h - w)] if t > 1 else [] for h, w, (_, _, t) in zip(high, low, rows, strict=True)]
    right = [c[left:] for c, left, _ in rows]
    back = [c[:left][::-1] for c, left, _ in rows]
    if many == 2:
        top = min(common(back[0], back[1]), high[0], high[1])
        bottom = max(WIDTH - common(right[0], right[1]), low[0], low[1])
        return [[(0, h - w)] if t > 1 else [(h - top, h - bottom)] if bottom <= top else [] for h, w, (_, _, t) in zip(high, low, rows, strict=True)]
    by_right, right_same = deep_shallow(right, ANCHOR)
    by_back, back_same = deep_shallow(back)
    tops, bottoms, often = np.array(high), np.array(low), np.array([t > 1 for _, _, t in rows])
    # o is the distance from a window's start to the anchor; between these values no class changes.
    cuts = np.unique(np.concatenate([bottoms, tops + 1, back_same[1:] + 1, WIDTH - right_same[1:]]))
    cuts = cuts[(cuts >= bottoms.min()) & (cuts <= tops.max())]
    ends = np.append(cuts[1:], tops.max() + 1) - 1
    runs: list[list[tuple[int, int]]] = [[] for _ in rows]
    one, two = np.empty(many, np.int64), np.empty(many, np.int64)
    for o, end in zip(cuts.tolist(), ends.tolist(), strict=True):
        one[by_right] = np.cumsum(right_same < WIDTH - o)
        two[by_back] = np.cumsum(back_same < o)
        here = np.flatnonzero((bottoms <= o) & (o <= tops))
        _, which, count = np.unique(one[here] * (many + 1) + two[here], return_inverse=True, return_counts=True)
        for i in here[(count[which] > 1) | often[here]].tolist():
            runs[i].append((high[i] - min(end, high[i]), high[i] - o))
    out = []
    for found in runs:
        joined: list[tuple[int, int]] = []
        for a, b in sorted(found):
            if joined and a <= joined[-1][1] + 1:
                joined[-1] = (joined[-1][0], max(b, joined[-1][1]))
            else:
                joined.append((a, b))
        out.append(joined)
    return out


def _anchor_counts(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                anchors, counts = np.unique(windows(*_bytes_of(part.column(2)))[4], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(anchors.view(np.int64)), pa.array(counts, pa.int64())], ["anchor", "n"])

    return docs.mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))


def _contexts(docs: DataFrame, bits) -> DataFrame:
    """anchor, context, left, and the documents and places of its occurrences in a chunk, for anchors whose slot is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                data, starts, sizes = _bytes_of(part.column(2))
                doc, anchor, first, last, hashes = windows(data, starts, sizes)
                on = np.flatnonzero(is_set(bits.value, (hashes & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)))
                whole = data.tobytes()
                found: dict[tuple[int, int, bytes], list[int]] = {}
                for k, a, f, e, h in zip(on.tolist(), anchor[on].tolist(), first[on].tolist(), last[on].tolist(), hashes[on].view(np.int64).tolist(), strict=True):
                    found.setdefault((h, a - f, whole[f : e + WIDTH]), []).append(k)
                ids, keys = part.column(0), part.column(1)
                flat = np.array([k for ks in found.values() for k in ks], np.int64)
                cut = np.concatenate([[0], np.cumsum([len(ks) for ks in found.values()])]).astype(np.int32)
                rows = pa.array(doc[flat])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x[0] for x in found], pa.int64()),
                        pa.array([x[1] for x in found], pa.int32()),
                        pa.array([x[2] for x in found], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(cut), ids.take(rows)),
                        pa.ListArray.from_arrays(pa.array(cut), keys.take(rows)),
                        pa.ListArray.from_arrays(pa.array(cut), pa.array(first[flat] - starts[doc[flat]], pa.int64())),
                    ],
                    ["anchor", "left", "context", "ids", "keys", "places"],
                )

    return docs.mapInArrow(run, "anchor long, left int, context binary, ids array<long>, keys array<long>, places array<long>")


_SPANS = "row_id long, row_key long, start long, stop long"


def _spans(rows: list[tuple], out: list[tuple]) -> None:
    """Removed byte spans of one anchor's rows."""
    merged: dict[tuple[bytes, int], list[tuple]] = {}
    for row in rows:
        merged.setdefault((row[2], row[1]), []).append(row)
    contexts = [(c, left, sum(len(r[3]) for r in same)) for (c, left), same in merged.items()]
    if len(contexts) == 1 and contexts[0][2] < 2:
        return
    for runs, same in zip(repeated_offsets(contexts), merged.values(), strict=True):
        for a, b in runs:
            for row in same:
                out += [(i, k, p + a, p + b + WIDTH) for i, k, p in zip(row[3], row[4], row[5], strict=True)]


def _gathered(contexts: DataFrame) -> DataFrame:
    """Removed spans, by the contexts that share an anchor; they stand together in a sorted partition."""

    def flush(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["row_id", "row_key", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        out: list[tuple] = []
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                for row in zip(*(c.to_pylist() for c in batch.slice(at, 2000).columns), strict=True):
                    if rows and rows[0][0] != row[0]:
                        _spans(rows, out)
                        rows = []
                    rows.append(row)
                if len(out) > 20_000:
                    yield flush(out)
                    out = []
        if rows:
            _spans(rows, out)
        yield flush(out)

    return contexts.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, _SPANS)


def _counted(contexts: DataFrame, gathered: int) -> DataFrame:
    """Removed spans for anchors too frequent to gather: the windows of each distinct context by their digests, counted
    with partial sums. A context has at most SPAN windows; the runs of those that repeat go back to its occurrences, which
    are dealt into a part for each so many (gathered) of them, so that no task takes all of a frequent context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, context, times in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                some = len(context) - WIDTH + 1
                digests = [hashlib.blake2b(context[k : k + WIDTH], digest_size=16).digest() for k in range(some)]
                yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array([name] * some, pa.binary()), pa.array(range(some), pa.int32()), pa.array([times] * some, pa.int64())], ["digest", "name", "place", "times"])

    named = written(contexts.select(F.unhex(F.md5("context")).alias("name"), "context", "ids", "keys", "places"), "hot_contexts")
    distinct = named.groupBy("name").agg(F.first("context").alias("context"), F.sum(F.size("ids")).alias("times"))
    each = written(distinct.mapInArrow(run, "digest binary, name binary, place int, times long"), "hot_windows")
    often = written(each.groupBy("digest").agg(F.sum("times").alias("n")).where("n > 1").select("digest"), "hot_digests")
    parts = F.expr(f"max(times) div {max(gathered, 1)} + 1").alias("parts")
    places = each.join(often.hint("shuffle_merge"), "digest").groupBy("name").agg(F.sort_array(F.collect_list("place")).alias("at"), parts)
    edges = "filter(at, (x, k) -> coalesce(get(at, k {0} 1) <> x {0} 1, true))"
    runs = written(places.select("name", "parts", F.expr(f"zip_with({edges.format('-')}, {edges.format('+')}, (a, b) -> struct(a, b))").alias("runs")), "hot_runs")
    many = runs.where("parts > 1").select("name", "parts")  # one for each so many occurrences at most
    dealt = named.join(F.broadcast(many), "name", "left").withColumn("part", F.expr("pmod(xxhash64(monotonically_increasing_id()), coalesce(parts, 1))")).drop("parts")
    copies = runs.select("name", "runs", F.explode(F.expr("sequence(0L, parts - 1)")).alias("part"))
    occurrences = dealt.join(copies.hint("shuffle_merge"), ["name", "part"]).select("runs", F.explode(F.arrays_zip("ids", "keys", "places")).alias("o"))
    spans = occurrences.select(F.col("o.ids").alias("row_id"), F.col("o.keys").alias("row_key"), F.col("o.places").alias("place"), F.explode("runs").alias("r"))
    return spans.select("row_id", "row_key", (F.col("place") + F.col("r.a")).alias("start"), (F.col("place") + F.col("r.b") + WIDTH).alias("stop"))


def removed_spans(rows: DataFrame, gathered: int = GATHERED) -> DataFrame:
    """row_id, row_key, start, stop: byte spans to remove, possibly overlapping. rows: row_id, row_key, text."""
    spark = rows.sparkSession
    counts = written(_anchor_counts(rows).where("n > 1"), "anchors")
    slots = counts.select("n", slot_of(F.col("anchor")).alias("slot")).groupBy("slot").agg(F.max("n").alias("n"))
    bits = spark.sparkContext.broadcast(packed(bitmap(slots.where(F.col("n") <= gathered).select("slot"))))
    spans = _gathered(_contexts(rows, bits))
    hot = slots.where(F.col("n") > gathered)
    if not hot.isEmpty():
        hot_bits = spark.sparkContext.broadcast(packed(bitmap(hot.select("slot"))))
        spans = spans.unionByName(_counted(_contexts(rows, hot_bits), gathered))
    return spans


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", gathered: int = GATHERED) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each document, as UTF-8 bytes, and text, what is left of it
    (without the rest of a character that was cut through).

    A byte goes if a 400-byte string over it starts anywhere else, in the same document or another. Null texts are empty
    and texts under 400 bytes keep all. Repeated rows are documents of their own, each the other's copy. An empty table
    gives no rows; extra columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("row_id"), F.xxhash64(F.col(id_col), F.col(text)).alias("row_key"), F.col(text).alias("text"))
    spans = removed_spans(rows, gathered).groupBy("row_id", "row_key").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    # Null ids must find their spans too.
    joined = rows.join(spans.withColumnRenamed("row_id", "span_id").hint("shuffle_hash"), F.col("row_id").eqNullSafe(F.col("span_id")) & (rows["row_key"] == spans["row_key"]), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                out = []
                for key, text_, cut in zip(*(c.to_pylist() for c in batch.slice(at, 200).columns), strict=True):
                    data = (text_ or "").encode()
                    kept, place, gone, n = [], 0, 0, 0
                    for s in sorted((s["start"], s["stop"]) for s in cut or ()):
                        if s[0] > place or not n:
                            kept.append(data[place : s[0]])
                            n += 1
                            gone += s[1] - s[0]
                            place = s[1]
                        elif s[1] > place:
                            gone += s[1] - place
                            place = s[1]
                    kept.append(data[place:])
                    left = b"".join(kept)
                    out.append((key, len(data), gone, n, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore")))
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.string()) for c in columns[4:])], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])

    return joined.select("row_id", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string")
