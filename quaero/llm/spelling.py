"""Spelling variant grouping with a bit-sliced position index (operator 11).

Two words are near if one insertion, deletion or replacement leads from one to the other. An edit lies in one window of
the word, and what stands before and behind that window is the same in both. So words are dealt by (window, what is
outside of it): a word of L letters stands for itself in the windows of length L, and for those that lack one of its
letters in the windows of length L - 1. Windows start as the two halves; groups above GROUP words are cut again at
the middle of their window. At a window of one letter a group holds at most 90 words and 90 * 90 longer ones, as the
alphabet has 90 letters, so groups are bounded whatever the vocabulary, and no word is lost to a cap.

Inside a group each (position, letter) of the window has a bitset over the group's words, best word first. A word runs
through the window once; word-parallel recurrences keep the sets that agree so far and those with one edit so far,
the latter with the index shifted by one position for insertions and deletions.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import chunks, written

#: Fixed values of the contract: runs of letters, least letters and occurrences of a word, every how many hashes lose a
#: letter, and how many times more frequent a form must be.
RUN, LETTERS, OCCURRENCES, DAMAGE, TIMES = r"[A-Za-zÀ-ÿ]+", 5, 3, 97, 2
#: Words that a task holds before it gives their counts away.
HELD = 200_000
#: Words of a group at most, as long as its window has two letters to cut.
GROUP = 16_384
#: Keys of groups to cut that are broadcast (about 10 MB); more are joined by shuffle.
BROADCAST_KEYS = 100_000
#: Groups up to this size build their bitsets word by word, larger ones by whole columns.
SMALL = 192

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_KEY = ["lo", "hi", "fixed"]


def damaged(word: str, start: int, damage: int) -> str:
    """The word without the letter at crc32 % length, if damage divides its crc32 that goes on from start."""
    h = zlib.crc32(word.encode(), start)
    return word if h % damage else word[: h % len(word)] + word[h % len(word) + 1 :]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", damage: int = DAMAGE) -> DataFrame:
    """word, n: the runs of letters of all texts, A to Z in lower case and a few damaged as the contract says, with their
    occurrences (of LETTERS and OCCURRENCES at least). Tasks add up before the shuffle, so no frequent word weighs on it."""
    find, lower = re.compile(RUN).findall, str.maketrans(_UPPER, _LOWER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for batch in batches:
            for part in chunks(batch, "text"):
                for doc, value in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    start = zlib.crc32(f"{doc}:".encode())
                    for word, n in Counter(find(value or "")).items():
                        if len(word) >= LETTERS:
                            total[damaged(word.lower() if word.isascii() else word.translate(lower), start, damage)] += n
                if len(total) >= HELD:
                    yield rows()
        yield rows()

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc"), F.col(text).alias("text"))
    found = rows.mapInArrow(run, "word string, n long").where(F.length("word") >= LETTERS)
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OCCURRENCES)


def _fixed(lo: Column, hi: Column, length: Column) -> Column:
    """What is outside of the window lo to hi of words of this length; a word one letter longer has a window one longer."""
    return F.concat(F.substring(F.col("word"), F.lit(1), lo), F.substring(F.col("word"), hi + 1 + F.length("word") - length, F.length("word")))


def _dealt(words: DataFrame) -> DataFrame:
    """lo, hi, fixed, word, n: each word in both halves of its own length and of the length below."""
    size = F.length("word")
    halves = [F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi")) for length in (size, size - 1) for lo, hi in ((F.lit(0), F.floor(length / 2)), (F.floor(length / 2), length))]
    own, below = F.array(*halves[:2]), F.array(*halves)
    each = words.select("word", "n", F.posexplode(F.when(size > LETTERS, below).otherwise(own)).alias("at", "w"))
    length = size - F.when(F.col("at") > 1, 1).otherwise(0)
    return each.select(F.col("w.lo").alias("lo"), F.col("w.hi").alias("hi"), _fixed(F.col("w.lo"), F.col("w.hi"), length).alias("fixed"), "word", "n")


def _halved(rows: DataFrame) -> DataFrame:
    """The rows in both halves of their windows."""
    middle = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    length = F.length("fixed") + F.col("hi") - F.col("lo")
    cut = rows.withColumn("length", length).withColumn("w", F.explode(F.array(F.struct(F.col("lo").alias("a"), middle.alias("b")), F.struct(middle.alias("a"), F.col("hi").alias("b")))))
    return cut.select(F.col("w.a").alias("lo"), F.col("w.b").alias("hi"), _fixed(F.col("w.a"), F.col("w.b"), F.col("length")).alias("fixed"), "word", "n")


def grouped(words: DataFrame, limit: int = GROUP) -> DataFrame:
    """The words dealt to groups of at most limit words (or with a window of one letter)."""
    rows, done = written(_dealt(words), "windows"), None
    while True:
        large = rows.where("hi - lo > 1").groupBy(*_KEY).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > limit)
        large = written(large.select(*_KEY), "large")
        n = large.count()
        if not n:
            return rows if done is None else done.unionByName(rows)
        large = F.broadcast(large) if n <= BROADCAST_KEYS else large.hint("shuffle_hash")
        ready = written(rows.join(large, _KEY, "left_anti"), "ready")
        done = ready if done is None else done.unionByName(ready)
        rows = written(_halved(rows.join(large, _KEY, "left_semi")), "windows")


class PositionIndex:
    """Bitsets over the windows of words: for each position, letter -> the words that have it there."""

    def __init__(self, windows: list[str], width: int):
        self.width, self.all = width, (1 << len(windows)) - 1
        self.at: list[dict[str, int]] = [{} for _ in range(width + 1)]
        if len(windows) <= SMALL:
            for i, window in enumerate(windows):
                bit = 1 << i
                for place, letter in zip(self.at, window, strict=False):
                    place[letter] = place.get(letter, 0) | bit
        else:
            points = np.frombuffer("".join(w.ljust(width + 1, "\0") for w in windows).encode("utf-32-le"), np.uint32).reshape(len(windows), -1)
            for place, column in zip(self.at, points.T, strict=True):
                for point in np.unique(column).tolist():
                    place[chr(point)] = int.from_bytes(np.packbits(column == point, bitorder="little").tobytes(), "little")

    def one_edit(self, window: str) -> tuple[int, int, int]:
        """The words that an edit inside the window leads to: those as long by a replacement, and those longer by an insertion (or,
        if the window is a longer one, those shorter by a deletion), and the words that agree over the short ones' width. The
        sets of unlike length hold others too and are to be masked by length."""
        same, replaced, agreed = self.all, 0, 0
        if len(window) > self.width:  # of a word with a letter more than the short ones
            shifted, before = 0, {}
            for letter, place in zip(window, self.at, strict=True):
                shifted = (shifted & before.get(letter, 0)) | same
                agreed, before = same, place
                same &= place.get(letter, 0)
            return 0, shifted, agreed
        shifted = same  # the other word's first letter is the inserted one
        for i, letter in enumerate(window):
            agrees = self.at[i].get(letter, 0)
            replaced = (replaced & agrees) | (same & ~agrees)
            same &= agrees
            shifted = (shifted & self.at[i + 1].get(letter, 0)) | same
        return replaced, shifted, same


def near_in_group(lo: int, hi: int, fixed: str, words: list[str], counts: list[int]) -> Iterator[tuple[str, int, int, str, int]]:
    """word, n, n_near, form, form_n of the words that have near words in this group (form: the most frequent of those).

    A pair belongs to one window only: to that of the first place at which the words differ (the last window, if the longer
    word only goes on behind the shorter one).
    """
    length = len(fixed) + hi - lo
    order = sorted(range(len(words)), key=lambda i: (-counts[i], words[i]))
    words, counts = [words[i] for i in order], [counts[i] for i in order]
    windows = [w[lo : hi + len(w) - length] for w in words]
    short = sum(1 << i for i, w in enumerate(words) if len(w) == length) if len(words) <= SMALL else int.from_bytes(np.packbits([len(w) == length for w in words], bitorder="little").tobytes(), "little")
    index = PositionIndex(windows, hi - lo)
    long, last = index.all & ~short, hi == length
    if not short:
        return
    for word, n, window in zip(words, counts, windows, strict=True):
        replaced, shifted, agreed = index.one_edit(window)
        shifted &= long if len(word) == length else short
        if shifted and not last:  # a pair that agrees up to the window's end belongs to the next one
            shifted &= ~agreed
        found = (replaced & short) | shifted
        if found:
            best = (found & -found).bit_length() - 1
            yield word, n, found.bit_count(), words[best], counts[best]


def near_words(groups: DataFrame) -> DataFrame:
    """word, n, n_near, form, form_n: a row per word and group in which it has near words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, words, counts = None, [], []
        out: list[tuple] = []

        def close() -> None:
            if len(words) > 1:
                out.extend(near_in_group(*key, words, counts))

        def rows() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()), strict=True)], ["word", "n", "n_near", "form", "form_n"])

        for batch in batches:
            for lo, hi, fixed, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (lo, hi, fixed) != key:
                    close()
                    key, words, counts = (lo, hi, fixed), [], []
                    if len(out) >= 10_000:
                        yield rows()
                words.append(word)
                counts.append(n)
        close()
        if out:
            yield rows()

    dealt = groups.select(*_KEY, "word", "n").repartition(*_KEY).sortWithinPartitions(*_KEY)
    return dealt.mapInArrow(run, "word string, n long, n_near long, form string, form_n long")


def rooted(forms: DataFrame) -> DataFrame:
    """word, root: where following the forms (word, form) ends. Every round doubles the steps taken, and n doubles with each
    step, so there are about six rounds at most."""
    ends = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = ends.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = written(ends.join(further.hint("shuffle_merge"), "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        ends = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return ends


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text: str = "text", limit: int = GROUP) -> DataFrame:
    """word, form, root, n, n_near, form_n of each word of the texts.

    Words are those of word_counts. form is the most frequent near word (ties: the least in code-point order) if it is at
    least twice as frequent, else null, and form_n its occurrences; root is where the forms lead (the word itself if it has
    none); n_near counts the near words. Null and empty texts have no words; a null id counts as the empty text. Repeated
    rows count as often as they occur. An empty table gives no rows; extra columns, whatever their names, are ignored.
    """
    words = written(word_counts(docs, id_col, text), "words")
    found = near_words(grouped(words, limit))
    none = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("string").alias("form"), F.lit(None).cast("long").alias("form_n"))
    best = F.min(F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("minus"), "form"))).alias("best")
    whole = none.unionByName(found).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), best)
    often = -F.col("best.minus") >= TIMES * F.col("n")
    judged = written(whole.select("word", "n", "n_near", F.when(often, F.col("best.form")).alias("form"), F.when(often, -F.col("best.minus")).alias("form_n")), "forms")
    roots = rooted(judged.where("form IS NOT NULL"))
    joined = judged.join(roots.hint("shuffle_merge"), "word", "left")
    return joined.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
