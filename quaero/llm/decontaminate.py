"""Benchmark decontamination by spaced-seed hashing (operator 9).

A seed is a fixed mask over up to nine words: its hash takes four to six of them and ignores the others, so it survives
substitutions at the ignored places. Seeds of test items and of training texts are joined; around each hit, the item and the text are
laid on each other along the hit's diagonal and their words compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import SLOT_BITS, bitmap, chunks, flat_words, is_set, mix, packed, row_hash, slot_of, word_hashes, written

#: Places of the masks, by the words of an item; the last ones are for items of SPAN words and more. Wherever the words of
#: an item of up to STRETCH words, or of such a stretch of a longer one, differ, one of its masks fits somewhere if the
#: share of equal words reaches SHARE; a test enumerates this.
MASKS = {
    5: ((0, 1, 2, 3), (0, 2, 3, 4), (0, 1, 3, 4), (0, 1, 2, 4)),
    6: ((0, 1, 2, 3, 4), (0, 2, 3, 4, 5), (0, 1, 3, 4, 5), (0, 1, 2, 4, 5), (0, 1, 2, 3, 5)),
    7: ((0, 1, 2, 4, 5), (0, 3, 4, 5, 6), (0, 1, 2, 3, 5)),
    8: ((0, 2, 3, 4, 5, 6), (0, 1, 2, 3, 5, 7), (0, 1, 2, 4, 6, 7)),
    9: ((0, 1, 2, 3, 5, 6), (0, 1, 4, 6, 7, 8), (0, 1, 2, 3, 4, 8), (0, 3, 4, 5, 6, 7), (0, 1, 5, 6, 7, 8), (0, 1, 2, 4, 5, 6)),
}
SPAN = 9
#: A text is contaminated if in some stretch of STRETCH words of an item (all of a shorter item) this share is equal.
STRETCH, SHARE = 16, 0.8
#: Items under so many words are too short to be evidence.
LEAST_WORDS = 5
#: Up to so many seeds (some 20 MB) the items' side is broadcast; beyond, both sides are dealt by salted seed.
BROADCAST_SEEDS, SALTS = 500_000, 32
#: Up to so many keys of contaminated rows (8 MB) are broadcast to find their ids.
BROADCAST_ROWS = 1_000_000
PUNCTUATION = ".,;:!?\"'()[]{}#*$%&|<>"


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each word: lower case, without punctuation at its ends."""
    rows, words = flat_words(pc.utf8_lower(pc.fill_null(texts, "")))
    return rows, word_hashes(words, PUNCTUATION)


def seeds(rows: np.ndarray, words: np.ndarray, mask: tuple[int, ...], salt: int) -> tuple[np.ndarray, np.ndarray]:
    """First place and hash of the mask wherever it fits inside one text."""
    n = len(rows) - max(mask)
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    out = np.full(n, salt, np.uint64)
    for k in mask:
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
    fits = np.flatnonzero(rows[:n] == rows[max(mask) : max(mask) + n])
    return fits, mix(out[fits])


def _starts(rows: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(rows, np.arange(n + 1))


def _item_seeds(items: DataFrame) -> DataFrame:
    """item_id, seed, place of all items, and their words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0)
            rows, words = hashed_words(batch.column(1))
            starts = _starts(rows, batch.num_rows)
            length = np.diff(starts)
            for mask, salt, fitting in _masks(set(length.tolist())):
                at, hashes = seeds(rows, words, mask, salt)
                own = fitting(length[rows[at]])
                at, hashes = at[own], hashes[own]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows[at])), pa.array(hashes.view(np.int64)), pa.array(at - starts[rows[at]], pa.int64()), pa.array(length[rows[at]], pa.int64())], ["item_id", "seed", "place", "n_words"])

    return items.mapInArrow(run, "item_id long, seed long, place long, n_words long")


def _masks(lengths: set[int]):
    """The masks for items of these lengths: (mask, salt, which item lengths it is for)."""
    sizes = sorted({min(n, SPAN) for n in lengths if n >= LEAST_WORDS} | {SPAN})
    return [(m, 10 * s + k, lambda n, s=s: np.minimum(n, SPAN) == s) for s in sizes for k, m in enumerate(MASKS[s])]


def _hits(docs: DataFrame, bits, lengths: set[int]) -> DataFrame:
    """row_key, seed, place of the training seeds whose slot some item's seed has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = bits.value
        for batch in batches:
            for part in chunks(batch, "text"):
                rows, words = hashed_words(part.column(1))
                starts = _starts(rows, part.num_rows)
                for mask, salt, _ in _masks(lengths):
                    at, hashes = seeds(rows, words, mask, salt)
                    on = is_set(flags, (hashes & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64))
                    at, hashes = at[on], hashes[on]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows[at])), pa.array(hashes.view(np.int64)), pa.array(at - starts[rows[at]], pa.int64())], ["row_key", "seed", "place"])

    return docs.mapInArrow(run, "row_key long, seed long, place long")


def _words_of(docs: DataFrame, name: str, bits=None) -> DataFrame:
    """The word hashes of each text as one binary value; with bits, of the texts whose slot is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if bits is not None:
                batch = batch.filter(pa.array(is_set(bits.value, batch.column(2).to_numpy())))
            for part in chunks(batch, "text"):
                rows, words = hashed_words(part.column(1))
                starts = _starts(rows, part.num_rows).tolist()
                cut = [words[a:b].tobytes() for a, b in zip(starts, starts[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(cut, pa.binary())], [name, f"{name}_words"])

    return docs.mapInArrow(run, f"{name} long, {name}_words binary")


def overlap(item: np.ndarray, text: np.ndarray, diagonal: int) -> float:
    """The best share of equal words in a stretch of the item laid on the text at a diagonal."""
    n = len(item)
    same = np.zeros(n, bool)
    low, high = max(0, -diagonal), min(n, len(text) - diagonal)
    if high > low:
        same[low:high] = item[low:high] == text[low + diagonal : high + diagonal]
    size = min(STRETCH, n)
    if not size:
        return 0.0
    total = np.concatenate([[0], np.cumsum(same)])
    return float((total[size:] - total[:-size]).max() / size)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """doc_id, item_ids (sorted) and best_share of each document that holds a passage of the benchmark; no other rows.

    Null and empty texts hold nothing; items under LEAST_WORDS words are not looked for. Documents and items without an
    id are judged like others (a null among item_ids is left out). Equal rows, of id and text, are one document. An empty
    table on either side gives no rows; extra columns are ignored.
    """
    return contaminated_rows(docs, benchmark, id_col, text, item_id, item_text).select("doc_id", "item_ids", "best_share")


def contaminated_rows(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """contaminated with row_key, the row_hash of id and text."""
    spark = docs.sparkSession
    rows = docs.select(row_hash(id_col, text).alias("row_key"), F.col(text).alias("text"), F.col(id_col).cast("long").alias("doc_id"))
    items = benchmark.select(row_hash(item_id, item_text).alias("item_id"), F.col(item_text).alias("text"), F.col(item_id).cast("long").alias("item_name"))
    wanted = written(_item_seeds(items.select("item_id", "text")), "seeds")
    lengths = {r.n for r in wanted.where(F.col("n_words") < SPAN).select(F.col("n_words").alias("n")).distinct().collect()}
    n_seeds = wanted.count()
    bits = spark.sparkContext.broadcast(packed(bitmap(wanted.select(slot_of(F.col("seed")).alias("slot")))))
    hits = _hits(rows.select("row_key", "text"), bits, lengths)
    known = wanted.select("seed", "item_id", F.col("place").alias("item_place"))
    if n_seeds <= BROADCAST_SEEDS:
        met = hits.join(F.broadcast(known), "seed")
    else:
        known = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = hits.withColumn("salt", F.pmod(F.col("row_key"), F.lit(SALTS)).cast("int")).join(known.hint("shuffle_hash"), ["seed", "salt"])
    pairs = written(met.select("row_key", "item_id", (F.col("place") - F.col("item_place")).alias("diagonal")).distinct(), "hits")

    # The words of the texts with hits, and of the items, meet the pairs by key.
    slot = slot_of(F.xxhash64("row_key"))
    found = spark.sparkContext.broadcast(packed(bitmap(pairs.select(slot.alias("slot")))))
    texts = _words_of(rows.select("row_key", "text", slot.alias("slot")), "row_key", found)
    of_items = _words_of(items.select("item_id", "text"), "item_id")
    compared = pairs.join(F.broadcast(of_items) if n_seeds <= BROADCAST_SEEDS else of_items.hint("shuffle_merge"), "item_id")
    compared = compared.join(texts.hint("shuffle_merge"), "row_key")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shares = [
                overlap(np.frombuffer(i, np.uint64), np.frombuffer(t, np.uint64), d)
                for d, i, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)
            ]
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(shares, pa.float64())], ["row_key", "item_id", "share"])
            yield out.filter(pc.greater_equal(out.column(2), SHARE))

    shares = written(compared.select("row_key", "item_id", "diagonal", "item_id_words", "row_key_words").mapInArrow(verify, "row_key long, item_id long, share double"), "shares")
    names = items.select("item_id", "item_name").distinct()
    named = shares.groupBy("row_key", "item_id").agg(F.max("share").alias("share")).join(F.broadcast(names) if n_seeds <= BROADCAST_SEEDS else names.hint("shuffle_merge"), "item_id")
    found_rows = written(named.groupBy("row_key").agg(F.array_sort(F.collect_set("item_name")).alias("item_ids"), F.max("share").alias("best_share")), "found")
    few = found_rows.count() <= BROADCAST_ROWS
    ids = rows.select("row_key", "doc_id").join(F.broadcast(found_rows.select("row_key")) if few else found_rows.select("row_key").hint("shuffle_hash"), "row_key", "left_semi").distinct()
    return written(ids, "found_ids").join(found_rows.hint("shuffle_merge"), "row_key")
