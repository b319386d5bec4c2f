"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one step inside a task works on; bounds a worker's memory whatever the batch size.
CHUNK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder that the driver and all executors see.

    It lies under spark.checkpoint.dir. Where that is unset (local tests) it lies under the warehouse.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/quaero-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage and gives Spark true sizes."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def chunks(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of batch whose values in column total about limit bytes; a longer value comes alone."""
    if not batch.num_rows:
        return
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    cut = np.cumsum(size, dtype=np.int64) // limit
    edges = np.flatnonzero(np.diff(cut)) + 1
    start = 0
    for end in [*edges.tolist(), batch.num_rows]:
        yield batch.slice(start, end - start)
        start = end


def flat_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Row number of each whitespace-separated word, and the words; null texts have none."""
    lists = pc.utf8_split_whitespace(pc.fill_null(texts, ""))
    words, rows = lists.flatten(), pc.list_parent_indices(lists)
    some = pc.greater(pc.binary_length(words), 0)
    return rows.filter(some).to_numpy().astype(np.int64), words.filter(some)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Bytes of words that are hashed together, and the factor and letters of the polynomial that hashes them.
_HASHED, _FACTOR = 1 << 19, 0xD1342543DE82EF95
_LETTERS = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(max(n, 1), _FACTOR, np.uint64))


def word_hashes(words: pa.Array, trim: str = "") -> np.ndarray:
    """64-bit hash of each word (a polynomial of its bytes), without the characters of trim at its ends."""
    if trim:
        words = pc.utf8_trim(words, characters=trim)
    out = np.zeros(len(words), np.uint64)
    if not len(words):
        return out
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
    sizes = np.diff(offsets)
    powers = _powers(int(sizes.max()))
    start = 0
    while start < len(words):
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + _HASHED, "right")) - 1)
        own = start + np.flatnonzero(sizes[start:stop])  # empty words keep 0
        if len(own):
            first = offsets[own] - offsets[start]
            place = np.arange(offsets[stop] - offsets[start], dtype=np.int32) - np.repeat(first, sizes[own])
            terms = _LETTERS[data[offsets[start] : offsets[stop]]]
            terms *= powers[place]
            out[own] = np.add.reduceat(terms, first)
        start = stop
    return mix(out)


def shingles(rows: np.ndarray, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and 64-bit hash of each window of size words; a shorter text has one window of all its words."""
    n = len(rows)
    if not n:
        return rows, hashes
    factor = np.uint64(0x9E3779B97F4A7C15)
    out = np.zeros(n, np.uint64)
    inside = np.ones(n, bool)
    first = np.ones(n, bool)
    first[1:] = rows[1:] != rows[:-1]
    for k in range(size):
        end = max(0, n - k)
        same = np.zeros(n, bool)
        same[:end] = rows[k:] == rows[:end]
        keep = same | first  # the first window of a short text goes on without the missing words
        shifted = np.zeros(n, np.uint64)
        shifted[:end] = hashes[k:]
        out = np.where(same, out * factor + shifted, out)
        inside &= keep
    return rows[inside], mix(out[inside])


def fresh(df: DataFrame, name: str) -> str:
    """A column name like this one that df doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_hash(id_col: str, text: str) -> Column:
    """A 64-bit key of a row's id (null or not) and whole text: equal rows have equal keys."""
    return F.xxhash64(F.col(id_col).isNull(), F.col(id_col).cast("long"), F.col(text))


#: Slots of a key bitmap: 2 MB whatever the number of keys. More keys let more rows through, and never fewer.
SLOT_BITS = 24


def slot_of(hashed: Column) -> Column:
    """The bitmap slot of a 64-bit hash."""
    return F.pmod(hashed, F.lit(1 << SLOT_BITS))


def bitmap(slots: DataFrame) -> np.ndarray:
    """One flag per slot, set for the values of the only column. At most 512 rows of 4 KB reach the driver."""
    at = F.col(slots.columns[0]) + 1
    rows = slots.groupBy(F.bitmap_bucket_number(at).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()
    out = np.zeros(1 << SLOT_BITS, bool)
    for r in rows:
        bits = np.unpackbits(np.frombuffer(bytes(r.bits), np.uint8), bitorder="little")
        out[(r.bucket - 1) * 32768 : r.bucket * 32768] = bits.astype(bool)
    return out


def packed(flags: np.ndarray) -> np.ndarray:
    return np.packbits(flags, bitorder="little")


def is_set(bits: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Whether each slot is set in a packed bitmap."""
    return (bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1
