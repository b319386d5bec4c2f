"""Quality classifier: a factorisation machine over hashed words and structure statistics (operator 3).

The score of a text is sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j). The pairwise part is computed in time
linear in the number of features by the identity 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import chunks, flat_words, word_hashes

#: Hash buckets of words, rank of the interactions, and the bound on labelled rows that the fit uses.
BUCKETS, RANK, LABELLED_ROWS = 1 << 14, 8, 8000
EPOCHS, RATE, DECAY, SEED = 8, 0.05, 1e-5, 17

_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "symbol": b"#*$%&|<>", "mark": b".,;:", "bang": b"!?", "line": b"\n", "blank": b" \t"}
#: Structure statistics, and the metadata that is free to use: the table's count of characters, by itself and against the
#: bytes that the text has.
STATS = ("log_chars", "bytes_per_char", "log_bytes", "log_words", "word_bytes", "distinct_share", "top_word_share", "repeat_next_share", *_CLASSES)


def features(texts: pa.Array, sizes_told: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, buckets and values of the word features (by row; log counts of unit length) and the statistics of each text.
    sizes_told: the number of characters that the table has for each text; null: not known, and the text's own is taken.

    Null and empty texts have no word features and statistics of 0.
    """
    n = len(texts)
    texts = pc.fill_null(texts, "").cast(pa.string())
    rows, words = flat_words(pc.utf8_lower(texts))
    buckets = (word_hashes(words) & np.uint64(BUCKETS - 1)).astype(np.int64)
    same = np.zeros(len(rows), bool)
    same[1:] = (rows[1:] == rows[:-1]) & (buckets[1:] == buckets[:-1])
    keys, counts = np.unique(rows * BUCKETS + buckets, return_counts=True)
    at, which = keys // BUCKETS, keys % BUCKETS
    values = np.log1p(counts)
    length = np.sqrt(np.bincount(at, values * values, n))
    values = (values / np.maximum(length, 1e-9)[at]).astype(np.float32)

    told = np.maximum(pc.coalesce(sizes_told.cast(pa.int64()), pc.utf8_length(texts).cast(pa.int64())).to_numpy(zero_copy_only=False), 0)
    n_words = np.bincount(rows, minlength=n)
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset] if n else 0
    data = data[first : first + sizes.sum()]
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if n else np.zeros(0, np.int64)
    some = sizes > 0
    share = []
    for chars in _CLASSES.values():
        look = np.zeros(256, np.uint8)
        look[list(chars)] = 1
        total = np.zeros(n)
        if some.any():
            total[some] = np.add.reduceat(look[data], starts[some], dtype=np.int64)
        share.append(total)
    top = np.zeros(n)
    np.maximum.at(top, at, counts)
    per_byte, per_word = np.maximum(sizes, 1), np.maximum(n_words, 1)
    blank = share[-1] + share[-2]
    stats = np.column_stack(
        [np.log1p(told), np.log1p(sizes / np.maximum(told, 1)), np.log1p(sizes), np.log1p(n_words), (sizes - blank) / per_word, np.bincount(at, minlength=n) / per_word, top / per_word, np.bincount(rows, same, n) / per_word, *[s / per_byte for s in share]]
    )
    return at, which, values, stats.astype(np.float32)


@dataclass
class Machine:
    bias: float
    weights: np.ndarray  # BUCKETS + len(STATS)
    factors: np.ndarray  # (BUCKETS + len(STATS), RANK)
    mean: np.ndarray
    spread: np.ndarray

    def scores(self, texts: pa.Array, sizes_told: pa.Array) -> np.ndarray:
        n = len(texts)
        at, which, values, stats = features(texts, sizes_told)
        scaled = np.clip((stats - self.mean) / self.spread, -5, 5)
        raw = self.bias + np.bincount(at, self.weights[which] * values, n) + scaled @ self.weights[BUCKETS:]
        for f in range(RANK):
            v, s = self.factors[:BUCKETS, f][which] * values, scaled * self.factors[BUCKETS:, f]
            total = np.bincount(at, v, n) + s.sum(1)
            raw = raw + 0.5 * (total * total - np.bincount(at, v * v, n) - (s * s).sum(1))
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def held_out(key):
    """Whether crc32 of the id as text leaves 2 when divided by 4: such rows never train."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def _told(docs: DataFrame, n_chars: str):
    """The table's count of characters, null if it has none."""
    return (F.col(n_chars) if n_chars in docs.columns else F.lit(None)).cast("long")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", n_chars: str = "n_chars") -> Machine:
    """Fit on labelled documents outside the held-out rows.

    The rows are all of them up to LABELLED_ROWS, or about that many chosen by a hash of the id. Their features, not
    their texts, come to the driver: at most LABELLED_ROWS * BUCKETS values whatever the corpus. The labels join by
    broadcast, as they are bounded alike. Null labels are left out; without any label all scores are 0.5.
    """
    usable = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).where(~held_out(F.col(id_col)))
    step = max(1, -(-usable.count() // LABELLED_ROWS))
    chosen = usable.where(F.pmod(F.xxhash64(id_col), F.lit(step)) == 0).groupBy(F.col(id_col).alias("label_key")).agg(F.max(label).cast("double").alias("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                at, which, values, stats = features(part.column(1), part.column(2))
                cut = np.searchsorted(at, np.arange(part.num_rows + 1))
                spans = list(zip(cut[:-1], cut[1:], strict=True))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([which[a:b].astype(np.uint16).tobytes() for a, b in spans], pa.binary()), pa.array([values[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([s.tobytes() for s in stats], pa.binary())],
                    ["y", "buckets", "data", "stats"],
                )

    taken = docs.select(F.col(id_col).alias("label_key"), F.col(text).alias("text"), _told(docs, n_chars).alias("told")).join(F.broadcast(chosen), "label_key")
    first = F.min_by(F.struct("y", "text", "told"), F.struct(F.xxhash64("text"), "told"))
    taken = taken.groupBy("label_key").agg(first.alias("one")).select("one.y", "one.text", "one.told")
    rows = taken.mapInArrow(run, "y double, buckets binary, data binary, stats binary").collect()
    size = BUCKETS + len(STATS)
    rng = np.random.default_rng(SEED)
    weights, factors, bias = np.zeros(size), rng.normal(0, 0.01, (size, RANK)), 0.0
    if not rows:
        return Machine(0.0, weights.astype(np.float32), np.zeros((size, RANK), np.float32), np.zeros(len(STATS)), np.ones(len(STATS)))
    rows = sorted(rows, key=lambda r: (bytes(r.stats), r.y))  # one order whatever the partitions
    stats = np.array([np.frombuffer(r.stats, np.float32) for r in rows], np.float64)
    mean, spread = stats.mean(0), stats.std(0) + 1e-6
    scaled = np.clip((stats - mean) / spread, -5, 5)
    tail = np.arange(BUCKETS, size)
    index = [np.concatenate([np.frombuffer(r.buckets, np.uint16).astype(np.int64), tail]) for r in rows]
    value = [np.concatenate([np.frombuffer(r.data, np.float32).astype(np.float64), s]) for r, s in zip(rows, scaled, strict=True)]
    y = np.array([r.y > 0 for r in rows], float)
    sum_w, sum_v, sum_b = np.full(size, 1e-2), np.full((size, RANK), 1e-2), 1e-2
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            at, x = index[i], value[i]
            v = factors[at]
            total = x @ v
            raw = bias + weights[at] @ x + 0.5 * (total @ total - ((v * x[:, None]) ** 2).sum())
            error = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[i]
            g = error * x + DECAY * weights[at]
            sum_w[at] += g * g
            weights[at] -= RATE * g / np.sqrt(sum_w[at])
            gv = error * (x[:, None] * total - v * (x * x)[:, None]) + DECAY * v
            sum_v[at] += gv * gv
            factors[at] -= RATE * gv / np.sqrt(sum_v[at])
            sum_b += error * error
            bias -= RATE * error / np.sqrt(sum_b)
    return Machine(float(bias), weights.astype(np.float32), factors.astype(np.float32), mean, spread)


def quality_scores(docs: DataFrame, machine: Machine, text: str = "text", column: str = "quality_score", n_chars: str = "n_chars") -> DataFrame:
    """docs with a column for the score (0 to 1). Null texts are scored as empty ones, and where docs has no count of
    characters the text's own is taken. All rows and columns are kept."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    @F.arrow_udf("double")
    def score(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, told in batches:
            parts = [shared.value.scores(part.column(0), part.column(1)) for part in chunks(pa.RecordBatch.from_arrays([texts, told], ["text", "told"]), "text")]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return docs.withColumn(column, score(F.col(text), _told(docs, n_chars)))


def quality_classifier(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= threshold) of each document.

    Learns from labels.quality of rows that aren't held out; labels, lang, source and the id are no inputs of a score, but
    n_chars is where the table has it.
    Null and empty texts get the score of a text without features. Each row is scored by itself, so repeated rows give
    repeated rows. An empty table gives no rows; extra columns are ignored.
    """
    machine = fit(docs, labels, id_col, text)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text).alias("body_text"), _told(docs, "n_chars").alias("n_chars"))
    scored = quality_scores(rows, machine, "body_text")
    return scored.select("doc_id", "held_out", F.col("quality_score").alias("score"), (F.col("quality_score") >= threshold).cast("int").alias("predicted"))
