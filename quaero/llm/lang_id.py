"""Language identification by averaged hashed subword embeddings and a linear softmax (operator 12).

A text is its words of letters, in lower case; a word is the byte runs of 2 to 5 bytes of "<word>" and itself, each hashed to a
row of an embedding table. The average of all of a text's embeddings goes through a linear softmax. Both are trained by
stochastic gradient descent in numpy, on passages of a bounded sample of the labelled rows. A share of that sample is kept out of
the training and calibrates the model: a temperature makes the scores probabilities, and a threshold rejects texts whose
score is too low to be trusted.

For scoring, embeddings and softmax are multiplied out once, so that a distinct word of a chunk is looked up once and
every text of any length is a weighted sum over its words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import chunks, mix

#: Held-out rows of the contract: those whose crc32 of the id as text has this remainder.
FOLDS, HELD_OUT = 5, 0
#: Rows of the embedding table and its width, bytes of a subword.
BUCKETS, WIDTH, SIZES = 1 << 16, 16, (2, 3, 4, 5)
#: Longer words are read in pieces of so many letters. Bytes of distinct words that are looked up together.
LONGEST, LOOKUP = 24, 1 << 18
#: Bounds of training: rows of the sample (dealt evenly to the languages), languages (the most frequent ones), subwords of a row's
#: passages, and how many passages. The driver holds ROWS * SUBWORDS * 4 bytes (12 MB) at most.
ROWS, LANGUAGES, SUBWORDS, PASSAGES = 6000, 256, 512, 2
#: One in so many sampled rows calibrates. Wanted precision of accepted texts on these.
CALIBRATES, PRECISION = 4, 0.99
#: Descents of at least so many batches of examples, whole passes over the sample each, and the first step.
STEPS, BATCH, STEP = 300, 64, 1.0
UNKNOWN = "und"


def words_of(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Row and word of each word of letters (marks of letters belong to it) of the texts."""
    low = pc.replace_substring_regex(pc.utf8_lower(pc.fill_null(texts, "")), r"[^\p{L}\p{M}]+", " ")
    low = pc.replace_substring_regex(low, r"(\S{%d})" % LONGEST, r"\1 ")
    lists = pc.utf8_split_whitespace(low)
    words, rows = lists.flatten(), pc.list_parent_indices(lists)
    some = pc.greater(pc.binary_length(words), 0)
    return rows.filter(some).to_numpy().astype(np.int64), words.filter(some)


def subwords(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The table rows of all subwords, those of a word together, and how many each word has."""
    data = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.repeat(np.cumsum(sizes), sizes)
    at = np.arange(len(data))
    owner = np.repeat(np.arange(len(words)), sizes)
    codes, owners = [], []
    rolled = data + np.uint64(1)
    for n in range(1, max(SIZES)):
        following = np.zeros(len(data), np.uint64)
        following[:-n] = data[n:]
        rolled = rolled * np.uint64(257) + following + np.uint64(1)
        if n + 1 in SIZES:
            whole = at + n + 1 <= ends
            codes.append(mix(rolled[whole] * np.uint64(8) + np.uint64(n)))
            owners.append(owner[whole])
    # The word itself: a polynomial of its bytes.
    powers = np.cumprod(np.full(int(sizes.max(initial=1)), 0xD1342543DE82EF95, np.uint64))
    starts = np.cumsum(sizes) - sizes
    place = at - np.repeat(starts, sizes)
    codes.append(mix(np.add.reduceat((data + np.uint64(1)) * powers[place], starts)) if len(words) else np.zeros(0, np.uint64))
    owners.append(np.arange(len(words)))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return (np.concatenate(codes)[order] & np.uint64(BUCKETS - 1)).astype(np.int64), np.bincount(owner, minlength=len(words))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


@dataclass(frozen=True)
class Identifier:
    """A trained model: languages, table (embeddings times softmax weights), bias, temperature, least accepted score."""

    languages: tuple[str, ...]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, texts: pa.Array) -> np.ndarray:
        """A row per text; of zeros, with -inf bias aside, where it has no word: see has_letter."""
        rows, words = words_of(texts)
        k, many = len(self.languages), len(texts)
        sums, counts = np.zeros((many, k)), np.zeros(many)
        if len(words):
            coded = words.dictionary_encode()
            which, distinct = coded.indices.to_numpy(), [w.encode() for w in coded.dictionary.to_pylist()]
            total, n = np.zeros((len(distinct), k)), np.zeros(len(distinct))
            cut = np.cumsum([len(w) + 2 for w in distinct]) // LOOKUP
            for part in np.split(np.arange(len(distinct)), np.flatnonzero(np.diff(cut)) + 1):
                ids, sizes = subwords(distinct[part[0] : part[-1] + 1])
                total[part] = np.add.reduceat(self.table[ids], np.cumsum(sizes) - sizes)
                n[part] = sizes
            for j in range(k):
                sums[:, j] = np.bincount(rows, total[which, j], many)
            counts = np.bincount(rows, n[which], many)
        return sums / np.maximum(counts, 1)[:, None] + self.bias

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; UNKNOWN and 0 for a text without a letter."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        chances = softmax(self.logits(texts) / self.temperature)
        best = chances.argmax(1)
        lettered = pc.match_substring_regex(pc.fill_null(texts, ""), r"\p{L}").to_numpy(zero_copy_only=False)
        return [self.languages[b] if some else UNKNOWN for b, some in zip(best.tolist(), lettered.tolist(), strict=True)], np.where(lettered, chances.max(1), 0.0)


def held_out(id_col: str) -> Column:
    return F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "utf-8")) % FOLDS == HELD_OUT


def _passages(words: pa.Array) -> np.ndarray:
    """Subwords of a text's passages, which are runs of words that lie evenly in it (all of its words, if they are few)."""
    each = SUBWORDS // PASSAGES
    some = each // 4  # a word has four subwords at least
    starts = [len(words) * k // PASSAGES for k in range(PASSAGES)] if len(words) > some else [0]
    return np.concatenate([subwords([w.encode() for w in words.slice(a, some).to_pylist()])[0][:each] for a in starts])


def _sample(docs: DataFrame, languages: dict[str, int], lang: str) -> DataFrame:
    """number (of the language), calibrates, text of about ROWS rows, as many of each language."""
    each = max(1, ROWS // max(1, len(languages)))
    rate = F.element_at(F.create_map(*[x for name, n in languages.items() for x in (F.lit(name), F.lit(min(1.0, each / n)))]), F.col(lang))
    number = F.element_at(F.create_map(*[x for k, name in enumerate(languages) for x in (F.lit(name), F.lit(k))]), F.col(lang))
    draw = F.xxhash64(F.col("text"), F.col("doc"), F.lit("sample"))
    taken = docs.where(F.col(lang).isin(*languages)).where(F.pmod(draw, F.lit(1 << 20)) < rate * (1 << 20))
    return taken.select(number.alias("number"), (F.pmod(F.shiftright(draw, 24), F.lit(CALIBRATES)) == 0).alias("calibrates"), "text")


def train(examples: list[np.ndarray], labels: np.ndarray, k: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """table and bias by stochastic gradient descent over batches of examples; the step falls to zero on the way."""
    rnd = np.random.default_rng(seed)
    embeddings = rnd.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH))
    weights, bias = np.zeros((WIDTH, k)), np.zeros(k)
    batches = math.ceil(len(examples) / BATCH)
    passes = math.ceil(STEPS / batches)
    done = 0
    for _ in range(passes):
        for part in np.array_split(rnd.permutation(len(examples)), batches):
            rate = STEP * (1 - done / (passes * batches))
            done += 1
            sizes = np.array([len(examples[i]) for i in part])
            flat = np.concatenate([examples[i] for i in part])
            mean = np.add.reduceat(embeddings[flat], np.cumsum(sizes) - sizes) / sizes[:, None]
            slope = softmax(mean @ weights + bias)
            slope[np.arange(len(part)), labels[part]] -= 1
            back = slope @ weights.T
            weights -= rate * mean.T @ slope / len(part) * WIDTH
            bias -= rate * slope.mean(0)
            share = np.repeat(back / sizes[:, None], sizes, axis=0) * rate
            used, index = np.unique(flat, return_inverse=True)
            for d in range(WIDTH):
                embeddings[used, d] -= np.bincount(index, share[:, d])
    return embeddings @ weights, bias


def calibrated(logits: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """The temperature of least log-loss, and the least score from which on the wanted precision holds (over 1: none does)."""
    losses = [(-np.log(np.maximum(softmax(logits / t)[np.arange(len(labels)), labels], 1e-12)).mean(), t) for t in np.geomspace(0.05, 20, 60).tolist()]
    temperature = min(losses)[1]
    chances = softmax(logits / temperature)
    score, right = chances.max(1), chances.argmax(1) == labels
    order = np.argsort(-score, kind="stable")
    precise = np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= PRECISION
    return temperature, float(score[order][np.flatnonzero(precise)[-1]]) if precise.any() else 1.1


def fit(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> Identifier:
    """A model from the rows that are not held out and have a text and a language."""
    rows = docs.where(~held_out(id_col)).select(F.col(id_col).cast("string").alias("doc"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    languages = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()}
    languages = dict(sorted(languages.items()))
    if not languages:
        return Identifier((), np.zeros((BUCKETS, 0)), np.zeros(0))
    sample = _sample(rows, languages, "lang")

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                rows, words = words_of(part.column(1))
                cut = np.searchsorted(rows, np.arange(part.num_rows + 1)).tolist()
                out = [_passages(words.slice(a, b - a)).astype(np.int32).tobytes() if b > a else None for a, b in zip(cut, cut[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], ["number", "ids"])

    learned = sample.where("NOT calibrates").select("number", "text").mapInArrow(passages, "number int, ids binary").where("ids IS NOT NULL").toArrow()
    if not learned.num_rows:
        return Identifier(tuple(languages), np.zeros((BUCKETS, len(languages))), np.zeros(len(languages)))
    # In an order of their own, not of the tasks.
    found = sorted(zip(learned.column("number").to_pylist(), learned.column("ids").to_pylist(), strict=True))
    table, bias = train([np.frombuffer(ids, np.int32) for _, ids in found], np.array([n for n, _ in found]), len(languages))
    plain = Identifier(tuple(languages), table, bias)
    shared = docs.sparkSession.sparkContext.broadcast(plain)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(shared.value.logits(part.column(1))), pa.list_(pa.float64()))], ["number", "logits"])

    kept = sample.where("calibrates").select("number", "text").mapInArrow(scored, "number int, logits array<double>").toArrow()
    if not kept.num_rows:
        return plain
    temperature, threshold = calibrated(np.array(kept.column("logits").to_pylist()), kept.column("number").to_numpy())
    return Identifier(plain.languages, table, bias, temperature, threshold)


def identified(docs: DataFrame, model: Identifier, text: str = "text", prediction: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the predicted language of each whole text and its score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at, names = docs.columns.index(text), [*docs.columns, prediction, score]
    schema = docs.select("*", F.lit("").alias(prediction), F.lit(0.0).alias(score)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.rename_columns([f"c{k}" for k in range(batch.num_columns)])
            for part in chunks(batch, f"c{at}"):
                languages, scores = shared.value.predict(part.column(at))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(languages, pa.string()), pa.array(scores)], names)

    return docs.mapInArrow(run, schema)


def language_id(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, accepted of each row.

    The model learns from rows that are not held out, and from their text and language only. lang_pred is a learned language, or
    "und" (score 0) for a null text or one without a letter. score is the calibrated probability of the language; accepted is
    false where it is under the calibrated threshold, and for "und". Where nothing can be learned every row is "und".
    Every row is judged by itself: repeated rows give repeated rows, null ids stay null (and are held out, as the empty text is). An
    empty table gives no rows; extra columns, whatever their names, are ignored.
    """
    model = fit(docs, id_col, text, lang)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text).alias("text"))
    found = identified(rows, model).drop("text")
    return found.withColumn("accepted", (F.col("lang_pred") != UNKNOWN) & (F.col("score") >= model.threshold))
