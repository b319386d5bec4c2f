"""A text model trained here: factors of word co-occurrences, averaged over a text's words.

Words that stand near each other are counted over all notes by Spark, for the VOCABULARY words that most notes have. What reaches
the driver is at most VOCABULARY squared counts; their positive pointwise mutual information is factored there. The model is
a table of a few megabytes at most (word, weight, vector). Texts are embedded in batches by predict_batch_udf: the sum of their words'
vectors by weight, at unit length; texts without a known word, empty and null ones get a zero vector.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ..sources.store import stored

#: Words of the model, length of its vectors, how far apart two words may stand, texts of a batch.
VOCABULARY, DIMENSION, WINDOW, BATCH = 2048, 64, 4, 256
#: What a word is, for Spark and for Python alike: a run of letters or digits in lower case.
WORD = r"[\p{L}\p{N}]+"
SCHEMA = "word string, weight double, vector array<float>"


def words(text: Column) -> Column:
    """The words of a text in order, repeated ones too."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def vocabulary(texts: DataFrame, size: int = VOCABULARY) -> DataFrame:
    """word, n, place (from 0): the words that most texts have, ties by word; n is the number of those texts."""
    counts = texts.select(F.explode(F.array_distinct(words(F.col("text")))).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.desc("n"), "word").limit(size)
    return top.withColumn("place", F.expr("row_number() OVER (ORDER BY n DESC, word) - 1"))  # over size rows


def co_occurrences(texts: DataFrame, known: DataFrame, window: int = WINDOW) -> DataFrame:
    """a, b (places of words, a <= b), n: how often two known words stand up to `window` words apart, in either order.

    Texts of any length give `window` rows a word; both words are looked up (the vocabulary has a fixed size and is broadcast)
    before anything is shuffled, and tasks add up their counts, so at most size squared rows leave a task.
    """
    each = texts.select(words(F.col("text")).alias("w"))
    apart = [F.arrays_zip(F.slice("w", 1, F.greatest(F.lit(0), F.size("w") - d)).alias("a"), F.slice("w", d + 1, F.greatest(F.lit(0), F.size("w") - d)).alias("b")) for d in range(1, window + 1)]
    pairs = each.select(F.array(*apart).alias("z")).select(F.explode("z").alias("z")).select(F.explode("z").alias("z")).select("z.a", "z.b")
    side = lambda name: F.broadcast(known.select(F.col("word").alias(name), F.col("place").alias(f"{name}_place")))
    met = pairs.join(side("a"), "a").join(side("b"), "b")
    return met.groupBy(F.least("a_place", "b_place").alias("a"), F.greatest("a_place", "b_place").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def factors(a: np.ndarray, b: np.ndarray, n: np.ndarray, size: int, dimension: int = DIMENSION) -> np.ndarray:
    """Word vectors (size x dimension) from the symmetric counts: the greatest eigenvectors of their positive mutual information,
    by the root of their eigenvalues. Signs are fixed by each one's greatest component, so equal counts give equal vectors."""
    counts = np.zeros((size, size))
    counts[a, b] = n
    counts = counts + counts.T
    own = counts.sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        shared = np.log(counts * counts.sum() / np.outer(own, own))
    values, axes = np.linalg.eigh(np.where(counts > 0, np.maximum(shared, 0.0), 0.0))
    first = np.argsort(-values, kind="stable")[:dimension]
    axes = axes[:, first] * np.sign(axes[np.abs(axes[:, first]).argmax(0), first])
    out = np.zeros((size, dimension))
    out[:, : len(first)] = axes * np.sqrt(np.maximum(values[first], 0.0))
    return out


def trained(texts: DataFrame, size: int = VOCABULARY, dimension: int = DIMENSION) -> DataFrame:
    """word, weight, vector of the model of these texts (text), written; without any text an empty table.

    A word weighs ln(1 + N / n) for n of N texts.
    """
    spark = texts.sparkSession
    known = stored(vocabulary(texts, size))
    n_texts = texts.count()
    top = known.orderBy("place").collect()  # at most size rows
    if not top:
        return spark.createDataFrame([], SCHEMA)
    met = co_occurrences(texts, known).toArrow()  # at most size squared rows of three numbers
    a, b, n = (met.column(c).to_numpy() for c in ("a", "b", "n"))
    vectors = factors(a, b, n, len(top), dimension).astype(np.float32)
    rows = [(r.word, float(np.log(1 + n_texts / r.n)), [float(x) for x in v]) for r, v in zip(top, vectors)]
    return stored(spark.createDataFrame(rows, SCHEMA))


def encoder(model: DataFrame):
    """A column function: the vector of a text by the model, which goes to the tasks as a broadcast variable."""
    rows = model.collect()  # the vocabulary, of a fixed size
    places = {r.word: k for k, r in enumerate(rows)}
    weighted = np.array([np.array(r.vector) * r.weight for r in rows], np.float32).reshape(len(rows), -1 if rows else 1)
    sent = model.sparkSession.sparkContext.broadcast((places, weighted))

    def make():
        import regex

        word, (known, vectors) = regex.compile(WORD), sent.value

        def predict(texts: np.ndarray) -> np.ndarray:
            out = np.zeros((len(texts), vectors.shape[1]), np.float32)
            for i, text in enumerate(texts):
                at = [known[w] for w in word.findall(text) if w in known]
                if at:
                    out[i] = vectors[at].sum(0)
            return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

        return predict

    run = predict_batch_udf(make, return_type=ArrayType(FloatType()), batch_size=BATCH)
    return lambda text: run(F.lower(F.coalesce(text, F.lit(""))))


def embedded_by(model: DataFrame, rows: DataFrame) -> DataFrame:
    """key, embedding of the distinct keys of rows (key, text)."""
    return rows.dropDuplicates(["key"]).select("key", encoder(model)(F.col("text")).alias("embedding"))
