"""Token counts from pre-token frequencies (operator 2).

A text falls into pre-tokens that no vocabulary piece crosses, so its token count is the sum, over its distinct
pre-tokens, of frequency times the pieces of that pre-token. Ids are never made for a document.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import chunks, row_hash, written

#: Bounds of the broadcast head: about so many texts in the pilot, pre-tokens kept (some 10 MB), the length up to which
#: they are kept from the start, and the longer ones kept besides.
PILOT_TEXTS, HEAD_PRETOKENS, HEAD_LENGTH, LONG_PRETOKENS, LONG_LENGTH = 4000, 120_000, 48, 1000, 2048
#: A pre-token in a thousandth of all rows is in the pilot, and so in the head if it is short. Longer ones are dealt by salt,
#: so that one in a large share of all texts goes to so many tasks.
SALTS = 16

_processors: dict[str, object] = {}


def processor(model: str):
    """The sentencepiece model, loaded once per worker."""
    import sentencepiece

    if model not in _processors:
        _processors[model] = sentencepiece.SentencePieceProcessor(model_file=model)
    return _processors[model]


#: Runs of blanks with the word behind them; blanks before a line end or at the end; each line end alone.
PRETOKEN = re.compile("[ ▁]*[^ ▁\n]+|[ ▁]+|\n")


def check_model(model: str) -> None:
    """Refuse a model whose pieces could cross a pre-token border, or that rewrites its input."""
    sp = processor(model)
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        if re.search("[^▁]▁", piece) or "\n" in piece:
            raise ValueError(f"piece {piece!r} crosses a pre-token border")
    probe = " a  Åﬁ "
    if sp.decode(sp.encode(probe)) != probe or sp.encode(probe, out_type=str)[0] != "▁":
        raise ValueError("the model rewrites its input")


def pretokens(text: str) -> list[str]:
    """The pre-tokens of a text, with the blank that the model puts before it; none for an empty text."""
    return PRETOKEN.findall(f" {text}") if text else []


def piece_counts(model: str, tokens: list[str]) -> list[int]:
    """Pieces of each pre-token. The line end in front keeps the model's own blank (one piece, like the line end) apart."""
    return [len(x) - 2 for x in processor(model).encode([f"\n{t}" for t in tokens], num_threads=1)]


def _head(docs: DataFrame, id_col: str, text: str, model: str) -> dict[str, int]:
    """Piece counts of the commonest pre-tokens of a bounded pilot, spread over the rows of the whole table. Only speed
    depends on it."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()
        for batch in batches:
            for value in batch.column(0).to_pylist():
                total.update(pretokens(value or ""))
        top = [(w, n) for w, n in total.most_common(HEAD_PRETOKENS) if len(w) <= LONG_LENGTH]
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["pretoken", "n"])

    step = max(1, docs.count() // PILOT_TEXTS)
    pilot = docs.where(F.pmod(row_hash(id_col, text), F.lit(step)) == 0).select(text)
    counted = written(pilot.mapInArrow(tally, "pretoken string, n long").groupBy("pretoken").agg(F.sum("n").alias("n")).where("n > 1"), "pilot")
    words = []
    for long, most in ((False, HEAD_PRETOKENS), (True, LONG_PRETOKENS)):
        own = counted.where((F.length("pretoken") > HEAD_LENGTH) == F.lit(long))
        words += [r.pretoken for r in own.orderBy(F.desc("n"), "pretoken").limit(most).collect()]
    return dict(zip(words, piece_counts(model, words), strict=True))


#: row_key and text_key name a row: its id (null or not) and a 64-bit hash of its text. A true pre-token has salt 0 and more,
#: the sum over the head -1.
_FREQUENCIES = "row_key long, text_key long, pretoken string NOT NULL, salt int NOT NULL, n long, n_bytes long"


def pretoken_frequencies(docs: DataFrame, head, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """row_key, text_key, pretoken, salt, n, n_bytes: a row per document and pre-token outside the head, and one per
    document for the sum over the head (salt -1, the pre-token spreads it): its n are pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = head.value
        for batch in batches:
            for part in chunks(batch, "text"):
                rows, words, salts, times, sizes = [], [], [], [], []
                for k, (key, value) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)):
                    value, total = value or "", 0
                    for word, n in Counter(pretokens(value)).items():
                        if (pieces := known.get(word)) is None:
                            rows.append(k)
                            words.append(word)
                            salts.append(key % SALTS if len(word) > HEAD_LENGTH else 0)
                            times.append(n)
                            sizes.append(0)
                        else:
                            total += n * pieces
                    rows.append(k)
                    words.append(str(key))
                    salts.append(-1)
                    times.append(total)
                    sizes.append(len(value.encode()))
                at = pa.array(rows, pa.int64())
                columns = [part.column(0).take(at), part.column(1).take(at), pa.array(words, pa.string()), pa.array(salts, pa.int32()), pa.array(times, pa.int64()), pa.array(sizes, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["row_key", "text_key", "pretoken", "salt", "n", "n_bytes"])

    text_key = F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    rows = docs.select(F.col(id_col).cast("long").alias("row_key"), text_key.alias("text_key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, _FREQUENCIES)


def token_counts(docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) for each document.

    Pieces are counted once per distinct pre-token of the corpus and joined to the per-document frequencies on the
    pre-token. The commonest pre-tokens, of which every document has some, are a bounded broadcast table and are
    summed where the text is read, so no hot key meets the shuffle.
    Null and empty texts have 0 bytes and 0 tokens. Each row is a document of its own, whatever its id (null too).
    An empty table gives an empty result; extra columns, whatever their names, are ignored.
    """
    check_model(model)
    head = docs.sparkSession.sparkContext.broadcast(_head(docs, id_col, text, model))
    dealt = pretoken_frequencies(docs, head, id_col, text).repartition("pretoken", "salt")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, salts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            own = [i for i, s in enumerate(salts) if s >= 0]
            pieces = [1] * len(words)
            for i, n in zip(own, piece_counts(model, [words[i] for i in own]), strict=True):
                pieces[i] = n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pieces, pa.int64())], [*batch.schema.names, "pieces"])

    # No pre-token is null, and the totals are kept, that this side reads the same columns, and so the same shuffle, as the other.
    totals = [F.sum("n").alias("in_corpus"), F.max("row_key").alias("last_key"), F.max("text_key").alias("last_text"), F.sum("n_bytes").alias("head_bytes")]
    vocabulary = dealt.groupBy("pretoken", "salt").agg(*totals)
    vocabulary = vocabulary.mapInArrow(count, "pretoken string NOT NULL, salt int NOT NULL, in_corpus long, last_key long, last_text long, head_bytes long, pieces long")
    joined = dealt.join(vocabulary.hint("shuffle_merge"), ["pretoken", "salt"]).where("in_corpus IS NOT NULL")
    # Equal rows have equal keys: their sums are divided by how many they are, and each of them has a row.
    summed = joined.groupBy("row_key", "text_key").agg(F.sum("n_bytes").alias("n_bytes"), F.sum(F.col("n") * F.col("pieces")).alias("n_tokens"), F.count_if(F.col("salt") < 0).alias("n_rows"))
    each = summed.select("row_key", F.expr("n_bytes div n_rows").alias("n_bytes"), F.expr("n_tokens div n_rows").alias("n_tokens"), F.explode(F.expr("array_repeat(0, int(n_rows))")))
    return each.select(F.col("row_key").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
