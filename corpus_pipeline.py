"""A training corpus from documents: quality, near duplicates, benchmark passages, secrets, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and returns a DataFrame; all but
the last return the columns of docs. Null and empty texts pass through the stages as empty texts. Stages judge rows, not
ids: rows with equal or null ids are documents of their own, and a duplicate takes no other text of its id with it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaero.llm.bpe_automaton import bpe_round_trip
from quaero.llm.decontaminate import contaminated_rows
from quaero.llm.near_dedup import row_classes
from quaero.llm.quality_model import fit, quality_scores
from quaero.llm.secret_scan import redacted
from quaero.llm.shared import fresh, row_hash, table, written

#: Least quality score of a document that stays.
THRESHOLD = 0.7
#: Up to so many keys (8 MB) of rows to take out are broadcast; more are joined by shuffle.
BROADCAST_KEYS = 1_000_000


def _without(docs: DataFrame, key: Column, keys: DataFrame) -> DataFrame:
    """docs without the rows whose key is among keys (one column, already written)."""
    few = keys.count() <= BROADCAST_KEYS
    keys = keys.toDF(fresh(docs, "gone_key"))
    return docs.join(F.broadcast(keys) if few else keys.hint("shuffle_hash"), key == F.col(keys.columns[0]), "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is below the threshold go."""
    machine = fit(docs, table(spark, sf_dir, "labels"))
    score = fresh(docs, "quality_score")
    return quality_scores(docs, machine, column=score).where(F.col(score) >= THRESHOLD).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the row with the least id stays, and of equal ids one."""
    number = fresh(docs, "row_number")
    numbered = written(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    classes = row_classes(numbered.select(F.col(number).alias("row_key"), F.col("doc_id").cast("long").alias("doc_key"), "text"))
    gone = written(classes.where("row_key <> class_row").select("row_key"), "duplicates")
    return _without(numbered, F.col(number), gone).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    found = contaminated_rows(docs, table(spark, sf_dir, "benchmark")).select("row_key").distinct()
    return _without(docs, row_hash("doc_id", "text"), written(found, "contaminated"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by their kind; n_chars follows the text."""
    return redacted(docs).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*docs.columns)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded text of each document."""
    return bpe_round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secrets", secrets), ("bpe", bpe)]

#: The stages hold trained models, signatures and an automaton, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name)
    return docs
