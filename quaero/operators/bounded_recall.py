"""Keyword recall that looks up frequent terms for candidates alone.

A note counts if it reaches a fixed share of its question's weight, so a question's commonest terms are optional: as long as all
that they could give a note stays well below that share, a note without any of the others is out. What a term can give is bounded per
block of notes, by the greatest weight that it has in the block. recall_blocks does this inside tiles of notes and questions; recall_rows
tells what it saves.

Null or empty questions recall nothing; notes without terms are never found; repeated question rows count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import stored
from .recall_blocks import OPTIONAL, SLACK
from .search import COVERAGE, keyword_recall, note_terms, question_weights, terms

#: Blocks that the notes are dealt into.
BLOCKS = 16


def dealt(index: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """The postings (term, id, weight) with the block of their note."""
    return index.select("term", "id", "weight", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))


def block_bounds(postings: DataFrame) -> DataFrame:
    """term, block, top (the greatest weight of the term in the block), n (its postings there)."""
    return postings.groupBy("term", "block").agg(F.max("weight").alias("top"), F.count(F.lit(1)).alias("n"))


def bounded_terms(weighted: DataFrame, total: DataFrame, bounds: DataFrame) -> DataFrame:
    """query_id, block, term, idf, n, need, optional, rest: a question's terms in each block that has them.

    need is the score that a note must reach, rest what the block's optional terms can give at most. Terms become optional from
    the most frequent on (ties by term) while their sum stays below OPTIONAL of need.
    """
    known = weighted.where("df IS NOT NULL").join(total.hint("shuffle_merge"), "query_id")
    each = known.join(bounds.hint("shuffle_merge"), "term").withColumn("need", F.col("total") * (COVERAGE * (1 - SLACK)))
    own = Window.partitionBy("query_id", "block")
    upto = own.orderBy(F.desc("df"), "term").rowsBetween(Window.unboundedPreceding, 0)
    bound = F.col("idf") * F.col("top")
    told = each.withColumn("optional", F.sum(bound).over(upto) < F.col("need") * OPTIONAL)
    return told.withColumn("rest", F.coalesce(F.sum(F.when(F.col("optional"), bound)).over(own), F.lit(0.0))).select("query_id", "block", "term", "idf", "n", "need", "optional", "rest")


def _prepared(questions: DataFrame, notes: DataFrame, index: DataFrame | None, blocks: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The postings with blocks, the questions' bounded terms and total weights."""
    asked = stored(questions.select("query_id", F.explode(terms(F.col("query"))).alias("term")).distinct())
    postings = stored(dealt(note_terms(notes) if index is None else index, blocks))
    weighted, total = question_weights(asked, postings, notes)
    return postings, stored(bounded_terms(weighted, total, block_bounds(postings))), stored(total)


def bounded_recall(questions: DataFrame, notes: DataFrame, index: DataFrame | None = None, blocks: int = BLOCKS, limit: int | None = None) -> DataFrame:
    """query_id, id, score, rank: the rows of search.keyword_recall; all notes are dealt into `blocks` blocks at least."""
    return keyword_recall(questions, notes, index, limit, groups=blocks, share=OPTIONAL)


def recall_rows(questions: DataFrame, notes: DataFrame, index: DataFrame | None = None, blocks: int = BLOCKS) -> DataFrame:
    """query_id, all_rows, first_rows: the postings of all of a question's terms, and of those that are joined before candidates are known."""
    _, each, _ = _prepared(questions, notes, index, blocks)
    first = F.sum(F.when(F.col("optional"), 0).otherwise(F.col("n")))
    return each.groupBy("query_id").agg(F.sum("n").alias("all_rows"), first.alias("first_rows"))
