"""Scores of questions against notes by blocks: which notes cover a share of a question's weight.

Notes and questions are dealt into groups, and each two groups meet in one task, which goes through them in tiles. Pairs
live in a tile's array only, so neither the postings of a term times the questions that have it nor the pairs of questions and notes
below the share are ever rows. In a tile a question's commonest terms are optional: as long as all that they could give a note of the
tile stays well below what it must reach, notes without any other term are out, and the optional terms are looked up for the notes
that the others leave in reach.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Notes and questions of a group, the least number of groups, and the notes and questions of a tile in it.
NOTES, QUESTIONS, MIN_NOTES, MIN_QUESTIONS = 16_384, 65_536, 8, 2
TILE_NOTES, TILE_QUESTIONS = 4096, 512
#: What the optional terms may give together, as a share of what a note must reach. At 1 fewest postings are looked through first, but
#: nearly every note that they find stays in reach and is looked up for all optional terms; at 0 all terms are needed.
OPTIONAL = 0.75
#: Bounds give way by this share, as sums of doubles depend on their order.
SLACK = 1e-9

SCORES = "query_id long, id long, created_s long, score double"


def _lists(table: pa.Table, *names: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Row number of each list element, and the elements of these list columns."""
    columns = [table.column(n).combine_chunks() for n in names]
    rows = np.repeat(np.arange(table.num_rows), np.asarray(columns[0].value_lengths()).astype(np.int64))
    return rows, [c.flatten().to_numpy(zero_copy_only=False) for c in columns]


def _numbers(table: pa.Table, name: str, missing: int | None = None) -> np.ndarray:
    column = table.column(name).combine_chunks()
    return (column if missing is None else column.fill_null(missing)).to_numpy(zero_copy_only=False)


def _spread(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges (start, count): the range's number and the place, of each place in each range."""
    of = np.repeat(np.arange(len(starts)), counts)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts) + starts[of]


class _Notes:
    """A tile of notes: postings by term, and each term's greatest weight."""

    def __init__(self, note: np.ndarray, code: np.ndarray, weight: np.ndarray, size: int):
        order = np.lexsort((note, code))
        note, code, weight = note[order], code[order], weight[order]
        first = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (note[1:] != note[:-1])][: len(code)])
        self.note, self.weight, self.size = note[first], np.add.reduceat(weight, first) if len(first) else weight, size
        self.codes, self.starts, self.counts = np.unique(code[first], return_index=True, return_counts=True)
        self.tops = np.maximum.reduceat(self.weight, self.starts) if len(first) else weight
        self.keys = np.repeat(np.arange(len(self.codes)), self.counts) * size + self.note


def _tile_scores(n: _Notes, question: np.ndarray, code: np.ndarray, idf: np.ndarray, need: np.ndarray, share: float):
    """question, note, score of the pairs of a tile that may reach need. A question's terms stand together, the commonest first."""
    at = np.searchsorted(n.codes, code)
    known = at < len(n.codes)
    known[known] = n.codes[at[known]] == code[known]
    question, idf, at = question[known], idf[known], at[known]
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    bound = idf * n.tops[at]
    upto = np.cumsum(bound)
    first = np.searchsorted(question, question)
    optional = upto - upto[first] + bound[first] < need[question] * share
    rest = np.bincount(question[optional], bound[optional], len(need))

    needed = np.flatnonzero(~optional)
    of, place = _spread(n.starts[at[needed]], n.counts[at[needed]])
    of = needed[of]
    part = np.bincount(question[of] * n.size + n.note[place], idf[of] * n.weight[place], len(need) * n.size).reshape(len(need), n.size)
    q, note = np.nonzero(part >= np.maximum((need - rest) * (1 - SLACK), 1e-300)[:, None])
    score = part[q, note]

    if len(q) and optional.any():
        entries = np.flatnonzero(optional)
        counts = np.bincount(question[entries], minlength=len(need))
        starts = np.cumsum(counts) - counts
        of, place = _spread(starts[q], counts[q])
        entry = entries[place]
        key = at[entry] * n.size + note[of]
        found = np.minimum(np.searchsorted(n.keys, key), len(n.keys) - 1)
        hit = n.keys[found] == key
        score = score + np.bincount(of[hit], idf[entry[hit]] * n.weight[found[hit]], len(q))
    return q, note, score


def _block_scores(share: float, limit: int | None):
    def run(notes: pa.Table, asked: pa.Table) -> pa.Table:
        out = []
        if notes.num_rows and asked.num_rows:
            ids, created = _numbers(notes, "id"), _numbers(notes, "created_s", np.iinfo(np.int64).min)
            row, (code, weight) = _lists(notes, "codes", "weights")
            cut = np.searchsorted(row, np.arange(0, notes.num_rows + TILE_NOTES, TILE_NOTES))
            tiles = [(a, _Notes(row[x:y] - a, code[x:y], weight[x:y], min(TILE_NOTES, notes.num_rows - a))) for a, x, y in zip(range(0, notes.num_rows, TILE_NOTES), cut, cut[1:])]
            query_ids, need = _numbers(asked, "query_id"), _numbers(asked, "need")
            row, (code, idf) = _lists(asked, "codes", "idfs")
            for a in range(0, asked.num_rows, TILE_QUESTIONS):
                b = min(a + TILE_QUESTIONS, asked.num_rows)
                x, y = np.searchsorted(row, [a, b])
                found = []
                for begin, tile in tiles:
                    q, note, score = _tile_scores(tile, row[x:y] - a, code[x:y], idf[x:y], need[a:b], share)
                    keep = (score > 0) & (score >= need[a:b][q])
                    found.append((q[keep] + a, note[keep] + begin, score[keep]))
                q, note, score = (np.concatenate(c) for c in zip(*found))
                score = np.floor(score * 1e6 + 0.5) / 1e6
                if limit is not None:
                    order = np.lexsort((ids[note], ~created[note], -score, q))
                    q, note, score = q[order], note[order], score[order]
                    best = np.arange(len(q)) - np.searchsorted(q, q) < limit
                    q, note, score = q[best], note[best], score[best]
                out.append((query_ids[q], ids[note], created[note], score))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]
        return pa.table(dict(zip(("query_id", "id", "created_s", "score"), columns)))

    return run


def block_scores(asked: DataFrame, total: DataFrame, postings: DataFrame, notes: DataFrame, coverage: float, share: float = OPTIONAL, limit: int | None = None, groups: int = MIN_NOTES) -> DataFrame:
    """query_id, id, created_s, score (six places): the notes that cover the share `coverage` of a question's weight; with a limit
    the first `limit` of each question and group of notes only, by score, newest and id.

    asked: query_id, term, df, idf. total: query_id, total. postings: term, id, weight. notes: id, created_s. Terms and ids are longs.
    groups: the least number of groups of notes.
    """
    n_notes, n_asked = max(groups, -(-notes.count() // NOTES)), max(MIN_QUESTIONS, -(-total.count() // QUESTIONS))
    terms = asked.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("df")).alias("n"), "term", "idf"))).alias("t"))
    q = terms.join(total.hint("shuffle_merge"), "query_id").select("query_id", (F.col("total") * coverage).alias("need"), F.col("t.term").alias("codes"), F.col("t.idf").alias("idfs"))
    packed = postings.groupBy("id").agg(F.collect_list(F.struct("term", "weight")).alias("t"))
    n = packed.join(notes.select("id", "created_s").hint("shuffle_merge"), "id").select("id", "created_s", F.col("t.term").alias("codes"), F.col("t.weight").alias("weights"))

    def dealt(rows: DataFrame, key: str, own: str, size: int, other: str, others: int) -> DataFrame:
        """The rows under their group and each of the other side's groups; a fixed number of partitions keeps small groups apart."""
        each = rows.withColumn(own, F.pmod(F.xxhash64(key), F.lit(size)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
        return each.repartition(2 * n_notes * n_asked, "nb", "qb")

    left, right = dealt(n, "id", "nb", n_notes, "qb", n_asked), dealt(q, "query_id", "qb", n_asked, "nb", n_notes)
    return left.groupBy("nb", "qb").cogroup(right.groupBy("nb", "qb")).applyInArrow(_block_scores(share, limit), SCORES)
