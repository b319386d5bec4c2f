"""Reference resolution: chains of merges and aliases, one canonical copy per id, conflicts and their settlement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import stored


def follow(edges: DataFrame, source: str, target: str) -> DataFrame:
    """start, resolved for every source of an edge: where its chain ends.

    A chain stops at a node without an edge or at the first node it meets again, so a node on a cycle resolves to itself
    and a node that leads into a cycle to the node where it enters. Chains are walked together, a join per hop over the
    chains still on their way; each hop is written once, and only whether any is left reaches the driver. One edge per
    source (the least target) counts.
    """
    step = stored(edges.where(F.col(source).isNotNull() & F.col(target).isNotNull()).groupBy(F.col(source).alias("cur")).agg(F.min(target).alias("next_id")))
    going = step.select(F.col("cur").alias("start"), F.col("next_id").alias("cur"), F.array("cur").alias("seen"))
    ends = []
    while True:
        stop = F.col("next_id").isNull() | F.array_contains("seen", F.col("cur"))
        reached = stored(going.join(step.hint("shuffle_merge"), "cur", "left").withColumn("stop", stop))
        ends.append(reached.where("stop").select("start", F.col("cur").alias("resolved")))
        left = reached.where("NOT stop")
        if left.isEmpty():
            return reduce(DataFrame.unionByName, ends)
        going = left.select("start", F.col("next_id").alias("cur"), F.concat("seen", F.array("cur")).alias("seen"))


def resolved(rows: DataFrame, column: str, chains: DataFrame) -> DataFrame:
    """rows with column replaced by the end of its chain."""
    ends = chains.select(F.col("start").alias(column), F.col("resolved").alias("chain_end"))
    return rows.join(ends, column, "left").withColumn(column, F.coalesce("chain_end", column)).drop("chain_end")


def latest_alias(aliases: DataFrame) -> DataFrame:
    """One edge (from_tag, to_tag) per tag: the last by created, then path."""
    return aliases.groupBy("from_tag").agg(F.max_by("to_tag", F.struct("created", "path")).alias("to_tag"))


def canonical(rows: DataFrame, key: str = "id", path: str = "path") -> DataFrame:
    """The copy of each id with the shortest path, then the least; rows without an id count as copies of one.

    Each task leaves one copy of an id, so an id may have any number of them.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in rows.columns))
    best = rows.groupBy(F.col(key).alias("copies_of")).agg(F.min_by(row, F.struct(F.length(path), path)).alias("copy"))
    return best.select("copy.*")


def _all_files(tables: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), "path") for kind, df in tables.items()])


def conflict_ids(tables: dict[str, DataFrame]) -> DataFrame:
    """kind, id, n_copies of the ids that more than one file has; counted, so an id may have any number of copies."""
    return _all_files(tables).groupBy("kind", "id").agg(F.count(F.lit(1)).alias("n_copies")).where("n_copies > 1")


def conflict_copies(tables: dict[str, DataFrame]) -> DataFrame:
    """kind, id, path of each copy of those ids, a row each."""
    ids = conflict_ids(tables).select("kind", "id", F.lit(True).alias("found"))
    return _all_files(tables).join(ids.hint("shuffle_merge"), ["kind", "id"]).drop("found")


def conflicts(tables: dict[str, DataFrame]) -> DataFrame:
    """kind, id, paths (by length, then text) of those ids: a report for people, with all paths of an id in one row."""
    found = conflict_copies(tables).groupBy("kind", "id").agg(F.array_sort(F.collect_list(F.struct(F.length("path").alias("n"), "path"))).alias("found"))
    return found.select("kind", "id", F.col("found.path").alias("paths"))


def settle(copies: DataFrame, decisions: DataFrame) -> DataFrame:
    """kind, id, path, outcome: kept and discarded copies of decided conflicts; rejected decisions with their reason.

    copies: as conflict_copies gives them. decisions: kind, id, keep. A decision counts if the conflict exists and keep is
    one of its paths.
    """
    ids = copies.select("kind", "id", F.lit(True).alias("exists")).distinct()
    paths = copies.select("kind", "id", F.col("path").alias("keep"), F.lit(True).alias("is_copy")).distinct()
    reason = F.when(F.col("exists").isNull(), "no such conflict").when(F.col("is_copy").isNull(), "not a copy")
    met = decisions.join(ids.hint("shuffle_merge"), ["kind", "id"], "left").join(paths.hint("shuffle_merge"), ["kind", "id", "keep"], "left")
    judged = stored(met.select("kind", "id", "keep", reason.alias("reason")))
    rejected = judged.where("reason IS NOT NULL").select("kind", "id", F.col("keep").alias("path"), F.concat(F.lit("rejected: "), "reason").alias("outcome"))
    done = copies.join(judged.where("reason IS NULL").drop("reason").hint("shuffle_merge"), ["kind", "id"])
    return done.select("kind", "id", "path", F.when(F.col("path") == F.col("keep"), "kept").otherwise("discarded").alias("outcome")).unionByName(rejected)


def merged_from(chains: DataFrame) -> DataFrame:
    """topic_id and the ids, in order, whose chains end there."""
    return chains.where("start <> resolved").groupBy(F.col("resolved").alias("topic_id")).agg(F.array_sort(F.collect_list("start")).alias("merged_ids"))
