"""Merges applied one after the other, worked out in parallel.

A merge request joins the groups of its two ends if they are different when its turn comes. So it is accepted exactly if it is
in the minimum spanning forest by turn, and the groups that meet at it are the two children of its node in the forest's
reconstruction tree, whose nodes are the accepted requests, each under the one that its group took part in next.

Rounds: every group takes its first request to another group, and groups so linked become one; a round leaves half of them at
most. `first(V)` is that request of a group V of some round. A request inside V before first(V), but after the first of the
smaller groups around it, is on V's chain, and the chain in order of turns is a path of the tree: a request's child there is the
one before it on the chain, on the side away from the group that chose it; on the chosen side it is the last one of the choosing
group's chain; and over the last of a chain stands first(V). Refused requests stand on the chains as nodes with one child.
The topic that a group has come to is found down the sides that requests lead into, by doubling the steps.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.store import stored
from .activity import ordinals

FROM, INTO = 0, 1


def _doubled(steps: DataFrame) -> DataFrame:
    """node, end of steps (node, next): where each node's steps lead. A node that steps to itself is an end."""
    at = stored(steps.select("node", F.col("next").alias("end")))
    while True:
        further = at.select(F.col("node").alias("end"), F.col("end").alias("further"))
        moved = stored(at.join(further.hint("shuffle_merge"), "end", "left").select("node", F.coalesce("further", "end").alias("end"), (F.col("further") != F.col("end")).alias("moved")))
        at = moved.select("node", "end")
        if moved.where("moved").isEmpty():
            return at


def _rounds(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """chains: round, label, at, accepted; chosen: at, side, round, label; over: round, label, next_at, next_side of the last of each chain.

    edges: at (the turn, distinct), x, y.
    """
    active = stored(edges.where("x <> y").select("at", "x", "y"))
    waiting = edges.where("x = y").select("at", F.col("x").alias("label"), F.lit(False).alias("accepted"))
    chains, chosen, over = [], [], []
    number = 0
    while True:
        both = active.select(F.col("x").alias("label"), "at", F.lit(FROM).alias("side"), F.col("y").alias("other")).unionByName(active.select(F.col("y").alias("label"), "at", F.lit(INTO).alias("side"), F.col("x").alias("other")))
        first = stored(both.groupBy("label").agg(F.min(F.struct("at", "side", "other")).alias("f")).select("label", F.col("f.at").alias("first"), F.col("f.side").alias("side"), F.col("f.other").alias("other")))
        placed = stored(waiting.join(first.select("label", "first").hint("shuffle_merge"), "label", "left"))
        ready = F.col("first").isNull() | (F.col("first") > F.col("at"))
        chains.append(placed.where(ready).select(F.lit(number).alias("round"), "label", "at", "accepted"))
        if first.isEmpty():
            return tuple(reduce(DataFrame.unionByName, x) if x else None for x in (chains, chosen, over))
        chosen.append(first.select(F.col("first").alias("at"), "side", F.lit(number).alias("round"), "label"))
        over.append(first.select(F.lit(number).alias("round"), "label", F.col("first").alias("next_at"), F.col("side").alias("next_side")))
        # Along the chosen requests turns only fall, to the one that both of its groups chose: the lesser of them is the end.
        back = first.select(F.col("label").alias("other"), F.col("first").alias("of_other"))
        ends = first.join(back.hint("shuffle_merge"), "other").withColumn("mutual", F.col("first") == F.col("of_other"))
        labels = _doubled(ends.select(F.col("label").alias("node"), F.when(F.col("mutual") & (F.col("label") < F.col("other")), F.col("label")).otherwise(F.col("other")).alias("next")))
        labels = labels.withColumnsRenamed({"node": "label", "end": "new"})
        for c in ("x", "y"):
            active = active.join(labels.withColumnsRenamed({"label": c, "new": f"new_{c}"}).hint("shuffle_merge"), c)
        taken = first.select(F.col("first").alias("at"), F.lit(True).alias("taken")).distinct()
        active = stored(active.select("at", F.col("new_x").alias("x"), F.col("new_y").alias("y")).join(taken.hint("shuffle_merge"), "at", "left"))
        inside = active.where("x = y").select("at", F.col("x").alias("label"), F.col("taken").isNotNull().alias("accepted"))
        waiting = placed.where(~ready).join(labels.hint("shuffle_merge"), "label").select("at", F.col("new").alias("label"), "accepted").unionByName(inside)
        active = active.where("x <> y").drop("taken")
        number += 1


def merged_in_turn(edges: DataFrame) -> DataFrame:
    """at, from_id, into_id, accepted of each request: the topics that its ends have come to when its turn comes.

    edges: at (the turn: a distinct whole number), x and y (the ends; equal ends are refused). An accepted request makes the topic
    that x has come to part of the one that y has come to. An empty table gives no rows.
    """
    edges = stored(edges.select("at", "x", "y"))
    chains, chosen, over = _rounds(edges)
    key = F.concat_ws(":", F.col("round").cast("string"), F.col("label").cast("string"))
    chains = stored(ordinals(chains.withColumn("chain", key), "chain", [F.col("at").asc()], "place", "size"))
    # What stands below each request: topic (a leaf) or below (another request), by side; side null: on both.
    along = chains.select("chain", (F.col("place") + 1).alias("place"), F.col("at").alias("below"))
    before = chains.join(along.hint("shuffle_merge"), ["chain", "place"], "left")
    if chosen is None:  # no request leads to another topic: each one's child is its topic, or the request before it there
        children = before.select("at", F.lit(None).cast("int").alias("side"), "below", "label")
    else:
        last = chains.where("place = size").select("round", "label", F.col("at").alias("below"))
        by_choice = chosen.join(last.hint("shuffle_merge"), ["round", "label"], "left").select("at", "side", "below", "label")
        once = chosen.groupBy("at").agg(F.count(F.lit(1)).alias("n"), F.min("side").alias("chosen_side"))
        sided = before.join(once.hint("shuffle_merge"), "at", "left").where("n IS NULL OR n = 1")
        on_chain = sided.select("at", (F.lit(1) - F.col("chosen_side")).alias("side"), "below", "label")
        children = by_choice.unionByName(on_chain)
    children = stored(children.select("at", "side", "below", F.when(F.col("below").isNull(), F.col("label")).alias("topic")))
    # Down the side that a request leads into (a refused one has one child), to the topic at the end.
    down = children.where(f"side IS NULL OR side = {INTO}")
    steps = _doubled(down.select(F.col("at").alias("node"), F.coalesce("below", "at").alias("next")))
    tops = down.where("topic IS NOT NULL").select(F.col("at").alias("end"), "topic")
    come_to = stored(steps.join(tops.hint("shuffle_merge"), "end").select(F.col("node").alias("below"), F.col("topic").alias("come_to")))
    named = children.join(come_to.hint("shuffle_merge"), "below", "left").withColumn("topic", F.coalesce("topic", "come_to"))
    side = lambda k: F.max(F.when(F.col("side").isNull() | (F.col("side") == k), F.col("topic")))
    ends = named.groupBy("at").agg(side(FROM).alias("from_id"), side(INTO).alias("into_id"), F.bool_and(F.col("side").isNotNull()).alias("accepted"))
    return ends.select("at", "from_id", "into_id", "accepted")
