"""Vector recall: embedding plans, centroids, exact cosine neighbours, similar topics and duplicate pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import sized, stored

#: Rows of a block on either side of a block product.
BLOCK = 2048
#: Queries of a tile, pairs that are worked out at once, and the queries and rows of the groups that meet in a task.
TILE, CHUNK, QUERIES, ROWS = 1024, 65_536, 32_768, 16_384
RECALL_FLOOR, DUPLICATE_FLOOR, NEIGHBOURS, CANDIDATES = 0.40, 0.65, 5, 30
BATCH = 32


def note_keys(notes: DataFrame, model: str) -> DataFrame:
    """id, key and text of what is embedded: title and question. Equal texts share a key."""
    text = F.concat_ws("\n", "title", "question")
    return notes.select("id", F.concat(F.lit(f"{model}:"), F.sha2(text, 256)).alias("key"), text.alias("text"))


def embedding_plan(wanted: DataFrame, known: DataFrame) -> DataFrame:
    """key, action: missing keys to embed and stale ones to drop; both sides' keys are made distinct."""
    w, k = wanted.select("key").distinct(), known.select("key").distinct()
    missing = w.join(k, "key", "left_anti").withColumn("action", F.lit("embed"))
    return missing.unionByName(k.join(w, "key", "left_anti").withColumn("action", F.lit("drop")))


def hashing_model(dimension: int = 64):
    """A deterministic model that needs no files: signed hashing of words, for tests and as the default."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), dimension), np.float32)
        for i, t in enumerate(texts):
            words = np.array(t.lower().split() or [""], dtype=object)
            h = pd.util.hash_array(words, categorize=False)
            np.add.at(out[i], (h % np.uint64(dimension)).astype(int), np.where(h >> np.uint64(63), 1.0, -1.0))
        return out

    return encode


def embedded(rows: DataFrame, make_model=hashing_model) -> DataFrame:
    """key, embedding (unit length) of distinct keys, in batches; make_model is called once per worker stream."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make_model()
        for pdf in batches:
            parts = [encode(pdf["text"].iloc[a : a + BATCH].fillna("").tolist()) for a in range(0, len(pdf), BATCH)]
            if parts:
                v = np.concatenate(parts)
                v = v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
                yield pd.DataFrame({"key": pdf["key"], "embedding": list(v.astype(np.float32))})

    return rows.dropDuplicates(["key"]).select("key", "text").mapInPandas(run, "key string, embedding array<float>")


def centroids(vectors: DataFrame, group: str = "topic_id") -> DataFrame:
    """group, embedding: the sum of a group's vectors at unit length; a zero sum stays zero. Sums are partial per task."""
    places = vectors.select(group, F.posexplode("embedding").alias("pos", "x")).groupBy(group, "pos").agg(F.sum(F.col("x").cast("double")).alias("x"))
    whole = places.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v")).select(group, F.col("v.x").alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return whole.withColumn("norm", norm).select(group, F.when(F.col("norm") > 0, F.transform("v", lambda x: x / F.col("norm"))).otherwise(F.col("v")).alias("embedding"))


def change_signature(vectors: DataFrame, group: str = "topic_id", key: str = "id") -> DataFrame:
    """group, signature of its set of keys: equal signatures need no new centroid."""
    return vectors.groupBy(group).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.col(key).cast("string"))), "\n"), 256).alias("signature"))


def change_sums(rows: DataFrame, group: str = "topic_id", key: str = "id") -> DataFrame:
    """group, signature: a change signature that tasks add up in parts, so no group is gathered, whatever its size.

    It is the number of rows and the sums of the four 32-bit words of the keys' MD5 digests: equal multisets of keys have
    equal ones, in any order. Null keys only count; an empty table has no groups.
    """
    digest = F.md5(F.col(key).cast("string"))
    words = [F.sum(F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("decimal(10,0)")) for k in range(4)]
    sums = [F.coalesce(w.cast("string"), F.lit("0")) for w in words]
    return rows.groupBy(group).agg(F.concat_ws("-", F.count(F.lit(1)).cast("string"), *sums).alias("signature"))


def kept_centroids(vectors: DataFrame, group: str = "topic_id", key: str = "key") -> DataFrame:
    """group, signature, embedding: the centroids with the signatures of the keys that they were made of."""
    return centroids(vectors, group).join(change_sums(vectors, group, key).hint("shuffle_merge"), group).select(group, "signature", "embedding")


def refreshed_centroids(kept: DataFrame, vectors: DataFrame, group: str = "topic_id", key: str = "key") -> DataFrame:
    """kept_centroids of the vectors as they are now; only groups with another set of keys are summed again.

    kept: an earlier result, written. The keys tell contents: a changed vector has another key. A row that moves changes the
    signatures of both groups; groups that have lost all rows go. Vectors are read in full for changed groups alone, the
    others' rows give their group and key. An empty kept table makes it a rebuild.
    """
    now = stored(change_sums(vectors, group, key))
    known = kept.select(group, "signature")
    changed = now.join(known.hint("shuffle_merge"), [group, "signature"], "left_anti")
    rows = vectors.join(sized(changed.select(group)), group, "left_semi")
    rebuilt = centroids(rows, group).join(changed.hint("shuffle_merge"), group).select(group, "signature", "embedding")
    return kept.select(group, "signature", "embedding").join(now.hint("shuffle_merge"), [group, "signature"], "left_semi").unionByName(rebuilt)


#: Columns of a block's best.
BEST = "query_id long, id long, similarity double"


def unit_rows(vectors: pd.Series) -> np.ndarray:
    """The vectors as rows of unit length; a zero vector stays zero."""
    m = np.stack(vectors.to_numpy())
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def best_of_blocks(k: int, floor: float, skip_self: bool):
    """A function of two blocks (query_id, embedding and id, embedding): each query's k best rows at or above the floor."""

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "id": np.zeros(0, np.int64), "similarity": np.zeros(0)})
        ids, asked = b["id"].to_numpy(), a["query_id"].to_numpy()
        same = np.round(unit_rows(a["embedding"]) @ unit_rows(b["embedding"]).T, 6)
        if skip_self:
            same[asked[:, None] == ids[None, :]] = -2.0
        by_id = np.argsort(ids)  # ties go to the least id
        same, ids = same[:, by_id], ids[by_id]
        top = np.argsort(-same, axis=1, kind="stable")[:, :k]
        best = np.take_along_axis(same, top, 1)
        keep = best >= max(floor, -1.5)
        return pd.DataFrame({"query_id": np.repeat(asked, keep.sum(1)), "id": ids[top][keep], "similarity": best[keep]})

    return run


def k_best(found: DataFrame, k: int) -> DataFrame:
    """query_id, rank, id, similarity: the k best rows of each query, ties by id."""
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).select("query_id", "rank", "id", "similarity")


def _matrix(table: pa.Table) -> np.ndarray:
    """The embeddings as rows of unit length."""
    flat = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(table.num_rows, -1)
    return flat / np.maximum(np.linalg.norm(flat, axis=1, keepdims=True), 1e-12)


def _kept_best(found: tuple, k: int) -> tuple:
    """The k best of each query of (query, id, similarity), ties by id."""
    q, ids, same = found
    order = np.lexsort((ids, -same, q))
    q, ids, same = q[order], ids[order], same[order]
    best = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[best], ids[best], same[best]


def best_of_groups(k: int, floor: float, skip_self: bool):
    """A function of two groups of rows: each query's k best rows at or above the floor, found tile by tile.

    A product in single precision, with the greatest error it can have, tells which pairs of a tile can be at the floor and among
    the k best so far; those alone are worked out in double precision and rounded to six places.
    """

    def run(asked: pa.Table, rows: pa.Table) -> pa.Table:
        out = []
        if asked.num_rows and rows.num_rows:
            query_ids, ids = asked.column("query_id").to_numpy(), rows.column("id").to_numpy()
            a, b = _matrix(asked), _matrix(rows)
            a32, b32 = a.astype(np.float32), b.astype(np.float32)
            slack = np.float32(1e-5 + 2.4e-7 * a.shape[1])
            for x in range(0, len(a), TILE):
                found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
                least = np.full(len(a32[x : x + TILE]), max(floor, -1.5), np.float32)
                for y in range(0, len(b), BLOCK):
                    rough = a32[x : x + TILE] @ b32[y : y + BLOCK].T
                    if skip_self:
                        rough[query_ids[x : x + TILE, None] == ids[None, y : y + BLOCK]] = -4.0
                    near = rough >= (least - slack)[:, None]
                    if rough.shape[1] > k and np.count_nonzero(near) > 4 * k * len(least):
                        kth = np.partition(rough, rough.shape[1] - k, axis=1)[:, rough.shape[1] - k]
                        near &= rough >= (kth - 2 * slack)[:, None]
                    q, n = np.nonzero(near)
                    same = np.concatenate([np.einsum("ij,ij->i", a[x + q[i : i + CHUNK]], b[y + n[i : i + CHUNK]]) for i in range(0, len(q), CHUNK)] or [np.zeros(0)])
                    same = np.round(same, 6)
                    keep = same >= max(floor, -1.5)
                    found = _kept_best(tuple(np.concatenate(c) for c in zip(found, (q[keep], ids[y + n[keep]], same[keep]))), k)
                    full = np.bincount(found[0], minlength=len(least)) == k
                    if full.any():
                        last = np.searchsorted(found[0], np.flatnonzero(full), side="right") - 1
                        least[full] = np.maximum(least[full], found[2][last].astype(np.float32))
                out.append((query_ids[x + found[0]], found[1], found[2]))
        columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(dict(zip(("query_id", "id", "similarity"), columns)))

    return run


def neighbours(queries: DataFrame, vectors: DataFrame, k: int, floor: float = -1.0, skip_self: bool = False) -> DataFrame:
    """query_id, rank, id, similarity: the k most similar vectors of each query at or above a floor, exactly.

    Both sides are dealt into groups and each two groups meet in one task, where products of tiles leave each query its k best of
    the group; the groups' best meet by query. No pair list is made, and memory is a group's and a tile's. Groups are
    large, as each row is sent once to every group of the other side.
    """
    n_q, n_v = max(2, -(-queries.count() // QUERIES)), max(8, -(-vectors.count() // ROWS))

    def dealt(rows: DataFrame, key: str, own: str, size: int, other: str, others: int) -> DataFrame:
        each = rows.select(F.col(key).cast("long").alias(key), F.col("embedding").alias("embedding"))
        each = each.withColumn(own, F.pmod(F.xxhash64(key), F.lit(size)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
        return each.repartition(2 * n_q * n_v, "qb", "vb")

    q, v = dealt(queries, "query_id", "qb", n_q, "vb", n_v), dealt(vectors, "id", "vb", n_v, "qb", n_q)
    local = q.groupBy("qb", "vb").cogroup(v.groupBy("qb", "vb")).applyInArrow(best_of_groups(k, floor, skip_self), BEST)
    return k_best(local, k)


def similar_topics(vectors: DataFrame, counts: DataFrame, k: int = NEIGHBOURS, floor: float = RECALL_FLOOR) -> DataFrame:
    """topic_id, rank, other, similarity, ask_count of the most similar other topics."""
    c = centroids(vectors)
    near = neighbours(c.withColumnRenamed("topic_id", "query_id"), c.withColumnRenamed("topic_id", "id"), k, floor, skip_self=True)
    return near.join(counts.select(F.col("topic_id").alias("id"), "ask_count"), "id").select(F.col("query_id").alias("topic_id"), "rank", F.col("id").alias("other"), "similarity", "ask_count")


def duplicate_topics(vectors: DataFrame, counts: DataFrame, dismissed: DataFrame | None = None, k: int = NEIGHBOURS, floor: float = DUPLICATE_FLOOR) -> DataFrame:
    """a, b, similarity: each unordered pair of near topics once, b the more asked (the merge target); equal counts: a < b."""
    near = similar_topics(vectors, counts, k, floor).select(F.least("topic_id", "other").alias("x"), F.greatest("topic_id", "other").alias("y"), "similarity").groupBy("x", "y").agg(F.max("similarity").alias("similarity"))
    if dismissed is not None:
        near = near.join(ordered_pairs(dismissed).withColumnsRenamed({"a": "x", "b": "y"}), ["x", "y"], "left_anti")
    n = counts.select("topic_id", "ask_count")
    both = near.join(n.withColumnsRenamed({"topic_id": "x", "ask_count": "nx"}), "x").join(n.withColumnsRenamed({"topic_id": "y", "ask_count": "ny"}), "y")
    swap = F.col("nx") > F.col("ny")
    return both.select(F.when(swap, F.col("y")).otherwise(F.col("x")).alias("a"), F.when(swap, F.col("x")).otherwise(F.col("y")).alias("b"), "similarity")


def ordered_pairs(pairs: DataFrame) -> DataFrame:
    """Dismissed pairs as a set: a < b, each once."""
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
