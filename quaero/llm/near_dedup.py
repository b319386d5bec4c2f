"""MinHash near-duplicate detection with DartMinHash signatures (operator 1).

Each element of a weighted set owns a plane of weight and rank, cut into layers of one unit of weight. Over each layer
darts are thrown by hashing, one behind the other along the rank with gaps that make them one per unit of area, the same
for every text that has the element. A text takes the darts under its weights up to a rank at which it has enough of
them, and each coordinate of the signature keeps the dart of least rank. The number of darts depends on the signature's
length only, so long texts cost one look per element and short ones no more.

Exact copies are collapsed first. Signatures are cut into bands; texts that share a band are joined through a hub, the
candidates' 5-word shingle sets are compared exactly, and pairs of 0.8 or more are linked. Bands whose texts are still
in several components are then gone through block by block, so that no link is lost to the choice of hubs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import bitmap, chunks, flat_words, is_set, mix, packed, shingles, slot_of, word_hashes, written

#: Words of a shingle, least similarity, bands and rows of a signature: a pair at 0.8 shares a band in 0.9999 of cases.
WORDS, SIMILARITY, BANDS, ROWS = 5, 0.8, 32, 6
LENGTH = BANDS * ROWS
#: In block comparisons, pairs are compared exactly if the signatures' estimate is within so many deviations.
DEVIATIONS = 4.0
BLOCK = 256

#: Rows that are signed together, and darts looked at together; they bound a worker's memory. Elements whose texts reach
#: further than RUN throw so many darts at once.
SIGNED_ROWS, DARTS, RUN = 2048, 200_000, 32


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> np.uint64(11)).astype(np.float64) * 2.0**-53


def dart_signatures(rows: np.ndarray, elements: np.ndarray, weights: np.ndarray | None, many: int, length: int = LENGTH) -> np.ndarray:
    """A signature of 64-bit dart ids for each of many weighted sets; a set without weight has a row of zeros.

    rows, elements: the owner and 64-bit hash of each element; weights: positive, 1 if None. With all weights 1 an
    element may be given repeatedly without effect.
    """
    out = np.zeros((many, length), np.uint64)
    if not len(rows):
        return out
    top = np.ones(len(rows))
    if weights is not None:  # one layer per unit of weight, the last one cut
        layers = np.maximum(np.ceil(weights).astype(np.int64), 0)
        index = np.repeat(np.arange(len(rows)), layers)
        layer = np.arange(len(index)) - np.repeat(np.cumsum(layers) - layers, layers)
        top = np.minimum(weights[index] - layer, 1.0)
        rows, elements = rows[index], mix(elements[index] + layer.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    total = np.bincount(rows, top, many)
    reach = length * (math.log(length) + 3) / np.maximum(total, 1e-9)
    todo = total > 0
    while todo.any():
        own = np.flatnonzero(todo[rows])
        best = np.full(many * length, np.inf)
        ids = np.zeros(many * length, np.uint64)
        upto = np.cumsum(reach[rows[own]] + 1)
        for part in np.split(own, np.searchsorted(upto, np.arange(DARTS, upto[-1], DARTS))):
            far = reach[rows[part]] > RUN
            for some, run in ((part[~far], 1), (part[far], RUN)):
                _throw(rows[some], elements[some], top[some], reach, run, length, best, ids, weights is not None)
        full = np.isfinite(best.reshape(many, length)).all(1) & todo
        out[full] = ids.reshape(many, length)[full]
        todo &= ~full
        reach = reach * 2  # a coordinate without a dart: look further
    return out


def _throw(who, what, height, reach, run, length, best, ids, cut) -> None:
    """Put the darts of these elements, up to their owners' reach, into the owners' coordinates; run darts in a step."""
    limit = reach[who]
    at = np.zeros(len(who))  # rank of the last dart
    thrown = 0
    while len(who):
        numbers = np.arange(thrown + 1, thrown + run + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
        dart = mix((what[:, None] + numbers).ravel())
        rank = -np.log1p(-_unit(mix(dart ^ np.uint64(0x9E3779B97F4A7C15))))
        if run == 1:
            rank += at
        else:
            rank = np.cumsum(np.column_stack([at, rank.reshape(-1, run)]), axis=1)[:, 1:].ravel()
        owner, far = (who, limit) if run == 1 else (np.repeat(who, run), np.repeat(limit, run))
        inside = rank < far
        hit = inside & (_unit(mix(dart ^ np.uint64(0xD6E8FEB86659FD93))) < np.repeat(height, run)) if cut else inside
        found, ranks = dart[hit], rank[hit]
        place = owner[hit] * length + (((found >> np.uint64(32)) * np.uint64(length)) >> np.uint64(32)).astype(np.int64)
        better = ranks < best[place]
        found, ranks, place = found[better], ranks[better], place[better]
        np.minimum.at(best, place, ranks)
        won = ranks == best[place]
        ids[place[won]] = found[won]
        on = inside[run - 1 :: run]
        who, what, height, limit, at = who[on], what[on], height[on], limit[on], rank[run - 1 :: run][on]
        thrown += run


def shingle_hashes(texts: pa.Array, size: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each shingle: size words in lower case, split at white space; a shorter text is one shingle."""
    rows, words = flat_words(pc.utf8_lower(pc.fill_null(texts, "")))
    return shingles(rows, word_hashes(words), size)


def weighed_shingles(texts: pa.Array, weighted: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Row, hash and weight of each text's distinct shingles, sorted: its number of occurrences if weighted, else 1 (None)."""
    rows, hashes = shingle_hashes(texts)
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    first = np.flatnonzero(new)
    return rows[first], hashes[first], np.diff(np.append(first, len(rows))).astype(np.float64) if weighted else None


def _signed(rows: DataFrame, weighted: bool) -> DataFrame:
    """row_key, doc_key, text_key, bands and the signature's low bytes of each text (bands null if it has no word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch, "text"):
                for at in range(0, chunk.num_rows, SIGNED_ROWS):
                    part = chunk.slice(at, SIGNED_ROWS)
                    many = part.num_rows
                    if weighted:
                        owners, hashes, weights = weighed_shingles(part.column(2), True)
                    else:
                        (owners, hashes), weights = shingle_hashes(part.column(2)), None
                    signs = dart_signatures(owners, hashes, weights, many)
                    bare = np.bincount(owners, minlength=many) == 0
                    bands = np.zeros((many, BANDS), np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
                    for k in range(ROWS):
                        bands = mix(bands * np.uint64(0x9E3779B97F4A7C15) + signs[:, k::ROWS])
                    edges = pa.array(np.arange(0, many * BANDS + 1, BANDS, dtype=np.int32))
                    lists = pa.ListArray.from_arrays(edges, pa.array(bands.view(np.int64).ravel()), mask=pa.array(bare))
                    low = pa.array([s.tobytes() for s in (signs & np.uint64(255)).astype(np.uint8)], pa.binary())
                    keys = pa.array([hashlib.md5((t or "").encode()).digest() for t in part.column(2).to_pylist()], pa.binary())
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), keys, lists, low], ["row_key", "doc_key", "text_key", "bands", "low"])

    return rows.mapInArrow(run, "row_key long, doc_key long, text_key binary, bands array<long>, low binary")


def _sets(docs: DataFrame, bits, weighted: bool) -> DataFrame:
    """node and its sorted shingle hashes (with their weights behind them), for the rows whose slot is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(is_set(bits.value, batch.column(2).to_numpy())))
            for part in chunks(batch, "text"):
                rows, hashes, weights = weighed_shingles(part.column(1), weighted)
                cut = np.searchsorted(rows, np.arange(part.num_rows + 1)).tolist()
                sets = [hashes[a:b].tobytes() + (weights[a:b].tobytes() if weighted else b"") for a, b in zip(cut, cut[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["node", "hashes"])

    return docs.mapInArrow(run, "node long, hashes binary")


def jaccard(a: bytes, b: bytes, weighted: bool = False) -> float:
    """Similarity of two packed sets: shared weight over weight in all."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    if not len(x) or not len(y):
        return 0.0
    if weighted:
        x, u = np.split(x, 2)
        y, v = np.split(y, 2)
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    same = x[at] == y
    if not weighted:
        both = int(same.sum())
        return both / (len(x) + len(y) - both)
    u, v = u.view(np.float64), v.view(np.float64)
    both = float(np.minimum(u[at[same]], v[same]).sum())
    return both / float(u.sum() + v.sum() - both)


def _node_sets(nodes: DataFrame, rows: DataFrame, weighted: bool) -> DataFrame:
    """node and hashes of these texts (and of a few others that share a slot)."""
    slot = slot_of(F.xxhash64("row_key"))
    wanted = nodes.select(F.col("node").alias("row_key")).select(slot.alias("slot"))
    return _sets(rows.select("row_key", "text", slot.alias("slot")), rows.sparkSession.sparkContext.broadcast(packed(bitmap(wanted))), weighted)


def _compared(pairs: DataFrame, rows: DataFrame, weighted: bool) -> DataFrame:
    """a, b, linked of each pair: whether the exact similarity of their shingle sets reaches the threshold."""
    sets = written(_node_sets(pairs.select(F.explode(F.array("a", "b")).alias("node")), rows, weighted), "sets")
    left = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("a_hashes")).hint("shuffle_merge"), "a")
    both = left.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("b_hashes")).hint("shuffle_merge"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = [jaccard(x, y, weighted) >= SIMILARITY for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    return written(both.select("a", "b", "a_hashes", "b_hashes").mapInArrow(run, "a long, b long, linked boolean"), "compared")


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) for the nodes of undirected edges (a, b).

    Large-star and small-star steps in turn: each links a node's neighbours to the least of them, so the edges never
    grow in number and a path of n nodes shrinks to a star in O(log^2 n) rounds. A hub's neighbours are never gathered.
    """
    links = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least.hint("shuffle_merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("shuffle_merge"), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if now == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = now


def _met(buckets: DataFrame) -> DataFrame:
    """The rows of buckets (key, node, component, low) that hold several components, dealt to groups (key, one, two).

    A bucket is cut into blocks, those of its largest component apart from the others, and each two blocks meet in a
    group of their own; blocks of the largest component don't meet each other.
    """
    each = buckets.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"))
    counted = each.groupBy("key").agg(F.sum("c").alias("n"), F.max(F.struct("c", "component")).alias("top")).where("n > top.c")
    counted = counted.select("key", F.col("top.component").alias("largest"), F.expr(f"cast(ceil((n - top.c) / {BLOCK}) as int)").alias("others"), F.expr(f"cast(ceil(top.c / {BLOCK}) as int)").alias("own"))
    dealt = buckets.join(counted.hint("shuffle_merge"), "key")
    inside = F.col("component") == F.col("largest")
    block = F.when(inside, F.col("others") + F.pmod(F.xxhash64("node"), F.col("own"))).otherwise(F.pmod(F.xxhash64("node"), F.col("others"))).cast("int")
    meets = F.when(inside, F.col("others")).otherwise(F.col("others") + F.col("own"))
    met = dealt.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), meets - 1)))
    return met.select("key", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"), "node", "component", "low")


_GROUP = "key long, one int, two int, node long, component long, low binary"


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (key, one, two) of a partition sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        names = np.column_stack([batch.column(k).to_numpy() for k in range(3)])
        cut = [0, *(np.flatnonzero((names[1:] != names[:-1]).any(1)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cut, cut[1:], strict=False):
            name = tuple(names[a].tolist())
            if held and name != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = name
    if held:
        yield pa.Table.from_batches(held)


def _close(group: pa.Table, least: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """A row of the group, the rows behind it of other components whose estimate reaches the least, and the estimates.

    Rows of the largest component aren't compared with each other.
    """
    comps = group.column(4).to_numpy()
    _, which, counts = np.unique(comps, return_inverse=True, return_counts=True)
    if len(counts) < 2:
        return
    order = np.argsort(counts[which], kind="stable")
    comps = comps[order]
    signs = np.frombuffer(b"".join(group.column(5).to_pylist()), np.uint8).reshape(len(comps), LENGTH)[order]
    for i in range(min(len(comps) - int(counts.max()), len(comps) - 1)):
        same = (signs[i + 1 :] == signs[i]).sum(1) / LENGTH
        other = np.flatnonzero((same >= least) & (comps[i + 1 :] != comps[i]))
        if len(other):
            yield int(order[i]), order[other + i + 1], same[other]


def _candidates(met: DataFrame, least: float) -> DataFrame:
    """The rows of met that have a candidate of another component in their group: never more rows than came in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            keep = np.zeros(group.num_rows, bool)
            for i, others, _ in _close(group, least):
                keep[i] = True
                keep[others] = True
            if keep.any():
                yield from group.filter(pa.array(keep)).to_batches()

    names = ["key", "one", "two"]
    return met.repartition(*names).sortWithinPartitions(*names).mapInArrow(run, _GROUP)


def _links(candidates: DataFrame, least: float, weighted: bool) -> DataFrame:
    """Links (a, b) across components: in each group the candidates are gone through from the most alike on, and those
    whose components aren't joined yet are compared exactly. At most a link per row; a pair not tested is joined anyway."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            comps, nodes, hashes = group.column(4).to_pylist(), group.column(3).to_pylist(), group.column(6)
            top = {c: c for c in comps}

            def root(c: int, top: dict = top) -> int:
                while top[c] != c:
                    top[c] = c = top[top[c]]
                return c

            found = []
            for i, j, _ in sorted(((i, j, s) for i, others, same in _close(group, least) for j, s in zip(others.tolist(), same.tolist(), strict=True)), key=lambda x: -x[2]):
                x, y = root(comps[i]), root(comps[j])
                if x != y and jaccard(hashes[i].as_py(), hashes[j].as_py(), weighted) >= SIMILARITY:
                    top[x] = y
                    found.append((min(nodes[i], nodes[j]), max(nodes[i], nodes[j])))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["a", "b"])

    names = ["key", "one", "two"]
    return candidates.repartition(*names).sortWithinPartitions(*names).mapInArrow(run, "a long, b long").distinct()


def _rank():
    """Rows by id, those without one last, then by row_key."""
    return F.struct(F.col("doc_key").isNull().alias("nameless"), "doc_key", "row_key")


def row_classes(rows: DataFrame, weighted: bool = False) -> DataFrame:
    """row_key, doc_key, class_id and class_row (id and row_key of the first row of its class) of each row.

    rows: row_key (distinct), doc_key, text; read several times, so it must be a stored table. The first row of a class
    is the one with the least id, those without an id last; of equal ids the least row_key.
    """
    signed = written(_signed(rows, weighted), "signatures")
    texts = signed.groupBy("text_key").agg(F.min("row_key").alias("node"), F.min(_rank()).alias("least"), F.first("bands").alias("bands"), F.first("low").alias("low"))
    texts = written(texts, "texts")
    buckets = texts.where("bands IS NOT NULL").select("node", F.explode("bands").alias("key"))
    sizes = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = written(buckets.join(sizes.hint("shuffle_merge"), "key"), "buckets")
    # The hub of a bucket is the text that meets most others over all its buckets: an original rather than an edited copy.
    density = shared.groupBy("node").agg(F.sum("n").alias("density"))
    dense = shared.select("key", "node").join(density.hint("shuffle_merge"), "node")
    hubs = dense.groupBy("key").agg(F.max(F.struct("density", (-F.col("node")).alias("minus"))).alias("top")).select("key", (-F.col("top.minus")).alias("hub"))
    star = shared.select("key", "node").join(hubs.hint("shuffle_merge"), "key").where("node <> hub")
    pairs = written(star.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct(), "pairs")
    compared = _compared(pairs, rows, weighted)
    classes = written(components(compared.where("linked").select("a", "b")), "classes")

    # Bands that still hold several components.
    floor = SIMILARITY - DEVIATIONS * math.sqrt(SIMILARITY * (1 - SIMILARITY) / LENGTH)
    placed = shared.select("key", "node").join(classes.hint("shuffle_merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    open_keys = placed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
    open_rows = placed.join(open_keys.hint("shuffle_merge"), "key", "left_semi").join(texts.select("node", "low").hint("shuffle_merge"), "node")
    near = written(_candidates(_met(open_rows), floor), "candidates")
    sets = _node_sets(near.select("node"), rows, weighted)
    more = written(_links(near.join(sets.hint("shuffle_merge"), "node").select("key", "one", "two", "node", "component", "low", "hashes"), floor, weighted), "more_links")
    if not more.isEmpty():
        classes = written(components(compared.where("linked").select("a", "b").unionByName(more)), "classes")

    # The first row of each class that has several texts; other classes are one text.
    of_class = classes.join(texts.select("node", "least").hint("shuffle_merge"), "node").groupBy("component").agg(F.min("least").alias("class_least"))
    of_class = written(of_class, "leasts")
    of_node = classes.join(of_class.hint("shuffle_merge"), "component").select("node", "class_least")
    of_text = texts.select("text_key", "node", "least").join(of_node.hint("shuffle_merge"), "node", "left").select("text_key", F.coalesce("class_least", "least").alias("first"))
    joined = signed.select("row_key", "doc_key", "text_key").join(of_text.hint("shuffle_merge"), "text_key", "left")
    return joined.select("row_key", "doc_key", F.col("first.doc_key").alias("class_id"), F.col("first.row_key").alias("class_row"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", weighted: bool = False) -> DataFrame:
    """doc_id and class_id (the least id of its class of near-duplicates) of each row.

    Two texts are linked if the Jaccard similarity of their sets of 5-word shingles is 0.8 or more (weighted: of the
    shingles weighted by their occurrences); a class is a connected component of links, exact copies included. A text
    under five words is one shingle. Null texts are empty; texts without a word are alike only if equal. Rows with equal
    or null ids are documents of their own; a row without an id has a null class_id. An empty table gives no rows; extra
    columns are ignored.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row_key"), F.col(id_col).cast("long").alias("doc_key"), F.col(text).alias("text"))
    classes = row_classes(written(rows, "rows"), weighted)
    return classes.select(F.col("doc_key").alias("doc_id"), F.when(F.col("doc_key").isNotNull(), F.col("class_id")).alias("class_id"))
