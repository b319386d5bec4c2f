"""Queries of search, recall and vectors. Searches ask with every row whose id is divisible by 100, against all rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import bounded_recall as B
from ..operators import search as R
from ..operators import vectors as V
from ..operators import word_vectors as W
from ..operators.kept_index import KeptIndex
from ..operators.vector_index import VectorIndex
from ..sources import tables as S
from ..sources.store import shared_folder, stored
from ..sources.tables import KEY_SUMS, sql_with


def _asked(spark, d):
    return S.questions(spark, d).where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("question").alias("query"))


def substring_search(spark, d):
    return R.substring_matches(_asked(spark, d), S.questions(spark, d)).select("query_id", "id")


def bm25_search(spark, d):
    return R.bm25_search(_asked(spark, d), S.questions(spark, d))


def note_terms(spark, d):
    return R.note_terms(S.questions(spark, d)).groupBy("id").agg(F.count(F.lit(1)).alias("n_terms"), F.sum("weight").cast("long").alias("weight"))


def term_idf(spark, d):
    q = S.questions(spark, d)
    return R.term_idf(R.note_terms(q), q).select("term", "df", F.round("idf", 6).alias("idf"))


def keyword_recall(spark, d):
    return R.keyword_recall(_asked(spark, d), S.questions(spark, d)).select("query_id", "id", F.round("score", 4).alias("score"))


def _kept_index(spark, d, kind):
    """An index of one kind of postings that has seen each question three times: with its answer as its title beside a note that is
    deleted later, in a part of them without a title, and as it is."""
    index = KeptIndex(spark, shared_folder(spark), fan=2, kinds=(kind,))
    q = S.questions(spark, d).withColumn("deleted", F.lit(False))
    doubled = q.withColumn("title", F.col("conclusion")).unionByName(q.withColumn("id", -F.col("id")))
    index.update(doubled, 1)
    index.update(q.where("id % 2 = 0").withColumn("title", F.lit("")).unionByName(q.withColumns({"id": -F.col("id"), "deleted": F.lit(True)})), 2)
    index.update(q, 3)
    index.update(q, 3)  # replayed
    return index


def kept_index_search(spark, d):
    return _kept_index(spark, d, "words").bm25_search(_asked(spark, d))


def kept_index_recall(spark, d):
    return _kept_index(spark, d, "terms").keyword_recall(_asked(spark, d)).select("query_id", "id", F.round("score", 4).alias("score"))


def _vector_queries(spark, d):
    return S.vectors(spark, d).where("id % 100 = 0").select(F.col("id").alias("query_id"), "embedding")


def vector_neighbours(spark, d):
    return V.neighbours(_vector_queries(spark, d), S.vectors(spark, d), R.CANDIDATES, V.RECALL_FLOOR).select("query_id", "id", F.round("similarity", 4).alias("similarity"))


def indexed_neighbours(spark, d):
    """As vector_neighbours, by the index of all vectors and its bounds."""
    found = VectorIndex.build(S.vectors(spark, d)).neighbours(_vector_queries(spark, d), R.CANDIDATES, V.RECALL_FLOOR)
    return found.select("query_id", "id", F.round("similarity", 4).alias("similarity"))


def bounded_recall(spark, d):
    return B.bounded_recall(_asked(spark, d), S.questions(spark, d)).select("query_id", "id", F.round("score", 4).alias("score"))


def recall_rows(spark, d):
    """The rows that bounded_recall joins, with all notes as one block."""
    return B.recall_rows(_asked(spark, d), S.questions(spark, d), blocks=1)


def _fused_with(keyword, vectors):
    near = V.neighbours(vectors.where("id % 100 = 0").withColumnRenamed("id", "query_id"), vectors, R.CANDIDATES, V.RECALL_FLOOR)
    return R.fused(keyword, near).where(F.col("rank") <= R.CANDIDATES).select("query_id", "id", "rank")


def hybrid_recall(spark, d):
    """Keyword and vector rankings fused; a question's vector is the stored one with the number of its conversation."""
    notes = S.questions(spark, d)
    stored_ones = S.vectors(spark, d).select(F.col("id").alias("session_id"), "embedding")
    vectors = notes.select("id", "session_id").join(stored_ones.hint("shuffle_merge"), "session_id").select("id", "embedding")
    return _fused_with(B.bounded_recall(_asked(spark, d), notes), vectors)


def trained_recall(spark, d):
    """Likewise with vectors by the model that is trained on the questions."""
    notes = S.questions(spark, d)
    keys = V.note_keys(notes, "words")
    embedded = stored(W.embedded_by(W.trained(keys), keys))
    vectors = keys.select("id", "key").join(embedded.hint("shuffle_merge"), "key").select("id", "embedding")
    return _fused_with(B.bounded_recall(_asked(spark, d), notes), stored(vectors))


def word_pairs(spark, d):
    """The counts that the model is made of."""
    keys = V.note_keys(S.questions(spark, d), "words")
    return W.co_occurrences(keys, stored(W.vocabulary(keys))).select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"), "n")


def recalled_topics(spark, d):
    notes = S.questions(spark, d)
    return R.recalled_topics(R.keyword_recall(_asked(spark, d), notes, limit=R.CANDIDATES), notes)


def recalled_notes(spark, d):
    notes = S.questions(spark, d)
    return R.recalled_notes(R.keyword_recall(_asked(spark, d), notes, limit=R.CANDIDATES), notes)


def rank_fusion(spark, d):
    """Two rankings of each topic's vectors: by the first component, of those where it is positive, and by the second."""
    v = S.vectors(spark, d).select(F.col("topic_id").alias("query_id"), "id", F.get("embedding", F.lit(0)).alias("first"), F.get("embedding", F.lit(1)).alias("second"))
    place = lambda by: F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(by), "id")).cast("long").alias("rank")
    return R.fused(v.where("first > 0").select("query_id", "id", place("first")), v.select("query_id", "id", place("second")))


def note_keys(spark, d):
    return V.note_keys(S.questions(spark, d), "model").select("id", "key")


def embedding_plan(spark, d):
    q = S.questions(spark, d)
    keys = V.note_keys(q, "model")
    return V.embedding_plan(keys.where("id % 3 <> 0"), keys.where("id % 5 <> 0"))


def centroids(spark, d):
    c = V.centroids(S.vectors(spark, d)).select("topic_id", F.posexplode("embedding").alias("pos", "x"))
    return c.select("topic_id", F.col("pos").cast("long").alias("pos"), (F.round("x", 5) + 0.0).alias("x"))


def refreshed_centroids(spark, d):
    """Centroids kept from an earlier state (some notes under the next topic, some with their vector turned, and notes that are
    gone now), brought up to date."""
    now = S.vectors(spark, d).withColumn("key", F.concat_ws(":", "id", F.xxhash64("embedding")))
    turned = F.when(F.col("topic_id") % 7 == 0, F.transform("embedding", lambda x: -x)).otherwise(F.col("embedding"))
    earlier = S.vectors(spark, d).select("id", (F.col("topic_id") + F.when(F.col("topic_id") % 5 == 0, F.col("id") % 2).otherwise(0)).alias("topic_id"), turned.alias("embedding"))
    gone = S.vectors(spark, d).select((-F.col("id") - 1).alias("id"), F.when(F.col("topic_id") % 3 == 0, F.col("topic_id")).otherwise(-1).alias("topic_id"), "embedding")
    before = earlier.unionByName(gone).withColumn("key", F.concat_ws(":", "id", F.xxhash64("embedding")))
    c = V.refreshed_centroids(stored(V.kept_centroids(before)), now).select("topic_id", F.posexplode("embedding").alias("pos", "x"))
    return c.select("topic_id", F.col("pos").cast("long").alias("pos"), (F.round("x", 5) + 0.0).alias("x"))


def change_signatures(spark, d):
    return V.change_signature(S.vectors(spark, d))


def topic_signatures(spark, d):
    return V.change_sums(S.vectors(spark, d))


def _topic_counts(spark, d):
    return S.vectors(spark, d).groupBy("topic_id").agg(F.count(F.lit(1)).alias("ask_count"))


def similar_topics(spark, d):
    return V.similar_topics(S.vectors(spark, d), _topic_counts(spark, d)).select("topic_id", "other", F.round("similarity", 4).alias("similarity"), "ask_count")


def duplicate_topics(spark, d):
    dismissed = S.vectors(spark, d).where("id % 11 = 0").select(F.col("topic_id").alias("a"), (F.col("topic_id") + 1).alias("b"))
    return V.duplicate_topics(S.vectors(spark, d), _topic_counts(spark, d), dismissed, floor=V.RECALL_FLOOR).select("a", "b", F.round("similarity", 4).alias("similarity"))


_TERMS = """w AS (SELECT id, lower(title || chr(10) || question) AS head, lower(conclusion) AS body FROM qa),
h AS (SELECT DISTINCT id, term FROM (SELECT id, unnest(regexp_extract_all(head, '[\\p{L}\\p{N}+#]+')) AS term FROM w) WHERE length(term) >= 2),
b AS (SELECT DISTINCT id, term FROM (SELECT id, unnest(regexp_extract_all(body, '[\\p{L}\\p{N}+#]+')) AS term FROM w) WHERE length(term) >= 2),
ix AS (SELECT id, term, 2.0::DOUBLE AS weight FROM h UNION ALL SELECT id, term, 1.0::DOUBLE FROM b WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.id = b.id AND h.term = b.term)),
df AS (SELECT term, count(*)::BIGINT AS df FROM ix GROUP BY 1), n AS (SELECT count(*) AS n FROM qa)"""
_RECALL = f"""{_TERMS},
q AS (SELECT DISTINCT id AS query_id, term FROM (SELECT id, unnest(regexp_extract_all(lower(question), '[\\p{{L}}\\p{{N}}+#]+')) AS term FROM qa WHERE id % 100 = 0) WHERE length(term) >= 2),
wq AS (SELECT query_id, q.term, ln(1 + n / (coalesce(df, 0) + 1)::DOUBLE) AS idf FROM q LEFT JOIN df ON df.term = q.term CROSS JOIN n),
tot AS (SELECT query_id, sum(idf) * 2 AS total FROM wq GROUP BY 1),
sc AS (SELECT query_id, id, sum(weight * idf) AS score FROM wq JOIN ix ON ix.term = wq.term GROUP BY 1, 2),
kw AS (SELECT sc.query_id, sc.id, round(score, 6) AS score, row_number() OVER (PARTITION BY sc.query_id ORDER BY round(score, 6) DESC, created_s DESC, sc.id) AS rank
  FROM sc JOIN tot ON tot.query_id = sc.query_id JOIN qa ON qa.id = sc.id WHERE score > 0 AND score >= total * 0.25)"""
_SHORT = """qs AS (SELECT id AS query_id, list_filter(regexp_split_to_array(trim(question), '\\s+'), lambda x: x <> '') AS ps FROM qa WHERE id % 100 = 0),
qp AS (SELECT query_id, lower(piece) AS piece FROM (SELECT query_id, unnest(ps) AS piece FROM qs)), ql AS (SELECT query_id, len(list_filter(ps, lambda x: length(x) >= 3)) AS n_long FROM qs),
nt AS (SELECT id, created_s, lower(title) AS t, lower(question) AS q, lower(conclusion) AS c, greatest(0, length(title) - 2) + greatest(0, length(question) - 2) + greatest(0, length(conclusion) - 2) AS g FROM qa),
m AS (SELECT ql.query_id, n_long, nt.* FROM ql JOIN nt ON NOT EXISTS (SELECT 1 FROM qp WHERE qp.query_id = ql.query_id AND
  CASE WHEN length(piece) >= 3 THEN NOT (contains(t, piece) OR contains(q, piece) OR contains(c, piece)) ELSE NOT (contains(t, piece) OR contains(c, piece)) END))"""
_UNIT = """u AS (SELECT id, topic_id, embedding FROM vec)"""
_CENT = """cs AS (SELECT topic_id, pos, sum(x::DOUBLE) AS x FROM (SELECT topic_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM vec) GROUP BY 1, 2),
cn AS (SELECT topic_id, sqrt(sum(x * x)) AS norm FROM cs GROUP BY 1),
cc AS (SELECT cs.topic_id, pos, CASE WHEN norm > 0 THEN x / norm ELSE x END AS x FROM cs JOIN cn ON cn.topic_id = cs.topic_id),
cl AS (SELECT topic_id, list(x ORDER BY pos) AS v FROM cc GROUP BY 1),
tc AS (SELECT topic_id, count(*)::BIGINT AS ask_count FROM vec GROUP BY 1),
st AS (SELECT a.topic_id, b.topic_id AS other, round(list_dot_product(a.v, b.v), 6) AS s FROM cl a JOIN cl b ON a.topic_id <> b.topic_id),
s5 AS (SELECT topic_id, other, s FROM st WHERE s >= 0.4 QUALIFY row_number() OVER (PARTITION BY topic_id ORDER BY s DESC, other) <= 5)"""

QUERIES = {
    "substring_search": (substring_search, sql_with(f", {_SHORT} SELECT query_id, id FROM m", "qa")),
    "bm25_search": (
        bm25_search,
        sql_with(
            f""", {_SHORT}, st AS (SELECT count(*) AS n_all, avg(g) AS ag FROM nt),
fp AS (SELECT piece, count(*) AS n_with FROM (SELECT DISTINCT piece FROM qp WHERE length(piece) >= 3) JOIN nt ON contains(t, piece) OR contains(q, piece) OR contains(c, piece) GROUP BY 1),
hit AS (SELECT m.query_id, m.id, m.g, m.created_s, piece, 3.0 * len(list_filter(range(1, length(t) + 1), lambda i: substring(t, i, length(piece)) = piece)) + 2.0 * len(list_filter(range(1, length(q) + 1), lambda i: substring(q, i, length(piece)) = piece))
   + len(list_filter(range(1, length(c) + 1), lambda i: substring(c, i, length(piece)) = piece)) AS tf FROM m JOIN qp ON qp.query_id = m.query_id AND length(piece) >= 3),
sc AS (SELECT query_id, id, created_s, round(sum(greatest(1e-6, ln((n_all - n_with + 0.5) / (n_with + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * g / ag))), 6) AS score FROM hit JOIN fp USING (piece) CROSS JOIN st GROUP BY 1, 2, 3
   UNION ALL SELECT query_id, id, created_s, 0.0 FROM m WHERE n_long = 0),
rk AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, CASE WHEN score = 0 THEN created_s END DESC NULLS LAST, id)::BIGINT AS rank, id, score::DOUBLE AS score FROM sc)
SELECT * FROM rk WHERE rank <= 20""",
            "qa",
        ),
    ),
    "note_terms": (note_terms, sql_with(f", {_TERMS} SELECT id, count(*)::BIGINT AS n_terms, sum(weight)::BIGINT AS weight FROM ix GROUP BY 1", "qa")),
    "term_idf": (term_idf, sql_with(f", {_TERMS} SELECT term, df, round(ln(1 + n / (df + 1)::DOUBLE), 6) AS idf FROM df CROSS JOIN n", "qa")),
    "keyword_recall": (keyword_recall, sql_with(f", {_RECALL} SELECT query_id, id, round(score, 4) AS score FROM kw", "qa")),
    "kept_index_recall": (kept_index_recall, sql_with(f", {_RECALL} SELECT query_id, id, round(score, 4) AS score FROM kw", "qa")),
    "vector_neighbours": (
        vector_neighbours,
        sql_with(
            f""", {_UNIT}, p AS (SELECT a.id AS query_id, b.id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS s FROM u a JOIN u b ON a.id % 100 = 0)
SELECT query_id, id, round(s, 4) AS similarity FROM p WHERE s >= 0.4 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) <= 30""",
            "vec",
        ),
    ),
    "bounded_recall": (bounded_recall, sql_with(f", {_RECALL} SELECT query_id, id, round(score, 4) AS score FROM kw", "qa")),
    "recall_rows": (
        recall_rows,
        sql_with(
            f""", {_RECALL}, tp AS (SELECT term, max(weight) AS top FROM ix GROUP BY 1),
e AS (SELECT wq.query_id, df, sum(wq.idf * top) OVER (PARTITION BY wq.query_id ORDER BY df DESC, wq.term ROWS UNBOUNDED PRECEDING) < total * 0.25 * (1 - 1e-9) * 0.75 AS optional
  FROM wq JOIN df ON df.term = wq.term JOIN tp ON tp.term = wq.term JOIN tot ON tot.query_id = wq.query_id)
SELECT query_id, sum(df)::BIGINT AS all_rows, sum(CASE WHEN optional THEN 0 ELSE df END)::BIGINT AS first_rows FROM e GROUP BY 1""",
            "qa",
        ),
    ),
    "hybrid_recall": (
        hybrid_recall,
        sql_with(
            f""", {_RECALL}, qv AS (SELECT qa.id, embedding FROM qa JOIN vec ON vec.id = session_id),
nn AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) AS rank FROM (SELECT a.id AS query_id, b.id,
  round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS s FROM qv a JOIN qv b ON a.id % 100 = 0) WHERE s >= 0.4 QUALIFY rank <= 30),
fu AS (SELECT query_id, id, round(sum(1.0 / (60 + rank)::DOUBLE), 9) AS score FROM (SELECT query_id, id, rank FROM kw UNION ALL SELECT query_id, id, rank FROM nn) GROUP BY 1, 2)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::BIGINT AS rank FROM fu QUALIFY rank <= 30""",
            "qa",
            "vec",
        ),
    ),
    "trained_recall": (trained_recall, None),
    "word_pairs": (
        word_pairs,
        sql_with(
            """, t AS (SELECT id, regexp_extract_all(lower(title || chr(10) || question), '[\\p{L}\\p{N}]+') AS w FROM qa),
v AS (SELECT word, row_number() OVER (ORDER BY n DESC, word) - 1 AS place FROM (SELECT word, count(*) AS n FROM (SELECT DISTINCT id, unnest(w) AS word FROM t) GROUP BY 1) QUALIFY place < 2048),
e AS (SELECT id, pos, place FROM (SELECT id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM t) JOIN v USING (word))
SELECT least(x.place, y.place)::BIGINT AS a, greatest(x.place, y.place)::BIGINT AS b, count(*)::BIGINT AS n FROM e x JOIN e y ON x.id = y.id AND y.pos - x.pos BETWEEN 1 AND 4 GROUP BY 1, 2""",
            "qa",
        ),
    ),
    "recalled_topics": (
        recalled_topics,
        sql_with(
            f""", {_RECALL}, f AS (SELECT query_id, topic_id, min(rank) AS best FROM kw JOIN qa ON qa.id = kw.id WHERE rank <= 30 GROUP BY 1, 2),
r AS (SELECT query_id, topic_id, row_number() OVER (PARTITION BY query_id ORDER BY best, topic_id)::BIGINT AS rank FROM f),
t AS (SELECT topic_id, count(*)::BIGINT AS ask_count, string_agg(id::VARCHAR, ',' ORDER BY created_s, id) AS note_ids FROM qa GROUP BY 1)
SELECT query_id, rank, r.topic_id, ask_count, note_ids FROM r JOIN t ON t.topic_id = r.topic_id WHERE rank <= 5""",
            "qa",
        ),
    ),
    "recalled_notes": (
        recalled_notes,
        sql_with(
            f""", {_RECALL}, f AS (SELECT query_id, topic_id, min(rank) AS best FROM kw JOIN qa ON qa.id = kw.id WHERE rank <= 30 GROUP BY 1, 2),
t AS (SELECT DISTINCT topic_id FROM (SELECT topic_id FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY best, topic_id) <= 5))
SELECT topic_id, row_number() OVER (PARTITION BY topic_id ORDER BY created_s, id)::BIGINT AS place, id FROM qa WHERE topic_id IN (SELECT topic_id FROM t)""",
            "qa",
        ),
    ),
    "rank_fusion": (
        rank_fusion,
        sql_with(
            """, l AS (SELECT topic_id AS query_id, id, row_number() OVER (PARTITION BY topic_id ORDER BY embedding[1] DESC, id) AS rank FROM vec WHERE embedding[1] > 0
  UNION ALL SELECT topic_id, id, row_number() OVER (PARTITION BY topic_id ORDER BY embedding[2] DESC, id) FROM vec), s AS (SELECT query_id, id, round(sum(1.0 / (60 + rank)::DOUBLE), 9) AS score FROM l GROUP BY 1, 2)
SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::BIGINT AS rank FROM s""",
            "vec",
        ),
    ),
    "note_keys": (note_keys, sql_with("SELECT id, 'model:' || sha256(title || chr(10) || question) AS key FROM qa", "qa")),
    "embedding_plan": (
        embedding_plan,
        sql_with(
            """, k AS (SELECT id, 'model:' || sha256(title || chr(10) || question) AS key FROM qa), a AS (SELECT DISTINCT key FROM k WHERE id % 3 <> 0), b AS (SELECT DISTINCT key FROM k WHERE id % 5 <> 0)
SELECT key, 'embed' AS action FROM a WHERE key NOT IN (SELECT key FROM b) UNION ALL SELECT key, 'drop' FROM b WHERE key NOT IN (SELECT key FROM a)""",
            "qa",
        ),
    ),
    "centroids": (centroids, sql_with(f", {_CENT} SELECT topic_id, pos::BIGINT AS pos, round(x, 5) + 0.0 AS x FROM cc", "vec")),
    "change_signatures": (change_signatures, sql_with("SELECT topic_id, sha256(string_agg(id::VARCHAR, chr(10) ORDER BY id::VARCHAR)) AS signature FROM vec GROUP BY 1", "vec")),
    "topic_signatures": (topic_signatures, sql_with(f"SELECT topic_id, {KEY_SUMS} AS signature FROM vec GROUP BY 1", "vec")),
    "similar_topics": (similar_topics, sql_with(f", {_CENT} SELECT s5.topic_id, other, round(s, 4) AS similarity, ask_count FROM s5 JOIN tc ON tc.topic_id = other", "vec")),
    "duplicate_topics": (
        duplicate_topics,
        sql_with(
            f""", {_CENT}, p AS (SELECT least(topic_id, other) AS x, greatest(topic_id, other) AS y, max(s) AS s FROM s5 GROUP BY 1, 2),
k AS (SELECT p.* FROM p WHERE NOT EXISTS (SELECT 1 FROM vec WHERE id % 11 = 0 AND topic_id = x AND topic_id + 1 = y))
SELECT CASE WHEN a.ask_count > b.ask_count THEN y ELSE x END AS a, CASE WHEN a.ask_count > b.ask_count THEN x ELSE y END AS b, round(s, 4) AS similarity FROM k JOIN tc a ON a.topic_id = x JOIN tc b ON b.topic_id = y""",
            "vec",
        ),
    ),
}
QUERIES["kept_index_search"] = (kept_index_search, QUERIES["bm25_search"][1])
QUERIES["indexed_neighbours"] = (indexed_neighbours, QUERIES["vector_neighbours"][1])
QUERIES["refreshed_centroids"] = (refreshed_centroids, QUERIES["centroids"][1])
