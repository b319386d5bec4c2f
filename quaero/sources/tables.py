"""The given tables, and the projections that stand for notes, questions, files, vectors and merges.

Each projection has a DuckDB twin in SQL_VIEWS, from which the queries' counterparts are put together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes over time, from events: id, topic_id, session_id, tag, created, created_utc, project."""
    return load(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        (F.col("user_id") % 40).alias("topic_id"),
        F.col("user_id").alias("session_id"),
        F.col("event_type").alias("tag"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created"),
        F.date_trunc("second", F.col("ts").cast("timestamp")).alias("created_utc"),
        F.col("props").alias("project"),
    )


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Question and answer notes, from each user turn that an assistant turn follows."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.lead("role").over(w).alias("next_role"), F.lead("text").over(w).alias("conclusion"))
    return turns.where("role = 'user' AND next_role = 'assistant'").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"),
        F.col("conv_id").alias("session_id"),
        F.get(F.split("text", "\n"), F.lit(0)).alias("title"),
        F.col("text").alias("question"),
        "conclusion",
        (F.col("conv_id") % 25).alias("topic_id"),
        (F.unix_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp")) + F.col("conv_id") * 25200 + F.col("turn") * 60).alias("created_s"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Note files, from documents: equal texts are sync conflicts of one id."""
    return load(spark, sf_dir, "documents").select(
        F.concat(F.lit("notes/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.md5("text").alias("id"), F.col("text").alias("body"), "lang", "source", "doc_id"
    )


def tagged_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Note files with the tags source and lang, and a topic by the text's length."""
    f = files(spark, sf_dir)
    return f.select("id", "path", "body", F.array("source", "lang").alias("tags"), (F.length("body") % 40).cast("long").alias("topic_id"))


def tag_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tag aliases: each source stands for the least of its languages."""
    return load(spark, sf_dir, "documents").groupBy(F.col("source").alias("from_tag")).agg(F.min("lang").alias("to_tag"))


def tagged_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with the first and the last word of their title as tags."""
    words = F.split(F.lower("title"), " ")
    return questions(spark, sf_dir).withColumn("tags", F.array_distinct(F.array(F.get(words, F.lit(0)), F.element_at(words, -1))))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Note vectors, from embeddings: id, topic_id, embedding."""
    return load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") * 100 + F.col("vec_id") % 100).alias("topic_id"), "embedding")


def merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic merges: id, merged_into."""
    topics = notes(spark, sf_dir).select("topic_id").distinct().where("topic_id % 3 = 0 AND topic_id > 0")
    return topics.select(F.col("topic_id").alias("id"), F.floor(F.col("topic_id") / 2).cast("long").alias("merged_into"))


#: DuckDB twins of the projections above, as members of a WITH RECURSIVE list.
SQL_VIEWS = {
    "note0": """SELECT event_id AS id, user_id % 40 AS topic_id, user_id AS session_id, event_type AS tag,
  strftime(ts, '%Y-%m-%d %H:%M:%S') AS created, date_trunc('second', ts) AS created_utc, props AS project FROM events""",
    "edge": "SELECT topic_id AS id, topic_id // 2 AS merged_into FROM (SELECT DISTINCT topic_id FROM note0) WHERE topic_id % 3 = 0 AND topic_id > 0",
    "walk": """SELECT id AS start_id, merged_into AS cur, 1 AS hops FROM edge
  UNION ALL SELECT w.start_id, e.merged_into, w.hops + 1 FROM walk w JOIN edge e ON e.id = w.cur WHERE w.hops < 60""",
    "root": "SELECT start_id, arg_max(cur, hops) AS root_id FROM walk GROUP BY 1",
    "note": """SELECT n.id, coalesce(r.root_id, n.topic_id) AS topic_id, n.topic_id AS own_topic, session_id, tag, created, created_utc, project
  FROM note0 n LEFT JOIN root r ON r.start_id = n.topic_id""",
    "qa": """SELECT conv_id * 1000 + turn AS id, conv_id AS session_id, split_part(text, chr(10), 1) AS title, text AS question, conclusion,
  conv_id % 25 AS topic_id, epoch(TIMESTAMP '2024-01-01')::BIGINT + conv_id * 25200 + turn * 60 AS created_s
  FROM (SELECT *, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS conclusion FROM conversations)
  WHERE role = 'user' AND next_role = 'assistant'""",
    "doc": "SELECT 'notes/' || source || '/' || doc_id || '.md' AS path, md5(text) AS id, text AS body, lang, source, doc_id FROM documents",
    "tagged": """SELECT id, path, body, list_distinct([coalesce(to_tag, source), lang]) AS tags, length(body) % 40 AS topic_id
  FROM doc LEFT JOIN (SELECT source AS from_tag, min(lang) AS to_tag FROM documents GROUP BY 1) ON from_tag = source""",
    "row_": """SELECT id, path, list_sort(tags) AS tags, coalesce(root_id, topic_id) AS topic_id
  FROM (SELECT * FROM tagged QUALIFY row_number() OVER (PARTITION BY id ORDER BY length(path), path) = 1) LEFT JOIN root ON start_id = topic_id""",
    "vec": "SELECT vec_id AS id, label * 100 + vec_id % 100 AS topic_id, embedding FROM embeddings",
}


#: DuckDB twin of operators.vectors.change_sums over the column id.
KEY_SUMS = "concat_ws('-', count(*)::VARCHAR, " + ", ".join(f"sum(('0x' || substring(md5(id::VARCHAR), {8 * k + 1}, 8))::BIGINT)::VARCHAR" for k in range(4)) + ")"


def sql_with(query: str, *names: str) -> str:
    """The query after a WITH list of these views and what they build on."""
    need = {"edge": ["note0"], "walk": ["edge"], "root": ["walk"], "note": ["note0", "root"], "tagged": ["doc"], "row_": ["tagged", "root"]}
    order: list[str] = []

    def add(name: str) -> None:
        for other in need.get(name, []):
            add(other)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({SQL_VIEWS[n]})" for n in order) + ("," if query.lstrip().startswith("AND ") else "") + "\n" + query.lstrip().removeprefix("AND ")
