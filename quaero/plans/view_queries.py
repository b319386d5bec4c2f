"""Queries of views with tags: resolved rows, tags in use, search with a tag, recall results, timeline items, export."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import activity as A
from ..operators import resolve
from ..operators import search as R
from ..operators import views as W
from ..sources import tables as S
from ..sources.store import stored
from ..sources.tables import sql_with
from . import recall_queries
from .activity_queries import _chains, _notes
from .edit_queries import QUERIES as EDITS
from .edit_queries import saved_requests


def _aliases(spark, d):
    return resolve.follow(S.tag_aliases(spark, d), "from_tag", "to_tag")


def _rows(spark, d):
    return W.note_rows(S.tagged_files(spark, d), _chains(spark, d), _aliases(spark, d))


def note_rows(spark, d):
    """Tags in order of the alphabet, as DuckDB keeps no order among distinct items."""
    return _rows(spark, d).select("id", "path", F.array_join(F.array_sort("tags"), ",").alias("tags"), "topic_id")


def tags_in_use(spark, d):
    return W.tags_in_use(_rows(spark, d), _aliases(spark, d))


def tag_usage(spark, d):
    return W.tag_usage(_rows(spark, d))


def file_locations(spark, d):
    return W.file_locations(S.tagged_files(spark, d), "topic_id")


def json_export(spark, d):
    """The resolved rows as JSON lines, without their tags."""
    return W.exported(_rows(spark, d).select("id", "path", "topic_id")).withColumnRenamed("value", "line")


def timeline_items(spark, d):
    """Turns of the system stand for annotations of the note with their conversation's number."""
    labels = S.notes(spark, d).groupBy("topic_id").agg(F.min("project").alias("label"))
    annotations = S.load(spark, d, "conversations").where("role = 'system'").select(F.col("conv_id").alias("note_id"))
    return A.timeline_items(_notes(spark, d), labels, annotations).select("id", "topic_id", "label", "ask_index", "ask_count", "n_annotations")


def newest_page(spark, d):
    """The first page of the timeline, with the cursor of the next."""
    return A.page_with_next(_notes(spark, d), 50).select("id", "topic_id", "created", F.coalesce("next", F.lit("")).alias("next"))


def tagged_search(spark, d):
    """Questions with an even length ask under their own first word, the others under 'the'."""
    q = S.tagged_questions(spark, d)
    asked = q.where("id % 100 = 0").select(F.col("id").alias("query_id"), F.col("question").alias("query"), F.when(F.length("question") % 2 == 0, F.get("tags", F.lit(0))).otherwise("the").alias("tag"))
    return W.tagged_search(asked, q, _aliases(spark, d))


def recall_results(spark, d):
    """The topics of each recall, and the tags in use beside them."""
    q = S.tagged_questions(spark, d)
    found = W.recall_result(R.keyword_recall(recall_queries._asked(spark, d), q, limit=R.CANDIDATES), q, W.topic_labels(q, "created_s"))
    topics = found.select(F.lit("topic").alias("part"), "query_id", "rank", F.md5("label").alias("name"), "ask_count", "semantic")
    tags = W.tag_usage(q).select(F.lit("tag").alias("part"), F.lit(-1).cast("long").alias("query_id"), F.lit(0).cast("long").alias("rank"), F.md5("tag").alias("name"), F.col("n_notes").alias("ask_count"), F.lit(False).alias("semantic"))
    return topics.unionByName(tags)


def ask_counts_after(spark, d):
    """Requests that join a topic, and the topic's count once each is saved."""
    saved = stored(saved_requests(spark, d)).where("NOT is_new_topic")
    return W.ask_counts_after(saved, _notes(spark, d).select(F.col("topic_id").cast("string").alias("topic_id")))


def _topics(spark, d):
    return S.notes(spark, d).groupBy(F.col("topic_id").alias("id")).agg(F.min("project").alias("label"), F.min("created").alias("created"))


def topic_pages(spark, d):
    return W.topic_pages(_notes(spark, d), _topics(spark, d), _chains(spark, d))


def merged_topics(spark, d):
    return W.merged_topics(_topics(spark, d), _chains(spark, d))


def topic_positions(spark, d):
    return W.topic_positions(_notes(spark, d)).select("id", "topic_id", F.col("position").cast("long").alias("position"))


def _file_tables(spark, d):
    """Documents as note files, pages as topic files, turns of the system as annotation files; equal contents share an id."""
    pages = S.load(spark, d, "pages").select(F.md5("html").alias("id"), F.concat(F.lit("topics/"), F.col("page_id").cast("string"), F.lit(".md")).alias("path"))
    turns = S.load(spark, d, "conversations").where("role = 'system'")
    annotations = turns.select(F.md5("text").alias("id"), F.concat_ws("/", F.lit("annotations"), F.col("conv_id").cast("string"), F.concat(F.col("turn").cast("string"), F.lit(".md"))).alias("path"))
    return {"note": S.files(spark, d).where("id IS NOT NULL").select("id", "path"), "topic": pages.where("id IS NOT NULL"), "annotation": annotations.where("id IS NOT NULL")}


def all_conflicts(spark, d):
    return resolve.conflict_ids(_file_tables(spark, d))


def _part_labels(spark, d):
    """Names of parts stand for the labels of topics."""
    return S.load(spark, d, "part").select(F.col("p_partkey").alias("topic_id"), F.col("p_name").alias("label"))


def _remarks(spark, d):
    """Each label of a document stands for an annotation of its note."""
    documents = S.load(spark, d, "documents").select("doc_id", F.md5("text").alias("note_id"))
    return S.load(spark, d, "labels").join(documents.hint("shuffle_merge"), "doc_id").select(
        "note_id", F.col("doc_id").alias("id"), F.col("quality").alias("created"), F.concat_ws(" ", "quality", "toxic").alias("body")
    )


def note_details(spark, d):
    """Every note, with a digest of its markdown."""
    found = W.note_details(_rows(spark, d), _part_labels(spark, d), _remarks(spark, d))
    return found.select("id", "path", F.sha2("markdown", 256).alias("markdown_sha256"), F.array_join(F.array_sort("tags"), ",").alias("tags"), "topic_id", "label", "ask_count", "n_annotations")


def note_annotations(spark, d):
    return W.note_annotations(_rows(spark, d), _remarks(spark, d))


def project_counts(spark, d):
    """Notes of documents: the source stands for the folder, the host of the page with the document's id for the repository."""
    hosts = S.load(spark, d, "pages").select(F.col("page_id").alias("doc_id"), F.regexp_extract("url", "//([^/]+)", 1).alias("git_repo"))
    notes = S.load(spark, d, "documents").select("doc_id", F.col("source").alias("cwd"), F.col("lang").alias("agent"))
    return W.project_counts(notes.join(hosts.hint("shuffle_merge"), "doc_id", "left"))


def labelled_similar(spark, d):
    return W.labelled_pairs(recall_queries.similar_topics(spark, d), _part_labels(spark, d), "topic_id", "other")


def labelled_duplicates(spark, d):
    return W.labelled_pairs(recall_queries.duplicate_topics(spark, d), _part_labels(spark, d), "a", "b")


def health_report(spark, d):
    """Files without a text that tells a title (no line of 40 characters or more) stand for invalid ones."""
    invalid = S.files(spark, d).where("NOT coalesce(body RLIKE '[^\\\\n]{40}', false)")
    return W.health_report(_file_tables(spark, d), invalid)


_TAGS = "list_distinct([lower(split_part(title, ' ', 1)), lower(split_part(title, ' ', -1))])"
_LABELS = "l AS (SELECT topic_id, min(project) AS label FROM note0 GROUP BY 1), a AS (SELECT conv_id AS id, count(*) AS n FROM conversations WHERE role = 'system' GROUP BY 1)"
_BM25 = recall_queries.QUERIES["bm25_search"][1].rsplit("SELECT * FROM rk", 1)[0]
_SAVED = EDITS["save_batch"][1].rsplit("SELECT id AS request_id", 1)[0]

_TOPICS = "tp AS (SELECT topic_id AS id, min(project) AS label, min(created) AS created FROM note0 GROUP BY 1)"
_FILES = """fl AS (SELECT 'note' AS kind, md5(text) AS id FROM documents UNION ALL SELECT 'topic', md5(html) FROM pages UNION ALL SELECT 'annotation', md5(text) FROM conversations WHERE role = 'system'),
cf AS (SELECT kind, id, count(*)::BIGINT AS n_copies FROM fl WHERE id IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1)"""

def _labelled(name, x, y):
    """The SQL of a query on pairs with both sides' labels."""
    return f"""SELECT p.*, coalesce(lx.p_name, '') AS label_{x}, coalesce(ly.p_name, '') AS label_{y}
FROM ({recall_queries.QUERIES[name][1]}) p LEFT JOIN part lx ON lx.p_partkey = p.{x} LEFT JOIN part ly ON ly.p_partkey = p.{y}"""


QUERIES = {
    "note_rows": (note_rows, sql_with(", _ AS (SELECT 1) SELECT id, path, array_to_string(tags, ',') AS tags, topic_id FROM row_", "row_")),
    "tags_in_use": (tags_in_use, sql_with(", _ AS (SELECT 1) SELECT DISTINCT unnest(tags) AS tag FROM row_ UNION SELECT min(lang) FROM documents GROUP BY source", "row_")),
    "tag_usage": (tag_usage, sql_with(", t AS (SELECT unnest(tags) AS tag FROM row_) SELECT tag, count(*)::BIGINT AS n_notes FROM t GROUP BY 1", "row_")),
    "file_locations": (file_locations, sql_with(", _ AS (SELECT 1) SELECT id, path, topic_id FROM tagged QUALIFY row_number() OVER (PARTITION BY id ORDER BY length(path), path) = 1", "tagged")),
    "json_export": (json_export, sql_with(""", _ AS (SELECT 1) SELECT '{"id":"' || id || '","path":"' || path || '","topic_id":' || topic_id || '}' AS line FROM row_""", "row_")),
    "timeline_items": (
        timeline_items,
        sql_with(
            f""", {_LABELS} SELECT note.id, note.topic_id, coalesce(label, '') AS label, row_number() OVER (PARTITION BY note.topic_id ORDER BY created_utc, note.id)::BIGINT AS ask_index,
  count(*) OVER (PARTITION BY note.topic_id)::BIGINT AS ask_count, coalesce(n, 0)::BIGINT AS n_annotations FROM note LEFT JOIN l ON l.topic_id = note.topic_id LEFT JOIN a ON a.id = note.id""",
            "note",
        ),
    ),
    "newest_page": (
        newest_page,
        sql_with(
            """, p AS (SELECT *, row_number() OVER (ORDER BY created_utc DESC, id DESC) AS k FROM note)
SELECT id, topic_id, created, (SELECT CASE WHEN max(k) > 50 THEN max(CASE WHEN k = 50 THEN created || ' ' || id ELSE '' END) ELSE '' END FROM p) AS next FROM p WHERE k <= 50""",
            "note",
        ),
    ),
    "tagged_search": (
        tagged_search,
        f"""{_BM25}, tg AS (SELECT id, lower(split_part(title, ' ', 1)) AS first_word, {_TAGS} AS tags, question FROM qa)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rank)::BIGINT AS rank, rk.id, score FROM rk JOIN tg n ON n.id = rk.id JOIN tg q ON q.id = rk.query_id
WHERE list_contains(n.tags, CASE WHEN length(q.question) % 2 = 0 THEN q.first_word ELSE 'the' END) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank) <= 20""",
    ),
    "recall_results": (
        recall_results,
        sql_with(
            f""", {recall_queries._RECALL}, f AS (SELECT query_id, topic_id, min(rank) AS best FROM kw JOIN qa ON qa.id = kw.id WHERE rank <= 30 GROUP BY 1, 2),
r AS (SELECT query_id, topic_id, row_number() OVER (PARTITION BY query_id ORDER BY best, topic_id)::BIGINT AS rank FROM f),
t AS (SELECT topic_id, count(*)::BIGINT AS ask_count, arg_min(title, (created_s, id)) AS label FROM qa GROUP BY 1), u AS (SELECT unnest({_TAGS}) AS tag FROM qa)
SELECT 'topic' AS part, query_id, rank, md5(label) AS name, ask_count, false AS semantic FROM r JOIN t ON t.topic_id = r.topic_id WHERE rank <= 5
UNION ALL SELECT 'tag', -1, 0, md5(tag), count(*)::BIGINT, false FROM u GROUP BY tag""",
            "qa",
        ),
    ),
    "ask_counts_after": (
        ask_counts_after,
        f"""{_SAVED}, c AS (SELECT topic_id::VARCHAR AS topic, count(*) AS n FROM note GROUP BY 1)
SELECT id AS request_id, ended AS topic_id, (coalesce(n, 0) + row_number() OVER (PARTITION BY ended ORDER BY id))::BIGINT AS ask_count FROM j LEFT JOIN c ON c.topic = ended WHERE reason = '' AND j.topic <> 'new'""",
    ),
    "topic_pages": (
        topic_pages,
        sql_with(
            f""", {_TOPICS}, mg AS (SELECT root_id, count(*) AS n FROM root GROUP BY 1)
SELECT n.topic_id, coalesce(label, '') AS label, coalesce(tp.created, '') AS created, count(*)::BIGINT AS ask_count, count(DISTINCT session_id)::BIGINT AS sessions, coalesce(any_value(mg.n), 0)::BIGINT AS n_merged
FROM note n LEFT JOIN tp ON tp.id = n.topic_id LEFT JOIN mg ON mg.root_id = n.topic_id GROUP BY 1, 2, 3""",
            "note",
        ),
    ),
    "merged_topics": (merged_topics, sql_with(f", {_TOPICS} SELECT root_id AS topic_id, start_id AS merged_id, coalesce(label, '') AS label FROM root LEFT JOIN tp ON tp.id = start_id", "root")),
    "topic_positions": (topic_positions, sql_with("SELECT id, topic_id, row_number() OVER (PARTITION BY topic_id ORDER BY created, id)::BIGINT AS position FROM note", "note")),
    "note_details": (
        note_details,
        sql_with(
            """, an AS (SELECT md5(text) AS id, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1), tc AS (SELECT topic_id, count(*) AS n FROM row_ GROUP BY 1)
SELECT r.id, r.path, sha256(body) AS markdown_sha256, array_to_string(r.tags, ',') AS tags, r.topic_id, coalesce(p_name, '') AS label, tc.n::BIGINT AS ask_count, coalesce(an.n, 0)::BIGINT AS n_annotations
FROM row_ r JOIN doc ON doc.path = r.path LEFT JOIN an ON an.id = r.id LEFT JOIN tc ON tc.topic_id = r.topic_id LEFT JOIN part ON p_partkey = r.topic_id""",
            "row_",
        ),
    ),
    "note_annotations": (
        note_annotations,
        """SELECT md5(text) AS note_id, row_number() OVER (PARTITION BY md5(text) ORDER BY quality NULLS FIRST, doc_id)::BIGINT AS place, doc_id AS id, concat_ws(' ', quality, toxic) AS body
FROM labels JOIN documents USING (doc_id) WHERE text IS NOT NULL""",
    ),
    "project_counts": (
        project_counts,
        """SELECT coalesce(regexp_extract(url, '//([^/]+)', 1), source, '') AS project, count(*)::BIGINT AS n_notes, count(DISTINCT lang)::BIGINT AS n_agents
FROM documents LEFT JOIN pages ON page_id = doc_id GROUP BY 1""",
    ),
    "labelled_similar": (labelled_similar, _labelled("similar_topics", "topic_id", "other")),
    "labelled_duplicates": (labelled_duplicates, _labelled("duplicate_topics", "a", "b")),
    "all_conflicts": (all_conflicts, f"WITH {_FILES} SELECT * FROM cf"),
    "health_report": (
        health_report,
        f"""WITH {_FILES}, r AS (SELECT (SELECT count(*) FROM cf)::BIGINT AS conflicts, (SELECT count(*) FROM documents WHERE NOT coalesce(regexp_matches(text, '[^\\n]{{40}}'), false))::BIGINT AS invalid_files,
  (SELECT count(DISTINCT id) FROM fl WHERE kind = 'note')::BIGINT AS notes, (SELECT count(DISTINCT id) FROM fl WHERE kind = 'topic')::BIGINT AS topics, (SELECT count(DISTINCT id) FROM fl WHERE kind = 'annotation')::BIGINT AS annotations)
SELECT *, conflicts = 0 AND invalid_files = 0 AS ok FROM r""",
    ),
}
