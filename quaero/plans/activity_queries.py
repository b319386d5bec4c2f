"""Queries over notes in time: resolution, counts, calendars, timelines, conflicts and edits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import activity as A
from ..operators import edits, resolve
from ..operators import vectors as V
from ..operators.page_layout import PageLayout
from ..sources import tables as S
from ..sources.store import sized
from ..sources.tables import KEY_SUMS, sql_with


def _chains(spark, d):
    return resolve.follow(S.merges(spark, d), "id", "merged_into")


def _notes(spark, d):
    return resolve.resolved(S.notes(spark, d), "topic_id", sized(_chains(spark, d)))


def _annotated(spark, d):
    """Notes with a comment: the purchases of the event stream stand for them."""
    return S.notes(spark, d).where("id % 50 = 0").select("id")


def merge_resolution(spark, d):
    return _chains(spark, d).select(F.col("start").alias("id"), F.col("resolved").alias("topic_id"))


def _counts(spark, d):
    return A.topic_counts(_notes(spark, d), _annotated(spark, d))


COUNTS = """counts AS (SELECT topic_id, count(*)::BIGINT AS ask_count, arg_min(created, created_utc) AS first_asked, arg_max(created, created_utc) AS last_asked,
  bool_or(id % 50 = 0) AS annotated FROM note GROUP BY 1)"""
DAYS = "days AS (SELECT substring(created, 1, 10) AS day, count(*)::BIGINT AS n_notes FROM note GROUP BY 1)"


def top_topics(spark, d):
    return A.top_topics(_counts(spark, d))


def topic_counts(spark, d):
    return _counts(spark, d)


def repeats(spark, d):
    return A.repeats(_counts(spark, d))


def undigested(spark, d):
    return A.undigested(_counts(spark, d)).select("topic_id", "ask_count")


def tag_counts(spark, d):
    return A.count_by(_notes(spark, d), F.col("tag"), "tag")


def by_day(spark, d):
    return A.by_day(_notes(spark, d))


def by_week(spark, d):
    return A.by_week(_notes(spark, d))


def by_project(spark, d):
    return A.count_by(_notes(spark, d), F.coalesce("project", F.lit("")), "project")


def by_agent(spark, d):
    return A.count_by(S.load(spark, d, "conversations"), F.col("role"), "agent")


def topic_detail(spark, d):
    return A.topic_detail(_notes(spark, d), resolve.merged_from(_chains(spark, d)))


def heat_map(spark, d):
    return A.heat_map(A.by_day(_notes(spark, d)))


def weekly(spark, d):
    return A.weekly(A.by_day(_notes(spark, d)))


def active_days(spark, d):
    return A.active_days(A.by_day(_notes(spark, d)))


def project_shares(spark, d):
    return A.bar_shares(by_project(spark, d), "project")


def timeline(spark, d):
    return A.timeline(_notes(spark, d)).select("id", "topic_id", "created", F.col("ask_index").cast("int").alias("ask_index"), "ask_count")


def timeline_page(spark, d):
    last = S.notes(spark, d).agg(F.max("created_utc")).first()[0]
    rows = A.page(_notes(spark, d).where("tag = 'click'"), 50, (last, 0))
    return rows.select("id", "topic_id", "created")


def timeline_pages(spark, d):
    return A.page_numbers(_notes(spark, d), 50)


def _tenths(layout, size):
    """The number of the page at each tenth of the depth."""
    n_pages = -(-layout.n_rows() // size)
    return sorted({n_pages * k // 10 for k in range(10)})


def deep_pages(spark, d):
    """Ten pages of a layout of all notes, by number, at each tenth of its depth."""
    layout = PageLayout.write(S.notes(spark, d), file_rows=5_000)
    pages = [layout.numbered(k, 50) for k in _tenths(layout, 50)]
    return reduce(DataFrame.unionByName, pages).select("id", "created", "place")


def deep_cursors(spark, d):
    """The pages after those of deep_pages, each by the cursor that its last row gives; page is the number before."""
    layout = PageLayout.write(S.notes(spark, d), file_rows=5_000)
    pages = []
    for k in _tenths(layout, 50):
        last = layout.numbered(k, 50).orderBy("created_utc", "id").first()
        pages.append(layout.page(50, (last.created_utc, last.id)).withColumn("page", F.lit(k).cast("long")))
    return reduce(DataFrame.unionByName, pages).select("page", "id", "created")


def day_sections(spark, d):
    return A.day_sections(_notes(spark, d))


def day_signatures(spark, d):
    """What tells whether a day's section has changed."""
    return V.change_sums(_notes(spark, d).withColumn("day", F.substring("created", 1, 10)), "day")


def totals(spark, d):
    one = A.repeats(_counts(spark, d)).select("topics", "repeated")
    n = _notes(spark, d).agg(F.count(F.lit(1)).alias("notes"), F.count_if(F.col("id") % 50 == 0).alias("annotations"))
    c = resolve.conflict_ids({"note": S.files(spark, d)}).agg(F.count(F.lit(1)).alias("conflicts"))
    return n.crossJoin(one).crossJoin(c)  # one row each


def health(spark, d):
    found = resolve.conflict_ids({"note": S.files(spark, d)})
    bad = S.files(spark, d).where("length(body) < 40").select(F.lit("invalid").alias("problem"), F.col("path").alias("subject"))
    return found.select(F.lit("conflict").alias("problem"), F.col("id").alias("subject")).unionByName(bad)


def canonical(spark, d):
    return resolve.canonical(S.files(spark, d)).select("id", "path", "source")


def conflicts(spark, d):
    return resolve.conflicts({"note": S.files(spark, d)}).select("kind", "id", F.array_join("paths", "|").alias("paths"))


def settled(spark, d):
    found = resolve.conflict_copies({"note": S.files(spark, d)})
    first = found.groupBy("kind", "id").agg(F.min(F.struct(F.length("path").alias("n"), "path")).alias("first"))
    decisions = first.select("kind", "id", F.col("first.path").alias("keep")).unionByName(S.files(spark, d).where("doc_id % 100 = 0").select(F.lit("topic").alias("kind"), "id", F.col("path").alias("keep")).distinct())
    return resolve.settle(found, decisions)


def merged_from(spark, d):
    return resolve.merged_from(_chains(spark, d)).select("topic_id", F.array_join("merged_ids", ",").alias("merged_ids"))


def ask_counts(spark, d):
    """The count of every topic id that notes or merges name, after resolution."""
    ends = S.notes(spark, d).select("topic_id").union(S.merges(spark, d).select("id")).distinct().withColumn("asked_id", F.col("topic_id"))
    ends = resolve.resolved(ends, "topic_id", sized(_chains(spark, d)))
    n = _notes(spark, d).groupBy("topic_id").agg(F.count(F.lit(1)).alias("n"))
    return ends.join(n, "topic_id", "left").select("asked_id", "topic_id", F.coalesce("n", F.lit(0)).alias("ask_count"))


def sessions_verified(spark, d):
    """Notes whose session is in the catalogue of sessions, and those whose isn't."""
    sessions = S.load(spark, d, "customer").select(F.col("c_custkey").alias("session_id"), F.lit(True).alias("known"))
    rows = S.notes(spark, d).join(sessions, "session_id", "left")
    return rows.groupBy("session_id").agg(F.bool_or(F.coalesce("known", F.lit(False))).alias("verified"), F.count(F.lit(1)).alias("n_notes"))


def note_view(spark, d):
    """Each question with its later turns as nested comments, in order."""
    q = S.questions(spark, d)
    turns = S.load(spark, d, "conversations").where("role = 'system'").groupBy(F.col("conv_id").alias("session_id")).agg(F.array_sort(F.collect_list(F.struct("turn", F.md5("text").alias("m")))).alias("c"))
    return q.join(turns, "session_id", "left").select("id", F.coalesce(F.array_join("c.m", ","), F.lit("")).alias("comments"), F.coalesce(F.size("c"), F.lit(0)).cast("long").alias("n_comments"))


def merge_batch(spark, d):
    """Merge requests between topics, validated against the topics and merges that exist."""
    topics = S.notes(spark, d).select(F.col("topic_id").alias("id")).distinct()
    requests = topics.where("id % 5 = 1").select(F.col("id").alias("seq"), F.col("id").alias("source"), (F.col("id") + 7).alias("target"))
    return edits.merge_topics(requests, topics, _chains(spark, d))


def renamed_topics(spark, d):
    labels = S.notes(spark, d).groupBy(F.col("topic_id").alias("id")).agg(F.min("project").alias("label"))
    changes = labels.where("id % 4 = 0").select(F.col("id").alias("topic_id"), F.concat(F.lit(" topic "), F.col("id").cast("string")).alias("label"), F.lit(1).alias("seq"))
    return edits.rename_topics(labels, changes)[0].select("id", F.coalesce("label", F.lit("")).alias("label"))


QUERIES = {
    "top_topics": (top_topics, sql_with(f", {COUNTS} SELECT * FROM counts ORDER BY ask_count DESC, last_asked DESC, topic_id LIMIT 20", "note")),
    "merge_resolution": (merge_resolution, sql_with("SELECT start_id AS id, root_id AS topic_id FROM root", "root")),
    "topic_counts": (topic_counts, sql_with(f", {COUNTS} SELECT * FROM counts", "note")),
    "repeats": (
        repeats,
        sql_with(
            f""", {COUNTS}, r AS (SELECT count(*)::BIGINT AS topics, count(*) FILTER (WHERE ask_count >= 2)::BIGINT AS repeated,
  count(*) FILTER (WHERE ask_count >= 2 AND annotated)::BIGINT AS annotated_repeated FROM counts)
SELECT *, round(100 * repeated / nullif(topics, 0))::BIGINT AS repeated_share, round(100 * annotated_repeated / nullif(repeated, 0))::BIGINT AS annotated_share FROM r""",
            "note",
        ),
    ),
    "undigested": (undigested, sql_with(f", {COUNTS} SELECT topic_id, ask_count FROM counts WHERE ask_count >= 2 AND NOT annotated", "note")),
    "tag_counts": (tag_counts, sql_with("SELECT tag, count(*)::BIGINT AS n_notes FROM note GROUP BY 1", "note")),
    "by_day": (by_day, sql_with(f", {DAYS} SELECT * FROM days", "note")),
    "by_week": (by_week, sql_with("SELECT strftime(created_utc, '%G-W%V') AS week, count(*)::BIGINT AS n_notes FROM note GROUP BY 1", "note")),
    "by_project": (by_project, sql_with("SELECT coalesce(project, '') AS project, count(*)::BIGINT AS n_notes FROM note GROUP BY 1", "note")),
    "by_agent": (by_agent, "SELECT role AS agent, count(*)::BIGINT AS n_notes FROM conversations GROUP BY 1"),
    "topic_detail": (
        topic_detail,
        sql_with(
            """, m AS (SELECT root_id AS topic_id, string_agg(start_id::VARCHAR, ',' ORDER BY start_id) AS merged_ids FROM root GROUP BY 1)
SELECT topic_id, count(*)::BIGINT AS ask_count, count(DISTINCT session_id)::BIGINT AS sessions, coalesce(any_value(merged_ids), '') AS merged_ids FROM note LEFT JOIN m USING (topic_id) GROUP BY 1""",
            "note",
        ),
    ),
    "heat_map": (
        heat_map,
        sql_with(
            f""", {DAYS}, e AS (SELECT max(day)::DATE AS last_day FROM days),
spine AS (SELECT last_day, unnest(generate_series(date_trunc('week', last_day) - INTERVAL 175 DAY, date_trunc('week', last_day) + INTERVAL 6 DAY, INTERVAL 1 DAY))::DATE AS date FROM e),
f AS (SELECT strftime(date, '%Y-%m-%d') AS day, coalesce(n_notes, 0) AS n_notes, date > last_day AS future FROM spine LEFT JOIN days ON days.day = strftime(date, '%Y-%m-%d'))
SELECT day, n_notes, future, (CASE WHEN n_notes = 0 THEN 0 ELSE least(4, ceil(4.0 * n_notes / (SELECT max(n_notes) FROM f))) END)::INT AS level FROM f""",
            "note",
        ),
    ),
    "weekly": (
        weekly,
        sql_with(
            f""", {DAYS}, e AS (SELECT date_trunc('week', max(day)::DATE)::DATE AS m FROM days),
spine AS (SELECT unnest(generate_series(m - INTERVAL 105 DAY, m::TIMESTAMP, INTERVAL 7 DAY))::DATE AS monday FROM e),
c AS (SELECT date_trunc('week', day::DATE)::DATE AS monday, sum(n_notes)::BIGINT AS n_notes FROM days GROUP BY 1),
f AS (SELECT spine.monday, coalesce(n_notes, 0) AS n_notes FROM spine LEFT JOIN c ON c.monday = spine.monday)
SELECT strftime(monday, '%G-W%V') AS week, n_notes, n_notes - coalesce(lag(n_notes) OVER (ORDER BY monday), 0) AS change,
  monday = (SELECT min(monday) FROM f WHERE n_notes = (SELECT max(n_notes) FROM f)) AS peak FROM f""",
            "note",
        ),
    ),
    "active_days": (active_days, sql_with(f", {DAYS} SELECT count(*)::BIGINT AS active_days FROM days WHERE day::DATE > (SELECT max(day)::DATE FROM days) - INTERVAL 30 DAY", "note")),
    "project_shares": (
        project_shares,
        sql_with(""", c AS (SELECT coalesce(project, '') AS project, count(*)::BIGINT AS n_notes FROM note GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)
SELECT project, n_notes, round(n_notes / greatest(1, (SELECT max(n_notes) FROM c)), 6) AS share FROM c""", "note"),
    ),
    "timeline": (
        timeline,
        sql_with("""SELECT id, topic_id, created, row_number() OVER (PARTITION BY topic_id ORDER BY created_utc, id)::INT AS ask_index, count(*) OVER (PARTITION BY topic_id)::BIGINT AS ask_count FROM note""", "note"),
    ),
    "timeline_page": (
        timeline_page,
        sql_with("SELECT id, topic_id, created FROM note WHERE tag = 'click' AND created_utc < (SELECT max(created_utc) FROM note) ORDER BY created_utc DESC, id DESC LIMIT 51", "note"),
    ),
    "deep_pages": (
        deep_pages,
        sql_with(
            """, p AS (SELECT id, created, (row_number() OVER (ORDER BY created_utc DESC, id DESC) - 1)::BIGINT AS place FROM note0), n AS (SELECT (count(*) + 49) // 50 AS n FROM note0)
SELECT id, created, place FROM p WHERE place // 50 IN (SELECT n * k // 10 FROM n, range(10) r(k))""",
            "note0",
        ),
    ),
    "deep_cursors": (
        deep_cursors,
        sql_with(
            """, p AS (SELECT id, created, row_number() OVER (ORDER BY created_utc DESC, id DESC) - 1 AS place FROM note0), n AS (SELECT (count(*) + 49) // 50 AS n FROM note0)
SELECT page, id, created FROM p JOIN (SELECT DISTINCT (n * k // 10)::BIGINT AS page FROM n, range(10) r(k)) ON place BETWEEN (page + 1) * 50 AND (page + 2) * 50""",
            "note0",
        ),
    ),
    "timeline_pages": (timeline_pages, sql_with("SELECT id, tag, ((row_number() OVER (PARTITION BY tag ORDER BY created_utc DESC, id DESC) - 1) // 50)::BIGINT AS page FROM note", "note")),
    "day_sections": (
        day_sections,
        sql_with("SELECT substring(created, 1, 10) AS day, count(*)::BIGINT AS n_notes, md5(string_agg(id::VARCHAR, ',' ORDER BY created_utc DESC, id DESC)) AS id_digest FROM note GROUP BY 1", "note"),
    ),
    "day_signatures": (day_signatures, sql_with(f"SELECT substring(created, 1, 10) AS day, {KEY_SUMS} AS signature FROM note GROUP BY 1", "note")),
    "totals": (
        totals,
        sql_with(
            f""", {COUNTS} SELECT (SELECT count(*) FROM note)::BIGINT AS notes, (SELECT count(*) FROM note WHERE id % 50 = 0)::BIGINT AS annotations, (SELECT count(*) FROM counts)::BIGINT AS topics,
  (SELECT count(*) FROM counts WHERE ask_count >= 2)::BIGINT AS repeated, (SELECT count(*) FROM (SELECT id FROM doc GROUP BY 1 HAVING count(*) > 1))::BIGINT AS conflicts""",
            "note",
            "doc",
        ),
    ),
    "health": (health, sql_with("SELECT 'conflict' AS problem, id AS subject FROM doc GROUP BY id HAVING count(*) > 1 UNION ALL SELECT 'invalid', path FROM doc WHERE length(body) < 40", "doc")),
    "canonical": (canonical, sql_with("SELECT id, path, source FROM doc QUALIFY row_number() OVER (PARTITION BY id ORDER BY length(path), path) = 1", "doc")),
    "conflicts": (conflicts, sql_with("SELECT 'note' AS kind, id, string_agg(path, '|' ORDER BY length(path), path) AS paths FROM doc GROUP BY id HAVING count(*) > 1", "doc")),
    "settled_conflicts": (
        settled,
        sql_with(
            """, r AS (SELECT id, path, row_number() OVER (PARTITION BY id ORDER BY length(path), path) AS k, count(*) OVER (PARTITION BY id) AS n FROM doc)
SELECT 'note' AS kind, id, path, CASE WHEN k = 1 THEN 'kept' ELSE 'discarded' END AS outcome FROM r WHERE n > 1
UNION ALL SELECT DISTINCT 'topic', id, path, 'rejected: no such conflict' FROM doc WHERE doc_id % 100 = 0""",
            "doc",
        ),
    ),
    "merged_from": (merged_from, sql_with("SELECT root_id AS topic_id, string_agg(start_id::VARCHAR, ',' ORDER BY start_id) AS merged_ids FROM root GROUP BY 1", "root")),
    "ask_counts": (
        ask_counts,
        sql_with(""", a AS (SELECT DISTINCT topic_id AS asked_id FROM note0 UNION SELECT id FROM edge), t AS (SELECT asked_id, coalesce(root_id, asked_id) AS topic_id FROM a LEFT JOIN root ON start_id = asked_id)
SELECT asked_id, t.topic_id, (SELECT count(*) FROM note WHERE note.topic_id = t.topic_id)::BIGINT AS ask_count FROM t""", "note"),
    ),
    "sessions_verified": (sessions_verified, sql_with("SELECT session_id, session_id IN (SELECT c_custkey FROM customer) AS verified, count(*)::BIGINT AS n_notes FROM note0 GROUP BY 1", "note0")),
    "note_view": (
        note_view,
        sql_with(""", s AS (SELECT conv_id AS session_id, string_agg(md5(text), ',' ORDER BY turn) AS c, count(*) AS n FROM conversations WHERE role = 'system' GROUP BY 1)
SELECT id, coalesce(c, '') AS comments, coalesce(n, 0)::BIGINT AS n_comments FROM qa LEFT JOIN s USING (session_id)""", "qa"),
    ),
    "merge_batch": (
        merge_batch,
        sql_with(
            """, t AS (SELECT DISTINCT topic_id AS id FROM note0), q AS (SELECT id AS seq, id AS s0, id + 7 AS t0 FROM t WHERE id % 5 = 1),
r AS (SELECT seq, s0 IN (SELECT id FROM t) AS sk, t0 IN (SELECT id FROM t) AS tk, coalesce((SELECT root_id FROM root WHERE start_id = s0), s0) AS from_id, coalesce((SELECT root_id FROM root WHERE start_id = t0), t0) AS into_id FROM q),
g AS (SELECT *, row_number() OVER (ORDER BY seq) AS k FROM r WHERE sk AND tk),
turn AS (SELECT 0::BIGINT AS k, map_from_entries([(x, x) FOR x IN list_distinct(list_concat((SELECT list(from_id) FROM g), (SELECT list(into_id) FROM g)))]) AS top, NULL::BIGINT AS a, NULL::BIGINT AS b
  UNION ALL SELECT k, CASE WHEN a = b THEN top ELSE map_from_entries([(e.key, CASE WHEN e.value = a THEN b ELSE e.value END) FOR e IN map_entries(top)]) END, a, b
  FROM (SELECT g.k, top, top[g.from_id] AS a, top[g.into_id] AS b FROM turn JOIN g ON g.k = turn.k + 1))
SELECT seq, a AS from_id, b AS into_id, CASE WHEN a = b THEN 'same topic' END AS reason FROM turn JOIN g USING (k)
UNION ALL SELECT seq, from_id, into_id, CASE WHEN NOT sk THEN 'unknown source' ELSE 'unknown target' END FROM r WHERE NOT (sk AND tk)""",
            "note",
        ),
    ),
    "renamed_topics": (
        renamed_topics,
        sql_with("SELECT topic_id AS id, CASE WHEN topic_id % 4 = 0 THEN 'topic ' || topic_id ELSE coalesce(min(project), '') END AS label FROM note0 GROUP BY topic_id", "note0"),
    ),
}
