"""Queries of validated batches, note details and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import activity as A
from ..operators import edits, resolve
from ..sources import tables as S
from ..sources import vault
from ..sources.store import shared_folder
from ..sources.tables import sql_with
from ..streaming import kept, live
from .activity_queries import _chains, _notes


def _uuid(key):
    """A UUID-shaped text of a key's digest."""
    return F.regexp_replace(F.md5(key.cast("string")), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def _requests(spark, d):
    q = S.questions(spark, d)
    i = F.col("id")
    return q.select(
        i.alias("request_id"),
        F.when(i % 7 == 0, "no-uuid").otherwise(_uuid(i)).alias("session_id"),
        F.when(i % 11 == 0, " ").otherwise("/work").alias("cwd"),
        F.when(i % 13 == 0, "").otherwise(F.concat(F.lit("Question "), i.cast("string"))).alias("title"),
        "question",
        "conclusion",
        F.array(F.lit("one")).alias("key_points"),
        F.expr("cast(array() AS array<string>)").alias("open_questions"),
        F.when(i % 2 == 0, "new").otherwise((i % 50).cast("string")).alias("topic"),
        F.when(i % 5 == 0, F.array(F.lit("Unknown Tag"))).otherwise(F.array(F.lit(" CLICK "), F.lit("alias"))).alias("tags"),
        F.when(i % 3 == 0, F.array(F.lit("views"))).otherwise(F.expr("cast(array() AS array<string>)")).alias("new_tags"),
        (i % 4 == 0).alias("confirm_new"),
        F.lit("2026-01-01T00:00:00Z").alias("created"),
    )


def saved_requests(spark, d):
    known = S.notes(spark, d).select("tag").distinct()
    aliases = known.where("tag = 'click'").select(F.lit("alias").alias("start"), F.lit("view").alias("resolved"))
    topics = S.notes(spark, d).select(F.col("topic_id").cast("string").alias("id")).distinct()
    chains = _chains(spark, d).select(F.col("start").cast("string").alias("start"), F.col("resolved").cast("string").alias("resolved"))
    return edits.save_batch(_requests(spark, d), topics, chains, known, aliases)


def save_batch(spark, d):
    out = saved_requests(spark, d)
    return out.select("request_id", F.coalesce("reject_reason", F.lit("")).alias("reason"), F.when(F.col("is_new_topic"), "new").otherwise(F.col("topic_id")).alias("topic"), F.array_join("tags", ",").alias("tags"))


def _tag_requests(spark, d):
    """Save requests with words of five letters and more of the questions' titles as tags, and the words of the benchmark, known."""
    long_words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-zà-ÿ]{5,}"), F.lit(0))
    none = F.expr("cast(array() AS array<string>)")
    i, w = F.col("id"), F.col("w")
    q = S.questions(spark, d).select("id", long_words(F.col("title")).alias("w"))
    tags = F.when((i % 3 == 0) & (F.size(w) > 0), F.slice(w, 1, 1)).otherwise(none)
    new = F.when(F.size(w) == 0, none).when(i % 4 == 0, F.array_distinct(F.array(F.get(w, F.lit(0)), F.element_at(w, -1)))).otherwise(F.array(F.element_at(w, -1)))
    requests = q.select(i.alias("request_id"), tags.alias("tags"), new.alias("new_tags"), (i % 5 == 0).alias("confirm_new"), (i % 11 != 0).alias("fine"))
    known = S.load(spark, d, "benchmark").select(F.explode(long_words(F.col("text"))).alias("tag")).distinct()
    return requests, known


def tags_in_order(spark, d):
    """The tags of save requests that are taken one after the other, each knowing the tags that those before it made."""
    requests, known = _tag_requests(spark, d)
    out = edits.tag_policy_in_order(requests, known, known.where("false").selectExpr("tag AS start", "tag AS resolved"))
    return out.select("request_id", F.array_join("tags", ",").alias("tags"), F.coalesce("tag_reason", F.lit("")).alias("reason"), F.coalesce(F.array_join("near", ","), F.lit("")).alias("near"))


def merges_in_turn(spark, d):
    """A merge request from each vector's topic, taken one after the other."""
    v = S.vectors(spark, d)
    requests = v.select(F.col("id").alias("seq"), F.col("topic_id").alias("source"), F.pmod(F.col("topic_id") * 37 + F.col("id") % 3, F.lit(1000)).alias("target"))
    none = v.where("false").select(F.col("id").alias("start"), F.col("id").alias("resolved"))
    out = edits.merge_topics(requests, v.select(F.col("topic_id").alias("id")).distinct(), none)
    return out.select("seq", "from_id", "into_id", F.coalesce("reason", F.lit("")).alias("reason"))


def json_requests(spark, d):
    """Save requests read from JSON lines, beside the same notes' plain texts, which are no requests."""
    q = S.questions(spark, d)
    line = F.to_json(F.struct("title", "question", "conclusion"))
    lines = q.select("id", F.lit("json").alias("form"), line.alias("value")).unionByName(q.select("id", F.lit("plain").alias("form"), F.col("question").alias("value")))
    read = vault.requests_from_json(lines)
    return read.select("id", "form", F.md5(F.coalesce("question", F.lit(""))).alias("question"), F.md5(F.coalesce("conclusion", F.lit(""))).alias("conclusion"), F.coalesce("error", F.lit("")).alias("error"))


def annotated_batch(spark, d):
    q = S.questions(spark, d)
    i = F.col("id")
    requests = q.select(i.alias("id"), F.when(i % 6 == 0, -1).otherwise(i).alias("note_id"), F.when(i % 10 == 0, "  ").otherwise(F.concat(F.lit(" secret = "), F.md5("question"), F.lit(" "))).alias("body"), F.lit("x").alias("created"))
    return edits.annotate(requests, q.select("id")).select("id", "note_id", "body", F.coalesce("reason", F.lit("")).alias("reason"))


def annotation_changes(spark, d):
    e = S.load(spark, d, "events")
    old = e.where("event_id % 2 = 0").select(F.col("event_id").alias("id"), F.col("user_id").alias("note_id"), F.col("event_type").alias("body"), F.lit("0").alias("created"), F.lit(None).cast("string").alias("updated"))
    changes = e.where("event_id % 3 = 0").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 5 == 0, "delete").otherwise("update").alias("op"), F.when(F.col("event_id") % 7 == 0, "").otherwise("new body").alias("body"), F.lit(1).alias("seq"), F.lit("1").alias("at"))
    return edits.apply_annotation_changes(old, changes)[0].select("id", "note_id", "body", F.coalesce("updated", F.lit("")).alias("updated"))


def note_detail(spark, d):
    """Each note with its topic's count, label and the way back to its session."""
    n = A.timeline(_notes(spark, d))
    labels = S.notes(spark, d).groupBy("topic_id").agg(F.min("project").alias("label"))
    link, _ = X.reopen(F.lit("codex"), F.col("session_id").cast("string"), F.lit("/"))
    return n.join(labels, "topic_id", "left").select("id", "topic_id", "ask_count", F.coalesce(F.nullif("label", F.lit("")), F.col("topic_id").cast("string")).alias("label"), link.alias("link"))


def notes_by_tag(spark, d):
    """Notes of a tag that is named by its alias."""
    aliases = S.notes(spark, d).where("tag = 'click'").select(F.lit("c").alias("from_tag"), F.lit("click").alias("to_tag"), F.lit("1").alias("created"), F.lit("a").alias("path")).distinct()
    ends = resolve.follow(resolve.latest_alias(aliases), "from_tag", "to_tag")
    return S.notes(spark, d).join(ends.where("start = 'c'").select(F.col("resolved").alias("tag")), "tag", "left_semi").select("id", "tag")


def utc_times(spark, d):
    e = S.load(spark, d, "events")
    offset = F.when(F.col("event_id") % 3 == 0, "Z").when(F.col("event_id") % 3 == 1, "+02:00").otherwise("")
    return e.select("event_id", F.coalesce(X.utc_text(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), offset)), F.lit("")).alias("utc"))


def uuid_checks(spark, d):
    e = S.load(spark, d, "events")
    return e.select("event_id", X.is_uuid(F.when(F.col("event_id") % 2 == 0, _uuid(F.col("event_id"))).otherwise(F.md5(F.col("event_id").cast("string")))).alias("ok"))


def source_lines(spark, d):
    c = S.load(spark, d, "conversations")
    text = F.concat(F.lit("intro\n"), F.when(F.col("conv_id") % 2 == 0, F.concat(F.lit("note-source: codex "), F.col("conv_id").cast("string"), F.lit(" /my work\n"))).otherwise(""), "text")
    s = X.source_line(text, "note-source")
    return c.select("conv_id", "turn", F.coalesce(F.concat_ws("|", s["agent"], s["session"], s["cwd"]), F.lit("")).alias("source"))


def _streamed(spark, d, make):
    """What make gives for the event stream, read in bounded batches and written to a table in the warehouse."""
    source = S.load(spark, d, "events")
    folder = f"{(spark.conf.get('spark.checkpoint.dir', None) or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/quaero-{uuid.uuid4().hex}"
    source.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 64).parquet(f"{folder}/in")
    out = make(stream)
    query = out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


def _stream_notes(stream):
    return stream.select(F.col("event_id").alias("id"), (F.col("user_id") % 40).alias("topic_id"), F.col("ts").cast("timestamp").alias("created_utc"), "event_type", "props")


def stream_ask_counts(spark, d):
    return _streamed(spark, d, lambda s: live.running_ask_counts(_stream_notes(s))).groupBy("topic_id").agg(F.count(F.lit(1)).alias("n_notes"), F.max("ask_index").alias("last_index"), F.count_distinct("ask_index").alias("n_indexes"))


def stream_weeks(spark, d):
    """The weeks of the event stream that its watermark has closed."""
    return _streamed(spark, d, lambda s: live.running_activity(_stream_notes(s)))


def _kept(spark, d, make):
    """What make(folder) keeps of the event stream, read in bounded batches."""
    source = S.load(spark, d, "events")
    folder = shared_folder(spark)
    source.repartition(4, "event_id").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    out = make(f"{folder}/out")
    kept.keep(_stream_notes(stream).withColumn("created", F.date_format("created_utc", "yyyy-MM-dd HH:mm:ss")), out, f"{folder}/state").awaitTermination()
    return out


def kept_weeks(spark, d):
    """Weeks of the event stream in no order of time, the open week and the latest rows among them."""
    return _kept(spark, d, lambda folder: kept.KeptActivity(spark, folder, fan=2)).weeks()


def kept_ask_counts(spark, d):
    rows = _kept(spark, d, lambda folder: kept.KeptOrdinals(spark, folder)).rows()
    return rows.groupBy("topic_id").agg(F.count(F.lit(1)).alias("n_notes"), F.max("ask_index").alias("last_index"), F.count_distinct("ask_index").alias("n_indexes"))


def folder_changes(spark, d):
    """The documents' files by language, listed; then again, once those of languages with an odd number of them are written anew."""
    docs = S.load(spark, d, "documents").select("doc_id", F.md5("text").alias("text"), F.coalesce("lang", F.lit("none")).alias("lang"))
    folder = shared_folder(spark)
    found = kept.FolderChanges(spark, f"{folder}/files", f"{folder}/kept")
    docs.write.partitionBy("lang").parquet(f"{folder}/files")
    found.record()
    odd = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1").select("lang")
    docs.join(F.broadcast(odd), "lang", "left_semi").write.partitionBy("lang").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(f"{folder}/files")
    found.record()
    return found.changes().select(F.col("version").cast("long").alias("version"), F.regexp_extract("path", "lang=([^/]*)/", 1).alias("lang"), "action").distinct()


def stream_redaction(spark, d):
    out = _streamed(spark, d, lambda s: live.redacted_stream(_stream_notes(s).withColumn("text", F.concat(F.lit("token = "), F.md5(F.col("id").cast("string")))), ["text"]))
    return out.select("id", "text")


QUERIES = {
    "save_batch": (
        save_batch,
        sql_with(
            """, t AS (SELECT DISTINCT topic_id::VARCHAR AS id FROM note0), r AS (SELECT id, CASE WHEN id % 2 = 0 THEN 'new' ELSE (id % 50)::VARCHAR END AS topic FROM qa),
j AS (SELECT r.id, topic, coalesce((SELECT root_id::VARCHAR FROM root WHERE start_id::VARCHAR = topic), topic) AS ended,
  CASE WHEN r.id % 7 = 0 THEN 'session_id is not a UUID' WHEN r.id % 11 = 0 THEN 'cwd is empty' WHEN r.id % 13 = 0 THEN 'title is empty' WHEN trim(question) = '' THEN 'question is empty' WHEN trim(conclusion) = '' THEN 'conclusion is empty'
   WHEN r.id % 5 = 0 THEN 'unknown tag: unknown-tag' WHEN r.id % 3 = 0 AND r.id % 4 <> 0 THEN 'near duplicate: views' WHEN topic <> 'new' AND topic NOT IN (SELECT id FROM t) THEN 'unknown topic: ' || topic ELSE '' END AS reason,
  CASE WHEN r.id % 5 = 0 THEN 'unknown-tag' ELSE 'click,view' END || CASE WHEN r.id % 3 = 0 THEN ',views' ELSE '' END AS tags FROM r JOIN qa ON qa.id = r.id)
SELECT id AS request_id, reason, ended AS topic, tags FROM j""",
            "qa",
            "note",
        ),
    ),
    "tags_in_order": (
        tags_in_order,
        sql_with(
            """, w AS (SELECT id, regexp_extract_all(lower(title), '[a-zà-ÿ]{5,}') AS w FROM qa),
kn AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-zà-ÿ]{5,}')) AS t FROM benchmark),
rq AS (SELECT id, row_number() OVER (ORDER BY id) AS k, CASE WHEN id % 3 = 0 AND len(w) > 0 THEN [w[1]] ELSE [] END AS tags,
  CASE WHEN len(w) = 0 THEN [] WHEN id % 4 = 0 AND w[1] <> w[-1] THEN [w[1], w[-1]] ELSE [w[-1]] END AS new_tags, id % 5 = 0 AS confirm, id % 11 <> 0 AS fine FROM w),
kl AS (SELECT list(t) AS known FROM kn),
pr AS (SELECT rq.*, list_filter(tags, lambda t: NOT list_contains(known, t)) AS unsure, list_filter(new_tags, lambda t: NOT list_contains(known, t)) AS fresh, known FROM rq CROSS JOIN kl),
st AS (SELECT 0::BIGINT AS k, []::VARCHAR[] AS made, NULL::BIGINT AS request_id, []::VARCHAR[] AS final, NULL::VARCHAR AS bad, []::VARCHAR[] AS near
  UNION ALL SELECT k, CASE WHEN fine AND bad IS NULL AND len(final) BETWEEN 1 AND 5 THEN list_distinct(list_concat(made, new_tags)) ELSE made END, id, final, bad, CASE WHEN bad LIKE 'near%' THEN close ELSE [] END
  FROM (SELECT *, CASE WHEN lost IS NOT NULL THEN 'unknown tag: ' || lost WHEN twin IS NOT NULL THEN 'near duplicate: ' || twin END AS bad,
    list_sort(list_filter(list_concat(known, made), lambda u: u <> twin AND 1 - levenshtein(twin, u) / greatest(length(twin), length(u))::DOUBLE >= 0.8)) AS close
   FROM (SELECT pr.*, st.made, list_concat(tags, list_filter(new_tags, lambda t: NOT list_contains(tags, t))) AS final, list_filter(unsure, lambda t: NOT list_contains(st.made, t))[1] AS lost,
      list_filter(fresh, lambda t: NOT confirm AND NOT list_contains(st.made, t) AND len(list_filter(list_concat(known, st.made), lambda u: u <> t AND 1 - levenshtein(t, u) / greatest(length(t), length(u))::DOUBLE >= 0.8)) > 0)[1] AS twin
     FROM st JOIN pr ON pr.k = st.k + 1)))
SELECT request_id, array_to_string(final, ',') AS tags, coalesce(bad, CASE WHEN len(final) = 0 THEN 'a note needs a tag' WHEN len(final) > 5 THEN 'more than 5 tags' ELSE '' END) AS reason, array_to_string(near, ',') AS near FROM st WHERE k > 0""",
            "qa",
        ),
    ),
    "merges_in_turn": (
        merges_in_turn,
        sql_with(
            """, t AS (SELECT DISTINCT topic_id AS id FROM vec), q AS (SELECT id AS seq, topic_id AS s0, (topic_id * 37 + id % 3) % 1000 AS t0 FROM vec),
g AS (SELECT *, row_number() OVER (ORDER BY seq) AS k FROM q WHERE t0 IN (SELECT id FROM t)),
turn AS (SELECT 0::BIGINT AS k, map_from_entries([(x, x) FOR x IN (SELECT list(id) FROM t)]) AS top, NULL::BIGINT AS a, NULL::BIGINT AS b
  UNION ALL SELECT k, CASE WHEN a = b THEN top ELSE map_from_entries([(e.key, CASE WHEN e.value = a THEN b ELSE e.value END) FOR e IN map_entries(top)]) END, a, b
  FROM (SELECT g.k, top, top[g.s0] AS a, top[g.t0] AS b FROM turn JOIN g ON g.k = turn.k + 1))
SELECT seq, a AS from_id, b AS into_id, CASE WHEN a = b THEN 'same topic' ELSE '' END AS reason FROM turn JOIN g USING (k)
UNION ALL SELECT seq, s0, t0, 'unknown target' FROM q WHERE t0 NOT IN (SELECT id FROM t)""",
            "vec",
        ),
    ),
    "json_requests": (
        json_requests,
        sql_with(
            """SELECT id, 'json' AS form, md5(coalesce(question, '')) AS question, md5(coalesce(conclusion, '')) AS conclusion, '' AS error FROM qa
UNION ALL SELECT id, 'plain', md5(''), md5(''), 'not a JSON object' FROM qa""",
            "qa",
        ),
    ),
    "annotated_batch": (
        annotated_batch,
        sql_with(
            """SELECT id, CASE WHEN id % 6 = 0 THEN -1 ELSE id END AS note_id, CASE WHEN id % 10 = 0 THEN '' ELSE 'secret = [REDACTED:secret]' END AS body,
 CASE WHEN id % 6 = 0 THEN 'unknown note' WHEN id % 10 = 0 THEN 'annotation is empty' ELSE '' END AS reason FROM qa""",
            "qa",
        ),
    ),
    "annotation_changes": (
        annotation_changes,
        """WITH o AS (SELECT event_id AS id, user_id AS note_id, event_type AS body, event_id % 3 = 0 AND NOT (event_id % 5 <> 0 AND event_id % 7 = 0) AS hit FROM events WHERE event_id % 2 = 0)
SELECT id, note_id, CASE WHEN hit THEN 'new body' ELSE body END AS body, CASE WHEN hit THEN '1' ELSE '' END AS updated FROM o WHERE NOT (hit AND id % 5 = 0)""",
    ),
    "note_detail": (
        note_detail,
        sql_with(""", l AS (SELECT topic_id, min(project) AS label FROM note0 GROUP BY 1)
SELECT id, n.topic_id, count(*) OVER (PARTITION BY n.topic_id)::BIGINT AS ask_count, coalesce(nullif(label, ''), n.topic_id::VARCHAR) AS label, 'codex://threads/' || session_id AS link FROM note n LEFT JOIN l ON l.topic_id = n.topic_id""", "note"),
    ),
    "notes_by_tag": (notes_by_tag, "SELECT event_id AS id, event_type AS tag FROM events WHERE event_type = 'click'"),
    "utc_times": (
        utc_times,
        "SELECT event_id, CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(ts - INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%SZ') ELSE '' END AS utc FROM events",
    ),
    "uuid_checks": (uuid_checks, "SELECT event_id, event_id % 2 = 0 AS ok FROM events"),
    "source_lines": (source_lines, "SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN 'codex|' || conv_id || '|/my work' ELSE '' END AS source FROM conversations"),
    "stream_ask_counts": (stream_ask_counts, "SELECT user_id % 40 AS topic_id, count(*)::BIGINT AS n_notes, count(*)::BIGINT AS last_index, count(*)::BIGINT AS n_indexes FROM events GROUP BY 1"),
    "stream_weeks": (
        stream_weeks,
        """WITH w AS (SELECT date_trunc('week', ts)::DATE AS m, count(*)::BIGINT AS n_notes FROM events GROUP BY 1)
SELECT strftime(m, '%Y-%m-%d') AS monday, n_notes FROM w WHERE m + INTERVAL 21 DAY <= (SELECT max(ts) FROM events)""",
    ),
    "stream_redaction": (stream_redaction, "SELECT event_id AS id, 'token = [REDACTED:secret]' AS text FROM events"),
}
QUERIES["kept_weeks"] = (kept_weeks, "SELECT strftime(ts, '%G-W%V') AS week, count(*)::BIGINT AS n_notes FROM events GROUP BY 1")
QUERIES["kept_ask_counts"] = (kept_ask_counts, QUERIES["stream_ask_counts"][1])
QUERIES["folder_changes"] = (
    folder_changes,
    """WITH c AS (SELECT coalesce(lang, 'none') AS lang, count(*) AS n FROM documents GROUP BY 1) SELECT 1::BIGINT AS version, lang, 'added' AS action FROM c
UNION ALL SELECT 2, lang, unnest(['added', 'removed']) FROM c WHERE n % 2 = 1""",
)
