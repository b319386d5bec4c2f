"""Queries over texts, tags and files: column functions, redaction, parsing and incremental plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import redaction
from ..functions import tags as tagfn
from ..functions import text as X
from ..sources import tables as S
from ..sources import vault
from ..sources.tables import sql_with


def tag_normalized(spark, d):
    raw = F.concat(F.lit(" "), "p_brand", F.lit("__"), "p_type", F.lit(" - "))
    return S.load(spark, d, "part").select("p_partkey", tagfn.normalized(raw).alias("tag"))


def _brands(spark, d):
    return S.load(spark, d, "part").select(tagfn.normalized(F.col("p_brand")).alias("tag")).distinct()


def near_tags(spark, d):
    return tagfn.near_pairs(_brands(spark, d))


def tag_suggestions(spark, d):
    unknown = S.load(spark, d, "part").select(tagfn.normalized(F.concat(F.substring("p_brand", 1, 7), F.lit("0"))).alias("tag")).distinct()
    return tagfn.suggestions(unknown, _brands(spark, d))


def known_tags(spark, d):
    """Resolved tags of the notes and the targets of aliases, each once."""
    used = S.notes(spark, d).select("tag").distinct()
    return used.union(_brands(spark, d)).distinct()


def redacted_documents(spark, d):
    docs = S.load(spark, d, "documents")
    out = redaction.redacted(F.col("text"))
    return docs.select("doc_id", F.md5(out).alias("text_md5"), F.regexp_count(out, F.lit(r"\[REDACTED:")).cast("long").alias("n_redacted"))


def redaction_findings(spark, d):
    docs = S.load(spark, d, "documents").select(F.explode(redaction.findings(redaction.redacted(F.col("text")))).alias("f"))
    return docs.groupBy("f.kind").agg(F.count(F.lit(1)).alias("n_documents"), F.sum("f.n").cast("long").alias("n_redacted"))


def slugs(spark, d):
    return S.questions(spark, d).select("id", X.slug(F.col("title")).alias("slug"))


def excerpts(spark, d):
    return S.load(spark, d, "conversations").select("conv_id", "turn", X.excerpt(F.col("text")).alias("excerpt"))


def first_lines(spark, d):
    return S.load(spark, d, "documents").select("doc_id", X.first_line(F.col("text")).alias("line"))


def project_names(spark, d):
    pages = S.load(spark, d, "pages")
    return pages.select("page_id", X.project_name(F.when(F.col("page_id") % 2 == 0, F.col("url")), F.col("url")).alias("project"))


def ages(spark, d):
    now = F.unix_seconds(F.lit("2026-01-01 00:00:00").cast("timestamp"))
    unit, count = X.age(F.unix_seconds("created_utc") - now)
    return S.notes(spark, d).select("id", unit.alias("unit"), count.alias("n"))


def reopen_links(spark, d):
    n = S.notes(spark, d)
    agent = F.when(F.col("id") % 2 == 0, "codex").otherwise("claude-code")
    link, command = X.reopen(agent, F.col("session_id").cast("string"), F.concat(F.lit("/work/"), "tag", F.when(F.col("id") % 3 == 0, " x").otherwise("")))
    return n.select("id", link.alias("link"), command.alias("command"))


def agents_detected(spark, d):
    e = S.load(spark, d, "events")
    path = F.concat(F.lit("\\home\\"), F.when(F.col("event_id") % 3 == 0, ".codex").when(F.col("event_id") % 3 == 1, ".claude").otherwise("other"), F.lit("\\s.jsonl"))
    found = X.detect_agent(F.when(F.col("event_type") == "click", F.col("user_id").cast("string")), F.col("event_type") == "view", path)
    return e.select("event_id", F.coalesce(found, F.lit("unknown")).alias("agent"))


def without_sections(spark, d):
    text = F.concat(F.lit("# t\n## a\n"), "text", F.lit("\n## b\nrest"))
    return S.load(spark, d, "conversations").select("conv_id", "turn", F.md5(X.without_section(X.without_title(text), "a")).alias("text_md5"))


def note_round_trip(spark, d):
    """Notes rendered as markdown and parsed again."""
    plain = lambda c: F.trim(F.regexp_replace(F.col(c), r"\s+", " "))
    q = S.questions(spark, d).select("id", plain("title").alias("title"), plain("question").alias("question"), plain("conclusion").alias("conclusion"))
    empty = F.expr("cast(array() AS array<string>)")
    md = q.select("id", vault.rendered(F.col("title"), F.col("question"), F.col("conclusion"), F.array("title"), empty).alias("md"))
    back = vault.note_fields(F.col("md"))
    return md.select("id", *[back[c].alias(c) for c in ("title", "question", "conclusion")], F.array_join(back["key_points"], "|").alias("key_points"), F.size(back["open_questions"]).cast("long").alias("n_open"))


def note_paths(spark, d):
    made = F.when(F.col("id") % 7 == 0, F.lit("unknown")).otherwise(F.date_format(F.timestamp_seconds("created_s"), "yyyy-MM-dd"))
    return S.questions(spark, d).select("id", vault.note_path(made, F.col("id").cast("string"), F.col("title")).alias("path"))


def file_kinds(spark, d):
    folder = F.when(F.col("doc_id") % 5 == 0, "notes/2024/01/").when(F.col("doc_id") % 5 == 1, "topics/").when(F.col("doc_id") % 5 == 2, "annotations/n/").when(F.col("doc_id") % 5 == 3, "tag-aliases/").otherwise("misc/")
    path = F.concat(folder, F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 5 == 3, ".yml").otherwise(".md"))
    kinds = S.load(spark, d, "documents").select(F.coalesce(vault.file_kind(path), F.lit("ignored")).alias("kind"))
    return kinds.groupBy("kind").agg(F.count(F.lit(1)).alias("n_files"))


def _manifests(spark, d):
    f = S.files(spark, d).withColumn("size", F.length("body").cast("long"))
    new = f.where("doc_id % 10 <> 1").select("path", F.lit(1).alias("mtime"), "size", F.col("id").alias("hash"))
    k = F.col("doc_id") % 10
    old = f.where("doc_id % 10 <> 2").select("path", F.when((k == 3) | (k == 4), 0).otherwise(1).alias("mtime"), "size", F.when(k == 4, F.md5(F.col("id"))).otherwise(F.col("id")).alias("hash"))
    return new, old


def sync_plan(spark, d):
    return vault.sync_plan(*_manifests(spark, d))


def manifests_compared(spark, d):
    new, old = _manifests(spark, d)
    return vault.compared(new, old)


def label_matches(spark, d):
    """The first six part names per brand that contain the brand's number, case-insensitive."""
    from pyspark.sql import Window

    p = S.load(spark, d, "part").where(F.lower("p_name").contains("re"))
    w = Window.partitionBy("p_brand").orderBy("p_name", "p_partkey")
    return p.withColumn("k", F.row_number().over(w)).where("k <= 6").select("p_brand", "p_partkey")


_NORM = "regexp_replace(regexp_replace(lower({x}), '[\\s_-]+', '-', 'g'), '^-|-$', '', 'g')"
_BRANDS = f"b AS (SELECT DISTINCT {_NORM.format(x='p_brand')} AS tag FROM part)"
_SIM = "round(1 - levenshtein(a.tag, b.tag) / greatest(length(a.tag), length(b.tag), 1)::DOUBLE, 6)"
_MAN = """f AS (SELECT path, id, length(body) AS size, doc_id % 10 AS k FROM doc),
n AS (SELECT path, id AS hash FROM f WHERE k <> 1), o AS (SELECT path, CASE WHEN k = 4 THEN md5(id) ELSE id END AS hash, k FROM f WHERE k <> 2)"""
# The rules whose patterns RE2 can express as they stand; the other kinds don't occur in the tables.
_RULES = [
    (r"\bsk-[A-Za-z0-9_-]{20,}", "[REDACTED:api-key]"),
    (r"\b(?:gh[pousr]_[A-Za-z0-9]{36,}|github_pat_[A-Za-z0-9_]{22,})", "[REDACTED:github-token]"),
    (r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", "[REDACTED:aws-key]"),
    (r"\bAIza[0-9A-Za-z_-]{35}", "[REDACTED:google-key]"),
    (r"""(?i)(\b(?:api[_-]?key|secret|token|passw(?:or)?d)\b["'']?\s*[:=]\s*["'']?)[^\s"'',;]{8,}""", r"\1[REDACTED:secret]"),
]


def _sql_redacted(text: str) -> str:
    for pattern, to in _RULES:
        text = f"regexp_replace({text}, '{pattern}', '{to}', 'g')"
    return text


QUERIES = {
    "tag_normalized": (tag_normalized, f"SELECT p_partkey, {_NORM.format(x="p_brand || '__' || p_type")} AS tag FROM part"),
    "near_tags": (near_tags, f"WITH {_BRANDS} SELECT a.tag, b.tag AS other, {_SIM} AS score FROM b a JOIN b ON a.tag <> b.tag WHERE replace(a.tag, '-', '') = replace(b.tag, '-', '') OR {_SIM} >= 0.8"),
    "tag_suggestions": (
        tag_suggestions,
        f"""WITH {_BRANDS}, a AS (SELECT DISTINCT {_NORM.format(x="substring(p_brand, 1, 7) || '0'")} AS tag FROM part),
m AS (SELECT a.tag, b.tag AS suggestion, {_SIM} AS score FROM a JOIN b ON a.tag <> b.tag WHERE {_SIM} >= 0.5 OR contains(a.tag, b.tag) OR contains(b.tag, a.tag))
SELECT tag, row_number() OVER (PARTITION BY tag ORDER BY score DESC, suggestion)::BIGINT AS rank, suggestion, score FROM m QUALIFY row_number() OVER (PARTITION BY tag ORDER BY score DESC, suggestion) <= 5""",
    ),
    "known_tags": (known_tags, f"WITH {_BRANDS} SELECT DISTINCT event_type AS tag FROM events UNION SELECT tag FROM b"),
    "redacted_documents": (redacted_documents, f"WITH r AS (SELECT doc_id, {_sql_redacted('text')} AS t FROM documents) SELECT doc_id, md5(t) AS text_md5, len(regexp_extract_all(t, '\\[REDACTED:'))::BIGINT AS n_redacted FROM r"),
    "redaction_findings": (
        redaction_findings,
        f"""WITH r AS (SELECT {_sql_redacted('text')} AS t FROM documents), m AS (SELECT unnest(regexp_extract_all(t, '\\[REDACTED:([a-z-]+)\\]', 1)) AS kind, rn FROM (SELECT t, row_number() OVER () AS rn FROM r))
SELECT kind, count(DISTINCT rn)::BIGINT AS n_documents, count(*)::BIGINT AS n_redacted FROM m GROUP BY 1""",
    ),
    "slugs": (slugs, sql_with("SELECT id, regexp_extract(trim(regexp_replace(lower(title), '[^\\p{L}\\p{N}]+', '-', 'g'), '-'), '^.{0,47}(-.|[^-])?') AS slug FROM qa", "qa")),
    "excerpts": (
        excerpts,
        r"""SELECT conv_id, turn, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '!?\[([^\]]*)\]\([^)]*\)', '\1', 'g'), '(?m)^\s{0,3}(#{1,6}|>|[-*+]|\d+\.)\s+', '', 'g'), '[`*_~]', '', 'g'), '\s+', ' ', 'g')) AS excerpt FROM conversations""",
    ),
    "first_lines": (first_lines, "SELECT doc_id, split_part(text, chr(10), 1) AS line FROM documents"),
    "project_names": (
        project_names,
        r"""SELECT page_id, CASE WHEN page_id % 2 = 0 THEN regexp_replace(regexp_replace(url, '^https?://', ''), '\.git$', '')
  ELSE (SELECT array_to_string(list_slice(p, greatest(1, len(p) - 1), len(p)), '/') FROM (SELECT list_filter(regexp_split_to_array(url, '[\\/]'), lambda x: x <> '') AS p)) END AS project FROM pages""",
    ),
    "ages": (
        ages,
        sql_with(""", s AS (SELECT id, epoch(created_utc)::BIGINT - epoch(TIMESTAMP '2026-01-01')::BIGINT AS s FROM note0)
SELECT id, CASE WHEN abs(s) >= 31536000 THEN 'year' WHEN abs(s) >= 2592000 THEN 'month' WHEN abs(s) >= 604800 THEN 'week' WHEN abs(s) >= 86400 THEN 'day' WHEN abs(s) >= 3600 THEN 'hour' WHEN abs(s) >= 60 THEN 'minute' ELSE 'now' END AS unit,
 (CASE WHEN abs(s) >= 31536000 THEN floor(s / 31536000.0 + 0.5) WHEN abs(s) >= 2592000 THEN floor(s / 2592000.0 + 0.5) WHEN abs(s) >= 604800 THEN floor(s / 604800.0 + 0.5) WHEN abs(s) >= 86400 THEN floor(s / 86400.0 + 0.5) WHEN abs(s) >= 3600 THEN floor(s / 3600.0 + 0.5) WHEN abs(s) >= 60 THEN floor(s / 60.0 + 0.5) ELSE 0 END)::BIGINT AS n FROM s""", "note0"),
    ),
    "reopen_links": (
        reopen_links,
        sql_with(""", c AS (SELECT *, '/work/' || tag || CASE WHEN id % 3 = 0 THEN ' x' ELSE '' END AS cwd FROM note0)
SELECT id, CASE WHEN id % 2 = 0 THEN 'codex://threads/' || session_id ELSE 'claude://resume?session=' || session_id END AS link,
 CASE WHEN id % 2 = 0 THEN 'codex resume ' || session_id ELSE 'cd ' || CASE WHEN id % 3 = 0 THEN '''' || cwd || '''' ELSE cwd END || ' && claude --resume ' || session_id END AS command FROM c""", "note0"),
    ),
    "agents_detected": (
        agents_detected,
        "SELECT event_id, CASE WHEN event_type = 'click' THEN 'codex' WHEN event_type = 'view' THEN 'claude-code' WHEN event_id % 3 = 0 THEN 'codex' WHEN event_id % 3 = 1 THEN 'claude-code' ELSE 'unknown' END AS agent FROM events",
    ),
    "without_sections": (without_sections, "SELECT conv_id, turn, md5('## b' || chr(10) || 'rest') AS text_md5 FROM conversations"),
    "note_round_trip": (
        note_round_trip,
        sql_with(", p AS (SELECT id, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS title, trim(regexp_replace(question, '\\s+', ' ', 'g')) AS question, trim(regexp_replace(conclusion, '\\s+', ' ', 'g')) AS conclusion FROM qa) SELECT id, title, question, conclusion, title AS key_points, 0::BIGINT AS n_open FROM p", "qa"),
    ),
    "note_paths": (
        note_paths,
        sql_with(""", s AS (SELECT id, regexp_extract(trim(regexp_replace(lower(title), '[^\\p{L}\\p{N}]+', '-', 'g'), '-'), '^.{0,47}(-.|[^-])?') AS slug, to_timestamp(created_s) AT TIME ZONE 'UTC' AS t FROM qa)
SELECT id, 'notes/' || CASE WHEN id % 7 = 0 THEN '0000/00' ELSE strftime(t, '%Y/%m') END || '/' || id || CASE WHEN slug = '' THEN '' ELSE '-' || slug END || '.md' AS path FROM s""", "qa"),
    ),
    "file_kinds": (
        file_kinds,
        "SELECT CASE doc_id % 5 WHEN 0 THEN 'note' WHEN 1 THEN 'topic' WHEN 2 THEN 'annotation' WHEN 3 THEN 'alias' ELSE 'ignored' END AS kind, count(*)::BIGINT AS n_files FROM documents GROUP BY 1",
    ),
    "sync_plan": (
        sync_plan,
        sql_with(f", {_MAN} SELECT path, CASE k WHEN 1 THEN 'removed' WHEN 2 THEN 'added' WHEN 3 THEN 'touched' WHEN 4 THEN 'updated' ELSE 'unchanged' END AS action FROM f", "doc"),
    ),
    "manifests_compared": (
        manifests_compared,
        sql_with(f", {_MAN} SELECT path, CASE WHEN n.path IS NULL THEN 'missing left' WHEN o.path IS NULL THEN 'missing right' WHEN n.hash = o.hash THEN 'matched' ELSE 'mismatched' END AS state FROM n FULL JOIN o USING (path)", "doc"),
    ),
    "label_matches": (label_matches, "SELECT p_brand, p_partkey FROM part WHERE contains(lower(p_name), 're') QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) <= 6"),
}
