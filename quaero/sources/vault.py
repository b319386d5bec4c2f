"""Note folders as tables: listing, classification, incremental plans, parsing, validation, quarantine and rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import is_uuid, slug, to_utc

#: Section headings of a note: question, conclusion, key points, open questions (fixed values of the file format).
HEADINGS = {"question": "问题", "conclusion": "结论", "key_points": "要点", "open_questions": "仍不清楚"}
AGENTS = ("codex", "claude-code")
MANIFEST = T.StructType([T.StructField("path", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("mtime", T.TimestampType()), T.StructField("size", T.LongType()), T.StructField("hash", T.StringType()), T.StructField("error", T.StringType())])
#: One save request per document; anything else in it is refused.
REQUEST = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("title", "question", "conclusion", "topic")]
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("key_points", "open_questions", "tags", "new_tags")]
    + [T.StructField("confirm_new", T.BooleanType()), T.StructField("source", T.StructType([T.StructField(n, T.StringType()) for n in ("agent", "session_id", "cwd", "git_repo")]))]
)


def relative(path: Column, root: str) -> Column:
    plain = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    return F.regexp_replace(path, rf"^[a-z]*:?/*\Q{plain}\E/", "")


def listed(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """path (relative), mtime, size and, if asked for, content of the files below root; parts that start with a dot are skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    out = files.select(relative(F.col("path"), root).alias("path"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), *(["content"] if content else []))
    return out.where(~F.exists(F.split("path", "/"), lambda p: p.startswith(".")))


def file_kind(path: Column) -> Column:
    """note, topic, alias or annotation by place and ending; null for other files."""
    parts = F.split(path, "/")
    head, depth, note = F.get(parts, F.lit(0)), F.size(parts), path.endswith(".md")
    return (
        F.when((head == "notes") & (depth >= 2) & note, "note")
        .when((head == "topics") & (depth == 2) & note, "topic")
        .when((head == "tag-aliases") & (depth == 2) & path.rlike(r"\.ya?ml$"), "alias")
        .when((head == "annotations") & (depth == 3) & note, "annotation")
    )


def sync_plan(snapshot: DataFrame, manifest: DataFrame) -> DataFrame:
    """path, action: added, updated, touched (same hash, new time or size), unchanged or removed.

    snapshot: path, mtime, size, hash (null where not read: then equal time and size are taken as unchanged).
    """
    s = snapshot.select("path", F.col("mtime").alias("s_mtime"), F.col("size").alias("s_size"), F.col("hash").alias("s_hash"), F.lit(True).alias("there"))
    m = manifest.select("path", F.col("mtime").alias("m_mtime"), F.col("size").alias("m_size"), F.col("hash").alias("m_hash"), F.lit(True).alias("known"))
    both = s.join(m, "path", "full_outer")
    same = (F.col("s_mtime") == F.col("m_mtime")) & (F.col("s_size") == F.col("m_size"))
    action = F.when(F.col("there").isNull(), "removed").when(F.col("known").isNull(), "added").when(same, "unchanged").when(F.col("s_hash") == F.col("m_hash"), "touched").otherwise("updated")
    return both.select("path", action.alias("action"))


def compared(left: DataFrame, right: DataFrame) -> DataFrame:
    """path, state of two manifests (path, hash): matched, mismatched, missing left or right."""
    both = left.select("path", F.col("hash").alias("a"), F.lit(1).alias("x")).join(right.select("path", F.col("hash").alias("b"), F.lit(1).alias("y")), "path", "full_outer")
    state = F.when(F.col("x").isNull(), "missing left").when(F.col("y").isNull(), "missing right").when(F.col("a").eqNullSafe(F.col("b")), "matched").otherwise("mismatched")
    return both.select("path", state.alias("state"))


def split_frontmatter(text: Column) -> tuple[Column, Column]:
    """YAML and body; null if the text doesn't start with a --- line or has no line --- to end it."""
    pattern = r"(?s)\A---\r?\n(.*?)(?:(?<=\n)|\A)---[ \t\r]*(?:\n(.*))?\z"
    found = text.rlike(r"(?s)\A---\r?\n(?:.*\n)?---[ \t\r]*(?:\n.*)?\z")
    return F.when(found, F.regexp_extract(text, pattern, 1)), F.when(found, F.regexp_extract(text, pattern, 2))


def yaml_field(yaml: Column, name: str) -> Column:
    """A scalar of the frontmatter, quotes removed; null if absent."""
    line = rf"(?m)^\s*{name}:[ \t]*(?:\"((?:[^\"\\]++|\\.)*+)\"|'((?:[^']++|'')*+)'|([^\r\n#]*?))[ \t]*$"
    double = F.replace(F.replace(F.regexp_extract(yaml, line, 1), F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    single = F.replace(F.regexp_extract(yaml, line, 2), F.lit("''"), F.lit("'"))
    return F.when(yaml.rlike(line), F.coalesce(F.nullif(double, F.lit("")), F.nullif(single, F.lit("")), F.regexp_extract(yaml, line, 3)))


def yaml_list(yaml: Column, name: str) -> Column:
    """A list of the frontmatter, in flow ([a, b]) or block form (- a)."""
    flow = F.split(F.regexp_extract(yaml, rf"(?m)^{name}:[ \t]*\[(.*)\][ \t]*$", 1), ",")
    block = F.regexp_extract_all(F.regexp_extract(yaml, rf"(?m)^{name}:[ \t]*\r?\n((?:[ \t]*+- .*+(?:\r?\n|\z))*+)", 1), F.lit(r"(?m)^[ \t]*- (.*)$"), F.lit(1))
    clean = lambda items: F.filter(F.transform(items, lambda x: F.trim(F.regexp_replace(F.trim(x), "^[\"']|[\"']$", ""))), lambda x: x != "")
    return F.when(yaml.rlike(rf"(?m)^{name}:[ \t]*\["), clean(flow)).otherwise(clean(block))


def note_fields(body: Column) -> dict[str, Column]:
    """title, question, conclusion, key_points and open_questions of a note's markdown.

    The first line "# " with a text gives the title and such lines are dropped; "## " opens a section; of sections with
    one heading the last counts; others are ignored. Bullets are lines "- ", blank ones dropped.
    """
    lines = F.split(F.regexp_replace(body, "\r\n", "\n"), "\n")
    titles = F.filter(F.transform(F.filter(lines, lambda x: x.startswith("# ")), lambda x: F.trim(F.substr(x, F.lit(3)))), lambda t: t != "")
    kept = F.array_join(F.filter(lines, lambda x: ~x.startswith("# ")), "\n")
    sections = F.split(kept, "(?m)^## ")
    strip = lambda c: F.regexp_replace(c, r"(?U)\A\s+|\s+\z", "")
    heading = lambda s: F.trim(F.get(F.split(s, "\n"), F.lit(0)))
    rest = lambda s: strip(F.array_join(F.slice(F.split(s, "\n"), F.lit(2), F.size(F.split(s, "\n"))), "\n"))
    later = F.slice(sections, F.lit(2), F.size(sections))

    def section(name: str) -> Column:
        own = F.transform(F.filter(later, lambda s: heading(s) == HEADINGS[name]), rest)
        return F.coalesce(F.get(own, F.size(own) - 1), F.lit(""))

    def bullets(text: Column) -> Column:
        found = F.filter(F.transform(F.split(text, "\n"), lambda x: F.ltrim(x)), lambda x: x.startswith("- "))
        return F.filter(F.transform(found, lambda x: F.trim(F.substr(x, F.lit(3)))), lambda x: x != "")

    return {
        "title": F.coalesce(F.get(titles, F.lit(0)), F.lit("")),
        "question": section("question"),
        "conclusion": section("conclusion"),
        "key_points": bullets(section("key_points")),
        "open_questions": bullets(section("open_questions")),
    }


def rendered(title: Column, question: Column, conclusion: Column, key_points: Column, open_questions: Column) -> Column:
    """A note's markdown; list sections without items are left out."""
    section = lambda name, text: F.concat(F.lit(f"\n## {HEADINGS[name]}\n\n"), text, F.lit("\n"))
    items = lambda c: F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), F.trim(x))), "\n")
    listed_ = lambda name, c: F.when(F.size(c) > 0, section(name, items(c))).otherwise("")
    return F.concat(F.lit("# "), F.trim(title), F.lit("\n"), section("question", F.trim(question)), section("conclusion", F.trim(conclusion)), listed_("key_points", key_points), listed_("open_questions", open_questions))


def note_path(created: Column, note_id: Column, title: Column) -> Column:
    """notes/<year>/<month>/<id>-<slug>.md, 0000 and 00 if created doesn't tell."""
    year = F.when(created.rlike(r"^\d{4}"), F.substring(created, 1, 4)).otherwise("0000")
    month = F.when(created.rlike(r"^\d{4}-\d{2}"), F.substring(created, 6, 2)).otherwise("00")
    return F.concat(F.lit("notes/"), year, F.lit("/"), month, F.lit("/"), note_id, F.when(slug(title) == "", "").otherwise(F.concat(F.lit("-"), slug(title))), F.lit(".md"))


def parsed(files: DataFrame) -> DataFrame:
    """Every classified file with its fields and error (null: valid). files: path, content (binary), and mtime, size."""
    text = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
    rows = files.withColumns({"kind": file_kind(F.col("path")), "text": text, "hash": F.sha2("content", 256)}).where("kind IS NOT NULL")
    yaml, body = split_frontmatter(F.col("text"))
    rows = rows.withColumns({"yaml": F.when(F.col("kind") == "alias", F.col("text")).otherwise(yaml), "body": body})
    scalars = ("id", "topic", "label", "merged_into", "created", "updated", "note", "from", "to", "agent", "session_id", "cwd", "git_repo", "schema")
    rows = rows.withColumns({f"f_{n}": F.nullif(yaml_field(F.col("yaml"), n), F.lit("null")) for n in scalars} | {"tags": F.array_distinct(yaml_list(F.col("yaml"), "tags"))} | {f"n_{k}": v for k, v in note_fields(F.col("body")).items()})
    is_note = F.col("kind") == "note"
    checks = [
        (F.col("text").isNull(), "not UTF-8"),
        (F.col("yaml").isNull(), "missing frontmatter"),
        (~F.coalesce(F.col("f_schema") == "1", F.lit(False)), "unsupported schema"),
        ((F.col("kind") != "alias") & F.col("f_id").isNull(), "missing id"),
        (is_note & ~F.coalesce(F.col("f_agent").isin(*AGENTS), F.lit(False)), "unknown agent"),
        (is_note & ~is_uuid(F.col("f_session_id")), "session_id is not a UUID"),
        (is_note & F.coalesce(F.trim("f_cwd") == "", F.lit(True)), "cwd is empty"),
        (is_note & to_utc(F.col("f_created")).isNull(), "created is not a time"),
        ((F.col("kind") == "alias") & (F.col("f_from").isNull() | F.col("f_to").isNull()), "missing from or to"),
    ]
    return rows.withColumn("error", F.coalesce(*[F.when(bad, F.lit(why)) for bad, why in checks]))


def notes_table(rows: DataFrame) -> DataFrame:
    good = rows.where("error IS NULL AND kind = 'note'")
    names = {"f_id": "id", "f_topic": "topic_id", "n_title": "title", "n_question": "question", "n_conclusion": "conclusion", "n_key_points": "key_points", "n_open_questions": "open_questions", "f_agent": "agent", "f_session_id": "session_id", "f_cwd": "cwd", "f_git_repo": "git_repo", "f_created": "created"}
    return good.select("path", *[F.col(a).alias(b) for a, b in names.items()], "tags", F.trim("body").alias("body"), to_utc(F.col("f_created")).alias("created_utc"))


def topics_table(rows: DataFrame) -> DataFrame:
    return rows.where("error IS NULL AND kind = 'topic'").select("path", F.col("f_id").alias("id"), F.coalesce("f_label", F.lit("")).alias("label"), F.col("f_merged_into").alias("merged_into"), F.col("f_created").alias("created"))


def annotations_table(rows: DataFrame) -> DataFrame:
    return rows.where("error IS NULL AND kind = 'annotation'").select("path", F.col("f_id").alias("id"), F.col("f_note").alias("note_id"), F.regexp_replace("body", r"(?U)\A\s+|\s+\z", "").alias("body"), F.col("f_created").alias("created"), F.col("f_updated").alias("updated"))


def aliases_table(rows: DataFrame) -> DataFrame:
    return rows.where("error IS NULL AND kind = 'alias'").select("path", F.col("f_from").alias("from_tag"), F.col("f_to").alias("to_tag"), F.col("f_created").alias("created"))


def invalid_files(rows: DataFrame) -> DataFrame:
    """path and reason of the files that no table holds, by path."""
    return rows.where("error IS NOT NULL").select("path", "error").orderBy("path")


def manifest_of(rows: DataFrame) -> DataFrame:
    return rows.select("path", "kind", "mtime", "size", "hash", "error")


def requests_from_json(lines: DataFrame, column: str = "value") -> DataFrame:
    """Save requests of JSON texts, with error for broken ones and for unknown fields."""
    parsed_ = lines.withColumn("request", F.from_json(F.col(column), REQUEST, {"mode": "PERMISSIVE"}))
    keys = F.json_object_keys(column)
    unknown = F.array_except(keys, F.array(*[F.lit(f.name) for f in REQUEST.fields]))
    error = F.when(keys.isNull(), "not a JSON object").when(F.size(unknown) > 0, F.concat(F.lit("unknown field: "), F.get(unknown, F.lit(0))))
    return parsed_.withColumn("error", error).select("*", "request.*").drop("request")
