"""Views over notes with tags: resolved rows, tags in use, search with a tag, recall results, file locations, JSON export.

notes: id, path, tags (array), topic_id. Chains are those of resolve.follow: start, resolved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import shared_folder, sized, stored
from . import search
from .activity import ordinals
from .resolve import canonical, conflict_ids, resolved


def tags_resolved(notes: DataFrame, aliases: DataFrame) -> DataFrame:
    """notes (one row an id) with their tags through the aliases, in order and once each; without tags an empty array."""
    each = notes.select("id", F.posexplode("tags").alias("pos", "tag"))
    ends = resolved(each, "tag", sized(aliases))
    # A note has a handful of tags, so these groups are small.
    back = ends.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "tag"))).alias("placed"))
    tags = F.array_distinct(F.coalesce(F.col("placed.tag"), F.expr("cast(array() AS array<string>)")))
    return notes.drop("tags").join(back.hint("shuffle_merge"), "id", "left").withColumn("tags", tags).drop("placed")


def note_rows(notes: DataFrame, merges: DataFrame, aliases: DataFrame) -> DataFrame:
    """The canonical copy of each id, tags through aliases and topic through merges. Rows without an id are left out."""
    one = canonical(notes.where("id IS NOT NULL"))
    return resolved(tags_resolved(one, aliases), "topic_id", sized(merges))


def tags_in_use(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """tag: every tag on a resolved row and every alias's end."""
    return rows.select(F.explode("tags").alias("tag")).union(aliases.select("resolved")).distinct()


def tag_usage(rows: DataFrame) -> DataFrame:
    """tag, n_notes: the notes of each resolved tag."""
    return rows.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n_notes"))


def topic_labels(notes: DataFrame, order: str) -> DataFrame:
    """topic_id, label: the title of each topic's first note."""
    return notes.groupBy("topic_id").agg(F.min_by("title", F.struct(order, "id")).alias("label"))


def tagged_search(queries: DataFrame, notes: DataFrame, aliases: DataFrame, limit: int = 20) -> DataFrame:
    """query_id, rank, id, score: the best notes of each query among those with its tag.

    queries: query_id, query, tag (through the aliases; null: any). notes also have tags, resolved. The tag is applied to the
    whole ranking, so a query gets its limit of notes if so many have the tag.
    """
    ranked = search.bm25_ranking(queries.select("query_id", "query"), notes)
    asked = resolved(queries.select("query_id", "tag"), "tag", sized(aliases))
    met = ranked.join(asked.hint("shuffle_merge"), "query_id").join(notes.select("id", "tags").hint("shuffle_merge"), "id")
    kept = met.where(F.col("tag").isNull() | F.array_contains("tags", F.col("tag")))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("rank")).cast("long")
    return kept.withColumn("rank", place).where(F.col("rank") <= limit).select("query_id", "rank", "id", "score")


def recall_result(keyword: DataFrame, notes: DataFrame, labels: DataFrame, near: DataFrame | None = None, limit: int = search.TOPICS) -> DataFrame:
    """query_id, rank, topic_id, label, ask_count, semantic: the topics of a recall. tag_usage gives the tags beside it.

    keyword and near: rankings (query_id, id, rank); with near both are fused and semantic is true.
    """
    ranking = keyword if near is None else search.fused(keyword, near)
    best = search.best_topics(ranking, notes, limit)
    counts = notes.groupBy("topic_id").agg(F.count(F.lit(1)).alias("ask_count"))
    out = best.join(stored(counts).hint("shuffle_merge"), "topic_id").join(labels.hint("shuffle_merge"), "topic_id", "left")
    return out.select("query_id", "rank", "topic_id", F.coalesce("label", F.lit("")).alias("label"), "ask_count", F.lit(near is not None).alias("semantic"))


def file_locations(rows: DataFrame, *columns: str) -> DataFrame:
    """id, path and the given columns of the file that defines each id (of copies the canonical one)."""
    return canonical(rows.where("id IS NOT NULL")).select("id", "path", *columns)


def ask_counts_after(saved: DataFrame, notes: DataFrame) -> DataFrame:
    """request_id, topic_id, ask_count of each accepted request: the topic's notes once it is saved, itself among them.

    Requests are saved in order of request_id. notes: topic_id of the notes that were there before.
    """
    there = notes.groupBy("topic_id").agg(F.count(F.lit(1)).alias("n_before"))
    accepted = saved.where("reject_reason IS NULL").select("request_id", "topic_id")
    placed = ordinals(accepted, "topic_id", [F.col("request_id").asc()], "place")
    joined = placed.join(stored(there).hint("shuffle_merge"), "topic_id", "left")
    return joined.select("request_id", "topic_id", (F.coalesce("n_before", F.lit(0)) + F.col("place")).alias("ask_count"))


def exported(rows: DataFrame, folder: str | None = None) -> DataFrame:
    """The rows as JSON lines, written below folder and read back as texts (value); null fields are written as such."""
    folder = folder or shared_folder(rows.sparkSession)
    rows.write.option("ignoreNullFields", False).json(folder)
    return rows.sparkSession.read.text(folder)


def note_details(rows: DataFrame, labels: DataFrame, annotations: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """id, path, markdown, tags, topic_id, label, ask_count, n_annotations of each note, or of the asked ones (id).

    rows: note_rows (one row an id) with body. labels: topic_id, label; a topic without one has an empty label. annotations: note_id.
    ask_count counts all notes of the topic, asked or not; a note without a topic has 0. Asked ids that no note has give no row, ids
    asked for twice one. note_annotations has the annotations themselves.
    """
    counts = stored(rows.where("topic_id IS NOT NULL").groupBy("topic_id").agg(F.count(F.lit(1)).alias("ask_count")))
    notes = rows if asked is None else rows.join(sized(asked.select("id").distinct()), "id", "left_semi")
    remarks = stored(annotations.groupBy(F.col("note_id").alias("id")).agg(F.count(F.lit(1)).alias("n_annotations")))
    met = notes.join(remarks.hint("shuffle_merge"), "id", "left").join(sized(counts), "topic_id", "left").join(sized(labels.select("topic_id", "label")), "topic_id", "left")
    number = lambda name: F.coalesce(name, F.lit(0)).alias(name)
    markdown = F.coalesce("body", F.lit("")).alias("markdown")
    return met.select("id", "path", markdown, "tags", "topic_id", F.coalesce("label", F.lit("")).alias("label"), number("ask_count"), number("n_annotations"))


def note_annotations(rows: DataFrame, annotations: DataFrame) -> DataFrame:
    """note_id, place (from 1, by created, then id), id, body of the annotations of the given notes, as rows."""
    own = annotations.join(rows.select(F.col("id").alias("note_id")).distinct().hint("shuffle_merge"), "note_id", "left_semi")
    placed = ordinals(own, "note_id", [F.col("created").asc(), F.col("id").asc()], "place")
    return placed.select("note_id", F.col("place").cast("long").alias("place"), "id", "body")


def project_counts(notes: DataFrame) -> DataFrame:
    """project, n_notes, n_agents: notes by their repository or else their folder (git_repo, cwd, agent), without both by "".

    A repository counts if it is told, even as an empty text.
    """
    project = F.coalesce("git_repo", "cwd", F.lit(""))
    return notes.groupBy(project.alias("project")).agg(F.count(F.lit(1)).alias("n_notes"), F.count_distinct("agent").alias("n_agents"))


def labelled_pairs(pairs: DataFrame, labels: DataFrame, *sides: str) -> DataFrame:
    """pairs with label_<side> of the topic in each side's column; empty without one. labels: topic_id, label."""
    labels = sized(labels.select("topic_id", "label"))
    for side in sides:
        named = labels.withColumnsRenamed({"topic_id": side, "label": f"label_{side}"})
        pairs = pairs.join(named, side, "left").withColumn(f"label_{side}", F.coalesce(f"label_{side}", F.lit("")))
    return pairs


def topic_pages(notes: DataFrame, topics: DataFrame, chains: DataFrame) -> DataFrame:
    """topic_id, label, created, ask_count, sessions, n_merged of each topic with notes; label and created are empty if no file tells.

    notes: topic_id (resolved), session_id. topics: id, label, created. merged_topics and topic_positions have the lists of a page as rows.
    """
    counts = notes.groupBy("topic_id").agg(F.count(F.lit(1)).alias("ask_count"), F.count_distinct("session_id").alias("sessions"))
    merged = chains.where("start <> resolved").groupBy(F.col("resolved").alias("topic_id")).agg(F.count(F.lit(1)).alias("n_merged"))
    met = counts.join(merged.hint("shuffle_merge"), "topic_id", "left").join(topics.withColumnRenamed("id", "topic_id").hint("shuffle_merge"), "topic_id", "left")
    text = lambda name: F.coalesce(name, F.lit("")).alias(name)
    return met.select("topic_id", text("label"), text("created"), "ask_count", "sessions", F.coalesce("n_merged", F.lit(0)).alias("n_merged"))


def merged_topics(topics: DataFrame, chains: DataFrame) -> DataFrame:
    """topic_id, merged_id, label: every topic whose chain ends at another, with its own label."""
    ends = chains.where("start <> resolved").select(F.col("resolved").alias("topic_id"), F.col("start").alias("id"))
    met = ends.join(topics.select("id", "label").hint("shuffle_merge"), "id", "left")
    return met.select("topic_id", F.col("id").alias("merged_id"), F.coalesce("label", F.lit("")).alias("label"))


def topic_positions(notes: DataFrame) -> DataFrame:
    """notes with position: how many times their topic had been asked, by the text of created, then id."""
    return ordinals(notes, "topic_id", [F.col("created").asc(), F.col("id").asc()], "position")


def health_report(tables: dict[str, DataFrame], invalid: DataFrame) -> DataFrame:
    """One row: the distinct ids of each kind of file (named by it), conflicts over all kinds, invalid files, and ok, which is true without either.

    tables: by kind, id and path of the valid files. invalid: a row per file.
    """
    out = conflict_ids(tables).agg(F.count(F.lit(1)).alias("conflicts")).crossJoin(invalid.agg(F.count(F.lit(1)).alias("invalid_files")))
    for kind, rows in tables.items():
        out = out.crossJoin(rows.select("id").distinct().agg(F.count(F.lit(1)).alias(f"{kind}s")))  # one row each
    return out.withColumn("ok", (F.col("conflicts") == 0) & (F.col("invalid_files") == 0))
