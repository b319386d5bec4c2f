"""Counts and calendars over notes: topics, tags, days, weeks, projects, agents, repeats and shares.

notes: id, topic_id (resolved), session_id, tag, created (text), created_utc, project.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import sized, stored


def topic_counts(notes: DataFrame, annotated: DataFrame | None = None) -> DataFrame:
    """ask_count, first_asked, last_asked and annotated of each topic. annotated: note ids with an annotation."""
    rows = notes.withColumn("has_annotation", F.lit(False))
    if annotated is not None:
        marks = annotated.select(F.col("id"), F.lit(True).alias("has_annotation")).distinct()
        rows = notes.join(marks, "id", "left")
    at = F.struct("created_utc", "id")
    return rows.groupBy("topic_id").agg(
        F.count(F.lit(1)).alias("ask_count"),
        F.min_by("created", at).alias("first_asked"),
        F.max_by("created", at).alias("last_asked"),
        F.coalesce(F.bool_or("has_annotation"), F.lit(False)).alias("annotated"),
    )


def top_topics(counts: DataFrame, limit: int = 20) -> DataFrame:
    return counts.orderBy(F.desc("ask_count"), F.desc("last_asked"), "topic_id").limit(limit)


def repeats(counts: DataFrame) -> DataFrame:
    """topics, repeated (asked twice or more), annotated_repeated and their rounded shares, null without a base."""
    again = F.col("ask_count") >= 2
    row = counts.agg(F.count(F.lit(1)).alias("topics"), F.count_if(again).alias("repeated"), F.count_if(again & F.col("annotated")).alias("annotated_repeated"))
    share = lambda a, b: F.round(F.try_divide(F.lit(100) * F.col(a), F.col(b))).cast("long")
    return row.select("*", share("repeated", "topics").alias("repeated_share"), share("annotated_repeated", "repeated").alias("annotated_share"))


def undigested(counts: DataFrame) -> DataFrame:
    """Topics asked twice or more without an annotation."""
    return counts.where("ask_count >= 2 AND NOT annotated")


def count_by(rows: DataFrame, key: Column, name: str) -> DataFrame:
    return rows.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("n_notes"))


def iso_week(date: Column) -> Column:
    """YYYY-Www with the ISO year."""
    d = F.to_date(F.substring(date, 1, 10))
    return F.concat(F.extract(F.lit("YEAROFWEEK"), d).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(d).cast("string"), 2, "0"))


def by_day(notes: DataFrame) -> DataFrame:
    return count_by(notes, F.substring("created", 1, 10), "day")


def by_week(notes: DataFrame) -> DataFrame:
    return count_by(notes, iso_week(F.col("created")), "week")


def topic_detail(notes: DataFrame, merged: DataFrame) -> DataFrame:
    """ask_count, distinct sessions, and the ids merged into each topic."""
    base = notes.groupBy("topic_id").agg(F.count(F.lit(1)).alias("ask_count"), F.count_distinct("session_id").alias("sessions"))
    return base.join(merged, "topic_id", "left").select("topic_id", "ask_count", "sessions", F.coalesce(F.array_join("merged_ids", ","), F.lit("")).alias("merged_ids"))


def heat_map(days: DataFrame, as_of: Column | None = None, weeks: int = 26) -> DataFrame:
    """day, n_notes, level 0 to 4 and future, for the weeks (from Monday) up to the one that holds as_of (or the last day).

    days: day (text), n_notes. level is ceil(4 n / most), at most 4.
    """
    end = days.agg((F.max("day") if as_of is None else F.first(as_of)).cast("date").alias("last_day"))
    monday = F.date_trunc("week", F.col("last_day")).cast("date")
    spine = end.select("last_day", F.explode(F.sequence(F.date_sub(monday, 7 * (weeks - 1)), F.date_add(monday, 6))).alias("date"))
    filled = spine.withColumn("day", F.col("date").cast("string")).join(days, "day", "left").select("day", F.coalesce("n_notes", F.lit(0)).alias("n_notes"), (F.col("date") > F.col("last_day")).alias("future"))
    most = filled.agg(F.max("n_notes").alias("most"))
    level = F.when(F.col("n_notes") == 0, 0).otherwise(F.least(F.lit(4), F.ceil(4 * F.col("n_notes") / F.col("most")))).cast("int")
    return filled.crossJoin(F.broadcast(most)).select("day", "n_notes", "future", level.alias("level"))  # most: one row


def weekly(days: DataFrame, weeks: int = 16) -> DataFrame:
    """week, n_notes, change to the week before, and peak (the first of the most), zero-filled to the last day's week."""
    end = days.agg(F.max("day").cast("date").alias("last_day"))
    monday = F.date_trunc("week", F.col("last_day")).cast("date")
    spine = end.select(F.explode(F.sequence(F.date_sub(monday, 7 * (weeks - 1)), monday, F.expr("interval 7 days"))).alias("monday"))
    counted = days.groupBy(F.date_trunc("week", F.col("day").cast("date")).cast("date").alias("monday")).agg(F.sum("n_notes").alias("n_notes"))
    filled = spine.join(counted, "monday", "left").select("monday", F.coalesce("n_notes", F.lit(0)).alias("n_notes"))
    # At most `weeks` rows from here on, so windows over all of them are small.
    order, all_ = Window.orderBy("monday"), Window.partitionBy()
    first = F.max(F.struct("n_notes", (-F.unix_date("monday")).alias("minus"))).over(all_)
    return filled.select(
        iso_week(F.col("monday").cast("string")).alias("week"),
        "n_notes",
        (F.col("n_notes") - F.coalesce(F.lag("n_notes").over(order), F.lit(0))).alias("change"),
        (F.unix_date("monday") == -first["minus"]).alias("peak"),
    )


def active_days(days: DataFrame, span: int = 30) -> DataFrame:
    """How many of the span days up to the last day have notes."""
    end = days.agg(F.max("day").cast("date").alias("last_day"))
    return days.crossJoin(F.broadcast(end)).where(F.col("day").cast("date") > F.date_sub("last_day", span)).agg(F.count(F.lit(1)).alias("active_days"))


def bar_shares(counts: DataFrame, key: str, limit: int = 10) -> DataFrame:
    """The most frequent keys with their share of the greatest count."""
    top = counts.orderBy(F.desc("n_notes"), key).limit(limit)
    return top.select(key, "n_notes", F.round(F.col("n_notes") / F.greatest(F.lit(1), F.max("n_notes").over(Window.partitionBy())), 6).alias("share"))


def ordinals(rows: DataFrame, key: str, order: list[Column], name: str, total: str | None = None) -> DataFrame:
    """rows with their ordinal (name, from 1) within their key by order and, if asked for, the number of the key's rows.

    Rows are sorted into ranges of (key, order), so a key of any size is spread over many tasks. An ordinal is the place
    within the range plus the key's rows in the ranges before. Only a key that goes over the end of a range needs that sum;
    there are at most two such rows a range, which bounds the broadcast. Rows without a key form one.
    """
    n_ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(rows.repartitionByRange(n_ranges, F.col(key), *order).withColumn("range_no", F.spark_partition_id()))
    own, before = Window.partitionBy(key), Window.partitionBy(key).orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(key, "range_no").agg(F.count(F.lit(1)).alias("n"))
    carried = sizes.select(F.col(key).alias("carried_key"), F.col("range_no").alias("carried_range"), F.sum("n").over(before).alias("n_before"), F.sum("n").over(own).alias("n_key"), F.count(F.lit(1)).over(own).alias("n_ranges"))
    carried = F.broadcast(stored(carried.where("n_ranges > 1").drop("n_ranges")))
    met = placed.join(carried, F.col(key).eqNullSafe(F.col("carried_key")) & (F.col("range_no") == F.col("carried_range")), "left")
    group = Window.partitionBy(key, "range_no")
    out = {name: F.row_number().over(group.orderBy(*order)) + F.coalesce("n_before", F.lit(0))}
    if total:
        out[total] = F.coalesce("n_key", F.count(F.lit(1)).over(group))
    return met.withColumns(out).select(*rows.columns, *out)


def timeline(notes: DataFrame) -> DataFrame:
    """Each note with its ordinal in its topic (oldest first) and the topic's count."""
    return ordinals(notes, "topic_id", [F.col("created_utc").asc(), F.col("id").asc()], "ask_index", "ask_count")


def timeline_items(notes: DataFrame, labels: DataFrame, annotations: DataFrame) -> DataFrame:
    """The timeline's rows with the topic's label (empty if it has none) and the number of the note's annotations.

    labels: topic_id, label. annotations: note_id.
    """
    counts = annotations.groupBy(F.col("note_id").alias("id")).agg(F.count(F.lit(1)).alias("n_annotations"))
    items = timeline(notes).join(counts.hint("shuffle_merge"), "id", "left").join(sized(labels.select("topic_id", "label")), "topic_id", "left")
    return items.withColumns({"label": F.coalesce("label", F.lit("")), "n_annotations": F.coalesce("n_annotations", F.lit(0))})


def page(rows: DataFrame, limit: int, before: tuple | None = None) -> DataFrame:
    """A keyset page, newest first, of the rows before (created_utc, id), one row more to tell whether there is a next."""
    if before:
        at, key = before
        rows = rows.where((F.col("created_utc") < F.lit(at)) | ((F.col("created_utc") == F.lit(at)) & (F.col("id") < F.lit(key))))
    return rows.orderBy(F.desc("created_utc"), F.desc("id")).limit(limit + 1)


def page_with_next(rows: DataFrame, limit: int, before: tuple | None = None) -> DataFrame:
    """The page's rows (at most limit), each with next: the cursor "<created_utc> <id>" of the last one if more follow."""
    w = Window.orderBy(F.desc("created_utc"), F.desc("id"))  # over limit + 1 rows
    placed = page(rows, limit, before).withColumns({"place": F.row_number().over(w), "found": F.count(F.lit(1)).over(Window.partitionBy())})
    cursor = F.concat_ws(" ", F.col("created_utc").cast("string"), F.col("id").cast("string"))
    kept = placed.where(F.col("place") <= limit).withColumn("last", F.max(F.when(F.col("place") == limit, cursor)).over(Window.partitionBy()))
    return kept.withColumn("next", F.when(F.col("found") > limit, F.col("last"))).drop("place", "found", "last")


def page_numbers(notes: DataFrame, size: int) -> DataFrame:
    """The page of each note in its tag's timeline, newest first."""
    placed = ordinals(notes.select("id", "tag", "created_utc"), "tag", [F.desc("created_utc"), F.desc("id")], "place")
    return placed.select("id", "tag", F.floor((F.col("place") - 1) / size).cast("long").alias("page"))


def day_sections(notes: DataFrame) -> DataFrame:
    """day, its notes newest first (a digest of their ids) and their number."""
    item = F.struct((-F.unix_micros("created_utc")).alias("at"), (-F.col("id")).alias("minus"))
    grouped = notes.groupBy(F.substring("created", 1, 10).alias("day")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return grouped.select("day", F.size("items").cast("long").alias("n_notes"), F.md5(F.array_join(F.transform("items", lambda x: (-x["minus"]).cast("string")), ",")).alias("id_digest"))
