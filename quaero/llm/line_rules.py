"""Quality rules with cross-document line frequency (operator 4), in DataFrame functions only.

Base rules look at one text. The method then hashes normalised lines, counts the documents per host in which each line
occurs, removes the lines above the host's limit from the texts, and rejects documents of which too little is left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

#: A line is boilerplate if more documents of its host hold it than this, however many documents the host has.
MAX_DOCUMENTS = 20
#: A document is depleted if the lines removed hold more than this share of its word characters.
MAX_REMOVED = 0.8
#: Up to so many boilerplate lines (some 40 MB) are broadcast; more meet the documents' lines by salted shuffle, as hot
#: lines occur in a large share of all documents.
BROADCAST_LINES, SALTS = 500_000, 64

#: The six ASCII blanks, as characters and as a pattern; and what a line's blanks are that aren't single spaces.
BLANK_CHARS, BLANKS = " \t\n\x0b\x0c\r", "[ \\t-\\r]+"
WIDE_BLANKS = " *[\\t\\x0b-\\r][ \\t\\x0b-\\r]*| {2,}"


def words_of(text: Column) -> Column:
    """The words: maximal runs of characters other than the six ASCII blanks (null if there is none)."""
    trimmed = F.btrim(text, F.lit(BLANK_CHARS))
    return F.when(trimmed != "", F.split(trimmed, BLANKS))


def lines_of(text: Column) -> Column:
    """The lines that hold a word, as they stand."""
    return F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANK_CHARS)) != "")


def normal(text: Column) -> Column:
    """Lower case, a run of blanks inside a line as one space, digits made equal. Line ends stay."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), WIDE_BLANKS, " "), "[1-9]", "0")


def line_hash(line: Column) -> Column:
    """Hash of a line in its normal form."""
    return F.xxhash64(F.trim(line))


def base_columns(docs: DataFrame, text: str) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words.

    Windows of eight words are compared by a 64-bit hash, combined from the hashes of their halves. Only in texts where a
    window occurs twice are windows sorted: each start of such a window covers its eight words, or those up to the next
    start.
    """
    words = docs.withColumn("words_", words_of(F.col(text))).withColumn("lines_", lines_of(F.col(text)))
    ones = words.withColumn("ones_", F.when(F.size("words_") > 8, F.transform("words_", lambda w: F.xxhash64(w))))
    pair = lambda name, step: F.zip_with(name, F.slice(name, step + 1, F.size(name)), lambda a, b: F.xxhash64(a, b))
    eights = ones.withColumn("twos_", pair("ones_", 1)).withColumn("fours_", pair("twos_", 2)).withColumn("eights_", F.slice(pair("fours_", 4), 1, F.size("ones_") - 7))
    found = eights.withColumn("placed_", F.when(F.size(F.array_distinct("eights_")) < F.size("eights_"), F.sort_array(F.transform("eights_", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    starts = found.withColumn("starts_", F.expr("sort_array(transform(filter(placed_, (x, k) -> x.h = get(placed_, k - 1).h OR x.h = get(placed_, k + 1).h), x -> x.i))"))
    covered = F.expr("aggregate(starts_, struct(0L AS n, -8 AS last), (a, s) -> struct(a.n + least(8, s - a.last) AS n, s AS last), a -> a.n)")
    return starts.select(
        *docs.columns,
        F.coalesce(F.size("words_"), F.lit(0)).cast("long").alias("n_words"),
        F.coalesce(F.length(F.array_join("words_", "")), F.lit(0)).cast("long").alias("word_chars"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("lines_") - F.size(F.array_distinct("lines_"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def _boilerplate(lines: DataFrame) -> DataFrame:
    """The (host, h) that more than MAX_DOCUMENTS documents hold; a line that a text holds twice counts once."""
    return lines.groupBy("host", "h").agg(F.count_if("is_first").alias("documents")).where(F.col("documents") > MAX_DOCUMENTS).select("host", "h")


def _removed(rows: DataFrame) -> DataFrame:
    """row, gone (hashes of its boilerplate lines) and gone_chars (their word characters), of the rows that have any."""
    lines = rows.select("row", "host", F.explode("line_hashes").alias("line")).select("row", "host", "line.*")
    known = written(_boilerplate(lines), "boilerplate")
    if known.count() <= BROADCAST_LINES:
        met = lines.join(F.broadcast(known), ["host", "h"])
    else:
        salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = lines.withColumn("salt", F.pmod("row", F.lit(SALTS)).cast("int")).join(salted.hint("shuffle_hash"), ["host", "h", "salt"])
    return met.groupBy("row").agg(F.collect_set("h").alias("gone"), F.sum("chars").alias("gone_chars"))


def cleaned_documents(docs: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source", with_text: bool = True) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, removed_chars, and (with_text) text without the lines above the limit.

    The base counts are those of the whole text; removed_chars are the word characters of the lines taken out. A null
    text has no words and fails the base rules; so does an empty one. Documents without host (null) form one host. Each
    row is a document of its own, whatever its id: rows with equal or null ids count and are cleaned by themselves. An
    empty table gives no rows; extra columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(host), F.lit("")).alias("host"), F.coalesce(F.col(text), F.lit("")).alias("body_text"))
    base = base_columns(rows, "body_text")
    plain = F.filter(F.split(F.regexp_replace("body_text", WIDE_BLANKS, " "), "\n"), lambda x: (x != "") & (x != " "))
    chars = F.transform(plain, lambda x: F.length(F.replace(x, F.lit(" "), F.lit(""))))
    hashes = F.transform(F.filter(F.split(normal(F.col("body_text")), "\n"), lambda x: (x != "") & (x != " ")), line_hash)
    pairs = F.sort_array(F.zip_with(hashes, chars, lambda h, c: F.struct(h.alias("h"), c.alias("chars"))))
    flagged = F.expr("transform(pairs_, (p, k) -> struct(p.h AS h, p.chars AS chars, k = 0 OR p.h <> get(pairs_, k - 1).h AS is_first))")
    kept = base.withColumn("pairs_", pairs).withColumn("line_hashes", flagged).drop("pairs_", *([] if with_text else ["body_text"]))
    stored = written(kept.withColumn("row", F.monotonically_increasing_id()), "rows")
    joined = stored.drop("line_hashes").join(_removed(stored).hint("shuffle_merge"), "row", "left")
    removed = F.coalesce("gone_chars", F.lit(0)).cast("long")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    out = joined.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (removed <= MAX_REMOVED * F.col("word_chars"))).alias("kept"),
        removed.alias("removed_chars"),
        *(["body_text", "gone"] if with_text else []),
    )
    if not with_text:
        return out
    stays = F.filter(F.split("body_text", "\n"), lambda x: ~F.array_contains("gone", line_hash(normal(x))))
    return out.withColumn("text", F.when(F.col("gone").isNull(), F.col("body_text")).otherwise(F.array_join(stays, "\n"))).drop("body_text", "gone")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """cleaned_documents without their texts, which aren't carried along."""
    return cleaned_documents(docs, id_col, text, host, with_text=False)
