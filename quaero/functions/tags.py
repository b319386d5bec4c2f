"""Tags: canonical form, near-duplicates and suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Edit similarity of near-duplicates, and of suggestions.
NEAR, SUGGESTED, SUGGESTIONS = 0.8, 0.5, 5
#: Tags that may have so many edits meet on what is left of them with as many letters less (at most 91 texts a tag).
FEW_EDITS = 2

_WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "\u3000"
_PLAIN = "".join(chr(c) for c in range(0x21, 0x7F)) + " "


def normalized(raw: Column) -> Column:
    """Full-width folded to ASCII, lower case, runs of blanks, _ and - as one dash and none at the ends.

    Null if no letter or digit is left.
    """
    folded = F.regexp_replace(F.lower(F.translate(raw, _WIDE, _PLAIN)), r"(?U)[\s_-]+", "-")
    trimmed = F.trim(folded, F.lit("-"))
    return F.when(trimmed.rlike(r"[\p{L}\p{N}]"), trimmed)


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / length of the longer."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def squashed(tag: Column) -> Column:
    return F.replace(tag, F.lit("-"), F.lit(""))


def _segments(n: Column) -> Column:
    """no, start (from 0) and size of the segments of a tag of n letters: one more than the edits that NEAR allows it."""
    many = F.floor(n / 5) + 1
    return F.transform(F.sequence(F.lit(0), many - 1), lambda i: F.struct(i.alias("no"), F.floor(i * n / many).alias("start"), (F.floor((i + 1) * n / many) - F.floor(i * n / many)).alias("size")))


def _less(word: Column, letters: int) -> Column:
    """The distinct texts that a word leaves when it loses so many letters."""
    without_one = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    left = F.array(word)
    for _ in range(letters):
        left = F.array_distinct(F.flatten(F.transform(left, without_one)))
    return left


def meeting(tags: DataFrame) -> DataFrame:
    """tag, other (no shorter), perhaps repeated: distinct tags among which are all that are similar enough, and few others.

    A similarity of 0.8 allows one edit to five letters of the longer tag. Where that is one or two edits, the longer tag less
    as many letters is the shorter one less what their lengths leave of the edits, so tags meet on (length, what is left):
    hardly any meet that are not near. Longer tags are cut into one segment more than they may have edits, so one segment
    at least is whole in the shorter tag, shifted by no more than the edits and the difference in length leave room for; they
    meet on (length, number and letters of a segment).
    """
    sized = tags.select("tag", F.length("tag").cast("long").alias("own"))
    # n is the length of the longer tag.
    short = sized.select("tag", "own", F.explode(F.sequence(F.col("own"), F.floor(F.col("own") * 5 / 4))).alias("n")).where("n >= 5")
    edits, more = F.floor(F.col("n") / 5), F.col("n") - F.col("own")
    less = lambda letters: F.explode(F.when(letters == 0, _less(F.col("tag"), 0)).when(letters == 1, _less(F.col("tag"), 1)).otherwise(_less(F.col("tag"), FEW_EDITS))).alias("left")
    few = short.where(edits <= FEW_EDITS)
    left = few.where("own = n").select(F.col("tag").alias("other"), "n", less(edits))
    met = few.select("tag", "own", "n", less(edits - more)).join(left.hint("shuffle_merge"), ["n", "left"])
    piece = F.substring(F.col("tag"), (F.col("start") + 1).cast("int"), F.col("s.size").cast("int")).alias("piece")
    many = short.where(edits > FEW_EDITS)
    long = many.where("own = n").select("tag", "n", F.explode(_segments(F.col("n"))).alias("s")).withColumn("start", F.col("s.start"))
    index = long.select(F.col("tag").alias("other"), "n", F.col("s.no").alias("no"), piece)
    # Of the edits, some come before the segment and some behind it; together they make up for the difference in length.
    cut = many.select("tag", "own", "n", F.floor((edits + more) / 2).alias("back"), F.floor((edits - more) / 2).alias("on"), F.explode(_segments(F.col("n"))).alias("s"))
    first, last = F.greatest(F.lit(0), F.col("s.start") - F.col("back")), F.least(F.col("own") - F.col("s.size"), F.col("s.start") + F.col("on"))
    probes = cut.withColumns({"first": first, "last": last}).where("first <= last").withColumn("start", F.explode(F.sequence("first", "last"))).select("tag", "own", "n", F.col("s.no").alias("no"), piece).distinct()
    met_long = probes.join(index.hint("shuffle_merge"), ["n", "no", "piece"])
    each_once = "own < n OR tag < other"
    return met.where(each_once).select("tag", "other").unionByName(met_long.where(each_once).select("tag", "other"))


def near_pairs(tags: DataFrame) -> DataFrame:
    """tag, other, score of near-duplicates among distinct tags: equal without dashes, or similar enough (compared exactly where they meet)."""
    one = tags.select("tag", squashed(F.col("tag")).alias("plain")).where("tag IS NOT NULL").distinct()
    same = one.join(one.withColumnRenamed("tag", "other").hint("shuffle_merge"), "plain").where("tag <> other").select("tag", "other")
    alike = meeting(one).where(similarity(F.col("tag"), F.col("other")) >= NEAR).distinct()
    both = same.unionByName(alike).unionByName(alike.select(F.col("other").alias("tag"), F.col("tag").alias("other"))).distinct()
    return both.select("tag", "other", F.round(similarity(F.col("tag"), F.col("other")), 6).alias("score"))


def suggestions(unknown: DataFrame, known: DataFrame, limit: int = SUGGESTIONS) -> DataFrame:
    """tag, rank, suggestion, score: known tags of some similarity or that contain, or are contained in, an unknown one.

    A stated set of unknown tags is compared with the known tags, which are distinct labels and not notes.
    """
    a, b = unknown.select("tag").distinct(), known.select(F.col("tag").alias("suggestion")).distinct()
    # The length bound is an equi-free condition; both sides are label sets, the known one checked before it is broadcast.
    score = similarity(F.col("tag"), F.col("suggestion"))
    fits = (score >= SUGGESTED) | F.contains("suggestion", "tag") | F.contains("tag", "suggestion")
    w = Window.partitionBy("tag").orderBy(F.desc("score"), "suggestion")
    met = a.join(F.broadcast(b) if b.count() <= 100_000 else b, fits & (F.col("tag") != F.col("suggestion"))).withColumn("score", score)
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("tag", F.col("rank").cast("long").alias("rank"), "suggestion", F.round("score", 6).alias("score"))
