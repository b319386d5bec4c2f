"""Validated batch writes as table transforms: saves, tag policy, renames, merges, annotations.

Each takes a table of requests and gives accepted rows and rejected ones with a machine-readable reason.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.redaction import redacted, redacted_list
from ..functions.tags import near_pairs, normalized
from ..functions.text import is_uuid
from ..sources.store import BROADCAST_ROWS, sized, stored
from .activity import ordinals
from .forest import merged_in_turn
from .resolve import resolved

MAX_TAGS = 5
NEW = "new"


def blank(text: Column) -> Column:
    return F.coalesce(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")) == "", F.lit(True))


def first_reason(*checks: tuple[Column, str]) -> Column:
    """The reason of the first failing check; null if none fails."""
    return F.coalesce(*[F.when(failed, F.lit(reason)) for failed, reason in checks])


def body_reason() -> Column:
    return first_reason(
        (~is_uuid(F.col("session_id")), "session_id is not a UUID"),
        (blank(F.col("cwd")), "cwd is empty"),
        (blank(F.col("title")), "title is empty"),
        (blank(F.col("question")), "question is empty"),
        (blank(F.col("conclusion")), "conclusion is empty"),
        (F.contains("title", F.lit("\n")), "title must be a single line"),
    )


def _tag_rows(requests: DataFrame, known: DataFrame, aliases: DataFrame) -> DataFrame:
    """request_id, confirm_new, is_new, pos, raw, tag (normalised, through the aliases; null if nothing is left), is_known."""
    given = lambda c, new: requests.select("request_id", F.coalesce("confirm_new", F.lit(False)).alias("confirm_new"), F.lit(new).alias("is_new"), F.posexplode(c).alias("pos", "raw"))
    each = given("tags", False).unionByName(given("new_tags", True)).withColumn("tag", normalized(F.col("raw")))
    there = known.select("tag", F.lit(True).alias("is_known")).distinct()
    return resolved(each, "tag", sized(aliases)).join(there.hint("shuffle_merge"), "tag", "left").withColumn("is_known", F.coalesce("is_known", F.lit(False)))


def _near(each: DataFrame, known: DataFrame) -> DataFrame:
    """tag, other, is_known: the near-duplicates of the new tags that nobody knows yet, among these and the known ones."""
    fresh = each.where("is_new AND NOT is_known AND tag IS NOT NULL").select("tag").distinct()
    there = known.select(F.col("tag").alias("other"), F.lit(True).alias("is_known")).distinct()
    pairs = near_pairs(stored(fresh.union(known.select("tag")).distinct())).join(stored(fresh).hint("shuffle_merge"), "tag", "left_semi")
    return pairs.select("tag", "other").join(there.hint("shuffle_merge"), "other", "left").select("tag", "other", F.coalesce("is_known", F.lit(False)).alias("is_known"))


def _by_request(requests: DataFrame, each: DataFrame) -> DataFrame:
    """request_id, tags (distinct, in the order given), tag_reason, near, from rows with bad (why the tag is refused) and near.

    A request has a handful of tags, so these groups are small.
    """
    order = F.struct("is_new", "pos")
    failed = F.when(F.col("bad").isNotNull(), order)
    grouped = each.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "tag"))).alias("all"), F.min_by("bad", failed).alias("bad"), F.min_by(F.when(F.col("is_new"), F.col("near")), failed).alias("near"))
    whole = requests.select("request_id").join(grouped.hint("shuffle_merge"), "request_id", "left").withColumn("tags", F.array_distinct(F.coalesce(F.col("all.tag"), F.expr("cast(array() AS array<string>)"))))
    reason = F.coalesce("bad", F.when(F.size("tags") == 0, "a note needs a tag"), F.when(F.size("tags") > MAX_TAGS, f"more than {MAX_TAGS} tags"))
    return whole.select("request_id", "tags", reason.alias("tag_reason"), "near")


def _refused(known: Column) -> Column:
    """Why a tag is refused, given whether it is known when its request's turn comes and the near-duplicates known then."""
    return (
        F.when(F.col("tag").isNull(), F.concat(F.lit("empty tag: "), "raw"))
        .when(~F.col("is_new") & ~known, F.concat(F.lit("unknown tag: "), "tag"))
        .when(F.col("is_new") & ~known & F.col("near").isNotNull() & ~F.col("confirm_new"), F.concat(F.lit("near duplicate: "), "tag"))
    )


def tag_policy(requests: DataFrame, known: DataFrame, aliases: DataFrame) -> DataFrame:
    """request_id, tags, tag_reason, near: the resolved tags of each request, or why they are refused.

    requests: request_id, tags, new_tags, confirm_new. known: tag. aliases: start, resolved. Tags must be known after
    normalising and alias; a new tag near a known one needs confirm_new, and one that is known is reused; 1 to 5 in all. Each
    request is judged by the tags known before the batch; tag_policy_in_order lets those of the requests before it count.
    """
    requests = stored(requests.select("request_id", "tags", "new_tags", "confirm_new"))
    known = stored(known.select("tag").distinct())
    each = stored(_tag_rows(requests, known, aliases))
    near = _near(each, known).where("is_known").groupBy("tag").agg(F.array_sort(F.collect_set("other")).alias("near"))
    each = each.join(near.hint("shuffle_merge"), "tag", "left")
    return _by_request(requests, each.withColumn("bad", _refused(F.col("is_known"))))


def _created_in_order(each: DataFrame, near: DataFrame) -> DataFrame:
    """tag, created_by: the first accepted request that names each tag as new, with all requests taken in order of request_id.

    each: the rows, of requests that nothing else refuses, of tags not known before. near: tag, other, is_known. Whether a request
    is accepted may hang on earlier ones: on a tag that one of them makes, or on a near-duplicate that none of them may make. In
    each round a tag is made no later than by its first accepted request, and no earlier than by its first open one that may
    still be the first to make it. One that names the tag as known too may not, nor one without confirm_new beside a
    near-duplicate made before it: these are accepted only if the tag is there. Requests for which these bounds decide are closed. The first open request always is, and those
    that share no tags or near tags with an earlier open one that may make them all are, so the rounds are as many as the longest such
    dependency is long; however often a tag is refused, that is one round.
    """
    pairs = stored(near.where("NOT is_known").select("tag", "other"))
    beside_known = near.where("is_known").select("tag", F.lit(True).alias("beside_known")).distinct()
    named_known = F.bool_or(~F.col("is_new")).over(Window.partitionBy("request_id", "tag"))
    open_ = each.select("request_id", "tag", "is_new", "confirm_new", named_known.alias("named_known")).join(beside_known.hint("shuffle_merge"), "tag", "left").withColumn("beside_known", F.coalesce("beside_known", F.lit(False)))
    # high: the first accepted request yet that makes the tag; near_high: that makes one of its near-duplicates.
    no_request = F.lit(None).cast(each.schema["request_id"].dataType)
    open_ = stored(open_.withColumns({"high": no_request, "near_high": no_request}))
    made = [open_.where("false").select("tag", F.col("request_id").alias("created_by"))]
    turn, yes = F.col("request_id"), lambda c: F.coalesce(c, F.lit(False))
    near_known = F.col("beside_known") | yes(F.col("near_high") < turn)
    may_make = F.col("is_new") & ~F.col("named_known") & (F.col("confirm_new") | ~near_known) & ~yes(F.col("high") < turn)
    known, unknown = yes(F.col("high") < turn), yes(F.least("high", "soonest") >= turn) | F.coalesce("high", "soonest").isNull()
    alone = ~F.col("beside_known") & (yes(F.least("near_high", "near_soonest") >= turn) | F.coalesce("near_high", "near_soonest").isNull())
    fine = F.when(F.col("is_new"), F.col("confirm_new") | known | alone).otherwise(known)
    bad = F.when(F.col("is_new"), ~F.col("confirm_new") & unknown & near_known).otherwise(unknown)
    own = Window.partitionBy("request_id")
    left = paired_for = open_.count()
    while left:
        if left * 4 < paired_for:
            pairs, paired_for = stored(pairs.join(open_.where("is_new").select("tag").distinct().hint("shuffle_merge"), "tag", "left_semi")), left
        # No table of tags made from the open rows has more rows than these.
        joined = F.broadcast if left <= BROADCAST_ROWS else lambda df: df.hint("shuffle_merge")
        soonest = stored(open_.where(may_make).groupBy("tag").agg(F.min("request_id").alias("soonest")))
        beside = pairs.join(joined(soonest.withColumnRenamed("tag", "other")), "other").groupBy("tag").agg(F.min("soonest").alias("near_soonest"))
        met = open_.join(joined(soonest), "tag", "left").join(beside.hint("shuffle_merge"), "tag", "left")
        judged = stored(met.select(*open_.columns, fine.alias("fine"), bad.alias("bad")).withColumns({"fine": F.bool_and("fine").over(own), "bad": F.bool_or("bad").over(own)}))
        new = stored(judged.where("fine AND is_new").groupBy("tag").agg(F.min("request_id").alias("created_by")))
        made.append(new)
        beside = pairs.join(joined(new.withColumnRenamed("tag", "other")), "other").groupBy("tag").agg(F.min("created_by").alias("near_created"))
        later = judged.where("NOT fine AND NOT bad").join(joined(new), "tag", "left").join(beside.hint("shuffle_merge"), "tag", "left")
        open_ = stored(later.withColumns({"high": F.least("high", "created_by"), "near_high": F.least("near_high", "near_created")}).select(*open_.columns))
        left = open_.count()
    return reduce(DataFrame.unionByName, made).groupBy("tag").agg(F.min("created_by").alias("created_by"))


def tag_policy_in_order(requests: DataFrame, known: DataFrame, aliases: DataFrame) -> DataFrame:
    """As tag_policy, with the requests applied one after the other by request_id: tags that an accepted request makes are
    known to the later ones. A request with fine = false (refused for another reason) makes none.

    requests also have fine (boolean). request_id must be distinct.
    """
    requests = stored(requests.select("request_id", "tags", "new_tags", "confirm_new", "fine"))
    known = stored(known.select("tag").distinct())
    each = stored(_tag_rows(requests, known, aliases))
    near = stored(_near(each, known))
    counted = _by_request(requests, each.withColumns({"bad": F.when(F.col("tag").isNull(), F.lit("empty")), "near": F.lit(None).cast("array<string>")}))
    usable = requests.where("fine").select("request_id").join(counted.where("tag_reason IS NULL").select("request_id").hint("shuffle_merge"), "request_id", "left_semi")
    unsure = stored(each.where("NOT is_known AND tag IS NOT NULL"))
    made = stored(_created_in_order(unsure.join(stored(usable).hint("shuffle_merge"), "request_id", "left_semi"), near))
    placed = each.join(sized(made), "tag", "left").withColumn("known_then", F.col("is_known") | F.coalesce(F.col("created_by") < F.col("request_id"), F.lit(False)))
    placed = stored(placed)
    # The near-duplicates that were known when the request's turn came, for the tags that were not.
    since = near.join(made.withColumnsRenamed({"tag": "other", "created_by": "since"}).hint("shuffle_merge"), "other", "left")
    asked = placed.where("is_new AND NOT known_then AND NOT confirm_new AND tag IS NOT NULL").select("request_id", "tag").distinct()
    then = asked.join(since.hint("shuffle_merge"), "tag").where("is_known OR since < request_id").groupBy("request_id", "tag").agg(F.array_sort(F.collect_set("other")).alias("near"))
    met = placed.join(then.hint("shuffle_merge"), ["request_id", "tag"], "left")
    return _by_request(requests, met.withColumn("bad", _refused(F.col("known_then"))))


def save_batch(requests: DataFrame, topics: DataFrame, chains: DataFrame, known: DataFrame, aliases: DataFrame, in_order: bool = False) -> DataFrame:
    """Every request with reject_reason (null: accepted), redacted prose, resolved topic and tags.

    Requests are judged by the tags known before the batch or, in_order, also by those of the accepted requests before them. A new topic gets an id from the request's content, so a repeated run gives the same row.
    """
    judged = requests.withColumn("body_bad", body_reason()).join(topics.select(F.col("id").alias("topic"), F.lit(True).alias("topic_known")).distinct().hint("shuffle_merge"), "topic", "left")
    topic_bad = F.when((F.col("topic") != NEW) & F.col("topic_known").isNull(), F.concat(F.lit("unknown topic: "), "topic")).when(F.col("topic").isNull(), "no topic")
    if in_order:
        tags = tag_policy_in_order(judged.withColumn("fine", F.coalesce("body_bad", topic_bad).isNull()), known, aliases)
    else:
        tags = tag_policy(requests, known, aliases)
    judged = judged.join(stored(tags.withColumnRenamed("tags", "final_tags")).hint("shuffle_merge"), "request_id")
    made = F.concat(F.lit("t-"), F.substring(F.sha2(F.concat_ws("\n", F.col("request_id").cast("string"), "title", "question"), 256), 1, 24))
    out = judged.withColumn("reject_reason", F.coalesce("body_bad", "tag_reason", topic_bad)).withColumn("is_new_topic", F.col("topic") == NEW)
    out = resolved(out.withColumn("topic_id", F.when(F.col("topic") == NEW, made).otherwise(F.col("topic"))), "topic_id", chains)
    prose = {c: redacted(F.col(c)) for c in ("title", "question", "conclusion")} | {c: redacted_list(F.col(c)) for c in ("key_points", "open_questions")}
    return out.withColumns(prose).select("request_id", "session_id", "cwd", *prose, "topic_id", "is_new_topic", F.col("final_tags").alias("tags"), "created", "reject_reason", "near")


def new_topics(saved: DataFrame) -> DataFrame:
    """Topic rows of accepted requests for a new topic: label is the redacted title."""
    return saved.where("reject_reason IS NULL AND is_new_topic").select(F.col("topic_id").alias("id"), F.col("title").alias("label"), "created")


def rename_topics(topics: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Topics with their new labels, and rejected edits. edits: topic_id, label, seq; the last good one counts."""
    label = F.trim(F.col("label"))
    known = topics.select(F.col("id").alias("topic_id"), F.lit(True).alias("known")).distinct()
    judged = edits.join(known, "topic_id", "left").withColumn("reason", first_reason((F.col("known").isNull(), "unknown topic"), (blank(label), "label is empty"), (F.contains(label, F.lit("\n")), "label must be a single line")))
    good = judged.where("reason IS NULL").groupBy("topic_id").agg(F.max_by(redacted(label), "seq").alias("new_label"))
    renamed = topics.join(good.withColumnRenamed("topic_id", "id"), "id", "left").withColumn("label", F.coalesce("new_label", "label")).drop("new_label")
    return renamed, judged.where("reason IS NOT NULL").select("topic_id", "seq", "reason")


def merge_topics(requests: DataFrame, topics: DataFrame, chains: DataFrame) -> DataFrame:
    """seq, from_id, into_id, reason (null: accepted). Both topics must exist.

    Requests apply one after the other by seq (then by their ends): both ends are resolved through the merges that exist and
    those accepted before, the topic that the source has come to is merged into the one that the target has come to, and a
    request whose ends have come to the same topic is refused, so no circle of any length closes. They are worked out in
    rounds over all requests (see forest), whose number grows with the logarithm of theirs; no component is gathered.
    """
    known = stored(topics.select("id").distinct())
    r = requests.select("seq", F.col("source").alias("from_id"), F.col("target").alias("into_id"))
    for c in ("from_id", "into_id"):
        r = r.join(known.select(F.col("id").alias(c), F.lit(True).alias(f"{c}_known")).hint("shuffle_merge"), c, "left")
        r = resolved(r, c, chains)
    reason = first_reason((F.col("from_id_known").isNull(), "unknown source"), (F.col("into_id_known").isNull(), "unknown target"))
    r = stored(r.select("seq", "from_id", "into_id", reason.alias("reason")))
    good = r.where("reason IS NULL").select("seq", "from_id", "into_id", F.lit(0).alias("batch"))
    good = stored(ordinals(good, "batch", [F.col(c).asc() for c in ("seq", "from_id", "into_id")], "at"))
    ends = merged_in_turn(good.select("at", F.col("from_id").alias("x"), F.col("into_id").alias("y")))
    judged = good.select("at", "seq").join(ends.hint("shuffle_merge"), "at")
    return judged.select("seq", "from_id", "into_id", F.when(~F.col("accepted"), "same topic").alias("reason")).unionByName(r.where("reason IS NOT NULL"))


def annotate(requests: DataFrame, notes: DataFrame) -> DataFrame:
    """Annotation rows with reason (null: accepted): the note must exist and the text not be blank; text is redacted."""
    known = notes.select(F.col("id").alias("note_id"), F.lit(True).alias("known")).distinct()
    reason = first_reason((F.col("known").isNull(), "unknown note"), (blank(F.col("body")), "annotation is empty"))
    return requests.join(known, "note_id", "left").select("id", "note_id", redacted(F.trim("body")).alias("body"), "created", reason.alias("reason"))


def apply_annotation_changes(annotations: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Annotations after updates and deletions, and rejected changes. changes: id, op, body, seq, at; the last good one wins."""
    known = annotations.select("id", F.lit(True).alias("known")).distinct()
    reason = first_reason((F.col("known").isNull(), "unknown annotation"), ((F.col("op") == "update") & blank(F.col("body")), "annotation is empty"))
    judged = changes.join(known, "id", "left").withColumn("reason", reason)
    last = judged.where("reason IS NULL").groupBy("id").agg(F.max_by(F.struct("op", "body", "at"), "seq").alias("last"))
    after = annotations.join(last, "id", "left").where("last IS NULL OR last.op <> 'delete'")
    after = after.withColumn("body", F.when(F.col("last").isNotNull(), redacted(F.trim("last.body"))).otherwise(F.col("body"))).withColumn("updated", F.coalesce("last.at", "updated")).drop("last")
    return after, judged.where("reason IS NOT NULL").select("id", "seq", "reason")
