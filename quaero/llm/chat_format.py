"""Chat formatting by prefix-target expansion (operator 6), in DataFrame functions only.

Every assistant turn becomes one training example: all turns before it are context, and only its own text is under
the loss mask. ``stored_examples`` writes each example out, which grows with the square of a conversation's length; the
digests are taken from what is read back. ``examples`` has only the ends and spans, for those who keep the transcript.

Template, per turn (text and role escaped)::

    <s>[INST] <role>\\n<text> [/INST]     any role but assistant
     <text></s>                          assistant

Escaping doubles each backslash and puts one before the first character of ``<s>``, ``</s>``, ``[INST]`` and
``[/INST]`` inside a text, so a control string in the output is always the template's own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

CONTROL = r"(<(?=/?s>)|\[(?=/?INST\]))"
OPEN, MIDDLE, CLOSE = "<s>[INST] ", "\n", " [/INST]"
REPLY_OPEN, REPLY_CLOSE = " ", "</s>"
ASSISTANT = "assistant"
#: Replies of so many places of a conversation meet its turns in one group: a turn goes once to each such block behind it.
REPLY_BLOCK = 64


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _role_escaped(role: Column) -> Column:
    """A line end ends the role, so one inside a role gets a backslash too."""
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\\n"))


def transcripts(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row per turn: conv_id, place (from 1), is_reply, rendered, start and stop of it in the transcript (code points),
    loss_start and loss_stop of a reply's text in the transcript (null for context).

    Turns go by (turn, role, text), so ties and repeated rows have one order; all rows are kept. A null role or text is
    empty; rows with a null conv_id make one conversation. Extra columns are ignored; an empty table gives no rows.
    """
    rows = conversations.select(
        F.col(conv).cast("long").alias("conv_id"),
        F.col(turn).alias("turn_key"),
        F.coalesce(F.col(role), F.lit("")).alias("role_text"),
        F.coalesce(F.col(text), F.lit("")).alias("body_text"),
    )
    reply = F.col("role_text") == ASSISTANT
    rendered = F.when(reply, F.concat(F.lit(REPLY_OPEN), escaped(F.col("body_text")), F.lit(REPLY_CLOSE))).otherwise(
        F.concat(F.lit(OPEN), _role_escaped(F.col("role_text")), F.lit(MIDDLE), escaped(F.col("body_text")), F.lit(CLOSE))
    )
    order = Window.partitionBy("conv_id").orderBy("turn_key", "role_text", "body_text")
    placed = rows.select("conv_id", reply.alias("is_reply"), rendered.alias("rendered"), F.row_number().over(order).alias("place"), F.sum(F.length(rendered)).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("stop"))
    start = F.col("stop") - F.length("rendered")
    return placed.select(
        "conv_id",
        "place",
        "is_reply",
        "rendered",
        start.alias("start"),
        "stop",
        F.when(F.col("is_reply"), start + len(REPLY_OPEN)).alias("loss_start"),
        F.when(F.col("is_reply"), F.col("stop") - len(REPLY_CLOSE)).alias("loss_stop"),
    )


def examples(turns: DataFrame) -> DataFrame:
    """An example per assistant turn: conv_id, place, prefix_chars (its text is that much of the transcript), its loss span."""
    return turns.where("is_reply").select("conv_id", "place", F.col("stop").alias("prefix_chars"), "loss_start", "loss_stop")


def _joined(found: str) -> Column:
    """The rendered turns of a group, in order of their place."""
    return F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct(found, "rendered"))), lambda t: t["rendered"]))


def example_texts(turns: DataFrame) -> DataFrame:
    """The examples with their texts written out: each reply meets the turns up to its place, by conversation and block."""
    whole = Window.partitionBy("conv_id")
    block = lambda place: F.floor(F.col(place) / REPLY_BLOCK)
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv_key")
    replies = turns.where("is_reply").select(key, "conv_id", "place", "loss_start", "loss_stop", block("place").alias("block"))
    last = turns.withColumn("last_reply", F.max(F.when(F.col("is_reply"), F.col("place"))).over(whole)).where("place <= last_reply")
    parts = last.select(key, F.col("place").alias("part"), "rendered", F.explode(F.sequence(block("place"), block("last_reply"))).alias("block"))
    met = replies.join(parts.hint("shuffle_merge"), ["conv_key", "block"]).where("part <= place")
    found = met.groupBy("conv_key", "block", "conv_id", "place", "loss_start", "loss_stop").agg(_joined("part").alias("example_text"))
    return found.select("conv_id", "place", "example_text", "loss_start", "loss_stop")


def stored_examples(turns: DataFrame) -> DataFrame:
    """The examples, and a row without loss span for the context behind a conversation's last reply, if there is any."""
    last = F.max(F.when(F.col("is_reply"), F.col("place"))).over(Window.partitionBy("conv_id"))
    behind = turns.withColumn("last_reply", F.coalesce(last, F.lit(0))).where("place > last_reply")
    rest = behind.groupBy("conv_id").agg(F.max("place").alias("place"), _joined("place").alias("example_text"))
    return example_texts(turns).unionByName(rest, allowMissingColumns=True)


def _parsed(transcript: Column) -> Column:
    """role and text of each turn of a transcript.

    A mark behind each escaped character breaks the control strings inside texts; those left are the template's own.
    """
    turns = F.filter(F.split(F.regexp_replace(transcript, r"(?s)(\\.)", "$1;"), r"(?<=</s>|\[/INST\])"), lambda t: t != "")
    plain = lambda t: F.regexp_replace(t, r"(?s)\\(.);", "$1")
    context = r"(?s)^<s>\[INST\] (.*?)(?<!\\)\n(.*) \[/INST\]$"
    reply = lambda t: ~F.startswith(t, F.lit(OPEN))
    return F.transform(
        turns,
        lambda t: F.struct(
            F.when(reply(t), F.lit(ASSISTANT)).otherwise(plain(F.regexp_extract(t, context, 1))).alias("role"),
            plain(F.when(reply(t), F.regexp_extract(t, r"(?s)^ (.*)</s>$", 1)).otherwise(F.regexp_extract(t, context, 2))).alias("text"),
        ),
    )


def read_back(stored: DataFrame) -> DataFrame:
    """conv_id, said (role and text of every turn), losses (place and loss text of every example, in order) and
    formatted_chars, parsed from stored examples: the turns from the last example and the context behind it."""
    is_example = F.col("loss_start").isNotNull()
    loss = unescaped(F.substr("example_text", F.col("loss_start") + 1, F.col("loss_stop") - F.col("loss_start")))
    found = stored.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.when(is_example, F.struct("place", loss.alias("loss"))))).alias("losses"),
        F.max_by("example_text", F.when(is_example, F.col("place"))).alias("longest"),
        F.max(F.when(~is_example, F.col("example_text"))).alias("rest"),
        F.sum(F.length("example_text")).alias("formatted_chars"),
    )
    return found.select("conv_id", _parsed(F.concat_ws("", "longest", "rest")).alias("said"), "losses", "formatted_chars")


def digests(turns: DataFrame) -> DataFrame:
    """The digest of each conversation, from the examples as written and read back.

    formatted_chars is the sum of the example lengths, and of the context behind the last reply if there is any.
    """
    loss_text = F.concat_ws("", "losses.loss")
    whole = F.concat_ws("", F.transform("said", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return read_back(written(stored_examples(turns), "examples")).select(
        "conv_id",
        F.size("said").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length(loss_text).cast("long").alias("loss_chars"),
        F.sha2(loss_text, 256).alias("loss_sha256"),
        "formatted_chars",
    )
