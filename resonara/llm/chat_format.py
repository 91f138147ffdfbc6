"""Chat formatting from an event log, with DataFrame operations only.

A log row is an event of a conversation: ``message`` (a whole message),
``delta`` (text appended to a message), ``edit`` (a message's text replaced)
or ``regenerate`` (a message's text cleared and every later message dropped).
Events are partitioned by conversation and message, sorted by sequence and
folded: what a message says is its last whole text and the deltas after it,
as far as they come after the last regeneration of an earlier message.

Rendering.  A turn is ``<|start|>role<|sep|>text<|end|>`` and a newline.  Inside
roles and texts a control string gets a backslash after its first character,
and one more where it has some already, so ``unescaped`` gives the text back
exactly.  No other text is changed.

A conversation ends as one row, and so as one value of Spark: that is the only
thing here that grows with the length of a conversation.  Messages are folded
apart from each other before, and events are pre-sorted arrays of one message.

Defined results: events that tie in sequence apply in the order regenerate,
message, edit, delta, then by role and text; equal rows each apply; a null
kind is ``message``, a null text or role is empty, a null conversation is a
conversation, a null sequence sorts first.  An empty log gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The strings that mark turns here and in other common templates.
START, SEPARATOR, END = "<|start|>", "<|sep|>", "<|end|>"
CONTROL = r"(/?s>|/?INST\]|\|(?:start|sep|end)\|>)"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + CONTROL, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + CONTROL, "$1$2$3")


def fold(events: DataFrame) -> DataFrame:
    """conv_id, message, role and final text of each message that an event log leaves.

    ``events`` has conv_id, seq (orderable), kind, message (orderable), role, text.
    """
    kind = F.coalesce("kind", F.lit("message"))
    rank = F.when(kind == "regenerate", 0).when(kind == "message", 1).when(kind == "edit", 2).otherwise(3)
    event = F.struct("seq", rank.alias("rank"), F.col("role"), F.coalesce("text", F.lit("")).alias("text"))
    messages = events.groupBy("conv_id", "message").agg(F.sort_array(F.collect_list(event)).alias("events"), F.max(F.when(kind == "regenerate", F.col("seq"))).alias("regenerated"))
    before = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    live = messages.withColumn("cut", F.max("regenerated").over(before)).withColumn("events", F.when(F.col("cut").isNull(), F.col("events")).otherwise(F.filter("events", lambda e: e["seq"] > F.col("cut"))))
    whole = F.coalesce(F.array_max(F.transform("events", lambda e, i: F.when(e["rank"] < 3, i))), F.lit(-1))
    roles = F.filter("events", lambda e: e["role"].isNotNull())
    return (
        live.filter(F.size("events") > 0)
        .withColumn("whole", whole)
        .select(
            "conv_id",
            "message",
            F.coalesce(F.get(roles, F.size(roles) - 1)["role"], F.lit("")).alias("role"),
            F.array_join(F.transform(F.filter("events", lambda e, i: (i > F.col("whole")) | ((i == F.col("whole")) & (e["rank"] > 0))), lambda e: e["text"]), "").alias("text"),
        )
    )


def render(messages: DataFrame, learn: str = "assistant") -> DataFrame:
    """conv_id, n_turns, formatted and spans of each conversation.

    ``spans`` has a struct for each turn: its start, and the start and end of
    its text if its role is ``learn`` (the loss mask), else nulls.  All are
    code points of ``formatted``.
    """
    head = F.concat(F.lit(START), escaped(F.col("role")), F.lit(SEPARATOR))
    body = escaped(F.col("text"))
    turns = messages.select("conv_id", "message", "role", head.alias("head"), body.alias("body")).withColumn("turn", F.concat("head", "body", F.lit(END + "\n")))
    so_far = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("start", F.coalesce(F.sum(F.length("turn")).over(so_far), F.lit(0)))
    loss = F.col("role") == learn
    begin = F.col("start") + F.length("head")
    span = F.struct(F.col("start"), F.when(loss, begin).alias("loss_start"), F.when(loss, begin + F.length("body")).alias("loss_end"))
    by_turn = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("message", "turn", span.alias("span")))).alias("turns"))
    return by_turn.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"),
        F.transform("turns", lambda t: t["span"]).alias("spans"),
    )


def chunks(formatted: Column) -> Column:
    """The turns of a formatted text, without their ends."""
    parts = F.split(formatted, r"<\|end\|>\n", -1)
    return F.slice(parts, 1, F.size(parts) - 1)


def parse(formatted: Column) -> Column:
    """The turns of a formatted text as structs of role and text."""

    def turn(chunk: Column) -> Column:
        halves = F.split(chunk, r"<\|sep\|>", -1)
        return F.struct(unescaped(F.substring(halves[0], len(START) + 1, 2**31 - 1)).alias("role"), unescaped(halves[1]).alias("text"))

    return F.transform(chunks(formatted), turn)


def under_mask(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped and joined."""

    def masked(chunk: Column, span: Column) -> Column:
        cut = F.substr(chunk, (span["loss_start"] - span["start"] + 1).cast("int"), (span["loss_end"] - span["loss_start"]).cast("int"))
        return F.coalesce(unescaped(cut), F.lit(""))

    return F.array_join(F.zip_with(chunks(formatted), spans, masked), "")


def format_conversations(events: DataFrame, learn: str = "assistant") -> DataFrame:
    """Final conversations of an event log, rendered; see ``fold`` and ``render``."""
    return render(fold(events), learn)


def events_of_rows(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as a log in which every row is a message, in the order of turn, role, text."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return rows.select("conv_id", F.row_number().over(order).alias("seq"), F.lit("message").alias("kind"), "role", "text").withColumn("message", F.col("seq"))


def streamed(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as the log of a service that streams, in the order of turn, role, text.

    A message begins with a draft, which is regenerated; its first third comes
    as a delta, which an edit replaces by two thirds, and a delta brings the
    rest.  So what the fold gives back depends on every kind of event.
    """
    whole = events_of_rows(rows).withColumn("text", F.coalesce("text", F.lit("")))
    third = F.floor(F.length("text") / 3).cast("int")
    part = lambda first, last: F.substr(F.col("text"), first + 1, last - first)
    zero, end = F.lit(0), F.length("text")
    made = [("message", F.col("role"), F.concat(F.lit("draft of "), F.reverse("text"))), ("regenerate", F.lit(None), F.lit(None)), ("delta", F.lit(None), part(zero, third)), ("edit", F.lit(None), part(zero, 2 * third)), ("delta", F.lit(None), part(2 * third, end))]
    events = F.array(*[F.struct((F.col("seq") * len(made) + k).alias("seq"), F.lit(kind).alias("kind"), role.cast("string").alias("role"), text.cast("string").alias("text")) for k, (kind, role, text) in enumerate(made)])
    return whole.select("conv_id", "message", F.explode(events).alias("e")).select("conv_id", "e.seq", "e.kind", "message", "e.role", "e.text")


def digests(formatted: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations."""
    turns = F.transform(parse(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return formatted.withColumn("loss_text", under_mask(F.col("formatted"), F.col("spans"))).select(
        "conv_id",
        F.size(chunks(F.col("formatted"))).cast("long").alias("n_turns"),
        F.sha2(F.array_join(turns, ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
