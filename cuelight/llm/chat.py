"""Chat formatting from an event log, in DataFrame operations only.

A log has rows (conv_id, seq, turn, kind, role, text). Kinds:

- ``message``: opens a message at ``turn``;
- ``delta``: appends to the latest message of its turn, as streaming does;
- ``edit``: replaces what that message says;
- ``regenerate``: empties it (or replaces it, if there is a text), and what later turns held until then is void.

Logs are dealt by conversation, ordered by seq, and folded to final messages; these are
rendered by a template, with a mask of what counts for the loss: assistants' texts.

Template: ``<s>``, then for each message ``[INST]`` role ``[/INST]`` text ``</s>``. Control strings inside
roles and texts are written as a backslash and a letter, and a backslash as ``\\b``: each backslash of
the output is followed by its letter, so that reading back is exact.

A conversation ends up as one string, so it is one task's work; all else is dealt by it once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, HEAD, BODY, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"
_ESCAPES = [("\\", "\\b"), (HEAD, "\\i"), (BODY, "\\j"), (CLOSE, "\\k"), (OPEN, "\\l")]


def escape(text: Column) -> Column:
    for plain, written in _ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column) -> Column:
    for plain, written in reversed(_ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, turn, number, role, text): the final messages, ``number`` telling those of one turn apart.

    Null roles and texts count as empty; a message's role is the first that is not. Events of equal seq apply in the
    order of kind (delta, edit, message, regenerate), role and text. Events of a turn before its first ``message`` make one
    of their own. Unknown and null kinds are taken as ``message``.
    """
    kinds = ("delta", "edit", "regenerate")
    log = events.select(
        "conv_id",
        "turn",
        "seq",
        F.when(F.col("kind").isin(*kinds), F.col("kind")).otherwise("message").alias("kind"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    later = Window.partitionBy("conv_id").orderBy(F.col("seq").desc_nulls_last()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    redone = F.min(F.when(F.col("kind") == "regenerate", F.col("turn"))).over(later)
    log = log.withColumn("redone", redone).where("redone is null or turn is null or turn <= redone")
    of_turn = Window.partitionBy("conv_id", "turn").orderBy("seq", "kind", "role", "text")
    log = log.withColumn("number", F.sum((F.col("kind") == "message").cast("int")).over(of_turn.rowsBetween(Window.unboundedPreceding, 0)))
    log = log.withColumn("at", F.row_number().over(of_turn))
    own = Window.partitionBy("conv_id", "turn", "number")
    log = log.withColumn("anew", F.max(F.when(F.col("kind") != "delta", F.col("at"))).over(own))
    said = F.when(F.col("anew").isNull() | (F.col("at") >= F.col("anew")), F.col("text")).otherwise("")
    parts = F.sort_array(F.collect_list(F.struct("at", said.alias("said"), "role")))
    folded = log.groupBy("conv_id", "turn", "number").agg(parts.alias("parts"))
    return folded.select(
        "conv_id",
        "turn",
        "number",
        F.coalesce(F.try_element_at(F.filter("parts", lambda p: p.role != ""), F.lit(1)).role, F.lit("")).alias("role"),
        F.array_join(F.transform("parts", lambda p: p.said), "").alias("text"),
    )


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans, pieces) of each conversation.

    loss_spans: array of (start, length) in characters of ``formatted``. pieces: ``formatted`` as an array of
    (text, loss), a mask that can be read without counting characters.
    """
    rows = messages.select(
        "conv_id",
        "turn",
        "number",
        F.concat(F.lit(HEAD), escape(F.col("role")), F.lit(BODY)).alias("head"),
        escape(F.col("text")).alias("body"),
        (F.col("role") == "assistant").alias("loss"),
    )
    length = F.char_length("head") + F.char_length("body") + len(CLOSE)
    before = Window.partitionBy("conv_id").orderBy("turn", "number").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(length).over(before), F.lit(0)) + len(OPEN) + F.char_length("head"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "number", "head", "body", "loss", "start"))).alias("m"))
    pieces = F.flatten(
        F.transform(
            "m",
            lambda m: F.array(
                F.struct(m.head.alias("text"), F.lit(False).alias("loss")),
                F.struct(m.body.alias("text"), m.loss.alias("loss")),
                F.struct(F.lit(CLOSE).alias("text"), F.lit(False).alias("loss")),
            ),
        )
    )
    pieces = F.concat(F.array(F.struct(F.lit(OPEN).alias("text"), F.lit(False).alias("loss"))), pieces)
    spans = F.transform(
        F.filter("m", lambda m: m.loss), lambda m: F.struct(m.start.alias("start"), F.char_length(m.body).alias("length"))
    )
    return grouped.select("conv_id", spans.alias("loss_spans"), pieces.alias("pieces")).select(
        "conv_id", F.array_join(F.transform("pieces", lambda p: p.text), "").alias("formatted"), "loss_spans", "pieces"
    )


def read_back(formatted: Column) -> Column:
    """The messages that a formatted string holds: array of (role, text)."""
    inside = F.substring(formatted, len(OPEN) + 1, 2**31 - 1)
    turns = F.split(inside, CLOSE, -1)
    turns = F.slice(turns, F.lit(1), F.size(turns) - 1)
    return F.transform(
        turns,
        lambda t: F.struct(
            unescape(F.substring(F.substring_index(t, BODY, 1), len(HEAD) + 1, 2**31 - 1)).alias("role"),
            unescape(F.substring(t, F.char_length(F.substring_index(t, BODY, 1)) + len(BODY) + 1, F.lit(2**31 - 1))).alias("text"),
        ),
    )


def loss_text(pieces: Column) -> Column:
    """All text under the loss mask, as it was before escaping."""
    return F.array_join(F.transform(F.filter(pieces, lambda p: p.loss), lambda p: unescape(p.text)), "")


def format_chats(events: DataFrame) -> DataFrame:
    """Folds and renders a log: see ``fold`` and ``render``. An empty log gives no conversation; a null conv_id is one
    conversation; other columns are ignored."""
    return render(fold(events))


def messages_as_events(conversations: DataFrame) -> DataFrame:
    """A table of finished messages (conv_id, turn, role, text) as a log; rows of one turn stay apart."""
    return conversations.select(
        "conv_id", F.col("turn").alias("seq"), "turn", F.lit("message").alias("kind"), "role", "text"
    )


def as_streamed(conversations: DataFrame) -> DataFrame:
    """Finished messages (conv_id, turn, role, text) as a log of how they might have come about, latest events first.

    By a hash of conversation and place a message was written at once, streamed in three deltas, written wrongly and
    edited, or generated wrongly, answered by a next turn and then regenerated and streamed, which voids that answer; the
    last only where the turn has a number. Folding gives the messages again, rows of one turn by role and text.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    rows = conversations.select(
        "conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("said"), F.row_number().over(order).cast("long").alias("place")
    )
    way = F.pmod(F.xxhash64("conv_id", "place"), F.lit(4))
    rows = rows.withColumn("way", F.when(F.col("turn").isNull() & (way == 3), 2).otherwise(way))
    third = F.floor(F.char_length("said") / 3).cast("int")
    rows = rows.withColumns({"a": F.substring("said", F.lit(1), third), "b": F.substring("said", third + 1, third)})
    rows = rows.withColumn("c", F.substring("said", 2 * third + 1, F.lit(2**31 - 1)))
    wrong = F.reverse("said")

    def event(step: int, kind: str, text: Column, later: int = 0) -> Column:
        return F.struct(
            (F.col("place") * 8 + step).alias("seq"), (F.col("turn") + later).alias("turn"), F.lit(kind).alias("kind"),
            F.when(F.lit(kind == "message"), F.col("role")).alias("role"), text.alias("text"),
        )

    streamed = [event(n, "delta", F.col(part)) for n, part in ((6, "c"), (5, "b"), (4, "a"))]
    nothing = F.lit("")
    events = (
        F.when(F.col("way") == 0, F.array(event(0, "message", F.col("said"))))
        .when(F.col("way") == 1, F.array(*streamed, event(0, "message", nothing)))
        .when(F.col("way") == 2, F.array(event(1, "edit", F.col("said")), event(0, "message", wrong)))
        .otherwise(F.array(*streamed, event(3, "regenerate", nothing), event(2, "message", wrong, later=1), event(0, "message", wrong)))
    )
    return rows.select("conv_id", F.explode(events).alias("e")).select("conv_id", "e.*")
