"""Chat formatting from an event log.

Messages are folded from their events (a whole message, streamed deltas, edits
and regenerations), each message on its own, so a conversation that holds most
of the log is still spread over many tasks.  Each final message becomes one
piece of the formatted conversation with its span under the loss mask; the
conversation is its pieces in order.  Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MESSAGE, DELTA, EDIT, REGENERATE = "message", "delta", "edit", "regenerate"
ASSISTANT = "assistant"
OPEN, OPENED, CLOSE = "<turn ", ">\n", "</turn>\n"


def escape(text: Column) -> Column:
    """No ``<`` or ``>`` is left, so no text can hold a control string."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))


def conversation_log(conversations: DataFrame) -> DataFrame:
    """The table's rows as an event log: each row is one whole message.

    ``message`` is (turn, place among rows of the same conversation and turn by
    role and text), so repeated rows stay messages of their own; a null turn
    comes first.
    """
    tied = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    return conversations.select(
        "conv_id",
        F.struct(F.col("turn").alias("turn"), F.row_number().over(tied).alias("place")).alias("message"),
        F.lit(0).cast("long").alias("seq"),
        F.lit(MESSAGE).alias("event"),
        "role",
        "text",
    )


def fold(log: DataFrame) -> DataFrame:
    """conv_id, message, role, text: the last state of each message.

    Columns of ``log``: conv_id, message (any ordered type), seq, event, role,
    text.  In the order of ``seq`` (ties: event, role, text), a ``message`` or an
    ``edit`` sets the text, a ``regenerate`` empties it (or starts it with its
    own text) and a ``delta`` adds to it.  The role is the last one given; null
    texts and roles count as empty.  An unknown event is ignored.
    """
    known = log.where(F.col("event").isin(MESSAGE, DELTA, EDIT, REGENERATE))
    event = F.struct(
        "seq", "event", "role", F.coalesce("text", F.lit("")).alias("text"), (F.col("event") != DELTA).alias("sets")
    )
    gathered = known.groupBy("conv_id", "message").agg(
        F.array_sort(F.collect_list(event)).alias("events"),
        F.max_by("role", F.when(F.col("role").isNotNull(), F.struct("seq", "event", "role"))).alias("role"),
    )
    last = F.coalesce(
        F.array_max(F.transform("events", lambda e, i: F.when(e["sets"], i))), F.lit(0)
    )
    tail = F.slice("events", last + 1, F.size("events"))
    return gathered.select(
        "conv_id", "message", F.coalesce("role", F.lit("")).alias("role"),
        F.array_join(F.transform(tail, lambda e: e["text"]), "").alias("text"),
    )


def render(messages: DataFrame) -> DataFrame:
    """conv_id, message, piece, loss_start, loss_end (code points in the piece).

    The formatted conversation is its pieces by ``message``.  The span is empty
    except for the assistant's text.
    """
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(OPENED))
    body = escape(F.col("text"))
    start = F.length(head)
    return messages.select(
        "conv_id",
        "message",
        F.concat(head, body, F.lit(CLOSE)).alias("piece"),
        start.alias("loss_start"),
        F.when(F.col("role") == ASSISTANT, start + F.length(body)).otherwise(start).alias("loss_end"),
    )


def parse(pieces: DataFrame) -> DataFrame:
    """Read pieces back: conv_id, message, role, text, loss_text."""
    opened = F.instr("piece", OPENED)
    body_at = opened + len(OPENED)
    head = F.substring("piece", len(OPEN) + 1, opened - len(OPEN) - 1)
    body = F.substring("piece", body_at, F.length("piece") - len(CLOSE) - body_at + 1)
    loss = F.substring("piece", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start"))
    return pieces.select(
        "conv_id",
        "message",
        F.length("piece").alias("chars"),
        unescape(head).alias("role"),
        unescape(body).alias("text"),
        F.when(F.col("loss_end") > F.col("loss_start"), unescape(loss)).otherwise(F.lit("")).alias("loss_text"),
    )


def digests(pieces: DataFrame) -> DataFrame:
    """One row for each conversation, read back from the formatted pieces.

    A digest is over one conversation's texts in order, so this step (and only
    this one) holds a conversation in one row.
    """
    turn = F.struct("message", "role", "text", "loss_text")
    gathered = parse(pieces).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(turn)).alias("turns"), F.sum("chars").cast("long").alias("formatted_chars")
    )
    everything = F.array_join(
        F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""
    )
    loss = F.array_join(F.transform("turns", lambda t: t["loss_text"]), "")
    return gathered.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(everything, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )


def format_conversations(conversations: DataFrame) -> DataFrame:
    """The formatted pieces of a table of conversations.

    Null texts and roles are empty, repeated rows are turns of their own, an
    empty table gives no rows, other columns are not read.
    """
    return render(fold(conversation_log(conversations)))
