"""Chat formatting from an event log, in DataFrame functions only.

The log holds one row for each event: conv_id, seq, msg (the message it is about), kind, role, text.
Kinds: ``message`` sets a message, ``delta`` appends to it, ``edit`` replaces its text, ``regenerate``
empties it and drops what the conversation had said after it, ``delete`` removes it. Events of a
conversation are folded in the order of seq: of each message only the events from its last reset on
count, and those of later messages only if they came after the regeneration. An event that was delivered
again (the same conv_id and seq) counts once.

``render`` joins the messages by a template of control strings. Inside roles and texts a control
string cannot occur: backslashes, ``<|`` and (in roles) line ends are escaped, and ``unescape`` takes
that back. The loss mask is a list of (start, length) in code points, one span for each assistant
text. ``read_back`` parses the formatted string again.

Everything is dealt once, by conversation; a conversation becomes one string by contract, so its rows
meet in one task.

``as_events`` writes the log that a service would have kept of finished conversations: answers come as an
opening and streamed deltas, some of them after a draft that an edit replaces or that is regenerated, some
with a follow-up that the regeneration discards, and some events are delivered twice.

Defined results: null text and role are empty strings; a null conv_id is a conversation of its own; texts
of any length are kept whole; rows of one turn are ordered by role and text, repeated rows stay repeated
turns; of different events with one conv_id and seq the least by message, kind, role and text counts;
extra columns are ignored; an empty log gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
RESETS = ("message", "edit", "regenerate", "delete")


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(text, F.lit("\\"), F.lit("\\0")), F.lit("<|"), F.lit("\\1"))
    return F.replace(out, F.lit("\n"), F.lit("\\2")) if role else out


def unescape(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("\\1"), F.lit("<|")), F.lit("\\2"), F.lit("\n"))
    return F.replace(out, F.lit("\\0"), F.lit("\\"))


def fold(events: DataFrame) -> DataFrame:
    """conv_id, msg, role, text: the messages that a conversation ends with."""
    by_message = Window.partitionBy("conv_id", "msg").orderBy("seq")
    whole_message = Window.partitionBy("conv_id", "msg")
    earlier = Window.partitionBy("conv_id").orderBy("msg").rangeBetween(Window.unboundedPreceding, -1)
    arrival = Window.partitionBy("conv_id").orderBy("seq", "msg", "kind", "role", "text")
    log = (
        events.select("conv_id", "seq", "msg", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .withColumn("before", F.lag("seq").over(arrival))
        .where(F.col("before").isNull() | (F.col("before") != F.col("seq")))
        .drop("before")
        .withColumn("cut", F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).over(earlier))
        .where(F.col("cut").isNull() | (F.col("seq") > F.col("cut")))
        .withColumn("epoch", F.count(F.when(F.col("kind").isin(*RESETS), 1)).over(by_message))
        .withColumn("last", F.max("epoch").over(whole_message))
        .withColumn("speaker", F.last(F.when(F.col("role") != "", F.col("role")), ignorenulls=True).over(whole_message))
        .where(F.col("epoch") == F.col("last"))
    )
    parts = F.array_sort(F.collect_list(F.struct("seq", F.when(F.col("kind").isin("regenerate", "delete"), F.lit("")).otherwise(F.col("text")).alias("text"))))
    return (
        log.groupBy("conv_id", "msg")
        .agg(F.max(F.coalesce("speaker", F.lit(""))).alias("role"), parts.alias("parts"), F.max(F.col("kind") == "delete").alias("gone"))
        .where(~F.col("gone"))
        .select("conv_id", "msg", "role", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))
    )


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, mask: the conversation as one string and the spans of its assistant texts."""
    order = Window.partitionBy("conv_id").orderBy("msg").rowsBetween(Window.unboundedPreceding, -1)
    head = F.concat(F.lit(START), escape(F.col("role"), role=True), F.lit("\n"))
    turns = (
        messages.withColumn("head", head)
        .withColumn("body", escape(F.col("text")))
        .withColumn("start", F.coalesce(F.sum(F.length("head") + F.length("body") + F.lit(len(END))).over(order), F.lit(0)) + F.length("head"))
    )
    span = F.when(F.col("role") == "assistant", F.struct(F.col("start").cast("long").alias("start"), F.length("body").cast("long").alias("length")))
    return (
        turns.groupBy("conv_id")
        .agg(
            F.array_sort(F.collect_list(F.struct("msg", F.concat("head", "body", F.lit(END)).alias("turn")))).alias("turns"),
            F.array_sort(F.collect_list(span)).alias("mask"),
        )
        .select("conv_id", F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"), "mask")
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role and text, unescaped), loss (all text under the mask), formatted."""
    pieces = F.split("formatted", r"<\|im_end\|>\n")
    inner = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.substr(p, F.lit(len(START) + 1)))
    turns = F.transform(
        inner,
        lambda p: F.struct(
            unescape(F.substring_index(p, "\n", 1)).alias("role"),
            unescape(F.substr(p, F.instr(p, "\n") + 1)).alias("text"),
        ),
    )
    loss = F.array_join(F.transform("mask", lambda s: unescape(F.substr("formatted", (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    return formatted.select("conv_id", turns.alias("turns"), loss.alias("loss"), "formatted")


# What drafts and discarded follow-ups of the derived log say.
DRAFT, FOLLOW_UP = "draft: ", "and what if"


def _streamed(text: Column, first: Column, size: int = 3) -> list[Column]:
    """A text as the opening of a message and two deltas, cut in thirds; seq from first."""
    third = F.ceil(F.length(text) / size).cast("int")
    cuts = [F.substr(text, F.lit(1) + third * k, third) for k in range(size)]
    return [_event(first + k, "message" if k == 0 else "delta", t) for k, t in enumerate(cuts)]


def _event(seq: Column, kind: str, text: Column, later: int = 0) -> Column:
    return F.struct(seq.cast("long").alias("seq"), F.lit(later).alias("later"), F.lit(kind).alias("kind"), text.alias("text"))


def as_events(conversations: DataFrame) -> DataFrame:
    """The event log of conversations (conv_id, turn, role, text), turns in the order of turn, role and text.

    Messages have even numbers and twelve places of seq each. By the digest of its text, an answer is streamed
    at once, after a draft that is edited, or after a regeneration that also discards a follow-up of the user."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    placed = rows.withColumn("n", F.row_number().over(order).cast("long"))
    text, at = F.col("text"), F.col("n") * 12
    draft = F.concat(F.lit(DRAFT), F.substr(text, F.lit(1), F.lit(40)))
    streamed = _streamed(text, at)
    once = F.array(*streamed, streamed[2])  # the last delta is delivered twice
    edited = F.array(_event(at, "message", draft), _event(at + 1, "delta", F.lit(" ...")), _event(at + 2, "edit", text), _event(at, "message", draft))
    again = [_event(at + 4 + k, "delta", t["text"]) for k, t in enumerate(_streamed(text, at))]
    redone = F.array(_event(at, "message", draft), _event(at + 1, "delta", F.lit(" ...")), _event(at + 2, "message", F.lit(FOLLOW_UP), 1), _event(at + 3, "regenerate", F.lit("")), *again)
    way = F.pmod(F.crc32(text.cast("binary")), F.lit(3))
    log = F.when(F.col("role") != "assistant", F.array(_event(at, "message", text))).when(way == 0, once).when(way == 1, edited).otherwise(redone)
    return placed.select("conv_id", "n", "role", F.explode(log).alias("e")).select(
        "conv_id", "e.seq", (F.col("n") * 2 + F.col("e.later")).alias("msg"), "e.kind",
        F.when(F.col("e.later") == 1, "user").when(F.col("e.kind") == "message", F.col("role")).alias("role"), "e.text",
    )


def digests(read: DataFrame) -> DataFrame:
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
