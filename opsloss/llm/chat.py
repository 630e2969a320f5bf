"""Chat formatting from an event log, with DataFrame operations only.

A log holds one row for each event: conv_id, seq, message (any id, unique in its conversation), kind,
role, text. A conversation's events are folded in the order of seq; kinds:

* ``open``: a message of ``role`` begins; its place among the messages is this event's seq.
* ``delta``: ``text`` is appended to the message (a streamed piece).
* ``edit``: the message's text so far is replaced by ``text``; later deltas append to that.
* ``regenerate``: the message's text so far is taken back and streamed anew; messages opened after it
  and before this event are taken back with it.
* ``drop``: the message is deleted.

A message that was deleted or taken back is gone: none of its later events does anything.

``reconstruct`` partitions the log twice, since only regenerations depend on other messages. (1) By conversation: its
regenerations are sorted and folded into the stretches of the log that they take back. A regeneration has an effect if its message is still
there, that is not dropped before and not inside a stretch already taken back; a stretch that lies in a later one is
merged into it. Only regenerations, not messages or texts, meet in that fold. (2) By message: its deltas and
edits are sorted and folded from the last reset on; dropped messages and those opened inside a stretch go. ``render``
writes messages in the template, one row for each block of a conversation (messages whose places agree
after division by ``SPAN``), so that a conversation of any length is a number of bounded rows,
dealt over tasks by conversation and block. ``read_back`` parses them again.

Template: every message is ``<s>[ROLE]`` role ``[/ROLE]`` text ``</s>``. Inside roles and texts ``~``
is written ``~0``, ``<`` ``~1`` and ``[`` ``~2``, so no control string can occur there and the writing is
reversible. The loss mask is a list of spans (start, length in code points of the block's text); it
covers the written text of each assistant message and nothing else.

Defined cases: a null role or text is empty; a null kind or an unknown one is ignored; a message without
``open`` takes its first event's place and an empty role, of several opens the first counts; events that repeat a seq
within a message are folded in the order open, regenerate, edit, delta, drop, then by text; regenerations at one seq are
folded by their messages' places; messages at the same place are ordered by role, then text, repeated ones all stay; a null
conv_id is a conversation of its own; an empty log gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = 64            # places of a block
STRIDE = 1 << 12     # places between two replayed turns
TRAINED = "assistant"
PIECE = 200
LOG = "conv_id long, seq long, message long, kind string, role string, text string"


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("~"), F.lit("~0")), F.lit("<"), F.lit("~1")), F.lit("["), F.lit("~2"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("~2"), F.lit("[")), F.lit("~1"), F.lit("<")), F.lit("~0"), F.lit("~"))


STRETCH = "array<struct<from:bigint,to:bigint>>"


def _stretches(messages: DataFrame) -> DataFrame:
    """(conv_id, taken): the stretches (from, to) of each conversation with regenerations: what was opened inside, ends
    excluded, is taken back. Stretches do not overlap."""
    again = messages.filter(F.size("again") > 0).select("conv_id", "place", "dropped", F.explode("again").alias("seq"))
    again = again.filter(F.col("dropped").isNull() | (F.col("seq") <= F.col("dropped")))
    events = again.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("seq", "place"))).alias("e"))

    def step(taken: Column, e: Column) -> Column:
        gone = F.exists(taken, lambda x: (x["from"] < e["place"]) & (e["place"] < x["to"]))
        left = F.filter(taken, lambda x: x["from"] < e["place"])          # the others lie inside the new one
        return F.when(gone, taken).otherwise(F.concat(left, F.array(F.struct(
            e["place"].alias("from"), e["seq"].alias("to")))))

    return events.select("conv_id", F.aggregate("e", F.array().cast(STRETCH), step).alias("taken"))


def reconstruct(log: DataFrame) -> DataFrame:
    """(conv_id, place, role, text) of the messages that remain."""
    seq, kind = F.col("seq"), F.col("kind")
    piece = F.struct("seq", F.coalesce("text", F.lit("")).alias("text"))
    m = (log.filter(kind.isin("open", "delta", "edit", "regenerate", "drop")).groupBy("conv_id", "message").agg(
        F.coalesce(F.min(F.when(kind == "open", seq)), F.min("seq")).alias("place"),
        F.coalesce(F.min_by(F.when(kind == "open", F.col("role")), F.when(kind == "open", seq)), F.lit("")).alias("role"),
        F.collect_set(F.when(kind == "regenerate", seq)).alias("again"),
        F.min(F.when(kind == "drop", seq)).alias("dropped"),
        F.max(F.when(kind == "edit", piece)).alias("edit"),
        F.collect_list(F.when(kind == "delta", piece)).alias("pieces")))
    # an edit or a regeneration empties the text so far: only the last one and what follows it count
    last = F.greatest("edit.seq", F.array_max("again"))
    head = F.when(F.col("edit.seq") == last, F.col("edit.text")).otherwise(F.lit(""))
    left = F.filter("pieces", lambda x: last.isNull() | (x["seq"] >= last))
    text = F.concat(head, F.array_join(F.transform(F.array_sort(left), lambda x: x["text"]), ""))
    m = m.withColumn("text", text)
    taken = _stretches(m.select("conv_id", "place", "again", "dropped"))
    m = m.filter(F.col("dropped").isNull()).select("conv_id", "place", "role", "text")
    t = taken.select(F.col("conv_id").alias("c"), "taken")
    m = m.join(t, m["conv_id"].eqNullSafe(t["c"]), "left")
    gone = F.exists("taken", lambda x: (x["from"] < F.col("place")) & (F.col("place") < x["to"]))
    return m.filter(~F.coalesce(gone, F.lit(False))).select("conv_id", "place", "role", "text")


def render(messages: DataFrame, span: int = SPAN) -> DataFrame:
    """(conv_id, block, formatted, loss): the written messages of a block and its loss spans."""
    block = F.floor(F.col("place") / span)
    b = messages.groupBy("conv_id", block.alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("place", "role", "text"))).alias("m"))
    turns = F.transform("m", lambda x: F.struct(
        F.concat(F.lit("<s>[ROLE]"), escape(x["role"]), F.lit("[/ROLE]")).alias("head"),
        escape(x["text"]).alias("body"), (x["role"] == TRAINED).alias("trained")))
    b = b.select("conv_id", "block", turns.alias("t"))
    size = lambda x: F.char_length(x["head"]) + F.char_length(x["body"]) + F.lit(len("</s>"))
    spans = "array<struct<start:int,length:int>>"
    walk = F.aggregate(
        "t", F.struct(F.lit(0).alias("at"), F.array().cast(spans).alias("loss")),
        lambda acc, x: F.struct(
            (acc["at"] + size(x)).alias("at"),
            F.when(x["trained"], F.concat(acc["loss"], F.array(F.struct(
                (acc["at"] + F.char_length(x["head"])).alias("start"), F.char_length(x["body"]).alias("length")))))
            .otherwise(acc["loss"]).alias("loss")),
        lambda acc: acc["loss"])
    formatted = F.array_join(F.transform("t", lambda x: F.concat(x["head"], x["body"], F.lit("</s>"))), "")
    return b.select("conv_id", "block", formatted.alias("formatted"), walk.alias("loss"))


def read_back(blocks: DataFrame) -> DataFrame:
    """(conv_id, block, turns, masked, n_chars) of rendered rows: the turns (role, text) and the text under
    the loss mask, both unescaped."""
    parts = F.filter(F.split("formatted", "</s>"), lambda x: x != "")
    turns = F.transform(parts, lambda x: F.struct(
        unescape(F.substring_index(F.replace(x, F.lit("<s>[ROLE]"), F.lit("")), "[/ROLE]", 1)).alias("role"),
        unescape(F.substring_index(x, "[/ROLE]", -1)).alias("text")))
    masked = F.array_join(F.transform("loss", lambda s: unescape(
        F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    return blocks.select("conv_id", "block", turns.alias("turns"), masked.alias("masked"),
                         F.char_length("formatted").alias("n_chars"))


def digest(blocks: DataFrame) -> DataFrame:
    """One row for each conversation, from its rendered blocks.

    The digest runs over the whole conversation in order, so its blocks are gathered in one row of one
    task. That bounds a conversation: its roles, texts and line ends, and its assistant texts once more,
    must stay below 2^31 - 1 bytes (2 GB) together, and the task must have memory for them several times.
    ``render`` and ``read_back`` work by block and have no such limit."""
    lines = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    b = read_back(blocks).select("conv_id", "block", F.size("turns").alias("n"), lines.alias("lines"), "masked", "n_chars")
    c = b.groupBy("conv_id").agg(
        F.sum("n").cast("long").alias("n_turns"), F.sum("n_chars").cast("long").alias("formatted_chars"),
        F.array_sort(F.collect_list(F.struct("block", "lines", "masked"))).alias("b"))
    turns = F.array_join(F.transform("b", lambda x: x["lines"]), "")
    loss = F.array_join(F.transform("b", lambda x: x["masked"]), "")
    return c.select("conv_id", "n_turns", F.sha2(turns, 256).alias("turns_sha256"),
                    F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
                    "formatted_chars")


def replay(conversations: DataFrame) -> DataFrame:
    """The event log of a table of finished turns, as a chat service would have written it.

    Each row is opened and streamed in pieces of ``PIECE`` code points. By a hash of its conversation, turn and length a row also has a
    history that leads to the same end: (1) a wrong draft, edited away; (2) a wrong draft and an answer
    opened after it, both taken back by a regeneration; (3) an answer opened after it and dropped; (0) none.
    A null turn comes before all others; rows that repeat a turn are messages of their own."""
    turn = F.coalesce(F.col("turn").cast("long"), F.lit(-1))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), (turn * STRIDE).alias("at"),
        (F.monotonically_increasing_id() * 2).alias("message"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("history", F.pmod(F.xxhash64("conv_id", "at", F.char_length("text")), F.lit(4)))

    def event(step, kind, text=None, role=None, other=False):
        return F.struct((F.col("at") + step).alias("seq"), (F.col("message") + (1 if other else 0)).alias("message"),
                        F.lit(kind).alias("kind"), (F.lit(None).cast("string") if role is None else role).alias("role"),
                        (F.lit(None).cast("string") if text is None else text).alias("text"))

    piece = lambda i: F.substring(F.col("text"), i * PIECE + 1, F.lit(PIECE))
    draft, other = F.lit("a wrong draft"), F.lit("an answer to it")
    edited = F.array(event(1, "delta", draft), event(2, "edit", piece(0)))
    again = F.array(event(1, "delta", draft), event(2, "open", role=F.lit(TRAINED), other=True),
                    event(3, "delta", other, other=True), event(4, "regenerate"))
    dropped = F.array(event(1, "open", role=F.lit(TRAINED), other=True), event(2, "delta", other, other=True),
                      event(3, "drop", other=True))
    before = (F.when(F.col("history") == 1, edited).when(F.col("history") == 2, again)
              .when(F.col("history") == 3, dropped).otherwise(F.slice(edited, 1, 0)))
    # the first piece of an edited message is in its edit
    first = F.when(F.col("history") == 1, 1).otherwise(0)
    last = F.floor((F.char_length("text") + PIECE - 1) / PIECE).cast("int") - 1
    pieces = F.when(last >= first, F.transform(F.sequence(first, F.greatest(last, first)), lambda i: event(
        F.lit(5) + i, "delta", piece(i)))).otherwise(F.slice(edited, 1, 0))
    log = F.concat(F.array(event(0, "open", role=F.col("role"))), before, pieces)
    return rows.select("conv_id", F.explode(log).alias("e")).select("conv_id", "e.seq", "e.message", "e.kind", "e.role", "e.text")


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Rendered blocks of a table conv_id, turn, role, text."""
    return render(reconstruct(replay(conversations)), SPAN * STRIDE)
