"""Chat transcripts folded from an event log and rendered with a loss mask, in Spark SQL functions only.

Events are (conv_id, sequence, message, kind, role, text). Each conversation is a partition of the log
in the order of its sequence:

- start: a message of this role begins, empty.
- delta: streamed text goes to the end of the message.
- edit: this text takes the place of all of the message's so far; later deltas follow it.
- regenerate: the message is empty again, and every message that began after it, so far, is withdrawn.

fold() replays that with one window sort and two grouped aggregates: an event is void where a later
reset of its message follows, and a message is withdrawn where some earlier one was regenerated after
its start. render() turns messages into segments, of which the ones under the loss mask are marked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: A turn is TURN role ROLE_END text TURN_END; texts and roles are escaped so that none of these occurs in them.
TURN, ROLE_END, TURN_END = "<s>[INST]", "[/INST]", "</s>"

#: What the control strings are made of begins so: a backslash is put behind it, and behind each backslash.
_CONTROL = r"(\\|<(?=/?s>)|\[(?=/?INST\]))"
_ESCAPED = r"(\\|<(?=\\/?s>)|\[(?=\\/?INST\]))\\"

EVENTS = "conv_id long, sequence long, message long, kind string, role string, text string"


def escape(text: Column) -> Column:
    """Text without control strings: `</s>` becomes `<\\/s>`, `[INST]` `[\\INST]` and a backslash two."""
    return F.regexp_replace(text, _CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    """What escape() has been given."""
    return F.regexp_replace(text, _ESCAPED, "$1")


def events_of(turns: DataFrame) -> DataFrame:
    """The log of finished conversations (conv_id, turn, role, text): each row starts a message, each line of it is a delta.

    Rows go by turn (null first), then role and text; rows that repeat all three are messages of their own.
    """
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = turns.select("conv_id", F.row_number().over(w).cast("long").alias("message"), "role", F.coalesce("text", F.lit("")).alias("text"))
    lines = F.transform(F.split("text", r"(?<=\n)"), lambda line: F.struct(F.lit("delta").alias("kind"), F.lit(None).cast("string").alias("role"), line.alias("text")))
    start = F.struct(F.lit("start").alias("kind"), F.col("role"), F.lit(None).cast("string").alias("text"))
    each = numbered.select("conv_id", "message", F.posexplode(F.concat(F.array(start), lines)).alias("at", "event"))
    # messages are 2^32 apart in the sequence; a text has fewer lines
    return each.select("conv_id", (F.shiftleft("message", 32) + F.col("at")).alias("sequence"), "message", "event.kind", "event.role", "event.text")


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, message, began, role, text): the messages that stand at the end of each conversation's log.

    Order is by sequence, null first, then start, regenerate, edit, delta, then role and text; an event that is
    there twice happens twice. A null conv_id or message is an id like any other; null texts are empty; a null role stays null, and
    the last start gives the role. A message begins at its first event, whatever that is, and events count
    even for a withdrawn message. Events of other kinds are passed over. No events give no messages.

    Events are reduced to their message before messages meet their conversation.
    """
    rank = F.array_position(F.array(*map(F.lit, ("start", "regenerate", "edit", "delta"))), F.col("kind"))
    known = events.select("conv_id", "message", "kind", "role", F.coalesce("text", F.lit("")).alias("text"), F.struct(F.col("sequence"), rank.alias("rank"), F.col("role").alias("r"), F.col("text").alias("t")).alias("order")).where(F.col("order.rank") > 0)
    w = Window.partitionBy("conv_id").orderBy("order")
    placed = known.withColumn("at", F.row_number().over(w)).drop("order")
    reset = F.max(F.when(F.col("kind") != "delta", F.col("at")))
    said = F.array_sort(F.collect_list(F.struct("at", F.when(F.col("kind").isin("delta", "edit"), F.col("text")).otherwise("").alias("text"))))
    messages = placed.groupBy("conv_id", "message").agg(F.min("at").alias("began"), reset.alias("reset"), F.max(F.when(F.col("kind") == "regenerate", F.col("at"))).alias("again"), F.max_by(F.col("role"), F.when(F.col("kind") == "start", F.col("at"))).alias("role"), said.alias("said"))
    withdrawn = F.max("again").over(Window.partitionBy("conv_id").orderBy("began").rowsBetween(Window.unboundedPreceding, -1))
    standing = messages.withColumn("withdrawn", withdrawn).where("withdrawn IS NULL OR withdrawn < began")
    lasting = F.filter("said", lambda e: e["at"] >= F.coalesce("reset", F.lit(0)))
    return standing.select("conv_id", "message", "began", "role", F.array_join(F.transform(lasting, lambda e: e["text"]), "").alias("text"))


def render(messages: DataFrame, learn: str = "assistant") -> DataFrame:
    """(conv_id, segments): each conversation as the segments (start, text, loss) whose texts, joined, are the formatted string.

    start: code points before the segment. loss: the segment is the text of a turn whose role is `learn`; there
    is one for each such turn, maybe empty, and its turn's end is not in it. Null roles and texts are
    empty. Turns are rendered one by one; only then a conversation is put together, in one row, so it is bounded by what a Spark string holds.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    head = F.concat(F.lit(TURN), escape(role), F.lit(ROLE_END))
    turns = messages.select("conv_id", "began", head.alias("head"), escape(text).alias("body"), (role == learn).alias("loss"))
    w = Window.partitionBy("conv_id").orderBy("began")
    size = F.length("head") + F.length("body") + len(TURN_END)
    placed = turns.withColumn("start", F.sum(size).over(w) - size)
    after = F.col("start") + F.length("head")

    def segment(start: Column, text: Column, loss: Column) -> Column:
        return F.struct(start.cast("long").alias("start"), text.alias("text"), loss.alias("loss"))

    parts = F.array(segment(F.col("start"), F.col("head"), F.lit(False)), segment(after, F.col("body"), F.col("loss")), segment(after + F.length("body"), F.lit(TURN_END), F.lit(False)))
    ordered = F.array_sort(F.collect_list(F.struct("began", parts.alias("parts"))))
    return placed.groupBy("conv_id").agg(ordered.alias("turns")).select("conv_id", F.flatten(F.transform("turns", lambda t: t["parts"])).alias("segments"))


def formatted(segments: Column | str) -> Column:
    """The formatted string."""
    return F.array_join(F.transform(segments, lambda s: s["text"]), "")


def read_back(rendered: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text, formatted): what a rendered conversation says.

    turns (role, text) are parsed from the formatted string alone; loss_text is the text under the loss mask. Both are unescaped.
    """
    whole = rendered.select("conv_id", formatted("segments").alias("formatted"), F.filter("segments", lambda s: s["loss"]).alias("masked"))
    pieces = F.split("formatted", F.lit(TURN_END))  # the last piece is what follows the last turn: nothing

    def parsed(piece: Column) -> Column:
        cut = F.instr(piece, ROLE_END)
        role = F.substring(piece, F.lit(len(TURN) + 1), cut - len(TURN) - 1)
        return F.struct(unescape(role).alias("role"), unescape(F.substring(piece, cut + len(ROLE_END), F.length(piece))).alias("text"))

    turns = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), parsed)
    loss = F.array_join(F.transform("masked", lambda s: unescape(s["text"])), "")
    return whole.select("conv_id", turns.alias("turns"), loss.alias("loss_text"), "formatted")


def digests(read: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of what read_back() gives."""
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
