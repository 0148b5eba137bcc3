"""Chat logs folded into final messages and rendered with a loss mask, in DataFrame functions only.

A log is a table of events: ``message`` begins a message, ``delta`` appends to the message of its turn, ``edit``
replaces its text, ``regenerate`` clears it and drops the turns after it. Events of a conversation are ordered by
sequence number and folded by window functions, so one shuffle by conversation serves the fold and the rendering.

Template: ``<|turn|>role<|text|>text<|end|>`` per turn. In roles and texts a backslash is doubled and each control
string (these three, and those of common chat formats) gets a backslash after its first character, so no control string
is left inside a text and dropping each backslash before another character restores it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: After the first character of a control string: ours, and those of other chat formats.
_CONTROL = r"([<\[])(\|[A-Za-z_]+\|>|/?s>|/?INST\]|/?SYS>|<SYS>>|</SYS>>)"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, turn, position, role, text) of events (conv_id, seq, turn, kind, role, text).

    Sequence order decides, ties by kind, role and text. A null kind is ``message``; a null text is empty; a null role
    is kept as an empty string. A message with no event left after its last edit or regeneration is the edited text or
    empty. Repeated ``message`` events of one turn are messages of their own, in order. Rows with a null conv_id form
    a conversation. ``delta``, ``edit`` and ``regenerate`` without a message before them begin one. A null seq comes first; a
    null turn is a turn of its own, which no regeneration of another drops. An empty table gives none.
    """
    e = events.select("conv_id", "seq", "turn", F.coalesce("kind", F.lit("message")).alias("kind"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["seq", F.col("turn"), "kind", "role", "text"]
    conv = Window.partitionBy("conv_id").orderBy(*order)
    e = e.withColumn("at", F.row_number().over(conv))
    line = Window.partitionBy("conv_id", "turn").orderBy("at")
    e = e.withColumn("message", F.sum(F.when(F.col("kind") == "message", 1).otherwise(0)).over(line))
    # a regeneration of an earlier turn drops what had been said in later turns until then
    later = Window.partitionBy("conv_id").orderBy(F.col("at").desc()).rowsBetween(Window.unboundedPreceding, -1)  # from the end, so that each row adds to a running minimum
    e = e.withColumn("redone", F.min(F.when(F.col("kind") == "regenerate", F.col("turn"))).over(later)).where(F.coalesce(F.col("turn") <= F.col("redone"), F.lit(True)))
    reset = F.max(F.when(F.col("kind").isin("edit", "regenerate"), F.col("at"))).over(Window.partitionBy("conv_id", "turn", "message"))
    e = e.withColumn("reset", F.coalesce(reset, F.lit(0)))
    said = F.when(F.col("kind") == "regenerate", F.lit("")).otherwise(F.col("text"))
    live = F.when(F.col("at") >= F.col("reset"), F.struct("at", said.alias("said")))
    return (
        e.groupBy("conv_id", "turn", "message")
        .agg(F.min("at").alias("position"), F.min_by("role", "at").alias("role"), F.array_join(F.transform(F.array_sort(F.collect_list(live)), lambda x: x["said"]), "").alias("text"))
        .select("conv_id", "turn", "position", "role", "text")
    )


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss_mask: [(turn, skip, start, length)].

    A span covers one escaped text of ``loss_role``: ``start`` in code points of ``formatted``, ``skip`` in those of its
    turn. Messages are ordered by position. A conversation is one string, as its readers need it, whatever its length; a
    null role or text, as fold_events never gives, counts as empty, and no messages give no rows.
    """
    head = F.concat(F.lit(TURN), escape(F.coalesce("role", F.lit(""))), F.lit(TEXT))
    rows = messages.select("conv_id", "position", F.coalesce("role", F.lit("")).alias("role"), head.alias("head"), escape(F.coalesce("text", F.lit(""))).alias("body"))
    rows = rows.withColumns({"skip": F.length("head").cast("long"), "size": F.length("body").cast("long")})
    order = Window.partitionBy("conv_id").orderBy("position")
    rows = rows.withColumns({"turn": (F.row_number().over(order) - 1).cast("long"), "at": F.coalesce(F.sum(F.col("skip") + F.col("size") + len(END)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))})
    rows = rows.withColumn("x", F.struct("turn", F.concat("head", "body", F.lit(END)).alias("shown"), "skip", (F.col("at") + F.col("skip")).alias("start"), F.col("size").alias("length"), (F.col("role") == loss_role).alias("loss")))
    out = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    mask = F.transform(F.filter("xs", lambda x: x["loss"]), lambda x: F.struct(x["turn"].alias("turn"), x["skip"].alias("skip"), x["start"].alias("start"), x["length"].alias("length")))
    return out.select("conv_id", F.size("xs").cast("long").alias("n_turns"), F.array_join(F.transform("xs", lambda x: x["shown"]), "").alias("formatted"), mask.alias("loss_mask"))


def read_back(rendered: DataFrame) -> DataFrame:
    """From ``formatted`` and ``loss_mask`` alone: turns [(role, text)], loss_text and formatted_chars, unescaped.

    Control strings occur in ``formatted`` only as marks, so it is split at them. A null ``formatted`` gives nulls.
    """
    turns = F.split(F.col("formatted"), r"\Q" + END + r"\E")
    shown = F.slice(turns, F.lit(1), F.greatest(F.size(turns) - 1, F.lit(0)))  # what follows the last end is empty

    def parsed(x: Column) -> Column:
        role = F.substring_index(x, TEXT, 1)
        return F.struct(unescape(F.substring(role, F.lit(len(TURN) + 1), F.length(role))).alias("role"), unescape(F.substring(x, F.length(role) + len(TEXT) + 1, F.length(x))).alias("text"))

    loss = F.transform("loss_mask", lambda m: unescape(F.substring(F.get(F.col("shown"), m["turn"].cast("int")), m["skip"].cast("int") + 1, m["length"].cast("int"))))
    out = rendered.withColumn("shown", shown)
    return out.select("conv_id", F.transform("shown", parsed).alias("turns"), F.array_join(loss, "").alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))


def events_of(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as a log: each row is a ``message`` event whose sequence number is its turn."""
    return conversations.select("conv_id", F.col("turn").alias("seq"), "turn", F.lit("message").alias("kind"), "role", "text")
