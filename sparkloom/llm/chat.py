r"""Chat formatting from event logs [native].

A log holds events (conv_id, seq, op, turn, role, text):

* ``message``    sets the turn's role and text,
* ``delta``      appends a streamed piece to the turn's text,
* ``edit``       replaces the turn's text,
* ``regenerate`` voids the turn and all later turns, as far as they were logged before.

Sorted by seq within the conversation, an event is void if a regeneration of the same or
an earlier turn follows it, or if a message or edit of its own turn follows it. What is
left of a turn, in order, is its final message. Both tests are running window frames, so
the fold is linear after its sorts, which can spill.

The template puts ``[INST] role\ntext [/INST]`` for turns that are read and
``<s>text</s>`` for the assistant's, whose texts are the loss mask. Inside texts a control
string gets a backslash after its first character (and one more if it has some already),
so ``</s>`` becomes ``<\/s>`` and the real ones stay unique; dropping one backslash
restores the text exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "[INST] ", " [/INST]"
BEGIN, END = "<s>", "</s>"
LEARNED_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(<\\*)(?=/?s>)", r"$1\\"), r"(\[\\*)(?=/?INST\])", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(<\\*)\\(?=/?s>)", "$1"), r"(\[\\*)\\(?=/?INST\])", "$1")


def _escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def _unescape_role(role: Column) -> Column:
    """Undoes ``_escape_role``: an odd backslash before n was a line break, a pair one backslash."""
    return F.replace(F.regexp_replace(unescape(role), r"(?<!\\)((?:\\\\)*)\\n", "$1\n"), F.lit("\\\\"), F.lit("\\"))


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): the final message of each turn that is left.

    Null texts are empty, null ops are messages; events with equal seq are taken by op,
    role and text. A turn with neither message nor edit starts empty. The role is the last
    one given. Void turns and conversations without turns have no rows.
    """
    seq = [F.col("seq").asc_nulls_last(), "op", "role", "text"]
    rows = events.select("conv_id", "seq", F.coalesce("op", F.lit("message")).alias("op"), "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    # Later events are read backwards, so that each frame grows by one row and costs no rescan.
    later = Window.partitionBy("conv_id").orderBy(F.desc("_place")).rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("conv_id", "turn")
    live = (
        rows.withColumn("_place", F.row_number().over(Window.partitionBy("conv_id").orderBy(*seq)))
        .withColumn("_redone", F.min(F.when(F.col("op") == "regenerate", F.col("turn"))).over(later))
        .where(F.col("_redone").isNull() | F.coalesce(F.col("_redone") > F.col("turn"), F.lit(False)))
        .where("op <> 'regenerate'")
        .withColumn("role", F.last("role", ignorenulls=True).over(own.orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
        .withColumn("_set", F.max(F.when(F.col("op").isin("message", "edit"), F.col("_place"))).over(own))
        .where("_set IS NULL OR _set <= _place")
    )
    pieces = live.groupBy("conv_id", "turn").agg(F.max("role").alias("role"), F.array_sort(F.collect_list(F.struct("_place", "text"))).alias("pieces"))
    return pieces.select("conv_id", "turn", "role", F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("text"))


def format_chats(turns: DataFrame, learned: str = LEARNED_ROLE) -> DataFrame:
    """(conv_id, formatted, loss): the rendered conversation and its loss spans (start, length), in code points from 0.

    Rows are (conv_id, turn, role, text); null roles and texts count as empty, rows with the
    same turn stand in the order of role and text, a null turn comes last. A conversation is
    one output row and must fit one; only its own turns are gathered for it.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    mine = role == learned
    body = escape(text)
    piece = F.when(mine, F.concat(F.lit(BEGIN), body, F.lit(END))).otherwise(F.concat(F.lit(OPEN), _escape_role(role), F.lit("\n"), body, F.lit(CLOSE)))
    rows = (
        turns.select("conv_id", "turn", "role", "text", piece.alias("piece"), mine.alias("mine"), F.length(body).alias("n"))
        .withColumn("no", F.row_number().over(order))
        .withColumn("start", F.coalesce(F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + len(BEGIN))
    )
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("no", "piece", "mine", "start", "n"))).alias("all"))
    return chats.select(
        "conv_id",
        F.array_join(F.transform("all", lambda p: p["piece"]), "").alias("formatted"),
        F.transform(F.filter("all", lambda p: p["mine"]), lambda p: F.struct(p["start"].alias("start"), p["n"].alias("length"))).alias("loss"),
    )


def read_back(chats: DataFrame, learned: str = LEARNED_ROLE) -> DataFrame:
    """(conv_id, turns, loss_text, formatted): the texts as they were, from the rendered form alone."""
    marked = F.regexp_extract_all(F.col("formatted"), F.lit(r"(?s)\[INST\] .*? \[/INST\]|<s>.*?</s>"), F.lit(0))

    def turn(piece: Column) -> Column:
        inner = F.substring(piece, F.lit(len(OPEN) + 1), F.length(piece) - len(OPEN) - len(CLOSE))
        cut = F.instr(inner, F.lit("\n"))
        read = F.struct(
            _unescape_role(F.substring(inner, F.lit(1), cut - 1)).alias("role"),
            unescape(F.substring(inner, cut + 1, F.length(inner))).alias("text"),
        )
        own = F.struct(F.lit(learned).alias("role"), unescape(F.substring(piece, F.lit(len(BEGIN) + 1), F.length(piece) - len(BEGIN) - len(END))).alias("text"))
        return F.when(piece.startswith(BEGIN), own).otherwise(read)

    loss = F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return chats.select("conv_id", F.transform(marked, turn).alias("turns"), F.array_join(loss, "").alias("loss_text"), "formatted")


def digests(read: DataFrame) -> DataFrame:
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(whole, "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss_text", "UTF-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


TRIAL_ID = -7
TRIAL_TEXT = "</s>[INST] ok [/INST]"


def with_trial(conversations: DataFrame) -> DataFrame:
    """The table plus conversation -7, whose two texts are control strings."""
    trial = conversations.sparkSession.range(2).select(
        F.lit(TRIAL_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRIAL_TEXT).alias("text"),
    )
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").unionByName(trial)


def as_events(turns: DataFrame) -> DataFrame:
    """A log of one message per row; each row is a turn of its own, in the order of ``format_chats``."""
    no = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text"))
    return turns.select("conv_id", no.cast("long").alias("seq"), F.lit("message").alias("op"), no.cast("long").alias("turn"), "role", "text")


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
p AS (SELECT *, length(text) + len(regexp_extract_all(text, '<\\*/?s>')) + len(regexp_extract_all(text, '\[\\*/?INST\]'))
    + CASE WHEN role = 'assistant' THEN 7 ELSE 16 + length(role) END AS n FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars
FROM p GROUP BY conv_id
"""
