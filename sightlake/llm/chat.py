"""Dialogues rendered once from the view of every participant.

Method: perspective rotation. Each participant of a conversation (any role but ``system``) is the
assistant of one rendering; the other speakers are users under their names, system turns stay
system turns. Only what the assistant says, with its closing mark, is to be learned: its
character spans are the mask.

Turns are joined with the conversation's participants and concatenated in two steps, pieces of
``PIECE_TURNS`` turn numbers first, so that a very long conversation is rendered by many tasks and
only its finished pieces meet.

Defined results: turns are ordered by number (NULL last), then role and text; repeated rows are
repeated turns; a NULL role is the speaker ``unknown``, NULL text is empty; marks inside a text
are broken by a space (``<|`` to ``< |``) so that no text can forge a turn; names keep word
characters, others become ``_``; conversations with system turns only have no rendering; rows
with a NULL conversation id form one conversation.
"""

from pyspark.sql import DataFrame, functions as F

OPEN, CLOSE = "<|turn|>", "<|end|>"
SYSTEM, UNKNOWN = "system", "unknown"
PIECE_TURNS = 512


def rotations(conversations: DataFrame, piece_turns: int = PIECE_TURNS) -> DataFrame:
    """One row per conversation and participant: conv_id, perspective, n_turns, rendered, spans
    (array of start and stop, in characters of ``rendered``), trained_chars."""
    turns = conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit(UNKNOWN)).alias("speaker"),
        F.replace(F.coalesce("text", F.lit("")), F.lit("<|"), F.lit("< |")).alias("said"),
    )
    people = turns.filter(F.col("speaker") != SYSTEM).select(F.col("conv_id").alias("_conv"), F.col("speaker").alias("perspective")).distinct()
    own = F.col("speaker") == F.col("perspective")
    head = (
        F.when(own, F.lit("assistant")).when(F.col("speaker") == SYSTEM, F.lit("system"))
        .otherwise(F.concat(F.lit("user name="), F.regexp_replace("speaker", r"\W", "_")))
    )
    lines = (
        turns.join(people, F.col("conv_id").eqNullSafe(F.col("_conv")))
        .select(
            "conv_id", "perspective", F.floor(F.col("turn") / piece_turns).alias("piece"), "turn", "speaker", "said", own.alias("own"),
            F.concat(F.lit(OPEN), head, F.lit("\n")).alias("head"), F.concat("said", F.lit(CLOSE)).alias("body"),
        )
    )
    shown = F.struct(
        F.col("turn").isNull().alias("last"), "turn", "speaker", "said", "own", "head", "body"
    )
    pieces = lines.groupBy("conv_id", "perspective", "piece").agg(F.array_sort(F.collect_list(shown)).alias("turns"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,stop:bigint>>").alias("spans"))

    def add(done, turn):
        begin = done["at"] + F.length(turn["head"])
        stop = begin + F.length(turn["body"])
        mine = F.when(turn["own"], F.array(F.struct(begin.alias("start"), stop.alias("stop")))).otherwise(F.array().cast("array<struct<start:bigint,stop:bigint>>"))
        return F.struct((stop + 1).cast("long").alias("at"), F.concat(done["spans"], mine).alias("spans"))

    written = pieces.select(
        "conv_id", "perspective", "piece", F.size("turns").cast("long").alias("n"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit("\n"))), "").alias("rendered"),
        F.aggregate("turns", start, add).alias("walked"),
    )
    ordered = F.array_sort(F.collect_list(F.struct(
        F.col("piece").isNull().alias("last"), "piece", "rendered", F.col("walked.at").alias("length"), F.col("walked.spans").alias("spans"), "n"
    )))
    whole = written.groupBy("conv_id", "perspective").agg(F.sum("n").alias("n_turns"), ordered.alias("pieces"))

    def place(done, piece):
        moved = F.transform(piece["spans"], lambda s: F.struct((s["start"] + done["at"]).alias("start"), (s["stop"] + done["at"]).alias("stop")))
        return F.struct((done["at"] + piece["length"]).cast("long").alias("at"), F.concat(done["spans"], moved).alias("spans"))

    spans = F.aggregate("pieces", start, place, lambda done: done["spans"])
    placed = whole.select("conv_id", "perspective", "n_turns", F.array_join("pieces.rendered", "").alias("rendered"), spans.alias("spans"))
    return placed.withColumn("trained_chars", F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"]))


def rotation_report(conversations: DataFrame) -> DataFrame:
    """``rotations`` with the mask as text ("start-stop,...")."""
    mask = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["stop"].cast("string"))), ",")
    return rotations(conversations).select("conv_id", "perspective", "n_turns", "rendered", mask.alias("mask"), "trained_chars")
