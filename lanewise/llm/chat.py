"""Chat formatting with Spark expressions only: turns to one text with a loss mask, and back.

Turns of a conversation are collected as structs and sorted. Places where the
role changes cut the sorted array into runs; each run is merged into one block
under one header, its texts joined behind end marks::

    ### User: first text</turn>second text of the same role</turn>
    ### Assistant: answer</turn>

Backslashes, end marks and header marks inside texts are escaped by a backslash,
so that both marks occur in the output only where the template puts them. All
array steps are linear in the turns. A conversation becomes one text, which
bounds its size by that of a cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The template.
HEADER = "### "
COLON = ": "
END = "</turn>"
HIDDEN_HEADER = r"\###"
HIDDEN_END = r"<\/turn>"
TITLES = {"system": "System", "user": "User", "assistant": "Assistant"}
OTHER = "role="
LEARNED = "assistant"


def escaped(text: Column) -> Column:
    """The text without marks: every backslash in it stands before a character that is meant as such."""
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit(END), F.lit(HIDDEN_END))
    return F.replace(text, F.lit("###"), F.lit(HIDDEN_HEADER))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _title(role: Column) -> Column:
    known = F.lit(None).cast("string")
    for name, title in TITLES.items():
        known = F.when(role == name, F.lit(title)).otherwise(known)
    return F.coalesce(known, F.concat(F.lit(OTHER), F.url_encode(role)))


def _role(title: Column) -> Column:
    found = F.url_decode(F.substring(title, len(OTHER) + 1, 1 << 30))
    for name, known in TITLES.items():
        found = F.when(title == known, F.lit(name)).otherwise(found)
    return found


def formatted(
    turns: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """One row per conversation: conv_id, formatted, segments ``array<struct<text, loss>>``.

    The segments spell ``formatted``; those with ``loss`` are the escaped texts
    of the assistant, and only these. Turns are in the order of ``turn``, null
    first, then of role and text; rows that repeat are turns of their own. A
    null role or text counts as empty. Roles other than the three known ones
    are written URL-encoded. Rows without a conversation id form one of their
    own, with a null id. An empty table has no conversation. Other columns are
    not read.
    """
    rows = turns.select(
        F.col(conv_id).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        ).alias("turn"),
    )
    sorted_turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    places = F.sequence(F.lit(0), F.size("turns") - 1)
    changes = F.filter(
        places, lambda i: (i == 0) | (F.get(F.col("turns"), i)["role"] != F.get(F.col("turns"), i - 1)["role"])
    )
    cut = sorted_turns.withColumn("starts", changes)

    def run(start: Column, nth: Column) -> Column:
        following = F.coalesce(F.get(F.col("starts"), nth + 1), F.size("turns"))
        return F.struct(
            F.get(F.col("turns"), start)["role"].alias("role"),
            (nth > 0).alias("later"),
            F.transform(F.slice("turns", start + 1, following - start), lambda t: escaped(t["text"])).alias("texts"),
        )

    def segment(content: Column, loss: Column) -> Column:
        return F.struct(content.alias("text"), loss.alias("loss"))

    def block(of: Column) -> Column:
        header = F.concat(F.when(of["later"], F.lit("\n" + HEADER)).otherwise(F.lit(HEADER)), _title(of["role"]), F.lit(COLON))
        learned = of["role"] == LEARNED
        texts = F.transform(of["texts"], lambda t: F.array(segment(t, learned), segment(F.lit(END), F.lit(False))))
        return F.concat(F.array(segment(header, F.lit(False))), F.flatten(texts))

    merged = cut.select("conv_id", F.transform("starts", run).alias("runs"))
    laid = merged.select("conv_id", F.flatten(F.transform("runs", block)).alias("segments"))
    return laid.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def turns_of(text: Column) -> Column:
    """The turns that a formatted text holds, as ``array<struct<role, text>>``."""

    def of_run(run: Column) -> Column:
        halves = F.split(run, COLON, 2)
        parts = F.split(F.get(halves, 1), END, -1)
        texts = F.slice(parts, 1, F.size(parts) - 1)
        return F.transform(texts, lambda t: F.struct(_role(F.get(halves, 0)).alias("role"), unescaped(t).alias("text")))

    runs = F.split(F.substring(text, len(HEADER) + 1, (1 << 31) - 1), "\n" + HEADER, -1)
    return F.flatten(F.transform(runs, of_run))


def learned_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing in between."""
    under = F.filter(segments, lambda s: s["loss"])
    return F.array_join(F.transform(under, lambda s: unescaped(s["text"])), "")


def digests(chats: DataFrame) -> DataFrame:
    """What is read back from ``formatted`` rows: counts and SHA-256 digests of their turns and learned texts."""
    read = chats.select(
        "conv_id",
        turns_of(F.col("formatted")).alias("turns"),
        learned_text(F.col("segments")).alias("learned"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
    spelled = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(spelled, ""), 256).alias("turns_sha256"),
        F.length("learned").cast("long").alias("loss_chars"),
        F.sha2(F.col("learned"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def with_marks(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """The turns with conversation -7, whose two texts hold every mark of the template."""
    marks = F.lit(r"\### Assistant: </turn> ok")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), marks.alias("text")
    )
    return turns.select("conv_id", "turn", "role", "text").unionByName(planted)
