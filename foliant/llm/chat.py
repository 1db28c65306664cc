"""Chat training texts from logged conversations, of which many are snapshots of longer ones.

A conversation that goes on is logged again and again, each time with all turns so far. A rolling
hash covers the turns up to each one; a conversation whose hash over all its turns is also the hash
of a longer one's first turns is a snapshot, and an anti-join drops it. Of equal conversations
one stays. What is left is rendered.

The rolling hash is a prefix sum of position-dependent turn hashes, so it is computed in blocks of
turns and a conversation with a large share of all rows is no single task's work. Rendered
texts come in parts of at most ``PART`` turns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import stage
from foliant.plans.ordered import next_row, running_sums

PART = 256
_BLOCK = 1024  # turns whose hashes one task sums
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
_SUMS = [f"h{k}" for k in range(4)]


def numbered_turns(
    df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """``key, conv_id, pos, role, text, last, h0..h3``: turns in order with their rolling hashes."""
    rows = df.select(
        F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"),
        F.lower(F.trim(F.coalesce(F.col(role_col).cast("string"), F.lit("")))).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    ).distinct()
    rows = rows.withColumn("key", F.when(F.col("conv_id").isNull(), "").otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string"))))
    rows = rows.withColumn("late", F.col("turn").isNull().cast("int"))
    rows = rows.withColumn("what", F.struct("late", "turn", "role", "text"))
    # turns between two multiples of the block size are counted by one task
    block = F.when(F.col("turn").isNull(), F.lit(2**62)).otherwise(F.floor(F.col("turn") / _BLOCK))
    rows = running_sums(rows, ["key"], block, [F.col("what")], {"pos": F.lit(1)}).drop("turn", "late", "what")
    rows = stage(rows, "turns")
    # four sums of 32-bit numbers: 128 bits, and no sum of turns overflows
    hashes = [F.xxhash64(F.lit(seed), "pos", "role", "text") for seed in (1, 2)]
    parts = [f(h) for h in hashes for f in (lambda h: h.bitwiseAND(0xFFFFFFFF), lambda h: F.shiftrightunsigned(h, 32))]
    block, order = F.floor(F.col("pos") / _BLOCK), [F.col("pos")]
    rows = running_sums(rows, ["key"], block, order, dict(zip(_SUMS, parts, strict=True)))
    rows = next_row(rows, ["key"], block, order, {"after": F.col("pos")})
    return stage(rows.withColumn("last", F.col("after").isNull()).drop("after"), "rolling")


def collapse(turns: DataFrame) -> DataFrame:
    """``key, conv_id, n_turns, kept``: every conversation of ``numbered_turns``.

    Kept are those that are neither the first turns of a longer one nor equal to one with a smaller id.
    """
    whole = turns.where("last").select("key", "conv_id", F.col("pos").alias("n_turns"), *_SUMS)
    same = ["n_turns", *_SUMS]
    first = whole.groupBy(*same).agg(F.min_by("key", F.struct(F.col("conv_id").isNull(), "conv_id")).alias("key"))
    prefixes = turns.where("NOT last").select(F.col("pos").alias("n_turns"), *_SUMS).distinct()
    maximal = first.join(prefixes, same, "left_anti").select("key", F.lit(True).alias("kept"))
    return whole.select("key", "conv_id", "n_turns").join(maximal, "key", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


def render(turns: DataFrame, kept: DataFrame) -> DataFrame:
    """``key, part, turns, text``: the kept conversations in the chat template, in parts of ``PART`` turns.

    A template mark inside a role or text is broken by a backslash, so that only the template writes marks.
    """
    safe = lambda c: F.replace(c, F.lit("<|"), F.lit("<\\|"))
    line = F.concat(F.lit(OPEN), safe(F.col("role")), F.lit("\n"), safe(F.col("text")), F.lit(CLOSE + "\n"))
    chosen = turns.join(kept.select("key"), "key", "left_semi")
    lines = chosen.select("key", F.floor((F.col("pos") - 1) / PART).alias("part"), F.struct("pos", line.alias("line")).alias("at"))
    parts = lines.groupBy("key", "part").agg(F.array_sort(F.collect_list("at")).alias("at"))
    return parts.select("key", "part", F.size("at").cast("bigint").alias("turns"), F.array_join(F.transform("at", lambda x: x["line"]), "").alias("text"))


def chat_format(df: DataFrame, **columns: str) -> tuple[DataFrame, DataFrame]:
    """``(conversations, texts)``: one row per conversation with ``kept``, and the rendered parts of the kept ones.

    Turns are ordered by turn number (NULL last), then role and text; repeated rows are one turn. A NULL role or
    text is empty, roles are compared trimmed and in lower case. The rows with a NULL conversation id are one
    conversation of their own. Other columns are not read. No rows give no rows.
    """
    turns = numbered_turns(df, **columns)
    decided = stage(collapse(turns), "conversations")
    return decided, render(turns, decided.where("kept"))
