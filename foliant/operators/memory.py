"""Session history: ordered messages, the last N, append and trim, clear."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.plans.ordered import top_n


def last_messages(messages: DataFrame, limit: int) -> DataFrame:
    """The newest ``limit`` messages of each session, oldest first by ``place``.

    Only the kept rows of a session reach one task; 0 gives none.
    """
    if limit <= 0:
        return messages.where(F.lit(False)).withColumn("place", F.lit(0).cast("bigint"))
    kept = top_n(messages, ["session_id"], [F.col("position").desc()], limit, "back")
    few = Window.partitionBy("session_id").orderBy("position")
    return kept.withColumn("place", F.row_number().over(few).cast("bigint")).drop("back")


def append_exchange(messages: DataFrame, exchanges: DataFrame, limit: int) -> DataFrame:
    """Add a user and an assistant message per exchange, then trim every session to ``limit``.

    ``exchanges``: ``session_id, position, query, answer`` with positions after the history's.
    """
    pair = F.explode(
        F.array(
            F.struct(F.lit(0).alias("k"), F.lit("user").alias("role"), F.col("query").alias("content")),
            F.struct(F.lit(1).alias("k"), F.lit("assistant").alias("role"), F.col("answer").alias("content")),
        )
    ).alias("m")
    added = exchanges.select("session_id", "position", pair).select(
        "session_id", (F.col("position") + F.col("m.k")).alias("position"), "m.role", "m.content"
    )
    return last_messages(messages.unionByName(added), limit)


def clear_sessions(messages: DataFrame, cleared: DataFrame) -> DataFrame:
    return messages.join(cleared.select("session_id").distinct(), "session_id", "left_anti")
