"""Exact duplicates by recipes of content-defined chunks; built-in functions only.

A text is cut where its own content says so: a chunk holds ``CHUNK_MIN`` characters and then
runs to the first anchor (a vowel or even digit, a blank, a letter or digit of the first half), or to
``CHUNK_MAX`` characters. Equal texts are cut alike, and so are long equal stretches of
different texts. A chunk's identifier is its 64-bit hash, and every identifier is verified: the
chunks are grouped by hash and content once, and a hash under which two contents are found gets
one identifier per content. Two texts are equal if and only if their ordered identifier lists are, so all
later work moves short lists instead of texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import stage, text_of

CHUNK_MIN, CHUNK_MAX = 512, 8192
ANCHOR = r"[aeiou02468][\x20\n][a-mA-M0-4]"


def chunks(text: Column, least: int = CHUNK_MIN, most: int = CHUNK_MAX) -> Column:
    """The chunks of a text in order; together they are the text. An empty text has none."""
    pattern = rf"(?s).{{{least},{most - 3}}}?{ANCHOR}|.{{1,{most}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def recipes(
    df: DataFrame, id_col: str, text_col: str, chunk_hash: Callable[[Column], Column] = F.xxhash64, **cut: int
) -> DataFrame:
    """``(row_no, doc_id, text_sha256, ids)``: one row per row, ``ids`` the verified identifiers in order."""
    rows = df.select(
        F.monotonically_increasing_id().alias("row_no"), F.col(id_col).alias("doc_id"), text_of(text_col).alias("text")
    )
    plain = stage(
        rows.select(
            "row_no", "doc_id", F.sha2("text", 256).alias("text_sha256"),
            F.transform(chunks(F.col("text"), **cut), lambda c: chunk_hash(c)).alias("ids"),
        ),
        "recipes",
    )
    pieces = rows.select("row_no", F.posexplode(chunks(F.col("text"), **cut)).alias("pos", "chunk"))
    pieces = pieces.withColumn("h", chunk_hash(F.col("chunk")))
    # the only movement of text: every distinct chunk of a task goes to its hash once
    contents = pieces.groupBy("h", "chunk").agg(F.count("*").alias("n")).groupBy("h").agg(F.count("*").alias("contents"))
    clash = stage(contents.where("contents > 1").select("h"), "clash")
    if clash.isEmpty():
        return plain
    # an identifier that stands for several contents is told apart by the content itself
    told = pieces.join(clash, "h").select("row_no", "pos", F.concat(F.lit("="), F.col("chunk")).alias("told"))
    listed = plain.select("row_no", F.posexplode("ids").alias("pos", "h")).join(told, ["row_no", "pos"], "left")
    named = listed.select("row_no", F.struct("pos", F.coalesce("told", F.col("h").cast("string")).alias("id")).alias("at"))
    named = named.groupBy("row_no").agg(F.array_sort(F.collect_list("at")).alias("at"))
    named = named.select("row_no", F.transform("at", lambda x: x["id"]).alias("ids"))
    return stage(plain.drop("ids").join(named, "row_no", "left"), "recipes")


def exact_dedup(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk_hash: Callable[[Column], Column] = F.xxhash64,
    **cut: int,
) -> DataFrame:
    """One row per row of ``df``: ``doc_id, keep_id, group_size, kept, text_sha256, n_chunks``.

    Of the rows with one text that with the largest ``doc_id`` stays. A NULL text is empty; all
    empty texts are one group. A NULL ``doc_id`` is smaller than any other. Of rows that repeat
    both text and ``doc_id``, exactly one is kept. Other columns of ``df`` are not read, so their
    names cannot clash. No rows give no rows.
    """
    lists = recipes(df, id_col, text_col, chunk_hash, **cut)
    key = F.xxhash64("ids")
    groups = lists.groupBy("ids").agg(
        F.max(F.struct("doc_id", "row_no")).alias("last"), F.count("*").alias("group_size")
    )
    groups = stage(
        groups.where("group_size > 1").select(
            key.alias("key"), F.coalesce("ids", F.array()).alias("group_ids"), "group_size",
            F.col("last.doc_id").alias("keep_id"), F.col("last.row_no").alias("keep_row"),
        ),
        "groups",
    )
    all_rows = lists.withColumn("ids", F.coalesce("ids", F.array())).withColumn("key", key)
    out = all_rows.join(groups, (all_rows["key"] == groups["key"]) & (F.col("ids") == F.col("group_ids")), "left")
    alone = F.col("group_size").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        (alone | (F.col("row_no") == F.col("keep_row"))).alias("kept"),
        "text_sha256",
        F.size("ids").cast("bigint").alias("n_chunks"),
    )
