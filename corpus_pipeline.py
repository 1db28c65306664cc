"""From raw documents to packed sequences: the operators of ``foliant.llm`` as stages over one table.

Every stage but the last returns the columns of its input. A stage's rows are written and read
again before the next, so each works on exactly what its predecessor kept.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import langid, pii
from foliant.llm.common import stage
from foliant.llm.exact_dedup import exact_dedup
from foliant.llm.minhash import minhash_dedup
from foliant.llm.packing import pack
from foliant.llm.queries import tokenizer

#: A document goes if no language is this likely. With a few languages even a mixed text is above it.
LEAST_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters or text, and those whose language stays unknown."""
    fold = langid.fold("doc_id")
    model = langid.train(docs, fold > 1, fold == 1)
    found = langid.identify(docs, model, lang_to="__lang", score_to="__score")
    known = (F.col("__lang") != langid.UNKNOWN) & (F.col("__score") >= LEAST_SCORE)
    return found.where(known).select(*docs.columns)


def _one_of_each(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose id and text are ``chosen`` (``of_id``, ``of_sha256``), one for each.

    Rows that repeat id and text are told apart by their other columns; of rows alike the smallest stays.
    """
    chosen = stage(chosen.groupBy("of_id", "of_sha256").agg(F.max("copies").alias("copies")), "chosen")
    rows = docs.withColumn("__sha256", F.sha2(F.coalesce("text", F.lit("")), 256))
    both = rows.join(chosen, F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("__sha256") == F.col("of_sha256")))
    single = both.where("copies = 1").select(*docs.columns)
    several = both.where("copies > 1").groupBy("doc_id", "__sha256").agg(F.min(F.struct(*docs.columns)).alias("row"))
    return single.unionByName(several.select("row.*"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each text, that with the largest id."""
    rows = stage(exact_dedup(docs), "copies")
    copies = rows.groupBy("doc_id", "text_sha256").agg(F.count("*").alias("copies"), F.max("kept").alias("kept"))
    return _one_of_each(docs, copies.where("kept").select(F.col("doc_id").alias("of_id"), F.col("text_sha256").alias("of_sha256"), "copies"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies (five words, 0.8), that with the smallest id.

    Documents are told apart by id and text, so one that shares its id with another is judged by its own
    text; of those that differ in nothing else the smallest text hash stays. A NULL id is smaller than any other.
    """
    keyed = docs.withColumn("__key", F.struct("doc_id", F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("md5")))
    rows = stage(minhash_dedup(keyed, id_col="__key"), "near")
    gone = stage(rows.where("NOT kept").select(F.col("doc_id").alias("of")).distinct(), "gone")
    return keyed.join(gone, keyed["__key"] == gone["of"], "left_anti").drop("__key")


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts; ``n_chars`` follows. A NULL text stays NULL."""
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    rows = docs.withColumn("__row", F.struct(*others, F.col("text").isNull().alias("__none"), *(["n_chars"] if "n_chars" in docs.columns else [])))
    found = pii.detect(rows, id_col="__row")
    out = found.select("doc_id.*", F.when(~F.col("doc_id.__none"), F.col("redacted")).alias("text"), F.size("spans").alias("__spans"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__spans") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens; ``ids`` are little-endian unsigned 32-bit numbers."""
    return pack(docs, tokenizer("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("pii", redact),
    ("packing", pack_sequences),
]

#: No SQL for models and tokenizers; tests/llm compares the stages with plain definitions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
