"""Corpus files, vector tables, object tables, artifacts and inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions.text import has_text
from foliant.plans.ordered import last_row, running_sums


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, content, length`` of every file below ``path``."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", "content", "length")
    )


# The file types the corpus reader knows.
FILE_TYPES = (".txt", ".text", ".md")


def scan_corpus(files: DataFrame) -> DataFrame:
    """Text of known file types, strict UTF-8, blank files skipped. ``path, content`` in."""
    suffix = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    text = F.col("content").cast("string")
    return files.where(
        suffix.isin(*FILE_TYPES) & F.is_valid_utf8(text) & has_text(text)
    ).select("path", text.alias("text"), suffix.alias("file_type"))


def vector_upsert(base: DataFrame, writes: DataFrame) -> DataFrame:
    """State after a log of writes ``id, seq, ...``: the last write per id wins."""
    log = base.withColumn("seq", F.lit(-1).cast("bigint")).unionByName(writes)
    return last_row(log, ["id"], [F.col("seq")]).drop("seq")


def vector_reset(base: DataFrame) -> DataFrame:
    return base.limit(0)


def vector_list(vectors: DataFrame, where: Column) -> DataFrame:
    """Rows whose metadata match; the filter reaches the file scan."""
    return vectors.where(where)


def publish_version(corpus: DataFrame, root: str, version: str) -> bool:
    """Write one corpus version, then its marker row; an empty corpus publishes nothing."""
    if corpus.isEmpty():
        return False
    spark = corpus.sparkSession
    corpus.write.mode("errorifexists").parquet(f"{root}/corpus/version={version}")
    rows = spark.read.parquet(f"{root}/corpus/version={version}").count()
    spark.createDataFrame([(version, rows)], "version string, rows bigint").write.mode(
        "append"
    ).parquet(f"{root}/versions")
    return True


def version_gate(loaded: DataFrame, published: DataFrame, expected: DataFrame) -> DataFrame:
    """Readiness per corpus: the loaded, published and expected versions must be equal.

    Each input: ``corpus, version``.
    """
    e = expected.select("corpus", F.col("version").alias("expected"))
    p = published.select("corpus", F.col("version").alias("published"))
    m = loaded.select("corpus", F.col("version").alias("loaded"))
    return (
        e.join(m, "corpus", "left")
        .join(p, "corpus", "left")
        .select(
            "corpus",
            "expected",
            "published",
            "loaded",
            F.when(F.col("loaded").isNull(), F.lit("bm25_uninitialized"))
            .when(F.col("published").isNull(), F.lit("bm25_version_unavailable"))
            .when(
                (F.col("loaded") != F.col("expected")) | (F.col("published") != F.col("expected")),
                F.lit("bm25_version_mismatch"),
            )
            .otherwise(F.lit("ready"))
            .alias("status"),
        )
    )


def object_put(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Classify content-addressed writes ``key, sha256``: new, same or conflict.

    Two different contents for one key inside the same batch are a conflict as well.
    """
    batch = incoming.groupBy("key").agg(
        F.min("sha256").alias("low"), F.max("sha256").alias("high")
    )
    known = stored.select("key", F.col("sha256").alias("stored"))
    return (
        incoming.join(batch, "key")
        .join(known, "key", "left")
        .select(
            *incoming.columns,
            F.when(F.col("stored").isNotNull() & (F.col("stored") != F.col("sha256")), F.lit("conflict"))
            .when(F.col("stored").isNotNull(), F.lit("same"))
            .when(F.col("low") != F.col("high"), F.lit("conflict"))
            .otherwise(F.lit("new"))
            .alias("outcome"),
        )
    )


def object_verify(refs: DataFrame, objects: DataFrame) -> DataFrame:
    """Check refs ``key, scope, sha256, byte_size`` against stored ``key, scope, content``."""
    stored = objects.select(
        "key",
        F.col("scope").alias("o_scope"),
        F.sha2("content", 256).alias("o_sha"),
        F.length("content").alias("o_size"),
    )
    return refs.join(stored, "key", "left").select(
        *refs.columns,
        F.when(F.col("o_sha").isNull(), F.lit("object_not_found"))
        .when(F.col("scope") != F.col("o_scope"), F.lit("scope_mismatch"))
        .when(
            (F.col("byte_size") != F.col("o_size")) | (F.col("sha256") != F.col("o_sha")),
            F.lit("integrity_error"),
        )
        .otherwise(F.lit("ok"))
        .alias("verdict"),
    )


# JSON types, as a variant names them, that each field type takes.
_JSON_TYPES = {
    "string": "STRING", "boolean": "BOOLEAN", "tinyint": "BIGINT", "smallint": "BIGINT", "int": "BIGINT", "bigint": "BIGINT",
    "float": "BIGINT|DECIMAL.*|DOUBLE", "double": "BIGINT|DECIMAL.*|DOUBLE", "decimal": "BIGINT|DECIMAL.*|DOUBLE",
    "array": "ARRAY.*", "struct": "OBJECT.*", "map": "OBJECT.*",
}


def _typed(body: Column, schema: T.StructType) -> Column:
    value = F.try_parse_json(body)
    out = value.isNotNull()
    for f in schema.fields:
        found = F.schema_of_variant(F.variant_get(value, f"$['{f.name}']", "variant"))
        kinds = _JSON_TYPES.get(f.dataType.simpleString().split("<")[0].split("(")[0], ".*")
        out = out & F.coalesce(found, F.lit("VOID")).rlike(f"^({kinds}{'|VOID' if f.nullable else ''})$")
    return out


def decode_artifacts(raw: DataFrame, schema: T.StructType, *, max_bytes: int) -> DataFrame:
    """Strict reading of JSON artifacts in ``body``: size, syntax, duplicate and extra fields, types.

    Adds ``record`` (STRUCT) and ``reason`` (NULL when accepted). A value must have the JSON type of its
    field, nothing is converted; null is accepted for nullable fields only.
    """
    body, names = F.col("body"), F.col("__names")
    allowed = F.array(*[F.lit(f.name) for f in schema.fields])
    record = F.from_json(body, schema, {"mode": "PERMISSIVE"})
    missing = F.size(F.array_except(allowed, names)) > 0
    reason = (
        F.when(F.octet_length(body) > max_bytes, F.lit("too_large"))
        .when(names.isNull(), F.lit("malformed_json"))
        .when(F.size(names) != F.size(F.array_distinct(names)), F.lit("duplicate_field"))
        .when(F.size(F.array_except(names, allowed)) > 0, F.lit("extra_field"))
        .when(missing, F.lit("missing_field"))
        .when(~_typed(body, schema), F.lit("invalid_field"))
    )
    return (
        raw.withColumn("__names", F.json_object_keys(body))
        .withColumn("reason", reason)
        .withColumn("record", F.when(F.col("reason").isNull(), record))
        .drop("__names")
    )


def tree_inventory(files: DataFrame) -> DataFrame:
    return files.select(
        "path", F.sha2("content", 256).alias("sha256"), F.length("content").alias("byte_size")
    )


def inventory_diff(actual: DataFrame, manifest: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Full outer comparison: same, changed, missing (in the manifest only) or extra."""
    a = actual.select(*keys, F.struct(*values).alias("__a"))
    m = manifest.select(*keys, F.struct(*values).alias("__m"))
    return a.join(m, keys, "full").select(
        *keys,
        F.when(F.col("__a").isNull(), F.lit("missing"))
        .when(F.col("__m").isNull(), F.lit("extra"))
        .when(~F.col("__a").eqNullSafe(F.col("__m")), F.lit("changed"))
        .otherwise(F.lit("same"))
        .alias("status"),
    )


def capacity_gate(entries: DataFrame, keys: list[str], block: Column, order: list[Column], limit: int) -> DataFrame:
    """Append-only log with a fixed room per key: rows past the limit are refused."""
    placed = running_sums(entries, keys, block, order, {"position": F.lit(1)})
    return placed.withColumn("accepted", F.col("position") <= limit)
