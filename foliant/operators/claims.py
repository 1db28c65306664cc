"""Aliases, claim decoding and envelope sizes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions.ids import json_string



def alias_table(members: DataFrame, keys: list[str], value: str, prefix: str) -> DataFrame:
    """E1..En per request: sorted distinct values with their local alias.

    A request's table is bounded by its own size limit; the distinct step combines map-side.
    """
    w = Window.partitionBy(*keys).orderBy(value)
    return members.select(*keys, value).distinct().withColumn(
        "alias", F.concat(F.lit(prefix), F.row_number().over(w).cast("string"))
    )


def decode_aliases(refs: DataFrame, aliases: DataFrame, keys: list[str], value: str) -> DataFrame:
    """References back to values; foreign aliases and repeats are refused.

    ``refs``: ``keys + [position, alias]``. Adds ``value`` and ``verdict``.
    """
    repeats = refs.groupBy(*keys, "alias").agg(F.count(F.lit(1)).alias("times"))
    return (
        refs.join(repeats, [*keys, "alias"])
        .join(aliases, [*keys, "alias"], "left")
        .select(
            *keys,
            "position",
            "alias",
            value,
            F.when(F.col(value).isNull(), F.lit("foreign_reference"))
            .when(F.col("times") > 1, F.lit("duplicate_reference"))
            .otherwise(F.lit("ok"))
            .alias("verdict"),
        )
    )


# The enumerations of a claim.
KINDS = ("fact", "unknown", "unsupported", "commentary", "structural")
STATUSES = ("supported", "unknown", "unsupported")
STANCES = ("affirmed", "denied", "unknown")

CLAIM = T.StructType(
    [
        T.StructField("claim_id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("stance", T.StringType()),
        T.StructField("subject", T.StringType()),
        T.StructField("evidence", T.ArrayType(T.StringType())),
    ]
)


def claim_reasons(claims: DataFrame, body: Column, *, max_text: int) -> DataFrame:
    """Add ``reason``: why a claim's JSON is refused, or NULL. The list of reasons is closed.

    The text is parsed once per row; the first rule that fails names the reason.
    """
    fields = F.array(*[F.lit(f.name) for f in CLAIM.fields])
    parsed = claims.withColumn("__body", body).withColumns(
        {"__names": F.json_object_keys("__body"), "__c": F.from_json("__body", CLAIM)}
    )
    names, c = F.col("__names"), F.col("__c")
    token = c["subject"].rlike(r"^[A-Za-z0-9_./:-]{1,128}$")
    uuid = c["claim_id"].rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")
    reason = (
        F.when(names.isNull(), F.lit("malformed_json"))
        .when(F.size(names) != F.size(F.array_distinct(names)), F.lit("duplicate_json_key"))
        .when(
            ~F.coalesce(uuid, F.lit(False)) & F.array_contains(names, "claim_id"),
            F.lit("invalid_uuid"),
        )
        .when(c["subject"].isNotNull() & ~token, F.lit("invalid_subject_token"))
        .when(
            c["text"].isNotNull() & ~F.length(c["text"]).between(1, max_text),
            F.lit("invalid_text_bound"),
        )
        .when(F.size(F.array_except(fields, names)) > 0, F.lit("missing_required_field"))
        .when(c["text"].isNull() | c["evidence"].isNull(), F.lit("invalid_field_type"))
        .when(F.size(F.array_except(names, fields)) > 0, F.lit("forbidden_extra_field"))
        .when(
            ~(c["kind"].isin(*KINDS) & c["status"].isin(*STATUSES) & c["stance"].isin(*STANCES)),
            F.lit("invalid_enum"),
        )
        .when(c["subject"].isNotNull() & (c["kind"] != "fact"), F.lit("subject_on_nonfact"))
    )
    return parsed.withColumn("reason", reason).drop("__body", "__names", "__c")


def escaped_size(value: Column) -> Column:
    """Bytes a text needs inside a JSON string that is itself inside a JSON string."""
    # the outer string only doubles the marks of the inner one
    marked = lambda text: 2 * F.length(text) - F.length(F.translate(text, '"\\', ""))
    return F.get(F.transform(F.array(json_string(value)), marked), F.lit(0))


def envelope_sizes(pieces: DataFrame, keys: list[str], base: int, per_piece: int) -> DataFrame:
    """Upper bound of a request envelope: base, escaped texts and a fixed part per piece."""
    return (
        pieces.withColumn("size", escaped_size(F.col("text")))
        .groupBy(*keys)
        .agg(
            (F.lit(base) + F.sum("size") + F.count(F.lit(1)) * per_piece).alias("envelope_bytes"),
            F.count(F.lit(1)).alias("pieces"),
        )
    )


