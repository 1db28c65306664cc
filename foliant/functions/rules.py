"""Ordered rules as column expressions: routing, policy, classification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that choose a model role, in order of precedence.
ROLE_WORDS = (
    ("coding", ("python", "code", "programming", "debug", "algorithm")),
    ("summarization", ("summarize", "summary", "shorten")),
    ("fast", ("quick", "fast")),
)


def role_route(query: Column) -> Column:
    """Substring match on the lower-cased query; the first role that matches wins."""
    text = F.lower(query)
    out = None
    for role, words in ROLE_WORDS:
        hit = text.rlike("|".join(words))
        out = F.when(hit, F.lit(role)) if out is None else out.when(hit, F.lit(role))
    return out.otherwise(F.lit("general"))


def tool_dispatch(query: Column) -> Column:
    text = F.lower(query)
    return (
        F.when(text.contains("time"), F.lit("current_time"))
        .when(text.rlike(r"[+\-*/]"), F.lit("calculate"))
        .otherwise(F.lit("unavailable"))
    )


def quality_policy(
    *,
    parser_failed: Column,
    has_text: Column,
    has_images: Column,
    has_graphics: Column,
    replacement_ratio: Column,
    printable_ratio: Column,
    structure_required: Column,
) -> Column:
    """STRUCT<outcome, next_tier, reason>; the first rule that holds decides."""

    def row(outcome: str, tier: str, reason: str) -> Column:
        return F.struct(
            F.lit(outcome).alias("outcome"), F.lit(tier).alias("next_tier"),
            F.lit(reason).alias("reason"),
        )

    bad_text = (replacement_ratio > 0) | (has_text & (printable_ratio < 1))
    return (
        F.when(parser_failed, row("failed", "none", "parser_failure"))
        .when(~has_text & has_images, row("ocr_required", "ocr", "image_without_text"))
        .when(bad_text, row("manual_review", "none", "unusable_text"))
        .when(has_text & structure_required, row("layout_required", "layout", "structure_requested"))
        .when(has_text, row("native_accepted", "native", "native_text"))
        .when(
            has_graphics.isNull() | has_graphics, row("manual_review", "none", "unresolved_graphics")
        )
        .otherwise(row("native_accepted", "native", "blank"))
    )


def retry_delay(
    key: Column, attempt: Column, *, base: float = 1.0, cap: float = 60.0, jitter: float = 0.0
) -> Column:
    """Capped doubling times a jitter in [1-jitter, 1] that only the key and attempt decide."""
    from foliant.functions.ids import fingerprint, json_array, json_string

    digest = fingerprint(json_array(json_string(key), attempt.cast("string")))
    share = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(0xFFFFFFFF)
    grown = F.lit(float(base)) * F.pow(F.lit(2.0), (attempt - 1).cast("double"))
    return F.least(F.lit(float(cap)), grown) * (1 - F.lit(float(jitter)) * share)


# The closed set of failure categories, of documents and of stages.
DOCUMENT_CATEGORIES = (
    "unsupported_format", "invalid_document", "encrypted_document", "source_too_large",
    "page_limit_exceeded", "extraction_limit_exceeded", "extraction_failed", "integrity_error",
    "storage_error", "object_conflict", "object_not_found", "scope_mismatch",
    "serialization_error", "invalid_reference",
)
STAGE_CATEGORIES = (
    "idempotency_conflict", "invalid_transition", "job_not_found", "step_not_found",
    "lease_conflict", "stale_fence", "lease_expired", "retry_exhausted", "cancelled",
    "ledger_error", "dispatch_error", "manifest_conflict", "invalid_configuration",
    "schema_mismatch", "worker_interrupted", "worker_failed", "profile_mismatch",
    "inference_rate_limited", "inference_timeout", "inference_unavailable",
    "inference_authentication", "inference_configuration", "inference_invalid_response",
    "inference_context_exceeded", "inference_output_limit", "inference_unknown",
    "governance_denied", "security_denied",
)


def sanitized_category(category: Column) -> Column:
    return F.when(category.isin(*DOCUMENT_CATEGORIES, *STAGE_CATEGORIES), category).otherwise(F.lit("worker_failed"))


def failure_class(category: Column, transient_storage: Column) -> Column:
    """RETRYABLE, NON_RETRYABLE or CANCELLED."""
    known = sanitized_category(category)
    return (
        F.when(known == "cancelled", F.lit("CANCELLED"))
        .when(known == "worker_interrupted", F.lit("RETRYABLE"))
        .when((known == "storage_error") & transient_storage, F.lit("RETRYABLE"))
        .otherwise(F.lit("NON_RETRYABLE"))
    )


def provider_error(status: Column) -> Column:
    """Category of a provider HTTP status; no status means no connection."""
    return (
        F.when(status.isNull(), F.lit("provider_unreachable"))
        .when(status.isin(401, 403), F.lit("authentication_failure"))
        .when(status == 404, F.lit("model_unavailable"))
        .when(status.isin(408, 504), F.lit("timeout"))
        .when(status.isin(429, 502, 503), F.lit("overloaded"))
        .otherwise(F.lit("provider_error"))
    )


def application_status(category: Column) -> Column:
    down = ("provider_unreachable", "timeout", "authentication_failure", "overloaded",
            "model_unavailable")
    return F.when(category.isin(*down), F.lit(503)).otherwise(F.lit(502))


def vector_error(exception: Column, operation: Column) -> Column:
    """Category of a vector-store failure by exception name and operation."""
    return (
        F.when(exception == "TimeoutError", F.lit("vector_timeout"))
        .when(exception.isin("ConnectionError", "OSError"), F.lit("vector_unreachable"))
        .when(exception.isin("KeyError", "TypeError", "ValueError", "IndexError"),
              F.lit("vector_protocol"))
        .when(exception.isin("NotFoundError", "InvalidCollectionException"),
              F.lit("collection_unavailable"))
        .when(operation.isin("upsert", "reset"), F.lit("vector_write_failure"))
        .otherwise(F.lit("vector_query_failure"))
    )


def token_count(raw: Column) -> Column:
    """A reported token count: a whole number >= 0, or NULL. Unknown never becomes zero."""
    n = F.when(raw.rlike(r"^-?[0-9]{1,18}$"), raw).try_cast("bigint")
    return F.when(n >= 0, n)
