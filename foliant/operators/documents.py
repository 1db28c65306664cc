"""Document intake, blocks, spans and records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as tx
from foliant.functions.ids import stable_id
from foliant.plans.ordered import carry_forward, previous_row

POSITION_BLOCK = 4096


def admit(files: DataFrame, *, max_bytes: int, max_characters: int) -> DataFrame:
    """Admission of raw files ``path, declared_mime, content BINARY``.

    Adds ``detected_mime`` and ``reject_reason`` (NULL when accepted); the first failed check
    names the reason.
    """
    content = F.col("content")
    size = F.length(content)
    detected = F.when(
        F.substring(content, 1, 5) == F.lit(b"%PDF-"), F.lit("application/pdf")
    ).otherwise(F.lit("text/plain"))
    name = F.element_at(F.split(F.replace(F.col("path"), F.lit("\\"), F.lit("/")), "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1))
    expected = F.when(suffix == ".pdf", F.lit("application/pdf")).when(
        suffix == ".txt", F.lit("text/plain")
    )
    text = content.cast("string")
    plain = F.col("detected_mime") == "text/plain"
    agree = (
        F.col("declared_mime").isin("application/pdf", "text/plain")
        & (F.col("declared_mime") == F.col("detected_mime"))
        & ((suffix == "") | expected.eqNullSafe(F.col("detected_mime")))
    )
    valid = F.is_valid_utf8(text)
    reason = (
        F.when(size > max_bytes, F.lit("source_too_large"))
        .when(F.coalesce(size, F.lit(0)) == 0, F.lit("invalid_document"))
        .when(~F.coalesce(agree, F.lit(False)), F.lit("unsupported_format"))
        .when(plain & ~valid, F.lit("invalid_document"))
        .when(
            plain & (~tx.has_text(text) | text.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f]")),
            F.lit("invalid_document"),
        )
        .when(plain & (F.length(text) > max_characters), F.lit("extraction_limit_exceeded"))
    )
    return files.withColumn("detected_mime", detected).withColumn("reject_reason", reason)


def page_inventory(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """Every ordinal 1..page_count of each document, with its state.

    ``pages``: ``document_id, ordinal, failed``; ``documents``: ``document_id, page_count``.
    """
    wanted = documents.where("page_count > 0").select(
        "document_id", F.explode(F.sequence(F.lit(1), F.col("page_count").cast("int"))).alias("ordinal")
    )
    return wanted.join(pages, ["document_id", "ordinal"], "left").select(
        "document_id",
        "ordinal",
        F.when(F.col("failed").isNull(), F.lit("missing"))
        .when(F.col("failed"), F.lit("failed"))
        .otherwise(F.lit("present"))
        .alias("state"),
    )


def observations(units: DataFrame) -> DataFrame:
    """Character count, printable and replacement ratios, native-text flag. Adds columns."""
    t = F.col("text")
    return units.select(
        "*",
        F.length(t).alias("character_count"),
        tx.printable_ratio(t).alias("printable_ratio"),
        tx.replacement_ratio(t).alias("replacement_ratio"),
        tx.has_text(t).alias("has_native_text"),
    )


def split_blocks(units: DataFrame) -> DataFrame:
    """LF-delimited blocks with exact half-open spans and 1-based lines; no shuffle.

    ``units``: ``document_id, text``. CR stays in the text, an empty tail gives no block.
    """
    return tx.explode_lines(units.select("document_id", "text")).select(
        "document_id",
        F.col("n").cast("bigint").alias("reading_order"),
        F.col("piece").alias("text"),
        "start",
        (F.col("start") + F.length("piece")).alias("end"),
        (F.col("n") + 1).cast("bigint").alias("line"),
    )


def check_spans(spans: DataFrame, units: DataFrame) -> DataFrame:
    """``span_ok``: the unit's text between start and end equals the stored text."""
    cut = F.substring(
        F.col("unit_text"), (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")
    )
    return (
        spans.join(units.select("document_id", F.col("text").alias("unit_text")), "document_id", "left")
        .withColumn("span_ok", F.coalesce(cut == F.col("text"), F.lit(False)))
        .drop("unit_text")
    )


def check_blocks(blocks: DataFrame, units: DataFrame) -> DataFrame:
    """Per document: blocks contiguous, in order, covering the text, with unique ids and lines.

    ``blocks``: ``document_id, block_id, reading_order, start, end, line_start, text``.
    """
    spans = blocks.select(
        "document_id", "block_id", "reading_order", "start", "end", "line_start",
        (F.col("line_start") + tx.count_char(F.col("text"), "\n")).alias("line_after"),
    )
    near = previous_row(
        spans,
        ["document_id"],
        F.floor(F.col("reading_order") / POSITION_BLOCK),
        [F.col("reading_order"), F.col("block_id")],
        {
            "p_end": F.col("end"),
            "p_order": F.col("reading_order"),
            "p_line": F.col("line_after"),
        },
    )
    first = F.col("p_order").isNull()
    checked = near.select(
        "document_id",
        "block_id",
        "end",
        (F.col("start") != F.coalesce("p_end", F.lit(0))).alias("gap"),
        (F.col("reading_order") != F.coalesce(F.col("p_order") + 1, F.lit(0))).alias("disorder"),
        (F.col("line_start") != F.when(first, F.lit(1)).otherwise(F.col("p_line"))).alias("line_off"),
    )
    ids = blocks.groupBy("document_id", "block_id").agg(F.count(F.lit(1)).alias("n"))
    repeated = ids.groupBy("document_id").agg(F.max("n").alias("most"))
    facts = checked.groupBy("document_id").agg(
        F.count(F.lit(1)).alias("blocks"),
        F.max("end").alias("covered"),
        F.bool_or("gap").alias("gap"),
        F.bool_or("disorder").alias("disorder"),
        F.bool_or("line_off").alias("line_off"),
    )
    sized = units.select("document_id", F.length("text").cast("bigint").alias("chars"))
    return (
        sized.join(facts, "document_id", "left")
        .join(repeated, "document_id", "left")
        .select(
            "document_id",
            F.coalesce("blocks", F.lit(0)).alias("blocks"),
            F.when(F.col("most") > 1, F.lit("duplicate_block"))
            .when(F.col("disorder"), F.lit("reading_order"))
            .when(F.col("gap"), F.lit("not_contiguous"))
            .when(F.coalesce("covered", F.lit(0)) != F.col("chars"), F.lit("not_covering"))
            .when(F.col("line_off"), F.lit("line_numbers"))
            .otherwise(F.lit("ok"))
            .alias("verdict"),
        )
    )


def resolve_evidence(evidence: DataFrame, blocks: DataFrame) -> DataFrame:
    """Evidence spans against their blocks: known block, same version and extraction, contained.

    Both sides carry ``block_id, version, extraction``; equi join on the block, then the range.
    """
    b = blocks.select(
        "block_id", *[F.col(c).alias(f"b_{c}") for c in ("version", "extraction", "start", "end", "text")]
    )
    inside = (
        (F.col("start") >= F.col("b_start")) & (F.col("end") <= F.col("b_end")) & (F.col("start") < F.col("end"))
    )
    return evidence.join(b, "block_id", "left").select(
        *evidence.columns,
        F.when(F.col("b_version").isNull(), F.lit("unknown_block"))
        .when(F.col("version") != F.col("b_version"), F.lit("other_version"))
        .when(F.col("extraction") != F.col("b_extraction"), F.lit("other_extraction"))
        .when(~inside, F.lit("outside_block"))
        .otherwise(F.lit("ok"))
        .alias("verdict"),
        F.when(
            inside,
            F.substring(
                F.col("b_text"), (F.col("start") - F.col("b_start") + 1).cast("int"),
                (F.col("end") - F.col("start")).cast("int"),
            ),
        ).alias("excerpt"),
    )


def offsets_to_lines(offsets: DataFrame, blocks: DataFrame) -> DataFrame:
    """1-based line of each ``document_id, offset``: an as-of fill over the line starts."""
    marks = blocks.select(
        "document_id", F.col("start").alias("offset"), F.lit(0).alias("asked"), F.col("line")
    )
    asks = offsets.select(
        "document_id", "offset", F.lit(1).alias("asked"), F.lit(None).cast("bigint").alias("line")
    )
    filled = carry_forward(
        marks.unionByName(asks),
        ["document_id"],
        F.floor(F.col("offset") / 65536),
        [F.col("offset"), F.col("asked")],
        {"found": F.col("line")},
    )
    return filled.where("asked = 1").select("document_id", "offset", F.col("found").alias("line"))


def build_records(
    blocks: DataFrame, included: DataFrame | None, paths: DataFrame | None, limit: int = 4096, tokens: int = 240, count: Callable[[Column], Column] = tx.word_tokens
) -> DataFrame:
    """Retrieval records of the included blocks: pieces within both bounds, with lines, path and id.

    ``blocks``: ``document_id, block_id, kind, text, start, line``; ``included``: ``block_id``;
    ``paths``: ``block_id, path``; ``count`` counts the tokens of a text. All per-piece values come from the block's own row.
    Without ``included`` all blocks are; without ``paths`` the blocks carry their ``path``. Then nothing is shuffled.
    """
    kept = blocks if included is None else blocks.join(included.select("block_id").distinct(), "block_id", "left_semi")
    owned = kept if paths is None else kept.join(paths, "block_id", "left")
    split = tx.exact_pieces(owned, "text", "__pieces", limit=limit, tokens=tokens, count=count)
    parts = tx.explode_pieces(split, "__pieces")
    line = F.col("line") + F.col("p.lines")
    body = F.rtrim(F.col("p.piece"), F.lit("\n"))
    begin = F.col("start") + F.col("p.start")
    return parts.select(
        stable_id(F.col("document_id"), F.col("block_id"), begin, F.sha2("p.piece", 256)).alias("record_id"),
        "document_id",
        "block_id",
        F.col("p.piece").alias("text"),
        begin.alias("start"),
        (begin + F.length("p.piece")).alias("end"),
        line.alias("line_start"),
        (line + tx.count_char(body, "\n")).alias("line_end"),
        F.coalesce("path", F.lit("")).alias("path"),
        F.when(F.col("kind").isin("table", "figure"), F.lit("uninterpreted_visual"))
        .otherwise(F.lit("none"))
        .alias("limitation"),
    )


def piece_limitation(kind: Column, parsed: Column, whole: Column) -> Column:
    """visual_uninterpreted, hard_split or none."""
    return (
        F.when(kind.isin("table", "figure") & ~parsed, F.lit("visual_uninterpreted"))
        .when(~whole, F.lit("hard_split"))
        .otherwise(F.lit("none"))
    )


def allowlist(sources: DataFrame, approvals: DataFrame, pages: DataFrame, *, max_bytes: int) -> DataFrame:
    """Sources whose owner and hash have an approval, within size, with every page accepted.

    Reasons: not_approved, source_too_large, page_refused, NULL when accepted.
    """
    verdict = pages.groupBy("document_id").agg(F.bool_and("accepted").alias("pages_ok"))
    known = approvals.select("owner", "sha256", F.lit(True).alias("approved")).distinct()
    return (
        sources.join(known, ["owner", "sha256"], "left")
        .join(verdict, "document_id", "left")
        .select(
            *sources.columns,
            F.when(F.col("approved").isNull(), F.lit("not_approved"))
            .when((F.col("byte_size") > max_bytes) | (F.col("byte_size") == 0), F.lit("source_too_large"))
            .when(~F.coalesce("pages_ok", F.lit(False)), F.lit("page_refused"))
            .alias("reject_reason"),
        )
    )
