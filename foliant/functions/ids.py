"""Content-derived identities as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the URL namespace of RFC 4122.
URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"


def json_string(value: Column) -> Column:
    """A JSON string in ASCII, as compact canonical JSON writes it."""

    def escape(run: Column) -> Column:
        units = F.lower(F.hex(F.encode(run, "UTF-16BE")))
        return (
            F.when(run.rlike(r"^[\x20-\x7f]"), run)
            .when(F.length(units) > 4, F.concat(F.lit("\\u"), F.substring(units, 1, 4),
                                                F.lit("\\u"), F.substring(units, 5, 4)))
            .otherwise(F.concat(F.lit("\\u"), units))
        )

    # what stays as it is comes in runs, and only the other characters one by one
    runs = lambda text: F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"(?s)[\x20-\x7f]+|."), F.lit(0)), escape), "")
    let = lambda one, body: F.get(F.transform(F.array(one), body), F.lit(0))

    def marked(plain: Column) -> Column:
        for ch, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("\b", "\\b"), ("\f", "\\f")):
            plain = F.replace(plain, F.lit(ch), F.lit(escaped))
        return let(plain, lambda text: F.when(text.rlike(r"[^\x20-\x7f]"), runs(text)).otherwise(text))

    # most texts hold nothing to escape, and one look tells
    once = let(value.cast("string"), lambda text: F.when(text.rlike(r'[^\x20-\x7f]|["\\]'), marked(text)).otherwise(text))
    return F.concat(F.lit('"'), once, F.lit('"'))


def json_array(*parts: Column) -> Column:
    return F.concat(F.lit("["), F.concat_ws(",", *parts), F.lit("]"))


def json_object(fields: dict[str, Column]) -> Column:
    """Sorted keys, no blanks. Values are JSON text already; NULL becomes ``null``."""
    items = [
        F.concat(F.lit(f'"{k}":'), F.coalesce(fields[k], F.lit("null"))) for k in sorted(fields)
    ]
    return F.concat(F.lit("{"), F.concat_ws(",", *items), F.lit("}"))


def name_uuid(name: Column) -> Column:
    """Name-based (version 5) UUID in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE)), F.encode(name, "UTF-8")))
    variant = F.substring(
        F.lit("89ab"), (F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4) + 1, F.lit(1)
    )
    return F.concat(
        F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3),
        F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12),
    )


def stable_id(*parts: Column) -> Column:
    """UUID of the compact JSON array of the parts."""
    return name_uuid(json_array(*[json_string(p) for p in parts]))


def fingerprint(canonical: Column) -> Column:
    """SHA-256 of canonical JSON text."""
    return F.sha2(canonical, 256)


def session_key(*parts: Column) -> Column:
    """Isolated session name: hash of the canonical scope and session parts."""
    return F.sha2(json_array(*[json_string(p) for p in parts]), 256)
