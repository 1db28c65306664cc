"""Text expressions: tokens, observations, line blocks, bounded pieces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.arrays import with_starts

# The words the tokenizer drops.
STOPWORDS = (
    "a", "an", "the", "is", "are", "was", "were", "what", "who", "when", "where", "why",
    "how", "of", "to", "for", "in", "on", "at", "and", "or", "with", "about",
)

# Fixed value: characters that count as not printable (controls other than CR, LF and TAB,
# format, surrogate, private, unassigned, and separators other than the plain space).
UNPRINTABLE = r"[[\p{C}\p{Z}]&&[^ \r\n\t]]"

REPLACEMENT = "�"


_WORD = r"[\p{L}\p{N}_]"


def tokens(text: Column) -> Column:
    """Lower-cased whole ASCII-alphanumeric words without the stopwords.

    A word is a maximal run of letters, digits and underscores; runs holding anything but
    ASCII letters and digits give no token.
    """
    pattern = rf"(?<!{_WORD})[a-z0-9]++(?!{_WORD})"
    words = F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))
    return F.filter(words, lambda t: ~t.isin(*STOPWORDS))


def has_text(text: Column) -> Column:
    return F.coalesce(text.rlike(r"[^\s\x1c-\x1f\x85\p{Z}]"), F.lit(False))


def printable_ratio(text: Column) -> Column:
    n = F.length(text)
    bad = n - F.length(F.regexp_replace(text, UNPRINTABLE, ""))
    return F.when(n > 0, (n - bad) / n).otherwise(F.lit(1.0))


def replacement_ratio(text: Column) -> Column:
    n = F.length(text)
    bad = n - F.length(F.replace(text, F.lit(REPLACEMENT), F.lit("")))
    return F.when(n > 0, bad / n).otherwise(F.lit(0.0))


def explode_lines(rows: DataFrame, text: str = "text") -> DataFrame:
    """One row per LF-delimited line, in place of ``text``: ``n`` (0-based), ``piece`` (keeps
    its LF) and ``start`` (offset). No empty tail.

    Each array is its own projection, because a repeated array expression is evaluated again
    at every use.
    """
    keep = [c for c in rows.columns if c != text]
    lines = rows.select(*keep, F.split(text, "\n", -1).alias("__l"))
    last = F.size("__l") - 1
    whole = F.transform(
        "__l", lambda x, i: F.when(i < last, F.concat(x, F.lit("\n"))).otherwise(x)
    )
    kept = lines.select(*keep, F.filter(whole, lambda x: F.length(x) > 0).alias("__k"))
    placed = with_starts(kept, "__k", "__s")
    zipped = F.arrays_zip(F.col("__k").alias("piece"), F.col("__s").alias("start"))
    return placed.select(*keep, F.posexplode(zipped).alias("n", "p")).select(
        *keep, "n", "p.piece", "p.start"
    )


def explode_pieces(rows: DataFrame, pieces: str) -> DataFrame:
    """One row per element of an array without NULLs, as ``p`` in its place; no row for an empty or missing one.

    The outer form, because for the inner one the planner filters by the size of the array, below joins too, and computes
    a costly array once more for each mention.
    """
    return rows.select("*", F.explode_outer(pieces).alias("p")).drop(pieces).where("p IS NOT NULL")


def bounded_pieces(text: Column, limit: int) -> Column:
    """ARRAY<STRUCT<piece, start>>: consecutive slices of at most ``limit`` characters."""
    n = F.length(text)
    begin = F.when(
        n > 0, F.sequence(F.lit(0), F.floor((n - 1) / limit).cast("int"))
    ).otherwise(F.array().cast("array<int>"))
    return F.transform(
        begin,
        lambda k: F.struct(
            F.substring(text, k * limit + 1, F.lit(limit)).alias("piece"),
            (k * limit).cast("bigint").alias("start"),
        ),
    )


# Tokens as a vocabulary of whole words and single marks counts them.
WORD_TOKEN = r"[\p{L}\p{N}_]++|[^\p{L}\p{N}_\x09-\x0D\x20]"


def word_tokens(text: Column, extra: int = 2) -> Column:
    """A token count without a model: words and marks, and ``extra`` for the tokens around a text."""
    return F.regexp_count(text, F.lit(WORD_TOKEN)) + extra


def exact_pieces(rows: DataFrame, text: str, out: str, *, limit: int, tokens: int, count: Callable[[Column], Column] = word_tokens, extra: int = 2) -> DataFrame:
    """``rows`` with ``out``, an array of ``piece, start, lines``: exact slices under both bounds.

    A piece takes ``limit`` characters, or half as many again and again until ``count`` of it is at most ``tokens``;
    counts need not grow with the text. ``lines`` is the number of LF before it. ``count`` must not exceed the characters by more than
    ``extra``, so that every piece but the last has more than ``(tokens - extra) / 2`` characters, and the loop an end.

    The text is read once, in slices: a step holds what is left of two of them, however long the text is.
    """
    least = max(1, (min(limit, tokens - extra) + 1) // 2)
    if tokens <= extra:
        raise ValueError("no character fits the token limit")
    halvings = F.sequence(F.lit(0), F.lit(max(0, (limit - 1).bit_length())))
    piece = "piece string, start bigint, lines bigint"
    # in the state, so that the text is cut once and not wherever a slice is asked for
    zero = F.struct(
        F.regexp_extract_all(text, F.lit(f"(?s).{{1,{limit}}}"), F.lit(0)).alias("slices"), F.lit("").alias("left"), F.lit(0).alias("next"), F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("lines"),
        F.array().cast(f"array<struct<{piece.replace(' string', ':string').replace(' bigint', ':bigint')}>>").alias("out"),
    )

    def let(value: Column, body: Callable[[Column], Column]) -> Column:
        """``body`` of a value that is computed once."""
        return F.get(F.transform(F.array(value), body), F.lit(0))

    def first_fit(held: Column) -> Column:
        given = F.least(F.length(held), F.lit(limit))
        halved = lambda k: F.floor(given / F.pow(F.lit(2.0), k)).cast("int")
        fits = lambda n: (n <= tokens - extra) | (count(F.substring(held, F.lit(1), n)) <= tokens)
        soon = F.when(fits(given), given)
        for k in range(1, 4):  # most pieces are cut a few times at most; what comes later is not counted for them
            soon = soon.when(fits(halved(F.lit(k))), halved(F.lit(k)))
        late = F.transform(F.slice(halvings, 5, 64), halved)
        return soon.otherwise(F.get(F.filter(late, fits), F.lit(0)))

    def onward(state: Column, held: Column, taken: Column) -> Column:
        one = F.struct(taken.alias("piece"), state["start"].alias("start"), state["lines"].alias("lines"))
        return F.struct(
            state["slices"].alias("slices"), F.substring(held, F.length(taken) + 1, F.lit(2 * limit)).alias("left"), (state["next"] + F.when(wants(state), 1).otherwise(0)).alias("next"),
            (state["start"] + F.length(taken)).alias("start"), (state["lines"] + count_char(taken, "\n")).alias("lines"),
            F.concat(state["out"], F.array(one)).alias("out"),
        )

    def wants(state: Column) -> Column:
        return (F.length(state["left"]) < limit) & (state["next"] < F.size(state["slices"]))

    def step(state: Column, _: Column) -> Column:
        held = F.when(wants(state), F.concat(state["left"], F.get(state["slices"], state["next"]))).otherwise(state["left"])
        over = (F.length(state["left"]) == 0) & ~wants(state)
        go = let(held, lambda h: let(F.substring(h, F.lit(1), first_fit(h)), lambda t: onward(state, h, t)))
        return F.when(over, state).otherwise(go)

    n = F.coalesce(F.length(text), F.lit(0))
    steps = F.when(n > 0, F.sequence(F.lit(1), (F.floor(n / least) + 2).cast("int"))).otherwise(F.array().cast("array<int>"))
    # a text that is one piece needs no loop
    alone = F.struct(F.col(text).alias("piece"), F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("lines"))
    fits = (n > 0) & (n <= limit) & ((n <= tokens - extra) | (count(F.col(text)) <= tokens))
    return rows.withColumn(out, F.when(fits, F.array(alone)).otherwise(F.aggregate(steps, zero, step)["out"]))


def count_char(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))
