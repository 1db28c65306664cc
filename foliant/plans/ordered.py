"""Ordered operators that stay parallel when one key holds most of the rows.

A plain window sends all rows of a key to one task. The helpers here cut each key into
blocks (a time bucket, a position range), work inside (key, block), and carry one row per
block across blocks. The rows of a hot key are spread over as many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.plans.session import cut_lineage, parts_for

BLOCK = "__block"
SIDE = "__side"


@dataclass(frozen=True)
class Scan:
    """One ordered output: ``sum``, ``max``, ``last`` (non-NULL), ``prev`` or ``next``.

    ``within`` limits what is carried into a block to earlier blocks with the same value; it
    must be constant inside a block.
    """

    kind: str
    value: Column
    inclusive: bool = True
    within: Column | None = None


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    block: Column,
    order: Sequence[Column],
    outputs: Mapping[str, Scan],
    parts: int | None = None,
) -> DataFrame:
    """All ordered outputs in one pass: one aggregate per block, whose carried row opens (or ends) the next one.

    ``block`` must not decrease along ``order``. Asking for several outputs at once reads the
    input twice in total, whereas chained calls would double it each time. With ``parts`` the rows are dealt into that many
    tasks, see :func:`foliant.plans.session.parts_for`.
    """
    base = df.withColumn(BLOCK, block)
    part = [*keys, BLOCK]
    spread_by = (lambda rows, *by: rows.repartition(parts, *by)) if parts and keys else (lambda rows, *by: rows)
    position = F.struct(*order)
    totals = spread_by(base, *part).groupBy(*part).agg(
        *[_block_total(s, position).alias(f"__t_{n}") for n, s in outputs.items()],
        *[F.min(s.within).alias(f"__w_{n}") for n, s in outputs.items() if s.within is not None],
    )
    carry = spread_by(totals, *keys).select(*part, *[_carried(n, s, keys).alias(f"__c_{n}") for n, s in outputs.items()])
    # a carried row comes before those of its block, that of a next row after them
    sides = [-1, 1] if any(s.kind == "next" for s in outputs.values()) else [-1]
    carry = carry.withColumn(SIDE, F.explode(F.array(*map(F.lit, sides))))
    both = spread_by(base.withColumn(SIDE, F.lit(0)).unionByName(carry, allowMissingColumns=True), *part)
    local = Window.partitionBy(*part).orderBy(SIDE, *order)
    found = both.select(*df.columns, SIDE, *[_merged(n, s, local).alias(n) for n, s in outputs.items()])
    return found.where(F.col(SIDE) == 0).drop(SIDE)


def _block_total(s: Scan, position: Column) -> Column:
    if s.kind == "sum":
        return F.sum(s.value)
    if s.kind == "max":
        return F.max(s.value)
    if s.kind == "last":
        return F.max_by(s.value, F.when(s.value.isNotNull(), position))
    pick = F.max_by if s.kind == "prev" else F.min_by
    return pick(F.struct(s.value.alias("v")), position)


def _carried(n: str, s: Scan, keys: Sequence[str]) -> Column:
    scope = [*keys, f"__w_{n}"] if s.within is not None else list(keys)
    across = Window.partitionBy(*scope).orderBy(BLOCK)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    total = F.col(f"__t_{n}")
    if s.kind == "sum":
        return F.sum(total).over(before)
    if s.kind == "max":
        return F.max(total).over(before)
    if s.kind == "last":
        return F.last(total, ignorenulls=True).over(before)
    return (F.lag if s.kind == "prev" else F.lead)(total).over(across)


def _merged(n: str, s: Scan, local) -> Column:
    if s.kind in ("prev", "next"):
        near = F.when(F.col(SIDE) == 0, F.struct(s.value.alias("v"))).otherwise(F.col(f"__c_{n}"))
        return (F.lag if s.kind == "prev" else F.lead)(near).over(local)["v"]
    value = F.when(F.col(SIDE) == 0, s.value).otherwise(F.col(f"__c_{n}"))
    rows = local.rowsBetween(Window.unboundedPreceding, Window.currentRow if s.inclusive else -1)
    if s.kind == "sum":
        return F.coalesce(F.sum(value).over(rows), F.lit(0))
    return F.max(value).over(rows) if s.kind == "max" else F.last(value, ignorenulls=True).over(rows)


def join_on(left: DataFrame, right: DataFrame, names: Sequence[str], how: str = "left") -> DataFrame:
    """Join on keys that may be NULL; NULL meets NULL."""
    renamed = right.select(
        *[F.col(n).alias(f"__r_{n}") for n in names],
        *[c for c in right.columns if c not in names],
    )
    cond = None
    for n in names:
        part = F.col(n).eqNullSafe(F.col(f"__r_{n}"))
        cond = part if cond is None else cond & part
    return left.join(renamed, cond, how).drop(*[f"__r_{n}" for n in names])


def running_sums(df, keys, block, order, sums: Mapping[str, Column], *, inclusive=True) -> DataFrame:
    """Prefix sums per key, in order; ``inclusive=False`` leaves out the current row."""
    return ordered_scan(
        df, keys, block, order, {n: Scan("sum", v, inclusive) for n, v in sums.items()}
    )


def carry_forward(df, keys, block, order, values: Mapping[str, Column]) -> DataFrame:
    """Latest non-NULL value at or before each row (as-of fill)."""
    return ordered_scan(df, keys, block, order, {n: Scan("last", v) for n, v in values.items()})


def previous_row(df, keys, block, order, values: Mapping[str, Column]) -> DataFrame:
    """``lag`` by one row, across block edges."""
    return ordered_scan(df, keys, block, order, {n: Scan("prev", v) for n, v in values.items()})


def next_row(df, keys, block, order, values: Mapping[str, Column]) -> DataFrame:
    """``lead`` by one row, across block edges."""
    return ordered_scan(df, keys, block, order, {n: Scan("next", v) for n, v in values.items()})


def live_sums(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    identity: str,
    block: int,
    live: Mapping[str, tuple[Column, Column]],
    scans: Mapping[str, tuple[Column, Callable[[Column], Column] | None]] | None = None,
) -> DataFrame:
    """What is live before each row: one sweep over start and end marks, one ordered scan.

    ``live`` maps an output to ``(amount, end)``: the amount counts from the row's ``time`` until ``end`` (NULL: for
    ever), which frees its place before a start at the same moment. A sliding window is an end at ``time +
    width``. ``scans`` adds plain sums ``(amount, within)`` over the earlier rows, ``within`` a function of the time.
    """
    ends = list(dict.fromkeys(str(end) for _, end in live.values()))
    column = {str(end): end for _, end in live.values()}
    others = [c for c in df.columns if c not in (*keys, identity)]
    amounts = {n: F.coalesce(a, F.lit(0)) for n, (a, _) in live.items()}
    lasting = {n: e.isNull() | (e > F.col(time)) for n, (_, e) in live.items()}
    scans = scans or {}
    starts = df.select(
        "*", F.col(time).alias("__at"), F.lit(1).alias("__kind"),
        *[F.when(lasting[n], amounts[n]).otherwise(0).alias(f"__{n}") for n in live],
        *[a.alias(f"__{n}") for n, (a, _) in scans.items()],
    )
    marks = [starts]
    for name in ends:
        end = column[name]
        marks.append(
            df.where(end > F.col(time)).select(
                *keys, identity, *[F.lit(None).cast(df.schema[c].dataType).alias(c) for c in others],
                end.alias("__at"), F.lit(0).alias("__kind"),
                *[(-amounts[n] if str(e) == name else F.lit(0)).cast(starts.schema[f"__{n}"].dataType).alias(f"__{n}") for n, (_, e) in live.items()],
                *[F.lit(None).cast(starts.schema[f"__{n}"].dataType).alias(f"__{n}") for n in scans],
            ).select(*starts.columns)
        )
    both = marks[0]
    for m in marks[1:]:
        both = both.unionByName(m)
    outputs = {n: Scan("sum", F.col(f"__{n}"), inclusive=False) for n in live}
    outputs |= {n: Scan("sum", F.col(f"__{n}"), False, w(F.col("__at")) if w else None) for n, (_, w) in scans.items()}
    order = [F.col("__at"), F.col("__kind"), F.col(identity)]
    # the scan reads its input twice; what made it is not run again
    both = cut_lineage(both)
    swept = ordered_scan(both, keys, F.floor(F.col("__at") / block), order, outputs, parts_for(both))
    return swept.where("__kind = 1").select(*df.columns, *live, *scans)


def sliding_sums(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    identity: str,
    width: int,
    sums: Mapping[str, Column],
) -> DataFrame:
    """Sums over the earlier rows with ``time > t - width``, the current row left out.

    Equal times are ordered by ``identity``. Each row is also shown to the next time block,
    so a window never needs rows of another task and a hot key is cut along time.
    """
    flagged = df.withColumn(BLOCK, F.floor(F.col(time) / width)).withColumn(
        "__own", F.explode(F.array(F.lit(0), F.lit(1)))
    )
    both = flagged.withColumn(BLOCK, F.col(BLOCK) + F.col("__own"))
    part = [*keys, BLOCK]
    seen = Window.partitionBy(*part).orderBy(time).rangeBetween(-(width - 1), 0)
    later = (
        Window.partitionBy(*part, time).orderBy(identity).rowsBetween(0, Window.unboundedFollowing)
    )
    zero = F.lit(0)
    return (
        both.select(
            *df.columns,
            "__own",
            *[
                (F.coalesce(F.sum(v).over(seen), zero) - F.coalesce(F.sum(v).over(later), zero)).alias(n)
                for n, v in sums.items()
            ],
        )
        .where("__own = 0")
        .drop("__own")
    )


def top_n(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str = "rank"
) -> DataFrame:
    """First ``n`` rows per key with a 1-based rank.

    Catalyst turns the rank filter into a group limit before the shuffle, so a hot key
    sends at most ``n`` rows per map task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the smallest in order: an aggregate with a map-side combine."""
    rest = [c for c in df.columns if c not in keys]
    picked = F.min_by(F.struct(*rest), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(picked).select(*keys, *[F.col("__row")[c].alias(c) for c in rest])


def last_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the largest in order."""
    rest = [c for c in df.columns if c not in keys]
    picked = F.max_by(F.struct(*rest), F.struct(*order)).alias("__row")
    return df.groupBy(*keys).agg(picked).select(*keys, *[F.col("__row")[c].alias(c) for c in rest])


def whole_groups(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str
) -> DataFrame:
    """``fn`` over frames of many whole groups at once, each group contiguous and in order.

    The frame has a column ``__key``, one text per group. A grouped map would call ``fn`` once for every
    group; with small groups that is most of the time. Groups must be of bounded size.
    """
    named = df.withColumn("__key", F.to_json(F.struct(*keys)))
    sorted_rows = named.repartition("__key").sortWithinPartitions("__key", *order)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for frame in frames:
            frame = frame if held is None else pd.concat([held, frame], ignore_index=True)
            keys_here = frame["__key"].to_numpy()
            cut = int((keys_here == keys_here[-1]).argmax()) if len(frame) else 0  # the last group may go on
            held = frame.iloc[cut:]
            if cut:
                yield fn(frame.iloc[:cut])
        if held is not None and len(held):
            yield fn(held)

    return sorted_rows.mapInPandas(run, schema)


def group_bounds(frame: pd.DataFrame) -> list[tuple[int, int]]:
    """``(first, end)`` of each group in a frame of :func:`whole_groups`."""
    key = frame["__key"].to_numpy()
    edges = [0, *((key[1:] != key[:-1]).nonzero()[0] + 1).tolist(), len(key)]
    return list(zip(edges[:-1], edges[1:], strict=True)) if len(key) else []
