"""Structured Streaming operators. Event time in, a 10-minute watermark unless stated."""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foliant.operators.telemetry import BOUNDS, bucket_index
from foliant.plans.ordered import previous_row, running_sums

LATENESS = "10 minutes"


def _timer(ms: int) -> str:
    return GroupStateTimeout.ProcessingTimeTimeout if ms else GroupStateTimeout.NoTimeout


def _millis(times: pd.Series) -> list[int]:
    return times.astype("datetime64[ms]").astype("int64").tolist()


# ---- responses -------------------------------------------------------------------------

def assemble_responses(events: DataFrame, time: str, idle_ms: int = 3_600_000, lateness: str = LATENESS) -> DataFrame:
    """Join the chunks of each request, in order of ``seq``; ``error`` ends a request without a row.

    ``events``: ``request_id BIGINT, seq BIGINT, type, content`` and an event ``time``. Chunks may come after
    ``done`` and in any order: the row leaves, and the state with it, once the watermark has passed the event that
    ended the request. A request with no news for ``idle_ms`` of event time is dropped.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts, end, last = json.loads(state.get[0]) if state.exists else ([], None, 0)
        if state.hasTimedOut:
            state.remove()
            if end and end[1] == "done":
                told = [text for seq, text in sorted(parts) if seq < end[0]]
                yield pd.DataFrame({"request_id": [key[0]], "response": ["".join(told)], "chunks": [len(told)]})
            return
        for frame in batches:
            for seq, kind, content, at in zip(frame["seq"], frame["type"], frame["content"], _millis(frame[time])):
                if kind == "chunk":
                    parts.append([int(seq), content or ""])
                elif kind in ("done", "error") and (end is None or seq < end[0]):
                    end = [int(seq), kind, at]
                last = max(last, at)
        state.update((json.dumps([parts, end, last]),))
        due = end[2] if end else last + idle_ms
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))

    return events.withWatermark(time, lateness).groupBy("request_id").applyInPandasWithState(
        step, "request_id bigint, response string, chunks bigint", "held string", "append", GroupStateTimeout.EventTimeTimeout,
    )


def assemble_batch(events: DataFrame) -> DataFrame:
    """The same result over a finished table; one response's chunks are bounded by its size."""
    ends = events.where(F.col("type").isin("done", "error")).groupBy("request_id").agg(
        F.min_by("type", "seq").alias("end"), F.min("seq").alias("end_seq")
    )
    done = ends.where("end = 'done'").select("request_id", "end_seq")
    chunks = (
        events.where("type = 'chunk'")
        .join(done, "request_id")
        .where("seq < end_seq")
        .groupBy("request_id")
        .agg(F.sort_array(F.collect_list(F.struct("seq", "content"))).alias("parts"))
    )
    text = F.array_join(F.transform("parts", lambda p: F.coalesce(p["content"], F.lit(""))), "")
    return done.join(chunks, "request_id", "left").select(
        "request_id", F.coalesce(text, F.lit("")).alias("response"),
        F.greatest(F.coalesce(F.size("parts"), F.lit(0)), F.lit(0)).cast("bigint").alias("chunks"),
    )


# ---- session memory --------------------------------------------------------------------

def session_state(messages: DataFrame, limit: int, ttl_ms: int = 0) -> DataFrame:
    """Last ``limit`` messages of each session by position as state; an append refreshes the TTL.

    ``messages``: ``session_id BIGINT, position BIGINT, role, content``, in any order. Emits the session
    after each batch; an expired session leaves with no messages.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"session_id": [key[0]], "messages": [0], "history": [""]})
            return
        kept = json.loads(state.get[0]) if state.exists else []
        for frame in batches:
            kept += [[int(p), f"{r}: {c}\n"] for p, r, c in zip(frame["position"], frame["role"], frame["content"])]
        kept = sorted(kept)[-limit:]
        state.update((json.dumps(kept),))
        if ttl_ms:
            state.setTimeoutDuration(ttl_ms)
        yield pd.DataFrame(
            {"session_id": [key[0]], "messages": [len(kept)], "history": ["".join(line for _, line in kept)]}
        )

    return messages.groupBy("session_id").applyInPandasWithState(
        step, "session_id bigint, messages bigint, history string", "kept string", "update",
        _timer(ttl_ms),
    )


# ---- admission -------------------------------------------------------------------------

class _Window:
    """Admitted calls of one quota inside the sliding window; a denial is never stored."""

    def __init__(self, held: list[list[int]] | None = None):
        self.held = deque(held or [])
        self.tokens = sum(t for _, t in self.held)

    def admit(self, at: int, tokens: int, width: int, rpm: int, tpm: int) -> bool:
        while self.held and self.held[0][0] <= at - width:
            self.tokens -= self.held.popleft()[1]
        if len(self.held) >= rpm or self.tokens + tokens > tpm:
            return False
        self.held.append([at, tokens])
        self.tokens += tokens
        return True


ANSWERED = 8192  # verdicts that leave at once
_ADMITTED = "quota string, call_id bigint, at bigint, tokens bigint, admitted boolean"


def admission_stream(requests: DataFrame, time: str, *, width: int, rpm: int, tpm: int, lateness: str = LATENESS) -> DataFrame:
    """Sliding-window admission per quota key, in event time: a request is decided once the watermark has
    passed it, after all that came before it.

    The state is the admitted calls in the window and the requests that wait, as packed integers; a quota that is silent
    for a window's length has none.
    """

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, waits = state.get if state.exists else (b"", b"")
        parts = [np.frombuffer(waits, np.int64).reshape(-1, 4)]
        if not state.hasTimedOut:
            parts += [np.column_stack([f["at"], f["call_id"], f["tokens"], _millis(f[time])]).astype(np.int64) for f in batches]
        rows, now = np.concatenate(parts), state.getCurrentWatermarkMs()
        del parts, waits
        passed = rows[:, 3] < now
        due, waiting = rows[passed], rows[~passed]
        del rows
        due = due[np.lexsort(due.T[::-1])]
        window = _Window(np.frombuffer(held, np.int64).reshape(-1, 2).tolist())
        for first in range(0, len(due), ANSWERED):
            part = due[first : first + ANSWERED]
            verdicts = [window.admit(at, tokens, width, rpm, tpm) for at, _, tokens, _ in part.tolist()]
            yield pd.DataFrame({"quota": key[0], "call_id": part[:, 1], "at": part[:, 0], "tokens": part[:, 2], "admitted": verdicts})
        calm = [at // 1000 + width // 1000 for at, _ in window.held]
        if not len(waiting) and (not calm or max(calm) < now):
            state.remove()
        else:
            state.update((np.array(window.held, np.int64).tobytes(), waiting.tobytes()))
            state.setTimeoutTimestamp(max(int(waiting[:, 3].min()) if len(waiting) else max(calm), now + 1))

    return requests.withWatermark(time, lateness).groupBy("quota").applyInPandasWithState(
        step, _ADMITTED, "held binary, waiting binary", "append", GroupStateTimeout.EventTimeTimeout
    )


def admission_replay(requests: DataFrame, block: Column, *, width: int, rpm: int, tpm: int) -> DataFrame:
    """The same decisions over a finished log.

    A silence as long as the window empties it, so the log of a quota is cut at its silences
    and the parts are replayed in parallel, as sorted streams that hold one window each.
    ``requests``: ``quota, call_id, at, tokens``.
    """
    order = [F.col("at"), F.col("call_id")]
    near = previous_row(requests, ["quota"], block, order, {"p_at": F.col("at")})
    fresh = F.when(F.col("p_at").isNull() | (F.col("at") - F.col("p_at") >= width), 1)
    parts = running_sums(near, ["quota"], block, order, {"part": fresh}).drop("p_at")

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, window = None, _Window()
        for batch in batches:
            verdicts = []
            for quota, part, at, tokens in zip(batch["quota"], batch["part"], batch["at"], batch["tokens"]):
                if (quota, part) != current:
                    current, window = (quota, part), _Window()
                verdicts.append(window.admit(int(at), int(tokens), width, rpm, tpm))
            batch["admitted"] = verdicts
            yield batch[["quota", "call_id", "at", "tokens", "admitted"]]

    return (
        parts.select("quota", "part", "call_id", "at", "tokens")
        .repartition("quota", "part")
        .sortWithinPartitions("quota", "part", "at", "call_id")
        .mapInPandas(replay, _ADMITTED)
    )


# ---- built-in state --------------------------------------------------------------------

def dedupe(requests: DataFrame, keys: list[str], time: str, lateness: str = LATENESS) -> DataFrame:
    """One row per request key; repeats within the watermark are dropped."""
    return requests.withWatermark(time, lateness).dropDuplicatesWithinWatermark(keys)


def interrupted(starts: DataFrame, ends: DataFrame, key: str, lease: str, lateness: str = LATENESS) -> DataFrame:
    """Starts with no end inside the lease, reported once the watermark has passed it.

    ``starts``: ``key, start_id, started_at``; ``ends``: ``key, ended_at``.
    """
    s = starts.withWatermark("started_at", lateness)
    e = ends.withWatermark("ended_at", lateness).withColumnRenamed(key, "__k")
    inside = F.expr(
        f"__k = {key} AND ended_at >= started_at AND ended_at <= started_at + INTERVAL {lease}"
    )
    return s.join(e, inside, "leftOuter").where("ended_at is null").select(key, "start_id", "started_at")


def route_windows(requests: DataFrame, time: str, width: str, lateness: str = LATENESS) -> DataFrame:
    """Tumbling counts and duration buckets by route and outcome."""
    per_bound = [
        F.count(F.when(bucket_index(F.col("duration")) <= i, 1)).alias(f"le_{i}")
        for i in range(len(BOUNDS))
    ]
    return (
        requests.withWatermark(time, lateness)
        .groupBy(F.window(time, width), "route", "outcome")
        .agg(F.count(F.lit(1)).alias("requests"), F.sum("duration").alias("total"), *per_bound)
        .withColumn("window_start", F.unix_micros(F.col("window.start")))
        .drop("window")
    )
