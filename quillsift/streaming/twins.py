"""Structured Streaming versions of the trace operators.

Each has a batch twin; run to the end of its input it gives the same rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def status_stream(events: DataFrame, kinds: list[str]) -> DataFrame:
    """The events of some kinds; stateless, so batch and stream are one plan."""
    return events.filter(F.col("event_type").isin(kinds))


def sessions(events: DataFrame, key: str, ts: str, gap: str, late: str = "1 hour") -> DataFrame:
    """(key, start, stop, n) of sessions that the gap has closed."""
    held = events.withWatermark(ts, late)
    return held.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.min(ts).alias("start"), F.max(ts).alias("stop"), F.count("*").alias("n")).drop("w")


def first_result(events: DataFrame, key: list[str], ts: str, late: str = "1 hour") -> DataFrame:
    """One row a key, whichever channel brings it first; state older than the watermark is dropped."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


def ttl_cache(events: DataFrame, key: str, ttl_ms: int, late: str = "1 hour") -> DataFrame:
    """Reads with ``hit``: the last write is under ``ttl_ms`` old and not read yet. events: key, id, ms, is_write.

    All rows of a key in a trigger are put in order before they are played. The state of
    a key goes with the read that takes its write, or once the watermark has passed its end.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = []
        if state.hasTimedOut:
            state.remove()
        else:
            written = state.get[0] if state.exists else -1
            held = pd.concat(list(frames), ignore_index=True)
            for i, ms, write in sorted(zip(held["id"], held["ms"], held["is_write"], strict=True), key=lambda x: (x[1], x[0])):
                if write:
                    written = int(ms)
                else:
                    rows.append((k[0], i, written >= 0 and ms - written < ttl_ms))
                    written = -1
            if written >= 0 and written + ttl_ms > state.getCurrentWatermarkMs():
                state.update((written,))
                state.setTimeoutTimestamp(written + ttl_ms)
            elif state.exists:
                state.remove()
        yield pd.DataFrame(rows, columns=[key, "id", "hit"])

    timed = events.withColumn("_at", F.timestamp_millis("ms")).withWatermark("_at", late)
    return timed.groupBy(key).applyInPandasWithState(step, f"{key} long, id long, hit boolean", "written long", "append", GroupStateTimeout.EventTimeTimeout)


#: A rule that is played over the events of a key in the order of their times: (memory, ms, kind, id) -> rows.
Play = Callable[[dict, int, str, "int | None"], Iterable[tuple]]


def played(
    events: DataFrame, key: str, kinds: tuple[str, ...], play: Play, schema: str, due: Callable[[dict, int], Iterable[tuple]] | None = None,
    next_due: Callable[[dict], int | None] = lambda memory: None, late: str = "1 hour",
) -> DataFrame:
    """Rows of ``play`` over events (key, id, ms, kind), whatever the order in which they come within ``late``.

    Events wait until the watermark has passed their time, so that late ones take
    their place; at one time they are played in the order of ``kinds``, then of ids.
    ``due`` plays what falls due by itself until a time, and ``next_due`` tells when
    that is next. A key whose memory and queue are empty holds no state.
    """
    rank = {k: i for i, k in enumerate(kinds)}
    names = [key, *(f.split()[0] for f in schema.split(", "))]

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentWatermarkMs()
        times, ranks, ids, memo = state.get if state.exists else ([], [], [], "{}")
        queue, memory = list(zip(times, ranks, ids, strict=True)), json.loads(memo)
        if not state.hasTimedOut:
            for pdf in frames:
                queue += [(int(ms), rank[kind], None if pd.isna(i) else int(i)) for ms, kind, i in zip(pdf["ms"], pdf["kind"], pdf["id"], strict=True)]
        queue.sort(key=lambda e: (e[0], e[1], e[2] is not None, e[2] or 0))
        rows: list[tuple] = []
        n = sum(e[0] <= now for e in queue)
        for ms, r, i in queue[:n]:
            rows += due(memory, ms) if due else ()
            rows += play(memory, ms, kinds[r], i)
        rows += due(memory, now) if due else ()
        queue = queue[n:]
        if queue or memory:
            state.update(([e[0] for e in queue], [e[1] for e in queue], [e[2] for e in queue], json.dumps(memory)))
            wake = [t for t in (queue[0][0] if queue else None, next_due(memory)) if t is not None]
            if wake:
                state.setTimeoutTimestamp(max(min(wake), now + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame([(k[0], *r) for r in rows], columns=names)

    timed = events.select(key, "id", "ms", "kind").withColumn("_at", F.timestamp_millis("ms")).withWatermark("_at", late)
    held = "times array<long>, ranks array<int>, ids array<long>, memory string"
    return timed.groupBy(key).applyInPandasWithState(step, f"{key} long, {schema}", held, "append", GroupStateTimeout.EventTimeTimeout)


def correlate(events: DataFrame, key: str, timeout_ms: int, late: str = "1 hour") -> DataFrame:
    """(key, id, status, took) of requests, as ``trace.correlate`` has them. events (key, id, ms, kind): request, reply or failure of the key's worker."""

    def due(memory: dict, now: int) -> Iterable[tuple]:
        open_ = memory.get("open", [])
        for i, at in [x for x in open_ if x[1] + timeout_ms <= now]:
            yield i, "timed out", None
        _keep(memory, [x for x in open_ if x[1] + timeout_ms > now])

    def play(memory: dict, ms: int, kind: str, i: int | None) -> Iterable[tuple]:
        open_ = memory.get("open", [])
        if kind == "request":
            _keep(memory, [*open_, [i, ms]])
            return
        own = [x for x in open_ if kind == "failure" or x[0] == i]
        for j, at in own:
            yield (j, "failed", None) if kind == "failure" else (j, "answered", ms - at)
        _keep(memory, [x for x in open_ if x not in own])

    def _keep(memory: dict, left: list) -> None:
        memory["open"] = left
        if not left:
            del memory["open"]

    soonest = lambda memory: min((at + timeout_ms for _, at in memory.get("open", [])), default=None)
    return played(events, key, ("request", "reply", "failure"), play, "id long, status string, took long", due, soonest, late)


def preempt(events: DataFrame, key: str, late: str = "1 hour") -> DataFrame:
    """(key, id, what, ms): what becomes of commands. events (key, id, ms, kind): command, or end of the run that is on.

    A command runs if nothing does. Else the run is told to stop, once, and the command
    waits; a newer one takes its place, and it is dropped. When the run ends, the one
    that waits starts. An end without a run, and a command without an id, are nothing.
    """

    def play(memory: dict, ms: int, kind: str, i: int | None) -> Iterable[tuple]:
        if kind == "end":
            if "run" in memory:
                yield memory.pop("run"), "ended", ms
                memory.pop("stopping", None)
                if "next" in memory:
                    memory["run"] = memory.pop("next")
                    yield memory["run"], "started", ms
        elif i is not None:
            if "run" not in memory:
                memory["run"] = i
                yield i, "started", ms
                return
            if "next" in memory:
                yield memory["next"], "dropped", ms
            memory["next"] = i
            if "stopping" not in memory:
                memory["stopping"] = True
                yield memory["run"], "stopped", ms

    return played(events, key, ("end", "command"), play, "id long, what string, ms long", late=late)
