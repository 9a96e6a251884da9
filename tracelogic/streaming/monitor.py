"""Monitoring of live traces with Structured Streaming.

Events carry event time; an operator is one keyed stateful step. A guard row waits until the watermark has passed all
that its interval can hold; state holds the times that an interval can still reach and is dropped as the watermark
passes, so memory is bounded by the interval. Late rows are dropped by the watermark.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.statistics import frequencies

OPERATORS = ("once", "eventually", "since", "until", "since_not", "until_not", "prev", "next")


def run_start(tps: list[int], tp: int) -> int:
    """First of the neighbouring time-points that end at tp, which is in tps (sorted); tp + 1 if it is not."""
    i = bisect_right(tps, tp) - 1
    if i < 0 or tps[i] != tp:
        return tp + 1
    low, high = 0, i  # tps[j] - j is the same all along a run
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if tps[mid] - mid == tps[i] - i else (mid + 1, high)
    return tps[low]


def run_end(tps: list[int], tp: int) -> int:
    """Last of the neighbouring time-points that begin at tp; tp - 1 if tp is not in tps."""
    i = bisect_left(tps, tp)
    if i == len(tps) or tps[i] != tp:
        return tp - 1
    low, high = i, len(tps) - 1
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if tps[mid] - mid == tps[i] - i else (low, mid - 1)
    return tps[low]


def satisfied(op: str, tp: int, ts: int, lo: int, hi: int, alphas: list[int], betas: list[tuple[int, int]]) -> bool:
    """Whether the operator holds at (tp, ts); betas are sorted (ts, tp), alphas sorted tp without repeats."""
    if op in ("prev", "next"):
        there = tp - 1 if op == "prev" else tp + 1
        first, last = (ts - hi + 1, ts - lo) if op == "prev" else (ts + lo, ts + hi - 1)
        i = bisect_left(betas, (first, -1))
        while i < len(betas) and betas[i][0] <= last:
            if betas[i][1] == there:
                return True
            i += 1
        return False
    if op in ("once", "since", "since_not"):
        i = bisect_right(betas, (ts - lo, tp)) - 1  # the last beta that is old enough
        if i < 0 or betas[i][0] <= ts - hi:
            return False
        at = betas[i][1]
        if op == "once":
            return True
        if op == "since":
            return at == tp or at >= run_start(alphas, tp) - 1
        k = bisect_right(alphas, tp) - 1
        return k < 0 or alphas[k] <= at
    i = bisect_left(betas, (ts + lo, tp))
    while i < len(betas) and betas[i][1] < tp:
        i += 1
    if i == len(betas) or betas[i][0] >= ts + hi:
        return False
    at = betas[i][1]
    if op == "eventually":
        return True
    if op == "until":
        return at == tp or at <= run_end(alphas, tp) + 1
    k = bisect_left(alphas, tp)
    return k == len(alphas) or alphas[k] >= at


def temporal(events: DataFrame, keys: list[str], op: str, lo: int, hi: int, negated: bool = False, delay: str = "0 seconds") -> DataFrame:
    """Verdicts (keys..., tp, ts) of guards p AND [NOT] (operator [lo, hi)) with shared keys.

    events: keys, at timestamp, tp and ts long, side 'p' (guard), 'a' or 'b' (the operator's left and right part; ONCE,
    EVENTUALLY, PREVIOUS and NEXT have 'b' only). tp numbers the time-points of the whole trace. ``since`` and
    ``until`` ask for 'a' at every time-point between, ``since_not`` and ``until_not`` for none. Unbounded intervals
    are refused: they could never be final or never be forgotten.
    """
    if hi is None:
        raise ValueError("streaming needs a bounded interval")
    if op not in OPERATORS:
        raise ValueError(f"unknown operator {op}")
    import pandas as pd

    past = op in ("once", "since", "since_not", "prev")
    fields = [f for f in events.schema.fields if f.name in keys]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", tp long, ts long"
    state_schema = "p array<struct<ts:long,tp:long>>, a array<struct<ts:long,tp:long>>, b array<struct<ts:long,tp:long>>"
    final = lambda ts: ts if past else ts + hi - 1

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {s: [tuple(x) for x in part] for s, part in zip("pab", state.get if state.exists else ([], [], []), strict=True)}
        if not state.hasTimedOut:
            for f in frames:
                for s in "pab":
                    mine = f[f.side == s]
                    held[s] += zip(mine.ts.tolist(), mine.tp.tolist(), strict=True)
        for s in "pab":
            held[s].sort()
        # no row before this second can come any more
        done = state.getCurrentWatermarkMs() // 1000
        ready = [x for x in held["p"] if final(x[0]) < done]
        held["p"] = [x for x in held["p"] if final(x[0]) >= done]
        alphas = sorted({tp for _, tp in held["a"]})
        out = [(tp, ts) for ts, tp in ready if satisfied(op, tp, ts, lo, hi, alphas, held["b"]) != negated]
        first = min([x[0] for x in held["p"]] + [done]) - (hi if past else 0)
        held["a"], held["b"] = ([x for x in held[s] if x[0] >= first] for s in "ab")
        if any(held.values()):
            state.update(tuple([{"ts": ts, "tp": tp} for ts, tp in held[s]] for s in "pab"))
            wait = min([final(x[0]) for x in held["p"]] + [x[0] + hi for s in "ab" for x in held[s]]) + 1
            state.setTimeoutTimestamp(max(wait * 1000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame({**{f.name: [v] * len(out) for f, v in zip(fields, key, strict=True)}, "tp": [x[0] for x in out], "ts": [x[1] for x in out]})

    marked = events.withWatermark("at", delay).select(*keys, "tp", "ts", "side", "at")
    return marked.groupBy(*[f.name for f in fields]).applyInPandasWithState(step, schema, state_schema, "append", GroupStateTimeout.EventTimeTimeout)


def guarded(events: DataFrame, keys: list[str], lo: int, hi: int, past: bool = True, negated: bool = False, delay: str = "0 seconds") -> DataFrame:
    """Verdicts (keys..., ts) of p AND [NOT] ONCE / EVENTUALLY q, where every time-stamp is a time-point of its own.

    events: keys, at timestamp, ts long, side 'p' or 'q'.
    """
    if hi is None:
        raise ValueError("streaming needs a bounded interval")
    sided = events.withColumn("side", F.when(F.col("side") == "q", "b").otherwise(F.col("side"))).withColumn("tp", F.col("ts"))
    return temporal(sided, keys, "once" if past else "eventually", lo, hi, negated, delay).drop("tp")


def windowed_counts(events: DataFrame, size: str = "60 seconds", delay: str = "0 seconds") -> DataFrame:
    """(start, relation, n) of events (relation, at timestamp), final once the watermark passes the window."""
    counted = events.withWatermark("at", delay).groupBy(F.window("at", size).alias("w"), "relation").agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), "relation", "n")


def once_per_event(events: DataFrame, columns: list[str], delay: str = "10 seconds") -> DataFrame:
    """events without repeats inside the watermark."""
    return events.withWatermark("at", delay).dropDuplicatesWithinWatermark(columns)


__all__ = ["OPERATORS", "frequencies", "guarded", "once_per_event", "temporal", "windowed_counts"]
