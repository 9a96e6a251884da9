"""What slicing would have cost: shares chosen window by window from a trace's own statistics.

Static slicing keeps one slicer; predictive slicing uses in each window the slicer of that window's statistics,
reactive slicing that of the window before; adaptive slicing changes to it only where the change pays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..formula.ast import Formula
from ..functions.statistics import frequencies, heavy_hitters, relevant, window_start
from ..sources.traces import command_line, heavy_values
from .slicing import Slicer, should_switch

MODES = ("static", "predictive", "reactive")


def window_slicers(facts: DataFrame, formula: Formula, degree: int, size: int) -> dict[int, Slicer]:
    """For each window of ``size`` seconds (by its start) the slicer of its rates and heavy values.

    The driver gets one row for each window and relation, and of heavy values at most 2 * degree for each attribute.
    """
    mine = relevant(facts, formula)
    sizes: dict[int, dict[str, float]] = {}
    for r in frequencies(mine, size).collect():
        sizes.setdefault(r["start"], {})[r["relation"]] = float(r["n"])
    heavy: dict[int, list] = {}
    for r in heavy_hitters(mine, size, degree, least=2).collect():
        heavy.setdefault(r["start"], []).append(r)
    return {start: Slicer.optimize(formula, degree, sizes[start], heavy_values(heavy.get(start, []), formula)) for start in sorted(sizes)}


def schedule(slicers: dict[int, Slicer], default: Slicer, mode: str) -> dict[int, Slicer]:
    """Which slicer each window uses. Reactive slicing begins with the default."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    starts = sorted(slicers)
    if mode == "static":
        return dict.fromkeys(starts, default)
    if mode == "predictive":
        return {s: slicers[s] for s in starts}
    return {s: slicers[starts[i - 1]] if i else default for i, s in enumerate(starts)}


def with_commands(facts: DataFrame, used: dict[int, Slicer]) -> DataFrame:
    """(ts, tp, last, line): csv lines with a set_slicer command ahead of each window whose slicer is another one.

    Written in order of (ts, tp, last).
    """
    from ..sources.traces import csv_lines

    spark = facts.sparkSession
    rows, before = [], None
    for start in sorted(used):
        text = used[start].to_text()
        if before is not None and text != before:
            rows.append((start, -1, 0, command_line("set_slicer", text)))
        before = text
    of_tp = facts.select("tp", "ts").distinct()
    lines = csv_lines(facts).join(of_tp, "tp").select("ts", "tp", F.lit(1).alias("last"), "line")
    return lines.unionByName(spark.createDataFrame(rows, "ts long, tp long, last int, line string"))


def of_command(formula: Formula, line: str) -> Slicer:
    """The slicer of a set_slicer line."""
    return Slicer.of_text(formula, line.strip()[1:-1].split(" ", 1)[1])


def simulated_cost(facts: DataFrame, used: dict[int, Slicer], size: int) -> DataFrame:
    """(start, cost): the most events of any slice in each window, under the slicer that the window uses.

    Windows of equal slicers are sliced together.
    """
    by_text: dict[str, tuple[Slicer, list[int]]] = {}
    for start, s in used.items():
        by_text.setdefault(s.to_text(), (s, []))[1].append(start)
    at = window_start(F.col("ts"), size)
    out = None
    for s, starts in by_text.values():
        load = s.slice_facts(facts.where(at.isin(starts))).groupBy(at.alias("start"), "slice").agg(F.count("*").alias("n"))
        part = load.groupBy("start").agg(F.max("n").alias("cost"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else facts.sparkSession.createDataFrame([], "start long, cost long")


def adaptive(facts: DataFrame, formula: Formula, degree: int, size: int, per_event: float = 1.0, shutdown: float = 0.0, stability: float = 1.0) -> dict[int, Slicer]:
    """The slicer of each window, where a window's own slicer takes over from the next window on if the change pays.

    Costs are counted for the current and the window's own slicer, one job a window.
    """
    slicers = window_slicers(facts, formula, degree, size)
    now = Slicer.optimize(formula, degree, {})
    used: dict[int, Slicer] = {}
    for start in sorted(slicers):
        used[start] = now
        new = slicers[start]
        if new.to_text() == now.to_text():
            continue
        mine = facts.where(window_start(F.col("ts"), size) == start)
        both = simulated_cost(mine, {start: now}, size).withColumn("k", F.lit(0)).unionByName(simulated_cost(mine, {start: new}, size).withColumn("k", F.lit(1)))
        cost = {r["k"]: float(r["cost"]) for r in both.collect()}
        go, stability = should_switch(cost.get(0, 0.0), cost.get(1, 0.0), per_event, shutdown, stability)
        if go:
            now = new
    return used


__all__ = ["MODES", "adaptive", "of_command", "schedule", "simulated_cost", "window_slicers", "with_commands"]
