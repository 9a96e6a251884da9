"""Windowed statistics of traces: frequencies, heavy hitters, histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_start(ts, size: int):
    return (F.floor(ts / F.lit(size)) * size).cast("long")


def frequencies(facts: DataFrame, size: int = 60) -> DataFrame:
    """(start, relation, n): events per relation and tumbling window of ``size`` seconds."""
    return facts.groupBy(window_start(F.col("ts"), size).alias("start"), "relation").agg(F.count("*").alias("n"))


def heavy_hitters(facts: DataFrame, size: int = 60, degree: int = 16, least: int = 0) -> DataFrame:
    """(start, relation, attribute, value, n): values in at least events / (2 * degree) of a window's events, rounded up, and ``least`` events."""
    base = facts.select(window_start(F.col("ts"), size).alias("start"), "relation", "args")
    totals = base.groupBy("start", "relation").agg(F.count("*").alias("_n"))
    values = base.select("start", "relation", F.posexplode("args").alias("attribute", "value")).groupBy("start", "relation", "attribute", "value").agg(F.count("*").alias("n"))
    limit = F.greatest(F.ceil(F.col("_n") / (2 * degree)), F.lit(least))
    return values.join(totals, ["start", "relation"]).where(F.col("n") >= limit).drop("_n")


def relation_statistics(facts: DataFrame, size: int = 60, degree: int = 16, least: int = 0, counts: bool = False) -> DataFrame:
    """(start, relation, n, heavy): heavy joins each attribute's values by comma, attributes by semicolon."""
    arity = facts.groupBy(window_start(F.col("ts"), size).alias("start"), "relation").agg(F.count("*").alias("n"), F.max(F.size("args")).alias("_a"))
    item = F.concat_ws(",", "value", F.col("n").cast("string")) if counts else F.col("value")
    heavy = heavy_hitters(facts, size, degree, least).groupBy("start", "relation", "attribute").agg(F.array_join(F.array_sort(F.collect_list(item)), ",").alias("_v"))
    per = heavy.groupBy("start", "relation").agg(F.map_from_entries(F.collect_list(F.struct("attribute", "_v"))).alias("_m"))
    joined = arity.join(per, ["start", "relation"], "left")
    listed = F.when(F.col("_a") > 0, F.array_join(F.transform(F.sequence(F.lit(0), F.col("_a") - 1), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(""))), ";")).otherwise(F.lit(""))
    return joined.select("start", "relation", "n", listed.alias("heavy"))


def statistics_lines(stats: DataFrame) -> DataFrame:
    return stats.select(F.concat_ws(",", F.col("start").cast("string"), "relation", F.col("n").cast("string"), "heavy").alias("line"))


def split_statistics(stats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(time, relation, rate) and (time, relation, attribute, value) of relation_statistics' result."""
    rates = stats.select(F.col("start").alias("time"), "relation", F.col("n").alias("rate"))
    attributes = stats.select(F.col("start").alias("time"), "relation", F.posexplode(F.split("heavy", ";")).alias("attribute", "_v"))
    return rates, attributes.where("_v <> ''").select("time", "relation", "attribute", F.explode(F.split("_v", ",")).alias("value"))


def merge_heavy(heavy: DataFrame, least: int = 2) -> DataFrame:
    """Values that are heavy in at least ``least`` windows."""
    return heavy.groupBy("relation", "attribute", "value").agg(F.countDistinct("time").alias("windows")).where(F.col("windows") >= least)


def histogram(facts: DataFrame) -> DataFrame:
    """(relation, attribute, value, n, total): counts of values and of their attribute."""
    values = facts.select("relation", F.posexplode("args").alias("attribute", "value")).groupBy("relation", "attribute", "value").agg(F.count("*").alias("n"))
    return values.join(values.groupBy("relation", "attribute").agg(F.sum("n").alias("total")), ["relation", "attribute"])


def merge_histograms(a: DataFrame, b: DataFrame) -> DataFrame:
    """The histogram of both inputs together."""
    n = a.unionByName(b).groupBy("relation", "attribute", "value").agg(F.sum("n").alias("n"))
    return n.join(n.groupBy("relation", "attribute").agg(F.sum("n").alias("total")), ["relation", "attribute"])


def heavy_of(hist: DataFrame, degree: int) -> DataFrame:
    """Values whose share is over 1 / (2 * degree)."""
    return hist.where(F.col("n") * (2 * degree) > F.col("total"))


def relevant(facts: DataFrame, formula) -> DataFrame:
    """Facts that some atom of the formula can match."""
    from ..formula.ast import Const, atoms

    ok = F.lit(False)
    for a in atoms(formula):
        match = (F.col("relation") == a.relation) & (F.size("args") == len(a.args))
        for i, t in enumerate(a.args):
            if isinstance(t, Const):
                match = match & (F.get("args", F.lit(i)) == str(t.value))
        ok = ok | match
    return facts.where(ok)


def hopping_histogram(facts: DataFrame, frame: int, frames: int) -> DataFrame:
    """(start, relation, attribute, value, n) over the last ``frames`` frames of ``frame`` seconds that end with each frame.

    start is the window's first second. Frames are counted first, so a fact is repeated only as a count.
    """
    counts = facts.select(window_start(F.col("ts"), frame).alias("_f"), "relation", F.posexplode("args").alias("attribute", "value")).groupBy("_f", "relation", "attribute", "value").agg(F.count("*").alias("_n"))
    spread = counts.withColumn("start", F.explode(F.sequence(F.col("_f") - (frames - 1) * frame, F.col("_f"), F.lit(frame).cast("long"))))
    return spread.groupBy("start", "relation", "attribute", "value").agg(F.sum("_n").alias("n"))


def relation_sizes(hist: DataFrame) -> dict[str, float]:
    """Facts of each relation by its histogram; one row for each relation comes to the driver."""
    return {r["relation"]: float(r["n"]) for r in hist.groupBy("relation").agg(F.max("total").alias("n")).collect()}


def constant_sizes(relations, size: float = 100.0) -> dict[str, float]:
    """The same size for every relation, for want of a measurement."""
    return dict.fromkeys(relations, size)


def latencies(rows: DataFrame, by: list[str], column: str) -> DataFrame:
    """Largest, mean and 99th percentile of a latency column for each group."""
    return rows.groupBy(*by).agg(F.max(column).alias("peak"), F.avg(column).alias("mean"), F.percentile_approx(column, 0.99).alias("p99"))


def moving_average(values, keep: float = 0.9):
    """Exponentially weighted means of a series, one for each value; the first value starts it."""
    mean = None
    for x in values:
        mean = float(x) if mean is None else keep * mean + (1 - keep) * x
        yield mean
