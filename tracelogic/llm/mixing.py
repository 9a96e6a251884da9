"""Mixing sources to target weights by subset-sum budget fitting.

Sources in order of their names (by code point, null last) weigh 5, 2, 1, 5, 2, 1, ...; together they shall have
``share`` times all words. A source's target stops at ``most`` times its words; what is cut off is dealt to the others
by weight until no target is above. Each target is met by whole passes over the source and a part: documents are
counted by exact word count, every count gives its proportional share, and a bounded-knapsack dynamic program over the
remaining documents fits the remaining budget to the word. Within a word count, seeded hashes choose the documents: a
word count's cut-off is the hash of the last one that is taken.

Texts are counted once into a table of (source, size, hash); the driver sees one row for each source. A source's
histogram is fitted in one task, of one row for each different word count. The answer needs no exchange of texts.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch

#: Hash ranges in which the last document taken is looked for.
BUCKETS = 1024
#: Up to so many (source, word count) pairs, of about 60 bytes, are sent to every executor; more are joined.
BROADCAST_ROWS = 500_000


def targets(sizes: list[tuple[str | None, int]], weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Words to take of each source."""
    order = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode("utf-8", "surrogatepass")))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    size = dict(order)
    left, open_, out = share * sum(size.values()), list(size), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if unit * weight[s] > most * size[s]]
        if not full:
            return out | {s: unit * weight[s] for s in open_}
        for s in full:
            out[s] = float(most * size[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in set(full)]
    return out


def fit(counts: dict[int, int], budget: int, capacity: int = 1 << 17) -> dict[int, int]:
    """Documents to take of each size, so that their sizes add up to budget, or to the closest sum below that is found.

    Proportional shares first; then the remainder is fitted by the program, over at least ``capacity`` words and twice
    the largest size. If no sum fits, less is dealt out by share, and at last nothing, so that the program has more to
    choose from; budgets up to the program's reach are thus fitted exactly.
    """
    total = sum(s * c for s, c in counts.items())
    budget = max(0, min(budget, total))
    capacity = max(capacity, 2 * max(counts, default=0))
    best: dict[int, int] = {}
    for tenths in (10, 9, 5, 0):
        take = fit_from({s: c * budget * tenths // (10 * total) if total else 0 for s, c in counts.items() if s}, counts, budget, capacity)
        if not best or sum(s * n for s, n in take.items()) > sum(s * n for s, n in best.items()):
            best = take
        if sum(s * n for s, n in best.items()) == budget:
            break
    return best


def fit_from(take: dict[int, int], counts: dict[int, int], budget: int, capacity: int) -> dict[int, int]:
    """fit() with some documents taken already."""
    rest = budget - sum(s * c for s, c in take.items())
    for s in sorted(take, reverse=True):
        if rest - capacity // 2 < s:
            continue
        n = min(counts[s] - take[s], (rest - capacity // 2) // s)
        take[s] += n
        rest -= s * n
    for s in sorted(take, reverse=True):  # what is still above the program's reach
        if rest <= capacity:
            break
        n = min(counts[s] - take[s], -(-(rest - capacity) // s), rest // s)
        take[s] += n
        rest -= s * n
    for s, n in knapsack([(s, counts[s] - take[s]) for s in sorted(take)], min(rest, capacity)):
        take[s] += n
    return take


def knapsack(free: list[tuple[int, int]], goal: int) -> list[tuple[int, int]]:
    """(size, number) whose sum is the largest up to goal, with at most the free number of each size.

    Sums are the bits of an integer, numbers are split in powers of two. Every ``stride``-th state is kept and those
    between are made again on the way back, so memory grows with the root of the steps.
    """
    lots = []
    for s, n in free:
        n, lot = min(n, goal // s), 1
        while n > 0:
            lots.append((s, min(lot, n)))
            n, lot = n - lot, lot * 2
    mask, stride = (1 << (goal + 1)) - 1, math.isqrt(len(lots)) + 1
    reach, kept, done = 1, [], 0
    for i, (s, n) in enumerate(lots):
        if i % stride == 0:
            kept.append(reach)
        reach |= reach << (s * n) & mask
        done = i + 1
        if reach >> goal & 1:
            break
    at, out = reach.bit_length() - 1, []
    for block in range(len(kept) - 1, -1, -1):
        state, before = kept[block], []
        part = lots[block * stride : min(done, (block + 1) * stride)]
        for s, n in part:
            before.append(state)
            state |= state << (s * n) & mask
        for (s, n), was in zip(reversed(part), reversed(before), strict=True):
            if not was >> at & 1:
                out.append((s, n))
                at -= s * n
    return out


def mix(docs: DataFrame, seed: int = 7, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """docs with size, source_size, target (double) and taken (words taken, repeats counted; at most 2 * size).

    Null and empty texts have size 0 and are taken 0 times. A null source is a source, the last. Rows that repeat a
    document are separate documents of equal rank. Extra columns are kept; columns that have the names of the new
    ones are replaced. Empty tables give none.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    added = ("size", "source_size", "target", "taken")
    base = docs.drop(*[c for c in docs.columns if c.startswith("_mix") or c in added])
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]++")).cast("long").alias("_mix_k")
    order = F.xxhash64(F.lit(seed), F.col("doc_id"), F.xxhash64("text")).alias("_mix_h")
    rows = scratch.save(base.select(F.col("source").alias("_mix_s"), size, order))
    counts = scratch.save(rows.groupBy("_mix_s", "_mix_k").agg(F.count("*").alias("_mix_n")))
    whole = {r[0]: r[1] for r in counts.groupBy("_mix_s").agg(F.sum(F.col("_mix_k") * F.col("_mix_n"))).collect()}
    goal = targets(list(whole.items()), weights, share, most)
    named = []
    for i, s in enumerate(whole):
        passes = int(goal[s] // whole[s]) if whole[s] else 0
        named.append((i, s, whole[s], goal[s], passes, round(goal[s]) - passes * whole[s] if passes < most else 0))
    kind = docs.schema["source"].dataType.simpleString()
    sources = spark.createDataFrame(named, f"_mix_i int, _mix_s {kind}, source_size long, target double, _mix_p int, _mix_b long")
    few = F.broadcast if len(named) <= BROADCAST_ROWS else lambda x: x

    def numbered(df: DataFrame, *columns: str) -> DataFrame:
        ids = sources.select(F.col("_mix_s").alias("_mix_o"), "_mix_i", *columns)
        return df.join(few(ids), F.col("_mix_s").eqNullSafe(F.col("_mix_o"))).drop("_mix_o")

    def fitted(group: pd.DataFrame) -> pd.DataFrame:
        sizes, numbers = group["_mix_k"].tolist(), group["_mix_n"].tolist()
        part = fit(dict(zip(sizes, numbers, strict=True)), int(group["_mix_b"].iloc[0]))
        return pd.DataFrame({"_mix_i": group["_mix_i"], "_mix_k": sizes, "_mix_n": numbers, "_mix_q": [part.get(k, 0) for k in sizes]})

    plan = numbered(counts, "_mix_b").select("_mix_i", "_mix_k", "_mix_n", "_mix_b")
    plan = scratch.save(plan.groupBy("_mix_i").applyInPandas(fitted, "_mix_i int, _mix_k long, _mix_n long, _mix_q long"))
    # where a word count is taken in part: the hash range of the last document taken, then its hash
    some = plan.where((F.col("_mix_q") > 0) & (F.col("_mix_q") < F.col("_mix_n"))).select("_mix_i", "_mix_k", "_mix_q")
    of = numbered(rows).select("_mix_i", "_mix_k", "_mix_h", F.shiftright("_mix_h", 54).alias("_mix_r")).join(some, ["_mix_i", "_mix_k"])
    upto = Window.partitionBy("_mix_i", "_mix_k").orderBy("_mix_r").rowsBetween(Window.unboundedPreceding, -1)
    ranges = of.groupBy("_mix_i", "_mix_k", "_mix_r").agg(F.count("*").alias("_mix_c"), F.first("_mix_q").alias("_mix_q")).withColumn("_mix_o", F.coalesce(F.sum("_mix_c").over(upto), F.lit(0)))
    last = ranges.where((F.col("_mix_o") < F.col("_mix_q")) & (F.col("_mix_q") <= F.col("_mix_o") + F.col("_mix_c"))).select("_mix_i", "_mix_k", "_mix_r", (F.col("_mix_q") - F.col("_mix_o")).alias("_mix_w"))
    inside = of.drop("_mix_q").join(last, ["_mix_i", "_mix_k", "_mix_r"])
    by = Window.partitionBy("_mix_i", "_mix_k").orderBy("_mix_h")
    same = Window.partitionBy("_mix_i", "_mix_k", "_mix_h")
    ranked = inside.select("*", F.row_number().over(by).alias("_mix_1"), F.rank().over(by).alias("_mix_2"), F.count("*").over(same).alias("_mix_e"))
    cuts = ranked.where(F.col("_mix_1") == F.col("_mix_w")).select("_mix_i", "_mix_k", F.col("_mix_h").alias("_mix_x"), (F.col("_mix_1") - F.col("_mix_2") + 1).alias("_mix_t"), "_mix_e")
    table = plan.join(cuts, ["_mix_i", "_mix_k"], "left").join(few(sources.drop("_mix_b")), "_mix_i").drop("_mix_i").withColumnRenamed("_mix_k", "_mix_y")
    table = scratch.save(table)
    n, tied = table.agg(F.count("*"), F.count(F.when(F.col("_mix_t") < F.col("_mix_e"), 1))).first()
    sized = base.select("*", size, order)
    joined = sized.join(F.broadcast(table) if n <= BROADCAST_ROWS else table, F.col("source").eqNullSafe(F.col("_mix_s")) & (F.col("_mix_k") == F.col("_mix_y")))
    before = (F.col("_mix_q") == F.col("_mix_n")) | (F.col("_mix_h") < F.col("_mix_x")) | (F.col("_mix_h") == F.col("_mix_x"))
    at_cut = F.coalesce((F.col("_mix_h") == F.col("_mix_x")) & (F.col("_mix_t") < F.col("_mix_e")), F.lit(False))
    out = joined.withColumn("_mix_z", F.coalesce(before, F.lit(False)).cast("int"))
    if tied:  # rows that are equal, of which some are taken
        number = F.row_number().over(Window.partitionBy("source", "_mix_k").orderBy("_mix_h"))
        out = out.where(~at_cut).unionByName(out.where(at_cut).withColumn("_mix_z", (number <= F.col("_mix_t")).cast("int")))
    return out.select(*base.columns, F.col("_mix_k").alias("size"), "source_size", "target", (F.col("_mix_k") * (F.col("_mix_p") + F.col("_mix_z"))).alias("taken"))
