"""Quality rules: hard limits, then robust multivariate outliers.

Each text gives a vector of transformed shares. For each language and source a minimum-covariance-determinant estimate
is made over all rows: from several starts (medians and median deviations, and seeded random subsets) concentration
steps take the mean and scatter of the ``core`` share of rows with the smallest distances; after two steps the start
with the smallest determinant goes on until the determinant no longer falls. FLOORS, the squares of the least standard
deviations that the parts are taken to have, are added to each scatter, so parts that hardly vary don't make it
singular (a regularised estimate with a diagonal target). Distances are scaled so that their median is that of a
chi-square, and rows beyond its upper ``reject`` quantile are rejected.

Everything is DataFrame expressions, the factorisation of the group matrices too; groups and their estimates are
tables, and only one row of sums comes to the driver after each step.
"""

from __future__ import annotations

from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .native import let, total

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKS = "!?;:\"'()[]{}=+_/\\~^@`"
DIGITS = "0123456789"
#: The vector's parts and the least standard deviation that each is taken to have.
PARTS = {"v_word": 0.15, "v_symbol": 0.05, "v_upper": 0.06, "v_mark": 0.05, "v_digit": 0.08, "v_stutter": 0.06}
P = len(PARTS)
#: Up to so many groups, of about 300 bytes, are sent to every executor; more are joined.
BROADCAST_ROWS = 100_000


def repeated_words(words: Column, window: int) -> Column:
    """Words that lie in windows found twice or more."""

    def covered(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def count(p: Column) -> Column:
            again = F.filter(p, lambda x, i: (F.get(p, i - 1)["h"] == x["h"]) | (F.get(p, i + 1)["h"] == x["h"]))
            at = F.array_sort(F.transform(again, lambda x: x["i"]))
            start = F.struct(F.lit(-window).alias("last"), F.lit(0).cast("long").alias("n"))
            return F.aggregate(at, start, lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(window), i - a["last"])).alias("n")), lambda a: a["n"])

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(pairs, count))

    def both(parts: Column, apart: int) -> Column:
        """Hashes of what begins at i and at i + apart."""
        return F.transform(F.slice(parts, 1, F.greatest(F.lit(0), F.size(parts) - apart)), lambda v, i: F.xxhash64(v, F.get(parts, i + apart)))

    def windows(h: Column, size: int = 1) -> Column:
        # twice the size from two neighbours; at last two that overlap make the window
        if 2 * size <= window:
            return let(both(h, size), lambda x: windows(x, 2 * size))
        return both(h, window - size) if size < window else h

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) < window, F.lit(0).cast("long")).otherwise(let(let(hashed, lambda h: windows(h)), covered))


def count_of(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def statistics(docs: DataFrame, window: int = 8) -> DataFrame:
    """doc_id, lang, source, the counted columns and the vector of each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", "lang", "source", text.alias("text"))
    solid = F.length(F.translate("text", SPACES, "")).cast("long")
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    lines = F.filter(F.split("text", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    counted = base.select(
        "doc_id", "lang", "source",
        let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w, window).alias("n_repeat_words"), F.size(F.filter(w, lambda x, i: x == F.get(w, i - 1))).alias("stutter"))).alias("w"),
        solid.alias("word_chars"), count_of(F.col("text"), SYMBOLS).alias("n_symbols"),
        let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias("n_dup_lines"),
        count_of(F.col("text"), UPPER).alias("u"), count_of(F.col("text"), MARKS).alias("m"), count_of(F.col("text"), DIGITS).alias("d"),
    )
    n, c = F.col("w.n_words"), F.col("word_chars") + 60

    def share(part: Column, whole: Column) -> Column:
        return F.sqrt(part / whole)

    return counted.select(
        "doc_id", "lang", "source", n.alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("w.n_repeat_words").alias("n_repeat_words"),
        F.log((F.col("word_chars") + 60) / (n + 12)).alias("v_word"), share(F.col("n_symbols"), c).alias("v_symbol"), share(F.col("u") + 2, c).alias("v_upper"), share(F.col("m"), c).alias("v_mark"), share(F.col("d"), c).alias("v_digit"),
        share(F.col("w.stutter"), n + 20).alias("v_stutter"),
    )


def chi_square(p: int, share: float) -> float:
    """Quantile of a chi-square with p degrees of freedom (Wilson and Hilferty)."""
    return p * (1 - 2 / (9 * p) + NormalDist().inv_cdf(share) * (2 / (9 * p)) ** 0.5) ** 3


def joined(rows: DataFrame, table: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    return rows.join(F.broadcast(table) if table.count() <= BROADCAST_ROWS else table, on, how)


PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


def polynomial() -> Column:
    """The vector's parts and their products, of which a distance is a weighted sum."""
    names = list(PARTS)
    return F.array(*[F.col(c) for c in names], *[F.col(names[i]) * F.col(names[j]) for i, j in PAIRS])


def weights(found: DataFrame) -> DataFrame:
    """found with c: the weights of polynomial(), and the constant, that give the squared distance by m and l."""
    at = lambda i, j: F.get("l", F.lit(i * (i + 1) // 2 + j))
    out = found
    for i in range(P):  # the inverse of l, row by row
        for j in range(i + 1):
            rest = reduce(lambda a, k: a - at(i, k) * F.col(f"_r{k}_{j}"), range(j, i), F.lit(1.0 if i == j else 0.0))  # noqa: B023
            out = out.withColumn(f"_r{i}_{j}", rest / at(i, i))
    for i, j in PAIRS:
        out = out.withColumn(f"_w{i}_{j}", reduce(lambda a, k: a + F.col(f"_r{k}_{i}") * F.col(f"_r{k}_{j}"), range(j, P), F.lit(0.0)))  # noqa: B023
    w = lambda i, j: F.col(f"_w{min(i, j)}_{max(i, j)}")
    m = [F.get("m", F.lit(i)) for i in range(P)]
    linear = [total([w(i, j) * m[j] for j in range(P)]) for i in range(P)]
    c = F.array(*[-2 * x for x in linear], *[w(i, j) * (1 if i == j else 2) for i, j in PAIRS], total([x * y for x, y in zip(linear, m, strict=True)]))
    return out.select(*found.columns, c.alias("c"))


def measured(rows: DataFrame, found: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """rows with d2, and s where found has it. The sum runs over arrays: as one expression it would be too large to be compiled."""
    near = joined(rows, weights(found).drop("m", "l", "logdet"), on, how)
    terms = F.zip_with("c", polynomial(), lambda c, x: c * F.coalesce(x, F.lit(1.0)))  # the constant has no partner
    return near.withColumn("d2", F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x))).drop("c")


def factored(moments: DataFrame) -> DataFrame:
    """(g, s, m, l, logdet) from (g, s, n, sums x_i, sums of products x_i_j)."""
    out = moments
    for i in range(P):
        out = out.withColumn(f"m{i}", F.col(f"x_{i}") / F.col("n"))
    floor = list(PARTS.values())
    for i in range(P):
        for j in range(i + 1):
            cov = F.greatest(F.lit(0.0), F.col(f"x_{j}_{i}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")) + floor[i] ** 2 if i == j else F.col(f"x_{j}_{i}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}")
            rest = reduce(lambda a, k: a - F.col(f"l{i}_{k}") * F.col(f"l{j}_{k}"), range(j), cov)  # noqa: B023
            # rounding can't take a pivot below its floor by much
            out = out.withColumn(f"l{i}_{j}", F.sqrt(F.greatest(rest, F.lit(floor[i] ** 2 / 4))) if i == j else rest / F.col(f"l{j}_{j}"))
    logdet = reduce(lambda a, b: a + b, [2 * F.log(F.col(f"l{i}_{i}")) for i in range(P)])
    return out.select("g", "s", F.array(*[f"m{i}" for i in range(P)]).alias("m"), F.array(*[f"l{i}_{j}" for i in range(P) for j in range(i + 1)]).alias("l"), logdet.alias("logdet"))


def moments() -> list[Column]:
    names = list(PARTS)
    return [F.count("*").alias("n")] + [F.sum(c).alias(f"x_{i}") for i, c in enumerate(names)] + [F.sum(F.col(names[i]) * F.col(names[j])).alias(f"x_{i}_{j}") for i, j in PAIRS]


def starts(rows: DataFrame, number: int, size: int) -> DataFrame:
    """Start 0: medians and median deviations. Others: about ``size`` rows of the group, by a seeded hash."""
    names = list(PARTS)
    middle = rows.groupBy("g").agg(F.count("*").alias("rows"), F.array(*[F.percentile_approx(c, 0.5, 10_000) for c in names]).alias("middle"))
    near = joined(rows, middle, ["g"])
    spread = near.groupBy("g").agg(F.first("middle").alias("m"), *[F.percentile_approx(F.abs(F.col(c) - F.get("middle", F.lit(i))), 0.5, 10_000).alias(f"d{i}") for i, c in enumerate(names)])
    sd = [F.sqrt((1.4826 * F.col(f"d{i}")) ** 2 + w * w) for i, w in enumerate(PARTS.values())]
    diagonal = F.array(*[sd[i] if i == j else F.lit(0.0) for i in range(P) for j in range(i + 1)])
    first = spread.select("g", F.lit(0).alias("s"), F.col("m"), diagonal.alias("l"), F.lit(None).cast("double").alias("logdet"))
    if number < 2:
        return first
    dealt = near.withColumn("s", F.explode(F.sequence(F.lit(1), F.lit(number - 1))))
    drawn = dealt.where(F.pmod(F.xxhash64("s", *names), F.greatest(F.lit(1), (F.col("rows") / size).cast("long"))) == 0)
    return first.unionByName(factored(drawn.groupBy("g", "s").agg(*moments())))


def concentrated(rows: DataFrame, found: DataFrame, core: float) -> DataFrame:
    """Estimates from the ``core`` share of rows that are nearest by the estimates ``found``."""
    near = measured(rows, found, ["g"])
    edge = near.groupBy("g", "s").agg(F.percentile_approx("d2", core, 10_000).alias("edge"))
    return factored(joined(near, edge, ["g", "s"]).where("d2 <= edge").groupBy("g", "s").agg(*moments()))


def estimate(rows: DataFrame, core: float, scratch: Scratch, number: int = 4, size: int = 60, steps: int = 30) -> DataFrame:
    """(g, m, l, logdet) of each group of rows (g and PARTS)."""
    found = scratch.save(starts(rows, number, size))
    for _ in range(2):
        found = scratch.save(concentrated(rows, found, core))
    best = found.groupBy("g").agg(F.min_by(F.struct("s", "m", "l", "logdet"), F.struct("logdet", "s")).alias("b")).select("g", "b.*")
    best = scratch.save(best)
    for _ in range(steps):
        then = scratch.save(concentrated(rows, best, core))
        gain = best.select("g", F.col("logdet").alias("was")).join(then, "g").agg(F.max(F.col("was") - F.col("logdet"))).first()[0]
        scratch.drop(best)
        best = then
        if gain is None or gain < 1e-4:
            break
    return best


def judge(docs: DataFrame, core: float = 0.75, reject: float = 5e-5, least: int = 200, min_words: int = 20, max_repeat_percent: int = 30) -> DataFrame:
    """Per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance.

    Null and empty texts have zero counts and fail the base rules. Null languages and sources are groups like others.
    A (lang, source) with fewer than ``least`` rows that pass the base rules is estimated with its language's small
    sources together, and with all small groups where those are still too few; distance is null where the base rules
    fail. Groups whose rows are all alike have the floors as scatter. Repeated rows are judged alike. Extra columns are
    ignored; empty tables give none.
    """
    scratch = Scratch(docs.sparkSession)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    rows = scratch.save(statistics(docs).withColumn("base_failed", failed))
    sizes = rows.where(~F.col("base_failed")).groupBy("lang", "source").agg(F.count("*").alias("n"))
    few = sizes.where(F.col("n") < least).groupBy("lang").agg(F.sum("n").alias("few"))
    both = sizes.join(few.withColumnRenamed("lang", "_l"), F.col("lang").eqNullSafe(F.col("_l")), "left")
    level = F.when(F.col("n") >= least, 2).when(F.col("few") >= least, 1).otherwise(0)
    name = lambda c, at: F.concat(F.when(level < at, "-").when(F.col(c).isNull(), "?").otherwise(F.lit("=")), F.coalesce(F.when(level >= at, F.col(c)), F.lit("")))
    groups = scratch.save(both.select(F.col("lang").alias("_lang"), F.col("source").alias("_source"), F.struct(name("lang", 1).alias("lang"), name("source", 2).alias("source")).alias("g")))
    few_groups = groups.count() <= BROADCAST_ROWS
    named = rows.join(F.broadcast(groups) if few_groups else groups, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left").drop("_lang", "_source")
    good = scratch.save(named.where(~F.col("base_failed")).select("g", *PARTS))
    found = estimate(good, core, scratch)
    scale = measured(good, found.drop("s"), ["g"]).groupBy("g").agg((F.percentile_approx("d2", 0.5, 10_000) / chi_square(P, 0.5)).alias("scale"))
    # never let a tight core shrink the scale below the floors
    final = scratch.save(found.drop("logdet", "s").join(scale, "g").select("g", "m", F.transform("l", lambda x: x * F.sqrt(F.greatest(F.lit(1.0), F.col("scale")))).alias("l")))
    out = measured(named, final, ["g"], "left")
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(F.col("d2") <= chi_square(P, 1 - reject), F.lit(False))).alias("kept"), F.when(~F.col("base_failed"), F.col("d2")).alias("distance"),
    )
