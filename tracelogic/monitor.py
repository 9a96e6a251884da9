"""The user's entry: a formula, a trace, verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .formula import ast
from .formula.rewrite import push_negation, read
from .plans.compile import Compiler, bounded


class Monitor:
    """Evaluates one formula; ``negate`` asks for its violations, ``collapse`` merges time-points of equal time-stamp."""

    def __init__(self, formula: str | ast.Formula, negate: bool = False, collapse: bool = False, strip_brackets: bool = True):
        f = read(formula, strip_brackets) if isinstance(formula, str) else formula
        if negate:
            f = ast.Not(f) if bounded(ast.Not(f)) else push_negation(ast.Not(f))
        self.formula = f
        self.collapse = collapse

    @property
    def columns(self) -> list[str]:
        return ast.free_variables(self.formula)

    def run(self, relations: dict[str, DataFrame], timepoints: DataFrame) -> DataFrame:
        """(tp, ts, one column per free variable) of each satisfying binding; closed formulas have no further column."""
        if self.collapse:
            # neighbours must be one apart, so merged time-points are numbered anew
            order = number(timepoints.select("ts").distinct(), ["ts"], "ts")
            relations = {k: d.drop("tp").join(order, "ts").select("tp", "ts", *[c for c in d.columns if c not in ("tp", "ts")]) for k, d in relations.items()}
            timepoints = order
        compiler = Compiler(relations, timepoints)
        f = self.formula
        out = compiler.plan(f) if bounded(f) else compiler.holds(compiler.t, f)
        return out.select("tp", "ts", *[F.col(f"v_{v}").alias(v) for v in self.columns])


def number(df: DataFrame, order: list[str], ts: str, width: int = 60) -> DataFrame:
    """df with dense tp from 0 in the given order: counts per time bucket give offsets, rows are numbered in buckets."""
    from pyspark.sql.window import Window

    cut = df.withColumn("_w", F.floor(F.col(ts) / width).cast("long"))
    counts = cut.groupBy("_w").agg(F.count("*").alias("_n"))
    # two levels, so that no task sorts all buckets
    coarse = counts.groupBy(F.floor(F.col("_w") / 1024).alias("_c")).agg(F.sum("_n").alias("_m"))
    before = Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    coarse = coarse.withColumn("_before", F.coalesce(F.sum("_m").over(before), F.lit(0))).drop("_m")
    inner = Window.partitionBy("_c").orderBy("_w").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_c", F.floor(F.col("_w") / 1024)).withColumn("_in", F.coalesce(F.sum("_n").over(inner), F.lit(0))).join(coarse, "_c").select("_w", (F.col("_in") + F.col("_before")).alias("_o"))
    numbered = cut.withColumn("_r", F.row_number().over(Window.partitionBy("_w").orderBy(*order)))
    return numbered.join(starts, "_w").withColumn("tp", (F.col("_o") + F.col("_r") - 1).cast("long")).select("tp", *df.columns)
