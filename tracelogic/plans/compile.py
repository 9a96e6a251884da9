"""Formulas to DataFrame plans.

A sub-plan has columns tp, ts and one ``v_<name>`` for each free variable, without duplicates. Conjunctions are
flattened: bounded parts are joined, comparisons bind or filter, negations are anti joins, and temporal parts are
fused with what guards them. Interval joins are equi-joins on the shared variables and a time bucket as wide as the
interval, so no cross product and no scan over all time-points is planned.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..formula.ast import ANY, And, Compare, Const, Eventually, Exists, Forall, Formula, FormulaError, Interval, Next, Not, Once, Or, Pred, Prev, Release, Since, Trigger, Truth, Until, Var, free_variables

TIME = ["tp", "ts"]
#: Time-points (or seconds) that are sorted in one task.
BUCKET = 1 << 16
#: Hits that meet the time-points together.
BLOCK = 64
#: Time-points that a task meets on average. Parquet's dictionaries hold 131072 longs; a file with more takes much more space.
DEALT = 1 << 14
#: Intervals that are sorted in one task for a key; rows near a border also stand in the bucket beyond it.
SPAN = 16


def variables(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("v_")]


def names(f: Formula) -> list[str]:
    return [f"v_{v}" for v in free_variables(f)]


def conjuncts(f: Formula) -> list[Formula]:
    if isinstance(f, And):
        return conjuncts(f.left) + conjuncts(f.right)
    if isinstance(f, Not) and isinstance(f.arg, Or):
        return conjuncts(Not(f.arg.left)) + conjuncts(Not(f.arg.right))
    if isinstance(f, Not) and isinstance(f.arg, Not):
        return conjuncts(f.arg.arg)
    return [f]


def bounded(f: Formula) -> bool:
    """Whether f can be evaluated by itself: it yields all its free variables."""
    if isinstance(f, (Pred, Truth)):
        return True
    if isinstance(f, Compare):
        return f.op == "=" and isinstance(f.left, Const) != isinstance(f.right, Const) or not free_variables(f)
    if isinstance(f, Not):
        return not free_variables(f) and bounded(f.arg)
    if isinstance(f, And):
        parts = conjuncts(f)
        have = {v for p in parts if bounded(p) for v in free_variables(p)}
        for _ in parts:
            have |= {v for p in parts if isinstance(p, Compare) and p.op == "=" and len(set(free_variables(p)) - have) == 1 for v in free_variables(p)}
        return any(map(bounded, parts)) and set(free_variables(f)) <= have
    if isinstance(f, Or):
        return bounded(f.left) and bounded(f.right) and set(free_variables(f.left)) == set(free_variables(f.right))
    if isinstance(f, (Exists, Prev, Next, Once, Eventually)):
        return bounded(f.arg)
    if isinstance(f, (Since, Until)):
        left = f.left.arg if isinstance(f.left, Not) else f.left
        return bounded(f.right) and bounded(left) and set(free_variables(left)) <= set(free_variables(f.right))
    return False


class Compiler:
    """Plans over relations (name to DataFrame tp, ts, x0, x1, ...) and the time-points (tp, ts; tp dense)."""

    def __init__(self, relations: dict[str, DataFrame], timepoints: DataFrame, parts: int = 64):
        self.relations, self.t, self.parts = relations, timepoints.select(*TIME), parts
        self.plans: dict[Formula, DataFrame] = {}
        self._ends: tuple[int, int] | None = None
        self._tasks: int | None = None
        #: Least width of the time buckets in which a key's rows are sorted.
        self.width = 1

    def ends(self) -> tuple[int, int]:
        """First and last time-stamp; asked for only where an interval has no end."""
        if self._ends is None:
            r = self.t.agg(F.min("ts"), F.max("ts")).first()
            self._ends = (r[0] or 0, r[1] or 0)
        return self._ends

    def tasks(self) -> int:
        """Partitions for rows that meet the time-points."""
        if self._tasks is None:
            self._tasks = max(int(self.t.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-self.t.count() // DEALT))
        return self._tasks

    def last_bucket(self) -> int:
        """Bucket of the last time-point."""
        return (self.t.agg(F.max("tp")).first()[0] or 0) // BUCKET

    def plan(self, f: Formula) -> DataFrame:
        """Satisfying (tp, ts, bindings); equal sub-formulas share a plan."""
        if f not in self.plans:
            if not bounded(f):
                raise FormulaError(f"not bounded: {', '.join(free_variables(f)) or f}")
            self.plans[f] = getattr(self, f"_{type(f).__name__.lower()}")(f)
        return self.plans[f]

    # ---- leaves and boolean operators

    def _truth(self, f: Truth) -> DataFrame:
        return self.t if f.value else self.t.where(F.lit(False))

    def _pred(self, f: Pred) -> DataFrame:
        return self.facts(f).distinct()

    def repeated(self, f: Formula) -> DataFrame:
        """As plan, but rows may come up more than once; for what needs no distinct rows."""
        return self.facts(f) if isinstance(f, Pred) else self.plan(f)

    def facts(self, f: Pred) -> DataFrame:
        if f.relation not in self.relations:
            raise FormulaError(f"unknown relation {f.relation}")
        df = self.relations[f.relation]
        if len(df.columns) - 2 != len(f.args):
            raise FormulaError(f"{f.relation} has {len(df.columns) - 2} arguments, not {len(f.args)}")
        seen: dict[str, str] = {}
        for i, a in enumerate(f.args):
            if isinstance(a, Const):
                df = df.where(F.col(f"x{i}") == F.lit(a.value))
            elif a.name in seen:
                df = df.where(F.col(f"x{i}") == F.col(seen[a.name]))
            else:
                seen[a.name] = f"x{i}"
        return df.select(*TIME, *[F.col(c).alias(f"v_{v}") for v, c in seen.items()])

    def _compare(self, f: Compare) -> DataFrame:
        if not free_variables(f):
            return self.t.where(self.test(f))
        var, const = (f.left, f.right) if isinstance(f.left, Var) else (f.right, f.left)
        return self.t.withColumn(f"v_{var.name}", F.lit(const.value))

    def _not(self, f: Not) -> DataFrame:
        return self.t.join(self.plan(f.arg), TIME, "left_anti")

    def _or(self, f: Or) -> DataFrame:
        return self.plan(f.left).unionByName(self.plan(f.right)).distinct()

    def _exists(self, f: Exists) -> DataFrame:
        df = self.plan(f.arg)
        return df.drop(f"v_{f.var}").distinct() if f"v_{f.var}" in df.columns else df

    def _and(self, f: And) -> DataFrame:
        parts = conjuncts(f)
        own = [p for p in parts if bounded(p) and not isinstance(p, (Compare, Not))]
        # relations first, temporal parts where they can be fused with them
        own.sort(key=lambda p: isinstance(p, (Once, Eventually, Truth)))
        if own:
            start = own.pop(0)
        else:
            start = next(p for p in parts if bounded(p))
        rest = [p for p in parts if p is not start]
        df = self.plan(start)
        while rest:
            df, rest = self.step(df, rest)
        return df

    def step(self, df: DataFrame, rest: list[Formula]) -> tuple[DataFrame, list[Formula]]:
        """Apply the best of the conjuncts that can be applied now."""
        have = set(variables(df))
        ready = [p for p in rest if set(names(p)) <= have]
        binder = [p for p in rest if isinstance(p, Compare) and p.op == "=" and len(set(names(p)) - have) == 1]
        joins = [p for p in rest if bounded(p) and not isinstance(p, (Compare, Not))]
        joins.sort(key=lambda p: (not have & set(names(p)), isinstance(p, (Once, Eventually))))
        order = [p for p in ready if isinstance(p, Compare)] + binder + joins + ready
        if not order:
            raise FormulaError("not bounded: " + ", ".join(sorted({v for p in rest for v in free_variables(p)} - {c[2:] for c in have})))
        pick = order[0]
        left = [p for p in rest if p is not pick]
        if pick in binder and pick not in ready:
            new, other = (pick.left, pick.right) if isinstance(pick.left, Var) and f"v_{pick.left.name}" not in have else (pick.right, pick.left)
            return df.withColumn(f"v_{new.name}", self.term(other)), left
        return self.guarded(df, pick), left

    def guarded(self, df: DataFrame, f: Formula) -> DataFrame:
        """Rows of df for which f holds, with f's further variables bound."""
        if isinstance(f, Compare):
            return df.where(self.test(f))
        if isinstance(f, Not) and set(names(f)) <= set(variables(df)):
            return self.lacking(df, f.arg)
        if isinstance(f, (Once, Eventually)) and bounded(f.arg):
            return self.near(df, self.plan(f.arg), f.interval, isinstance(f, Once), "inner")
        if self.one_pass(df, f):
            return self.near_since(df, f, True)
        if bounded(f):
            shared = [c for c in names(f) if c in df.columns]
            how = "left_semi" if len(shared) == len(names(f)) else "inner"
            return df.join(self.plan(f), [*TIME, *shared], how)
        return self.holds(df, f)

    def lacking(self, df: DataFrame, f: Formula) -> DataFrame:
        """Rows of df for which f does not hold."""
        if isinstance(f, Not):
            return self.guarded(df, f.arg)
        if isinstance(f, Compare):
            return df.where(~self.test(f))
        if isinstance(f, (Once, Eventually)) and bounded(f.arg):
            return self.near(df, self.plan(f.arg), f.interval, isinstance(f, Once), "left_anti")
        if isinstance(f, (Trigger, Release)):
            return self.holds(df, dual(f))
        if self.one_pass(df, f):
            return self.near_since(df, f, False)
        if bounded(f):
            return df.join(self.plan(f), [*TIME, *names(f)], "left_anti")
        return df.join(self.holds(df, f), df.columns, "left_anti")

    def test(self, f: Compare) -> Column:
        a, b = self.term(f.left), self.term(f.right)
        return a == b if f.op == "=" else a < b

    @staticmethod
    def term(t) -> Column:
        return F.col(f"v_{t.name}") if isinstance(t, Var) else F.lit(t.value)

    # ---- neighbours

    def _prev(self, f: Prev | Next) -> DataFrame:
        ahead = isinstance(f, Prev)
        moved = self.plan(f.arg).withColumn("tp", F.col("tp") + (1 if ahead else -1)).withColumnRenamed("ts", "_ts")
        # tp is dense, so the neighbour is one away and its time-stamp is the fact's own
        diff = (F.col("ts") - F.col("_ts")) * (1 if ahead else -1)
        return moved.join(self.t, "tp").where(within(diff, f.interval)).select(*TIME, *names(f))

    _next = _prev

    # ---- ONCE and EVENTUALLY

    def _once(self, f: Once | Eventually) -> DataFrame:
        """Unguarded: each hit reaches until the next hit takes over, so no time-point comes up twice."""
        past, i = isinstance(f, Once), f.interval
        # of equal hits all but one are followed at once
        hits, keys = self.repeated(f.arg), names(f)
        if i.hi is None:
            pick = F.min(F.struct("tp", "ts")) if past else F.max(F.struct("tp", "ts"))
            hits = hits.groupBy(*keys).agg(pick.alias("_x")).where("_x is not null").select(*keys, "_x.tp", "_x.ts").withColumn("_n", F.lit(None).cast("long"))
        else:
            hits = follower(hits, keys, i, past)
        hits = hits.withColumnRenamed("tp", "_tp").withColumnRenamed("ts", "_ts")
        out = self.reach(hits, i, past)
        sign = 1 if past else -1
        ok = within((F.col("ts") - F.col("_ts")) * sign, i) & ((F.col("tp") >= F.col("_tp")) if past else (F.col("tp") <= F.col("_tp")))
        if i.hi is not None:
            ok = ok & before(i, past)
        return out.where(ok).select(*TIME, *keys)

    _eventually = _once

    def reach(self, hits: DataFrame, i: Interval, past: bool) -> DataFrame:
        """hits (_tp, _ts, ...) with the time-points in their interval, by buckets of time."""
        if i.hi is None:
            first, last = self.ends()
            width = max(1, (last - first) // self.parts + 1)
            low, high = (F.col("_ts") + i.lo, F.lit(last)) if past else (F.lit(first), F.col("_ts") - i.lo)
        else:
            width = max(1, i.hi - i.lo)
            low, high = (F.col("_ts") + i.lo, F.col("_ts") + i.hi - 1) if past else (F.col("_ts") - i.hi + 1, F.col("_ts") - i.lo)
        # hits of neighbouring time-points go as one array, so the rows of a time-point come one after the other and those
        # of the next repeat them: written by columns, they take little; and a block outside its reach meets no time-point
        # few rows become many, so their partitions are kept as they are, and grow in number with the time-points
        n = self.tasks()
        spread = hits.where(low <= high).withColumn("_b", F.explode(F.sequence(bucket(low, width), bucket(high, width)))).repartition(n, "_b").select("*", low.alias("_low"), high.alias("_high"))
        cut = spread.withColumn("_c", F.floor(F.col("_tp") / BUCKET))
        cut = cut.withColumn("_d", F.floor((F.row_number().over(Window.partitionBy("_b", "_c").orderBy("_tp")) - 1) / BLOCK))
        blocks = cut.groupBy("_b", "_c", "_d").agg(F.collect_list(F.struct(*hits.columns)).alias("_block"), F.min("_low").alias("_low"), F.max("_high").alias("_high"))
        t = self.t.withColumn("_b", bucket(F.col("ts"), width)).repartition(n, "_b").sortWithinPartitions("_b", "tp")
        met = blocks.hint("merge").join(t, "_b").where((F.col("ts") >= F.col("_low")) & (F.col("ts") <= F.col("_high")))
        # compiled into one loop with the join, all rows that a block makes would be held at once; this parts the two and moves
        # no rows, as there are never so many partitions
        return met.select("_block", *TIME).coalesce(1 << 20).select(*TIME, F.inline("_block"))

    def near(self, df: DataFrame, hits: DataFrame, i: Interval, past: bool, how: str) -> DataFrame:
        """Rows of df with a hit in the interval (or without, for left_anti)."""
        keys = variables(hits)
        shared = [c for c in keys if c in df.columns]
        if how == "inner" and len(shared) < len(keys):
            return self.spanned(df, hits, shared, i, past).distinct()
        if i.hi is None:
            pick = F.min(F.struct("tp", "ts")) if past else F.max(F.struct("tp", "ts"))
            best = hits.groupBy(*shared).agg(pick.alias("_x")).where("_x is not null")
            tp, ts = F.col("_x.tp"), F.col("_x.ts")
            ok = ((tp <= F.col("tp")) & (F.col("ts") - ts >= i.lo)) if past else ((tp >= F.col("tp")) & (ts - F.col("ts") >= i.lo))
            joined = df.join(best, shared, "left") if shared else df.join(F.broadcast(best), F.lit(True), "left")
            ok = F.coalesce(ok, F.lit(False))
            return joined.where(ok if how == "inner" else ~ok).select(*df.columns)
        # one pass over both sides, sorted by time within (variables, time bucket)
        width = max(1, i.hi)
        low, high = (F.col("ts") + i.lo, F.col("ts") + i.hi - 1) if past else (F.col("ts") - i.hi + 1, F.col("ts") - i.lo)
        own = df.withColumn("_b", bucket(F.col("ts"), width)).withColumn("_hit", F.lit(None).cast("long"))
        theirs = hits.select(*TIME, *shared).withColumn("_hit", F.col("ts")).withColumn("_b", F.explode(F.sequence(bucket(low, width), bucket(high, width)))).withColumn("_q", F.lit(True))
        both = own.withColumn("_q", F.lit(False)).unionByName(theirs, allowMissingColumns=True)
        part = Window.partitionBy(*shared, "_b")
        if i.lo == 0:
            # a frame that only grows is one pass; so the future is read backwards
            frame = part.orderBy("tp" if past else F.desc("tp")).rangeBetween(Window.unboundedPreceding, 0)
            hit = (F.max if past else F.min)("_hit").over(frame)
            ok = F.coalesce((F.col("ts") - F.col("_m")) * (1 if past else -1) < i.hi, F.lit(False))
        else:
            hit = F.max("_hit").over(part.orderBy("ts").rangeBetween(*((1 - i.hi, -i.lo) if past else (i.lo, i.hi - 1))))
            ok = F.col("_m").isNotNull()
        return both.withColumn("_m", hit).where(~F.col("_q")).where(ok if how == "inner" else ~ok).select(*df.columns)

    def spanned(self, df: DataFrame, hits: DataFrame, shared: list[str], i: Interval, past: bool) -> DataFrame:
        """Pairs of a row of df and a hit in its interval, joined on shared variables and, if the interval ends, time buckets."""
        theirs = hits.withColumnRenamed("tp", "_tp").withColumnRenamed("ts", "_ts")
        keys = list(shared)
        if i.hi is not None:
            width = max(1, i.hi - i.lo)
            low, high = (F.col("_ts") + i.lo, F.col("_ts") + i.hi - 1) if past else (F.col("_ts") - i.hi + 1, F.col("_ts") - i.lo)
            theirs = theirs.withColumn("_b", F.explode(F.sequence(bucket(low, width), bucket(high, width))))
            df = df.withColumn("_b", bucket(F.col("ts"), width))
            keys.append("_b")
        sign = 1 if past else -1
        ok = within((F.col("ts") - F.col("_ts")) * sign, i) & ((F.col("_tp") <= F.col("tp")) if past else (F.col("_tp") >= F.col("tp")))
        joined = df.join(theirs, keys) if keys else df.join(theirs, F.lit(True))
        return joined.where(ok).drop("_tp", "_ts", "_b")

    @staticmethod
    def one_pass(df: DataFrame, f: Formula) -> bool:
        """Whether f is (NOT alpha) SINCE or UNTIL beta of equal variables that df binds, and its rows can be dealt out."""
        if not (isinstance(f, (Since, Until)) and isinstance(f.left, Not) and bounded(f)):
            return False
        keys = set(names(f))
        return set(names(f.left)) == keys <= set(variables(df)) and (f.interval.hi is not None or bool(keys))

    def near_since(self, df: DataFrame, f: Since | Until, keep: bool) -> DataFrame:
        """Rows of df with (keep) or without (NOT alpha) SINCE/UNTIL beta, from the nearest beta and the nearest alpha.

        The nearest beta that the lower bound admits decides: one beyond it is farther away and has more alphas between.
        """
        past, i, keys = isinstance(f, Since), f.interval, names(f)
        sign = 1 if past else -1
        own = df.withColumn("_o", F.col("ts") * sign)
        beta = self.plan(f.right).select(*TIME, *keys, (F.col("ts") * sign + i.lo).alias("_o"), F.struct(*TIME).alias("_beta"))
        alpha = self.plan(f.left.arg).select(*TIME, *keys, (F.col("ts") * sign).alias("_o"), F.col("tp").alias("_alpha"))
        part = list(keys)
        if i.hi is not None:
            # alphas beyond the interval are beyond the beta too
            width = max(1, i.hi)
            spread = lambda d, lo: d.withColumn("_b", F.explode(F.sequence(*[bucket(F.col("ts") + x, width) for x in ((lo, i.hi - 1) if past else (1 - i.hi, -lo))])))
            own, beta, alpha = own.withColumn("_b", bucket(F.col("ts"), width)), spread(beta, i.lo), spread(alpha, 0)
            part.append("_b")
        both = own.withColumn("_q", F.lit(True)).unionByName(beta, allowMissingColumns=True).unionByName(alpha, allowMissingColumns=True)
        pick, by_tp = (F.max, F.col("tp")) if past else (F.min, F.desc("tp"))
        frame = lambda c: Window.partitionBy(*part).orderBy(c).rangeBetween(Window.unboundedPreceding, 0)
        both = both.withColumn("_beta", pick("_beta").over(frame(F.col("_o") if i.lo else by_tp))).withColumn("_alpha", pick("_alpha").over(frame(by_tp)))
        near = within((F.col("ts") - F.col("_beta.ts")) * sign, i)
        clear = F.col("_alpha").isNull() | ((F.col("_alpha") <= F.col("_beta.tp")) if past else (F.col("_alpha") >= F.col("_beta.tp")))
        ok = F.coalesce(near & clear, F.lit(False))
        return both.where("_q").where(ok if keep else ~ok).select(*df.columns)

    # ---- SINCE and UNTIL

    def _since(self, f: Since | Until) -> DataFrame:
        past, i = isinstance(f, Since), f.interval
        if f.left == Truth(True):
            return self.plan((Once if past else Eventually)(i, f.right))
        negated = isinstance(f.left, Not)
        # where the next beta takes over, of equal ones all but one are followed at once
        alpha, beta = (self.repeated(f.left.arg), self.repeated(f.right)) if negated else (self.plan(f.left), self.plan(f.right))
        shared, keys = variables(alpha), names(f)
        if negated:
            # the nearest beta that the lower bound admits decides, so each one reaches until the next takes over
            if i.lo:
                beta = beta.groupBy(*keys, "ts").agg((F.max if past else F.min)("tp").alias("tp"))
            if i.hi is None:
                beta = neighbour(beta, keys, "ts" if i.lo else "tp", past)
        beta = beta.withColumnRenamed("tp", "_tp").withColumnRenamed("ts", "_ts")
        if negated:
            # the nearest alpha beyond beta ends its reach; alphas beyond the interval don't matter
            marks = alpha.withColumnRenamed("tp", "_tp").withColumnRenamed("ts", "_ts").withColumn("_beta", F.lit(False))
            beta = beta.withColumn("_beta", F.lit(True))
            if i.hi is not None:
                # betas and alphas beyond the interval don't matter, so one exchange serves both
                width = max(self.width, i.hi * (SPAN if shared else 1))
                both = copied(beta.unionByName(marks, allowMissingColumns=True), "_ts", i, past, width).repartition(*shared, "_b")
                both = both.withColumn("_n", (F.lead if past else F.lag)("_ts" if i.lo else "_tp").over(Window.partitionBy(*keys, "_b", "_beta").orderBy("_tp")))
                own = F.col("_b") == bucket(F.col("_ts"), width)
            else:
                # without an end the first (last) alpha of each bucket serves all buckets before (after) it
                cut = F.floor(F.col("_tp") / BUCKET).cast("long")
                marks, beta = marks.withColumn("_b", cut), beta.withColumn("_b", cut)
                ends = neighbour(marks.groupBy(*shared, "_b").agg((F.min if past else F.max)("_tp").alias("_e")), shared, "_b", not past).withColumnRenamed("_n", "_from")
                # an alpha also stands in the buckets that see it as the next one
                low, high = (F.coalesce("_from", F.lit(0)), F.col("_b")) if past else (F.col("_b"), F.coalesce("_from", F.lit(self.last_bucket())))
                far = ends.select(*shared, F.col("_e").alias("_tp"), F.explode(F.sequence(low, high)).alias("_c"), "_b").where("_c <> _b").select(*shared, "_tp", F.col("_c").alias("_b")).withColumn("_beta", F.lit(False))
                marks = marks.drop("_ts").unionByName(far)
                both, own = beta.unionByName(marks, allowMissingColumns=True), F.lit(True)
            frame = Window.partitionBy(*shared, "_b").orderBy(F.desc("_tp") if past else "_tp").rangeBetween(Window.unboundedPreceding, -1)
            near = (F.min if past else F.max)(F.when(~F.col("_beta"), F.col("_tp"))).over(frame)
            beta = both.withColumn("_k", near).where("_beta").where(own).drop("_beta", "_b")
            if i.lo == 0:
                beta = beta.withColumn("_n", (F.least if past else F.greatest)("_n", "_k")).drop("_k")
            reach = self.reach(beta, i, past)
            inside = before(i, past)
            if i.lo:
                inside = inside & (F.col("_k").isNull() | ((F.col("tp") < F.col("_k")) if past else (F.col("tp") > F.col("_k"))))
        else:
            # runs of neighbouring time-points; each beta touches one run at most, the last that begins before it (the
            # first that ends after it). Both are cut into buckets of time-points, so a key's rows go to many tasks.
            cut = alpha.withColumn("_b", F.floor(F.col("tp") / BUCKET).cast("long"))
            part = Window.partitionBy(*shared, "_b").orderBy("tp")
            pieces = cut.withColumn("_g", F.col("tp") - F.row_number().over(part)).groupBy(*shared, "_b", "_g").agg(F.min("tp").alias("_s"), F.max("tp").alias("_e"))
            runs = joined_runs(pieces, shared)
            mine = F.floor(F.col("_tp") / BUCKET).cast("long")
            span = F.sequence(F.floor((F.col("_s") - 1) / BUCKET).cast("long"), F.floor((F.col("_e") + 1) / BUCKET).cast("long"))
            spread = runs.withColumn("_b", F.explode(span)).withColumn("_run", F.struct("_s", "_e")).withColumn("_tp", F.col("_s") - 1 if past else F.col("_e") + 1).drop("_s", "_e")
            both = beta.withColumn("_b", mine).withColumn("_beta", F.lit(1)).unionByName(spread.withColumn("_beta", F.lit(0)), allowMissingColumns=True)
            frame = Window.partitionBy(*shared, "_b").orderBy("_tp" if past else F.desc("_tp"), "_beta").rowsBetween(Window.unboundedPreceding, 0)
            held = both.withColumn("_r", F.last("_run", ignorenulls=True).over(frame)).where("_beta = 1").drop("_run", "_b", "_beta")
            held = held.select("*", F.col("_r._s").alias("_s"), F.col("_r._e").alias("_e")).drop("_r")
            touches = ((F.col("_tp") >= F.col("_s") - 1) & (F.col("_tp") < F.col("_e"))) if past else ((F.col("_tp") > F.col("_s")) & (F.col("_tp") <= F.col("_e") + 1))
            held = held.where(touches)
            reach = self.reach(held, i, past)
            inside = ((F.col("tp") > F.col("_tp")) & (F.col("tp") <= F.col("_e"))) if past else ((F.col("tp") < F.col("_tp")) & (F.col("tp") >= F.col("_s")))
        sign = 1 if past else -1
        ordered = (F.col("tp") >= F.col("_tp")) if past else (F.col("tp") <= F.col("_tp"))
        out = reach.where(within((F.col("ts") - F.col("_ts")) * sign, i) & ordered & inside).select(*TIME, *keys)
        if negated:
            return out
        return (out if i.lo else out.unionByName(self.plan(f.right))).distinct()

    _until = _since

    # ---- anything, under a guard

    def holds(self, df: DataFrame, f: Formula) -> DataFrame:
        """Rows of df for which f holds, where df binds all free variables of f."""
        if not set(names(f)) <= set(variables(df)):
            raise FormulaError("not bounded: " + ", ".join(v for v in free_variables(f) if f"v_{v}" not in df.columns))
        if bounded(f) or isinstance(f, (Compare, Not)):
            return self.guarded(df, f) if not isinstance(f, Not) else self.lacking(df, f.arg)
        if isinstance(f, And):
            return self.holds(self.holds(df, f.left), f.right)
        if isinstance(f, Or):
            return self.holds(df, f.left).unionByName(self.holds(df, f.right)).distinct()
        if isinstance(f, Forall):
            return self.lacking(df, Exists(f.var, Not(f.arg)))
        if isinstance(f, (Trigger, Release)):
            return self.lacking(df, dual(f))
        if isinstance(f, Exists):
            if isinstance(f.arg, (And, Not)):
                parts = [p for p in conjuncts(f.arg)]
                out, rest = df, parts
                while rest:
                    out, rest = self.step(out, rest)
                return out.select(*df.columns).distinct()
            raise FormulaError(f"not bounded: {f.var}")
        if isinstance(f, (Prev, Next)):
            step = 1 if isinstance(f, Prev) else -1
            there = df.select(F.col("tp").alias("_tp0"), F.col("ts").alias("_ts0"), *variables(df)).withColumn("tp", F.col("_tp0") - step).join(self.t, "tp")
            there = there.where(within((F.col("_ts0") - F.col("ts")) * step, f.interval))
            good = self.holds(there, f.arg).select(F.col("_tp0").alias("tp"), *variables(df))
            return df.join(good, ["tp", *variables(df)], "left_semi")
        past = isinstance(f, (Once, Since))
        left = Truth(True) if isinstance(f, (Once, Eventually)) else f.left
        right = f.arg if isinstance(f, (Once, Eventually)) else f.right
        # all time-points that the row can see, then the latest (earliest) one at which left fails
        me = df.select(F.col("tp").alias("_tp"), F.col("ts").alias("_ts"), *variables(df)).distinct()
        seen = self.reach(me, Interval(0, f.interval.hi), not past)
        seen = seen.where((F.col("tp") <= F.col("_tp")) if past else (F.col("tp") >= F.col("_tp")))
        seen = seen.where(within((F.col("_ts") - F.col("ts")) * (1 if past else -1), Interval(0, f.interval.hi)))
        key = ["_tp", *variables(df)]
        good = self.holds(seen, right).where(within((F.col("_ts") - F.col("ts")) * (1 if past else -1), f.interval))
        if left == Truth(True):
            found = good
        else:
            bad = self.lacking(seen, left).groupBy(*key).agg((F.max if past else F.min)("tp").alias("_bad"))
            found = good.join(bad, key, "left").where(F.col("_bad").isNull() | ((F.col("tp") >= F.col("_bad")) if past else (F.col("tp") <= F.col("_bad"))))
        found = found.select(F.col("_tp").alias("tp"), *variables(df)).distinct()
        return df.join(found, ["tp", *variables(df)], "left_semi")


def neighbour(df: DataFrame, keys: list[str], column: str, after: bool) -> DataFrame:
    """df with _n, the next larger (smaller) value of the column among rows of equal keys.

    Rows are sorted in buckets of the column; where a bucket has no further value, the first (last) value of the next
    bucket that has any is taken, from a table with one row for each key and bucket.
    """
    # both readers take all columns of one exchange, so the rows are made and moved once
    cut = df.withColumn("_nb", F.floor(F.col(column) / BUCKET).cast("long")).repartition(*keys, "_nb")
    inner = Window.partitionBy(*keys, "_nb").orderBy(column)
    whole = F.struct(column, *[c for c in df.columns if c != column and c not in keys])
    ends = cut.groupBy(*keys, "_nb").agg((F.min if after else F.max)(whole)[column].alias("_nv"))
    # keyed: a key's buckets; else all buckets, again in two steps
    if keys:
        order = Window.partitionBy(*keys).orderBy("_nb")
        ends = ends.withColumn("_nf", (F.lead if after else F.lag)("_nv").over(order))
    else:
        wide = ends.withColumn("_nc", F.floor(F.col("_nb") / BUCKET).cast("long"))
        tops = wide.groupBy("_nc").agg((F.min if after else F.max)("_nv").alias("_nt"))
        tops = tops.withColumn("_nt", (F.lead if after else F.lag)("_nt").over(Window.orderBy("_nc")))
        order = Window.partitionBy("_nc").orderBy("_nb")
        ends = wide.withColumn("_nf", (F.lead if after else F.lag)("_nv").over(order)).join(tops, "_nc").withColumn("_nf", F.coalesce("_nf", "_nt")).drop("_nc", "_nt")
    ends = ends.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_nb").alias("_kb"), "_nf")
    # with a plain equality one of the readers would get a filter against nulls, and an exchange of its own
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)], F.col("_nb").eqNullSafe(F.col("_kb")))
    found = cut.withColumn("_n", (F.lead if after else F.lag)(column).over(inner)).join(ends, same)
    return found.withColumn("_n", F.coalesce("_n", "_nf")).select(*df.columns, "_n")


def copied(df: DataFrame, ts: str, i: Interval, past: bool, width: int) -> DataFrame:
    """df with the time buckets _b in which rows find it as a next one less than the interval's end away; the first (last) is its own."""
    at = F.col(ts)
    return df.withColumn("_b", F.explode(F.sequence(*[bucket(x, width) for x in ((at - i.hi + 1, at) if past else (at, at + i.hi - 1))])))


def follower(hits: DataFrame, keys: list[str], i: Interval, past: bool) -> DataFrame:
    """Hits with _n, the tp (ts under a lower bound) of the next hit of equal keys, or null if that is beyond the interval.

    In one exchange. Under a lower bound the first of each time-stamp stands for all.
    """
    width = i.hi * (SPAN if keys else 1)
    near = copied(hits, "ts", i, past, width).repartition(*keys, "_b")
    if i.lo:
        near = near.groupBy(*keys, "_b", "ts").agg(F.min("tp").alias("tp"))
    found = near.withColumn("_n", (F.lead if past else F.lag)("ts" if i.lo else "tp").over(Window.partitionBy(*keys, "_b").orderBy("tp")))
    return found.where(F.col("_b") == bucket(F.col("ts"), width)).select(*hits.columns, "_n")


def joined_runs(pieces: DataFrame, shared: list[str]) -> DataFrame:
    """Runs from their pieces in buckets (shared, _b, _s, _e): a piece that ends where the next begins goes on in it.

    Only pieces at a bucket's edge are joined; a run through whole buckets is followed in order of its buckets.
    """
    low, high = F.col("_b") * BUCKET, F.col("_b") * BUCKET + BUCKET - 1
    edge = (F.col("_s") == low) | (F.col("_e") == high)
    inner = pieces.where(~edge).select(*shared, "_s", "_e")
    order = Window.partitionBy(*shared).orderBy("_s")
    edges = pieces.where(edge).withColumn("_new", (F.coalesce(F.lag("_e").over(order), F.lit(-2)) != F.col("_s") - 1).cast("int"))
    edges = edges.withColumn("_r", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return inner.unionByName(edges.groupBy(*shared, "_r").agg(F.min("_s").alias("_s"), F.max("_e").alias("_e")).drop("_r"))


def dual(f: Trigger | Release) -> Formula:
    """The SINCE or UNTIL whose negation f is."""
    node = Since if isinstance(f, Trigger) else Until
    right = f.right.arg if isinstance(f.right, Not) else Not(f.right)
    left = f.left.arg if isinstance(f.left, Not) else Truth(not f.left.value) if isinstance(f.left, Truth) else Not(f.left)
    if left == Truth(True):
        return (Once if isinstance(f, Trigger) else Eventually)(f.interval, right)
    return node(f.interval, left, right)


def bucket(ts: Column, width: int) -> Column:
    return F.floor(ts / F.lit(width)).cast("long")


def before(i: Interval, past: bool) -> Column:
    """Whether a time-point comes before the one from which the next hit (_n: its tp, or ts under a lower bound) takes over."""
    if i.lo == 0:
        later = (F.col("tp") < F.col("_n")) if past else (F.col("tp") > F.col("_n"))
    else:
        later = (F.col("ts") < F.col("_n") + i.lo) if past else (F.col("ts") > F.col("_n") - i.lo)
    return F.col("_n").isNull() | later


def within(diff: Column, i: Interval) -> Column:
    return reduce(lambda a, b: a & b, [diff >= i.lo] + ([diff < i.hi] if i.hi is not None else []))


__all__ = ["ANY", "Compiler", "bounded"]
