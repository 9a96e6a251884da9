"""Multi-dimensional hash slicing of traces, and the choice of shares."""

from __future__ import annotations

import json
import random
import subprocess
import tempfile
from dataclasses import dataclass, field
from math import prod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..formula.ast import Const, Formula, Pred, Var, atoms, free_variables


def shares_of(formula: Formula, degree: int, sizes: dict[str, float], active: set[str] | None = None) -> dict[str, int]:
    """Shares (per free variable) of at most ``degree`` slices with the least data per slice; on ties the most even ones."""
    names = sorted(free_variables(formula))
    parts = {(a.relation, frozenset(t.name for t in a.args if isinstance(t, Var) and t.name in names)) for a in set(atoms(formula))}
    weights = [(sizes.get(r, 100.0), vs) for r, vs in parts]
    best: tuple | None = None

    def options(left: int, todo: list[str]):
        if not todo:
            yield ()
            return
        top = left if active is None or todo[0] in active else 1
        for p in range(1, top + 1):
            for rest in options(left // p, todo[1:]):
                yield (p, *rest)

    for shares in options(degree, names):
        by = dict(zip(names, shares, strict=True))
        cost = sum(w / prod(by[v] for v in vs) for w, vs in weights)
        if best is None or (cost, max(shares, default=1)) < best[:2]:
            best = (cost, max(shares, default=1), by)
    return best[2] if best else {}


@dataclass
class Slicer:
    """Sends each fact to the slices that may need it; verdicts are kept in the one slice that they hash to.

    heavy: variables with values that are too frequent for hashing; shares has one entry for each set of heavy
    variables that are heavy in a binding (as a bit mask over sorted heavy names).
    """

    formula: Formula
    shares: list[dict[str, int]]
    heavy: dict[str, set] = field(default_factory=dict)
    seed: int = 1234

    @classmethod
    def optimize(cls, formula: Formula, degree: int, sizes: dict[str, float], heavy: dict[str, set] | None = None) -> Slicer:
        heavy = {v: s for v, s in (heavy or {}).items() if s}
        if len(heavy) > 30:
            raise ValueError("too many variables with heavy values")
        names = sorted(heavy)
        masks = [{names[i] for i in range(len(names)) if m >> i & 1} for m in range(1 << len(names))]
        return cls(formula, [shares_of(formula, degree, sizes, set(free_variables(formula)) - on) for on in masks], heavy)

    @classmethod
    def of_shares(cls, formula: Formula, shares: dict[str, int], seed: int = 1234) -> Slicer:
        """A slicer with the user's shares; variables that are not named have one."""
        return cls(formula, [{v: int(shares.get(v, 1)) for v in free_variables(formula)}], seed=seed)

    def to_text(self) -> str:
        """Heavy values, shares and seed as JSON; of_text() reads it."""
        return json.dumps({"heavy": {v: sorted(s, key=str) for v, s in sorted(self.heavy.items())}, "shares": self.shares, "seed": self.seed}, sort_keys=True)

    @classmethod
    def of_text(cls, formula: Formula, text: str) -> Slicer:
        x = json.loads(text)
        return cls(formula, x["shares"], {v: set(s) for v, s in x["heavy"].items()}, x["seed"])

    def requires_filter(self) -> bool:
        """Whether a slice can give verdicts that belong to another: a relation in several atoms, an atom without free variables, or heavy values."""
        own = list(dict.fromkeys(atoms(self.formula)))
        free = set(free_variables(self.formula))
        rigid = any(not free & {t.name for t in a.args if isinstance(t, Var)} for a in own)
        return bool(self.heavy) or rigid or len({a.relation for a in own}) < len(own)

    def to_all(self, commands: DataFrame) -> DataFrame:
        """Each command once for each slice."""
        return commands.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(self.degree - 1))))

    def dealt(self, sliced: DataFrame) -> DataFrame:
        """sliced with each slice in a partition of its own; no two slices share one."""
        return sliced.repartitionById(self.degree, F.col("slice"))

    @property
    def degree(self) -> int:
        return max(prod(s.values()) for s in self.shares)

    def seeds(self, mask: int) -> dict[str, int]:
        r = random.Random(f"{self.seed}:{sorted(self.shares[mask].items())}")
        return {v: r.randrange(1 << 30) for v in sorted(self.shares[mask])}

    def is_heavy(self, v: str, c: Column) -> Column:
        return c.cast("string").isin([str(x) for x in self.heavy[v]]) if v in self.heavy else F.lit(False)

    def slices(self, bound: dict[str, Column]) -> Column:
        """Array of slice numbers of a binding of some variables: missing ones range over their dimension, and over
        heavy and not heavy."""
        names, heavy = sorted(free_variables(self.formula)), sorted(self.heavy)
        arrays = []
        for mask, shares in enumerate(self.shares):
            fits, seeds = F.lit(True), self.seeds(mask)
            for i, v in enumerate(heavy):
                if v in bound:
                    fits = fits & (self.is_heavy(v, bound[v]) == bool(mask >> i & 1))
            at, stride, free = F.lit(0), 1, [0]
            for v in names:
                if v in bound:
                    at = at + F.pmod(F.hash(F.lit(seeds[v]), bound[v].cast("string")), F.lit(shares[v])) * stride
                else:
                    free = [f + stride * k for f in free for k in range(shares[v])]
                stride *= shares[v]
            arrays.append(F.when(fits, F.transform(F.array(*map(F.lit, free)), _plus(at))).otherwise(F.array().cast("array<int>")))
        return F.array_distinct(F.concat(*arrays))

    def slice_facts(self, facts: DataFrame) -> DataFrame:
        """facts (relation, tp, ts, args) with slice: a copy for each slice that some matching atom needs."""
        out = []
        for a in dict.fromkeys(atoms(self.formula)):
            ok = (F.col("relation") == a.relation) & (F.size("args") == len(a.args))
            bound: dict[str, Column] = {}
            for i, t in enumerate(a.args):
                value = F.get("args", F.lit(i))
                if isinstance(t, Const):
                    ok = ok & (value == str(t.value))
                elif t.name in bound:
                    ok = ok & (value == bound[t.name])
                else:
                    bound[t.name] = value
            free = set(free_variables(self.formula))
            out.append(F.when(ok, self.slices({v: c for v, c in bound.items() if v in free})).otherwise(F.array().cast("array<int>")))
        return facts.withColumn("slice", F.explode(F.array_distinct(F.concat(*out))))

    def keeps(self, verdicts: DataFrame) -> DataFrame:
        """Verdicts (slice, tp, ts, variables) that belong to their slice."""
        return verdicts.where(F.array_contains(self.slices({v: F.col(v) for v in free_variables(self.formula)}), F.col("slice")))


def _plus(at: Column):
    return lambda x: (x + at).cast("int")


def slice_load(sliced: DataFrame, size: int = 60) -> DataFrame:
    """(start, slice, relation, n) of sliced facts."""
    from ..functions.statistics import window_start

    return sliced.groupBy(window_start(F.col("ts"), size).alias("start"), "slice", "relation").agg(F.count("*").alias("n"))


def slicing_cost(sliced: DataFrame) -> DataFrame:
    """One row: the most events of any slice."""
    return sliced.groupBy("slice").agg(F.count("*").alias("n")).agg(F.max("n").alias("cost"))


def should_switch(cost_now: float, cost_new: float, per_event: float, shutdown: float, stability: float) -> tuple[bool, float]:
    """Whether new shares pay for the switch, and the next stability (one more while stable, halved on a switch)."""
    go = cost_new * per_event + shutdown / max(stability, 1e-9) < cost_now * per_event
    return go, stability / 2 if go else stability + 1


def through_process(lines: DataFrame, command: list[str], slices: int) -> DataFrame:
    """(slice, line) that a process of the command writes for each slice, given its lines (slice, tp, line) in order of tp.

    A task streams a slice's lines to the process; what comes back waits in a file of the task's own.
    """

    def run(batches):
        import pyarrow as pa

        now, process, out = None, None, None

        def end():
            process.stdin.close()
            if process.wait():
                raise RuntimeError(f"{command[0]} ended with {process.returncode}")
            out.seek(0)
            got = out.read().decode().splitlines()
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([now] * len(got), pa.int32()), pa.array(got, pa.string())], ["slice", "line"])

        for b in batches:
            for k, line in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if k != now:
                    if process:
                        yield end()
                    now, out = k, tempfile.TemporaryFile()
                    process = subprocess.Popen(command, stdin=subprocess.PIPE, stdout=out)
                process.stdin.write((line + "\n").encode())
        if process:
            yield end()

    mine = lines.repartitionById(slices, F.col("slice")).sortWithinPartitions("slice", "tp", "line")
    return mine.select(F.col("slice").cast("int"), "line").mapInArrow(run, "slice int, line string")


#: Variable that stands for the slice number in a formula evaluated over all slices at once.
SLICE = "slice__"


def with_slice(f: Formula) -> Formula:
    """f with the slice number as a further argument of every predicate."""
    return Pred(f.relation, (*f.args, Var(SLICE))) if isinstance(f, Pred) else f.rebuilt(with_slice)


def run_sliced(slicer: Slicer, facts: DataFrame, timepoints: DataFrame, sig) -> DataFrame:
    """Verdicts by slice, filtered and merged; equal to the unsliced ones.

    The slice is a key column of one plan. Only formulas that are not bounded with it (negations without variables)
    are planned slice by slice.
    """
    from ..monitor import Monitor
    from ..plans.compile import bounded
    from ..sources.traces import relations

    sliced = slicer.slice_facts(facts)
    keyed = with_slice(slicer.formula)
    if bounded(keyed):
        wide = {name: [*cols, (SLICE, "int")] for name, cols in sig.items()}
        tagged = sliced.withColumn("args", F.concat("args", F.array(F.col("slice").cast("string"))))
        found = Monitor(keyed).run(relations(tagged, wide), timepoints)
        return slicer.keeps(found.withColumnRenamed(SLICE, "slice")).select("tp", "ts", *free_variables(slicer.formula))
    parts = []
    for k in range(slicer.degree):
        mine = sliced.where(F.col("slice") == k)
        parts.append(slicer.keeps(Monitor(slicer.formula).run(relations(mine, sig), timepoints).withColumn("slice", F.lit(k))).drop("slice"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


__all__ = ["Slicer", "run_sliced", "through_process", "shares_of", "should_switch", "slice_load", "slicing_cost"]
