"""Command line: monitor a trace, look at its statistics, slice, convert, make, split and replay it, compare verdicts.

python -m tracelogic.cli monitor --formula F --trace T [--format csv] [--negate] [--out DIR]
python -m tracelogic.cli analyse --trace T --window 60 --degree 8 [--out DIR]
python -m tracelogic.cli convert --trace T --format csv --to databases --out DIR
python -m tracelogic.cli diff --left V --right V
python -m tracelogic.cli slice --trace T --formula F --degree 8 [--shares x=2,y=4 | --rates p=100,q=10] [--heavy H]
python -m tracelogic.cli simulate --trace T --formula F --degree 8 --window 60 [--mode reactive] [--costs]
python -m tracelogic.cli generate (--pattern star | --signature S) --seconds 60 --event-rate 10 [--formula-out]
python -m tracelogic.cli split --trace T --sources 4 [--sigma 2 --most 5 --period 10]
python -m tracelogic.cli replay --trace T --to csv [--acceleration 10] [--host H --port P]
"""

from __future__ import annotations

import argparse
import json
import socket
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .formula.ast import atoms
from .formula.rewrite import read, show
from .functions import statistics as st
from .monitor import Monitor
from .operators import simulation as sim
from .operators.slicing import Slicer
from .sources import generate as gen
from .sources import traces

FORMATS = ("csv", "databases", "plain", "plain-timed")


def options(argv: list[str] | None) -> argparse.Namespace:
    parser = argparse.ArgumentParser(prog="tracelogic")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("monitor", "analyse", "convert", "diff", "slice", "simulate", "generate", "split", "replay"):
        c = commands.add_parser(name)
        c.add_argument("--out", help="folder for the result; else it is printed")
        if name == "diff":
            c.add_argument("--left", required=True)
            c.add_argument("--right", required=True)
            c.add_argument("--collapse", action="store_true", help="compare by time-stamp")
            continue
        if name == "generate":
            made = c.add_mutually_exclusive_group(required=True)
            made.add_argument("--pattern", help="star, linear, triangle, or the variables of A, B and C such as ab,bc,ca")
            made.add_argument("--signature", help="signature file; its relations are equally likely")
            for option, kind, default in (("--seconds", int, 60), ("--event-rate", int, 10), ("--index-rate", int, 1), ("--violations", float, 0.01), ("--window", int, 10), ("--share-a", float, 1 / 3), ("--share-b", float, 1 / 3), ("--zipf", float, 0.0), ("--seed", int, 314159265), ("--domain", int, 1000), ("--fresh", float, 0.25)):
                c.add_argument(option, type=kind, default=default)
            c.add_argument("--formula-out", action="store_true", help="the pattern's formula in place of the trace")
            c.add_argument("--signature-out", action="store_true", help="the pattern's signature in place of the trace")
            continue
        c.add_argument("--trace", required=True)
        c.add_argument("--format", choices=FORMATS, default="csv")
        if name == "monitor":
            c.add_argument("--formula", required=True, help="the formula, or a file that holds it")
            c.add_argument("--signature", help="signature file; else all arguments are texts")
            c.add_argument("--negate", action="store_true")
            c.add_argument("--collapse", action="store_true")
            c.add_argument("--grouped", action="store_true")
        elif name == "analyse":
            c.add_argument("--window", type=int, default=60)
            c.add_argument("--degree", type=int, default=8)
            c.add_argument("--formula", help="only facts that match its atoms")
        elif name in ("slice", "simulate"):
            c.add_argument("--formula", required=True, help="the formula, or a file that holds it")
            c.add_argument("--degree", type=int, default=8)
            if name == "simulate":
                c.add_argument("--window", type=int, default=60)
                c.add_argument("--mode", choices=(*sim.MODES, "adaptive"), default="predictive")
                c.add_argument("--costs", action="store_true", help="start,cost of each window in place of the trace")
            else:
                c.add_argument("--shares", help="variable=number, joined by comma")
                c.add_argument("--rates", help="relation=number, joined by comma; else all are alike")
                c.add_argument("--heavy", help="relation,attribute,value file")
                c.add_argument("--dump-shares", action="store_true", help="only the slicer's text")
        elif name == "split":
            c.add_argument("--sources", type=int, default=2)
            c.add_argument("--weights", help="numbers joined by comma, one for each source")
            c.add_argument("--sigma", type=float, default=0.0, help="spread of the delays; 0 is none")
            c.add_argument("--most", type=int, default=5)
            c.add_argument("--period", type=int, default=10, help="seconds between watermarks")
            c.add_argument("--seed", type=int, default=0)
        else:
            c.add_argument("--to", choices=FORMATS, required=True)
            if name == "replay":
                c.add_argument("--acceleration", type=float, default=1.0, help="0 is as fast as can be")
                c.add_argument("--host", help="with --port: lines go to a socket in place of the output")
                c.add_argument("--port", type=int)
    return parser.parse_args(argv)


def text_of(x: str) -> str:
    path = Path(x)
    return path.read_text() if len(x) < 4096 and "\n" not in x and path.is_file() else x


def pairs_of(x: str | None, kind) -> dict:
    return {k.strip(): kind(v) for k, v in (p.split("=") for p in x.split(","))} if x else {}


def written(facts: DataFrame, times: DataFrame, to: str) -> DataFrame:
    """(tp, line) in a format."""
    if to == "csv":
        return traces.csv_lines(facts)
    if to == "databases":
        return traces.database_lines(facts, times)
    return traces.plain_lines(traces.linearized(facts), timed=to == "plain-timed")


def generated(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    if o.signature:
        facts = gen.generate_signature(spark, traces.signature(text_of(o.signature)), o.seconds, o.event_rate, o.index_rate, o.domain, o.fresh, seed=o.seed)
        return traces.csv_lines(facts)
    pattern = o.pattern if o.pattern in gen.PATTERNS else tuple(o.pattern.split(","))
    said = [show(gen.formula_of(pattern, o.window))] if o.formula_out else gen.signature_of(pattern).splitlines() if o.signature_out else None
    if said:
        return spark.createDataFrame([(x,) for x in said], "line string")
    return traces.csv_lines(gen.generate(spark, gen.Workload(pattern, o.seconds, o.event_rate, o.index_rate, o.violations, o.window, o.share_a, o.share_b, zipf=o.zipf, seed=o.seed)))


def split_lines(facts: DataFrame, o: argparse.Namespace) -> DataFrame:
    """(source, tp, line): csv lines of each source in order of tp, which is the second of emission where facts are delayed."""
    dealt = gen.split(facts, o.sources, o.seed, [float(x) for x in o.weights.split(",")] if o.weights else None)
    if not o.sigma:
        return traces.csv_lines(dealt, keep=("source",))
    late = gen.delay(dealt, o.sigma, o.most, o.seed)
    lines = traces.csv_lines(late, keep=("source", "emission")).select("source", F.col("emission").alias("tp"), "line")
    marks = gen.watermarks(late, o.period, o.most).select("source", F.col("emission").alias("tp"), F.concat(F.lit(">WATERMARK "), F.col("watermark").cast("string"), F.lit("<")).alias("line"))
    return lines.unionByName(marks)


def run(spark: SparkSession, o: argparse.Namespace) -> DataFrame:
    """The command's result: one column ``line``, with source and tp for the order where there are."""
    if o.command == "diff":
        left, right = (traces.parse_verdicts(spark.read.text(p)) for p in (o.left, o.right))
        found = traces.diff_verdicts(left, right, o.collapse)
        return found.select("tp", F.concat_ws(" ", "side", F.concat(F.lit("@"), F.col("ts").cast("string")), F.col("tp").cast("string"), F.concat(F.lit("("), F.array_join("args", ","), F.lit(")"))).alias("line"))
    if o.command == "generate":
        return generated(spark, o)
    facts, times = traces.read_trace(spark, o.trace, o.format)
    if o.command == "monitor":
        m = Monitor(text_of(o.formula), negate=o.negate, collapse=o.collapse)
        if o.signature:
            sig = traces.signature(Path(o.signature).read_text())
        else:
            sig = {a.relation: [(f"x{i}", "string") for i in range(len(a.args))] for a in atoms(m.formula)}
        return traces.verdict_lines(m.run(traces.relations(facts, sig), times), o.grouped)
    if o.command == "analyse":
        mine = st.relevant(facts, read(text_of(o.formula))) if o.formula else facts
        return st.statistics_lines(st.relation_statistics(mine, o.window, o.degree))
    if o.command == "split":
        return split_lines(facts, o)
    if o.command == "slice":
        formula = read(text_of(o.formula))
        if o.shares:
            slicer = Slicer.of_shares(formula, pairs_of(o.shares, int))
        else:
            heavy = traces.heavy_values(traces.read_heavy(spark, o.heavy), formula) if o.heavy else None
            slicer = Slicer.optimize(formula, o.degree, pairs_of(o.rates, float), heavy)
        if o.dump_shares:
            return spark.createDataFrame([(slicer.to_text(),)], "line string")
        return traces.csv_lines(slicer.slice_facts(facts), keep=("slice",)).select(F.col("slice").alias("source"), "tp", "line")
    if o.command == "simulate":
        formula = read(text_of(o.formula))
        if o.mode == "adaptive":
            used = sim.adaptive(facts, formula, o.degree, o.window)
        else:
            used = sim.schedule(sim.window_slicers(facts, formula, o.degree, o.window), Slicer.optimize(formula, o.degree, {}), o.mode)
        if o.costs:
            return sim.simulated_cost(facts, used, o.window).select(F.col("start").alias("tp"), F.concat_ws(",", F.col("start").cast("string"), F.col("cost").cast("string")).alias("line"))
        return sim.with_commands(facts, used)
    return written(facts, times, o.to)


def replayed(spark: SparkSession, o: argparse.Namespace, emit) -> dict[str, float]:
    """Emits the trace's lines when they are due; a line of several facts when its time-point is."""
    facts, times = traces.read_trace(spark, o.trace, o.format)
    if o.to.startswith("plain"):
        facts = traces.linearized(facts)
        times = facts.select("tp", "ts")
    lines = written(facts, times, o.to) if not o.to.startswith("plain") else traces.plain_lines(facts, timed=o.to == "plain-timed")
    due = lines.join(times, "tp").select(F.col("line").alias("relation"), "tp", "ts", F.array().cast("array<string>").alias("args"))
    return gen.replay(due, lambda r: emit(r["relation"]), o.acceleration)


def ordered(result: DataFrame) -> DataFrame:
    return result.orderBy(*[c for c in ("source", "ts", "tp", "last", "line") if c in result.columns])


def main(argv: list[str] | None = None) -> None:
    o = options(argv)
    spark = SparkSession.builder.appName("tracelogic").getOrCreate()
    if o.command == "replay":
        if o.host:
            with socket.create_connection((o.host, o.port)) as s:
                report = replayed(spark, o, lambda line: s.sendall((line + "\n").encode()))
        else:
            report = replayed(spark, o, print)
        print(json.dumps(report), file=sys.stderr)
        return
    result = run(spark, o)
    # slices and sources go to folders of their own
    by = ["source"] if "source" in result.columns else []
    if o.out:
        ordered(result).select(*by, "line").write.mode("errorifexists").partitionBy(*by).text(o.out)
    else:
        for r in ordered(result).select(*by, "line").toLocalIterator():
            print(*r)


if __name__ == "__main__":
    main()
