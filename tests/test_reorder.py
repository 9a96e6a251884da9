"""Several live sources in order, commands in traces, slicing simulated over windows, and the tools' command line."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tracelogic import cli
from tracelogic.formula.rewrite import read
from tracelogic.operators import simulation as sim
from tracelogic.operators.slicing import Slicer, slicing_cost
from tracelogic.sources import generate as gen
from tracelogic.sources import traces
from tracelogic.streaming.reorder import Reorder

ROWS = "source int, command string, value long, relation string, tp long, ts long, args array<string>"


def feed(spark, path, order, seed=1, n=60):
    """Files of rows of three sources; each source's facts come in order of tp, or shuffled inside its promises."""
    r = random.Random(seed)
    facts = [(r.randrange(3), None, None, r.choice("pq"), i // 2, i // 4, [str(i)]) for i in range(n)]
    files = []
    for at in range(0, n, 12):
        part = facts[at : at + 12]
        if order == "watermark":
            r.shuffle(part)
            part = part + [(s, "WATERMARK", (at + 12) // 4, None, None, None, None) for s in range(3)]
        files.append(part)
    # source 2 is slow: what it sends comes two files later
    if order != "watermark":
        slow = [[x for x in f if x[0] == 2] for f in files]
        files = [[x for x in f if x[0] != 2] for f in files] + [[], []]
        files = [f + (slow[i - 2] if i >= 2 else []) for i, f in enumerate(files)]
    files.append([(s, "EOF", None, None, None, None, None) for s in range(3)])
    for f in files:
        spark.createDataFrame(f, ROWS).coalesce(1).write.mode("append").parquet(path)
    return facts


@pytest.mark.parametrize("order", ["tp", "ts", "watermark"])
def test_sources_in_order(spark, tmp_path, order):
    facts = feed(spark, f"{tmp_path}/in", order)
    got, failed = {}, []

    def release(final, times, batch):
        rows = sorted((x["tp"], x["ts"], x["relation"], x["args"][0]) for x in final.collect())
        if batch == 3 and not failed:  # the stream dies once, in the middle of a batch
            failed.append(batch)
            raise RuntimeError("lost")
        assert {x[0] for x in rows} == {t["tp"] for t in times.collect()}
        got[batch] = rows

    source = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    step = Reorder(spark, f"file://{tmp_path}/state", 3, release, order)
    with pytest.raises(Exception, match="lost"):
        step.start(source, f"{tmp_path}/c", availableNow=True).awaitTermination()
    step.start(source, f"{tmp_path}/c", availableNow=True).awaitTermination()
    flat = [x for b in sorted(got) for x in got[b]]
    assert len([b for b in got if got[b]]) > 2  # released as the sources come along, not all at the end
    assert [x[0] for x in flat] == sorted(x[0] for x in flat)
    if order == "tp":
        assert sorted(flat) == sorted((x[4], x[5], x[3], x[6][0]) for x in facts)
    else:  # time-points of equal ts are one, numbered through all batches
        assert sorted(flat) == sorted((x[5], x[5], x[3], x[6][0]) for x in facts)


def test_late_facts(spark, tmp_path):
    def batch(*rows):
        return spark.createDataFrame(rows, ROWS)

    first = batch((0, None, None, "p", 0, 0, ["a"]), (0, "WATERMARK", 10, None, None, None, None))
    second = batch((0, None, None, "p", 1, 5, ["b"]), (0, "LATENCY", 3, None, None, None, None))
    late = []
    step = Reorder(spark, f"file://{tmp_path}/a", 1, lambda f, t, b: None, on_late=lambda rows, b: late.extend(x["args"] for x in rows.collect()))
    step(first, 0)
    step(second, 1)
    assert late == [["b"]]
    step = Reorder(spark, f"file://{tmp_path}/b", 1, lambda f, t, b: None)
    step(first, 0)
    with pytest.raises(ValueError, match="older"):
        step(second, 1)
    with pytest.raises(ValueError, match="order"):
        Reorder(spark, str(tmp_path), 1, print, "none")


def test_commands(spark):
    lines = [(0, "p, tp=0, ts=7, x0=1"), (0, ">WATERMARK 9<"), (1, " >LATENCY 4 1234<"), (1, ">EOF<"), (1, ";;"), (1, "q, tp=1, ts=8")]
    df = spark.createDataFrame(lines, "source int, value string")
    said = traces.parse_commands(df).where("command is not null")
    assert sorted((x["command"], x["arguments"]) for x in said.collect()) == [("EOF", []), ("LATENCY", ["4", "1234"]), ("WATERMARK", ["9"])]
    rows = traces.source_rows(df).collect()
    assert sorted((x["source"], x["command"] or "", x["value"] or 0, x["relation"] or "") for x in rows) == [(0, "", 0, "p"), (0, "WATERMARK", 9, ""), (1, "", 0, "q"), (1, "EOF", 0, ""), (1, "LATENCY", 4, "")]
    assert traces.command_line("START", 3) == ">START 3<"


FORMULA = "p(x,y) AND ONCE [0,30) q(x,z)"


def skewed(spark):
    """In the first window x is skewed, in the second y."""
    rows = []
    for i in range(240):
        x, y = (1, i) if i < 120 else (i, 1)
        rows.append(("p" if i % 3 else "q", i, i // 2, [str(x), str(y)]))
    return spark.createDataFrame(rows, traces.FACTS)


def test_simulated_slicing(spark):
    facts, f = skewed(spark), read(FORMULA)
    slicers = sim.window_slicers(facts, f, 4, 60)
    assert sorted(slicers) == [0, 60] and all("x" in s.heavy or "y" in s.heavy or "z" in s.heavy for s in slicers.values())
    default = Slicer.optimize(f, 4, {})
    costs = {}
    for mode in sim.MODES:
        used = sim.schedule(slicers, default, mode)
        costs[mode] = {r["start"]: r["cost"] for r in sim.simulated_cost(facts, used, 60).collect()}
        for start, s in used.items():  # as counted without the simulation
            one = s.slice_facts(facts.where(F.floor(F.col("ts") / 60) * 60 == start))
            assert slicing_cost(one).first()["cost"] == costs[mode][start]
    assert costs["reactive"][0] == costs["static"][0] and costs["predictive"][0] < costs["static"][0]
    used = sim.adaptive(facts, f, 4, 60)
    assert used[0].to_text() == default.to_text() and used[60].to_text() == slicers[0].to_text()
    assert sim.adaptive(facts, f, 4, 60, shutdown=1e9)[60].to_text() == default.to_text()
    lines = [r["line"] for r in cli.ordered(sim.with_commands(facts, slicers)).collect()]
    at = [i for i, x in enumerate(lines) if x.startswith(">")]
    assert len(lines) == 241 and at == [120] and sim.of_command(f, lines[120]).to_text() == slicers[60].to_text()
    with pytest.raises(ValueError, match="mode"):
        sim.schedule(slicers, default, "other")


def test_generated_from_a_signature(spark):
    sig = traces.signature("p(int,int) q(x:int) none()")
    rows = gen.generate_signature(spark, sig, 20, 100, 2, domain=50, fresh=0.2).collect()
    assert len(rows) == 2000 and {(x["relation"], len(x["args"])) for x in rows} == {("p", 2), ("q", 1), ("none", 0)}
    assert all(abs(sum(x["relation"] == r for x in rows) - 667) < 100 for r in sig)
    values = [v for x in rows for v in x["args"]]
    assert 0.1 < len(set(values)) / len(values) < 0.9 and [x["ts"] for x in rows] == [x["tp"] // 2 for x in rows]
    assert [x["args"] for x in gen.generate_signature(spark, sig, 20, 100, 2, domain=50, fresh=0.2).collect()] == [x["args"] for x in rows]


def test_tools_command_line(spark, tmp_path):
    def go(*a):
        return [x["line"] for x in cli.ordered(cli.run(spark, cli.options([*map(str, a)]))).collect()]

    assert go("generate", "--pattern", "ab,bc,ca", "--signature-out") == ["A(int,int)", "B(int,int)", "C(int,int)"]
    assert "ONCE" in go("generate", "--pattern", "star", "--formula-out")[0]
    (tmp_path / "sig").write_text("p(int,int)\nq(int,int)\n")
    assert len(go("generate", "--signature", tmp_path / "sig", "--seconds", 5, "--event-rate", 4)) == 20
    path = str(tmp_path / "t")
    traces.csv_lines(skewed(spark)).select("line").coalesce(1).write.text(path)
    assert len(go("split", "--trace", path, "--sources", 3)) == 240
    delayed = go("split", "--trace", path, "--sources", 3, "--sigma", 2)
    assert sum(x.startswith(">WATERMARK") for x in delayed) > 3 and len(delayed) > 240
    text = go("slice", "--trace", path, "--formula", FORMULA, "--shares", "x=2,z=3", "--dump-shares")[0]
    assert json.loads(text)["shares"] == [{"x": 2, "y": 1, "z": 3}]
    assert len(go("slice", "--trace", path, "--formula", FORMULA, "--rates", "p=100,q=1", "--degree", 2)) >= 240
    assert len(go("simulate", "--trace", path, "--formula", FORMULA, "--degree", 4, "--costs", "--mode", "adaptive")) == 2
    assert len(go("simulate", "--trace", path, "--formula", FORMULA, "--degree", 4)) == 241
    cli.main(["split", "--trace", path, "--sources", "2", "--out", str(tmp_path / "out")])
    assert sorted(p.name for p in (tmp_path / "out").glob("source=*")) == ["source=0", "source=1"]
    assert go("convert", "--trace", path, "--to", "plain")[:2] == ["q,1,0", "p,1,1"] and len(go("convert", "--trace", path, "--to", "plain-timed")) == 240
    got = []
    o = cli.options(["replay", "--trace", path, "--to", "databases", "--acceleration", "0"])
    assert cli.replayed(spark, o, got.append)["rows"] == 240 and got[0].startswith("@0 ")
