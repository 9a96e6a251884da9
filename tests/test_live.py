"""Streaming operators against the batch plans, formats with odd values, live sources and the command line."""

import random

import pytest
from pyspark.sql import functions as F

from tracelogic import cli
from tracelogic.formula.rewrite import read
from tracelogic.monitor import Monitor
from tracelogic.operators.slicing import Slicer, run_sliced
from tracelogic.sources import live, traces
from tracelogic.streaming.monitor import run_end, run_start, satisfied, temporal

BATCH = {
    "once": "G(k) AND ONCE [1,6) B(k)", "eventually": "G(k) AND EVENTUALLY [0,5) B(k)", "since": "G(k) AND (A(k) SINCE [0,7) B(k))", "until": "G(k) AND (A(k) UNTIL [1,7) B(k))",
    "since_not": "G(k) AND ((NOT A(k)) SINCE [1,9) B(k))", "until_not": "G(k) AND ((NOT A(k)) UNTIL [0,9) B(k))", "prev": "G(k) AND PREVIOUS [0,2) B(k)", "next": "G(k) AND NEXT [1,3) B(k)",
}
INTERVAL = {"once": (1, 6), "eventually": (0, 5), "since": (0, 7), "until": (1, 7), "since_not": (1, 9), "until_not": (0, 9), "prev": (0, 2), "next": (1, 3)}


def trace(seed, n=120):
    r, ts, rows = random.Random(seed), 100, []
    for tp in range(n):
        ts += r.choice([0, 1, 1, 2])
        for k in range(2):
            rows += [(side, k, tp, ts) for side, share in (("p", 0.4), ("a", 0.75), ("b", 0.15)) if r.random() < share]
        rows.append(("-", 9, tp, ts))
    return rows


@pytest.mark.parametrize("op", BATCH)
def test_streams_equal_batches(spark, tmp_path, op):
    rows, schema = trace(op), "side string, k long, tp long, ts long"
    for i in range(0, len(rows), 150):
        spark.createDataFrame(rows[i : i + 150], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    last = max(x[3] for x in rows)
    spark.createDataFrame([("-", 99, 10_000, last + 100)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    times = spark.createDataFrame(sorted({x[2:] for x in rows}), "tp long, ts long")
    relations = {name: spark.createDataFrame([(x[2], x[3], x[1]) for x in rows if x[0] == side], "tp long, ts long, x0 long") for name, side in (("G", "p"), ("A", "a"), ("B", "b"))}
    want = sorted((x["k"], x["tp"], x["ts"]) for x in Monitor(BATCH[op]).run(relations, times).collect())
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").withColumn("at", F.timestamp_seconds("ts"))
    name = f"live_{op}"
    temporal(source, ["k"], op, *INTERVAL[op]).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert want and sorted(map(tuple, spark.table(name).select("k", "tp", "ts").collect())) == want


def test_runs():
    r = random.Random(2)
    for _ in range(200):
        tps = sorted(r.sample(range(30), r.randint(0, 25)))
        for tp in range(30):
            s = e = tp
            while s - 1 in tps and tp in tps:
                s -= 1
            while e + 1 in tps and tp in tps:
                e += 1
            assert (run_start(tps, tp), run_end(tps, tp)) == ((s, e) if tp in tps else (tp + 1, tp - 1))
    assert satisfied("once", 5, 50, 0, 3, [], [(48, 4)]) and not satisfied("once", 5, 50, 0, 3, [], [(47, 4)])


ODD = ["", " ", "a,b", 'say "x"', "back\\slash", "(1)", "new\nline", "x=1", "\\n", "plain", " pad ", "'q'", "ü#;>"]


def test_formats_keep_every_value(spark, tmp_path):
    facts = spark.createDataFrame([("r", i, i, [v, "z", w]) for i, (v, w) in enumerate(zip(ODD, reversed(ODD), strict=True))] + [("none", 50, 50, [])], traces.FACTS)
    want = sorted((x["relation"], x["tp"], tuple(x["args"])) for x in facts.collect())
    traces.csv_lines(facts).select("line").write.text(f"{tmp_path}/csv")
    back, _ = traces.read_trace(spark, f"{tmp_path}/csv")
    assert sorted((x["relation"], x["tp"], tuple(x["args"])) for x in back.collect()) == want
    lines = traces.database_lines(facts, facts.select("tp", "ts"))
    back, _ = traces.parse_databases(lines.select(F.col("tp").alias("n"), F.col("line").alias("value")))
    assert sorted((x["relation"], x["ts"], tuple(x["args"])) for x in back.collect()) == want
    verdicts = facts.where("relation = 'r'").select("tp", "ts", F.col("args")[0].alias("v"), F.col("args")[2].alias("w"))
    for grouped in (False, True):
        back = traces.parse_verdicts(traces.verdict_lines(verdicts, grouped).select(F.col("line").alias("value")))
        assert sorted((x["tp"], tuple(x["args"])) for x in back.collect()) == sorted((x["tp"], (x["v"], x["w"])) for x in verdicts.collect())


def test_lines_from_a_directory(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("p, tp=0, ts=0, x=1\n;;\nq, tp=1, ts=1, x=, y=2\n")
    facts, _ = traces.parse_csv(live.read_lines(spark, "directory", path=f"{tmp_path}/in"))
    lines = facts.select(F.concat_ws(" ", "relation", F.size("args").cast("string")).alias("line"))
    live.write_lines(lines, "directory", f"{tmp_path}/c", path=f"{tmp_path}/out").trigger(availableNow=True).start().awaitTermination()
    assert sorted(x["value"] for x in spark.read.text(f"{tmp_path}/out").collect()) == ["p 1", "q 2"]
    with pytest.raises(ValueError, match="unknown"):
        live.read_lines(spark, "pipe")


def test_late_rows(spark):
    rows = spark.createDataFrame([(0, 10, 10), (0, 11, 20), (0, 12, 14), (0, 13, 16), (1, 12, 3)], "source int, emission long, ts long")
    assert {(x["source"], x["ts"]) for x in live.late_rows(rows, 5).where("late").collect()} == {(0, 14)}


def test_command_line(spark, tmp_path):
    (tmp_path / "t.csv").write_text("p, tp=0, ts=0, x=1\nq, tp=1, ts=3, x=1\np, tp=2, ts=4, x=2\n")
    go = lambda *a: [x["line"] for x in cli.run(spark, cli.options([*a])).orderBy("line").collect()]
    trace_ = ["--trace", str(tmp_path / "t.csv")]
    assert go("monitor", *trace_, "--formula", "q(x) AND ONCE [0,5) p(x)") == ["@3. (time point 1): (1)"]
    assert go("convert", *trace_, "--to", "databases") == ["@0 p(1);", "@3 q(1);", "@4 p(2);"]
    assert go("analyse", *trace_, "--window", "10", "--degree", "2") and go("analyse", *trace_, "--formula", "p(x)")
    (tmp_path / "v").write_text("@3. (time point 1): (1)\n")
    (tmp_path / "w").write_text("@3. (time point 1): (2)\n")
    assert go("diff", "--left", str(tmp_path / "v"), "--right", str(tmp_path / "w")) == ["left @3 1 (1)", "right @3 1 (2)"]
    cli.main(["monitor", *trace_, "--formula", "p(x)", "--out", str(tmp_path / "out")])
    assert spark.read.text(str(tmp_path / "out")).count() == 2


def test_slices_are_one_plan(spark):
    facts = spark.createDataFrame([(r, i // 3, i // 3, [str(i % 3), str((i + j) % 4)]) for i in range(30) for j, r in enumerate("AB")], traces.FACTS)
    sig = {r: [("x", "string"), ("y", "string")] for r in "AB"}
    t = facts.select("tp", "ts").distinct()
    for text in ("A(a,b) AND ONCE [0,4) B(a,c)", "A(a,b) AND NOT (ONCE [0,4) (EXISTS c. B(a,c)))", "A(a,b) AND (EXISTS c. B(a,c) AND c < b)"):
        f = read(text)
        sizes = set()
        for degree in (4, 8):
            out = run_sliced(Slicer.optimize(f, degree, {}), facts, t, sig)
            sizes.add(len(out._jdf.queryExecution().optimizedPlan().toString().splitlines()))
            assert sorted(map(tuple, out.collect())) == sorted(map(tuple, Monitor(f).run(traces.relations(facts, sig), t).collect()))
        assert len(sizes) == 1  # no part for each slice
