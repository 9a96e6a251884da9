import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tracelogic.formula import ast
from tracelogic.formula.ast import And, Compare, Const, Exists, Forall, FormulaError, Interval, Next, Not, Once, Or, Pred, Prev, Since, Truth, Until, Var, implies
from tracelogic.formula.parser import parse
from tracelogic.formula.rewrite import close, push_negation, read, resolve, show, to_past_language
from tracelogic.functions import statistics as st
from tracelogic.monitor import Monitor
from tracelogic.operators.slicing import Slicer, run_sliced, shares_of, should_switch, slice_load, slicing_cost, through_process
from tracelogic.sources import generate as gen
from tracelogic.sources import traces
from tracelogic.streaming.monitor import guarded, windowed_counts

X, Y = Var("x"), Var("y")
PX, PY, QXY = Pred("P", (X,)), Pred("P", (Y,)), Pred("Q", (X, Y))


@pytest.mark.parametrize(
    "text,want",
    [
        ("door_1()", Pred("door_1")), ("Q(x, y)", QXY), ("P('it')", Pred("P", (Const("it"),))), ('P("[unit]")', Pred("P", (Const("unit"),))), ("P(-12)", Pred("P", (Const(-12),))), ("y = 0", Compare("=", Y, Const(0))), ("y < x", Compare("<", Y, X)),
        ("P(y) AND NOT P(x) AND Q(x, y)", And(And(PY, Not(PX)), QXY)), ("P(y) AND P(x) OR Q(x, y)", Or(And(PY, PX), QXY)), ("(P(y) OR P(x)) AND Q(x, y)", And(Or(PY, PX), QXY)), ("Q(x, y) IMPLIES P(x) OR P(y)", implies(QXY, Or(PX, PY))),
        ("P(y) EQUIV Q(x, y)", ast.equiv(PY, QXY)), ("FORALL y. EXISTS x. Q(x, y)", Forall("y", Exists("x", QXY))), ("NOT (EXISTS y. P(y))", Not(Exists("y", PY))),
        ("PREVIOUS [1h,2h) P(y)", Prev(Interval(3600, 7200), PY)), ("NEXT (1,2) P(y)", Next(Interval(2, 2), PY)), ("ONCE [2d,*) P(y)", Once(Interval(172800, None), PY)), ("NOT ONCE P(y)", Not(Once(ast.ANY, PY))),
        ("P(x) SINCE [0,60] P(y)", Since(Interval(0, 61), PX, PY)), ("(NOT P(x)) UNTIL [1m,*) P(y)", Until(Interval(60, None), Not(PX), PY)), ("HISTORICALLY [0,9) P(x)", ast.historically(Interval(0, 9), PX)), ("ALWAYS P(x) # why", ast.always(ast.ANY, PX)), ("(* note *) P(x)", PX), ("TRUE OR FALSE", Or(Truth(), Truth(False))),
    ],
)
def test_grammar(text, want):
    assert parse(text) == want
    assert parse(show(want)) == want


@pytest.mark.parametrize("text", ["", "P(x", "P(x) AND", "ONCE [5,3x) P(x)", "x", "P(x) P(y)", "EXISTS . P(x)"])
def test_syntax_errors(text):
    with pytest.raises(FormulaError):
        parse(text)


def test_rewrites():
    with pytest.raises(FormulaError):
        read("ONCE [5,5) P(x)")
    assert resolve(parse("P(x) AND EXISTS x. P(x)")) == And(PX, Exists("x_1", Pred("P", (Var("x_1"),))))
    assert ast.free_variables(parse("Q(x,y) AND EXISTS x. P(x)")) == ["x", "y"]
    assert close(QXY, negate=True) == Exists("x", Exists("y", Not(QXY)))
    assert push_negation(Not(parse("P(x) AND ONCE P(y)"))) == Or(Not(PX), ast.historically(ast.ANY, Not(PY)))
    assert push_negation(Not(parse("P(x) SINCE P(y)"))) == ast.Trigger(ast.ANY, Not(PX), Not(PY))
    assert to_past_language(parse("EXISTS x. P(x) AND ONCE P(y)")) == "Exists x . (((P(x)) & (P (P(y)))))"
    for text in ("NEXT P(x)", "ONCE [0,5) P(x)"):
        with pytest.raises(FormulaError):
            to_past_language(parse(text))


def test_unsafe_formulas_name_the_variable(spark):
    t = spark.createDataFrame([(0, 0)], "tp long, ts long")
    rel = {"P": spark.createDataFrame([(0, 0, 1)], "tp long, ts long, x0 long")}
    for text in ("NOT P(x)", "P(x) OR P(y)", "P(x) AND x < y"):
        with pytest.raises(FormulaError, match="x|y"):
            Monitor(text).run(rel, t)


def test_trace_formats(spark, tmp_path):
    (tmp_path / "t.csv").write_text("q, tp=0, ts=0, x=25, y=17\n;;\n>cmd<\np, tp=1, ts=1, x=a b, y=23\n")
    facts, t = traces.read_trace(spark, str(tmp_path / "t.csv"))
    rows = {("q", 0, 0, ("25", "17")), ("p", 1, 1, ("a b", "23"))}
    assert {(r["relation"], r["tp"], r["ts"], tuple(r["args"])) for r in facts.collect()} == rows and t.count() == 2
    (tmp_path / "t.log").write_text('@0 q(25,17)\n # comment\n@1 p("a b",23)\n  p(x,1)(y,2);\n@5\n@7 z();\n')
    facts, t = traces.read_trace(spark, str(tmp_path / "t.log"), "databases")
    assert {(r["relation"], r["tp"], r["ts"], tuple(r["args"])) for r in facts.collect()} == rows | {("p", 1, 1, ("x", "1")), ("p", 1, 1, ("y", "2")), ("z", 3, 7, ())}
    assert sorted(map(tuple, t.collect())) == [(0, 0), (1, 1), (2, 5), (3, 7)]
    lines = [r["line"] for r in traces.database_lines(facts, t).orderBy("tp").collect()]
    assert lines == ["@0 q(25,17);", '@1 p("a b",23)(x,1)(y,2);', "@5;", "@7 z();"]
    (tmp_path / "p.txt").write_text("publish,160,13\napprove,1,14\n")
    facts, _ = traces.read_trace(spark, str(tmp_path / "p.txt"), "plain-timed")
    assert sorted((r["relation"], r["tp"], r["ts"], tuple(r["args"])) for r in facts.collect()) == [("approve", 1, 14, ("1",)), ("publish", 0, 13, ("160",))]
    assert sorted(r["line"] for r in traces.plain_lines(facts, timed=True).collect()) == ["approve,1,14", "publish,160,13"]
    assert traces.signature("p(x:int, string)\n# no\nq()") == {"p": [("x", "long"), ("x1", "string")], "q": []}


def test_verdict_lines(spark):
    v = spark.createDataFrame([(3, 9, "a", 1), (3, 9, "c", 2)], "tp long, ts long, x string, y long")
    assert sorted(r["line"] for r in traces.verdict_lines(v).collect()) == ["@9. (time point 3): (a, 1)", "@9. (time point 3): (c, 2)"]
    grouped = traces.verdict_lines(v, grouped=True)
    assert [r["line"] for r in grouped.collect()] == ["@9. (time point 3): (a,1)(c,2)"]
    back = traces.parse_verdicts(grouped.select(F.col("line").alias("value")))
    assert sorted((r["tp"], r["ts"], tuple(r["args"])) for r in back.collect()) == [(3, 9, ("a", "1")), (3, 9, ("c", "2"))]
    assert traces.diff_verdicts(v, v.where("y = 1")).collect()[0]["side"] == "left"


def test_statistics(spark):
    facts = spark.createDataFrame([("p", i, i, [str(i % 2), str(i)]) for i in range(10)], traces.FACTS)
    assert {(r["start"], r["n"]) for r in st.frequencies(facts, 5).collect()} == {(0, 5), (5, 5)}
    heavy = st.relation_statistics(facts, 10, 2)
    assert [r["heavy"] for r in heavy.collect()] == ["0,1;"] and [r["line"] for r in st.statistics_lines(heavy).collect()] == ["0,p,10,0,1;"]
    h = st.histogram(facts)
    assert st.heavy_of(h, 1).count() == 0 and st.heavy_of(h, 2).count() == 2
    assert st.relevant(facts, parse("p(0, x)")).count() == 5


def test_share_optima():
    cross = And(PX, Pred("Q", (Y,)))
    assert shares_of(cross, 1024, {"P": 100, "Q": 400}) == {"x": 16, "y": 64}
    triangle = parse("A(x,y) AND B(y,z) AND C(z,x)")
    assert shares_of(triangle, 512, {}) == {"x": 8, "y": 8, "z": 8} and shares_of(triangle, 65, {}) == {"x": 4, "y": 4, "z": 4}
    assert shares_of(And(PX, PY), 256, {}) == {"x": 16, "y": 16} and shares_of(PX, 1, {}) == {"x": 1}
    assert should_switch(100, 10, 1.0, 5.0, 1.0) == (True, 0.5) and should_switch(10, 10, 1.0, 5.0, 1.0) == (False, 2.0)


@pytest.mark.parametrize("heavy", [{}, {"a": {"0"}}])
def test_sliced_equals_whole(spark, heavy):
    facts = spark.createDataFrame([(r, i // 3, i // 3, [str(i % 3 if j else 0 if i % 2 else i % 5), str((i + j) % 4)]) for i in range(30) for j, r in enumerate("AB")], traces.FACTS)
    f = read("A(a,b) AND ONCE [0,4) B(a,c)")
    sig = {r: [("x", "string"), ("y", "string")] for r in "AB"}
    t = facts.select("tp", "ts").distinct()
    whole = Monitor(f).run(traces.relations(facts, sig), t)
    slicer = Slicer.optimize(f, 4, {}, heavy)
    sliced = slicer.slice_facts(facts)
    assert sorted(map(tuple, run_sliced(slicer, facts, t, sig).collect())) == sorted(map(tuple, whole.collect()))
    assert slicing_cost(sliced).first()["cost"] >= 60 // slicer.degree and slice_load(sliced).count() > 0


def test_generated_traces(spark):
    w = gen.Workload(pattern="star", seconds=20, event_rate=50, violations=0.2)
    facts = gen.generate(spark, w)
    assert sorted(map(str, facts.collect())) == sorted(map(str, gen.generate(spark, w).collect())) and facts.count() == 1000
    late = gen.delay(gen.split(facts, 3), 2.0, 5)
    assert {r["source"] for r in late.select("source").distinct().collect()} == {0, 1, 2} and late.where("emission < ts or emission > ts + 5").count() == 0
    back, _ = gen.reorder(late, collapse=False)
    assert back.exceptAll(facts).count() == 0 == facts.exceptAll(back).count()
    assert gen.watermarks(late, 5, 5).count() > 0 and "ONCE" in show(gen.formula_of("triangle", 10))


def test_streaming_equals_batch(spark, tmp_path):
    rows = [("p" if i % 3 == 0 else "q", i % 4, 100 + i) for i in range(60)] + [("q", 99, 500)]
    schema = "side string, k long, ts long"
    for i in range(0, len(rows), 20):
        spark.createDataFrame(rows[i : i + 20], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for past, negated in ((True, False), (True, True), (False, False)):
        src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{tmp_path}/in").withColumn("at", F.timestamp_seconds("ts"))
        name = f"out_{past}_{negated}"
        q = guarded(src, ["k"], 1, 6, past, negated).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination()
        got = {(r["k"], r["ts"]) for r in spark.table(name).collect()}
        near = lambda k, t: any(s == "q" and j == k and (1 <= t - u < 6 if past else 1 <= u - t < 6) for s, j, u in rows)  # noqa: B023,E731
        assert got == {(k, t) for s, k, t in rows if s == "p" and near(k, t) != negated}


def test_windowed_counts_plan(spark):
    src = spark.readStream.format("rate").load().select(F.lit("p").alias("relation"), F.col("timestamp").alias("at"))
    assert windowed_counts(src).columns == ["start", "relation", "n"] and windowed_counts(src).isStreaming


def test_entry_registers_queries():
    known, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert "and_once" in known and set(sql) <= set(known)


def test_further_statistics(spark):
    facts = spark.createDataFrame([("p", i, i, [str(i % 2)]) for i in range(10)] + [("q", 3, 3, ["7", "8"])], traces.FACTS)
    hop = {(r["start"], r["value"]): r["n"] for r in st.hopping_histogram(facts.where("relation = 'p'"), 5, 2).collect()}
    assert hop == {(-5, "0"): 3, (-5, "1"): 2, (0, "0"): 5, (0, "1"): 5, (5, "0"): 2, (5, "1"): 3}
    assert st.relation_sizes(st.histogram(facts)) == {"p": 10.0, "q": 1.0} and st.constant_sizes("pq") == {"p": 100.0, "q": 100.0}
    assert [round(x, 3) for x in st.moving_average([1, 2, 3])] == [1.0, 1.1, 1.29] and list(st.moving_average([])) == []
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "m string, ms double")
    assert {(r["m"], r["peak"], r["mean"]) for r in st.latencies(rows, ["m"], "ms").collect()} == {("a", 3.0, 2.0), ("b", 5.0, 5.0)}


def test_slicer_parts(spark):
    f = read("A(a,b) AND ONCE [0,4) B(a,c)")
    s = Slicer.of_shares(f, {"a": 2, "b": 3})
    assert s.degree == 6 and not s.requires_filter() and Slicer.of_text(f, s.to_text()) == s
    heavy = Slicer.optimize(f, 4, {}, {"a": {"1"}})
    assert Slicer.of_text(f, heavy.to_text()) == heavy and heavy.requires_filter()
    assert Slicer.of_shares(read("A(a,b) AND NOT A(b,a)"), {"a": 2}).requires_filter() and Slicer.of_shares(read("A(a,b) AND (EXISTS c. B(c,c))"), {}).requires_filter()
    assert s.to_all(spark.createDataFrame([("flush",)], "command string")).count() == 6
    rows = spark.createDataFrame([(k, t, f"{k} {t}") for t in range(20) for k in range(6)], "slice int, tp long, line string")
    parts = s.dealt(rows).withColumn("part", F.spark_partition_id()).groupBy("part").agg(F.countDistinct("slice").alias("n")).collect()
    assert len(parts) == 6 and all(r["n"] == 1 for r in parts)
    got = through_process(rows, ["tail", "-n", "1"], 6).collect()
    assert sorted(map(tuple, got)) == [(k, f"{k} 19") for k in range(6)]


def test_trace_tools(spark, tmp_path):
    facts = spark.createDataFrame([("p", 0, 5, ["1"]), ("q", 2, 5, ["2"]), ("p", 3, 9, ["3"])], traces.FACTS)
    times = spark.createDataFrame([(0, 5), (1, 5), (2, 5), (3, 9)], "tp long, ts long")
    ends = lambda mode: [r["tp"] for r in traces.closed_lines(facts, times, mode).where("last = 1").orderBy("tp").collect()]
    assert ends("all") == [0, 1, 2, 3] and ends("timestamps") == [2, 3] and ends("none") == []
    assert traces.cut(facts, 5, 9).count() == 2
    (tmp_path / "heavy.csv").write_text("A,0,17\nA,1,x\nC,0,9\n")
    assert traces.heavy_values(traces.read_heavy(spark, str(tmp_path / "heavy.csv")), read("A(a,b) AND B(a,c)")) == {"a": {"17"}, "b": {"x"}}
    w = gen.Workload(pattern=("xy", "yz", "xz"), seconds=5, event_rate=20)
    assert gen.generate(spark, w).count() == 100 and gen.signature_of(w.pattern) == "A(int,int)\nB(int,int)\nC(int,int)\n" and "xz" not in show(gen.formula_of(w.pattern, 5))
    with pytest.raises(ValueError):
        gen.variables_of(("a", "", "b"))
    said, slept, now = [], [], [0.0]

    def sleep(s):
        slept.append(s)
        now[0] += s

    report = gen.replay(facts, lambda r: said.append(r["tp"]), acceleration=2.0, clock=lambda: now[0], sleep=sleep)
    assert said == [0, 2, 3] and slept == [2.0] and report["rows"] == 3 and report["peak"] == 0.0
