"""Plans at small bucket sizes, long keys, and what plans must not hold."""

import random
import re
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tests.brute import verdicts
from tracelogic.formula.rewrite import read
from tracelogic.monitor import Monitor
from tracelogic.plans import compile as plans
from tracelogic.sources.staging import staged

FORMULAS = [
    "(NOT P(x)) SINCE [0,*) Q(x)", "(NOT P(x)) UNTIL [0,*) Q(x)", "(NOT P(x)) SINCE [1,6) Q(x)", "(NOT P(x)) UNTIL [0,7) Q(x)", "P(x) SINCE [0,9) Q(x)", "P(x) UNTIL [0,9) Q(x)", "P(x) SINCE [2,*) Q(x)", "P(x) UNTIL [1,*) Q(x)",
    "(EXISTS x. P(x)) SINCE [0,*) (EXISTS y. Q(y))", "(EXISTS x. P(x)) UNTIL [0,8) (EXISTS y. Q(y))", "(NOT (EXISTS x. P(x))) SINCE [0,*) Q(y)", "(NOT (EXISTS x. P(x))) UNTIL [0,5) Q(y)", "ONCE [0,5) (EXISTS x. P(x))", "EVENTUALLY [1,5) (EXISTS x. P(x))", "ONCE [1,4) Q(x)", "EVENTUALLY [0,4) Q(x)",
    "P(x) AND EVENTUALLY [0,6) Q(x)", "P(x) AND NOT (EVENTUALLY [0,6) (EXISTS y. Q(y)))",
]


@pytest.mark.parametrize("formula", FORMULAS)
def test_buckets(spark, monkeypatch, formula):
    """Three time-points a bucket, so runs, neighbours and marks pass through many buckets."""
    monkeypatch.setattr(plans, "BUCKET", 3)
    r = random.Random(formula)
    facts, tps, ts = [], [], 5
    for i in range(26):
        ts += r.choice([0, 1, 1, 2])
        tps.append(ts)
        facts.append({("P", (x,)) for x in range(2) if r.random() < 0.75} | {("Q", (x,)) for x in range(2) if r.random() < 0.15} if i % 9 else set())
    rows = {"P": [], "Q": []}
    for i, day in enumerate(facts):
        for name, args in day:
            rows[name].append((i, tps[i], *args))
    relations = {k: spark.createDataFrame(v, "tp long, ts long, x0 long") for k, v in rows.items()}
    got = {(x["tp"], *x[2:]) for x in Monitor(formula).run(relations, spark.createDataFrame(list(enumerate(tps)), "tp long, ts long")).collect()}
    assert got == verdicts(read(formula), tps, facts)


def one_key(spark, n):
    rows = spark.range(n).selectExpr("id as tp", "id as ts", "0L as x0")
    return {"P": rows.where("tp % 50 = 0"), "Q": rows.where("tp % 7 = 0")}, rows.select("tp", "ts")


@pytest.mark.parametrize("formula", ["(NOT P(x)) SINCE [0,20) Q(x)", "(NOT P(x)) UNTIL [0,20) Q(x)", "Q(x) AND NOT EVENTUALLY [0,5) P(x)", "(EXISTS x. Q(x)) SINCE [0,20) (EXISTS x. P(x))"])
def test_plans_have_no_single_task_and_no_cross_join(spark, formula):
    relations, times = one_key(spark, 100)
    text = Monitor(formula).run(relations, times)._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in text and "UnboundedFollowing" not in text.replace("unboundedfollowing", "UnboundedFollowing")


def test_one_long_key_takes_linear_time(spark):
    took = []
    for n in (20_000, 80_000):
        relations, times = one_key(spark, n)
        began = time.time()
        Monitor("(NOT P(x)) SINCE [0,20) Q(x)").run(relations, times).count()
        Monitor("Q(x) AND NOT EVENTUALLY [0,30) P(x)").run(relations, times).count()
        took.append(time.time() - began)
    assert took[1] < 5 * took[0] + 4


GUARDED = [
    "Q(x) AND (P(x) TRIGGER [0,6) (NOT S(x)))", "Q(x) AND (P(x) RELEASE [0,6) (NOT S(x)))", "Q(x) AND (P(x) TRIGGER [2,6) (NOT S(x)))", "Q(x) AND (P(x) RELEASE [1,5) (NOT S(x)))", "Q(x) AND (P(x) TRIGGER [0,*) (NOT S(x)))", "Q(x) AND (P(x) RELEASE [2,*) (NOT S(x)))",
    "Q(x) AND ((NOT P(x)) SINCE [0,6) S(x))", "Q(x) AND ((NOT P(x)) UNTIL [2,6) S(x))", "Q(x) AND NOT ((NOT P(x)) SINCE [1,*) S(x))", "Q(x) AND NOT ((NOT P(x)) UNTIL [0,4) S(x))", "Q(x) AND ((NOT (EXISTS y. P(y))) SINCE [0,6) (EXISTS y. S(y)))",
]


def joined(df):
    """Joins in the plan of a query."""
    return [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join " in x]


@pytest.mark.parametrize("formula", GUARDED)
def test_guarded_since_and_until_meet_no_other_time_point(spark, formula):
    """Under a guard only the guard's rows are asked, so no row is made for each time-point in the interval."""
    r = random.Random(formula)
    facts, tps, ts = [], [], 5
    for _ in range(24):
        ts += r.choice([0, 0, 1, 1, 2])
        tps.append(ts)
        facts.append({(k, (x,)) for k, p in (("P", 0.15), ("Q", 0.5), ("S", 0.25)) for x in range(2) if r.random() < p})
    relations = {k: spark.createDataFrame([(i, tps[i], *a) for i, day in enumerate(facts) for name, a in day if name == k], "tp long, ts long, x0 long") for k in "PQS"}
    out = Monitor(formula).run(relations, spark.createDataFrame(list(enumerate(tps)), "tp long, ts long"))
    assert {(x["tp"], *x[2:]) for x in out.collect()} == verdicts(read(formula), tps, facts)
    assert out.count() == out.distinct().count()
    assert not joined(out)


@pytest.mark.parametrize("formula", ["ONCE [0,6) Q(x)", "ONCE [2,6) Q(x)", "EVENTUALLY [1,6) Q(x)", "(NOT P(x)) SINCE [0,6) Q(x)", "(NOT P(x)) UNTIL [0,6) Q(x)", "(NOT P(x)) SINCE [2,*) Q(x)", "(NOT P(x)) UNTIL [3,8) Q(x)"])
def test_rows_of_a_time_point_come_together(spark, monkeypatch, formula):
    """Rows aren't exchanged once made, none comes up twice, and those of one time-point and block follow each other."""
    monkeypatch.setattr(plans, "BLOCK", 4)
    r = random.Random(formula)
    tps = sorted(r.randint(0, 30) for _ in range(40))
    facts = [{("Q", (x,)) for x in range(6) if r.random() < 0.3} | {("P", (x,)) for x in range(6) if r.random() < 0.05} for _ in tps]
    relations = {k: spark.createDataFrame([(i, tps[i], *a) for i, day in enumerate(facts) for name, a in day if name == k], "tp long, ts long, x0 long") for k in "PQ"}
    out = Monitor(formula).run(relations, spark.createDataFrame(list(enumerate(tps)), "tp long, ts long"))
    rows = [tuple(x) for x in out.collect()]
    assert len(rows) == len(set(rows)) and {(tp, x) for tp, _, x in rows} == verdicts(read(formula), tps, facts)
    top = out._jdf.queryExecution().optimizedPlan().toString().split("Join ")[0]
    assert "Generate inline" in top and "Aggregate" not in top
    turns = sum(a[0] != b[0] for a, b in zip(rows, rows[1:]))
    assert turns < 0.7 * len(rows)


@pytest.mark.parametrize("formula", ["ONCE [0,6) Q(x)", "EVENTUALLY [1,6) Q(x)", "ONCE [2,6) Q(x)", "(NOT P(x)) UNTIL [0,6) Q(x)"])
def test_hits_are_made_once(spark, formula):
    """Each hit's successor is looked for in one exchange of the hits, so what makes them runs once."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    rows = spark.range(300).selectExpr("id as tp", "id as ts", "id % 5 as x0")
    hits = rows.where("tp % 3 = 0").mapInArrow(counted, "tp long, ts long, x0 long")
    Monitor(formula).run({"P": rows.where("tp % 40 = 1"), "Q": hits}, rows.select("tp", "ts")).collect()
    assert made.value == 100


@pytest.mark.parametrize("formula", ["EVENTUALLY [1,6) Q(x)", "ONCE [2,6) Q(x)", "(NOT P(x)) UNTIL [0,6) Q(x)"])
def test_no_task_makes_rows_of_many_time_points(spark, monkeypatch, formula):
    """However few the shuffle partitions, the rows are made in tasks (and files) of few time-points."""
    monkeypatch.setattr(plans, "DEALT", 20)
    rows = spark.range(600).selectExpr("id as tp", "id as ts", "id % 5 as x0")
    out = Monitor(formula).run({"P": rows.where("tp % 40 = 1"), "Q": rows.where("tp % 3 = 0")}, rows.select("tp", "ts"))
    seen = [r[0] for r in out.groupBy(F.spark_partition_id()).agg(F.countDistinct("tp")).select("count(DISTINCT tp)").collect()]
    assert out.rdd.getNumPartitions() == 30 and max(seen) < 100


NEXT = ["ONCE [0,6) Q(x)", "ONCE [2,6) Q(x)", "EVENTUALLY [1,6) Q(x)", "EVENTUALLY [0,5) (EXISTS x. Q(x))", "(NOT P(x)) UNTIL [0,6) Q(x)", "(NOT P(x)) SINCE [2,7) Q(x)", "(NOT (EXISTS x. P(x))) UNTIL [1,6) Q(y)"]


@pytest.mark.parametrize("formula", NEXT)
def test_next_hits_across_buckets(spark, monkeypatch, formula):
    """A next hit or an alpha in another bucket is seen, where buckets are as narrow as the interval; repeated facts count once."""
    monkeypatch.setattr(plans, "SPAN", 1)
    r = random.Random(formula)
    tps = sorted(r.randint(0, 40) for _ in range(44))
    facts = [{("Q", (x,)) for x in range(3) if r.random() < 0.3} | {("P", (x,)) for x in range(3) if r.random() < 0.1} for _ in tps]
    relations = {k: spark.createDataFrame([(i, tps[i], *a) for i, day in enumerate(facts) for name, a in day if name == k for _ in range(1 + a[0] % 2)], "tp long, ts long, x0 long") for k in "PQ"}
    rows = [tuple(x) for x in Monitor(formula).run(relations, spark.createDataFrame(list(enumerate(tps)), "tp long, ts long")).collect()]
    assert len(rows) == len(set(rows)) and {(x[0], *x[2:]) for x in rows} == verdicts(read(formula), tps, facts)


def exchanges(spark, formula):
    """Exchanges in the plan of a formula over relations that are dealt out already by time alone."""
    rows = spark.range(600).selectExpr("id as tp", "id as ts", "id % 5 as x0")
    out = Monitor(formula).run({"P": rows.where("tp % 40 = 1"), "Q": rows.where("tp % 3 = 0")}, rows.select("tp", "ts"))
    return out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_once_with_a_lower_bound_moves_its_hits_twice(spark):
    """For the next hit, and to the time-points, which are moved too."""
    assert exchanges(spark, "ONCE [2,6) Q(x)") <= 3


@pytest.mark.parametrize("formula", ["ONCE [2,6) Q(x)", "EVENTUALLY [1,6) Q(x)", "(NOT P(x)) UNTIL [0,6) Q(x)"])
def test_blocks_are_inlined_apart_from_the_join(spark, formula):
    """In one compiled stage all rows that a block makes would be held before the first goes on."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(600).selectExpr("id as tp", "id as ts", "id % 5 as x0")
        out = Monitor(formula).run({"P": rows.where("tp % 40 = 1"), "Q": rows.where("tp % 3 = 0")}, rows.select("tp", "ts"))
        plan = out._jdf.queryExecution().executedPlan().toString()
        parts = out.rdd.getNumPartitions()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    stages = lambda operator: set(re.findall(rf"\*\((\d+)\) {operator}", plan))
    assert stages("Generate inline") and stages("SortMergeJoin") and not stages("Generate inline") & stages("SortMergeJoin")
    assert parts >= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_until_moves_both_sides_once_before_the_time_points(spark):
    """Both for the next beta and alpha, the betas to the time-points, which are moved too."""
    assert exchanges(spark, "(NOT P(x)) UNTIL [0,6) Q(x)") <= 3


def test_staging_leaves_no_exchanged_files(spark):
    """What was exchanged to write a table goes with the write."""
    dirs = [Path(str(d)) for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    there = lambda: {f for d in dirs for f in d.rglob("shuffle_*.data")}
    before = there()
    df = staged(spark.range(5000).repartition(3, "id"))
    for _ in range(50):
        if not there() - before:
            break
        time.sleep(0.2)
    assert not there() - before
    assert df.count() == 5000
