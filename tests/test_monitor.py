import random

import pytest

from tests.brute import verdicts
from tracelogic.formula.rewrite import read
from tracelogic.monitor import Monitor

#: A door log of the test's own: badge, open and alarm facts of two doors, by hand.
DOORS = {
    "badge": [(0, 10, 1), (1, 12, 2), (4, 20, 1), (6, 31, 2)],
    "open": [(1, 12, 1), (2, 12, 2), (4, 20, 1), (5, 30, 2), (7, 40, 1)],
    "alarm": [(3, 15, 2), (7, 40, 1)],
}
DOOR_TIMES = [(0, 10), (1, 12), (2, 12), (3, 15), (4, 20), (5, 30), (6, 31), (7, 40)]
BY_HAND = {
    "open(d) AND NOT ONCE [0,5] badge(d)": [(5, 2), (7, 1)],
    "alarm(d) AND ONCE [0,20] open(d)": [(3, 2), (7, 1)],
    "badge(d) AND EVENTUALLY [0,2] open(d)": [(0, 1), (1, 2), (4, 1)],
    "open(d) AND PREVIOUS [0,3) badge(d)": [(1, 1), (2, 2)],
    "badge(d) AND NEXT [0,1] open(d)": [(1, 2)],
    "(NOT alarm(d)) SINCE [0,4) badge(d)": [(0, 1), (1, 1), (1, 2), (2, 1), (2, 2), (4, 1), (6, 2)],
    "EXISTS d. (open(d) AND badge(d))": [(4,)],
}


@pytest.mark.parametrize("formula", BY_HAND)
def test_by_hand(spark, formula):
    relations = {k: spark.createDataFrame(v, "tp long, ts long, x0 long") for k, v in DOORS.items()}
    got = [(r["tp"], *r[2:]) for r in Monitor(formula).run(relations, spark.createDataFrame(DOOR_TIMES, "tp long, ts long")).collect()]
    assert sorted(got) == BY_HAND[formula]


RANDOM = [
    "PREVIOUS [0,2) P(x)", "NEXT [1,3) (P(x) OR Q(x))", "(ONCE [0,3) P(x)) AND (NEXT [0,2) Q(x))", "ONCE [0,3] (P(x) AND Q(x))", "EVENTUALLY [0,3] (P(x) AND Q(x))", "(NOT R(x,y)) SINCE [0,5) R(y,x)", "EXISTS x. (P(x) AND Q(x))", "R(x,y) AND NOT R(y,x)",
    "P(x) AND ONCE [1,4) Q(x)", "P(x) AND NOT ONCE [1,4) Q(x)", "P(x) AND EVENTUALLY [2,5) Q(x)", "P(x) AND NOT EVENTUALLY [0,3) Q(x)", "P(x) AND ONCE [2,*) R(x,y)", "P(x) AND NOT ONCE [3,*) Q(x)", "ONCE [1,3) R(x,y)", "ONCE [2,*) Q(x)",
    "EVENTUALLY [1,*) P(x)", "EVENTUALLY [2,4] R(x,x)", "Q(x) SINCE [1,5) R(x,y)", "P(x) UNTIL [1,6) R(x,y)", "(NOT P(x)) SINCE [2,*) R(x,y)", "(NOT Q(y)) UNTIL [0,*) R(x,y)", "P(x) AND HISTORICALLY [0,3) (NOT Q(x))", "P(x) AND ALWAYS [0,3) (P(x) OR Q(x))",
    "P(x) AND (Q(x) TRIGGER [0,4) P(x))", "P(x) AND (Q(x) RELEASE [0,4) P(x))", "P(x) AND FORALL y. (R(x,y) IMPLIES Q(y))", "R(x,y) AND x < y AND NOT (y = 2)", "P(x) AND y = x AND ONCE [0,2) Q(y)", "R(x,y) AND (P(x) OR Q(y)) AND NOT (P(y) AND Q(x))",
    "((ONCE[0,4) R(a,b)) AND R(b,c)) AND EVENTUALLY[0,4) R(c,a)", "P(x) AND (Q(x) SINCE [0,4) (NOT R(x,x)))", "P(x) AND NOT (PREVIOUS [0,2] Q(x))", "NOT (EXISTS x. P(x))", "P(x) AND (EXISTS y. R(x,y) AND NOT ONCE [0,3] Q(y))", "FALSE OR (TRUE AND NOT (EXISTS x. Q(x)))", "P(1) AND ONCE [0,3] Q(2)", "x = 1 AND ONCE [0,2] P(x)",
]


@pytest.mark.parametrize("formula", RANDOM)
def test_against_brute_force(spark, formula):
    r = random.Random(formula)
    facts, tps, ts = [], [], 0
    for _ in range(14):
        ts += r.choice([0, 0, 1, 1, 2, 3])
        tps.append(ts)
        facts.append({("P", (r.randint(0, 2),)) for _ in range(r.randint(0, 2))} | {("Q", (r.randint(0, 2),)) for _ in range(r.randint(0, 2))} | {("R", (r.randint(0, 2), r.randint(0, 2))) for _ in range(r.randint(0, 2))})
    rows = {"P": [], "Q": [], "R": []}
    for i, day in enumerate(facts):
        for name, args in day:
            rows[name].append((i, tps[i], *args))
    relations = {k: spark.createDataFrame(v, "tp long, ts long, x0 long" + (", x1 long" if k == "R" else "")) for k, v in rows.items()}
    got = {(x["tp"], *x[2:]) for x in Monitor(formula).run(relations, spark.createDataFrame(list(enumerate(tps)), "tp long, ts long")).collect()}
    assert got == verdicts(read(formula), tps, facts)
