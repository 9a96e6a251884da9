"""Registered queries over the driver's tables, with DuckDB SQL.

``events`` gives a trace with a time-point for each row (relations by event type); ``orders`` gives one with a
time-point for each order date (relations by status, customer and order as arguments, time in days).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .formula.ast import Eventually, Once, Pred, Since, Temporal, Until
from .formula.rewrite import read
from .functions import statistics as st
from .monitor import Monitor, number
from .operators.slicing import Slicer, run_sliced, slice_load
from .sources import generate as gen
from .sources import traces
from .sources.staging import staged

TYPES = ("click", "error", "purchase", "signup", "view")


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seconds(c: str):
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {c})")


def event_rows(spark, sf_dir: str) -> DataFrame:
    base = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.col("ts").alias("at"), seconds("ts").cast("long").alias("ts"))
    return number(base, ["at", "event_id"], "ts")


#: From so many mentions on, the numbered trace is written once instead of being numbered for each.
MENTIONS = 4


def events_trace(spark, sf_dir: str, mentions: int = 1) -> tuple[dict[str, DataFrame], DataFrame]:
    e = event_rows(spark, sf_dir)
    if mentions >= MENTIONS:
        e = staged(e.select("tp", "ts", "user_id", "event_id", "event_type"))
    of = lambda kind: e.where(F.col("event_type") == kind)
    out = {k: of(k).select("tp", "ts", F.col("user_id").alias("x0")) for k in TYPES}
    for name, kind in (("bought", "purchase"), ("failed", "error")):
        out[name] = of(kind).select("tp", "ts", F.col("user_id").alias("x0"), F.col("event_id").alias("x1"))
    for name, kind in (("A", "click"), ("B", "view"), ("C", "purchase")):
        out[name] = of(kind).select("tp", "ts", (F.col("user_id") % 50).alias("x0"), (F.col("event_id") % 50).alias("x1"))
    for name, kind in (("A3", "click"), ("B3", "view"), ("C3", "purchase")):
        out[name] = of(kind).select("tp", "ts", (F.col("user_id") % 12).alias("x0"), (F.col("event_id") % 12).alias("x1"))
    out["typed"] = e.select("tp", "ts", F.col("user_id").alias("x0"), F.col("event_type").alias("x1"))
    return out, e.select("tp", "ts")


def orders_trace(spark, sf_dir: str, mentions: int = 1) -> tuple[dict[str, DataFrame], DataFrame]:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", F.expr("timestampdiff(DAY, TIMESTAMP_NTZ'1970-01-01 00:00:00', o_orderdate)").cast("long").alias("ts"))
    t = number(o.select("ts").distinct(), ["ts"], "ts")
    if mentions >= MENTIONS:
        t = staged(t)
    rows = o.join(t, "ts")
    if mentions >= MENTIONS:
        rows = staged(rows)
    return {k: rows.where(F.col("o_orderstatus") == k).select("tp", "ts", F.col("o_custkey").alias("x0"), F.col("o_orderkey").alias("x1")) for k in "OFP"}, t


EVENTS_SQL = (
    "WITH e AS (SELECT event_id, user_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS ts, row_number() OVER (ORDER BY ts, event_id) - 1 AS tp FROM events), T AS (SELECT tp, ts FROM e), "
    + ", ".join(f"{k} AS (SELECT DISTINCT tp, ts, user_id AS u FROM e WHERE event_type = '{k}')" for k in TYPES)
    + ", bought AS (SELECT tp, ts, user_id AS u, event_id AS ev FROM e WHERE event_type = 'purchase')"
    + "".join(f", {n} AS (SELECT tp, ts, user_id % {m} AS x, event_id % {m} AS y FROM e WHERE event_type = '{k}')" for n, k, m in (("A", "click", 50), ("B", "view", 50), ("C", "purchase", 50), ("A3", "click", 12), ("B3", "view", 12), ("C3", "purchase", 12)))
)
ORDERS_SQL = (
    "WITH base AS (SELECT o_custkey AS c, o_orderkey AS k, o_orderstatus AS s, datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS ts, dense_rank() OVER (ORDER BY CAST(o_orderdate AS DATE)) - 1 AS tp FROM orders), T AS (SELECT DISTINCT tp, ts FROM base)"
    + "".join(f", {s} AS (SELECT tp, ts, c, k FROM base WHERE s = '{s}')" for s in "OFP")
)


def past(p: str, q: str, lo: int, hi: int | None, on: str = "", sign: int = 1) -> str:
    """SQL condition that a row q lies in the interval before p (sign 1) or after it (-1)."""
    a, b = (p, q) if sign == 1 else (q, p)
    end = f" AND {a}.ts - {b}.ts < {hi}" if hi is not None else ""
    return f"{b}.tp <= {a}.tp AND {a}.ts - {b}.ts >= {lo}{end}{on}"


def since_not(beta: str, alpha: str, lo: int, hi: int, until: bool = False) -> str:
    """(NOT alpha(u)) SINCE/UNTIL beta(u)."""
    pick = "max" if until else "min"
    frame = "UNBOUNDED PRECEDING AND 1 PRECEDING" if until else "1 FOLLOWING AND UNBOUNDED FOLLOWING"
    order = "t.tp <= b.tp AND (b.k IS NULL OR t.tp > b.k) AND b.ts - t.ts" if until else "t.tp >= b.tp AND (b.k IS NULL OR t.tp < b.k) AND t.ts - b.ts"
    return (
        f"SELECT DISTINCT t.tp, t.ts, b.u FROM (SELECT *, {pick}(CASE WHEN isb = 0 THEN tp END) OVER (PARTITION BY u ORDER BY tp RANGE BETWEEN {frame}) AS k "
        f"FROM (SELECT tp, ts, u, 1 AS isb FROM {beta} UNION ALL SELECT tp, ts, u, 0 FROM {alpha})) b JOIN T t ON {order} BETWEEN {lo} AND {hi - 1} WHERE b.isb = 1"
    )


def runs(beta: str, alpha: str, hi: int, until: bool = False) -> str:
    """alpha(c) SINCE/UNTIL [0, hi) beta(c), from runs of alpha."""
    r = f"(SELECT c, min(tp) AS s, max(tp) AS e FROM (SELECT c, tp, tp - row_number() OVER (PARTITION BY c ORDER BY tp) AS g FROM (SELECT DISTINCT c, tp FROM {alpha})) GROUP BY c, g)"
    touch = "b.tp > r.s AND b.tp <= r.e + 1" if until else "b.tp >= r.s - 1 AND b.tp < r.e"
    reach = "t.tp < b.tp AND t.tp >= r.s AND b.ts - t.ts" if until else "t.tp > b.tp AND t.tp <= r.e AND t.ts - b.ts"
    return f"SELECT DISTINCT tp, ts, c FROM {beta} UNION SELECT t.tp, t.ts, b.c FROM {beta} b JOIN {r} r ON r.c = b.c AND {touch} JOIN T t ON {reach} < {hi}"


ANTI = "SELECT p.tp, p.ts, p.u FROM purchase p WHERE NOT EXISTS (SELECT 1 FROM {q} q WHERE q.u = p.u AND {c})"
PATTERN = "SELECT DISTINCT b.tp, b.ts, a.x AS a, a.y AS b, {c} AS c{d} FROM A a JOIN B b ON {ab} AND b.tp >= a.tp AND b.ts - a.ts < 3600 JOIN C k ON {bc} AND k.tp >= b.tp AND k.ts - b.ts < 3600"
E, O = "events", "orders"
#: name: (trace, formula, further options, SQL after the trace's WITH)
FORMULAS: dict[str, tuple[str, str, dict, str]] = {
    "pred_scan": (E, "purchase(u)", {}, "SELECT tp, ts, u FROM purchase"),
    "pred_const": (E, "purchase(7)", {}, "SELECT tp, ts FROM purchase WHERE u = 7"),
    "pred_repeated_var": (E, "A(x, x)", {}, "SELECT tp, ts, x FROM A WHERE x = y"),
    "and_join": (O, "F(c, x) AND O(c, y)", {}, "SELECT f.tp, f.ts, f.c, f.k AS x, o.k AS y FROM F f JOIN O o ON o.tp = f.tp AND o.c = f.c"),
    "and_not_anti": (O, "F(c, x) AND NOT (EXISTS y. O(c, y))", {}, "SELECT tp, ts, c, k AS x FROM F f WHERE NOT EXISTS (SELECT 1 FROM O o WHERE o.tp = f.tp AND o.c = f.c)"),
    "or_union": (E, "error(u) OR signup(u)", {}, "SELECT tp, ts, u FROM error UNION SELECT tp, ts, u FROM signup"),
    "exists_project": (O, "EXISTS x. P(c, x)", {}, "SELECT DISTINCT tp, ts, c FROM P"),
    "forall_guarded": (O, "F(c, x) AND FORALL y. (F(c, y) IMPLIES (x < y OR x = y))", {}, "SELECT tp, ts, c, min(k) AS x FROM F GROUP BY tp, ts, c"),
    "eq_filter": (E, "bought(u, e) AND u = 7", {}, "SELECT tp, ts, u, ev AS e FROM bought WHERE u = 7"),
    "eq_bind": (E, "purchase(u) AND w = u", {}, "SELECT tp, ts, u, u AS w FROM purchase"),
    "less_filter": (O, "F(c, x) AND O(d, y) AND x < y", {}, "SELECT f.tp, f.ts, f.c, f.k AS x, o.c AS d, o.k AS y FROM F f JOIN O o ON o.tp = f.tp WHERE f.k < o.k"),
    "true_rel": (E, "TRUE", {}, "SELECT tp, ts FROM T"),
    "closed_formula": (O, "NOT (EXISTS c, x. P(c, x))", {}, "SELECT tp, ts FROM T WHERE tp NOT IN (SELECT tp FROM P)"),
    "implies_violation": (E, "purchase(u) IMPLIES ONCE [0,3600) view(u)", {"negate": True}, ANTI.format(q="view", c=past("p", "q", 0, 3600))),
    "equiv_violation": (O, "(EXISTS a, b. F(a, b)) EQUIV (EXISTS a, b. P(a, b))", {"negate": True}, "SELECT tp, ts FROM T WHERE (tp IN (SELECT tp FROM F)) <> (tp IN (SELECT tp FROM P))"),
    "prev": (E, "PREVIOUS [0,600) error(u)", {}, "SELECT t.tp, t.ts, q.u FROM T t JOIN error q ON q.tp = t.tp - 1 AND t.ts - q.ts < 600"),
    "next": (E, "NEXT [0,600) error(u)", {}, "SELECT t.tp, t.ts, q.u FROM T t JOIN error q ON q.tp = t.tp + 1 AND q.ts - t.ts < 600"),
    "once_bounded": (E, "ONCE [0,3600) error(u)", {}, f"SELECT DISTINCT t.tp, t.ts, q.u FROM T t JOIN error q ON {past('t', 'q', 0, 3600)}"),
    "once_lower": (E, "ONCE [600,7200) error(u)", {}, f"SELECT DISTINCT t.tp, t.ts, q.u FROM T t JOIN error q ON {past('t', 'q', 600, 7200)}"),
    "once_unbounded": (E, "purchase(u) AND ONCE [3600,*) signup(u)", {}, f"SELECT p.tp, p.ts, p.u FROM purchase p WHERE EXISTS (SELECT 1 FROM signup q WHERE q.u = p.u AND {past('p', 'q', 3600, None)})"),
    "eventually_bounded": (E, "EVENTUALLY [60,3600) error(u)", {}, f"SELECT DISTINCT t.tp, t.ts, q.u FROM T t JOIN error q ON {past('t', 'q', 60, 3600, '', -1)}"),
    "historically_guarded": (E, "purchase(u) AND HISTORICALLY [0,86400) (NOT error(u))", {}, ANTI.format(q="error", c=past("p", "q", 0, 86400))),
    "always_guarded": (E, "purchase(u) AND ALWAYS [0,86400) (NOT error(u))", {}, ANTI.format(q="error", c=past("p", "q", 0, 86400, "", -1))),
    "since_pos": (O, "(EXISTS x. O(c, x)) SINCE [0,30] (EXISTS y. F(c, y))", {}, runs("F", "O", 31)),
    "until_pos": (O, "(EXISTS x. O(c, x)) UNTIL [0,30] (EXISTS y. F(c, y))", {}, runs("F", "O", 31, True)),
    "since_neg": (E, "(NOT error(u)) SINCE [0,1800) purchase(u)", {}, since_not("purchase", "error", 0, 1800)),
    "until_neg": (E, "(NOT error(u)) UNTIL [0,1800) purchase(u)", {}, since_not("purchase", "error", 0, 1800, True)),
    "trigger_guarded": (E, "purchase(u) AND (error(u) TRIGGER [0,86400) (NOT view(u)))", {}, f"SELECT tp, ts, u FROM purchase EXCEPT ({since_not('view', 'error', 0, 86400)})"),
    "release_guarded": (E, "purchase(u) AND (error(u) RELEASE [0,86400) (NOT view(u)))", {}, f"SELECT tp, ts, u FROM purchase EXCEPT ({since_not('view', 'error', 0, 86400, True)})"),
    "and_once": (E, "purchase(u) AND ONCE [0,86400) error(u)", {}, f"SELECT p.tp, p.ts, p.u FROM purchase p WHERE EXISTS (SELECT 1 FROM error q WHERE q.u = p.u AND {past('p', 'q', 0, 86400)})"),
    "and_once_binding": (E, "purchase(u) AND ONCE [1,43200) failed(u, e)", {}, f"SELECT p.tp, p.ts, p.u, q.event_id AS e FROM purchase p JOIN e q ON q.event_type = 'error' AND q.user_id = p.u AND {past('p', 'q', 1, 43200)}"),
    "and_not_once": (E, "purchase(u) AND NOT (ONCE [60,86400) error(u))", {}, ANTI.format(q="error", c=past("p", "q", 60, 86400))),
    "and_not_eventually": (E, "purchase(u) AND NOT (EVENTUALLY [60,86400) error(u))", {}, ANTI.format(q="error", c=past("p", "q", 60, 86400, "", -1))),
    "star": (E, "((ONCE [0,3600) A(a,b)) AND B(a,c)) AND EVENTUALLY [0,3600) C(a,d)", {}, PATTERN.format(c="b.y", d=", k.y AS d", ab="b.x = a.x", bc="k.x = a.x")),
    "linear": (E, "((ONCE [0,3600) A(a,b)) AND B(b,c)) AND EVENTUALLY [0,3600) C(c,d)", {}, PATTERN.format(c="b.y", d=", k.y AS d", ab="b.x = a.y", bc="k.x = b.y")),
    "triangle": (E, "((ONCE [0,3600) A3(a,b)) AND B3(b,c)) AND EVENTUALLY [0,3600) C3(c,a)", {}, PATTERN.format(c="b.y", d="", ab="b.x = a.y", bc="k.x = b.y AND k.y = a.x").replace("FROM A a JOIN B b", "FROM A3 a JOIN B3 b").replace("JOIN C k", "JOIN C3 k")),
    "string_const": (E, "typed(u, 'error') AND NOT (ONCE [0,7200) typed(u, \"click\"))", {}, f"SELECT p.tp, p.ts, p.u FROM error p WHERE NOT EXISTS (SELECT 1 FROM click q WHERE q.u = p.u AND {past('p', 'q', 0, 7200)})"),
    "string_bind": (E, "typed(u, k) AND NOT k = 'view' AND ONCE [1,1800) typed(u, 'view')", {}, f"SELECT p.tp, p.ts, p.user_id AS u, p.event_type AS k FROM e p WHERE p.event_type <> 'view' AND EXISTS (SELECT 1 FROM view q WHERE q.u = p.user_id AND {past('p', 'q', 1, 1800)})"),
    "false_rel": (E, "FALSE OR (EXISTS u. error(u))", {}, "SELECT DISTINCT tp, ts FROM error"),
    "easy": (E, "A(x,y) AND (ONCE [1,1800] B(x,z)) AND (ONCE [1,1800] C(x,q))", {}, f"SELECT DISTINCT a.tp, a.ts, a.x, a.y, b.y AS z, k.y AS q FROM A a JOIN B b ON b.x = a.x AND {past('a', 'b', 1, 1801)} JOIN C k ON k.x = a.x AND {past('a', 'k', 1, 1801)}"),
    "insert_propagation": (O, "O(c, x) AND NOT (EVENTUALLY [0,30) (EXISTS y. (F(c, y) OR P(c, y))))", {}, f"SELECT o.tp, o.ts, o.c, o.k AS x FROM O o WHERE NOT EXISTS (SELECT 1 FROM (SELECT * FROM F UNION ALL SELECT * FROM P) q WHERE q.c = o.c AND {past('o', 'q', 0, 30, '', -1)})"),
    "delete_propagation": (
        O, "((O(c, x) AND NOT (ONCE [0,60) (EXISTS y. F(c, y)))) OR (O(c, x) AND ((ONCE [0,60) (EXISTS y. P(c, y))) OR (EVENTUALLY [0,60) (EXISTS y. P(c, y)))))) AND NOT (EVENTUALLY [0,60) (EXISTS y. F(c, y)))", {},
        f"SELECT o.tp, o.ts, o.c, o.k AS x FROM O o WHERE (NOT EXISTS (SELECT 1 FROM F q WHERE q.c = o.c AND {past('o', 'q', 0, 60)}) OR EXISTS (SELECT 1 FROM P q WHERE q.c = o.c AND abs(o.ts - q.ts) < 60)) AND NOT EXISTS (SELECT 1 FROM F q WHERE q.c = o.c AND {past('o', 'q', 0, 60, '', -1)})",
    ),
}


def formula_query(name: str):
    kind, formula, options, _ = FORMULAS[name]

    def run(spark, sf_dir: str) -> DataFrame:
        monitor = Monitor(formula, **options)
        mentions = sum(isinstance(x, (Pred, Temporal)) for x in monitor.formula.walk())
        if isinstance(monitor.formula, (Once, Eventually, Since, Until)):
            # without a guard the time-points are counted and met, too
            mentions += 2
        return monitor.run(*(events_trace if kind == E else orders_trace)(spark, sf_dir, mentions))

    return run


def facts_of(spark, sf_dir: str) -> DataFrame:
    """events as facts: relation by type, arguments user and event modulo 10."""
    e = event_rows(spark, sf_dir)
    return e.select(F.col("event_type").alias("relation"), "tp", "ts", F.array(F.col("user_id").cast("string"), (F.col("event_id") % 10).cast("string")).alias("args"))


def collapse_ts(spark, sf_dir):
    rel, t = events_trace(spark, sf_dir)
    day = lambda d: d.withColumn("ts", F.floor(F.col("ts") / 86400).cast("long"))
    return Monitor("purchase(u) AND PREVIOUS [0,2) error(u)", collapse=True).run({k: day(v) for k, v in rel.items()}, day(t))


def relation_freq(spark, sf_dir):
    return st.frequencies(facts_of(spark, sf_dir), 3600)


def heavy_hitters(spark, sf_dir):
    return st.heavy_hitters(facts_of(spark, sf_dir), 86400, 8)


def heavy_merged(spark, sf_dir):
    _, heavy = st.split_statistics(st.relation_statistics(facts_of(spark, sf_dir), 86400, 8))
    return st.merge_heavy(heavy, 5)


def histogram_merge(spark, sf_dir):
    facts = facts_of(spark, sf_dir)
    a, b = (st.histogram(facts.where(F.col("tp") % 2 == i)).drop("total") for i in (0, 1))
    return st.merge_histograms(a, b)


def verdict_lines(spark, sf_dir):
    return traces.verdict_lines(formula_query("and_once")(spark, sf_dir))


def csv_roundtrip(spark, sf_dir):
    facts, _ = traces.parse_csv(traces.csv_lines(facts_of(spark, sf_dir)).select(F.col("line").alias("value")))
    return facts.select("relation", "tp", "ts", F.get("args", F.lit(0)).alias("a0"), F.get("args", F.lit(1)).alias("a1"))


def database_roundtrip(spark, sf_dir):
    facts = facts_of(spark, sf_dir)
    lines = traces.database_lines(facts, facts.select("tp", "ts").distinct())
    parsed, _ = traces.parse_databases(lines.select(F.col("tp").alias("n"), F.col("line").alias("value")))
    return parsed.select("relation", "tp", "ts", F.get("args", F.lit(0)).alias("a0"), F.get("args", F.lit(1)).alias("a1"))


SLICED = "purchase(u, a) AND ONCE [0,86400) error(u, b)"


def hypercube_equiv(spark, sf_dir):
    facts = facts_of(spark, sf_dir)
    slicer = Slicer.optimize(read(SLICED), 4, {"purchase": 100.0, "error": 50.0})
    sig = {k: [("u", "string"), ("e", "string")] for k in ("purchase", "error")}
    return run_sliced(slicer, facts, facts.select("tp", "ts"), sig)


def hypercube_heavy(spark, sf_dir):
    """The busiest users are heavy, so their facts are dealt by the other variables."""
    facts = facts_of(spark, sf_dir)
    busy = [r["user_id"] for r in table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "user_id").limit(3).collect()]
    slicer = Slicer.optimize(read(SLICED), 4, {"purchase": 100.0, "error": 50.0}, {"u": {str(x) for x in busy}})
    sig = {k: [("u", "string"), ("e", "string")] for k in ("purchase", "error")}
    return run_sliced(slicer, facts, facts.select("tp", "ts"), sig)


def hopping_frequencies(spark, sf_dir):
    """Counts of users over the last three days at each day."""
    return st.hopping_histogram(facts_of(spark, sf_dir), 86400, 3).where("attribute = 0").select("start", "relation", "value", "n")


def sliced_load(spark, sf_dir):
    return slice_load(Slicer.optimize(read(SLICED), 4, {}).slice_facts(facts_of(spark, sf_dir)), 86400)


def out_of_order_reorder(spark, sf_dir):
    """Split over sources, delayed and put back in order: verdicts as of the whole trace."""
    late = gen.delay(gen.split(facts_of(spark, sf_dir), 4), 3.0, 10)
    facts, t = gen.reorder(late, collapse=False)
    sig = {k: [("u", "long"), ("e", "long")] for k in ("purchase", "error")}
    return Monitor("EXISTS a. (purchase(u, a) AND ONCE [0,86400) (EXISTS b. error(u, b)))").run(traces.relations(facts, sig), t)


def generated_triangle(spark, sf_dir):
    """Violations in a generated trace of 20 s at 1000 events/s."""
    w = gen.Workload(pattern="triangle", seconds=20, event_rate=1000, violations=0.02)
    facts = gen.generate(spark, w)
    sig = {k: [("x", "long"), ("y", "long")] for k in "ABC"}
    return Monitor("((ONCE [0,10) A(a,b)) AND B(b,c)) AND EVENTUALLY [0,10) C(c,a)").run(traces.relations(facts, sig), facts.select("tp", "ts").distinct())


FACTS_SQL = EVENTS_SQL + ", facts AS (SELECT event_type AS relation, tp, ts, CAST(user_id AS VARCHAR) AS a0, CAST(event_id % 10 AS VARCHAR) AS a1 FROM e), vals AS (SELECT relation, tp, ts, 0 AS attribute, a0 AS value FROM facts UNION ALL SELECT relation, tp, ts, 1, a1 FROM facts)"
HEAVY_SQL = FACTS_SQL + ", tot AS (SELECT ts // 86400 * 86400 AS start, relation, count(*) AS n FROM facts GROUP BY ALL), hv AS (SELECT v.start, v.relation, v.attribute, v.value, v.n FROM (SELECT ts // 86400 * 86400 AS start, relation, attribute, value, count(*) AS n FROM vals GROUP BY ALL) v JOIN tot USING (start, relation) WHERE v.n >= ceil(tot.n / 16.0))"

QUERIES = {name: formula_query(name) for name in FORMULAS} | {
    f.__name__: f
    for f in (collapse_ts, relation_freq, heavy_hitters, heavy_merged, histogram_merge, verdict_lines, csv_roundtrip, database_roundtrip, hypercube_equiv, hypercube_heavy, hopping_frequencies, sliced_load, out_of_order_reorder, generated_triangle)
}
ORACLES = {name: f"{EVENTS_SQL if kind == E else ORDERS_SQL} {sql}" for name, (kind, _, _, sql) in FORMULAS.items()} | {
    "collapse_ts": EVENTS_SQL + ", d AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS tp FROM (SELECT DISTINCT ts // 86400 AS ts FROM T)) SELECT DISTINCT d.tp, d.ts, p.u FROM purchase p JOIN d ON d.ts = p.ts // 86400 JOIN d b ON b.tp = d.tp - 1 AND d.ts - b.ts < 2 JOIN error q ON q.u = p.u AND q.ts // 86400 = b.ts",
    "relation_freq": FACTS_SQL + " SELECT ts // 3600 * 3600 AS start, relation, count(*) AS n FROM facts GROUP BY ALL",
    "heavy_hitters": HEAVY_SQL + " SELECT start, relation, CAST(attribute AS INTEGER) AS attribute, value, n FROM hv",
    "heavy_merged": HEAVY_SQL + " SELECT relation, CAST(attribute AS INTEGER) AS attribute, value, count(DISTINCT start) AS windows FROM hv GROUP BY ALL HAVING count(DISTINCT start) >= 5",
    "histogram_merge": FACTS_SQL + " SELECT relation, CAST(attribute AS INTEGER) AS attribute, value, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY relation, attribute) AS BIGINT) AS total FROM vals GROUP BY relation, attribute, value",
    "verdict_lines": EVENTS_SQL + f" SELECT p.tp, '@' || p.ts || '. (time point ' || p.tp || '): (' || p.u || ')' AS line FROM purchase p WHERE EXISTS (SELECT 1 FROM error q WHERE q.u = p.u AND {past('p', 'q', 0, 86400)})",
    "csv_roundtrip": FACTS_SQL + " SELECT relation, tp, ts, a0, a1 FROM facts",
    "database_roundtrip": FACTS_SQL + " SELECT relation, tp, ts, a0, a1 FROM facts",
    "hypercube_equiv": FACTS_SQL + f" SELECT DISTINCT p.tp, p.ts, p.a0 AS u, p.a1 AS a, q.a1 AS b FROM facts p JOIN facts q ON p.relation = 'purchase' AND q.relation = 'error' AND q.a0 = p.a0 AND {past('p', 'q', 0, 86400)}",
    "hypercube_heavy": FACTS_SQL + f" SELECT DISTINCT p.tp, p.ts, p.a0 AS u, p.a1 AS a, q.a1 AS b FROM facts p JOIN facts q ON p.relation = 'purchase' AND q.relation = 'error' AND q.a0 = p.a0 AND {past('p', 'q', 0, 86400)}",
    "hopping_frequencies": FACTS_SQL + ", f AS (SELECT relation, a0 AS value, ts // 86400 * 86400 AS d FROM facts) SELECT d - k * 86400 AS start, relation, value, count(*) AS n FROM f, range(0, 3) r(k) GROUP BY ALL",
    "out_of_order_reorder": f"{EVENTS_SQL} {FORMULAS['and_once'][3]}",
}
