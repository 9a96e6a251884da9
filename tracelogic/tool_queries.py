"""Registered queries over statistics, formats and trace tools, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .formula.rewrite import read
from .functions import statistics as st
from .queries import EVENTS_SQL, FACTS_SQL, HEAVY_SQL, facts_of, formula_query, past
from .sources import generate as gen
from .sources import live, traces

DAY = 86400


def two_args(facts: DataFrame, *columns: str) -> DataFrame:
    return facts.select(*columns, F.get("args", F.lit(0)).alias("a0"), F.get("args", F.lit(1)).alias("a1"))


def by_day(spark, sf_dir: str) -> DataFrame:
    """Facts with days as time-points and time-stamps."""
    day = F.floor(F.col("ts") / DAY).cast("long")
    return facts_of(spark, sf_dir).select("relation", day.alias("tp"), day.alias("ts"), "args")


def relation_stats(spark, sf_dir):
    return st.relation_statistics(facts_of(spark, sf_dir), DAY, 8)


def relation_stats_counts(spark, sf_dir):
    """Heavy values with their counts, of at least 30 events."""
    return st.relation_statistics(facts_of(spark, sf_dir), DAY, 8, 30, counts=True)


def statistics_lines(spark, sf_dir):
    return st.statistics_lines(st.relation_statistics(facts_of(spark, sf_dir), DAY, 8))


def relevant_facts(spark, sf_dir):
    return two_args(st.relevant(facts_of(spark, sf_dir), read('purchase(u, "3") AND ONCE error(u, "4")')), "relation", "tp", "ts")


def heavy_of_histogram(spark, sf_dir):
    return st.heavy_of(st.histogram(facts_of(spark, sf_dir)), 8)


def lateness(spark, sf_dir):
    """Peak and mean of a latency (event number modulo 97) for each relation and day."""
    rows = facts_of(spark, sf_dir).select("relation", st.window_start(F.col("ts"), DAY).alias("start"), (F.col("tp") % 97).alias("wait"))
    return st.latencies(rows, ["relation", "start"], "wait").select("relation", "start", "peak", F.round("mean", 6).alias("mean"))


def linearized_days(spark, sf_dir):
    return two_args(traces.linearized(by_day(spark, sf_dir)), "relation", "tp", "ts")


def plain_roundtrip(spark, sf_dir):
    """Written as plain lines with time and read back."""
    lines = traces.plain_lines(facts_of(spark, sf_dir), timed=True)
    facts, _ = traces.parse_plain(lines.select(F.col("tp").alias("n"), F.col("line").alias("value")), timed=True)
    return two_args(facts, "relation", "tp", "ts")


def grouped_verdicts(spark, sf_dir):
    """One line for each day with the users that bought."""
    days = by_day(spark, sf_dir).where("relation = 'purchase'").select("tp", "ts", F.col("args")[0].alias("u")).distinct()
    return traces.verdict_lines(days, grouped=True)


def verdict_roundtrip(spark, sf_dir):
    found = traces.parse_verdicts(traces.verdict_lines(formula_query("and_once")(spark, sf_dir)).select(F.col("line").alias("value")))
    return found.select("tp", "ts", F.col("args")[0].cast("long").alias("u"))


def verdict_difference(spark, sf_dir):
    """Purchases after an error within a day, against all purchases by time-stamp."""
    every = formula_query("pred_scan")(spark, sf_dir)
    return traces.diff_verdicts(formula_query("and_once")(spark, sf_dir), every.toDF("tp", "ts", "u"), collapse=True)


def cut_trace(spark, sf_dir):
    return two_args(traces.cut(facts_of(spark, sf_dir), 1704672000, 1705276800), "relation", "tp", "ts")


def closing_lines(spark, sf_dir):
    """csv lines of each day's purchases, closed behind each time-stamp."""
    mine = by_day(spark, sf_dir).where("relation = 'purchase'").distinct()
    return traces.closed_lines(mine, mine.select("tp", "ts").distinct(), "timestamps")


def command_rows(spark, sf_dir):
    """Facts and watermark lines of four sources as the live reordering takes them."""
    facts = facts_of(spark, sf_dir).withColumn("source", (F.col("tp") % 4).cast("int"))
    lines = traces.csv_lines(facts.where("relation <> 'error'"), keep=("source",)).select("source", F.col("line").alias("value"))
    marks = facts.where("relation = 'error'").select("source", F.concat(F.lit(">WATERMARK "), F.col("ts").cast("string"), F.lit("<")).alias("value"))
    return traces.source_rows(lines.unionByName(marks)).select("source", "command", "value", "relation", "tp", "ts", F.get("args", F.lit(0)).alias("a0"))


def late_facts(spark, sf_dir):
    """Facts of four sources that come up to four hours late, against an allowance of an hour."""
    f = facts_of(spark, sf_dir)
    rows = f.select((F.col("tp") % 4).alias("source"), F.col("ts").alias("emission"), (F.col("ts") - (F.col("tp") % 5) * 3600).alias("ts"), "tp")
    return live.late_rows(rows, 3600).where("late").select("source", "tp", "ts")


def source_watermarks(spark, sf_dir):
    rows = facts_of(spark, sf_dir).select((F.col("tp") % 4).alias("source"), F.col("ts").alias("emission"))
    return gen.watermarks(rows, 6 * 3600, 3600)


QUERIES = {
    f.__name__: f
    for f in (
        relation_stats, relation_stats_counts, statistics_lines, relevant_facts, heavy_of_histogram, lateness, linearized_days, plain_roundtrip, grouped_verdicts, verdict_roundtrip, verdict_difference, cut_trace,
        closing_lines, command_rows, late_facts, source_watermarks,
    )
}
STATS_SQL = HEAVY_SQL + ", s AS (SELECT t.start, t.relation, t.n, coalesce((SELECT string_agg(h.value, ',' ORDER BY h.value) FROM hv h WHERE h.start = t.start AND h.relation = t.relation AND h.attribute = 0), '') || ';' || coalesce((SELECT string_agg(h.value, ',' ORDER BY h.value) FROM hv h WHERE h.start = t.start AND h.relation = t.relation AND h.attribute = 1), '') AS heavy FROM tot t)"
COUNTS_SQL = STATS_SQL.replace("string_agg(h.value, ',' ORDER BY h.value)", "string_agg(h.value || ',' || h.n, ',' ORDER BY h.value || ',' || h.n)").replace("h.start = t.start AND", "h.n >= 30 AND h.start = t.start AND")
DAYS_SQL = FACTS_SQL + ", d AS (SELECT relation, ts // 86400 AS tp, ts // 86400 AS ts, a0, a1 FROM facts)"
ORACLES = {
    "relation_stats": STATS_SQL + " SELECT start, relation, n, heavy FROM s",
    "relation_stats_counts": COUNTS_SQL + " SELECT start, relation, n, heavy FROM s",
    "statistics_lines": STATS_SQL + " SELECT start || ',' || relation || ',' || n || ',' || heavy AS line FROM s",
    "relevant_facts": FACTS_SQL + " SELECT relation, tp, ts, a0, a1 FROM facts WHERE (relation = 'purchase' AND a1 = '3') OR (relation = 'error' AND a1 = '4')",
    "heavy_of_histogram": FACTS_SQL + ", h AS (SELECT relation, CAST(attribute AS INTEGER) AS attribute, value, count(*) AS n, CAST(sum(count(*)) OVER (PARTITION BY relation, attribute) AS BIGINT) AS total FROM vals GROUP BY relation, attribute, value) SELECT * FROM h WHERE n * 16 > total",
    "lateness": FACTS_SQL + " SELECT relation, ts // 86400 * 86400 AS start, max(tp % 97) AS peak, round(avg(tp % 97), 6) AS mean FROM facts GROUP BY ALL",
    "linearized_days": DAYS_SQL + " SELECT relation, row_number() OVER (ORDER BY tp, relation, a0, a1) - 1 AS tp, ts, a0, a1 FROM d",
    "plain_roundtrip": FACTS_SQL + " SELECT relation, tp, ts, a0, a1 FROM facts",
    "grouped_verdicts": DAYS_SQL + " SELECT tp, '@' || tp || '. (time point ' || tp || '): ' || string_agg('(' || a0 || ')', '' ORDER BY '(' || a0 || ')') AS line FROM (SELECT DISTINCT tp, a0 FROM d WHERE relation = 'purchase') GROUP BY tp",
    "verdict_roundtrip": EVENTS_SQL + f" SELECT p.tp, p.ts, p.u FROM purchase p WHERE EXISTS (SELECT 1 FROM error q WHERE q.u = p.u AND {past('p', 'q', 0, 86400)})",
    "verdict_difference": EVENTS_SQL + f", x AS (SELECT DISTINCT p.ts AS tp, p.ts, p.u FROM purchase p WHERE EXISTS (SELECT 1 FROM error q WHERE q.u = p.u AND {past('p', 'q', 0, 86400)})), y AS (SELECT DISTINCT ts AS tp, ts, u FROM purchase) SELECT *, 'left' AS side FROM (SELECT * FROM x EXCEPT SELECT * FROM y) UNION ALL SELECT *, 'right' AS side FROM (SELECT * FROM y EXCEPT SELECT * FROM x)",
    "cut_trace": FACTS_SQL + " SELECT relation, tp, ts, a0, a1 FROM facts WHERE ts >= 1704672000 AND ts < 1705276800",
    "closing_lines": DAYS_SQL + ", p AS (SELECT DISTINCT * FROM d WHERE relation = 'purchase') SELECT tp, 0 AS last, relation || ', tp=' || tp || ', ts=' || ts || ', x0=' || a0 || ', x1=' || a1 AS line FROM p UNION ALL SELECT DISTINCT tp, 1, ';;' FROM p",
    "command_rows": FACTS_SQL + " SELECT CAST(tp % 4 AS INTEGER) AS source, NULL::VARCHAR AS command, NULL::BIGINT AS value, relation, tp, ts, a0 FROM facts WHERE relation <> 'error' UNION ALL SELECT CAST(tp % 4 AS INTEGER), 'WATERMARK', ts, NULL, NULL, NULL, NULL FROM facts WHERE relation = 'error'",
    "late_facts": FACTS_SQL + ", r AS (SELECT tp % 4 AS source, ts AS emission, ts - tp % 5 * 3600 AS ts, tp FROM facts) SELECT source, tp, ts FROM (SELECT *, max(ts) OVER (PARTITION BY source ORDER BY emission RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM r) WHERE ts < top - 3600",
    "source_watermarks": FACTS_SQL + ", r AS (SELECT tp % 4 AS source, min(ts) AS a, max(ts) AS b FROM facts GROUP BY 1) SELECT source, unnest(range(a, b + 1, 21600)) AS emission, unnest(range(a, b + 1, 21600)) - 3600 AS watermark FROM r",
}
