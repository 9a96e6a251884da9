"""Trace and verdict files: readers, writers, signatures.

All readers give facts (relation, tp, ts, args array<string>) and time-points (tp, ts).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FACTS = "relation string, tp long, ts long, args array<string>"
SIMPLE = r"^[A-Za-z0-9_\[\]/:.-]+$"
#: Values that need no quotes in csv lines and verdicts.
CLEAN = r'^(?:[^\s,()"\\]|[^\s,()"\\][^,()"\\\n]*[^\s,()"\\])?$'


def signature(text: str) -> dict[str, list[tuple[str, str]]]:
    """Relations of a signature file: name to (column, Spark type) in order; unnamed columns are x0, x1, ..."""
    out: dict[str, list[tuple[str, str]]] = {}
    for name, inside in re.findall(r"([A-Za-z0-9_]+)\s*\(([^)]*)\)", re.sub(r"#[^\n]*|\(\*.*?\*\)", "", text, flags=re.S)):
        cols = []
        for i, part in enumerate(p.strip() for p in inside.split(",") if p.strip()):
            column, _, kind = part.rpartition(":")
            cols.append((column.strip() or f"x{i}", {"int": "long", "string": "string", "float": "double"}[kind.strip()]))
        out[name] = cols
    return out


def relations(facts: DataFrame, sig: dict[str, list[tuple[str, str]]]) -> dict[str, DataFrame]:
    """A typed table (tp, ts, x0, ...) for each relation; facts of another arity are left out."""
    out = {}
    for name, cols in sig.items():
        mine = facts.where((F.col("relation") == name) & (F.size("args") == len(cols)))
        out[name] = mine.select("tp", "ts", *[F.get("args", F.lit(i)).cast(kind).alias(f"x{i}") for i, (_, kind) in enumerate(cols)])
    return out


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


#: A value in a line: quoted, with \\, \" and \n inside, or anything without comma and quote.
VALUE = r'(?:[^,"]|"(?:[^"\\]|\\.)*+")*+'


def unquoted(x):
    """The value that a text stands for; text without quotes is itself, without blanks around it."""
    inner = F.regexp_extract(x, r'^[^"]*"((?:[^"\\]|\\.)*)"\s*$', 1)
    plain = F.replace(F.replace(F.replace(F.replace(inner, F.lit("\\\\"), F.lit("\0")), F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"')), F.lit("\0"), F.lit("\\"))
    return F.when(F.regexp_like(x, F.lit(r'^\s*"')), plain).otherwise(F.trim(x))


def closed_lines(facts: DataFrame, timepoints: DataFrame, mode: str = "all") -> DataFrame:
    """tp, last and line of csv lines with ``;;`` behind each time-point (all), each time-stamp (timestamps) or nowhere (none).

    Written in order of (tp, last). Empty time-points get their ``;;`` too.
    """
    lines = csv_lines(facts).select("tp", F.lit(0).alias("last"), "line")
    if mode == "none":
        return lines
    if mode not in ("all", "timestamps"):
        raise ValueError(f"unknown mode {mode}")
    ends = timepoints.select("tp") if mode == "all" else timepoints.groupBy("ts").agg(F.max("tp").alias("tp")).select("tp")
    return lines.unionByName(ends.select("tp", F.lit(1).alias("last"), F.lit(";;").alias("line")))


def quoted(a, simple: str):
    """a in quotes unless it matches ``simple``."""
    inner = F.replace(F.replace(F.replace(a, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n"))
    return F.when(F.regexp_like(a, F.lit(simple)), a).otherwise(F.concat(F.lit('"'), inner, F.lit('"')))


def parse_csv(text: DataFrame, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """``R, tp=1, ts=2, x0=a, ...`` lines (column value; ``keep`` are further columns that come along). Argument names
    don't count; ``;;`` and ``>...<`` lines are no facts.

    Empty values are values; only a comma with nothing behind it, after ts, is no argument. Works on streams too.
    """
    parts = F.regexp_extract_all(F.concat("value", F.lit(",")), F.lit(f"({VALUE}),"), F.lit(1))
    after = lambda x: unquoted(F.regexp_replace(x, r'^[^="]*=', ""))
    rows = text.where(F.regexp_like("value", F.lit(r"^\s*[^>;\s][^,]*,\s*tp\s*="))).select(*keep, parts.alias("p"))
    args = F.slice("p", 4, F.size("p"))
    none = (F.size("p") == 4) & (F.trim(F.get("p", F.lit(3))) == "")
    facts = rows.select(*keep, F.trim(F.get("p", F.lit(0))).alias("relation"), after(F.get("p", F.lit(1))).cast("long").alias("tp"), after(F.get("p", F.lit(2))).cast("long").alias("ts"), F.when(none, F.array().cast("array<string>")).otherwise(F.transform(args, after)).alias("args"))
    return facts, facts.select("tp", "ts").distinct()


def parse_commands(text: DataFrame) -> DataFrame:
    """text's columns with command and arguments (array) of its ``>NAME a b<`` lines (column value), such as START,
    WATERMARK, EOF, LATENCY or set_slicer; null on other lines. Works on streams too."""
    inside = F.regexp_extract("value", r"^\s*>(.*)<\s*$", 1)
    is_command = F.regexp_like("value", F.lit(r"^\s*>\s*\S.*<\s*$"))
    parts = F.split(F.trim(inside), r"\s+")
    return text.withColumn("command", F.when(is_command, parts[0])).withColumn("arguments", F.when(is_command, F.slice(parts, 2, F.size(parts))))


def command_line(name: str, *arguments) -> str:
    return ">" + " ".join([name, *map(str, arguments)]) + "<"


def source_rows(text: DataFrame) -> DataFrame:
    """Rows (source, command, value, relation, tp, ts, args) of csv lines (columns source, value): facts and commands
    with a number, as streaming.reorder takes them."""
    named = parse_commands(text)
    said = named.where("command is not null").select("source", "command", F.get("arguments", F.lit(0)).try_cast("long").alias("value"), *[F.lit(None).cast(t).alias(c) for c, t in (("relation", "string"), ("tp", "long"), ("ts", "long"), ("args", "array<string>"))])
    facts, _ = parse_csv(text, keep=("source",))
    return said.unionByName(facts.select("source", F.lit(None).cast("string").alias("command"), F.lit(None).cast("long").alias("value"), "relation", "tp", "ts", "args"))


def parse_plain(text: DataFrame, timed: bool = False) -> tuple[DataFrame, DataFrame]:
    """``R,a,b[,ts]`` lines (columns n, value): each event is its own time-point, numbered by n from 0."""
    parts = F.split("value", ",")
    rows = text.where(F.trim("value") != "")
    last = F.size(parts) - (1 if timed else 0)
    ts = F.get(parts, F.size(parts) - 1).cast("long") if timed else F.col("n").cast("long")
    facts = rows.select(F.trim(parts[0]).alias("relation"), F.col("n").cast("long").alias("tp"), ts.alias("ts"), F.transform(F.slice(parts, 2, F.greatest(F.lit(0), last - 1)), lambda x: F.trim(x)).alias("args"))
    return facts, facts.select("tp", "ts").distinct()


ITEM = re.compile(r"""\s+|\#[^\n]*|>[^<\n]*<|(?P<at>@)\s*(?P<ts>-?[0-9]+)|(?P<name>[A-Za-z0-9_]+)(?=\s*\()|(?P<open>\()|(?P<close>\))|(?P<text>"(?:[^"\\]|\\.)*")|(?P<word>[A-Za-z0-9_\[\]/:.\-']+)|(?P<mark>[,;])""")


ESCAPE = re.compile(r"\\(.)", re.S)


def database_items(source: str) -> Iterator[tuple[str | None, int, int, list[str]]]:
    """(relation, position of the database, ts, args) of ``@ts R(a,b)(c,d) S(e);`` text; relation is None once for each database."""
    tp, ts, relation, args, value = -1, 0, "", None, None
    at = 0
    while at < len(source):
        m = ITEM.match(source, at)
        if not m:
            raise ValueError(f"unexpected {source[at : at + 12]!r} at {at}")
        at = m.end()
        if m["at"]:
            tp, ts = tp + 1, int(m["ts"])
            yield None, tp, ts, []
        elif m["open"]:
            args, value = [], None
        elif m["close"]:
            if args is None:
                raise ValueError(f"unexpected ) at {at}")
            yield relation, tp, ts, args if value is None else [*args, value]
            args = None
        elif args is not None:
            if m["mark"] == ",":
                args.append(value or "")
                value = None
            elif m["text"]:
                value = ESCAPE.sub(lambda e: "\n" if e[1] == "n" else e[1], m["text"][1:-1])
            elif m["word"] or m["name"]:
                value = m["word"] or m["name"]
        elif m["name"]:
            relation = m["name"]


def parse_databases(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Databases that may span lines. chunks: (n, value), text pieces in order that each begin with an ``@``.

    Pieces are parsed apart; their database counts give offsets.
    """

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = []
            for n, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                out += [(n, *x) for x in database_items(v or "")]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(kinds)], ["n", "relation", "tp", "ts", "args"])

    items = chunks.select(F.col("n").cast("long"), "value").mapInArrow(run, "n long, " + FACTS)
    counts = items.where("relation is null").groupBy("n").agg(F.count("*").alias("_k"))
    offsets = counts.withColumn("_o", F.coalesce(F.sum("_k").over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_k")
    items = items.join(offsets, "n").withColumn("tp", F.col("tp") + F.col("_o")).drop("n", "_o")
    return items.where("relation is not null").select("relation", "tp", "ts", "args"), items.where("relation is null").select("tp", "ts")


def read_trace(spark: SparkSession, path: str, format: str = "csv", sep: str = "\n@") -> tuple[DataFrame, DataFrame]:
    """Facts and time-points of a file in csv, databases, plain or plain-timed format.

    Files are split by Spark's text reader; databases are split at line starts with ``@``, so a file of many databases
    is read by many tasks.
    """
    if format == "csv":
        return parse_csv(spark.read.text(path))
    if format == "databases":
        raw = spark.read.option("lineSep", sep).text(path).withColumn("n", F.monotonically_increasing_id())
        return parse_databases(raw.where(F.trim("value") != "").select("n", F.when(F.regexp_like(F.ltrim("value"), F.lit("^[@#>]")), F.col("value")).otherwise(F.concat(F.lit("@"), "value")).alias("value")))
    raw = spark.read.text(path).where(F.trim("value") != "").withColumn("_id", F.monotonically_increasing_id())
    counts = raw.groupBy(F.shiftright("_id", 33).alias("_p")).agg(F.count("*").alias("_k"))
    offsets = counts.withColumn("_o", F.coalesce(F.sum("_k").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_k")
    rank = F.row_number().over(Window.partitionBy("_p").orderBy("_id")) - 1
    numbered = raw.withColumn("_p", F.shiftright("_id", 33)).withColumn("_r", rank).join(offsets, "_p").select((F.col("_r") + F.col("_o")).alias("n"), "value")
    return parse_plain(numbered, timed=format == "plain-timed")


def read_heavy(spark: SparkSession, path: str) -> DataFrame:
    """(relation, attribute, value) of ``relation,attribute,value`` lines without a header."""
    return spark.read.csv(path, schema="relation string, attribute int, value string")


def heavy_values(rows: DataFrame | list, formula) -> dict[str, set[str]]:
    """Heavy values of the formula's free variables, for a Slicer: those of each attribute at which a variable stands.

    rows (relation, attribute, value): a table or rows of one.
    """
    from ..formula.ast import Var, atoms, free_variables

    free, out = set(free_variables(formula)), {}
    listed = {(a.relation, i): t.name for a in atoms(formula) for i, t in enumerate(a.args) if isinstance(t, Var) and t.name in free}
    for r in rows.collect() if isinstance(rows, DataFrame) else rows:
        if (r["relation"], r["attribute"]) in listed:
            out.setdefault(listed[r["relation"], r["attribute"]], set()).add(r["value"])
    return out


def cut(facts: DataFrame, first: int, last: int) -> DataFrame:
    """Facts with first <= ts < last."""
    return facts.where((F.col("ts") >= first) & (F.col("ts") < last))


# ---- writers


def linearized(facts: DataFrame) -> DataFrame:
    """Every event becomes its own time-point, in order of tp."""
    from ..monitor import number

    return number(facts.withColumnRenamed("tp", "_tp"), ["_tp", "relation", "args"], "_tp", 1).select("relation", "tp", "ts", "args")


def csv_lines(facts: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """tp and line of each fact in the csv format; ``keep`` are further columns that come along."""
    args = F.array_join(F.transform("args", lambda a, i: F.concat(F.lit(", x"), i.cast("string"), F.lit("="), quoted(a, CLEAN))), "")
    return facts.select(*keep, "tp", F.concat("relation", F.lit(", tp="), F.col("tp").cast("string"), F.lit(", ts="), F.col("ts").cast("string"), args).alias("line"))


def database_lines(facts: DataFrame, timepoints: DataFrame) -> DataFrame:
    """tp and line ``@ts R(a,b)(c,d) S(e);`` of each time-point, empty ones included."""
    tuples = facts.groupBy("tp", "relation").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("("), F.array_join(F.transform("args", lambda a: quoted(a, SIMPLE)), ","), F.lit(")")))), "").alias("_t"))
    groups = tuples.groupBy("tp").agg(F.array_join(F.array_sort(F.collect_list(F.concat("relation", "_t"))), " ").alias("_g"))
    body = F.coalesce(F.concat(F.lit(" "), "_g"), F.lit(""))
    return timepoints.join(groups, "tp", "left").select("tp", F.concat(F.lit("@"), F.col("ts").cast("string"), body, F.lit(";")).alias("line"))


def plain_lines(facts: DataFrame, timed: bool = False) -> DataFrame:
    """tp and line ``R,a,b``; fails at run time where a time-point has more than one event."""
    many = F.count("*").over(Window.partitionBy("tp")) > 1
    line = F.concat_ws(",", "relation", F.array_join("args", ","), *([F.col("ts").cast("string")] if timed else []))
    line = F.when(F.size("args") == 0, F.concat_ws(",", "relation", *([F.col("ts").cast("string")] if timed else []))).otherwise(line)
    return facts.select("tp", F.when(many, F.raise_error(F.lit("more than one event in a time-point"))).otherwise(line).alias("line"))


def verdict_lines(verdicts: DataFrame, grouped: bool = False) -> DataFrame:
    """tp and line ``@ts. (time point tp): (a, b)`` of each binding, or one line for each time-point."""
    cols = [c for c in verdicts.columns if c not in ("tp", "ts")]
    head = F.concat(F.lit("@"), F.col("ts").cast("string"), F.lit(". (time point "), F.col("tp").cast("string"), F.lit("): "))
    if not cols:
        return verdicts.select("tp", F.concat(head, F.lit("true" if grouped else "(true)")).alias("line"))
    sep = "," if grouped else ", "
    binding = F.concat(F.lit("("), F.concat_ws(sep, *[quoted(F.col(c).cast("string"), CLEAN) for c in cols]), F.lit(")"))
    if not grouped:
        return verdicts.select("tp", F.concat(head, binding).alias("line"))
    return verdicts.groupBy("tp", "ts").agg(F.array_join(F.array_sort(F.collect_list(binding)), "").alias("_b")).select("tp", F.concat(head, "_b").alias("line"))


def parse_verdicts(text: DataFrame) -> DataFrame:
    """tp, ts, args of each binding of verdict lines (column value), compact or grouped."""
    m = lambda i: F.regexp_extract("value", r"^@(-?[0-9]+)\. \(time ?-?point ([0-9]+)\): (.*)$", i)
    rows = text.where(F.regexp_like("value", F.lit(r"^@-?[0-9]+\. \(time"))).select(m(2).cast("long").alias("tp"), m(1).cast("long").alias("ts"), m(3).alias("rest"))
    closed = F.regexp_like("rest", F.lit(r"^\(?true\)?$"))
    bindings = F.when(closed, F.array(F.lit("true"))).otherwise(F.regexp_extract_all("rest", F.lit(r'\(((?:[^()"]|"(?:[^"\\]|\\.)*+")*+)\)'), F.lit(1)))
    parts = F.regexp_extract_all(F.concat("_x", F.lit(",")), F.lit(f"({VALUE}),"), F.lit(1))
    return rows.select("tp", "ts", closed.alias("_c"), F.explode(bindings).alias("_x")).select("tp", "ts", F.when(F.col("_c"), F.array().cast("array<string>")).otherwise(F.transform(parts, unquoted)).alias("args"))


def diff_verdicts(a: DataFrame, b: DataFrame, collapse: bool = False) -> DataFrame:
    """Rows in one set of verdicts only, with side 'left' or 'right'; collapse compares by time-stamp."""
    if collapse:
        a, b = (d.withColumn("tp", F.col("ts")).distinct() for d in (a, b))
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))
