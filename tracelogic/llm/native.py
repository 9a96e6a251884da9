"""Column expressions that several native operators share. Their cost is linear in the text, times log n for n matches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points of the pieces in which long texts are addressed.
PIECE = 512


def let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """combine(values[0], ..., values[i]) at each i, by doubling: a round for each bit of the array's length."""

    def scan(whole: Column) -> Column:
        def step(a: Column, j: Column) -> Column:
            return F.transform(a, lambda v, i: F.when(i < F.call_function("shiftleft", F.lit(1), j), v).otherwise(combine(F.get(a, i - F.call_function("shiftleft", F.lit(1), j)), v)))

        rounds = F.sequence(F.lit(0), F.floor(F.log2((F.size(whole) - 1).cast("double"))).cast("int"))
        return F.when(F.size(whole) < 2, whole).otherwise(F.aggregate(rounds, whole, step))

    return let(values, scan)


def located(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, value>> of the pattern's leftmost matches, in code points, end exclusive.

    Splitting at the matches gives the lengths between them. group names a part that stands at the match's end.
    """

    def spans(between: Column, whole: Column, parts: Column) -> Column:
        ends = running(F.transform(whole, lambda m, i: F.length(F.get(between, i)) + F.length(m)), lambda a, b: a + b)

        def span(end: Column, i: Column) -> Column:
            value = F.get(parts, i)
            return F.struct((end - F.length(value)).alias("start"), end.alias("end"), value.alias("value"))

        return F.transform(ends, span)

    def all_of(n: int) -> Column:
        return F.regexp_extract_all(text, F.lit(pattern), F.lit(n))

    inner = lambda between, whole: spans(between, whole, whole) if not group else let(all_of(group), lambda parts: spans(between, whole, parts))
    return let(F.split(text, pattern, -1), lambda between: let(all_of(0), lambda whole: inner(between, whole)))


NO_SPANS = "cast(array() as array<struct<start:int,end:int,value:string>>)"


def pieces(text: Column) -> Column:
    """The text cut into runs of PIECE code points."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))


def cut(parts: Column, start: Column, end: Column) -> Column:
    """Code points start .. end of the text that ``parts`` are the pieces of; its cost is that of what it takes."""

    def take(at: Column) -> Column:
        first = F.floor(at / PIECE).cast("int")
        count = F.greatest(F.lit(0), F.ceil(end / PIECE).cast("int") - first)
        return F.substring(F.array_join(F.slice(parts, first + 1, count), ""), at - PIECE * first + 1, F.greatest(F.lit(0), end - at))

    return let(F.greatest(F.lit(0), start), take)


def seen(items: Column, key, marks: Column) -> Column:
    """For each item the largest ``w`` of the marks (struct<at, w long>) with at <= key(item); null where there is none."""

    def answer(found: Column) -> Column:
        carried = running(F.transform(found, lambda u: u["w"]), F.greatest)
        # items[i] is where its number i says
        hits = let(carried, lambda c: F.array_sort(F.filter(F.transform(found, lambda u, j: F.struct(u["i"].alias("i"), F.get(c, j).alias("w"))), lambda u: u["i"] >= 0)))
        return F.transform(hits, lambda u: u["w"])

    as_marks = F.transform(marks, lambda m: F.struct(m["at"].cast("long").alias("at"), F.lit(0).alias("o"), F.lit(-1).alias("i"), m["w"].alias("w")))
    as_items = F.transform(items, lambda x, i: F.struct(key(x).cast("long").alias("at"), F.lit(1).alias("o"), i.alias("i"), F.lit(None).cast("long").alias("w")))
    none = F.transform(items, lambda x: F.lit(None).cast("long"))
    return F.when((F.size(items) == 0) | (F.size(marks) == 0), none).otherwise(let(F.array_sort(F.concat(as_marks, as_items)), answer))


def where_seen(items: Column, key, marks: Column, keep) -> Column:
    """The items for which keep(item, seen w or null) holds."""
    return let(seen(items, key, marks), lambda ws: F.filter(items, lambda x, i: keep(x, F.get(ws, i))))


def union(spans: Column) -> Column:
    """array<struct<start, end>> with spans that overlap made one, in order."""

    def over(s: Column, reach: Column) -> Column:
        starts = F.filter(s, lambda x, i: (i == 0) | (x["start"] >= F.get(reach, i - 1)))
        last = F.filter(F.transform(s, lambda x, i: F.struct(F.get(reach, i).alias("end"), F.coalesce(F.get(s, i + 1)["start"] >= F.get(reach, i), F.lit(True)).alias("stop"))), lambda x: x["stop"])
        return let(last, lambda ends: F.transform(starts, lambda x, i: F.struct(x["start"].alias("start"), F.get(ends, i)["end"].alias("end"))))

    return let(F.array_sort(spans), lambda s: let(running(F.transform(s, lambda x: x["end"]), F.greatest), lambda reach: over(s, reach)))


def total(terms: list[Column]) -> Column:
    out = F.lit(0.0)
    for t in terms:
        out = out + t
    return out
