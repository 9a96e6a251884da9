"""The minimum covariance determinant against all subsets, and groups that are small or alike."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelogic.llm import quality
from tracelogic.llm.common import Scratch

FLOORS = np.diag(np.array(list(quality.PARTS.values())) ** 2)


def scatter(x):
    return x.mean(axis=0), np.cov(x.T, bias=True) + FLOORS


def least_determinant(x, core):
    """Of all subsets with the core share of rows, the one whose scatter has the smallest determinant."""
    h = int(np.ceil(core * len(x)))
    return min((float(np.linalg.slogdet(scatter(x[list(c)])[1])[1]), c) for c in itertools.combinations(range(len(x)), h))


def test_estimates_are_of_the_smallest_determinant(spark):
    r = np.random.default_rng(3)
    groups, rows = {}, []
    for g in range(6):
        mix = r.normal(0, 0.4, (6, 6))
        x = r.normal(0, 1, (12, 6)) @ mix + r.normal(0, 2, 6)
        x[9:] += r.choice([-1, 1], (3, 1)) * r.uniform(4, 9, (3, 6))  # three of twelve are elsewhere
        groups[g] = x
        rows += [(g, *map(float, v)) for v in x]
    table = spark.createDataFrame(rows, "g int, " + ", ".join(f"{c} double" for c in quality.PARTS))
    got = {x["g"]: x for x in quality.estimate(table, 0.75, Scratch(spark)).collect()}
    for g, x in groups.items():
        logdet, chosen = least_determinant(x, 0.75)
        mean, cov = scatter(x[list(chosen)])
        factor = np.zeros((6, 6))
        factor[np.tril_indices(6)] = got[g]["l"]
        assert abs(got[g]["logdet"] - logdet) < 1e-6 and np.allclose(got[g]["m"], mean) and np.allclose(factor @ factor.T, cov)


def test_distances(spark):
    r = np.random.default_rng(5)
    x = r.normal(0, 1, (40, 6))
    mean, cov = scatter(x)
    factor = np.linalg.cholesky(cov)
    table = spark.createDataFrame([(1, *map(float, v)) for v in x], "g int, " + ", ".join(f"{c} double" for c in quality.PARTS))
    found = spark.createDataFrame([(1, mean.tolist(), factor[np.tril_indices(6)].tolist())], "g int, m array<double>, l array<double>")
    got = [x["d2"] for x in quality.measured(table, found, ["g"]).collect()]
    assert np.allclose(sorted(got), sorted(((x - mean) @ np.linalg.inv(cov) * (x - mean)).sum(axis=1)))


@pytest.mark.parametrize("window", [1, 2, 3, 7, 8, 11])
def test_repeated_words(spark, window):
    r = random.Random(window)
    texts = ["", "a", "a a a", *[" ".join(r.choice("abc") + r.choice(["", "x"]) for _ in range(r.randint(1, 60))) for _ in range(30)], "p q " * 40]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {x["i"]: x["n"] for x in rows.select("i", quality.repeated_words(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)), window).alias("n")).collect()}
    for i, t in enumerate(texts):
        w = t.split()
        at: dict = {}
        for k in range(len(w) - window + 1):
            at.setdefault(tuple(w[k : k + window]), []).append(k)
        assert got[i] == len({k + j for places in at.values() if len(places) > 1 for k in places for j in range(window)}), t


def test_chi_square():
    # tabled quantiles
    assert quality.chi_square(6, 0.5) == pytest.approx(5.348, rel=0.01) and quality.chi_square(6, 0.99) == pytest.approx(16.81, rel=0.01) and quality.chi_square(6, 0.999) == pytest.approx(22.46, rel=0.01)


def prose(r, n):
    return " ".join(r.choice(["plain", "words", "of", "every", "day", "and", "more"]) + r.choice(["", "", "s", "ly"]) for _ in range(n))


def test_small_groups_are_estimated_together(spark):
    r = random.Random(6)
    rows = []
    for i in range(700):
        lang, source = ("en", "big") if i < 260 else ("en", f"s{i % 20}") if i < 560 else ("fr", None) if i < 600 else (None, f"t{i % 40}")
        rows.append((i, prose(r, r.randint(40, 90)), lang, source))
    bad = [(1000 + i, " ".join(r.choice(["$$$", "###", "A*B"]) + str(r.randint(0, 9)) for _ in range(60)), lang, source) for i, (lang, source) in enumerate([("en", "big"), ("en", "s3"), ("fr", None), (None, "t5"), ("xx", "alone")])]
    docs = spark.createDataFrame([*rows, *bad], "doc_id long, text string, lang string, source string").withColumn("g", F.lit(1)).withColumn("m", F.lit(2))
    got = {x["doc_id"]: x for x in quality.judge(docs).collect()}
    assert len(got) == 705 and not any(x["base_failed"] for x in got.values())
    assert not any(got[1000 + i]["kept"] for i in range(5)) and sum(got[i]["kept"] for i in range(700)) >= 695


def test_rows_that_are_alike(spark):
    r = random.Random(1)
    text = prose(r, 50)
    rows = [(i, text, "en", "a") for i in range(230)] + [(500, text + " $$$ ### *** $$$ ### *** |||| &&&& %%%% " * 3, "en", "a"), (501, None, "en", "a"), (None, text, "en", "a")]
    got = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert [x["kept"] for x in got if x["doc_id"] in (500, 501)] == [False, False] and all(x["kept"] for x in got if x["doc_id"] not in (500, 501))
