"""The counterfactual penalty changes scores, and scores equal a plain version's."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracelogic.llm import toxicity

PLAIN = ["river", "stone", "walks", "green", "paper", "music", "table", "house", "winter", "letter"]
BAD = ["idiot", "moron", "scum"]


def corpus(seed=9, n=900):
    """Toxic texts insult one group only, so its name alone goes with the label."""
    r, texts, labels = random.Random(seed), [], []
    for _ in range(n):
        bad = r.random() < 0.35
        w = [r.choice(PLAIN) for _ in range(20)]
        if bad and r.random() < 0.7:
            w[r.randrange(10)] = r.choice(BAD)
        if r.random() < (0.9 if bad else 0.03):
            w[12] = "muslims"
        elif r.random() < 0.2:
            w[12] = r.choice(["christians", "jews", "hindus"])
        texts.append(" ".join(w[:10]) + ". " + " ".join(w[10:]))
        labels.append(int(bad))
    return texts, labels


def frames(spark, more):
    texts, labels = corpus()
    docs = spark.createDataFrame(list(enumerate([*texts, *more])), "doc_id long, text string")
    return docs, spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int"), texts


NEUTRAL = ["Muslims walk along the green river", "Christians walk along the green river", "jews read a letter", "muslims read a letter"]


def test_penalty_takes_the_name_out_of_the_score(spark):
    docs, truth, texts = frames(spark, [*NEUTRAL, "muslims are scum", "hindus are scum"])
    got = {}
    for penalty in (0.0, 1.0):
        got[penalty] = {x["doc_id"] - len(texts): x["score"] for x in toxicity.score(docs, truth, swap_penalty=penalty).where(F.col("doc_id") >= len(texts)).collect()}
    gap = {p: max(abs(s[0] - s[1]), abs(s[2] - s[3])) for p, s in got.items()}
    assert gap[0.0] > 0.5 and gap[1.0] < 0.15
    assert got[0.0][0] >= 0.7 > got[1.0][0]  # a neutral mention that is rejected without the penalty
    assert got[1.0][4] >= 0.7 and got[1.0][5] >= 0.7


def test_swaps():
    got = toxicity.swaps("Women won. The women and men left! women's day\nnothing here", ("women men girls", "gay straight"))
    assert ("the women and men left".strip(), "the girls and men left") in [(a.strip(), b.strip()) for a, b in got]
    assert ("women's day", "men's day") in [(a.strip(), b.strip()) for a, b in got] and len(got) == 2 + 4 + 2
    assert toxicity.swaps("mention of omen", ("women men",)) == []


def test_scores_are_those_of_the_model(spark):
    more = ["", None, "?!", "IDIOT idiot Idioten", "größe " * 50, "moron" * 3, " ".join(PLAIN * 2000)]
    docs, truth, texts = frames(spark, more)
    model = toxicity.fit(docs, truth)
    weight = dict(zip(model.keys.tolist(), model.weights.tolist(), strict=True))
    got = {x["doc_id"]: x for x in toxicity.score(docs, truth).collect()}
    for i, t in enumerate([*texts, *more]):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "").encode()
        found = {int(h) for w in set(re.findall(rb"[a-z\x80-\xff]+", low)) for h in toxicity.features(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[1]}
        z = model.bias + sum(weight.get(h, 0.0) for h in found)
        assert abs(got[i]["score"] - 1 / (1 + math.exp(-max(-30, min(30, z))))) < 1e-9 and got[i]["predicted"] == int(got[i]["score"] >= 0.7)


@pytest.mark.parametrize("label", [0, 1])
def test_one_class_and_ties_of_the_sample(spark, label):
    docs, truth, texts = frames(spark, [])
    one = toxicity.score(docs, truth.withColumn("toxic", F.lit(label))).agg(F.min("score"), F.max("score")).first()
    assert one[0] == one[1] and (one[0] > 0.9) == bool(label)
    # rows that repeat a doc_id don't make the sample depend on their order
    twice = docs.unionByName(docs)
    a, b = (sorted(x["score"] for x in toxicity.score(d, truth.unionByName(truth), sample=200).collect()) for d in (twice, twice.repartition(5)))
    assert np.allclose(a, b, atol=1e-6)
