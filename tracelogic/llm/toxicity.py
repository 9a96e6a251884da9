"""Toxicity scores from a counterfactual-regularised linear classifier.

Features are the presence of words and of word beginnings (4, 5 and 6 bytes), as hashes. A logistic regression is
fitted on a bounded sample of labelled rows. In each sentence of that sample that names a group of people, the name is
swapped for each other of its kind, the sentence is scored again, and the squared change of the score is added to the
loss; so a sentence's score comes from what it says and not from whom it names. Sentences are split at . ! ? and line
ends, so a text gives one pair for each sentence, name and replacement.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, Scratch, byte_chunks, prefix_hashes, span_hashes, words

#: Interchangeable names of groups.
IDENTITY = (
    "women men girls boys transgender nonbinary",
    "gay lesbian bisexual straight heterosexual homosexual queer",
    "muslim christian jewish hindu buddhist atheist catholic",
    "muslims christians jews hindus buddhists atheists catholics",
    "black white asian african european american hispanic latino arab indian chinese",
    "immigrants refugees foreigners natives",
    "elderly young old disabled deaf blind",
    "frauen männer mädchen jungen",
    "muslime christen juden hindus atheisten",
    "femmes hommes filles garçons",
    "musulmans chrétiens juifs hindous athées",
    "mujeres hombres niñas niños",
    "musulmanes cristianos judíos hindúes ateos",
)
#: Letters and bytes of characters beyond ASCII.
LETTER = np.zeros(256, bool)
LETTER[97:123] = LETTER[128:] = True
BEGINNINGS = (4, 5, 6)
NAME = re.compile(r"[^\W\d_]+")


def features(low: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature hash) of each word and beginning, with repeats."""
    s, e, row = words(low, offsets, LETTER)
    if not len(s):
        return row, np.zeros(0, np.uint64)
    h = prefix_hashes(low)
    rows, out = [row], [span_hashes(h, s, e)]
    for k in BEGINNINGS:
        long = e - s >= k
        rows.append(row[long])
        out.append(span_hashes(h, s[long], s[long] + k) ^ np.uint64(k))
    return np.concatenate(rows), np.concatenate(out)


def word_features(word: str) -> np.ndarray:
    raw = LOWER[np.frombuffer(word.encode(), np.uint8)]
    return features(raw, np.array([0, len(raw)]))[1]


@dataclass
class Model:
    keys: np.ndarray  # sorted feature hashes
    weights: np.ndarray
    bias: float

    def score(self, column: pa.Array) -> np.ndarray:
        out = []
        for _, offsets, data in byte_chunks(column):
            n = len(offsets) - 1
            row, f = features(LOWER[data], offsets)
            z = np.full(n, self.bias)
            if len(self.keys) and len(f):
                at = np.searchsorted(self.keys, f)
                at[at == len(self.keys)] = 0
                hit = self.keys[at] == f
                once = np.unique(row[hit] * len(self.keys) + at[hit])
                z += np.bincount(once // len(self.keys), self.weights[once % len(self.keys)], n)
            out.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        return np.concatenate(out) if out else np.zeros(0)


SENTENCE = re.compile(r"[.!?\n]+")


def swaps(text: str, groups: tuple[str, ...]) -> list[tuple[str, str]]:
    """(sentence, the same with one name swapped) for each sentence, name in it and other name of its group."""
    others = {t: [x for x in g.split() if x != t] for g in groups for t in g.split()}
    out: list[tuple[str, str]] = []
    low = text.lower()
    if others.keys().isdisjoint(NAME.findall(low)):
        return out
    for sentence in SENTENCE.split(low):
        for name in sorted(others.keys() & set(NAME.findall(sentence))):
            out += [(sentence, re.sub(rf"(?<![^\W\d_]){re.escape(name)}(?![^\W\d_])", other, sentence)) for other in others[name]]
    return out


def sentence_features(sentence: str) -> np.ndarray:
    raw = LOWER[np.frombuffer(sentence.encode("utf-8", "surrogatepass"), np.uint8)]
    return np.unique(features(raw, np.array([0, len(raw)]))[1])


def identity_features(groups: tuple[str, ...]) -> list[int]:
    return sorted({int(x) for g in groups for t in g.split() for x in word_features(t).view(np.int64)})


def constant(positive: int, total: int) -> Model:
    """The model of a sample with one class only."""
    rate = (positive + 0.5) / (total + 1)
    return Model(np.zeros(0, np.uint64), np.zeros(0), float(np.log(rate / (1 - rate))) if total else -5.0)


def train(y: np.ndarray, row: np.ndarray, code: np.ndarray, keys: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], swap_penalty: float = 1.0, l2: float = 1e-4, steps: int = 250) -> Model:
    """Fit on labels y and the (row, code) pairs of features present; keys are the sorted feature hashes that codes index.

    pairs are the codes of a sentence and of its counterfactual. The penalty is the mean squared change of their logits,
    as many times as the classifier's own loss counts.
    """
    # what a swap adds and takes away, as (pair, code, sign)
    change = [(np.setdiff1d(b, a), np.setdiff1d(a, b)) for a, b in pairs]
    at = np.repeat(np.arange(len(pairs)), [len(p) + len(m) for p, m in change])
    moved = np.concatenate([np.concatenate(x) for x in change]).astype(np.int64) if pairs else np.zeros(0, np.int64)
    sign = np.concatenate([np.repeat([1.0, -1.0], [len(p), len(m)]) for p, m in change]) if pairs else np.zeros(0)
    # Adam on the whole sample
    w, bias = np.zeros(len(keys)), float(np.log(y.mean() / (1 - y.mean())))
    m, v = np.zeros(len(keys) + 1), np.zeros(len(keys) + 1)
    for t in range(1, steps + 1):
        z = np.bincount(row, w[code], len(y)) + bias
        r = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(y)
        grad = np.bincount(code, r[row], len(keys)) + l2 * w
        if len(pairs) and swap_penalty:
            delta = np.bincount(at, sign * w[moved], len(pairs))
            grad = grad + np.bincount(moved, 2 * swap_penalty / len(pairs) * sign * delta[at], len(keys))
        grad = np.append(grad, r.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return Model(keys, w, float(bias))


def held_out():
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000, n_features: int = 6000, groups: tuple[str, ...] = IDENTITY, n_swaps: int = 50_000, **params) -> Model:
    """Train on at most ``sample`` labelled documents, the first by a hash of doc_id; held-out ones never.

    Features are counted and chosen in Spark; the driver gets the chosen ones, their numbers in each document, and of
    the sample's sentence swaps the ``n_swaps`` first by a hash. ``groups`` are lists of interchangeable names.
    """
    scratch = Scratch(docs.sparkSession)
    ids = labels.where("toxic is not null and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # bounded, so it is sent to all executors
    rows = scratch.save(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").select("toxic", "text"))

    def present(batches):
        for b in batches:
            out: list[np.ndarray] = []
            for _, offsets, data in byte_chunks(b.column(1)):
                row, f = features(LOWER[data], offsets)
                f = f[np.argsort(row, kind="stable")]
                cut = np.searchsorted(np.sort(row), np.arange(len(offsets)))
                out += [np.unique(f[i:j]).view(np.int64) for i, j in zip(cut[:-1], cut[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int32()), pa.array(out, pa.list_(pa.int64()))], ["toxic", "f"])

    seen = scratch.save(rows.mapInArrow(present, "toxic int, f array<long>"))
    total, positive = seen.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not 0 < positive < total:
        return constant(positive, total)
    share = positive / total
    counts = seen.select("toxic", F.explode("f").alias("f")).groupBy("f").agg(F.sum("toxic").cast("double").alias("n1"), F.count("*").cast("double").alias("n"))
    # likelihood ratios; what may as well be chance (p > 0.001) is left out
    part = lambda n, q: F.when(n > 0, n * F.log(n / (F.col("n") * q))).otherwise(0.0)
    counts = counts.withColumn("gain", 2 * (part(F.col("n1"), share) + part(F.col("n") - F.col("n1"), 1 - share)))
    names = identity_features(groups)
    kept = counts.where((F.col("gain") >= 10.83) & ~F.col("f").isin(names)).orderBy(F.desc("gain"), "f").limit(n_features).select("f")
    chosen = [r["f"] for r in kept.unionByName(counts.where(F.col("f").isin(names)).select("f")).collect()]
    keys = np.sort(np.array(chosen, np.int64).view(np.uint64))
    held = docs.sparkSession.sparkContext.broadcast(keys)

    def codes_of(f: np.ndarray) -> np.ndarray:
        if not len(held.value):
            return np.zeros(0, np.int32)
        at = np.searchsorted(held.value, f)
        at[at == len(held.value)] = 0
        return at[held.value[at] == f].astype(np.int32)

    def swapped(batches):
        for b in batches:
            out = []
            for text in b.column(0).to_pylist():
                for pair in swaps(text or "", groups):
                    a, c = (codes_of(sentence_features(x)).tobytes() for x in pair)
                    out.append((a, c, hashlib.blake2b("\0".join(pair).encode("utf-8", "surrogatepass"), digest_size=8).digest()))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.binary()) for i in range(3)], ["a", "b", "h"])

    def coded(batches):
        for b in batches:
            out = []
            for x in b.column(1):
                out.append(codes_of(x.values.to_numpy().view(np.uint64)).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["toxic", "f"])

    got = seen.mapInArrow(coded, "toxic int, f binary").collect()
    codes = [np.frombuffer(r["f"], np.int32) for r in got]
    scratch.drop(seen)
    y = np.array([float(r["toxic"]) for r in got])
    pairs = rows.select("text").mapInArrow(swapped, "a binary, b binary, h binary").orderBy("h", "a", "b").limit(n_swaps).collect() if groups else []
    scratch.drop(rows)
    pairs = [(np.frombuffer(r["a"], np.int32), np.frombuffer(r["b"], np.int32)) for r in pairs]
    return train(y, np.repeat(np.arange(len(y)), [len(c) for c in codes]), np.concatenate(codes), keys, pairs, **params)


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample: int = 20_000, **params) -> DataFrame:
    """docs with held_out, score and predicted; existing columns of these names are replaced, others are kept.

    Null and empty texts get the score of a text without features. A null doc_id is not held out and not learnt from.
    Without labels, or with one class only, all scores are alike. Repeated rows get equal scores; empty tables give none.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(fit(docs, labels, sample, **params))
    base = docs.drop("held_out", "score", "predicted")
    kept = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(base.columns)]
    at = base.columns.index("text")

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.value.score(b.column(at)))], [*b.schema.names, "score"])

    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(base.schema))
    out = base.select(*kept).mapInArrow(run, f"{schema}, score double").select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(base.columns)], "score")
    return out.select(*base.columns, held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
