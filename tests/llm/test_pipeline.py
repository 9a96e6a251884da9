"""The pipeline against plain Python, given the fitted classifier and forest."""

import math
import random
import re

import numpy as np
import pyarrow as pa

import corpus_pipeline
from tests.llm.test_operators import SCHEMA
from tests.llm.test_spans import plain
from tracelogic.llm import mixing, secrets, toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def rows():
    """Copies and near copies, toxic texts, benchmark passages, secrets; null, repeated and clashing ids; empty texts."""
    r = random.Random(12)
    words = ["river", "stone", "Walks", "green", "paper", "music", "table", "house", "über", "letter", "of", "the"]
    some = lambda n: [r.choice(words) + str(r.randint(0, 300)) for _ in range(n)]
    bench = [" ".join(some(16)), " ".join(some(5))]
    out = []
    for i in range(150):
        w = some(r.randint(6, 60))
        if i % 5 == 0:
            w[r.randrange(len(w))] = r.choice(["idiot", "moron", "scum"])
        if i % 17 == 3:
            w += bench[i % 2].upper().split() + some(3)
        if i % 13 == 2:
            w += ["token", "=", '"' + "".join(r.choice("0123456789abcdef") for _ in range(40)) + '"', *some(2)]
        out.append((i, " ".join(w), "en", f"s{i % 3}" if i % 7 else None, None if i % 11 == 0 else len(w)))
    for i in range(40):
        w = out[2 * i + 1][1].split()
        if i % 2 and len(w) > 20:
            w[i % len(w)] = "changed"
        out.append((200 + i, " ".join(w), "de", "s1", 7))
    twin = " ".join(some(30))
    out += [(None, None, None, None, None), (None, "", "en", "s0", 0), (None, "", "en", "s0", 0), (300, "  ", "en", "s2", 2), (None, twin, "en", "s0", 1), (None, " ".join(some(30)), "en", "s0", 1), (None, " ".join(some(12)) + " " + bench[0], "en", "s0", 1)]
    out += [(301, " ".join(some(25)), "en", "s1", 1), (301, " ".join(some(25)), "fr", "s2", 2), (302, " ".join(some(25)), "en", "s1", 1)]
    return [*out, out[-1], (5, twin, "en", "s0", 1)], bench


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def without_toxic(docs, model):
    weight = dict(zip(model.keys.tolist(), model.weights.tolist(), strict=True))
    out = []
    for d in docs:
        found = {int(h) for w in set(re.findall(rb"[a-z\x80-\xff]+", lower(d[1]).encode())) for h in toxicity.features(np.frombuffer(w, np.uint8), np.array([0, len(w)]))[1]}
        if 1 / (1 + math.exp(-max(-30, min(30, model.bias + sum(weight.get(h, 0.0) for h in found))))) < 0.7:
            out.append(d)
    return out


def groups(docs):
    """Components of documents by shared shingles, as lists of positions; texts without words are alone."""
    sets = []
    for d in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", lower(d[1]))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                root[find(i)] = find(j)
    out: dict = {}
    for i in range(len(docs)):
        out.setdefault(find(i), []).append(i)
    return list(out.values()), sets


def without_benchmark(docs, bench):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = set()
    for t in bench:
        v = split(t)
        k = min(10, len(v))
        windows |= {tuple(v[j : j + k]) for j in range(len(v) - k + 1)}
    return [d for d in docs if not any(tuple(w[j : j + k]) in windows for w in [split(d[1])] for k in {len(x) for x in windows} for j in range(len(w) - k + 1))]


def masked(docs, forest):
    out = []
    for d in docs:
        spans, clean = plain(d[1] or "", forest)
        out.append((d[0], clean, *d[2:4], len(clean)) if spans else d)
    return out


def test_every_stage_against_plain_python(spark, tmp_path):
    docs, bench = rows()
    labels = [(d[0], 1, int(bool(re.search("idiot|moron|scum", d[1] or "")))) for d in docs if d[0] is not None and d[0] < 150]
    spark.createDataFrame(docs, SCHEMA).withColumnRenamed("doc_id", "doc_id").selectExpr("*", "'x' as key", "1 as score", "2 as size", "3L as text_hash").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(bench)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    held = spark.read.parquet(f"{tmp_path}/documents.parquet")
    order = lambda xs: sorted((tuple(x) for x in xs), key=str)
    stages = dict(corpus_pipeline.STAGES)

    def step(name, frame):
        got = stages[name](spark, frame, str(tmp_path))
        assert name == "mixing" or tuple(got.columns) == COLUMNS
        path = f"{tmp_path}/{name}.parquet"
        got.write.parquet(path)
        got = spark.read.parquet(path)
        return got, order(got.collect())

    held, got = step("toxicity", held)
    want = without_toxic(docs, toxicity.fit(spark.createDataFrame(docs, SCHEMA), spark.read.parquet(f"{tmp_path}/labels.parquet")))
    assert got == order(want) and len(docs) - 40 <= len(want) < len(docs) - 10
    held, got = step("minhash", held)
    parts, sets = groups(want)
    assert len(got) == sum(len(p) if not sets[p[0]] else 1 for p in parts)
    for p in parts:
        mine = [want[i] for i in p]
        if not sets[p[0]]:
            assert all(x in got for x in mine)
            continue
        ids = [x[0] for x in mine if x[0] is not None]
        kept = [x for x in got if x in mine]
        assert len(kept) == 1 and kept[0][0] == (min(ids) if ids else None)
    want = without_benchmark(got, bench)
    held, after = step("decontamination", held)
    assert after == order(want) and len(got) - 20 < len(after) < len(got) - 3
    held, got = step("secrets", held)
    assert got == order(masked(after, secrets.train(spark))) and sum("[SECRET]" in (x[1] or "") for x in got) >= 4
    _, mix = step("mixing", held)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    whole: dict = {}
    for x in got:
        whole[x[3]] = whole.get(x[3], 0) + size(x[1])
    target = mixing.targets(list(whole.items()))
    taken: dict = {}
    for *doc, n, of, aim, words in mix:
        assert tuple(doc) in got and n == size(doc[1]) and of == whole[doc[3]] and aim == target[doc[3]] and 0 < words <= 2 * n and words % n == 0
        taken[doc[3]] = taken.get(doc[3], 0) + words
    assert all(abs(taken.get(s, 0) - target[s]) <= 1 for s in whole)
    ran = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert order(ran) == mix


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_saved_tables_go_through_small_batches(spark):
    """A worker that makes a saved table holds at most BATCH_ROWS rows at a time; the session's setting stays."""
    from tracelogic.llm import common

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    got = [r["n"] for r in common.Scratch(spark).save(spark.range(0, 5500, 1, 1).mapInArrow(sizes, "n long")).collect()]
    assert sum(got) == 5500 and max(got) == common.BATCH_ROWS
    assert spark.conf.get(name) == before
