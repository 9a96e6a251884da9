"""Chunk dedup against a plain version: ends by scanning, runs compared as bytes."""

import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from tracelogic.llm import chunk_dedup
from tracelogic.llm.chunk_dedup import GEAR, WINDOW, remove_chunks
from tracelogic.llm.common import mix

REACH, LEAST = 24, 128


def ends(raw: bytes) -> list[int]:
    value = []
    for i in range(len(raw)):
        h = 0
        for b in raw[max(0, i - WINDOW + 1) : i + 1]:
            h = (2 * h + int(GEAR[b])) & ((1 << WINDOW) - 1)
        value.append(int(mix(np.array([h + 1], np.uint64))[0]))
    out: list[int] = []
    for i, v in enumerate(value):
        e = i + 1
        if e >= WINDOW + REACH and len(raw) - e >= REACH and v <= min(value[max(0, i - REACH) : i], default=v) and v <= min(value[i + 1 : i + 1 + REACH], default=v):
            if out and e - out[-1] < REACH:
                continue
            out.append(e)
    return out + ([len(raw)] if raw else [])


def brute(docs: list[tuple]) -> dict[int, tuple]:
    """doc number to (chunks, removed bytes, removed chunks, hash of the rest)."""
    found: dict[bytes, list[tuple]] = {}
    for n, (ident, text) in enumerate(docs):
        raw = (text or "").encode()
        pos = [0, *ends(raw)]
        take = []
        for i in range(len(pos) - 1):
            j = next((j for j in range(i, len(pos)) if pos[j] - pos[i] >= LEAST), None)
            if j is not None:
                take.append((pos[i], pos[j]))
        if raw and not take:
            take = [(0, len(raw))]
        elif raw and take[-1][1] < len(raw):
            take.append((take[-1][0], len(raw)))
        for s, e in take:
            found.setdefault(raw[s:e], []).append(((ident is None, ident or 0, s), n, s, e))
    gone: dict[int, set] = {}
    for places in found.values():
        first = min(p[0] for p in places)
        for p, n, s, e in places:
            if p != first:
                gone.setdefault(n, set()).update(range(s, e))
    out = {}
    for n, (_, text) in enumerate(docs):
        raw, g, last, chunks = (text or "").encode(), gone.get(n, set()), 0, 0
        own = ends(raw)
        for e in own:
            chunks += last in g
            assert len({i in g for i in range(last, e)}) == 1  # whole chunks go
            last = e
        out[n] = (len(raw), len(own), len(g), chunks, hashlib.sha256(bytes(b for i, b in enumerate(raw) if i not in g)).hexdigest())
    return out


def fixture():
    r = random.Random(5)
    words = ["über", "the", "of", "river", "étude", "ñandú", "stone", "walks", "a", "日本語"]
    some = lambda n: " ".join(r.choice(words) + r.choice("abcdefgh") * r.randint(0, 2) for _ in range(n))
    shared, other = some(55), some(70)
    texts = [None, "", "short", "short", some(90), some(30) + shared + some(40), other, some(10) + " " + shared, shared, "x" + other, "of " * 200, some(20) + "of " * 150, "aaaa" * 300, some(300), other[:200], some(5)]
    docs = [(100 - i if i % 5 else i, t) for i, t in enumerate(texts)]
    return [*docs, (None, shared + some(12)), (None, other), (docs[6][0], shared)]


def test_chunk_dedup_is_what_it_says(spark):
    docs = fixture()
    want = brute(docs)
    rows = spark.createDataFrame([(i, t, n) for n, (i, t) in enumerate(docs)], "doc_id long, text string, start long")
    got = sorted(map(tuple, remove_chunks(rows).select("doc_id", "n_bytes", "n_chunks", "n_removed", "n_removed_chunks", "kept_sha256").collect()), key=str)
    assert got == sorted(((docs[n][0], *x) for n, x in want.items()), key=str)
    assert sum(x[2] for x in want.values()) > 1500


def test_chunk_dedup_in_small_parts(spark, monkeypatch):
    rows = spark.createDataFrame([(i, t) for i, t in fixture()], "doc_id long, text string")
    cols = ("doc_id", "n_removed", "kept_sha256")
    one = sorted(map(tuple, remove_chunks(rows).select(*cols).collect()), key=str)
    assert one == sorted(map(tuple, remove_chunks(rows.repartition(5), partition_bytes=300).select(*cols).collect()), key=str)


def test_chunk_dedup_flushes(monkeypatch):
    """Answers don't depend on when a task sends what it holds."""
    r = np.random.default_rng(2)
    x = np.zeros(3000, chunk_dedup.RUN)
    x["d1"], x["d2"], x["doc"], x["start"] = r.integers(0, 400, 3000), r.integers(0, 2, 3000), r.integers(0, 50, 3000), r.integers(0, 99, 3000)
    x["end"] = x["start"] + 5
    whole = chunk_dedup.firsts(x)[1]
    left, gone = zip(*[chunk_dedup.firsts(p) for p in np.array_split(x, 7)], strict=True)
    parts = np.concatenate([*gone, chunk_dedup.firsts(np.concatenate(left))[1]])
    assert set(whole.tolist()) == set(parts.tolist())


def test_chunk_dedup_of_repeated_and_null_ids(spark):
    r = random.Random(2)
    body = "".join(r.choice("abcdefgh ") for _ in range(900))
    rows = [(1, body), (1, body), (1, "z" + body), (None, body), (None, None), (2, body)]
    got = remove_chunks(spark.createDataFrame(rows, "doc_id long, text string").withColumn("removed", F.lit(1)).withColumn("copy", F.lit(2))).collect()
    by = {(x["doc_id"], x["n_bytes"]): x["n_removed"] for x in got}
    n = len(body)
    # equal rows are one document; one of the two texts of id 1 is kept whole
    assert len(got) == 6 and by[None, 0] == 0 and by[None, n] == by[2, n] == n
    assert sorted((by[1, n] == 0, by[1, n + 1] == 0)) == [False, True]
    assert remove_chunks(spark.createDataFrame(rows, "doc_id long, text string").limit(0)).count() == 0


def test_chunks_resist_insertions_and_leave_short_overlaps(spark):
    r = random.Random(9)
    some = lambda n: "".join(r.choice("abcdefghijklmnop ") for _ in range(n))
    passages = [some(280) for _ in range(60)]
    texts = [some(300) + p + some(300) for p in passages] + [some(411) + p + some(100) for p in passages]
    clean = [some(300) + p[:90] + some(300) for p in passages]
    got = {x["doc_id"]: x["n_removed"] for x in remove_chunks(spark.createDataFrame(list(enumerate(texts + clean)), "doc_id long, text string")).collect()}
    assert sum(got[i] > 0 for i in range(60, 120)) >= 58 and all(got[i] == 0 for i in [*range(60), *range(120, 180)])
