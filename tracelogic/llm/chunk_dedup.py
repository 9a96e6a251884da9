"""Substring dedup by content-defined chunks.

A gear hash rolls over the bytes: h = 2h + GEAR[byte]; its low 16 bits depend on the last 16 bytes only. A chunk ends
where the scrambled hash is smallest among the ``reach`` positions on either side, so an end depends on the bytes near
it and on no other end, and an insertion moves the ends near it and no others. Where equal values tie (periodic text),
ends nearer than ``reach`` to the one before are passed over.

Chunks of this size hold common wording, so they are compared in runs: from each end the fewest whole chunks that
together have ``least`` bytes. Runs are compared by a 128-bit digest; the first in order of (doc_id, start) is kept,
the others' chunks are removed. A removed chunk stands at an earlier place too, and the earliest is never removed.

Each task keeps the first place of each digest that it sees and answers the rest by itself, so a passage that very
many documents hold is exchanged once a task. What is exchanged are packed blobs, about 40 bytes a chunk.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_chunks, mix

WINDOW = 16
GEAR = np.random.default_rng(19937).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)
#: One run: digest, and its place (doc_id null or not, doc_id, text hash, start, end).
RUN = np.dtype([("d1", "<u8"), ("d2", "<u8"), ("null", "?"), ("doc", "<i8"), ("copy", "<i8"), ("start", "<u4"), ("end", "<u4")])
PLACE = ["null", "doc", "copy", "start"]
#: Runs that a task holds before it sends what is left of them.
HELD = 400_000


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash of the WINDOW bytes that end at each byte (fewer at the beginning), scrambled."""
    h = GEAR[data]
    j = 1
    while j < WINDOW:
        h = h.copy() if j > len(h) else np.concatenate((h[:j], h[j:] + (h[:-j] << np.uint32(j))))
        j *= 2
    return mix((h & np.uint32((1 << WINDOW) - 1)).astype(np.uint64) + np.uint64(1))


def least_ahead(v: np.ndarray, n: int) -> np.ndarray:
    """The smallest of v[i : i + n] at each i."""
    top, span = np.uint64(2**64 - 1), 1
    while span < n:
        move = min(span, n - span)
        v = np.minimum(v, np.concatenate((v[move:], np.full(min(move, len(v)), top))))
        span += move
    return v


def cuts(data: np.ndarray, offsets: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, row) of all chunk ends, each row's beginning and end among them, in order."""
    rows = len(offsets) - 1
    top, v = np.uint64(2**64 - 1), gear(data)
    ahead = least_ahead(v, reach)
    after = np.concatenate((ahead[1:], [top]))[: len(v)]
    before = np.concatenate((np.full(min(reach, len(v)), top), ahead[: max(0, len(v) - reach)]))
    at = np.flatnonzero((v <= before) & (v <= after)) + 1
    row = np.searchsorted(offsets, at - 1, "right") - 1
    # what decides on an end must lie in the row, as it must in any other row that has the bytes
    inside = (at - offsets[row] >= WINDOW + reach) & (offsets[row + 1] - at >= reach)
    at, row = at[inside], row[inside]
    near = np.flatnonzero((np.diff(at) < reach) & (np.diff(row) == 0)) + 1
    if len(near):  # ties: walk each chain of near ends
        keep, last, chain = np.ones(len(at), bool), 0, -2
        for i in near.tolist():
            if chain != i - 1:
                last = at[i - 1]
            chain = i
            if at[i] - last < reach:
                keep[i] = False
            else:
                last = at[i]
        at, row = at[keep], row[keep]
    every = np.arange(rows)
    full = offsets[1:] > offsets[:-1]
    pos = np.concatenate((offsets[:-1][full], at, offsets[1:][full]))
    own = np.concatenate((every[full], row, every[full]))
    order = np.lexsort((pos, own))
    return pos[order], own[order]


def runs(pos: np.ndarray, row: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the runs of each row. A row of fewer than ``least`` bytes is one run; the last run reaches the end."""
    if not len(pos):
        return pos, pos, row
    key = pos + row  # a row's end and the next one's beginning differ
    last = np.searchsorted(row, row, "right") - 1
    end = np.searchsorted(key, key + least)
    good = end <= last
    first = np.searchsorted(row, row, "left")
    short = (np.arange(len(pos)) == first) & ~good
    # the last start of each row also gets a run to the row's end
    tail = good & ~np.append(good[1:], False) & (end < last)
    s = np.concatenate((np.flatnonzero(good), np.flatnonzero(short | tail)))
    e = np.concatenate((end[good], last[short | tail]))
    return pos[s], pos[e], row[s]


def firsts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the runs x, the first of each digest, and those at later places."""
    order = np.argsort(x["d1"], kind="stable")
    d = x["d1"][order]
    same = d[1:] == d[:-1]
    shared = np.zeros(len(x), bool)
    shared[order[1:][same]] = shared[order[:-1][same]] = True
    y = x[shared]
    y = y[np.lexsort([y[c] for c in (*PLACE[::-1], "d2", "d1")])]
    new = np.ones(len(y), bool)
    new[1:] = (y["d1"][1:] != y["d1"][:-1]) | (y["d2"][1:] != y["d2"][:-1])
    head = y[np.maximum.accumulate(np.where(new, np.arange(len(y)), 0))] if len(y) else y
    # rows that repeat stand at one place and are not copies of each other
    later = np.zeros(len(y), bool)
    for c in PLACE:
        later |= y[c] != head[c]
    return np.concatenate((x[~shared], y[new])), y[later]


def joined(x: np.ndarray) -> np.ndarray:
    """Runs with those of one document that touch or overlap made one."""
    x = x[np.lexsort([x[c] for c in PLACE[::-1]])]
    if not len(x):
        return x
    # ends rise with starts within a document, but for repeated rows
    new = np.ones(len(x), bool)
    new[1:] = (x["null"][1:] != x["null"][:-1]) | (x["doc"][1:] != x["doc"][:-1]) | (x["copy"][1:] != x["copy"][:-1]) | (x["start"][1:] > x["end"][:-1])
    out = x[new].copy()
    out["end"] = np.maximum.reduceat(x["end"], np.flatnonzero(new))
    return out


def answers(x: np.ndarray) -> pa.RecordBatch:
    """One row for each document of the sorted runs x."""
    new = np.ones(len(x), bool)
    new[1:] = (x["null"][1:] != x["null"][:-1]) | (x["doc"][1:] != x["doc"][:-1]) | (x["copy"][1:] != x["copy"][:-1])
    at = np.flatnonzero(new)
    doc, first = pa.array(x["doc"], mask=x["null"]), pa.array(at)
    spans = pa.ListArray.from_arrays(pa.array(np.append(at, len(x)), pa.int32()), pa.array(x["start"].astype(np.int64) << 32 | x["end"]))
    return pa.RecordBatch.from_arrays([doc.take(first), pa.array(x["copy"][at]), spans], ["doc_id", "copy", "span"])


def removed_spans(docs: DataFrame, reach: int, least: int, partition_bytes: int) -> DataFrame:
    """(doc_id, copy, spans): start << 32 | end of what goes, in pieces; copy tells texts of one doc_id apart."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # a task solves its parts one by one, so its memory stays the same where tasks stop growing in number
    tasks = int(min(20_000, max(1, -(-total // partition_bytes))))
    parts = max(1, -(-4 * total // partition_bytes))

    def local(batches):
        held: list[np.ndarray] = []
        n = 0

        def flush():
            left, gone = firsts(np.concatenate(held))
            held.clear()
            to = left["d1"] % np.uint64(parts)
            left = left[np.argsort(to, kind="stable")]
            to = np.sort(to)
            at = np.flatnonzero(np.diff(to.astype(np.int64), prepend=-1))
            blobs = [b.tobytes() for b in np.split(left, at[1:])] if len(left) else []
            pids = to[at].astype(np.int64).tolist()
            gone = joined(gone)
            for i in range(0, len(gone), 10_000):  # answered already; these only pass by
                blobs.append(gone[i : i + 10_000].tobytes())
                pids.append(-1 - int(gone[i]["d1"] % np.uint64(parts)))
            return pa.RecordBatch.from_arrays([pa.array(pids, pa.int64()), pa.array(blobs, pa.binary())], ["pid", "blob"])

        for b in batches:
            null = b.column(0).is_null().to_numpy(zero_copy_only=False)
            ids, copies = b.column(0).fill_null(0).to_numpy(), b.column(1).to_numpy()
            for row0, offsets, data in byte_chunks(b.column(2)):
                s, e, row = runs(*cuts(data, offsets, reach), least)
                raw = data.tobytes()
                x = np.empty(len(s), RUN)
                d = np.frombuffer(b"".join([hashlib.blake2b(raw[i:j], digest_size=16).digest() for i, j in zip(s.tolist(), e.tolist(), strict=True)]), "<u8").reshape(-1, 2)
                x["d1"], x["d2"], x["null"], x["doc"], x["copy"] = d[:, 0], d[:, 1], null[row0 + row], ids[row0 + row], copies[row0 + row]
                x["start"], x["end"] = s - offsets[row], e - offsets[row]
                held.append(x)
                n += len(x)
                if n >= HELD:
                    yield flush()
                    n = 0
        if held:
            yield flush()

    def decide(batches):
        pid, blobs, done = None, [], []

        def solve():
            done.append(firsts(np.concatenate(blobs))[1])
            blobs.clear()

        def full(limit: int) -> bool:
            return bool(done) and sum(map(len, done)) > limit

        def said():
            out = joined(np.concatenate(done))
            done.clear()
            return answers(out)

        for b in batches:
            for p, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(blob, RUN)
                if p < 0:
                    done.append(x)
                elif p != pid and blobs:
                    solve()
                if p >= 0:
                    pid = p
                    blobs.append(x)
                if full(HELD):
                    yield said()
        if blobs:
            solve()
        if full(0):
            yield said()

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("copy"), "text").where(F.octet_length("text") > 0)
    packed = source.mapInArrow(local, "pid long, blob binary").repartition(tasks, "pid").sortWithinPartitions("pid")
    return packed.mapInArrow(decide, "doc_id long, copy long, span array<long>").groupBy("doc_id", "copy").agg(F.flatten(F.collect_list("span")).alias("spans"))


def remove_chunks(docs: DataFrame, reach: int = 24, least: int = 128, partition_bytes: int = 32 << 20) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_chunks, n_removed (bytes), n_removed_chunks, kept_sha256, removed (array of start, size).

    Null and empty texts have no chunks. Order is by doc_id (null last), then text hash, then start; rows that repeat
    both doc_id and text count once and are answered alike. A text of fewer than ``least`` bytes goes only if another
    text is equal to it. Extra columns are ignored; empty tables give none. Chunk ends of what is kept are those of
    the whole text.
    """
    gone = removed_spans(docs, reach, least, partition_bytes).select(F.col("doc_id").alias("_id"), F.col("copy").alias("_copy"), "spans")
    rows = docs.select("doc_id", F.xxhash64("text").alias("_text_hash"), F.coalesce("text", F.lit("")).alias("text"))
    both = rows.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")) & (F.col("_text_hash") == F.col("_copy")), "left").select("doc_id", "text", "spans")

    def strip(batches):
        for b in batches:
            ends: list[np.ndarray] = []
            for _, offsets, data in byte_chunks(b.column(1)):
                pos, row = cuts(data, offsets, reach)
                at = np.searchsorted(row, np.arange(len(offsets)))
                ends += [pos[i:j][1:] - offsets[r] for r, (i, j) in enumerate(zip(at[:-1], at[1:], strict=True))]
            out = []
            for ident, text, own, spans in zip(b.column(0).to_pylist(), b.column(1), ends, b.column(2).to_pylist(), strict=True):
                raw, sha, at, chunks, list_ = text.as_buffer().to_pybytes(), hashlib.sha256(), 0, 0, []
                for s, e in union_of(spans):
                    sha.update(raw[at:s])
                    at = e
                    chunks += int(np.searchsorted(own, e, "right") - np.searchsorted(own, s, "right"))
                    list_.append({"start": s, "size": e - s})
                sha.update(raw[at:])
                out.append((ident, len(raw), len(own), sum(x["size"] for x in list_), chunks, sha.hexdigest(), list_))
            kinds = (b.column(0).type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("size", pa.int64())])))
            names = ("doc_id", "n_bytes", "n_chunks", "n_removed", "n_removed_chunks", "kept_sha256", "removed")
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in out], t) for j, t in enumerate(kinds)], list(names))

    kind = docs.schema["doc_id"].dataType.simpleString()
    return both.mapInArrow(strip, f"doc_id {kind}, n_bytes long, n_chunks long, n_removed long, n_removed_chunks long, kept_sha256 string, removed array<struct<start:long,size:long>>")


def union_of(spans: list[int] | None) -> list[tuple[int, int]]:
    """Merged, sorted (start, end) of start << 32 | end; touching spans are one."""
    out: list[list[int]] = []
    for x in sorted(spans or ()):
        s, e = x >> 32, x & 0xFFFFFFFF
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]
