"""Repeated byte strings of a given length, by merging sorted suffix runs.

A string of ``length`` bytes is repeated if it starts at two places of the collection. Sorting every suffix would move
``length`` bytes for each byte of input, so suffixes are sampled: of each ``length`` - GRAM + 1 neighbouring GRAM-byte
hashes the smallest is an anchor. Equal strings have their anchor at the same offset; so all repeats show among
suffixes that begin at anchors, taken with the bytes left of them.

1. Texts that are equal fold into one (a text that has a copy is repeated as a whole), in a table bucketed by text key.
2. Anchors whose gram occurs twice anywhere are candidates; only 22 bytes an anchor are exchanged for that.
3. Each task sorts its candidate suffixes and writes one front-coded run (shared prefix length and the rest) for each
   target partition; equal suffixes with equal left contexts share one entry.
4. Each partition merges its runs with a loser tree that keeps, for each run, the prefix length it shares with the
   last winner, so that known prefixes are never compared again. The lengths come out with the sorted suffixes: a
   window at offset d left of the anchor is repeated if the neighbours share ``length`` - d bytes and the d bytes
   left of the anchor.
5. Spans go back to their texts by the bucketed table's key: texts are shuffled once.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BASE, INVERSE, Scratch, byte_chunks, powers, prefix_hashes

GRAM = 48
POSITION = np.uint64((1 << 28) - 1)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(row, position in row, smallest and largest offset d, gram hash) of the anchors of all windows of each row."""
    none = np.zeros(0, np.int64)
    w, n = length - GRAM + 1, len(data) - GRAM + 1
    rows = np.flatnonzero(np.diff(offsets) >= length)
    if n < w or not len(rows):
        return none, none, none, none, none.astype(np.uint64)
    h = prefix_hashes(data)
    g = (h[GRAM:] - h[:-GRAM]) * powers(INVERSE, len(data))[:n]
    g ^= g >> np.uint64(32)
    g *= BASE
    g ^= g >> np.uint64(29)
    # the position, counted down, decides ties: the rightmost wins
    key = (g & ~POSITION) | (POSITION - (np.arange(n, dtype=np.uint64) & POSITION))
    blocks = -(-n // w)
    padded = np.full(blocks * w, np.iinfo(np.uint64).max)
    padded[:n] = key
    grid = padded.reshape(blocks, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    best = np.minimum(back[: n - w + 1], ahead[w - 1 : n])
    sizes = offsets[rows + 1] - offsets[rows] - length + 1
    start = np.repeat(offsets[rows] - np.concatenate(([0], np.cumsum(sizes)[:-1])), sizes) + np.arange(sizes.sum())
    row = np.repeat(rows, sizes)
    low = (POSITION - (best[start] & POSITION)).astype(np.int64)
    at = start + ((low - start) & int(POSITION))
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    a = at[first]
    return row[first], a - offsets[row[first]], a - start[last], a - start[first], g[a]


def common(a: bytes, b: bytes, known: int) -> int:
    """Length of the common prefix; the first ``known`` bytes are not looked at."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    return n - ((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7) // 8


# A run: for each entry a head of five numbers (shared prefix, rest, left context, smallest d, references), the
# references (text key, position), and the bytes of the rests and the left contexts.
HEAD = np.dtype([("lcp", "<u2"), ("rest", "<u2"), ("left", "<u2"), ("dlo", "<u2"), ("refs", "<u4")])
REF = np.dtype([("key", "<i8"), ("at", "<u4")])


def encode(entries: list[tuple[bytes, bytes, int, int, int]]) -> bytes:
    """Front-code (right, left, dlo, key, position) entries as one run."""
    entries.sort()
    heads, refs, rests, lefts = [], [], [], []
    before: tuple = (b"", None, None)
    for right, left, dlo, key, at in entries:
        if (right, left, dlo) == before:
            heads[-1][4] += 1
        else:
            shared = common(before[0], right, 0)
            heads.append([shared, len(right) - shared, len(left), dlo, 1])
            rests.append(right[shared:])
            lefts.append(left)
            before = (right, left, dlo)
        refs.append((key, at))
    parts = [np.array([tuple(x) for x in heads], HEAD).tobytes(), np.array(refs, REF).tobytes(), b"".join(rests), b"".join(lefts)]
    return zstandard.ZstdCompressor(level=1).compress(b"".join([np.array([len(p) for p in parts], "<u4").tobytes(), *parts]))


class Run:
    """Reads a run entry by entry; ``text`` is the current suffix, ``shared`` its known common prefix."""

    def __init__(self, raw: bytes):
        raw = zstandard.ZstdDecompressor().decompress(raw)
        a, b, c, _ = np.frombuffer(raw, "<u4", 4).tolist()
        self.heads = np.frombuffer(raw, HEAD, offset=16, count=a // HEAD.itemsize).tolist()
        self.refs = np.frombuffer(raw, REF, offset=16 + a, count=b // REF.itemsize).tolist()
        self.raw, self.i, self.r, self.p, self.q = raw, 0, 0, 16 + a + b, 16 + a + b + c
        self.text: bytes | None = b""
        self.shared = 0
        self.step()

    def step(self) -> None:
        if self.i == len(self.heads):
            self.text = None
            return
        shared, rest, left, self.dlo, n = self.heads[self.i]
        self.text = self.text[:shared] + self.raw[self.p : self.p + rest]
        self.shared = shared
        self.left = self.raw[self.q : self.q + left]
        self.own = self.refs[self.r : self.r + n]
        self.i, self.r, self.p, self.q = self.i + 1, self.r + n, self.p + rest, self.q + left


def merge(runs: list[Run]) -> Iterator[tuple[bytes, int, bytes, int, list]]:
    """(suffix, prefix shared with the one before, left context, smallest d, references) in order, by a loser tree."""
    k = 1
    while k < len(runs):
        k *= 2
    done = Run.__new__(Run)
    done.text, done.shared = None, 0
    leaf = runs + [done] * (k - len(runs))
    lost: list = [None] * k

    def play(a: Run, b: Run) -> tuple[Run, Run]:
        """Winner and loser; the loser's prefix shared with the winner becomes known."""
        if a.text is None:
            return b, a
        if b.text is None:
            return a, b
        if a.shared != b.shared:
            return (a, b) if a.shared > b.shared else (b, a)
        x, y = a.text, b.text
        n = common(x, y, a.shared)
        if n == len(x) or (n < len(y) and x[n] < y[n]):
            b.shared = n
            return a, b
        a.shared = n
        return b, a

    def fill(node: int) -> Run:
        if node >= k:
            return leaf[node - k]
        win, lost[node] = play(fill(2 * node), fill(2 * node + 1))
        return win

    place = {id(r): i for i, r in enumerate(runs)}
    win = fill(1)
    while win.text is not None:
        yield win.text, win.shared, win.left, win.dlo, win.own
        at = (place[id(win)] + k) // 2
        win.step()
        while at:
            win, lost[at] = play(win, lost[at])
            at //= 2


def repeats(group: list[tuple[bytes, int, bytes, int, list]], length: int) -> Iterator[tuple[int, int, int]]:
    """(key, start, end) of repeated spans of one gram's sorted suffixes."""
    if len(group) == 1 and len(group[0][4]) == 1:
        return
    m = len(group)
    near = [max(group[i][1] if i else 0, group[i + 1][1] if i + 1 < m else 0) for i in range(m)]
    good: list[set[int]] = [set() for _ in group]
    wanted = set()
    for i, (_, _, left, dlo, refs) in enumerate(group):
        if len(refs) > 1:
            good[i].update(range(dlo, len(left) + 1))
        elif near[i] >= length - len(left):
            wanted.update(range(max(dlo, length - near[i]), len(left) + 1))
    for d in wanted:
        seen: dict[bytes, int] = {}
        for i, (_, shared, left, dlo, _) in enumerate(group):
            if shared < length - d:
                seen = {}
            if dlo <= d <= len(left):
                j = seen.setdefault(left[len(left) - d :], i)
                if j != i:
                    good[i].add(d)
                    good[j].add(d)
    for i, (_, _, _, _, refs) in enumerate(group):
        if good[i]:
            ds = sorted(good[i], reverse=True)
            for key, at in refs:
                s = e = at - ds[0]
                for d in ds:
                    if at - d > e + 1:
                        yield key, s, e + length
                        s = at - d
                    e = at - d
                yield key, s, e + length


def spans_of(batches, length: int):
    """Spans of the runs of each partition; runs come sorted by pid."""

    def solve(raws: list[bytes]):
        group: list = []
        for x in merge([Run(r) for r in raws]):
            if group and x[1] < GRAM:
                yield from repeats(group, length)
                group = []
            group.append(x)
        if group:
            yield from repeats(group, length)

    def batch(got):
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.int64()), pa.array([x[1] << 32 | x[2] for x in got], pa.int64())], ["key", "span"])

    def partitions():
        pid, raws = None, []
        for b in batches:
            for p, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if p != pid:
                    if raws:
                        yield raws
                    pid, raws = p, []
                raws.append(raw)
        if raws:
            yield raws

    for raws in partitions():
        got = []
        for x in solve(raws):
            got.append(x)
            if len(got) == 50_000:
                yield batch(got)
                got = []
        yield batch(got)


def text_key(text, clashes: list[int] = (), key_bits: int = 64):
    """A text's 64-bit key; the keys in ``clashes`` stand for several texts and are told apart by a second hash."""
    key = F.shiftright(F.xxhash64(text), 64 - key_bits)
    return F.when(key.isin(list(clashes)), F.xxhash64(key, F.md5(text))).otherwise(key) if clashes else key


def survey(whole: DataFrame, key_bits: int) -> tuple[int, list[int]]:
    """Bytes of all texts, and the keys that different texts share: none as a rule, a few among 1e10 texts."""
    check = F.xxhash64(F.md5("text"))
    each = whole.groupBy(text_key(F.col("text"), key_bits=key_bits).alias("key")).agg(F.min(check).alias("lo"), F.max(check).alias("hi"), F.sum(F.octet_length("text")).alias("n"))
    total, clashes = each.agg(F.sum("n"), F.collect_list(F.when(F.col("lo") != F.col("hi"), F.col("key")))).first()
    return total or 0, clashes


def folded(batches, limit: int = 64 << 20):
    """(key, text, copies) of (key, text) batches, with the copies of about ``limit`` bytes at a time made one row."""
    held: list[pa.RecordBatch] = []

    def flush():
        table = pa.Table.from_batches(held).combine_chunks()
        held.clear()
        _, first, copies = np.unique(table["key"].to_numpy(), return_index=True, return_counts=True)
        for b in table.take(pa.array(first)).append_column("copies", pa.array(copies.astype(np.int64))).to_batches(max_chunksize=5000):
            yield b

    for b in batches:
        held.append(b)
        if sum(x.nbytes for x in held) > limit:
            yield from flush()
    if held:
        yield from flush()


def repeated_spans(docs: DataFrame, length: int = 200, partition_bytes: int = 32 << 20, key_bits: int = 64) -> tuple[DataFrame, DataFrame, list[int]]:
    """(texts, spans, clashes): the bucketed table (key, text, copies) of different texts of ``length`` bytes at least,
    (key, list of start << 32 | end) for those with repeated spans, where copies are not in the list, and the keys that
    text_key() has to tell apart."""
    if not GRAM <= length < GRAM + 256:
        raise ValueError(f"length must be {GRAM} to {GRAM + 255} bytes, as offsets of anchors are kept in 8 bits: {length}")
    spark = docs.sparkSession
    scratch = Scratch(spark)
    whole = docs.select("text").where(F.octet_length("text") >= length)
    total, clashes = survey(whole, key_bits)
    parts = int(min(50_000, max(1, -(-total // partition_bytes))))
    name = f"texts_{uuid.uuid4().hex}"
    # tasks fold the copies that they see, so a text that very many rows share is exchanged a few times a task; texts
    # are exchanged once, by the partitioning that the table and the second fold share
    texts = whole.select(text_key(F.col("text"), clashes, key_bits).alias("key"), "text").mapInArrow(folded, "key long, text string, copies long")
    texts = texts.repartition(parts, "key").groupBy("key").agg(F.first("text").alias("text"), F.sum("copies").alias("copies"))
    texts.write.option("compression", "zstd").bucketBy(parts, "key").sortBy("key").format("parquet").option("path", f"{scratch.root}/texts").saveAsTable(name)
    texts = spark.table(name)
    # the catalog's entry has done its work; the files stay in the shared folder
    spark.sql(f"DROP TABLE {name}")

    def sample(batches):
        out: list[list] = [[] for _ in range(5)]
        held = 0

        def flush():
            key, at, lo, hi, g = (np.concatenate(x) for x in out)
            pid = (g >> np.uint64(40)).astype(np.int64) % parts
            order = np.argsort(pid, kind="stable")
            cut = np.flatnonzero(np.diff(pid[order], prepend=-1))
            blobs = []
            for i in np.split(order, cut[1:]) if len(cut) else []:
                blobs.append((int(pid[i[0]]), len(i), b"".join(x[i].tobytes() for x in (g, key, at.astype(np.uint32), lo.astype(np.uint8), hi.astype(np.uint8)))))
            for x in out:
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([x[j] for x in blobs], t) for j, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], ["pid", "n", "blob"])

        for b in batches:
            keys = b.column(0).to_numpy()
            for first, offsets, data in byte_chunks(b.column(1)):
                row, at, lo, hi, g = anchors(data, offsets, length)
                for x, y in zip(out, (keys[first + row], at, lo, hi, g), strict=True):
                    x.append(y)
                held += len(row)
                if held > 500_000:
                    yield flush()
                    held = 0
        if held:
            yield flush()

    def choose(batches):
        pid, blobs = None, []

        def solve():
            parts_ = []
            for n, x in blobs:
                parts_.append((np.frombuffer(x, np.uint64, n), np.frombuffer(x, np.int64, n, 8 * n), np.frombuffer(x, np.uint32, n, 16 * n), np.frombuffer(x, np.uint8, n, 20 * n), np.frombuffer(x, np.uint8, n, 21 * n)))
            g, key, at, lo, hi = (np.concatenate(x) for x in zip(*parts_, strict=True))
            order = np.argsort(g, kind="stable")
            same = g[order][1:] == g[order][:-1]
            twice = np.zeros(len(g), bool)
            twice[1:] |= same
            twice[:-1] |= same
            i = order[twice]
            code = at[i].astype(np.int64) << 16 | lo[i].astype(np.int64) << 8 | hi[i]
            for s in range(0, max(1, len(i)), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(key[i][s : s + 100_000]), pa.array(code[s : s + 100_000])], ["key", "code"])

        for b in batches:
            for p, n, x in zip(*(b.column(j).to_pylist() for j in range(3)), strict=True):
                if p != pid:
                    if blobs:
                        yield from solve()
                    pid, blobs = p, []
                blobs.append((n, x))
        if blobs:
            yield from solve()

    def cut(batches):
        runs: dict[int, list] = {}
        held = 0

        def flush():
            got = [(p, encode(x)) for p, x in runs.items()]
            runs.clear()
            return pa.RecordBatch.from_arrays([pa.array([p for p, _ in got], pa.int32()), pa.array([x for _, x in got], pa.binary())], ["pid", "run"])

        for b in batches:
            for key, text, codes in zip(b.column(0).to_pylist(), b.column(1), b.column(2), strict=True):
                raw = text.as_buffer().to_pybytes()
                for code in codes.values.to_pylist():
                    at, lo, hi = code >> 16, code >> 8 & 255, code & 255
                    right = raw[at : at + length - lo]
                    runs.setdefault(zlib.crc32(right[:GRAM]) % parts, []).append((right, raw[at - hi : at], lo, key, at))
                held += len(codes)
                if held > 150_000:
                    yield flush()
                    held = 0
        if held:
            yield flush()

    picked = texts.select("key", "text").mapInArrow(sample, "pid int, n int, blob binary")
    picked = picked.repartition(parts, "pid").sortWithinPartitions("pid").mapInArrow(choose, "key long, code long")
    lists = picked.groupBy("key").agg(F.collect_list("code").alias("codes"))
    runs = texts.select("key", "text").join(lists, "key").select("key", "text", "codes").mapInArrow(cut, "pid int, run binary")
    found = runs.repartition(parts, "pid").sortWithinPartitions("pid").mapInArrow(lambda b: spans_of(b, length), "key long, span long")
    return texts, scratch.save(found.groupBy("key").agg(F.collect_list("span").alias("spans"))), clashes


def union_of(spans: list[int] | None) -> list[tuple[int, int]]:
    """Merged, sorted (start, end); touching spans are one."""
    out: list[list[int]] = []
    for x in sorted(spans or ()):
        s, e = x >> 32, x & 0xFFFFFFFF
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def remove_repeats(docs: DataFrame, length: int = 200, partition_bytes: int = 32 << 20, key_bits: int = 64) -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (array of start, end in bytes).

    Other lengths than 48 to 303 are an error.
    Null is empty; texts shorter than ``length`` lose nothing. Of repeated rows and equal texts every one is removed
    whole (they start anywhere else). Extra columns are ignored; empty tables give none. Texts are told apart by two
    64-bit hashes; ``key_bits`` is the length of the first, and the result doesn't depend on it.
    """
    texts, spans, clashes = repeated_spans(docs, length, partition_bytes, key_bits)

    def strip(batches):
        for b in batches:
            got = []
            for key, text, copies, found in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                raw = text.as_buffer().to_pybytes()
                gone = [(0, len(raw))] if copies > 1 else union_of(found)
                sha, at = hashlib.sha256(), 0
                for s, e in gone:
                    sha.update(raw[at:s])
                    at = e
                sha.update(raw[at:])
                got.append((key, sum(e - s for s, e in gone), len(gone), sha.hexdigest(), [{"start": s, "end": e} for s, e in gone]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in got], t) for j, t in enumerate(kinds)], ["key", "n_removed", "n_spans", "kept", "spans"])

    answer = texts.join(spans, "key", "left").select("key", "text", "copies", "spans").mapInArrow(strip, "key long, n_removed long, n_spans long, kept string, spans array<struct<start:long,end:long>>")
    text = F.coalesce("text", F.lit(""))
    n = F.octet_length(text)
    rows = docs.select("doc_id", n.cast("long").alias("n_bytes"), F.when(n >= length, text_key(text, clashes, key_bits)).otherwise(F.xxhash64("doc_id", F.lit("short"))).alias("key"), F.when(n < length, F.sha2(text, 256)).alias("_short"))
    long = F.col("_short").isNull()  # short texts have keys of their own, so they don't meet in one task, and no answer
    return rows.join(answer, "key", "left").select(
        "doc_id", "n_bytes", F.coalesce(F.when(long, F.col("n_removed")), F.lit(0).cast("long")).alias("n_removed"), F.coalesce(F.when(long, F.col("n_spans")), F.lit(0).cast("long")).alias("n_spans"),
        F.coalesce("_short", "kept").alias("kept_sha256"), F.coalesce(F.when(long, F.col("spans")), F.array().cast("array<struct<start:long,end:long>>")).alias("spans"),
    )
