"""Benchmark decontamination by winnowing.

Words are hashed; of each run of ``w`` neighbouring k-gram hashes the smallest (rightmost on ties) is a fingerprint.
Documents and benchmark items share fingerprints wherever they share ``k + w - 1`` words; each shared fingerprint is
extended word by word in both directions, and the run counts if it is as long as the item's window. For windows of L
words k = min(5, L) and k + w - 1 = L, so no shared window is missed; items shorter than ``window`` have windows of
their own length, and each occurring length is winnowed by itself.

The benchmark is read in blocks of at most ``block_words`` words. Each block's index (a few dozen bytes a word) goes
to the executors; documents are then scanned without any shuffle. One block is the rule; further blocks add one scan
each and are merged by document. The driver holds one block at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM, LOWER, Scratch, byte_chunks, grams, prefix_hashes, span_hashes, words

WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def winnow(hashes: np.ndarray, w: int) -> np.ndarray:
    """Positions of the rightmost smallest hash of each run of w; sorted, without repeats."""
    n = len(hashes) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best = hashes[w - 1 :].copy()
    at = np.arange(w - 1, w - 1 + n)
    for j in range(w - 2, -1, -1):
        less = hashes[j : j + n] < best
        best = np.where(less, hashes[j : j + n], best)
        at = np.where(less, np.arange(j, j + n), at)
    return np.unique(at)


class Index:
    """Fingerprints of one block of benchmark items."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.items: list[tuple[str, list[bytes], int]] = []
        found: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for name, text in items:
            own = WORD.findall(lowered(text or ""))
            if not own:
                continue
            size = min(window, len(own))
            raw = b" ".join(own)
            data = np.frombuffer(raw, np.uint8)
            s, e, _ = words(data, np.array([0, len(data)]), ALNUM)
            hashed = span_hashes(prefix_hashes(data), s, e)
            k = min(5, size)
            g = grams(hashed, k, size)
            at = found.setdefault(size, {})
            for p in winnow(g, size - k + 1):
                at.setdefault(int(g[p]), []).append((len(self.items), int(p)))
            self.items.append((name, own, size))
        self.at = found
        self.keys = {size: np.array(sorted(at), np.uint64) for size, at in found.items()}


def lowered(text: str) -> bytes:
    """UTF-8 with only A-Z lowered."""
    return text.encode("utf-8", "surrogatepass").translate(bytes(LOWER))


def scan(index: Index, column: pa.Array) -> Iterator[tuple[int, int, list[int], list[str]]]:
    """(row, number of words, positions of hit words, ids of occurring items) of each row."""
    for first, offsets, data in byte_chunks(column):
        low = LOWER[data]
        s, e, row = words(low, offsets, ALNUM)
        n_rows = len(offsets) - 1
        count = np.bincount(row, minlength=n_rows)
        begin = np.concatenate(([0], np.cumsum(count)))
        hashed = span_hashes(prefix_hashes(low), s, e) if len(s) else np.zeros(0, np.uint64)
        hits: dict[int, list[tuple[int, int, int]]] = {}
        for size, keys in index.keys.items():
            k = min(5, size)
            g = grams(hashed, k, size)
            if not len(g) or not len(keys):
                continue
            kept = winnow(g, size - k + 1)  # windows across two rows only add fingerprints
            found = np.searchsorted(keys, g[kept])
            found[found == len(keys)] = 0
            for p in kept[keys[found] == g[kept]]:
                r = int(row[p])
                if p + k <= begin[r + 1]:
                    hits.setdefault(r, []).append((size, int(g[p]), int(p - begin[r])))
        for r in range(n_rows):
            marked, names = [], []
            if r in hits:
                own = [bytes(low[a:b]) for a, b in zip(s[begin[r] : begin[r + 1]], e[begin[r] : begin[r + 1]], strict=True)]
                marked, names = extend(index, own, hits[r])
            yield first + r, int(count[r]), marked, names


def extend(index: Index, own: list[bytes], hits: list[tuple[int, int, int]]) -> tuple[list[int], list[str]]:
    """Grow each shared fingerprint to the whole run of equal words; keep the runs of a window at least."""
    done: dict[tuple[int, int], int] = {}
    spans, names = [], set()
    for size, key, p in hits:
        for item, q in index.at[size][key]:
            if done.get((item, p - q), -1) > p:
                continue
            _, theirs, _ = index.items[item]
            a, b = 0, 0
            while a < min(p, q) and own[p - a - 1] == theirs[q - a - 1]:
                a += 1
            while p + b < len(own) and q + b < len(theirs) and own[p + b] == theirs[q + b]:
                b += 1
            done[item, p - q] = p + b
            if a + b >= size:
                spans.append((p - a, p + b))
                names.add(index.items[item][0])
    marked = sorted({i for a, b in set(spans) for i in range(a, b)})
    return marked, sorted(names)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 10, block_words: int = 2_000_000, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items (array<string>), hit (array<int>).

    Null and empty texts have no words and are clean; so are empty tables. Repeated rows are answered one by one.
    Items whose text is null or has no word occur nowhere; an item_id that repeats counts once. A null item_id is
    written as an empty string. Of docs' other columns those in ``carry`` come along, behind the answer; the rest, and
    other columns of the benchmark, are ignored.
    """
    spark = docs.sparkSession
    blocks = blocks_of(benchmark, block_words)
    first, second = next(blocks, []), next(blocks, None)
    along = [f"_c{i}" for i in range(len(carry))]
    source = docs.select("doc_id", "text", *[F.col(f"`{c}`").alias(a) for c, a in zip(carry, along, strict=True)])
    kinds = "".join(f", {a} {source.schema[a].dataType.simpleString()}" for a in along)

    def over(block: list) -> DataFrame:
        held = spark.sparkContext.broadcast(Index(block, window))

        def run(batches):
            for b in batches:
                got = list(scan(held.value, b.column(1)))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), *(pa.array([x[i] for x in got], t) for i, t in ((1, pa.int64()), (2, pa.list_(pa.int32())), (3, pa.list_(pa.string())))), *b.columns[2:]],
                    ["doc_id", "n_words", "hit", "items", *along],
                )

        return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_words long, hit array<int>, items array<string>{kinds}")

    if second is None:
        found = over(first)
    else:
        scratch = Scratch(spark)
        parts = [over_block(scratch, source, first, window), over_block(scratch, source, second, window)]
        del first, second
        found = merged(source, along, [*parts, *(over_block(scratch, source, b, window) for b in blocks)])
    items = F.array_sort("items")
    return found.select(
        "doc_id", "n_words", F.size("hit").cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (F.size("hit") > 0).alias("contaminated"), items.alias("items"), "hit",
        *[F.col(a).alias(c) for c, a in zip(carry, along, strict=True)],
    )


def blocks_of(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[str, str | None]]]:
    """Items in blocks of at most ``block_words`` words; a longer item is a block of its own."""
    block: list[tuple[str, str | None]] = []
    held = 0
    for r in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), "text").toLocalIterator():
        n = len(r["text"] or "") // 2 + 1
        if held + n > block_words and block:
            yield block
            block, held = [], 0
        block.append((r["i"], r["text"]))
        held += n
    if block:
        yield block


def over_block(scratch: Scratch, source: DataFrame, block: list, window: int) -> DataFrame:
    """Hits of one of several blocks, for the texts that have any, once for each different text, as a table."""
    held = scratch.spark.sparkContext.broadcast(Index(block, window))

    def run(batches):
        for b in batches:
            texts = b.column(0)
            got = [(hashlib.sha256((texts[r].as_py() or "").encode("utf-8", "surrogatepass")).hexdigest(), h, i) for r, _, h, i in scan(held.value, texts) if i]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.list_(pa.int32())), pa.array([x[2] for x in got], pa.list_(pa.string()))], ["_text", "_hit", "_items"])

    found = scratch.save(source.select("text").mapInArrow(run, "_text string, _hit array<int>, _items array<string>").dropDuplicates(["_text"]))
    held.destroy()
    return found


def merged(source: DataFrame, along: list[str], parts: list[DataFrame]) -> DataFrame:
    """One answer per row from the answers of the blocks.

    What the blocks found, a row for each different text with a hit, is joined by the text's hash; rows without a word
    are answered without the join, and AQE splits the rows of a text that very many documents share.
    """
    some = parts[0]
    for p in parts[1:]:
        some = some.unionByName(p)
    some = some.groupBy("_text").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_hit")))).alias("_hit"), F.array_distinct(F.flatten(F.collect_list("_items"))).alias("_items"))
    low = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    n_words = F.regexp_count(low, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")).cast("long")
    left = source.select("doc_id", n_words.alias("n_words"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("_text"), *along)
    # rows without words get keys of their own, so they don't meet in one task
    left = left.withColumn("_text", F.when(F.col("n_words") > 0, F.col("_text")).otherwise(F.concat(F.lit("none "), F.xxhash64("doc_id").cast("string"))))
    joined = left.join(some, "_text", "left")
    return joined.select("doc_id", "n_words", F.coalesce("_hit", F.array().cast("array<int>")).alias("hit"), F.coalesce("_items", F.array().cast("array<string>")).alias("items"), *along)
