"""Near-duplicate classes by one-permutation hashing.

1. Each text's set of word shingles is hashed once; the hash's top bits choose one of ``BINS`` bins, and each bin
   keeps its smallest hash. Empty bins borrow from a bin that a fixed random sequence of theirs finds (optimal
   densification), so that two texts agree in a bin with the probability of their similarity.
2. Texts with equal sets fold into one class. Classes get one row per band of ``ROWS`` bins.
3. Candidate edges are stars: in each bucket, every class is paired with the bucket's smallest class only, so a
   bucket of n classes makes n - 1 pairs. Pairs are confirmed on the full sets.
4. What the confirmed links connect needs no further pairs. Where a bucket still holds classes of different
   components, those outside the largest class's component are compared with all others of the bucket: in small
   buckets as pairs, in large ones block by block, inside tasks that emit links only. So no candidate pair whose link
   could join two components is left out.

A pair at similarity 0.75 is missed with probability (1 - 0.75**ROWS)**BANDS, 5e-6. Class ids are half of a 128-bit hash of
the set; the other half tells unlike sets with one id apart, and they get ids of their own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SOLID, Scratch, byte_chunks, grams, mix, prefix_hashes, span_hashes, words
from .components import components

BINS, ROWS = 128, 4
BANDS = BINS // ROWS
#: Members per task block of a large group, and sets held against them at a time.
BLOCK, HELD = 600, 200
#: Up to so many candidates are sent to every executor (8 bytes each); more are joined.
BROADCAST_ROWS = 500_000
#: Tasks over which the members of one large bucket are dealt.
SALTS = 32
EMPTY = np.uint64(1 << 63)
_rng = np.random.default_rng(20240229)
#: For each bin, the bins to borrow from, in order.
TRIES = np.stack([_rng.integers(0, BINS, 96) for _ in range(BINS)], axis=1)


def shingle_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    """Each row's sorted distinct shingle hashes; a text of fewer than k words has its whole sequence as one."""
    out: list[np.ndarray] = []
    for _, offsets, data in byte_chunks(column):
        low = LOWER[data]
        s, e, row = words(low, offsets, SOLID)
        count = np.bincount(row, minlength=len(offsets) - 1)
        begin = np.concatenate(([0], np.cumsum(count)))
        hashed = span_hashes(prefix_hashes(low), s, e) if len(s) else np.zeros(0, np.uint64)
        g = grams(hashed, k, k)
        for a, b in zip(begin[:-1], begin[1:], strict=True):
            if b - a >= k:
                out.append(np.unique(g[a : b - k + 1]))
            elif b > a:
                out.append(grams(hashed[a:b], int(b - a), int(b - a)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of BINS values for each non-empty set."""
    sizes = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), sizes)
    flat = np.concatenate(sets)
    bins = (flat >> np.uint64(57)).astype(np.int64)
    first = np.ones(len(flat), bool)
    first[1:] = (row[1:] != row[:-1]) | (bins[1:] != bins[:-1])
    sig = np.full((len(sets), BINS), EMPTY)
    sig[row[first], bins[first]] = flat[first] & np.uint64((1 << 57) - 1)
    whole = sig.copy()
    open_rows = np.flatnonzero((sig == EMPTY).any(axis=1))
    for step in range(len(TRIES) + BINS):
        if not len(open_rows):
            break
        source = TRIES[step] if step < len(TRIES) else (np.arange(BINS) + step - len(TRIES)) % BINS
        part = sig[open_rows]
        part = np.where(part == EMPTY, whole[open_rows][:, source], part)
        sig[open_rows] = part
        open_rows = open_rows[(part == EMPTY).any(axis=1)]
    return sig


def bands(sig: np.ndarray) -> np.ndarray:
    """BANDS bucket hashes of each row; the band's number is part of the hash."""
    out = np.tile(np.arange(BANDS, dtype=np.uint64), (len(sig), 1))
    for r in range(ROWS):
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + sig[:, r::ROWS])
    return out.view(np.int64)


def digest(s: np.ndarray) -> tuple[int, int]:
    """The two halves of a set's 128-bit hash: class id and check."""
    raw = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
    return int.from_bytes(raw[:8], "little", signed=True), int.from_bytes(raw[8:], "little", signed=True)


def sketch(docs: DataFrame, k: int, id_bits: int) -> DataFrame:
    """(doc_id, key, text_hash, n, cls, check, bands) of each row; the last three are null for texts without words.

    key finds the row again: doc_id, or a hash of the text where that is null.
    """

    def run(batches):
        for b in batches:
            sets = shingle_sets(b.column(3), k)
            full = [i for i, s in enumerate(sets) if len(s)]
            cls: list = [None] * len(sets)
            check: list = [None] * len(sets)
            band: list = [None] * len(sets)
            for at in range(0, len(full), 2000):
                part = full[at : at + 2000]
                for i, v in zip(part, bands(signatures([sets[i] for i in part])), strict=True):
                    cls[i], check[i] = digest(sets[i])
                    cls[i] >>= 64 - id_bits
                    band[i] = v
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([len(s) for s in sets], pa.int64()), pa.array(cls, pa.int64()), pa.array(check, pa.int64()), pa.array(band, pa.list_(pa.int64()))], ["doc_id", "key", "text_hash", "n", "cls", "check", "bands"])

    return keyed(docs).mapInArrow(run, "doc_id long, key long, text_hash long, n long, cls long, check long, bands array<long>")


def classes_of(rows: DataFrame) -> DataFrame:
    """One row of each class; clash tells whether unlike sets share its id."""
    return rows.where("cls is not null").groupBy("cls").agg(F.min("doc_id").alias("doc_id"), F.min("key").alias("key"), F.first("bands").alias("bands"), F.min("check").alias("check"), (F.min("check") != F.max("check")).alias("clash"))


def told_apart(rows: DataFrame, classes: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """rows and classes with ids of their own for unlike sets that share one: none as a rule, a few among 1e10 sets."""
    clash = scratch.save(classes.where("clash").select(F.col("cls").alias("_clash")))
    n = clash.count()
    if not n:
        return rows, classes
    rows = rows.join(F.broadcast(clash) if n <= BROADCAST_ROWS else clash, F.col("cls") == F.col("_clash"), "left")
    rows = scratch.save(rows.withColumn("cls", F.when(F.col("_clash").isNull(), F.col("cls")).otherwise(F.xxhash64("cls", "check"))).drop("_clash"))
    return rows, scratch.save(classes_of(rows))


def keyed(docs: DataFrame) -> DataFrame:
    ident = F.col("doc_id").cast("long")
    return docs.select(ident.alias("doc_id"), F.coalesce(ident, F.xxhash64("text")).alias("key"), F.xxhash64("text").alias("text_hash"), "text")


def sets_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(cls, set) of the wanted classes (cls, key, check), each read from the row that key names."""
    few = wanted.count() <= BROADCAST_ROWS
    rows = keyed(docs).select("key", "text").join(F.broadcast(wanted) if few else wanted, "key")

    def run(batches):
        for b in batches:
            sets = shingle_sets(b.column(0), k)
            keep = [(c, s.tobytes()) for c, x, s in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), sets, strict=True) if len(s) and digest(s)[1] == x]
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in keep], pa.int64()), pa.array([s for _, s in keep], pa.binary())], ["cls", "set"])

    return rows.select("text", "cls", "check").mapInArrow(run, "cls long, set binary")


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort()
    same = int((both[1:] == both[:-1]).sum())
    return 100 * same >= percent * (len(both) - same)


def confirm(rows: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between the held sets (held = 0) and the others of each (grp, part), in sorted streams.

    Tasks hold the group's held sets, HELD at most, and see the others one by one. Between the same two components one
    link is enough, so further pairs of them are neither compared nor emitted.
    """
    sized = rows.repartition("grp", "part").sortWithinPartitions("grp", "part", "held")

    def run(batches):
        group, mine, joined = None, [], set()
        for b in batches:
            links = []
            for g, p, h, comp, cls, raw in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if (g, p) != group:
                    group, mine, joined = (g, p), [], set()
                s = np.frombuffer(raw, np.uint64)
                if h == 0:
                    mine.append((cls, comp, s))
                else:
                    for c, o, t in mine:
                        if o != comp and (o, comp) not in joined and linked(s, t, percent):
                            joined.add((o, comp))
                            links.append((cls, c))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], ["a", "b"])

    return sized.select("grp", "part", "held", "comp", "cls", "set").mapInArrow(run, "a long, b long")


def star_rows(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows for confirm(): pairs (center, member), the members of a large star in blocks."""
    many = pairs.groupBy("center").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    cut = pairs.join(many, "center").select("center", "member", F.expr("pmod(xxhash64(member), blocks)").alias("part"))
    members = cut.join(sets, F.col("member") == sets["cls"]).select(F.col("center").alias("grp"), "part", F.lit(1).alias("held"), F.col("cls").alias("comp"), "cls", "set")
    centers = cut.select("center", "part").distinct().join(sets, F.col("center") == sets["cls"]).select(F.col("center").alias("grp"), "part", F.lit(0).alias("held"), F.col("cls").alias("comp"), "cls", "set")
    return members.unionByName(centers)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 75, pairs_up_to: int = 32, id_bits: int = 64) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept, text_hash, chosen.

    Null and empty texts, and texts of white space, have no shingles and are linked with nothing; they are kept, with
    their own doc_id as component. Texts of fewer than k words are linked only if their words are equal. A null doc_id
    is never a component's smallest while another is there; a component of null ids alone has a null component_id and
    kept is true. Different texts under one doc_id are compared each by itself. ``chosen`` holds for one text of each
    component: of those with the component's doc_id the one with the smallest text_hash (xxhash64). Rows that repeat
    doc_id and text are answered alike. Extra columns are ignored; empty tables give none. ``id_bits`` is the length of
    the class ids; the result doesn't depend on it.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = scratch.save(sketch(docs.select("doc_id", "text"), k, id_bits))
    rows, classes = told_apart(rows, scratch.save(classes_of(rows)), scratch)
    spread = classes.select("cls", F.explode("bands").alias("h"))
    shared = spread.groupBy("h").agg(F.min("cls").alias("center"), F.max("cls").alias("_last")).where("center <> _last").drop("_last")
    buckets = scratch.save(spread.join(shared, "h"))
    stars = scratch.save(buckets.where("cls <> center").select("center", F.col("cls").alias("member")).distinct())
    wanted = stars.select(F.col("center").alias("cls")).unionByName(stars.select(F.col("member").alias("cls"))).distinct()
    sets = scratch.save(sets_of(docs, classes.select("cls", "key", "check").join(wanted, "cls"), k).dropDuplicates(["cls"]))
    links = scratch.save(confirm(star_rows(stars, sets), percent))
    roots = scratch.save(components(links, scratch))
    # candidates whose components differ still
    named = buckets.join(roots, F.col("cls") == F.col("node"), "left").select("h", "cls", "center", F.coalesce("root", "cls").alias("comp"))
    named = scratch.save(named)
    state = named.groupBy("h").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi"), F.count("*").alias("n"), F.max(F.when(F.col("cls") == F.col("center"), F.col("comp"))).alias("main")).where("_lo <> _hi")
    mixed = scratch.save(named.join(state.select("h", "n", "main"), "h"))
    small = mixed.where(F.col("n") <= pairs_up_to)
    outer = small.where("comp <> main").select("h", F.col("cls").alias("center"), F.col("comp").alias("_comp"))
    pairs = small.select("h", F.col("cls").alias("member"), "comp").join(outer, "h").where("comp <> _comp").select("center", "member").distinct()
    pairs = pairs.join(stars, ["center", "member"], "left_anti")
    large = mixed.where(F.col("n") > pairs_up_to)
    queries = large.where("comp <> main")
    turns = queries.groupBy("h").agg(F.ceil(F.count("*") / HELD).alias("turns"))
    # a large bucket's members stay dealt over many tasks: what is joined to them is repeated for each salt
    turns = turns.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    large = large.withColumn("salt", F.expr(f"pmod(xxhash64(cls, 3), {SALTS})")).join(turns, ["h", "salt"]).withColumn("blocks", F.expr("ceil(n / %d)" % BLOCK))
    asked = large.where("comp <> main").select("h", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.expr("pmod(xxhash64(cls, 1), turns)").alias("turn"), F.lit(0).alias("held"), "comp", "cls")
    all_of = large.select("h", F.expr("pmod(xxhash64(cls, 2), blocks)").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)).alias("turn"), F.lit(1).alias("held"), "comp", "cls")
    blocks = asked.unionByName(all_of).join(sets, "cls").select(F.col("h").alias("grp"), F.expr("block * 1000000007 + turn").alias("part"), "held", "comp", "cls", "set")
    more = scratch.save(confirm(star_rows(pairs, sets), percent).unionByName(confirm(blocks, percent)))
    if not more.isEmpty():
        roots = scratch.save(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more), scratch))
    owner = classes.select("cls", "doc_id").join(roots, F.col("cls") == F.col("node"), "left").select("cls", "doc_id", F.coalesce("root", "cls").alias("root"))
    least = owner.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    answer = scratch.save(owner.join(least, "root").select("cls", "root", "component_id"))
    found = rows.select("doc_id", F.col("n").alias("n_shingles"), "text_hash", "cls").join(answer, "cls", "left")
    # the smallest text_hash of a component, pre-aggregated in each task
    own = F.col("doc_id").eqNullSafe(F.col("component_id"))
    first = found.where(own & F.col("root").isNotNull()).groupBy("root").agg(F.min("text_hash").alias("_first"))
    out = found.join(first, "root", "left")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    kept = F.col("doc_id").eqNullSafe(component)
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), "text_hash", (kept & (F.col("cls").isNull() | (F.col("text_hash") == F.col("_first")))).alias("chosen"))
