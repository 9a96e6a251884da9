"""What the text operators share: scratch tables, byte chunks of Arrow strings, and vectorised word hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

U64 = np.uint64


#: Rows that a Python worker of a saved table gets at a time; the worker and the JVM each hold a few such batches.
BATCH_ROWS = 1000


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of BATCH_ROWS rows at most, as long as this lasts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = int(spark.conf.get(name))
    if 0 < before <= BATCH_ROWS:
        yield
        return
    spark.conf.set(name, BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Scratch:
    """Parquet tables in the shared folder that ``spark.checkpoint.dir`` names.

    They cut lineage: a lost executor costs a reread, not a recomputation. Where the setting is absent and the master
    is local, a temporary folder is made and set; on a cluster, where executors would each write to a disk of their
    own, that is an error.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.conf.get("spark.master", "local").startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            base = "file://" + tempfile.mkdtemp(prefix="scratch-")
            spark.conf.set("spark.checkpoint.dir", base)
        self.root = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
        self.n = 0

    def save(self, df: DataFrame) -> DataFrame:
        """Write df and return the table read back."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        with small_batches(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete saved tables that no later step reads."""
        jvm = self.spark._jvm
        for t in tables:
            p = jvm.org.apache.hadoop.fs.Path(t._scratch_path)
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


#: Byte classes.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: [0-9a-z] and every byte of a character beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: Everything but blank and \t..\r.
SOLID = np.ones(256, bool)
SOLID[[32, 9, 10, 11, 12, 13]] = False

BASE = U64(0x9E3779B97F4A7C15 | 1)
INVERSE = U64(pow(int(BASE), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; kept and grown."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << int(n - 1).bit_length() if n > 1 else 1)
        p = np.full(size, base, U64)
        p[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(p)
        _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """H with H[e] - H[s] the polynomial of data[s:e], times BASE**s."""
    out = np.zeros(len(data) + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers(BASE, len(data)), out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], alike for equal bytes wherever they stand."""
    return mix((prefix[end] - prefix[start]) * powers(INVERSE, len(prefix))[start])


def byte_chunks(column: pa.Array, limit: int = 2 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets from 0, bytes) of runs of whole rows with about ``limit`` bytes; null is empty."""
    column = column.fill_null("") if column.null_count else column
    n = len(column)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offs, offs[row] + limit, "right")) - 1)
        yield row, offs[row : end + 1] - offs[row], data[offs[row] : offs[end]]
        row = end


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the maximal runs of bytes in ``table``; runs never cross rows."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    is_word = table[data]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    start = is_word.copy()
    start[1:] &= ~is_word[:-1] | first[1:n]
    end = is_word.copy()
    end[:-1] &= ~is_word[1:] | first[1:n]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(offsets, s, "right") - 1


def grams(values: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A hash of each k neighbouring values; k - 1 fewer than the values."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.full(n, U64(seed))
    for j in range(k):
        out = out * U64(0xD6E8FEB86659FD93) + values[j : j + n]
    return mix(out)


def ensure_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns can't clash with those that an operator adds."""
    return df.select(*names)
