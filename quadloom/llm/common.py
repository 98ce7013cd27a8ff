"""What the operators share: stored intermediates and Arrow/numpy word access.

Words are maximal runs of bytes other than space and the five ASCII line and
tab controls.  In UTF-8 these bytes never occur inside a longer character, so
all splitting works on the raw Arrow buffers and no Python string is made.
"""

from __future__ import annotations

import atexit
import functools
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

SEP = np.zeros(256, bool)
SEP[[0x20, *range(0x09, 0x0E)]] = True

_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASES = (np.uint64(0x9E3779B97F4A7C15 | 5), np.uint64(0xC2B2AE3D27D4EB4F | 1))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over unsigned 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.cache
def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    base = int(BASES[which])
    inverse = pow(base, -1, 2**64)
    up, down = np.empty(n, np.uint64), np.empty(n, np.uint64)
    for out, b in ((up, base), (down, inverse)):
        out[0], done = 1, 1
        while done < n:
            step = min(done, n - done)
            out[done : done + step] = out[:step] * np.uint64(pow(b, done, 2**64))
            done += step
    return up, down


def powers(n: int, which: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse modulo 2**64, at least n of each."""
    return _powers(which, max(1 << 16, 1 << (max(n, 1) - 1).bit_length()))


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """Polynomial hashes of values[starts:ends], from one running sum."""
    up, down = powers(len(values) + 1, which)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=total[1:])
    n = (ends - starts).astype(np.uint64)
    return mix((total[ends] - total[starts]) * down[starts] + n * np.uint64(0xD6E8FEB86659FD93))


class Block:
    """Some whole documents: their bytes, words and word hashes.

    ``first`` and ``last`` bound the rows in the batch, ``offsets`` the bytes of
    each, ``starts``/``ends`` the words, ``word_at`` the first word of each row.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int, sep: np.ndarray = SEP):
        self.data, self.offsets, self.first, self.n = data, offsets, first, len(offsets) - 1
        word = ~sep[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        begin = word.copy()
        begin[1:] &= ~word[:-1] | edge[1:-1]
        end = word
        end[:-1] &= sep[data[1:]] | edge[1:-1]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(end) + 1
        self.word_at = np.searchsorted(self.starts, offsets)

    @functools.cached_property
    def hashes(self) -> np.ndarray:
        return span_hash(BYTE_VALUES[self.data], self.starts, self.ends)

    def per_doc(self, of_words: np.ndarray) -> np.ndarray:
        """Sums over the words of each row."""
        total = np.concatenate([[0], np.cumsum(of_words)])
        return total[self.word_at[1:]] - total[self.word_at[:-1]]

    @functools.cached_property
    def doc(self) -> np.ndarray:
        """The row, within the block, of each word."""
        return np.repeat(np.arange(self.n), np.diff(self.word_at))

    def windows(self, k: int) -> np.ndarray:
        """Places of the k-word windows that lie within one document."""
        return np.flatnonzero(np.arange(len(self.starts)) + k <= self.word_at[self.doc + 1])


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw, offs.astype(np.int64)


def blocks(column: pa.Array, most: int = 1 << 20) -> Iterator[Block]:
    """The documents of a column in blocks of about ``most`` bytes; a longer one is alone."""
    raw, offs = text_buffers(column)
    at, n = 0, len(offs) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, side="right")) - 1)
        to = min(to, n)
        yield Block(raw[offs[at] : offs[to]], offs[at : to + 1] - offs[at], at)
        at = to


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or on a single machine one of our own if it is unset."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = tempfile.mkdtemp(prefix="quadloom-")
        spark.conf.set("spark.checkpoint.dir", where)
        atexit.register(shutil.rmtree, where, True)
    return where


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Lets a batch that goes to Python hold 1000 rows or 4 MB, whichever is less, as texts may be long; smaller settings of the session stay."""
    for key, most in (("maxRecordsPerBatch", 1000), ("maxBytesPerBatch", 4 << 20)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{key}")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))
    return spark


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: later steps outlive lost executors and repeat no work."""
    spark = bounded_batches(df.sparkSession)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def signed(x: np.ndarray) -> pa.Array:
    """Unsigned 64-bit values as Spark's signed longs."""
    return pa.array(np.ascontiguousarray(x).view(np.int64))
