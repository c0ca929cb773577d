"""Shared pieces: the cluster's shared folder, written tables, and vectorised text kernels."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Short rows that a task takes at least, where their number is known.
TASK_ROWS = 20_000
_own: dict[str, str] = {}
_kept: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, as a URI. Where that is unset, as in tests, one below the
    system's temp folder, which ends with this process."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if "dir" not in _own:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            _own["dir"] = tempfile.mkdtemp(prefix="helixframe-")
            atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
        top = "file://" + _own["dir"]
    return f"{top.rstrip('/')}/helixframe-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """df as a table in the shared folder: computed once, lineage cut, and it survives lost executors."""
    spark = df.sparkSession
    path = path or shared_dir(spark)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete_dir(spark: SparkSession, path: str) -> None:
    """Removes a folder of any file system that Spark reaches."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Workspace:
    """Tables of one operator call. What the call only needs itself goes when it is left, finished or failed; tables
    that a lazy result still reads are made with `kept`, and go with `clean_up`."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.paths = spark, []

    def __enter__(self) -> Workspace:
        return self

    def __exit__(self, *_) -> None:
        for path in self.paths:
            delete_dir(self.spark, path)

    def written(self, df: DataFrame) -> DataFrame:
        self.paths.append(shared_dir(self.spark))
        return written(df, self.paths[-1])

    def kept(self, df: DataFrame) -> DataFrame:
        _kept.append(shared_dir(self.spark))
        return written(df, _kept[-1])

def clean_up(spark: SparkSession) -> None:
    """Deletes the tables that results of this driver read; call it when the results are consumed."""
    while _kept:
        delete_dir(spark, _kept.pop())


def small(df: DataFrame, rows: int) -> DataFrame:
    """df, a written table, with a broadcast hint if it has at most so many rows; else joins shuffle it."""
    return F.broadcast(df) if df.count() <= rows else df


def packed(df: DataFrame, rows: int, task_rows: int = TASK_ROWS) -> DataFrame:
    """df, of so many rows at most, in no more tasks than these are worth."""
    return df.coalesce(max(1, -(-rows // task_rows)))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix finaliser)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def seeds(n: int, seed: int) -> np.ndarray:
    return mix((np.arange(1, n + 1, dtype=U64) + U64(seed)) * U64(0x9E3779B97F4A7C15))


# The white space of the contracts: code points 0x20 and 0x09 to 0x0D, which is what bytes.split() splits at.
_IS_WORD = np.ones(256, np.uint8)
_IS_WORD[[32, 9, 10, 11, 12, 13]] = 0
_LETTERS = seeds(256, 7)
_BLOCK = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        out = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(n, base, U64)
            steps[0] = 1
            out.append(np.multiply.accumulate(steps))
        _powers[:] = out
    return _powers[0], _powers[1]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column without nulls, and the n + 1 offsets of its values."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    if not len(offsets):
        offsets = np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces_of(data: np.ndarray, offsets: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole values of about `most` bytes: first, end, bytes, offsets."""
    n, first = len(offsets) - 1, 0
    while first < n:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield first, end, data[offsets[first] : offsets[end]], offsets[first : end + 1] - offsets[first]
        first = end


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each value the place of its first word (n + 1 entries)."""
    word = _IS_WORD[data]
    first = word.copy()
    last = word.copy()
    if len(word):
        first[1:] &= word[:-1] ^ 1
        last[:-1] &= word[1:] ^ 1
        inner = offsets[(offsets > 0) & (offsets < len(word))]
        first[inner] = word[inner]
        last[inner - 1] = word[inner - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial over random letters, in blocks that end between words."""
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        begin = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, begin + _BLOCK, "right")))
        stop = int(ends[j - 1])
        power, inverse = _power_tables(max(_BLOCK, stop - begin))
        total = np.zeros(stop - begin + 1, U64)
        np.cumsum(_LETTERS[data[begin:stop]] * power[: stop - begin], out=total[1:])
        s, e = starts[i:j] - begin, ends[i:j] - begin
        out[i:j] = (total[e] - total[s]) * inverse[s] + (e - s).astype(U64) * U64(0xD6E8FEB86659FD93)
        i = j
    return mix(out)


def per_value(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many marked bytes each value has."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def trim() -> None:
    """Gives memory that a reused Python worker no longer needs back to the system."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def lean(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """f, a function for mapInArrow, with the worker's memory trimmed when a partition is done."""

    def run(batches):
        try:
            yield from f(batches)
        finally:
            trim()

    return run
