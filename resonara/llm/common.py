"""Shared pieces: Arrow text access, word hashing and lineage cuts.

Text reaches the Python kernels as UTF-8 bytes.  ``bytes.split`` separates at
exactly the six ASCII white-space bytes (x20, x09-x0D) and ``bytes.lower``
changes only A-Z, which are the word rules most contracts name.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes after which an Arrow batch ends; it holds one row at least, and one text may be very long.
BATCH_BYTES = 1 << 20
#: Entries after which a worker's word table starts afresh.
VOCABULARY_ROWS = 200_000

_U = np.uint64


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of the Arrow batches of the session's plans.

    Spark reads the setting when a plan runs, so it can't be put back here.  It
    only ever falls, and changes no plan's result.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name).rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder: the session's ``spark.checkpoint.dir``, or the context's.

    A folder of this machine is set only where both are missing and Spark runs in this process.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not context.getCheckpointDir():
        if not named:
            if not context.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="resonara-")
        context.setCheckpointDir(named)
    return named or context.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there, so that a lost executor repeats nothing before it."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def split_join(rows: DataFrame, sums: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """``rows`` joined with ``sums``, an aggregate by ``keys`` (the first a long).

    An aggregate joined on its own keys stays in their partitioning, and a
    partition that holds a hot key couldn't be split.  With one more condition,
    on part of the first key, both sides are dealt anew, and adaptive execution
    may split and copy what is too large.
    """
    taken = [*rows.columns, *sums.columns]
    other = {k: free_name(f"_{k}", taken) for k in keys}
    part = lambda c: F.col(c).bitwiseAND(F.lit(63))
    met = F.lit(True)
    for k in keys:
        met = met & (F.col(k) == F.col(other[k]))
    met = met & (part(keys[0]) == part(other[keys[0]]))
    return rows.join(sums.withColumnsRenamed(other), met, how).drop(*other.values())


def free_name(name: str, taken: list[str]) -> str:
    """``name``, with underscores added until no column has it in any case."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name += "_"
    return name


def removed(spark: SparkSession, folder: str) -> None:
    """Delete a folder of any file system that Spark writes to."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def hash_sample(rows: int, wanted: int, *columns: str) -> Column:
    """A condition that holds for about ``wanted`` of ``rows`` rows, all if there are no more: those with the lowest hash of ``columns``."""
    if rows <= wanted:
        return F.lit(True)
    return F.xxhash64(*columns) < F.lit(-(1 << 63) + (wanted << 64) // rows)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as bytes; a null text is empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, remembered for up to VOCABULARY_ROWS words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= VOCABULARY_ROWS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), _U, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def odd_powers(base: int, n: int) -> list[np.uint64]:
    return [_U(pow(base, k, 1 << 64)) for k in range(n)]


_SHINGLE = odd_powers(0x9E3779B97F4A7C15, 64)


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive words; none if there are fewer."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, _U)
    total = np.zeros(n, _U)
    for k in range(width):
        total += hashes[k : k + n] * _SHINGLE[k]
    return mixed(total)


def shingle_set(words: list[bytes], cache: WordHashes, width: int = 5) -> np.ndarray:
    """Sorted hashes of the distinct ``width``-word shingles; a shorter text is one shingle, no words are none."""
    if not words:
        return np.empty(0, _U)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b"\x00".join(words), seed=len(words))], _U)
    return np.unique(window_hashes(cache.of(words), width))


def batches_of(rows: Iterator[dict], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Rows gathered into Arrow batches of up to ``size``."""
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)
