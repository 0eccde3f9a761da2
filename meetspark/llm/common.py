"""What the operators of this subpackage share: scratch tables, sizing and Arrow helpers."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators of the contracts: space and the control characters tab to carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Rows and bytes of an Arrow batch handed to Python, so that a batch of long texts stays small.
BATCH_ROWS, BATCH_BYTES = 4000, 16 << 20

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small: lowers the session's limits where they are above ours."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, None)
        number = int(now) if now and now.lstrip("-").isdigit() else 0
        if number <= 0 or number > most:
            spark.conf.set(key, str(most))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where it is unset, a folder of this session's own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):  # local-cluster has executors of its own
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="meetspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/meetspark/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which sizes every split of the corpus."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def accuracy(parts: int) -> int:
    """Of approximate percentiles for so many ranges: a hundredth of a range, as far as its summary, of some ten bytes each, stays small."""
    return max(10_000, min(100 * parts, 1_000_000))


def key_bounds(rows: DataFrame, parts: int, key: str = "key") -> tuple[np.ndarray, int | None]:
    """Ascending bounds that cut rows into `parts` ranges of about as many rows by a 64-bit key, and the least key. Reads the key alone."""
    found = rows.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)] or [1.0], accuracy(parts)).alias("bounds"), F.min(key).alias("least")).first()
    return np.unique(np.array(found.bounds or [], dtype=np.int64)), found.least


def release_memory() -> None:
    """Give back to the system what a worker has freed: earlier stages leave their buffers with the allocators."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Python strings of a string column; null is the empty text."""
    return [x or "" for x in column.to_pylist()]


def bytes_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 of a string column; null is the empty text."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def words_of(data: bytes) -> list[bytes]:
    """The words of a UTF-8 text with A-Z lower-cased; bytes.split() separates at just the six separators of WORD_PATTERN."""
    return data.translate(_LOWER).split()


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection on 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def balanced(sizes: list[int], most: int) -> Iterator[slice]:
    """Consecutive slices whose sizes add up to most at the most, or hold one item."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))
