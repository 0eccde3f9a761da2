"""Corpus-wide lookups for whole texts: what a chunk of documents needs to know about its keys comes back to the chunk.

Documents are dealt into chunks. Each chunk asks about its distinct keys, packed into a blob for each of some ranges; the
blobs of a range meet in one task, which answers each chunk in the order of its question; answers then meet the chunk's
texts. Only distinct keys of a chunk travel, packed, and no task holds more than a chunk or a range. Spark shuffles the texts once and
reads that shuffle twice.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meetspark.llm.common import partitions

#: Chunks for each shuffle partition, so that a chunk stays small.
PER_PARTITION = 2


def spark_hash(x: np.ndarray) -> np.ndarray:
    """Spark's hash (Murmur3 with seed 42) of 32-bit integers, by which it deals them to partitions."""
    turn = lambda v, r: v << np.uint32(r) | v >> np.uint32(32 - r)
    k = turn(x.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
    h = turn(np.uint32(42) ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(4)
    h = (h ^ h >> np.uint32(16)) * np.uint32(0x85EBCA6B)
    h = (h ^ h >> np.uint32(13)) * np.uint32(0xC2B2AE35)
    return (h ^ h >> np.uint32(16)).view(np.int32)


def even_ids(n: int, each: int = PER_PARTITION) -> list[int]:
    """Numbers that Spark's hash deals evenly to n partitions, `each` to every one."""
    size = n * (each + 4 + 2 * max(1, n).bit_length()) + 64
    while True:
        place = np.mod(spark_hash(np.arange(size)).astype(np.int64), n)
        order = np.argsort(place, kind="stable")
        counts = np.bincount(place, minlength=n)
        if counts.min() >= each:
            first = np.cumsum(counts) - counts
            return np.sort(order[(first[:, None] + np.arange(each)).ravel()]).tolist()
        size *= 2


def dealt(documents: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """The columns with a column chunk, clustered by it, as many chunks in each partition. Rows are dealt one by one: neither equal ids nor copies gather."""
    n = partitions(documents.sparkSession)
    ids = F.array(*[F.lit(i) for i in even_ids(n)])
    rows = documents.select(*(c.alias(x) for x, c in columns.items()), F.monotonically_increasing_id().alias("_ms_row"))
    return rows.withColumn("chunk", F.get(ids, F.pmod(F.xxhash64("_ms_row"), F.lit(PER_PARTITION * n)).cast("int"))).drop("_ms_row").repartition(n, "chunk")
