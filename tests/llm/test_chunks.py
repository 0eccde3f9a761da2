from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from meetspark.llm import chunks


def test_hash_is_that_of_spark(spark):
    values = [0, 1, 2, 77, 123456, 2**31 - 1]
    got = [r.h for r in spark.createDataFrame([(x,) for x in values], "x int").select(F.hash("x").alias("h")).collect()]
    assert got == chunks.spark_hash(np.array(values)).tolist()


def test_chunks_are_dealt_evenly(spark):
    rows = chunks.dealt(spark.range(8000), {"id": F.col("id")})
    found = [(r.p, r.chunk) for r in rows.select(F.spark_partition_id().alias("p"), "chunk").collect()]
    n = rows.rdd.getNumPartitions()
    assert Counter(p for p, _ in set(found)) == {p: chunks.PER_PARTITION for p in range(n)}
    assert max(Counter(c for _, c in found).values()) < 1.5 * len(found) / (n * chunks.PER_PARTITION)
    assert len(set(chunks.even_ids(97))) == 97 * chunks.PER_PARTITION
