"""Validation of streams: the violations of a row need no state, so the batch expression serves streams as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meetspark.operators.frame import vet
from meetspark.plans.evaluate import Schema


def vet_stream(stream: DataFrame, schema: Schema | str, **options) -> DataFrame:
    """A streaming DataFrame with a column of violations."""
    return vet(stream, schema, **options)


def violation_rates(stream: DataFrame, schema: Schema | str, time_col: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Violations by event-time window, path and cause; windows end by a watermark, so state stays bounded. An extension."""
    found = vet(stream.withWatermark(time_col, late), schema).select(time_col, F.explode_outer("_violations").alias("v")).where(F.col("v").isNotNull())
    return found.groupBy(F.window(time_col, window).alias("window"), F.col("v.path").alias("path"), F.col("v.cause").alias("cause")).agg(F.count(F.lit(1)).alias("n"))


def unique_within(stream: DataFrame, keys: list[str], time_col: str, late: str = "10 minutes") -> DataFrame:
    """Rows whose keys were not seen within the watermark. An extension."""
    return stream.withWatermark(time_col, late).dropDuplicatesWithinWatermark(keys)


def drain(stream: DataFrame, path: str) -> DataFrame:
    """Write all that a stream has to offer now as Parquet under path, with its checkpoint beside it, and read that; a later call adds what has come since."""
    query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")
