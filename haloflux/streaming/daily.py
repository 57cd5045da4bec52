"""Incremental histograms: process model output as files arrive.

The streaming form of day-at-a-time processing.  Each micro-batch writes the partial
class sums of its files; a re-run of a batch replaces its own partial, and a run from a new
checkpoint, which starts over with all files, replaces all of them, so restarts never
count a file twice.  Partials of one step may come from several batches, and the split
into inflow and outflow needs complete sums, so :func:`merged` adds partials up first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def checkpoint_location(spark: SparkSession, name: str) -> str:
    """Folder below the cluster's shared ``spark.checkpoint.dir``."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("set spark.checkpoint.dir or pass a checkpoint folder")
    return f"{base.rstrip('/')}/{name}"


def stream_histogram(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    build: Callable[[DataFrame], DataFrame],
    target: str,
    checkpoint: str | None = None,
    name: str = "haloflux-histogram",
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Run ``build`` (rows to class sums) over every file not processed yet, then stop.

    ``build`` may be any operator that only adds up, such as
    :func:`~haloflux.operators.histogram.weighted_histogram` or
    :func:`~haloflux.operators.exchange.net_from_samples`.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def save(batch: DataFrame, batch_id: int) -> None:
        # the first batch of a checkpoint clears what another checkpoint has left
        replaced = "dynamic" if batch_id else "static"
        writer = build(batch).withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").partitionBy("batch_id")
        writer.option("partitionOverwriteMode", replaced).parquet(target)

    return (
        reader.parquet(source)
        .writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint or checkpoint_location(spark, name))
        .trigger(availableNow=True)
        .start()
    )


def merged(spark: SparkSession, target: str, keys: list[str], values: list[str]) -> DataFrame:
    """Complete class sums from all partials."""
    partials = spark.read.parquet(target)
    return partials.groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])
