"""Tables in the folder that driver and executors share, and session settings for Arrow stages."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haloflux.session import shared_folder


def drawn(share: float, *columns: str | Column) -> Column:
    """A share of all rows, drawn by a hash of columns: as many bits as a hash has, so that no share is too small."""
    if share >= 1:
        return F.lit(True)
    return F.shiftrightunsigned(F.xxhash64(*columns), 1) < F.lit(int(share * 2.0**63))


def written(df: DataFrame) -> DataFrame:
    """Writes ``df`` as Parquet below the shared folder and reads it back.

    A lost executor then costs a re-read, not a recomputation, and each later reader scans
    only the columns it needs.  The tables stay until the folder is cleared.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/haloflux-llm/{uuid.uuid4().hex}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def arrow_settings(spark: SparkSession) -> SparkSession:
    """Bounds the rows of an Arrow batch, so that long texts don't fill a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def slots(spark: SparkSession, rows_or_bytes: int, per_slot: int) -> int:
    """Number of partitions for so many rows or bytes."""
    return max(1, -(-int(rows_or_bytes) // per_slot))
