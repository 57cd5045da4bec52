"""Results of several tables that appear as one.

Each run writes its parts (data, metadata, ...) below a fresh folder and then adds one row to the small
table of published versions.  That row is one file that a single rename brings into being, so readers
see all parts of a run or none: a run that dies between its writes leaves the version before it
as it was.  Earlier versions stay readable by their number.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import write

DATA = "data"
_PUBLISHED = "number long, version string, published timestamp_ntz"


def published(spark: SparkSession, path: str) -> DataFrame:
    """Versions of a result: number, folder and time of publication; none if there is no result yet."""
    try:
        return spark.read.schema(_PUBLISHED).parquet(f"{path}/published")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _PUBLISHED)


def _latest(versions: DataFrame):
    # two runs that publish at once have the same number: the later folder name wins everywhere
    return versions.agg(F.max(F.struct("number", "version")).alias("v")).first().v


def publish(parts: dict[str, DataFrame], path: str, partition_by: Sequence[str] = (), now: datetime | None = None) -> int:
    """Writes all parts, the one named ``data`` partitioned, and makes them the current version; returns its number."""
    spark = next(iter(parts.values())).sparkSession
    folder = uuid.uuid4().hex
    for name, df in parts.items():
        write(df, f"{path}/{folder}/{name}", partition_by if name == DATA else ())
    before = _latest(published(spark, path))
    number = 1 if before is None else before.number + 1
    stamp = (now or datetime.now(timezone.utc)).replace(tzinfo=None)
    row = spark.createDataFrame([(number, folder, stamp)], _PUBLISHED)
    row.coalesce(1).write.mode("append").parquet(f"{path}/published")
    return number


def read(spark: SparkSession, path: str, part: str = DATA, number: int | None = None) -> DataFrame:
    """A part of the current version, or of an earlier one."""
    versions = published(spark, path)
    found = _latest(versions if number is None else versions.where(F.col("number") == number))
    if found is None:
        raise FileNotFoundError(f"no version {number or ''} is published in {path}")
    return spark.read.parquet(f"{path}/{found.version}/{part}")
