"""Model output that arrives in deliveries, and may arrive again.

A ledger lists what each delivery (batch) brought: file, modification time, and the days in it.  A
delivery is whatever files are new, or changed since, against the ledger.  A day counts as its latest delivery
has it: delivered again, under whatever name, it replaces its former self, whose
partial sums are withdrawn; other days of the same files stay.  When a file is rewritten in place, the unchanged
files that share its days are taken into the delivery, so that a day spread over several files stays whole.

Partial sums of a batch are written first and its ledger rows last.  A delivery that dies in between
leaves no trace: the next one uses the same batch number and overwrites the partial.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .tables import scan, write

_LEDGER = "file string, modified timestamp, day date, batch long"


def _path(c: Column) -> Column:
    # one spelling of the root of local paths
    return F.regexp_replace(c, "^file:/+", "file:/")


def entries(spark: SparkSession, target: str) -> DataFrame:
    """All rows of the ledger; none before the first delivery."""
    try:
        return spark.read.schema(_LEDGER).parquet(f"{target}/ledger")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _LEDGER)


def current(ledger: DataFrame) -> DataFrame:
    """Day and the batch that holds it."""
    return ledger.groupBy("day").agg(F.max("batch").alias("batch"))


def listed(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """File and modification time of all Parquet files below ``paths``; their content isn't read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet")
    files = reader.load([paths] if isinstance(paths, str) else list(paths))
    return files.select(_path(F.col("path")).alias("file"), F.col("modificationTime").alias("modified"))


def deliver(
    spark: SparkSession,
    paths: str | Sequence[str],
    build: Callable[[DataFrame], DataFrame],
    target: str,
    schema: T.StructType | str | None = None,
    time: str = "ocean_time",
) -> int | None:
    """Takes in what is new or changed below ``paths``; returns the number of the batch, None if nothing is.

    ``build`` makes class sums of rows and keeps ``time`` among its keys.  The driver sees the file names of
    one delivery; rows and sums stay distributed.
    """
    ledger, files = entries(spark, target), listed(spark, paths)
    known = ledger.select("file", "modified").distinct()
    fresh = files.join(known, ["file", "modified"], "left_anti")
    names = [r.file for r in fresh.select("file").collect()]
    if not names:
        return None
    held = _days(scan(spark, names, schema), time).join(fresh, "file").select("file", "modified", "day")
    again = known.select("file").distinct().join(fresh, "file")
    former = ledger.join(current(ledger), ["day", "batch"])
    # days of files rewritten in place, as they were and as they are
    lost = former.select("file", "day").join(again, "file").select("file", "modified", "day")
    shared = lost.unionByName(held.join(again.select("file"), "file", "left_semi")).select("day").distinct()
    beside = former.join(shared, "day").join(files, ["file", "modified"], "left_semi").select("file", "modified", "day")
    rows_of = held.unionByName(beside).distinct()
    batch = (ledger.agg(F.max("batch")).first()[0] or 0) + 1
    names += [r.file for r in beside.select("file").distinct().collect()]
    rows = scan(spark, names, schema)
    tagged = rows.withColumns({"__file": _path(F.col("_metadata.file_path")), "__day": F.col(time).cast("date")})
    wanted = rows_of.select(F.col("file").alias("__file"), F.col("day").alias("__day"))
    taken = tagged.join(wanted, ["__file", "__day"], "left_semi").select(*rows.columns)
    write(build(taken).withColumn("batch_id", F.lit(batch)), f"{target}/partials", ["batch_id"], replace="partitions")
    rows_of.unionByName(lost).distinct().withColumn("batch", F.lit(batch).cast("long")).coalesce(1).write.mode("append").parquet(f"{target}/ledger")
    return batch


def _days(rows: DataFrame, time: str) -> DataFrame:
    day = F.col(time).cast("date")
    return rows.select(_path(F.col("_metadata.file_path")).alias("file"), day.alias("day")).where("day IS NOT NULL").distinct()


def merged(spark: SparkSession, target: str, keys: list[str], values: list[str], time: str = "ocean_time") -> DataFrame:
    """Class sums of all days as their latest deliveries have them; ``keys`` include ``time``."""
    partials = spark.read.parquet(f"{target}/partials").withColumn("day", F.col(time).cast("date"))
    held = current(entries(spark, target)).withColumnRenamed("batch", "batch_id")
    return partials.join(held, ["day", "batch_id"], "left_semi").groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])
