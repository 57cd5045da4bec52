"""Reading model output and writing results.

Everything is Parquet in the schemas of :mod:`haloflux.schema`.  Results are partitioned
by day (or month, chunk, volume).  Daily and monthly writers replace just the partitions
they produce, which is what day-at-a-time processing is for; writers of a whole result
replace all of it, so that no partition of an earlier run stays behind.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.grid import pack_levels
from ..operators.series import with_chunk_id
from ..schema import COLUMNS_SCHEMA, DIM_RENAMES, ControlVolume


def scan(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | None = None) -> DataFrame:
    """One file, several files or a glob, concatenated along time."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(*([paths] if isinstance(paths, str) else paths))


#: Overlapping files up to this number are named in the predicate of the scan, so that each file is read by one branch only.
NAMED_FILES = 1000


def file_spans(df: DataFrame, time: str = "ocean_time") -> DataFrame:
    """First and last time of each file of a scan; reads the time column only."""
    return df.groupBy(F.col("_metadata.file_path").alias("file")).agg(F.min(time).alias("first"), F.max(time).alias("last"))


def overlapping(spans: DataFrame) -> DataFrame:
    """Files whose span meets that of another file (equal ends included).

    One row per file in one window, whatever the number of rows in them.
    """
    ordered = Window.orderBy("first", "file")
    before = F.max("last").over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    after = F.lead("first").over(ordered)
    near = spans.withColumns({"__before": before, "__after": after})
    return near.where((F.col("__before") >= F.col("first")) | (F.col("__after") <= F.col("last"))).select("file")


def without_overlap(df: DataFrame, keys: Sequence[str] = ("ocean_time", "j", "i"), time: str = "ocean_time") -> DataFrame:
    """One row per key of tables whose files overlap: the one from the last file by name.

    Faces and cells would otherwise see different ones of two rows, or count both.  Files that share no
    time with others go through as they are; only rows of overlapping files are shuffled.
    ``keys`` include ``time``.  Finding the overlaps is one job over the time column.
    """
    contested = overlapping(file_spans(df, time))
    names = [r.file for r in contested.limit(NAMED_FILES + 1).collect()]
    if not names:
        return df
    file = F.col("_metadata.file_path")
    if len(names) <= NAMED_FILES:
        alone, shared = df.where(~file.isin(names)), df.where(file.isin(names))
    else:
        tagged = df.select("*", file.alias("__file"))
        held = contested.withColumnRenamed("file", "__file")
        alone, shared = (tagged.join(held, "__file", how) for how in ("left_anti", "left_semi"))
        file = F.col("__file")
    # as many rows a key as files overlap there
    latest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("__file")))
    single = shared.select(*df.columns, file.alias("__file")).withColumn("__nth", latest).where("__nth = 1").select(*df.columns)
    return alone.select(*df.columns).unionByName(single)


def open_columns(
    spark: SparkSession,
    paths: str | Sequence[str],
    schema: T.StructType = COLUMNS_SCHEMA,
    clean: bool = True,
    overlap: str = "keep",
) -> DataFrame:
    """Packed model output with NaN turned into NULL.

    ``overlap="last"`` keeps one row per water column and step where files overlap.

    NaN must not get further: it compares greater than every number and poisons sums.
    Tables known to hold none (cleaned at ingest) can be read with ``clean=False``, which
    saves touching every array element.
    """
    df = scan(spark, paths, schema)
    if overlap == "last":
        df = without_overlap(df)
    elif overlap != "keep":
        raise ValueError("overlap must be 'keep' or 'last'")
    return nan_to_null(df) if clean else df


def pack_cells(cells: DataFrame, surface: DataFrame, static: DataFrame, n: int) -> DataFrame:
    """Long cell rows (:data:`~haloflux.schema.CELLS_SCHEMA`) to packed water columns.

    ``surface`` has one row per ``(ocean_time, j, i)``, ``static`` one per ``(j, i)``.
    ``aks`` of a cell row belongs to the interface below the cell; the surface interface
    is a row with ``k = n``.  One shuffle by water column, meant to be done once at
    ingest with the result written.
    """
    keys = ["ocean_time", "j", "i"]
    fields = [f for f in ("salt", "temp", "aks", "u", "v") if f in cells.columns]
    packed = pack_levels(cells, n, fields, keys, interfaces=("aks",))
    return packed.join(surface, keys).join(static, ["j", "i"])


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = (T.DoubleType, T.FloatType)
    clean = {}
    for field in df.schema.fields:
        c = F.col(field.name)
        if isinstance(field.dataType, floats):
            clean[field.name] = F.when(~F.isnan(c), c)
        elif isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, floats):
            clean[field.name] = F.transform(c, lambda x: F.when(~F.isnan(x), x))
    return df.withColumns(clean) if clean else df


def unify_dimensions(df: DataFrame) -> DataFrame:
    """Raw per-location dimension names to the shared ones, where they occur."""
    return df.withColumnsRenamed({a: b for a, b in DIM_RENAMES.items() if a in df.columns})


def merge_results(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Result families with common coordinates side by side; a key missing in one stays, and null keys
    meet like others."""

    def beside(left: DataFrame, right: DataFrame) -> DataFrame:
        other = right.withColumnsRenamed({k: f"__{k}" for k in keys})
        equal = reduce(lambda a, b: a & b, [left[k].eqNullSafe(other[f"__{k}"]) for k in keys])
        joined = left.join(other, equal, "full_outer")
        return joined.withColumns({k: F.coalesce(F.col(k), F.col(f"__{k}")) for k in keys}).drop(*[f"__{k}" for k in keys])

    return reduce(beside, parts)


def write(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite", replace: str = "all") -> None:
    """Write a result, replacing the ``"all"`` of ``path`` or only the ``"partitions"``
    present in ``df``, whatever the session default is.

    Rows are rebalanced on the partition columns first: a partition ends up in few files,
    and AQE splits one that is too large for a task.
    """
    if not partition_by:
        df.write.mode(mode).parquet(path)
        return
    lined_up = df.hint("rebalance", *partition_by)
    writer = lined_up.write.mode(mode).partitionBy(*partition_by)
    writer.option("partitionOverwriteMode", {"all": "static", "partitions": "dynamic"}[replace]).parquet(path)


def write_daily(df: DataFrame, path: str, time: str = "ocean_time", extra: Sequence[str] = ()) -> None:
    """One partition per day; re-running a day replaces that day only."""
    write(df.withColumn("ocean_date", F.col(time).cast("date")), path, [*extra, "ocean_date"], replace="partitions")


def write_monthly(df: DataFrame, path: str, time: str = "ocean_time") -> None:
    out = df.withColumns({"year": F.year(time), "month": F.month(time)})
    write(out, path, ["year", "month"], replace="partitions")


def write_chunked(df: DataFrame, path: str, chunks: int, keys: Sequence[str] = (), time: str = "ocean_time") -> None:
    """The steps of the run cut into ``chunks`` nearly equal parts, one partition each."""
    write(with_chunk_id(df, list(keys), time, chunks), path, ["chunk_id"])


def write_per_volume(df: DataFrame, path: str) -> None:
    write(df, path, ["cv_id"])


def run_metadata(
    spark: SparkSession,
    description: str,
    volumes: Sequence[ControlVolume] = (),
    n_bins: dict[str, int] | None = None,
    units: dict[str, str] | None = None,
    created: datetime | None = None,
) -> DataFrame:
    """One row describing a run, to be written beside its result."""
    schema = (
        "description string, created timestamp_ntz, "
        "volumes array<struct<cv_id int, i0 int, i1 int, j0 int, j1 int, convention string>>, "
        "n_bins map<string,int>, units map<string,string>"
    )
    stamp = (created or datetime.now(timezone.utc)).replace(tzinfo=None)
    boxes = [(v.cv_id, v.i0, v.i1, v.j0, v.j1, v.convention) for v in volumes]
    return spark.createDataFrame([(description, stamp, boxes, n_bins or {}, units or {})], schema)
