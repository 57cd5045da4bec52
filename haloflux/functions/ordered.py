"""Predecessor, successor and position within ordered series.

The series here are results of aggregation: one row per step (and class), so a group is
as long as the run has steps.  The default is one window per series.

``bucket`` (a calendar unit or a column) is for series too long for one task, or for a
series without keys: rows are ordered inside (key, bucket) groups and one row per bucket
is carried across bucket borders, so a series spreads over as many tasks as it has
buckets.  Its price is a second pass over the ordered rows, which Spark serves from the
same shuffle when both passes read the same columns; pass only the columns needed.  Series
without keys are always ordered by bucket, as a window without keys is one task; by default
quantiles of the times cut it into ``RANGE_BUCKETS`` runs of about equally many rows, however the
samples are spread over its span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .timeparts import epoch_micros, truncate

# bucket of series without keys when none is given
KEYLESS_BUCKET = "range"
RANGE_BUCKETS = 256

_BUCKET, _EDGE, _ROW, _CARRY = "__bucket", "__edge", "__row", "__carry"


def _bucketed(df: DataFrame, time: str, bucket: str | Column) -> DataFrame:
    if isinstance(bucket, str) and bucket == "range":
        at = epoch_micros(F.col(time))
        # one pass with mergeable sketches; read as a constant by every task
        shares = F.array(*[F.lit(k / RANGE_BUCKETS) for k in range(1, RANGE_BUCKETS)])
        borders = df.agg(F.percentile_approx(at, shares, F.lit(100 * RANGE_BUCKETS))).scalar()
        df = df.withColumns({_EDGE: borders, _ROW: at})
        halves = F.array(*[F.lit(1 << k) for k in reversed(range((RANGE_BUCKETS - 1).bit_length()))])

        def further(passed: Column, step: Column) -> Column:
            return F.when(F.get(F.col(_EDGE), passed + step - 1) <= F.col(_ROW), passed + step).otherwise(passed)

        return df.withColumn(_BUCKET, F.aggregate(halves, F.lit(0), further)).drop(_EDGE, _ROW)
    expr = truncate(bucket, F.col(time)) if isinstance(bucket, str) else bucket
    return df.withColumn(_BUCKET, expr)


def _neighbour(df, keys, time, values, bucket, ascending, suffix):
    def ordered(c):
        return F.col(c).asc() if ascending else F.col(c).desc()

    fields = [time, *values]
    if bucket is None and not keys:
        bucket = KEYLESS_BUCKET
    if bucket is None:
        w = Window.partitionBy(*keys).orderBy(ordered(time))
        return df.withColumns({f"{c}{suffix}": F.lag(F.col(c), 1).over(w) for c in fields})
    df = _bucketed(df, time, bucket)
    inner = Window.partitionBy(*keys, _BUCKET).orderBy(ordered(time))
    row = F.struct(*[F.col(c) for c in fields])
    df = df.withColumn(_ROW, F.lag(row, 1).over(inner)).withColumn(
        _EDGE, F.lead(F.col(time), 1).over(inner).isNull()
    )
    across = Window.partitionBy(*keys).orderBy(ordered(_BUCKET))
    carry = df.where(_EDGE).select(*keys, _BUCKET, row.alias(_CARRY))
    carry = carry.withColumn(_CARRY, F.lag(_CARRY, 1).over(across))
    out = df.join(carry, [*keys, _BUCKET], "left").withColumn(_ROW, F.coalesce(F.col(_ROW), F.col(_CARRY)))
    return out.withColumns({f"{c}{suffix}": F.col(_ROW)[c] for c in fields}).drop(_BUCKET, _EDGE, _ROW, _CARRY)


def with_previous(df: DataFrame, keys: list[str], time: str, values: list[str], bucket=None) -> DataFrame:
    """Adds ``<c>_prev`` for the time column and every value column (NULL on the first row)."""
    return _neighbour(df, keys, time, values, bucket, True, "_prev")


def with_next(df: DataFrame, keys: list[str], time: str, values: list[str], bucket=None) -> DataFrame:
    """Adds ``<c>_next`` (NULL on the last row)."""
    return _neighbour(df, keys, time, values, bucket, False, "_next")


def with_position(df: DataFrame, keys: list[str], time: str, name: str = "pos", bucket=None) -> DataFrame:
    """Adds the 0-based position of each row in its series."""
    if bucket is None and not keys:
        bucket = KEYLESS_BUCKET
    if bucket is None:
        w = Window.partitionBy(*keys).orderBy(time)
        return df.withColumn(name, (F.row_number().over(w) - 1).cast("bigint"))
    df = _bucketed(df, time, bucket)
    counts = df.groupBy(*keys, _BUCKET).agg(F.count(F.lit(1)).alias(_EDGE))
    before = Window.partitionBy(*keys).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, _BUCKET, F.coalesce(F.sum(_EDGE).over(before), F.lit(0)).alias(_CARRY))
    inner = Window.partitionBy(*keys, _BUCKET).orderBy(time)
    return (
        df.withColumn(_ROW, F.row_number().over(inner))
        .join(offsets, [*keys, _BUCKET])
        .withColumn(name, (F.col(_CARRY) + F.col(_ROW) - 1).cast("bigint"))
        .drop(_BUCKET, _EDGE, _ROW, _CARRY)
    )
