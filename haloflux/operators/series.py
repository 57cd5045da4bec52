"""Time-series operators: upsampling, low-pass filter, positions."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ordered
from ..functions.timeparts import epoch_micros, from_epoch_micros


def resample_linear(df: DataFrame, keys: list[str], time: str, values: list[str], step: int, bucket=None) -> DataFrame:
    """Linear interpolation onto a regular grid of ``step`` seconds.

    Every sample pairs with its successor and emits the grid points between them, so the
    work is spread over the samples; the last sample emits itself only.
    """
    nxt = ordered.with_next(df.select(*keys, time, *values), keys, time, values, bucket)
    t0, t1, unit = epoch_micros(F.col(time)), epoch_micros(F.col(f"{time}_next")), step * 1_000_000
    first = -F.floor(-t0 / F.lit(unit)) * unit
    last = F.coalesce(t1 - 1, t0)
    points = (
        nxt.withColumns({"__t0": t0, "__t1": t1, "__first": first.cast("bigint"), "__last": last})
        .where(F.col("__first") <= F.col("__last"))
        .withColumn("__t", F.explode(F.sequence("__first", "__last", F.lit(unit).cast("bigint"))))
    )
    share = F.coalesce(F.try_divide(F.col("__t") - F.col("__t0"), F.col("__t1") - F.col("__t0")), F.lit(0.0))

    def between(c: str) -> Column:
        whole = share * (F.col(f"{c}_next") - F.col(c)) + F.col(c)
        return F.when(F.col("__t") == F.col("__t0"), F.col(c)).otherwise(whole)

    return points.select(*keys, from_epoch_micros(F.col("__t")).alias(time), *[between(c).alias(c) for c in values])


def hann(n: int) -> list[float]:
    """Symmetric Hann window."""
    if n == 1:
        return [1.0]
    return [0.5 - 0.5 * math.cos(2.0 * math.pi * m / (n - 1)) for m in range(n)]


# samples of a block of the low-pass filter, unless the kernel is longer
BLOCK = 2048


def lowpass(
    df: DataFrame,
    keys: list[str],
    time: str,
    values: list[str],
    kernel: list[float],
    step: int | None = None,
    bucket=None,
) -> DataFrame:
    """Centred moving average with the given kernel, divided by the kernel sum.

    The series counts as 0 beyond its ends, so the ends are damped; a missing sample or a
    missing value under the kernel makes the result missing.  Output has the rows of the
    input; with ``step``, values of the same time are added up, also where a value is missing.

    Blocks of consecutive samples are packed to arrays.  A sample goes to its own block and, within a
    kernel's reach of the border, to the neighbour, so little more than one row a sample is moved,
    a block holds a bounded number of them, and taps are added in the same order everywhere.
    ``step`` (seconds) is the distance of the samples of a regular series; without it samples are
    numbered first and count as evenly spaced.  The kernel may have any length.
    """
    n = len(kernel)
    if not n:
        raise ValueError("the kernel is empty")
    total = float(sum(kernel))
    lead, size = (n - 1) // 2, max(BLOCK, n)
    if step is None:
        samples = ordered.with_position(df.select(*keys, time, *values), keys, time, "__at", bucket)
        unit = 1
    else:
        # a time that occurs twice is one sample, lest it hides a gap beside it
        once = [F.when(F.count(c) == F.count(F.lit(1)), F.sum(F.col(c).cast("double"))).alias(c) for c in values]
        samples = df.groupBy(*keys, time).agg(*once).withColumn("__at", epoch_micros(F.col(time)))
        unit = step * 1_000_000
    at, slot, phase, block = (F.col(c) for c in ("__at", "__slot", "__phase", "__block"))
    samples = samples.withColumn("__phase", F.pmod(at, F.lit(unit))).withColumn("__slot", F.floor((at - phase) / unit))
    # output m needs the samples m + lead - n + 1 to m + lead
    reached = F.sequence(F.floor((slot - lead) / size), F.floor((slot + (n - 1 - lead)) / size))
    row = F.struct(slot.alias("slot"), F.col(time).alias("time"), *[F.col(c).cast("double").alias(f"v{k}") for k, c in enumerate(values)])
    blocks = (
        samples.withColumn("__block", F.explode(reached))
        .groupBy(*keys, "__phase", "__block")
        .agg(F.array_sort(F.collect_list(row)).alias("__rows"))
    )
    ends = samples.groupBy(*keys).agg(F.min(at).alias("__lo"), F.max(at).alias("__hi"))
    if keys:
        blocks = blocks.join(ends, keys)
    else:
        blocks = blocks.withColumn("__ends", ends.select(F.struct("__lo", "__hi")).scalar()).select("*", "__ends.*")
    rows, first, width = F.col("__rows"), block * size + (lead - n + 1), size + n - 1

    def times(value: float | None, count: Column) -> Column:
        return F.array_repeat(F.lit(value).cast("double"), F.greatest(F.lit(0), F.least(F.lit(width), count)).cast("int"))

    # within the window of a block: places before and after the series, and missing ones up to its first and after its last sample
    before = F.greatest(F.lit(0), F.ceil((F.col("__lo") - phase) / unit) - first)
    after = F.greatest(F.lit(0), first + width - 1 - F.floor((F.col("__hi") - phase) / unit))
    missing = F.get(rows, F.lit(0))["slot"] - first - before, first + width - 1 - F.element_at(rows, -1)["slot"] - after

    def dense(v: str) -> Column:
        def to_next(e: Column, k: Column) -> Column:
            following = F.coalesce(F.get(rows, k + 1)["slot"], e["slot"] + 1)
            return F.concat(F.array(e[v]), times(None, following - e["slot"] - 1))

        return F.concat(times(0.0, before), times(None, missing[0]), F.flatten(F.transform(rows, to_next)), times(None, missing[1]), times(0.0, after))

    fields = [f"v{k}" for k in range(len(values))]
    taps = F.from_json(F.lit(json.dumps([float(w) for w in reversed(kernel)])), "array<double>")
    packed = blocks.withColumns({f"__{v}": dense(v) for v in fields}).withColumn("__taps", taps)

    def filtered(e: Column) -> Column:
        def under_kernel(v: str) -> Column:
            window = F.slice(F.col(f"__{v}"), (e["slot"] - block * size + 1).cast("int"), n)
            products = F.zip_with(window, F.col("__taps"), lambda x, w: x * w)
            return F.aggregate(products, F.lit(0.0), lambda s, x: s + x) / total

        return F.struct(e["time"].alias("time"), *[under_kernel(v).alias(v) for v in fields])

    own = F.filter(rows, lambda e: F.floor(e["slot"] / size) == block)
    out = packed.select(*keys, F.inline(F.transform(own, filtered)))
    return out.select(*keys, F.col("time").alias(time), *[F.col(v).alias(c) for v, c in zip(fields, values)])


def numbered(df: DataFrame, keys: list[str], time: str, name: str = "pos", bucket=None) -> DataFrame:
    """Adds the 0-based position of each row in its series."""
    return ordered.with_position(df, keys, time, name, bucket)


def position_slice(df: DataFrame, keys: list[str], time: str, start: int, stop: int | None = None, bucket=None) -> DataFrame:
    """Rows ``start <= position < stop`` of every series, in time order."""
    at = ordered.with_position(df, keys, time, "__pos", bucket)
    keep = F.col("__pos") >= start
    if stop is not None:
        keep = keep & (F.col("__pos") < stop)
    return at.where(keep).drop("__pos")


def chunk_of_position(position: Column, length: Column, chunks: int) -> Column:
    """Number of the chunk a position falls in when ``length`` steps are cut at
    ``floor(c * (length / chunks))``, the last chunk ending with the series."""

    def start(c: Column) -> Column:
        return F.floor(c * (length / F.lit(float(chunks))))

    # exact in integers; an edge that double arithmetic rounds below a whole number lies
    # one step earlier
    guess = F.floor(((position + 1) * chunks - 1) / length)
    return F.when((guess + 1 < chunks) & (position >= start(guess + 1)), guess + 1).otherwise(guess).cast("int")


def with_chunk_id(df: DataFrame, keys: list[str], time: str, chunks: int, name: str = "chunk_id", bucket=None) -> DataFrame:
    """Cut the steps of each series into ``chunks`` nearly equal runs.

    ``df`` may hold many rows per step: steps are numbered once on their distinct times.
    """
    steps = ordered.with_position(df.select(*keys, time).distinct(), keys, time, "__pos", bucket)
    sizes = steps.groupBy(*keys).agg(F.count(F.lit(1)).alias("__len")) if keys else None
    if keys:
        steps = steps.join(sizes, keys)
    else:
        steps = steps.withColumn("__len", df.select(time).distinct().agg(F.count(F.lit(1))).scalar())
    steps = steps.withColumn(name, chunk_of_position(F.col("__pos"), F.col("__len"), chunks))
    return df.join(steps.select(*keys, time, name), [*keys, time])


def joined_by_position(left: DataFrame, right: DataFrame, keys: list[str], time: str, right_values: list[str], bucket=None) -> DataFrame:
    """Pair two series row by row in time order, whatever their time stamps."""
    a = ordered.with_position(left, keys, time, "__pos", bucket)
    b = ordered.with_position(right, keys, time, "__pos", bucket).select(*keys, "__pos", *right_values)
    return a.join(b, [*keys, "__pos"]).drop("__pos")
