"""Weighted histograms: the aggregate everything else is built on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import BinSpec


def with_bin_index(df: DataFrame, bins: dict[str, BinSpec]) -> DataFrame:
    """Adds the bin number of each named column (NULL out of range)."""
    return df.withColumns({spec.idx: spec.index(F.col(c)) for c, spec in bins.items()})


def weighted_histogram(
    df: DataFrame,
    keys: list[str],
    bins: dict[str, BinSpec],
    weights: dict[str, Column],
    dense: bool = False,
    announce: bool = False,
) -> DataFrame:
    """Sum every weight per key and bin, all weights in one aggregation.

    ``bins`` maps a value column to its bins (one or two of them); the result carries
    ``<name>_idx`` and ``<name>_bin`` (centre) per dimension.  Binning is an expression,
    so scan, binning and map-side aggregation are one stage and at most one row per key
    and occupied bin leaves a task, however skewed the bins are.

    Rows out of range or with a missing value count in no bin.  ``dense=True`` also
    returns empty bins as 0, for every key present in the input.  ``announce=True`` keeps the bins of a
    sample that are known, with 0 and a NULL number for each coordinate out of range: at least one row
    for every key.
    """
    specs = list(bins.values())
    idx = [s.idx for s in specs]
    inside = F.lit(True)
    for c, s in bins.items():
        inside = inside & s.covers(F.col(c))
    if announce:
        weights = {n: F.when(inside, w) for n, w in weights.items()}
    elif not dense:
        df = df.where(inside)
    binned = with_bin_index(df, bins)
    sums = [F.coalesce(F.sum(w), F.lit(0.0)).alias(n) for n, w in weights.items()]
    hist = binned.groupBy(*keys, *idx).agg(*sums)
    if dense:
        hist = fill_bins(hist, keys, specs, list(weights))
    return hist.withColumns({s.bin: s.centre(F.col(s.idx)) for s in specs})


def fill_bins(hist: DataFrame, keys: list[str], specs: list[BinSpec], values: list[str]) -> DataFrame:
    """Dense histogram from occupied bins.

    Rows with a NULL index only announce their key.  Within a key each row also emits the
    empty bins up to the next occupied one, so there is no join with a bin table and a
    group never holds more rows than there are bins.
    """
    size = 1
    for s in specs:
        size *= s.n
    flat = F.lit(0)
    missing = F.lit(False)
    for s in specs:
        flat = flat * s.n + F.col(s.idx)
        missing = missing | F.col(s.idx).isNull()
    hist = hist.withColumn("__at", F.when(missing, F.lit(-1)).otherwise(flat))
    if len(specs) > 1:
        # several out-of-range combinations announce the same key: keep one
        hist = hist.groupBy(*keys, "__at").agg(*[F.first(v).alias(v) for v in values])
    w = Window.partitionBy(*keys).orderBy("__at")
    first = F.when(F.lag("__at").over(w).isNull(), F.lit(0)).otherwise(F.col("__at"))
    upto = F.coalesce(F.lead("__at").over(w), F.lit(size)) - 1
    spans = hist.withColumns({"__from": F.greatest(first, F.lit(0)), "__to": upto})
    rows = spans.where(F.col("__to") >= F.col("__from")).withColumn(
        "__bin", F.explode(F.sequence("__from", "__to"))
    )
    own = F.col("__bin") == F.col("__at")
    out = rows.select(*keys, "__bin", *[F.when(own, F.col(v)).otherwise(F.lit(0.0)).alias(v) for v in values])
    index, rest = {}, F.col("__bin")
    for s in reversed(specs):
        index[s.idx] = F.pmod(rest, F.lit(s.n)).cast("int")
        rest = F.floor(rest / s.n)
    return out.withColumns({s.idx: index[s.idx] for s in specs}).select(*keys, *[s.idx for s in specs], *values)


def dropped_samples(df: DataFrame, keys: list[str], bins: dict[str, BinSpec]) -> DataFrame:
    """How many samples per key fall outside the bins or miss a value."""
    binned = with_bin_index(df, bins)
    outside = F.lit(False)
    for s in bins.values():
        outside = outside | F.col(s.idx).isNull()
    return binned.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_samples"), F.count(F.when(outside, 1)).alias("n_dropped")
    )


def density_histogram(df: DataFrame, column: str, spec: BinSpec, keys: list[str] | None = None, dense: bool = False) -> DataFrame:
    """Histogram over all rows (per key) that integrates to 1 over the bins.

    ``dense`` also returns empty bins, with density 0.
    """
    keys = keys or []
    counts = weighted_histogram(df, keys, {column: spec}, {"n": F.lit(1).cast("bigint")}, dense=dense)
    # one row per bin is left here
    total = F.sum("n").over(Window.partitionBy(*keys))
    width = spec.edge(F.col(spec.idx) + 1) - spec.edge(F.col(spec.idx))
    return counts.withColumn("density", F.try_divide(F.col("n") / total, width)).withColumn(
        "n", F.col("n").cast("bigint")
    )


def quantile_bins(df: DataFrame, column: str, fine: BinSpec, n: int, name: str | None = None) -> BinSpec:
    """At most ``n`` bins with about equally many samples each, their edges being edges of ``fine``.

    One pass with map-side combine; what the driver reads is one row per occupied fine bin, so at
    most ``fine.n``, whatever the size of the data.
    """
    counts = weighted_histogram(df, [], {column: fine}, {"n": F.lit(1).cast("bigint")})
    rows = sorted((r[0], int(r[1])) for r in counts.select(fine.idx, "n").collect())
    if not rows:
        raise ValueError(f"no value of {column} lies in {fine.name} {fine.lo}..{fine.hi}")
    edges, total, seen, k = [fine.edges[rows[0][0]]], sum(c for _, c in rows), 0, 1
    for at, c in rows:
        seen += c
        if seen * n >= k * total:
            edges.append(fine.edges[at + 1])
            k = seen * n // total + 1
    return BinSpec.from_edges(name or column, edges)


def range_histogram(df: DataFrame, column: str, n: int = 50, name: str = "value", dense: bool = False) -> DataFrame:
    """Counts in ``n`` equal bins between the minimum and maximum of the data; with ``dense``
    empty bins as well.

    The range is a scalar subquery: one aggregate over the data, planned with the query
    and read as a constant by every task.
    """
    data = df.select(F.col(column).cast("double").alias("__x")).where(F.col("__x").isNotNull())
    limits = data.agg(F.struct(F.min("__x").alias("lo"), F.max("__x").alias("hi"))).scalar()
    both = data.withColumn("__limits", limits)
    x, lo, hi = F.col("__x"), F.col("__limits")["lo"], F.col("__limits")["hi"]
    width = (hi - lo) / n

    def edge(k: Column) -> Column:
        return F.when(k == n, hi).otherwise(lo + k * width)

    guess = F.least(F.coalesce(F.floor(F.try_divide(x - lo, width)), F.lit(0)), F.lit(n - 1))
    g = F.col("__g")
    exact = F.when(x < edge(g), g - 1).when((x >= edge(g + 1)) & (g + 1 < n), g + 1).otherwise(g)
    k = F.col(f"{name}_idx")
    counts = (
        both.withColumn("__g", guess)
        .withColumn(f"{name}_idx", exact.cast("int"))
        .groupBy(f"{name}_idx")
        .agg(F.min(edge(k)).alias(f"{name}_lo"), F.count(F.lit(1)).alias("n"))
    )
    if not dense:
        return counts
    # a column without values has no range and so no bins
    bins = df.sparkSession.range(n).select(F.col("id").cast("int").alias(f"{name}_idx")).withColumn("__limits", limits)
    bins = bins.where(lo.isNotNull()).select(f"{name}_idx", edge(k).alias(f"{name}_lo"))
    return bins.join(counts.drop(f"{name}_lo"), f"{name}_idx", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("bigint")))
