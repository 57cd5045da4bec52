"""Reductions and diagnostics on histograms, columns and series."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vertical as vt
from ..functions.timeparts import truncate
from ..schema import BinSpec, ControlVolume, SLevels
from .grid import centred_gradient, mean2, with_neighbours
from .volumes import stencil_in_volumes


def marginal(df: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Sum over every dimension but ``keys``."""
    sums = [F.coalesce(F.sum(v), F.lit(0.0)).alias(v) for v in values]
    return df.groupBy(*keys).agg(*sums) if keys else df.agg(*sums)


def marginals(df: DataFrame, sets: list[list[str]], values: list[str]) -> DataFrame:
    """Several marginal sums in one scan; dimensions summed over are NULL."""
    dims = list(dict.fromkeys(c for s in sets for c in s))
    grouped = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in dims])
    level = F.grouping_id().alias("grouping_id")
    return grouped.agg(level, *[F.coalesce(F.sum(v), F.lit(0.0)).alias(v) for v in values])


def normalise_by_max(summed: DataFrame, values: list[str], by: list[str], n_bins: int) -> DataFrame:
    """Divide each value by its maximum over the bins of ``by``.

    ``summed`` holds the time sum of every occupied bin; unoccupied ones are 0 and take
    part in the maximum.  At most ``n_bins`` rows per group are left at this point.
    """
    w = Window.partitionBy(*by)
    some_empty = F.count(F.lit(1)).over(w) < n_bins

    def top(v: str) -> Column:
        m = F.max(v).over(w)
        return F.when(some_empty, F.greatest(m, F.lit(0.0))).otherwise(m)

    return summed.withColumns({f"{v}_norm": F.try_divide(F.col(v), top(v)) for v in values})


def period_share_of_max(df: DataFrame, dims: list[str], values: list[str], by: list[str], n_bins: int, period: str = "month", time: str = "ocean_time") -> DataFrame:
    """Sum per period and bin, divided by the maximum of the whole-time sum.

    The whole-time sum is taken from the period sums, so the data is read once.
    """
    per = marginal(df.withColumn("period", truncate(period, F.col(time))), [*by, "period", *dims], values)
    whole = marginal(per, [*by, *dims], values)
    tops = whole.groupBy(*by).agg(
        F.count(F.lit(1)).alias("__n"), *[F.max(v).alias(f"__max_{v}") for v in values]
    )
    joined = per.join(tops, by)

    def top(v: str) -> Column:
        m = F.col(f"__max_{v}")
        return F.when(F.col("__n") < n_bins, F.greatest(m, F.lit(0.0))).otherwise(m)

    out = joined.withColumns({f"{v}_norm": F.try_divide(F.col(v), top(v)) for v in values})
    return out.drop("__n", *[f"__max_{v}" for v in values])


def dense_std(sparse: DataFrame, values: list[str], by: list[str], n_bins: int) -> DataFrame:
    """Population standard deviation over all bins, empty ones counting as 0.

    Empty bins enter through the bin count instead of being written out; the mean is taken
    off before squaring.
    """
    w = Window.partitionBy(*by)
    means = {f"__m_{v}": F.sum(v).over(w) / F.lit(float(n_bins)) for v in values}
    centred = sparse.withColumns(means)
    aggs = []
    for v in values:
        d, m = F.col(v) - F.col(f"__m_{v}"), F.first(f"__m_{v}")
        empty = F.lit(float(n_bins)) - F.count(F.col(v))
        aggs.append(F.sqrt((F.sum(d * d) + empty * m * m) / F.lit(float(n_bins))).alias(f"{v}_std"))
    return centred.groupBy(*by).agg(*aggs)


def log10_of(df: DataFrame, values: list[str]) -> DataFrame:
    """Decimal logarithm; NULL for 0 and negative values."""
    return df.withColumns({f"log_{v}": F.log10(F.when(F.col(v) > 0, F.col(v))) for v in values})


def linear_density(salt: Column, temp: Column) -> Column:
    """Potential density anomaly from a linear equation of state.

    Fixed values: reference density 1027 kg/m^3 at 35 g/kg and 25 deg C, haline
    contraction 7.6e-4, thermal expansion 1.7e-4.
    """
    return F.lit(1027.0) * (
        (F.lit(1.0) + F.lit(7.6 * 10**-4) * (salt - F.lit(35.0))) - F.lit(1.7 * 10**-4) * (temp - F.lit(25.0))
    ) - F.lit(1000.0)


def density_mesh(spark, salt: BinSpec, temp: BinSpec) -> DataFrame:
    """Density on every pair of salinity and temperature edges (the mesh itself is the
    result, so its size is ``(n+1) * (m+1)`` by definition)."""
    n, m = salt.n + 1, temp.n + 1
    at = F.col("id")
    grid = spark.range(n * m).select(
        F.floor(at / m).cast("int").alias("salt_edge_idx"), F.pmod(at, F.lit(m)).cast("int").alias("temp_edge_idx")
    )
    grid = grid.withColumns({"salt": salt.edge(F.col("salt_edge_idx")), "temp": temp.edge(F.col("temp_edge_idx"))})
    return grid.withColumn("rho", linear_density(F.col("salt"), F.col("temp")))


def isosurface_depth(columns: DataFrame, field: str, value: float, levels: SLevels, crossing: str = "shallowest", name: str = "z_iso") -> DataFrame:
    """Depth at which ``field`` equals ``value`` in each water column; NULL if nowhere.

    A level that holds the value exactly counts as a crossing.  With several crossings
    ``crossing`` chooses ``shallowest``, ``deepest`` or ``all`` (an array from the bottom
    up).  Columns are packed, so this is a projection.
    """
    h, zeta = F.col("h"), F.col("zeta")
    target = F.lit(float(value))

    def crossings(k: Column) -> Column:
        a, b = F.get(F.col(field), k) - target, F.get(F.col(field), k + 1) - target
        za, zb = vt.depth(levels, "rho", k, h, zeta), vt.depth(levels, "rho", k + 1, h, zeta)
        return F.when(a == 0, za).when(a * b < 0, za - a * (zb - za) / (b - a))

    found = F.array_compact(F.transform(F.sequence(F.lit(0), F.lit(levels.n - 1)), crossings))
    pick = {"shallowest": F.array_max, "deepest": F.array_min, "all": lambda c: c}
    if crossing not in pick:
        raise ValueError("crossing must be 'shallowest', 'deepest' or 'all'")
    return columns.withColumn(name, pick[crossing](found))


def time_mean(columns: DataFrame, fields: dict[str, Column], keys: list[str] | None = None) -> DataFrame:
    """Mean over time per grid position, skipping missing values."""
    return columns.groupBy(*(keys or ["j", "i"])).agg(*[F.avg(c).alias(n) for n, c in fields.items()])


def at_level(columns: DataFrame, fields: list[str], level: int) -> DataFrame:
    """One level of packed fields (0 is the bottom, -1 the surface)."""
    def pick(f: str) -> Column:
        c = F.col(f)
        return F.get(c, F.size(c) + level) if level < 0 else F.get(c, F.lit(level))

    return columns.withColumns({f: pick(f) for f in fields})


def strided(df: DataFrame, column: str, start: int, step: int) -> DataFrame:
    """Every ``step``-th index from ``start`` on."""
    c = F.col(column)
    return df.where((c >= start) & (F.pmod(c - start, F.lit(step)) == 0))


def extent(static: DataFrame, fields: list[str]) -> DataFrame:
    """Plan area in km^2, its equivalent side in km, and min/max/mean of the given fields."""
    area = F.sum((F.lit(1.0) / F.col("pm")) * (F.lit(1.0) / F.col("pn"))) / F.lit(1e6)
    stats = [agg(F.col(f)).alias(f"{f}_{n}") for f in fields for n, agg in (("min", F.min), ("max", F.max), ("mean", F.avg))]
    return static.agg(area.alias("area_km2"), *stats).withColumn("side_km", F.sqrt("area_km2"))


def gradient_magnitude(surface: DataFrame, field: str, last_i: int, last_j: int, keys: list[str], name: str = "gradmag") -> DataFrame:
    """Magnitude of the horizontal gradient at cell centres of a one-level field."""
    gx = centred_gradient(surface, field, "x", F.lit(1.0) / F.col("pm"), last_i, keys, "__gx")
    gy = centred_gradient(gx, field, "y", F.lit(1.0) / F.col("pn"), last_j, keys, "__gy")
    gx_, gy_ = F.col("__gx"), F.col("__gy")
    return gy.withColumn(name, F.sqrt(gx_ * gx_ + gy_ * gy_)).withColumnsRenamed({"__gx": "dsdx", "__gy": "dsdy"})


#: How far the stencils reach: neighbours of a column that its gradient, and its corner's velocity gradients, depend on.
GRADIENT_REACH, KINEMATICS_REACH = 1, 2


def volume_gradient(columns: DataFrame, volumes: list[ControlVolume], field: str, last_i: int, last_j: int, keys: list[str], level: int = -1) -> DataFrame:
    """:func:`gradient_magnitude` of one level (the surface) of each volume, reading no more than the volumes and their rims."""

    def stencil(near: DataFrame) -> DataFrame:
        one_level = at_level(near.select(*keys, "j", "i", "pm", "pn", field), [field], level)
        return gradient_magnitude(one_level, field, last_i, last_j, keys)

    return stencil_in_volumes(columns, volumes, GRADIENT_REACH, stencil)


def volume_kinematics(columns: DataFrame, volumes: list[ControlVolume], levels: SLevels) -> DataFrame:
    """:func:`surface_kinematics` at the corners of the columns of each volume, likewise."""

    def stencil(near: DataFrame) -> DataFrame:
        return surface_kinematics(surface_velocity_gradients(near, levels))

    return stencil_in_volumes(columns, volumes, KINEMATICS_REACH, stencil)


def aligned(series: list[DataFrame], keys: list[str]) -> DataFrame:
    """Series with common keys side by side, on the steps all of them have."""
    return reduce(lambda a, b: a.join(b, keys), series)


def class_of_maximum(hist: DataFrame, value: str, by: list[str], bin_column: str = "salt_bin") -> DataFrame:
    """The bin in which a histogram peaks; of equal peaks the lowest bin."""
    top = F.max(value).over(Window.partitionBy(*by))
    peaks = hist.withColumn("__top", top).where(F.col(value) == F.col("__top"))
    return peaks.groupBy(*by).agg(F.min(bin_column).alias(bin_column), F.max(value).alias(value))


def overlap_of_runs(runs: DataFrame, run: str = "run_id", time: str = "ocean_time") -> DataFrame:
    """Rows of all runs within the period that every run covers (both ends included).

    Spans are one row per run; these few rows know the limits, and rows get them through their run.
    """
    spans = runs.groupBy(run).agg(F.min(time).alias("__lo"), F.max(time).alias("__hi"))
    every = Window.partitionBy()
    limits = spans.select(run, F.max("__lo").over(every).alias("__lo"), F.min("__hi").over(every).alias("__hi"))
    met = runs.join(limits, run)
    return met.where(F.col(time).between(F.col("__lo"), F.col("__hi"))).select(*runs.columns)


def surface_velocity_gradients(columns: DataFrame, levels: SLevels) -> DataFrame:
    """Horizontal velocity gradients at the corner points of the uppermost layer.

    Gradients are taken at constant depth: vertical shear times the slope of the
    terrain-following layer is subtracted from the difference along the layer.  Only the
    two uppermost layers are read, and all steps along one axis share a shuffle.
    """
    n, keys, c = levels.n, ["ocean_time"], F.col
    h, zeta = c("h"), c("zeta")

    def along(near: str, far: str, q: str, z: str, shear: str) -> Column:
        """Difference of ``q`` from ``near`` to ``far`` at constant depth."""
        q0, q1, z0, z1, s0, s1 = (c(f"{name}{end}") for name in (q, z, shear) for end in (near, far))
        return (q1 - q0) - mean2(s0, s1) * (z1 - z0)

    def shear(q: str, z: str) -> Column:
        return F.try_divide(c(f"{q}1") - c(f"{q}2"), c(f"{z}1") - c(f"{z}2"))

    top = columns.select(
        "ocean_time", "j", "i", "pm", "pn", "f",
        *[F.get(c(q), F.lit(n - m)).alias(f"{q}{m}") for q in ("u", "v") for m in (1, 2)],
        *[vt.depth(levels, "rho", F.lit(n - m), h, zeta).alias(f"z{m}") for m in (1, 2)],
    )
    x = with_neighbours(top, "x", ["z1", "z2"], keys)
    x = x.withColumns({f"zu{m}": mean2(c(f"z{m}"), c(f"z{m}_next")) for m in (1, 2)}).drop("z1_next", "z2_next")
    x = x.withColumn("su", shear("u", "zu"))
    x = with_neighbours(x, "x", ["u1", "zu1", "su"], keys, back=True)
    x = x.withColumn("dudx", along("_back", "", "u1", "zu1", "su") * c("pm"))
    x = x.drop(*[f"{q}{e}" for q in ("u1", "zu1", "su") for e in ("_next", "_back")])

    y = with_neighbours(x, "y", ["z1", "z2"], keys)
    y = y.withColumns({f"zv{m}": mean2(c(f"z{m}"), c(f"z{m}_next")) for m in (1, 2)}).drop("z1_next", "z2_next")
    y = y.withColumn("sv", shear("v", "zv"))
    y = with_neighbours(y, "y", ["v1", "zv1", "sv"], keys, back=True)
    y = y.withColumn("dvdy", along("_back", "", "v1", "zv1", "sv") * c("pn"))
    y = y.drop(*[f"{q}{e}" for q in ("v1", "zv1", "sv") for e in ("_next", "_back")])
    centred = ["dudx", "dvdy", "pm", "pn", "f"]
    y = with_neighbours(y, "y", ["u1", "zu1", "su", *centred], keys)
    y = y.withColumns(
        {"du": along("", "_next", "u1", "zu1", "su"), **{f"m_{q}": mean2(c(q), c(f"{q}_next")) for q in centred}}
    )
    y = y.select(*keys, "j", "i", "v1", "zv1", "sv", "du", *[f"m_{q}" for q in centred])

    psi = with_neighbours(y, "x", ["v1", "zv1", "sv", *[f"m_{q}" for q in centred]], keys)
    at = {q: mean2(c(f"m_{q}"), c(f"m_{q}_next")) for q in centred}
    return psi.select(
        *keys, "j", "i", at["f"].alias("f"), at["dudx"].alias("dudx"), at["dvdy"].alias("dvdy"),
        (c("du") * at["pn"]).alias("dudy"), (along("", "_next", "v1", "zv1", "sv") * at["pm"]).alias("dvdx"),
    )


def surface_kinematics(gradients: DataFrame) -> DataFrame:
    """Relative vorticity, divergence and lateral strain in units of the Coriolis
    parameter."""
    ux, uy, vx, vy, f = (F.col(n) for n in ("dudx", "dudy", "dvdx", "dvdy", "f"))
    strain = F.sqrt((ux - vy) * (ux - vy) + (vx + uy) * (vx + uy))
    return gradients.withColumns(
        {
            "vorticity": F.try_divide(vx - uy, f),
            "divergence": F.try_divide(ux + vy, f),
            "strain": F.try_divide(strain, f),
        }
    )
