"""Volume, salt, salt-squared and variance content, tendencies, mixing and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ordered
from ..functions import vertical as vt
from ..functions.timeparts import epoch_micros
from ..schema import ControlVolume, SLevels
from .volumes import in_volumes

KEYS = ["cv_id", "ocean_time"]
# fields of the sea surface that cells can carry, with the factor that turns their sum into m^3/s or salt per second
SURFACE = {"swflux": (100.0, 86400.0), "ssflux": ()}
def volume_cells(columns: DataFrame, volumes: list[ControlVolume], levels: SLevels, fields: list[str] | None = None) -> DataFrame:
    """Cells of every volume, one row per level, with ``dV``, ``z_rho`` and the fields.

    ``chi`` among the fields is the dissipation density.  ``swflux`` and ``ssflux`` are
    surface fields: times the cell area, in the row of the uppermost level only.
    """
    fields = fields or ["salt"]
    k, h, zeta = F.col("k"), F.col("h"), F.col("zeta")
    surface = [f for f in fields if f in SURFACE]
    inputs = [f for f in fields if f not in ("chi", "z_rho", *SURFACE)]
    needed = list(dict.fromkeys(inputs + (["salt", "aks"] if "chi" in fields else [])))
    base = in_volumes(columns.select("ocean_time", "j", "i", "h", "zeta", "pm", "pn", *needed, *surface), volumes)
    cells = vt.explode_levels(base, levels.n)
    area = (F.lit(1.0) / F.col("pm")) * (F.lit(1.0) / F.col("pn"))
    out = {f: F.get(F.col(f), k) for f in inputs}
    out |= {f: F.when(k == levels.n - 1, F.col(f) * area) for f in surface}
    if "z_rho" in fields:
        out["z_rho"] = vt.depth(levels, "rho", k, h, zeta)
    if "chi" in fields:
        out["chi"] = vt.mixing(F.col("salt"), F.col("aks"), levels, k, h, zeta)
    return cells.select(
        "cv_id", "ocean_time", "k", "j", "i",
        (vt.thickness(levels, k, h, zeta) * area).alias("dV"),
        *[c.alias(n) for n, c in out.items()],
    )


def _cell_sums(cells: DataFrame, wet_only: bool) -> dict[str, Column]:
    """What is summed over cells, by the name of the sum."""
    s, dv = F.col("salt"), F.col("dV")
    sums = {"V": F.when(s.isNotNull(), dv) if wet_only else dv, "sV": s * dv, "ssV": (s * s) * dv}
    if "chi" in cells.columns:
        sums["chi"] = F.col("chi") * dv
    return sums | {c: F.col(c) for c in SURFACE if c in cells.columns}


def _contents(sums: DataFrame, names: list[str]) -> DataFrame:
    """Sums without a value as 0, surface fluxes in their units, and the mean ``sbar``."""
    out = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in names if c != "V"}
    for c in names:
        for d in SURFACE.get(c, ()):
            out[c] = out[c] / F.lit(d)
    return sums.withColumns(out).withColumn("sbar", F.try_divide(F.col("sV"), F.col("V")))


def volume_means(cells: DataFrame, keys: list[str] | None = None, wet_only: bool = False) -> DataFrame:
    """Volume ``V``, contents ``sV``, ``ssV`` and mean ``sbar``; also the integrated dissipation
    ``chi`` and the surface fluxes when the cells have them.

    ``V`` counts every cell; cells without salinity only drop out of the salt terms unless
    ``wet_only``.
    """
    sums = _cell_sums(cells, wet_only)
    return _contents(cells.groupBy(*(keys or KEYS)).agg(*[F.sum(c).alias(n) for n, c in sums.items()]), list(sums))


# salinity classes in which moments are taken: one unit wide, values beyond the range in the outer ones
_FRESHEST, _SALTIEST = -2, 64


#: Running means and co-moments of a class, updated value by value: no large sums are subtracted, so what is
#: lost is as small as the spread of the class against its width, not the square of it.
_CLASS_MOMENTS = {
    "__w": "sum(CASE WHEN __off IS NOT NULL THEN dV END)",
    "__n": "count(__off)",
    "__mean": "avg(__off)",
    "__sw": "covar_pop(__off, dV)",
    "__ssw": "covar_pop(__off, __off * dV)",
}
# class, weight, weighted mean from the middle of the class, and sum of weighted squared deviations from that mean
_MOMENTS = """CASE WHEN __w IS NOT NULL THEN named_struct(
  'k', __class, 'w', __w, 'mean', __mean + coalesce(try_divide(__n * __sw, __w), 0D),
  'spread', greatest(__n * (__ssw - __mean * __sw) - coalesce(try_divide(__n * __sw * (__n * __sw), __w), 0D), 0D)) END"""
# parallel-axis rule for two sets of moments, means counted from the middle of the first class
_MERGED = """aggregate(__classes, named_struct('w', 0D, 'mean', 0D, 'spread', 0D), (a, c) -> named_struct(
  'w', a.w + c.w,
  'mean', a.mean + (c.k - get(__classes, 0).k + c.mean - a.mean) * coalesce(try_divide(c.w, a.w + c.w), 0D),
  'spread', a.spread + c.spread + power(c.k - get(__classes, 0).k + c.mean - a.mean, 2) * (a.w * coalesce(try_divide(c.w, a.w + c.w), 0D))))"""


def volume_stats(cells: DataFrame, keys: list[str] | None = None, wet_only: bool = False) -> DataFrame:
    """:func:`volume_means` with the variance content ``svarV``.

    The cells are read once.  Each salinity class of a key keeps its weight, mean and squared
    deviation; classes are merged by the parallel-axis rule, so nearly uniform salinity loses no
    digits.  The classes of a key are fewer than a hundred, whatever the number of cells.
    """
    keys = keys or KEYS
    sums = _cell_sums(cells, wet_only)
    salinity_class = f"CAST(greatest({_FRESHEST}, least({_SALTIEST}, floor(salt))) AS int)"
    classes = (
        cells.withColumn("__class", F.expr(salinity_class))
        .withColumn("__off", F.expr("CASE WHEN dV IS NOT NULL THEN salt - (__class + 0.5D) END"))
        .groupBy(*keys, "__class")
        .agg(*[F.sum(c).alias(n) for n, c in sums.items()], *[F.expr(f"{e} AS {n}") for n, e in _CLASS_MOMENTS.items()])
    )
    # only classes with salinity have moments; the others count in the sums
    held = F.expr(f"array_sort(collect_list({_MOMENTS})) AS __classes")
    both = classes.groupBy(*keys).agg(*[F.expr(f"sum({n}) AS {n}") for n in sums], held)
    out = _contents(both, list(sums)).withColumn("__all", F.expr(_MERGED))
    # the mean over all of V differs from that of the wet cells where some cells have no salinity
    svar = "__all.spread + power(get(__classes, 0).k + 0.5D + __all.mean - sbar, 2) * __all.w"
    return out.withColumn("svarV", F.expr(f"coalesce({svar}, 0D)")).drop("__classes", "__all")


_RATES = {"V": "dVdt", "sV": "dsVdt", "ssV": "dssVdt", "svarV": "dsvardt"}


def with_tendencies(stats: DataFrame, dt: float | str = 3600.0, keys: tuple[str, ...] = ("cv_id",), bucket=None) -> DataFrame:
    """Rates of change between consecutive steps, beside the columns of the later step.

    ``dt`` is the output step in seconds; ``'auto'`` divides by the actual distance.  The
    first step of a series has no row.
    """
    present = {c: n for c, n in _RATES.items() if c in stats.columns}
    prev = ordered.with_previous(stats, list(keys), "ocean_time", list(present), bucket)
    prev = prev.where(F.col("ocean_time_prev").isNotNull())
    rates = prev.withColumns({n: rate(c, dt) for c, n in present.items()})
    return rates.drop("ocean_time_prev", *[f"{c}_prev" for c in present])


def tendencies(stats: DataFrame, dt: float | str = 3600.0, keys: tuple[str, ...] = ("cv_id",), bucket=None) -> DataFrame:
    """Only the rates of :func:`with_tendencies`."""
    present = [c for c in _RATES if c in stats.columns]
    steps = stats.select(*keys, "ocean_time", *present)
    return with_tendencies(steps, dt, keys, bucket).drop(*present)


def rate(c: str, dt: float | str) -> Column:
    change = F.col(c) - F.col(f"{c}_prev")
    if dt != "auto":
        return change / F.lit(float(dt))
    micros = epoch_micros(F.col("ocean_time")) - epoch_micros(F.col("ocean_time_prev"))
    return change / (micros / F.lit(1e6))


def class_tendency(dense_hist: DataFrame, value: str, dt: float = 3600.0, keys: tuple[str, ...] = ("cv_id", "salt_idx", "salt_bin"), bucket=None) -> DataFrame:
    """Rate of change of each salinity class (entrainment).  Needs a dense histogram, so
    that a class that empties or fills changes from or to 0."""
    prev = ordered.with_previous(dense_hist, list(keys), "ocean_time", [value], bucket)
    return prev.where(F.col("ocean_time_prev").isNotNull()).select(
        *keys, "ocean_time", rate(value, dt).alias(f"d{value}dt")
    )


def class_changes(
    hist: DataFrame, value: str, classes: list[str], dt: float | str = 3600.0, keys: tuple[str, ...] = ("cv_id",), bucket=None
) -> DataFrame:
    """Rates of change of the classes that are occupied at a step or the one before (entrainment), from a
    sparse histogram.

    ``hist`` holds occupied classes; rows with a NULL class only say that their step exists
    (``announce`` of :func:`histogram.weighted_histogram`).  Each occupied class adds its value at its own
    step and takes it away at the next step of the series, so classes that fill or empty need no rows of
    zeros: with 500 x 500 classes of which a hundred are occupied, some hundred rows a step are
    moved instead of 250,000.  Classes that stay empty have no row.
    """
    keys = list(keys)
    steps = hist.select(*keys, "ocean_time").distinct()
    steps = ordered.with_previous(ordered.with_next(steps, keys, "ocean_time", [], bucket), keys, "ocean_time", [], bucket)
    here = F.struct(F.col("ocean_time").alias("at"), F.col("ocean_time_prev").alias("before"), F.col(value).alias("v"))
    after = F.struct(F.col("ocean_time_next").alias("at"), F.col("ocean_time").alias("before"), (-F.col(value)).alias("v"))
    held = hist.where(~F.greatest(*[F.col(c).isNull() for c in classes], F.lit(False)))
    events = held.join(steps, [*keys, "ocean_time"]).select(*keys, *classes, F.inline(F.array(here, after)))
    sums = (
        events.where("at IS NOT NULL AND before IS NOT NULL")
        .groupBy(*keys, *classes, F.col("at").alias("ocean_time"))
        .agg(F.sum("v").alias("__change"), F.max("before").alias("__before"))
    )
    if dt == "auto":
        length = (epoch_micros(F.col("ocean_time")) - epoch_micros(F.col("__before"))) / F.lit(1e6)
    else:
        length = F.lit(float(dt))
    return sums.select(*keys, *classes, "ocean_time", (F.col("__change") / length).alias(f"d{value}dt"))


def mixing_series(cells: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Volume-integrated dissipation per key."""
    return cells.groupBy(*(keys or KEYS)).agg(F.coalesce(F.sum(F.col("chi") * F.col("dV")), F.lit(0.0)).alias("chi"))


def closure(df: DataFrame, pairs: dict[str, tuple[Column, Column]], keys: list[str], seconds: float = 1.0) -> DataFrame:
    """Sums of two series and their difference in percent of the second, per budget.

    ``pairs`` maps a budget name to (supply, storage); ``seconds`` scales rates to totals.
    """
    sums = []
    for name, (supply, storage) in pairs.items():
        scale = F.lit(float(seconds))
        sums += [
            (F.coalesce(F.sum(supply), F.lit(0.0)) * scale).alias(f"{name}_supply"),
            (F.coalesce(F.sum(storage), F.lit(0.0)) * scale).alias(f"{name}_storage"),
        ]
    out = df.groupBy(*keys).agg(*sums) if keys else df.agg(*sums)
    pct = {
        f"{name}_pct": F.try_divide(F.col(f"{name}_supply") - F.col(f"{name}_storage"), F.col(f"{name}_storage")) * 100.0
        for name in pairs
    }
    return out.withColumns(pct)


def budget_terms(tef: DataFrame, tend: DataFrame, mixing: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """Advection, storage and mixing side by side for every step that has a storage term.

    All inputs are one row per (volume, step) and share their keys.  A step without
    exchange flow or mixing counts as having none.
    """
    keys = keys or KEYS
    out = tend.join(tef, keys, "left")
    filled = [c for c in ("voladv", "saltadv", "ssaltadv", "svaradv") if c in tef.columns]
    if mixing is not None:
        out = out.join(mixing, keys, "left")
        filled.append("chi")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in filled})


STANDARD_BUDGETS = {
    "volume": lambda: (F.col("voladv"), F.col("dVdt")),
    "salt": lambda: (F.col("saltadv"), F.col("dsVdt")),
    "ssalt": lambda: (F.col("ssaltadv") - F.col("chi"), F.col("dssVdt")),
    "svar": lambda: (F.col("svaradv") - F.col("chi"), F.col("dsvardt")),
}


def budget_closure(terms: DataFrame, keys: list[str] | None = None, seconds: float = 1.0) -> DataFrame:
    pairs = {n: p() for n, p in STANDARD_BUDGETS.items()}
    return closure(terms, pairs, ["cv_id"] if keys is None else keys, seconds)


def freshwater_flux(forcing: DataFrame, static: DataFrame, volumes: list[ControlVolume], time: str = "time") -> DataFrame:
    """Net surface water flux (cm/day in, m^3/s out) summed over each volume.

    ``static`` is the grid with ``pm`` and ``pn``, one row per (j, i); AQE broadcasts it
    when its measured size allows.
    """
    area = (F.lit(1.0) / F.col("pm")) * (F.lit(1.0) / F.col("pn"))
    inside = in_volumes(forcing, volumes)
    joined = inside.join(static.select("j", "i", "pm", "pn"), ["j", "i"])
    # the unit change is a constant: applied once per sum, not per cell
    total = F.coalesce(F.sum(F.col("swflux") * area), F.lit(0.0)) / F.lit(100.0) / F.lit(86400.0)
    return joined.groupBy("cv_id", time).agg(total.alias("swflux"))


def surface_salt_flux(columns: DataFrame, volumes: list[ControlVolume], levels: SLevels) -> DataFrame:
    """Surface salt flux (``ssflux``) and the volume flux it implies through the surface
    salinity (``svolflux``), summed over each volume."""
    area = (F.lit(1.0) / F.col("pm")) * (F.lit(1.0) / F.col("pn"))
    surface = F.get(F.col("salt"), F.lit(levels.n - 1))
    inside = in_volumes(columns.select("ocean_time", "j", "i", "pm", "pn", "ssflux", surface.alias("sss")), volumes)
    zero = F.lit(0.0)
    return inside.groupBy(*KEYS).agg(
        F.coalesce(F.sum(F.col("ssflux") * area), zero).alias("ssflux"),
        F.coalesce(F.sum(F.try_divide(F.col("ssflux"), F.col("sss")) * area), zero).alias("svolflux"),
    )


def surface_budget(terms: DataFrame, fluxes: DataFrame | None = None, sign: float = 1.0, keys: list[str] | None = None) -> DataFrame:
    """Per-step budgets with surface forcing.

    ``terms`` comes from :func:`budget_terms`; ``fluxes`` holds ``swflux`` and ``ssflux``
    per step, unless the terms have them already.  ``sign`` is the sign the water flux
    enters the volume budget with.
    """
    joined = terms if fluxes is None else terms.join(fluxes, keys or KEYS)
    sw, ss = F.col("swflux"), F.col("ssflux")
    volume = F.col("voladv") + F.lit(float(sign)) * sw
    return joined.withColumns(
        {
            "volume_supply": volume,
            "volume_residual": F.col("dVdt") - volume,
            "salt_supply": F.col("saltadv") + ss,
            "s2flux": F.try_divide(ss * ss, sw),
            "ssalt_supply": F.col("ssaltadv") + F.try_divide(ss * ss, sw) - F.col("chi"),
        }
    )
