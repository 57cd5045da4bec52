"""Registered queries: each operator of the library over the supplied tables.

Every query reads whole tables.  Values that are exact in any summation order are
compared bit for bit; others are rounded far above their rounding error.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import timeparts as tp
from ..functions import vertical as vt
from ..operators import analysis, budgets, exchange, grid, histogram, series, volumes
from ..schema import COLUMNS_SCHEMA, BinSpec, ControlVolume
from ..session import shared_folder
from ..sources import adapters as src
from ..sources import ledger, tables, versions
from . import tef

Query = Callable[[SparkSession, str], DataFrame]

SALT = BinSpec("salt", 0.0, 40.0, 80)
TEMP = BinSpec("temp", 0.0, 40.0, 40)
DEPTH = BinSpec("depth", -65.0, 0.0, 52)
GRAD = BinSpec("grad", 0.0, 0.0625, 64)
KEYS = ["cv_id", "ocean_time"]
LEVELS = src.grid_levels()
STEP = 3600.0
# few samples fall in these bins, so some steps have none
NARROW = BinSpec("salt", 36.5, 37.0, 4)
COOL = BinSpec("temp", 2.0, 10.0, 8)
# bins from whose edges those of salinity quantiles are taken
FINE_EDGES = BinSpec("salt", 0.0, 40.0, 640)
# bins whose edges are not binary fractions
FINE_SALT, FINE_TEMP = BinSpec("salt", 0.0, 37.3, 500), BinSpec("temp", 0.1, 39.7, 500)

_REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    _REGISTRY[fn.__name__] = fn
    return fn


def all_queries() -> dict[str, Query]:
    return dict(_REGISTRY)


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    # + 0.0 turns a negative zero into zero
    return df.withColumns({c: F.round(F.col(c), d) + F.lit(0.0) for c, d in digits.items()})


def closed(df: DataFrame, names: list[str], digits: int, pct_digits: int) -> DataFrame:
    """Rounded sums of budgets, and percentages of these: a storage that cancels is 0, not rounding error."""
    df = rounded(df, {f"{n}_{c}": digits for n in names for c in ("supply", "storage")})
    pct = {f"{n}_pct": F.try_divide(F.col(f"{n}_supply") - F.col(f"{n}_storage"), F.col(f"{n}_storage")) * 100.0 for n in names}
    return rounded(df.withColumns(pct), {n: pct_digits for n in pct})


def stepped(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Values to multiples of pi / 10^digits: unlike in decimal rounding, no binary fraction lies halfway between two."""
    steps = {n: F.lit(math.pi * 10.0**-d) for n, d in digits.items()}
    return df.withColumns({n: F.round(F.col(n) / c) * c + F.lit(0.0) for n, c in steps.items()})


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return volumes.tracer_transports(src.tef_samples(spark, d))


def _samples_with_variance(spark: SparkSession, d: str) -> DataFrame:
    base = src.tef_samples(spark, d)
    mean = base.groupBy(*KEYS).agg(F.try_divide(F.sum(F.col("salt") * F.col("dv")), F.sum("dv")).alias("sbar"))
    return volumes.variance_transport(volumes.tracer_transports(base), mean)


# ---- exchange flow ------------------------------------------------------------------


@query
def tef_bulk(spark, d):
    return exchange.exchange_flow_from_samples(_samples(spark, d).drop("qss"), {"salt": SALT}, KEYS)


@query
def tef_net(spark, d):
    return exchange.net_from_samples(_samples(spark, d), {"salt": SALT}, KEYS)


@query
def tef_full_ss(spark, d):
    out = exchange.exchange_flow_from_samples(_samples_with_variance(spark, d), {"salt": SALT}, KEYS)
    return stepped(out, {"Qsvarin": 4, "Qsvarout": 4, "svaradv": 4, "svarin": 7, "svarout": 7})


@query
def tef_steps(spark, d):
    """Steps without a sample in any class have a row with transports of 0."""
    return exchange.exchange_flow_from_samples(_samples(spark, d).drop("qss"), {"salt": NARROW}, KEYS)


@query
def tef_normalized(spark, d):
    samples = volumes.per_cell_volume(_samples_with_variance(spark, d)).select(*KEYS, "face", "salt", "q", "qsvar")
    out = exchange.exchange_flow_from_samples(samples, {"salt": SALT}, KEYS)
    return stepped(out, dict.fromkeys(("Qin", "Qout", "voladv", "Qsvarin", "Qsvarout", "svaradv", "svarin", "svarout"), 8))


@query
def tef_ts(spark, d):
    samples = _samples(spark, d).drop("qss")
    return exchange.exchange_flow_from_samples(samples, {"salt": SALT, "temp": TEMP}, KEYS)


@query
def tef_ts_steps(spark, d):
    """Steps and temperatures without a sample in any salinity class have rows with transports of 0."""
    samples = _samples(spark, d).drop("qss")
    return exchange.exchange_flow_from_samples(samples, {"salt": NARROW, "temp": COOL}, KEYS)


@query
def tef_ts_dense(spark, d):
    """All bins of temperature at every step."""
    samples = _samples(spark, d).drop("qss")
    return exchange.exchange_flow_from_samples(samples, {"salt": NARROW, "temp": COOL}, KEYS, dense=True)


@query
def tef_ts_500(spark, d):
    """Net transport in 500 x 500 classes."""
    net = exchange.net_from_samples(_samples(spark, d).drop("qss"), {"salt": FINE_SALT, "temp": FINE_TEMP}, ["cv_id"])
    return rounded(net, {"salt_bin": 9, "temp_bin": 9})


@query
def tef_depth(spark, d):
    samples = _samples(spark, d).drop("qss")
    return exchange.exchange_flow_from_samples(samples, {"salt": SALT, "z": DEPTH}, KEYS)


@query
def tef_boxes(spark, d):
    g = src.shape(spark, d)
    samples = volumes.face_samples(src.grid_columns(spark, d), g.boxes, LEVELS)
    samples = volumes.tracer_transports(samples).select(*KEYS, "face", "salt", "q", "qs")
    return exchange.exchange_flow_from_samples(samples, {"salt": SALT}, KEYS)


@query
def tef_model_output(spark, d):
    g = src.shape(spark, d)
    out = tef.total_exchange_flow(src.grid_columns(spark, d), [g.box, g.half_open], LEVELS, {"salt": SALT})
    return rounded(
        out.select(*KEYS, "Qin", "Qout", "sin", "sout", "ssaltadv", "Qsvarin", "Qsvarout", "svaradv"),
        {"Qsvarin": 3, "Qsvarout": 3, "svaradv": 3},
    )


@query
def tef_halfopen_mean(spark, d):
    """Inclusive faces, mean salinity over the cells less the last row and column."""
    g = src.shape(spark, d)
    out = tef.total_exchange_flow(src.grid_columns(spark, d), [g.box], LEVELS, {"salt": SALT}, mean_boxes=[g.box.without_last()])
    return rounded(out.select(*KEYS, "Qsvarin", "Qsvarout", "svaradv"), {"Qsvarin": 3, "Qsvarout": 3, "svaradv": 3})


@query
def bin_count_compare(spark, d):
    net = exchange.net_from_samples(_samples(spark, d).drop("qss"), {"salt": SALT}, KEYS)
    return exchange.bin_count_comparison(net, SALT, [20, 40, 80], KEYS)


# ---- histograms ---------------------------------------------------------------------


def _face_hist(df: DataFrame, bins: dict[str, BinSpec], values: list[str], dense: bool = False) -> DataFrame:
    weights = {v: F.col(v) for v in values}
    return histogram.weighted_histogram(df, [*KEYS, "face"], bins, weights, dense=dense)


@query
def hist_vol(spark, d):
    return _face_hist(_samples(spark, d), {"salt": SALT}, ["q"])


@query
def hist_salt(spark, d):
    return _face_hist(_samples(spark, d), {"salt": SALT}, ["qs"])


@query
def hist_ssq(spark, d):
    return _face_hist(_samples(spark, d), {"salt": SALT}, ["qss"])


@query
def hist_svar(spark, d):
    return stepped(_face_hist(_samples_with_variance(spark, d), {"salt": SALT}, {"qsvar": 4}), {"qsvar": 4})


@query
def hist_ts(spark, d):
    return stepped(_face_hist(_samples_with_variance(spark, d), {"salt": SALT, "temp": TEMP}, ["q", "qs", "qsvar"]), {"qsvar": 4})


@query
def hist_sz(spark, d):
    return stepped(_face_hist(_samples_with_variance(spark, d), {"salt": SALT, "z": DEPTH}, ["q", "qs", "qss", "qsvar"]), {"qsvar": 4})


@query
def hist_dense(spark, d):
    weights = {"q": F.col("q"), "qs": F.col("qs")}
    return histogram.weighted_histogram(_samples(spark, d), KEYS, {"salt": SALT}, weights, dense=True)


@query
def hist_dense_ts(spark, d):
    by_year = _samples(spark, d).withColumn("ocean_time", tp.truncate("year", F.col("ocean_time")))
    coarse = {"salt": BinSpec("salt", 0.0, 30.0, 15), "temp": BinSpec("temp", 5.0, 35.0, 15)}
    return histogram.weighted_histogram(by_year, KEYS, coarse, {"q": F.col("q")}, dense=True)


@query
def hist_dropped(spark, d):
    narrow = {"salt": BinSpec("salt", 5.0, 30.0, 50)}
    return histogram.dropped_samples(src.tef_samples(spark, d), ["cv_id"], narrow)


@query
def hist_density(spark, d):
    out = histogram.density_histogram(src.tef_samples(spark, d), "salt", SALT, ["cv_id"])
    return rounded(out, {"density": 12})


@query
def hist_density_dense(spark, d):
    wide = BinSpec("salt", -10.0, 50.0, 120)
    out = histogram.density_histogram(src.tef_samples(spark, d), "salt", wide, ["cv_id"], dense=True)
    return rounded(out, {"density": 12})


@query
def hist_quantile_edges(spark, d):
    """Density in bins of about equally many samples, which are the narrower the more samples there are."""
    samples = src.tef_samples(spark, d)
    spec = histogram.quantile_bins(samples, "salt", FINE_EDGES, 12)
    out = histogram.density_histogram(samples, "salt", spec, ["cv_id"])
    k = F.col("salt_idx")
    return rounded(out.withColumns({"salt_lo": spec.edge(k), "salt_hi": spec.edge(k + 1)}), {"density": 12})


@query
def hist_minmax50(spark, d):
    """All 50 bins of the transport of fully laden items, some of which are empty."""
    laden = src.tef_samples(spark, d).where(F.col("salt") >= 36.75)
    return histogram.range_histogram(laden, "q", 50, "vel", dense=True)


def _cells(spark: SparkSession, d: str, fields: list[str], boxes=None) -> DataFrame:
    g = src.shape(spark, d)
    return budgets.volume_cells(src.grid_columns(spark, d), boxes or [g.box], LEVELS, fields)


@query
def vol_by_salt(spark, d):
    g = src.shape(spark, d)
    cells = _cells(spark, d, ["salt"], g.boxes)
    return histogram.weighted_histogram(cells, KEYS, {"salt": SALT}, {"dV_saltcoord": F.col("dV")})


@query
def saltcontent_by_salt(spark, d):
    g = src.shape(spark, d)
    cells = _cells(spark, d, ["salt"], g.boxes)
    weights = {"dVs_saltcoord": F.col("dV") * F.col("salt")}
    return histogram.weighted_histogram(cells, KEYS, {"salt": SALT}, weights)


@query
def depth_vol_ts(spark, d):
    cells = _cells(spark, d, ["salt", "temp", "z_rho"])
    weights = {"zrh": F.col("z_rho"), "vint": F.col("dV")}
    hist = histogram.weighted_histogram(cells, KEYS, {"salt": SALT, "temp": TEMP}, weights)
    total = analysis.marginal(hist, ["salt_idx", "temp_idx"], ["zrh", "vint"])
    return rounded(analysis.log10_of(total.withColumn("zrh", -F.col("zrh")), ["zrh", "vint"]), {"log_zrh": 10, "log_vint": 10})


@query
def entrainment(spark, d):
    cells = _cells(spark, d, ["salt"])
    hist = histogram.weighted_histogram(
        cells, KEYS, {"salt": BinSpec("salt", 0.0, 40.0, 20)}, {"dV_saltcoord": F.col("dV")}, dense=True
    )
    return budgets.class_tendency(hist, "dV_saltcoord")


@query
def entrainment_ts(spark, d):
    """Change of the volume of each of 500 x 500 classes that is occupied at a step or the one before."""
    cells = _cells(spark, d, ["salt", "temp"])
    bins = {"salt": FINE_SALT, "temp": FINE_TEMP}
    hist = histogram.weighted_histogram(cells, KEYS, bins, {"dV": F.col("dV")}, announce=True)
    return budgets.class_changes(hist.select(*KEYS, "salt_idx", "temp_idx", "dV"), "dV", ["salt_idx", "temp_idx"])


# ---- contents, tendencies, mixing, budgets ------------------------------------------


@query
def cv_volume_stats(spark, d):
    g = src.shape(spark, d)
    return rounded(budgets.volume_stats(_cells(spark, d, ["salt"], [g.box, *g.boxes[1:]])), {"svarV": 0})


@query
def tendencies(spark, d):
    g = src.shape(spark, d)
    out = budgets.tendencies(budgets.volume_stats(_cells(spark, d, ["salt"], g.boxes)))
    return rounded(out, {"dsvardt": 4})


@query
def closure(spark, d):
    g = src.shape(spark, d)
    terms = tef.budget(src.grid_columns(spark, d), g.boxes, LEVELS, SALT, STEP)
    out = budgets.budget_closure(terms, seconds=STEP)
    return closed(out, ["volume", "salt", "ssalt", "svar"], 0, 4)


@query
def chi_series(spark, d):
    g = src.shape(spark, d)
    return rounded(budgets.mixing_series(_cells(spark, d, ["chi"], g.boxes)), {"chi": 6})


@query
def chi_by_salt(spark, d):
    cells = _cells(spark, d, ["salt", "chi"])
    weights = {"chi": F.col("chi") * F.col("dV")}
    return rounded(histogram.weighted_histogram(cells, KEYS, {"salt": SALT}, weights), {"chi": 6})


@query
def chi_ts(spark, d):
    cells = _cells(spark, d, ["salt", "temp", "chi"])
    weights = {"chi": F.col("chi") * F.col("dV")}
    return rounded(histogram.weighted_histogram(cells, KEYS, {"salt": SALT, "temp": TEMP}, weights), {"chi": 6})


@query
def chi_sz(spark, d):
    cells = _cells(spark, d, ["salt", "z_rho", "chi"])
    hist = histogram.weighted_histogram(cells, KEYS, {"salt": SALT, "z_rho": DEPTH}, {"chi": F.col("chi")})
    return rounded(hist, {"chi": 12})


@query
def chi_per_volume(spark, d):
    g = src.shape(spark, d)
    cells = _cells(spark, d, ["salt", "temp", "chi"], g.boxes)
    bins = {"salt": SALT, "temp": TEMP}
    dv = F.col("dV")
    per_cell = F.try_divide(F.col("chi") * dv, dv)
    hist = histogram.weighted_histogram(cells, KEYS, bins, {"chi_unit": per_cell, "dV_saltcoord": dv})
    out = hist.withColumn("chi_per_v", F.try_divide(F.col("chi_unit"), F.col("dV_saltcoord")))
    return rounded(out, {"chi_unit": 12, "chi_per_v": 16})


@query
def surface_flux(spark, d):
    g = src.shape(spark, d)
    cols = src.grid_columns(spark, d)
    static = src.grid_static(cols)
    forcing = cols.select(F.col("ocean_time").alias("time"), "j", "i", "swflux")
    fresh = budgets.freshwater_flux(forcing, static, [g.box]).withColumnRenamed("time", "ocean_time")
    salt = budgets.surface_salt_flux(cols, [g.box], LEVELS)
    return rounded(analysis.aligned([fresh, salt], KEYS), {"swflux": 9, "svolflux": 6})


@query
def surface_forcing(spark, d):
    g = src.shape(spark, d)
    cols = src.grid_columns(spark, d)
    forcing = cols.select(F.col("ocean_time").alias("time"), "j", "i", "swflux")
    out = tef.surface_forcing(forcing, src.grid_static(cols), g.boxes, 86400, skip=1)
    return rounded(out, {"swflux": 8})


def _surface_terms(spark, d):
    g = src.shape(spark, d)
    terms = tef.budget(src.grid_columns(spark, d), [g.box], LEVELS, SALT, STEP, surface=True)
    return budgets.surface_budget(terms)


@query
def surface_budget(spark, d):
    out = _surface_terms(spark, d).select(
        *KEYS, "volume_supply", "volume_residual", "salt_supply", "s2flux", "ssalt_supply"
    )
    return rounded(out, {"volume_supply": 4, "volume_residual": 4, "salt_supply": 4, "s2flux": 4, "ssalt_supply": 2})


@query
def surface_closure(spark, d):
    pairs = {"salt": (F.col("salt_supply"), F.col("dsVdt")), "volume": (F.col("volume_supply"), F.col("dVdt"))}
    out = budgets.closure(_surface_terms(spark, d), pairs, ["cv_id"])
    return closed(out, list(pairs), 3, 3)


# ---- grid ---------------------------------------------------------------------------


@query
def vertical_coords(spark, d):
    cols = src.grid_columns(spark, d).select("ocean_time", "j", "i", "h", "zeta")
    k, h, zeta = F.col("k"), F.col("h"), F.col("zeta")
    out = vt.explode_levels(cols, src.N_LEVELS + 1)
    forms = {}
    for version in (1, 2):
        lev = src.grid_levels(version)
        forms[f"z_w_v{version}"] = vt.depth(lev, "w", k, h, zeta)
        forms[f"z_rho_v{version}"] = vt.depth(lev, "rho", k, h, zeta)
        forms[f"z_w0_v{version}"] = vt.rest_depth(lev, "w", k, h)
    return out.select("ocean_time", "k", "j", "i", *[c.alias(n) for n, c in forms.items()])


@query
def metrics_uv(spark, d):
    static = src.grid_static(src.grid_columns(spark, d))
    m = grid.horizontal_metrics(static)
    names = [f"{a}{p}" for a in ("dx", "dy", "dA") for p in ("", "_u", "_v", "_psi")]
    return rounded(m.select("j", "i", *names), {n: 6 for n in names})


@query
def interp_uv(spark, d):
    return grid.interpolate_levels(src.grid_columns(spark, d), src.N_LEVELS, ["salt"], ["ocean_time"])


@query
def interp_left_extrap(spark, d):
    cols = src.grid_columns(spark, d)
    surface = analysis.at_level(cols.select("ocean_time", "j", "i", "salt"), ["salt"], -1)
    out = grid.interpolate_left(surface, "x", ["salt"], ["ocean_time"], 0, "_x")
    out = grid.interpolate_left(out, "y", ["salt"], ["ocean_time"], 0, "_y")
    return out.select("ocean_time", "j", "i", "salt_x", "salt_y")


@query
def dz_family(spark, d):
    cols = src.grid_columns(spark, d).select("ocean_time", "j", "i", "h", "zeta", "pm", "pn")
    out = grid.interface_geometry(cols, LEVELS)
    k = F.col("k")
    dz = vt.thickness(LEVELS, k, F.col("h"), F.col("zeta"))
    return out.select(
        "ocean_time", "k", "j", "i", "dz_w", "dz_w0", "dV_w",
        dz.alias("dz"), vt.thickness(LEVELS, k, F.col("h")).alias("dz0"),
    )


@query
def staggered_volumes(spark, d):
    cols = src.grid_columns(spark, d).select("ocean_time", "j", "i", "h", "zeta", "pm", "pn")
    return rounded(grid.staggered_table(cols, LEVELS), {"dV": 2})


@query
def rest_volume(spark, d):
    static = src.grid_static(src.grid_columns(spark, d))
    return grid.rest_column_volume(static, LEVELS)


@query
def salt_gradient(spark, d):
    g = src.shape(spark, d)
    cols = src.grid_columns(spark, d).select("ocean_time", "j", "i", "pm", "pn", "salt")
    surface = analysis.at_level(cols, ["salt"], -1)
    out = analysis.gradient_magnitude(surface, "salt", g.ni - 1, g.nj - 1, ["ocean_time"])
    return out.select("ocean_time", "j", "i", "dsdx", "dsdy", "gradmag")


@query
def gradient_stats(spark, d):
    yearly = salt_gradient(spark, d).withColumn("period", tp.truncate("year", F.col("ocean_time")))
    return rounded(histogram.density_histogram(yearly, "gradmag", GRAD, ["period"]), {"density": 9})


def _kinematics(spark, d):
    cols = src.grid_columns(spark, d).withColumn("f", (1 + F.col("j")) / F.lit(16384.0))
    return analysis.surface_kinematics(analysis.surface_velocity_gradients(cols, LEVELS))


@query
def surface_kinematics(spark, d):
    out = _kinematics(spark, d).select("ocean_time", "j", "i", "vorticity", "divergence", "strain")
    return rounded(out, {"vorticity": 8, "divergence": 8, "strain": 8})


@query
def vorticity_stats(spark, d):
    yearly = _kinematics(spark, d).withColumn("period", tp.truncate("year", F.col("ocean_time")))
    hist = histogram.density_histogram(yearly, "vorticity", BinSpec("vorticity", -60.0, 60.0, 60), ["period"])
    return rounded(hist, {"density": 9})


@query
def gradient_boxes(spark, d):
    """Salinity gradient at the surface of each box, from the box and its rim."""
    g = src.shape(spark, d)
    out = analysis.volume_gradient(src.grid_columns(spark, d), g.boxes, "salt", g.ni - 1, g.nj - 1, ["ocean_time"])
    return out.select(*KEYS, "j", "i", "gradmag")


@query
def vorticity_boxes(spark, d):
    """Density of relative vorticity at the surface of each box, from the box and its rim."""
    g = src.shape(spark, d)
    cols = src.grid_columns(spark, d).withColumn("f", (1 + F.col("j")) / F.lit(16384.0))
    out = analysis.volume_kinematics(cols, g.boxes, LEVELS)
    hist = histogram.density_histogram(out, "vorticity", BinSpec("vorticity", -60.0, 60.0, 60), ["cv_id"])
    return rounded(hist, {"density": 9})


# ---- faces and boxes ----------------------------------------------------------------


@query
def face_transport(spark, d):
    g = src.shape(spark, d)
    samples = volumes.face_samples(src.grid_columns(spark, d), [g.box, g.half_open, g.beyond], LEVELS, ())
    return samples.select(*KEYS, "face", "k", "pos", "vel", "q")


@query
def face_tracers(spark, d):
    g = src.shape(spark, d)
    samples = volumes.face_samples(src.grid_columns(spark, d), [g.box, g.half_open, g.beyond], LEVELS, ("salt", "temp"))
    return samples.select(*KEYS, "face", "k", "pos", "salt", "temp", "z")


@query
def face_area_volume(spark, d):
    g = src.shape(spark, d)
    samples = volumes.face_samples(src.grid_columns(spark, d), [g.box], LEVELS, ())
    out = samples.select(*KEYS, "face", "k", "pos", "area", "dv", F.try_divide(F.col("q"), F.col("dv")).alias("q_norm"))
    return rounded(out, {"dv": 3, "q_norm": 9})


@query
def boxes_many(spark, d):
    """Contents of every rectangle of up to two by two unit cells of the grid, in one pass."""
    g = src.shape(spark, d)
    corners = [(j, i, b, a) for b in (0, 1) for a in (0, 1) for j in range(src.NJ - b) for i in range(src.NI - a)]
    boxes = [g.scaled(ControlVolume(n, i, i + a, j, j + b)) for n, (j, i, b, a) in enumerate(corners)]
    cells = budgets.volume_cells(src.grid_columns(spark, d), boxes, LEVELS)
    return budgets.volume_means(cells, ["cv_id"]).select("cv_id", "V", "sV", "ssV")


@query
def boxes_2x2(spark, d):
    g = src.shape(spark, d)
    cols = src.grid_columns(spark, d)
    samples = tef.face_transports(cols, g.boxes, LEVELS, ("salt", "temp"), edge="extrapolate")
    sums = samples.groupBy(*KEYS, "face").agg(
        F.count("q").alias("n"),
        *[F.sum(c).alias(c) for c in ("q", "qs", "qss", "temp", "svar", "qsvar")],
    )
    return rounded(sums, {"svar": 6, "qsvar": 3})


# ---- reductions and series ----------------------------------------------------------


def _net_ts(spark, d):
    return exchange.net_from_samples(_samples(spark, d).drop("qss"), {"salt": SALT, "temp": TEMP}, KEYS)


@query
def marginals(spark, d):
    dims = [["cv_id", "salt_idx"], ["cv_id", "temp_idx"], ["cv_id"]]
    return analysis.marginals(_net_ts(spark, d), dims, ["Qnet", "Qsnet"]).drop("grouping_id")


@query
def max_norm(spark, d):
    total = analysis.marginal(_net_ts(spark, d), ["cv_id", "salt_idx", "temp_idx"], ["Qnet", "Qsnet"])
    return analysis.normalise_by_max(total, ["Qnet", "Qsnet"], ["cv_id"], SALT.n * TEMP.n)


@query
def monthly_norm(spark, d):
    return analysis.period_share_of_max(
        _net_ts(spark, d), ["salt_idx"], ["Qnet", "Qsnet"], ["cv_id"], SALT.n, period="month"
    )


@query
def std_norm(spark, d):
    total = analysis.marginal(_net_ts(spark, d), ["cv_id", "salt_idx", "temp_idx"], ["Qnet", "Qsnet"])
    norm = analysis.normalise_by_max(total, ["Qnet", "Qsnet"], ["cv_id"], SALT.n * TEMP.n)
    out = analysis.dense_std(norm, ["Qnet_norm", "Qsnet_norm"], ["cv_id"], SALT.n * TEMP.n)
    return rounded(out, {"Qnet_norm_std": 9, "Qsnet_norm_std": 9})


@query
def log_hist(spark, d):
    total = analysis.marginal(_net_ts(spark, d), ["cv_id", "salt_idx"], ["Qnet"])
    return rounded(analysis.log10_of(total, ["Qnet"]), {"log_Qnet": 10})


@query
def peak_class(spark, d):
    total = analysis.marginal(_net_ts(spark, d), ["cv_id", "salt_bin"], ["Qnet"])
    return analysis.class_of_maximum(total, "Qnet", ["cv_id"])


@query
def density_ts(spark, d):
    binned = src.tef_samples(spark, d)
    rho = analysis.linear_density(F.col("salt"), F.col("temp"))
    out = binned.groupBy(*KEYS).agg(F.avg(rho).alias("rho_mean"), F.min(rho).alias("rho_min"), F.max(rho).alias("rho_max"))
    return rounded(out, {"rho_mean": 8, "rho_min": 8, "rho_max": 8})


@query
def density_mesh(spark, d):
    """Density on the mesh of the classes that the samples occupy."""
    occupied = histogram.weighted_histogram(
        src.tef_samples(spark, d), [], {"salt": SALT, "temp": TEMP}, {"n": F.lit(1.0)}
    )
    rho = analysis.linear_density(F.col("salt_bin"), F.col("temp_bin"))
    return rounded(occupied.withColumn("rho", rho), {"rho": 8})


@query
def density_full_mesh(spark, d):
    """Density on all pairs of class edges, with the samples of the class above either edge."""
    samples = src.tef_samples(spark, d)
    counted = histogram.weighted_histogram(samples, [], {"salt": SALT, "temp": TEMP}, {"n": F.lit(1).cast("bigint")})
    counted = counted.select(F.col("salt_idx").alias("salt_edge_idx"), F.col("temp_idx").alias("temp_edge_idx"), F.col("n").cast("bigint").alias("n"))
    mesh = analysis.density_mesh(spark, SALT, TEMP).join(counted, ["salt_edge_idx", "temp_edge_idx"], "left")
    return rounded(mesh.withColumn("n", F.coalesce("n", F.lit(0).cast("bigint"))), {"rho": 8})


@query
def resample_linear(spark, d):
    hours = src.hour_series(spark, d)
    daily = hours.groupBy(tp.truncate("day", F.col("ocean_time")).alias("ocean_time")).agg(
        F.sum("xc").cast("double").alias("xc"), F.sum("n").cast("double").alias("n")
    )
    out = series.resample_linear(daily, [], "ocean_time", ["xc", "n"], 3600, bucket="month")
    return rounded(out, {"xc": 4, "n": 6})


@query
def lowpass_hann(spark, d):
    hours = src.hour_series(spark, d).select("ocean_time", F.col("n").cast("double").alias("n"))
    even = series.lowpass(hours, [], "ocean_time", ["n"], series.hann(72), step=3600)
    odd = series.lowpass(hours, [], "ocean_time", ["n"], series.hann(75), bucket="day").withColumnRenamed("n", "n75")
    out = even.withColumnRenamed("n", "n72").join(odd, "ocean_time")
    return rounded(out, {"n72": 8, "n75": 8})


@query
def isohaline_depth(spark, d):
    cols = src.grid_columns(spark, d).select("ocean_time", "j", "i", "h", "zeta", "salt")
    out = analysis.isosurface_depth(cols, "salt", 20.0, LEVELS, "shallowest", "z_shallow")
    out = analysis.isosurface_depth(out, "salt", 20.0, LEVELS, "deepest", "z_deep")
    return out.select("ocean_time", "j", "i", "z_shallow", "z_deep")


@query
def isohaline_mean(spark, d):
    cols = src.grid_columns(spark, d).select("ocean_time", "j", "i", "h", "zeta", "salt")
    out = analysis.isosurface_depth(cols, "salt", 28.4, LEVELS)
    return rounded(analysis.time_mean(out, {"z_iso": F.col("z_iso")}), {"z_iso": 8})


@query
def time_mean_bottom(spark, d):
    cols = src.grid_columns(spark, d).select("ocean_time", "j", "i", "salt", "temp")
    bottom = analysis.at_level(cols, ["salt", "temp"], 0)
    return analysis.time_mean(bottom, {"salt": F.col("salt"), "temp": F.col("temp")})


# ---- tables -------------------------------------------------------------------------


@query
def packed_levels(spark, d):
    """Cells packed to water columns and unpacked again."""
    cols = src.grid_columns(spark, d).select("ocean_time", "j", "i", "salt", "temp", "u", "v")
    return grid.unpack_levels(cols, src.N_LEVELS, ["salt", "temp", "u", "v"])


def _folder(spark: SparkSession) -> str:
    """A fresh folder for what a query writes and reads back."""
    return f"{shared_folder(spark)}/haloflux/{uuid.uuid4().hex}"


def _net(spark, d):
    return exchange.net_from_samples(_samples(spark, d).drop("qss"), {"salt": SALT}, KEYS)


@query
def daily_results(spark, d):
    """Results written by day and a year of them written again; the other days stay."""
    net, path = _net(spark, d), _folder(spark)
    tables.write_daily(net, path)
    again = net.where(tp.at_time("1995")).withColumns({c: F.col(c) * 2 for c in ("Qnet", "Qsnet")})
    tables.write_daily(again, path)
    return tables.scan(spark, path)


@query
def monthly_results(spark, d):
    """Results written by month and summers read back from their partitions."""
    path = _folder(spark)
    tables.write_monthly(_net(spark, d), path)
    return tables.scan(spark, path).where(F.col("month").between(6, 8) & (F.col("year") >= 1994))


@query
def volume_results(spark, d):
    """Results written by volume and two of them read back."""
    path = _folder(spark)
    tables.write_per_volume(_net(spark, d), path)
    return tables.scan(spark, path).where(F.col("cv_id").isin(1, 3))


@query
def chunk_results(spark, d):
    """Steps written in seven chunks, one of them read back."""
    path = _folder(spark)
    tables.write_chunked(_net(spark, d), path, 7, ["cv_id"])
    return tables.scan(spark, path).where("chunk_id = 2").select(*KEYS, "salt_idx", "salt_bin", "Qnet", "chunk_id")


@query
def versioned_results(spark, d):
    """Two published versions of a result with its description; each is read as it was published."""
    net, path = _net(spark, d), _folder(spark)
    for name, some in (("two volumes", net.where("cv_id < 2")), ("all volumes", net)):
        about = tables.run_metadata(spark, name, n_bins={"salt": SALT.n})
        versions.publish({"data": some, "metadata": about}, path, ["cv_id"])
    parts = []
    for number in (1, None):
        about = versions.read(spark, path, "metadata", number).select("description", F.col("n_bins")["salt"].alias("n_bins"))
        sums = versions.read(spark, path, number=number).groupBy("cv_id").agg(F.count(F.lit(1)).alias("n"), F.sum("Qnet").alias("Qnet"))
        # one row describes all of a version
        parts.append(sums.withColumn("about", about.select(F.struct("description", "n_bins")).scalar()).select("cv_id", "n", "Qnet", "about.*"))
    return parts[0].unionByName(parts[1])


@query
def redelivered_days(spark, d):
    """Deliveries of files, one of which brings a year again with other transports."""
    source, target = _folder(spark), _folder(spark)
    samples = src.tef_samples(spark, d).select(*KEYS, "face", "salt", "q")
    early = F.col("ocean_time") < tp.ntz(datetime(1995, 6, 1))

    def build(rows: DataFrame) -> DataFrame:
        return exchange.net_from_samples(rows, {"salt": SALT}, KEYS)

    for rows in (samples.where(early), samples.where(~early), samples.where(tp.at_time("1995")).withColumn("q", F.col("q") * 4)):
        rows.write.mode("append").parquet(source)
        ledger.deliver(spark, source, build, target, rows.schema)
    return ledger.merged(spark, target, [*KEYS, "salt_idx"], ["Qnet"])


@query
def overlapping_files(spark, d):
    """Model output in three deliveries, of which two overlap by half a year; where they do, the later one's files count."""
    path, when = _folder(spark), F.col("ocean_time")
    cols = src.grid_columns(spark, d)
    middle, late = tp.ntz(datetime(1995, 7, 1)), tp.ntz(datetime(1996, 1, 1))
    parts = {"his_1": cols.where(when < tp.ntz(datetime(1994, 1, 1))), "his_2": cols.where((when >= tp.ntz(datetime(1994, 1, 1))) & (when < late)), "his_3": cols.where(when >= middle).withColumn("zeta", F.col("zeta") + 1)}
    for name, part in parts.items():
        # as many files as the delivery has tasks: no task holds a whole delivery
        tables.write(part, f"{path}/{name}")
    read = tables.open_columns(spark, [f"{path}/{name}" for name in parts], cols.schema, overlap="last")
    return read.groupBy("ocean_time").agg(F.count(F.lit(1)).alias("n"), F.sum("zeta").alias("zeta"))


@query
def stored_columns(spark, d):
    """Long cells written, read and packed to water columns, which are written and opened by a glob in the model's schema."""
    path = _folder(spark)
    cols = src.grid_columns(spark, d).withColumns({c: F.lit(None).cast("double") for c in ("f", "lon_rho", "lat_rho")})
    static = ["h", "pm", "pn", "f", "lon_rho", "lat_rho"]
    cells = grid.unpack_levels(cols.select("ocean_time", "j", "i", "salt", "temp", "aks", "u", "v"), src.N_LEVELS + 1, ["salt", "temp", "aks", "u", "v"])
    tables.write(cells, f"{path}/cells")
    still = cols.groupBy("j", "i").agg(*[F.max(c).alias(c) for c in static])
    packed = tables.pack_cells(tables.scan(spark, f"{path}/cells"), cols.select("ocean_time", "j", "i", "zeta", "ssflux"), still, src.N_LEVELS)
    packed = packed.select(COLUMNS_SCHEMA.names)
    for half in (0, 1):
        tables.write(packed.where(F.col("j") % 2 == half), f"{path}/his_{half}")
    opened = tables.open_columns(spark, f"{path}/his_*")
    long = grid.unpack_levels(opened.select("ocean_time", "j", "i", "h", "zeta", "salt", "u"), src.N_LEVELS, ["salt", "u"])
    return long.groupBy("ocean_time", "k").agg(F.count("salt").alias("n"), F.sum("salt").alias("salt"), F.sum("u").alias("u"), F.sum(F.col("h") + F.col("zeta")).alias("depth"))


@query
def merged_results(spark, d):
    """Two result families with partly common keys side by side."""
    samples = src.tef_samples(spark, d)
    fresh = samples.where(F.col("salt") < 1.0).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_fresh"))
    deep = samples.where(F.col("z") < -64.0).groupBy(*KEYS).agg(F.sum("q").alias("q_deep"))
    return tables.merge_results([fresh, deep], KEYS)


@query
def shared_dimensions(spark, d):
    """Columns under location-specific dimension names brought to shared ones, with the reference density where the input has none."""
    cols = src.grid_columns(spark, d).select("ocean_time", F.col("j").alias("eta_u"), F.col("i").alias("xi_v"), "h")
    static = tables.unify_dimensions(cols).groupBy("eta_rho", "xi_rho").agg(F.max("h").alias("h"), F.count(F.lit(1)).alias("n"))
    return grid.with_reference_density(static).withColumn("load", F.col("rho0") * F.col("h"))


@query
def box_area(spark, d):
    g = src.shape(spark, d)
    static = src.grid_static(volumes.in_volumes(src.grid_columns(spark, d), [g.box]))
    static = static.withColumns({"lat": 28.0 + F.col("j") / F.lit(64.0), "lon": -95.0 + F.col("i") / F.lit(64.0)})
    return rounded(analysis.extent(static, ["h", "lat", "lon"]), {"area_km2": 9, "side_km": 9})


@query
def sin_sout_chi(spark, d):
    g = src.shape(spark, d)
    cols = src.grid_columns(spark, d)
    samples = volumes.tracer_transports(volumes.face_samples(cols, [g.box], LEVELS)).select(*KEYS, "face", "salt", "q", "qs")
    flow = exchange.exchange_flow_from_samples(samples, {"salt": SALT}, KEYS).select(*KEYS, "sin", "sout")
    chi = budgets.mixing_series(budgets.volume_cells(cols, [g.box], LEVELS, ["chi"]))
    return rounded(analysis.aligned([flow, chi], KEYS), {"chi": 6})


@query
def time_slices(spark, d):
    hours = series.numbered(src.hour_series(spark, d), [], "ocean_time", "pos", bucket="day")
    day = F.col("ocean_time").cast("date")
    cases: dict[str, Column] = {
        "day": tp.at_time("2024-01-03"),
        "hour": tp.at_time("2024-01-03-07"),
        "instant": tp.at_time("2024-01-20 12:00:00"),
        "month": tp.at_time("2024-01"),
        "days_inclusive": tp.between_times("2024-01-05", "2024-01-06"),
        "stamps_inclusive": tp.between_times("2024-01-02 23:00:00", "2024-01-18 00:00:00"),
        "positions": F.col("pos").between(200, 719),
        "dates_exclusive": (day >= F.lit("2024-01-03").cast("date")) & (day < F.lit("2024-01-10").cast("date")),
    }
    zero = F.lit(0).cast("bigint")
    picked = {n: F.struct(F.lit(n).alias("selection"), F.count_if(c).alias("n"), F.coalesce(F.sum(F.when(c, F.col("xc"))), zero).alias("xc")) for n, c in cases.items()}
    return hours.agg(*[c.alias(n) for n, c in picked.items()]).select(F.inline(F.array(*picked)))


@query
def time_chunks(spark, d):
    samples = src.tef_samples(spark, d).select("ocean_time", "cv_id", "q")
    chunked = series.with_chunk_id(samples, ["cv_id"], "ocean_time", 7)
    return chunked.groupBy("cv_id", "chunk_id").agg(
        F.min("ocean_time").alias("first"), F.max("ocean_time").alias("last"), F.count(F.lit(1)).alias("n"), F.sum("q").alias("q")
    )


@query
def strided_section(spark, d):
    cols = src.grid_columns(spark, d).select("ocean_time", "j", "i", "salt")
    section = analysis.strided(cols.where(F.col("i") == 3), "j", 1, 2)
    return grid.unpack_levels(section, src.N_LEVELS, ["salt"]).where(F.col("salt").isNotNull())


@query
def freq_compare(spark, d):
    hours = src.hour_series(spark, d).select("ocean_time", F.col("xc").cast("double").alias("x"))
    six = hours.groupBy(tp.truncate("day", F.col("ocean_time")).alias("ocean_time")).agg(F.sum("x").alias("x"))
    six = six.where(tp.between_times("2024-01-04", "2024-01-25"))
    runs = hours.withColumn("run_id", F.lit("hourly")).unionByName(six.withColumn("run_id", F.lit("daily")))
    shared = analysis.overlap_of_runs(runs)
    return shared.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("total"), F.max("x").alias("top"))


@query
def positional_pairs(spark, d):
    hours = src.hour_series(spark, d)
    base = hours.select("ocean_time", "xc")
    later = series.position_slice(hours.select("ocean_time", "n"), [], "ocean_time", 1, bucket="day")
    return series.joined_by_position(base, later, [], "ocean_time", ["n"], bucket="day")
