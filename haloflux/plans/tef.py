"""Whole analyses from model output to results, each one lazily built plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import budgets, exchange, histogram, series, volumes
from ..schema import BinSpec, ControlVolume, SLevels

KEYS = ["cv_id", "ocean_time"]


def face_transports(
    columns: DataFrame,
    boxes: list[ControlVolume],
    levels: SLevels,
    tracers: tuple[str, ...] = ("salt",),
    edge: str = "mean",
    mean_boxes: list[ControlVolume] | None = None,
) -> DataFrame:
    """Face samples with volume, salt, salt-squared and variance transport.

    ``mean_boxes`` (same ids) are the cells of the mean salinity where these are not those
    of the boxes, such as ``box.without_last()``.
    """
    samples = volumes.tracer_transports(volumes.face_samples(columns, boxes, levels, tracers, edge))
    stats = budgets.volume_means(budgets.volume_cells(columns, mean_boxes or boxes, levels))
    return volumes.variance_transport(samples, stats)


def face_histograms(samples: DataFrame, bins: dict[str, BinSpec], dense: bool = False) -> DataFrame:
    """All transports by face and class in one aggregation."""
    weights = {c: F.col(c) for c in exchange.TRACERS if c in samples.columns}
    return histogram.weighted_histogram(samples, [*KEYS, "face"], bins, weights, dense=dense)


def class_transports(
    columns: DataFrame, boxes: list[ControlVolume], levels: SLevels, bins: dict[str, BinSpec], edge: str = "mean"
) -> DataFrame:
    """Net transports per step and class, with the moments of salinity about the class
    centre (``__d1``, ``__d2``) from which the variance transport follows."""
    tracers = tuple(c for c in bins if c != "z")
    samples = volumes.tracer_transports(volumes.face_samples(columns, boxes, levels, tracers, edge))
    salt = bins["salt"]
    sign = exchange.inward(F.col("face"))
    d = F.col("salt") - salt.centre(salt.index(F.col("salt")))
    q = sign * F.col("q")
    weights = {
        "Qnet": q,
        "Qsnet": sign * F.col("qs"),
        "Qssnet": sign * F.col("qss"),
        "__d1": q * d,
        "__d2": q * (d * d),
    }
    # samples out of the classes of salinity announce their bin of a second coordinate
    return histogram.weighted_histogram(samples, KEYS, bins, weights, announce=len(bins) > 1)


def add_variance_transport(net: DataFrame, stats: DataFrame, salt: BinSpec, every_step: bool = False) -> DataFrame:
    """Adds ``Qsvarnet`` from the class moments and the volume mean ``sbar`` of each step.

    ``every_step`` keeps steps of ``stats`` that have no transport in any class.
    """
    off = F.col(salt.bin) - F.col("sbar")
    return (
        stats.join(net, KEYS, "left" if every_step else "inner")
        .withColumn("Qsvarnet", F.col("__d2") + F.lit(2.0) * off * F.col("__d1") + off * off * F.col("Qnet"))
        .drop("__d1", "__d2")
    )


def total_exchange_flow(
    columns: DataFrame,
    boxes: list[ControlVolume],
    levels: SLevels,
    bins: dict[str, BinSpec],
    edge: str = "mean",
    mean_boxes: list[ControlVolume] | None = None,
) -> DataFrame:
    """Model output to bulk exchange flow of every volume and step.

    A step whose transport lies outside all classes has a row with transports of 0; rows of a second
    coordinate are as in :func:`exchange.exchange_flow`.
    ``mean_boxes`` as in :func:`face_transports`.

    The variance transport of a class follows from its volume, salt and salt-squared
    transport and the volume mean, so face samples are aggregated right after they are
    cut; only the small class sums meet the mean salinity.  Moments are taken about the
    class centre, where they are small.
    """
    stats = budgets.volume_means(budgets.volume_cells(columns, mean_boxes or boxes, levels)).select(*KEYS, "sbar")
    second = next((s for c, s in bins.items() if c != "salt"), None)
    net = add_variance_transport(class_transports(columns, boxes, levels, bins, edge), stats, bins["salt"], every_step=True)
    return exchange.exchange_flow(net, KEYS, second)


def budget(
    columns: DataFrame,
    boxes: list[ControlVolume],
    levels: SLevels,
    salt: BinSpec,
    dt: float | str = 3600.0,
    surface: bool = False,
    bucket=None,
) -> DataFrame:
    """Advection, storage and mixing terms of every volume and step.

    Contents, mean salinity, mixing and, with ``surface``, the water and salt flux through
    the surface are one aggregation of the cells, and its result (one row per step) joins
    the class transports once, carrying the tendencies along as constants of the step.
    The first step of a volume has no tendency and no row; a step without transport in
    any class keeps its storage and mixing.

    ``bucket`` orders long series in pieces (:mod:`haloflux.functions.ordered`).
    """
    flux = list(budgets.SURFACE) if surface else []
    cells = budgets.volume_cells(columns, boxes, levels, ["salt", "chi", *flux])
    steps = budgets.with_tendencies(budgets.volume_stats(cells), dt, bucket=bucket)
    along = ["dVdt", "dsVdt", "dssVdt", "dsvardt", "chi", *flux]
    net = class_transports(columns, boxes, levels, {"salt": salt})
    net = add_variance_transport(net, steps.select(*KEYS, "sbar", *along), salt, every_step=True)
    return exchange.exchange_flow(net, KEYS + along).select(*KEYS, *along, *BULK)


def surface_forcing(
    forcing: DataFrame, static: DataFrame, boxes: list[ControlVolume], step: int, skip: int = 0
) -> DataFrame:
    """Surface water flux of every volume on the time steps of the run.

    The forcing is coarser in time than the run.  Interpolation in time and the sum over
    cells commute, so cells are summed first and only one row per forcing step is
    interpolated.  ``skip`` drops leading steps.
    """
    coarse = budgets.freshwater_flux(forcing, static, boxes)
    fine = series.resample_linear(coarse, ["cv_id"], "time", ["swflux"], step)
    if skip:
        fine = series.position_slice(fine, ["cv_id"], "time", skip)
    return fine.withColumnRenamed("time", "ocean_time")


# bulk columns of a full exchange-flow result
BULK = [
    "Qin", "Qout", "Qsin", "Qsout", "Qssin", "Qssout", "Qsvarin", "Qsvarout",
    "sin", "sout", "ssin", "ssout", "svarin", "svarout",
    "voladv", "saltadv", "ssaltadv", "svaradv",
]
