"""Total exchange flow: net transport per salinity class, then inflow and outflow.

The split into inflow and outflow is by the sign of the *net* transport of a class, so it
must see the complete sum per class.  The two steps are therefore two aggregations: one
per (key, class) with map-side combine, then one over the few classes of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import BinSpec
from .histogram import fill_bins, weighted_histogram

# transport column of a face sample or histogram -> prefix in the results
TRACERS = {"q": "Q", "qs": "Qs", "qss": "Qss", "qsvar": "Qsvar"}
# tracer prefix -> names of the transport-weighted value and of the advection term
_VALUES = {"Qs": ("s", "saltadv"), "Qss": ("ss", "ssaltadv"), "Qsvar": ("svar", "svaradv")}


def inward(face: Column) -> Column:
    """+1 where positive transport enters (west, south), -1 where it leaves (east, north)."""
    return F.when(face.isin("W", "S"), F.lit(1.0)).otherwise(F.lit(-1.0))


def _tracers(df: DataFrame) -> dict[str, str]:
    return {c: p for c, p in TRACERS.items() if c in df.columns}


def net_transport(hist: DataFrame, keys: list[str]) -> DataFrame:
    """Net inward transport per ``keys`` (bin columns included) from a per-face histogram."""
    sign = inward(F.col("face"))
    return hist.groupBy(*keys).agg(
        *[F.coalesce(F.sum(sign * F.col(c)), F.lit(0.0)).alias(f"{p}net") for c, p in _tracers(hist).items()]
    )


def net_from_samples(
    samples: DataFrame, bins: dict[str, BinSpec], keys: list[str], dense: bool = False
) -> DataFrame:
    """The same straight from face samples: the face sign goes into the weight, so faces
    never become rows and the histogram and the divergence are one aggregation."""
    sign = inward(F.col("face"))
    weights = {f"{p}net": sign * F.col(c) for c, p in _tracers(samples).items()}
    return weighted_histogram(samples, keys, bins, weights, dense=dense)


def exchange_flow(net: DataFrame, keys: list[str], second: BinSpec | None = None, dense: bool = False) -> DataFrame:
    """Bulk inflow/outflow per ``keys``, which are all dimensions of ``net`` but salinity.

    Each tracer is split by the sign of its own net transport.  Ratios are NULL where
    there is no inflow (outflow); advection terms count such a side as 0.

    ``second`` is a second binned coordinate, one result row for each of its bins.  A NULL bin stands for
    samples out of its range: it has a row only where a key has no other.  ``dense`` gives every key all
    bins of ``second``.
    """
    present = [p for p in TRACERS.values() if f"{p}net" in net.columns]

    def side(c: Column, keep: Column) -> Column:
        return F.coalesce(F.sum(F.when(keep, c)), F.lit(0.0))

    sums = []
    for p in present:
        c = F.col(f"{p}net")
        sums += [side(c, c > 0).alias(f"{p}in"), side(c, c < 0).alias(f"{p}out")]
    if second is None:
        bulk = net.groupBy(*keys).agg(*sums)
    else:
        bulk = net.groupBy(*keys, second.idx).agg(*sums)
        sides = [c for p in present for c in (f"{p}in", f"{p}out")]
        if dense:
            bulk = fill_bins(bulk, keys, [second], sides)
        else:
            # as many rows as the second coordinate has bins
            alone = F.count(second.idx).over(Window.partitionBy(*keys)) == 0
            bulk = bulk.withColumn("__alone", alone).where(F.col(second.idx).isNotNull() | F.col("__alone")).drop("__alone")
        bulk = bulk.withColumn(second.bin, second.centre(F.col(second.idx)))
    q_in, q_out = F.col("Qin"), F.col("Qout")
    out = {"voladv": q_in + q_out}
    for p in present[1:]:
        value, advection = _VALUES[p]
        into, outof = F.try_divide(F.col(f"{p}in"), q_in), F.try_divide(F.col(f"{p}out"), q_out)
        out[f"{value}in"], out[f"{value}out"] = into, outof
        out[advection] = F.coalesce(q_in * into, F.lit(0.0)) + F.coalesce(q_out * outof, F.lit(0.0))
    return bulk.withColumns(out)


def exchange_flow_from_samples(
    samples: DataFrame, bins: dict[str, BinSpec], keys: list[str], dense: bool = False
) -> DataFrame:
    """Samples to bulk exchange flow.  ``keys`` are cv_id and time; with a second binned
    coordinate (temperature, depth) the result keeps that bin as well.

    Every key present in the samples has a row, and with a second coordinate every bin of it that a
    sample of the key falls in (all bins with ``dense``): where no sample falls in a salinity class,
    transports are 0 and ratios missing.  A key without a sample in any bin of the second coordinate
    has one row whose bin is missing.
    """
    second = next((s for c, s in bins.items() if c != "salt"), None)
    sign = inward(F.col("face"))
    weights = {f"{p}net": sign * F.col(c) for c, p in _tracers(samples).items()}
    return exchange_flow(weighted_histogram(samples, keys, bins, weights, announce=True), keys, second, dense)


def bin_count_comparison(net: DataFrame, fine: BinSpec, counts: list[int], keys: list[str]) -> DataFrame:
    """Exchange flow with several numbers of salinity bins, one result row per count.

    Every count must divide the fine one, so a coarse class is a run of fine classes and
    one histogram serves all counts.
    """
    if any(fine.n % n for n in counts):
        raise ValueError(f"bin counts must divide {fine.n}")
    coarse = F.array(
        *[F.struct(F.lit(n).alias("n_bins"), F.floor(F.col(fine.idx) / (fine.n // n)).alias("at")) for n in counts]
    )
    values = [c for c in net.columns if c.endswith("net")]
    regrouped = (
        net.withColumn("__c", F.explode(coarse))
        .groupBy(*keys, F.col("__c.n_bins").alias("n_bins"), F.col("__c.at").alias("__at"))
        .agg(*[F.sum(v).alias(v) for v in values])
    )
    return exchange_flow(regrouped, [*keys, "n_bins"])
