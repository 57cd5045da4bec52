"""Vertical coordinates and stencils as column expressions on packed water columns.

``k`` is a level number column.  Level constants are literal arrays (N is a few dozen),
read with ``get``: everything stays inside generated code, there is no join with a
level table and no lambda.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import SLevels


def _pick(values: tuple[float, ...], k: Column) -> Column:
    return F.get(F.expr(f"array({', '.join(f'{float(v)!r}D' for v in values)})"), k)


def _stretch(levels: SLevels, where: str, k: Column) -> tuple[Column, Column]:
    if where == "rho":
        return _pick(levels.s_rho, k), _pick(levels.cs_r, k)
    if where == "w":
        return _pick(levels.s_w, k), _pick(levels.cs_w, k)
    raise ValueError(f"level position must be 'rho' or 'w', not {where!r}")


def rest_depth(levels: SLevels, where: str, k: Column, h: Column) -> Column:
    """Depth of a level at mean sea level (``z_rho0`` / ``z_w0``)."""
    s, cs = _stretch(levels, where, k)
    hc = F.lit(float(levels.hc))
    if levels.vtransform == 1:
        return hc * (s - cs) + cs * h
    return h * ((hc * s + cs * h) / (hc + h))


def depth(levels: SLevels, where: str, k: Column, h: Column, zeta: Column) -> Column:
    """Depth of a level under the free surface ``zeta`` (``z_rho`` / ``z_w``)."""
    s, cs = _stretch(levels, where, k)
    hc = F.lit(float(levels.hc))
    if levels.vtransform == 1:
        rest = hc * (s - cs) + cs * h
        return rest + zeta * (F.lit(1.0) + rest / h)
    return zeta + (zeta + h) * ((hc * s + cs * h) / (hc + h))


def thickness(levels: SLevels, k: Column, h: Column, zeta: Column | None = None) -> Column:
    """Layer thickness ``dz`` (``dz0`` when ``zeta`` is left out)."""
    if zeta is None:
        return rest_depth(levels, "w", k + 1, h) - rest_depth(levels, "w", k, h)
    return depth(levels, "w", k + 1, h, zeta) - depth(levels, "w", k, h, zeta)


def interface_thickness(levels: SLevels, k: Column, h: Column, zeta: Column | None = None) -> Column:
    """Distance between the centres around interface ``k`` (``dz_w`` / ``dz_w0``).

    Beyond the bottom and top centre the missing neighbour counts as depth 0.
    """

    def centre(m: Column) -> Column:
        z = rest_depth(levels, "rho", m, h) if zeta is None else depth(levels, "rho", m, h, zeta)
        return F.coalesce(z, F.lit(0.0))

    # a column without a free surface has no depths at all, not zero ones
    known = h.isNotNull() if zeta is None else h.isNotNull() & zeta.isNotNull()
    return F.when(known, centre(k) - centre(k - 1))


def ddz(packed: Column, levels: SLevels, k: Column, h: Column, zeta: Column) -> Column:
    """Vertical derivative at interface ``k``; the edge value is repeated outside, so it is
    0 at the bottom and the surface (where the edge cell is present)."""
    top, bottom = k == levels.n, k == 0
    above = F.when(top, F.get(packed, k - 1)).otherwise(F.get(packed, k))
    below = F.when(bottom, F.get(packed, k)).otherwise(F.get(packed, k - 1))
    return F.try_divide(above - below, interface_thickness(levels, k, h, zeta))


def to_centre(at_interface, k: Column) -> Column:
    """Mean of the two interfaces around level ``k``; ``at_interface`` maps k -> column."""
    return F.lit(0.5) * (at_interface(k) + at_interface(k + 1))


def mixing_at_interface(salt: Column, aks: Column, levels: SLevels, k: Column, h: Column, zeta: Column) -> Column:
    """Salinity-variance dissipation ``2 * AKs * (ds/dz)^2`` at interface ``k``."""
    slope = ddz(salt, levels, k, h, zeta)
    return F.lit(2.0) * (F.get(aks, k) * (slope * slope))


def mixing(salt: Column, aks: Column, levels: SLevels, k: Column, h: Column, zeta: Column) -> Column:
    """Dissipation density at level centres (chi)."""
    return to_centre(lambda m: mixing_at_interface(salt, aks, levels, m, h, zeta), k)


def explode_levels(columns: DataFrame, n: int, name: str = "k") -> DataFrame:
    """One row per level; the packed arrays stay reachable for neighbour access."""
    return columns.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
