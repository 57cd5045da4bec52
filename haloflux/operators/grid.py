"""Staggered-grid operators on packed water columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vertical as vt
from ..schema import RHO0_DEFAULT, SLevels

_AXES = {"x": ("i", "j"), "y": ("j", "i")}


def pack_levels(cells: DataFrame, n: int, fields: list[str], keys: list[str], interfaces: tuple[str, ...] = ()) -> DataFrame:
    """Long ``(.., k, field..)`` rows to one row per ``keys`` with an array per field.

    Levels without a row become NULL entries.  Fields named in ``interfaces`` get
    ``n + 1`` entries.  Fixed-width conditional aggregates keep this in hash aggregation,
    and the buffer of a group is exactly the packed row.
    """
    slots = {f: n + 1 if f in interfaces else n for f in fields}
    aggs = [F.expr(f"max(CASE WHEN k = {k} THEN `{f}` END) AS `__{f}_{k}`") for f, m in slots.items() for k in range(m)]
    arrays = [f"array({', '.join(f'`__{f}_{k}`' for k in range(m))}) AS `{f}`" for f, m in slots.items()]
    return cells.groupBy(*keys).agg(*aggs).selectExpr(*keys, *arrays)


def unpack_levels(columns: DataFrame, n: int, fields: list[str]) -> DataFrame:
    """Packed arrays back to one row per level."""
    others = [c for c in columns.columns if c not in fields]
    long = vt.explode_levels(columns, n)
    return long.select(*others, "k", *[F.get(F.col(f), F.col("k")).alias(f) for f in fields])


def with_neighbours(df: DataFrame, axis: str, fields: list[str], keys: list[str], back: bool = False, ahead: str = "_next") -> DataFrame:
    """Adds ``<field>_next`` (and ``<field>_back``) from the adjacent column along ``axis``.

    Groups are single grid lines (one row per column, never per cell).  A neighbour only
    counts when its index is adjacent, so gaps in the table read as missing cells.
    ``keys`` are the other keys of the table, such as ``ocean_time``.
    """
    along, across = _AXES[axis]
    w = Window.partitionBy(*keys, across).orderBy(along)
    at = F.col(along)
    new = {}
    for f in fields:
        new[f"{f}{ahead}"] = F.when(F.lead(at).over(w) == at + 1, F.lead(F.col(f)).over(w))
        if back:
            new[f"{f}_back"] = F.when(F.lag(at).over(w) == at - 1, F.lag(F.col(f)).over(w))
    return df.withColumns(new)


def mean2(a: Column, b: Column) -> Column:
    return F.lit(0.5) * (a + b)


def interpolate(df: DataFrame, axis: str, fields: list[str], keys: list[str], suffix: str) -> DataFrame:
    """Two-point mean onto the face between each column and the next one along ``axis``."""
    near = with_neighbours(df, axis, fields, keys)
    means = {f"{f}{suffix}": mean2(F.col(f), F.col(f"{f}_next")) for f in fields}
    return near.withColumns(means).drop(*[f"{f}_next" for f in fields])


def interpolate_left(df: DataFrame, axis: str, fields: list[str], keys: list[str], first: int, suffix: str = "_left") -> DataFrame:
    """Value on the face *before* each column; on the first line (index ``first``) it is
    extrapolated linearly from the two columns after it."""
    near = with_neighbours(df, axis, fields, keys, back=True)
    at = F.col(_AXES[axis][0])
    out = {}
    for f in fields:
        ghost = F.lit(1.5) * F.col(f) - F.lit(0.5) * F.col(f"{f}_next")
        out[f"{f}{suffix}"] = F.when(at == first, ghost).otherwise(mean2(F.col(f"{f}_back"), F.col(f)))
    return near.withColumns(out).drop(*[f"{f}{s}" for f in fields for s in ("_next", "_back")])


def interpolate_psi(df: DataFrame, fields: list[str], keys: list[str], suffix: str = "_psi") -> DataFrame:
    """Four-corner mean: along x, then along y."""
    x = interpolate(df, "x", fields, keys, "__x")
    y = interpolate(x, "y", [f"{f}__x" for f in fields], keys, "__y")
    out = y.withColumns({f"{f}{suffix}": F.col(f"{f}__x__y") for f in fields})
    return out.drop(*[f"{f}__x" for f in fields], *[f"{f}__x__y" for f in fields])


def interpolate_levels(columns: DataFrame, n: int, fields: list[str], keys: list[str]) -> DataFrame:
    """Packed fields at u, v and corner points, one row per level.

    Neighbours exchange packed columns, one row per water column; levels are unpacked last.
    """
    near = with_neighbours(columns.select(*keys, "j", "i", *fields), "x", fields, keys, ahead="__x")
    near = with_neighbours(near, "y", [*fields, *[f"{f}__x" for f in fields]], keys, ahead="__y")
    k = F.col("k")
    out = []
    for f in fields:
        at, x, y, xy = (F.get(F.col(f"{f}{c}"), k) for c in ("", "__x", "__y", "__x__y"))
        out += [mean2(at, x).alias(f"{f}_u"), mean2(at, y).alias(f"{f}_v"), mean2(mean2(at, x), mean2(y, xy)).alias(f"{f}_psi")]
    return vt.explode_levels(near, n).select(*keys, "k", "j", "i", *out)


def horizontal_metrics(static: DataFrame) -> DataFrame:
    """Cell sizes and areas at centres, u, v and corner points.

    Inverse spacings are averaged first and inverted afterwards.  ``static`` has one row
    per ``(j, i)`` with ``pm`` and ``pn``.
    """
    at_u = interpolate(static, "x", ["pm", "pn"], [], "_u")
    at_v = interpolate(at_u, "y", ["pm", "pn", "pm_u", "pn_u"], [], "_v")
    one = F.lit(1.0)
    points = {"": ("pm", "pn"), "_u": ("pm_u", "pn_u"), "_v": ("pm_v", "pn_v"), "_psi": ("pm_u_v", "pn_u_v")}
    out = at_v
    for p, (pm, pn) in points.items():
        out = out.withColumns({f"dx{p}": one / F.col(pm), f"dy{p}": one / F.col(pn)})
    out = out.withColumns({f"dA{p}": F.col(f"dx{p}") * F.col(f"dy{p}") for p in points})
    return out.withColumnsRenamed({"pm_u_v": "pm_psi", "pn_u_v": "pn_psi"})


def level_geometry(columns: DataFrame, levels: SLevels) -> DataFrame:
    """Per level: centre depth, thickness and cell volume, moving and at rest."""
    k, h, zeta = F.col("k"), F.col("h"), F.col("zeta")
    area = (F.lit(1.0) / F.col("pm")) * (F.lit(1.0) / F.col("pn"))
    dz = vt.thickness(levels, k, h, zeta)
    return vt.explode_levels(columns, levels.n).withColumns(
        {
            "z_rho": vt.depth(levels, "rho", k, h, zeta),
            "z_rho0": vt.rest_depth(levels, "rho", k, h),
            "dz": dz,
            "dz0": vt.thickness(levels, k, h),
            "dV": dz * area,
        }
    )


def interface_geometry(columns: DataFrame, levels: SLevels) -> DataFrame:
    """Per interface ``k = 0..N``: depth, spacing of the centres around it, volume."""
    k, h, zeta = F.col("k"), F.col("h"), F.col("zeta")
    dz_w = vt.interface_thickness(levels, k, h, zeta)
    return vt.explode_levels(columns, levels.n + 1).withColumns(
        {
            "z_w": vt.depth(levels, "w", k, h, zeta),
            "z_w0": vt.rest_depth(levels, "w", k, h),
            "dz_w": dz_w,
            "dz_w0": vt.interface_thickness(levels, k, h),
            "dV_w": dz_w * (F.lit(1.0) / F.col("pm")) * (F.lit(1.0) / F.col("pn")),
        }
    )


_SCALARS = ["h", "zeta", "pm", "pn"]
_STEPS = {"u": ["x"], "v": ["y"], "psi": ["x", "y"]}


def with_corners(columns: DataFrame, steps: list[str] | tuple[str, ...] = ("x", "y")) -> DataFrame:
    """Adds the scalars of the next column along x (``__x``), y (``__y``) and both (``__x__y``).

    Depths follow from the scalars of a column, so only those travel between neighbours.
    """
    corners = [""]
    for axis in steps:
        names = [f"{s}{c}" for c in corners for s in _SCALARS]
        columns = with_neighbours(columns, axis, names, ["ocean_time"], ahead=f"__{axis}")
        corners = corners + [f"{c}__{axis}" for c in corners]
    return columns


def _corners(point: str) -> list[str]:
    corners = [""]
    for axis in _STEPS[point]:
        corners = corners + [f"{c}__{axis}" for c in corners]
    return corners


def _staggered(levels: SLevels, point: str, interfaces: bool) -> dict[str, Column]:
    """z, z0, dz, dz0, dx, dy and dV at level ``k`` of a point, from a table of corners."""
    corners = _corners(point)
    weight = F.lit(1.0 / len(corners))
    k = F.col("k")

    def mean(expr) -> Column:
        total = None
        for c in corners:
            term = expr(lambda name, c=c: F.col(f"{name}{c}"))
            total = term if total is None else total + term
        return total * weight

    at = "w" if interfaces else "rho"
    spacing = vt.interface_thickness if interfaces else vt.thickness
    dz = mean(lambda col: spacing(levels, k, col("h"), col("zeta")))
    dx = F.lit(1.0) / mean(lambda col: col("pm"))
    dy = F.lit(1.0) / mean(lambda col: col("pn"))
    return {
        "z": mean(lambda col: vt.depth(levels, at, k, col("h"), col("zeta"))),
        "z0": mean(lambda col: vt.rest_depth(levels, at, k, col("h"))),
        "dz": dz,
        "dz0": mean(lambda col: spacing(levels, k, col("h"))),
        "dx": dx,
        "dy": dy,
        "dV": dz * dx * dy,
    }


def staggered_geometry(columns: DataFrame, levels: SLevels, point: str, interfaces: bool = False) -> DataFrame:
    """Depth, thickness and volume at ``u``, ``v`` or ``psi`` points.

    Depths and thicknesses are means of the surrounding columns and volumes use the
    metrics of the point itself.  With ``interfaces`` everything refers to the levels
    between the layers (``n + 1`` of them).  Names carry the usual ``_u`` / ``_v`` /
    ``_psi`` suffix.
    """
    df = with_corners(columns, _STEPS[point])
    df = vt.explode_levels(df, levels.n + 1 if interfaces else levels.n)
    at, mark = ("w", "_w") if interfaces else ("rho", "")
    names = {
        "z": f"z_{at}_{point}", "z0": f"z_{at}_{point}0", "dz": f"dz{mark}_{point}", "dz0": f"dz{mark}_{point}0",
        "dx": f"dx_{point}", "dy": f"dy_{point}", "dV": f"dV{mark}_{point}",
    }
    out = df.withColumns({names[n]: c for n, c in _staggered(levels, point, interfaces).items()})
    return out.drop(*[f"{s}{c}" for c in _corners(point) if c for s in _SCALARS])


def staggered_table(columns: DataFrame, levels: SLevels) -> DataFrame:
    """Geometry of all staggered points, centres of layers and interfaces, in one table.

    ``place`` is ``u``, ``v`` or ``psi``, with ``_w`` for interfaces.  All six are projections of
    one table of corners.  Points without all their columns have no row.
    """
    df = vt.explode_levels(with_corners(columns), levels.n + 1)
    fields = ("z", "z0", "dz", "dz0", "dV")
    places = []
    for point in _STEPS:
        for interfaces in (False, True):
            e = _staggered(levels, point, interfaces)
            row = F.struct(F.lit(f"{point}{'_w' if interfaces else ''}").alias("place"), *[e[n].alias(n) for n in fields])
            places.append(row if interfaces else F.when(F.col("k") < levels.n, row))
    out = df.select("ocean_time", "k", "j", "i", F.explode(F.array(*places)).alias("__at"))
    return out.select("ocean_time", "k", "j", "i", "__at.*").where(F.col("z").isNotNull())


def rest_column_volume(static: DataFrame, levels: SLevels) -> DataFrame:
    """Volume of each column between its lowest and highest centre at mean sea level:
    the ``N - 1`` centre-to-centre layers times the cell area."""
    per_layer = vt.explode_levels(static, levels.n - 1)
    k, h = F.col("k"), F.col("h")
    layer = vt.rest_depth(levels, "rho", k + 1, h) - vt.rest_depth(levels, "rho", k, h)
    area = (F.lit(1.0) / F.col("pm")) * (F.lit(1.0) / F.col("pn"))
    return per_layer.groupBy("j", "i").agg(F.sum(area * layer).alias("dV0"))


def centred_gradient(df: DataFrame, field: str, axis: str, spacing: Column, last: int, keys: list[str], name: str) -> DataFrame:
    """Horizontal derivative at cell centres from the differences on both sides.

    On the edge lines of the domain (index 0 and ``last``) the one available difference
    is used; next to missing cells the result is missing.
    """
    near = with_neighbours(df, axis, [field], keys, back=True)
    at = F.col(_AXES[axis][0])
    ahead = F.col(f"{field}_next") - F.col(field)
    behind = F.col(field) - F.col(f"{field}_back")
    value = F.when(at == 0, ahead).when(at == last, behind).otherwise(mean2(behind, ahead))
    return near.withColumn(name, value / spacing).drop(f"{field}_next", f"{field}_back")


def with_reference_density(df: DataFrame) -> DataFrame:
    return df if "rho0" in df.columns else df.withColumn("rho0", F.lit(RHO0_DEFAULT))
