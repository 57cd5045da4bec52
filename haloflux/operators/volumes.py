"""Control volumes: which columns lie in them, their faces, and what crosses the faces."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vertical as vt
from ..schema import ControlVolume, SLevels

# Above this many rows a membership table is joined by shuffle instead of broadcast.
# A row is under 100 bytes, so the largest broadcast stays near 20 MB.
BROADCAST_ROWS = 200_000
# Up to this many volumes membership is a plain expression, without any join.
INLINE_VOLUMES = 16
# Index ranges of face lines in the scan predicate; beyond it neighbouring ranges are joined,
# which lets some more columns through but never fewer.
PREDICATE_RANGES = 64


def _bounds(volumes: list[ControlVolume], halo: int = 0) -> Column:
    return F.col("i").between(
        min(v.i0 for v in volumes) - halo, max(v.i1 for v in volumes) + halo
    ) & F.col("j").between(min(v.j0 for v in volumes) - halo, max(v.j1 for v in volumes) + halo)


def _on_lines(column: str, lines: set[int]) -> Column:
    """Predicate for index lines, as at most ``PREDICATE_RANGES`` ranges."""
    ordered = sorted(lines)
    gaps = sorted(range(1, len(ordered)), key=lambda n: ordered[n - 1] - ordered[n])
    cuts = sorted(n for n in gaps[: PREDICATE_RANGES - 1] if ordered[n] - ordered[n - 1] > 1)
    found = F.lit(False)
    for first, stop in zip([0, *cuts], [*cuts, len(ordered)]):
        found = found | F.col(column).between(ordered[first], ordered[stop - 1])
    return found


def _broadcast_if_small(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= BROADCAST_ROWS else table


def in_volumes(columns: DataFrame, volumes: list[ControlVolume]) -> DataFrame:
    """Adds ``cv_id``; a column inside several volumes appears once for each.

    Few volumes are an expression; many are found through square tiles of about their size.
    """
    columns = columns.where(_bounds(volumes))
    if len(volumes) == 1:
        return columns.withColumn("cv_id", F.lit(volumes[0].cv_id))
    if len(volumes) <= INLINE_VOLUMES:
        hits = [F.when(_bounds([v]), F.lit(v.cv_id)) for v in volumes]
        return columns.withColumn("cv_id", F.explode(F.array_compact(F.array(*hits))))
    met = tile_candidates(columns, volumes)
    inside = F.col("i").between(F.col("__i0"), F.col("__i1")) & F.col("j").between(F.col("__j0"), F.col("__j1"))
    return met.where(inside).drop("__i0", "__i1", "__j0", "__j1")


def tiles(volumes: list[ControlVolume]) -> list[tuple[int, ...]]:
    """(row power, column power, tile row, tile column, cv_id, i0, i1, j0, j1) of every tile that a volume touches.

    Sides of tiles are powers of two: for each volume the largest that are not longer than its own, so
    that it touches three by three tiles at most, whatever its size.
    """
    rows = []
    for v in volumes:
        pj, pi = (n.bit_length() - 1 for n in (v.j1 - v.j0 + 1, v.i1 - v.i0 + 1))
        rows += [
            (pj, pi, tj, ti, v.cv_id, v.i0, v.i1, v.j0, v.j1)
            for tj in range(v.j0 >> pj, (v.j1 >> pj) + 1)
            for ti in range(v.i0 >> pi, (v.i1 >> pi) + 1)
        ]
    return rows


def tile_candidates(columns: DataFrame, volumes: list[ControlVolume]) -> DataFrame:
    """Columns beside the volumes whose tiles they lie in, to be compared with the bounds of these.

    A column lies in one tile for each shape of tiles in use.  Of volumes that don't overlap, fewer than four
    of a shape meet each column on average, so candidates follow hits.
    """
    rows = tiles(volumes)
    names = "__pj int, __pi int, __tj int, __ti int, cv_id int, __i0 int, __i1 int, __j0 int, __j1 int"
    table = _broadcast_if_small(columns.sparkSession.createDataFrame(rows, names), len(rows))
    shapes = F.array(*[F.struct(F.lit(a).alias("__pj"), F.lit(b).alias("__pi")) for a, b in sorted({r[:2] for r in rows})])
    placed = columns.select("*", F.inline(shapes)).withColumns({"__tj": F.expr("shiftright(j, __pj)"), "__ti": F.expr("shiftright(i, __pi)")})
    keys = ["__pj", "__pi", "__tj", "__ti"]
    return placed.join(table, keys).drop(*keys)


def widened(columns: DataFrame, volumes: list[ControlVolume], reach: int) -> DataFrame:
    """Columns within ``reach`` of a volume; the bounds of all of them reach the scan as pushed filters."""
    near = columns.where(_bounds(volumes, reach))
    if 1 < len(volumes) <= INLINE_VOLUMES:
        near = near.where(reduce(lambda a, b: a | b, [_bounds([v], reach) for v in volumes]))
    return near


def stencil_in_volumes(columns: DataFrame, volumes: list[ControlVolume], reach: int, stencil: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Result of a horizontal stencil at the columns of volumes, with ``cv_id``.

    Only the volumes and a rim as wide as the stencil's ``reach`` are read; the result is that of the whole domain.
    """
    return in_volumes(stencil(widened(columns, volumes, reach)), volumes)


def face_reads(spark: SparkSession, volumes: list[ControlVolume], edge: str = "mean") -> DataFrame:
    """The columns each face cell reads: ``(cv_id, face, pos, j, i, role)``.

    Role 0 is the column whose velocity lies on the face, role 1 the one across it and
    role 2 the second inner column of an extrapolated west or south face.  Expanded by
    Spark from one row per volume.
    """
    lines = [(v.cv_id, f, at, v.j0, v.j1) if f in "WE" else (v.cv_id, f, at, v.i0, v.i1) for v in volumes for f, at in v.face_lines.items()]
    table = spark.createDataFrame(lines, "cv_id int, face string, line int, lo int, hi int")
    last = F.when(F.col("face").isin("W", "S"), 2).otherwise(1) if edge == "extrapolate" else F.lit(1)
    cells = table.withColumn("pos", F.explode(F.sequence("lo", "hi"))).withColumn(
        "role", F.explode(F.sequence(F.lit(0), last))
    )
    across = F.col("line") + F.col("role")
    along_x = F.col("face").isin("W", "E")
    return cells.select(
        "cv_id", "face", "pos",
        F.when(along_x, F.col("pos")).otherwise(across).alias("j"),
        F.when(along_x, across).otherwise(F.col("pos")).alias("i"),
        "role",
    )


def face_samples(
    columns: DataFrame,
    volumes: list[ControlVolume],
    levels: SLevels,
    tracers: tuple[str, ...] = ("salt",),
    edge: str = "mean",
) -> DataFrame:
    """Everything known at the face cells of every volume, one row per
    ``(cv_id, ocean_time, face, k, pos)``.

    Columns: ``vel`` (normal velocity), ``q`` (volume transport), ``area``, ``dv`` (volume
    of the staggered cell), ``z`` (depth) and one per tracer.  A value is NULL when any
    cell it needs is missing.

    Only face columns are read and moved, once: both sides of a face meet in one
    aggregation over packed columns, which is O(perimeter) and needs no velocity/tracer
    join.  ``edge='extrapolate'`` takes west/south tracers by linear extrapolation from
    inside the box instead of the two-cell mean.
    """
    if edge not in ("mean", "extrapolate"):
        raise ValueError("edge must be 'mean' or 'extrapolate'")
    depth = 2 if edge == "extrapolate" else 1
    lines_i = {at + m for v in volumes for f, at in v.face_lines.items() if f in "WE" for m in range(depth + 1)}
    lines_j = {at + m for v in volumes for f, at in v.face_lines.items() if f in "SN" for m in range(depth + 1)}
    columns = columns.where(
        F.col("i").between(min(lines_i | {v.i0 for v in volumes}), max(lines_i | {v.i1 for v in volumes}))
        & F.col("j").between(min(lines_j | {v.j0 for v in volumes}), max(lines_j | {v.j1 for v in volumes}))
    )
    columns = columns.where(_on_lines("i", lines_i) | _on_lines("j", lines_j))
    n_reads = sum((depth + 1) * 2 * (v.i1 - v.i0 + v.j1 - v.j0 + 2) for v in volumes)
    table = _broadcast_if_small(face_reads(columns.sparkSession, volumes, edge), n_reads)
    needed = [*dict.fromkeys(["u", "v", *tracers])]
    touched = columns.select("ocean_time", "j", "i", "h", "zeta", "pm", "pn", *needed).join(table, ["j", "i"])

    # levels become rows before both sides meet, so that all aggregates are of plain numbers
    # and the aggregation hashes; only the velocity across the face travels, and only from
    # the column it belongs to
    along_x = F.col("face").isin("W", "E")
    role, k = F.col("role"), F.col("k")
    across = F.when(role == 0, F.get(F.when(along_x, F.col("u")).otherwise(F.col("v")), k)).alias("__vel")
    keys = ["cv_id", "ocean_time", "face", "pos"]
    n_roles = depth + 1
    cells = vt.explode_levels(touched, levels.n).select(
        *keys, "role", "k", "h", "zeta", "pm", "pn", across, *[F.get(F.col(t), k).alias(t) for t in tracers]
    )
    parts = ["h", "zeta", "pm", "pn", *tracers]
    levelled = cells.groupBy(*keys, "k").agg(
        F.max("__vel").alias("__vel"),
        *[F.max(F.when(role == r, F.col(c))).alias(f"{c}__{r}") for r in range(n_roles) for c in parts],
    )
    sides = [{c: F.col(f"{c}__{r}") for c in parts} for r in range(n_roles)]

    def pair(expr) -> Column:
        return F.lit(0.5) * (expr(sides[0]) + expr(sides[1]))

    dz = pair(lambda s: vt.thickness(levels, k, s["h"], s["zeta"]))
    dx = F.lit(1.0) / pair(lambda s: s["pm"])
    dy = F.lit(1.0) / pair(lambda s: s["pn"])
    vel = F.col("__vel")
    area = dz * F.when(along_x, dy).otherwise(dx)

    def tracer(name: str) -> Column:
        # the third column only exists for extrapolated west/south faces
        mean = pair(lambda s: s[name])
        if edge == "mean":
            return mean
        outward = F.lit(1.5) * sides[1][name] - F.lit(0.5) * sides[2][name]
        return F.when(F.col("face").isin("W", "S"), outward).otherwise(mean)

    return levelled.select(
        "cv_id",
        "ocean_time",
        "face",
        "k",
        "pos",
        vel.alias("vel"),
        (vel * area).alias("q"),
        area.alias("area"),
        (dz * dx * dy).alias("dv"),
        pair(lambda s: vt.depth(levels, "rho", k, s["h"], s["zeta"])).alias("z"),
        *[tracer(t).alias(t) for t in tracers],
    )


def tracer_transports(samples: DataFrame) -> DataFrame:
    """Adds salt and salt-squared transport (``qs``, ``qss``) to face samples."""
    s, q = F.col("salt"), F.col("q")
    return samples.withColumns({"qs": s * q, "qss": (s * s) * q})


def variance_transport(samples: DataFrame, mean_salt: DataFrame, keys=("cv_id", "ocean_time")) -> DataFrame:
    """Adds ``svar`` (squared deviation from the volume mean) and ``qsvar``.

    ``mean_salt`` has one row per key with ``sbar``.  No broadcast hint: its size grows
    with the number of time steps, so the choice is left to AQE.
    """
    d = F.col("salt") - F.col("sbar")
    joined = samples.join(mean_salt.select(*keys, "sbar"), list(keys), "left")
    return joined.withColumn("svar", d * d).withColumn("qsvar", F.col("q") * F.col("svar")).drop("sbar")


def per_cell_volume(samples: DataFrame, names: tuple[str, ...] = ("q", "qsvar")) -> DataFrame:
    """Divide face transports by the volume of the face cell."""
    return samples.withColumns({n: F.try_divide(F.col(n), F.col("dv")) for n in names})
