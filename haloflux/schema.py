"""Data model: table schemas, control volumes, bins and vertical levels.

The canonical layout is one row per *water column*: ``(ocean_time, j, i)`` with the
vertical axis packed into arrays.  Vertical neighbours then sit in the same row, so
every vertical stencil is a projection and never a shuffle; horizontal stencils and
face cuts move one row per column instead of one per cell.

Staggering, in column terms: ``u[k]`` of column ``i`` is the velocity on the face
between columns ``i`` and ``i+1``; ``v[k]`` of column ``j`` on the face between rows
``j`` and ``j+1``; ``aks[k]`` sits on the interface below level ``k`` (``n_levels + 1``
entries).  Missing values are NULL, never NaN.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ARRAY = T.ArrayType(T.DoubleType())

COLUMNS_SCHEMA = T.StructType(
    [
        T.StructField("ocean_time", T.TimestampNTZType()),
        T.StructField("j", T.IntegerType()),
        T.StructField("i", T.IntegerType()),
        T.StructField("h", T.DoubleType()),
        T.StructField("pm", T.DoubleType()),
        T.StructField("pn", T.DoubleType()),
        T.StructField("f", T.DoubleType()),
        T.StructField("lon_rho", T.DoubleType()),
        T.StructField("lat_rho", T.DoubleType()),
        T.StructField("zeta", T.DoubleType()),
        T.StructField("ssflux", T.DoubleType()),
        T.StructField("salt", _ARRAY),
        T.StructField("temp", _ARRAY),
        T.StructField("aks", _ARRAY),
        T.StructField("u", _ARRAY),
        T.StructField("v", _ARRAY),
    ]
)

CELLS_SCHEMA = T.StructType(
    [
        T.StructField("ocean_time", T.TimestampNTZType()),
        T.StructField("k", T.IntegerType()),
        T.StructField("j", T.IntegerType()),
        T.StructField("i", T.IntegerType()),
        *[T.StructField(c, T.DoubleType()) for c in ("salt", "temp", "aks", "u", "v")],
    ]
)

FORCING_SCHEMA = T.StructType(
    [
        T.StructField("time", T.TimestampNTZType()),
        T.StructField("j", T.IntegerType()),
        T.StructField("i", T.IntegerType()),
        *[T.StructField(c, T.DoubleType()) for c in ("swflux", "Uwind", "Vwind", "sustr")],
    ]
)

# Raw dimension names folded into the unified ones at ingest (fixed values).
DIM_RENAMES = {
    "eta_u": "eta_rho",
    "xi_v": "xi_rho",
    "xi_psi": "xi_u",
    "eta_psi": "eta_v",
}

# Sea-water reference density used where the input has none (fixed value, kg/m^3).
RHO0_DEFAULT = 1025.0

FACES = ("W", "E", "S", "N")


@dataclass(frozen=True)
class ControlVolume:
    """A box of cells ``i0..i1`` x ``j0..j1``, both ends included.

    ``convention`` says where the east and north faces lie:

    * ``closed``: on the outer edge of the last cell, so the four faces bound exactly
      the cells of the box and fluxes close against storage;
    * ``halfopen``: one cell further in, which is what index slices of the form
      ``[start-1, stop-1)`` on the velocity grids select.
    """

    cv_id: int
    i0: int
    i1: int
    j0: int
    j1: int
    convention: str = "closed"

    def __post_init__(self):
        if self.convention not in ("closed", "halfopen", "beyond"):
            raise ValueError(f"unknown face convention {self.convention!r}")
        if self.i1 < self.i0 or self.j1 < self.j0:
            raise ValueError(f"empty control volume {self}")

    @classmethod
    def from_slices(cls, cv_id: int, xi: slice, eta: slice, convention: str = "closed") -> ControlVolume:
        """From index slices: ``closed`` reads them label-wise (stop included), ``halfopen``
        and ``beyond`` position-wise (stop excluded)."""
        last = 0 if convention == "closed" else 1
        return cls(cv_id, xi.start, xi.stop - last, eta.start, eta.stop - last, convention)

    @property
    def face_lines(self) -> dict[str, int]:
        """Index of each face on its velocity grid (``i`` of u for W/E, ``j`` of v for S/N)."""
        inset = {"closed": 0, "halfopen": 1, "beyond": -1}[self.convention]
        return {"W": self.i0 - 1, "E": self.i1 - inset, "S": self.j0 - 1, "N": self.j1 - inset}

    def without_last(self) -> ControlVolume:
        """The same box less its last row and column of cells (for means over half-open cells)."""
        return replace(self, i1=self.i1 - 1, j1=self.j1 - 1)

    def split(self, nx: int = 2, ny: int = 2, first_id: int = 0) -> list[ControlVolume]:
        """Cut into ``nx`` x ``ny`` boxes numbered south to north, then west to east.

        Closed boxes tile the volume, so a shared face is the same line seen from both
        sides and internal fluxes cancel.  Half-open boxes overlap by one cell for the
        same reason: their east/north faces lie one cell in.
        """
        overlap = 1 if self.convention == "halfopen" else 0

        def cuts(lo: int, hi: int, n: int) -> list[tuple[int, int]]:
            size = -(-(hi - lo + 1) // n)
            # the last box takes the full size, the first one the remainder
            ends = [hi - size * (n - 1 - m) for m in range(n)]
            starts = [lo] + [e + 1 - overlap for e in ends[:-1]]
            return list(zip(starts, ends))

        return [
            replace(self, cv_id=first_id + n, i0=a, i1=b, j0=c, j1=d)
            for n, (a, b, c, d) in enumerate(
                (a, b, c, d)
                for a, b in cuts(self.i0, self.i1, nx)
                for c, d in cuts(self.j0, self.j1, ny)
            )
        ]


def control_volume_table(spark: SparkSession, volumes: Iterable[ControlVolume]) -> DataFrame:
    rows = [(v.cv_id, v.i0, v.i1, v.j0, v.j1, v.convention) for v in volumes]
    return spark.createDataFrame(rows, "cv_id int, i0 int, i1 int, j0 int, j1 int, convention string")


# up to so many bins are found by nested comparisons, more by a search in a constant array
NESTED_BINS = 64


@dataclass(frozen=True)
class BinSpec:
    """``n`` bins over ``[lo, hi]``: half-open, the last one closed on the right.

    Bins are equal unless :meth:`from_edges` made them.  Edge ``k`` of equal bins is ``lo + k * step`` in
    double arithmetic with the last edge exactly ``hi``, the same numbers an evenly spaced
    edge vector holds.
    """

    name: str
    lo: float
    hi: float
    n: int
    #: inner edges of unequal bins
    cuts: tuple[float, ...] = ()

    def __post_init__(self):
        edges = self.edges
        if self.cuts and len(self.cuts) != self.n - 1:
            raise ValueError(f"{self.n} bins have {self.n - 1} inner edges")
        if self.n < 1 or not all(math.isfinite(e) for e in edges) or any(a >= b for a, b in zip(edges, edges[1:])):
            raise ValueError(f"edges must increase: {self.name}")

    @classmethod
    def from_edges(cls, name: str, edges: Sequence[float]) -> BinSpec:
        """Bins between given edges, in increasing order."""
        edges = tuple(float(e) for e in edges)
        if len(edges) < 2:
            raise ValueError("bins need two edges at least")
        return cls(name, edges[0], edges[-1], len(edges) - 1, edges[1:-1])

    @property
    def step(self) -> float:
        """Width of equal bins."""
        return (self.hi - self.lo) / self.n

    @property
    def edges(self) -> list[float]:
        if self.cuts:
            return [self.lo, *self.cuts, self.hi]
        return [self.lo + k * self.step for k in range(self.n)] + [self.hi]

    @property
    def idx(self) -> str:
        return f"{self.name}_idx"

    @property
    def bin(self) -> str:
        return f"{self.name}_bin"

    def edge(self, k: Column) -> Column:
        if self.cuts:
            return F.get(_constants(self.edges), k)
        inner = F.lit(float(self.lo)) + k.cast("double") * F.lit(self.step)
        return F.when(k == self.n, F.lit(float(self.hi))).otherwise(inner)

    def centre(self, k: Column) -> Column:
        return F.lit(0.5) * (self.edge(k) + self.edge(k + 1))

    def index(self, x: Column) -> Column:
        """Bin number of ``x``; NULL when missing or out of range.

        The floor of the scaled value can be one off next to an edge, so it is compared
        with the real edges and moved by one where needed.  Unequal bins are found by halving.
        """
        if self.cuts:
            return F.when(self.covers(x), _cuts_passed(x, self.cuts))
        lo, step = F.lit(float(self.lo)), F.lit(self.step)
        guess = F.least(F.floor((x - lo) / step).cast("int"), F.lit(self.n - 1))
        exact = (
            F.when(x < lo + guess.cast("double") * step, guess - 1)
            .when((guess < self.n - 1) & (x >= lo + (guess + 1).cast("double") * step), guess + 1)
            .otherwise(guess)
        )
        return F.when(self.covers(x), exact)

    def covers(self, x: Column) -> Column:
        return (x >= F.lit(float(self.lo))) & (x <= F.lit(float(self.hi)))

    def table(self, spark: SparkSession) -> DataFrame:
        """The bins as rows: index, centre, both edges."""
        k = F.col("id").cast("int")
        return spark.range(self.n).select(
            k.alias(self.idx),
            self.centre(k).alias(self.bin),
            self.edge(k).alias(f"{self.name}_lo"),
            self.edge(k + 1).alias(f"{self.name}_hi"),
        )


def _constants(values: Sequence[float]) -> Column:
    """A constant array of the plan."""
    return F.from_json(F.lit(json.dumps(list(values))), "array<double>")


def _cuts_passed(x: Column, cuts: tuple[float, ...]) -> Column:
    """How many of the increasing ``cuts`` are not above ``x``, in log2 comparisons."""
    if len(cuts) < NESTED_BINS:

        def half(low: int, high: int) -> Column:
            if low == high:
                return F.lit(low)
            mid = (low + high) // 2
            return F.when(x < F.lit(cuts[mid]), half(low, mid)).otherwise(half(mid + 1, high))

        return half(0, len(cuts))
    held = _constants(cuts)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(cuts).bit_length()))])

    def further(at: Column, step: Column) -> Column:
        # beyond the last cut there is no element and so no move
        return F.when(F.get(held, at + step - 1) <= x, at + step).otherwise(at)

    return F.aggregate(steps, F.lit(0), further)


@dataclass(frozen=True)
class SLevels:
    """Terrain-following levels: ``s`` and stretching at centres (N) and interfaces (N+1)."""

    s_rho: tuple[float, ...]
    cs_r: tuple[float, ...]
    s_w: tuple[float, ...]
    cs_w: tuple[float, ...]
    hc: float
    vtransform: int = 2

    def __post_init__(self):
        if self.vtransform not in (1, 2):
            raise ValueError("vtransform must be 1 or 2")
        n = len(self.s_rho)
        if len(self.cs_r) != n or len(self.s_w) != n + 1 or len(self.cs_w) != n + 1:
            raise ValueError("need N centre and N+1 interface levels")

    @property
    def n(self) -> int:
        return len(self.s_rho)
