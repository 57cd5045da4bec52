"""Model-shaped inputs from the supplied order and event tables.

All values are dyadic rationals (sums are exact in any order), so results can be compared
bit for bit with another engine.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.timeparts import from_epoch_seconds, epoch_seconds, truncate
from ..operators.grid import pack_levels
from ..schema import ControlVolume, SLevels

# Levels of :func:`grid_columns`, and its rows and columns for each unit of refinement.
N_LEVELS, NJ, NI = 7, 6, 8
# Line items for which a refinement of 1 is enough: about four a cell.
REFINED_ROWS = 37_500

_S_W = tuple(k / 8.0 - 0.875 for k in range(N_LEVELS + 1))
_S_RHO = tuple(k / 8.0 - 0.8125 for k in range(N_LEVELS))


def grid_levels(vtransform: int = 2) -> SLevels:
    return SLevels(_S_RHO, _S_RHO, _S_W, _S_W, hc=16.0, vtransform=vtransform)


_BOX = ControlVolume(0, 2, 5, 2, 4)


@dataclass(frozen=True)
class GridShape:
    """Grid and boxes of :func:`grid_columns`: ``m`` times as many rows and columns for ``m`` squared times the data."""

    m: int

    @property
    def nj(self) -> int:
        return NJ * self.m

    @property
    def ni(self) -> int:
        return NI * self.m

    def scaled(self, v: ControlVolume) -> ControlVolume:
        m = self.m
        return replace(v, i0=v.i0 * m, i1=(v.i1 + 1) * m - 1, j0=v.j0 * m, j1=(v.j1 + 1) * m - 1)

    @property
    def box(self) -> ControlVolume:
        """One box inside the domain."""
        return self.scaled(_BOX)

    @property
    def boxes(self) -> list[ControlVolume]:
        """The same cut into four."""
        return [self.scaled(v) for v in _BOX.split(2, 2)]

    @property
    def half_open(self) -> ControlVolume:
        return self.scaled(ControlVolume(1, 2, 5, 2, 4, "halfopen"))

    @property
    def beyond(self) -> ControlVolume:
        return self.scaled(ControlVolume(2, 2, 4, 2, 3, "beyond"))


@lru_cache(maxsize=64)
def shape(spark: SparkSession, sf_dir: str) -> GridShape:
    """Shape that follows the number of line items, read from the table's footers."""
    return GridShape(max(1, math.isqrt(table(spark, sf_dir, "lineitem").count() // REFINED_ROWS)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Plans here are built from SQL text: one call into the engine for each column, not for each operator of it.


def tef_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line item is one face sample."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "CAST(trunc(CAST(l_shipdate AS date), 'month') AS timestamp_ntz) AS ocean_time",
        "CAST(l_suppkey % 4 AS int) AS cv_id",
        "element_at(array('W', 'E', 'S', 'N'), CAST(l_linenumber % 4 + 1 AS int)) AS face",
        "l_quantity * 0.75D AS salt",
        "(l_partkey % 160) / 4D AS temp",
        "-((l_partkey % 260) / 4D) AS z",
        "((l_orderkey % 17) - 8) / 8D * (16 + l_partkey % 64) AS q",
        "1024D * (1 + l_suppkey % 8) AS dv",
    )


def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items grouped to cells of a staggered grid, with the sums the fields need."""
    grid = shape(spark, sf_dir)
    li = table(spark, sf_dir, "lineitem").selectExpr(
        "CAST(trunc(CAST(l_shipdate AS date), 'quarter') AS timestamp_ntz) AS ocean_time",
        "CAST(l_linenumber - 1 AS int) AS k",
        f"CAST(l_suppkey % {grid.nj} AS int) AS j",
        f"CAST(l_partkey % {grid.ni} AS int) AS i",
        "l_quantity", "l_suppkey", "l_partkey", "l_orderkey",
    )
    sums = ["count(1) AS n", "sum(l_quantity) AS sq", "sum(l_suppkey) AS ss", "sum(l_partkey) AS sp", "sum(l_orderkey) AS so"]
    cells = li.groupBy("ocean_time", "k", "j", "i").agg(*map(F.expr, sums))
    return cells.selectExpr(
        "ocean_time", "k", "j", "i", "ss", "sp", "so",
        "floor(sq * 0.75D / n * 64) / 64D AS salt",
        "((ss + sp) % 160) / 4D AS temp",
        "(n % 8) / 1024D AS aks",
        "(so % 17 - 8) / 8D AS u",
        "(sp % 17 - 8) / 8D AS v",
    )


def grid_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same grid as packed water columns with their surface fields."""
    # interface k carries the mixing of cell k; bottom and surface are 0
    cells = grid_cells(spark, sf_dir).withColumn("aks", F.expr("CASE WHEN k > 0 THEN aks ELSE 0D END"))
    packed = pack_levels(cells, N_LEVELS, ["salt", "temp", "aks", "u", "v", "ss", "sp", "so"], ["ocean_time", "j", "i"])

    def total(c: str) -> str:
        return "(" + " + ".join(f"coalesce(get({c}, {k}), 0L)" for k in range(N_LEVELS)) + ")"

    m = shape(spark, sf_dir).m
    return packed.selectExpr(
        "ocean_time", "j", "i",
        f"16D + 8 * floor(j / {m}) + 4 * floor(i / {m}) AS h",
        "1D / (512 * (1 + i % 2)) AS pm",
        "1D / (512 * (1 + j % 2)) AS pn",
        f"({total('ss')} % 9 - 4) / 16D AS zeta",
        f"({total('so')} % 9 - 4) / 1024D AS ssflux",
        f"({total('sp')} % 17 - 8) / 8D AS swflux",
        "salt", "temp", "concat(aks, array(0D)) AS aks", "u", "v",
    )


def grid_static(columns: DataFrame) -> DataFrame:
    """The time-independent part of packed columns, one row per (j, i)."""
    return columns.groupBy("j", "i").agg(*[F.max(c).alias(c) for c in ("h", "pm", "pn")])


def hour_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events per hour: count and value in cents, every hour of the span present."""
    ev = table(spark, sf_dir, "events").select(
        truncate("hour", F.col("ts")).alias("ocean_time"),
        F.round(F.col("value") * 100).cast("bigint").alias("cents"),
    )
    sums = ev.groupBy("ocean_time").agg(F.sum("cents").alias("xc"), F.count(F.lit(1)).alias("n"))
    span = sums.agg(F.struct(F.min("ocean_time").alias("lo"), F.max("ocean_time").alias("hi")).alias("s"))
    hours = span.select(
        F.explode(
            F.sequence(epoch_seconds(F.col("s.lo")), epoch_seconds(F.col("s.hi")), F.lit(3600).cast("bigint"))
        ).alias("sec")
    ).select(from_epoch_seconds(F.col("sec")).alias("ocean_time"))
    zero = F.lit(0).cast("bigint")
    return hours.join(sums, "ocean_time", "left").select(
        "ocean_time",
        F.coalesce("xc", zero).alias("xc"),
        F.coalesce("n", zero).alias("n"),
    )
