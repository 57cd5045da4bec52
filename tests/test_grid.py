import numpy as np
import pytest
from shapes import make_columns, uniform_levels
from pyspark.sql import functions as F

from haloflux.functions import vertical as vt
from haloflux.operators import analysis, grid

LINEAR = lambda t, k, j, i: 30.0 + i + 10.0 * j + 0.5 * k


@pytest.mark.parametrize("version", [1, 2])
def test_depths_match_the_formulas_and_close_on_bottom_and_surface(spark, version):
    lev = uniform_levels(3, vtransform=version)
    cols = make_columns(spark, zeta=lambda t, j, i: 0.25 * i, h=lambda j, i: 30.0 + j)
    k, h, z = F.col("k"), F.col("h"), F.col("zeta")
    out = vt.explode_levels(cols, 4).select("h", "zeta", "k", vt.depth(lev, "w", k, h, z).alias("zw")).collect()
    for r in out:
        if r.k == 0:
            assert r.zw == pytest.approx(-r.h)
        if r.k == 3:
            assert r.zw == pytest.approx(r.zeta)
    geo = grid.level_geometry(cols, lev).groupBy("j", "i").agg(F.sum("dz").alias("d"), F.sum("dV").alias("v"), F.first("h").alias("h"), F.first("zeta").alias("z"))
    for r in geo.collect():
        assert r.d == pytest.approx(r.h + r.z)
        assert r.v == pytest.approx((r.h + r.z) * 1e6)


def test_interface_thickness_takes_depth_zero_beyond_the_ends(spark):
    lev = uniform_levels(3)
    cols = make_columns(spark, nj=1, ni=1)
    rows = grid.interface_geometry(cols, lev).orderBy("k").collect()
    assert [round(r.dz_w, 9) for r in rows] == [-25.0, 10.0, 10.0, 5.0]


def test_vertical_derivative_is_zero_at_the_ends_and_missing_next_to_gaps(spark):
    lev = uniform_levels(3)
    cols = make_columns(spark, nj=1, ni=2, salt=lambda t, k, j, i: None if (i, k) == (1, 2) else 30.0 + 2.0 * k)
    slope = vt.ddz(F.col("salt"), lev, F.col("k"), F.col("h"), F.col("zeta"))
    rows = {(r.i, r.k): r.d for r in vt.explode_levels(cols, 4).select("i", "k", slope.alias("d")).collect()}
    assert [rows[0, k] for k in range(4)] == pytest.approx([0.0, 0.2, 0.2, 0.0])
    assert rows[1, 0] == 0.0 and rows[1, 1] == pytest.approx(0.2) and rows[1, 2] is None and rows[1, 3] is None


def test_mixing_by_hand_and_zero_for_constant_salinity(spark):
    lev = uniform_levels(3)
    cols = make_columns(spark, nj=1, ni=1, salt=lambda t, k, j, i: [30.0, 31.0, 33.0][k], aks=lambda t, k, j, i: 1e-3 * (k + 1))
    chi = vt.mixing(F.col("salt"), F.col("aks"), lev, F.col("k"), F.col("h"), F.col("zeta"))
    got = [r.c for r in vt.explode_levels(cols, 3).select("k", chi.alias("c")).orderBy("k").collect()]
    w = [0.0, 2 * 2e-3 * 0.1**2, 2 * 3e-3 * 0.2**2, 0.0]
    assert got == pytest.approx([(w[k] + w[k + 1]) / 2 for k in range(3)])
    flat = make_columns(spark, nj=1, ni=1)
    assert {r.c for r in vt.explode_levels(flat, 3).select(chi.alias("c")).collect()} == {0.0}


def test_pack_and_unpack_are_inverse_and_keep_gaps(spark):
    cells = spark.createDataFrame([(0, 0, 0, 1.0), (2, 0, 0, 3.0), (0, 0, 1, 5.0)], "k int, j int, i int, salt double")
    packed = grid.pack_levels(cells, 3, ["salt"], ["j", "i"])
    assert {r.i: r.salt for r in packed.collect()} == {0: [1.0, None, 3.0], 1: [5.0, None, None]}
    back = grid.unpack_levels(packed, 3, ["salt"]).where("salt is not null")
    assert sorted(map(tuple, back.select("k", "j", "i", "salt").collect())) == sorted(map(tuple, cells.collect()))


def test_interpolation_stops_at_missing_columns(spark):
    cols = make_columns(spark, salt=LINEAR, skip={(1, 2)})
    cells = grid.unpack_levels(cols.select("ocean_time", "j", "i", "salt"), 3, ["salt"])
    out = grid.interpolate(cells, "x", ["salt"], ["ocean_time", "k"], "_u")
    got = {(r.j, r.i): r.salt_u for r in out.where("k = 0").collect()}
    assert got[0, 0] == 30.5 and got[0, 3] is None
    assert got[1, 1] is None and (1, 2) not in got


def test_corner_mean_and_left_extrapolation(spark):
    cols = make_columns(spark, salt=LINEAR)
    cells = grid.unpack_levels(cols.select("ocean_time", "j", "i", "salt"), 3, ["salt"])
    psi = grid.interpolate_psi(cells, ["salt"], ["ocean_time", "k"])
    got = {(r.j, r.i): r.salt_psi for r in psi.where("k = 0").collect()}
    assert got[1, 2] == 30.0 + 2.5 + 15.0 and got[3, 0] is None and got[0, 3] is None
    left = grid.interpolate_left(cells, "x", ["salt"], ["ocean_time", "k"], 0)
    got = {(r.j, r.i): r.salt_left for r in left.where("k = 0").collect()}
    assert got[0, 0] == 29.5 and got[0, 1] == 30.5


def test_metrics_average_inverse_spacing_before_inverting(spark):
    static = spark.createDataFrame([(0, 0, 1e-3, 2e-3), (0, 1, 3e-3, 2e-3), (1, 0, 1e-3, 4e-3), (1, 1, 3e-3, 4e-3)], "j int, i int, pm double, pn double")
    m = {(r.j, r.i): r for r in grid.horizontal_metrics(static).collect()}
    assert m[0, 0].dx_u == pytest.approx(500.0)
    assert m[0, 0].dy_v == pytest.approx(1 / 3e-3)
    assert m[0, 0].dA_psi == pytest.approx(500.0 / 3e-3)
    assert m[0, 1].dx_u is None


def test_staggered_geometry_matches_interpolated_cells(spark):
    lev = uniform_levels(3)
    cols = make_columns(spark, zeta=lambda t, j, i: 0.1 * i + 0.2 * j, h=lambda j, i: 30.0 + j * i)
    slim = cols.select("ocean_time", "j", "i", "h", "zeta", "pm", "pn")
    dz = grid.level_geometry(slim, lev).select("ocean_time", "k", "j", "i", "dz", "z_rho")
    want = grid.interpolate_psi(dz, ["dz", "z_rho"], ["ocean_time", "k"])
    want = {(r.k, r.j, r.i): (r.dz_psi, r.z_rho_psi) for r in want.collect()}
    got = grid.staggered_geometry(slim, lev, "psi").collect()
    for r in got:
        a, b = want[r.k, r.j, r.i]
        if a is None:
            assert r.dz_psi is None
        else:
            assert (r.dz_psi, r.z_rho_psi) == pytest.approx((a, b))
            assert r.dV_psi == pytest.approx(a * 1e6)


def test_rest_volume_uses_centre_to_centre_layers(spark):
    lev = uniform_levels(3)
    static = make_columns(spark, nj=1, ni=1).select("j", "i", "h", "pm", "pn")
    assert grid.rest_column_volume(static, lev).first().dV0 == pytest.approx(20.0 * 1e6)


def test_gradient_is_one_sided_at_domain_edges_and_missing_at_land(spark):
    cols = make_columns(spark, salt=lambda t, k, j, i: float(i * i + 10 * j), skip={(2, 2)})
    surf = analysis.at_level(cols.select("ocean_time", "j", "i", "pm", "pn", "salt"), ["salt"], -1)
    out = {(r.j, r.i): r for r in analysis.gradient_magnitude(surf, "salt", 3, 3, ["ocean_time"]).collect()}
    assert out[0, 0].dsdx == pytest.approx(1e-3) and out[0, 1].dsdx == pytest.approx(2e-3) and out[0, 3].dsdx == pytest.approx(5e-3)
    assert out[0, 0].gradmag == pytest.approx(np.hypot(1e-3, 1e-2))
    assert out[2, 1].dsdx is None and out[1, 2].dsdy is None


def test_isosurface_policies(spark):
    profiles = {0: [35.0, 34.0, 33.0, 32.0, 31.0], 1: [35.0, 33.5, 32.0, 31.0, 30.0], 2: [34.0, 32.0, 34.0, 32.0, 31.0], 3: [34.0, 33.0, 32.0, 31.0, 30.0]}
    lev = uniform_levels(5)
    cols = make_columns(spark, nk=5, nj=1, ni=4, h=lambda j, i: 10.0, salt=lambda t, k, j, i: profiles[i][k])
    # centres at -9, -7, -5, -3, -1
    got = {}
    for policy in ("shallowest", "deepest", "all"):
        for r in analysis.isosurface_depth(cols, "salt", 33.0, lev, policy).collect():
            got[policy, r.i] = r.z_iso
    assert got["shallowest", 0] == pytest.approx(-5.0)
    assert got["shallowest", 1] == pytest.approx(-7.0 + 2.0 / 3.0)
    assert got["shallowest", 2] == pytest.approx(-4.0) and got["deepest", 2] == pytest.approx(-8.0)
    assert got["all", 2] == pytest.approx([-8.0, -6.0, -4.0])
    assert got["deepest", 3] == pytest.approx(-7.0)
    none = analysis.isosurface_depth(cols, "salt", 20.0, lev).where("z_iso is not null")
    assert none.count() == 0


def test_velocity_gradients_at_constant_depth(spark):
    lev = uniform_levels(4)
    # sloping layers; velocities linear in x, y and depth, so gradients are constants
    depth_of = lambda k, h: h * lev.s_rho[k]
    h = lambda j, i: 40.0 + 2.0 * i + 3.0 * j
    zu = lambda k, j, i: (depth_of(k, h(j, i)) + depth_of(k, h(j, i + 1))) / 2
    zv = lambda k, j, i: (depth_of(k, h(j, i)) + depth_of(k, h(j + 1, i))) / 2
    cols = make_columns(
        spark, nk=4, nj=6, ni=6, h=h,
        u=lambda t, k, j, i: 0.02 * (i + 0.5) + 0.03 * j + 0.01 * zu(k, j, i),
        v=lambda t, k, j, i: 0.05 * i - 0.04 * (j + 0.5) - 0.02 * zv(k, j, i),
    )
    out = analysis.surface_kinematics(analysis.surface_velocity_gradients(cols, lev)).where("dudx IS NOT NULL AND dvdy IS NOT NULL")
    rows = out.collect()
    assert {(r.j, r.i) for r in rows} == {(j, i) for j in range(1, 4) for i in range(1, 4)}
    for r in rows:
        assert (r.dudx, r.dudy, r.dvdx, r.dvdy) == pytest.approx((2e-5, 3e-5, 5e-5, -4e-5), rel=1e-9)
        assert r.vorticity == pytest.approx(2e-5 / 7e-5) and r.divergence == pytest.approx(-2e-5 / 7e-5)
        assert r.strain == pytest.approx(np.hypot(6e-5, 8e-5) / 7e-5)


def test_reference_density_is_only_added_where_absent(spark):
    df = spark.createDataFrame([(1,)], "k int")
    assert grid.with_reference_density(df).first().rho0 == 1025.0
    assert grid.with_reference_density(df.withColumn("rho0", F.lit(1000.0))).first().rho0 == 1000.0


def test_stencils_in_volumes_read_a_rim_and_equal_those_of_the_domain(spark, tmp_path):
    from haloflux.operators import volumes
    from haloflux.schema import ControlVolume

    lev = uniform_levels(3)
    wavy = dict(salt=lambda t, k, j, i: 30.0 + (3 * i + 5 * j + k) % 7, u=lambda t, k, j, i: ((i * j + k) % 5) / 4, v=lambda t, k, j, i: ((2 * i + j * j) % 7) / 4, zeta=lambda t, j, i: ((i + j) % 3) / 8, h=lambda j, i: 20.0 + i + 2 * j)
    make_columns(spark, nt=2, nj=9, ni=10, skip={(4, 6)}, **wavy).repartition(3).write.parquet(str(tmp_path / "cols"))
    cols = spark.read.parquet(str(tmp_path / "cols"))
    boxes = [ControlVolume(0, 0, 2, 0, 3), ControlVolume(1, 5, 7, 3, 6), ControlVolume(2, 6, 9, 5, 8)]
    keys = ["cv_id", "ocean_time", "j", "i"]
    surface = analysis.at_level(cols.select("ocean_time", "j", "i", "pm", "pn", "salt"), ["salt"], -1)
    whole = volumes.in_volumes(analysis.gradient_magnitude(surface, "salt", 9, 8, ["ocean_time"]), boxes)
    cut = analysis.volume_gradient(cols, boxes, "salt", 9, 8, ["ocean_time"])
    rows = lambda df, *c: sorted(map(tuple, df.select(*keys, *c).collect()), key=str)
    assert rows(cut, "dsdx", "dsdy", "gradmag") == rows(whole, "dsdx", "dsdy", "gradmag") and cut.count() > 60
    fields = ("vorticity", "divergence", "strain")
    kinematics = volumes.in_volumes(analysis.surface_kinematics(analysis.surface_velocity_gradients(cols, lev)), boxes)
    cut = analysis.volume_kinematics(cols, boxes, lev)
    assert rows(cut, *fields) == rows(kinematics, *fields)
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    try:
        plan = analysis.volume_kinematics(cols, [boxes[1]], lev)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = plan[plan.index("PushedFilters") :]
    for bound in ("GreaterThanOrEqual(i,3)", "LessThanOrEqual(i,9)", "GreaterThanOrEqual(j,1)", "LessThanOrEqual(j,8)"):
        assert bound in pushed
