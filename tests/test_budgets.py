from fractions import Fraction

import numpy as np
import pytest
from shapes import make_columns, step, uniform_levels
from pyspark.sql import functions as F

from haloflux.operators import budgets, exchange, histogram, volumes
from haloflux.plans import tef
from haloflux.schema import BinSpec, ControlVolume

LEV = uniform_levels(3)
BOX = ControlVolume(0, 0, 3, 0, 3)


def bumpy(t, k, j, i):
    return 28.0 + (5 * i + 3 * j + 7 * k + 2 * t) % 9 + 0.125 * k


def test_variance_of_bumpy_water(spark):
    cols = make_columns(spark, nt=2, salt=bumpy, zeta=lambda t, j, i: 0.1 * t)
    r = budgets.volume_stats(budgets.volume_cells(cols, [BOX], LEV)).orderBy("ocean_time").collect()
    for t in range(2):
        s = np.array([bumpy(t, k, j, i) for k in range(3) for j in range(4) for i in range(4)])
        dv = (30.0 + 0.1 * t) / 3 * 1e6
        assert r[t].V == pytest.approx(48 * dv)
        assert r[t].sV == pytest.approx((s * dv).sum()) and r[t].ssV == pytest.approx((s * s * dv).sum())
        assert r[t].sbar == pytest.approx(s.mean())
        assert r[t].svarV == pytest.approx(((s - s.mean()) ** 2 * dv).sum(), rel=1e-11)


def exact_spread(salt, dv, volume=None):
    """Sum of weighted squared deviations from the mean, in exact fractions."""
    s, w = [Fraction(float(x)) for x in salt], [Fraction(float(x)) for x in dv]
    mean = sum(a * b for a, b in zip(s, w)) / (sum(w) if volume is None else volume)
    return float(sum(b * (a - mean) ** 2 for a, b in zip(s, w)))


def salinity_cells(spark, groups):
    rows = [(cv, step(0), None if s is None else float(s), float(w)) for cv, (salt, dv) in enumerate(groups) for s, w in zip(salt, dv)]
    return spark.createDataFrame(rows, "cv_id int, ocean_time timestamp_ntz, salt double, dV double")


def test_variance_of_nearly_uniform_water_has_all_its_digits(spark):
    """Within a class, across the border of two, far out of range, wide and of one value; unequal volumes."""
    rng = np.random.default_rng(3)
    n = 4000
    volumes_ = 1e6 * rng.uniform(0.2, 3.0, n)
    salts = [c + e * rng.normal(size=n) for c in (0.1, 34.73, 30.0, -7.0, 900.0) for e in (1e-6, 1e-4)] + [rng.uniform(0.0, 40.0, n), np.full(n, 0.1)]
    cells = salinity_cells(spark, [(s, volumes_) for s in salts]).repartition(7)
    got = {r.cv_id: r.svarV for r in budgets.volume_stats(cells).collect()}
    for cv, s in enumerate(salts):
        # beyond the range of classes, deviations from the outer class are large
        rel = 1e-9 if cv < 6 or cv > 9 else 1e-4
        assert got[cv] == pytest.approx(exact_spread(s, volumes_), rel=rel, abs=1e-12)


def test_variance_counts_cells_without_salinity_in_the_mean(spark):
    salt, dv = [30.0, 31.5, None, 30.25], [2.0, 1.0, 4.0, 3.0]
    cells = salinity_cells(spark, [(salt, dv), ([None, None], [1.0, 2.0])])
    wet = [(s, w) for s, w in zip(salt, dv) if s is not None]
    for wet_only, volume in ((False, Fraction(10)), (True, Fraction(6))):
        r = {r.cv_id: r for r in budgets.volume_stats(cells, wet_only=wet_only).collect()}
        assert r[0].V == float(volume) and r[0].svarV == pytest.approx(exact_spread(*zip(*wet), volume), rel=1e-12)
        assert (r[1].V, r[1].sV, r[1].svarV) == (None if wet_only else 3.0, 0.0, 0.0)


def test_one_class_after_another_equals_all_at_once(spark):
    """Moments of parts merge to the moments of the whole."""
    rng = np.random.default_rng(4)
    salt, dv = rng.uniform(20.0, 29.0, 500), rng.uniform(1.0, 2.0, 500)
    means = budgets.volume_means(salinity_cells(spark, [(salt, dv)])).first()
    stats = budgets.volume_stats(salinity_cells(spark, [(salt, dv)])).first()
    assert [means[c] for c in ("V", "sV", "ssV")] == pytest.approx([stats[c] for c in ("V", "sV", "ssV")], rel=1e-13)
    assert stats.svarV == pytest.approx(stats.ssV - stats.sV**2 / stats.V, rel=1e-10)


def test_steps_out_of_range_keep_their_storage_terms(spark):
    lev = uniform_levels(2)
    box = [ControlVolume(0, 1, 3, 1, 3)]
    cols = make_columns(spark, nt=3, nk=2, nj=5, ni=5, salt=lambda t, k, j, i: 50.0 if t == 1 else 30.0 + i, zeta=lambda t, j, i: 0.1 * t * t)
    terms = tef.budget(cols, box, lev, BinSpec("salt", 0.0, 40.0, 40)).orderBy("ocean_time").collect()
    assert [r.ocean_time for r in terms] == [step(1), step(2)]
    assert terms[0].voladv == 0.0 and terms[0].saltadv == 0.0 and terms[0].sin is None and terms[0].dVdt > 0
    flow = tef.total_exchange_flow(cols, box, lev, {"salt": BinSpec("salt", 0.0, 40.0, 40)}).orderBy("ocean_time").collect()
    assert len(flow) == 3 and (flow[1].Qin, flow[1].Qout) == (0.0, 0.0) and flow[0].Qin > 0
    samples = volumes.tracer_transports(volumes.face_samples(cols, box, lev)).select("cv_id", "ocean_time", "face", "salt", "q", "qs")
    direct = exchange.exchange_flow_from_samples(samples, {"salt": BinSpec("salt", 0.0, 40.0, 40)}, budgets.KEYS).orderBy("ocean_time").collect()
    assert [r.Qin for r in direct] == pytest.approx([r.Qin for r in flow])
    joined = budgets.budget_terms(spark.createDataFrame([], "cv_id int, ocean_time timestamp_ntz, voladv double"), budgets.tendencies(budgets.volume_stats(budgets.volume_cells(cols, box, lev))))
    assert [r.voladv for r in joined.collect()] == [0.0, 0.0]


def test_surface_terms_come_with_the_cells(spark):
    box = [ControlVolume(0, 1, 3, 1, 3)]
    cols = make_columns(spark, nt=2, nj=5, ni=5, salt=bumpy).withColumns({"swflux": F.col("i") + 0.5, "ssflux": F.col("j") * 0.25})
    terms = tef.budget(cols, box, LEV, BinSpec("salt", 0.0, 60.0, 60), surface=True).first()
    apart = budgets.surface_salt_flux(cols, box, LEV).where(F.col("ocean_time") == terms.ocean_time).first()
    fresh = budgets.freshwater_flux(cols.select("ocean_time", "j", "i", "swflux"), cols.select("j", "i", "pm", "pn").distinct(), box, "ocean_time")
    assert terms.ssflux == pytest.approx(apart.ssflux)
    assert terms.swflux == pytest.approx(fresh.where(F.col("ocean_time") == terms.ocean_time).first().swflux)


def test_land_counts_in_the_volume_unless_wet_only(spark):
    cols = make_columns(spark, nk=3, salt=lambda t, k, j, i: None if i == 0 else 32.0)
    cells = budgets.volume_cells(cols, [BOX], LEV)
    a, b = budgets.volume_stats(cells).first(), budgets.volume_stats(cells, wet_only=True).first()
    assert a.V == pytest.approx(16 * 30e6) and b.V == pytest.approx(12 * 30e6)
    assert a.sbar == pytest.approx(24.0) and b.sbar == pytest.approx(32.0)
    assert a.svarV == pytest.approx(64.0 * 12 * 30e6) and b.svarV == pytest.approx(0.0, abs=1e-3)


def test_tendencies_label_the_later_step_and_use_the_given_step(spark):
    cols = make_columns(spark, nt=3, zeta=lambda t, j, i: 0.36 * t * t, salt=lambda t, k, j, i: 30.0 + t)
    stats = budgets.volume_stats(budgets.volume_cells(cols, [BOX], LEV))
    out = budgets.tendencies(stats, 3600.0).orderBy("ocean_time").collect()
    assert [r.ocean_time for r in out] == [step(1), step(2)]
    assert [r.dVdt for r in out] == pytest.approx([0.36 * 16e6 / 3600, 3 * 0.36 * 16e6 / 3600])
    auto = budgets.tendencies(stats, "auto", bucket="hour").orderBy("ocean_time").collect()
    assert [r.dsVdt for r in auto] == pytest.approx([r.dsVdt for r in out])


def test_classes_that_empty_change_to_zero(spark):
    cols = make_columns(spark, nt=2, nj=1, ni=1, salt=lambda t, k, j, i: 10.5 + t)
    hist = histogram.weighted_histogram(
        budgets.volume_cells(cols, [ControlVolume(0, 0, 0, 0, 0)], LEV),
        budgets.KEYS, {"salt": BinSpec("salt", 0.0, 40.0, 40)}, {"V": F.col("dV")}, dense=True,
    )
    out = {r.salt_idx: r.dVdt for r in budgets.class_tendency(hist, "V").collect()}
    assert len(out) == 40
    assert out[10] == pytest.approx(-30e6 / 3600) and out[11] == pytest.approx(30e6 / 3600) and out[12] == 0.0


def test_closure_percent_and_zero_storage(spark):
    df = spark.createDataFrame([(0, 1.0, 2.0), (0, 3.0, 2.0), (1, 1.0, 0.0)], "cv_id int, a double, b double")
    out = {r.cv_id: r for r in budgets.closure(df, {"x": (F.col("a"), F.col("b"))}, ["cv_id"], seconds=10.0).collect()}
    assert (out[0].x_supply, out[0].x_storage, out[0].x_pct) == (40.0, 40.0, 0.0)
    assert out[1].x_pct is None


def test_surface_fluxes(spark):
    cols = make_columns(spark, nj=2, ni=2, salt=lambda t, k, j, i: [30.0, 31.0, 32.0][k]).withColumn("ssflux", F.lit(1e-6))
    box = [ControlVolume(0, 0, 1, 0, 1)]
    r = budgets.surface_salt_flux(cols, box, LEV).first()
    assert r.ssflux == pytest.approx(4.0) and r.svolflux == pytest.approx(4.0 / 32.0)
    forcing = cols.select(F.col("ocean_time").alias("time"), "j", "i", F.lit(86.4).alias("swflux"))
    assert budgets.freshwater_flux(forcing, cols.select("j", "i", "pm", "pn"), box).first().swflux == pytest.approx(1e-5 * 4e6)


def test_surface_budget_sign(spark):
    terms = spark.createDataFrame([(0, 0, 5.0, 7.0, 100.0, 90.0, 3.0, 1.0)], "cv_id int, ocean_time int, voladv double, dVdt double, saltadv double, ssaltadv double, chi double, dsVdt double")
    fluxes = spark.createDataFrame([(0, 0, 2.0, 6.0)], "cv_id int, ocean_time int, swflux double, ssflux double")
    plus, minus = (budgets.surface_budget(terms, fluxes, s).first() for s in (1.0, -1.0))
    assert (plus.volume_supply, plus.volume_residual, minus.volume_supply) == (7.0, 0.0, 3.0)
    assert plus.salt_supply == 106.0 and plus.s2flux == 18.0 and plus.ssalt_supply == 105.0


def test_forcing_summed_then_interpolated_equals_interpolated_then_summed(spark):
    from haloflux.operators import series
    from haloflux.plans import tef

    box = [ControlVolume(0, 0, 1, 0, 1)]
    cols = make_columns(spark, nt=4, nj=2, ni=2, zeta=lambda t, j, i: (3 * t + j + 2 * i) % 5 * 86.4)
    days = cols.withColumn("time", F.expr("ocean_time + make_dt_interval(0, 23 * hour(ocean_time))"))
    forcing = days.select("time", "j", "i", F.col("zeta").alias("swflux"))
    static = cols.select("j", "i", "pm", "pn").distinct()
    fast = tef.surface_forcing(forcing, static, box, 3600, skip=1).orderBy("ocean_time").collect()
    slow = budgets.freshwater_flux(series.resample_linear(forcing, ["j", "i"], "time", ["swflux"], 3600), static, box)
    slow = {r.time: r.swflux for r in slow.collect()}
    assert len(fast) == len(slow) - 1 == 72
    for r in fast:
        assert r.swflux == pytest.approx(slow[r.ocean_time])


def changes(spark, rows, dt, bucket=None):
    """Sparse changes and those of the dense histogram, less the classes that are and were empty."""
    df = spark.createDataFrame(rows, "cv_id int, ocean_time timestamp_ntz, salt double, temp double, dV double").repartition(5)
    bins = {"salt": BinSpec.from_edges("salt", [0.0, 1.0, 5.0, 9.0]), "temp": BinSpec("temp", 0.0, 4.0, 4)}
    args = (["cv_id", "ocean_time"], bins, {"dV": F.col("dV")})
    sparse = histogram.weighted_histogram(df, *args, announce=True).select("cv_id", "ocean_time", "salt_idx", "temp_idx", "dV")
    got = budgets.class_changes(sparse, "dV", ["salt_idx", "temp_idx"], dt, bucket=bucket).collect()
    assert len({tuple(r)[:4] for r in got}) == len(got)
    dense = histogram.weighted_histogram(df, *args, dense=True)
    want = budgets.class_tendency(dense, "dV", dt, ("cv_id", "salt_idx", "temp_idx")).collect()
    key = lambda r: (r.cv_id, r.salt_idx, r.temp_idx, r.ocean_time)
    a, b = {key(r): r.ddVdt for r in got if r.ddVdt}, {key(r): r.ddVdt for r in want if r.ddVdt}
    assert a == b and a
    return got


@pytest.mark.parametrize("dt,bucket", [(3600.0, None), ("auto", None), (3600.0, "day")])
def test_changes_of_sparse_classes_equal_those_of_dense_ones(spark, dt, bucket):
    """Classes that fill, empty, stay and return, steps of other lengths, and a step whose cells are all out of range."""
    rng = np.random.default_rng(6)
    rows = []
    for cv in range(2):
        for t in (0, 1, 2, 4, 5, 9, 30, 31):
            for _ in range(int(rng.integers(1, 5))):
                far = 100.0 if t == 4 else 0.0
                rows.append((cv, step(t), float(rng.integers(0, 9)) + far, float(rng.integers(0, 4)), float(rng.integers(1, 8))))
    rows += [(0, step(9), None, 1.0, 5.0), (1, step(40), 50.0, 50.0, 1.0)]
    got = changes(spark, rows, dt, bucket)
    # everything left at the step out of range, and at the last step
    assert any(r.ocean_time == step(4) and r.ddVdt < 0 for r in got) and any(r.ocean_time == step(40) and r.ddVdt < 0 for r in got)
    assert all(r.ocean_time != step(0) for r in got)
