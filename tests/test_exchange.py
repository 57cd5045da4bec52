import pytest
from pyspark.sql import functions as F
from shapes import step

from haloflux.operators import analysis, exchange
from haloflux.schema import BinSpec

SALT = BinSpec("salt", 0.0, 40.0, 40)


def samples(spark, rows):
    df = spark.createDataFrame(rows, "cv_id int, ocean_time int, face string, salt double, q double")
    return df.withColumns({"qs": F.col("salt") * F.col("q"), "qss": F.col("salt") * F.col("salt") * F.col("q")})


def test_signs_of_the_four_faces(spark):
    df = samples(spark, [(0, 0, f, 30.5, 1.0) for f in "WESN"] + [(0, 0, "W", 30.5, 2.0)])
    r = exchange.net_from_samples(df, {"salt": SALT}, ["cv_id", "ocean_time"]).first()
    assert r.Qnet == 2.0 and r.Qsnet == 61.0


def test_split_is_by_the_sign_of_each_tracers_own_net(spark):
    # one class: volume nets to zero, salt does not
    df = samples(spark, [(0, 0, "W", 30.2, 1.0), (0, 0, "E", 30.8, 1.0)])
    r = exchange.exchange_flow_from_samples(df, {"salt": SALT}, ["cv_id", "ocean_time"]).first()
    assert r.Qin == 0.0 and r.Qout == 0.0 and r.voladv == 0.0
    assert r.Qsout == pytest.approx(-0.6) and r.Qsin == 0.0
    assert r["sin"] is None and r["sout"] is None and r.saltadv == 0.0


def test_one_sided_flow_has_missing_ratio_but_finite_advection(spark):
    df = samples(spark, [(0, 0, "W", 30.5, 2.0), (0, 0, "S", 20.5, 1.0)])
    r = exchange.exchange_flow_from_samples(df, {"salt": SALT}, ["cv_id", "ocean_time"]).first()
    assert r.Qin == 3.0 and r.Qout == 0.0 and r["sout"] is None
    assert r["sin"] == pytest.approx(81.5 / 3) and r.saltadv == pytest.approx(81.5) and r.ssaltadv == pytest.approx(2 * 30.5**2 + 20.5**2)


def test_histogram_then_net_equals_net_from_samples(spark):
    rows = [(c, t, "WESN"[n % 4], (7 * n % 160) / 4.0, float(n % 9 - 4)) for n in range(200) for c in (0, 1) for t in (0, 1)]
    df = samples(spark, rows)
    from haloflux.plans.tef import face_histograms

    keys = ["cv_id", "ocean_time", "salt_idx", "salt_bin"]
    a = exchange.net_transport(face_histograms(df, {"salt": SALT}), keys)
    b = exchange.net_from_samples(df, {"salt": SALT}, ["cv_id", "ocean_time"]).select(*a.columns)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    dense = exchange.net_from_samples(df, {"salt": SALT}, ["cv_id", "ocean_time"], dense=True)
    assert dense.count() == 4 * 40
    bulk = lambda net: sorted(map(tuple, exchange.exchange_flow(net, ["cv_id", "ocean_time"]).collect()))
    assert bulk(dense) == bulk(b)


def test_second_coordinate_stays_in_the_result(spark):
    df = samples(spark, [(0, 0, "W", 30.5, 1.0), (0, 0, "E", 20.5, 2.0), (0, 0, "W", 10.5, 4.0)])
    df = df.withColumn("temp", F.col("salt") / 2)
    out = exchange.exchange_flow_from_samples(df, {"salt": SALT, "temp": BinSpec("temp", 0.0, 40.0, 2)}, ["cv_id", "ocean_time"])
    got = {r.temp_idx: (r.Qin, r.Qout) for r in out.collect()}
    assert got == {0: (5.0, -2.0)}


def test_bin_counts_from_one_histogram(spark):
    df = samples(spark, [(0, 0, "W", 10.2, 3.0), (0, 0, "E", 10.8, 2.0), (0, 0, "E", 11.5, 2.0)])
    net = exchange.net_from_samples(df, {"salt": BinSpec("salt", 0.0, 40.0, 80)}, ["cv_id", "ocean_time"])
    out = exchange.bin_count_comparison(net, BinSpec("salt", 0.0, 40.0, 80), [20, 40, 80], ["cv_id"])
    assert {r.n_bins: (r.Qin, r.Qout) for r in out.collect()} == {20: (0.0, -1.0), 40: (1.0, -2.0), 80: (3.0, -4.0)}
    with pytest.raises(ValueError):
        exchange.bin_count_comparison(net, SALT, [7], ["cv_id"])


def test_maximum_and_deviation_count_empty_bins(spark):
    df = spark.createDataFrame([(0, 1, -2.0), (0, 2, -1.0), (1, 0, 4.0), (1, 1, -4.0)], "cv_id int, b int, v double")
    norm = {(r.cv_id, r.b): r.v_norm for r in analysis.normalise_by_max(df, ["v"], ["cv_id"], 4).collect()}
    assert norm[0, 1] is None and norm[1, 0] == 1.0 and norm[1, 1] == -1.0
    full = {r.cv_id: r for r in analysis.dense_std(df, ["v"], ["cv_id"], 4).collect()}
    import numpy as np

    assert full[0].v_std == pytest.approx(np.std([0, -2, -1, 0])) and full[1].v_std == pytest.approx(np.std([4, -4, 0, 0]))


def test_period_share_uses_the_whole_period_maximum(spark):
    rows = [("2010-06-01", 0, 1.0), ("2010-06-09", 0, 1.0), ("2010-07-02", 0, 6.0), ("2010-07-03", 1, 4.0)]
    df = spark.createDataFrame(rows, "d string, b int, v double").selectExpr("0 AS cv_id", "CAST(d AS timestamp_ntz) AS ocean_time", "b", "v")
    out = analysis.period_share_of_max(df, ["b"], ["v"], ["cv_id"], 2)
    got = {(str(r.period)[:7], r.b): r.v_norm for r in out.collect()}
    assert got == {("2010-06", 0): 0.25, ("2010-07", 0): 0.75, ("2010-07", 1): 0.5}


def test_log_and_density(spark):
    df = spark.createDataFrame([(100.0,), (0.0,), (-1.0,)], "v double")
    assert [r.log_v for r in analysis.log10_of(df, ["v"]).orderBy(F.desc("v")).collect()] == [2.0, None, None]
    mesh = analysis.density_mesh(spark, BinSpec("s", 0.0, 40.0, 4), BinSpec("t", 0.0, 40.0, 8))
    assert mesh.count() == 45
    at = spark.range(1).select(analysis.linear_density(F.lit(35.0), F.lit(25.0)).alias("r")).first().r
    assert at == pytest.approx(27.0)


def test_peak_class(spark):
    df = spark.createDataFrame([(0, 28.25, 3.0), (0, 28.44, 9.0), (0, 30.0, 1.0)], "cv_id int, salt_bin double, chi double")
    assert analysis.class_of_maximum(df, "chi", ["cv_id"]).first().salt_bin == 28.44


def test_of_equal_peaks_the_lowest_bin_counts(spark):
    from haloflux.operators import analysis

    for order in ([(7.0, 2.0), (5.0, 2.0), (6.0, 1.0)], [(5.0, 2.0), (6.0, 1.0), (7.0, 2.0)]):
        hist = spark.createDataFrame([(0, *r) for r in order], "g int, salt_bin double, Qnet double").coalesce(1)
        assert analysis.class_of_maximum(hist, "Qnet", ["g"]).first().salt_bin == 5.0


def test_steps_without_samples_in_range_keep_rows_with_a_second_coordinate(spark):
    salt, temp = BinSpec("salt", 30.0, 34.0, 4), BinSpec("temp", 0.0, 3.0, 3)
    rows = [
        (0, step(0), "W", 31.0, 0.5, 2.0), (0, step(0), "W", 99.0, 1.5, 4.0), (0, step(0), "W", 31.0, 77.0, 8.0),
        (0, step(1), "W", 99.0, 2.5, 4.0), (0, step(2), "W", 31.0, 88.0, 4.0), (0, step(3), "W", None, None, 4.0),
    ]
    df = spark.createDataFrame(rows, "cv_id int, ocean_time timestamp_ntz, face string, salt double, temp double, q double")
    out = exchange.exchange_flow_from_samples(df, {"salt": salt, "temp": temp}, ["cv_id", "ocean_time"]).collect()
    got = {(r.ocean_time, r.temp_idx): (r.Qin, r.Qout, r.temp_bin) for r in out}
    zero = lambda b: (0.0, 0.0, b)
    assert got == {
        (step(0), 0): (2.0, 0.0, 0.5), (step(0), 1): zero(1.5), (step(1), 2): zero(2.5), (step(2), None): zero(None), (step(3), None): zero(None),
    }
    dense = exchange.exchange_flow_from_samples(df, {"salt": salt, "temp": temp}, ["cv_id", "ocean_time"], dense=True).collect()
    assert len(dense) == 4 * 3 and sum(r.Qin for r in dense) == 2.0 and all(r.temp_idx is not None for r in dense)
