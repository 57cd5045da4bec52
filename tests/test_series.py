import numpy as np
import pytest
from shapes import step
from pyspark.sql import functions as F

from haloflux.functions import ordered
from haloflux.functions import timeparts as tp
from haloflux.operators import series


def make_series(spark, values, key=0, hours=1):
    return spark.createDataFrame([(key, step(n, hours), v) for n, v in enumerate(values)], "g int, ocean_time timestamp_ntz, x double")


@pytest.mark.parametrize("n", [72, 75])
def test_lowpass_matches_numpy(spark, n):
    x = np.random.default_rng(1).normal(size=200) + np.arange(200)
    w = np.array(series.hann(n))
    want = np.convolve(x, w, mode="full")[(n - 1) // 2 : (n - 1) // 2 + 200] / w.sum()
    df = make_series(spark, x.tolist())
    for out in (
        series.lowpass(df, ["g"], "ocean_time", ["x"], series.hann(n), step=3600),
        series.lowpass(df, ["g"], "ocean_time", ["x"], series.hann(n)),
        series.lowpass(df, ["g"], "ocean_time", ["x"], series.hann(n), bucket="day"),
    ):
        got = [r.x for r in out.orderBy("ocean_time").collect()]
        assert np.allclose(got, want, rtol=0, atol=1e-10)


def test_lowpass_is_missing_where_the_kernel_meets_a_gap(spark):
    x = [1.0] * 20
    x[10] = None
    out = series.lowpass(make_series(spark, x), ["g"], "ocean_time", ["x"], [1.0, 1.0, 1.0])
    got = [r.x for r in out.orderBy("ocean_time").collect()]
    assert [n for n, v in enumerate(got) if v is None] == [9, 10, 11]
    assert got[0] == pytest.approx(2 / 3) and got[1] == pytest.approx(1.0)


@pytest.mark.parametrize("bucket", [None, "day", "month"])
def test_resample_matches_numpy_interp(spark, bucket):
    x = [1.0, 4.0, 2.0, 8.0]
    out = series.resample_linear(make_series(spark, x, hours=24), ["g"], "ocean_time", ["x"], 600, bucket)
    rows = out.orderBy("ocean_time").collect()
    assert rows[0].ocean_time == step(0) and rows[-1].ocean_time == step(72) and len(rows) == 3 * 144 + 1
    want = np.interp(np.arange(len(rows)) / 144, range(4), x)
    assert np.allclose([r.x for r in rows], want)


def test_resample_of_unaligned_samples_hits_the_regular_grid(spark):
    df = make_series(spark, [0.0, 3.0, 6.0]).withColumn("ocean_time", F.expr("ocean_time + INTERVAL 30 MINUTES"))
    rows = series.resample_linear(df, ["g"], "ocean_time", ["x"], 3600).orderBy("ocean_time").collect()
    assert [(r.ocean_time, r.x) for r in rows] == [(step(1), 1.5), (step(2), 4.5)]


@pytest.mark.parametrize("bucket", [None, "hour", "day", "month"])
def test_neighbours_and_positions_do_not_depend_on_buckets(spark, bucket):
    a, b = make_series(spark, [float(n) for n in range(60)]), make_series(spark, [5.0], key=1)
    df = a.unionByName(b)
    prev = {(r.g, r.ocean_time): (r.x, r.x_prev) for r in ordered.with_previous(df, ["g"], "ocean_time", ["x"], bucket).collect()}
    assert len(prev) == 61 and prev[1, step(0)] == (5.0, None) and prev[0, step(0)][1] is None
    assert all(prev[0, step(n)] == (float(n), n - 1.0) for n in range(1, 60))
    nxt = {(r.g, r.ocean_time): r.x_next for r in ordered.with_next(df, ["g"], "ocean_time", ["x"], bucket).collect()}
    assert nxt[0, step(59)] is None and all(nxt[0, step(n)] == n + 1.0 for n in range(59))
    pos = {(r.g, r.x): r.pos for r in ordered.with_position(df, ["g"], "ocean_time", bucket=bucket).collect()}
    assert pos[1, 5.0] == 0 and all(pos[0, float(n)] == n for n in range(60))


def test_position_slice_and_positional_join(spark):
    df = make_series(spark, [float(n) for n in range(10)])
    assert [r.x for r in series.position_slice(df, ["g"], "ocean_time", 2, 5).orderBy("x").collect()] == [2.0, 3.0, 4.0]
    late = series.position_slice(df.withColumnRenamed("x", "y"), ["g"], "ocean_time", 1)
    out = series.joined_by_position(df, late, ["g"], "ocean_time", ["y"]).collect()
    assert len(out) == 9 and all(r.y == r.x + 1 for r in out)


@pytest.mark.parametrize("steps,chunks", [(719, 59), (60, 59), (100, 7), (5, 8)])
def test_chunks_follow_the_rounded_down_even_edges(spark, steps, chunks):
    edges = np.floor(np.linspace(0, steps, chunks + 1)).astype(int)
    want = {}
    for c in range(chunks):
        for p in range(edges[c], edges[c + 1]):
            want[step(p)] = c
    df = make_series(spark, [0.0] * steps)
    for keys in (["g"], []):
        got = {r.ocean_time: r.chunk_id for r in series.with_chunk_id(df, keys, "ocean_time", chunks, bucket=None if keys else "day").collect()}
        assert got == want


def test_time_selectors(spark):
    df = spark.createDataFrame([(s,) for s in (
        "2010-05-31 23:59:59", "2010-06-01 00:00:00", "2010-06-03 01:00:00", "2010-06-03 01:59:59", "2010-06-03 02:00:00",
        "2010-08-31 23:00:00", "2010-09-01 00:00:00", "2010-12-31 12:00:00")], "s string").selectExpr("CAST(s AS timestamp_ntz) AS ocean_time")
    n = lambda c: df.where(c).count()
    assert n(tp.at_time("2010")) == 8 and n(tp.at_time("2010-06")) == 4 and n(tp.at_time("2010-06-03")) == 3
    assert n(tp.at_time("2010-06-03-01")) == 2 and n(tp.at_time("2010-06-03 01:59")) == 1 and n(tp.at_time("2010-12")) == 1
    assert n(tp.at_time("2010-06-03 02:00:00")) == 1
    assert n(tp.between_times("2010-06", "2010-08")) == 5
    assert n(tp.between_times("2010-06-03 01:00:00", "2010-06-03 02:00:00")) == 3
    days = [str(r.ocean_date) for r in tp.dates(spark, "2010-06-01", "2010-08-31").orderBy("ocean_date").collect()]
    assert len(days) == 91 and days[-1] == "2010-08-30"


def test_truncation_does_not_depend_on_the_session_zone(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-03-10 02:30:15' AS t, TIMESTAMP_NTZ'1969-12-31 23:10:00' AS u")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        r = df.select(*[tp.truncate(u, F.col("t")).cast("string").alias(u) for u in ("hour", "day", "month", "quarter", "year")],
                      tp.truncate("hour", F.col("u")).cast("string").alias("before")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert tuple(r) == ("2024-03-10 02:00:00", "2024-03-10 00:00:00", "2024-03-01 00:00:00", "2024-01-01 00:00:00", "2024-01-01 00:00:00", "1969-12-31 23:00:00")


def test_lowpass_over_a_gap_is_missing(spark):
    df = make_series(spark, [1.0] * 12).where(F.col("ocean_time") != F.lit(step(5)))
    got = {r.ocean_time: r.x for r in series.lowpass(df, ["g"], "ocean_time", ["x"], [1.0, 1.0, 1.0], step=3600).collect()}
    assert got[step(4)] is None and got[step(6)] is None and len(got) == 11
    assert got[step(3)] == pytest.approx(1.0) and got[step(0)] == pytest.approx(2 / 3) and got[step(11)] == pytest.approx(2 / 3)
    keyless = {r.ocean_time: r.x for r in series.lowpass(df.drop("g"), [], "ocean_time", ["x"], [1.0, 1.0, 1.0], step=3600).collect()}
    assert keyless == got


def test_kernels_have_no_longest_length(spark):
    df = make_series(spark, [float(n) for n in range(5)])
    got = [r.x for r in series.lowpass(df, ["g"], "ocean_time", ["x"], [1.0] * 10_001, step=3600).collect()]
    assert got == pytest.approx([10.0 / 10_001] * 5)


@pytest.mark.parametrize("n,block", [(1, 4), (5, 8), (8, 8), (9, 4), (30, 7), (72, 50)])
def test_lowpass_does_not_depend_on_the_blocks(spark, monkeypatch, n, block):
    """Blocks shorter and longer than the kernel, gaps longer than a block, missing values, two phases, two values."""
    monkeypatch.setattr(series, "BLOCK", block)
    rng = np.random.default_rng(n)
    length = 150
    rows, held = [], {}
    for g in range(2):
        x, y = rng.normal(size=length), rng.normal(size=length)
        there = np.ones(length, bool)
        there[60:95] = g == 0
        there[[20, 33]] = False
        for t in np.flatnonzero(there):
            rows.append((g, step(int(t)), float(x[t]), None if t == 120 else float(y[t])))
            held[g, int(t)] = (x[t], None if t == 120 else y[t])
    # samples between the hours neither fill the gaps nor count under their kernels
    rows += [(1, step(0.5 + 24 * k), 1.0, 1.0) for k in range(3)]
    kernel = (rng.uniform(0.5, 1.0, n)).tolist()
    df = spark.createDataFrame(rows, "g int, ocean_time timestamp_ntz, x double, y double").repartition(7)
    got = {(r.g, r.ocean_time): (r.x, r.y) for r in series.lowpass(df, ["g"], "ocean_time", ["x", "y"], kernel, step=3600).collect()}
    assert len(got) == len(rows)
    lead = (n - 1) // 2
    for (g, t), _ in held.items():
        for k in range(2):
            under = [(kernel[b], t + lead - b) for b in range(n) if 0 <= t + lead - b < length]
            taken = [held.get((g, s), (None, None))[k] for _, s in under]
            value = got[g, step(t)][k]
            if any(v is None for v in taken):
                assert value is None
            else:
                assert value == pytest.approx(sum(w * v for (w, _), v in zip(under, taken)) / sum(kernel), rel=1e-11, abs=1e-12)


def test_a_time_that_occurs_twice_hides_no_gap(spark):
    x = [(0, step(n), 1.0) for n in range(12) if n != 5] + [(0, step(4), 2.0), (0, step(6), 0.0)]
    df = spark.createDataFrame(x, "g int, ocean_time timestamp_ntz, x double")
    got = {r.ocean_time: r.x for r in series.lowpass(df, ["g"], "ocean_time", ["x"], [1.0, 1.0, 1.0], step=3600).collect()}
    assert len(got) == 11 and got[step(4)] is None and got[step(6)] is None and got[step(3)] == pytest.approx(5 / 3)


def test_lowpass_moves_little_more_than_a_row_a_sample(spark):
    df = spark.range(40_000).select(F.lit(0).alias("g"), F.timestamp_seconds(F.col("id") * 3600).cast("timestamp_ntz").alias("ocean_time"), F.rand(1).alias("x"))
    out = series.lowpass(df, ["g"], "ocean_time", ["x"], series.hann(72), step=3600)
    assert out.count() == 40_000
    # samples that reach two blocks: 71 of each 2048
    blocks = (F.floor((F.col("id") - 35) / series.BLOCK) != F.floor((F.col("id") + 36) / series.BLOCK)).cast("int")
    assert spark.range(40_000).agg(F.sum(1 + blocks)).first()[0] < 1.05 * 40_000
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode(sequence(") == 1


def test_fractions_of_a_second_count(spark):
    df = spark.sql("SELECT 0 AS g, CAST(s AS timestamp_ntz) AS ocean_time, x FROM VALUES ('2020-01-01 00:00:00.5', 1.0D), ('2020-01-01 00:00:02.5', 3.0D) t(s, x)")
    assert df.where(tp.at_time("2020-01-01 00:00:00.5")).count() == 1 and df.where(tp.at_time("2020-01-01 00:00:00")).count() == 0
    assert df.where(tp.between_times("2020-01-01 00:00:00.6", "2020-01-01 00:00:02.5")).count() == 1
    got = [(str(r.ocean_time), r.x) for r in series.resample_linear(df, ["g"], "ocean_time", ["x"], 1).orderBy("ocean_time").collect()]
    assert got == [("2020-01-01 00:00:01", 1.5), ("2020-01-01 00:00:02", 2.5)]
    with pytest.raises(ValueError):
        tp.at_time("2020-01-01.5")


def test_keyless_series_spread_over_the_data(spark):
    df = spark.range(2000).select((F.expr("TIMESTAMP_NTZ'2024-01-03 00:00:00'") + F.make_dt_interval(secs=F.col("id").cast("decimal(18,6)"))).alias("ocean_time"), F.col("id").alias("x"))
    assert ordered._bucketed(df, "ocean_time", "range").select("__bucket").distinct().count() == ordered.RANGE_BUCKETS
    assert ordered.with_position(df, [], "ocean_time").where("pos <> x").count() == 0
    assert ordered.with_previous(df, [], "ocean_time", ["x"]).where("x_prev = x - 1").count() == 1999


def test_keyless_series_spread_however_the_samples_lie(spark):
    """All but a few samples within a thousandth of the span, and times that occur often."""
    at = F.when(F.col("id") < 5, F.col("id") * 100_000_000).when(F.col("id") < 200, F.lit(250_000_000)).otherwise(300_000_000 + F.col("id") * 7)
    df = spark.range(6000).select(F.timestamp_seconds(at).cast("timestamp_ntz").alias("ocean_time"), F.col("id").alias("x")).repartition(9)
    sizes = [r["count"] for r in ordered._bucketed(df, "ocean_time", "range").groupBy("__bucket").count().collect()]
    assert len(sizes) > 200 and sum(sizes) == 6000 and max(sizes) <= 195 + 2 * 6000 // ordered.RANGE_BUCKETS
    single = df.dropDuplicates(["ocean_time"])
    got = sorted((r.ocean_time, r.pos) for r in ordered.with_position(single, [], "ocean_time").collect())
    assert [p for _, p in got] == list(range(len(got)))
    before = {r.ocean_time: r.ocean_time_prev for r in ordered.with_previous(single, [], "ocean_time", ["x"]).collect()}
    assert all(before[b] == a for (a, _), (b, _) in zip(got, got[1:])) and before[got[0][0]] is None
    empty = single.limit(0)
    assert ordered.with_position(empty, [], "ocean_time").count() == 0
