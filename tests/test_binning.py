import numpy as np
import pytest
from pyspark.sql import functions as F

from haloflux.operators import histogram as H
from haloflux.schema import BinSpec


def reference_index(x, edges):
    """Half-open bins, last one closed, out of range is None."""
    out = np.searchsorted(edges, x, side="right") - 1
    out = np.where(x == edges[-1], len(edges) - 2, out)
    bad = ~((x >= edges[0]) & (x <= edges[-1]))
    return [None if b else int(o) for o, b in zip(out, bad)]


@pytest.mark.parametrize(
    "lo,hi,n", [(0.0, 40.0, 100), (0.0, 40.0, 200), (0.0, 40.0, 500), (0.0, 40.0, 1000), (-65.0, 0.0, 50), (0.0, 0.002, 199)]
)
def test_index_matches_numpy_at_every_edge(spark, lo, hi, n):
    edges = np.linspace(lo, hi, n + 1)
    spec = BinSpec("x", lo, hi, n)
    assert spec.edges == edges.tolist()
    rng = np.random.default_rng(7)
    x = np.concatenate(
        [edges, np.nextafter(edges, np.inf), np.nextafter(edges, -np.inf), rng.uniform(lo - 1, hi + 1, 2000), [np.nan]]
    )
    df = spark.createDataFrame([(int(m), float(v)) for m, v in enumerate(x)] + [(len(x), None)], "id int, x double")
    got = {r.id: r.b for r in df.select("id", spec.index(F.col("x")).alias("b")).collect()}
    want = reference_index(x, edges) + [None]
    assert [got[m] for m in range(len(x) + 1)] == want


def test_histogram_sums_in_range_samples_and_drops_the_rest(spark):
    rows = [("a", 0.0, 1.0), ("a", 0.5, 2.0), ("a", 1.0, 4.0), ("a", 2.0, 8.0), ("a", 2.1, 16.0), ("a", -0.1, 32.0), ("a", None, 64.0)]
    df = spark.createDataFrame(rows, "g string, x double, w double")
    spec = BinSpec("x", 0.0, 2.0, 2)
    out = {r.x_idx: (r.x_bin, r.s) for r in H.weighted_histogram(df, ["g"], {"x": spec}, {"s": F.col("w")}).collect()}
    assert out == {0: (0.5, 3.0), 1: (1.5, 12.0)}
    d = H.dropped_samples(df, ["g"], {"x": spec}).first()
    assert (d.n_samples, d.n_dropped) == (7, 3)


def test_dense_equals_sparse_plus_zeros_also_for_keys_without_samples(spark):
    rows = [("a", 0.1, 1.0), ("a", 3.9, 2.0), ("b", 9.0, 5.0), ("c", 2.0, 7.0), ("c", 2.5, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, w double")
    spec = BinSpec("x", 0.0, 4.0, 4)
    out = H.weighted_histogram(df, ["g"], {"x": spec}, {"s": F.col("w")}, dense=True).collect()
    table = {(r.g, r.x_idx): r.s for r in out}
    assert len(out) == len(table) == 12
    want = {("a", 0): 1.0, ("a", 3): 2.0, ("c", 2): 8.0}
    assert table == {(g, k): want.get((g, k), 0.0) for g in "abc" for k in range(4)}


def test_dense_two_dimensions(spark):
    rows = [("a", 0.5, 1.5, 1.0), ("a", 5.0, 0.5, 1.0), ("a", 0.5, 7.0, 1.0), ("a", 5.0, 7.0, 1.0), ("a", 1.5, 0.5, 3.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double, w double")
    bins = {"x": BinSpec("x", 0.0, 2.0, 2), "y": BinSpec("y", 0.0, 3.0, 3)}
    out = H.weighted_histogram(df, ["g"], bins, {"s": F.col("w")}, dense=True).collect()
    assert {(r.x_idx, r.y_idx): r.s for r in out} == {
        (0, 0): 0.0, (0, 1): 1.0, (0, 2): 0.0, (1, 0): 3.0, (1, 1): 0.0, (1, 2): 0.0
    }


def test_two_dimensional_sums_to_one_dimensional_and_halving_width_nests(spark):
    rng = np.random.default_rng(3)
    rows = [(float(a), float(b), float(w)) for a, b, w in zip(rng.uniform(0, 40, 500), rng.uniform(0, 40, 500), rng.integers(-8, 8, 500))]
    df = spark.createDataFrame(rows, "s double, t double, w double")
    w = {"v": F.col("w")}
    salt, temp = BinSpec("s", 0.0, 40.0, 40), BinSpec("t", 0.0, 40.0, 10)
    one = {r.s_idx: r.v for r in H.weighted_histogram(df, [], {"s": salt}, w).collect()}
    two = H.weighted_histogram(df, [], {"s": salt, "t": temp}, w).groupBy("s_idx").agg(F.sum("v").alias("v")).collect()
    assert one == {r.s_idx: r.v for r in two}
    coarse = {r.s_idx: r.v for r in H.weighted_histogram(df, [], {"s": BinSpec("s", 0.0, 40.0, 20)}, w).collect()}
    pairs = {}
    for k, v in one.items():
        pairs[k // 2] = pairs.get(k // 2, 0.0) + v
    assert coarse == pairs


def test_density_integrates_to_one_over_in_range_samples(spark):
    df = spark.createDataFrame([(float(x),) for x in [0.1, 0.2, 1.1, 1.9, 2.5, 99.0]], "x double")
    spec = BinSpec("x", 0.0, 3.0, 6)
    out = H.density_histogram(df, "x", spec).collect()
    assert sum(r.n for r in out) == 5
    assert sum(r.density for r in out) * 0.5 == pytest.approx(1.0)


def test_range_histogram_matches_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=3000)
    out = H.range_histogram(spark.createDataFrame([(float(v),) for v in x], "x double"), "x", 50).collect()
    want, _ = np.histogram(x, bins=50)
    got = np.zeros(50, int)
    for r in out:
        got[r.value_idx] = r.n
    assert got.tolist() == want.tolist()


def test_range_histogram_of_a_constant(spark):
    out = H.range_histogram(spark.createDataFrame([(2.0,)] * 3, "x double"), "x", 5).collect()
    assert sum(r.n for r in out) == 3


@pytest.mark.parametrize("n", [1, 2, 5, 63, 64, 65, 500])
def test_unequal_bins_match_numpy_at_every_edge(spark, n):
    """Nested comparisons up to 64 bins, a search in a constant array beyond."""
    rng = np.random.default_rng(n)
    edges = np.cumsum(rng.exponential(size=n + 1)) - 3.0
    spec = BinSpec.from_edges("x", edges)
    assert spec.edges == edges.tolist() and spec.n == n
    x = np.concatenate(
        [edges, np.nextafter(edges, np.inf), np.nextafter(edges, -np.inf), rng.uniform(edges[0] - 1, edges[-1] + 1, 500), [np.nan, np.inf, -np.inf]]
    )
    df = spark.createDataFrame([(int(m), float(v)) for m, v in enumerate(x)] + [(len(x), None)], "id int, x double")
    got = {r.id: r.b for r in df.select("id", spec.index(F.col("x")).alias("b")).collect()}
    assert [got[m] for m in range(len(x) + 1)] == reference_index(x, edges) + [None]
    middle = [r.x_bin for r in spec.table(spark).orderBy("x_idx").collect()]
    assert middle == [0.5 * (a + b) for a, b in zip(edges, edges[1:])]


@pytest.mark.parametrize("edges", [[], [1.0], [1.0, 1.0], [0.0, 2.0, 1.0], [0.0, float("nan"), 1.0], [0.0, float("inf")]])
def test_edges_must_increase(edges):
    with pytest.raises(ValueError):
        BinSpec.from_edges("x", edges)


def test_density_in_unequal_bins_integrates_to_one(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(30.0, 3.0, 3000)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    edges = [20.0, 25.0, 25.5, 30.0, 36.0, 50.0]
    out = H.density_histogram(df, "x", BinSpec.from_edges("x", edges), dense=True).orderBy("x_idx").collect()
    want, _ = np.histogram(x, edges, density=True)
    assert [r.density for r in out] == pytest.approx(want.tolist(), rel=1e-12)


def test_quantile_bins_hold_about_equally_many_samples(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.exponential(2.0, 5000), [39.99, 99.0]])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double").repartition(5)
    spec = H.quantile_bins(df, "x", BinSpec("x", 0.0, 40.0, 4000), 10)
    n = [r.n for r in H.weighted_histogram(df, [], {"x": spec}, {"n": F.lit(1.0)}).orderBy("x_idx").collect()]
    assert len(n) == 10 and sum(n) == 5001 and max(n) < 1.15 * 500 and min(n) > 0.85 * 500
    one = H.quantile_bins(spark.createDataFrame([(1.0,)] * 9, "x double"), "x", BinSpec("x", 0.0, 2.0, 4), 5)
    assert one.edges == [1.0, 1.5]
    with pytest.raises(ValueError):
        H.quantile_bins(df.where("x > 50"), "x", BinSpec("x", 0.0, 40.0, 4), 2)


def test_announced_keys_keep_the_bins_they_have(spark):
    rows = [("a", 0.5, 1.5, 2.0), ("b", 9.0, 1.5, 4.0), ("c", 9.0, 9.0, 8.0), ("d", None, None, 1.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double, w double")
    bins = {"x": BinSpec("x", 0.0, 2.0, 2), "y": BinSpec("y", 0.0, 2.0, 2)}
    out = H.weighted_histogram(df, ["g"], bins, {"s": F.col("w")}, announce=True).collect()
    assert {(r.g, r.x_idx, r.y_idx, r.s) for r in out} == {("a", 0, 1, 2.0), ("b", None, 1, 0.0), ("c", None, None, 0.0), ("d", None, None, 0.0)}
