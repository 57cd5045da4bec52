import pytest
from shapes import make_columns, uniform_levels
from pyspark.sql import functions as F

from haloflux.operators import budgets, exchange, volumes
from haloflux.plans import tef
from haloflux.schema import BinSpec, ControlVolume

LINEAR = lambda t, k, j, i: 30.0 + i + 10.0 * j + 0.5 * k
LEV = uniform_levels(3)
SALT = BinSpec("salt", 0.0, 120.0, 240)


def by_face(samples, column):
    return {(r.face, r.k, r.pos): r[column] for r in samples.collect()}


def test_slices_to_volumes_under_both_conventions():
    closed = ControlVolume.from_slices(0, slice(50, 250), slice(150, 350))
    assert (closed.i0, closed.i1, closed.j0, closed.j1) == (50, 250, 150, 350)
    assert closed.face_lines == {"W": 49, "E": 250, "S": 149, "N": 350}
    half = ControlVolume.from_slices(0, slice(260, 380), slice(47, 148), "halfopen")
    assert (half.i0, half.i1, half.j0, half.j1) == (260, 379, 47, 147)
    assert half.face_lines == {"W": 259, "E": 378, "S": 46, "N": 146}
    with pytest.raises(ValueError):
        ControlVolume(0, 3, 2, 0, 1)


def test_split_order_and_shared_lines():
    half = ControlVolume.from_slices(0, slice(260, 380), slice(47, 148), "halfopen")
    sw, nw, se, ne = half.split(2, 2)
    assert (sw.i0, sw.i1, sw.j0, sw.j1) == (260, 319, 47, 96)
    assert (ne.i0, ne.i1, ne.j0, ne.j1) == (319, 379, 96, 147)
    assert sw.face_lines["E"] == se.face_lines["W"] and sw.face_lines["N"] == nw.face_lines["S"]
    parts = ControlVolume(0, 0, 6, 0, 4).split(3, 2)
    cells = [(i, j) for p in parts for i in range(p.i0, p.i1 + 1) for j in range(p.j0, p.j1 + 1)]
    assert len(cells) == len(set(cells)) == 35


def test_transport_and_tracers_by_hand(spark):
    cols = make_columns(spark, nj=6, ni=6, salt=LINEAR, u=lambda t, k, j, i: 0.1 * i, v=lambda t, k, j, i: 0.1 * j)
    box = ControlVolume(0, 2, 3, 2, 3)
    s = volumes.tracer_transports(volumes.face_samples(cols, [box], LEV, ("salt", "temp")))
    assert s.count() == 4 * 2 * 3
    q, salt, qs = by_face(s, "q"), by_face(s, "salt"), by_face(s, "qs")
    assert q["W", 0, 2] == pytest.approx(0.1 * 10.0 * 1000.0)
    assert q["E", 0, 2] == pytest.approx(0.3 * 10.0 * 1000.0)
    assert salt["W", 1, 2] == pytest.approx(30 + 1.5 + 20 + 0.5)
    assert salt["N", 1, 2] == pytest.approx(30 + 2 + 35 + 0.5)
    assert qs["W", 0, 2] == pytest.approx(q["W", 0, 2] * salt["W", 0, 2])
    assert by_face(s, "z")["W", 2, 3] == pytest.approx(-5.0)
    assert by_face(s, "dv")["S", 2, 3] == pytest.approx(1e7)


def test_half_open_faces_lie_one_cell_in(spark):
    cols = make_columns(spark, nj=8, ni=8, u=lambda t, k, j, i: float(i), v=lambda t, k, j, i: float(j))
    closed, half = ControlVolume(0, 2, 5, 2, 5), ControlVolume(1, 2, 5, 2, 5, "halfopen")
    vel = {(r.cv_id, r.face): r.vel for r in volumes.face_samples(cols, [closed, half], LEV, ()).where("k = 0 and pos = 2").collect()}
    assert [vel[0, f] for f in "WESN"] == [1.0, 5.0, 1.0, 5.0]
    assert [vel[1, f] for f in "WESN"] == [1.0, 4.0, 1.0, 4.0]


def test_extrapolated_edges_only_change_west_and_south(spark):
    cols = make_columns(spark, nj=6, ni=6, salt=lambda t, k, j, i: 20.0 + i * i + j)
    box = ControlVolume(0, 2, 4, 2, 4)
    mean = by_face(volumes.face_samples(cols, [box], LEV), "salt")
    ext = by_face(volumes.face_samples(cols, [box], LEV, edge="extrapolate"), "salt")
    assert mean["W", 0, 2] == pytest.approx(22 + 2.5)
    assert ext["W", 0, 2] == pytest.approx(22 + 1.5 * 4 - 0.5 * 9)
    assert ext["E", 0, 2] == mean["E", 0, 2] and ext["N", 0, 3] == mean["N", 0, 3]


def test_missing_column_makes_the_face_value_missing(spark):
    cols = make_columns(spark, nj=6, ni=6, skip={(2, 1)})
    s = volumes.face_samples(cols, [ControlVolume(0, 2, 3, 2, 3)], LEV)
    west = s.where("face = 'W' and pos = 2").collect()
    assert len(west) == 3 and all(r.salt is None and r.q is None for r in west)


def test_membership_paths_agree(spark):
    cols = make_columns(spark, nj=8, ni=8)
    many = [ControlVolume(n, n % 5, n % 5 + 2, n // 5, n // 5 + 3) for n in range(20)]
    want = {(v.cv_id, j, i) for v in many for i in range(v.i0, v.i1 + 1) for j in range(v.j0, v.j1 + 1)}
    got = {(r.cv_id, r.j, r.i) for r in volumes.in_volumes(cols, many).collect()}
    assert got == want
    few = {(r.cv_id, r.j, r.i) for v in range(0, 20, 10) for r in volumes.in_volumes(cols, many[v : v + 10]).collect()}
    assert few == want


def test_large_volume_tables_are_joined_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(volumes, "BROADCAST_ROWS", 10)
    cols = make_columns(spark, nj=8, ni=8)
    many = [ControlVolume(n, n % 5 + 1, n % 5 + 2, n // 5 + 1, n // 5 + 3) for n in range(20)]
    want = {(v.cv_id, j, i) for v in many for i in range(v.i0, v.i1 + 1) for j in range(v.j0, v.j1 + 1)}
    assert {(r.cv_id, r.j, r.i) for r in volumes.in_volumes(cols, many).collect()} == want
    assert volumes.face_samples(cols, many, LEV).where("q is not null").count() == sum(
        3 * 2 * (v.i1 - v.i0 + v.j1 - v.j0 + 2) for v in many
    )


def test_boxes_sum_to_the_whole_volume(spark):
    cols = make_columns(spark, nj=8, ni=8, u=lambda t, k, j, i: 0.3 * i - 0.1 * j * k, v=lambda t, k, j, i: 0.2 * j + 0.05 * i * k, salt=LINEAR)
    whole = ControlVolume(9, 1, 6, 1, 6)
    s = volumes.tracer_transports(volumes.face_samples(cols, [whole, *whole.split(2, 2)], LEV))
    total = {r.cv_id: (r.q, r.qs) for r in s.groupBy("cv_id").agg(
        F.sum(exchange.inward(F.col("face")) * F.col("q")).alias("q"),
        F.sum(exchange.inward(F.col("face")) * F.col("qs")).alias("qs")).collect()}
    assert sum(total[c][0] for c in range(4)) == pytest.approx(total[9][0])
    assert sum(total[c][1] for c in range(4)) == pytest.approx(total[9][1])


def test_constant_salinity_invariants(spark):
    cols = make_columns(spark, nt=2, nj=6, ni=6, u=lambda t, k, j, i: 0.5 - 0.4 * k, v=lambda t, k, j, i: 0.1 * (i - 2))
    box = ControlVolume(0, 2, 4, 2, 4)
    samples = tef.face_transports(cols, [box], LEV)
    for r in samples.collect():
        assert r.qs == pytest.approx(32.0 * r.q) and r.svar == pytest.approx(0.0, abs=1e-20)
    flow = tef.total_exchange_flow(cols, [box], LEV, {"salt": SALT}).collect()
    for r in flow:
        for s in (r["sin"], r["sout"]):
            assert s is None or s == pytest.approx(32.0)
    terms = tef.budget(cols, [box], LEV, SALT).first()
    assert terms.chi == 0.0 and terms.dsvardt == pytest.approx(0.0, abs=1e-6)


def test_divergence_free_flow_conserves_volume(spark):
    cols = make_columns(spark, nt=3, nj=6, ni=6, u=lambda t, k, j, i: 0.5, v=lambda t, k, j, i: -0.25)
    terms = tef.budget(cols, [ControlVolume(0, 1, 4, 1, 4)], LEV, SALT).collect()
    assert len(terms) == 2
    for r in terms:
        assert r.dVdt == pytest.approx(0.0, abs=1e-9) and r.voladv == pytest.approx(0.0, abs=1e-6)


def test_two_layer_exchange_by_hand(spark):
    lev = uniform_levels(2)
    # salty inflow below, fresh outflow above, through the west face only
    cols = make_columns(
        spark, nk=2, nj=4, ni=4, salt=lambda t, k, j, i: [34.25, 30.25][k], u=lambda t, k, j, i: [0.2, -0.1][k] if i == 0 else 0.0
    )
    r = tef.total_exchange_flow(cols, [ControlVolume(0, 1, 2, 1, 2)], lev, {"salt": SALT}).first()
    q = 15.0 * 1000.0 * 2
    assert r.Qin == pytest.approx(0.2 * q) and r.Qout == pytest.approx(-0.1 * q)
    assert r["sin"] == pytest.approx(34.25) and r["sout"] == pytest.approx(30.25)
    assert r.saltadv == pytest.approx(0.2 * q * 34.25 - 0.1 * q * 30.25)


def test_variance_transport_from_moments_equals_direct(spark):
    cols = make_columns(spark, nt=2, nj=6, ni=6, salt=lambda t, k, j, i: 25.0 + (i * 7 + j * 3 + k * 5 + t) % 11, u=lambda t, k, j, i: ((i + j + k) % 5 - 2) / 4, v=lambda t, k, j, i: ((2 * i + j + k) % 5 - 2) / 4)
    boxes = ControlVolume(0, 1, 4, 1, 4).split(2, 2)
    direct = exchange.exchange_flow_from_samples(tef.face_transports(cols, boxes, LEV), {"salt": SALT}, tef.KEYS)
    moments = tef.total_exchange_flow(cols, boxes, LEV, {"salt": SALT})
    a = {(r.cv_id, r.ocean_time): r for r in direct.collect()}
    for r in moments.collect():
        d = a[r.cv_id, r.ocean_time]
        for c in ("Qin", "Qout", "Qsvarin", "Qsvarout", "ssaltadv", "svaradv"):
            assert r[c] == pytest.approx(d[c], rel=1e-9, abs=1e-6)


def test_face_pruning_reaches_the_scan(spark, tmp_path):
    make_columns(spark, nj=6, ni=6).write.parquet(str(tmp_path / "c"))
    cols = spark.read.parquet(str(tmp_path / "c"))
    df = volumes.face_samples(cols, [ControlVolume(0, 2, 3, 2, 3)], LEV)
    plan = df._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    assert "GreaterThanOrEqual(i,1)" in plan and "temp" not in scan.split("ReadSchema")[1]


def test_cells_split_volume_by_class_and_lose_nothing(spark):
    cols = make_columns(spark, nj=5, ni=5, salt=LINEAR)
    cells = budgets.volume_cells(cols, [ControlVolume(0, 1, 3, 1, 3)], LEV)
    assert cells.agg(F.sum("dV")).first()[0] == pytest.approx(9 * 30.0 * 1e6)


def test_third_face_convention_and_half_open_means():
    box = ControlVolume.from_slices(0, slice(4, 9), slice(2, 6), "beyond")
    assert (box.i0, box.i1, box.j0, box.j1) == (4, 8, 2, 5)
    assert box.face_lines == {"W": 3, "E": 9, "S": 1, "N": 6}
    less = ControlVolume(0, 4, 9, 2, 6).without_last()
    assert (less.i1, less.j1, less.i0, less.j0) == (8, 5, 4, 2)


@pytest.mark.parametrize("most", [1, 2, 64])
def test_line_predicate_never_drops_a_line(spark, monkeypatch, most):
    monkeypatch.setattr(volumes, "PREDICATE_RANGES", most)
    lines = {1, 2, 3, 10, 11, 40}
    got = {r.i for r in spark.range(60).select(F.col("id").alias("i")).where(volumes._on_lines("i", lines)).collect()}
    assert lines <= got and (most < 64 or got == lines)


def test_a_thousand_boxes_in_one_pass_meet_few_columns_beyond_their_own(spark):
    """Boxes that tile the grid and some of other sizes: candidates stay within four times the hits."""
    cols = spark.range(160 * 160).select((F.col("id") % 160).cast("int").alias("i"), F.floor(F.col("id") / 160).cast("int").alias("j"))
    whole = [ControlVolume(n, 5 * (n % 32), 5 * (n % 32) + 4, 5 * (n // 32), 5 * (n // 32) + 4) for n in range(1024)]
    others = [ControlVolume(2000 + n, 7 * n, 7 * n + 40, 11 * n, 11 * n + 3) for n in range(10)] + [ControlVolume(3000, 0, 159, 0, 159), ControlVolume(3001, 3, 3, 8, 8)]
    many = whole + others
    got = volumes.in_volumes(cols, many)
    assert got.columns == ["i", "j", "cv_id"]
    sizes = {r.cv_id: r["count"] for r in got.groupBy("cv_id").count().collect()}
    assert sizes == {v.cv_id: (v.i1 - v.i0 + 1) * (v.j1 - v.j0 + 1) for v in many}
    assert volumes.tile_candidates(cols, whole).count() <= 4 * sum(sizes[v.cv_id] for v in whole)
    assert all(sum(r[4] == v.cv_id for r in volumes.tiles(many)) <= 9 for v in many)
    south_west = [ControlVolume(n, -9 + n, -5 + n, -7, -3) for n in range(20)]
    shifted = cols.selectExpr("i - 20 AS i", "j - 10 AS j")
    assert volumes.in_volumes(shifted, south_west).count() == 20 * 25
