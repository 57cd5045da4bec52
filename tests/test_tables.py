from datetime import datetime

import pytest
from shapes import make_columns, uniform_levels
from pyspark.sql import functions as F

from haloflux.functions.timeparts import at_time
from haloflux.operators import exchange, grid, volumes
from haloflux.plans import catalog
from haloflux.schema import CELLS_SCHEMA, COLUMNS_SCHEMA, BinSpec, ControlVolume, control_volume_table
from haloflux.sources import adapters, ledger, tables, versions
from haloflux.streaming import daily

SALT = BinSpec("salt", 0.0, 60.0, 60)


def test_scan_of_files_and_glob_and_missing_values(spark, tmp_path):
    cols = make_columns(spark, nt=3, nj=2, ni=2, salt=lambda t, k, j, i: float("nan") if k == 0 else 30.0, zeta=lambda t, j, i: float("nan") if t == 0 else 0.0)
    for t in range(3):
        cols.where(F.hour("ocean_time") == t).coalesce(1).write.parquet(str(tmp_path / f"his_{t}"))
    glob = tables.open_columns(spark, str(tmp_path / "his_*"))
    some = tables.open_columns(spark, [str(tmp_path / "his_0"), str(tmp_path / "his_2")])
    assert glob.schema == COLUMNS_SCHEMA and glob.count() == 12 and some.count() == 8
    r = glob.agg(F.count("zeta").alias("z"), F.max(F.get("salt", F.lit(0))).alias("s"), F.max(F.get("salt", F.lit(1))).alias("t")).first()
    assert (r.z, r.s, r.t) == (8, None, 30.0)


def test_long_cells_pack_to_the_column_layout(spark):
    n = 3
    cols = make_columns(spark, nt=2, nj=2, ni=2, salt=lambda t, k, j, i: 20.0 + t + k + 2 * j + 3 * i, aks=lambda t, k, j, i: 1e-3 * k)
    cells = grid.unpack_levels(cols, n + 1, ["salt", "temp", "aks", "u", "v"]).select(CELLS_SCHEMA.names)
    surface = cols.select("ocean_time", "j", "i", "zeta", "ssflux")
    static = cols.select("j", "i", "h", "pm", "pn", "f", "lon_rho", "lat_rho").distinct()
    back = tables.pack_cells(cells, surface, static, n).select(COLUMNS_SCHEMA.names)
    order = ["ocean_time", "j", "i"]
    assert back.orderBy(order).collect() == cols.orderBy(order).collect()


def test_daily_overwrite_leaves_other_days(spark, tmp_path):
    out = str(tmp_path / "daily")
    df = spark.createDataFrame([("2010-06-01 03:00:00", 1.0), ("2010-06-02 04:00:00", 2.0)], "s string, q double").selectExpr("CAST(s AS timestamp_ntz) AS ocean_time", "q")
    tables.write_daily(df, out)
    tables.write_daily(df.where("q = 2").withColumn("q", F.lit(5.0)), out)
    assert sorted(r.q for r in tables.scan(spark, out).collect()) == [1.0, 5.0]
    back = tables.scan(spark, out).where(at_time("2010-06-02-04", date_column="ocean_date"))
    assert [r.q for r in back.collect()] == [5.0]
    assert "PartitionFilters: [isnotnull(ocean_date" in back._jdf.queryExecution().executedPlan().toString()


def test_month_chunk_and_volume_partitions(spark, tmp_path):
    df = spark.createDataFrame([(n % 2, f"2010-0{6 + n // 40}-0{1 + n % 9} 00:00:00", float(n)) for n in range(80)], "cv_id int, s string, q double")
    df = df.selectExpr("cv_id", "CAST(s AS timestamp_ntz) AS ocean_time", "q")
    tables.write_monthly(df, str(tmp_path / "m"))
    assert {(r.year, r.month) for r in tables.scan(spark, str(tmp_path / "m")).select("year", "month").distinct().collect()} == {(2010, 6), (2010, 7)}
    tables.write_per_volume(df, str(tmp_path / "v"))
    assert tables.scan(spark, str(tmp_path / "v")).where("cv_id = 1").count() == 40
    tables.write_chunked(df, str(tmp_path / "c"), 4, ["cv_id"])
    back = tables.scan(spark, str(tmp_path / "c"))
    assert back.count() == 80 and back.select("chunk_id").distinct().count() == 4


def test_metadata_beside_the_result(spark, tmp_path):
    box = ControlVolume(3, 50, 250, 150, 350)
    meta = tables.run_metadata(spark, "volume transport", [box], {"salt": 100}, {"q": "m^3 s^-1"}, datetime(2010, 1, 1))
    versions.publish({"data": spark.range(3), "metadata": meta}, str(tmp_path / "r"))
    m = versions.read(spark, str(tmp_path / "r"), "metadata").first()
    assert m.volumes[0].i1 == 250 and m.n_bins == {"salt": 100} and m.created == datetime(2010, 1, 1)
    assert versions.read(spark, str(tmp_path / "r")).count() == 3
    assert control_volume_table(spark, [box]).first().convention == "closed"


def test_dimension_names_and_merge(spark):
    df = spark.createDataFrame([(1, 2, 3.0)], "eta_u int, xi_u int, u double")
    assert tables.unify_dimensions(df).columns == ["eta_rho", "xi_u", "u"]
    a = spark.createDataFrame([(0, 1.0), (1, 2.0)], "k int, a double")
    b = spark.createDataFrame([(1, 5.0), (2, 6.0)], "k int, b double")
    got = {r.k: (r.a, r.b) for r in tables.merge_results([a, b], ["k"]).collect()}
    assert got == {0: (1.0, None), 1: (2.0, 5.0), 2: (None, 6.0)}


def test_streamed_partials_merge_to_the_batch_result(spark, tmp_path):
    lev = uniform_levels(3)
    cols = make_columns(spark, nt=4, nj=5, ni=5, salt=lambda t, k, j, i: 20.0 + i + 3 * j + k + t, u=lambda t, k, j, i: 0.5 - 0.25 * k, v=lambda t, k, j, i: 0.25 * (i - 2))
    src, out, ck = (str(tmp_path / d) for d in ("in", "out", "ck"))
    box = [ControlVolume(0, 1, 3, 1, 3)]
    keys = ["cv_id", "ocean_time"]

    def build(df):
        s = volumes.tracer_transports(volumes.face_samples(df, box, lev))
        return exchange.net_from_samples(s.select(*keys, "face", "salt", "q", "qs"), {"salt": SALT}, keys)

    def run():
        daily.stream_histogram(spark, src, COLUMNS_SCHEMA, build, out, ck, files_per_batch=1).awaitTermination()

    cols.where(F.hour("ocean_time") < 2).coalesce(1).write.mode("append").parquet(src)
    run()
    cols.where(F.hour("ocean_time") >= 2).coalesce(1).write.mode("append").parquet(src)
    run()
    run()
    net = daily.merged(spark, out, [*keys, "salt_idx", "salt_bin"], ["Qnet", "Qsnet"])
    got = exchange.exchange_flow(net, keys).orderBy("ocean_time").collect()
    want = exchange.exchange_flow(build(cols), keys).orderBy("ocean_time").collect()
    assert len(got) == 4
    for a, b in zip(got, want):
        assert a.ocean_time == b.ocean_time
        assert [a[c] for c in ("Qin", "Qout", "Qsin", "Qsout")] == pytest.approx([b[c] for c in ("Qin", "Qout", "Qsin", "Qsout")])


class FakeSession:
    def __init__(self, folder):
        self.conf = self
        self.folder = folder

    def get(self, key, default=None):
        return self.folder if key == "spark.checkpoint.dir" else default


def test_checkpoint_folder_comes_from_the_session():
    assert daily.checkpoint_location(FakeSession("/shared/ck/"), "x") == "/shared/ck/x"
    with pytest.raises(ValueError):
        daily.checkpoint_location(FakeSession(None), "x")


def test_a_second_run_leaves_nothing_of_the_first(spark, tmp_path):
    df = spark.createDataFrame([(n % 3, f"2010-06-{1 + n:02d} 00:00:00", float(n)) for n in range(12)], "cv_id int, s string, q double")
    df = df.selectExpr("cv_id", "CAST(s AS timestamp_ntz) AS ocean_time", "q")
    for chunks in (6, 3):
        tables.write_chunked(df, str(tmp_path / "c"), chunks)
        assert tables.scan(spark, str(tmp_path / "c")).count() == 12
    meta = tables.run_metadata(spark, "q")
    for kept in (df, df.where("cv_id < 2")):
        tables.write_per_volume(kept, str(tmp_path / "v"))
        versions.publish({"data": kept, "metadata": meta}, str(tmp_path / "m"), ["cv_id"])
        assert tables.scan(spark, str(tmp_path / "v")).count() == versions.read(spark, str(tmp_path / "m")).count() == kept.count()


def test_overlapping_files_count_once(spark, tmp_path):
    cols = make_columns(spark, nt=3, nj=2, ni=2)
    cols.where(F.hour("ocean_time") < 2).coalesce(1).write.parquet(str(tmp_path / "his_a"))
    cols.where(F.hour("ocean_time") > 0).coalesce(1).write.parquet(str(tmp_path / "his_b"))
    paths = [str(tmp_path / "his_a"), str(tmp_path / "his_b")]
    assert tables.open_columns(spark, paths).count() == 16
    once = tables.open_columns(spark, paths, overlap="last")
    assert once.count() == 12 and once.columns == cols.columns
    with pytest.raises(ValueError):
        tables.open_columns(spark, paths, overlap="first")


def test_a_new_checkpoint_starts_over(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for n in range(3):
        spark.createDataFrame([(0, float(n))], "k int, q double").coalesce(1).write.mode("append").parquet(src)

    def run(checkpoint, files):
        daily.stream_histogram(spark, src, "k int, q double", lambda d: d.groupBy("k").agg(F.sum("q").alias("q")), out, str(tmp_path / checkpoint), files_per_batch=files).awaitTermination()
        return daily.merged(spark, out, ["k"], ["q"]).first().q

    assert run("first", 1) == 3.0
    assert run("second", None) == 3.0


class Died(Exception):
    pass


def test_a_run_that_dies_between_its_parts_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "r")
    with pytest.raises(FileNotFoundError):
        versions.read(spark, path)
    assert versions.publish({"data": spark.range(3), "about": spark.range(1)}, path) == 1
    real = versions.write
    for dies_at in ("/data", "/about"):

        def write(df, to, partition_by=(), dies_at=dies_at):
            if to.endswith(dies_at):
                raise Died
            real(df, to, partition_by)

        monkeypatch.setattr(versions, "write", write)
        with pytest.raises(Died):
            versions.publish({"data": spark.range(9), "about": spark.range(9)}, path)
        assert versions.read(spark, path).count() == 3 and versions.read(spark, path, "about").count() == 1
    monkeypatch.setattr(versions, "write", real)
    assert versions.publish({"data": spark.range(5), "about": spark.range(2)}, path) == 2
    assert versions.read(spark, path).count() == 5 and versions.read(spark, path, number=1).count() == 3
    assert [r.number for r in versions.published(spark, path).orderBy("number").collect()] == [1, 2]


def by_day(rows):
    return rows.groupBy("g", "ocean_time").agg(F.sum("q").alias("q"))


class Deliveries:
    """Files of (day, g, q) rows and what a ledger makes of them."""

    def __init__(self, spark, folder):
        self.spark, self.source, self.target = spark, folder / "in", str(folder / "out")
        self.source.mkdir()
        self.schema = "ocean_time timestamp_ntz, g int, q double"

    def file(self, name, rows, seconds):
        """Writes one Parquet file with a modification time of its own."""
        import os

        import pyarrow as pa
        import pyarrow.parquet as pq

        times = pa.array([datetime(2010, 6, d, 5) for d, _, _ in rows], pa.timestamp("us"))
        table = pa.table({"ocean_time": times, "g": pa.array([g for _, g, _ in rows], pa.int32()), "q": pa.array([q for _, _, q in rows], pa.float64())})
        pq.write_table(table, self.source / name)
        os.utime(self.source / name, (seconds, seconds))

    def take(self, build=by_day):
        return ledger.deliver(self.spark, str(self.source), build, self.target, self.schema)

    def sums(self):
        rows = ledger.merged(self.spark, self.target, ["g", "ocean_time"], ["q"]).collect()
        return {(r.ocean_time.day, r.g): r.q for r in rows}


def test_days_delivered_again_replace_themselves(spark, tmp_path):
    d = Deliveries(spark, tmp_path)
    d.file("a.parquet", [(1, 0, 1.0), (2, 0, 2.0)], 1000)
    d.file("b.parquet", [(2, 1, 4.0), (3, 0, 8.0)], 1000)
    assert d.take() == 1 and d.take() is None
    assert d.sums() == {(1, 0): 1.0, (2, 0): 2.0, (2, 1): 4.0, (3, 0): 8.0}
    # a day under a new name, with fewer groups, and a new day
    d.file("c.parquet", [(2, 0, 16.0), (4, 0, 32.0)], 2000)
    assert d.take() == 2 and d.sums() == {(1, 0): 1.0, (2, 0): 16.0, (3, 0): 8.0, (4, 0): 32.0}
    # a file rewritten in place: its other days and the unchanged file that shares one of them stay whole
    d.file("d.parquet", [(5, 0, 1.0)], 3000)
    d.file("e.parquet", [(5, 0, 2.0), (6, 0, 3.0)], 3000)
    assert d.take() == 3 and d.sums()[5, 0] == 3.0
    d.file("d.parquet", [(5, 0, 10.0), (5, 1, 1.0)], 4000)
    assert d.take() == 4 and {k: v for k, v in d.sums().items() if k[0] > 4} == {(5, 0): 12.0, (5, 1): 1.0, (6, 0): 3.0}
    # a day that the rewritten file no longer holds goes
    d.file("c.parquet", [(2, 0, 16.0)], 5000)
    assert d.take() == 5 and d.sums() == {(1, 0): 1.0, (2, 0): 16.0, (3, 0): 8.0, (5, 0): 12.0, (5, 1): 1.0, (6, 0): 3.0}


def test_a_delivery_that_dies_is_taken_again(spark, tmp_path, monkeypatch):
    d = Deliveries(spark, tmp_path)
    d.file("a.parquet", [(1, 0, 1.0)], 1000)
    assert d.take() == 1
    d.file("b.parquet", [(1, 0, 5.0)], 2000)
    real = ledger.write

    def write(*args, **kwargs):
        real(*args, **kwargs)
        raise Died

    monkeypatch.setattr(ledger, "write", write)
    with pytest.raises(Died):
        d.take()
    monkeypatch.setattr(ledger, "write", real)
    assert d.sums() == {(1, 0): 1.0}
    assert d.take() == 2 and d.sums() == {(1, 0): 5.0}


def test_only_overlapping_files_are_shuffled(spark, tmp_path):
    cols = make_columns(spark, nt=8, nj=2, ni=2)
    hour = F.hour("ocean_time")
    for name, first, last in (("a", 0, 1), ("b", 2, 3), ("c", 3, 5), ("d", 6, 7)):
        cols.where(hour.between(first, last)).withColumn("zeta", F.lit(float(ord(name)))).coalesce(1).write.parquet(str(tmp_path / f"his_{name}"))
    apart = tables.open_columns(spark, [str(tmp_path / f"his_{n}") for n in "abd"], overlap="last")
    assert "Exchange" not in apart._jdf.queryExecution().executedPlan().toString() and apart.count() == 24
    df = tables.scan(spark, str(tmp_path / "his_*"), COLUMNS_SCHEMA)
    met = {r.file.split("his_")[1][0] for r in tables.overlapping(tables.file_spans(df)).collect()}
    assert met == {"b", "c"}
    for named in (1000, 1):
        tables.NAMED_FILES, before = named, tables.NAMED_FILES
        try:
            once = tables.open_columns(spark, str(tmp_path / "his_*"), overlap="last")
        finally:
            tables.NAMED_FILES = before
        got = {r.ocean_time.hour: (r.n, r.z) for r in once.groupBy("ocean_time").agg(F.count("j").alias("n"), F.max("zeta").alias("z")).collect()}
        assert got == {h: (4, float(ord("aabccdd"[h - (h > 3)] if h != 3 else "c"))) for h in range(8)}
        if named == 1000:
            # files without overlap are scanned in a branch of their own, before the only shuffle of the other branch
            plan = once._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == 1 and plan.index("Union") < plan.index("FileScan") < plan.index("Exchange")


@pytest.mark.parametrize("days", [2900, 30])
def test_a_delivery_is_written_by_many_tasks(spark, tmp_path, monkeypatch, days):
    # 30 days: all rows lie in the quarter where two deliveries overlap
    first = "1993-01-01" if days > 30 else "1995-08-01"
    items = spark.range(6000).selectExpr(
        f"CAST(date_add(DATE '{first}', CAST(pmod(hash(id, 1), {days}) AS int)) AS timestamp_ntz) AS l_shipdate",
        "CASE WHEN id % 50 > 0 THEN pmod(hash(id, 2), 1000L) END AS l_suppkey",
        "CASE WHEN id % 70 > 0 THEN pmod(hash(id, 3), 2000L) END AS l_partkey",
        "id DIV 4 AS l_orderkey", "CAST(id % 7 + 1 AS int) AS l_linenumber", "CAST(id % 50 AS double) AS l_quantity",
    )
    items.write.parquet(str(tmp_path / "lineitem.parquet"))
    monkeypatch.setattr(catalog, "_folder", lambda spark: str(tmp_path / "kept"))
    late = datetime(1995, 7, 1)
    want: dict[datetime, tuple[int, float]] = {}
    for r in adapters.grid_columns(spark, str(tmp_path)).select("ocean_time", "zeta").collect():
        n, zeta = want.get(r.ocean_time, (0, 0.0))
        want[r.ocean_time] = n + 1, zeta + (r.zeta or 0.0) + (r.zeta is not None and r.ocean_time >= late)
    merging = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(merging)
    spark.conf.set(merging, "false")
    try:
        got = {r.ocean_time: (r.n, r.zeta) for r in catalog.overlapping_files(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set(merging, before)
    assert got == want and len(want) == (1 if days == 30 else 32)
    for name in ("his_1", "his_2", "his_3") if days > 30 else ("his_2", "his_3"):
        files = [r["count"] for r in tables.scan(spark, str(tmp_path / "kept" / name)).groupBy("_metadata.file_path").count().collect()]
        assert len(files) > 1 and max(files) <= sum(files) / 2


def test_null_keys_meet_when_results_are_merged(spark):
    a = spark.createDataFrame([(None, 1.0), (1, 2.0)], "k int, a double")
    b = spark.createDataFrame([(None, 5.0), (2, 6.0)], "k int, b double")
    c = spark.createDataFrame([(None, 7.0)], "k int, c double")
    got = {r.k: (r.a, r.b, r.c) for r in tables.merge_results([a, b, c], ["k"]).collect()}
    assert got == {None: (1.0, 5.0, 7.0), 1: (2.0, None, None), 2: (None, 6.0, None)}
