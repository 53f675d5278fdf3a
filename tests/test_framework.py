import struct
import sys
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from cubeloom import likes, op
from cubeloom.cube import Cube, ValidationError
from cubeloom.functions.quantiles import exact_quantiles
from cubeloom.operators import alignment, data_frame, gapfilling, plotdata, regions, timeseries
from cubeloom.plans import chain
from cubeloom.sources import images, stores, vector
from cubeloom.streaming.windows import windowed_statistics


def grid(spark):
    rows = [(datetime(2000, m, 1), la * 10.0, lo * 10.0, float(m + la)) for m in (1, 2, 3) for la in range(3) for lo in range(4)]
    return Cube.of(spark.createDataFrame(rows, "time timestamp_ntz, lat double, lon double, v double"), ("time", "lat", "lon"))


def test_argument_kinds():
    assert likes.VarNamesLike.convert("a, b*") == ["a", "b*"] and likes.VarNamesLike.convert("") is None
    assert likes.TimeRangeLike.convert("2001-01, 2001-02") == (datetime(2001, 1, 1), datetime(2001, 2, 28, 23, 59, 59))
    assert likes.TimeLike.convert(date(2001, 5, 6)) == datetime(2001, 5, 6, 12) and likes.to_datetime("2001", upper=True) == datetime(2001, 12, 31, 23, 59, 59)
    assert likes.PointLike.convert("1.5, 2").wkt == "POINT (1.5 2)" and likes.PolygonLike.convert("0,0,1,1").area == 1
    assert likes.DictLike.convert("a=1, b='x'") == {"a": 1, "b": "x"} and likes.Literal.convert("[1, 2]") == [1, 2]
    for kind, bad in ((likes.TimeRangeLike, "2002, 2001"), (likes.PolygonLike, "POLYGON ((0 0, 1 1, 0 0))"), (likes.PolygonLike, "1,2"), (likes.PointLike, "0,0,1,1"), (likes.VarNamesLike, [1]), (likes.DictLike, "a=__import__('os')"), (likes.TimeLike, "yesterday")):
        assert not kind.accepts(bad), (kind, bad)


def test_operations_are_checked_and_leave_a_history(spark):
    registry = op.Registry()

    @op.op(version="2.0", tags=("test",), registry=registry, factor=dict(data_type=float, value_range=(0, 10)), mode=dict(value_set=["a", "b"]))
    def scale(ds, factor=2, mode="a"):
        """Scale.

        :param factor: by how much
        """
        return ds.on(ds.df.withColumn("v", F.col("v") * factor))

    cube = scale(scale(grid(spark)), factor=3)
    assert cube.attrs["history"].count("Modified with scale v2.0") == 2 and registry.names() == ["scale"]
    assert scale.meta()["inputs"]["factor"]["description"] == "by how much" and op.list_operations("test", registry=registry) == ["scale"]
    for bad in (dict(factor=11), dict(factor="x"), dict(mode="c"), dict(other=1)):
        with pytest.raises(ValidationError):
            scale(cube, **bad)
    with pytest.raises(ValidationError):
        registry.add(scale)
    with pytest.raises(ValidationError):
        op.get_op("nothing")
    monitor = op.Monitor()
    monitor.cancel()
    with pytest.raises(op.Cancelled):
        scale(cube, monitor=monitor)
    assert len(op.list_operations()) >= 49


def test_chains(spark, tmp_path):
    pool = stores.StorePool()
    pool.add_local_store(str(tmp_path), "here", persist=False)
    twice = chain.new_expression_op("twice", "v ** 2 + abs(lat)", "w")
    steps = [("subset_temporal", {"time_range": "2000-02, 2000-03"}), ("reduce", {"dim": "lon", "method": "max"}), twice, ("select_var", {"var": "w"}), ("select_var", {"var": "w"})]
    (cube, name), = chain.execute_operations(grid(spark), steps, write_results=True, output_store_id="here", output_file_name="out", pool=pool, spark=spark)
    assert name == "out.parquet" and pool.list_datasets(spark, "here") == ["out.parquet"]
    back, _ = pool.open_data(spark, "out.parquet")
    assert sorted(r["w"] for r in back.df.collect()) == sorted(r["w"] for r in cube.df.collect()) and len(back.df.collect()) == 6
    for bad in ("__import__('os')", "v.real", "open('x')", "unknown + 1", "[x for x in v]"):
        with pytest.raises((ValidationError, SyntaxError)):
            chain.new_expression_op("bad", bad)(grid(spark))
    cat = chain.new_subprocess_op("copy", ["cat"], "lat double, n long")
    df = grid(spark).df.groupBy("lat").agg(F.count("*").alias("n"))
    assert sorted(map(tuple, cat(df).collect())) == [(0.0, 12), (10.0, 12), (20.0, 12)]


def test_stores(spark, tmp_path):
    config = tmp_path / "stores.yml"
    pool = stores.StorePool(str(config))
    name = pool.add_local_store(str(tmp_path / "data"))
    assert name == "local_1" and name in stores.StorePool(str(config)).stores and pool.get_output_store_id() == name
    cube = grid(spark)
    written = pool.write_data(cube, "cube.SST.month")
    with pytest.raises(Exception):
        pool.write_data(cube, "cube.SST.month")
    pool.write_data(cube, "cube.SST.month", replace=True)
    part, _ = pool.open_data(spark, written, "2000-02, 2000-02", "5,5,25,15", "v")
    assert part.df.count() == 2
    plan = part.df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(time" in plan
    assert pool.list_ecvs(spark) == ["SST"] and pool.list_ecv_datasets(spark, "sst") == [(written, name)] and pool.search(spark, name, pattern="*SST*")[0]["format"] == "parquet"
    with pytest.raises(ValidationError):
        pool.write_data(cube, "x", format_id="kml")
    with pytest.raises(ValidationError):
        pool.remove_store("remote")
    with pytest.raises(ConnectionError):
        pool.list_datasets(spark, "remote")
    pool.remove_store(name)
    memory = pool.add_store("memory", persist=False)
    assert pool.open_data(spark, pool.write_data(cube, "c", memory), data_store_id=memory)[0] is cube


def test_vector_files(spark, tmp_path):
    df = data_frame.as_geodataframe(spark.createDataFrame([("a", True, 5, 1.0, 2.0), ("b & c", False, 7, -3.5, 4.0)], "place string, on boolean, n long, lon double, lat double")).drop("lon", "lat")
    for write, read, path in ((vector.write_geojson, vector.read_geojson, "x.geojson"), (vector.write_kml, vector.read_kml, "x.kml")):
        write(df, str(tmp_path / path))
        back = read(spark, str(tmp_path / path)).select("place", "on", "n", "geometry").orderBy("place")
        assert [tuple(r) for r in back.collect()] == [tuple(r) for r in df.orderBy("place").collect()], path


def test_images(spark, tmp_path):
    cube = grid(spark)
    one = cube.df.where("time = '2000-01-01'")
    path = images.output_array_as_image(one, "v", str(tmp_path / "a"))
    data = open(path, "rb").read()
    assert path.endswith(".png") and struct.unpack(">II", data[16:24]) == (4, 3)
    tiff = open(images.output_dataset_as_geotiff(cube, filepath=str(tmp_path / "b.tiff")), "rb").read()
    assert tiff[:4] == b"II*\0" and struct.unpack("<12f", tiff[8:56])[:4] == (5.0,) * 4
    assert len(images.output_animation(cube, "v", str(tmp_path))) == 3


def test_plot_data_and_regions(spark):
    cube = grid(spark)
    assert plotdata.plot_line(cube, "v", {"lat": 11, "lon": 0}).count() == 3
    with pytest.raises(ValidationError):
        plotdata.plot_line(cube, "v", {"lat": 11})
    hist = plotdata.plot_hist(cube, "v", bins=4).orderBy("bin").collect()
    assert [r["count"] for r in hist] == [4, 8, 12, 12] and hist[0]["low"] == 1 and hist[-1]["high"] == 5
    assert plotdata.plot_categorical(cube, "v", [(1, "one", "red")]).where("label = 'one'").count() == 4
    assert len(plotdata.animate_map(cube)) == 3 and plotdata.determine_cmap_params(-1, 3)["vmin"] == -3
    land = regions.Regions([("A", "X", "-5,-5,15,15"), ("B", "Y", "15,-5,45,15")])
    assert regions.get_regions_mask(cube, land, "B").df.where("mask").count() == 4
    assert regions.mask_dataset_by_land(cube, land).df.where("v IS NULL").count() == 12


def test_exact_quantiles(spark):
    import numpy as np

    x = np.concatenate([np.random.default_rng(1).lognormal(0, 3, 120_000), np.full(30_000, 7.0)])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    for q in (0.0, 0.05, 0.5, 0.61, 0.95, 1.0):
        assert exact_quantiles(df, F.col("x"), [q])[0] == pytest.approx(float(np.quantile(x, q)), rel=1e-12)
    assert exact_quantiles(df.limit(0), F.col("x"), [0.5]) == [None]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("ts", "value")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = windowed_statistics(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), late="40 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["time"], r["n"]) for r in spark.table("windows").collect()) == sorted((r["time"], r["n"]) for r in windowed_statistics(events).collect())


def test_text_utilities(spark):
    from cubeloom.functions import text

    assert text.time_strings("x-20020401-20020406.nc") == ["2002-04-01", "2002-04-06"] and text.time_strings("sst_June.nc") == ["06"] and text.time_strings("a-200204.nc") == ["2002-04"]
    assert text.time_strings("20020401T103000") == ["2002-04-01T10:30:00"]
    df = spark.createDataFrame([("x-20020401.nc",), ("none",), (None,)], "n string")
    assert [r[0] for r in df.select(text.first_time(F.col("n"))).collect()] == [datetime(2002, 4, 1), None, None]
    assert text.to_json({"a": (1, float("nan"), date(2001, 1, 2), 1 + 2j)}) == {"a": [1, None, "2001-01-02", [1.0, 2.0]]}
    assert text.new_indexed_name({"v_1", "v_2"}, "v_{index}") == "v_3" and text.encode_url_path("/a/%(x)s", {"x": "b c"}, {"q": 1}) == "/a/b%20c?q=1"
    assert text.is_str_constant(text.to_str_constant("it's")) and text.to_scalar([[3.14159]], 2) == 3.14 and text.to_scalar([1, 2]) is None and text.to_list("a") == ["a"]


def test_expressions_keep_python_precedence(spark):
    df = spark.createDataFrame([(2.0, 3.0), (0.5, 0.0)], "a double, b double")
    for text, of in (("(a*(b+1))**2", lambda a, b: (a * (b + 1)) ** 2), ("2**3**2 - a", lambda a, b: 2**9 - a), ("-a**2 + b % 2", lambda a, b: -(a**2) + b % 2), ("a if b > 1 else sqrt(a)", lambda a, b: a if b > 1 else a**0.5), ("0 < b < 5", lambda a, b: 0 < b < 5), ("round(a / 3, 2)", lambda a, b: round(a / 3, 2))):
        got = [r["x"] for r in chain.new_expression_op("f", text, "x")(df).collect()]
        assert got == pytest.approx([of(2.0, 3.0), of(0.5, 0.0)]), text
    with pytest.raises(ValidationError):
        chain.new_expression_op("f", "a.b", "x")(df)


def test_quantiles_of_several_columns(spark):
    import numpy as np

    from cubeloom.functions.quantiles import quantiles_of

    rng = np.random.default_rng(0)
    x, y = rng.normal(size=5000), np.round(rng.pareto(0.3, 5000), 1)
    df = spark.createDataFrame([(float(a), float(b), None, 7.0) for a, b in zip(x, y)], "x double, y double, z double, w double")
    got = quantiles_of(df, {c: df[c] for c in "xyzw"}, [0.0, 0.05, 0.5, 0.95, 1.0])
    assert np.allclose(got["x"], np.quantile(x, [0, 0.05, 0.5, 0.95, 1])) and np.allclose(got["y"], np.quantile(y, [0, 0.05, 0.5, 0.95, 1]))
    assert got["z"] == [None] * 5 and got["w"] == [7.0] * 5
    ends = spark.createDataFrame([(float("-inf"),), (1.0,), (2.0,), (float("inf"),)], "x double")
    assert quantiles_of(ends, {"x": ends["x"]}, [1 / 3])["x"] == [1.0]


def test_cubes_of_lat_and_lon_alone(spark):
    rows = [(float(i), float(j), None if (i + j) % 3 == 0 else float(i * 4 + j)) for i in range(4) for j in range(4)]
    cube = Cube.of(spark.createDataFrame(rows, "lat double, lon double, v double"), ("lat", "lon"))
    assert gapfilling.gapfill(cube).df.where("v IS NULL").count() == 0
    series = Cube.of(spark.sql("SELECT explode(sequence(timestamp_ntz'2000-01-01', timestamp_ntz'2000-01-08', interval 1 day)) AS time").selectExpr("time", "double(day(time)) AS v"), ("time",))
    assert timeseries.fourier_analysis(series).df.count() == 8
    finer = Cube.of(spark.sql("SELECT explode(sequence(timestamp_ntz'2000-01-02', timestamp_ntz'2000-01-06', interval 12 hours)) AS time").selectExpr("time", "1d AS p"), ("time",))
    got = {r["time"].isoformat()[:13]: r["v"] for r in alignment.temporal_alignment(finer, series, "quadratic").df.collect()}
    assert got["2000-01-03T12"] == pytest.approx(3.5)


def test_open_ended_time_ranges(spark, tmp_path):
    pool = stores.StorePool(str(tmp_path / "stores.json"))
    spark.sql("SELECT timestamp_ntz'2001-01-01' AS time, 1 AS v UNION ALL SELECT timestamp_ntz'2003-01-01', 2").write.parquet(str(tmp_path / "d" / "a.parquet"))
    store = pool.add_local_store(str(tmp_path / "d"), persist=False)
    for text, want in ((",2002-01-01", [1]), ("2000-01-01,2004-01-01", [1, 2])):
        cube, _ = pool.open_data(spark, "a.parquet", time_range=text, data_store_id=store)
        assert sorted(r["v"] for r in cube.df.collect()) == want, text


def test_vector_files_of_all_kinds(spark, tmp_path):
    from cubeloom.functions.geometry import COLUMN

    hole = [(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (0.0, 9.0), (0.0, 0.0), (3.0, 3.0), (6.0, 3.0), (6.0, 6.0), (3.0, 3.0)]
    far = [(20.0, 20.0), (21.0, 20.0), (21.0, 21.0), (20.0, 20.0)]
    rows = [
        ("a", 1.5, ("Polygon", hole, [5])), ("b", 2.0, ("MultiPolygon", [*hole, *far], [5, 9])), ("c", -3.0, ("MultiLineString", [(0.0, 1.0), (2.0, 3.0), (5.0, 5.0), (6.0, 6.0), (7.0, 5.0)], [2])),
        ("d <&>", None, ("MultiPoint", [(1.0, 2.0), (3.0, 4.0)], None)), ("é", 0.25, ("LineString", [(0.1, -1.0), (2.0, 3.0)], None)), ("f", 7.0, None),
    ]
    df = spark.createDataFrame(rows, f"place string, x double, geometry {COLUMN}").repartition(3)
    plain = lambda d: sorted(str((r["place"], r["x"], None if r["geometry"] is None else (r["geometry"]["type"], [tuple(p) for p in r["geometry"]["coords"]], r["geometry"]["ends"]))) for r in d.collect())
    for write, read, path in ((vector.write_geojson, vector.read_geojson, "y.geojson"), (vector.write_kml, vector.read_kml, "y.kml")):
        write(df, str(tmp_path / path))
        assert plain(read(spark, str(tmp_path / path))) == plain(df), path
        with pytest.raises(Exception, match="(?i)exists"):
            write(df, str(tmp_path / path))
        write(df.limit(2), str(tmp_path / path), True)
        assert read(spark, str(tmp_path / path)).count() == 2
        write(df.limit(0), str(tmp_path / f"none-{path}"))
    one = tmp_path / "z.kml"
    one.write_text('<?xml version="1.0"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document>' + "".join(f'<Placemark><name>n{k}</name><ExtendedData><Data name="v"><value>{k}</value></Data></ExtendedData><Point><coordinates>{k},2,0</coordinates></Point></Placemark>' for k in range(300)) + "</Document></kml>")
    got = vector.read_kml(spark, str(one))
    assert dict(got.dtypes)["v"] == "bigint" and {(r["Name"], r["v"], r["geometry"]["coords"][0]["x"]) for r in got.collect()} == {(f"n{k}", k, float(k)) for k in range(300)}


def test_programs_report_their_progress(spark):
    from cubeloom.op import Monitor

    class Kept(Monitor):
        said: list = []

        def start(self, label, total_work):
            super().start(label, total_work)
            self.said.append(("start", label, total_work))

        def progress(self, work=None, msg=None):
            super().progress(work, msg)
            self.said.append(("progress", work, msg))

        def finish(self):
            super().finish()
            self.said.append(("finish",))

    program = "import sys, os\nprint('begin twice of 4', file=sys.stderr)\nfor line in sys.stdin:\n  print(line, end='')\n  print('row done 1 in ' + os.environ['PLACE'], file=sys.stderr)\nprint('over', file=sys.stderr)"
    monitor = Kept()
    patterns = dict(started=r"begin (?P<label>\w+) of (?P<total_work>\d+)", progress=r"done (?P<work>\d+) in (?P<msg>\w+)", done="^over")
    twice = chain.new_subprocess_op("rows", [sys.executable, "-c", program], "n long", monitor=monitor, env={"PLACE": "here"}, **patterns)
    df = spark.range(8).withColumnRenamed("id", "n").repartition(2)
    assert sorted(r["n"] for r in twice(df).collect()) == list(range(8))
    assert monitor.said.count(("finish",)) == monitor.said.count(("start", "twice", 4.0)) >= 1
    assert sum(w for k, w, *_ in (x for x in monitor.said if x[0] == "progress")) == 8 and all(x[2] == "here" for x in monitor.said if x[0] == "progress")
    with pytest.raises(Exception, match="status 3"):
        chain.new_subprocess_op("bad", [sys.executable, "-c", "import sys; sys.exit(3)"], "n long")(df).collect()
