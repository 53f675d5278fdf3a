import datetime as dt
import json
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cubeloom.cube import Cube, ValidationError
from cubeloom.sources import zarr
from cubeloom.sources.stores import StorePool


def some_cube(spark, n=6):
    rows = [(dt.datetime(2001, 1, 1) + dt.timedelta(days=t), float(y), float(x), float(t * 100 + y * 10 + x) if (t + x) % 7 else None, (t + y + x) % 5) for t in range(n) for y in range(-4, 4) for x in range(10)]
    df = spark.createDataFrame(rows, "time timestamp_ntz, lat double, lon double, v double, k int")
    return Cube(df, ("time", "lat", "lon"), {"v": {"units": "K"}, "k": {}}, {"title": "some"})


def plain(df, *columns):
    return sorted((tuple(None if x is None else x for x in r) for r in df.select(*columns).collect()), key=str)


def test_written_and_read(spark, tmp_path):
    cube, at = some_cube(spark), str(tmp_path / "c.zarr")
    zarr.write_zarr(cube, at, {"lat": 3, "lon": 4})
    got = zarr.read_zarr(spark, at)
    assert got.dims == cube.dims and got.vars["v"] == {"units": "K"} and got.attrs == {"title": "some"}
    assert dict(got.df.dtypes) == {"time": "timestamp_ntz", "lat": "double", "lon": "double", "v": "double", "k": "double"}
    names = ("time", "lat", "lon", "v")
    assert plain(got.df, *names) == plain(cube.df, *names) and plain(got.df.withColumn("k", F.col("k").cast("int")), "k") == plain(cube.df, "k")
    with pytest.raises(ValidationError):
        zarr.write_zarr(cube, at)
    zarr.write_zarr(cube, at, compressor=None, overwrite=True)
    assert plain(zarr.read_zarr(spark, at, ["v"]).df, *names) == plain(cube.df, *names)


def test_filters_leave_chunks_closed(spark, tmp_path):
    cube, at = some_cube(spark), str(tmp_path / "c.zarr")
    zarr.write_zarr(cube, at, {"lat": 2, "lon": 5})
    box = lambda df: df.where((F.col("time") >= F.lit("2001-01-03").cast("timestamp_ntz")) & (F.col("time") < F.lit("2001-01-05").cast("timestamp_ntz")) & F.col("lat").between(-1.0, 1.0) & (F.col("lon") == 7.0))
    got = box(zarr.read_zarr(spark, at, ["v"], partitionBytes=1).df)
    assert plain(got, *got.columns) == plain(box(cube.df), *got.columns) and got.count() == 6
    assert "Filter (" not in got._jdf.queryExecution().executedPlan().toString()  # nothing is left to do above the scan
    assert got.rdd.getNumPartitions() == 2 * 2 * 1  # of 6 * 4 * 2 chunks
    some = zarr.read_zarr(spark, at, ["v"]).df
    assert plain(some.where("lon IN (1, 3) AND v > 100"), "v") == plain(cube.df.where("lon IN (1, 3) AND v > 100"), "v")
    assert some.where("lon > 99").count() == 0
    for c in os.listdir(f"{at}/v"):  # chunks outside of the box are never opened
        if not c.startswith(".") and not (c[0] in "23" and c.split(".")[1] in "12" and c.endswith("1")):
            with open(f"{at}/v/{c}", "wb") as f:
                f.write(b"broken")
    assert plain(got, *got.columns) == plain(box(cube.df), *got.columns)


def test_made_by_others(spark, tmp_path):
    """Big-endian packed integers in Fortran order, nested chunk names, float times, a variable of fewer dimensions, edge chunks, no consolidated metadata."""
    at = tmp_path / "o.zarr"

    def put(name, data, chunks, dims, order="C", separator=".", fill=None, compressor=None, **attrs):
        (at / name).mkdir(parents=True)
        meta = {"zarr_format": 2, "shape": data.shape, "chunks": chunks, "dtype": data.dtype.str, "order": order, "fill_value": fill, "compressor": compressor, "filters": None, "dimension_separator": separator}
        (at / name / ".zarray").write_text(json.dumps(meta))
        (at / name / ".zattrs").write_text(json.dumps(attrs | {"_ARRAY_DIMENSIONS": dims}))
        for k in np.ndindex(*(-(-s // c) for s, c in zip(data.shape, chunks))):
            full = np.zeros(chunks, data.dtype)
            part = data[tuple(slice(i * c, (i + 1) * c) for i, c in zip(k, chunks))]
            full[tuple(slice(0, s) for s in part.shape)] = part
            path = at / name / (separator.join(map(str, k)) or "0")
            path.parent.mkdir(parents=True, exist_ok=True)
            raw = full.tobytes(order=order)
            path.write_bytes(zlib.compress(raw) if compressor else raw)

    packed = np.arange(3 * 5, dtype=">i2").reshape(3, 5)
    packed[1, 2] = -99
    put("t2m", packed, (2, 2), ["time", "x"], "F", "/", None, {"id": "zlib", "level": 1}, scale_factor=0.5, add_offset=10, missing_value=-99)
    put("mask", np.array([0, 1, 0, 1, 1], "u1"), (5,), ["x"])
    put("time", np.array([0, 0.5, 1], "<f8"), (3,), ["time"], units="days since 2000-02-28 12:00:00")
    (at / ".zgroup").write_text('{"zarr_format": 2}')
    cube = zarr.read_zarr(spark, str(at))
    rows = {(r["time"], r["x"]): (r["t2m"], r["mask"]) for r in cube.df.collect()}
    times = [dt.datetime(2000, 2, 28, 12), dt.datetime(2000, 2, 29), dt.datetime(2000, 2, 29, 12)]
    assert rows == {(times[i], x): (None if (i, x) == (1, 2) else 10 + 0.5 * (5 * i + x), [0, 1, 0, 1, 1][x]) for i in range(3) for x in range(5)}
    (at / "mask" / ".zarray").write_text((at / "mask" / ".zarray").read_text().replace('"compressor": null', '"compressor": {"id": "blosc"}'))
    with pytest.raises(Exception, match="blosc"):
        zarr.read_zarr(spark, str(at), ["mask"]).df.collect()
    assert zarr.read_zarr(spark, str(at), ["t2m"]).df.count() == 15
    with pytest.raises(Exception, match="variables"):
        zarr.read_zarr(spark, str(at), ["none"])


def test_edges(spark, tmp_path):
    schema = "time timestamp_ntz, x int, v float"
    for name, rows in (("empty", []), ("nulls", [(dt.datetime(2001, 1, 1), 1, None), (None, 2, 5.0), (dt.datetime(2001, 1, 2), 3, float("nan")), (dt.datetime(2001, 1, 2), 3, 2.0), (dt.datetime(2001, 1, 2), 3, 1.0)])):
        at = str(tmp_path / f"{name}.zarr")
        zarr.write_zarr(Cube.of(spark.createDataFrame(rows, schema), ("time", "x")), at)
        got = zarr.read_zarr(spark, at)
        assert {(r["time"].day, r["x"]): r["v"] for r in got.df.collect()} == ({} if not rows else {(1, 1): None, (1, 2): None, (1, 3): None, (2, 1): None, (2, 2): None, (2, 3): 1.0})


def test_store(spark, tmp_path):
    pool = StorePool()
    store = pool.add_local_store(str(tmp_path), "mine", persist=False)
    cube = some_cube(spark)
    assert "zarr" in pool.get_supported_formats(cube, store)
    pool.write_data(cube, "some.data.zarr", store, "zarr")
    assert pool.list_datasets(spark, store) == ["some.data.zarr"]
    got, _ = pool.open_data(spark, "some.data.zarr", "2001-01-02, 2001-01-03", "1,-2,4,0", "v", store)
    want = cube.df.where("time BETWEEN '2001-01-02' AND '2001-01-03 23:59:59' AND lon BETWEEN 1 AND 4 AND lat BETWEEN -2 AND 0")
    assert list(got.vars) == ["v"] and plain(got.df, "time", "lat", "lon", "v") == plain(want, "time", "lat", "lon", "v") and got.vars["v"] == {"units": "K"}
