import datetime as dt

from cubeloom.cube import Cube
from cubeloom.operators import timeseries


def test_interpolate_time(spark):
    """Gaps between values are filled by straight lines, ends are not, and no frame runs on to the last row."""
    given = [None, 2.0, None, None, 8.0, None, 4.0, None]
    rows = [(dt.datetime(2001, 1, 1 + i), lat, v if v is None else v * lat) for lat in (1.0, 2.0) for i, v in enumerate(given)]
    cube = Cube.of(spark.createDataFrame(rows, "time timestamp_ntz, lat double, v double"), ("time", "lat"))
    found = timeseries.interpolate_time(cube).df
    want = [None, 2.0, 4.0, 6.0, 8.0, 6.0, 4.0, None]
    got = found.orderBy("lat", "time").collect()
    assert [r["v"] for r in got] == [v if v is None else v * lat for lat in (1.0, 2.0) for v in want]
    assert "unboundedfollowing" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
