"""Cubes in Zarr (version 2) groups: a scan that reads only the chunks its filters need, and a writer by chunks.

The reader is a Python data source. Comparisons of a dimension with constants are taken over from the plan: they become the
labels to keep of that axis, a chunk without any is not opened, and what is left of the others is cut before rows are made.
A partition is some chunks, so a cube of any size is read by as many tasks as its chunks are worth. Rows come as Arrow
batches of bounded length. The axes are read where the scan is planned; variables are read by tasks only.
"""

from __future__ import annotations

import datetime as dt
import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product
from math import ceil, prod
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from ..cube import Cube, ValidationError, small
from ..shipping import ship

FORMAT = "cubeloom_zarr"
#: Bytes of chunks in a partition (about) and rows of a batch.
PARTITION, BATCH = 32_000_000, 65_536
#: Nanoseconds of CF time units.
UNITS = {"days": 86_400 * 10**9, "hours": 3600 * 10**9, "minutes": 60 * 10**9, "seconds": 10**9, "milliseconds": 10**6, "microseconds": 1000, "nanoseconds": 1}


def filesystem(path: str):
    """The file system of a path or URI, and the path on it."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        system, at = fs.FileSystem.from_uri(path)
    else:
        system, at = fs.LocalFileSystem(), path
    return system, at.rstrip("/")


def _bytes(path: str) -> bytes | None:
    """What a file holds; None if there is none."""
    system, at = filesystem(path)
    try:
        with system.open_input_file(at) as f:
            return f.readall()
    except FileNotFoundError:
        return None


def unpacked(data: bytes, compressor: dict | None) -> bytes:
    kind = (compressor or {}).get("id")
    if kind is None:
        return data
    if kind in ("zlib", "gzip"):
        return zlib.decompress(data, 47)  # either header
    if kind == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    raise ValidationError(f"chunks packed by {kind!r} cannot be read here; zlib, gzip, zstd and none can")


@dataclass
class Array:
    """One array of a group, as its metadata say."""

    name: str
    shape: tuple[int, ...]
    chunks: tuple[int, ...]
    dtype: np.dtype
    dims: tuple[str, ...]
    order: str = "C"
    fill: Any = None
    compressor: dict | None = None
    separator: str = "."
    attrs: dict[str, Any] = field(default_factory=dict)

    def chunk(self, root: str, at: tuple[int, ...]) -> np.ndarray:
        """A whole chunk; the fill value where it was never written."""
        data = _bytes(f"{root}/{self.name}/{self.separator.join(map(str, at)) or '0'}")
        if data is None:
            return np.full(self.chunks, 0 if self.fill is None else self.fill, self.dtype)
        return np.frombuffer(unpacked(data, self.compressor), self.dtype).reshape(self.chunks, order=self.order)

    def region(self, root: str, low: tuple[int, ...], high: tuple[int, ...]) -> np.ndarray:
        """The cells from low to high (left out), of as many chunks as hold some."""
        out = np.empty([b - a for a, b in zip(low, high)], self.dtype)
        for at in product(*(range(a // c, -(-b // c)) for a, b, c in zip(low, high, self.chunks))):
            from_, to = [max(a, k * c) for a, k, c in zip(low, at, self.chunks)], [min(b, (k + 1) * c) for b, k, c in zip(high, at, self.chunks)]
            inside = tuple(slice(x - k * c, y - k * c) for x, y, k, c in zip(from_, to, at, self.chunks))
            out[tuple(slice(x - a, y - a) for x, y, a in zip(from_, to, low))] = self.chunk(root, at)[inside]
        return out

    @property
    def packed(self) -> bool:
        return any(a in self.attrs for a in ("scale_factor", "add_offset"))

    def values(self, raw: np.ndarray) -> pa.Array:
        """The values of a flat piece: scaled, with nulls for the fill value and not-a-number."""
        gone = np.zeros(len(raw), bool)
        for missing in (self.fill, self.attrs.get("_FillValue"), self.attrs.get("missing_value")):
            if missing is not None and not isinstance(missing, str):
                gone |= raw == np.asarray(missing).astype(self.dtype)
        if self.dtype.kind == "f":
            gone |= np.isnan(raw)
        if self.packed:
            raw = raw.astype(float) * float(self.attrs.get("scale_factor", 1)) + float(self.attrs.get("add_offset", 0))
        return pa.array(np.ascontiguousarray(raw.astype(raw.dtype.newbyteorder("="))), mask=gone)

    def kind(self) -> T.DataType:
        if self.packed:
            return T.DoubleType()
        k = self.dtype.kind + str(self.dtype.itemsize)
        known = {"f8": T.DoubleType(), "f4": T.FloatType(), "i8": T.LongType(), "i4": T.IntegerType(), "i2": T.ShortType(), "i1": T.ByteType(), "u1": T.ShortType(), "u2": T.IntegerType(), "u4": T.LongType(), "b1": T.BooleanType()}
        if k not in known:
            raise ValidationError(f"the array {self.name!r} holds {self.dtype.str}, which no column can")
        return known[k]


def _axis(array: Array, root: str) -> pd.Index:
    """The labels of a coordinate; CF times as timestamps."""
    raw = array.region(root, (0,) * len(array.shape), array.shape)
    raw = raw.astype(raw.dtype.newbyteorder("="))
    m = re.match(r"\s*(\w+?)s?\s+since\s+(.+?)\s*(?:UTC|Z)?\s*$", str(array.attrs.get("units", "")))
    if m and f"{m[1]}s" in UNITS:
        if array.attrs.get("calendar", "standard") not in ("standard", "gregorian", "proleptic_gregorian"):
            raise ValidationError(f"the calendar {array.attrs['calendar']!r} is not known here")
        unit, start = UNITS[f"{m[1]}s"], np.datetime64(pd.Timestamp(m[2]).tz_localize(None), "us")
        if raw.dtype.kind == "f":
            return pd.Index(start + np.round(raw * (unit / 1000)).astype("timedelta64[us]"))
        return pd.Index(start + (raw.astype(np.int64) * unit // 1000).astype("timedelta64[us]"))
    return pd.Index(raw)


def open_group(root: str) -> tuple[dict[str, Array], dict[str, Any]]:
    """The arrays of a group by name, and its attributes; by the consolidated metadata, or file by file."""
    whole = _bytes(f"{root}/.zmetadata")
    if whole is not None:
        files = json.loads(whole)["metadata"]
    else:
        from pyarrow import fs

        system, at = filesystem(root)
        if _bytes(f"{root}/.zgroup") is None:
            raise FileNotFoundError(f"{root} is no Zarr group")
        files = {}
        for info in system.get_file_info(fs.FileSelector(at)):
            for f in (".zarray", ".zattrs") if info.type == fs.FileType.Directory else ():
                if (data := _bytes(f"{root}/{info.base_name}/{f}")) is not None:
                    files[f"{info.base_name}/{f}"] = json.loads(data)
        files[".zattrs"] = json.loads(_bytes(f"{root}/.zattrs") or b"{}")
    arrays = {}
    for key, z in files.items():
        name, _, last = key.rpartition("/")
        if last != ".zarray":
            continue
        if z.get("filters"):
            raise ValidationError(f"the array {name!r} has filters, which are not known here")
        attrs = files.get(f"{name}/.zattrs", {})
        fill = {"NaN": np.nan, "Infinity": np.inf, "-Infinity": -np.inf}.get(z.get("fill_value"), z.get("fill_value")) if isinstance(z.get("fill_value"), str) else z.get("fill_value")
        dims = tuple(attrs.get("_ARRAY_DIMENSIONS", [f"{name}_dim{i}" for i in range(len(z["shape"]))]))
        arrays[name] = Array(name, tuple(z["shape"]), tuple(z["chunks"]), np.dtype(z["dtype"]), dims, z.get("order", "C"), fill, z.get("compressor"), z.get("dimension_separator", "."), attrs)
    return arrays, files.get(".zattrs", {})


@dataclass
class Chunks(InputPartition):
    """Chunk numbers of the grid that the scan is cut by."""

    at: list[tuple[int, ...]]


class ZarrReader(DataSourceReader):
    def __init__(self, root: str, arrays: dict[str, Array], dims: tuple[str, ...], variables: list[str], partition: int) -> None:
        self.root, self.arrays, self.dims, self.variables, self.partition_bytes = root, arrays, dims, variables, partition
        self.shape = {d: arrays[v].shape[arrays[v].dims.index(d)] for v in variables for d in arrays[v].dims}
        self.axes = {d: _axis(arrays[d], root) if d in arrays else pd.RangeIndex(self.shape[d]) for d in dims}
        self.keep = {d: np.ones(self.shape[d], bool) for d in dims}
        widest = max((arrays[v] for v in variables), key=lambda a: len(a.dims))
        self.step = {d: widest.chunks[widest.dims.index(d)] if d in widest.dims else self.shape[d] for d in dims}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        test = {EqualTo: "__eq__", EqualNullSafe: "__eq__", GreaterThan: "__gt__", GreaterThanOrEqual: "__ge__", LessThan: "__lt__", LessThanOrEqual: "__le__"}
        for f in filters:
            d = f.attribute[0] if len(f.attribute) == 1 and hasattr(f, "attribute") else None
            if d in self.dims and isinstance(f, IsNotNull):
                continue  # no label is null
            if d not in self.dims or not (type(f) in test or isinstance(f, In)):
                yield f
                continue
            plain = lambda x: np.datetime64(x.replace(tzinfo=None), "us") if isinstance(x, dt.datetime) else x
            labels = np.asarray(self.axes[d])
            self.keep[d] &= np.isin(labels, np.array([plain(x) for x in f.value])) if isinstance(f, In) else getattr(labels, test[type(f)])(plain(f.value))

    def partitions(self) -> list[Chunks]:
        """Chunks that hold a label to keep of every axis, in runs of about the bytes of a partition."""
        some = [[k for k in range(ceil(self.shape[d] / self.step[d])) if self.keep[d][k * self.step[d] : (k + 1) * self.step[d]].any()] for d in self.dims]
        size = prod(self.step.values()) * sum(self.arrays[v].dtype.itemsize for v in self.variables)
        run = max(1, self.partition_bytes // max(1, size))
        every = list(product(*some))
        return [Chunks(every[i : i + run]) for i in range(0, len(every), run)] or [Chunks([])]

    def read(self, partition: Chunks) -> Iterator[pa.RecordBatch]:
        schema = _schema(self.arrays, self.dims, self.variables, {d: a.dtype for d, a in self.axes.items()})
        for at in partition.at:
            low = {d: k * self.step[d] for d, k in zip(self.dims, at)}
            inside = {d: np.nonzero(self.keep[d][low[d] : low[d] + self.step[d]])[0] for d in self.dims}
            parts = {}
            for v in self.variables:
                a = self.arrays[v]
                own = [low[d] for d in a.dims]
                cells = a.region(self.root, tuple(own), tuple(min(x + self.step[d], self.shape[d]) for x, d in zip(own, a.dims)))
                parts[v] = cells[np.ix_(*(inside[d] for d in a.dims))] if a.dims else cells
            shape = [len(inside[d]) for d in self.dims]
            for first in range(0, prod(shape), BATCH):
                places = dict(zip(self.dims, np.unravel_index(np.arange(first, min(first + BATCH, prod(shape))), shape))) if shape else {}
                columns = [pa.array(np.asarray(self.axes[d])[low[d] + inside[d][places[d]]]) for d in self.dims]
                columns += [self.arrays[v].values(parts[v][tuple(places[d] for d in self.arrays[v].dims)]) for v in self.variables]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def _schema(arrays: dict[str, Array], dims: tuple[str, ...], variables: list[str], kinds: dict[str, np.dtype]) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(_columns(arrays, dims, variables, kinds))


def _columns(arrays: dict[str, Array], dims: tuple[str, ...], variables: list[str], kinds: dict[str, np.dtype]) -> T.StructType:
    def label(d: str) -> T.DataType:
        return T.TimestampNTZType() if kinds[d].kind == "M" else T.LongType() if kinds[d].kind in "iu" else T.DoubleType()

    return T.StructType([*(T.StructField(d, label(d)) for d in dims), *(T.StructField(v, arrays[v].kind()) for v in variables)])


class ZarrSource(DataSource):
    """spark.read.format("cubeloom_zarr").option("variables", "a,b").load(path); partitionBytes sizes the tasks."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def _open(self) -> ZarrReader:
        root = self.options["path"].rstrip("/")
        arrays, _ = open_group(root)
        data = [v for v, a in arrays.items() if v not in a.dims]
        wanted = [v.strip() for v in self.options["variables"].split(",")] if self.options.get("variables") else data
        if not wanted or set(wanted) - set(data):
            raise ValidationError(f"the group has the variables {', '.join(data)}")
        dims: list[str] = []
        for v in sorted(wanted, key=lambda v: -len(arrays[v].dims)):
            dims += [d for d in arrays[v].dims if d not in dims]
        return ZarrReader(root, arrays, tuple(dims), wanted, int(self.options.get("partitionBytes") or PARTITION))

    def schema(self) -> T.StructType:
        r = self._open()
        return _columns(r.arrays, r.dims, r.variables, {d: a.dtype for d, a in r.axes.items()})

    def reader(self, schema: T.StructType) -> ZarrReader:
        return self._open()


def read_zarr(spark: SparkSession, path: str, variables: list[str] | None = None, **options: Any) -> Cube:
    """The cube of a group; filters on its dimensions reach the scan. Missing cells are null; a variable of fewer dimensions is repeated along the others."""
    ship(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    spark.dataSource.register(ZarrSource)
    arrays, attrs = open_group(path.rstrip("/"))
    reader = spark.read.format(FORMAT).options(**options)
    df = (reader.option("variables", ",".join(variables)) if variables else reader).load(path)
    dims = tuple(c for c in df.columns if c not in arrays or c in arrays[c].dims)
    kept = [c for c in df.columns if c not in dims]
    said = {v: {k: x for k, x in arrays[v].attrs.items() if k not in ("_ARRAY_DIMENSIONS", "scale_factor", "add_offset", "_FillValue")} for v in kept}
    return Cube(df, dims, said, dict(attrs), {d: {k: x for k, x in arrays[d].attrs.items() if k not in ("_ARRAY_DIMENSIONS", "units", "calendar")} for d in dims if d in arrays})


def write_zarr(cube: Cube, path: str, chunks: dict[str, int] | None = None, compressor: str | None = "zlib", overwrite: bool = False) -> str:
    """Write a cube as a group with consolidated metadata: its cells are dealt by chunk, and a task writes whole chunks.

    chunks: labels of a dimension in a chunk; by default one time step and at most 256 labels of any other. Axes come to the
    driver (Cube.labels refuses them beyond a million). Variables are floats, doubles, or become doubles, whose not-a-number is a missing cell. Cells that are not there are missing; of several rows
    of a cell the smallest value stays. Chunks without any value are not written.
    """
    spark = cube.df.sparkSession
    ship(spark)
    if compressor not in ("zlib", None):
        raise ValidationError("the compressor is zlib or None")
    root = path.rstrip("/")
    if _bytes(f"{root}/.zgroup") is not None:
        if not overwrite:
            raise ValidationError(f"{path!r} exists already")
        system, at = filesystem(root)
        system.delete_dir(at)
    axes = {d: cube.labels(d) for d in cube.dims}
    step = {d: min(max(1, len(axes[d])), (chunks or {}).get(d, 1 if d == "time" else 256)) for d in cube.dims}
    kinds = dict(cube.df.dtypes)
    if odd := [v for v in cube.vars if not (kinds[v] in ("double", "float", "bigint", "int", "smallint", "tinyint", "boolean") or kinds[v].startswith("decimal"))]:
        raise ValidationError(f"variables must be numbers: {', '.join(odd)}")
    code = {v: "<f4" if kinds[v] == "float" else "<f8" for v in cube.vars}
    cells = cube.df.where(" AND ".join(f"`{d}` IS NOT NULL" for d in cube.dims))
    for d in cube.dims:
        labels = spark.createDataFrame([(i, x) for i, x in enumerate(axes[d])], T.StructType([T.StructField(f"_i_{d}", T.LongType()), T.StructField(d, cube.df.schema[d].dataType)]))
        cells = cells.join(small(labels), d)
    number = [F.floor(F.col(f"_i_{d}") / step[d]).alias(f"_c_{d}") for d in cube.dims]
    place = F.lit(0)
    for d in cube.dims:
        place = place * step[d] + F.col(f"_i_{d}") % step[d]
    numeric = [F.col(v).cast("float" if code[v] == "<f4" else "double").alias(v) for v in cube.vars]
    shape = [step[d] for d in cube.dims]
    names = [f"_c_{d}" for d in cube.dims]

    def store(group: pd.DataFrame) -> pd.DataFrame:
        at, own = ".".join(str(int(group[c].iloc[0])) for c in names), group.groupby("_place").min()
        written = 0
        for v in code:
            some = own[v].dropna()
            if not len(some):
                continue
            out = np.full(prod(shape), np.nan, np.dtype(code[v]))
            out[some.index.to_numpy(np.int64)] = some.to_numpy(np.dtype(code[v]))
            system, base = filesystem(f"{root}/{v}")
            system.create_dir(base, recursive=True)
            with system.open_output_stream(f"{base}/{at}") as f:  # the same bytes from every attempt
                f.write(zlib.compress(out.tobytes(), 1) if compressor else out.tobytes())
            written += 1
        return pd.DataFrame({"chunks": [written]})

    dealt = cells.select(*number, place.cast("long").alias("_place"), *numeric)
    dealt.groupBy(*names).applyInPandas(store, "chunks int").agg(F.sum("chunks")).collect()

    def put(name: str, data: bytes) -> None:
        system, base = filesystem(f"{root}/{name}")
        system.create_dir(base.rpartition("/")[0], recursive=True)
        with system.open_output_stream(base) as f:
            f.write(data)

    packing = {"id": "zlib", "level": 1} if compressor else None
    files: dict[str, Any] = {".zgroup": {"zarr_format": 2}, ".zattrs": {k: v for k, v in cube.attrs.items() if isinstance(v, (str, int, float, list, dict))}}

    def array(name: str, dims: list[str], size: list[int], step: list[int], code: str, fill: Any, attrs: dict) -> None:
        files[f"{name}/.zarray"] = {"zarr_format": 2, "shape": size, "chunks": step, "dtype": code, "compressor": packing, "fill_value": fill, "order": "C", "filters": None}
        files[f"{name}/.zattrs"] = {k: v for k, v in attrs.items() if isinstance(v, (str, int, float, list))} | {"_ARRAY_DIMENSIONS": dims}

    for d in cube.dims:
        labels, attrs = axes[d], dict(cube.coord_attrs.get(d, {}))
        if labels and isinstance(labels[0], (dt.date, dt.datetime)):
            stamps = np.array([np.datetime64(x.replace(tzinfo=None) if isinstance(x, dt.datetime) else x, "us") for x in labels])
            data, attrs = (stamps - np.datetime64(0, "us")).astype("<i8"), attrs | {"units": "microseconds since 1970-01-01", "calendar": "proleptic_gregorian"}
        else:
            data = np.array(labels, "<i8" if kinds[d] in ("bigint", "int", "smallint", "tinyint") else "<f8")
        array(d, [d], [len(labels)], [max(1, len(labels))], data.dtype.str, None, attrs)
        if len(labels):
            put(f"{d}/0", zlib.compress(data.tobytes(), 1) if compressor else data.tobytes())
    for v in cube.vars:
        array(v, list(cube.dims), [len(axes[d]) for d in cube.dims], [step[d] for d in cube.dims], code[v], "NaN", cube.vars[v])
    for name, said in files.items():
        put(name, json.dumps(said).encode())
    put(".zmetadata", json.dumps({"zarr_consolidated_format": 1, "metadata": files}).encode())
    return root

