"""Stores: named places of data sets, with registration, search, opening and writing."""

from __future__ import annotations

import fnmatch
import os
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cube import Cube, ValidationError
from ..likes import PolygonLike, TimeRangeLike, VarNamesLike
from . import vector, zarr

PROTOCOLS = ("abfs", "file", "ftp", "https", "memory", "reference", "s3")
CUBE_FORMATS, TABLE_FORMATS, VECTOR_FORMATS = ("parquet", "orc", "zarr"), ("parquet", "orc", "csv", "json"), ("geojson", "kml", "parquet")
EXTENSIONS = {".parquet": "parquet", ".orc": "orc", ".csv": "csv", ".json": "json", ".geojson": "geojson", ".kml": "kml", ".zarr": "zarr"}


@dataclass
class Store:
    """root is any URL that Spark's file systems reach. Its data sets are files or folders named by their format."""

    store_id: str
    root: str
    read_only: bool = False
    max_depth: int = 1
    includes: tuple[str, ...] = ()
    excludes: tuple[str, ...] = ()
    title: str = ""
    description: str = ""
    essential: bool = False
    remote: bool = False
    memory: dict[str, Any] = field(default_factory=dict)

    def _check(self) -> None:
        if self.remote:
            raise ConnectionError(f"the store {self.store_id!r} is a remote service, which this installation does not reach")

    def list(self, spark: SparkSession) -> list[str]:
        self._check()
        if self.root.startswith("memory:"):
            names = sorted(self.memory)
        else:
            jvm = spark.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(self.root)
            fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            names = []

            def walk(at: Any, depth: int, prefix: str) -> None:
                for s in fs.listStatus(at) if fs.exists(at) else []:
                    name = s.getPath().getName()
                    if os.path.splitext(name)[1] in EXTENSIONS:
                        names.append(prefix + name)
                    elif s.isDirectory() and depth < self.max_depth and name[:1] not in "_.":
                        walk(s.getPath(), depth + 1, f"{prefix}{name}/")

            walk(path, 1, "")
        return filter_fileset(sorted(names), self.includes, self.excludes)


def filter_fileset(names: list[str], includes: Any = (), excludes: Any = ()) -> list[str]:
    kept = [n for n in names if not includes or any(fnmatch.fnmatch(n, p) for p in includes)]
    return [n for n in kept if not any(fnmatch.fnmatch(n, p) for p in excludes or ())]


class StorePool:
    """The stores of a session, kept in a YAML file if one is given."""

    def __init__(self, config: str | None = None) -> None:
        self.config = config
        self.stores: dict[str, Store] = {
            "remote": Store("remote", "https:", True, title="remote service", essential=True, remote=True),
            "remote-zarr": Store("remote-zarr", "s3:", True, title="remote cubes", essential=True, remote=True),
            "remote-references": Store("remote-references", "reference:", True, title="remote references", essential=True, remote=True),
        }
        self.output: str | None = None
        if config and os.path.exists(config):
            import yaml

            with open(config) as f:
                for k, v in (yaml.safe_load(f) or {}).items():
                    self.stores.setdefault(k, Store(store_id=k, **v))

    def _save(self) -> None:
        if not self.config:
            return
        import yaml

        kept = {k: {a: list(v) if isinstance(v := getattr(s, a), tuple) else v for a in ("root", "read_only", "max_depth", "includes", "excludes", "title", "description")} for k, s in self.stores.items() if not s.essential}
        with open(self.config, "w") as f:
            yaml.safe_dump(kept, f)

    def _name(self, kind: str) -> str:
        return next(f"{kind}_{n}" for n in range(1, len(self.stores) + 2) if f"{kind}_{n}" not in self.stores)

    def list_stores(self) -> list[str]:
        return sorted(self.stores)

    def get_store(self, store_id: str) -> Store:
        if store_id not in self.stores:
            raise ValidationError(f"there is no store {store_id!r}")
        return self.stores[store_id]

    def add_local_store(self, root: str, store_id: str | None = None, max_depth: int = 1, read_only: bool = False, includes: Any = (), excludes: Any = (), title: str = "", description: str = "", persist: bool = True) -> str:
        return self.add_store("file", {"root": root, "max_depth": max_depth}, store_id or self._name("local"), read_only, includes, excludes, title, description, persist)

    def add_store(self, store_type: str, store_params: dict | None = None, store_id: str | None = None, read_only: bool = False, includes: Any = (), excludes: Any = (), title: str = "", description: str = "", persist: bool = True) -> str:
        if store_type not in PROTOCOLS:
            raise ValidationError(f"store type must be one of {PROTOCOLS}")
        store_id = store_id or self._name(store_type)
        if store_id in self.stores:
            raise ValidationError(f"there is a store {store_id!r} already")
        p = store_params or {}
        self.stores[store_id] = Store(store_id, "memory:" if store_type == "memory" else p.get("root", ""), read_only, p.get("max_depth", 1), tuple(includes or ()), tuple(excludes or ()), title, description)
        if persist:
            self._save()
        return store_id

    def remove_store(self, store_id: str, persist: bool = True) -> None:
        if self.get_store(store_id).essential:
            raise ValidationError(f"the store {store_id!r} may not be removed")
        del self.stores[store_id]
        if persist:
            self._save()

    def get_output_store_id(self) -> str | None:
        return self.output or next((k for k, s in self.stores.items() if not s.read_only), None)

    def set_output_store(self, store_id: str) -> None:
        if self.get_store(store_id).read_only:
            raise ValidationError(f"the store {store_id!r} is read-only")
        self.output = store_id

    def _local(self) -> dict[str, Store]:
        return {k: s for k, s in self.stores.items() if not s.remote}

    def list_datasets(self, spark: SparkSession, store_id: str | None = None, data_type: str | None = None, include_attrs: bool = False) -> list:
        stores = [self.get_store(store_id)] if store_id else self._local().values()
        names = [n for s in stores for n in s.list(spark) if data_type is None or data_type_of(n) == data_type]
        return [(n, {"data_type": data_type_of(n)}) for n in names] if include_attrs else names

    def find_data_store(self, spark: SparkSession, ds_id: str) -> tuple[str | None, Store | None]:
        found = [(k, s) for k, s in self._local().items() if ds_id in s.list(spark)]
        if len(found) > 1:
            raise ValidationError(f"{ds_id!r} is in several stores: {', '.join(k for k, _ in found)}")
        return found[0] if found else (None, None)

    def list_ecvs(self, spark: SparkSession) -> list[str]:
        """The second dotted parts of the data sets' names."""
        return sorted({n.split(".")[1] for n in self.list_datasets(spark) if n.count(".") >= 2})

    def list_ecv_datasets(self, spark: SparkSession, ecv: str, data_type: str | None = None) -> list[tuple[str, str]]:
        if ecv.upper() not in {x.upper() for x in self.list_ecvs(spark)}:
            raise ValidationError(f"there is no ECV {ecv!r}")
        e = ecv.upper()
        return [(n, k) for k, s in self._local().items() for n in s.list(spark) if any(x in n.upper() for x in (f".{e}.", f"-{e}-", f"_{e}_")) and data_type in (None, data_type_of(n))]

    def list_ecv_datasets_of_titles(self, spark: SparkSession, titles: list[str]) -> list[tuple[str, str]]:
        return [(n, k) for t in titles for k, s in self._local().items() if s.title == t for n in s.list(spark)]

    def get_search_params(self) -> dict[str, str]:
        return {"pattern": "a wildcard for names", "format": "a format's name"}

    def search(self, spark: SparkSession, store_id: str, data_type: str | None = None, pattern: str | None = None, format: str | None = None) -> list[dict[str, str]]:
        rows = [{"data_id": n, "data_type": data_type_of(n), "format": format_of(n)} for n in self.get_store(store_id).list(spark)]
        return [r for r in rows if data_type in (None, r["data_type"]) and format in (None, r["format"]) and (pattern is None or fnmatch.fnmatch(r["data_id"], pattern))]

    def open_data(self, spark: SparkSession, dataset_id: str, time_range: Any = None, region: Any = None, var_names: Any = None, data_store_id: str | None = None, place_names: list[str] | None = None) -> tuple[Any, str]:
        """A cube (a table with any of time, lat, lon) or a table. Time, the region's box and variables reach the scan as
        filters and columns; place_names prune the partitions of a data tree."""
        if data_store_id:
            store = self.get_store(data_store_id)
        else:
            _, store = self.find_data_store(spark, dataset_id)
            if store is None:
                raise ValidationError(f"no store has {dataset_id!r}")
        if store.root.startswith("memory:"):
            return store.memory[dataset_id], dataset_id
        store._check()
        kind, path = format_of(dataset_id), f"{store.root.rstrip('/')}/{dataset_id}"
        if kind in ("geojson", "kml"):
            return (vector.read_geojson if kind == "geojson" else vector.read_kml)(spark, path), dataset_id
        told = zarr.read_zarr(spark, path) if kind == "zarr" else None
        if told is not None:
            wanted = VarNamesLike.pick(var_names, list(told.vars))
            told = zarr.read_zarr(spark, path, wanted) if wanted != list(told.vars) else told
        reader = spark.read.option("header", True).option("inferSchema", True) if kind == "csv" else spark.read
        df = told.df if told is not None else reader.format(kind).load(path)
        if place_names:
            df = df.where(F.col("place_name").isin(place_names))
        time_range, region = TimeRangeLike.convert(time_range), PolygonLike.convert(region)
        if time_range and "time" in df.columns:
            low, high = time_range
            if low is not None:
                df = df.where(F.col("time") >= F.lit(low).cast("timestamp_ntz"))
            if high is not None:
                df = df.where(F.col("time") <= F.lit(high).cast("timestamp_ntz"))
        if region is not None and {"lat", "lon"} <= set(df.columns):
            x0, y0, x1, y1 = region.bounds
            df = df.where(F.col("lon").between(x0, x1) & F.col("lat").between(y0, y1))
        dims = list(told.dims) if told is not None else [d for d in ("place_name", "geometry_id", "time", "lat", "lon") if d in df.columns]
        names = VarNamesLike.pick(var_names, [c for c in df.columns if c not in dims])
        df = df.select(*dims, *names)
        if told is not None:
            return told.on(df, names, tuple(dims)), dataset_id
        return (Cube.of(df, dims) if dims else df), dataset_id

    def get_supported_formats(self, data: Any, store_id: str) -> list[str]:
        self.get_store(store_id)
        return list(CUBE_FORMATS if isinstance(data, Cube) else VECTOR_FORMATS if "geometry" in data.columns else TABLE_FORMATS)

    def write_data(self, data: Any, data_id: str | None = None, store_id: str | None = None, format_id: str | None = None, replace: bool = False) -> str:
        store = self.get_store(store_id or self.get_output_store_id() or "")
        if store.read_only:
            raise ValidationError(f"the store {store.store_id!r} is read-only")
        formats = self.get_supported_formats(data, store.store_id)
        kind = format_id or formats[0]
        if kind not in formats:
            raise ValidationError(f"format {kind!r} is not supported; use one of {', '.join(formats)}")
        data_id = data_id or f"data_{os.urandom(4).hex()}"
        if os.path.splitext(data_id)[1] not in EXTENSIONS:
            data_id += f".{kind}"
        if store.root.startswith("memory:"):
            if data_id in store.memory and not replace:
                raise ValidationError(f"{data_id!r} exists already")
            store.memory[data_id] = data
            return data_id
        path, df = f"{store.root.rstrip('/')}/{data_id}", data.df if isinstance(data, Cube) else data
        if kind == "zarr":
            zarr.write_zarr(data, path, overwrite=replace)
            return data_id
        if kind in ("geojson", "kml"):
            if data_id in store.list(df.sparkSession) and not replace:
                raise ValidationError(f"{data_id!r} exists already")
            (vector.write_geojson if kind == "geojson" else vector.write_kml)(df, path, replace)
            return data_id
        writer = df.write.mode("overwrite" if replace else "errorifexists").format(kind)
        if kind == "csv":
            writer = writer.option("header", True)
        if isinstance(data, Cube) and "place_name" in data.dims:
            writer = writer.partitionBy("place_name")
        writer.save(path)
        return data_id


def format_of(name: str) -> str:
    return EXTENSIONS.get(os.path.splitext(name)[1], "parquet")


def data_type_of(name: str) -> str:
    return {"geojson": "geodataframe", "kml": "geodataframe", "csv": "dataframe", "json": "dataframe"}.get(format_of(name), "dataset")
