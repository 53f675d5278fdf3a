"""Operations: functions with declared inputs, checked on every call, listed in a registry, with provenance."""

from __future__ import annotations

import functools
import importlib.metadata
import inspect
import logging
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession

from .cube import Cube, ValidationError
from .likes import Like

UNSET = object()


@dataclass
class Input:
    name: str
    default: Any = UNSET
    data_type: Any = None
    nullable: bool | None = None
    value_set: list | None = None
    any_of: list | None = None  # every element of a list must be one of these
    value_range: tuple | None = None
    units: str | None = None
    description: str | None = None
    deprecated: bool | str = False

    def check(self, value: Any) -> Any:
        """The converted value."""
        if value is None:
            if self.nullable or self.default is None:
                return None
            raise ValidationError(f"input {self.name!r} must be given")
        kind = self.data_type
        if isinstance(kind, type) and issubclass(kind, Like):
            try:
                value = kind.convert(value)
            except ValueError as e:
                raise ValidationError(f"input {self.name!r}: {e}") from None
        elif kind is float and isinstance(value, int) and not isinstance(value, bool):
            value = float(value)
        elif isinstance(kind, type) and not isinstance(value, kind):
            raise ValidationError(f"input {self.name!r} must be of type {kind.__name__!r}, but got type {type(value).__name__!r}")
        if self.value_set is not None and value not in self.value_set:
            raise ValidationError(f"input {self.name!r} must be one of {self.value_set}, but got {value!r}")
        if self.any_of is not None:
            for x in [value] if isinstance(value, str) else value:
                if x not in self.any_of:
                    raise ValidationError(f"input {self.name!r} takes {self.any_of}, but got {x!r}")
        if self.value_range is not None and not self.value_range[0] <= value <= self.value_range[1]:
            raise ValidationError(f"input {self.name!r} must be in range {self.value_range}, but got {value!r}")
        return value


@dataclass
class Operation:
    function: Callable
    name: str
    inputs: dict[str, Input]
    version: str = "1.0"
    tags: tuple[str, ...] = ()
    description: str = ""
    history: bool = True
    outputs: dict[str, dict] = field(default_factory=lambda: {"return": {}})
    deprecated: bool | str = False

    def bind(self, args: tuple, kwargs: dict) -> dict[str, Any]:
        names = list(self.inputs)
        if len(args) > len(names):
            raise ValidationError(f"operation {self.name!r} takes {len(names)} inputs")
        given = dict(zip(names, args))
        for k, v in kwargs.items():
            if k not in self.inputs:
                raise ValidationError(f"operation {self.name!r} has no input {k!r}")
            if k in given:
                raise ValidationError(f"input {k!r} is given twice")
            given[k] = v
        out = {}
        for k, spec in self.inputs.items():
            value = given.get(k, spec.default)
            if value is UNSET:
                raise ValidationError(f"input {k!r} must be given")
            out[k] = spec.check(value)
        return out

    def __call__(self, *args: Any, monitor: Monitor | None = None, **kwargs: Any) -> Any:
        values = self.bind(args, kwargs)
        with (monitor or Monitor.NONE).observing(self.name):
            result = self.function(**values)
        return self._with_history(result, values) if self.history and isinstance(result, Cube) else result

    def _with_history(self, cube: Cube, values: dict[str, Any]) -> Cube:
        said = ", ".join(f"{k}={v!r}" for k, v in values.items() if not isinstance(v, Cube) and not hasattr(v, "sparkSession"))
        line = f"Modified with {self.name} v{self.version} ({said})"
        return cube.with_(attrs={**cube.attrs, "history": "\n".join(filter(None, [cube.attrs.get("history"), line]))})

    def meta(self) -> dict[str, Any]:
        """The operation's description as plain values for JSON."""
        name = lambda t: getattr(t, "name", None) if isinstance(t, type) and issubclass(t, Like) else getattr(t, "__name__", None)
        return {
            "qualified_name": f"cubeloom.ops.{self.name}",
            "header": {"description": self.description, "tags": list(self.tags), "version": self.version, "deprecated": self.deprecated},
            "inputs": {k: {"data_type": name(v.data_type), **({"default_value": v.default} if v.default is not UNSET else {}), **{a: getattr(v, a) for a in ("nullable", "value_set", "any_of", "value_range", "units", "description") if getattr(v, a) is not None}} for k, v in self.inputs.items()},
            "outputs": self.outputs,
        }


class Registry:
    def __init__(self) -> None:
        self._ops: dict[str, Operation] = {}

    def add(self, op: Operation, fail_if_exists: bool = True) -> Operation:
        if fail_if_exists and op.name in self._ops:
            raise ValidationError(f"operation {op.name!r} is already registered")
        self._ops[op.name] = op
        return op

    def remove(self, name: str, fail_if_not_exists: bool = False) -> Operation | None:
        if fail_if_not_exists and name not in self._ops:
            raise ValidationError(f"operation {name!r} is not registered")
        return self._ops.pop(name, None)

    def get(self, name: str, fail_if_not_exists: bool = False) -> Operation | None:
        found = self._ops.get(name.rsplit(".", 1)[-1])
        if found is None and fail_if_not_exists:
            raise ValidationError(f"operation {name!r} is not registered")
        return found

    def names(self) -> list[str]:
        return sorted(self._ops)

    def items(self) -> list[tuple[str, Operation]]:
        return [(n, self._ops[n]) for n in self.names()]


REGISTRY = Registry()


def op(version: str = "1.0", tags: tuple[str, ...] | str = (), registry: Registry = REGISTRY, history: bool = True, deprecated: bool | str = False, **inputs: dict[str, Any]) -> Callable:
    """Register a function. Keyword arguments describe inputs: name=dict(data_type=..., value_set=..., ...)."""

    def register(f: Callable) -> Operation:
        found = {}
        doc = dict(re.findall(r":param (\w+):\s*(.*)", f.__doc__ or ""))
        for name, p in inspect.signature(f).parameters.items():
            found[name] = Input(name, UNSET if p.default is p.empty else p.default, description=doc.get(name), **inputs.get(name, {}))
        o = Operation(f, f.__name__, found, version, (tags,) if isinstance(tags, str) else tuple(tags), (f.__doc__ or "").split(":param")[0].strip(), history, deprecated=deprecated)
        functools.update_wrapper(o, f)
        return registry.add(o)

    return register


def list_operations(tag: str | None = None, include_qualified_name: bool = False, registry: Registry = REGISTRY) -> list:
    out = [(o.meta()["qualified_name"], n) if include_qualified_name else n for n, o in registry.items() if not n.startswith("_") and "internal" not in o.tags and (not tag or any(tag in t for t in o.tags))]
    return out


def get_op(name: str, registry: Registry = REGISTRY) -> Operation:
    return registry.get(name, fail_if_not_exists=True)


def get_op_meta_info(name: str, registry: Registry = REGISTRY) -> dict[str, Any]:
    return get_op(name, registry).meta()


class Cancelled(RuntimeError):
    pass


class Monitor:
    """Progress and cancellation. The jobs of an observed block run in a job group, which cancel() stops."""

    NONE: Monitor

    def __init__(self, spark: SparkSession | None = None) -> None:
        self.spark, self.label, self.total, self.done, self.cancelled = spark, "", 0.0, 0.0, False

    class _Block:
        def __init__(self, monitor: Monitor, label: str) -> None:
            self.monitor, self.label = monitor, label

        def __enter__(self) -> Monitor:
            self.monitor.check()
            self.monitor.start(self.label, 1.0)
            return self.monitor

        def __exit__(self, *_: Any) -> None:
            self.monitor.finish()

    def observing(self, label: str) -> _Block:
        return Monitor._Block(self, label)

    starting = observing

    def start(self, label: str, total_work: float) -> None:
        self.label, self.total, self.done = label, total_work, 0.0
        if self.spark is not None:
            self.spark.sparkContext.setJobGroup(f"cubeloom-{id(self)}", label, interruptOnCancel=True)

    def progress(self, work: float | None = None, msg: str | None = None) -> None:
        self.check()
        self.done += work or 0.0

    def finish(self) -> None:
        self.done = self.total

    def cancel(self) -> None:
        self.cancelled = True
        if self.spark is not None:
            self.spark.sparkContext.cancelJobGroup(f"cubeloom-{id(self)}")

    def check(self) -> None:
        if self.cancelled:
            raise Cancelled(self.label)

    def child(self, work: float) -> ChildMonitor:
        return ChildMonitor(self, work)


class ChildMonitor(Monitor):
    """Reports its share of work to the monitor above."""

    def __init__(self, parent: Monitor, work: float) -> None:
        super().__init__(parent.spark)
        self.parent, self.work = parent, work

    def progress(self, work: float | None = None, msg: str | None = None) -> None:
        super().progress(work, msg)
        if self.total:
            self.parent.progress((work or 0.0) / self.total * self.work, msg)

    def check(self) -> None:
        self.parent.check()
        super().check()

    def cancel(self) -> None:
        self.parent.cancel()


class ConsoleMonitor(Monitor):
    """Prints what starts, how far it is and that it ended."""

    def start(self, label: str, total_work: float) -> None:
        super().start(label, total_work)
        print(f"{label}: start")

    def progress(self, work: float | None = None, msg: str | None = None) -> None:
        super().progress(work, msg)
        print(f"{self.label}: {100 * self.done / (self.total or 1):.0f}%" + (f": {msg}" if msg else ""))

    def finish(self) -> None:
        super().finish()
        print(f"{self.label}: done")


Monitor.NONE = Monitor()


def load_plugins(group: str = "cubeloom_plugins") -> dict[str, Any]:
    """Call the functions of installed entry points; those that fail are logged and left out."""
    found = {}
    for entry in importlib.metadata.entry_points(group=group):
        try:
            init = entry.load()
            init()
            found[entry.name] = init
        except Exception:
            logging.getLogger(__name__).exception("plugin %s failed", entry.name)
    return found
