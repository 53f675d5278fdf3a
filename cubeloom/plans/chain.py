"""Chains of operations, and operations made of expressions or of other programs."""

from __future__ import annotations

import ast
import os
import re
import subprocess
from collections.abc import Callable, Iterable
from functools import reduce as fold
from typing import Any

from pyspark.accumulators import AccumulatorParam
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..cube import Cube, ValidationError
from ..op import REGISTRY, Input, Monitor, Operation, Registry
from ..sources.stores import StorePool

SAFE = frozenset("abs acos asin atan atan2 ceil cos cosh degrees exp floor log log10 log2 pow radians round sin sinh sqrt tan tanh greatest least coalesce".split())


def execute_operations(operation_inputs: Any, operations: Any, op_registry: Registry = REGISTRY, monitor: Monitor = Monitor.NONE, write_results: bool = False, output_store_id: str | None = None, output_folder: str | None = None, output_file_name: str | None = None, output_format: str | None = None, replace_output: bool = False, pool: StorePool | None = None, spark: Any = None) -> list:
    """Each input through all operations in turn: one lazy plan for each input. An input is a cube, a table, a name in a
    store, or a pair (name, arguments of open_data); an operation is a name, a function or a pair with its arguments, and
    may come more than once."""
    steps: list[tuple[Operation, dict]] = []
    for step in operations.items() if isinstance(operations, dict) else operations:
        what, args = step if isinstance(step, tuple) else (step, {})
        steps.append((what if isinstance(what, Operation) else op_registry.get(getattr(what, "__name__", what), fail_if_not_exists=True), dict(args or {})))
    if output_folder and pool is not None:
        output_store_id = pool.add_local_store(output_folder, persist=False)
    out = []
    given = operation_inputs if isinstance(operation_inputs, (list, tuple)) and not isinstance(operation_inputs, str) else [operation_inputs]
    for n, source in enumerate(given):
        data = source
        if isinstance(source, (str, tuple)):
            name, args = source if isinstance(source, tuple) else (source, {})
            if pool is None:
                raise ValidationError("a store pool is needed to open inputs by name")
            data, _ = pool.open_data(spark, name, **args)
        for operation, args in steps:
            data = operation(data, monitor=monitor, **args)
        if write_results:
            if pool is None:
                raise ValidationError("a store pool is needed to write results")
            name = f"{output_file_name}_{n}" if output_file_name and len(given) > 1 else output_file_name
            out.append((data, pool.write_data(data, name, output_store_id, output_format, replace_output)))
        else:
            out.append(data)
    return out


def check_expression(expression: str, names: set[str]) -> ast.Expression:
    """Arithmetic, comparisons and whitelisted functions of the given names; all else is refused."""
    tree = ast.parse(expression, mode="eval")
    allowed = (ast.Expression, ast.BinOp, ast.UnaryOp, ast.BoolOp, ast.Compare, ast.Call, ast.Name, ast.Constant, ast.Load, ast.operator, ast.unaryop, ast.boolop, ast.cmpop, ast.IfExp)
    for node in ast.walk(tree):
        if not isinstance(node, allowed):
            raise ValidationError(f"not allowed in an expression: {type(node).__name__}")
        if isinstance(node, ast.Call) and not (isinstance(node.func, ast.Name) and node.func.id in SAFE):
            raise ValidationError("not an allowed function")
        if isinstance(node, ast.Name) and node.id not in names | SAFE | {"pi", "e"}:
            raise ValidationError(f"name {node.id!r} is not defined")
    return tree


_BINARY = {
    ast.Add: lambda a, b: a + b, ast.Sub: lambda a, b: a - b, ast.Mult: lambda a, b: a * b, ast.Pow: F.pow,
    ast.Div: lambda a, b: F.try_divide(a.cast("double"), b), ast.Mod: F.try_mod,
    ast.FloorDiv: lambda a, b: F.floor(F.try_divide(a.cast("double"), b)),
    ast.BitAnd: lambda a, b: a & b, ast.BitOr: lambda a, b: a | b,
}
_COMPARED = {ast.Eq: lambda a, b: a == b, ast.NotEq: lambda a, b: a != b, ast.Lt: lambda a, b: a < b, ast.LtE: lambda a, b: a <= b, ast.Gt: lambda a, b: a > b, ast.GtE: lambda a, b: a >= b}


def expression_column(expression: str, columns: list[str]) -> Column:
    """A column of an expression over columns, with Python's precedence; a division by zero is null."""
    tree = check_expression(expression, set(columns))

    def walk(e: ast.expr) -> Column:
        if isinstance(e, ast.Constant):
            return F.lit(e.value)
        if isinstance(e, ast.Name):
            if e.id in columns:
                return F.col(f"`{e.id}`")
            if e.id in ("pi", "e"):
                return F.pi() if e.id == "pi" else F.e()
        if isinstance(e, ast.UnaryOp):
            v = walk(e.operand)
            return {ast.USub: lambda: -v, ast.UAdd: lambda: v}.get(type(e.op), lambda: ~v)()
        if isinstance(e, ast.BinOp) and type(e.op) in _BINARY:
            return _BINARY[type(e.op)](walk(e.left), walk(e.right))
        if isinstance(e, ast.BoolOp):
            return fold((lambda a, b: a & b) if isinstance(e.op, ast.And) else (lambda a, b: a | b), map(walk, e.values))
        if isinstance(e, ast.Compare) and all(type(o) in _COMPARED for o in e.ops):
            sides = [walk(x) for x in (e.left, *e.comparators)]
            return fold(lambda a, b: a & b, (_COMPARED[type(o)](a, b) for o, a, b in zip(e.ops, sides, sides[1:])))
        if isinstance(e, ast.IfExp):
            return F.when(walk(e.test), walk(e.body)).otherwise(walk(e.orelse))
        if isinstance(e, ast.Call) and not e.keywords:
            if e.func.id == "round":
                return F.round(walk(e.args[0]), *(a.value for a in e.args[1:]))
            return getattr(F, e.func.id)(*map(walk, e.args))
        raise ValidationError(f"not allowed in an expression: {ast.unparse(e)}")

    return walk(tree.body)


def new_expression_op(name: str, expression: str, output: str = "result", registry: Registry | None = None) -> Operation:
    """An operation that adds a column of an expression over the table's columns."""

    def run(ds: Any) -> Any:
        df: DataFrame = ds.df if isinstance(ds, Cube) else ds
        out = df.withColumn(output, expression_column(expression, df.columns))
        return ds.with_(df=out, vars={**ds.vars, output: {}}) if isinstance(ds, Cube) else out

    operation = Operation(run, name, {"ds": Input("ds")}, description=expression)
    return registry.add(operation) if registry is not None else operation


class _Reports(AccumulatorParam):
    """What tasks say of their programs, (kind, work, message): passed on to the driver's monitor as each task ends, and kept nowhere."""

    def __init__(self, monitor: Monitor | None = None) -> None:
        self.monitor = monitor

    def __getstate__(self) -> dict:
        return {"monitor": None}  # tasks have none

    def zero(self, value: list) -> list:
        return []

    def addInPlace(self, value1: list, value2: list) -> list:  # noqa: N802, N803
        if self.monitor is None:
            return value1 + value2
        for kind, work, message in value2:
            if kind == "started":
                self.monitor.start(message or self.monitor.label, work or self.monitor.total)
            elif kind == "progress":
                self.monitor.progress(work, message)
            else:
                self.monitor.finish()
        return []


def _told(lines: Iterable[str], patterns: dict[str, str]) -> list[tuple[str, float | None, str | None]]:
    """What lines that match the patterns say; the work of progress lines is summed and the last message stands for all."""
    out: dict[str, list] = {}
    for line in lines:
        for kind, pattern in patterns.items():
            m = re.search(pattern, line)
            if m is None:
                continue
            named = m.groupdict()
            work, message = named.get("total_work" if kind == "started" else "work"), named.get("label" if kind == "started" else "msg")
            known = out.setdefault(kind, [None, None])
            if work is not None:
                known[0] = float(work) + (known[0] or 0.0 if kind == "progress" else 0.0)
            known[1] = message or known[1]
    return [(kind, *v) for kind, v in out.items()]


def new_subprocess_op(
    name: str, command: list[str], schema: str, started: str | None = None, progress: str | None = None, done: str | None = None, monitor: Monitor | None = None, registry: Registry | None = None, cwd: str | None = None, env: dict[str, str] | None = None
) -> Operation:
    """An operation that gives each batch of rows, as JSON lines, to a program and reads its JSON lines as rows of a schema.

    Lines of the program's standard error are matched with patterns: started (groups label, total_work), progress (groups
    work, msg) and done. What they say reaches the monitor as each task ends. A status other than zero fails the task.
    """
    import json

    import pandas as pd

    patterns = {k: v for k, v in (("started", started), ("progress", progress), ("done", done)) if v}

    def run(df: DataFrame) -> DataFrame:
        reports = df.sparkSession.sparkContext.accumulator([], _Reports(monitor)) if patterns and monitor is not None else None

        def each(frames: Any) -> Any:
            for frame in frames:
                text = frame.to_json(orient="records", lines=True, date_format="iso")
                ended = subprocess.run(command, input=text, capture_output=True, text=True, cwd=cwd, env=None if env is None else os.environ | env)
                if ended.returncode:
                    raise RuntimeError(f"{command[0]} ended with status {ended.returncode}: {ended.stderr[-500:]}")
                if reports is not None:
                    reports.add(_told(ended.stderr.splitlines(), patterns))
                rows = [json.loads(x) for x in ended.stdout.splitlines() if x.strip()]
                if rows:
                    yield pd.DataFrame(rows)

        return df.mapInPandas(each, schema)

    operation = Operation(run, name, {"df": Input("df")}, description=" ".join(command), history=False)
    return registry.add(operation) if registry is not None else operation


def pipeline(*steps: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    """Functions of tables as one."""

    def run(df: DataFrame) -> DataFrame:
        for s in steps:
            df = df.transform(s)
        return df

    return run
