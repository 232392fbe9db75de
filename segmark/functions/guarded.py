"""Callers' own functions with an error channel: what raises on one row costs that row, not the run."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.util import PythonEvalType

ROWS = (PythonEvalType.SQL_BATCHED_UDF, PythonEvalType.SQL_ARROW_BATCHED_UDF)
SERIES = (PythonEvalType.SQL_SCALAR_PANDAS_UDF,)
ARRAYS = (PythonEvalType.SQL_SCALAR_ARROW_UDF,)

#: Values at fault that a task remembers.
MAX_FAULTS = 100_000


def _as_array(found, kind: pa.DataType) -> pa.Array:
    if isinstance(found, pa.ChunkedArray):
        found = found.combine_chunks()
    if not isinstance(found, pa.Array):
        found = found.to_dict("records") if hasattr(found, "columns") else list(found)
        found = pa.array(found, kind, from_pandas=True)
    return found if found.type == kind else found.cast(kind)


def kernel_of(function: Callable) -> tuple[Callable, T.DataType] | None:
    """The function of Arrow arrays behind a Python UDF of any scalar kind and what it returns; None for others."""
    style, plain, returned = (getattr(function, a, None) for a in ("evalType", "func", "returnType"))
    if plain is None or returned is None or style not in (*ROWS, *SERIES, *ARRAYS):
        return None
    kind = to_arrow_type(returned)

    def run(*columns: pa.Array) -> pa.Array:
        if style in ROWS:
            found = pa.array([plain(*row) for row in zip(*(c.to_pylist() for c in columns))], kind)
        elif style in SERIES:
            found = _as_array(plain(*(c.to_pandas() for c in columns)), kind)
        else:
            found = _as_array(plain(*columns), kind)
        if len(found) != len(columns[0]):
            raise ValueError(f"{len(columns[0])} rows in, {len(found)} out")
        return found

    return run, returned


def outcome(run: Callable, kind: pa.DataType, columns: list[pa.Array], failed: bool = False) -> tuple[list[pa.Array], list[str | None]]:
    """Results of a batch in pieces and each row's error; a batch that raises is halved down to the rows at fault.

    ``failed``: it is known to raise, being what is left of a batch that did, so it is halved at once.
    """
    n = len(columns[0])
    if n == 1 or not failed:
        try:
            return [run(*columns)], [None] * n
        except Exception as error:  # whatever a caller's function raises
            if n == 1:
                return [pa.nulls(1, kind)], [f"{type(error).__name__}: {error}"]
    half = n // 2
    left, bad_left = outcome(run, kind, [c.slice(0, half) for c in columns])
    right, bad_right = outcome(run, kind, [c.slice(half) for c in columns], not any(bad_left))
    return left + right, bad_left + bad_right


def by_value(run: Callable, kind: pa.DataType) -> Callable[[pa.Array], pa.Array]:
    """(value, error) of every row, from one call for the distinct values of a batch; NULL has neither.

    Values at fault are remembered over the batches of a task, so each is looked for once.
    """
    faults: dict[object, str] = {}

    def checked(column: pa.Array) -> pa.Array:
        coded = column.dictionary_encode()
        values = coded.dictionary
        errors = [faults.get(v) for v in values.to_pylist()] if faults else [None] * len(values)
        fresh = np.flatnonzero([e is None for e in errors])
        parts = []
        if len(fresh):
            parts, found = outcome(run, kind, [values.take(pa.array(fresh))])
            for k, error in zip(fresh, found):
                errors[k] = error
                if error is not None and len(faults) < MAX_FAULTS:
                    faults[values[k].as_py()] = error
        place = np.full(len(values), -1)
        place[fresh] = np.arange(len(fresh))
        got = pa.concat_arrays(parts) if parts else pa.nulls(0, kind)
        table = pa.StructArray.from_arrays([got.take(pa.array(place, mask=place < 0)), pa.array(errors, pa.string())], names=["value", "error"])
        return table.take(coded.indices)

    return checked


def guarded(function: Callable, distinct: bool = False) -> Callable[..., Column]:
    """``function`` as one that gives (value, error): a row on which it raises has no value and the reason.

    ``distinct``: a function of one column whose result depends on the value only; it is called for the distinct values
    of a batch, and never for NULL.

    Python UDFs of every scalar kind are run behind the guard; other functions of columns (built-in expressions) are
    used as they are and have no errors.
    """
    kernel = kernel_of(function)
    if kernel is None:
        return lambda *columns: F.struct(function(*columns).alias("value"), F.lit(None).cast("string").alias("error"))
    run, returned = kernel
    kind = to_arrow_type(returned)
    schema = T.StructType([T.StructField("value", returned), T.StructField("error", T.StringType())])

    def checked(*columns: pa.Array) -> pa.Array:
        if not len(columns[0]):
            return pa.StructArray.from_arrays([pa.nulls(0, kind), pa.nulls(0, pa.string())], names=["value", "error"])
        parts, errors = outcome(run, kind, list(columns))
        return pa.StructArray.from_arrays([pa.concat_arrays(parts), pa.array(errors, pa.string())], names=["value", "error"])

    valued = by_value(run, kind) if distinct else checked

    # One function for each number of columns: Spark reads the kind of a function from its signature.
    def one(a: pa.Array) -> pa.Array:
        return valued(a)

    def two(a: pa.Array, b: pa.Array) -> pa.Array:
        return checked(a, b)

    own = {1: F.arrow_udf(one, schema), 2: F.arrow_udf(two, schema)}
    # As with the library's own kernel: evaluated once, not again in filters that Spark derives.
    own = {n: f.asNondeterministic() for n, f in own.items()}
    return lambda *columns: own[len(columns)](*columns)
