"""Functions of users over rows, batches, columns, in Arrow batches of pandas frames."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.units import Quantity, Unit
from ..plans.positions import with_position
from .groups import whole_groups

FORMATS = ("numpy", "pandas", "arrow", "polars", "jax")


def check_format(format: str) -> None:
    if format not in FORMATS:
        raise ValueError(f"format {format!r}: one of {', '.join(FORMATS)}")
    if format in ("polars", "jax"):
        __import__(format)


def arguments(func: Callable, columns: list[str], kwargs: dict[str, Any]) -> list[str]:
    """Columns that a function's parameters name.  Parameters with a default are no columns."""
    if clash := sorted(set(kwargs) & set(columns)):
        raise ValueError(f"arguments that are columns too: {', '.join(clash)}")
    needed = [n for n, p in inspect.signature(func).parameters.items() if p.default is p.empty and p.kind not in (p.VAR_KEYWORD, p.VAR_POSITIONAL)]
    if unknown := [n for n in needed if n not in columns and n not in kwargs]:
        raise ValueError(f"{getattr(func, '__name__', 'the function')} needs {', '.join(unknown)}, no column or argument")
    return [n for n in needed if n in columns]


def formed(s: pd.Series, format: str) -> Any:
    if format == "pandas":
        return s
    if format == "arrow":
        import pyarrow as pa

        return pa.array(s)
    if format == "polars":
        import polars

        return polars.Series(s.to_numpy())
    a = np.stack(s.to_numpy()) if len(s) and isinstance(s.iloc[0], (list, np.ndarray)) else s.to_numpy()
    if format == "jax":
        import jax.numpy as jnp

        return jnp.asarray(a)
    return a


def named(name: str, made: Any) -> dict[str, Any]:
    return made if isinstance(made, dict) else {name: made}


def strip(x: Any) -> Any:
    return x.value if isinstance(x, Quantity) else x


def kind_of(x: Any) -> tuple[T.DataType, Unit | None]:
    """Spark's type and the unit of an example of a value of one row."""
    unit = x.unit if isinstance(x, Quantity) else None
    a = np.asarray(strip(x))
    base: T.DataType = T.BooleanType() if a.dtype.kind == "b" else T.LongType() if a.dtype.kind in "iu" else T.StringType() if a.dtype.kind in "US" else T.DoubleType()
    for _ in range(a.ndim):
        base = T.ArrayType(base)
    return base, unit


def column_of(made: Any, n: int) -> list | np.ndarray:
    made = strip(made)
    if hasattr(made, "to_numpy"):
        try:
            made = made.to_numpy(zero_copy_only=False)
        except TypeError:
            made = made.to_numpy()
    a = np.asarray(made)
    if a.ndim == 0 or len(a) != n:
        raise ValueError(f"a function made {a.shape or 'one value'} for {n} rows")
    return a.tolist() if a.ndim > 1 else a


def run(ds: Any, func: Callable, *, vectorize: bool, insert: bool, format: str, batch_size: int, allow_overwrite: bool, elementwise: bool, kwargs: dict[str, Any]) -> Any:
    """Evaluates ``func`` over rows; its parameters name columns, its result is a value or a dict of columns.

    By default it gets one row at a time.  ``batch_size``: runs of so many rows in order, the last may be shorter.
    ``vectorize``: the whole columns in one call, which one task must hold.  ``elementwise``: arrays of any rows,
    for functions that treat rows alike; the way for large tables.  ``insert``: a new dataset, whose
    new columns do not follow unit conventions; else the results, None for a function that returns nothing."""
    check_format(format)
    name = getattr(func, "__name__", "result")
    name = "result" if name == "<lambda>" else name
    inputs = arguments(func, ds.columns, kwargs)
    if not inputs:
        raise ValueError("a function of no column")
    args = {c: f"__arg_{c}" for c in inputs}
    base = ds.base.withColumns({v: ds._typed(ds.defs[c], c).column for c, v in args.items()})

    def whole(pdf: pd.DataFrame) -> dict[str, Any]:
        return named(name, func(**{c: formed(pdf[v], format) for c, v in args.items()}, **kwargs))

    def by_row(pdf: pd.DataFrame) -> dict[str, Any]:
        columns = {c: formed(pdf[v], "numpy") for c, v in args.items()}
        made = [named(name, func(**{c: x[i] for c, x in columns.items()}, **kwargs)) for i in range(len(pdf))]
        return {k: np.stack([np.asarray(strip(m[k])) for m in made]) for k in made[0]} if made else {}

    chunks = vectorize or elementwise or batch_size > 0
    call = whole if chunks else by_row
    first = base.select(*args.values()).limit(1).toPandas()
    if not len(first):
        probe = None
    else:
        r = func(**{c: formed(first[v], format) if chunks else formed(first[v], "numpy")[0] for c, v in args.items()}, **kwargs)
        probe = None if r is None else named(name, r)
        if probe is not None and chunks:
            probe = {k: Quantity(column_of(v, 1)[0], v.unit) if isinstance(v, Quantity) else column_of(v, 1)[0] for k, v in probe.items()}
    if probe is None:
        if insert:
            raise ValueError("a function that makes nothing, or no rows to try it on")
        if len(first):
            for b in base.select(*args.values()).toLocalIterator():
                func(**{c: b[v] for c, v in args.items()}, **kwargs)
        return None
    if insert and not allow_overwrite and (taken := sorted(set(probe) & set(ds.columns))):
        raise ValueError(f"columns exist: {', '.join(taken)}")
    kinds = {k: kind_of(v) for k, v in probe.items()}
    stored = {k: ds._fresh(k) for k in probe}
    keep = ds.base.columns
    schema = T.StructType([*ds.base.schema.fields, *[T.StructField(stored[k], t) for k, (t, _) in kinds.items()]])

    def filled(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pdf[keep].copy()
        made = call(pdf) if len(pdf) else {}
        for k in kinds:
            out[stored[k]] = column_of(made[k], len(pdf)) if made else []
        return out

    if batch_size > 0:
        placed = with_position(base, ds._keys())
        batches = placed.withColumn("__batch", F.floor(F.col("__pos") / batch_size))
        arrow = to_arrow_schema(schema)

        def in_runs(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t, begin in whole_groups(found, ["__batch"]):
                pdf, made = t.select(list(args.values())).to_pandas(), {k: [] for k in kinds}
                for a, b in zip(begin, begin[1:], strict=False):
                    one = whole(pdf.iloc[a:b].reset_index(drop=True))
                    for k, v in made.items():
                        v.extend(column_of(one[k], int(b - a)))
                old = [t[c].combine_chunks().cast(arrow.field(c).type) for c in keep]
                yield pa.RecordBatch.from_arrays([*old, *[pa.array(made[k], arrow.field(stored[k]).type) for k in kinds]], schema=arrow)

        result = batches.repartition(F.xxhash64("__batch")).sortWithinPartitions("__batch", "__pos").mapInArrow(in_runs, schema)
    elif vectorize and not elementwise:
        placed = with_position(base, ds._keys())
        result = placed.withColumn("__one", F.lit(0)).groupBy("__one").applyInPandas(lambda pdf: filled(pdf.sort_values("__pos", kind="stable")), schema)
    else:

        def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                yield filled(pdf)

        result = base.mapInPandas(each, schema)
    from .dataset import Stored

    new = ds._with(base=result, defs=ds.defs | {k: Stored(stored[k], unit, True) for k, (_, unit) in kinds.items()})
    if insert:
        return new
    return new._with(defs={k: new.defs[k] for k in kinds}).get_data("numpy", unpack=False)
