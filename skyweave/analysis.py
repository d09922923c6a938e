"""Reductions of what a function makes of parts of a dataset, binned projections, gas."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.expr import emission_measure, gas_number_density, gas_temperature, mean_molecular_weight
from .operators import evaluate as ev
from .operators.dataset import Dataset

OPERATIONS = ("sum", "prod", "avg")


def reduce_df(ds: Dataset, func: Callable, operation: str = "sum", **kwargs: Any) -> DataFrame:
    """``name``, ``position`` and ``value`` of the arrays that ``func`` makes of each part, combined element by element.

    ``func`` gets numpy columns of a part of the rows; ``avg`` weighs parts by their rows."""
    if operation not in OPERATIONS:
        raise ValueError(f"operation {operation!r}: one of {', '.join(OPERATIONS)}")
    inputs = ev.arguments(func, ds.columns, kwargs)
    name = getattr(func, "__name__", "result")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            made = ev.named(name, func(**{c: ev.formed(pdf[c], "numpy") for c in inputs}, **kwargs))
            for k, v in made.items():
                flat = np.asarray(ev.strip(v), float).ravel()
                yield pd.DataFrame({"name": k, "position": np.arange(len(flat)), "value": flat, "weight": float(len(pdf))})

    parts = ds.base.select(*[ds._typed(ds.defs[c], c).column.alias(c) for c in inputs]).mapInPandas(each, "name string, position long, value double, weight double")
    value = {"sum": F.sum("value"), "prod": F.product("value"), "avg": F.sum(F.col("value") * F.col("weight")) / F.sum("weight")}[operation]
    return parts.groupBy("name", "position").agg(value.alias("value"))


def reduce(ds: Dataset, func: Callable, operation: str = "sum", plotting_function: Callable | None = None, **kwargs: Any) -> Any:
    """The combined arrays, by name if there are several; what the plotting function makes of them, if there is one."""
    pdf = reduce_df(ds, func, operation, **kwargs).orderBy("name", "position").toPandas()
    out = {k: g["value"].to_numpy() for k, g in pdf.groupby("name")}
    one = next(iter(out.values())) if len(out) == 1 else out
    return plotting_function(one) if plotting_function else one


def projection(ds: Dataset, x: str, y: str, weight: str, dx: float, dy: float | None = None) -> DataFrame:
    """Sums of ``weight`` over cells of a grid: ``i``, ``j`` and ``total``."""
    cx, cy, w = (ds._typed(ds.defs[c], c).column for c in (x, y, weight))
    return ds.base.groupBy(F.floor(cx / dx).alias("i"), F.floor(cy / (dy or dx)).alias("j")).agg(F.sum(w).alias("total"))


__all__ = ["emission_measure", "gas_number_density", "gas_temperature", "mean_molecular_weight", "projection", "reduce", "reduce_df"]
