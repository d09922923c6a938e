"""Rows that point at their host row in the same table.

The host is stored as an id; positions are worked out when they are asked for, so any choice of rows keeps them right.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.dataset import Dataset, Stored
from ..plans.positions import with_position

POINTER = "top_host_idx"


def with_host_position(ds: Dataset, host: str, key: str, name: str = POINTER) -> Dataset:
    """Adds the position of each row's host among the rows of the moment, -1 if it is not there."""
    placed = with_position(ds.base, ds._keys(), "__at")
    at = placed.select(F.col(key).alias("__host"), F.col("__at").alias("__host_at"))
    base = placed.drop("__at").join(at, F.col(host) == F.col("__host"), "left")
    stored = ds._fresh(name)
    base = base.withColumn(stored, F.coalesce(F.col("__host_at"), F.lit(-1)).cast("long")).drop("__host", "__host_at")
    return ds._with(base=base, defs=ds.defs | {name: Stored(stored, None, True)})


def keep_top_host(chosen: Dataset, everything: Dataset, host: str) -> Dataset:
    """All rows of ``everything`` whose host is that of a chosen row."""
    groups = chosen.base.select(F.col(host).alias("__host")).distinct()
    return everything._with(base=everything.base.join(groups, F.col(host).eqNullSafe(F.col("__host")), "left_semi"))


def from_positions(ds: Dataset, pointer: str, key: str, name: str = "host_id") -> Dataset:
    """Turns stored positions, with -1 for none, into ids."""
    placed = with_position(ds.base, [(F.col(c), False) for c in ds.order], "__at")
    ids = placed.select(F.col("__at").alias("__to"), F.col(key).alias("__id"))
    stored = ds._fresh(name)
    base = placed.drop("__at").join(ids, F.col(pointer) == F.col("__to"), "left").withColumn(stored, F.col("__id")).drop("__to", "__id")
    return ds._with(base=base, defs=ds.defs | {name: Stored(stored, None, True)})
