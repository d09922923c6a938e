"""Positions of rows in an order, without sorting all rows in one task."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ranges that rows are counted over: as many as shuffle partitions, between these.  Their boundaries are literals in the plan.
RANGES, MOST_RANGES = 64, 512
#: Rows, those of the least hashes, that boundaries are taken from, for each range.
SAMPLED = 16


def _after(keys: Sequence[Column], bound: Sequence[Any], types: Sequence[T.DataType], down: Sequence[bool]) -> Column:
    """Whether a row comes after a bound: by the first key that differs, nulls first, or last where a key descends."""
    out = F.lit(False)
    for k, b, t, d in reversed(list(zip(keys, bound, types, down, strict=True))):
        if b is None:
            here, same = F.lit(False) if d else k.isNotNull(), k.isNull()
        else:
            value = F.lit(b).cast(t)
            here, same = (k.isNull() | (k < value) if d else F.coalesce(k > value, F.lit(False))), k.eqNullSafe(value)
        out = here | (same & out)
    return F.coalesce(out, F.lit(False))


def with_position(df: DataFrame, order: Sequence[tuple[Column, bool]], name: str = "__pos", ranges: int | None = None) -> DataFrame:
    """Adds positions from 0 in an order of keys, each with whether it descends, the last of which tells rows apart.

    Rows are dealt into ranges of all keys, so that equal first keys are spread too, by quantiles of a sample,
    counted, and numbered within their range."""
    ranges = ranges or min(MOST_RANGES, max(RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))))
    drop, down = [f"__k{i}" for i in range(len(order))], [d for _, d in order]
    keyed = df.withColumns({k: c for k, (c, _) in zip(drop, order, strict=True)})
    types, cols = [keyed.schema[k].dataType for k in drop], [F.col(k) for k in drop]
    keys = [F.desc(k) if d else F.asc(k) for k, d in zip(drop, down, strict=True)]
    few = keyed.select(*drop).orderBy(F.xxhash64(*drop)).limit(SAMPLED * ranges)
    rows = [tuple(r) for r in few.orderBy(*keys).collect()]
    bounds = list(dict.fromkeys(rows[len(rows) * k // ranges] for k in range(1, ranges))) if rows else []

    def place(a: int, b: int) -> Column:
        """Of ranges a to b, by halves."""
        if a == b:
            return F.lit(a)
        m = (a + b) // 2
        return F.when(_after(cols, bounds[m], types, down), place(m + 1, b)).otherwise(place(a, m))

    dealt = keyed.withColumn("__bucket", place(0, len(bounds)))
    before = F.sum("__n").over(W.orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1))
    counts = dealt.groupBy("__bucket").agg(F.count("*").alias("__n")).select("__bucket", F.coalesce(before, F.lit(0)).alias("__before"))  # a row a range
    own = F.row_number().over(W.partitionBy("__bucket").orderBy(*keys))
    return dealt.withColumn("__own", own).join(F.broadcast(counts), "__bucket").withColumn(name, (F.col("__before") + F.col("__own") - 1).cast("long")).drop("__bucket", "__own", "__before", *drop)
