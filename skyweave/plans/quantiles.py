"""Exact quantiles without all values in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A share of rows that quantile sketches are off by at most, as 1 of so many.
ACCURACY = 10_000


def exact(df: DataFrame, value: Column, q: float) -> DataFrame:
    """One row, ``v``: the interpolated quantile of the values that are not null; null if there are none.

    A sketch bounds the two ranks that count by values, and of the rows only those between the bounds, about one in
    ``ACCURACY / 4`` besides ties, are counted by value and put in order.  What lies outside is counted."""
    rows = df.select(value.cast("double").alias("v")).where("v IS NOT NULL")
    near = [max(0.0, q - 2 / ACCURACY), min(1.0, q + 2 / ACCURACY)]
    ends = rows.agg(F.percentile_approx("v", near, ACCURACY).alias("b")).select(F.col("b")[0].alias("low"), F.col("b")[1].alias("high"))
    placed = rows.crossJoin(F.broadcast(ends))  # one row
    inside = F.col("v").between(F.col("low"), F.col("high"))
    # below and above, the nearest value stands for its side: sketches may be off by a rank in small tables
    side = F.when(inside, 0).when(F.col("v") < F.col("low"), -1).otherwise(1)
    counts = placed.groupBy(side.alias("side"), F.when(inside, F.col("v")).alias("x")).agg(F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most"))
    value_of = F.when(F.col("side") == -1, F.col("most")).otherwise(F.col("least"))
    run = W.orderBy("side", "x").rowsBetween(W.unboundedPreceding, W.currentRow)
    summed = counts.select(value_of.alias("v"), "n", F.sum("n").over(run).alias("upto"), F.sum("n").over(W.partitionBy()).alias("all"))
    rank = F.lit(q) * (F.col("all") - 1)
    holds = lambda r: F.max(F.when((F.col("upto") > r) & (F.col("upto") - F.col("n") <= r), F.col("v")))
    ranks = summed.agg(holds(F.floor(rank)).alias("a"), holds(F.ceil(rank)).alias("b"), F.max(rank - F.floor(rank)).alias("f"))
    return ranks.select(F.when(F.col("a") == F.col("b"), F.col("a")).otherwise(F.col("a") * (1 - F.col("f")) + F.col("b") * F.col("f")).alias("v"))
