"""Connected components of a graph given by its edges, by alternating large-star and small-star steps.

Each step moves a node's neighbours to the smallest node it knows, and the number of steps grows
with the logarithm of the graph's size.  Minima are partial aggregates, and are written before they
are joined, so that Spark can split the join of a node with very many edges.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Table, write


def forest(i: np.ndarray, j: np.ndarray, name: np.ndarray) -> np.ndarray:
    """For each entry of ``name``, the smallest name that the pairs of indices i, j lead to; for graphs in memory."""
    least = name.copy()
    while True:
        new = least.copy()
        np.minimum.at(new, i, least[j])
        np.minimum.at(new, j, new[i])
        if (new == least).all():
            return least
        least = new


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``node`` and ``component``, its smallest reachable node, for nodes that are not the smallest of theirs.

    Loops and repeated edges change nothing; edges with a null end are left out; no edges, no rows.
    All else that a graph has is its own component."""
    u, v = F.greatest(F.col(a), F.col(b)), F.least(F.col(a), F.col(b))
    now = write(edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(u.alias("u"), v.alias("v")).distinct(), "edges")
    state = _state(now.df)
    while state[0]:
        both = now.df.unionAll(now.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = write(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "stars")
        large = write(both.join(least.df, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        low = write(large.df.groupBy("u").agg(F.min("v").alias("m")), "stars")
        moved = large.df.join(low.df, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") > F.col("v"))
        new: Table = write(moved.unionAll(low.df.select("u", F.col("m").alias("v"))).distinct(), "edges")
        for old in (now, least, large, low):
            old.drop()
        now, before, state = new, state, _state(new.df)
        if state == before:
            break
    return now.df.select(F.col("u").alias("node"), F.col("v").alias("component"))
