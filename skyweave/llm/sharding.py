"""Weighted rendezvous hashing of stable record keys over shards.

A record goes to the shard with the largest score ``-weight / ln(u)``, ``u`` being a hash of the
key and the shard number in (0, 1).  A further shard only adds a candidate, so rows move into it
or stay; a shard's share of the keys is its share of the weights.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import packed, passing, unpacked
from .store import materialize

#: Ranges of the key's hash within a shard that slots are counted over; fixes the size of the table of offsets.
SLOT_RANGES = 1024


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Shard of ``key``; shards of no or negative weight get nothing.  A null key is a key of its own.

    Equal scores, which 52 bits make unlikely, go to the larger shard number."""
    if not any(w > 0 for w in weights):
        raise ValueError("no shard has a positive weight")
    text = F.coalesce(key.cast("string"), F.lit("\0null"))

    def score(i: int, w: float) -> Column:
        u = (F.shiftrightunsigned(F.xxhash64(text, F.lit(i)), 12).cast("double") + 0.5) / F.lit(float(2**52))
        return F.struct((F.lit(-float(w)) / F.ln(u)).alias("score"), F.lit(i).alias("shard"))

    best = [score(i, w) for i, w in enumerate(weights) if w > 0]
    return (F.greatest(*best) if len(best) > 1 else best[0])["shard"]


def assign(df: DataFrame, key: str, weights: Sequence[float], shard: str = "shard") -> DataFrame:
    """Adds the shard of each row; a column of that name is replaced.  No shuffle; copies of a key share a shard.

    An empty table gives no rows."""
    return df.withColumn(shard, rendezvous(F.col(f"`{key}`"), weights))


def with_slots(df: DataFrame, key: str, ties: Sequence[str], n_shards: int, shard: str = "shard", slot: str = "slot") -> DataFrame:
    """Adds gapless positions from 0 within each shard, ordered by range of the key's hash, key and ``ties``; a column ``slot`` is replaced.

    Rows are counted over ``SLOT_RANGES`` hash ranges a shard, whose offsets (``n_shards *
    SLOT_RANGES`` rows at most, hence broadcast) are added to positions within a range, so that no task
    holds a shard.  A null key comes first in its range.  Rows equal in all these columns take their places in any order.
    An empty table gives no rows."""
    from pyspark.sql import Window as W

    rest = passing(df, (slot,))
    part = F.pmod(F.xxhash64(F.col(f"`{key}`"), F.lit("slot")), F.lit(SLOT_RANGES)).cast("int")
    rows = df.select(packed(rest), F.col(f"`{shard}`").alias("shard"), part.alias("part"))
    counts = materialize(rows.groupBy("shard", "part").agg(F.count("*").alias("n")), "slots")
    before = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = W.partitionBy("shard", "part").orderBy(F.col("row").getField(key).asc_nulls_first(), *[F.col("row").getField(t) for t in ties])
    placed = rows.withColumn("at", F.row_number().over(own)).join(F.broadcast(offsets), ["shard", "part"])
    return unpacked(placed, rest, (F.col("before") + F.col("at") - 1).cast("long").alias(slot))
