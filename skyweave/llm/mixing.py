"""Mixing sources to target weights with pivotal dependent rounding.

A document of a source whose target is r times its size is copied floor(r) times, and once more
with probability frac(r).  These extra copies are settled by the pivotal method: two fractional
units move mass (probability times size) between them at random, such that each keeps its expected
value, until one is 0 or 1; the other goes on.  Units meet in buckets of a fixed tree, whose
residuals meet in the next level's buckets, until a source has one residual, which is rounded to
the nearer side.  So a source's copied words differ from its target by half a document at most.

All random numbers are hashes of a seed and the document ids, so that reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import materialize, write
from .words import WORD

#: Units that a bucket of the tree holds on average at the lowest level and residuals at most above it.
FAN_IN = 64
WEIGHTS = (5, 2, 1)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, source: str, weights: Sequence[int], max_ratio: int) -> DataFrame:
    """``sizes``: a row a source with ``source_size``.  Adds ``target``.

    Sources in order of code points, null last, take the weights in turn and share the sum of all
    sizes.  A target stops at ``max_ratio`` times its source's size; the excess goes to the others by
    weight, until none is above: target = min(max_ratio * size, level * weight), the level being that
    of the first source, by growing max_ratio * size / weight, which it does not take beyond its cap.
    The window over all sources is one task: there is a row for each source, not for each document."""
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("__i") % len(weights) + 1).cast("int"))
    by_name = W.orderBy(F.col(source).isNull(), F.encode(F.coalesce(F.col(source), F.lit("")), "UTF-8"))
    by_ratio = W.orderBy("__ratio", "__i")
    below, above = by_ratio.rowsBetween(W.unboundedPreceding, -1), by_ratio.rowsBetween(0, W.unboundedFollowing)
    return (
        sizes.withColumn("__i", F.row_number().over(by_name) - 1)
        .withColumn("__w", weight)
        .withColumn("__cap", F.col("source_size") * max_ratio)
        .withColumn("__ratio", F.col("__cap") / F.col("__w"))
        .withColumn("__all", F.sum("source_size").over(W.partitionBy()))
        .withColumn("__level", (F.col("__all") - F.coalesce(F.sum("__cap").over(below), F.lit(0))) / F.sum("__w").over(above))
        .withColumn("__level", F.min_by("__level", F.when(F.col("__level") <= F.col("__ratio"), F.struct("__ratio", "__i"))).over(W.partitionBy()))
        .withColumn("target", F.least(F.col("__cap").cast("double"), F.col("__level") * F.col("__w")))
        .drop("__w", "__cap", "__ratio", "__all", "__level")
        .withColumnRenamed("__i", "__source")
    )


def _uniform(*parts: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / F.lit(float(2**53))


def _settle(units: Column, level: int, seed: int) -> Column:
    """Folds an array of units (id, size, p, ...) into its settled units and the residual one.

    Array elements must be ordered.  Units of p 0 or 1, or of size 0, are settled as they come; size 0
    has no mass to move, so its copies are dropped, which no word count shows."""
    put = lambda u, p: u.withField("p", p)
    start = F.struct(F.slice(units, 1, 0).alias("done"), F.filter(units, lambda u: F.lit(False)).alias("open"))

    def step(s: Column, u: Column) -> Column:
        r = s["open"][0]
        up = F.least(r["size"] * (1 - r["p"]), u["size"] * u["p"])  # mass that r can take from u
        down = F.least(r["size"] * r["p"], u["size"] * (1 - u["p"]))  # and u from r
        rises = _uniform(F.lit(seed), F.lit(level), r["id"], u["id"]) * (up + down) < down
        moved = F.when(rises, up).otherwise(-down)
        full = F.when(rises, r["size"] * (1 - r["p"]) <= u["size"] * u["p"]).otherwise(r["size"] * r["p"] <= u["size"] * (1 - u["p"]))  # r is settled
        r_new = F.when(full, F.when(rises, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(r["p"] + moved / r["size"])
        u_new = F.when(~full, F.when(rises, F.lit(0.0)).otherwise(F.lit(1.0))).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), u["p"] - moved / u["size"])))
        plain = (u["p"] <= 0) | (u["p"] >= 1) | (u["size"] <= 0)
        return (
            F.when(plain, F.struct(F.array_append(s["done"], put(u, F.when(u["size"] <= 0, F.lit(0.0)).otherwise(u["p"]))).alias("done"), s["open"].alias("open")))
            .when(F.size(s["open"]) == 0, F.struct(s["done"].alias("done"), F.array(u).alias("open")))
            .otherwise(
                F.struct(
                    F.array_append(s["done"], F.when(full, put(r, r_new)).otherwise(put(u, u_new))).alias("done"),
                    F.array(F.when(full, put(u, u_new)).otherwise(put(r, r_new))).alias("open"),
                )
            )
        )

    return F.aggregate(units, start, step)


def mix(docs: DataFrame, key: str, source: str, size: Column, weights: Sequence[int] = WEIGHTS, max_ratio: int = 3, seed: int = 17) -> DataFrame:
    """A row for each row of ``docs``: key, source, size, source_size, target and ``copies``.

    Null sources are one source, the last.  Null sizes count as 0; rows of size 0 have 0 or more whole
    copies and no extra ones.  Rows equal in key, source and size are one unit of the tree with a
    multiplicity, whatever their number.  Columns are made under names of their own, so other columns
    of ``docs`` may have any names.  An empty table gives no rows."""
    rows = docs.select(F.col(key).alias("id"), F.col(source).alias("source"), F.coalesce(size, F.lit(0)).cast("long").alias("size"))
    units = write(rows.groupBy("source", "id", "size").agg(F.count("*").alias("n")), "mix-units").df
    per = units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count("*").alias("units"))
    goal = materialize(targets(per, "source", weights, max_ratio), "mix-targets")
    deepest = goal.agg(F.max("units")).first()[0]
    if deepest is None:
        return rows.select("id", "source", "size", F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("copies"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    buckets = F.greatest(F.lit(1), F.ceil(F.col("units") / FAN_IN))
    # n equal rows: those of them that surely get one more copy, and one of fractional probability
    extra = F.col("n") * (F.col("ratio") - F.col("base"))
    g, u = goal.alias("g"), units.alias("u")
    placed = (
        u.join(g, F.col("u.source").eqNullSafe(F.col("g.source")))
        .select("u.id", "u.source", "u.size", "u.n", "g.source_size", "g.target", "g.__source", ratio.alias("ratio"), buckets.alias("buckets"))
        .withColumn("base", F.floor("ratio"))
        .withColumn("more", F.floor(extra))
        .withColumn("p", extra - F.col("more"))
        .withColumn("bucket", F.pmod(F.xxhash64("id", "size", F.lit(seed)), F.col("buckets")).cast("long"))
    )
    # large units come first, so that what is left over at last tends to be small
    member = F.struct((-F.col("size")).alias("order"), "id", "size", "p", "n", "base", "more", "source", "source_size", "target")
    done, level, width = [], 0, (deepest + FAN_IN - 1) // FAN_IN
    while True:
        folded = placed.groupBy("__source", "bucket").agg(F.array_sort(F.collect_list(member)).alias("units")).select("__source", "bucket", _settle(F.col("units"), level, seed).alias("s"))
        table = materialize(folded, f"mix-level{level}")
        done.append(table.select(F.explode("s.done").alias("u")))
        left = table.select("__source", "bucket", F.explode("s.open").alias("u"))
        if width <= 1:
            last = F.when(F.col("u.p") >= 0.5, F.lit(1.0)).otherwise(F.lit(0.0))
            done.append(left.select(F.col("u").withField("p", last).alias("u")))
            break
        placed = left.select("__source", F.floor(F.col("bucket") / FAN_IN).alias("bucket"), "u.*")
        width, level = (width + FAN_IN - 1) // FAN_IN, level + 1
    settled = done[0]
    for x in done[1:]:
        settled = settled.unionAll(x)
    each = settled.select("u.*").withColumn("with", F.col("more") + F.col("p").cast("long"))
    return each.select("id", "source", "size", "source_size", "target", "base", "with", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("k")).select(
        "id", "source", "size", "source_size", "target", (F.col("base") + F.when(F.col("k") <= F.col("with"), 1).otherwise(0)).cast("long").alias("copies")
    )
