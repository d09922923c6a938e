"""Near-duplicate embeddings: spherical k-means cells, blocked cosine products within cells.

Distinct unit vectors are assigned to the cell of the nearest centroid, their home.  Unit vectors with
a cosine of c or more are at most r = sqrt(2 - 2c) apart, and the plane between two cells lies between
vectors at home on its two sides, so one of any linked two is within r / 2 of it.  Hence a vector also
visits each cell whose plane is within r / 2, and every link is found in a home of one of the two: the
search is exact, and centroids only decide what it costs.  Cells are compared in blocks of rows, so
no task holds a cell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import frugal
from .components import components, forest
from .store import materialize

COSINE = 0.95
#: Vectors that centroids are fitted on at most, rounds, seed; rows of a block; most cells (centroids are sent to all tasks).
SAMPLE, ROUNDS, SEED, BLOCK, MOST_CELLS = 20_000, 8, 5, 2048, 4096
#: Allowance for rounding in the bound on distances.
SLACK = 1e-6


def usable(embedding: Column) -> Column:
    """Whether a vector is neither null nor zero and holds numbers only."""
    x = F.coalesce(embedding, F.array().cast("array<float>"))
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return finite & F.exists(x, lambda v: v != 0)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), 5e-324)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def spherical_kmeans(x: np.ndarray, cells: int, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """Unit centroids; an empty cell takes the vector that is furthest from its own centroid."""
    c = x[np.random.default_rng(seed).choice(len(x), min(cells, len(x)), replace=False)].copy()
    for _ in range(rounds):
        cosine = x @ c.T
        home = cosine.argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, home, x)
        empty = np.flatnonzero(np.bincount(home, minlength=len(c)) == 0)
        sums[empty] = x[np.argsort(cosine.max(axis=1), kind="stable")[: len(empty)]]
        flat = np.flatnonzero(~(np.abs(sums).sum(axis=1) > 0))
        sums[flat] = c[flat]
        c = _unit(sums)
    return c


def fit_cells(vectors: DataFrame, count: int, cells: int | None = None, sample: int = SAMPLE) -> np.ndarray:
    """Centroids from at most ``sample`` vectors, those of the least hashes; about sqrt(count / 100) cells."""
    cells = cells or max(1, min(MOST_CELLS, round(math.sqrt(count / 100))))
    share = min(1.0, 0.9 * sample / max(1, count))
    hashed = F.shiftrightunsigned(F.xxhash64("embedding", F.lit("fit")), 11) / F.lit(float(2**53))
    rows = vectors.where(hashed < share).select("embedding").limit(sample).collect()
    x = np.array(sorted(r[0] for r in rows), np.float64)
    return spherical_kmeans(_unit(x), cells) if len(x) else np.zeros((0, 0))


def _assign(centroids: np.ndarray, reach: float):
    apart = np.sqrt(np.maximum(0, 2 - 2 * centroids @ centroids.T))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            cosine = _unit(_matrix(b.column(1), centroids.shape[1])) @ centroids.T
            home = cosine.argmax(axis=1)
            # distance to the plane between two cells: difference of the cosines over the distance of the centroids
            near = cosine[np.arange(len(home)), home][:, None] - cosine <= reach * apart[home]
            near[np.arange(len(home)), home] = True
            row, cell = np.nonzero(near)
            visits = pa.ListArray.from_arrays(pa.array(np.r_[0, near.sum(axis=1).cumsum()], pa.int32()), pa.array(cell, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(home, pa.int32()), visits], ["rep", "embedding", "n", "home", "visits"])

    return run


def _compare(cosine: float, width: int, cells: int):
    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """Rows at home in a block against a block of the cell's members: links of each, and the least row that they lead to here."""
        if not len(left) or not len(right):
            return pd.DataFrame({"rep": left["rep"].iloc[:0], "links": pd.Series(dtype="int64"), "root": left["rep"].iloc[:0]})
        cell = key[0]
        a, b = (_unit(np.stack(list(f["embedding"])).astype(np.float64).reshape(len(f), width)) for f in (left, right))
        mine, other, home = left["rep"].to_numpy(), right["rep"].to_numpy(), right["home"].to_numpy()
        visits = np.zeros((len(left), cells), bool)
        for x, v in enumerate(left["visits"]):
            visits[x, v] = True
        i, j = (np.concatenate(x) for x in zip(*[(lambda p, at: (p[0] + at, p[1]))(np.nonzero(a[at : at + 512] @ b.T >= cosine), at) for at in range(0, len(a), 512)], strict=True))
        # a visitor's pair counts here, unless the row at home here also visits the visitor's home and that is the smaller cell
        use = np.where(home[j] == cell, mine[i] != other[j], (cell < home[j]) | ~visits[i, home[j]])
        i, j = i[use], j[use]
        names, at = np.unique(np.concatenate([mine, other]), return_inverse=True)
        x, y = at[: len(mine)][i], at[len(mine) :][j]
        links = np.bincount(x, right["n"].to_numpy()[j], len(names))
        far = home[j] != cell  # such a link is seen here only, so it is told to both ends
        links += np.bincount(y[far], left["n"].to_numpy()[i[far]], len(names))
        some = np.unique(np.r_[x, y])
        root = names[forest(x, y, np.arange(len(names)))]  # names are sorted, of whatever type
        return pd.DataFrame({"rep": names[some], "links": links[some].astype(np.int64), "root": root[some]})

    return run


def near_duplicates(df: DataFrame, key: str, embedding: str, cosine: float = COSINE, cells: int | None = None) -> DataFrame:
    """``key``, ``n_links`` (other vectors linked directly), ``component_id`` and ``kept`` for each row of ``df``.

    Links: a cosine of ``cosine`` or more, in double precision, between vectors of one width; each width is compared by itself.
    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing.  Equal vectors are compared once, with
    their number.  A row of a null key links with nothing and is kept.  Repeated keys are rows of their own in the counts and one
    node of the components.  Keys are numbers or strings.  An empty table gives no rows; other columns are not read."""
    rows = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{embedding}`").alias("embedding"))
    fits = F.col("key").isNotNull() & usable(F.col("embedding"))
    # -0.0 and 0.0 are the same component
    marked = rows.withColumn("embedding", F.when(fits, F.transform(F.col("embedding"), lambda v: v.cast("double") + F.lit(0.0))))
    width = F.when(fits, F.size("embedding"))
    widths = sorted(w for (w,) in rows.select(width.alias("w")).distinct().collect() if w)  # vectors of one table have few widths
    if len(widths) <= 1:
        found = _of_width(marked, widths[0], cosine, cells) if widths else None
    else:
        marked = materialize(marked, "vectors")
        found = None
        for w in widths:
            one = _of_width(marked.where(F.size("embedding") == w), w, cosine, cells)
            found = one if found is None else found.unionAll(one)
    if found is None:
        out = rows.select("key", F.lit(0).cast("long").alias("l"), F.lit(None).cast(rows.schema["key"].dataType).alias("c"))
    elif len(widths) > 1:  # a key that comes with several widths joins their components
        edges = materialize(found, "found")
        own = marked.where("embedding IS NOT NULL").join(edges, "embedding").select(F.col("key").alias("a"), F.col("c").alias("b"))
        joined = components(own, "a", "b")
        out = marked.join(edges, "embedding", "left").join(joined, F.col("key") == F.col("node"), "left").select("key", "l", F.coalesce("component", F.col("c")).alias("c"))
    else:
        out = marked.join(found, "embedding", "left")
    component = F.coalesce("c", "key")
    return out.select(F.col("key").alias(key), F.coalesce("l", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("key") == component, F.lit(True)).alias("kept"))


def _of_width(marked: DataFrame, width: int, cosine: float, cells: int | None) -> DataFrame:
    """``embedding``, its component ``c`` and its links ``l``, for the vectors of ``marked`` that are not null, all of one width."""
    distinct = materialize(marked.where("embedding IS NOT NULL").groupBy("embedding").agg(F.min("key").alias("rep"), F.count("*").alias("n")), "vectors")
    count = distinct.count()
    centroids = fit_cells(distinct, count, cells)
    reach = math.sqrt(max(0.0, 2 - 2 * cosine)) / 2 + SLACK
    parts = max(1, min(4096, count // 256))
    name = marked.schema["key"].dataType
    schema = T.StructType().add("rep", name).add("embedding", T.ArrayType(T.DoubleType())).add("n", "long").add("home", T.IntegerType()).add("visits", T.ArrayType(T.IntegerType()))
    placed = materialize(distinct.select("rep", "embedding", "n").repartition(parts, "rep").mapInArrow(frugal(_assign(centroids, reach)), schema), "placed")
    seat = F.pmod(F.xxhash64("rep", F.lit("seat")), F.lit(1 << 30))
    homes = {r["home"]: r["n"] for r in placed.groupBy("home").agg(F.count("*").alias("n")).collect()}  # MOST_CELLS rows at most
    members = {r["c"]: r["n"] for r in placed.select(F.explode("visits").alias("c")).groupBy("c").agg(F.count("*").alias("n")).collect()}
    blocks = lambda sizes: F.element_at(F.create_map(*[F.lit(int(x)) for c in sorted(members) for x in (c, -(-sizes.get(c, 0) // BLOCK) or 1)]), F.col("cell"))
    left = placed.select("rep", "embedding", "n", "visits", F.col("home").alias("cell"))
    left = left.withColumn("hb", F.pmod(seat, blocks(homes)).cast("int")).withColumn("mb", F.explode(F.sequence(F.lit(0), blocks(members) - 1)))
    right = placed.select("rep", "embedding", "n", "home", F.explode("visits").alias("cell"))
    right = right.withColumn("mb", F.pmod(seat, blocks(members)).cast("int")).withColumn("hb", F.explode(F.sequence(F.lit(0), blocks(homes) - 1)))
    keys = ["cell", "hb", "mb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_compare(cosine, width, len(centroids)), T.StructType().add("rep", name).add("links", "long").add("root", name))
    linked = materialize(found, "links")
    totals = linked.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(linked.select(F.col("rep").alias("a"), F.col("root").alias("b")), "a", "b")
    both = distinct.join(totals, "rep", "left").join(joined, F.col("rep") == F.col("node"), "left")
    return materialize(both.select("embedding", F.coalesce("component", "rep").alias("c"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("l")), "named")
