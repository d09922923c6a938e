"""SimHash near-duplicates with a Gray-order hierarchical index.

Fingerprints that differ in at most ``BITS`` bits are linked.  Equal fingerprints are one entry of
the index.  Its upper nodes are masked bit patterns: the 64 bits are cut into BITS + 1 blocks, of
which two linked fingerprints share one whole, so each fingerprint goes to the nodes of its blocks,
which share their masked bits with accumulated difference 0.  A node of more than ``NODE`` entries
is cut again by blocks of its remaining bits, and so on; 45 shared bits leave 2^19 entries at most.
Within a node, entries stand in order of their Gray rank, neighbours share most bits, and groups of
``FAN`` are factored, level by level, into the bits that all share (mask) and their values (pattern).
Pairs of groups are pruned whole once their shared bits differ in more than BITS places.  A node
gives a spanning forest of its links, not its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow import frugal
from .components import components, forest
from .store import materialize, write

SHINGLE, SEED, BITS = 3, 42, 2
NODE, FAN = 512, 8
#: Pairs of entries that nodes processed together have at most, unless one node has more.
PAIRS = 1 << 21


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64-bit SimHash of word shingles, repeats included; A-Z are lower-cased; no words: 0."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    ends = ends.tolist()
    starts = [0, *[e + 1 for e in ends[:-1]]]
    last = ends[shingle - 1 :] or ends[-1:]
    ones, n, hashed = np.zeros(64, np.int64), len(last), xxhash.xxh64_intdigest
    for at in range(0, n, 1 << 14):
        h = np.array([hashed(line[a:b], seed) for a, b in zip(starts[at : at + (1 << 14)], last[at : at + (1 << 14)], strict=False)], np.uint64)
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, key: str, text: str, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``key`` and ``fp``, the fingerprint as a signed long, for each row.  No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = np.array([fingerprint(t.as_py(), shingle, seed) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.int64())], [key, "fp"])

    return df.select(f"`{key}`", f"`{text}`").mapInArrow(frugal(run), df.select(f"`{key}`").schema.add("fp", "long"))


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray order."""
    fp = fp.copy()
    for k in (1, 2, 4, 8, 16, 32):
        fp ^= fp >> np.uint64(k)
    return fp


def _levels(fp: np.ndarray, node: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """From entries to one root for each node: pattern, mask, and where each group's children begin in the level below."""
    low, high, owner = fp, fp, node
    out = [(fp, np.full(len(fp), ~np.uint64(0)), np.arange(len(fp) + 1))]
    while len(owner) > 1 and (owner[1:] == owner[:-1]).any():
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        place = np.arange(len(owner)) - np.repeat(first, np.diff(np.r_[first, len(owner)]))
        begin = np.flatnonzero(place % FAN == 0)
        low, high, owner = np.bitwise_and.reduceat(low, begin), np.bitwise_or.reduceat(high, begin), owner[begin]
        out.append((low, ~(low ^ high), np.r_[begin, len(place)]))
    return out


def linked_pairs(fp: np.ndarray, node: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j of one node whose codes differ in at most ``bits``; ``node`` is sorted, codes in Gray order within each."""
    levels = _levels(fp, node)
    i = j = np.arange(len(levels[-1][0]))
    for (_, _, begin), (pattern, mask, _) in zip(levels[:0:-1], levels[-2::-1], strict=True):
        ni, nj = begin[i + 1] - begin[i], begin[j + 1] - begin[j]
        each = np.repeat(np.arange(len(i)), ni * nj)
        k = np.arange(len(each)) - np.repeat(np.cumsum(ni * nj) - ni * nj, ni * nj)
        a, b = begin[i][each] + k // nj[each], begin[j][each] + k % nj[each]
        near = (a <= b) & (np.bitwise_count((pattern[a] ^ pattern[b]) & mask[a] & mask[b]) <= bits)
        i, j = a[near], b[near]
    return i[i < j], j[i < j]


def _link_nodes(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(mask, value, fp, rep):  # noqa: ANN001
            edge = np.flatnonzero(np.r_[True, (mask[1:] != mask[:-1]) | (value[1:] != value[:-1]), True])
            sizes = np.diff(edge)
            cost, node = np.cumsum(sizes.astype(np.int64) ** 2), np.repeat(np.arange(len(sizes)), sizes)
            at = 0
            while at < len(sizes):
                end = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + PAIRS, "right")))
                part = slice(edge[at], edge[end])
                f = fp[part].view(np.uint64)
                order = np.lexsort((gray_rank(f), node[part]))
                f, r = f[order], rep[part][order]
                i, j = linked_pairs(f, node[part][order], bits)
                root = forest(i, j, r)
                if (far := root != r).any():
                    yield pa.RecordBatch.from_arrays([pa.array(r[far]), pa.array(root[far])], ["a", "b"])
                at = end

        kept = None
        for b in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if not len(columns[0]):
                continue
            if kept:
                columns = [np.concatenate(x) for x in zip(kept, columns, strict=True)]
            mask, value = columns[:2]
            whole = int(np.flatnonzero((mask != mask[-1]) | (value != value[-1]))[-1]) + 1 if (mask[0], value[0]) != (mask[-1], value[-1]) else 0
            if whole:
                yield from flush(*[c[:whole] for c in columns])
            kept = [c[whole:] for c in columns]
        if kept:
            yield from flush(*kept)

    return run


def _blocks(mask: int, parts: int) -> list[int]:
    """The bits outside ``mask``, cut into ``parts`` runs, each with the bits of ``mask``."""
    free = [k for k in range(64) if not mask >> k & 1]
    cuts = [len(free) * p // parts for p in range(parts + 1)]
    return [mask | sum(1 << k for k in free[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def link(reps: DataFrame, bits: int = BITS, node: int = NODE) -> DataFrame:
    """Edges ``a``, ``b`` between names ``rep`` of distinct codes ``fp``, which join all that links join."""
    schema = reps.select(F.col("rep").alias("a"), F.col("rep").alias("b")).schema
    masks, entries, edges = [0], reps.select(F.lit(0).cast("long").alias("mask"), "fp", "rep"), None
    while masks:
        below = {m: _blocks(m, bits + 1) for m in masks}
        masks = sorted({x for xs in below.values() for x in xs})
        pick: Column = F.create_map(*[x for m, xs in below.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(x)) for x in xs]))])
        placed = entries.select(F.explode(F.element_at(pick, F.col("mask"))).alias("mask"), "fp", "rep").withColumn("value", F.col("fp").bitwiseAND(F.col("mask")))
        counts = write(placed.groupBy("mask", "value").agg(F.count("*").alias("n")).where("n > 1"), "nodes").df
        small = placed.join(counts.where(F.col("n") <= node), ["mask", "value"]).select("mask", "value", "fp", "rep")
        # by a hash, as Spark leaves out a shuffle by columns that a join below is dealt by, and may split that one
        found = small.repartition(F.xxhash64("mask", "value")).sortWithinPartitions("mask", "value").mapInArrow(frugal(_link_nodes(bits)), schema)
        edges = found if edges is None else edges.unionAll(found)
        hot = counts.where(F.col("n") > node)
        masks = [m & ((1 << 64) - 1) for (m,) in hot.select("mask").distinct().collect()]  # a few, from a fixed tree of masks
        if masks:
            entries = materialize(placed.join(hot, ["mask", "value"]).select("mask", "fp", "rep"), "hot-nodes")
    return edges


def near_duplicates(df: DataFrame, key: str, text: str, bits: int = BITS) -> DataFrame:
    """``key``, ``fp`` and ``component`` for each row of ``df``: the smallest key that links lead to.

    Null and wordless texts have fingerprint 0 and link like any other.  Rows of one key are one
    document.  A null key links with nothing: its component is null.  Repeated rows stay.  An empty
    table gives no rows; other columns are not read."""
    marked = materialize(fingerprints(df, key, text).withColumnRenamed(key, "key"), "fingerprints")
    return joined(marked, lambda reps: link(reps, bits)).withColumnRenamed("key", key)


def joined(marked: DataFrame, link: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Components of ``key`` by ``fp``: equal ones are linked, and those that ``link`` gives edges for."""
    known = marked.where(F.col("key").isNotNull())
    reps = materialize(known.groupBy("fp").agg(F.min("key").alias("rep")), "reps")
    # a key that comes with several texts joins their fingerprints
    same = known.groupBy("key").agg(F.min("fp").alias("x"), F.max("fp").alias("y")).where("x != y")
    own = known.join(same.select("key"), "key").join(reps, "fp").select(F.col("key").alias("a"), F.col("rep").alias("b"))
    parts = components(link(reps).unionAll(own), "a", "b")
    named = materialize(reps.join(parts, F.col("rep") == F.col("node"), "left").select("fp", F.coalesce("component", "rep").alias("component")), "named")
    return marked.join(named, "fp", "left").select("key", "fp", F.when(F.col("key").isNotNull(), F.col("component")).alias("component"))


def keep_one(df: DataFrame, key: str, text: str, bits: int = BITS, found: DataFrame | None = None) -> DataFrame:
    """The rows of ``df`` whose key is that of their component, one for each; rows of a null key stay.

    All columns of ``df`` are kept.  Of several rows with the kept key one stays, the first by text.
    ``found``: components in place of those of ``near_duplicates``."""
    found = near_duplicates(df, key, text, bits) if found is None else found
    kept = materialize(found.where(F.col(key) == F.col("component")).groupBy(key).agg(F.count("*").alias("__n")).withColumnRenamed(key, "__key"), "kept")
    # a merge join at every size: what is kept grows with the input
    rows = df.join(kept.hint("merge"), F.col(f"`{key}`") == F.col("__key"))
    once = rows.where("__n = 1").drop("__key", "__n")
    many = rows.where("__n > 1")
    from pyspark.sql import Window as W

    first = many.withColumn("__i", F.row_number().over(W.partitionBy("__key").orderBy(F.col(f"`{text}`")))).where("__i = 1").drop("__key", "__n", "__i")
    return once.unionAll(first).unionAll(df.where(F.col(f"`{key}`").isNull()))
