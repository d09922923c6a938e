"""Near copies by SimHash fingerprints of word shingles, checked by exact Jaccard similarity.

Texts of one set of shingles are one entry.  64 bits can't tell a similarity of 0.8 from chance within a few bits, so
the fingerprint of an entry has ``WORDS`` x 64 bits: a pair of similarity s differs in each with a
probability of acos(2s / (1 + s)) / pi, 0.15 at 0.8.  The Gray-order index of ``simhash`` finds candidates:

1. *Upper nodes* are masked bit patterns: runs of bits that entries share whole.  Each entry goes to the nodes of its runs, which
   are wider, and more, the more entries there are, so that nodes stay small and a pair of similarity 0.8 shares
   a node with a probability of ``RECALL`` at every size.
2. *Within a node* entries stand in Gray order of other bits (the sketch), groups are factored into masks and patterns, and pairs of groups
   are pruned whole by accumulated differences, as in ``simhash.linked_pairs``.
3. *Candidates* are pairs of a node whose whole fingerprints are close enough.  Groups of more than ``FEW`` in a node are not paired: each row
   of theirs goes with the one of the least name that is close.
4. Candidates are compared by whole sets of shingles: only pairs of similarity 0.8 or more are links.
5. *Crowds*, which are what candidates connect, if of more than ``FEW`` entries, may be left in several parts by that.  Each row outside of the
   largest part is compared with its closest one there, and at last with all close ones of other parts, in blocks
   of rows against blocks of rows, so that no task holds a crowd.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import frugal
from .components import components, forest
from .simhash import gray_rank, joined, linked_pairs
from .store import materialize

SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
#: Words of a fingerprint that nodes are made of, and of its sketch.
WORDS, SKETCH = 16, 2
#: Probability that a pair of the least similarity shares a node; entries that a node has by chance, as a power of 2; bits of a node at least.
RECALL, CROWD, LEAST_BITS = 0.99, 8, 16
#: Candidates of a node that are paired at most; entries of a node that are compared at once; rounds of stars.
FEW, BLOCK, ROUNDS = 8, 1024, 1
#: Rows of a node that one task takes, if leaders in so many rounds are close to the others.
HOT, PEELS = 1 << 16, 16
#: Standard deviations that the differing bits of candidates may be above the mean of the least similarity.
SPREAD = 3.2
#: Pairs of entries that nodes processed together have at most, unless one node has more.
PAIRS = 1 << 20
_TIMES = np.random.default_rng(9).integers(0, 1 << 63, WORDS + SKETCH, np.uint64) | np.uint64(1)


def shingles(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """Sorted hashes of the distinct word shingles; words are those of ``simhash.fingerprint``.  Fewer words are one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line, ends = b" ".join(words), (np.cumsum([len(w) + 1 for w in words]) - 1).tolist()
    starts, last, hashed = [0, *[e + 1 for e in ends[:-1]]], ends[shingle - 1 :] or ends[-1:], xxhash.xxh64_intdigest
    return np.unique(np.fromiter((hashed(line[a:b], seed) for a, b in zip(starts, last, strict=False)), np.uint64, len(last)))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of sorted distinct hashes; two empty sets are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def _named(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), SEED)


def fingerprint(found: np.ndarray) -> np.ndarray:
    """``WORDS + SKETCH`` words: a bit is 1 if set in over half of the hashes that follow from each shingle's; 0 for no shingles."""
    ones = np.zeros(64 * len(_TIMES), np.int64)
    for at in range(0, len(found), 255):
        h = found[at : at + 255, None] * _TIMES
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        ones += np.unpackbits(h.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(found), bitorder="little").view(np.uint64)


def differing(similarity: float) -> float:
    """Share of bits in which fingerprints of two sets of one size differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def most_bits(similarity: float, words: int) -> int:
    """Bits in which candidates differ at most."""
    p, n = differing(similarity), 64 * words
    return int(n * p + SPREAD * math.sqrt(n * p * (1 - p)))


def node_shape(entries: int, similarity: float = SIMILARITY) -> tuple[int, int]:
    """Bits of a node and number of nodes of an entry."""
    bits = max(LEAST_BITS, math.ceil(math.log2(max(2, entries))) - CROWD)
    return bits, math.ceil(math.log(1 - RECALL) / math.log(1 - (1 - differing(similarity)) ** bits))


def nodes(code: np.ndarray, bits: int, count: int) -> np.ndarray:
    """Names of the nodes of codes (a row each): runs of ``bits`` bits that begin at even distances, with their place."""
    flat = np.unpackbits(np.ascontiguousarray(code[:, :WORDS]).view(np.uint8), axis=1, bitorder="little")
    first = np.arange(count) * 64 * WORDS // count
    runs = flat[:, (first[:, None] + np.arange(bits)) % (64 * WORDS)]
    return (np.arange(count) << 40) + runs @ (1 << np.arange(bits, dtype=np.int64))


def _marked(df: DataFrame, key: str, text: str, shingle: int) -> DataFrame:
    """``key``, ``fp``, the hash of the set, and ``code``, its fingerprint; null for no shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, codes = [], []
            for t in b.column(1):
                found = shingles(t.as_py(), shingle)
                fp.append(_named(found))
                codes.append(fingerprint(found).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(fp, np.uint64).view(np.int64)), pa.array(codes, pa.binary())], ["key", "fp", "code"])

    kind = df.select(F.col(f"`{key}`").alias("key")).schema.add("fp", "long").add("code", "binary")
    return df.select(f"`{key}`", f"`{text}`").mapInArrow(frugal(run), kind)


def _codes(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, WORDS + SKETCH)


def _placed(entries: DataFrame, bits: int, count: int) -> DataFrame:
    """``node``, ``fp`` and the sketch: a row for each node of each entry (fp, code)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                code = _codes(part.column(1))
                made = [nodes(code, bits, count).ravel(), np.repeat(part.column(0).to_numpy(), count), *[np.repeat(code[:, WORDS + k].view(np.int64), count) for k in range(SKETCH)]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], ["node", "fp", "s0", "s1"])

    return entries.select("fp", "code").mapInArrow(frugal(run), "node long, fp long, s0 long, s1 long")


def _crowded(fp: np.ndarray, sketch: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars of a node too large for pairs: leaders take the rows that are close to them, what is left is compared in blocks with the first that is close."""
    order = np.argsort(fp)
    left, x, y = order, [], []
    close = lambda a, b: np.bitwise_count(sketch[a][:, None] ^ sketch[b][None, :]).sum(axis=2, dtype=np.int64) <= most
    for _ in range(32):
        if len(left) < 2:
            break
        near = close(left[:1], left)[0]
        near[0] = False
        x.append(np.repeat(left[0], near.sum()))
        y.append(left[near])
        left = left[1:][~near[1:]]
    for at in range(0, len(left), BLOCK):
        mine = left[at : at + BLOCK]
        for other in range(0, at + 1, BLOCK):
            i, j = np.nonzero(close(left[other : other + BLOCK], mine))
            i, j = left[other : other + BLOCK][i], mine[j]
            keep = fp[i] < fp[j]
            i, j = i[keep], j[keep]
            first = np.unique(j, return_index=True)[1]
            x.append(i[first])
            y.append(j[first])
    return np.concatenate([np.zeros(0, np.int64), *x]), np.concatenate([np.zeros(0, np.int64), *y])


def _candidates(similarity: float):
    """Rows ``x``, ``y``, ``star``: pairs that are close by their sketches, and whether they are part of a larger group's star."""
    half, most = most_bits(similarity, 1), most_bits(similarity, SKETCH)

    def flush(node: np.ndarray, fp: np.ndarray, sketch: np.ndarray) -> pa.RecordBatch:
        edge = np.flatnonzero(np.r_[True, node[1:] != node[:-1], True])
        sizes = np.diff(edge)
        out: list[tuple[np.ndarray, np.ndarray, bool]] = []
        for k in np.flatnonzero(sizes > BLOCK):
            part = slice(edge[k], edge[k + 1])
            i, j = _crowded(fp[part], sketch[part], most)
            out.append((fp[part][i], fp[part][j], True))
        small = np.repeat((sizes > 1) & (sizes <= BLOCK), sizes)
        node, fp, sketch = node[small], fp[small], sketch[small]
        if len(node):
            order = np.lexsort((gray_rank(sketch[:, 0].copy()), node))
            node, fp, sketch = node[order], fp[order], sketch[order]
            i, j = linked_pairs(np.ascontiguousarray(sketch[:, 0]), node, half)
            near = np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=1, dtype=np.int64) <= most
            i, j = i[near], j[near]
            root = forest(i, j, np.arange(len(node)))
            many = np.bincount(root, minlength=len(node))[root] > FEW
            pair = ~many[i]
            out.append((fp[i[pair]], fp[j[pair]], False))
            if many.any():
                # in groups, each row's candidate of the least name
                a, b = np.r_[i[~pair], j[~pair]], np.r_[j[~pair], i[~pair]]
                by = np.lexsort((fp[a], b))
                a, b = a[by], b[by]
                first = np.r_[True, b[1:] != b[:-1]]
                a, b = a[first], b[first]
                out.append((fp[a], fp[b], True))
        none = np.zeros(0, np.int64)
        x, y = (np.concatenate([none, *[o[k] for o in out]]) for k in (0, 1))
        star = np.repeat([o[2] for o in out], [len(o[0]) for o in out]).astype(bool) if out else np.zeros(0, bool)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(star)], ["x", "y", "star"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for b in batches:
            if not b.num_rows:
                continue
            now = [c.to_numpy() for c in b.columns]
            if kept:
                now = [np.concatenate(x) for x in zip(kept, now, strict=True)]
            edge = np.flatnonzero(np.r_[True, now[0][1:] != now[0][:-1]])
            cost = np.cumsum(np.diff(np.r_[edge, len(now[0])]).astype(np.int64) ** 2)
            at = 0
            while at < len(edge) - 1:  # the last node may go on
                end = min(len(edge) - 1, max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + PAIRS, "right"))))
                part = slice(edge[at], edge[end])
                yield flush(now[0][part], now[1][part], np.stack([now[2][part], now[3][part]], axis=1).view(np.uint64))
                at = end
            kept = [x[edge[-1] :].copy() for x in now]
        if kept:
            yield flush(kept[0], kept[1], np.stack(kept[2:], axis=1).view(np.uint64))

    return run


def _peeled(placed: DataFrame, most: int) -> tuple[DataFrame, DataFrame | None]:
    """``placed`` without the rows that lead nodes of more than ``HOT`` rows, or are close to a leader, and stars of these (x, y, star).

    The leader is the row of the least name, as in ``_crowded``; each round is a partial aggregate and a join that Spark can split, so a
    task gets what is left of a node, which is more than ``HOT`` only if ``PEELS`` leaders are close to too few."""
    hot = lambda rows: materialize(rows.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") > HOT).select("node"), "hot")
    large = hot(placed)
    if large.isEmpty():
        return placed, None
    done, stars = [placed.join(large, "node", "left_anti").select(*placed.columns)], []
    rows = materialize(placed.join(large, "node"), "large")
    for _ in range(PEELS):
        leaders = materialize(rows.join(large, "node").groupBy("node").agg(F.min(F.struct("fp", "s0", "s1")).alias("lead")), "leaders")
        done.append(rows.join(large, "node", "left_anti").select(*placed.columns))
        away = F.bit_count(F.col("s0").bitwiseXOR(F.col("lead.s0"))) + F.bit_count(F.col("s1").bitwiseXOR(F.col("lead.s1")))
        led = materialize(rows.join(leaders, "node").withColumn("near", away <= most), "led")
        stars.append(led.where("near AND fp != lead.fp").select(F.col("lead.fp").alias("x"), F.col("fp").alias("y"), F.lit(True).alias("star")))
        rows = led.where("NOT near").select(*placed.columns)
        large = hot(rows)
        if large.isEmpty():
            break
    return reduce(DataFrame.unionAll, [*done, rows.select(*placed.columns)]), reduce(DataFrame.unionAll, stars)


def _close(pairs: DataFrame, entries: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs whose whole fingerprints are close."""
    most = most_bits(similarity, WORDS + SKETCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            away = np.bitwise_count(_codes(b.column(2)) ^ _codes(b.column(3))).sum(axis=1, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(b.columns[:2], ["x", "y"]).filter(pa.array(away <= most))

    one, two = (entries.select(F.col("fp").alias(n), F.col("code").alias(f"{n}_code")) for n in ("x", "y"))
    return pairs.join(one, "x").join(two, "y").select("x", "y", "x_code", "y_code").mapInArrow(frugal(run), "x long, y long")


def _between(similarity: float, last: bool):
    """Of blocks (crowd, rb, ob), sorted by those: ``mine``, rows outside of a crowd's largest part, against others: ``x``, ``y`` and their differing bits.

    Each row with the closest one of the block; ``last``: with all that are close and of another part."""
    most = most_bits(similarity, WORDS + SKETCH)

    def pairs(g: np.ndarray, fp: np.ndarray, code: np.ndarray, mine: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rest, there = np.flatnonzero(mine), np.flatnonzero(~mine)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for at in range(0, len(rest) if len(there) else 0, 256):
            here = rest[at : at + 256]
            away = np.zeros((len(here), len(there)), np.int64)
            for w in range(code.shape[1]):
                away += np.bitwise_count(code[here, w][:, None] ^ code[there, w][None, :])
            if last:
                i, j = np.nonzero((away <= most) & (g[here][:, None] != g[there][None, :]))
            else:
                j = away.argmin(axis=1)
                i = np.flatnonzero(away[np.arange(len(here)), j] <= most)
                j = j[i]
            found.append((fp[here[i]], fp[there[j]], away[i, j]))
        return tuple(np.concatenate([np.zeros(0, np.int64), *[f[k] for f in found]]) for k in range(3))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ..operators.groups import whole_groups

        for t, begin in whole_groups(batches, ["crowd", "rb", "ob"]):
            g, fp, code, mine = t["g"].to_numpy(), t["fp"].to_numpy(), _codes(t["code"]), t["mine"].to_numpy(zero_copy_only=False).astype(bool)
            for a, b in zip(begin, begin[1:], strict=False):
                made = pairs(g[a:b], fp[a:b], code[a:b], mine[a:b])
                if len(made[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(m) for m in made], ["x", "y", "away"])

    return run


def _reunited(parts: DataFrame, similarity: float, last: bool) -> DataFrame:
    """Pairs ``x``, ``y`` that may join the parts (crowd, g, fp, code, of; ``of``: the largest part, its rows and the others') of crowds.

    Rows meet in blocks of ``BLOCK`` on either side, so no task holds a crowd."""
    seat = F.xxhash64("fp", F.lit("seat"))
    blocks = lambda n: F.greatest(F.ceil(n / BLOCK), F.lit(1)).cast("int")
    outside = F.col("g") != F.col("of.main")
    rbs, obs = blocks(F.col("of.outside")), blocks(F.col("of.outside") + F.col("of.inside") if last else F.col("of.inside"))
    left = parts.where(outside).withColumn("rb", F.pmod(seat, rbs).cast("int")).withColumn("ob", F.explode(F.sequence(F.lit(0), obs - 1))).withColumn("mine", F.lit(True))
    right = parts if last else parts.where(~outside)
    right = right.withColumn("ob", F.pmod(seat, obs).cast("int")).withColumn("rb", F.explode(F.sequence(F.lit(0), rbs - 1))).withColumn("mine", F.lit(False))
    keys = ["crowd", "rb", "ob"]
    # by a hash, as Spark leaves out a shuffle by a column that a join below is dealt by
    dealt = left.unionByName(right).drop("of").repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys)
    met = dealt.mapInArrow(frugal(_between(similarity, last)), "x long, y long, away long")
    if not last:
        met = met.groupBy("x").agg(F.min(F.struct("away", "y")).alias("to")).select("x", F.col("to.y").alias("y"))
    return met.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def _sets(df: DataFrame, shingle: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py(), shingle) for t in b.column(0)]
            fp = np.array([_named(s) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(fp), pa.array([s.tobytes() for s in sets], pa.binary())], ["fp", "hashes"])

    return df.mapInArrow(frugal(run), "fp long, hashes binary")


def _alike(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs ``x``, ``y`` whose sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [jaccard(np.frombuffer(p.as_py(), np.uint64), np.frombuffer(q.as_py(), np.uint64)) >= similarity for p, q in zip(b.column(2), b.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays(b.columns[:2], ["x", "y"]).filter(pa.array(keep, pa.bool_()))

    one, two = (sets.select(F.col("fp").alias(n), F.col("hashes").alias(f"{n}_hashes")) for n in ("x", "y"))
    return pairs.join(one, "x").join(two, "y").select("x", "y", "x_hashes", "y_hashes").mapInArrow(frugal(run), "x long, y long")


def near_copies(df: DataFrame, key: str, text: str, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """``key``, ``fp`` and ``component`` for each row of ``df``: the smallest key that pairs of similar texts lead to.

    Null and wordless texts are equal.  Rows of one key are one document.  A null key is alone: its component is null.
    An empty table gives no rows; other columns are not read.  Of pairs of similarity 0.8 a share of ``RECALL`` is found, of more similar ones more."""
    marked = materialize(_marked(df, key, text, shingle), "shingles")
    entries = materialize(marked.where("key IS NOT NULL AND code IS NOT NULL").groupBy("fp", "code").agg(F.min("key").alias("key")), "entries")
    bits, count = node_shape(entries.count(), similarity)
    placed, stars = _peeled(_placed(entries, bits, count), most_bits(similarity, SKETCH))
    made = placed.repartition("node").sortWithinPartitions("node").mapInArrow(frugal(_candidates(similarity)), "x long, y long, star boolean")
    made = made.unionAll(stars) if stars else made
    found = materialize(made.groupBy("x", "y").agg(F.min("star").alias("star")), "candidates")
    # of the stars of many nodes two edges an entry are compared at first; crowds are what all edges connect, so none is lost
    stars = found.where("star")
    one, two = stars.groupBy("y").agg(F.min("x").alias("x")).select("x", "y"), stars.groupBy("x").agg(F.min("y").alias("y"))
    pairs = materialize(_close(found.where("NOT star").select("x", "y").unionAll(one).unionAll(two).distinct(), entries, similarity), "pairs")
    wanted = materialize(found.select(F.col("x").alias("fp")).unionAll(found.select("y")).distinct(), "wanted")
    source = entries.join(wanted, "fp").select(F.col("key").alias("__key")).distinct()
    # a merge join at every size: texts
    texts = df.select(F.col(f"`{key}`").alias("__own"), F.col(f"`{text}`").alias("__text")).join(source.hint("merge"), F.col("__own") == F.col("__key")).select("__text")
    sets = materialize(_sets(texts, shingle).dropDuplicates(["fp"]), "sets")
    links = materialize(_alike(pairs, sets, similarity), "alike")
    within = components(found, "x", "y")
    placed = wanted.join(within, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("crowd"))
    large = placed.groupBy("crowd").agg(F.count("*").alias("n")).where(F.col("n") > FEW).select("crowd")
    crowds = materialize(placed.join(large, "crowd").join(entries.select("fp", "code"), "fp").select("crowd", "fp", "code"), "crowds")
    for round_ in range(0 if crowds.isEmpty() else ROUNDS + 1):
        group = components(links, "x", "y")
        parts = crowds.join(group, F.col("fp") == F.col("node"), "left").select("crowd", F.coalesce("component", "fp").alias("g"), "fp", "code")
        sizes = parts.groupBy("crowd", "g").agg(F.count("*").alias("n")).groupBy("crowd").agg(F.max(F.struct("n", "g")).alias("top"), F.sum("n").alias("all"), F.count("*").alias("parts"))
        of = F.struct(F.col("top.g").alias("main"), F.col("top.n").alias("inside"), (F.col("all") - F.col("top.n")).alias("outside")).alias("of")
        parts = materialize(parts.join(sizes.where("parts > 1").select("crowd", of), "crowd"), "parts")
        if parts.isEmpty():
            break
        more = _reunited(parts, similarity, round_ == ROUNDS).join(pairs, ["x", "y"], "left_anti")
        links = materialize(links.unionAll(_alike(materialize(more, "pairs"), sets, similarity)).distinct(), "alike")

    def link(reps: DataFrame) -> DataFrame:
        a, b = (reps.select(F.col("fp").alias(n), F.col("rep").alias(m)) for n, m in (("x", "a"), ("y", "b")))
        return links.join(a, "x").join(b, "y").select("a", "b")

    return joined(marked.select("key", "fp"), link).withColumnRenamed("key", key)
