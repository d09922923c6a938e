"""Removal of long passages that repeat, by external induced sorting of suffixes.

A byte goes if a string of ``MATCH`` bytes that covers it also starts anywhere else.  So the sorted
order of suffixes is wanted, with the common prefix of neighbours, where that may reach MATCH bytes.

1. *Samples.*  Of each run of MATCH bytes the GRAM-byte string of the least hash is sampled, the leftmost of equal ones (winnowing), which
   depends on the run's bytes alone.  A run, called a window below, is induced from its own sample.
   Windows of one sample are a gap: their bytes, hashed, are its class.
2. *Names.*  Samples are counted by name.  A window of an unrepeated sample can't repeat and is done with.
   Nor need a sample be sorted of which all gaps are of one class: they are copies.
3. *Sorting.*  The gaps of other samples are sent with their bytes, a gap a class, in order of samples by Spark's external
   sort, which spills to disk.  The suffixes that begin at one sample are sorted, with common prefixes.
4. *Induction.*  The suffixes one byte further to the left are in the order of (that byte, order of the suffix after
   it), a stable bucket sort of the order so far; a common prefix is 1 more than the least on the way
   between two suffixes.  This carries order and prefixes from the samples to all windows.
   A window repeats if the common prefix with a neighbour reaches MATCH.
5. *Recursion.*  A sample of more than ``CLASSES`` classes is split by the distance of windows from it into ``SPLIT``
   ranges, whose shared bytes are a longer sample, and gaps are named anew.  A range of one window is of one class.

Hashes have 64 bits; a class is told by 64 bits more within its sample.  Equal texts are one text (``rid``, 128 bits): they repeat wholly.
Spans are made distinct before they are gathered, so that n copies of a text cost n times one copy.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import frugal
from .columns import packed, passing, unpacked
from .store import materialize

MATCH, GRAM = 200, 64
CLASSES, SPLIT = 512, 8
#: Bytes of texts that are hashed together, rows that suffixes are induced for together, bytes of texts in a batch of results.
SLAB, ROWS, OUT_BYTES = 1 << 17, 16_384, 1 << 23

_rng = np.random.default_rng(20)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


class Hasher:
    """Hashes of substrings of a slab: sums of random numbers of bytes times powers of an odd base, modulo 2^64."""

    def __init__(self, most: int):
        powers = lambda b: np.multiply.accumulate(np.r_[np.uint64(1), np.full(most, b, np.uint64)])
        self.up, self.down = powers(np.uint64(_BASE)), powers(np.uint64(pow(_BASE, -1, 2**64)))

    def load(self, data: bytes) -> None:
        s = np.frombuffer(data, np.uint8)
        self.sums = np.zeros(len(s) + 1, np.uint64)
        np.cumsum(_BYTE[s] * self.up[: len(s)], out=self.sums[1:])

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        x = (self.sums[b] - self.sums[a]) * self.down[a] + (b - a).astype(np.uint64) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))

    def grams(self, size: int) -> np.ndarray:
        a = np.arange(max(0, len(self.sums) - size))
        return self(a, a + size)


def _sliding(a: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Least or greatest of each ``width`` neighbours, from running ones of blocks in both directions."""
    f, fill = (np.minimum, ~np.uint64(0)) if least else (np.maximum, np.uint64(0))
    padded = np.full(-(-len(a) // width) * width, fill)
    padded[: len(a)] = a
    blocks, n = padded.reshape(-1, width), len(a) - width + 1
    return f(f.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()[:n], f.accumulate(blocks, axis=1).ravel()[width - 1 : width - 1 + n])


def gaps(hasher: Hasher, data: bytes, first: np.ndarray, last: np.ndarray, wanted: list[tuple[int, int]], match: int, gram: int) -> tuple[np.ndarray, ...]:
    """Gaps of the windows that begin in the wanted ranges: name of the sample, class, begin, number of windows, sample's place.

    ``first``, ``last``: where the texts in ``data`` begin and end; windows stay within them."""
    hasher.load(data)
    h, width = hasher.grams(gram), match - gram + 1
    inside = np.zeros(len(data), bool)
    for a, b in zip(first, last, strict=True):
        inside[a : max(a, b - match + 1)] = True
    if len(h) < width or not inside.any():
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
    least = _sliding(h, width, True)
    least[~inside[: len(least)]] = 0
    edge = np.zeros(width - 1, np.uint64)
    sampled = np.flatnonzero(_sliding(np.r_[edge, least, edge], width, False)[: len(h)] == h)
    asked = np.zeros(len(data), bool)
    for a, b in wanted:
        asked[a:b] = True
    p = np.flatnonzero(inside & asked)
    # a window's sample is the leftmost of its least grams: which other grams are sampled also depends on bytes outside of it
    at, open_ = np.searchsorted(sampled, p), np.arange(len(p))
    while len(open_):
        open_ = open_[h[sampled[at[open_]]] != least[p[open_]]]
        at[open_] += 1
    q = sampled[at]
    begin = np.flatnonzero(np.r_[True, (q[1:] != q[:-1]) | (p[1:] != p[:-1] + 1)]) if len(p) else np.zeros(0, np.int64)
    n, p, q = np.diff(np.r_[begin, len(p)]), p[begin], q[begin]
    return h[q], hasher(p, p + n - 1 + match), p, n, q


def _pieces(texts: Iterator[tuple[object, bytes]], match: int, gram: int) -> Iterator[tuple[bytes, list]]:
    """Slabs of whole texts, or of one piece of a long text with what decides on its samples; parts: key, place in text, begin, end, wanted range."""
    data, parts, size = [], [], 0
    for key, t in texts:
        if len(t) < match:
            continue
        if size and size + len(t) > SLAB:
            yield b"".join(data), parts
            data, parts, size = [], [], 0
        if len(t) <= SLAB:
            data.append(t)
            parts.append((key, 0, size, size + len(t), (size, size + len(t))))
            size += len(t)
            continue
        for a in range(0, len(t), SLAB):
            lo, hi = max(0, a - match), min(len(t), a + SLAB + 2 * match)
            yield t[lo:hi], [(key, lo, 0, hi - lo, (a - lo, min(a + SLAB, len(t)) - lo))]
    if size:
        yield b"".join(data), parts


def samples(rows: DataFrame, match: int, gram: int) -> DataFrame:
    """``rid``, ``place`` (begin, number of windows and distance of the sample, packed), ``g`` and ``c`` of each gap of ``rows`` (rid, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(SLAB + 4 * match)

        def texts(b: pa.RecordBatch) -> Iterator[tuple[object, bytes]]:
            for r, t in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                if t.is_valid:
                    yield r, t.as_buffer().to_pybytes()

        for b in batches:
            for data, parts in _pieces(texts(b), match, gram):
                first, last = np.array([p[2] for p in parts]), np.array([p[3] for p in parts])
                g, c, p, n, q = gaps(hasher, data, first, last, [x[4] for x in parts], match, gram)
                k = np.searchsorted(first, p, "right") - 1
                begin = p - first[k] + np.array([x[1] for x in parts])[k]
                names = pa.array([x[0] for x in parts], pa.binary()).take(pa.array(k))
                yield pa.RecordBatch.from_arrays([names, *[pa.array(x) for x in (begin << 16 | n << 8 | (q - p), g.view(np.int64), c.view(np.int64))]], ["rid", "place", "g", "c"])

    return rows.select("rid", "text").mapInArrow(frugal(run), "rid binary, place long, g long, c long")


def induce(group: np.ndarray, lo: np.ndarray, hi: np.ndarray, context: list[bytes], match: int = MATCH) -> np.ndarray:
    """Which windows repeat: a row for each context, a column for each distance of the window's begin to the left of the sample.

    Row i has windows at distances lo[i] to hi[i]; its context is their bytes.  Windows are compared within equal ``group``, a sorted array."""
    m, top = len(group), int(hi.max()) + 1
    raw = np.frombuffer(b"".join(context), np.uint8)
    start = np.cumsum([0, *[len(c) for c in context[:-1]]])
    sample, right = start + hi, match - lo
    padded = np.zeros((m, -(-match // 8) * 8), np.uint8)
    row, column = np.repeat(np.arange(m), right), np.arange(right.sum()) - np.repeat(np.cumsum(right) - right, right)
    padded[row, column] = raw[np.repeat(sample, right) + column]
    # suffixes that begin at the sample, those that end first, first
    order = np.lexsort([right, *padded.view(">u8").astype(np.uint64).T[::-1], group])
    differs = padded[order[1:]] != padded[order[:-1]]
    common = np.where(differs.any(axis=1), differs.argmax(axis=1), match)
    common = np.minimum(np.minimum(common, right[order[1:]]), right[order[:-1]])
    common[group[order[1:]] != group[order[:-1]]] = -1
    prefix = np.r_[-1, common]  # with the row before
    out = np.zeros((m, top), bool)
    for a in range(top):
        reach = np.maximum(prefix, np.r_[prefix[1:], -1]) >= match
        out[order[reach], a] = True
        if a + 1 == top:
            break
        keep = np.flatnonzero(hi[order] > a)
        if not len(keep):
            break
        if len(keep) < len(order):
            prefix = np.minimum.reduceat(prefix[: keep[-1] + 1], np.r_[0, keep[:-1] + 1])
            order = order[keep]
        bucket = group[order].astype(np.int64) << 8 | raw[sample[order] - a - 1]
        moved = np.argsort(bucket, kind="stable")
        i, j = moved[:-1], moved[1:]
        met = bucket[i] == bucket[j]
        i, j = i[met], j[met]
        way, tables = j - i, [prefix]
        while way.size and (2 << (len(tables) - 1)) <= way.max():
            t, s = tables[-1], 1 << (len(tables) - 1)
            tables.append(np.minimum(t, np.r_[t[s:], np.full(s, match, t.dtype)]))
        level = np.frexp(way.astype(np.float64))[1] - 1
        new = np.full(len(order), -1)
        low = np.empty(len(way), prefix.dtype)
        for k, t in enumerate(tables):
            at = level == k
            low[at] = np.minimum(t[i[at] + 1], t[j[at] - (1 << k) + 1])
        new[np.flatnonzero(met) + 1] = np.minimum(low + 1, 2 * match)
        order, prefix = order[moved], new
    column = np.arange(top)
    return out & (column >= lo[:, None]) & (column <= hi[:, None])


def _span_batches(rid: pa.Array, q: np.ndarray, repeats: np.ndarray, match: int) -> pa.RecordBatch:
    edge = np.diff(np.pad(repeats, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    last = np.nonzero(edge == -1)[1] - 1
    return pa.RecordBatch.from_arrays([rid.take(pa.array(row)), pa.array(q[row] - last), pa.array(q[row] - first + match)], ["rid", "begin", "end"])


SPAN = "rid binary, begin long, end long"
CONTEXT = "g long, h long, lo int, hi int, many boolean, rid binary, q long, context binary"


def _induced(match: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(b: pa.RecordBatch) -> pa.RecordBatch:
            g, h, lo, hi, many, q = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2, 3, 4, 6))
            group = np.r_[0, np.cumsum((g[1:] != g[:-1]) | (h[1:] != h[:-1]))]
            repeats = induce(group, lo.astype(np.int64), hi.astype(np.int64), b.column(7).to_pylist(), match)
            one = ~many.astype(bool)
            return _span_batches(b.column(5).filter(pa.array(one)), q[one], repeats[one], match)

        kept: list[pa.RecordBatch] = []
        for b in batches:
            while b.num_rows:
                g, h = b.column(0).to_numpy(), b.column(1).to_numpy()
                ends = np.flatnonzero((g[1:] != g[:-1]) | (h[1:] != h[:-1])) + 1  # where groups end within the batch
                if kept and (kept[-1].column(0)[-1].as_py(), kept[-1].column(1)[-1].as_py()) != (g[0], h[0]):
                    ends = np.r_[0, ends]
                have = sum(k.num_rows for k in kept)
                later = ends[ends + have >= ROWS]
                if not len(later):
                    kept.append(b)
                    break
                kept.append(b.slice(0, int(later[0])))
                yield flush(pa.Table.from_batches(kept).combine_chunks().to_batches()[0])
                b, kept = b.slice(int(later[0])), []
        if kept:
            yield flush(pa.Table.from_batches(kept).combine_chunks().to_batches()[0])

    return run


def _contexts(match: int):
    """The bytes of the gaps that a text is the example of: rows of (rid, text, places: array of (place, g, many)).  Copies follow each other; one is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for b in batches:
            for rid, text, places in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), b.column(2), strict=True):
                if rid == before:
                    continue
                before = rid
                t = text.as_buffer()
                made = places.values
                place, g = made.field("place").to_numpy(), made.field("g")
                begin, n, far = place >> 16, place >> 8 & 255, place & 255
                cut = [t.slice(x, y).to_pybytes() for x, y in zip(begin.tolist(), (n - 1 + match).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [g, pa.array(np.zeros(len(n), np.int64)), pa.array((far - n + 1).astype(np.int32)), pa.array(far.astype(np.int32)), made.field("many"), pa.array([rid] * len(n), pa.binary()), pa.array(begin + far), pa.array(cut, pa.binary())],
                    [x.split()[0] for x in CONTEXT.split(", ")],
                )

    return run


def _split(match: int, gram: int, parts: int):
    """Splits each context by ranges of the windows' distances; ``h`` tells range and shared bytes."""
    width = match - gram + 1
    cuts = [width * k // parts for k in range(parts + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                for low, high in zip(cuts, cuts[1:], strict=False):
                    lo, hi = max(low, r["lo"]), min(high - 1, r["hi"])
                    if lo > hi:
                        continue
                    at = r["hi"]  # the sample's place in the context
                    shared = r["context"][at - low : at - (high - 1) + match]
                    h = xxhash.xxh64_intdigest(shared, low << 16 | high)
                    out.append(r | {"h": h - (1 << 64) if h >> 63 else h, "lo": lo, "hi": hi, "context": r["context"][at - hi : at - lo + match]})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=b.schema)

    return run


def gram_of(match: int) -> int:
    """Bytes of a sample: ``GRAM``, for short matches half of them, for long ones enough to keep distances within 8 bits."""
    if match < 1:
        raise ValueError(f"matches of {match} bytes")
    return max(1, min(GRAM, match // 2), match - 254)


def repeated_spans(rows: DataFrame, match: int = MATCH, gram: int = GRAM, classes: int = CLASSES) -> DataFrame:
    """``rid``, ``begin``, ``end``: spans of bytes that repeated windows cover, which may overlap, of ``rows`` (rid, text)."""
    if not 0 < gram <= match or match - gram > 254:
        raise ValueError(f"samples of {gram} bytes for matches of {match}: no more than that, and no more than 254 fewer")
    found = samples(rows, match, gram)
    names = materialize(found.groupBy("g").agg(F.count("*").alias("n"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("n > 1").select("g", (F.col("c0") != F.col("c1")).alias("multi")), "names")
    near = materialize(found.join(names, "g"), "gaps")
    multi = near.where("multi")
    kinds = materialize(multi.groupBy("g", "c").agg(F.count("*").alias("n"), F.min(F.struct("rid", "place")).alias("at")), "classes")
    whole = lambda d: d.select("rid", F.shiftright("place", 16).alias("begin"), (F.shiftright("place", 16) + F.shiftright("place", 8).bitwiseAND(255) - 1 + match).alias("end"))
    spans = whole(near.where("NOT multi")).unionAll(whole(multi.join(kinds.where("n > 1").select("g", "c").hint("merge"), ["g", "c"])))
    hot = materialize(kinds.groupBy("g").agg(F.count("*").alias("k")).where(F.col("k") > classes).select("g"), "hot")
    examples = kinds.select("g", (F.col("n") > 1).alias("many"), F.col("at.rid").alias("rid"), F.col("at.place").alias("place"))

    def contexts(which: DataFrame) -> DataFrame:
        places = which.groupBy("rid").agg(F.collect_list(F.struct("place", "g", "many")).alias("places"))
        # a copy that is read again gives the same bytes at the same place, of a class that has many: it is no harm
        return rows.join(places.hint("merge"), "rid").select("rid", "text", "places").mapInArrow(frugal(_contexts(match)), CONTEXT)

    def sort(some: DataFrame) -> DataFrame:
        # by a hash, as Spark leaves out a shuffle by columns that a join below is dealt by, and may split that one
        return some.repartition(F.xxhash64("g", "h")).sortWithinPartitions("g", "h").mapInArrow(frugal(_induced(match)), SPAN)

    if hot.isEmpty():
        return spans.unionAll(sort(contexts(examples)))
    spans = spans.unionAll(sort(contexts(examples.join(hot, "g", "left_anti"))))
    left, parts, width = materialize(contexts(examples.join(hot, "g", "left_semi")), "contexts"), 1, match - gram + 1
    while True:
        parts = min(width, parts * SPLIT)
        split = materialize(left.mapInArrow(frugal(_split(match, gram, parts)), CONTEXT).withColumn("c", F.xxhash64("context", "lo", "hi")), "split")
        kinds = materialize(split.groupBy("g", "h", "c").agg(F.count("*").alias("n"), F.max("many").alias("many"), F.min(F.struct("lo", "hi", "rid", "q", "context")).alias("at")), "classes")
        same = split.where("NOT many").join(kinds.where("n > 1").select("g", "h", "c"), ["g", "h", "c"])
        spans = spans.unionAll(same.select("rid", (F.col("q") - F.col("hi")).alias("begin"), (F.col("q") - F.col("lo") + match).alias("end")))
        one = kinds.select("g", "h", "at.lo", "at.hi", (F.col("many") | (F.col("n") > 1)).alias("many"), "at.rid", "at.q", "at.context")
        sizes = materialize(one.groupBy("g", "h").agg(F.count("*").alias("k")).where("k > 1"), "sizes")
        spans = spans.unionAll(sort(one.join(sizes.where(F.col("k") <= classes).select("g", "h"), ["g", "h"])))
        large = sizes.where(F.col("k") > classes).select("g", "h")
        if large.isEmpty():  # as it must be once ranges hold one window, whose shared bytes are all there is
            return spans
        left = materialize(one.join(large, ["g", "h"]), "contexts")


def remove_repeats(df: DataFrame, key: str, text: str, match: int = MATCH, kept: str = "kept", as_text: bool = False) -> DataFrame:
    """Adds ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` (bytes) to each row of ``df``; ``text`` goes.

    Null texts are empty.  Windows are judged on the input; all places of a repeated window go, in the same
    row too.  Texts below ``match`` bytes stay whole.  Rows of equal text, whatever their keys (``key`` is not read), are repeats of one
    another.  Texts of any length are read in pieces.  An empty table gives no rows; other columns pass through, but for those of the added
    names, which are replaced.  ``as_text``: ``kept`` is a string, without the parts of characters that a cut leaves."""
    rest = passing(df, (text, "n_bytes", "n_removed", "n_spans", kept))
    body = F.col(f"`{text}`")
    df = df.select(packed(rest), body.alias("text"), F.unhex(F.md5(F.coalesce(body, F.lit("")).cast("binary"))).alias("rid"))
    spans = repeated_spans(df, match, gram_of(match)).distinct().groupBy("rid").agg(F.collect_list(F.struct("begin", "end")).alias("spans"))
    joined = df.join(spans, "rid", "left").select("row", "text", "spans")
    schema = joined.select("row").schema.add("n_bytes", "long").add("n_removed", "long").add("n_spans", "long").add("kept", "string" if as_text else "binary")
    k = 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made, at, size = [], 0, 0
            for n, (t, s) in enumerate(zip(b.column(k).cast(pa.binary()), b.column(k + 1), strict=True), 1):
                data = t.as_buffer().to_pybytes() if t.is_valid else b""
                made.append(cut(data, s.values.field("begin").to_numpy(), s.values.field("end").to_numpy()) if s.is_valid else (len(data), 0, 0, data))
                size += len(data)
                if size >= OUT_BYTES or n == b.num_rows:
                    columns = [c.slice(at, n - at) for c in b.columns[:k]]
                    yield pa.RecordBatch.from_arrays([*columns, *[pa.array([m[x] for m in made], pa.int64()) for x in range(3)], last([m[3] for m in made])], schema.names)
                    made, at, size = [], n, 0

    def last(made: list[bytes]) -> pa.Array:
        return pa.array([m.decode("utf-8", "ignore") for m in made], pa.string()) if as_text else pa.array(made, pa.binary())

    return unpacked(joined.mapInArrow(frugal(run), schema), rest, "n_bytes", "n_removed", "n_spans", F.col("kept").alias(kept))


def cut(data: bytes, begin: np.ndarray, end: np.ndarray) -> tuple[int, int, int, bytes]:
    """Length, bytes removed, maximal runs removed, and what is left of ``data`` without the spans."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    new = np.r_[True, begin[1:] > end[:-1]]
    first, last = begin[new], end[np.r_[np.flatnonzero(new)[1:] - 1, len(end) - 1]]
    kept = b"".join(data[a:b] for a, b in zip([0, *last.tolist()], [*first.tolist(), len(data)], strict=True))
    return len(data), int((last - first).sum()), len(first), kept
