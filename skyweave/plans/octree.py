"""Octree cells as Morton keys: bit k of x, y, z is bit 3k, 3k + 1, 3k + 2 of the key."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .regions import Box


def _spread(x: Column, bits: int) -> Column:
    """The lowest bits to every third place; ``x`` is bound once, as its terms would repeat it."""
    terms = lambda v: sum((F.shiftleft(F.shiftright(v, b).bitwiseAND(F.lit(1)), 3 * b) for b in range(1, bits)), v.bitwiseAND(F.lit(1)))
    return F.transform(F.array(x), terms)[0]


def key_column(coords: Sequence[Column], box_size: float, level: int) -> Column:
    """The cell of a point in a periodic box; points on or beyond its ends are in the cells at its ends."""
    cells = 1 << level
    axes = [F.greatest(F.lit(0), F.least(F.lit(cells - 1), F.floor(c.cast("double") / F.lit(box_size / cells)))).cast("long") for c in coords]
    x, y, z = (_spread(a, max(1, level)) for a in axes)
    return x.bitwiseOR(F.shiftleft(y, 1)).bitwiseOR(F.shiftleft(z, 2))


def key_ranges(box: Box, box_size: float, level: int, most: int = 256) -> list[tuple[int, int]]:
    """Runs of keys at ``level`` whose cells may meet a box, made of about ``most`` cells; coarser cells stand for finer ones."""
    cells, depth = [(0, 0, 0, 0)], 0
    done: list[tuple[int, int]] = []
    while cells and depth < level and len(cells) + len(done) <= most:
        depth += 1
        side, new = box_size / (1 << depth), []
        for key, x, y, z in cells:
            for o in range(8):
                at = (2 * x + (o & 1), 2 * y + (o >> 1 & 1), 2 * z + (o >> 2))
                last = (1 << depth) - 1  # cells at the ends also hold what lies beyond
                low = [-np.inf if c == 0 else c * side for c in at]
                high = [np.inf if c == last else (c + 1) * side for c in at]
                if any(lo > bh or hi < bl for lo, hi, bl, bh in zip(low, high, box.low, box.high, strict=True)):
                    continue
                inside = all(lo >= bl and hi <= bh for lo, hi, bl, bh in zip(low, high, box.low, box.high, strict=True))
                k = key << 3 | o
                if inside:
                    done.append((k << 3 * (level - depth), ((k + 1) << 3 * (level - depth)) - 1))
                else:
                    new.append((k, *at))
        cells = new
    done += [(k << 3 * (level - depth), ((k + 1) << 3 * (level - depth)) - 1) for k, *_ in cells]
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(done):
        if out and lo == out[-1][1] + 1:
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


#: Runs that a predicate for pruning names at most.
MOST_RUNS = 128


def coarser(runs: Sequence[tuple[int, int]], most: int = MOST_RUNS) -> list[tuple[int, int]]:
    """At most ``most`` runs that cover the given ones, in their order: the smallest gaps are closed."""
    if len(runs) <= most:
        return list(runs)
    low, high = np.array([r[0] for r in runs]), np.array([r[1] for r in runs])
    cut = np.sort(np.argsort(low[1:] - high[:-1], kind="stable")[len(runs) - most :])
    return list(zip(low[np.r_[0, cut + 1]].tolist(), high[np.r_[cut, len(runs) - 1]].tolist(), strict=True))


def in_ranges(key: Column, runs: Sequence[tuple[int, int]]) -> Column:
    """Whether a key is in one of the runs, as a balanced tree, so that depth grows with the logarithm of their number."""
    tests = [(key >= F.lit(lo)) & (key <= F.lit(hi)) for lo, hi in runs] or [F.lit(False)]
    while len(tests) > 1:
        tests = [a | b for a, b in zip(tests[::2], tests[1::2], strict=False)] + tests[len(tests) // 2 * 2 :]
    return tests[0]


def cell_counts(df: DataFrame, key: Column, level: int, fold: int = 3) -> DataFrame:
    """``level``, ``cell`` and ``n`` for all levels: counts of the finest cells, folded upwards from one shuffle of them."""
    finest = df.groupBy(key.alias("cell")).agg(F.count("*").alias("n"))
    folded = finest.select(F.explode(F.sequence(F.lit(0), F.lit(level))).alias("level"), "cell", "n")
    up = F.expr(f"shiftright(cell, {fold} * ({level} - level))")
    return folded.groupBy("level", up.alias("cell")).agg(F.sum("n").alias("n"))
