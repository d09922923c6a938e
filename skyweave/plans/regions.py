"""Regions of space and of the sky: how they relate, and the predicates of rows inside.

Points on a boundary are outside.  A region that holds another may share its boundary, but a cone must be larger.
"""

from __future__ import annotations

import json
import math
import warnings
from collections.abc import Sequence
from dataclasses import asdict, dataclass, replace

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.units import Quantity, UNITS
from . import healpix


def _degrees(x: float | Quantity) -> float:
    return x.to(UNITS["deg"]) if isinstance(x, Quantity) else float(x)


def separation(a: tuple[float, float], b: tuple[float, float]) -> float:
    """Great-circle distance in degrees, by the haversine formula."""
    (r1, d1), (r2, d2) = ([math.radians(x) for x in p] for p in (a, b))
    h = math.sin((d2 - d1) / 2) ** 2 + math.cos(d1) * math.cos(d2) * math.sin((r2 - r1) / 2) ** 2
    return math.degrees(2 * math.asin(min(1.0, math.sqrt(h))))


def separation_column(ra: Column, dec: Column, at: tuple[float, float]) -> Column:
    r, d = math.radians(at[0]), math.radians(at[1])
    a = F.pow(F.sin((F.radians(dec) - F.lit(d)) / 2), F.lit(2.0)) + F.lit(math.cos(d)) * F.cos(F.radians(dec)) * F.pow(F.sin((F.radians(ra) - F.lit(r)) / 2), F.lit(2.0))
    return F.degrees(F.lit(2.0) * F.asin(F.least(F.lit(1.0), F.sqrt(a))))


class Region:
    """``predicate`` takes the coordinate columns: three of space, or right ascension and declination in degrees."""

    flat = True

    def predicate(self, *coords: Column) -> Column:
        raise NotImplementedError

    def contains(self, other: Region) -> bool:
        return _relate(self, other, _CONTAINS)

    def intersects(self, other: Region) -> bool:
        return _relate(self, other, _INTERSECTS)

    def holds(self, points: Sequence[Sequence[float]]) -> list[bool]:
        """Whether each point is inside."""
        raise NotImplementedError

    def dump(self) -> dict:
        return {"kind": type(self).__name__, **{k: list(v) if isinstance(v, tuple) else v for k, v in asdict(self).items()}}


def _points(points, n: int) -> np.ndarray:
    p = np.asarray(points, float)
    if p.ndim != 2 or p.shape[1] != n:
        raise ValueError(f"points of {n} coordinates are wanted")
    return p


@dataclass(frozen=True)
class Box(Region):
    """``low`` and ``high`` corners, in the dataset's convention."""

    low: tuple[float, float, float]
    high: tuple[float, float, float]
    flat = False

    def predicate(self, *coords):
        out = None
        for c, lo, hi in zip(coords, self.low, self.high, strict=True):
            one = (c > F.lit(lo)) & (c < F.lit(hi))
            out = one if out is None else out & one
        return out

    def holds(self, points):
        p = _points(points, 3)
        return ((p > self.low) & (p < self.high)).all(axis=1).tolist()

    def scaled(self, factor: float) -> Box:
        return Box(tuple(x * factor for x in self.low), tuple(x * factor for x in self.high))


@dataclass(frozen=True)
class Cone(Region):
    ra: float
    dec: float
    radius: float

    def predicate(self, ra, dec):
        return separation_column(ra, dec, (self.ra, self.dec)) < F.lit(self.radius)

    def holds(self, points):
        return [separation((self.ra, self.dec), tuple(p)) < self.radius for p in _points(points, 2)]

    def pixels(self, nside: int) -> np.ndarray:
        return healpix.query_disc(nside, self.ra, self.dec, self.radius)


@dataclass(frozen=True)
class SkyBox(Region):
    """A rectangle in right ascension and declination, which does not wrap at 360 degrees."""

    low: tuple[float, float]
    high: tuple[float, float]

    def predicate(self, ra, dec):
        return (ra > F.lit(self.low[0])) & (ra < F.lit(self.high[0])) & (dec > F.lit(self.low[1])) & (dec < F.lit(self.high[1]))

    def holds(self, points):
        p = _points(points, 2)
        return ((p > self.low) & (p < self.high)).all(axis=1).tolist()

    def corners(self) -> list[tuple[float, float]]:
        return [(r, d) for r in (self.low[0], self.high[0]) for d in (self.low[1], self.high[1])]

    def pixels(self, nside: int) -> np.ndarray:
        """Pixels that may overlap: those of a coarse level that does, refined."""
        level, pixels = 1, np.arange(12)
        while True:
            ra, dec = healpix.pix2ang(level, pixels)
            r = healpix.max_radius(level)
            top = np.minimum(np.abs(dec) + r, 90.0)
            wide = np.where(top >= 89.999, 360.0, np.minimum(360.0, r / np.maximum(1e-9, np.cos(np.radians(top)))))
            near = np.zeros(len(pixels), bool)
            for turn in (-360.0, 0.0, 360.0):  # stored right ascensions may be negative
                near |= (ra + turn >= self.low[0] - wide) & (ra + turn <= self.high[0] + wide)
            pixels = pixels[near & (dec >= self.low[1] - r) & (dec <= self.high[1] + r)]
            if level == nside:
                return np.sort(pixels)
            level *= 2
            pixels = (pixels[:, None] * 4 + np.arange(4)).ravel()


@dataclass(frozen=True)
class PixelSet(Region):
    """HEALPix pixels in nested order."""

    nside: int
    pixel: tuple[int, ...]

    def predicate(self, ra, dec):
        return self.computed_predicate(healpix.pixel_column(self.nside, ra, dec))

    def pixel_predicate(self, pixel: Column) -> Column:
        """Few runs of pixels as ranges, which reach the scan for stored pixels; many are looked up, within the first and the last."""
        from .octree import MOST_RUNS, coarser, in_ranges

        runs = healpix.ranges(np.array(self.pixel, np.int64))
        return in_ranges(pixel, runs) if len(runs) <= MOST_RUNS else in_ranges(pixel, coarser(runs)) & self.computed_predicate(pixel)

    def computed_predicate(self, pixel: Column) -> Column:
        """The same for a pixel that is worked out: a lookup names it once."""
        return pixel.isin(list(self.pixel))

    def holds(self, points):
        p = _points(points, 2)
        return np.isin(healpix.ang2pix(self.nside, p[:, 0], p[:, 1]), self.pixel).tolist()

    def pixels(self, nside: int) -> np.ndarray:
        p, k = np.array(self.pixel, np.int64), nside.bit_length() - self.nside.bit_length()
        return np.unique(p >> -2 * k) if k <= 0 else ((p << 2 * k)[:, None] + np.arange(4**k)).ravel()

    def combine(self, other: PixelSet) -> PixelSet:
        if self.nside != other.nside:
            raise ValueError("pixel sets of one nside are wanted")
        return PixelSet(self.nside, tuple(sorted(set(self.pixel) | set(other.pixel))))


@dataclass(frozen=True)
class FullSky(Region):
    def predicate(self, ra, dec):
        return F.lit(True)

    def holds(self, points):
        return [True] * len(_points(points, 2))


def _flat_reach(b: SkyBox, c: Cone) -> bool:
    return b.low[0] <= c.ra - c.radius and c.ra + c.radius <= b.high[0] and b.low[1] <= c.dec - c.radius and c.dec + c.radius <= b.high[1]


def _nearest(b: SkyBox, c: Cone) -> tuple[float, float]:
    return min(max(c.ra, b.low[0]), b.high[0]), min(max(c.dec, b.low[1]), b.high[1])


_CONTAINS = {
    (Box, Box): lambda a, b: all(x <= y for x, y in zip(a.low, b.low, strict=True)) and all(x >= y for x, y in zip(a.high, b.high, strict=True)),
    (Cone, Cone): lambda a, b: a.radius > separation((a.ra, a.dec), (b.ra, b.dec)) + b.radius,
    (SkyBox, SkyBox): lambda a, b: all(x <= y for x, y in zip(a.low, b.low, strict=True)) and all(x >= y for x, y in zip(a.high, b.high, strict=True)),
    (SkyBox, Cone): _flat_reach,
    (Cone, SkyBox): lambda a, b: all(a.holds(b.corners())),
    (PixelSet, PixelSet): lambda a, b: a.nside == b.nside and set(b.pixel) <= set(a.pixel),
    (PixelSet, Cone): lambda a, b: set(b.pixels(a.nside).tolist()) <= set(a.pixel),
    (PixelSet, SkyBox): lambda a, b: set(b.pixels(a.nside).tolist()) <= set(a.pixel),
}
_INTERSECTS = {
    (Box, Box): lambda a, b: all(x <= y for x, y in zip(a.low, b.high, strict=True)) and all(x <= y for x, y in zip(b.low, a.high, strict=True)),
    (Cone, Cone): lambda a, b: separation((a.ra, a.dec), (b.ra, b.dec)) < a.radius + b.radius,
    (SkyBox, SkyBox): lambda a, b: all(x < y for x, y in zip(a.low, b.high, strict=True)) and all(x < y for x, y in zip(b.low, a.high, strict=True)),
    (SkyBox, Cone): lambda a, b: separation(_nearest(a, b), (b.ra, b.dec)) < b.radius,
    (Cone, SkyBox): lambda a, b: separation(_nearest(b, a), (a.ra, a.dec)) < a.radius,
    (PixelSet, PixelSet): lambda a, b: a.nside == b.nside and bool(set(a.pixel) & set(b.pixel)),
    (PixelSet, Cone): lambda a, b: bool(set(a.pixel) & set(b.pixels(a.nside).tolist())),
    (PixelSet, SkyBox): lambda a, b: bool(set(a.pixel) & set(b.pixels(a.nside).tolist())),
    (Cone, PixelSet): lambda a, b: bool(set(b.pixel) & set(a.pixels(b.nside).tolist())),
    (SkyBox, PixelSet): lambda a, b: bool(set(b.pixel) & set(a.pixels(b.nside).tolist())),
}


def _relate(a: Region, b: Region, table: dict) -> bool:
    if a.flat != b.flat:
        raise ValueError(f"{type(a).__name__} and {type(b).__name__} are not comparable")
    if isinstance(a, FullSky):
        return True
    if isinstance(b, FullSky):
        return table is _INTERSECTS
    if (type(a), type(b)) not in table:
        raise ValueError(f"{type(a).__name__} and {type(b).__name__} are not comparable")
    return table[type(a), type(b)](a, b)


def load(x: dict | str) -> Region:
    """The region of what ``dump`` made."""
    x = dict(json.loads(x) if isinstance(x, str) else x)
    kinds = {k.__name__: k for k in (Box, Cone, SkyBox, PixelSet, FullSky)}
    if (kind := kinds.get(x.pop("kind", ""))) is None:
        raise ValueError("no region")
    return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in x.items()})


def make_box(p1: Sequence[float], p2: Sequence[float]) -> Box:
    """Corners in any order; a side of no length is a ValueError."""
    if len(p1) != 3 or len(p2) != 3:
        raise ValueError("corners have three coordinates")
    low, high = tuple(float(min(a, b)) for a, b in zip(p1, p2, strict=True)), tuple(float(max(a, b)) for a, b in zip(p1, p2, strict=True))
    if any(a == b for a, b in zip(low, high, strict=True)):
        raise ValueError("a box has some length in each direction")
    return Box(low, high)


def make_cone(center: Sequence[float | Quantity], radius: float | Quantity) -> Cone:
    """Centre and radius in degrees, or with units."""
    if not isinstance(center, Sequence) or len(center) != 2:
        raise ValueError("a centre is right ascension and declination")
    return Cone(_degrees(center[0]), _degrees(center[1]), _degrees(radius))


def make_skybox(p1: Sequence[float | Quantity], p2: Sequence[float | Quantity]) -> SkyBox:
    """Corners in any order."""
    a, b = [_degrees(x) for x in p1], [_degrees(x) for x in p2]
    if len(a) != 2 or len(b) != 2:
        raise ValueError("corners are right ascension and declination")
    out = SkyBox((min(a[0], b[0]), min(a[1], b[1])), (max(a[0], b[0]), max(a[1], b[1])))
    if out.low[0] == out.high[0] or out.low[1] == out.high[1]:
        warnings.warn("the sky box has no area", stacklevel=2)
    return out


def moved(region: Region, factor: float) -> Region:
    """A box in other units of length; regions of the sky have none."""
    return region.scaled(factor) if isinstance(region, Box) else replace(region)
