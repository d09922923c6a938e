"""HEALPix pixels in nested order (Gorski et al. 2005), for arrays and as Spark expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def check_nside(nside: int) -> int:
    if not isinstance(nside, (int, np.integer)) or nside < 1 or nside & (nside - 1) or nside > 1 << 29:
        raise ValueError(f"nside {nside!r} is no power of two up to 2^29")
    return int(nside)


def npix(nside: int) -> int:
    return 12 * nside * nside


#: For each base pixel, ring and longitude of its lowest corner, in units of nside and of a quarter of pi.
RING = np.array([2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 4])
LONGITUDE = np.array([1, 3, 5, 7, 0, 2, 4, 6, 1, 3, 5, 7])
#: Masks that spread 32 bits to the even places of 64, step by step.
SPREAD = ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555))


def spread(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.int64)
    for shift, mask in SPREAD:
        x = (x | x << shift) & mask
    return x


def squeeze(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.int64) & SPREAD[-1][1]
    for (shift, _), mask in zip(SPREAD[::-1], [m for _, m in SPREAD[-2::-1]] + [0xFFFFFFFF], strict=True):
        x = (x | x >> shift) & mask
    return x


def spread_column(x: Column, bits: int) -> Column:
    """The lowest bits to the even places; ``x`` is bound once, as its terms would repeat it."""
    terms = lambda v: sum((F.shiftleft(F.shiftright(v, b).bitwiseAND(F.lit(1)), 2 * b) for b in range(1, bits)), v.bitwiseAND(F.lit(1)))
    return F.transform(F.array(x.cast("long")), terms)[0]


def ang2pix(nside: int, ra, dec) -> np.ndarray:
    """Pixels of directions in degrees."""
    ra, dec = np.broadcast_arrays(np.asarray(ra, float), np.asarray(dec, float))
    z, t = np.sin(np.radians(dec)), np.mod(ra, 360.0) / 90.0
    belt = np.abs(z) <= 2 / 3
    up, down = nside * (0.5 + t), nside * 0.75 * z
    a, b = np.floor(up - down).astype(np.int64), np.floor(up + down).astype(np.int64)  # diagonals that descend and ascend
    fa, fb = a // nside, b // nside
    face_belt = np.where(fa == fb, (fa & 3) | 4, np.where(fa < fb, fa & 3, (fb & 3) + 8))
    # near the poles, distances are taken from the cosine of the declination, which keeps its digits there
    quarter = np.minimum(np.floor(t).astype(np.int64), 3)
    part, size = t - quarter, nside * np.sqrt(3) * np.sqrt(2) * np.abs(np.sin(np.radians(45 - np.abs(dec) / 2)))
    c = np.minimum((part * size).astype(np.int64), nside - 1)
    d = np.minimum(((1 - part) * size).astype(np.int64), nside - 1)
    north = z > 0
    face = np.where(belt, face_belt, np.where(north, quarter, quarter + 8))
    x = np.where(belt, b & (nside - 1), np.where(north, nside - d - 1, c))
    y = np.where(belt, nside - (a & (nside - 1)) - 1, np.where(north, nside - c - 1, d))
    return face * nside * nside + spread(x) + (spread(y) << 1)


def pixel_column(nside: int, ra: Column, dec: Column) -> Column:
    """As ``ang2pix``, within Spark's generated code."""
    n, long = F.lit(nside), lambda c: F.floor(c).cast("long")
    z, t = F.sin(F.radians(dec)), F.pmod(ra, F.lit(360.0)) / 90.0
    up, down = n * (t + 0.5), n * 0.75 * z
    a, b = long(up - down), long(up + down)
    k = nside.bit_length() - 1
    fa, fb = F.shiftright(a, k), F.shiftright(b, k)
    three, low = F.lit(3), F.lit(nside - 1)
    face_belt = F.when(fa == fb, fa.bitwiseAND(three).bitwiseOR(F.lit(4))).when(fa < fb, fa.bitwiseAND(three)).otherwise(fb.bitwiseAND(three) + 8)
    quarter = F.least(long(t), F.lit(3).cast("long"))
    size = F.lit(nside * np.sqrt(3) * np.sqrt(2)) * F.abs(F.sin(F.radians(F.lit(45.0) - F.abs(dec) / 2)))
    c, d = F.least(long((t - quarter) * size), low.cast("long")), F.least(long((quarter + 1 - t) * size), low.cast("long"))
    belt, north = F.abs(z) <= 2 / 3, z > 0
    face = F.when(belt, face_belt).when(north, quarter).otherwise(quarter + 8)
    x = F.when(belt, b.bitwiseAND(low)).when(north, n - d - 1).otherwise(c)
    y = F.when(belt, n - a.bitwiseAND(low) - 1).when(north, n - c - 1).otherwise(d)
    bits = max(1, nside.bit_length() - 1)
    return (face * (nside * nside) + spread_column(x, bits) + F.shiftleft(spread_column(y, bits), 1)).cast("long")


def pix2ang(nside: int, pixel) -> tuple[np.ndarray, np.ndarray]:
    """Centres of pixels: right ascension and declination in degrees."""
    pixel = np.asarray(pixel, np.int64)
    face, rest = pixel // (nside * nside), pixel % (nside * nside)
    x, y = squeeze(rest), squeeze(rest >> 1)
    ring = RING[face] * nside - x - y - 1
    north, south = ring < nside, ring > 3 * nside
    width = np.where(north, ring, np.where(south, 4 * nside - ring, nside))
    z = np.where(north, 1 - width**2 / (3 * nside**2), np.where(south, width**2 / (3 * nside**2) - 1, (2 * nside - ring) * 2 / (3 * nside)))
    shift = np.where(north | south, 0, (ring - nside) & 1)
    j = (LONGITUDE[face] * width + x - y + 1 + shift) // 2
    j = np.where(j > 4 * nside, j - 4 * nside, np.where(j < 1, j + 4 * nside, j))
    phi = (j - (shift + 1) * 0.5) * (np.pi / 2) / width
    return np.degrees(phi) % 360.0, np.degrees(np.arcsin(np.clip(z, -1, 1)))


def vectors(ra, dec) -> np.ndarray:
    ra, dec = np.radians(np.asarray(ra, float)), np.radians(np.asarray(dec, float))
    return np.stack([np.cos(dec) * np.cos(ra), np.cos(dec) * np.sin(ra), np.sin(dec)], axis=-1)


def max_radius(nside: int) -> float:
    """An upper bound, in degrees, of the distance of a pixel's corner from its centre."""
    t, far = (1 - 1 / nside) ** 2, lambda z: np.degrees(np.arcsin(z))
    a, b = vectors(45.0 / nside, far(2 / 3)), vectors(0.0, far(1 - t / 3))
    return float(np.degrees(np.arccos(np.clip(a @ b, -1, 1)))) * (1 + 1e-9)


def query_disc(nside: int, ra: float, dec: float, radius: float, inclusive: bool = True) -> np.ndarray:
    """Pixels whose centre is within ``radius`` degrees, or, if inclusive, that may overlap the disc.

    Coarse pixels are refined step by step, so the work grows with the disc's rim, not with the sky."""
    centre = vectors(ra, dec)
    level, pixels = 1, np.arange(12)
    while True:
        c = vectors(*pix2ang(level, pixels))
        away = np.degrees(np.arccos(np.clip(c @ centre, -1, 1)))
        margin = max_radius(level) if inclusive or level < nside else 0.0
        pixels = pixels[away <= radius + margin]
        if level == nside:
            return np.sort(pixels)
        level *= 2
        pixels = (pixels[:, None] * 4 + np.arange(4)).ravel()


def ranges(pixels: np.ndarray) -> list[tuple[int, int]]:
    """Runs of neighbouring pixels, both ends included."""
    p = np.unique(pixels)
    if not len(p):
        return []
    cut = np.flatnonzero(np.diff(p) > 1)
    return list(zip(p[np.r_[0, cut + 1]].tolist(), p[np.r_[cut, len(p) - 1]].tolist(), strict=True))
