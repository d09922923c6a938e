"""Pixelised sky maps: a row a pixel, in nested order."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.dataset import Dataset, check_mode
from ..plans import healpix, regions
from ..sources.header import Header


class HealpixMap(Dataset):
    """``pixel`` is a column of ``base``; it is kept, but not among the public columns."""

    kind = "HealpixMap"

    def __init__(self, *args: Any, nside: int, pixel: str = "pixel", full_sky: bool = False, **kwargs: Any):
        super().__init__(*args, **kwargs)
        self.nside, self.pixel, self.full_sky = healpix.check_nside(nside), pixel, full_sky

    def _extra(self):
        return {"nside": self.nside, "pixel": self.pixel, "full_sky": self.full_sky}

    @classmethod
    def of(cls, df: DataFrame, nside: int, pixel: str = "pixel", full_sky: bool = False, units: dict | None = None, header: Header | None = None) -> HealpixMap:
        header = header or Header("healpix_map", healpix={"nside": nside, "ordering": "nested", "full_sky": full_sky})
        d = Dataset.from_dataframe(df, pixel, units, header)
        return cls(df, {n: x for n, x in d.defs.items() if n != pixel}, header, [pixel], nside=nside, pixel=pixel, full_sky=full_sky)

    @property
    def ordering(self) -> str:
        return "nested"

    @property
    def nside_lr(self) -> int:
        return self.header.healpix.get("nside_lr", self.nside)

    @property
    def z_range(self):
        return self.header.z_range

    def pixels(self) -> np.ndarray:
        return np.array([r[0] for r in self.base.select(self.pixel).orderBy(self.pixel).collect()], np.int64)

    def _part(self, ds: HealpixMap) -> HealpixMap:
        return ds._with(full_sky=False)

    def filter(self, *masks, mode: str = "global"):
        return self._part(super().filter(*masks, mode=mode)) if masks else self

    def take(self, n: int, at: str = "random", mode: str = "global", seed: int | None = None):
        """More rows than there are: ValueError."""
        check_mode(mode)
        if n > len(self):
            raise ValueError(f"the map has fewer than {n} pixels")
        return self._part(super().take(n, at, mode, seed))

    def take_range(self, start: int, end: int, mode: str = "global"):
        if end > len(self):
            raise ValueError(f"the map has fewer than {end} pixels")
        return self._part(super().take_range(start, end, mode))

    def take_rows(self, rows: Sequence[int]):
        return self._part(super().take_rows(rows))

    def drop(self, column: str):
        return super().drop(column)

    def with_units(self, *args: Any, **kwargs: Any):
        raise NotImplementedError("maps keep their units")

    def bound(self, region: regions.Region, inclusive: bool = False, select_by: Sequence[str] | None = None):
        """Pixels whose centre is in a cone, or that may overlap it if inclusive."""
        if not isinstance(region, regions.Cone):
            raise ValueError("maps are bound by cones")
        return self._within(region, healpix.query_disc(self.nside, region.ra, region.dec, region.radius, inclusive))

    def _within(self, region: regions.Region, pixels: np.ndarray):
        wanted = regions.PixelSet(self.nside, tuple(pixels.tolist()))
        return self._part(self._with(base=self.base.filter(wanted.pixel_predicate(F.col(self.pixel))), region=region))

    def cone_search(self, center, radius, inclusive: bool = False):
        return self.bound(regions.make_cone(center, radius), inclusive)

    def box_search(self, p1, p2):
        """Pixels whose centre is in a rectangle in right ascension and declination."""
        box = regions.make_skybox(p1, p2)
        near = box.pixels(self.nside)
        ra, dec = healpix.pix2ang(self.nside, near)
        inside = np.array(box.holds(np.stack([ra, dec], axis=1)), bool) if len(near) else np.zeros(0, bool)
        return self._within(box, near[inside])

    def with_resolution(self, nside: int):
        """The mean of the pixels that each coarser pixel holds, as 32-bit numbers."""
        healpix.check_nside(nside)
        if nside > self.nside:
            raise ValueError("maps can only be made coarser")
        if nside == self.nside:
            return self
        shift = 2 * (self.nside.bit_length() - nside.bit_length())
        df = self.to_df(hidden=[self.pixel])
        coarse = df.groupBy(F.shiftright(self.pixel, shift).cast("long").alias(self.pixel)).agg(*[F.avg(c).cast("float").alias(c) for c in self.columns])
        header = replace(self.header, healpix=self.header.healpix | {"nside": nside})
        return HealpixMap.of(coarse, nside, self.pixel, self.full_sky, {n: u for n, u in self.units.items() if u}, header)

    def get_data(self, format: str = "healpix", nside_out: int | None = None, **kwargs: Any) -> Any:
        """``healpix``: dense 32-bit arrays by column, masked where nothing was observed; else as for datasets."""
        if nside_out and nside_out != self.nside:
            return self.with_resolution(nside_out).get_data(format, **kwargs)
        if format == "healsparse":
            import healsparse

            pdf = self.to_df(hidden=[self.pixel]).toPandas()
            out = {}
            for c in self.columns:
                out[c] = healsparse.HealSparseMap.make_empty(min(32, self.nside), self.nside, np.float32)
                out[c][pdf[self.pixel].to_numpy()] = pdf[c].to_numpy(np.float32)
            return out
        if format != "healpix":
            return super().get_data(format, **kwargs)
        pdf = self.to_df(hidden=[self.pixel]).toPandas()
        out = {}
        for c in self.columns:
            values, unseen = np.zeros(healpix.npix(self.nside), np.float32), np.ones(healpix.npix(self.nside), bool)
            values[pdf[self.pixel]], unseen[pdf[self.pixel]] = pdf[c], False
            out[c] = np.ma.masked_array(values, unseen)
        return out
