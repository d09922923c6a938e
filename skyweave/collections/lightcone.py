"""Sky catalogues stacked from redshift steps: one table with a column for the step, so that reductions are over the whole stack."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import replace
from typing import Any

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import Expr
from ..functions.units import UNITS
from ..operators.dataset import Dataset, Stored
from ..plans import healpix, regions
from ..sources.header import Header

STEP = "__step"
#: Nested pixel of rows at a level fine enough for all coarser ones to be its shifted bits.
PIXEL, LEVEL = "__hpix", 12


def with_angles(df: DataFrame, header: Header) -> DataFrame:
    """Adds what a catalogue lacks of theta, phi, chi, redshift, ra and dec, in that order.

    Angles come from the centre's coordinates, redshifts from the scale factor, ``redshift_true``, ``zp`` or the distance."""
    have, xyz = set(df.columns), [f"fof_halo_center_{a}" for a in "xyz"]
    if not {"theta", "phi"} <= have and not {"ra", "dec"} <= have and set(xyz) <= have:
        x, y, z = (F.col(c) for c in xyz)
        df = df.withColumn("chi", F.sqrt(x * x + y * y + z * z)).withColumns({"phi": F.atan2(y, x), "theta": F.acos(z / F.col("chi"))})
        have = set(df.columns)
    if "redshift" not in have:
        if "fof_halo_center_a" in have:
            df = df.withColumn("redshift", 1 / F.col("fof_halo_center_a") - 1)
        elif "redshift_true" in have:
            df = df.withColumn("redshift", F.col("redshift_true"))
        elif "zp" in have:
            df = df.withColumn("redshift", F.col("zp"))
        elif "chi" in have:
            df = df.withColumn("redshift", header.cosmology.redshift_column(F.col("chi")))
    if not {"ra", "dec"} <= have and {"theta", "phi"} <= set(df.columns):
        df = df.withColumns({"ra": F.degrees("phi"), "dec": 90 - F.degrees("theta")})
    return df


class Lightcone(Dataset):
    """Members share their columns.  ``steps``: the redshift range of each step, for pruning."""

    kind = "Lightcone"

    def __init__(self, *args: Any, steps: dict[int, tuple[float, float] | None] | None = None, hidden: dict | None = None, z_range: tuple[float, float] | None = None, **kwargs: Any):
        super().__init__(*args, **kwargs)
        self.steps, self._z_range, self.hidden = steps or {}, z_range, hidden or {n: self.defs[n] for n in ("redshift", "ra", "dec") if n in self.defs}
        self.coords = self.coords or ("ra", "dec")

    def _extra(self):
        return {"steps": self.steps, "hidden": self.hidden, "z_range": self._z_range}

    @classmethod
    def from_datasets(cls, members: dict[int, Dataset] | Sequence[Dataset]) -> Lightcone:
        """Stacks members by step; different columns are a ValueError.  Sequences are numbered by their headers' steps, else in turn."""
        if not isinstance(members, dict):
            keys = [m.header.step for m in members]
            members = dict(zip(keys if None not in keys and len(set(keys)) == len(keys) else range(len(members)), members, strict=True))
        first = next(iter(members.values()))
        base, steps = None, {}
        for step, m in sorted(members.items()):
            if m.columns != first.columns or [t for _, t in m.to_df().dtypes] != [t for _, t in first.to_df().dtypes]:
                raise ValueError(f"step {step} has other columns")
            steps[step] = m.header.z_range or z_range_of(m.header)
            own = with_angles(m.base, m.header).withColumn(STEP, F.lit(int(step)))
            base = own if base is None else base.unionByName(own)
        units = {"ra": UNITS["deg"], "dec": UNITS["deg"], "theta": UNITS["rad"], "phi": UNITS["rad"]}
        defs = dict(first.defs) | {n: Stored(n, units.get(n), True) for n in ("chi", "phi", "theta", "redshift", "ra", "dec") if n in base.columns and n not in first.defs}
        return cls(base, defs, replace(first.header, is_lightcone=True), [STEP, *first.order], convention=first.convention, steps=steps)

    @classmethod
    def of(cls, df: DataFrame, order: str | Sequence[str], step: str, units: dict | None = None, header: Header | None = None, steps: dict | None = None) -> Lightcone:
        """A stack that is one table already, with a column for the step."""
        header = header or Header(is_lightcone=True)
        made = with_angles(df.withColumn(STEP, F.col(step)), header)
        d = Dataset.from_dataframe(made, order, units, header)
        return cls(made, d.defs, header, [STEP, *d.order], steps=steps)

    @property
    def z_range(self) -> tuple[float, float] | None:
        if self._z_range:
            return self._z_range
        known = [r for r in self.steps.values() if r]
        return (min(r[0] for r in known), max(r[1] for r in known)) if known else None

    def select(self, *columns: Any, mode: str = "global", **derived: Expr) -> Any:
        """As for datasets; ``redshift``, ``ra`` and ``dec`` stay in use, hidden."""
        return super().select(*columns, mode=mode, **derived)

    def drop(self, *columns: str | Iterable[str]) -> Lightcone:
        """Exact names only."""
        names = [n for c in columns for n in ([c] if isinstance(c, str) else c)]
        self._need(names)
        return super().drop(*names)

    def with_redshift_range(self, z_low: float, z_high: float) -> Lightcone:
        """Rows strictly between two redshifts; steps that lie outside are not read."""
        low, high = sorted((z_low, z_high))
        if low == high:
            raise ValueError("a redshift range has some width")
        known = self.z_range
        if known and (high <= known[0] or low >= known[1]):
            raise ValueError(f"the redshifts {low} to {high} are outside of {known}")
        z = self._typed(self.hidden["redshift"], "redshift").column
        base, steps = self.base, {s: r for s, r in self.steps.items() if r is None or r[0] < high and r[1] > low}
        if len(steps) < len(self.steps):
            base = base.filter(F.col(STEP).isin(sorted(steps)))
        z_range = (max(low, known[0]), min(high, known[1])) if known else (low, high)
        return self._with(base=base.filter((z > F.lit(low)) & (z < F.lit(high))), steps=steps, z_range=z_range)

    def cone_search(self, center: Sequence[Any], radius: Any) -> Lightcone:
        return self.bound(regions.make_cone(center, radius))

    def box_search(self, p1: Sequence[Any], p2: Sequence[Any]) -> Lightcone:
        """A rectangle in right ascension and declination."""
        return self.bound(regions.make_skybox(p1, p2))

    def _pixel(self, nside: int):
        healpix.check_nside(nside)
        k = nside.bit_length() - 1
        if PIXEL in self.base.columns and k <= LEVEL:
            return F.shiftright(F.col(PIXEL), 2 * (LEVEL - k))
        ra, dec = (self._typed(self.hidden[n], n, False).column for n in ("ra", "dec"))
        return healpix.pixel_column(nside, ra, dec)

    def with_pixels(self) -> Lightcone:
        """With the nested pixel of each row as a column that regions prune by; sort by it before writing."""
        ra, dec = (self._typed(self.hidden[n], n, False).column for n in ("ra", "dec"))
        return self._with(base=self.base.withColumn(PIXEL, healpix.pixel_column(1 << LEVEL, ra, dec)), key=(PIXEL, LEVEL, 0.0, True))

    def pixel_search(self, pixels: Iterable[int], nside: int = 64) -> Lightcone:
        """Rows in nested pixels."""
        healpix.check_nside(nside)
        wanted = sorted({int(p) for p in pixels})
        if not wanted or wanted[0] < 0 or wanted[-1] >= healpix.npix(nside):
            raise ValueError(f"pixels of nside {nside} are from 0 to {healpix.npix(nside) - 1}")
        region = regions.PixelSet(nside, tuple(wanted))
        return self._with(base=self.base.filter((region.pixel_predicate if PIXEL in self.base.columns else region.computed_predicate)(self._pixel(nside))), region=region)

    def pixels_df(self, nside: int) -> DataFrame:
        return self.base.select(self._pixel(nside).alias("pixel")).distinct()

    def get_pixels(self, nside: int) -> np.ndarray:
        """Occupied pixels, sorted: 12 nside^2 of them at most."""
        return np.array([r[0] for r in self.pixels_df(nside).orderBy("pixel").collect()], np.int64)

    def evaluate(self, func, **kwargs: Any) -> Any:
        """As for datasets; a dict argument whose keys are the steps gives each step its own value."""
        split = [k for k, v in kwargs.items() if isinstance(v, dict) and v and set(v) == set(self.steps)]
        if not split or not kwargs.get("insert", True):
            return super().evaluate(func, **kwargs)
        parts = [Dataset.evaluate(self[s], func, **kwargs | {k: kwargs[k][s] for k in split}) for s in self.steps]
        base = parts[0].base
        for p in parts[1:]:
            base = base.unionByName(p.base)
        return parts[0]._with(base=base, steps=self.steps)

    def keys(self) -> list[int]:
        return list(self.steps)

    def __getitem__(self, step: int) -> Lightcone:
        if step not in self.steps:
            raise KeyError(step)
        return self._with(base=self.base.filter(F.col(STEP) == step), steps={step: self.steps[step]})


def z_range_of(header: Header) -> tuple[float, float] | None:
    """From the steps of the simulation: between a step's redshift and that of the one before."""
    if header.step is None or not {"z_ini", "z_end", "n_steps"} <= set(header.simulation):
        return None
    z = header.step_redshifts
    return (z[header.step], z[header.step - 1]) if 0 < header.step < len(z) else None
