"""Friedmann cosmologies of matter, dark energy and curvature."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

LIGHT_KM_S = 299792.458


@dataclass(frozen=True)
class Cosmology:
    h: float = 0.7
    om0: float = 0.3
    ode0: float | None = None
    w0: float = -1.0
    wa: float = 0.0

    @property
    def dark(self) -> float:
        return 1 - self.om0 if self.ode0 is None else self.ode0

    @property
    def flat(self) -> bool:
        return self.om0 + self.dark == 1.0

    @property
    def name(self) -> str:
        kind = "LambdaCDM" if self.w0 == -1 and self.wa == 0 else "wCDM" if self.wa == 0 else "w0waCDM"
        return ("Flat" if self.flat else "") + kind

    def efunc(self, z):
        z = np.asarray(z, float)
        x, curved = 1 + z, 1 - self.om0 - self.dark
        return np.sqrt(self.om0 * x**3 + curved * x**2 + self.dark * x ** (3 * (1 + self.w0 + self.wa)) * np.exp(-3 * self.wa * z / x))

    def comoving_distance(self, z):
        """In Mpc, by Gauss-Legendre quadrature."""
        z = np.asarray(z, float)
        t, w = np.polynomial.legendre.leggauss(48)
        at = 0.5 * z[..., None] * (t + 1)
        return LIGHT_KM_S / (100 * self.h) * 0.5 * z * (w / self.efunc(at)).sum(axis=-1)

    def redshift_column(self, chi: Column, z_max: float = 10.0, nodes: int = 512) -> Column:
        """Redshift of a comoving distance in Mpc: linear interpolation between nodes, a constant of the plan."""
        z = np.expm1(np.linspace(0, np.log1p(z_max), nodes))
        d = self.comoving_distance(z)
        zs, ds = F.array(*[F.lit(float(x)) for x in z]), F.array(*[F.lit(float(x)) for x in d])
        # nodes below chi: the table ascends, so counting finds the place
        i = F.greatest(F.lit(1), F.least(F.lit(nodes - 1), F.size(F.filter(ds, lambda x: x <= chi))))
        x0, x1, y0, y1 = F.element_at(ds, i), F.element_at(ds, i + 1), F.element_at(zs, i), F.element_at(zs, i + 1)
        return y0 + (chi - x0) / (x1 - x0) * (y1 - y0)


def step_redshifts(z_ini: float, z_end: float, n_steps: int) -> list[float]:
    """Redshifts of steps whose scale factors are evenly spaced, to 3 decimals."""
    a = np.linspace(1 / (1 + z_ini), 1 / (1 + z_end), n_steps + 1)[1:]
    return [round(float(1 / x - 1), 3) for x in a]
