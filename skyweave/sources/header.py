"""Headers: what a dataset is, and the simulation and cosmology it comes from, as JSON beside the data."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field, replace
from typing import Any

from ..functions.units import CONVENTIONS, Quantity, u
from ..plans import regions
from ..plans.cosmology import Cosmology, step_redshifts

#: Kinds of data.
DATA_TYPES = ("galaxy_properties", "galaxy_particles", "halo_properties", "halo_profiles", "halo_particles", "synthetic_galaxies", "healpix_map")
#: Names of cosmological parameters in stored headers.
PARAMETER_ALIASES = {"omega_m": "om0", "omega_l": "ode0", "w_0": "w0", "w_a": "wa"}


@dataclass(frozen=True)
class Header:
    data_type: str = "halo_properties"
    unit_convention: str = "comoving"
    is_lightcone: bool = False
    redshift: float = 0.0
    step: int | None = None
    z_range: tuple[float, float] | None = None
    region: regions.Region | None = None
    cosmology: Cosmology = field(default_factory=Cosmology)
    simulation: dict[str, Any] = field(default_factory=dict)
    healpix: dict[str, Any] = field(default_factory=dict)
    load_if: dict[str, bool] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.data_type.endswith("_fits"):  # fits of galaxies to a simulation read as galaxies
            object.__setattr__(self, "data_type", "synthetic_galaxies")
        if self.data_type not in DATA_TYPES:
            raise ValueError(f"data type {self.data_type!r}")
        if self.unit_convention not in CONVENTIONS:
            raise ValueError(f"unit convention {self.unit_convention!r}")
        if self.data_type == "healpix_map" and "nside" not in self.healpix:
            raise ValueError("a map's header has its nside")

    @property
    def scale_factor(self) -> float:
        return 1 / (1 + self.redshift)

    @property
    def step_redshifts(self) -> list[float]:
        s = self.simulation
        return step_redshifts(s["z_ini"], s["z_end"], s["n_steps"])

    def parameter(self, name: str, convention: str | None = None) -> Any:
        """A parameter of the simulation; ``box_size`` (Mpc/h) and ``agn_seed_mass`` (Msun/h) follow a convention."""
        value = self.simulation[name]
        if name not in ("box_size", "agn_seed_mass") or convention == "unitless":
            return value
        unit = "Mpc" if name == "box_size" else "Msun"
        if convention == "scalefree":
            return Quantity(value, u(f"{unit}/h"))
        value /= self.cosmology.h
        return Quantity(value * self.scale_factor if convention == "physical" and unit == "Mpc" else value, u(unit))

    def with_parameters(self, **changes: Any) -> Header:
        return replace(self, **changes)

    def dump(self) -> dict:
        out = asdict(self) | {"cosmology": asdict(self.cosmology), "region": self.region.dump() if self.region else None}
        return {k: list(v) if isinstance(v, tuple) else v for k, v in out.items()}

    @staticmethod
    def load(x: dict) -> Header:
        """Unknown fields are a ValueError."""
        x = dict(x)
        if unknown := set(x) - set(Header.__dataclass_fields__):
            raise ValueError(f"unknown header fields: {', '.join(sorted(unknown))}")
        x["cosmology"] = Cosmology(**{PARAMETER_ALIASES.get(k, k): v for k, v in (x.get("cosmology") or {}).items()})
        x["region"] = regions.load(x["region"]) if x.get("region") else None
        x["z_range"] = tuple(x["z_range"]) if x.get("z_range") else None
        return Header(**x)
