"""Units, quantities and unit conventions.

A unit is a factor, powers of base dimensions and a power of h (the Hubble constant over 100 km/s/Mpc),
which is a dimension of its own.  Logarithmic units (dex, mag) wrap a plain one.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field, replace

from .errors import UnitConversionError, UnitsError

CONVENTIONS = ("comoving", "physical", "scalefree", "unitless")
Dims = tuple[tuple[str, float], ...]


def _combine(a: Dims, b: Dims, sign: float = 1) -> Dims:
    out = dict(a)
    for k, v in b:
        out[k] = out.get(k, 0) + sign * v
    return tuple(sorted((k, v) for k, v in out.items() if abs(v) > 1e-12))


@dataclass(frozen=True)
class Unit:
    """``scale`` base units of ``dims``; ``h`` is among the dims.  ``log``: "dex" or "mag", None for plain units."""

    scale: float = 1.0
    dims: Dims = ()
    log: str | None = None
    name: str = field(default="", compare=False)

    def _plain(self, other: Unit) -> None:
        if self.log or other.log:
            raise UnitsError("logarithmic units can't be multiplied")

    def __mul__(self, other):
        if not isinstance(other, Unit):
            return Quantity(other, self)
        self._plain(other)
        return Unit(self.scale * other.scale, _combine(self.dims, other.dims))

    __rmul__ = __mul__

    def __truediv__(self, other: Unit) -> Unit:
        self._plain(other)
        return Unit(self.scale / other.scale, _combine(self.dims, other.dims, -1))

    def __pow__(self, p: float) -> Unit:
        self._plain(self)
        return Unit(self.scale**p, tuple((k, v * p) for k, v in self.dims if v * p))

    def power(self, dim: str) -> float:
        return dict(self.dims).get(dim, 0.0)

    @property
    def dimensionless(self) -> bool:
        return not self.dims and not self.log

    def equivalent(self, other: Unit) -> bool:
        return self.dims == other.dims and self.log == other.log

    def same(self, other: Unit) -> bool:
        return self.equivalent(other) and math.isclose(self.scale, other.scale, rel_tol=1e-12)

    def factor(self, other: Unit) -> float:
        """What values in this unit are multiplied by to be in ``other``; log units: what is added."""
        if not self.equivalent(other):
            raise UnitConversionError(f"{self} is no {other}")
        ratio = self.scale / other.scale
        if self.log:
            return math.log10(ratio) * (1 if self.log == "dex" else -2.5)
        return ratio

    def without(self, dim: str) -> Unit:
        return replace(self, dims=tuple(d for d in self.dims if d[0] != dim), name="")

    def __str__(self) -> str:
        if self.name:
            return self.name
        parts = [f"{k}^{v:g}" if v != 1 else k for k, v in self.dims]
        plain = " ".join(([f"{self.scale:g}"] if self.scale != 1 else []) + parts)
        return f"{self.log}({plain})" if self.log else plain


@dataclass(frozen=True)
class Quantity:
    value: float
    unit: Unit

    def to(self, unit: Unit | str) -> float:
        f = self.unit.factor(as_unit(unit))
        return self.value + f if self.unit.log else self.value * f


def _base(name: str, scale: float = 1.0, dim: str | None = None, log: str | None = None) -> Unit:
    return Unit(scale, ((dim or name, 1.0),) if dim != "" else (), log, name)


#: Fixed values (SI; IAU 2015 nominal solar mass and parsec, CODATA 2018 proton mass).
PARSEC, SOLAR_MASS, YEAR, PROTON_MASS, ELECTRONVOLT, BOLTZMANN = 3.0856775814913674e16, 1.988409870698051e30, 31557600.0, 1.67262192369e-27, 1.602176634e-19, 1.380649e-23
UNITS: dict[str, Unit] = {
    u.name: u
    for u in (
        _base("m"), _base("cm", 1e-2, "m"), _base("km", 1e3, "m"), _base("pc", PARSEC, "m"), _base("kpc", 1e3 * PARSEC, "m"), _base("Mpc", 1e6 * PARSEC, "m"), _base("Gpc", 1e9 * PARSEC, "m"),
        _base("kg"), _base("g", 1e-3, "kg"), _base("Msun", SOLAR_MASS, "kg"), _base("m_p", PROTON_MASS, "kg"),
        _base("s"), _base("yr", YEAR, "s"), _base("Myr", 1e6 * YEAR, "s"), _base("Gyr", 1e9 * YEAR, "s"),
        _base("K"), _base("rad"), _base("deg", math.pi / 180, "rad"), _base("arcmin", math.pi / 10800, "rad"), _base("arcsec", math.pi / 648000, "rad"),
        _base("littleh", 1.0, "h"), _base("mag", 1.0, "", "mag"), _base("dex", 1.0, "", "dex"),
        Unit(1.0, (("kg", 1.0), ("m", 2.0), ("s", -2.0)), None, "J"), Unit(1e-7, (("kg", 1.0), ("m", 2.0), ("s", -2.0)), None, "erg"),
        Unit(ELECTRONVOLT, (("kg", 1.0), ("m", 2.0), ("s", -2.0)), None, "eV"), Unit(1e3 * ELECTRONVOLT, (("kg", 1.0), ("m", 2.0), ("s", -2.0)), None, "keV"),
    )
}
ALIASES = {"h": "littleh", "solMass": "Msun", "M_sun": "Msun", "Kelvin": "K", "degree": "deg", "dimensionless": ""}
#: Stored spellings that the grammar below does not read by itself.  H0^-1 is 1 Mpc / (100 h km/s).
SPELLINGS = {"H0^-1": "H0", "m_hydrogen": "m_p", "log10(erg/s)": "dex(erg/s)"}
_TOKEN = re.compile(r"\s*(?:([A-Za-z_][A-Za-z_0-9]*)|(\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)|(\*\*|\^|[*/()-]))")


class _Parser:
    """Products, quotients, powers, brackets; names side by side are multiplied; the word comoving means nothing."""

    def __init__(self, text: str):
        self.tokens: list[str] = []
        at = 0
        text = text.strip()
        while at < len(text):
            if not (m := _TOKEN.match(text, at)):
                raise UnitsError(f"unit {text!r}")
            if m[0].strip() != "comoving":
                self.tokens.append(m[0].strip())
            at = m.end()
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1]

    def product(self) -> Unit:
        out = self.raised()
        while (t := self.peek()) and t != ")":
            if t in "*/":
                self.take()
            out = out / self.raised() if t == "/" else out * self.raised()
        return out

    def raised(self) -> Unit:
        out = self.atom()
        if self.peek() in ("**", "^"):
            self.take()
            bracket = self.peek() == "(" and bool(self.take())
            sign = -1 if self.peek() == "-" and self.take() else 1
            out = out ** (sign * float(self.take()))
            if bracket and self.take() != ")":
                raise UnitsError("bracket")
        return out

    def atom(self) -> Unit:
        if not self.peek():
            raise UnitsError("unit ends early")
        t = self.take()
        if t == "(":
            out = self.product()
            if not self.peek() or self.take() != ")":
                raise UnitsError("bracket")
            return out
        if t in ("dex", "mag") and self.peek() == "(":
            self.take()
            inner = self.product() if self.peek() != ")" else Unit()
            self.take()
            return replace(inner, log=t, name="")
        if t[0].isdigit():
            return Unit(float(t))
        t = ALIASES.get(t, t)
        if t not in UNITS:
            raise UnitsError(f"unit {t!r}")
        return UNITS[t]


def as_unit(x: Unit | str) -> Unit:
    """The unit of a string; unknown ones raise UnitsError."""
    if isinstance(x, Unit):
        return x
    spelt = SPELLINGS.get(x.strip(), x)
    if spelt == "H0":
        return Unit(1e6 * PARSEC / 1e5, (("h", -1.0), ("s", 1.0)), None, "H0^-1")
    p = _Parser(spelt)
    out = p.product() if p.tokens else Unit()
    if p.peek():
        raise UnitsError(f"unit {x!r}")
    return replace(out, name=x.strip())


def stored_unit(text: str | None) -> Unit | None:
    """The unit of a stored string; none, or one that can't be read, makes a column unitless."""
    if not text:
        return None
    try:
        return as_unit(text)
    except UnitsError:
        return None


def u(text: str) -> Unit:
    """``5 * u("Mpc")`` is a quantity."""
    return as_unit(text)


@dataclass(frozen=True)
class Transition:
    """Values times ``factor`` and ``a`` to the ``a_power``, plus ``shift`` for log units, are in ``unit``."""

    unit: Unit | None
    factor: float = 1.0
    a_power: float = 0.0
    shift: float = 0.0


def transition(unit: Unit | None, stored: str, wanted: str, h: float) -> Transition:
    """From a stored convention to another.

    scalefree to comoving multiplies by h to the power of h in the unit, comoving to physical by the
    scale factor to the power of length.  Nothing leads back to scalefree from a stored comoving column: UnitsError."""
    if wanted not in CONVENTIONS:
        raise ValueError(f"convention {wanted!r}: one of {', '.join(CONVENTIONS)}")
    if unit is None or wanted == stored or stored in ("physical", "unitless") and wanted != "scalefree":
        return Transition(None if wanted == "unitless" else unit)
    if wanted == "unitless":
        return Transition(None)
    if wanted == "scalefree":
        raise UnitsError(f"a column stored as {stored} has no scalefree form")
    p = unit.power("h") if stored == "scalefree" else 0.0
    clean = unit.without("h") if stored == "scalefree" else unit
    length = clean.power("m") if wanted == "physical" else 0.0
    if unit.log:
        step = 1.0 if unit.log == "dex" else -2.5
        return Transition(clean, shift=step * p * math.log10(h)) if not length else Transition(clean, shift=step * p * math.log10(h), a_power=length)
    return Transition(clean, factor=h**p, a_power=length)
