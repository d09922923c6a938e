"""Expressions over columns: arithmetic, functions, reductions and masks, compiled to Spark columns with units.

Trees are immutable and name columns; a dataset compiles them with a context that knows its columns'
definitions.  A reduction is a scalar subquery over the rows of the moment, so it can be used in rows.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, replace
from typing import Any, Protocol

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import numeric
from .errors import UnitsError
from .units import UNITS, Quantity, Unit


@dataclass
class Typed:
    """A compiled column, its unit, and whether it may hold NaN."""

    column: Column
    unit: Unit | None
    floating: bool = True
    literal: bool = False
    #: The stored column and the factor it was multiplied by, if that is all.
    raw: tuple[Column, float] | None = None


class Context(Protocol):
    def column(self, name: str) -> Typed: ...

    def scalar(self, node: Reduction) -> Typed: ...


def wrap(x: Any) -> Expr:
    if isinstance(x, Expr):
        return x
    if isinstance(x, Quantity):
        if not isinstance(x.value, (int, float)):
            raise ValueError("only scalar quantities can be used in expressions")
        return Literal(float(x.value), x.unit)
    if isinstance(x, Unit):
        return Literal(1.0, x)
    if isinstance(x, bool) or not isinstance(x, (int, float)):
        raise ValueError(f"{x!r} is no number, quantity or expression")
    return Literal(x, None)


class Expr:
    """Operators make new trees.  There is no negation, absolute value, remainder or floor division."""

    def __add__(self, o): return Binary("+", self, wrap(o))
    def __radd__(self, o): return Binary("+", wrap(o), self)
    def __sub__(self, o): return Binary("-", self, wrap(o))
    def __rsub__(self, o): return Binary("-", wrap(o), self)
    def __mul__(self, o): return Binary("*", self, wrap(o))
    def __rmul__(self, o): return Binary("*", wrap(o), self)
    def __truediv__(self, o): return Binary("/", self, wrap(o))
    def __rtruediv__(self, o): return Binary("/", wrap(o), self)
    def __pow__(self, o): return Binary("**", self, wrap(o))

    def __eq__(self, o): return Compare("==", self, wrap(o))
    def __ne__(self, o): return Compare("!=", self, wrap(o))
    def __lt__(self, o): return Compare("<", self, wrap(o))
    def __le__(self, o): return Compare("<=", self, wrap(o))
    def __gt__(self, o): return Compare(">", self, wrap(o))
    def __ge__(self, o): return Compare(">=", self, wrap(o))
    __hash__ = object.__hash__

    def isin(self, values: Iterable): return IsIn(self, tuple(values))

    def log10(self, log: str = "dex"): return Call("log10", (self,), log)
    def exp10(self, log: str = "dex"): return Call("exp10", (self,), log)
    def sqrt(self): return Call("sqrt", (self,))
    def arcsin(self): return Call("arcsin", (self,))
    def arccos(self): return Call("arccos", (self,))
    def arctan2(self, o): return Call("arctan2", (self, wrap(o)))

    def mean(self): return Reduction("mean", self)
    def std(self): return Reduction("std", self)
    def var(self): return Reduction("var", self)
    def min(self): return Reduction("min", self)
    def max(self): return Reduction("max", self)
    def median(self): return Reduction("median", self)
    def sum(self): return Reduction("sum", self)
    def quantile(self, q: float, approximate: bool = False): return Reduction("quantile", self, q, approximate)

    def parents(self) -> tuple[Expr, ...]:
        return ()

    def names(self) -> set[str]:
        """Columns that the expression reads, in reductions too."""
        return set().union(*[p.names() for p in self.parents()])

    @property
    def scalar(self) -> bool:
        """Whether it has one value for all rows."""
        return all(p.scalar for p in self.parents())

    @property
    def reduces(self) -> bool:
        return any(p.reduces for p in self.parents())

    def compile(self, ctx: Context) -> Typed:
        raise NotImplementedError

    def __repr__(self) -> str:
        return f"Column [ {self.show()} ]"

    def show(self) -> str:
        raise NotImplementedError


class Name(Expr):
    """A column; ``alias`` renames it in ``select``."""

    def __init__(self, name: str, as_: str | None = None):
        self.name, self.renamed = name, as_

    def alias(self, name: str) -> Name:
        return Name(self.name, name)

    def names(self): return {self.name}
    scalar = False

    def compile(self, ctx): return ctx.column(self.name)
    def show(self): return self.name


class Literal(Expr):
    def __init__(self, value: float, unit: Unit | None):
        self.value, self.unit = value, unit

    scalar = True

    def compile(self, ctx): return Typed(F.lit(self.value), self.unit, isinstance(self.value, float) and self.value != self.value, True)
    def show(self): return f"{self.value:g}" + (f" {self.unit}" if self.unit else "")


def _converted(x: Typed, unit: Unit | None) -> Column:
    """The values of ``x`` in an equivalent unit."""
    if x.unit is None or unit is None or x.unit.same(unit):
        return x.column
    f = x.unit.factor(unit)
    return x.column + F.lit(f) if x.unit.log else x.column * F.lit(f)


class Binary(Expr):
    def __init__(self, op: str, a: Expr, b: Expr):
        self.op, self.a, self.b = op, a, b

    def parents(self): return self.a, self.b

    def compile(self, ctx):
        a, b = self.a.compile(ctx), self.b.compile(ctx)
        ua, ub = a.unit or Unit(), b.unit or Unit()
        floating = a.floating or b.floating or self.op in ("/", "**")
        if self.op in "+-":
            out = self._sum(a, b)
        elif self.op == "**":
            if not ub.dimensionless or not self.b.scalar:
                raise UnitsError("an exponent is a number")
            if a.unit and not isinstance(self.b, Literal):
                raise UnitsError("a unit is raised to a plain number")
            return Typed(numeric.power(a.column, b.column), a.unit ** self.b.value if a.unit else None)
        elif self.op == "*":
            out = Typed(a.column * b.column, ua * ub)
        else:
            out = Typed(numeric.divide(a.column, b.column), ua / ub)
        unit = out.unit
        if unit is not None and unit.dimensionless and self.op in "*/":
            # a ratio of like units is a plain number
            column = out.column * F.lit(unit.scale) if unit.scale != 1 else out.column
            return Typed(column, None, floating)
        return Typed(out.column, unit, floating)

    def _sum(self, a: Typed, b: Typed) -> Typed:
        apply = (lambda x, y: x + y) if self.op == "+" else (lambda x, y: x - y)
        ua, ub = a.unit, b.unit
        if ua and ub and ua.log and ub.log:
            return Typed(apply(a.column, b.column), ua)
        if (ua is None) != (ub is None) and not (ua or ub).dimensionless:
            raise UnitsError(f"{ua or 'no unit'} {self.op} {ub or 'no unit'}")
        if ua and ub:
            if not ua.equivalent(ub):
                raise UnitsError(f"{ua} {self.op} {ub}")
            if not ua.same(ub) and not (a.literal or b.literal):
                raise UnitsError(f"{ua} {self.op} {ub}: convert one first")
            if a.literal and not b.literal:
                return Typed(apply(_converted(a, ub), b.column), ub)
            return Typed(apply(a.column, _converted(b, ua)), ua)
        return Typed(apply(a.column, b.column), ua or ub)

    def show(self): return f"({self.a.show()} {self.op} {self.b.show()})"


class Call(Expr):
    def __init__(self, name: str, args: tuple[Expr, ...], log: str = "dex"):
        self.name, self.args, self.log = name, args, log

    def parents(self): return self.args

    def compile(self, ctx):
        a = self.args[0].compile(ctx)
        x, plain = a.column.cast("double"), a.unit is None or a.unit.dimensionless
        if self.name == "log10":
            if a.unit and a.unit.log:
                raise ValueError("the logarithm of a logarithm")
            k = -2.5 if self.log == "mag" else 1.0
            return Typed(numeric.log10(x) * F.lit(k) if k != 1 else numeric.log10(x), None if a.unit is None else replace(a.unit, log=self.log, name=""))
        if self.name == "exp10":
            if a.unit and a.unit.log != self.log:
                raise ValueError(f"{a.unit} is no {self.log}")
            k = -0.4 if self.log == "mag" and a.unit else 1.0
            return Typed(F.pow(F.lit(10.0), x * F.lit(k) if k != 1 else x), None if a.unit is None or not a.unit.dims else replace(a.unit, log=None, name=""))
        if self.name == "sqrt":
            return Typed(F.sqrt(x), a.unit**0.5 if a.unit else None)
        if self.name in ("arcsin", "arccos"):
            if not plain:
                raise UnitsError(f"{self.name} of {a.unit}")
            return Typed((F.asin if self.name == "arcsin" else F.acos)(x), UNITS["rad"])
        b = self.args[1].compile(ctx)
        if (a.unit is None) != (b.unit is None) and not (plain and (b.unit is None or b.unit.dimensionless)):
            raise UnitsError(f"arctan2 of {a.unit} and {b.unit}")
        if a.unit and b.unit and not a.unit.equivalent(b.unit):
            raise UnitsError(f"arctan2 of {a.unit} and {b.unit}")
        return Typed(F.atan2(x, _converted(b, a.unit).cast("double")), UNITS["rad"])

    def show(self): return f"{self.name}({', '.join(a.show() for a in self.args)})"


class Reduction(Expr):
    """One value of all rows.  Variances are those of the population; quantiles interpolate, or are approximate if asked for."""

    def __init__(self, name: str, arg: Expr, q: float | None = None, approximate: bool = False):
        if name == "quantile" and not 0 <= q <= 1:
            raise ValueError("a quantile is between 0 and 1")
        self.name, self.arg, self.q, self.approximate = name, arg, q, approximate

    scalar = reduces = True

    @property
    def exact_quantile(self) -> float | None:
        return None if self.approximate else 0.5 if self.name == "median" else self.q if self.name == "quantile" else None

    def parents(self): return (self.arg,)
    def compile(self, ctx): return ctx.scalar(self)

    def aggregate(self, x: Typed) -> Typed:
        c, u = x.column, x.unit
        match self.name:
            case "mean": out = F.avg(c)
            case "std": out = F.stddev_pop(c)
            case "var": return Typed(F.var_pop(c), u**2 if u else None)
            case "min": out = numeric.least(c) if x.floating else F.min(c)
            case "max": out = F.max(c)
            case "median": out = F.median(c)
            case "sum": out = F.sum(c.cast("double") if x.floating else c)
            case _: out = F.percentile_approx(c, F.lit(self.q), F.lit(10000)) if self.approximate else F.percentile(c, F.lit(self.q))
        return Typed(out, u, x.floating or self.name not in ("min", "max", "sum"))

    def show(self): return f"{self.name}({self.arg.show()}{f', {self.q}' if self.q is not None else ''})"


class Mask:
    """A predicate; masks are joined by ``&`` and ``|`` only."""

    def __and__(self, o): return Both("&", self, o)
    def __or__(self, o): return Both("|", self, o)


class Compare(Mask):
    def __init__(self, op: str, a: Expr, b: Expr):
        self.op, self.a, self.b = op, a, b

    def names(self): return self.a.names() | self.b.names()

    def compile(self, ctx) -> Column:
        a, b = self.a.compile(ctx), self.b.compile(ctx)
        flip = {"<": ">", ">": "<", "<=": ">=", ">=": "<="}
        op = self.op
        if a.literal and not b.literal:
            a, b, op = b, a, flip.get(op, op)
        right = b.column
        if a.unit and b.unit:  # the other side, often a constant, is converted, so that the column can be pushed down
            right = _converted(b, a.unit)
        elif b.unit and not b.unit.dimensionless and not b.literal:
            right = b.column  # a bare number or unitless column is in the column's own units
        elif b.unit and not b.unit.dimensionless and a.unit is None:
            raise UnitsError(f"a column without a unit against {b.unit}")
        return numeric.compare(op, a.column, right, [x for x, t in ((a.column, a), (right, b)) if t.floating and not t.literal])


class IsIn(Mask):
    def __init__(self, a: Expr, values: tuple):
        self.a, self.values = a, values

    def names(self): return self.a.names()

    def compile(self, ctx) -> Column:
        a = self.a.compile(ctx)
        own = [v.to(a.unit) if isinstance(v, Quantity) else v for v in self.values]
        return a.column.isin([v.item() if hasattr(v, "item") else v for v in own]) if own else F.lit(False)


class Both(Mask):
    def __init__(self, op: str, a: Mask, b: Mask):
        if not isinstance(a, Mask) or not isinstance(b, Mask):
            raise ValueError("only masks can be joined")
        self.op, self.a, self.b = op, a, b

    def names(self): return self.a.names() | self.b.names()

    def compile(self, ctx) -> Column:
        a, b = self.a.compile(ctx), self.b.compile(ctx)
        return a & b if self.op == "&" else a | b


def col(name: str) -> Name:
    return Name(name)


def norm_cols(*columns: str | Expr) -> Expr:
    """The Euclidean norm of two or more columns."""
    cols = [wrap(col(c) if isinstance(c, str) else c) for c in columns]
    if len(cols) < 2:
        raise ValueError("a norm takes two columns or more")
    total = cols[0] ** 2
    for c in cols[1:]:
        total = total + c**2
    return total.sqrt()


def offset_3d(a: str, b: str, axes: Iterable[str] = ("x", "y", "z")) -> Expr:
    """The distance of two points whose coordinates are ``{a}_{axis}`` and ``{b}_{axis}``."""
    return norm_cols(*[col(f"{a}_{x}") - col(f"{b}_{x}") for x in axes])


def add_mag_cols(*columns: str) -> Expr:
    """The magnitude of the sum of two or more fluxes that are given as magnitudes."""
    if len(columns) < 2:
        raise ValueError("a sum of magnitudes takes two columns or more")
    return MagnitudeSum(tuple(col(c) for c in columns))


class MagnitudeSum(Expr):
    def __init__(self, args: tuple[Expr, ...]):
        self.args = args

    def parents(self): return self.args

    def compile(self, ctx):
        parts = [a.compile(ctx) for a in self.args]
        units = [p.unit for p in parts]
        if any(x is not None and x.log != "mag" for x in units):
            raise UnitsError("magnitudes are wanted")
        flux = F.pow(F.lit(10.0), parts[0].column * F.lit(-0.4))
        for p in parts[1:]:
            flux = flux + F.pow(F.lit(10.0), p.column * F.lit(-0.4))
        return Typed(numeric.log10(flux) * F.lit(-2.5), units[0])

    def show(self): return f"add_mag({', '.join(a.show() for a in self.args)})"


#: Solar metallicity, adiabatic index.
SOLAR_METALLICITY, GAMMA = 0.0127, 5 / 3


def mean_molecular_weight(helium: str = "yhe", metals: str = "zmet") -> Expr:
    """1 / (2 X + 0.75 Y + Z / 32), with X = 1 - Y."""
    y = col(helium)
    return 1 / (2 * (1 - y) + 0.75 * y + col(metals) * SOLAR_METALLICITY / 32)


def gas_temperature(energy: str = "uu") -> Expr:
    """In K, of specific energies in (km/s)^2: weight * m_p * u / k_B * (gamma - 1)."""
    from .units import BOLTZMANN, PROTON_MASS

    return mean_molecular_weight() * col(energy) * (PROTON_MASS * 1e6 / BOLTZMANN * (GAMMA - 1))


def gas_number_density(density: str = "rho") -> Expr:
    """Particles per volume, of densities of mass: rho / (weight * m_p)."""
    from .units import PROTON_MASS

    return col(density) / (mean_molecular_weight() * PROTON_MASS)


def emission_measure(density: str = "rho", mass: str = "mass", helium: str = "yhe") -> Expr:
    """n_e * n_H * (mass / rho), with n_e = (1 - Y / 2) rho / m_p and n_H = (1 - Y) rho / m_p."""
    from .units import PROTON_MASS

    y, per = col(helium), col(density) / PROTON_MASS
    return (1 - 0.5 * y) * per * ((1 - y) * per) * (col(mass) / col(density))
