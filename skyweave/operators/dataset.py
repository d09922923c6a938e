"""Lazy, immutable, unit-aware tables over Spark DataFrames.

A dataset holds the rows of a moment (``base``, with columns as stored) and a definition of each
public column: a stored column, or an expression bound to the definitions of its time.  Verbs make
new plans; only ``get_data``, ``rows``, ``len`` and writing run them.  Conversions of units are part of the
projection, and predicates against constants convert the constant, so that they reach the scan.
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.errors import MissingColumnError, UnitConversionError
from ..functions.expr import Both, Compare, Expr, IsIn, Literal, Mask, Name, Reduction, Typed, col, wrap
from ..functions.units import Quantity, Unit, as_unit, transition
from ..plans import hooks, octree, quantiles, regions
from ..plans.positions import with_position
from ..sources.header import Header

META = "__meta_"
#: Columns that hold a row's scale factor or redshift.
SCALE_FACTOR, REDSHIFTS = "fof_halo_center_a", ("redshift", "redshift_true")
FORMATS = ("spark", "pandas", "numpy", "arrow", "polars", "jax")
#: Rows that ``take_rows`` sends along as a literal list; more are joined.
LITERAL_ROWS = 10_000
#: Rows up to which a top-k, which ends in one task, is used; beyond, rows are numbered within ranges.
TOP_ROWS = 100_000


@dataclass(frozen=True)
class Stored:
    """A column of ``base``.  Static ones, such as results of functions, do not follow conventions."""

    name: str
    unit: Unit | None = None
    static: bool = False
    description: str = ""


@dataclass(frozen=True)
class Derived:
    """An expression and the definitions that its names had when it was made."""

    expr: Expr
    env: dict[str, Stored | Derived]
    description: str = ""

    @property
    def reduces(self) -> bool:
        return self.expr.reduces or any(isinstance(d := self.env.get(n), Derived) and d.reduces for n in self.expr.names())


Definition = Stored | Derived


@dataclass(frozen=True)
class Evaluated:
    """A function of rows as a column of ``select`` and ``with_new_columns``; ``options``: those of ``evaluate``."""

    func: Callable
    options: dict[str, Any] = field(default_factory=dict)

    def inputs(self, ds: Dataset) -> list[str]:
        from .evaluate import arguments

        return arguments(self.func, ds.columns, {k: v for k, v in self.options.items() if k not in ("vectorize", "format", "batch_size", "elementwise")})


@dataclass(frozen=True)
class Conversions:
    blanket: tuple[tuple[Unit, Unit], ...] = ()
    columns: dict[str, Unit] = field(default_factory=dict)


def check_mode(mode: str) -> None:
    if mode not in ("global", "local"):
        raise ValueError(f"mode {mode!r}: global or local, which are the same here")


def matching(names: Iterable[str], pattern: str) -> list[str]:
    """Columns that a name with ``*`` stands for; other characters have their regular-expression meaning."""
    return [n for n in names if re.fullmatch(pattern.replace("*", ".*"), n)]


class _Compiler:
    """Compiles expressions for a dataset, with names as ``env`` defines them."""

    def __init__(self, ds: Dataset, env: dict[str, Definition], convert: bool = True):
        self.ds, self.env, self.convert = ds, env, convert

    def column(self, name: str) -> Typed:
        if name not in self.env:
            raise MissingColumnError(f"no column {name!r}")
        return self.ds._typed(self.env[name], name, self.convert)

    def scalar(self, node: Reduction) -> Typed:
        x = node.arg.compile(self)
        made = node.aggregate(x)
        if (q := node.exact_quantile) is not None:
            return replace(made, column=quantiles.exact(self.ds.base, x.column, q).scalar())
        return replace(made, column=self.ds.base.agg(made.column.alias("v")).scalar())


class Dataset:
    """See the module's text.  ``order``: columns of ``base`` whose values tell rows apart and give their order.

    ``key``: the name of a spatial key in ``base``, its level, the size of the box, and whether it is computed rather than stored."""

    kind = "Dataset"

    def __init__(self, base: DataFrame, defs: dict[str, Definition], header: Header, order: Sequence[str], *, convention: str = "comoving", conversions: Conversions | None = None, sort: tuple[str, Definition, bool] | None = None, region: regions.Region | None = None, coords: Sequence[str] | None = None, key: tuple | None = None):
        self.base, self.defs, self.header, self.order = base, defs, header, tuple(order)
        self.convention, self.conversions, self.sort = convention, conversions or Conversions(), sort
        self._region, self.coords, self.key = region, coords, key

    # -- making

    @classmethod
    def from_dataframe(cls, df: DataFrame, order: str | Sequence[str], units: dict[str, str | Unit] | None = None, header: Header | None = None, coords: Sequence[str] | None = None, descriptions: dict[str, str] | None = None, **more: Any) -> Dataset:
        """A dataset of a DataFrame, whose ``order`` columns tell rows apart.  ``__`` columns are hidden."""
        units, descriptions = units or {}, descriptions or {}
        if unknown := (set(units) | set(descriptions)) - set(df.columns):
            raise MissingColumnError(f"no column {', '.join(sorted(unknown))}")
        defs = {c: Stored(c, as_unit(units[c]) if units.get(c) else None, False, descriptions.get(c, "")) for c in df.columns if not c.startswith("__")}
        return cls(df, defs, header or Header(), [order] if isinstance(order, str) else order, coords=coords, **more)

    def _with(self, **changes: Any) -> Dataset:
        state = dict(base=self.base, defs=self.defs, header=self.header, order=self.order, convention=self.convention, conversions=self.conversions, sort=self.sort, region=self._region, coords=self.coords, key=self.key) | self._extra() | changes
        return type(self)(state.pop("base"), state.pop("defs"), state.pop("header"), state.pop("order"), **state)

    def _extra(self) -> dict[str, Any]:
        return {}

    # -- compiling

    def _typed(self, d: Definition, name: str, convert: bool = True) -> Typed:
        if isinstance(d, Derived):
            out = d.expr.compile(_Compiler(self, d.env, convert))
            if not convert or out.unit is None:
                return replace(out, unit=None) if self.convention == "unitless" else out
            return self._converted(out, name)
        kind = self.base.schema[d.name].dataType
        floating, c = isinstance(kind, (T.FloatType, T.DoubleType)), F.col(f"`{d.name}`")
        if d.unit is None:
            return Typed(c, None, floating)
        stored = self.header.unit_convention
        move = transition(d.unit, stored, stored if d.static else self.convention, self.header.cosmology.h)
        out, factor = c, move.factor
        if move.shift:
            out = out + F.lit(move.shift)
        if move.a_power and not d.unit.log:
            a = self._scale_factor()
            if isinstance(a, float):
                factor *= a**move.a_power
            else:
                out = out * F.pow(a, F.lit(float(move.a_power)))
        elif move.a_power:
            a, k = self._scale_factor(), move.a_power * (1 if d.unit.log == "dex" else -2.5)
            out = out + (F.lit(k * float(np.log10(a))) if isinstance(a, float) else F.lit(k) * F.log10(a))
        typed = Typed(out * F.lit(factor) if factor != 1 else out, move.unit, floating or factor != 1 or bool(move.a_power or move.shift))
        typed.raw = (c, factor) if out is c else None
        return self._converted(typed, name) if convert and self.convention != "unitless" else typed

    def _converted(self, x: Typed, name: str) -> Typed:
        target = self.conversions.columns.get(name)
        if target is None:
            target = next((new for old, new in self.conversions.blanket if x.unit is not None and x.unit.same(old)), None)
        if target is None or x.unit is None or x.unit.same(target):
            return x if target is None or x.unit is None else replace_typed(x, target, 1.0)
        return replace_typed(x, target, x.unit.factor(target))

    def _scale_factor(self) -> Column | float:
        if SCALE_FACTOR in self.base.columns:
            return F.col(SCALE_FACTOR)
        for z in REDSHIFTS:
            if z in self.base.columns:
                return F.lit(1.0) / (F.lit(1.0) + F.col(z))
        return self.header.scale_factor

    def _compiler(self) -> _Compiler:
        return _Compiler(self, self.defs)

    def _need(self, names: Iterable[str]) -> None:
        if missing := sorted(set(names) - set(self.defs)):
            raise MissingColumnError(f"no column {', '.join(missing)}; there are {', '.join(self.defs)}")

    def _mask(self, masks: Sequence[Mask]) -> Column:
        out = None
        for m in masks:
            if not isinstance(m, Mask):
                raise ValueError(f"{m!r} is no mask")
            self._need(m.names())
            one = _pushed(m, self._compiler())
            out = one if out is None else out & one
        return out

    def _keys(self) -> list[tuple[Column, bool]]:
        """Keys of the current order and whether they descend; ties of a sort go by the rows' own order."""
        sort = [(self._typed(self.sort[1], self.sort[0]).column, self.sort[2])] if self.sort else []
        return [*sort, *[(F.col(c), False) for c in self.order]]

    def _ordering(self, invert: bool = False) -> list[Column]:
        return [c.desc() if down != invert else c.asc() for c, down in self._keys()]

    # -- what it is

    @property
    def columns(self) -> list[str]:
        return list(self.defs)

    @property
    def meta_columns(self) -> list[str]:
        return [c.removeprefix(META) for c in self.base.columns if c.startswith(META)]

    @property
    def units(self) -> dict[str, Unit | None]:
        return {n: self._typed(d, n).unit for n, d in self.defs.items()}

    @property
    def descriptions(self) -> dict[str, str]:
        return {n: d.description or (repr(d.expr) if isinstance(d, Derived) else "") for n, d in self.defs.items()}

    @property
    def cosmology(self):
        return self.header.cosmology

    @property
    def redshift(self) -> float:
        return self.header.redshift

    @property
    def simulation(self) -> dict:
        return self.header.simulation

    @property
    def dtype(self) -> str:
        return self.header.data_type

    @property
    def region(self) -> regions.Region | None:
        return self._region or self.header.region

    @property
    def sorted_by(self) -> tuple[str, bool] | None:
        return (self.sort[0], self.sort[2]) if self.sort else None

    def __len__(self) -> int:
        return self.base.count()

    def __repr__(self) -> str:
        first = self.take(10, "start").to_pandas()
        return f"{self.kind} of {len(self)} rows\nCosmology: {self.cosmology}\nFirst rows:\n{first}"

    # -- rows out

    def to_df(self, ordered: bool = False, hidden: Sequence[str] = ()) -> DataFrame:
        """The plan of the public columns, in current units, which field metadata repeat; ordered if asked for or sorted."""
        self = hooks.fold("lightcone_instantiate" if self.kind == "Lightcone" else "dataset_instantiate", self)
        df = self.base.orderBy(*self._ordering()) if ordered or self.sort else self.base
        df = hooks.fold("post_sort", df) if self.sort else df
        out = []
        for n, d in self.defs.items():
            x = self._typed(d, n)
            about = {k: v for k, v in (("unit", str(x.unit) if x.unit else ""), ("description", d.description)) if v}
            out.append(x.column.alias(n, metadata=about) if about else x.column.alias(n))
        return df.select(*out, *[F.col(h) for h in hidden])

    def to_pandas(self):
        return self.to_df(ordered=True).toPandas()

    def get_data(self, format: str = "pandas", unpack: bool = True, metadata_columns: Sequence[str] = (), wrap_single: bool = False) -> Any:
        """All rows in order.  One column is an array unless ``wrap_single``; one row is values if ``unpack``.

        Formats: spark, pandas, numpy, arrow; polars and jax if they are installed."""
        if format not in FORMATS:
            raise ValueError(f"format {format!r}: one of {', '.join(FORMATS)}")
        df = self.to_df(ordered=True, hidden=[META + c for c in metadata_columns])
        for c in metadata_columns:
            df = df.withColumnRenamed(META + c, c)
        if format == "spark":
            return df
        if format == "arrow":
            return df.toArrow()
        if format == "polars":
            import polars

            return polars.from_arrow(df.toArrow())
        pdf = df.toPandas()
        if format == "pandas":
            return pdf if wrap_single or len(pdf.columns) > 1 else pdf.iloc[:, 0]
        data = {c: _array(pdf[c]) for c in pdf.columns}
        if format == "jax":
            import jax.numpy as jnp

            data = {k: jnp.asarray(v) for k, v in data.items()}
        if unpack and len(pdf) == 1:
            data = {k: v[0] for k, v in data.items()}
        return next(iter(data.values())) if len(data) == 1 and not wrap_single else data

    @property
    def data(self):
        warnings.warn("use get_data()", DeprecationWarning, stacklevel=2)
        return self.get_data("pandas", wrap_single=True)

    def get_metadata(self, columns: Sequence[str] | None = None):
        """Hidden columns, such as links, in row order."""
        wanted = list(columns or self.meta_columns)
        if missing := set(wanted) - set(self.meta_columns):
            raise MissingColumnError(f"no metadata {', '.join(sorted(missing))}")
        return self.base.orderBy(*self._ordering()).select(*[F.col(META + c).alias(c) for c in wanted]).toPandas()

    def rows(self, include_units: bool = False) -> Iterator[dict[str, Any]]:
        """Rows as dictionaries, fetched a partition at a time."""
        units = self.units if include_units else {}
        for r in self.to_df(ordered=True).toLocalIterator(prefetchPartitions=True):
            yield {k: Quantity(v, unit) if (unit := units.get(k)) is not None and not isinstance(v, list) else v for k, v in r.asDict().items()}

    # -- verbs of columns

    def _names(self, wanted: Iterable[Any]) -> list[str]:
        out: list[str] = []
        for w in wanted:
            for n in [w] if isinstance(w, str) else list(w):
                found = matching(self.defs, n) if "*" in n else [n] if n in self.defs else []
                if not found:
                    raise MissingColumnError(f"no column {n!r}")
                out += [f for f in found if f not in out]
        return out

    def select(self, *columns: str | Iterable[str] | Name, mode: str = "global", **derived: Expr) -> Any:
        """The named columns, in the table's order, and new ones.  ``*`` in a name stands for anything.

        Only reductions: their values, one by itself, several by name."""
        check_mode(mode)
        plain = [c for c in columns if not isinstance(c, Expr)]
        for c in columns:
            if isinstance(c, Name):
                if c.renamed:
                    derived = {c.renamed: Name(c.name)} | derived
                else:
                    plain.append(c.name)
            elif isinstance(c, Expr):
                raise ValueError("new columns need a name")
        derived = {k: wrap(v) if isinstance(v, (Expr, Quantity)) else v for k, v in derived.items()}
        scalars = [k for k, v in derived.items() if isinstance(v, Expr) and v.scalar]
        if scalars:
            if plain or len(scalars) < len(derived):
                raise ValueError("values of all rows and columns can't be selected together")
            return self._scalars(derived)
        ds = self.with_new_columns(allow_overwrite=True, **derived) if derived else self
        names = self._names(plain)
        keep = {n: ds.defs[n] for n in self.defs if n in names and n not in derived} | {n: ds.defs[n] for n in derived}
        return ds._with(defs=keep)

    def scalar_df(self, **derived: Expr) -> DataFrame:
        """One row of reductions, as a plan."""
        for v in derived.values():
            self._need(v.names())
        ctx = self._compiler()
        return self.base.agg(*[_aggregate(v, ctx, self.base).alias(k) for k, v in derived.items()])

    def _scalars(self, derived: dict[str, Expr]) -> Any:
        row = self.scalar_df(**derived).withColumn("__n", F.lit(1)).crossJoin(self.base.limit(1).agg(F.count("*").alias("__rows"))).first()
        if row is None or not row["__rows"]:
            raise ValueError("no rows to reduce")
        units = {k: v.compile(self._compiler()).unit for k, v in derived.items()}
        out = {k: Quantity(row[k], units[k]) if units[k] is not None else row[k] for k in derived}
        return next(iter(out.values())) if len(out) == 1 else out

    def drop(self, *columns: str | Iterable[str]) -> Dataset:
        """All but the named columns."""
        gone = set(self._names(columns))
        return self._with(defs={n: d for n, d in self.defs.items() if n not in gone})

    def with_new_columns(self, descriptions: dict[str, str] | str | None = None, allow_overwrite: bool = False, mode: str = "global", **new: Any) -> Dataset:
        """Adds expressions, arrays or array quantities of a value a row, in the current order.

        New columns may read each other; a name that is overwritten means the old column."""
        check_mode(mode)
        about = descriptions if isinstance(descriptions, dict) else dict.fromkeys(new, descriptions or "")
        if (taken := sorted(set(new) & set(self.defs))) and not allow_overwrite:
            raise ValueError(f"columns exist: {', '.join(taken)}")
        exprs, ds = {}, self
        for n, v in new.items():
            if isinstance(v, Evaluated):
                ds = ds._evaluated(n, v)
            elif isinstance(v, Expr):
                if v.scalar:
                    raise ValueError(f"{n} has one value for all rows")
                exprs[n] = v
            elif np.ndim(v.value if isinstance(v, Quantity) else v) == 0:
                raise ValueError(f"{n} has one value for all rows")
            else:
                ds = ds._with_array(n, v, about.get(n, ""))
        fresh = set(exprs) - set(self.defs)
        for n, e in exprs.items():
            if unknown := sorted(e.names() - set(ds.defs) - fresh):
                raise MissingColumnError(f"{n} reads no column: {', '.join(unknown)}")
        defs, open_, made = dict(ds.defs), dict(exprs), {}
        while open_:
            ready = [n for n, e in open_.items() if not (e.names() & fresh) - set(made)]
            if not ready:
                raise ValueError(f"columns read each other in a circle: {', '.join(sorted(open_))}")
            for n in ready:
                e = open_.pop(n)
                made[n] = Derived(e, {k: made[k] if k in fresh else ds.defs[k] for k in e.names()}, about.get(n, ""))
                made[n].expr.compile(_Compiler(ds, made[n].env))  # raises what units forbid
        return ds._with(defs=defs | made)

    def _evaluated(self, name: str, e: Evaluated) -> Dataset:
        made = self._with(defs={n: d for n, d in self.defs.items() if n != name} if name not in e.inputs(self) else self.defs).evaluate(e.func, allow_overwrite=True, **e.options)
        new = [n for n in made.columns if n not in self.columns or made.defs[n] is not self.defs[n]]
        if len(new) != 1:
            raise ValueError(f"{name} is made of a function of {len(new)} columns")
        return self._with(base=made.base, defs={n: d for n, d in self.defs.items() if n != name} | {name: made.defs[new[0]]})

    def _with_array(self, name: str, values: Any, description: str) -> Dataset:
        unit = values.unit if isinstance(values, Quantity) else None
        array = np.asarray(values.value if unit else values)
        n = len(self)
        if len(array) != n:
            raise ValueError(f"{name} has {len(array)} values for {n} rows")
        import pandas as pd

        stored = self._fresh(name)
        data = pd.DataFrame({"__pos": np.arange(n), stored: array.tolist() if array.ndim > 1 else array})
        right = self.base.sparkSession.createDataFrame(data)
        base = with_position(self.base, self._keys()).join(right, "__pos").drop("__pos")
        return self._with(base=base, defs=self.defs | {name: Stored(stored, unit, True, description)})

    def _fresh(self, name: str) -> str:
        """A name for a new column of ``base``."""
        taken, k, out = set(self.base.columns), 0, name
        while out in taken:
            k, out = k + 1, f"__{name}_{k + 1}"
        return out

    # -- verbs of rows

    def filter(self, *masks: Mask, mode: str = "global") -> Dataset:
        """Rows that all masks hold for.  Reductions in masks are over the rows before."""
        check_mode(mode)
        return hooks.fold("index_update", self._with(base=self.base.filter(self._mask(masks)))) if masks else self

    def sort_by(self, column: str | None, invert: bool = False) -> Dataset:
        """The order of what comes out and of positions; None: the rows' own."""
        if column is None:
            return self._with(sort=None)
        if column not in self.defs:
            raise ValueError(f"no column {column!r}")
        return self._with(sort=(column, self.defs[column], invert))

    def take(self, n: int, at: str = "random", mode: str = "global", seed: int | None = None) -> Dataset:
        """``n`` rows, or all if there are fewer; random ones by the hash of their order columns and a seed."""
        check_mode(mode)
        if n < 0:
            raise ValueError("a negative number of rows")
        if at == "start":
            keys = self._ordering()
        elif at == "end":
            keys = self._ordering(invert=True)
        elif at == "random":
            seed = int(np.random.default_rng().integers(1 << 31)) if seed is None else seed
            keys = [F.xxhash64(F.lit(seed), *self.order).asc(), *[F.asc(c) for c in self.order]]
        else:
            raise ValueError(f"at {at!r}: random, start or end")
        if n > TOP_ROWS and at != "random":
            placed = with_position(self.base, [(c, down != (at == "end")) for c, down in self._keys()])
            return self._with(base=placed.filter(F.col("__pos") < n).drop("__pos"))
        return self._with(base=self.base.orderBy(*keys).limit(n))

    def take_range(self, start: int, end: int, mode: str = "global") -> Dataset:
        """Rows from position ``start`` to before ``end``, which may be beyond the last."""
        check_mode(mode)
        if start < 0 or end < start:
            raise ValueError(f"range {start} to {end}")
        if end > TOP_ROWS:
            placed = with_position(self.base, self._keys())
            return self._with(base=placed.filter((F.col("__pos") >= start) & (F.col("__pos") < end)).drop("__pos"))
        return self._with(base=self.base.orderBy(*self._ordering()).offset(start).limit(end - start))

    def take_rows(self, rows: Sequence[int]) -> Dataset:
        """Rows at positions of the current order."""
        wanted = np.unique(np.asarray(rows, np.int64))
        if len(wanted) and (wanted[0] < 0 or wanted[-1] >= len(self)):
            raise ValueError("positions beyond the rows")
        if not len(wanted):
            return self._with(base=self.base.limit(0))
        placed = with_position(self.base, self._keys())
        if len(wanted) <= LITERAL_ROWS:
            return self._with(base=placed.filter(F.col("__pos").isin(wanted.tolist())).drop("__pos"))
        import pandas as pd

        right = self.base.sparkSession.createDataFrame(pd.DataFrame({"__pos": wanted}))
        return self._with(base=placed.join(right, "__pos", "left_semi").drop("__pos"))

    # -- units

    def with_units(self, convention: str | None = None, conversions: dict[Any, Any] | None = None, **columns: str | Unit) -> Dataset:
        """Another convention, and units for what has a unit (``conversions``) and for columns; earlier ones are forgotten.

        A column's own conversion comes before one for all."""
        convention = convention or self.convention
        for d in self.defs.values():
            for s in _stored(d):
                transition(s.unit, self.header.unit_convention, self.header.unit_convention if s.static else convention, self.header.cosmology.h)
        if convention == "scalefree" and self.header.unit_convention != "scalefree":
            raise ValueError(f"columns stored as {self.header.unit_convention} have no scalefree form")
        self._need(columns)
        plain = self._with(convention=convention, conversions=Conversions())
        own = {n: as_unit(x) for n, x in columns.items()}
        for n, x in own.items():
            now = plain._typed(plain.defs[n], n).unit
            if now is None or not now.equivalent(x):
                raise UnitConversionError(f"{n} ({now or 'no unit'}) can't be in {x}")
        every = tuple((as_unit(a), as_unit(b)) for a, b in (conversions or {}).items())
        for a, b in every:
            a.factor(b)
        return self._with(convention=convention, conversions=Conversions(every, own))

    # -- space

    def bound(self, region: regions.Region, select_by: Sequence[str] | None = None) -> Dataset:
        """Rows whose point is inside; ``select_by``: other coordinate columns.

        Constants are converted to stored units, and where rows have a spatial key (``key``), ranges of it prune the scan."""
        coords = list(select_by or self.coords or ())
        if not coords:
            raise AttributeError("the dataset has no spatial index")
        if select_by:
            self._need(coords)
        inside, known = region, self.region
        if known is not None and known.flat == region.flat:
            try:
                if not known.intersects(region):
                    return self._with(base=self.base.filter(F.lit(False)), region=region)
                if not known.contains(region):
                    warnings.warn("the region is not wholly in the dataset's", stacklevel=2)
            except ValueError:
                pass
        factors = [self._typed(Stored(c, self._unit_of(c)), c) for c in coords]
        raw = [getattr(t, "raw", None) for t in factors]
        cols = [t.column for t in factors]
        if isinstance(region, regions.Box) and all(r is not None for r in raw) and len({r[1] for r in raw}) == 1:
            inside, cols = region.scaled(1 / raw[0][1]), [r[0] for r in raw]
        exact = inside.predicate(*cols)
        if self.key and self.key[0] in self.base.columns and not (self.key[3:] and self.key[3]):  # a key that is worked out prunes nothing
            name, level, size = self.key[:3]
            if isinstance(inside, regions.Box):
                exact = octree.in_ranges(F.col(name), octree.coarser(octree.key_ranges(inside, size, level))) & exact
            elif hasattr(region, "pixels"):
                at = max(0, min(level, COARSE))
                runs = [(lo << 2 * (level - at), ((hi + 1) << 2 * (level - at)) - 1) for lo, hi in regions.healpix.ranges(region.pixels(1 << at))]
                exact = octree.in_ranges(F.col(name), octree.coarser(runs)) & exact
        return self._with(base=self.base.filter(exact), region=region)

    def _unit_of(self, name: str) -> Unit | None:
        d = self.defs.get(name)
        return d.unit if isinstance(d, Stored) else None

    # -- functions of users

    def evaluate(self, func: Callable, vectorize: bool = False, insert: bool = True, format: str = "numpy", batch_size: int = -1, allow_overwrite: bool = False, elementwise: bool = False, **kwargs: Any) -> Any:
        """See ``evaluate.run``."""
        from .evaluate import run

        return run(self, func, vectorize=vectorize, insert=insert, format=format, batch_size=batch_size, allow_overwrite=allow_overwrite, elementwise=elementwise, kwargs=kwargs)


#: Level of pixels that a region of the sky is resolved to for pruning.
COARSE = 7


def replace_typed(x: Typed, unit: Unit, factor: float) -> Typed:
    out = Typed(x.column if factor == (0.0 if unit.log else 1.0) else x.column + F.lit(factor) if unit.log else x.column * F.lit(factor), unit, x.floating or factor != 1)
    raw = getattr(x, "raw", None)
    out.raw = (raw[0], raw[1] * factor) if raw and not unit.log else None
    return out


def _stored(d: Definition) -> Iterator[Stored]:
    if isinstance(d, Stored):
        yield d
    else:
        for x in d.env.values():
            yield from _stored(x)


def _array(s) -> np.ndarray:
    return np.stack(s.to_numpy()) if len(s) and isinstance(s.iloc[0], (list, np.ndarray)) else s.to_numpy()


class _InAggregate(_Compiler):
    """Reductions become aggregates in place, those within them subqueries."""

    def __init__(self, ds: Dataset, env: dict[str, Definition]):
        super().__init__(ds, env)

    def scalar(self, node: Reduction) -> Typed:
        if node.exact_quantile is not None:
            return replace(one := super().scalar(node), column=F.max(one.column))
        return node.aggregate(node.arg.compile(_Compiler(self.ds, self.env)))


def _aggregate(e: Expr, ctx: _Compiler, base: DataFrame) -> Column:
    return e.compile(_InAggregate(ctx.ds, ctx.env)).column


def _pushed(m: Mask, ctx: _Compiler) -> Column:
    """Compiles a mask; a stored column against a constant is compared in stored units, which the scan can use."""
    if isinstance(m, Both):
        a, b = _pushed(m.a, ctx), _pushed(m.b, ctx)
        return a & b if m.op == "&" else a | b
    if isinstance(m, Compare):
        a, b, op = m.a, m.b, m.op
        if isinstance(a, Literal):
            a, b, op = b, a, {"<": ">", ">": "<", "<=": ">=", ">=": "<="}.get(op, op)
        if isinstance(a, Name) and isinstance(b, Literal):
            x = a.compile(ctx)
            raw = getattr(x, "raw", None)
            if raw and raw[1] > 0 and raw[1] != 1 and (b.unit is None or x.unit is not None and not b.unit.log):
                value = b.value * (b.unit.factor(x.unit) if b.unit else 1.0) / raw[1]
                return Compare(op, _Ready(Typed(raw[0], None, True)), Literal(value, None)).compile(ctx)
    return m.compile(ctx)


class _Ready(Expr):
    def __init__(self, typed: Typed):
        self.typed = typed

    scalar = False

    def compile(self, ctx):
        return self.typed


__all__ = ["Conversions", "Dataset", "Derived", "IsIn", "MissingColumnError", "Stored", "check_mode", "col", "matching"]
