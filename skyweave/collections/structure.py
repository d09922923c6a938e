"""Linked structures: a table of parents and tables of their children, by keys.

A child row holds its parent's key; verbs change the parents, and children are joined to the parents
of the moment only when they are used, as left-semi joins that Catalyst plans.  Children may be
structures themselves.
"""

from __future__ import annotations

import functools
import warnings
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.errors import MissingColumnError
from ..functions.expr import Expr
from ..operators import evaluate as ev
from ..operators.dataset import Dataset, Stored, matching
from ..operators.groups import whole_groups
from .lightcone import Lightcone

#: Names of links in stored data, and of the children they lead to.
LINK_NAMES = {
    "sodbighaloparticles_star_particles": "star_particles",
    "sodbighaloparticles_dm_particles": "dm_particles",
    "sodbighaloparticles_gravity_particles": "gravity_particles",
    "sodbighaloparticles_agn_particles": "agn_particles",
    "sodbighaloparticles_gas_particles": "gas_particles",
    "fofbighaloparticles_star_particles": "star_particles",
    "fofbighaloparticles_dm_particles": "dm_particles",
    "fofbighaloparticles_gravity_particles": "gravity_particles",
    "fofbighaloparticles_agn_particles": "agn_particles",
    "fofbighaloparticles_gas_particles": "gas_particles",
    "sod_profile": "halo_profiles",
    "haloprofiles": "halo_profiles",
    "galaxyproperties": "galaxy_properties",
    "galaxyparticles_star_particles": "star_particles",
}


@dataclass(frozen=True)
class Link:
    """Columns of the parent's and the child's base that are equal: a key, or a step and a key.  ``single``: one child at most."""

    parent: tuple[str, ...]
    child: tuple[str, ...]
    single: bool = False


def link(parent: str | Sequence[str], child: str | Sequence[str], single: bool = False) -> Link:
    as_tuple = lambda x: (x,) if isinstance(x, str) else tuple(x)
    return Link(as_tuple(parent), as_tuple(child), single)


def links_from_positions(parents: DataFrame, children: DataFrame, *, start: str | None = None, size: str | None = None, idx: str | None = None, parent_key: str, child_position: str, name: str = "__parent_id") -> DataFrame:
    """Stamps children with their parent's key, from stored links: runs of positions (``start``, ``size``) or one position (``idx``, -1: none)."""
    if idx:
        pairs = parents.where(F.col(idx) >= 0).select(F.col(parent_key).alias(name), F.col(idx).alias("__at"))
    else:
        pairs = parents.where(F.col(size) > 0).select(F.col(parent_key).alias(name), F.explode(F.sequence(F.col(start), F.col(start) + F.col(size) - 1)).alias("__at"))
    return children.join(pairs, F.col(child_position) == F.col("__at"), "left").drop("__at")


class StructureCollection:
    def __init__(self, source: Dataset, children: dict[str, Any], links: dict[str, Link], name: str = "halo_properties", hide_source: bool = False):
        self._source, self._children, self._links, self.source_name, self.hide_source = source, children, links, name, hide_source
        if set(children) != set(links):
            raise ValueError("each child has a link")

    def _with(self, source: Dataset | None = None, children: dict[str, Any] | None = None) -> StructureCollection:
        kept = self._children if children is None else children
        return StructureCollection(source or self._source, kept, {n: self._links[n] for n in kept}, self.source_name, self.hide_source)

    # -- members

    def keys(self) -> list[str]:
        return [*([] if self.hide_source else [self.source_name]), *self._children]

    def values(self) -> list[Any]:
        return [self[n] for n in self.keys()]

    def items(self) -> list[tuple[str, Any]]:
        return [(n, self[n]) for n in self.keys()]

    def __iter__(self) -> Iterator[str]:
        return iter(self.keys())

    def __len__(self) -> int:
        return len(self._source)

    def __getitem__(self, name: str) -> Any:
        """A member, with the rows that belong to the parents of the moment."""
        if name == self.source_name and not self.hide_source:
            return self._source
        if "." in name:
            head, rest = name.split(".", 1)
            return self[head][rest]
        if name not in self._children:
            raise KeyError(name)
        child, ln = self._children[name], self._links[name]
        inner = child._source if isinstance(child, StructureCollection) else child
        mine = self._source.base.select(*[F.col(p).alias(f"__p{i}") for i, p in enumerate(ln.parent)])
        on = functools.reduce(lambda a, b: a & b, [F.col(c) == F.col(f"__p{i}") for i, c in enumerate(ln.child)])
        aligned = inner._with(base=inner.base.join(mine, on, "left_semi"))
        return child._with(source=aligned) if isinstance(child, StructureCollection) else aligned

    @property
    def properties(self) -> list[str]:
        return self._source.columns

    @property
    def header(self): return self._source.header
    @property
    def cosmology(self): return self._source.cosmology
    @property
    def redshift(self): return self._source.redshift
    @property
    def simulation(self): return self._source.simulation
    @property
    def region(self): return self._source.region
    @property
    def sorted_by(self): return self._source.sorted_by
    @property
    def dtype(self): return self._source.dtype
    @property
    def z_range(self): return self._lightcone("z_range").z_range

    def _lightcone(self, verb: str) -> Lightcone:
        if not isinstance(self._source, Lightcone):
            raise AttributeError(f"{verb} is for structures in lightcones")
        return self._source

    # -- rows of parents

    def filter(self, *masks, on_galaxies: bool = False, mode: str = "global") -> StructureCollection:
        """Parents that masks hold for, or, ``on_galaxies``, that have a child galaxy they hold for."""
        if not on_galaxies or self._source.dtype == "galaxy_properties":
            return self._with(self._source.filter(*masks, mode=mode))
        name = next((n for n in ("galaxies", "galaxy_properties") if n in self._children), None)
        if name is None:
            raise ValueError("the structures have no galaxies")
        return self.filter_on(name, *masks)

    def filter_on(self, child: str, *masks) -> StructureCollection:
        """Parents with at least one child that masks hold for."""
        c, ln = self[child], self._links[child]
        inner = (c._source if isinstance(c, StructureCollection) else c).filter(*masks)
        return self._with(self._source._with(base=_semi(self._source.base, inner.base, ln.parent, ln.child)))

    def remove_empty(self, children: Iterable[str] | None = None) -> StructureCollection:
        """Parents with children in all members, or those named."""
        base = self._source.base
        for n in children or self._children:
            c, ln = self._children[n], self._links[n]
            inner = c._source if isinstance(c, StructureCollection) else c
            base = _semi(base, inner.base, ln.parent, ln.child)
        return self._with(self._source._with(base=base))

    def take(self, n: int, at: str = "random", mode: str = "global", seed: int | None = None): return self._with(self._source.take(n, at, mode, seed))
    def take_range(self, start: int, end: int, mode: str = "global"): return self._with(self._source.take_range(start, end, mode))
    def take_rows(self, rows: Sequence[int]): return self._with(self._source.take_rows(rows))
    def sort_by(self, column: str | None, invert: bool = False): return self._with(self._source.sort_by(column, invert))
    def bound(self, region, select_by: Sequence[str] | None = None): return self._with(self._source.bound(region, select_by))
    def with_redshift_range(self, low: float, high: float): return self._with(self._lightcone("with_redshift_range").with_redshift_range(low, high))
    def cone_search(self, center, radius): return self._with(self._lightcone("cone_search").cone_search(center, radius))
    def box_search(self, p1, p2): return self._with(self._lightcone("box_search").box_search(p1, p2))
    def pixel_search(self, pixels, nside: int = 64): return self._with(self._lightcone("pixel_search").pixel_search(pixels, nside))
    def get_pixels(self, nside: int): return self._lightcone("get_pixels").get_pixels(nside)

    # -- columns of members

    def _change(self, path: str, change: Callable[[Any], Any]) -> StructureCollection:
        head, _, rest = path.partition(".")
        if head == self.source_name and not rest:
            return self._with(change(self._source))
        if head not in self._children:
            raise ValueError(f"no member {head!r}")
        child = self._children[head]
        if rest:
            new = child._change(rest, change)
        elif isinstance(child, StructureCollection):
            new = child._with(change(child._source))
        else:
            new = change(child)
        return self._with(children=self._children | {head: new})

    def _tables(self) -> dict[str, Dataset]:
        return {self.source_name: self._source} | {n: c._source if isinstance(c, StructureCollection) else c for n, c in self._children.items()}

    def _route(self, names: Iterable[str]) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for name in names:
            found = [n for n, t in self._tables().items() if (matching(t.columns, name) if "*" in name else name in t.columns)]
            if not found:
                raise MissingColumnError(f"no member has a column {name!r}")
            for n in found:
                out.setdefault(n, []).append(name)
        return out

    def select(self, *columns: str | Iterable[str], **per: Any) -> StructureCollection:
        """Names go to all members that have them.  By member: names, ``{"columns": ..., "derived_columns": ...}``, or a dict for a member with children."""
        out = self
        for member, names in self._route([n for c in columns for n in ([c] if isinstance(c, str) else c)]).items():
            out = out._change(member, lambda d, names=names: d.select(*names))
        loose = {k: v for k, v in per.items() if isinstance(v, Expr)}
        if any(v.scalar for v in loose.values()):
            raise ValueError("values of all rows are selected from a member")
        for k, e in loose.items():
            homes = [n for n, t in self._tables().items() if e.names() <= set(t.columns)]
            if not homes:
                raise MissingColumnError(f"no member has what {k} reads")
            for n in homes:
                out = out._change(n, lambda d, k=k, e=e: d.with_new_columns(**{k: e}))
        for member, what in per.items():
            if isinstance(what, Expr):
                continue
            if isinstance(what, dict) and not set(what) <= {"columns", "derived_columns"}:
                if member not in out._children:
                    raise ValueError(f"no member {member!r}")
                out = out._with(children=out._children | {member: out._children[member].select(**what)})
                continue
            names = what.get("columns", ["*"]) if isinstance(what, dict) else what
            derived = what.get("derived_columns", {}) if isinstance(what, dict) else {}
            if any(v.scalar for v in derived.values()):
                raise ValueError("values of all rows are selected from a member")
            out = out._change(member, lambda d, names=names, derived=derived: d.select(names, **derived))
        return out

    def drop(self, *columns: str | Iterable[str], **per: Any) -> StructureCollection:
        out = self
        for member, names in self._route([n for c in columns for n in ([c] if isinstance(c, str) else c)]).items():
            out = out._change(member, lambda d, names=names: d.drop(*names))
        for member, names in per.items():
            out = out._change(member, lambda d, names=names: d.drop(names))
        return out

    def with_new_columns(self, dataset: str, descriptions: Any = None, allow_overwrite: bool = False, **new: Any) -> StructureCollection:
        """``dataset``: a member; a dot leads to members of members."""
        return self._change(dataset, lambda d: d.with_new_columns(descriptions, allow_overwrite, **new))

    def with_units(self, convention: str | None = None, conversions: dict | None = None, **per: dict) -> StructureCollection:
        """``per``: by member, a dict of columns' units, with ``conversions`` for its own blanket ones."""
        if unknown := set(per) - set(self._tables()):
            raise ValueError(f"no members {', '.join(sorted(unknown))}")
        out = self
        for n in self._tables():
            own = dict(per.get(n, {}))
            every = own.pop("conversions", conversions)
            out = out._change(n, lambda d, own=own, every=every: d.with_units(convention, every, **own))
        return out

    def with_datasets(self, names: Iterable[str]) -> StructureCollection:
        wanted = list(names)
        if unknown := [n for n in wanted if n not in self.keys()]:
            raise ValueError(f"no members {', '.join(unknown)}")
        kept = {n: c for n, c in self._children.items() if n in wanted}
        return StructureCollection(self._source, kept, {n: self._links[n] for n in kept}, self.source_name, self.source_name not in wanted)

    # -- structure by structure

    def objects(self, data_types: Iterable[str] | None = None, ignore_empty: bool = True) -> Iterator[dict[str, Any]]:
        """For each parent in order: its row as a dict, and the rows of each child as a pandas frame.

        Parents and children come sorted by key, partition by partition, and are merged; a parent without children in a
        member lacks that entry, or, if ``ignore_empty`` is false, has an empty frame."""
        wanted = list(data_types or self._children)
        if unknown := [n for n in wanted if n not in self._children]:
            raise ValueError(f"no members {', '.join(unknown)}")
        source = self._source
        keyed = {n: self._rows_of(n) for n in wanted}
        out_columns = source.columns
        parents = source._with(sort=None) if not source.sort else source
        links = {n: self._links[n].parent for n in wanted}
        keys = sorted({k for ks in links.values() for k in ks})
        if source.sort or len({ks for ks in links.values()}) > 1:
            streams = None
        else:
            streams = {n: _Stream(df, len(self._links[n].child)) for n, df in keyed.items()}
        public = [parents._typed(d, n).column.alias(n) for n, d in parents.defs.items()]
        ids = [F.col(k).alias(f"__key_{k}") for k in keys]
        order = [F.col(k) for k in next(iter(links.values()), source.order)] if streams is not None and wanted else parents._ordering()
        for row in parents.base.orderBy(*order).select(*public, *ids).toLocalIterator(prefetchPartitions=True):
            r = row.asDict()
            made: dict[str, Any] = {self.source_name: {c: r[c] for c in out_columns}}
            empty = False
            for n in wanted:
                key = tuple(r[f"__key_{k}"] for k in links[n])
                if streams is not None:
                    frame = streams[n].take(key)
                else:
                    condition = functools.reduce(lambda a, b: a & b, [F.col(f"__k{i}") == F.lit(v) for i, v in enumerate(key)])
                    frame = keyed[n].filter(condition).drop(*[f"__k{i}" for i in range(len(key))]).toPandas()
                if len(frame) or not ignore_empty:
                    made[n] = frame
                empty |= not len(frame)
            if empty:
                warnings.warn("some structures lack children", stacklevel=2)
            yield made

    def _rows_of(self, name: str) -> DataFrame:
        """A child's public columns with its parent's key, sorted by it."""
        child, ln = self[name], self._links[name]
        inner = child._source if isinstance(child, StructureCollection) else child
        public = [inner._typed(d, n).column.alias(n) for n, d in inner.defs.items()]
        keys = [F.col(c).alias(f"__k{i}") for i, c in enumerate(ln.child)]
        return inner.base.orderBy(*[F.col(c) for c in ln.child], *[F.col(c) for c in inner.order]).select(*keys, *public)

    def halos(self, *args: Any, **kwargs: Any):
        if self._source.dtype != "halo_properties":
            raise AttributeError("the structures are no halos")
        return self.objects(*args, **kwargs)

    def galaxies(self, *args: Any, **kwargs: Any):
        if self._source.dtype != "galaxy_properties":
            raise AttributeError("the structures are no galaxies")
        return self.objects(*args, **kwargs)

    def evaluate_on_dataset(self, func: Callable, dataset: str, **kwargs: Any) -> StructureCollection:
        """A function over the rows of one member, whatever the structure."""
        return self._change(dataset, lambda d: d.evaluate(func, **kwargs))

    def evaluate(self, func: Callable, dataset: str | None = None, insert: bool = True, format: str = "numpy", **kwargs: Any) -> Any:
        """A function called once for each parent.

        Parameters that name members get dicts of their columns (limited by a list of the same name in
        ``kwargs``); parameters that name no member get other ``kwargs``.  Without ``dataset`` the result is a row of
        the parents; a ``dataset`` that the function takes columns of (by their names) or members gets a value for each of its rows.
        Members are tagged and brought together by one shuffle on the parent's key."""
        ev.check_format(format)
        members = self.keys() if not self.hide_source else [self.source_name, *self._children]
        params = [n for n, p in __import__("inspect").signature(func).parameters.items() if p.default is p.empty]
        used = [p for p in params if p in members]
        if dataset and "." in dataset:
            head, rest = dataset.split(".", 1)
            child = self._children[head]
            return self._with(children=self._children | {head: child.evaluate(func, rest, insert, format, **kwargs)})
        flat = not used and dataset is not None
        tables = self._tables()
        if flat:
            if dataset not in tables:
                raise ValueError(f"no member {dataset!r}")
            inputs = {dataset: ev.arguments(func, tables[dataset].columns, kwargs)}
            used, extra = [dataset], kwargs
        else:
            extra = {k: v for k, v in kwargs.items() if k not in members}
            if unknown := [p for p in params if p not in members and p not in extra]:
                raise ValueError(f"no members or arguments {', '.join(unknown)}")
            inputs = {m: list(kwargs.get(m, tables[m].columns)) for m in used}
            for m, names in inputs.items():
                tables[m]._need(names)
        if not used:
            raise ValueError("a function of no member")
        target = dataset if dataset and dataset != self.source_name else None
        name = getattr(func, "__name__", "result")

        # one frame: the parent's key, a tag of the member, the row's place in its member, a struct of each member's columns
        children = [m for m in used if m != self.source_name]
        pk = self._links[(target or (children or list(self._children))[0])].parent
        frames = None
        for tag, m in enumerate(used):
            table = self[m] if m != self.source_name else self._source
            table = table._source if isinstance(table, StructureCollection) else table
            keys = pk if m == self.source_name else self._links[m].child
            ids = [F.col(c).alias(f"__o{i}") for i, c in enumerate(table.order)] if m == (target or "") else []
            own = table.base.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(keys)], F.lit(tag).alias("__tag"), F.struct(*[F.col(c) for c in table.order]).alias(f"__sort{tag}"), *ids, F.struct(*[table._typed(table.defs[c], c).column.alias(c) for c in inputs[m]]).alias(m))
            frames = own if frames is None else frames.unionByName(own, allowMissingColumns=True)
        nk = len(pk)
        key_names = [f"__k{i}" for i in range(nk)]
        order_names = [c for c in frames.columns if c.startswith("__o")]

        def split(t: pa.Table, begin: np.ndarray) -> Iterator[tuple[dict[str, Any], np.ndarray]]:
            """For each group of rows, what the function makes of it, and which rows are the target's (or the parent's)."""
            tag, group = t["__tag"].to_numpy(), np.repeat(np.arange(len(begin) - 1), np.diff(begin))
            at, columns, edges = {}, {}, {}
            for k, m in enumerate(used):
                at[m] = np.flatnonzero(tag == k)
                cells = t[m].combine_chunks().take(pa.array(at[m]))
                columns[m] = {c: cells.field(c).to_pandas() for c in inputs[m]}
                edges[m] = np.searchsorted(group[at[m]], np.arange(len(begin)))
            home = target or (self_name if self_name in used else None)
            for g in range(len(begin) - 1):
                args: dict[str, Any] = {}
                mine = np.arange(begin[g], begin[g] + 1) if home is None else at[home][edges[home][g] : edges[home][g + 1]]
                if not len(mine):  # a parent that is not there
                    continue
                for m in used:
                    low, high = edges[m][g], edges[m][g + 1]
                    found = {c: ev.formed(x.iloc[low:high].reset_index(drop=True) if format == "pandas" else x.iloc[low:high], format) for c, x in columns[m].items()}
                    args[m] = ({c: v[0] for c, v in found.items()} if high > low else {}) if m == self_name else found
                yield ev.named(name, func(**(args[used[0]] if flat else args), **extra)), mine

        self_name = self.source_name
        first_key = frames.where(F.col("__tag") == used.index(target) if target else F.col("__tag") == 0).limit(1).select(*key_names).first()
        sorts = [*key_names, "__tag", *[f"__sort{k}" for k in range(len(used))]]
        probe = frames.where(functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.lit(v)) for k, v in zip(key_names, first_key, strict=True)])).orderBy(*sorts).drop(*sorts[nk + 1 :]).toArrow() if first_key else None
        found = next(split(probe.combine_chunks(), np.array([0, probe.num_rows])), None) if probe is not None and probe.num_rows else None
        if found is None:
            raise ValueError("no structure to try the function on")
        made, rows_of_target = found
        if any(v is None for v in made.values()):
            if insert:
                raise ValueError("a function that makes nothing")
            return None
        n = len(rows_of_target)
        example = {k: (ev.Quantity(ev.column_of(v, n)[0], v.unit) if isinstance(v, ev.Quantity) else ev.column_of(v, n)[0]) if target else v for k, v in made.items()}
        kinds = {k: ev.kind_of(v) for k, v in example.items()}
        fields = {f.name: f for f in frames.schema.fields}
        outs = [fields[c] for c in [*key_names, *(order_names if target else [])]] + [T.StructField(f"__r_{k}", t) for k, (t, _) in kinds.items()]

        schema = T.StructType(outs)
        arrow = to_arrow_schema(schema)
        same = [*key_names, *(order_names if target else [])]

        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for t, begin in whole_groups(batches, key_names):
                rows, values = [], {k: [] for k in kinds}
                for made, mine in split(t, begin):
                    rows.append(mine if target else mine[:1])
                    for k, v in values.items():
                        if target:
                            v.extend(ev.column_of(made[k], len(mine)))
                        else:
                            one = ev.strip(made[k])
                            v.append(one.tolist() if isinstance(one, np.ndarray) else one)
                if rows:
                    at = pa.array(np.concatenate(rows))
                    yield pa.RecordBatch.from_arrays([*[t[c].combine_chunks().take(at).cast(arrow.field(c).type) for c in same], *[pa.array(values[k], arrow.field(f"__r_{k}").type) for k in kinds]], schema=arrow)

        # members of a parent are brought together by one shuffle, and sorted by Spark, which can spill; by a hash of the key, as Spark leaves
        # out a shuffle by columns that the plan below is dealt by, and may split or merge that one
        result = frames.repartition(F.xxhash64(*key_names)).sortWithinPartitions(*sorts).drop(*sorts[nk + 1 :]).mapInArrow(each, schema)
        home = tables[target] if target else self._source
        on = list(zip(self._links[target].child if target else pk, key_names, strict=True)) + list(zip(home.order, order_names, strict=False) if target else [])
        condition = functools.reduce(lambda a, b: a & b, [F.col(f"h.{a}").eqNullSafe(F.col(f"r.{b}")) for a, b in on])
        stored = {k: home._fresh(k) for k in kinds}
        joined = home.base.alias("h").join(result.alias("r"), condition, "left").select("h.*", *[F.col(f"r.__r_{k}").alias(stored[k]) for k in kinds])
        new = home._with(base=joined, defs=home.defs | {k: Stored(stored[k], unit, True) for k, (_, unit) in kinds.items()})
        if not insert:
            return new._with(defs={k: new.defs[k] for k in kinds}).get_data("numpy", unpack=False)
        return self._change(target, lambda d: new) if target else self._with(new)


def _semi(left: DataFrame, right: DataFrame, left_on: Sequence[str], right_on: Sequence[str]) -> DataFrame:
    keys = right.select(*[F.col(c).alias(f"__s{i}") for i, c in enumerate(right_on)])
    return left.join(keys, functools.reduce(lambda a, b: a & b, [F.col(c) == F.col(f"__s{i}") for i, c in enumerate(left_on)]), "left_semi")


class _Stream:
    """Rows sorted by key, handed out group by group to keys that ascend."""

    def __init__(self, df: DataFrame, keys: int):
        self.rows, self.keys, self.columns = df.toLocalIterator(prefetchPartitions=True), keys, df.columns[keys:]
        self.next = next(self.rows, None)

    def take(self, key: tuple) -> pd.DataFrame:
        while self.next is not None and tuple(self.next[: self.keys]) < key:
            self.next = next(self.rows, None)
        found = []
        while self.next is not None and tuple(self.next[: self.keys]) == key:
            found.append(tuple(self.next[self.keys :]))
            self.next = next(self.rows, None)
        return pd.DataFrame(found, columns=self.columns)
