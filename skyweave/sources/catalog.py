"""Catalogues on disk: a folder a dataset, with ``header.json`` and Parquet files; folders of such folders are collections.

::

    halos/                      a structure collection
      header.json               governs what has no header of its own
      halo_properties/          a dataset
        header.json
        columns.json            units, descriptions, order, spatial key, links
        data/*.parquet

The deepest header above the data holds.  Headers are read through Spark's file systems.
"""

from __future__ import annotations

import json
import warnings
from collections.abc import Iterable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..collections.healpix_map import HealpixMap
from ..collections.lightcone import LEVEL, PIXEL, STEP, Lightcone
from ..collections.simulation import SimulationCollection
from ..collections.structure import Link, StructureCollection
from ..functions.units import as_unit
from ..operators.dataset import Dataset, Stored
from ..plans import healpix, hooks, octree
from .header import Header

PROPERTIES = ("halo_properties", "galaxy_properties")
#: Which kinds of data link to which.
OWNERS = {"halo_properties": ("halo_particles", "halo_profiles", "galaxy_properties"), "galaxy_properties": ("galaxy_particles",)}
KEY, KEY_LEVEL = "__zkey", 8


@dataclass(frozen=True)
class Entry:
    """A dataset found on disk."""

    path: str
    scope: str
    header: Header
    about: dict[str, Any]
    columns: tuple[tuple[str, str], ...]

    @property
    def name(self) -> str:
        return self.path.rstrip("/").rsplit("/", 1)[-1]

    @property
    def links(self) -> dict[str, Any]:
        return self.about.get("links", {})


class _Files:
    """Paths as Spark's file systems know them."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.jvm = spark, spark._jvm
        self.fs = self._path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def qualified(self, p: str) -> str:
        return self.fs.makeQualified(self._path(p)).toString().rstrip("/")

    def exists(self, p: str) -> bool:
        return self.fs.exists(self._path(p))

    def folders(self, p: str) -> list[str]:
        return sorted(s.getPath().toString() for s in self.fs.listStatus(self._path(p)) if s.isDirectory())

    def read(self, p: str) -> dict:
        stream = self.fs.open(self._path(p))
        try:
            return json.loads(bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def write(self, p: str, x: dict) -> None:
        stream = self.fs.create(self._path(p), True)
        try:
            stream.write(json.dumps(x, indent=1).encode())
        finally:
            stream.close()

    def delete(self, p: str) -> None:
        self.fs.delete(self._path(p), True)


def discover(spark: SparkSession, path: str) -> list[Entry]:
    """Datasets below a path.  A malformed one is a ValueError that names it."""
    files, out = _Files(spark, path), []

    def walk(p: str, header: dict | None, scope: str) -> None:
        if files.exists(f"{p}/header.json"):
            try:
                header, scope = files.read(f"{p}/header.json"), p
            except ValueError as e:
                raise ValueError(f"{p}: {e}") from e
        if files.exists(f"{p}/data"):
            if header is None:
                raise ValueError(f"{p}: no header")
            try:
                about = files.read(f"{p}/columns.json") if files.exists(f"{p}/columns.json") else {}
                types = tuple(spark.read.parquet(f"{p}/data").dtypes)
                out.append(Entry(p, scope, Header.load(header), about, types))
            except (ValueError, TypeError) as e:
                raise ValueError(f"{p}: {e}") from e
            return
        for f in files.folders(p):
            walk(f, header, scope)

    if not files.exists(path):
        raise ValueError(f"{path}: not there")
    top = files.qualified(path)
    walk(top, None, top)
    if not out:
        raise ValueError(f"{path}: no data")
    return out


def load_dataset(spark: SparkSession, e: Entry) -> Dataset:
    """What a folder holds, after what hooks make of it."""
    made = _load(spark, e)
    return hooks.fold("lightcone_open" if isinstance(made, Lightcone) else "dataset_open", made)


def _load(spark: SparkSession, e: Entry) -> Dataset:
    df, about = spark.read.parquet(f"{e.path}/data"), e.about
    units, texts, static = about.get("units", {}), about.get("descriptions", {}), set(about.get("static", []))
    defs = {c: Stored(c, as_unit(units[c]) if units.get(c) else None, c in static, texts.get(c, "")) for c in df.columns if not c.startswith("__")}
    order = about.get("order") or [c for c in df.columns if not c.startswith("__")][:1]
    key, convention = about.get("key"), e.header.unit_convention if e.header.unit_convention in ("physical", "unitless") else "comoving"
    common = dict(convention=convention, coords=about.get("coords"), key=tuple(key) if key else None, region=None)
    if e.header.data_type == "healpix_map":
        m = e.header.healpix
        pixel = about.get("pixel", "pixel")
        if pixel not in df.columns:
            raise ValueError(f"{e.path}: a map has a column {pixel}")
        common.pop("key")
        return HealpixMap(df, {n: d for n, d in defs.items() if n != pixel}, e.header, [pixel], nside=m["nside"], pixel=pixel, full_sky=bool(m.get("full_sky")), **common)
    if e.header.is_lightcone:
        steps = {int(k): tuple(v) if v else None for k, v in about.get("steps", {}).items()}
        if STEP in df.columns:
            common["coords"] = common["coords"] or ("ra", "dec")
            return Lightcone(df, defs, e.header, order, steps=steps, z_range=e.header.z_range, **common)
        return Lightcone.from_datasets({e.header.step or 0: Dataset(df, defs, e.header, order, **common)})
    return Dataset(df, defs, e.header, order, **common)


def verify(entries: list[Entry]) -> None:
    """Datasets of one kind have the same columns; in lightcones each step has the same kinds."""
    kinds: dict[tuple[str, str], tuple] = {}
    for e in entries:
        at = (e.header.data_type, e.name)
        if kinds.setdefault(at, e.columns) != e.columns:
            raise ValueError(f"{e.path}: other columns than its like")
    steps: dict[int | None, set[str]] = {}
    for e in entries:
        if e.header.is_lightcone and e.header.step is not None:
            steps.setdefault(e.header.step, set()).add(e.header.data_type)
    if len({frozenset(x) for x in steps.values()}) > 1:
        raise ValueError("steps of different kinds of data")


def structure(spark: SparkSession, entries: list[Entry], ignore_empty: bool = False) -> StructureCollection:
    """Parents are halo properties, or else galaxy properties; galaxies with children of their own are structures within."""
    by: dict[str, list[Entry]] = {}
    for e in entries:
        by.setdefault(e.name, []).append(e)
    tables: dict[str, Dataset] = {}
    for name, es in by.items():
        made = [load_dataset(spark, e) for e in es]
        tables[name] = Lightcone.from_datasets(made) if es[0].header.is_lightcone and len(made) > 1 else made[0]
    kind = {n: es[0].header.data_type for n, es in by.items()}
    links = {n: {c: Link(tuple(x["parent"]), tuple(x["child"]), bool(x.get("single"))) for c, x in es[0].links.items()} for n, es in by.items()}
    source = next((n for k in PROPERTIES for n in tables if kind[n] == k and links[n]), None)
    if source is None:
        raise ValueError("no linked properties")

    def build(name: str) -> Any:
        mine = {c: ln for c, ln in links[name].items() if c in tables and kind[c] in OWNERS.get(kind[name], ())}
        if not mine:
            return tables[name]
        children = {("galaxies" if kind[c] == "galaxy_properties" and links[c] and any(x in tables for x in links[c]) else c): build(c) for c in mine}
        renamed = dict(zip(children, mine.values(), strict=True))
        return StructureCollection(tables[name], children, renamed, name)

    out = build(source)
    if not isinstance(out, StructureCollection):
        raise ValueError("no linked data")
    return out.remove_empty() if ignore_empty else out


#: Rules in order; the first that fits decides what a set of datasets opens as.
def is_structure(es: list[Entry]) -> bool:
    return any(e.header.data_type in PROPERTIES and e.links for e in es) and len({e.header.data_type for e in es}) > 1


def is_map(es: list[Entry]) -> bool:
    return len(es) == 1 and es[0].header.data_type == "healpix_map"


def is_lightcone(es: list[Entry]) -> bool:
    return all(e.header.is_lightcone for e in es) and len({e.header.data_type for e in es}) == 1


def is_dataset(es: list[Entry]) -> bool:
    return len(es) == 1


def build(spark: SparkSession, entries: list[Entry], ignore_empty: bool = False) -> Any:
    verify(entries)
    if is_structure(entries):
        return structure(spark, entries, ignore_empty)
    if is_map(entries):
        return load_dataset(spark, entries[0])
    if is_lightcone(entries):
        made = [load_dataset(spark, e) for e in entries]
        return made[0] if len(made) == 1 else Lightcone.from_datasets(made)
    if is_dataset(entries):
        return load_dataset(spark, entries[0])
    raise ValueError("the data fit no kind of collection")


def open(spark: SparkSession, *paths: str | Iterable[str], mode: str = "spatial", ignore_empty: bool = False, **flags: Any) -> Any:
    """What the paths hold: a dataset, lightcone, map or structure, or several simulations by name.

    Particles alone are a ValueError.  A dataset whose header has ``load_if`` opens only if each flag there is given so."""
    if mode not in ("spatial", "redshift"):
        raise ValueError(f"mode {mode!r}")
    flat = sorted(p for x in paths for p in ([x] if isinstance(x, str) else x))
    if not flat:
        raise ValueError("no paths")
    groups: dict[str, list[Entry]] = {}
    for p in flat:
        found, top = discover(spark, p), _Files(spark, p).qualified(p)
        below = {e.path: e.path[len(top) :].strip("/").split("/") for e in found}
        # folders side by side with headers of their own are simulations, but steps (such as 600_halos) and one folder's datasets are not
        several = len({x[0] for x in below.values() if len(x) > 1}) > 1 and all(e.scope != top for e in found) and not any(x[0].split("_")[0].isdigit() for x in below.values())
        for e in found:
            groups.setdefault(below[e.path][0] if several else "", []).append(e)
    kept = {g: [e for e in es if all(bool(flags.get(k, False)) == bool(v) for k, v in e.header.load_if.items())] for g, es in groups.items()}
    kept = {g: es for g, es in kept.items() if es}
    every = [e for es in kept.values() for e in es]
    if not every:
        raise ValueError("nothing to open")
    if all(e.header.data_type.endswith("_particles") for e in every):
        raise ValueError("particles open with the properties they belong to")
    if len(kept) > 1:
        return SimulationCollection({g: build(spark, es, ignore_empty) for g, es in sorted(kept.items())})
    return build(spark, every, ignore_empty)


def stored_df(ds: Dataset) -> tuple[DataFrame, dict[str, Any]]:
    """Columns as they are stored, whatever the units and sort of the moment; derived ones in the stored convention."""
    plain = ds._with(convention=ds.header.unit_convention, conversions=None, sort=None)
    public, hidden = [], [c for c in ds.base.columns if c.startswith("__") and c not in (KEY, PIXEL)]
    units, texts, static = {}, {}, []
    for n, d in plain.defs.items():
        x = plain._typed(d, n, False)
        public.append(x.column.alias(n))
        units[n] = str(x.unit) if x.unit else ""
        texts[n] = d.description
        if isinstance(d, Stored) and d.static:
            static.append(n)
    needed = [c for c in [*ds.order, *(ds.coords or ())] if c in ds.base.columns and c not in plain.defs and c not in hidden]
    df = plain.base.select(*public, *[F.col(c) for c in dict.fromkeys([*hidden, *needed])])
    return df, {"units": {k: v for k, v in units.items() if v}, "descriptions": {k: v for k, v in texts.items() if v}, "static": static, "order": list(ds.order), "coords": list(ds.coords) if ds.coords else None}


def write(path: str, obj: Any, overwrite: bool = False, partitions: int | None = None) -> None:
    """Writes a dataset or collection that ``open`` reads back.  An existing path is a FileExistsError unless ``overwrite``.

    Rows lie in order of their spatial key, so that files and row groups hold neighbours: octree cells of boxes, pixels of skies.
    Overwriting what ``obj`` itself reads is not possible: Spark refuses."""
    spark = _session(obj)
    files = _Files(spark, path)
    if files.exists(path):
        if not overwrite:
            raise FileExistsError(path)
        files.delete(path)
    _write(files, path.rstrip("/"), obj, partitions)


def _session(obj: Any) -> SparkSession:
    if isinstance(obj, SimulationCollection):
        return _session(next(iter(obj.values())))
    return (obj._source if isinstance(obj, StructureCollection) else obj).base.sparkSession


def _write(files: _Files, path: str, obj: Any, partitions: int | None, links: dict | None = None) -> None:
    if isinstance(obj, SimulationCollection):
        for n, m in obj.items():
            # a dataset in a folder of its own within its simulation's, so that simulations are told from the datasets of one
            _write(files, f"{path}/{n}/{m.header.data_type}" if isinstance(m, Dataset) else f"{path}/{n}", m, partitions)
        return
    if isinstance(obj, StructureCollection):
        own = {("galaxy_properties" if n == "galaxies" else n): {"parent": ln.parent, "child": ln.child, "single": ln.single} for n, ln in obj._links.items()}
        _write(files, f"{path}/{obj.source_name}", obj._source, partitions, own)
        for n in obj._children:
            child = obj[n]
            if isinstance(child, StructureCollection):
                inner = child._links
                _write(files, f"{path}/{child.source_name}", child._source, partitions, {k: {"parent": ln.parent, "child": ln.child, "single": ln.single} for k, ln in inner.items()})
                for k in child._children:
                    _write(files, f"{path}/{k}", child[k], partitions)
            else:
                _write(files, f"{path}/{n}", child, partitions)
        return
    df, about = stored_df(obj)
    header = obj.header
    if links:
        about["links"] = links
    sort: list[str] = []
    if isinstance(obj, HealpixMap):
        about["pixel"], sort = obj.pixel, [obj.pixel]
        header = replace(header, healpix=header.healpix | {"full_sky": obj.full_sky})
    elif isinstance(obj, Lightcone):
        header = replace(header, is_lightcone=True, z_range=obj.z_range, redshift=max([r[1] for r in obj.steps.values() if r], default=header.redshift), step=max(obj.steps, default=None))
        about["steps"] = {str(k): v for k, v in obj.steps.items()}
        if {"ra", "dec"} <= set(df.columns):
            df, sort = df.withColumn(PIXEL, healpix.pixel_column(1 << LEVEL, F.col("ra"), F.col("dec"))), [PIXEL]
            about["key"] = [PIXEL, LEVEL, 0.0]
    elif obj.coords and "box_size" in header.simulation and set(obj.coords) <= set(df.columns):
        size = float(header.simulation["box_size"])
        df, sort = df.withColumn(KEY, octree.key_column([F.col(c) for c in obj.coords], size, KEY_LEVEL)), [KEY]
        about["key"] = [KEY, KEY_LEVEL, size]
    if obj._region is not None:
        header = replace(header, region=obj._region)
    if sort:
        df = (df.repartitionByRange(partitions, *sort) if partitions else df.repartitionByRange(*sort)).sortWithinPartitions(*sort, *[c for c in obj.order if c in df.columns])
    df.write.parquet(f"{path}/data")
    files.write(f"{path}/columns.json", about)
    files.write(f"{path}/header.json", header.dump())


def write_parquet(path: str, obj: Any, overwrite: bool = False) -> None:
    """Plain Parquet in current units: a dataset or lightcone one folder, the particles of a structure one each (others: a warning).

    Nested fields become columns of their own."""
    mode = "overwrite" if overwrite else "errorifexists"
    if isinstance(obj, StructureCollection):
        files = _Files(_session(obj), path)
        if files.exists(path) and not overwrite:
            raise FileExistsError(path)
        for n, m in obj.items():
            if isinstance(m, StructureCollection) or not n.endswith("particles"):
                warnings.warn(f"{n} is not written: only particles of structures are", stacklevel=2)
                continue
            write_parquet(f"{path.rstrip('/')}/{n}", m, overwrite)
        return
    if not isinstance(obj, Dataset):
        raise ValueError("datasets, lightcones and structures can be written")
    if len(obj.columns) == 1:
        raise NotImplementedError("a single column")
    df, flat = obj.to_df(ordered=bool(obj.sort)), []
    for f in df.schema.fields:
        inner = getattr(f.dataType, "fields", None)
        flat += [F.col(f"`{f.name}`.`{x.name}`").alias(f"{f.name}_{x.name}") for x in inner] if inner else [F.col(f"`{f.name}`")]
    if not overwrite and _Files(_session(obj), path).exists(path):
        raise FileExistsError(path)
    df.select(*flat).write.mode(mode).parquet(path)


def rewrite_links(df: DataFrame, order: list[str], size: str | None = None, idx: str | None = None, start: str = "start") -> DataFrame:
    """Links of a written selection: ``start`` is the sum of the sizes before, ``idx`` counts the rows that have one, -1 stays.

    Sums before are those of ranges of the first order column, and of the rows before within a range."""
    from pyspark.sql import Window as W

    from ..plans.positions import with_position

    value = F.col(size) if size else (F.col(idx) >= 0).cast("long")
    placed = with_position(df, [(F.col(c), False) for c in order], "__at").withColumn("__block", F.floor(F.col("__at") / BLOCK))
    totals = placed.groupBy("__block").agg(F.sum(value).alias("__sum"))
    before = F.coalesce(F.sum("__sum").over(W.orderBy("__block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inner = F.coalesce(F.sum(value).over(W.partitionBy("__block").orderBy("__at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    run = placed.withColumn("__in", inner).join(totals.select("__block", before.alias("__before")), "__block").withColumn("__start", (F.col("__before") + F.col("__in")).cast("long"))
    run = run.drop("__at", "__block", "__in", "__before")
    if size:
        return run.withColumnRenamed("__start", start)
    return run.withColumn(idx, F.when(F.col(idx) >= 0, F.col("__start")).otherwise(F.lit(-1)).cast("long")).drop("__start")


#: Rows that link sums are made over together; a row for each such block goes through one task.
BLOCK = 1 << 20


__all__ = ["discover", "open", "rewrite_links", "write", "write_parquet"]
