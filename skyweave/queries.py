"""Queries over the driver's tables, one or more for each operator, and the same in SQL.

Parents are customers, galaxies orders, particles lineitems, redshift steps order years, simulations regions;
sky positions and pixels are made from keys.  Each query gives a plan.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import analysis
from .collections import hosts
from .collections.healpix_map import HealpixMap
from .collections.lightcone import Lightcone
from .collections.simulation import SimulationCollection
from .collections.structure import StructureCollection, link, links_from_positions
from .functions.expr import add_mag_cols, col, norm_cols, offset_3d
from .functions.units import u
from .operators.dataset import Dataset
from .plans import healpix, octree
from .plans.cosmology import Cosmology
from .plans.positions import with_position
from .plans.regions import make_box, make_cone, make_skybox
from .sources import catalog
from .sources.catalog import rewrite_links
from .sources.header import Header

Q = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Q] = {}
SQL: dict[str, str] = {}
H = 0.6766
LINE_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def query(sql: str | None = None) -> Callable[[Q], Q]:
    def add(f: Q) -> Q:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def orders(spark, sf, **more) -> Dataset:
    return Dataset.from_dataframe(read(spark, sf, "orders"), "o_orderkey", {"o_totalprice": "Msun"}, **more)


def customers(spark, sf) -> Dataset:
    return Dataset.from_dataframe(read(spark, sf, "customer"), "c_custkey")


def lines(spark, sf, **more) -> Dataset:
    return Dataset.from_dataframe(read(spark, sf, "lineitem"), LINE_ORDER, **more)


price, qty, ext, disc, tax = col("o_totalprice"), col("l_quantity"), col("l_extendedprice"), col("l_discount"), col("l_tax")


# -- filters


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 300000")
def filter_basic(spark, sf):
    return orders(spark, sf).filter(price > 300000).select("o_orderkey", "o_totalprice").to_df()


@query("SELECT o_orderkey FROM orders WHERE (o_totalprice > 400000 OR o_totalprice < 20000) AND o_custkey >= 100")
def filter_or_tree(spark, sf):
    return orders(spark, sf).filter((price > 400000) | (price < 20000), col("o_custkey") >= 100).select("o_orderkey").to_df()


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_nationkey IN (1, 3, 5, 7)")
def filter_isin(spark, sf):
    return customers(spark, sf).filter(col("c_nationkey").isin([1, 3, 5, 7])).select("c_custkey", "c_mktsegment").to_df()


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_linenumber <> 1")
def filter_not_equal(spark, sf):
    return lines(spark, sf).filter(col("l_linenumber") != 1).select("l_orderkey", "l_linenumber", "l_partkey").to_df()


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_partkey < l_suppkey * 2 + 7 AND l_quantity <= 10")
def filter_col_vs_col(spark, sf):
    return lines(spark, sf).filter(col("l_partkey") < col("l_suppkey") * 2 + 7, qty <= 10).select("l_orderkey", "l_linenumber", "l_quantity").to_df()


@query(f"SELECT o_orderkey, o_totalprice / {H} AS o_totalprice FROM orders WHERE o_totalprice > 350000 * {H}")
def filter_unit_literal(spark, sf):
    """Stored per h: the constant is converted, so the comparison reaches the scan."""
    header = Header(unit_convention="scalefree", cosmology=Cosmology(h=H, om0=0.31))
    ds = Dataset.from_dataframe(read(spark, sf, "orders"), "o_orderkey", {"o_totalprice": "Msun/h"}, header)
    return ds.filter(price > 350000 * u("Msun")).select("o_orderkey", "o_totalprice").to_df()


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
def filter_above_mean(spark, sf):
    return orders(spark, sf).filter(price > price.mean()).select("o_orderkey").to_df()


@query("SELECT o_orderkey FROM orders WHERE o_totalprice < (SELECT quantile_cont(o_totalprice, 0.1) FROM orders)")
def filter_below_quantile(spark, sf):
    return orders(spark, sf).filter(price < price.quantile(0.1)).select("o_orderkey").to_df()


@query("""SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) + stddev_pop(o_totalprice) FROM orders)
OR o_totalprice <= (SELECT (min(o_totalprice) + median(o_totalprice)) / 2 FROM orders)""")
def filter_compound_scalar(spark, sf):
    return orders(spark, sf).filter((price > price.mean() + price.std()) | (price <= (price.min() + price.median()) / 2)).select("o_orderkey").to_df()


@query("""WITH a AS (SELECT * FROM orders WHERE o_totalprice > 100000)
SELECT o_orderkey FROM a WHERE o_totalprice > (SELECT avg(o_totalprice) FROM a)""")
def filter_scalar_after_filter(spark, sf):
    return orders(spark, sf).filter(price > 100000).filter(price > price.mean()).select("o_orderkey").to_df()


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_discount <> 0 AND l_extendedprice / l_discount > 1000000 OR l_discount = 0")
def filter_ratio_by_zero(spark, sf):
    """A price over a discount of 0 is infinite, hence above any bound."""
    return lines(spark, sf).filter(ext / disc > 1000000).select("l_orderkey", "l_linenumber", "l_partkey").to_df()


# -- columns


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def select_wildcard(spark, sf):
    return customers(spark, sf).select("c_*").to_df()


@query("SELECT o_custkey, o_orderstatus, o_totalprice FROM orders")
def drop_wildcard(spark, sf):
    return orders(spark, sf).drop("o_order*y", "o_orderdate").to_df()


@query("""SELECT avg(o_totalprice) AS mean, stddev_pop(o_totalprice) AS std, var_pop(o_totalprice) AS var, min(o_totalprice) AS lo, max(o_totalprice) AS hi,
median(o_totalprice) AS mid, round(sum(o_totalprice), 2) AS total, quantile_cont(o_totalprice, 0.9) AS q9 FROM orders""")
def select_scalar_stats(spark, sf):
    df = orders(spark, sf).scalar_df(mean=price.mean(), std=price.std(), var=price.var(), lo=price.min(), hi=price.max(), mid=price.median(), total=price.sum(), q9=price.quantile(0.9))
    return df.withColumn("total", F.round("total", 2))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem")
def derive_arith(spark, sf):
    return lines(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", charge=ext * (1 - disc) * (1 + tax)).to_df()


@query("SELECT o_orderkey, o_totalprice * 2 AS a, o_totalprice * 2 + o_totalprice AS b, (o_totalprice * 2 + o_totalprice) / (o_totalprice * 2) AS c FROM orders")
def derive_chain(spark, sf):
    ds = orders(spark, sf).with_new_columns(c=col("b") / col("a"), b=col("a") + price, a=price * 2)
    return ds.select("o_orderkey", "a", "b", "c").to_df()


@query("SELECT o_orderkey, round(log10(o_totalprice), 9) AS lg, round(pow(10.0, log10(o_totalprice)), 6) AS back FROM orders")
def derive_log10_exp10(spark, sf):
    ds = orders(spark, sf).with_new_columns(lg=price.log10())
    return ds.with_new_columns(back=col("lg").exp10()).select("o_orderkey", "lg", "back").to_df().withColumns({"lg": F.round("lg", 9), "back": F.round("back", 6)})


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round(sqrt(l_extendedprice), 9) AS root, round(asin(l_discount), 9) AS arcsine, round(acos(l_tax), 9) AS arccosine, round(atan2(l_tax, l_quantity), 9) AS arc
FROM lineitem""")
def derive_sqrt_trig(spark, sf):
    ds = lines(spark, sf)
    return ds.select("l_orderkey", "l_linenumber", "l_partkey", root=ext.sqrt(), arcsine=disc.arcsin(), arccosine=tax.arccos(), arc=tax.arctan2(qty)).to_df().withColumns({c: F.round(c, 9) for c in ("root", "arcsine", "arccosine", "arc")})


@query("SELECT o_orderkey, o_totalprice + 1 AS o_totalprice, o_totalprice * 2 AS twice FROM orders")
def derive_overwrite(spark, sf):
    """What was derived from the old column keeps it."""
    ds = orders(spark, sf).with_new_columns(twice=price * 2).with_new_columns(allow_overwrite=True, o_totalprice=price + 1 * u("Msun"))
    return ds.select("o_orderkey", "o_totalprice", "twice").to_df()


@query("SELECT o_orderkey, o_totalprice AS cost FROM orders")
def derive_alias(spark, sf):
    return orders(spark, sf).select("o_orderkey", price.alias("cost")).to_df()


def _stats(columns: str, where: str = "") -> str:
    return f"""WITH s AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS sd, min(o_totalprice) AS lo, max(o_totalprice) AS hi, sum(o_totalprice) AS t,
quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3, median(o_totalprice) AS md FROM orders)
SELECT o_orderkey, round({columns}, 9) AS v FROM orders CROSS JOIN s {where}"""


def _derived(spark, sf, e) -> DataFrame:
    return orders(spark, sf).select("o_orderkey", v=e).to_df().withColumn("v", F.round("v", 9))


@query(_stats("(o_totalprice - m) / sd"))
def derive_zscore(spark, sf):
    return _derived(spark, sf, (price - price.mean()) / price.std())


@query(_stats("(o_totalprice - lo) / (hi - lo)"))
def derive_minmax(spark, sf):
    return _derived(spark, sf, (price - price.min()) / (price.max() - price.min()))


@query(_stats("(o_totalprice - md) / (q3 - q1)"))
def derive_iqr(spark, sf):
    return _derived(spark, sf, (price - price.median()) / (price.quantile(0.75) - price.quantile(0.25)))


@query(_stats("o_totalprice / t"))
def derive_fraction(spark, sf):
    return _derived(spark, sf, price / price.sum())


@query("""WITH a AS (SELECT o_orderkey, o_totalprice * o_custkey AS w FROM orders)
SELECT o_orderkey, round(w / (SELECT avg(w) FROM a), 9) AS v FROM a""")
def derive_scalar_on_derived(spark, sf):
    ds = orders(spark, sf).with_new_columns(w=price * col("o_custkey"))
    return ds.select("o_orderkey", v=col("w") / col("w").mean()).to_df().withColumn("v", F.round("v", 9))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(sqrt(l_quantity * l_quantity + l_tax * l_tax + l_discount * l_discount), 9) AS norm FROM lineitem")
def norm_columns(spark, sf):
    return lines(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", norm=norm_cols("l_quantity", "l_tax", "l_discount")).to_df().withColumn("norm", F.round("norm", 9))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round(sqrt(pow(l_quantity - l_discount, 2) + pow(l_tax - l_extendedprice, 2)), 6) AS apart
FROM lineitem""")
def offset_of_points(spark, sf):
    df = read(spark, sf, "lineitem").withColumns({"a_x": F.col("l_quantity"), "b_x": F.col("l_discount"), "a_y": F.col("l_tax"), "b_y": F.col("l_extendedprice")})
    ds = Dataset.from_dataframe(df, LINE_ORDER)
    return ds.select("l_orderkey", "l_linenumber", "l_partkey", apart=offset_3d("a", "b", ("x", "y"))).to_df().withColumn("apart", F.round("apart", 6))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(-2.5 * log10(pow(10.0, -0.4 * l_quantity) + pow(10.0, -0.4 * l_linenumber)), 9) AS mag FROM lineitem")
def add_magnitudes(spark, sf):
    return lines(spark, sf).select("l_orderkey", "l_linenumber", "l_partkey", mag=add_mag_cols("l_quantity", "l_linenumber")).to_df().withColumn("mag", F.round("mag", 9))


# -- order and positions


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 20")
def sort_take_start(spark, sf):
    return orders(spark, sf).sort_by("o_totalprice").take(20, "start").select("o_orderkey", "o_totalprice").to_df()


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def sort_desc_take_start(spark, sf):
    return orders(spark, sf).sort_by("o_totalprice", invert=True).take(20, "start").select("o_orderkey", "o_totalprice").to_df()


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey DESC LIMIT 20")
def sort_take_end(spark, sf):
    return orders(spark, sf).sort_by("o_totalprice").take(20, "end").select("o_orderkey", "o_totalprice").to_df()


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 50 OFFSET 100")
def take_range(spark, sf):
    return orders(spark, sf).sort_by("o_totalprice").take_range(100, 150).select("o_orderkey").to_df()


@query("""SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS p FROM orders) WHERE p IN (0, 3, 77, 500, 1234)""")
def take_rows(spark, sf):
    return orders(spark, sf).sort_by("o_totalprice").take_rows([3, 0, 77, 1234, 500]).select("o_orderkey").to_df()


@query("SELECT o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 50) ORDER BY o_orderkey DESC LIMIT 10")
def take_twice(spark, sf):
    return orders(spark, sf).take(50, "start").take(10, "end").select("o_orderkey").to_df()


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice / l_quantity AS unit FROM lineitem ORDER BY l_extendedprice / l_quantity DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice LIMIT 25")
def sort_by_derived(spark, sf):
    return lines(spark, sf).with_new_columns(unit=ext / qty).sort_by("unit", invert=True).take(25, "start").select("l_orderkey", "l_linenumber", "l_partkey", "unit").to_df()


@query("SELECT 100::BIGINT AS n, 100::BIGINT AS different")
def take_random_count(spark, sf):
    return orders(spark, sf).take(100, seed=4).to_df().agg(F.count("*").alias("n"), F.countDistinct("o_orderkey").alias("different"))


# -- units

_A = 1 / 1.5


def _scaled(spark, sf) -> Dataset:
    header = Header(unit_convention="scalefree", redshift=0.5, cosmology=Cosmology(h=H, om0=0.31))
    df = read(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.col("o_custkey").cast("double").alias("speed"))
    return Dataset.from_dataframe(df, "o_orderkey", {"o_totalprice": "Mpc/h", "speed": "km/s"}, header)


@query(f"SELECT o_orderkey, round(o_totalprice / {H}, 6) AS o_totalprice, o_custkey::DOUBLE AS speed FROM orders")
def units_comoving(spark, sf):
    return _scaled(spark, sf).to_df().withColumn("o_totalprice", F.round("o_totalprice", 6))


@query(f"SELECT o_orderkey, round(o_totalprice / {H} * {_A!r}, 6) AS o_totalprice, round(o_custkey * {_A!r}, 9) AS speed FROM orders")
def units_physical(spark, sf):
    """Any power of length scales, velocities too."""
    return _scaled(spark, sf).with_units("physical").to_df().withColumns({"o_totalprice": F.round("o_totalprice", 6), "speed": F.round("speed", 9)})


@query(f"SELECT o_orderkey, round(o_totalprice / {H} * 1000, 3) AS o_totalprice, o_custkey::DOUBLE AS speed FROM orders")
def units_blanket(spark, sf):
    return _scaled(spark, sf).with_units(conversions={"Mpc": "kpc"}).to_df().withColumn("o_totalprice", F.round("o_totalprice", 3))


@query(f"SELECT o_orderkey, round(o_totalprice / {H}, 6) AS o_totalprice, round(o_custkey * 1000.0, 6) AS speed FROM orders")
def units_column(spark, sf):
    return _scaled(spark, sf).with_units(speed="m/s").to_df().withColumns({"o_totalprice": F.round("o_totalprice", 6), "speed": F.round("speed", 6)})


@query(f"SELECT o_orderkey, round(1e-6 * pow(o_totalprice / {H} * {_A!r}, 2) * o_custkey * {_A!r}, 1) AS v FROM orders")
def units_derived(spark, sf):
    """Derived columns follow the convention of what they are made of."""
    ds = _scaled(spark, sf).with_new_columns(v=price**2 * col("speed") * 1e-6).with_units("physical")
    return ds.select("o_orderkey", "v").to_df().withColumn("v", F.round("v", 1))


# -- space


def _points(spark, sf, **more) -> Dataset:
    df = read(spark, sf, "lineitem").withColumns({"x": F.col("l_quantity"), "y": F.col("l_discount") * 100, "z": F.col("l_tax") * 100})
    return Dataset.from_dataframe(df, LINE_ORDER, coords=("x", "y", "z"), **more)


@query("SELECT count(*)::BIGINT AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem WHERE l_quantity > 10 AND l_quantity < 20 AND l_discount * 100 > 1.5 AND l_discount * 100 < 6.5 AND l_tax * 100 > 0.5 AND l_tax * 100 < 5.5")
def box_bound(spark, sf):
    return _points(spark, sf).bound(make_box((20, 1.5, 5.5), (10, 6.5, 0.5))).to_df().agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("SELECT count(*)::BIGINT AS n FROM lineitem WHERE l_quantity > 15 AND l_quantity < 18 AND l_discount * 100 > 1.5 AND l_discount * 100 < 4.5 AND l_tax * 100 > 0.5 AND l_tax * 100 < 5.5 AND l_linenumber > 2")
def box_bound_chain(spark, sf):
    ds = _points(spark, sf).bound(make_box((10, 1.5, 0.5), (20, 6.5, 5.5))).filter(col("l_linenumber") > 2)
    return ds.bound(make_box((15, 1.5, 0.5), (18, 4.5, 5.5))).to_df().agg(F.count("*").alias("n"))


@query(f"SELECT count(*)::BIGINT AS n FROM lineitem WHERE l_quantity > 10 * {H} AND l_quantity < 60 * {H} AND l_discount * 100 > 1.5 * {H} AND l_discount * 100 < 9.5 * {H} AND l_tax * 100 > 0.5 * {H} AND l_tax * 100 < 9.5 * {H}")
def box_after_units(spark, sf):
    header = Header(unit_convention="scalefree", cosmology=Cosmology(h=H, om0=0.31))
    df = read(spark, sf, "lineitem").withColumns({"x": F.col("l_quantity"), "y": F.col("l_discount") * 100, "z": F.col("l_tax") * 100})
    ds = Dataset.from_dataframe(df, LINE_ORDER, dict.fromkeys("xyz", "Mpc/h"), header, coords=("x", "y", "z"))
    return ds.bound(make_box((10, 1.5, 0.5), (60, 9.5, 9.5))).to_df().agg(F.count("*").alias("n"))


@query("SELECT count(*)::BIGINT AS n FROM lineitem WHERE l_quantity > 10 AND l_quantity < 20 AND l_discount * 100 > 1.5 AND l_discount * 100 < 6.5 AND l_tax * 100 > 0.5 AND l_tax * 100 < 5.5")
def box_with_octree_key(spark, sf):
    """Written in order of its Morton key, opened again: ranges of the stored key prune before the exact test."""
    return _stored(spark, "points", sf, lambda: _points(spark, sf, header=Header("halo_properties", simulation={"box_size": 64.0}))).bound(make_box((10, 1.5, 0.5), (20, 6.5, 5.5))).to_df().agg(F.count("*").alias("n"))


#: Two multiplicative hashes of a key, so that the directions fill the sphere.
SKY = {"ra": "((o_orderkey * 7368787) % 1000003) * 360.0 / 1000003", "dec": "degrees(asin(2 * (((o_orderkey * 5915587) % 999983) + 0.5) / 999983 - 1))"}


def _ra(k: Column) -> Column:
    return (k * 7368787) % 1000003 * 360.0 / 1000003


def _dec(k: Column) -> Column:
    return F.degrees(F.asin(2 * ((k * 5915587) % 999983 + 0.5) / 999983 - 1))



def _sky(spark, sf) -> Lightcone:
    k = F.col("o_orderkey")
    year = F.year("o_orderdate")
    df = read(spark, sf, "orders").withColumns({"ra": _ra(k), "dec": _dec(k), "redshift": (year - 1994) * 0.1 + F.month("o_orderdate") * 0.005, "year": year})
    steps = {y: ((y - 1994) * 0.1, (y - 1994) * 0.1 + 0.1) for y in range(1995, 2002)}
    return Lightcone.of(df, "o_orderkey", "year", {"o_totalprice": "Msun", "ra": "deg", "dec": "deg"}, steps=steps)


_SKY = f"(SELECT *, {SKY['ra']} AS ra, {SKY['dec']} AS \"dec\", (year(o_orderdate) - 1994) * 0.1 + month(o_orderdate) * 0.005 AS redshift, year(o_orderdate) AS year FROM orders)"
_AWAY = 'degrees(2 * asin(least(1.0, sqrt(pow(sin((radians("dec") - radians({d})) / 2), 2) + cos(radians({d})) * cos(radians("dec")) * pow(sin((radians(ra) - radians({r})) / 2), 2)))))'


@query(f"SELECT o_orderkey FROM {_SKY} WHERE {_AWAY.format(r=120.0, d=30.0)} < 25")
def cone_search(spark, sf):
    return _sky(spark, sf).cone_search((120.0, 30.0), 25.0).select("o_orderkey").to_df()


@query(f"SELECT o_orderkey FROM {_SKY} WHERE {_AWAY.format(r=120.0, d=30.0)} < 25")
def cone_search_by_pixels(spark, sf):
    """On a stored pixel, which the scan is pruned by."""
    return _stored(spark, "sky", sf, lambda: _sky(spark, sf)).cone_search((120.0, 30.0), 25.0).select("o_orderkey").to_df()


@query(f"SELECT o_orderkey FROM {_SKY} WHERE {_AWAY.format(r=10.0, d=5.0)} < 89")
def wide_cone_by_stored_pixels(spark, sf):
    """A cone of hundreds of pixel ranges, of which the predicate keeps a bounded number."""
    return _stored(spark, "sky", sf, lambda: _sky(spark, sf)).cone_search((10.0, 5.0), 89.0).select("o_orderkey").to_df()


@query(f'SELECT o_orderkey FROM {_SKY} WHERE ra > 10 AND ra < 200 AND "dec" > -60 AND "dec" < 60')
def wide_skybox_by_stored_pixels(spark, sf):
    return _stored(spark, "sky", sf, lambda: _sky(spark, sf)).bound(make_skybox((10, -60), (200, 60))).select("o_orderkey").to_df()


@query(f"SELECT o_orderkey FROM {_SKY} WHERE {_AWAY.format(r=80.0, d=-50.0)} < 10 AND o_totalprice > 100000")
def cone_then_filter_by_stored_pixels(spark, sf):
    return _stored(spark, "sky", sf, lambda: _sky(spark, sf)).cone_search((80.0, -50.0), 10.0).filter(price > 100000).select("o_orderkey").to_df()


@query(f'SELECT o_orderkey FROM {_SKY} WHERE ra > 40 AND ra < 90 AND "dec" > -20 AND "dec" < 35')
def skybox_search(spark, sf):
    return _sky(spark, sf).bound(make_skybox((90, -20), (40, 35))).select("o_orderkey").to_df()


@query(f"SELECT o_orderkey, o_totalprice FROM {_SKY} WHERE {_AWAY.format(r=200.0, d=-40.0)} < 30 AND o_totalprice > 250000")
def cone_then_filter(spark, sf):
    return _sky(spark, sf).bound(make_cone((200.0, -40.0), 30.0)).filter(price > 250000).select("o_orderkey", "o_totalprice").to_df()


_CELLS = "least(7, greatest(0, floor(l_quantity / 8)))::BIGINT AS i, least(7, greatest(0, floor(l_discount * 100 / 8)))::BIGINT AS j, least(7, greatest(0, floor(l_tax * 100 / 8)))::BIGINT AS k"
_MORTON = " + ".join(f"((({axis} >> {b}) & 1) << {3 * b + s})" for s, axis in enumerate("ijk") for b in range(3))


@query(f"SELECT cell::BIGINT AS cell, count(*)::BIGINT AS n FROM (SELECT {_MORTON} AS cell FROM (SELECT {_CELLS} FROM lineitem)) GROUP BY cell")
def zorder_cell_counts(spark, sf):
    df = _points(spark, sf).to_df()
    return df.groupBy(octree.key_column([F.col(c) for c in "xyz"], 64.0, 3).alias("cell")).agg(F.count("*").alias("n"))


@query(f"""WITH c AS (SELECT {_MORTON} AS cell FROM (SELECT {_CELLS} FROM lineitem)), l AS (SELECT unnest([0, 1, 2, 3]) AS level)
SELECT level::INT AS level, (cell >> (3 * (3 - level)))::BIGINT AS cell, count(*)::BIGINT AS n FROM c CROSS JOIN l GROUP BY ALL""")
def octree_rollup(spark, sf):
    return octree.cell_counts(_points(spark, sf).to_df(), octree.key_column([F.col(c) for c in "xyz"], 64.0, 3), 3)


# -- sources and sinks

#: What queries have written in this session, by application, kind and input.
_WRITTEN: dict[tuple, str] = {}


def _folder(spark) -> str:
    """A folder that the driver and the executors share; Spark deletes it when it ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or "file:///tmp/checkpoints"
    path = f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/catalogue-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def _stored(spark, kind: str, sf: str, make: Callable) -> Any:
    """A collection as it is written and opened again; written once a session."""
    at = (spark.sparkContext.applicationId, kind, sf)
    if at not in _WRITTEN:
        path = _folder(spark)
        catalog.write(path, make())
        _WRITTEN[at] = path
    return catalog.open(spark, _WRITTEN[at])


@query("SELECT o_orderkey, o_custkey, o_totalprice, round(o_totalprice * 2, 2) AS twice FROM orders WHERE o_totalprice > 200000")
def write_open_dataset(spark, sf):
    """Derived columns are written; filters hold."""
    ds = _stored(spark, "dear", sf, lambda: orders(spark, sf, header=Header("halo_properties")).filter(price > 200000).with_new_columns(twice=price * 2).select("o_orderkey", "o_custkey", "o_totalprice", "twice"))
    return ds.to_df().withColumn("twice", F.round("twice", 2))


@query(f"SELECT o_orderkey, round(o_totalprice / {H} * {_A!r}, 6) AS o_totalprice FROM orders WHERE o_totalprice / {H} * {_A!r} > 300000")
def write_open_units(spark, sf):
    """Stored units and the header come back: another convention after opening, and a filter in it."""

    def make():
        header = Header("halo_properties", unit_convention="scalefree", redshift=0.5, cosmology=Cosmology(h=H, om0=0.31))
        return Dataset.from_dataframe(read(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", {"o_totalprice": "Mpc/h"}, header).with_units("physical")

    return _stored(spark, "units", sf, make).with_units("physical").filter(price > 300000).to_df().withColumn("o_totalprice", F.round("o_totalprice", 6))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def write_open_structure(spark, sf):
    """Links come back as keys, and a filter of the parents reaches the children."""

    def make():
        source = Dataset.from_dataframe(read(spark, sf, "customer"), "c_custkey", header=Header("halo_properties"))
        kids = orders(spark, sf, header=Header("halo_particles"))
        return StructureCollection(source, {"halo_particles": kids}, {"halo_particles": link("c_custkey", "o_custkey")}, "halo_properties")

    return _stored(spark, "structure", sf, make).filter(col("c_acctbal") > 5000)["halo_particles"].select("o_orderkey", "o_custkey").to_df()


@query(f"SELECT o_orderkey, round(redshift, 6) AS redshift FROM {_SKY} WHERE redshift > 0.3 AND redshift < 0.52")
def write_open_lightcone(spark, sf):
    """Steps and redshift ranges come back."""
    return _stored(spark, "sky", sf, lambda: _sky(spark, sf)).with_redshift_range(0.3, 0.52).select("o_orderkey", "redshift").to_df().withColumn("redshift", F.round("redshift", 6))


@query("SELECT event_id % 3072 AS pixel, round(avg(value), 6) AS tsz FROM events GROUP BY 1 HAVING avg(value) > 60")
def write_open_map(spark, sf):
    got = _stored(spark, "map", sf, lambda: _map(spark, sf)).filter(col("tsz") > 60).select("tsz").to_df(hidden=["pixel"])
    return got.select(F.col("pixel").cast("long").alias("pixel"), F.round("tsz", 6).alias("tsz"))


@query("SELECT c_custkey, 'sim' || n_regionkey AS sim FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 7000")
def write_open_simulations(spark, sf):
    """Several simulations by their folders' names."""

    def make():
        return SimulationCollection({n: Dataset.from_dataframe(m.base, "c_custkey", header=Header("halo_properties")) for n, m in _sims(spark, sf).items()})

    return _all(_stored(spark, "simulations", sf, make).filter(col("c_acctbal") > 7000).select("c_custkey"))


@query(f"SELECT o_orderkey, round(o_totalprice / {H}, 6) AS o_totalprice FROM orders")
def write_plain_parquet(spark, sf):
    """Plain Parquet holds current units."""
    header = Header(unit_convention="scalefree", cosmology=Cosmology(h=H, om0=0.31))
    path = _folder(spark)
    catalog.write_parquet(path, Dataset.from_dataframe(read(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", {"o_totalprice": "Msun/h"}, header))
    return spark.read.parquet(path).withColumn("o_totalprice", F.round("o_totalprice", 6))


# -- maps


def _map(spark, sf, nside: int = 16) -> HealpixMap:
    df = read(spark, sf, "events").groupBy((F.col("event_id") % (12 * nside * nside)).alias("pixel")).agg(F.avg("value").alias("tsz"), F.max("value").alias("ksz"))
    return HealpixMap.of(df, nside, full_sky=True)


_MAP = "(SELECT event_id % 3072 AS pixel, avg(value) AS tsz, max(value) AS ksz FROM events GROUP BY 1)"


@query(f"SELECT (pixel >> 4)::BIGINT AS pixel, round(avg(tsz)::FLOAT, 2) AS tsz, round(avg(ksz)::FLOAT, 2) AS ksz FROM {_MAP} GROUP BY 1")
def pixel_downgrade(spark, sf):
    return _map(spark, sf).with_resolution(4).to_df(hidden=["pixel"]).withColumns({"tsz": F.round("tsz", 2), "ksz": F.round("ksz", 2)})


@query(f"SELECT pixel::BIGINT AS pixel, tsz FROM {_MAP} WHERE tsz > 60")
def map_filter(spark, sf):
    return _map(spark, sf).filter(col("tsz") > 60).select("tsz").to_df(hidden=["pixel"])


def _disc(nside: int, ra: float, dec: float, radius: float) -> str:
    return ", ".join(map(str, healpix.query_disc(nside, ra, dec, radius, inclusive=False).tolist()))


@query(f"SELECT pixel::BIGINT AS pixel, tsz FROM {_MAP} WHERE pixel IN ({_disc(16, 80.0, 20.0, 12.0)})")
def map_cone(spark, sf):
    return _map(spark, sf).cone_search((80.0, 20.0), 12.0).select("tsz").to_df(hidden=["pixel"])


@query(f"SELECT pixel::BIGINT AS pixel, ksz FROM {_MAP} ORDER BY ksz DESC, pixel LIMIT 15")
def map_sort_take(spark, sf):
    return _map(spark, sf).sort_by("ksz", invert=True).take(15, "start").select("ksz").to_df(hidden=["pixel"])


def _pixels_sql(nside: int) -> str:
    """The pixel of ra and dec in the belt and at the poles, written out for one nside."""
    k = nside.bit_length() - 1
    bits = lambda v: " + ".join(f"((({v} >> {b}) & 1) << {2 * b})" for b in range(k))
    return f"""(SELECT *, face * {nside * nside} + {bits('px')} + 2 * ({bits('py')}) AS pixel FROM (
SELECT *, CASE WHEN belt THEN CASE WHEN fa = fb THEN (fa & 3) | 4 WHEN fa < fb THEN fa & 3 ELSE (fb & 3) + 8 END WHEN zz > 0 THEN quarter ELSE quarter + 8 END AS face,
CASE WHEN belt THEN b & {nside - 1} WHEN zz > 0 THEN {nside} - cd - 1 ELSE cc END AS px,
CASE WHEN belt THEN {nside} - (a & {nside - 1}) - 1 WHEN zz > 0 THEN {nside} - cc - 1 ELSE cd END AS py FROM (
SELECT *, a >> {k} AS fa, b >> {k} AS fb, abs(zz) <= 2.0 / 3 AS belt,
least(floor((t - quarter) * size)::BIGINT, {nside - 1}) AS cc, least(floor((quarter + 1 - t) * size)::BIGINT, {nside - 1}) AS cd FROM (
SELECT *, floor({nside} * (t + 0.5) - {nside} * 0.75 * zz)::BIGINT AS a, floor({nside} * (t + 0.5) + {nside} * 0.75 * zz)::BIGINT AS b, least(floor(t)::BIGINT, 3) AS quarter,
{nside * math.sqrt(6)!r} * abs(sin(radians(45.0 - abs("dec") / 2))) AS size FROM (
SELECT *, sin(radians("dec")) AS zz, ra / 90.0 AS t FROM {_SKY})))))"""


@query(f"SELECT o_orderkey, pixel::BIGINT AS pixel FROM {_pixels_sql(32)}")
def pixel_of_directions(spark, sf):
    """The nested pixel of each row, within generated code."""
    ds = _sky(spark, sf)
    return ds.base.select("o_orderkey", healpix.pixel_column(32, F.col("ra"), F.col("dec")).alias("pixel"))


@query(f"SELECT o_orderkey FROM {_pixels_sql(8)} WHERE pixel IN (3, 4, 5, 200, 201, 500, 767)")
def pixel_search(spark, sf):
    return _sky(spark, sf).pixel_search([3, 4, 5, 200, 201, 500, 767], nside=8).select("o_orderkey").to_df()


@query(f"SELECT DISTINCT pixel::BIGINT AS pixel FROM {_pixels_sql(16)}")
def lightcone_get_pixels(spark, sf):
    return _sky(spark, sf).pixels_df(16)


# -- stacks


@query(f"SELECT year::INT AS year, count(*)::BIGINT AS n, round(sum(o_totalprice), 2) AS total FROM {_SKY} GROUP BY year")
def lightcone_union(spark, sf):
    base = read(spark, sf, "orders")
    k = F.col("o_orderkey")
    parts = {}
    for y in range(1995, 2002):
        df = base.where(F.year("o_orderdate") == y).withColumns({"ra": _ra(k), "dec": _dec(k), "redshift": F.lit((y - 1994) * 0.1), "year": F.lit(y)})
        parts[y] = Dataset.from_dataframe(df, "o_orderkey", {"o_totalprice": "Msun"}, Header(is_lightcone=True, step=y))
    return Lightcone.from_datasets(parts).to_df().groupBy("year").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query(f"SELECT o_orderkey, round(redshift, 6) AS redshift FROM {_SKY} WHERE redshift > 0.2321 AND redshift < 0.4011")
def lightcone_z_range(spark, sf):
    return _sky(spark, sf).with_redshift_range(0.4011, 0.2321).select("o_orderkey", "redshift").to_df().withColumn("redshift", F.round("redshift", 6))


@query(f"""WITH a AS (SELECT * FROM {_SKY} WHERE redshift > 0.2321 AND redshift < 0.4011)
SELECT o_orderkey, round((o_totalprice - (SELECT avg(o_totalprice) FROM a)) / (SELECT stddev_pop(o_totalprice) FROM a), 9) AS z FROM a""")
def lightcone_global_zscore(spark, sf):
    """Reductions are over the whole stack, and over what is left of it."""
    ds = _sky(spark, sf).with_new_columns(z=(price - price.mean()) / price.std()).with_redshift_range(0.2321, 0.4011)
    return ds.select("o_orderkey", "z").to_df().withColumn("z", F.round("z", 9))


@query(f"SELECT o_orderkey, o_totalprice FROM {_SKY} ORDER BY o_totalprice DESC, year, o_orderkey LIMIT 30")
def lightcone_sort_take(spark, sf):
    return _sky(spark, sf).sort_by("o_totalprice", invert=True).take(30, "start").select("o_orderkey", "o_totalprice").to_df()


# -- linked structures


def _halos(spark, sf) -> StructureCollection:
    galaxies = StructureCollection(orders(spark, sf, header=Header("galaxy_properties")), {"star_particles": lines(spark, sf)}, {"star_particles": link("o_orderkey", "l_orderkey")}, "galaxy_properties")
    return StructureCollection(customers(spark, sf), {"galaxies": galaxies}, {"galaxies": link("c_custkey", "o_custkey")}, "halo_properties")


_RICH = "SELECT c_custkey FROM customer WHERE c_acctbal > 8000"


@query(f"SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN ({_RICH})")
def structure_filter_propagates(spark, sf):
    return _halos(spark, sf).filter(col("c_acctbal") > 8000)["galaxies"]["galaxy_properties"].select("o_orderkey", "o_custkey").to_df()


@query("SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def structure_ignore_empty(spark, sf):
    return _halos(spark, sf)["galaxies"].remove_empty()["galaxy_properties"].select("o_orderkey").to_df()


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000)")
def structure_on_child_filter(spark, sf):
    return _halos(spark, sf).filter(price > 450000, on_galaxies=True)["halo_properties"].select("c_custkey").to_df()


@query(f"SELECT count(*)::BIGINT AS n, round(sum(l_quantity), 2) AS q FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey IN ({_RICH}))")
def structure_nested_two_hop(spark, sf):
    return _halos(spark, sf).filter(col("c_acctbal") > 8000)["galaxies"]["star_particles"].to_df().agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q"))


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10)")
def structure_take_then_children(spark, sf):
    return _halos(spark, sf).sort_by("c_acctbal", invert=True).take(10, "start")["galaxies"]["galaxy_properties"].select("o_orderkey").to_df()


@query("SELECT o_custkey AS c_custkey, round(sum(o_totalprice), 2) AS total, count(*)::BIGINT AS n FROM orders GROUP BY 1")
def structure_evaluate_into_source(spark, sf):
    """A function of a parent and its children gives a row of the parents."""
    flat = StructureCollection(customers(spark, sf), {"galaxies": orders(spark, sf)}, {"galaxies": link("c_custkey", "o_custkey")}, "halo_properties").remove_empty()

    def total(halo_properties, galaxies):
        return {"total": float(galaxies["o_totalprice"].sum()), "n": len(galaxies["o_totalprice"])}

    out = flat.evaluate(total, halo_properties=["c_custkey"], galaxies=["o_totalprice"])["halo_properties"]
    return out.select("c_custkey", "total", "n").to_df().withColumn("total", F.round("total", 2))


@query("SELECT o_orderkey, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 9) AS share FROM orders")
def structure_evaluate_into_child(spark, sf):
    """A function over the children of each parent gives a value for each child."""
    flat = StructureCollection(customers(spark, sf), {"galaxies": orders(spark, sf)}, {"galaxies": link("c_custkey", "o_custkey")}, "halo_properties")

    def share(o_totalprice):
        return o_totalprice / o_totalprice.sum()

    return flat.evaluate(share, "galaxies")["galaxies"].select("o_orderkey", "share").to_df().withColumn("share", F.round("share", 9))


@query("SELECT l.doc_id, l.quality FROM labels l WHERE l.doc_id IN (SELECT doc_id FROM documents WHERE n_chars > 400)")
def link_idx_profile(spark, sf):
    """Links to one row or none: profiles of the parents that a filter leaves."""
    docs = Dataset.from_dataframe(read(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id", header=Header("halo_properties"))
    marks = Dataset.from_dataframe(read(spark, sf, "labels"), "doc_id", header=Header("halo_profiles"))
    both = StructureCollection(docs, {"halo_profiles": marks}, {"halo_profiles": link("doc_id", "doc_id", single=True)}, "halo_properties")
    return both.filter(col("n_chars") > 400)["halo_profiles"].select("doc_id", "quality").to_df()


@query("SELECT o_orderkey, (sum(n) OVER (ORDER BY o_orderkey) - n)::BIGINT AS start, n::BIGINT AS size FROM (SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)")
def rewrite_link_starts(spark, sf):
    sizes = read(spark, sf, "orders").join(read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n")), F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("n", F.lit(0)).cast("long").alias("size"))
    return rewrite_links(sizes, ["o_orderkey"], size="size")


@query("SELECT c_custkey, (CASE WHEN c_acctbal > 0 THEN row_number() OVER (PARTITION BY c_acctbal > 0 ORDER BY c_custkey) - 1 ELSE -1 END)::BIGINT AS idx FROM customer")
def rewrite_link_idx(spark, sf):
    df = read(spark, sf, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_custkey")).otherwise(F.lit(-1)).alias("idx"))
    return rewrite_links(df, ["c_custkey"], idx="idx")


@query("SELECT o_orderkey, o_custkey AS parent FROM orders")
def links_to_keys(spark, sf):
    """Stored runs of positions become keys on the children."""
    keys = [(F.col("o_custkey"), False), (F.col("o_orderkey"), False)]
    kids = with_position(read(spark, sf, "orders").select("o_orderkey", "o_custkey"), keys, "at")
    runs = kids.groupBy("o_custkey").agg(F.min("at").alias("start"), F.count("*").alias("size"))
    made = links_from_positions(runs.withColumnRenamed("o_custkey", "c"), kids.drop("o_custkey"), start="start", size="size", parent_key="c", child_position="at", name="parent")
    return made.select("o_orderkey", "parent")


# -- several simulations


def _sims(spark, sf) -> SimulationCollection:
    c = read(spark, sf, "customer").join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_acctbal", "n_regionkey")
    return SimulationCollection({f"sim{r}": Dataset.from_dataframe(c.where(F.col("n_regionkey") == r), "c_custkey") for r in range(5)})


def _all(sims: SimulationCollection) -> DataFrame:
    out = None
    for n, m in sims.items():
        df = m.to_df().withColumn("sim", F.lit(n))
        out = df if out is None else out.unionByName(df)
    return out


_SIMS = "(SELECT c_custkey, c_acctbal, n_regionkey, 'sim' || n_regionkey AS sim FROM customer JOIN nation ON c_nationkey = n_nationkey)"


@query(f"SELECT c_custkey, sim FROM {_SIMS} s WHERE c_acctbal > (SELECT avg(c_acctbal) FROM {_SIMS} t WHERE t.sim = s.sim)")
def simulation_map_filter(spark, sf):
    """Reductions are each member's own."""
    return _all(_sims(spark, sf).filter(col("c_acctbal") > col("c_acctbal").mean()).select("c_custkey"))


@query(f"SELECT c_custkey, sim FROM (SELECT *, row_number() OVER (PARTITION BY sim ORDER BY c_acctbal DESC, c_custkey) AS r FROM {_SIMS}) WHERE r <= 7")
def simulation_take_each(spark, sf):
    return _all(_sims(spark, sf).sort_by("c_acctbal", invert=True).take(7, "start").select("c_custkey"))


# -- hosts


def _hosted(spark, sf) -> Dataset:
    from pyspark.sql import Window as W

    df = read(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice").withColumn("host", F.min("o_orderkey").over(W.partitionBy("o_custkey")))
    return Dataset.from_dataframe(df, "o_orderkey")


_HOSTED = "(SELECT o_orderkey, o_custkey, o_totalprice, min(o_orderkey) OVER (PARTITION BY o_custkey) AS host FROM orders)"


@query(f"SELECT o_orderkey, host FROM {_HOSTED} WHERE host IN (SELECT host FROM {_HOSTED} WHERE o_totalprice > 480000)")
def host_keep_closure(spark, sf):
    ds = _hosted(spark, sf)
    return hosts.keep_top_host(ds.filter(price > 480000), ds, "host").select("o_orderkey", "host").to_df()


@query(f"""WITH a AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS at FROM {_HOSTED} WHERE o_totalprice > 200000)
SELECT a.o_orderkey, coalesce(b.at, -1)::BIGINT AS top_host_idx FROM a LEFT JOIN a b ON a.host = b.o_orderkey""")
def host_reindex(spark, sf):
    return hosts.with_host_position(_hosted(spark, sf).filter(price > 200000), "host", "o_orderkey").select("o_orderkey", "top_host_idx").to_df()


# -- functions of users


@query("SELECT o_orderkey, o_totalprice * 2 + o_custkey AS doubled FROM orders")
def evaluate_rowwise(spark, sf):
    def doubled(o_totalprice, o_custkey):
        return o_totalprice * 2 + o_custkey

    return orders(spark, sf).evaluate(doubled).select("o_orderkey", "doubled").to_df()


@query("""SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY p // 100 ORDER BY o_orderkey), 2) AS running
FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM orders)""")
def evaluate_batched(spark, sf):
    def running(o_totalprice):
        return np.cumsum(o_totalprice)

    return orders(spark, sf).evaluate(running, batch_size=100).select("o_orderkey", "running").to_df().withColumn("running", F.round("running", 2))


@query("SELECT o_orderkey, round(o_totalprice - avg(o_totalprice) OVER (), 6) AS centred FROM orders")
def evaluate_vectorized(spark, sf):
    def centred(o_totalprice):
        return o_totalprice - o_totalprice.mean()

    return orders(spark, sf).evaluate(centred, vectorize=True).select("o_orderkey", "centred").to_df().withColumn("centred", F.round("centred", 6))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice * (1 - l_discount) AS net FROM lineitem")
def evaluate_elementwise(spark, sf):
    def net(l_extendedprice, l_discount):
        return l_extendedprice * (1 - l_discount)

    return lines(spark, sf).evaluate(net, elementwise=True).select("l_orderkey", "l_linenumber", "l_partkey", "net").to_df()


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS length FROM embeddings")
def evaluate_array_cell(spark, sf):
    def length(embedding):
        return float(np.sqrt((np.asarray(embedding, float) ** 2).sum()))

    return Dataset.from_dataframe(read(spark, sf, "embeddings"), "vec_id").evaluate(length).select("vec_id", "length").to_df().withColumn("length", F.round("length", 5))


@query("SELECT 'histogram' AS name, b::BIGINT AS position, count(l_quantity)::DOUBLE AS value FROM (SELECT unnest(range(10)) AS b) LEFT JOIN lineitem ON least(floor(l_quantity / 5.1), 9) = b GROUP BY b")
def reduce_histogram(spark, sf):
    def histogram(l_quantity):
        return np.bincount(np.minimum(l_quantity // 5.1, 9).astype(int), minlength=10).astype(float)

    return analysis.reduce_df(lines(spark, sf), histogram)


@query("SELECT floor(l_quantity / 10)::BIGINT AS i, floor(l_discount / 0.03)::BIGINT AS j, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY ALL")
def projection_2d(spark, sf):
    return analysis.projection(lines(spark, sf), "l_quantity", "l_discount", "l_extendedprice", 10.0, 0.03).withColumn("total", F.round("total", 2))


@query("""WITH a AS (SELECT * FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)),
t AS (SELECT * FROM a ORDER BY o_totalprice DESC, o_orderkey LIMIT 10)
SELECT o_orderkey, o_custkey, o_totalprice, round((o_totalprice - (SELECT avg(o_totalprice) FROM t)) / (SELECT stddev_pop(o_totalprice) FROM t), 9) AS price_z FROM t""")
def flagship(spark, sf):
    """The ten dearest orders above the mean, with their z-scores among the rows that are left."""
    ds = orders(spark, sf).filter(price > price.mean()).with_new_columns(price_z=(price - price.mean()) / price.std())
    out = ds.sort_by("o_totalprice", invert=True).take(10, "start").select("o_orderkey", "o_custkey", "o_totalprice", "price_z")
    return out.to_df().withColumn("price_z", F.round("price_z", 9))
