from importlib.util import find_spec

import numpy as np
import pandas as pd
import pytest

from skyweave import Dataset, Header, MissingColumnError, Quantity, UnitConversionError, col, make_box, u
from skyweave.plans.cosmology import Cosmology


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(1)
    return pd.DataFrame({"id": np.arange(200), "m": rng.lognormal(3, 1, 200), "x": rng.uniform(0, 64, 200), "y": rng.uniform(0, 64, 200), "z": rng.uniform(0, 64, 200), "kind": rng.integers(0, 4, 200)})


@pytest.fixture(scope="module")
def ds(spark, frame):
    header = Header(unit_convention="scalefree", redshift=1.0, cosmology=Cosmology(h=0.5), simulation={"box_size": 64.0})
    return Dataset.from_dataframe(spark.createDataFrame(frame), "id", {"m": "Msun/h", "x": "Mpc/h", "y": "Mpc/h", "z": "Mpc/h"}, header, ("x", "y", "z"))


def ids(d):
    return d.select("id").get_data("numpy").tolist() if len(d) != 1 else [int(d.select("id").get_data("numpy"))]


def test_select_and_drop(ds):
    assert ds.select("k*d", "id").columns == ["id", "kind"] and ds.drop("m", "?".replace("?", "k*")).columns == ["id", "x", "y", "z"]
    for bad in ("nothing", "no*"):
        with pytest.raises(MissingColumnError):
            ds.select(bad)
        with pytest.raises(MissingColumnError):
            ds.drop(bad)
    assert ds.select(col("m").alias("mass")).columns == ["mass"]


def test_scalars(ds, frame):
    q = ds.select(mean=col("m").mean())
    assert isinstance(q, Quantity) and q.value == pytest.approx(frame.m.mean() / 0.5)
    with pytest.raises(ValueError):
        ds.select("id", mean=col("m").mean())
    with pytest.raises(ValueError):
        ds.filter(col("id") > 999).select(mean=col("m").mean())


def test_new_columns_errors(ds):
    with pytest.raises(ValueError):
        ds.with_new_columns(m=col("x"))
    with pytest.raises(ValueError):
        ds.with_new_columns(n=3)
    with pytest.raises(ValueError):
        ds.with_new_columns(n=col("m").mean())
    with pytest.raises(ValueError):
        ds.with_new_columns(a=col("b"), b=col("a"))
    with pytest.raises(ValueError):
        ds.with_new_columns(a=col("nothing"))
    with pytest.raises(ValueError):
        ds.with_new_columns(a=np.arange(3))


def test_arrays_follow_the_order_of_the_moment(ds, frame):
    d = ds.sort_by("m").with_new_columns(rank=np.arange(200)).sort_by(None)
    assert d.select("rank").get_data("numpy").tolist() == frame.m.rank().sub(1).astype(int).tolist()
    v = ds.with_new_columns(vec=np.arange(2000).reshape(200, 10)).select("vec").get_data("numpy")
    assert v.shape == (200, 10) and v[3, 4] == 34


def test_reductions_in_columns_follow_the_rows(ds):
    d = ds.with_new_columns(z_=(col("m") - col("m").mean()) / col("m").std())
    for part in (d, d.take(50, "start"), d.filter(col("kind") == 1)):
        x = part.select("z_").get_data("numpy")
        assert x.mean() == pytest.approx(0, abs=1e-9) and x.std() == pytest.approx(1)


def test_take(ds, frame):
    assert ids(ds.take(50, "start").take(10, "end")) == list(range(40, 50))
    assert len(ds.take(999, "start")) == 200 and len(ds.take(7)) == 7 and ids(ds.take(5, seed=3)) == ids(ds.take(5, seed=3))
    best = frame.sort_values(["m", "id"], ascending=[False, True]).id.head(5).tolist()
    assert ids(ds.sort_by("m", invert=True).take(5, "start")) == best
    assert ids(ds.take_range(190, 500)) == list(range(190, 200))
    assert ids(ds.sort_by("m", invert=True).take_rows([4, 0])) == [best[0], best[4]]
    for bad in (lambda: ds.take(1, "middle"), lambda: ds.take_range(-1, 3), lambda: ds.take_range(5, 3), lambda: ds.take_rows([200]), lambda: ds.take(1, mode="x"), lambda: ds.sort_by("nothing")):
        with pytest.raises(ValueError):
            bad()
    assert len(ds.take_rows([])) == 0


def test_hidden_sort_column(ds, frame):
    got = ds.sort_by("m").select("id").get_data("numpy").tolist()
    assert got == frame.sort_values(["m", "id"]).id.tolist()


def test_units_of_conventions(ds, frame):
    x = lambda d: d.select("x").get_data("numpy")
    base = x(ds)
    assert base == pytest.approx(frame.x / 0.5)
    assert x(ds.with_units("physical")) == pytest.approx(base * 0.5)
    assert x(ds.with_units("scalefree")) == pytest.approx(frame.x)
    assert x(ds.with_units(conversions={"Mpc": "kpc"}, x="pc")) == pytest.approx(base * 1e6)
    assert x(ds.with_units(x="pc").with_units()) == pytest.approx(base)
    assert ds.with_units("unitless").units["x"] is None
    with pytest.raises(UnitConversionError):
        ds.with_units(x="s")
    with pytest.raises(UnitConversionError):
        ds.with_units(kind="m")
    with pytest.raises(ValueError):
        ds.with_units("martian")


def test_comoving_data_have_no_scalefree_form(spark, frame):
    with pytest.raises(ValueError):
        Dataset.from_dataframe(spark.createDataFrame(frame), "id", {"x": "Mpc"}).with_units("scalefree")


def test_constant_reaches_the_scan(spark, sf):
    header = Header(unit_convention="scalefree", cosmology=Cosmology(h=0.5))
    d = Dataset.from_dataframe(spark.read.parquet(f"{sf}/orders.parquet"), "o_orderkey", {"o_totalprice": "Msun/h"}, header)
    plan = d.filter(col("o_totalprice") > 4e5 * u("Msun")).select("o_orderkey").to_df()._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice,200000.0)" in plan and "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in plan


def test_bound(ds, frame):
    inside = frame[(frame.x > 10) & (frame.x < 40) & (frame.y > 5) & (frame.y < 60) & (frame.z > 0) & (frame.z < 32)]
    box = make_box((20, 10, 0), (80, 120, 64))  # comoving: twice the stored numbers
    got = ds.bound(box)
    assert ids(got) == inside.id.tolist() and got.region == box
    assert ids(ds.with_units("scalefree").bound(make_box((10, 5, 0), (40, 60, 32)))) == inside.id.tolist()
    with pytest.raises(AttributeError):
        ds._with(coords=None).bound(box)


def test_formats(ds):
    one = ds.take(1, "start")
    assert isinstance(one.get_data("numpy")["id"], np.integer) and ds.select("id").get_data("numpy").shape == (200,)
    assert list(ds.select("id").get_data("pandas", wrap_single=True).columns) == ["id"]
    assert ds.get_data("arrow").num_rows == 200
    with pytest.raises(ValueError):
        ds.get_data("fits")
    for name in ("polars", "jax"):
        if find_spec(name) is None:
            with pytest.raises(ImportError):
                ds.get_data(name)
        else:
            assert np.asarray(ds.get_data(name)["id"]).tolist() == list(range(200))
    rows = list(ds.take(3, "start").rows(include_units=True))
    assert [r["id"] for r in rows] == [0, 1, 2] and isinstance(rows[0]["m"], Quantity)
    assert "200 rows" in repr(ds)


def test_evaluate(ds, frame):
    def both(m, x):
        return {"s": m + x, "p": m * x}

    d = ds.evaluate(both)
    assert d.select("s").get_data("numpy") == pytest.approx((frame.m + frame.x) / 0.5)
    assert d.with_units("physical").select("s").get_data("numpy") == pytest.approx((frame.m + frame.x) / 0.5)  # results keep their units

    calls = []

    def running(m):
        calls.append(1)
        return np.cumsum(m)

    got = ds.evaluate(running, batch_size=60).select("running").get_data("numpy")
    want = np.concatenate([np.cumsum(frame.m[a : a + 60] / 0.5) for a in range(0, 200, 60)])
    assert got == pytest.approx(want)
    assert ds.evaluate(lambda m: m - m.mean(), vectorize=True).select("result").get_data("numpy").mean() == pytest.approx(0, abs=1e-9)
    assert ds.evaluate(lambda m: m * 2, insert=False, elementwise=True).shape == (200,)
    assert ds.evaluate(lambda m: None, insert=False) is None

    def scaled(m, factor):
        return m * factor

    assert ds.evaluate(scaled, factor=3.0).select("scaled").get_data("numpy") == pytest.approx(frame.m * 6)
    for bad in (lambda: ds.evaluate(lambda nothing: 1), lambda: ds.evaluate(scaled, m=2, factor=1), lambda: ds.evaluate(lambda m: None), lambda: ds.evaluate(running, format="csv")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(ValueError):
        ds.evaluate(lambda m: {"x": m})  # a column of that name


def test_empty(ds):
    none = ds.filter(col("id") < 0)
    assert len(none) == 0 and none.sort_by("m").take(3, "start").get_data("numpy")["id"].size == 0


def test_functions_as_columns(ds, frame):
    from skyweave import Evaluated

    def half(m):
        return m / 2

    assert ds.with_new_columns(h=Evaluated(half)).select("h").get_data("numpy") == pytest.approx(frame.m)
    assert ds.select("id", h=Evaluated(half, {"elementwise": True})).columns == ["id", "h"]


def test_hooks(ds):
    from skyweave.plans import hooks

    away = hooks.add("index_update", lambda d: d.drop("kind"))
    try:
        assert "kind" not in ds.filter(col("id") > 3).columns
    finally:
        away()
    assert "kind" in ds.filter(col("id") > 3).columns and hooks.ask("partition", 1) is None
    with pytest.raises(ValueError):
        hooks.add("nowhere", print)


def test_gas(spark):
    from skyweave import analysis

    df = spark.createDataFrame([(1, 2.0, 4.0, 0.25, 0.0, 100.0)], "id long, rho double, mass double, yhe double, zmet double, uu double")
    d = Dataset.from_dataframe(df, "id").with_new_columns(w=analysis.mean_molecular_weight(), t=analysis.gas_temperature(), n=analysis.gas_number_density(), e=analysis.emission_measure()).to_pandas().iloc[0]
    mp = 1.67262192369e-27
    assert d.w == pytest.approx(1 / (1.5 + 0.1875)) and d.n == pytest.approx(2 / (d.w * mp)) and d.e == pytest.approx(0.875 * 0.75 * 4 / mp**2 * 2)
    assert d.t == pytest.approx(d.w * mp * 100 * 1e6 / 1.380649e-23 * 2 / 3)
