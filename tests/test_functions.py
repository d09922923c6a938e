import math

import pytest

from skyweave import Dataset, Header, Quantity, UnitConversionError, UnitsError, add_mag_cols, col, norm_cols, u
from skyweave.functions.units import as_unit, stored_unit, transition
from skyweave.plans.cosmology import Cosmology, step_redshifts


@pytest.fixture
def numbers(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, 0.0, -1.0), (3, float("nan"), 4.0), (4, -2.0, 0.0)], "id long, a double, b double")
    return Dataset.from_dataframe(df, "id")


def values(ds, name):
    return [r[name] for r in ds.to_df(ordered=True).collect()]


def test_ieee_division_and_logarithm(numbers):
    ds = numbers.with_new_columns(q=col("b") / col("a"), lg=col("b").log10(), root=col("b").sqrt())
    q, lg = values(ds, "q"), values(ds, "lg")
    assert q[0] == 2 and q[1] == -math.inf and math.isnan(q[2]) and q[3] == 0
    assert lg[0] == math.log10(2) and math.isnan(lg[1]) and lg[3] == -math.inf
    assert math.isnan(values(ds, "root")[1])


def test_nan_is_unordered(numbers):
    assert [r["id"] for r in numbers.filter(col("a") > -100).to_df().collect()] == [1, 2, 4]
    assert len(numbers.filter(col("a") == col("a"))) == 3
    assert len(numbers.filter(col("a") != 1)) == 3


def test_reductions_see_nan(numbers):
    assert math.isnan(numbers.select(x=col("a").min())) and math.isnan(numbers.select(x=col("a").max()))
    assert numbers.filter(col("a") > -5).select(x=col("a").var()) == pytest.approx(1.5555555)


def test_unit_algebra():
    assert as_unit("comoving Mpc/h").power("h") == -1
    assert as_unit("Msun (km/s)^2").power("m") == 2
    assert as_unit("log10(erg/s)").log == "dex"
    assert (5 * u("Mpc")).to("kpc") == pytest.approx(5000)
    assert stored_unit("furlong") is None and stored_unit("") is None
    with pytest.raises(UnitsError):
        as_unit("furlong")
    with pytest.raises(UnitConversionError):
        Quantity(1.0, u("Mpc")).to("s")


def test_conventions():
    t = transition(as_unit("Mpc/h"), "scalefree", "physical", 0.7)
    assert t.factor == pytest.approx(1 / 0.7) and t.a_power == 1
    assert transition(as_unit("km/s"), "comoving", "physical", 0.7).a_power == 1
    assert transition(as_unit("Msun"), "comoving", "physical", 0.7).a_power == 0
    with pytest.raises(UnitsError):
        transition(as_unit("Mpc"), "comoving", "scalefree", 0.7)


def test_units_in_expressions(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0, 4.0)], "id long, m double, x double, v double")
    ds = Dataset.from_dataframe(df, "id", {"m": "Msun", "x": "Mpc", "v": "km/s"})
    made = ds.with_new_columns(e=col("m") * col("v") ** 2, s=col("x").sqrt(), lg=col("m").log10(), r=col("x") / col("x"))
    assert made.units["e"].same(as_unit("Msun km^2/s^2")) and made.units["s"].power("m") == 0.5
    assert made.units["lg"].log == "dex" and made.units["r"] is None
    assert made.with_new_columns(back=col("lg").exp10()).units["back"].same(as_unit("Msun"))
    for bad in (col("m") + col("x"), col("m") + 1, col("m").arcsin(), col("m").arctan2(col("x"))):
        with pytest.raises(UnitsError):
            ds.with_new_columns(bad=bad)
    for bad in (col("lg").log10(), col("m").exp10()):
        with pytest.raises(ValueError):
            made.with_new_columns(bad=bad)
    assert len(ds.filter(col("x") > 2000 * u("kpc"))) == 1 and len(ds.filter(col("x") > 4000 * u("kpc"))) == 0
    with pytest.raises(UnitConversionError):
        ds.filter(col("x") > 3 * u("s"))


def test_stock_columns_need_two(numbers):
    for f in (norm_cols, add_mag_cols):
        with pytest.raises(ValueError):
            f("a")
    assert values(numbers.with_new_columns(m=add_mag_cols("b", "b")), "m")[0] == pytest.approx(2 - 2.5 * math.log10(2))


def test_there_is_no_negation():
    for f in (lambda: -col("a"), lambda: abs(col("a")), lambda: col("a") % 2, lambda: col("a") // 2):
        with pytest.raises(TypeError):
            f()


def test_cosmology(spark):
    c = Cosmology(h=0.7, om0=0.3)
    assert c.name == "FlatLambdaCDM" and Cosmology(om0=0.3, ode0=0.6).name == "LambdaCDM" and Cosmology(w0=-0.9).name == "FlatwCDM"
    assert float(c.comoving_distance(1.0)) == pytest.approx(3303.83, rel=1e-4)
    assert step_redshifts(200, 0, 500)[-1] == 0
    from pyspark.sql import functions as F

    d = float(c.comoving_distance(0.37))
    assert spark.range(1).select(c.redshift_column(F.lit(d)).alias("z")).first()[0] == pytest.approx(0.37, abs=1e-4)


def test_headers():
    h = Header(redshift=1.0, cosmology=Cosmology(h=0.5), simulation={"box_size": 100.0, "z_ini": 9.0, "z_end": 0.0, "n_steps": 3})
    assert Header.load(h.dump()) == h
    assert h.parameter("box_size", "physical").value == 100 and h.parameter("box_size", "scalefree").value == 100
    assert h.step_redshifts[-1] == 0
    for bad in ({"data_type": "x"}, {"unit_convention": "x"}, {"data_type": "healpix_map"}):
        with pytest.raises(ValueError):
            Header(**bad)
    with pytest.raises(ValueError):
        Header.load({"colour": 1})
    assert Header("mock_fits").data_type == "synthetic_galaxies"
