import numpy as np
import pandas as pd
import pytest

import skyweave
from skyweave import Dataset, Header, Lightcone, MissingColumnError, SimulationCollection, StructureCollection, col, link, make_box
from skyweave.collections import hosts


@pytest.fixture(scope="module")
def frames():
    rng = np.random.default_rng(4)
    halos = pd.DataFrame({"tag": np.arange(30), "mass": rng.lognormal(2, 1, 30)})
    gal = pd.DataFrame({"gal": np.arange(100), "halo": rng.integers(0, 20, 100), "gmass": rng.lognormal(1, 1, 100)})
    stars = pd.DataFrame({"star": np.arange(400), "of": rng.integers(0, 80, 400), "w": rng.uniform(size=400)})
    return halos, gal, stars


@pytest.fixture(scope="module")
def halos(spark, frames):
    h, g, s = (spark.createDataFrame(f) for f in frames)
    galaxies = StructureCollection(Dataset.from_dataframe(g, "gal", {"gmass": "Msun"}, Header("galaxy_properties")), {"star_particles": Dataset.from_dataframe(s, "star", header=Header("galaxy_particles"))}, {"star_particles": link("gal", "of")}, "galaxy_properties")
    return StructureCollection(Dataset.from_dataframe(h, "tag", {"mass": "Msun"}), {"galaxies": galaxies}, {"galaxies": link("tag", "halo")})


def test_children_follow(halos, frames):
    h, g, s = frames
    big = halos.filter(col("mass") > 8)
    tags = set(h.tag[h.mass > 8])
    gal = big["galaxies"]["galaxy_properties"].to_pandas()
    assert sorted(gal.gal) == sorted(g.gal[g.halo.isin(tags)]) and set(gal.halo) <= tags
    assert len(big["galaxies.star_particles"]) == s.of.isin(gal.gal).sum()
    assert set(halos.remove_empty()["halo_properties"].to_pandas().tag) == set(g.halo)
    got = halos.filter(col("gmass") > 6, on_galaxies=True)["halo_properties"].to_pandas()
    assert set(got.tag) == set(g.halo[g.gmass > 6])


def test_columns_of_members(halos):
    s = halos.select("mass", "tag", "gmass", "gal", "halo")
    assert s["halo_properties"].columns == ["tag", "mass"] and s["galaxies"]["galaxy_properties"].columns == ["gal", "halo", "gmass"]
    assert halos.select(halo_properties=["tag"])["halo_properties"].columns == ["tag"]
    assert halos.select(galaxies={"galaxy_properties": ["gal"]})["galaxies"]["galaxy_properties"].columns == ["gal"]
    assert "twice" in halos.with_new_columns("galaxies.star_particles", twice=col("w") * 2)["galaxies"]["star_particles"].columns
    assert halos.drop("mass")["halo_properties"].columns == ["tag"]
    with pytest.raises(MissingColumnError):
        halos.select("nothing")
    with pytest.raises(ValueError):
        halos.select(m=col("mass").mean())
    with pytest.raises(ValueError):
        halos.with_units(nothing={})
    kg = halos.with_units(halo_properties={"mass": "kg"})
    assert str(kg["halo_properties"].units["mass"]) == "kg" and str(kg["galaxies"]["galaxy_properties"].units["gmass"]) == "Msun"
    assert halos.with_datasets(["galaxies"]).keys() == ["galaxies"]


def test_objects(halos, frames):
    h, g, _ = frames
    with pytest.warns(UserWarning):
        made = list(halos.objects())
    assert [m["halo_properties"]["tag"] for m in made] == h.tag.tolist()
    for m in made:
        mine = g.gal[g.halo == m["halo_properties"]["tag"]].tolist()
        assert (m["galaxies"].gal.tolist() if "galaxies" in m else []) == mine
    assert len(list(halos.take(3, "start").halos(ignore_empty=False))) == 3
    with pytest.raises(AttributeError):
        halos.galaxies()
    by_mass = [m["halo_properties"]["tag"] for m in halos.remove_empty().sort_by("mass", invert=True).take(3, "start").objects()]
    assert by_mass == h[h.tag.isin(g.halo)].sort_values("mass", ascending=False).tag.head(3).tolist()


def test_evaluate_on_structures(halos, frames):
    h, g, _ = frames

    def total(halo_properties, galaxies):
        return halo_properties["mass"] + galaxies["gmass"].sum()

    got = halos.remove_empty().evaluate(total)["halo_properties"].to_pandas().set_index("tag").total
    want = h.set_index("tag").mass + g.groupby("halo").gmass.sum()
    assert got.sort_index().to_numpy() == pytest.approx(want.dropna().sort_index().to_numpy())

    def rank(gmass):
        return gmass.argsort().argsort()

    out = halos.evaluate(rank, "galaxies")["galaxies"]["galaxy_properties"].to_pandas().set_index("gal")["rank"]
    want = g.set_index("gal").groupby("halo").gmass.rank().astype(int) - 1
    assert (out.sort_index() == want.sort_index()).all()
    with pytest.raises(ValueError):
        halos.evaluate(lambda gmass: gmass[:1].repeat(99), "galaxies")
    with pytest.raises(ValueError):
        halos.evaluate(lambda nothing: 1)


def test_lightcone_verbs_need_a_lightcone(halos):
    for f in (lambda: halos.with_redshift_range(0, 1), lambda: halos.cone_search((0, 0), 1), lambda: halos.get_pixels(4), lambda: halos.z_range):
        with pytest.raises(AttributeError):
            f()


def test_simulations(spark, frames):
    h, g, _ = frames
    a, b = Dataset.from_dataframe(spark.createDataFrame(h), "tag"), Dataset.from_dataframe(spark.createDataFrame(h.assign(mass=h.mass * 2, more=1)), "tag")
    sims = SimulationCollection({"a": a, "b": b})
    means = sims.filter(col("mass") > col("mass").mean())
    assert len(means["a"]) == len(means["b"])
    assert [len(x) for x in sims.take(4, "start").values()] == [4, 4] and [len(x) for x in sims.take(4, "start", datasets="a").values()] == [4, 30]
    assert sims.drop("more")["b"].columns == ["tag", "mass"] and sims.drop("more")["a"].columns == ["tag", "mass"]
    with pytest.raises(MissingColumnError):
        sims.drop("nothing")
    assert "m2" in sims.with_new_columns(m2=col("more") * 2)["b"].columns and "m2" not in sims.with_new_columns(m2=col("more") * 2)["a"].columns
    with pytest.raises(ValueError):
        sims.take(3, datasets="c")

    def scaled(mass, by):
        return mass * by

    out = sims.evaluate(scaled, by={"a": 2.0, "b": 1.0})
    assert out["a"].select("scaled").get_data("numpy") == pytest.approx(out["b"].select("scaled").get_data("numpy"))
    assert set(sims.redshift) == {"a", "b"}


def test_hosts(spark):
    df = spark.createDataFrame([(10, 10), (11, 10), (12, 12), (13, 12), (14, None)], "tag long, host long")
    ds = Dataset.from_dataframe(df, "tag")
    whole = hosts.with_host_position(ds, "host", "tag")
    assert whole.select("top_host_idx").get_data("numpy").tolist() == [0, 0, 2, 2, -1]
    part = hosts.with_host_position(ds.filter(col("tag") > 10), "host", "tag")
    assert part.select("top_host_idx").get_data("numpy").tolist() == [-1, 1, 1, -1]
    assert hosts.keep_top_host(ds.filter(col("tag") == 13), ds, "host").select("tag").get_data("numpy").tolist() == [12, 13]
    stored = spark.createDataFrame([(10, 0), (11, 0), (12, -1)], "tag long, at long")
    assert [r["host_id"] for r in hosts.from_positions(Dataset.from_dataframe(stored, "tag"), "at", "tag").to_df(ordered=True).collect()] == [10, 10, None]


def test_round_trip(spark, tmp_path, frames):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"id": np.arange(500), "m": rng.lognormal(size=500), **{a: rng.uniform(0, 64, 500) for a in "xyz"}})
    header = Header(unit_convention="scalefree", simulation={"box_size": 64.0})
    ds = Dataset.from_dataframe(spark.createDataFrame(pdf), "id", {"m": "Msun/h", "x": "Mpc/h", "y": "Mpc/h", "z": "Mpc/h"}, header, ("x", "y", "z"))
    path = str(tmp_path / "halo_properties")
    skyweave.write(path, ds.with_units("physical").with_new_columns(twice=col("m") * 2))
    back = skyweave.open(spark, path)
    assert back.columns == [*ds.columns, "twice"] and back.key[0] == "__zkey"
    assert back.to_pandas()[ds.columns].equals(ds.to_pandas()) and back.select("twice").get_data("numpy") == pytest.approx(2 * ds.select("m").get_data("numpy"))
    box = make_box((10, 10, 10), (50, 40, 64))
    assert sorted(back.bound(box).select("id").get_data("numpy")) == sorted(ds.bound(box).select("id").get_data("numpy"))
    plan = back.bound(box).to_df()._jdf.queryExecution().executedPlan().toString()
    assert "Or(Or(" in plan.split("DataFilters")[1]  # reaches the scan
    with pytest.raises(FileExistsError):
        skyweave.write(path, ds)
    skyweave.write(path, ds, overwrite=True)
    with pytest.raises(ValueError):
        skyweave.open(spark, str(tmp_path / "nothing"))


def test_structures_maps_and_cones_round_trip(spark, tmp_path, halos):
    path = str(tmp_path / "halos")
    skyweave.write(path, halos.filter(col("mass") > 4))
    back = skyweave.open(spark, path)
    assert isinstance(back, StructureCollection) and len(back) == len(halos.filter(col("mass") > 4))
    assert len(back["galaxies"]["star_particles"]) == len(halos.filter(col("mass") > 4)["galaxies"]["star_particles"])
    assert len(skyweave.open(spark, path, ignore_empty=True)) < len(back)
    with pytest.raises(ValueError):
        skyweave.open(spark, f"{path}/star_particles")
    sims = str(tmp_path / "sims")
    one = halos["halo_properties"]
    skyweave.write(sims, SimulationCollection({"a": SimulationCollection({"halo_properties": one}), "b": SimulationCollection({"halo_properties": one.take(5, "start")})}))
    back = skyweave.open(spark, sims)
    assert isinstance(back, SimulationCollection) and [len(m) for m in back.values()] == [30, 5]
    df = spark.createDataFrame([(i, float(i), 0.0, i / 100) for i in range(50)], "id long, ra double, dec double, redshift double").selectExpr("*", "600 + cast(redshift > 0.2 as int) AS step")
    cone = Lightcone.of(df, "id", "step", steps={600: (0.0, 0.2), 601: (0.2, 0.5)})
    skyweave.write(str(tmp_path / "cone"), cone.with_redshift_range(0.1, 0.3))
    back = skyweave.open(spark, str(tmp_path / "cone"))
    assert isinstance(back, Lightcone) and back.z_range == (0.1, 0.3) and len(back) == 19 and len(back.cone_search((15, 0), 3.5)) == 7


def test_write_parquet(spark, tmp_path, halos):
    p = str(tmp_path / "plain")
    skyweave.write_parquet(p, halos["halo_properties"].with_units(mass="kg"))
    assert spark.read.parquet(p).count() == 30
    with pytest.raises(FileExistsError):
        skyweave.write_parquet(p, halos["halo_properties"])
    with pytest.raises(NotImplementedError):
        skyweave.write_parquet(str(tmp_path / "one"), halos["halo_properties"].select("tag"))
    with pytest.warns(UserWarning):
        skyweave.write_parquet(str(tmp_path / "stars"), halos["galaxies"])
    assert spark.read.parquet(str(tmp_path / "stars" / "star_particles")).columns == ["star", "of", "w"]


def test_the_rest_works_without_the_optional_part(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "skyweave", tmp_path / "skyweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 70 and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
