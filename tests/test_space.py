import math

import numpy as np
import pytest

from skyweave import HealpixMap, Lightcone, make_box, make_cone, make_skybox, u
from skyweave.plans import healpix, octree, regions


def sky(n, seed=0):
    rng = np.random.default_rng(seed)
    return rng.uniform(0, 360, n), np.degrees(np.arcsin(rng.uniform(-1, 1, n)))


@pytest.mark.parametrize("nside", [1, 2, 16, 1024])
def test_pixels_and_their_centres(nside):
    p = np.arange(healpix.npix(nside)) if nside < 100 else np.random.default_rng(0).integers(0, healpix.npix(nside), 20000)
    assert (healpix.ang2pix(nside, *healpix.pix2ang(nside, p)) == p).all()
    ra, dec = sky(20000)
    q = healpix.ang2pix(nside, ra, dec)
    away = np.degrees(np.arccos(np.clip((healpix.vectors(*healpix.pix2ang(nside, q)) * healpix.vectors(ra, dec)).sum(-1), -1, 1)))
    assert away.max() <= healpix.max_radius(nside)
    if nside > 1:
        assert (q >> 2 == healpix.ang2pix(nside // 2, ra, dec)).all()


def test_pixel_column_equals_arrays(spark):
    from pyspark.sql import functions as F

    ra, dec = sky(5000, 3)
    ra[:4], dec[:4] = [0, 360, -30, 45], [90, -90, 0, 41.8]
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(ra, dec)], "ra double, dec double")
    for nside in (1, 8, 4096):
        got = [r[0] for r in df.select(healpix.pixel_column(nside, F.col("ra"), F.col("dec"))).collect()]
        assert (np.array(got) == healpix.ang2pix(nside, ra, dec)).all()


def test_query_disc():
    p = np.arange(healpix.npix(32))
    ra, dec = healpix.pix2ang(32, p)
    for at, r in (((10.0, 20.0), 7.0), ((0.0, 89.0), 15.0), ((359.0, -45.0), 1.0)):
        inside = [regions.separation(at, (a, d)) <= r for a, d in zip(ra, dec)]
        assert healpix.query_disc(32, *at, r, inclusive=False).tolist() == p[inside].tolist()
        pts = sky(3000, 5)
        touched = {int(q) for q, a, d in zip(healpix.ang2pix(32, *pts), *pts) if regions.separation(at, (a, d)) < r}
        assert touched <= set(healpix.query_disc(32, *at, r).tolist())
    for bad in (0, 3, -2):
        with pytest.raises(ValueError):
            healpix.check_nside(bad)


def test_builders():
    assert make_box((3, 2, 1), (1, 5, 0)).low == (1, 2, 0)
    assert make_cone((10 * u("deg"), 0.5 * u("rad")), 60 * u("arcmin")).radius == pytest.approx(1)
    with pytest.warns(UserWarning):
        make_skybox((1, 2), (1, 5))
    for bad in (lambda: make_box((0, 0, 0), (1, 0, 1)), lambda: make_box((0, 0), (1, 1)), lambda: make_cone(3, 1)):
        with pytest.raises(ValueError):
            bad()


def test_relations():
    a, b = make_box((0, 0, 0), (4, 4, 4)), make_box((0, 1, 1), (4, 2, 2))
    assert a.contains(b) and not b.contains(a) and a.intersects(make_box((4, 0, 0), (5, 1, 1))) and not a.intersects(make_box((5, 0, 0), (6, 1, 1)))
    c, d = make_cone((10, 0), 5), make_cone((12, 0), 2)
    assert c.contains(d) and not d.contains(c) and not make_cone((10, 0), 4).contains(d) and c.intersects(make_cone((18, 0), 4)) and not c.intersects(make_cone((20, 0), 4))
    s = make_skybox((0, -10), (30, 10))
    assert s.contains(make_skybox((0, -5), (30, 5))) and s.contains(d) and make_cone((15, 0), 40).contains(s) and s.intersects(make_cone((33, 0), 4)) and not s.intersects(make_cone((40, 0), 4))
    p = regions.PixelSet(8, tuple(healpix.query_disc(8, 10.0, 0.0, 20.0).tolist()))
    assert p.contains(c) and p.intersects(d) and not p.intersects(make_cone((190, 0), 3)) and c.intersects(p)
    full = regions.FullSky()
    assert full.contains(c) and full.intersects(s) and c.intersects(full) and not c.contains(full)
    with pytest.raises(ValueError):
        a.contains(c)
    with pytest.raises(ValueError):
        a.holds([(1, 2)])
    assert a.holds([(0, 1, 1), (1, 1, 1)]) == [False, True]
    for r in (a, c, s, p, full):
        assert regions.load(r.dump()) == r


def test_skybox_pixels_cover_it():
    box = make_skybox((350, 60), (360, 88))
    ra, dec = sky(60000, 9)
    inside = np.array(box.holds(np.stack([ra, dec], axis=1)))
    assert inside.any() and set(healpix.ang2pix(16, ra[inside], dec[inside]).tolist()) <= set(box.pixels(16).tolist())


def test_octree(spark):
    from pyspark.sql import functions as F

    rng = np.random.default_rng(2)
    pts = rng.uniform(-1, 17, (2000, 3))
    df = spark.createDataFrame([tuple(map(float, p)) for p in pts], "x double, y double, z double")
    keys = np.array([r[0] for r in df.select(octree.key_column([F.col(c) for c in "xyz"], 16.0, 4)).collect()])
    cell = np.clip(np.floor(pts), 0, 15).astype(int)
    want = sum(((cell[:, a] >> b & 1) << (3 * b + a)) for a in range(3) for b in range(4))
    assert (keys == want).all()
    box = make_box((1.5, 2, -3), (9, 7.7, 16.5))
    runs = octree.key_ranges(box, 16.0, 4)
    inside = np.array(box.holds(pts))
    assert inside.any() and all(any(lo <= k <= hi for lo, hi in runs) for k in keys[inside])
    counts = {(r["level"], r["cell"]): r["n"] for r in octree.cell_counts(df, octree.key_column([F.col(c) for c in "xyz"], 16.0, 4), 4).collect()}
    assert counts[0, 0] == 2000 and sum(v for (lv, _), v in counts.items() if lv == 2) == 2000


@pytest.fixture(scope="module")
def cone(spark):
    ra, dec = sky(3000, 7)
    rng = np.random.default_rng(8)
    rows = [(i, float(a), float(d), float(z), 600 + int(z > 0.5), float(m)) for i, (a, d, z, m) in enumerate(zip(ra, dec, rng.uniform(0, 1, 3000), rng.normal(size=3000)))]
    df = spark.createDataFrame(rows, "id long, ra double, dec double, redshift double, step int, m double")
    return Lightcone.of(df, "id", "step", {"ra": "deg", "dec": "deg"}, steps={600: (0.0, 0.5), 601: (0.5, 1.0)})


def test_lightcone_searches(cone):
    pdf = cone.to_pandas()
    away = [regions.separation((40.0, 10.0), (a, d)) for a, d in zip(pdf.ra, pdf.dec)]
    want = pdf.id[np.array(away) < 30].tolist()
    for c in (cone, cone.with_pixels()):
        assert sorted(c.cone_search((40.0, 10.0), 30.0).select("id").get_data("numpy").tolist()) == sorted(want)
    pixel = healpix.ang2pix(8, pdf.ra, pdf.dec)
    some = [5, 6, 7, 100, 400]
    assert cone.pixel_search(some, 8).select("id").get_data("numpy").tolist() == pdf.id[np.isin(pixel, some)].tolist()
    assert cone.get_pixels(4).tolist() == sorted(set(healpix.ang2pix(4, pdf.ra, pdf.dec).tolist()))
    box = cone.box_search((10, -30), (80, 30))
    assert len(box) == ((pdf.ra > 10) & (pdf.ra < 80) & (pdf.dec > -30) & (pdf.dec < 30)).sum()
    for bad in (lambda: cone.pixel_search([-1]), lambda: cone.pixel_search([1], 3), lambda: cone.with_redshift_range(2, 3), lambda: cone.with_redshift_range(0.5, 0.5)):
        with pytest.raises(ValueError):
            bad()


def test_lightcone_redshifts_and_hidden_columns(cone):
    part = cone.select("id", "m").with_redshift_range(0.8, 0.6)
    assert part.columns == ["id", "m"] and part.z_range == (0.6, 0.8) and part.keys() == [601]
    pdf = cone.to_pandas()
    assert len(part) == ((pdf.redshift > 0.6) & (pdf.redshift < 0.8)).sum()
    assert len(part.cone_search((0, 0), 90)) < len(part)
    assert len(cone[600]) == (pdf.step == 600).sum()


def test_derived_angles(spark):
    from skyweave import Dataset, Header

    df = spark.createDataFrame([(1, 3.0, 4.0, 12.0, 0.5)], "id long, fof_halo_center_x double, fof_halo_center_y double, fof_halo_center_z double, fof_halo_center_a double")
    d = Lightcone.from_datasets([Dataset.from_dataframe(df, "id", header=Header(is_lightcone=True, step=3))]).to_pandas().iloc[0]
    assert d.chi == pytest.approx(13) and d.redshift == pytest.approx(1) and d.ra == pytest.approx(math.degrees(math.atan2(4, 3))) and d.dec == pytest.approx(90 - math.degrees(math.acos(12 / 13)))
    other = df.withColumnRenamed("id", "key")
    with pytest.raises(ValueError):
        Lightcone.from_datasets({1: Dataset.from_dataframe(df, "id"), 2: Dataset.from_dataframe(other, "key")})


def test_map(spark):
    rng = np.random.default_rng(1)
    values = rng.normal(size=768)
    df = spark.createDataFrame([(int(p), float(v)) for p, v in enumerate(values)], "pixel long, tsz double")
    m = HealpixMap.of(df, 8, full_sky=True)
    half = m.with_resolution(4)
    assert half.get_data()["tsz"].compressed() == pytest.approx(values.reshape(-1, 4).mean(axis=1), abs=1e-6)
    got = m.cone_search((30, 10), 15)
    assert got.pixels().tolist() == healpix.query_disc(8, 30.0, 10.0, 15.0, inclusive=False).tolist() and not got.full_sky
    dense = got.get_data()["tsz"]
    assert dense.mask.sum() == 768 - len(got) and m.get_data(nside_out=4)["tsz"].shape == (192,)
    ra, dec = healpix.pix2ang(8, np.arange(768))
    assert m.box_search((10, -20), (100, 20)).pixels().tolist() == np.flatnonzero((ra > 10) & (ra < 100) & (dec > -20) & (dec < 20)).tolist()
    for bad in (lambda: m.with_resolution(16), lambda: m.take(769), lambda: m.take_range(0, 769), lambda: m.bound(make_skybox((0, 0), (1, 1)))):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(NotImplementedError):
        m.with_units("physical")
    assert m.with_resolution(8) is m and m.columns == ["tsz"]


def test_step_arguments(cone):
    def moved(m, by):
        return m + by

    pdf = cone.evaluate(moved, by={600: 1.0, 601: 100.0}).to_pandas()
    assert np.allclose(pdf.moved - pdf.m, np.where(pdf.step == 600, 1.0, 100.0))
