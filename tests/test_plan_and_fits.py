"""Plan folders that are written whole, checked, resumed and isolated; FITS files read back by an own parser; maps."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from starfold.operators import maps
from starfold.sources import fits, plan_folder

IMAGES = "image long, y long, x long, v double"


def parsed(path):
    raw = open(path, "rb").read()
    cards, at = {}, 0
    while True:
        line = raw[at : at + 80].decode()
        at += 80
        if line.startswith("END"):
            break
        body = line[10:]
        cards[line[:8].strip()] = body[1 : body.index("'", 1)].rstrip() if body[0] == "'" else body.split("/")[0].strip()
    at += -at % 2880
    ny, nx = int(cards["NAXIS2"]), int(cards["NAXIS1"])
    assert len(raw) % 2880 == 0 and set(raw[at + ny * nx * 8 :]) <= {0}
    return cards, np.frombuffer(raw[at : at + ny * nx * 8], ">f8").reshape(ny, nx)


def test_fits_files_read_back(spark, tmp_path):
    grid = fits.Grid(ra=150.1, dec=-2.2, scale=0.11, ny=13, nx=7, row=6.5, col=3.25)
    rng = np.random.default_rng(0)
    images = {i: rng.normal(size=(13, 7)) for i in range(4)}
    rows = [(i, y + 1, x + 1, float(a[y, x])) for i, a in images.items() for y in range(13) for x in range(7) if not (i == 2 and (y in (0, 5, 12) or x == 3))]
    fits.write_images(spark.createDataFrame(rows, IMAGES).repartition(3), str(tmp_path / "out"), grid, [("BAND", "F158", "filter")])
    assert sorted(os.listdir(tmp_path / "out")) == [f"{i}.fits" for i in range(4)]
    for i, a in images.items():
        cards, got = parsed(tmp_path / "out" / f"{i}.fits")
        if i == 2:
            a[[0, 5, 12]], a[:, 3] = np.nan, np.nan
        np.testing.assert_array_equal(got, a)
        assert cards["SIMPLE"] == "T" and cards["BITPIX"] == "-64" and cards["BAND"] == "F158"
        for key, value, _ in fits.wcs_cards(grid):
            assert cards[key] == value if isinstance(value, str) else float(cards[key]) == value
    found = {r["key"]: r["value"] for r in fits.read_header(spark, str(tmp_path / "out" / "1.fits")).collect()}
    assert found["CTYPE1"] == "RA---TAN" and float(found["CRVAL2"]) == -2.2 and len(fits.wcs_cards(grid)) == 13


def test_a_failed_fits_write_leaves_nothing(spark, tmp_path):
    grid = fits.Grid(0.0, 0.0, 1.0, 4, 4, 1.0, 1.0)
    rows = [(i, y, x, 1.0) for i in range(3) for y in range(1, 5) for x in range(1, 5)] + [(1, 5, 1, 1.0)]
    with pytest.raises(Exception, match="not on a grid of 4 x 4"):
        fits.write_images(spark.createDataFrame(rows, IMAGES), str(tmp_path / "bad"), grid)
    assert not [f for f in os.listdir(tmp_path / "bad") if not f.startswith(".")] if (tmp_path / "bad").exists() else True
    with pytest.raises(ValueError):
        fits.card("CRVAL1", float("nan"))


def tiles(spark, n=40):
    rows = [(t, t % 5, 10 * t, 10 * t + 9, 1, 10, 10 * t - 2, 10 * t + 11, 1, 12, [(f"im{t % 3}", 1, 5, 1, 5), ("im9", 2, 3, 2, 3)]) for t in range(n)]
    return spark.createDataFrame(rows, plan_folder.TILE.removesuffix(", hash string"))


def test_a_plan_reads_back_and_is_checked(spark, tmp_path):
    path = str(tmp_path / "plan")
    plan_folder.write_plan(tiles(spark), path, {"fwhm": 3.0}, shard_size=4)
    got = plan_folder.read_plan(spark, path)
    assert got.count() == 40 and got.select("hash").distinct().count() == 40 and len(os.listdir(path)) > 9
    assert sorted(r["tile"] for r in plan_folder.read_plan(spark, path, 2).collect()) == [t for t in range(40) if t % 5 == 2]
    job = plan_folder.PlanReader({"path": path, "job": "2"}).partitions()
    assert 0 < len(job) < len(plan_folder.PlanReader({"path": path}).partitions())  # a job reads its own shards
    with pytest.raises(Exception, match="written once"):
        plan_folder.write_plan(tiles(spark), path, {"fwhm": 3.0})
    assert os.listdir(tmp_path) == ["plan"]
    other = str(tmp_path / "other")
    plan_folder.write_plan(tiles(spark, 41), other, {"fwhm": 3.0}, shard_size=100)
    same = got.select("tile", "hash").join(plan_folder.read_plan(spark, other).select("tile", "hash"), ["tile", "hash"])
    assert same.count() == 40  # a plan made anew keeps the hashes of tiles that it does not change
    shard = next(f for f in os.listdir(path) if f.startswith("shard"))
    content = json.load(open(f"{path}/{shard}"))
    content["tiles"][0]["r1"] += 1
    json.dump(content, open(f"{path}/{shard}", "w"))
    with pytest.raises(Exception, match="does not match its hash"):
        plan_folder.read_plan(spark, path).count()
    index = json.load(open(f"{other}/index.json"))
    index["version"] = 99
    json.dump(index, open(f"{other}/index.json", "w"))
    with pytest.raises(Exception, match="version 99"):
        plan_folder.read_plan(spark, other).count()


def test_an_interrupted_run_goes_on_and_failures_stay_alone(spark, tmp_path):
    path, results = str(tmp_path / "plan"), str(tmp_path / "results")
    plan_folder.write_plan(tiles(spark, 12), path, {})
    log = tmp_path / "log"
    log.mkdir()

    def work(tile, broken=True):
        open(f"{log}/{tile['tile']}", "a").write("x")
        if broken and tile["tile"] in (3, 7):
            raise RuntimeError(f"no fit for {tile['tile']}")
        return tile["r1"] - tile["r0"]

    first = plan_folder.run_tiles(plan_folder.read_plan(spark, path, 0), work, results)  # one job, then a stop
    assert sorted(r["tile"] for r in first.collect()) == [0, 5, 10]
    second = plan_folder.run_tiles(plan_folder.read_plan(spark, path), work, results)
    failed = second.where("status = 'failed'").collect()
    assert sorted(r["tile"] for r in failed) == [3, 7] and all("no fit for" in r["error"] for r in failed)
    third = plan_folder.run_tiles(plan_folder.read_plan(spark, path), lambda t: work(t, False), results)
    assert third.where("status = 'ok'").select("tile").distinct().count() == 12
    tried = {int(f): len(open(log / f).read()) for f in os.listdir(log)}
    assert tried == {t: 2 if t in (3, 7) else 1 for t in range(12)}  # finished tiles are not done again


def test_cutouts_read_their_rows(spark, tmp_path):
    a = np.arange(600.0 * 9).reshape(600, 9)
    np.save(tmp_path / "a.npy", a)
    df = spark.createDataFrame([(str(tmp_path / "a.npy"), 290, 560, 3, 5), (str(tmp_path / "a.npy"), 0, 2, 8, 50)], "path string, r0 long, r1 long, c0 long, c1 long")
    got = plan_folder.read_cutouts(df).toPandas()
    assert len(got) == 271 * 3 + 2 * 2 and (got["v"] == a[got["y"] - 1, got["x"] - 1]).all()


def test_partitions_equal_a_full_search(spark):
    cases = [(4100, 1500), (4100, 4100), (4000, 3000), (1500, 2600), (9000, 700), (1, 1)]
    got = plan_folder.partition_frames(spark.createDataFrame(cases, "ny long, nx long"), 2000, 80)
    assert {(r["ny"], r["nx"]): (r["n"], r["m"]) for r in got.collect()}[(4100, 4100)] == (2, 3)

    def lengths(n, parts):
        return [min(n, k * n // parts + 80) - max(1, (k - 1) * n // parts + 1 - 80) + 1 for k in range(1, parts + 1)]

    for r in got.collect():
        ny, nx = r["ny"], r["nx"]
        fits_ = [(n * m, sum(lengths(ny, n)) * sum(lengths(nx, m)), n, m) for n in range(1, min(ny, 40) + 1) for m in range(1, min(nx, 40) + 1) if max(lengths(ny, n)) * max(lengths(nx, m)) <= 2000**2]
        assert (r["n"], r["m"]) == min(fits_)[2:]
    with pytest.raises(ValueError):
        plan_folder.partition_frames(spark.createDataFrame(cases, "ny long, nx long"), 150, 80)


def test_maps_rise_in_degree_until_the_points_between_are_met(spark):
    images = spark.createDataFrame([(1, 30, 20)], "image long, ny long, nx long")
    at = maps.lattice(images, 21, 5.0)
    assert at.where("check").count() == 400 and at.where("not check").count() == 441
    bent = lambda a: at.withColumns({"u": F.col("y"), "v": F.col("x")}).withColumns({"y": F.col("u") + a * F.sin(F.col("u") / 12), "x": F.col("v") + a * F.cos(F.col("v") / 9)})
    low, high = maps.fit_maps(bent(0.01)).first(), maps.fit_maps(bent(0.5)).first()
    assert low["degree"] == 5 and high["degree"] > 5 and max(low["error"], high["error"]) <= 1e-4
    with pytest.raises(Exception, match="split the image"):
        maps.fit_maps(bent(50.0), tol=1e-9).count()
