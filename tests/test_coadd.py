"""Coadds against brute force: clipped polygons, flux, weighted medians, growth of rejections."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from starfold.operators import coadd as K

EXTENT = 16.0
PIXELS = "image long, y long, x long, data double, background double, model double, rms double, weight double"
IMAGES = "image long, band long, flux_scale double, my array<array<double>>, mx array<array<double>>, r0 double, c0 double, extent double"


def clipped_area(corners, half):
    """Area of a polygon within a square about the origin, one side of the square after the other."""
    poly = list(corners)
    for axis in (0, 1):
        for sign in (1, -1):
            out = []
            for a, b in zip(poly, poly[1:] + poly[:1]):
                da, db = half - sign * a[axis], half - sign * b[axis]
                if da >= 0:
                    out.append(a)
                if (da >= 0) != (db >= 0):
                    t = da / (da - db)
                    out.append((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
            poly = out
            if not poly:
                return 0.0
    return abs(sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(poly, poly[1:] + poly[:1]))) / 2


def turned(spark, angles, scale=0.8, bend=0.0):
    rows = []
    for i, t in enumerate(angles):
        co, si = math.cos(t) * scale * EXTENT, math.sin(t) * scale * EXTENT
        my, mx = [[0.3 * i, si, bend], [co, bend]], [[-0.2 * i, co], [-si, 0.0], [bend]]
        rows.append((i, 0, 1.0 + 0.5 * i, my, mx, 5.0, 5.0, EXTENT))
    return rows, spark.createDataFrame(rows, IMAGES)


def field(spark, n, images, noise=0.1, seed=3, spoil=None):
    rng = np.random.default_rng(seed)
    rows = [(i, y, x, float(rng.normal(1.0, noise)), 0.0, 0.0, noise, 1 / noise**2) for i in range(images) for y in range(-n, n + 1) for x in range(-n, n + 1)]
    rows = [(*r[:3], r[3] + 5.0, *r[4:]) if r[:3] in (spoil or ()) else r for r in rows]
    return rows, spark.createDataFrame(rows, PIXELS)


@pytest.mark.parametrize("bend", [0.0, 0.5])
def test_rotated_drops_equal_clipped_polygons(spark, bend):
    rows, images = turned(spark, [0.0, 0.4, 1.2, math.pi / 2], bend=bend)
    given, pixels = field(spark, 3, 4)
    got = {(r["image"], r["y"], r["x"], r["r"], r["c"]): r["a"] for r in K.placed_nodes(pixels, images, 2, 0.7).collect()}
    want = {}
    for i, _, _, my, mx, r0, c0, extent in rows:
        at = lambda k, u, v: sum(k[p][q] * u**p * v**q for p in range(len(k)) for q in range(len(k[p])))
        for r in range(-6, 17):
            for c in range(-6, 17):
                if max(abs(r - r0), abs(c - c0)) > extent:
                    continue
                u, v, h = (r - r0) / extent, (c - c0) / extent, 1e-6
                y, x = at(my, u, v), at(mx, u, v)
                a = [(at(k, u + h, v) - at(k, u - h, v)) / (2 * h) / extent for k in (my, mx)]
                b = [(at(k, u, v + h) - at(k, u, v - h)) / (2 * h) / extent for k in (my, mx)]
                f = abs(a[0] * b[1] - a[1] * b[0])
                for py in range(-3, 4):
                    for px in range(-3, 4):
                        corners = [(y - py + (p * a[0] + q * b[0]) / 2, x - px + (p * a[1] + q * b[1]) / 2) for p, q in ((-1, -1), (1, -1), (1, 1), (-1, 1))]
                        area = clipped_area(corners, 0.35)
                        if area > 1e-9:
                            want[(i, py, px, r, c)] = area / f
    near = {k: v for k, v in got.items() if v > 2e-9}
    assert set(want) <= set(got) and set(near) <= set(want)
    assert max(abs(got[k] - v) for k, v in want.items()) < 1e-6


def test_flux_is_kept_and_units_differ_by_the_nodes_area(spark):
    _, images = turned(spark, [0.3], scale=0.5)
    _, pixels = field(spark, 4, 1)
    drops = K.placed_nodes(K.usable(pixels, "rms"), images)
    whole = drops.groupBy("y", "x").agg((F.sum(C_("a") * C_("f"))).alias("s")).toPandas()
    assert np.allclose(whole["s"], 1.0)  # a drop is shared out among its nodes without loss
    flux = K.coadd(pixels, images, ("data",)).toPandas().set_index(["r", "c"])
    light = K.coadd(pixels, images, ("data",), brightness=(5.0, 5.0, 0.1)).toPandas().set_index(["r", "c"])
    assert np.allclose(light["data"] / flux["data"], 100.0, rtol=1e-9)


def C_(name):
    return F.col(name)


def test_bad_pixels_are_left_out_and_bad_requests_refused(spark):
    _, images = turned(spark, [0.0])
    rows = [(0, 0, 0, math.nan, 0.0, 0.0, 1.0, 1.0), (0, 0, 1, 1.0, 0.0, 0.0, 1.0, 0.0), (0, 0, 2, 1.0, 0.0, 0.0, 0.0, 1.0), (0, 0, 3, None, 0.0, 0.0, 1.0, 1.0)]
    assert K.coadd(spark.createDataFrame(rows, PIXELS), images).count() == 0
    for bad in ({"quantities": ("flux",)}, {"pixfrac": 0.0}, {"weight": "none"}):
        with pytest.raises(ValueError):
            K.coadd(spark.createDataFrame(rows, PIXELS), images, **bad)


def test_weighted_median_is_the_least_value_at_half_the_weight(spark):
    rng = np.random.default_rng(5)
    rows = [(int(k), float(v), float(w)) for k, v, w in zip(rng.integers(0, 6, 200), rng.integers(0, 9, 200), rng.integers(1, 5, 200))]
    got = {r["k"]: r["med"] for r in K.weighted_median(spark.createDataFrame(rows, "k long, v double, w double"), ["k"], "v", "w").collect()}
    for k in range(6):
        mine = sorted((v, w) for g, v, w in rows if g == k)
        run, half = np.cumsum([w for _, w in mine]), sum(w for _, w in mine) / 2
        assert got[k] == mine[int(np.argmax(run >= half))][0]


def test_a_spoiled_pixel_is_rejected_with_its_neighbours(spark):
    _, images = turned(spark, [0.0] * 6, scale=1.0)
    images = images.withColumns({"my": F.expr("array(array(0D, 0D), array(16D))"), "mx": F.expr("array(array(0D, 16D), array(0D))"), "flux_scale": F.lit(1.0)})
    _, pixels = field(spark, 4, 6, spoil={(2, 0, 0)})
    plain = K.coadd(pixels, images, ("data", "nimg")).toPandas().set_index(["r", "c"])
    alone = K.coadd(pixels, images, ("data", "nimg"), clip=8.0, clip_grow=0).toPandas().set_index(["r", "c"])
    wide = K.coadd(pixels, images, ("data", "nimg"), clip=8.0).toPandas().set_index(["r", "c"])
    few = K.coadd(pixels, images, ("data", "nimg"), clip=8.0, clip_least=7).toPandas().set_index(["r", "c"])
    assert (plain["nimg"] == 6).all() and (few["nimg"] == 6).all() and np.allclose(few["data"].sort_index(), plain["data"].sort_index())
    assert (alone["nimg"] == 5).sum() == 1 and alone.loc[(5, 5), "nimg"] == 5 and abs(alone.loc[(5, 5), "data"] - 1) < 0.3
    assert (wide["nimg"] == 5).sum() == 9 and set(wide.index[wide["nimg"] == 5]) == {(r, c) for r in (4, 5, 6) for c in (4, 5, 6)}


def test_wide_sums_have_the_aperture_noise(spark):
    rng = np.random.default_rng(11)
    _, images = turned(spark, [0.2], scale=0.5)
    n, sums = 6, []
    base = spark.createDataFrame([(0, y, x) for y in range(-n, n + 1) for x in range(-n, n + 1)], "image long, y long, x long")
    drops = K.placed_nodes(base.selectExpr("*", "1.0D AS w"), images).select("y", "x", "r", "c", "a", "f").toPandas()
    totals = drops.groupby(["r", "c"])["a"].sum()
    inner = [k for k in totals.index if abs(k[0] - 5) <= 8 and abs(k[1] - 5) <= 8]
    for _ in range(200):
        noise = {(y, x): rng.normal() for y in range(-n, n + 1) for x in range(-n, n + 1)}
        v = (drops["a"] * drops["f"] * [noise[k] for k in zip(drops["y"], drops["x"])]).groupby([drops["r"], drops["c"]]).sum() / totals
        sums.append(v.loc[inner].sum())
    pixels = base.selectExpr("*", "1.0D AS data", "1.0D AS rms", "1.0D AS weight")
    noise = K.coadd(pixels, images, ("rms", "rms_aperture")).toPandas().set_index(["r", "c"]).loc[inner]
    assert 0.85 < np.std(sums) / math.sqrt((noise["rms_aperture"] ** 2).sum()) < 1.15
    assert math.sqrt((noise["rms"] ** 2).sum()) < 0.6 * np.std(sums)
