"""Sources against images, first guesses and selections where SQL rows do not reach."""

import numpy as np

from starfold.operators import scene as Z


def test_sources_meet_the_images_that_hold_them(spark):
    rng = np.random.default_rng(6)
    images = [(k, 40, 30, float(rng.uniform(-20, 20)), float(rng.choice([-0.5, 0.5, 2.0])), float(rng.uniform(-20, 20)), 1.0) for k in range(9)]
    sources = [(k, float(y), float(x)) for k, (y, x) in enumerate(rng.uniform(-60, 90, (300, 2)))]
    df = spark.createDataFrame(images, "image long, ny long, nx long, ay double, by double, ax double, bx double")
    for margin in (0.0, 7.0):
        got = {(r["id"], r["image"]) for r in Z.seen_in(spark.createDataFrame(sources, "id long, y double, x double"), df, margin, 16).collect()}
        want = {(s, i) for s, y, x in sources for i, ny, nx, ay, by, ax, bx in images if 0.5 - margin <= ay + by * y <= ny + 0.5 + margin and 0.5 - margin <= ax + bx * x <= nx + 0.5 + margin}
        assert got == want and want


def test_a_star_without_light_gets_its_brightest_pixel_or_nearly_nothing(spark):
    image = spark.createDataFrame([(y, x, 5.0) for y in range(1, 12) for x in range(1, 12)] + [(y, x + 40, 5.0 if (y, x) != (6, 6) else float("nan")) for y in range(1, 12) for x in range(1, 12)], "y long, x long, v double")
    stars = spark.createDataFrame([(1, 6.0, 6.0), (2, 6.0, 46.0)], "id long, y double, x double").selectExpr("*", "1.0D AS flux")
    got = {r["id"]: r for r in Z.first_guess(stars, image, 3).collect()}
    assert all(r["bkg"] == 5.0 and r["flux"] == 2.0**-52 for r in got.values())


def test_refining_stars_are_a_fixed_subset(spark):
    rows = [(b, k, float(k)) for b in range(2) for k in range(50)]
    df = spark.createDataFrame(rows, "band long, id long, snr double")
    one, two = (sorted(tuple(r) for r in Z.refining_stars(d, 5.0, 44.0, 10).collect()) for d in (df, df.repartition(5)))
    assert one == two and len(one) == 20 and all(5 <= s <= 44 for *_, s in one)
    assert Z.refining_stars(df, 5.0, 44.0, 100).count() == 80


def test_nothing_in_use_has_no_drift(spark):
    df = spark.createDataFrame([(1.0, 2.0, 0.0, 0.0, False)], "y double, x double, y_old double, x_old double, used boolean")
    assert Z.without_drift(df).first()["y"] == 1.0
