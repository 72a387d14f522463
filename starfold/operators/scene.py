"""Sources against many images, first guesses of stars, and selections for refining a profile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import shuffled
from .measure import gaussian, on_image
from .robust import finite, overall

C = F.col


def seen_in(sources: DataFrame, images: DataFrame, margin: float = 0.0, tile: int = 64, exclude: DataFrame | None = None) -> DataFrame:
    """``sources`` (``id, y, x`` and more) once for each image that sees them, with the image's columns and ``iy, ix``, the position in it.

    ``images`` has ``image, ny, nx`` and the map ``iy = ay + by y``, ``ix = ax + bx x``. A source counts if it lies within ``margin`` pixels of the
    image. Footprints are cut by tiles of the frame, so a source meets only images of its tile. Images named in ``exclude`` (``image``) are left out.
    """
    if exclude is not None:
        images = images.join(exclude.select("image"), "image", "left_anti")
    edge = lambda n, a, b, end: ((F.lit(0.5 - margin) if end == 0 else C(n) + 0.5 + margin) - C(a)) / C(b)
    cut = lambda n, a, b: F.sequence(F.floor(F.least(edge(n, a, b, 0), edge(n, a, b, 1)) / tile).cast("long"), F.floor(F.greatest(edge(n, a, b, 0), edge(n, a, b, 1)) / tile).cast("long"))
    near = images.select("*", F.explode(cut("ny", "ay", "by")).alias("_ty")).select("*", F.explode(cut("nx", "ax", "bx")).alias("_tx"))
    at = sources.withColumns({"_ty": F.floor(C("y") / tile).cast("long"), "_tx": F.floor(C("x") / tile).cast("long")})
    met = at.join(near, ["_ty", "_tx"]).drop("_ty", "_tx").withColumns({"iy": C("ay") + C("by") * C("y"), "ix": C("ax") + C("bx") * C("x")})
    inside = lambda p, n: (C(p) >= 0.5 - margin) & (C(p) <= C(n) + 0.5 + margin)
    return met.where(inside("iy", "ny") & inside("ix", "nx"))


def blend_terms(seen: DataFrame, pixels: DataFrame, fwhm: float) -> DataFrame:
    """``id, light, model, images``: at each source's pixel, over the images that see it with a positive inverse variance, the new source's light and the rendered catalog's, as signal to noise, and the number of images.

    ``seen`` is that of ``seen_in`` with ``flux, band_weight, flux_scale``; ``pixels`` has ``image, y, x, iv, model``.
    """
    at = seen.where(~F.isnan("flux")).withColumns({"py": F.rint("iy").cast("long"), "px": F.rint("ix").cast("long")})
    grid = pixels.where("iv > 0").select("image", C("y").alias("py"), C("x").alias("px"), "iv", C("model").alias("_m"))
    w = C("band_weight") * F.sqrt("iv")
    own = C("flux_scale") * C("flux") * gaussian(C("py") - C("iy"), C("px") - C("ix"), fwhm)
    return at.join(shuffled(grid), ["image", "py", "px"]).groupBy("id").agg(F.sum(w * own).alias("light"), F.sum(w * F.greatest(C("_m"), F.lit(0.0))).alias("model"), F.count("*").alias("images"))


def first_guess(sources: DataFrame, image: DataFrame, radius: int, share: float = 0.98) -> DataFrame:
    """``id, bkg, flux``: the median of the stamp's edge, and the sum of the light above it with the brightest pixels capped at the ``share`` of the sorted values.

    Light below the edge counts as 0. Without finite edge pixels the background is 0; without light the flux is the brightest pixel's, or the least double above 1 less 1.
    """
    met = on_image(sources, image, radius).where(finite(C("v")))
    edge = (F.abs(C("py") - C("ay")) == radius) | (F.abs(C("px") - C("ax")) == radius)
    sky = met.groupBy("id").agg(F.coalesce(F.median(F.when(edge, C("v"))), F.lit(0.0)).alias("bkg"), F.sort_array(F.collect_list("v")).alias("_v"))  # a stamp's pixels
    light = sky.withColumn("_l", F.transform("_v", lambda v: F.greatest(v - C("bkg"), F.lit(0.0))))
    place = F.greatest(F.lit(1), F.least(F.ceil(share * F.size("_l")), F.size("_l"))).cast("int")
    capped = light.withColumn("_cap", F.element_at("_l", place)).withColumn("_sum", F.aggregate("_l", F.lit(0.0), lambda t, v: t + F.least(v, C("_cap"))))
    tiny = F.lit(2.0**-52)
    return capped.select("id", "bkg", F.when(C("_sum") > tiny, C("_sum")).otherwise(F.greatest(tiny, F.element_at("_v", -1) - C("bkg"))).alias("flux"))


def without_drift(stars: DataFrame) -> DataFrame:
    """``stars`` (``y, x, y_old, x_old, used``) with the median shift of the used ones taken off their positions."""
    used = stars.where("used").select((C("y") - C("y_old")).alias("_dy"), (C("x") - C("x_old")).alias("_dx"))
    dy, dx = (overall(used, c) or 0.0 for c in ("_dy", "_dx"))
    return stars.withColumns({c: F.when(C("used"), C(c) - d).otherwise(C(c)) for c, d in (("y", dy), ("x", dx))})


def refining_stars(snr: DataFrame, low: float, high: float, most: int) -> DataFrame:
    """``band, id, snr`` of stars (of each band) with ``low <= snr <= high``; beyond ``most`` a fixed random subset, by the MD5 of the id."""
    w = Window.partitionBy("band").orderBy(F.md5(C("id").cast("string").cast("binary")), "id")
    return snr.where((C("snr") >= low) & (C("snr") <= high)).withColumn("_k", F.row_number().over(w)).where(C("_k") <= most).select("band", "id", "snr")


def kernel_template(cells: DataFrame, keys: list[str]) -> DataFrame:
    """``cells`` with ``template``: the profile of sum 1 behind each kernel (``k`` and its ``norm``) of zero sum or not."""
    whole = cells.groupBy(*keys).agg(F.sum("k").alias("_sum"), F.count("*").alias("_n"))
    d = C("norm") * C("norm")
    return cells.join(whole, keys).withColumn("template", C("k") * d + (1 - C("_sum") * d) / C("_n")).drop("_sum", "_n")


def sharp_half_width(fwhm: Column) -> Column:
    """Half width of the neighbourhood of the sharpness: 0.72 widths, at least 2 pixels."""
    return F.when(finite(fwhm) & (fwhm > 0), F.greatest(F.lit(2), F.floor(0.72 * fwhm))).otherwise(F.lit(2)).cast("int")


def node_to_frame(node: Column, finer: int) -> Column:
    """Frame position of a node of a grid that is ``finer`` times finer and has the same edges."""
    return (node - 0.5) / finer + 0.5


def box_half_width(y_fwhm: Column, x_fwhm: Column, theta: Column, factor: float = 5.0) -> Column:
    """Half width of the square that holds the ellipse of ``factor`` / 2 widths: the farther of its bounds along the axes, rounded up."""
    co, si = F.cos(F.radians(theta)), F.sin(F.radians(theta))
    reach = lambda a, b: factor / 2 * F.sqrt(a * a + b * b)
    return F.ceil(F.greatest(reach(x_fwhm * co, y_fwhm * si), reach(x_fwhm * si, y_fwhm * co))).cast("int")


def cell_name(ra: Column, dec: Column, i: Column, j: Column) -> Column:
    """A sky cell's name from its tangent point, rounded, and its place in the lattice, offset by 50."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    r, d = F.pmod(F.rint(ra).cast("int"), F.lit(360)), F.rint(dec).cast("int")
    return F.concat(F.lpad(r.cast("string"), 3, "0"), F.when(d >= 0, "p").otherwise("m"), two(F.abs(d)), F.lit("x"), two(50 + j), F.lit("y"), two(50 + i))
