"""The whole two-dimensional background: boxes, voids, median filter, interpolation to pixels."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import materialize
from . import robust as R
from . import stencil as T

C = F.col


def background2d(pixels: DataFrame, box: int, exclude_percentile: float = 10.0, sigma: float = 3.0, window: int = 1, fill_value: float = 0.0) -> DataFrame:
    """``y, x, background, rms`` of every pixel of ``pixels`` (``y, x, v``, and ``masked`` and ``outside``, false if absent).

    Masked pixels, those outside the image's coverage and values that are not finite take no part in their box. A box with too few
    survivors is filled from its neighbours, and the mesh is median-filtered over ``window`` boxes on either side (0: not). Pixels outside
    get ``fill_value``. If no box is left, it is an error.
    """
    if not 0 <= exclude_percentile <= 100:
        raise ValueError("exclude_percentile must be in [0, 100]")
    flag = lambda n: F.coalesce(C(n), F.lit(False)) if n in pixels.columns else F.lit(False)
    pixels = pixels.select("y", "x", "v", flag("masked").alias("masked"), flag("outside").alias("outside"))
    good = pixels.where(~C("masked") & ~C("outside") & R.finite(C("v")))
    boxes = materialize(R.mesh(good.select("y", "x", "v"), (box, box), exclude_percentile, sigma), "boxes")
    if not boxes.where(~F.isnan("bkg")).head(1):
        raise ValueError("all boxes of the mesh were excluded: take larger boxes, a smaller exclude_percentile or looser clipping")
    last = pixels.agg(F.floor((F.max("y") - 1) / box).cast("long"), F.floor((F.max("x") - 1) / box).cast("long")).first()
    corners = boxes.sparkSession.createDataFrame([(0, 0), tuple(last)], "mi long, mj long").distinct()  # the mesh spans the image, whatever is masked
    void = corners.join(boxes, ["mi", "mj"], "left_anti").select("mi", "mj", F.lit(math.nan).alias("bkg"), F.lit(math.nan).alias("rms"))
    mesh = R.fill_mesh(boxes.select("mi", "mj", "bkg", "rms").unionByName(void))
    out = pixels.select("y", "x", "v", "outside")
    for name, value in (("background", "bkg"), ("rms", "rms")):
        m = mesh.select((C("mi") + 1).alias("y"), (C("mj") + 1).alias("x"), C(value).alias("v"))
        m = T.median_filter(m, window) if window else m.withColumnRenamed("v", "m")
        flat = materialize(m.select((C("y") - 1).alias("mi"), (C("x") - 1).alias("mj"), "m"), "mesh")
        z = T.zoom(flat, out.select("y", "x", "v"), "m", last[0] + 1, last[1] + 1, (last[0] + 1) * box, (last[1] + 1) * box, name)
        out = out.join(z.select("y", "x", name), ["y", "x"])
    hidden = lambda n: F.when(C("outside"), F.lit(float(fill_value))).otherwise(C(n)).alias(n)
    return out.select("y", "x", hidden("background"), hidden("rms"))
