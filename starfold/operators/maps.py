"""Polynomial maps of positions, fitted for each image: least squares, raised in degree until points between the fitted ones are met."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import ship

C = F.col
MAP = "image long, degree int, u0 double, v0 double, scale double, my array<array<double>>, mx array<array<double>>, error double"


def lattice(images: DataFrame, n: int = 41, margin: float = 40.0) -> DataFrame:
    """``image, y, x, check`` for images (``image, ny, nx``): n x n points over the image and its margin, and (``check``) those in the middle between them."""
    side = lambda size, k, count: 1 - margin + (C(size) - 1 + 2 * margin) * k / (count - 1)
    half = lambda size, k: 1 - margin + (C(size) - 1 + 2 * margin) * (k + 0.5) / (n - 1)
    points = F.explode(F.expr(f"flatten(transform(sequence(0, {n - 1}), i -> transform(sequence(0, {n - 1}), j -> named_struct('i', i, 'j', j))))")).alias("p")
    at = images.select("image", "ny", "nx", points)
    fitted = at.select("image", side("ny", C("p.i"), n).alias("y"), side("nx", C("p.j"), n).alias("x"), F.lit(False).alias("check"))
    between = at.where((C("p.i") < n - 1) & (C("p.j") < n - 1)).select("image", half("ny", C("p.i")).alias("y"), half("nx", C("p.j")).alias("x"), F.lit(True).alias("check"))
    return fitted.unionByName(between)


def fit_maps(points: DataFrame, degree: int = 5, most: int = 9, tol: float = 1e-4) -> DataFrame:
    """``MAP`` of each image from ``image, u, v, y, x, check``: coefficients of u^i v^j in ``my[i][j]``, for (u - u0) / scale and (v - v0) / scale.

    The degree rises by 2 until the greatest error at the points of ``check`` is at most ``tol``; beyond ``most`` is an error, as are positions that are not finite.
    An image's points are a bounded group.
    """
    if degree > most:
        raise ValueError("the first degree is above the last")
    ship(points.sparkSession)

    def one(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        u, v, y, x = (p[c].to_numpy(float) for c in ("u", "v", "y", "x"))
        if not np.isfinite(np.stack([u, v, y, x])).all():
            raise ValueError(f"image {key[0]}: positions on the lattice are not finite")
        check = p["check"].to_numpy(bool)
        u0, v0 = u[~check].mean(), v[~check].mean()
        scale = max(abs(u[~check] - u0).max(), abs(v[~check] - v0).max()) or 1.0
        a, b = (u - u0) / scale, (v - v0) / scale
        for d in range(degree, most + 1, 2):
            powers = [(i, j) for i in range(d + 1) for j in range(d + 1 - i)]
            design = np.stack([a**i * b**j for i, j in powers], axis=1)
            if len(powers) > (~check).sum():
                raise ValueError(f"image {key[0]}: {len(powers)} coefficients need more points")
            found = np.linalg.lstsq(design[~check], np.stack([y, x], axis=1)[~check], rcond=None)[0]
            worst = abs(design[check] @ found - np.stack([y, x], axis=1)[check]).max(initial=0.0)
            if worst <= tol:
                grid = [[[found[powers.index((i, j)), k] for j in range(d + 1 - i)] for i in range(d + 1)] for k in (0, 1)]
                return pd.DataFrame([(key[0], d, u0, v0, scale, *grid, worst)], columns=["image", "degree", "u0", "v0", "scale", "my", "mx", "error"])
        raise ValueError(f"image {key[0]}: error {worst:.3g} exceeds {tol} up to degree {most}; split the image")

    return points.groupBy("image").applyInPandas(one, MAP)
