"""Joint photometry of several images: shared positions, one flux for each band.

``images`` maps frame positions to pixels by a shift; ``pixels`` has ``image, y, x, v`` and the
images' ``band, oy, ox, weight``. The table of images, one small row each, is broadcast, as the planner takes
rendered pixels for fewer. Tiles of the frame are bounded groups that hold the pixels of all images.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import joint as J
from ..operators import sparse_fit as S
from ..shared import materialize, ship
from .multipass import Options

C = F.col
CATALOG = "id long, y double, x double, band string, flux double, flux_err double, snr double"


def linearised(y: np.ndarray, x: np.ndarray, flux: np.ndarray, parts: list[tuple[int, float, float, S.Grid]], profile: S.Profile) -> tuple[S.Blocks, np.ndarray, float]:
    """Normal equations by sources and pairs, gradient and cost over all images; parameters are y, x and a flux for each band.

    ``parts`` has for each image its band, its shift and its pixels.
    """
    n, k = len(y), 2 + flux.shape[1]
    total, slope, cost = S.Blocks(np.zeros((n, k, k)), np.zeros(0, int), np.zeros(0, int), np.zeros((0, k, k))), np.zeros((n, k)), 0.0
    for band, oy, ox, grid in parts:
        j = S.Jacobian(grid, profile, y + oy, x + ox, flux[:, band])
        spots = [0, 1, 2 + band]
        put = np.zeros((3, k))
        put[range(3), spots] = 1.0
        lift = lambda a, left, right: put.T @ (a * left[:, :, None] * right[:, None, :]) @ put  # noqa: B023, E731
        i, m, cross = j.pairs()
        total = total.merged(S.Blocks(lift(j.blocks @ j.blocks.transpose(0, 2, 1), j.scale, j.scale), i, m, lift(cross, j.scale[i], j.scale[m])))
        r = j.residual()
        slope[:, spots] += j.back(r).reshape(n, 3) * j.scale
        cost += (r * r).sum()
    return total, slope, cost


def fit_tile(sources: pd.DataFrame, pixels: pd.DataFrame, bands: list[str], o: Options) -> pd.DataFrame:
    """Positions, fluxes by band and their errors by damped least squares over all images of a tile: blocks of sources and pairs, conjugate gradients, errors over the most coupled neighbours."""
    y, x = sources["y"].to_numpy(float).copy(), sources["x"].to_numpy(float).copy()
    n, nb = len(y), len(bands)
    flux = np.stack([sources[f"f_{b}"].to_numpy(float) for b in bands], axis=1).copy()
    profile = S.gaussian_profile(o.fwhm)
    parts = []
    for _, p in pixels.groupby("image", sort=True):
        band, oy, ox = p[["band", "oy", "ox"]].iloc[0]
        parts.append((bands.index(band), oy, ox, S.Grid(p["y"].to_numpy(float), p["x"].to_numpy(float), p["v"].to_numpy(float), p["weight"].to_numpy(float), o.radius)))

    h, b, cost = linearised(y, x, flux, parts, profile)
    damp = 1e-3
    for _ in range(o.steps):
        unit, scale = h.scaled()
        for _ in range(8):
            s = S.conjugate_gradients(unit, b / scale, damp, 1e-6) / scale
            new = y + np.clip(s[:, 0], -0.5, 0.5), x + np.clip(s[:, 1], -0.5, 0.5), flux + s[:, 2:]
            h2, b2, cost2 = linearised(*new, parts, profile)
            if cost2 < cost:
                break
            damp *= 10
        else:
            break
        small = cost - cost2 < 1e-8 * cost
        (y, x, flux), h, b, cost, damp = new, h2, b2, cost2, max(damp / 10, 1e-6)
        if small:
            break
    unit, scale = h.scaled()
    err = np.sqrt(np.maximum(np.einsum("nkk->nk", S.marginal(unit))[:, 2:], 0)) / scale[:, 2:]
    rows = [(i, y[r], x[r], b, flux[r, c], err[r, c], flux[r, c] / err[r, c] if err[r, c] > 0 else math.nan) for r, (i, own) in enumerate(zip(sources["id"], sources["owned"], strict=True)) if own for c, b in enumerate(bands)]
    return pd.DataFrame(rows, columns=["id", "y", "x", "band", "flux", "flux_err", "snr"])


def fit_joint(sources: DataFrame, images: DataFrame, pixels: DataFrame, o: Options = Options()) -> DataFrame:
    """``id, y, x, band, flux, flux_err, snr`` of all sources (``id, y, x, flux``) from all images."""
    ship(pixels.sparkSession)
    bands = [r["band"] for r in J.first_seen(images, "band", "image").orderBy("first", "band").collect()]  # one row for each band
    placed = pixels.join(F.broadcast(images), "image").select("image", "band", "weight", "v", "oy", "ox", "y", "x", (C("y") - C("oy")).alias("fy"), (C("x") - C("ox")).alias("fx")).where(~F.isnan("v") & (C("weight") > 0))
    span = lambda c: F.explode(F.sequence(F.floor((C(c) - o.halo) / o.tile).cast("long"), F.floor((C(c) + o.halo) / o.tile).cast("long")))
    parts = placed.select("*", span("fy").alias("ty")).select("*", span("fx").alias("tx")).drop("fy", "fx")
    owned = (C("ty") == F.floor(C("y") / o.tile)) & (C("tx") == F.floor(C("x") / o.tile))
    near = sources.select("id", "y", "x", *[C("flux").alias(f"f_{b}") for b in bands]).select("*", span("y").alias("ty")).select("*", span("x").alias("tx")).withColumn("owned", owned)

    def tile(own: pd.DataFrame, px: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not own["owned"].any() or not len(px):
            return pd.DataFrame(columns=["id", "y", "x", "band", "flux", "flux_err", "snr"])
        return fit_tile(own, px, bands, o)

    return near.groupBy("ty", "tx").cogroup(parts.groupBy("ty", "tx")).applyInPandas(tile, CATALOG)


def significance(joint: DataFrame) -> DataFrame:
    """One row for each source: bands measured and their signal to noise combined."""
    good = joint.where(~F.isnan("snr"))
    return good.groupBy("id").agg(F.first("y").alias("y"), F.first("x").alias("x"), F.count("*").alias("bands"), (F.sum("snr") / F.sqrt(F.count("*"))).alias("significance"))


def wide(joint: DataFrame, bands: list[str]) -> DataFrame:
    """One row for each source with a flux column for each band."""
    if len({b.lower() for b in bands}) != len(bands):
        raise ValueError("band names collide as column names")
    at = materialize(joint, "joint").groupBy("id").agg(F.first("y").alias("y"), F.first("x").alias("x"), *[F.max(F.when(C("band") == b, C("flux"))).alias(f"flux_{b}") for b in bands])
    return at.select("id", "y", "x", *[F.coalesce(f"flux_{b}", F.lit(math.nan)).alias(f"flux_{b}") for b in bands])
