"""Tabulated, gridded and pixel-integrated point-spread functions.

Each comes twice: as a model for fits in numpy (a call gives values, ``slopes`` their derivatives by
``names``), and as column expressions that evaluate every row of a table on the JVM. Offsets are
pixel minus star, in pixels. A table's grid is a literal of the plan; ``MAX_CELLS`` bounds it.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import catmull_rom_weights
from .fit import erf

C = F.col
K = 4 * math.log(2)
MAX_CELLS = 100_000
#: Cubic convolution: row k holds the factors of t^k for the four taps.
BASIS = np.array([[0, 2, 0, 0], [-1, 0, 1, 0], [2, -5, 4, -1], [-1, 3, -3, 1]]) / 2
NODES, WEIGHTS = np.polynomial.legendre.leggauss(16)


def pair(oversample: int | Iterable[int]) -> tuple[int, int]:
    """Oversampling along y and x, from one whole positive number or two."""
    both = (oversample, oversample) if isinstance(oversample, (int, np.integer)) else tuple(oversample)
    if len(both) != 2 or any(isinstance(n, bool) or not isinstance(n, (int, np.integer)) or n < 1 for n in both):
        raise ValueError("oversample must be one or two positive whole numbers")
    return int(both[0]), int(both[1])


@dataclass(frozen=True)
class Tabulated:
    """A star's light on an oversampled grid of unit flux, interpolated by cubic convolution, ``fill`` outside.

    ``origin`` is the star's place in cells from 0, the middle of the grid where it is None. Taps beyond an edge repeat it.
    """

    grid: np.ndarray
    oversample: int | tuple[int, int] = 1
    origin: tuple[float, float] | None = None
    fill: float = 0.0
    normalize: bool = False
    names = ("y", "x", "flux", "bkg")

    def __post_init__(self):
        grid = np.array(self.grid, float)
        if grid.ndim != 2 or min(grid.shape) < 4:
            raise ValueError("the grid needs two axes of at least four cells")
        if not np.isfinite(grid).all():
            raise ValueError("the grid must be finite")
        over = pair(self.oversample)
        if self.normalize:
            if not grid.sum() > 0:
                raise ValueError("a grid without light cannot be normalised")
            grid = grid * (over[0] * over[1] / grid.sum())
        origin = tuple((n - 1) / 2 for n in grid.shape) if self.origin is None else tuple(map(float, self.origin))
        if len(origin) != 2 or not np.isfinite(origin).all():
            raise ValueError("the origin must be two finite numbers")
        for name, value in (("grid", grid), ("oversample", over), ("origin", origin), ("normalize", False)):
            object.__setattr__(self, name, value)

    def sample(self, dy: np.ndarray, dx: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Light at offsets, and its derivatives by both offsets."""
        inside, at = True, []
        for d, n, over, mid in zip((dy, dx), self.grid.shape, self.oversample, self.origin, strict=True):
            c = np.asarray(d, float) * over + mid
            inside = inside & (c >= 0) & (c <= n - 1)
            c = np.where((c >= 0) & (c <= n - 1), c, 0.0)
            i = np.minimum(c.astype(int), n - 2)
            t = c - i
            zero, one = np.zeros_like(t), np.ones_like(t)
            at.append((np.clip(i[..., None] + np.arange(-1, 3), 0, n - 1), np.stack([one, t, t * t, t**3], -1) @ BASIS, np.stack([zero, one, 2 * t, 3 * t * t], -1) @ BASIS * over))
        (i, wy, sy), (j, wx, sx) = at
        taps = self.grid[i[..., :, None], j[..., None, :]]
        of = lambda a, b: np.einsum("...ij,...i,...j->...", taps, a, b)
        return np.where(inside, of(wy, wx), self.fill), np.where(inside, of(sy, wx), 0.0), np.where(inside, of(wy, sx), 0.0)

    def __call__(self, p: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
        return p[3] + p[2] * self.sample(y - p[0], x - p[1])[0]

    def slopes(self, p: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
        value, by_y, by_x = self.sample(y - p[0], x - p[1])
        return np.stack([-p[2] * by_y, -p[2] * by_x, value, np.ones_like(value)], axis=1)

    def half_box(self) -> int:
        """Half the side of the smallest square of pixels around a star that holds the table."""
        reach = [max(mid, n - 1 - mid) / over for n, over, mid in zip(self.grid.shape, self.oversample, self.origin, strict=True)]
        return math.ceil(max(reach))


def span(nodes: list[float], at: float) -> tuple[int, float, float]:
    """The cell of a place among rising nodes, its fraction in [0, 1], and the fraction's slope (0 beyond the ends)."""
    if len(nodes) == 1:
        return 0, 0.0, 0.0
    k = int(np.clip(np.searchsorted(nodes, at, side="right") - 1, 0, len(nodes) - 2))
    width = nodes[k + 1] - nodes[k]
    t = (at - nodes[k]) / width
    return k, min(max(t, 0.0), 1.0), 1 / width if 0 <= t <= 1 else 0.0


@dataclass(frozen=True)
class Gridded:
    """Tables at the nodes of a rectangular grid of places, blended bilinearly at the star's place.

    The slopes by position hold the change of the weights too. Beyond the outer nodes the blend stays that of the edge.
    """

    tables: list[Tabulated]
    at_y: list[float]
    at_x: list[float]
    rows: list[float] = field(init=False)
    columns: list[float] = field(init=False)
    place: dict[tuple[int, int], int] = field(init=False)
    names = ("y", "x", "flux", "bkg")

    def __post_init__(self):
        if not self.tables or not len(self.tables) == len(self.at_y) == len(self.at_x):
            raise ValueError("each table needs a place, and there must be one at least")
        if not np.isfinite([*self.at_y, *self.at_x]).all():
            raise ValueError("places must be finite")
        rows, columns = (sorted({float(v) for v in a}) for a in (self.at_y, self.at_x))
        place = {(rows.index(float(b)), columns.index(float(a))): k for k, (b, a) in enumerate(zip(self.at_y, self.at_x, strict=True))}
        if len(place) != len(self.tables):
            raise ValueError("two tables at one place")
        if len(place) != len(rows) * len(columns) or (len(place) > 1 and min(len(rows), len(columns)) < 2):
            raise ValueError("the places must form a full rectangular grid, two by two at least")
        for name, value in (("rows", rows), ("columns", columns), ("place", place)):
            object.__setattr__(self, name, value)

    def blend(self, y: float, x: float) -> list[tuple[Tabulated, float, float, float]]:
        """The tables around a place with their weights and the weights' slopes by y and x."""
        i, t, dt = span(self.rows, y)
        j, u, du = span(self.columns, x)
        if len(self.tables) == 1:
            return [(self.tables[0], 1.0, 0.0, 0.0)]
        both = lambda f, s: ((1 - f, -s), (f, s))
        return [(self.tables[self.place[i + a, j + b]], wy * wx, sy * wx, wy * sx) for a, (wy, sy) in enumerate(both(t, dt)) for b, (wx, sx) in enumerate(both(u, du))]

    def parts(self, p: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Blended light and its derivatives by the star's y and x."""
        total = np.zeros((3, *np.shape(y)))
        for table, w, w_y, w_x in self.blend(float(p[0]), float(p[1])):
            value, by_y, by_x = table.sample(y - p[0], x - p[1])
            total += [w * value, w_y * value - w * by_y, w_x * value - w * by_x]
        return total

    def __call__(self, p: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
        return p[3] + p[2] * self.parts(p, y, x)[0]

    def slopes(self, p: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
        value, by_y, by_x = self.parts(p, y, x)
        return np.stack([p[2] * by_y, p[2] * by_x, value, np.ones_like(value)], axis=1)

    def half_box(self) -> int:
        return max(t.half_box() for t in self.tables)


@dataclass(frozen=True)
class PixelGaussian:
    """A Gaussian turned by theta degrees; its axes are those of the box of unit sides that it is integrated over."""

    names = ("y", "x", "y_fwhm", "x_fwhm", "theta", "flux", "bkg")

    def _turned(self, p: np.ndarray, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
        c, s = math.cos(math.radians(p[4])), math.sin(math.radians(p[4]))
        return c * (x - p[1]) + s * (y - p[0]), c * (y - p[0]) - s * (x - p[1]), c, s

    @staticmethod
    def _side(a: np.ndarray, fwhm: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Share of light in the unit interval around ``a``, its slopes by ``a`` and by the width."""
        k = math.sqrt(K) / fwhm
        ends = [(sign, k * (a + sign / 2)) for sign in (1, -1)]
        bell = [(sign, z, np.exp(-z * z) / math.sqrt(math.pi)) for sign, z in ends]
        return sum(sign * erf(z) for sign, z in ends) / 2, sum(sign * k * b for sign, _, b in bell), -sum(sign * z * b for sign, z, b in bell) / fwhm

    def __call__(self, p: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
        u, v, _, _ = self._turned(p, y, x)
        return p[6] + p[5] * self._side(u, p[3])[0] * self._side(v, p[2])[0]

    def slopes(self, p: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
        u, v, c, s = self._turned(p, y, x)
        (a, a_u, a_w), (b, b_v, b_w) = self._side(u, p[3]), self._side(v, p[2])
        along, across = p[5] * a_u * b, p[5] * a * b_v  # by u and by v
        turn = math.radians(1)
        return np.stack([-s * along - c * across, s * across - c * along, p[5] * a * b_w, p[5] * a_w * b, turn * (v * along - u * across), a * b, np.ones_like(a)], axis=1)


def unit_interval(a: Column, fwhm: Column) -> Column:
    """A Gaussian's share of light in the unit interval around ``a``: sixteen-point Gauss quadrature, good to 1e-9 for widths from 0.5 pixels."""
    terms = [F.exp(-K * (a + float(n) / 2) * (a + float(n) / 2) / (fwhm * fwhm)) * float(w / 2) for n, w in zip(NODES, WEIGHTS, strict=True)]
    return sum(terms[1:], terms[0]) * math.sqrt(K / math.pi) / fwhm


def pixel_gaussian(dy: Column, dx: Column, y_fwhm: Column, x_fwhm: Column, theta: Column) -> Column:
    """Unit-flux value of ``PixelGaussian`` at an offset."""
    c, s = F.cos(F.radians(theta)), F.sin(F.radians(theta))
    return unit_interval(c * dx + s * dy, x_fwhm) * unit_interval(c * dy - s * dx, y_fwhm)


def literal(values: np.ndarray) -> Column:
    """An array of doubles as one literal of the plan."""
    if np.size(values) > MAX_CELLS:
        raise ValueError(f"a literal holds at most {MAX_CELLS} cells")
    return F.from_json(F.lit(json.dumps(np.ravel(values).tolist())), "array<double>")


def with_light(rows: DataFrame, model: Tabulated | Gridded, y: str = "y", x: str = "x", dy: str = "dy", dx: str = "dx") -> DataFrame:
    """``rows`` with ``light``, ``light_y`` and ``light_x``: the unit-flux model at an offset from a star, and its slopes by the star's place.

    The tables of a gridded model must share their shape, oversampling, origin and fill. No row is multiplied and nothing is shuffled.
    """
    grid = model if isinstance(model, Gridded) else Gridded([model], [0.0], [0.0])
    first = grid.tables[0]
    if any((t.grid.shape, t.oversample, t.origin, t.fill) != (first.grid.shape, first.oversample, first.origin, first.fill) for t in grid.tables):
        raise ValueError("the tables must share their shape, oversampling, origin and fill")
    (ny, nx), size = first.grid.shape, first.grid.size
    many = len(grid.tables) > 1
    ordered = [grid.tables[grid.place[i, j]].grid for i in range(len(grid.rows)) for j in range(len(grid.columns))]
    clamp = lambda c, low, high: F.least(F.lit(high), F.greatest(F.lit(low), c))
    new: dict[str, Column] = {"_all": literal(np.stack(ordered))}
    for axis, place, nodes in (("y", y, grid.rows), ("x", x, grid.columns)):
        if many:  # the last node at or below the place; places before the first and past the last stay in the outer cells
            cell = sum((F.when(C(place) >= n, 1).otherwise(0) for n in nodes[1:-1]), F.lit(0))
            low = F.element_at(F.array(*map(F.lit, nodes)), cell + 1)
            width = F.element_at(F.array(*map(F.lit, nodes)), cell + 2) - low
            t = (C(place) - low) / width
            new |= {f"_k{axis}": cell, f"_t{axis}": clamp(t, 0.0, 1.0), f"_s{axis}": F.when(t.between(0.0, 1.0), 1 / width).otherwise(0.0)}
    for axis, offset, n, over, mid in zip("yx", (dy, dx), (ny, nx), first.oversample, first.origin, strict=True):
        new[f"_c{axis}"] = C(offset) * float(over) + float(mid)
    rows = rows.withColumns(new)
    inside = C("_cy").between(0, ny - 1) & C("_cx").between(0, nx - 1)
    rows = rows.withColumns({f"_i{a}": clamp(F.floor(f"_c{a}").cast("int"), 0, n - 2) for a, n in (("y", ny), ("x", nx))} | {"_in": inside})
    rows = rows.withColumns({f"_f{a}": C(f"_c{a}") - C(f"_i{a}") for a in "yx"})
    wide = {}
    for a, over in zip("yx", first.oversample, strict=True):
        t = C(f"_f{a}")
        slope = [(3 * BASIS[3, k] * t + 2 * BASIS[2, k]) * t + BASIS[1, k] for k in range(4)]
        wide |= {f"_w{a}": F.array(*catmull_rom_weights(t)), f"_d{a}": F.array(*[s * float(over) for s in slope])}
    rows = rows.withColumns(wide)

    # Sixteen taps as arrays: k is four times the row and the column. Arrays keep the plan small, where single terms would fill megabytes.
    taps = F.sequence(F.lit(0), F.lit(15))
    tap = lambda f: F.transform(taps, lambda k: f(F.shiftright(k, 2), k % 4))
    at = lambda axis, k, n: clamp(C(f"_i{axis}") + k - 1, 0, n - 1)
    cells = lambda base: tap(lambda i, j: F.get("_all", base + at("y", i, ny) * nx + at("x", j, nx)))
    total = lambda a, b: F.aggregate(F.zip_with(a, b, lambda v, w: v * w), F.lit(0.0), lambda t, v: t + v)
    corners = [(a, b) for a in (0, 1) for b in (0, 1)] if many else [(0, 0)]
    found = {f"_n{a}{b}": cells(((C("_ky") + a) * len(grid.columns) + C("_kx") + b) * size if many else F.lit(0)) for a, b in corners}
    of = lambda wy, wx: tap(lambda i, j: F.get(wy, i) * F.get(wx, j))
    rows = rows.withColumns(found | {"_o": of("_wy", "_wx"), "_oy": of("_dy", "_wx"), "_ox": of("_wy", "_dx")})
    if many:
        side = lambda axis, k: C(f"_t{axis}") if k else 1 - C(f"_t{axis}")
        slope = lambda axis, k: C(f"_s{axis}") if k else -C(f"_s{axis}")
        share = {"_b": lambda a, b: side("y", a) * side("x", b), "_by": lambda a, b: slope("y", a) * side("x", b), "_bx": lambda a, b: side("y", a) * slope("x", b)}
        blend = lambda f: tap(lambda i, j: sum((f(a, b) * F.get(f"_n{a}{b}", 4 * i + j) for a, b in corners[1:]), f(0, 0) * F.get("_n00", 4 * i + j)))
        rows = rows.withColumns({k: blend(f) for k, f in share.items()})
        light, by_y, by_x = total("_b", "_o"), total("_by", "_o") - total("_b", "_oy"), total("_bx", "_o") - total("_b", "_ox")
        # Outside the tables all four give the fill, whose weights sum to 1 and whose slopes cancel.
    else:
        light, by_y, by_x = total("_n00", "_o"), -total("_n00", "_oy"), -total("_n00", "_ox")
    light, by_y, by_x = (F.when(C("_in"), v).otherwise(float(f)) for v, f in ((light, first.fill), (by_y, 0.0), (by_x, 0.0)))
    made = {*new, *found, "_in", "_o", "_oy", "_ox", "_b", "_by", "_bx", *[f"_{k}{a}" for k in "ifwd" for a in "yx"]}
    return rows.withColumns({"light": light, "light_y": by_y, "light_x": by_x}).drop(*made)
