"""Queries of the scalar functions over the star catalog and the cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..registry import query
from ..sources import bindings as B

C = F.col
STAR = f"WITH {B.STARS} "
PX = f"WITH {B.PIXELS} "


def rounded(**columns) -> list:
    return [F.round(c, 6).alias(n) for n, c in columns.items()]


@query("abmag_catalog", STAR + """SELECT id, round(CASE WHEN f > 0 THEN 2.5 * log10(3631.0 / f) ELSE 'nan'::DOUBLE END, 6) AS mag,
  round(CASE WHEN f > 0 THEN 2.5 / ln(10) * (sqrt(flux) / f) ELSE 'nan'::DOUBLE END, 6) AS mag_err FROM (SELECT id, flux, flux - 1200 AS f FROM stars)""")
def abmag_catalog(spark: SparkSession, sf: str) -> DataFrame:
    f = C("flux") - 1200
    return B.stars(spark, sf).select("id", *rounded(mag=S.abmag(f), mag_err=S.abmag_err(f, F.sqrt("flux"))))


@query("total_error", STAR + """SELECT id, round(CASE WHEN g > 0 AND d > 0 THEN sqrt(9 + d / g) ELSE 3.0 END, 6) AS err
  FROM (SELECT id, flux - 1200 AS d, CAST(id % 4 AS DOUBLE) AS g FROM stars)""")
def total_error(spark: SparkSession, sf: str) -> DataFrame:
    return B.stars(spark, sf).select("id", *rounded(err=S.total_error(C("flux") - 1200, F.lit(3.0), (C("id") % 4).cast("double"))))


@query("flux_for_snr", STAR + """, q AS (SELECT id, flux, 12.0 * (50.0 / 2.0 + 9.0) AS n, 1.0 + id % 50 AS s FROM stars)
  SELECT id, round((s * s / 2 + sqrt((s * s / 2) * (s * s / 2) + 4 * s * s * n)) / 2, 6) AS flux_at, round(flux / sqrt(flux / 2.0 + n), 6) AS snr FROM q""")
def flux_for_snr(spark: SparkSession, sf: str) -> DataFrame:
    gain, snr = F.lit(2.0), (1 + C("id") % 50).cast("double")
    noise = S.noise_area(F.lit(12.0), F.lit(50.0), F.lit(3.0), gain)
    return B.stars(spark, sf).select("id", *rounded(flux_at=S.flux_for_snr(snr, noise, gain), snr=S.snr_for_flux(C("flux"), noise, gain)))


GRID = {"ra0": 80.0, "dec0": -69.0, "scale": 0.11, "cy": 64.0, "cx": 64.0}


@query("tan_inverse", STAR + """, p AS (SELECT id, (y - field * 128 - 64.0) * 0.11 / 206264.80624709636 AS eta, -(x - 64.0) * 0.11 / 206264.80624709636 AS xi FROM stars),
  d AS (SELECT id, xi, eta, cos(radians(-69.0)) - eta * sin(radians(-69.0)) AS d FROM p), r AS (SELECT *, 80.0 + degrees(atan2(xi, d)) AS a FROM d)
  SELECT id, round(a - 360 * floor(a / 360), 6) AS ra, round(degrees(atan2(sin(radians(-69.0)) + eta * cos(radians(-69.0)), sqrt(xi * xi + d * d))), 6) AS dec FROM r""")
def tan_inverse(spark: SparkSession, sf: str) -> DataFrame:
    ra, dec = S.tan_inverse(C("y") - C("field") * B.SIDE, C("x"), **GRID)
    return B.stars(spark, sf).select("id", *rounded(ra=ra, dec=dec))


@query("tan_forward", STAR + """, p AS (SELECT id, radians((x - 64.0) / 500.0) AS a, radians(-69.0 + (y - field * 128 - 64.0) / 500.0) AS d FROM stars),
  c AS (SELECT *, sin(radians(-69.0)) * sin(d) + cos(radians(-69.0)) * cos(d) * cos(a) AS c FROM p)
  SELECT id, round(64.0 + (cos(radians(-69.0)) * sin(d) - sin(radians(-69.0)) * cos(d) * cos(a)) / c * (206264.80624709636 / 0.11), 4) AS grid_y,
   round(64.0 - cos(d) * sin(a) / c * (206264.80624709636 / 0.11), 4) AS grid_x FROM c""")
def tan_forward(spark: SparkSession, sf: str) -> DataFrame:
    y, x = S.tan_forward(80.0 + (C("x") - 64) / 500, -69.0 + (C("y") - C("field") * B.SIDE - 64) / 500, **GRID)
    return B.stars(spark, sf).select("id", F.round(y, 4).alias("grid_y"), F.round(x, 4).alias("grid_x"))


@query("tan_oversample", STAR + """SELECT id, round((y - field * 128 - 0.5) * 3 + 0.5, 6) AS fine_y, round((x - 0.5) * 3 + 0.5, 6) AS fine_x, round((floor(x) - 0.5) / 3 + 0.5, 6) AS node_x FROM stars""")
def tan_oversample(spark: SparkSession, sf: str) -> DataFrame:
    """Positions on a grid three times finer, and the coarse position of a fine node."""
    fine = lambda c: (c - 0.5) * 3 + 0.5
    return B.stars(spark, sf).select("id", *rounded(fine_y=fine(C("y") - C("field") * B.SIDE), fine_x=fine(C("x")), node_x=(F.floor("x").cast("double") - 0.5) / 3 + 0.5))


@query("morton_sort_keys", STAR + """, a AS (SELECT id, CAST(round_even(y, 0) AS BIGINT) AS ay, CAST(round_even(x, 0) AS BIGINT) AS ax FROM stars)
  SELECT id, ay, ax, CAST(list_sum(list_transform(range(0, 20), lambda b: ((ay >> b) & 1) * (CAST(1 AS BIGINT) << (2 * b)) + ((ax >> b) & 1) * (CAST(1 AS BIGINT) << (2 * b + 1)))) AS BIGINT) AS morton FROM a""")
def morton_sort_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Z-order keys of the rounded positions; ``repartitionByRange(morton)`` keeps neighbours together."""
    a = B.stars(spark, sf).select("id", F.rint("y").cast("long").alias("ay"), F.rint("x").cast("long").alias("ax"))
    return a.withColumn("morton", S.morton(C("ay"), C("ax"))).repartitionByRange("morton").sortWithinPartitions("morton", "id")


@query("catmull_rom_weights", STAR + """, t AS (SELECT id, x - floor(x) AS t FROM stars)
  SELECT id, round((-t + 2*t*t - t*t*t)/2, 6) AS w1, round((2 - 5*t*t + 3*t*t*t)/2, 6) AS w2, round((t + 4*t*t - 3*t*t*t)/2, 6) AS w3, round((-t*t + t*t*t)/2, 6) AS w4 FROM t""")
def catmull_rom(spark: SparkSession, sf: str) -> DataFrame:
    w = S.catmull_rom_weights(C("x") - F.floor("x").cast("double"))
    return B.stars(spark, sf).select("id", *rounded(w1=w[0], w2=w[1], w3=w[2], w4=w[3]))


@query("cubic4", PX + """, f AS (SELECT y, x, v AS f1, lead(v, 1) OVER w AS f2, lead(v, 2) OVER w AS f3, lead(v, 3) OVER w AS f4 FROM px WINDOW w AS (PARTITION BY y ORDER BY x)),
  c AS (SELECT y, x, f2, (f3 - f1) / 2 AS c1, f3 - f2 - (f3 - f1) / 2 AS c4, f4, f1, f3 FROM f WHERE f4 IS NOT NULL),
  k AS (SELECT y, x, f2, c1, 3 * c4 - (f4 - f2) / 2 + c1 AS c2, c4 FROM c)
  SELECT y, x, round(0.3 * (0.3 * (0.3 * (c4 - c2) + c2) + c1) + f2, 6) AS value, round(0.3 * (3 * 0.3 * (c4 - c2) + 2 * c2) + c1, 6) AS deriv FROM k""")
def cubic4(spark: SparkSession, sf: str) -> DataFrame:
    """Cubic convolution at 0.3 between every pixel's second and third neighbour along its row."""
    from pyspark.sql import Window

    w = Window.partitionBy("y").orderBy("x")
    f = B.pixels(spark, sf).select("y", "x", *[F.lead("v", k).over(w).alias(f"f{k + 1}") for k in range(4)]).where("f4 IS NOT NULL")
    value, deriv = S.cubic4(C("f1"), C("f2"), C("f3"), C("f4"), F.lit(0.3))
    return f.select("y", "x", *rounded(value=value, deriv=deriv))


@query("tukey_loss", PX + """, r AS (SELECT y, x, v * 40 AS r FROM px)
  SELECT y, x, round(CASE WHEN abs(r) <= 4.685 THEN 4.685*4.685/6*(1 - pow(1 - (r/4.685)*(r/4.685), 3)) ELSE 4.685*4.685/6 END, 6) AS rho,
  round(CASE WHEN abs(r) <= 4.685 THEN r * pow(1 - (r/4.685)*(r/4.685), 2) ELSE 0.0 END, 6) AS psi,
  round(CASE WHEN abs(r) <= 4.685 THEN (1 - (r/4.685)*(r/4.685)) * (1 - 5*(r/4.685)*(r/4.685)) ELSE 0.0 END, 6) AS psi_prime,
  round(CASE WHEN abs(r) <= 4.685 THEN pow(1 - (r/4.685)*(r/4.685), 2) ELSE 0.0 END, 6) AS weight FROM r""")
def tukey_loss(spark: SparkSession, sf: str) -> DataFrame:
    rho, psi, prime, weight = S.tukey(C("v") * 40)
    return B.pixels(spark, sf).select("y", "x", *rounded(rho=rho, psi=psi, psi_prime=prime, weight=weight))


@query("deconvolve_moments", PX + """, t AS (SELECT y, x, v*v*60 + 0.5 AS a, lead(v*v*60 + 0.4) OVER w AS b, v * lead(v) OVER w * 20 AS c FROM px WINDOW w AS (PARTITION BY y ORDER BY x)),
  q AS (SELECT *, a*b - c*c AS d, 1 - 0.8*(a+b) + 0.64*(a*b - c*c) AS q FROM t WHERE b IS NOT NULL),
  g AS (SELECT *, d > 0 AND q > 0 AND (a - 0.8*d) > 0 AND (b - 0.8*d) > 0 AS ok FROM q)
  SELECT y, x, round(CASE WHEN ok THEN (a - 0.8*d)/q ELSE 'nan'::DOUBLE END, 4) AS yy, round(CASE WHEN ok THEN (b - 0.8*d)/q ELSE 'nan'::DOUBLE END, 4) AS xx, round(CASE WHEN ok THEN c/q ELSE 'nan'::DOUBLE END, 4) AS xy FROM g""")
def deconvolve_moments(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("y").orderBy("x")
    t = B.pixels(spark, sf).select("y", "x", "v", F.lead("v").over(w).alias("n")).where("n IS NOT NULL")
    yy, xx, xy = S.deconvolved(C("v") * C("v") * 60 + 0.5, C("n") * C("n") * 60 + 0.4, C("v") * C("n") * 20, 0.8)
    return t.select("y", "x", *[F.round(c, 4).alias(k) for k, c in (("yy", yy), ("xx", xx), ("xy", xy))])


@query("debiased_ellipticity", PX + """, t AS (SELECT y, x, v AS d1, lead(v) OVER w AS d2 FROM px WINDOW w AS (PARTITION BY y ORDER BY x)),
  p AS (SELECT y, x, d1, d2, d1*d1 - 0.01 AS p1, d2*d2 - 0.02 AS p2 FROM t WHERE d2 IS NOT NULL)
  SELECT y, x, round(p1 + p2, 6) AS square, round(sqrt(greatest(0.0, 2*(0.01*0.01 + 0.02*0.02 + 2*0.003*0.003) + 4*greatest(0.0, greatest(0.0, p1)*0.01 + 2*(d1*d2 - 0.003)*0.003 + greatest(0.0, p2)*0.02))), 6) AS err FROM p""")
def debiased_ellipticity(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("y").orderBy("x")
    t = B.pixels(spark, sf).select("y", "x", C("v").alias("d1"), F.lead("v").over(w).alias("d2")).where("d2 IS NOT NULL")
    square, err = S.debiased_square(C("d1"), C("d2"), F.lit(0.01), F.lit(0.02), F.lit(0.003))
    return t.select("y", "x", *rounded(square=square, err=err))


@query("ellipse_bounds", STAR + """, e AS (SELECT id, 2 + id % 7 AS a, 1 + id % 3 AS b, radians(CAST(id % 180 AS DOUBLE)) AS t FROM stars)
  SELECT id, round(sqrt(pow(a*sin(t), 2) + pow(b*cos(t), 2)), 6) AS half_y, round(sqrt(pow(a*cos(t), 2) + pow(b*sin(t), 2)), 6) AS half_x FROM e""")
def ellipse_bounds(spark: SparkSession, sf: str) -> DataFrame:
    k = C("id")
    y, x = S.ellipse_bounds((2 + k % 7).cast("double"), (1 + k % 3).cast("double"), (k % 180).cast("double"))
    return B.stars(spark, sf).select("id", *rounded(half_y=y, half_x=x))


@query("nnls2_fit", PX + """, s AS (SELECT y, CAST(x AS DOUBLE) / 64 AS u, 1 - CAST(x AS DOUBLE) / 64 AS w, v + 0.02 AS d FROM px),
  n AS (SELECT y, sum(u*u) AS uu, sum(u*w) AS uw, sum(w*w) AS ww, sum(u*d) AS ud, sum(w*d) AS wd, sum(d*d) AS dd FROM s GROUP BY y),
  c AS (SELECT *, (ww*ud - uw*wd) / (uu*ww - uw*uw) AS p, (uu*wd - uw*ud) / (uu*ww - uw*uw) AS q, greatest(0.0, ud/uu) AS p1, greatest(0.0, wd/ww) AS q1 FROM n),
  r AS (SELECT *, dd - 2*p1*ud + p1*p1*uu AS r1, dd - 2*q1*wd + q1*q1*ww AS r2 FROM c),
  b AS (SELECT *, p >= 0 AND q >= 0 AS ok, r2 < least(r1, dd) AS second, r1 < dd AS first FROM r)
  SELECT y, round(CASE WHEN ok THEN p WHEN second THEN 0.0 WHEN first THEN p1 ELSE 0.0 END, 5) AS alpha, round(CASE WHEN ok THEN q WHEN second THEN q1 ELSE 0.0 END, 5) AS beta FROM b""")
def nnls2_fit(spark: SparkSession, sf: str) -> DataFrame:
    """Two non-negative slopes for each row: one grows along the row, one falls."""
    u = C("x").cast("double") / 64
    s = B.pixels(spark, sf).select("y", u.alias("u"), (1 - u).alias("w"), (C("v") + 0.02).alias("d"))
    n = s.groupBy("y").agg(*[F.sum(C(a) * C(b)).alias(a + b) for a, b in ("uu", "uw", "ww", "ud", "wd", "dd")])
    p, q, _ = S.nnls2(*[C(c) for c in ("uu", "uw", "ww", "ud", "wd", "dd")])
    return n.select("y", F.round(p, 5).alias("alpha"), F.round(q, 5).alias("beta"))


@query("effective_fwhm", STAR + """SELECT id, round(sqrt(2 * ln(2) * (5 + id % 40) / pi()), 6) AS fwhm, CAST(greatest(2, floor(0.72 * (1 + id % 12))) AS BIGINT) AS half_width FROM stars""")
def effective_fwhm(spark: SparkSession, sf: str) -> DataFrame:
    """Width of a Gaussian of a given effective area, and the half width of the sharpness window."""
    k = C("id")
    fwhm = F.sqrt(2 * F.log(F.lit(2.0)) * (5 + k % 40) / F.pi())
    return B.stars(spark, sf).select("id", F.round(fwhm, 6).alias("fwhm"), F.greatest(F.lit(2), F.floor(0.72 * (1 + k % 12))).cast("long").alias("half_width"))


DQ = "dq AS (SELECT l_orderkey, l_linenumber, (l_orderkey * 31 + l_linenumber) & 4095 AS dq FROM lineitem)"
#: Some flag names of a data-quality array and their bits.
FLAGS = {"DO_NOT_USE": 0, "SATURATED": 1, "JUMP_DET": 2, "DROPOUT": 3, "GW_AFFECTED_DATA": 4, "PERSISTENCE": 5, "AD_FLOOR": 6, "OUTLIER": 7, "UNRELIABLE_ERROR": 8, "NON_SCIENCE": 9, "DEAD": 10, "HOT": 11}


def flag_mask(names: list[str]) -> int:
    """Bits of the named flags; an unknown name raises an error."""
    unknown = [n for n in names if n not in FLAGS]
    if unknown:
        raise ValueError(f"unknown data-quality flags: {', '.join(unknown)}")
    return sum(1 << FLAGS[n] for n in set(names))


def dq_bits(spark: SparkSession, sf: str) -> DataFrame:
    return B.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (C("l_orderkey") * 31 + C("l_linenumber")).bitwiseAND(4095).alias("dq"))


@query("dq_flag_mask", f"WITH {DQ} SELECT l_orderkey, l_linenumber, (dq & 2053) <> 0 AS bad FROM dq")
def dq_flag_mask(spark: SparkSession, sf: str) -> DataFrame:
    mask = flag_mask(["DO_NOT_USE", "JUMP_DET", "HOT"])
    return dq_bits(spark, sf).select("l_orderkey", "l_linenumber", (C("dq").bitwiseAND(F.lit(mask)) != 0).alias("bad"))


@query("dq_flag_counts", f"WITH {DQ} SELECT b AS bit, count(*) AS n FROM dq, (SELECT unnest(range(0, 12)) AS b) WHERE (dq >> b) & 1 = 1 GROUP BY b")
def dq_flag_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels with each flag, from one pass of conditional counts."""
    counts = dq_bits(spark, sf).agg(*[F.count_if(F.shiftright("dq", b).bitwiseAND(1) == 1).alias(f"b{b}") for b in FLAGS.values()])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(b).cast("long").alias("bit"), C(f"b{b}").alias("n")) for b in FLAGS.values()]))).where("n > 0")


@query("jansky_factor", "SELECT s_suppkey AS id, round((abs(s_acctbal) / 1000 + 0.1) * 1e6 * (2.8e-3 + s_nationkey * 1e-5), 6) AS factor FROM supplier")
def jansky_factor(spark: SparkSession, sf: str) -> DataFrame:
    s = B.read(spark, sf, "supplier")
    return s.select(C("s_suppkey").alias("id"), F.round(S.jansky_factor(F.abs("s_acctbal") / 1000 + 0.1, 2.8e-3 + C("s_nationkey") * 1e-5), 6).alias("factor"))
