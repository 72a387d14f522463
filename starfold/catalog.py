"""The queries outside the text operators; importing the modules registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import measure
from .plans import coadd_queries, covariance_queries, fit_queries, image_queries, joint_queries, layout_queries, measure_queries, multipass, psf_queries, robust_queries, scalar_queries, scene_queries, shape_queries, spatial_queries, stream_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
from .shared import materialize


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources found in the rendered field (mesh background, matched filter, local maxima) with their shapes."""
    image = multipass.level(measure_queries.scene(spark, sf_dir).select("y", "x", "v"), 32)
    o = multipass.Options()
    found = multipass.number(materialize(multipass.detect(image, o).withColumn("id", F.lit(0).cast("long")), "peaks"), 0)
    shapes = measure.shapes(measure.moments(found, image, 4, 0.0))
    return found.join(shapes.select("id", "y_fwhm", "x_fwhm", "ellipticity1", "ellipticity2"), "id").select("id", "y", "x", "flux", "rank", "y_fwhm", "x_fwhm", "ellipticity1", "ellipticity2")
