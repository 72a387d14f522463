"""Joins of rows that a generator makes: sorted and merged, not broadcast, however small the planner takes them for."""

import os

import pytest
from pyspark.sql import functions as F

from starfold import catalog
from starfold.operators import covariance as V
from starfold.operators import measure as M
from starfold.operators import normal as N
from starfold.plans import fit_queries, joint_fit
from starfold.plans.covariance_queries import left_over
from starfold.sources import bindings as B

SF = "/root/testdata/sf0.001"
NAMED = """aperture_center aperture_exact aperture_subpixel aperture_whole blend_gate covariance_valid curve_of_growth curve_of_growth_error encircled_energy sharpness
 star_diagnostics star_first_guess star_shapes top_coupled_neighbours fit_fixed_shape normal_blocks normal_gradient normalize_cog overlap_pairs_capped pairs_within
 radius_at_energy render_scene stamp_geometry_counts cross_pairs nearest_within wing_gate merge_tiles_dedup residual_cost""".split()


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", NAMED)
def test_nothing_is_broadcast(spark, name):
    assert "Broadcast" not in plan(catalog.QUERIES[name](spark, SF))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_derivatives_written_for_normal_equations_merge_stamps(spark):
    assert "Broadcast" not in plan(N.derivatives(B.references(spark, SF), left_over(spark, SF), 3.0, 5))  # normal_gradient's plan only reads what this wrote


def test_step_with_covariance_merges_stamps(spark):
    sources = spark.createDataFrame([(1, 5.0, 5.0, 10.0, 0.1, 0.1, 2.0)], "id long, y double, x double, flux double, a double, b double, ell double")
    image = spark.range(81).select((F.expr("id div 9") + 1).alias("y"), (F.col("id") % 9 + 1).alias("x"), F.lit(0.5).alias("v"), F.lit(100.0).alias("iv"))
    assert "Broadcast" not in plan(V.correlated_steps(sources, image, 3.0, 3))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_joint_fit_broadcasts_images_not_pixels(spark):
    images, pixels = fit_queries.shifted_images(spark, SF)
    text = plan(joint_fit.fit_joint(B.references(spark, SF), images, pixels))
    assert text.count("BroadcastHashJoin") == 1 and "BuildRight" in text  # the right side is the table of images


def test_stamps_of_a_small_table_are_several_tasks(spark):
    one = spark.createDataFrame([(i, float(i), 1.0) for i in range(100)], "id long, y double, x double").coalesce(1)
    parts = M.stamps(one, 2).select("id", F.spark_partition_id().alias("p"))
    assert parts.agg(F.count("*"), F.count_distinct("p")).first() == (2500, int(spark.conf.get("spark.sql.shuffle.partitions")))
