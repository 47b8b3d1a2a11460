"""Neighbourhood statistics in one pass, and several values in one resampling, against the operators for one at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from heatgrid.operators import spatial
from heatgrid.operators.support import local_table


@pytest.fixture(scope="module")
def cells(spark):
    """A grid over several tiles with gaps, missing values, negative places and a lone cell far away."""
    rng = np.random.default_rng(5)
    rows, n = [], 0
    for r in range(-9, 20):
        for c in range(-5, 23):
            if rng.random() < 0.85:
                rows.append((n, r, c, None if rng.random() < 0.05 else float(rng.integers(0, 40)), float(rng.random()), "x"))
                n += 1
    rows.append((n, 400, 400, 1.0, 0.5, "x"))
    return local_table(spark, rows, "PixelID BIGINT, row INT, col INT, Elevation DOUBLE, NDVI DOUBLE, _id STRING").repartition(4)


@pytest.mark.parametrize("tile,reach", [(8, 6), (512, 30)])
def test_one_pass_gives_what_single_operators_give(cells, tile, reach):
    green = (F.col("NDVI") > 0.3).cast("double")
    masks = {"Dist_A": F.col("NDVI") > 0.9, "Dist_B": F.col("Elevation") > 100.0}
    got = spatial.neighbourhood(cells.drop("_id"), elevation="Elevation", focal=[spatial.Focal(green, 3, mean="g"), spatial.Focal(F.col("Elevation"), 5, mean="m", std="s")], distances=masks,
                                max_cells=reach, tile=tile)
    want = spatial.terrain(cells, tile=tile)
    want = spatial.focal_stats(want.withColumn("_g", green), "_g", 3, mean="g", tile=16)
    want = spatial.focal_stats(want, "Elevation", 5, mean="m", std="s", tile=16)
    for name, mask in masks.items():
        want = spatial.distance_to(want, mask, name, max_cells=reach, tile=tile)
    names = ["Slope", "Aspect", "g", "m", "s", *masks]
    a = {r["PixelID"]: [r[n] for n in names] for r in got.collect()}
    b = {r["PixelID"]: [r[n] for n in names] for r in want.collect()}
    assert a.keys() == b.keys()
    for k in a:
        for name, x, y in zip(names, a[k], b[k]):
            assert (x is None) == (y is None) and (x is None or x == pytest.approx(y, abs=1e-6)), (k, name, x, y)


def test_one_pass_has_one_exchange_of_the_cells(cells):
    plan = spatial.neighbourhood(cells, elevation="Elevation", focal=[spatial.Focal(F.col("NDVI"), mean="m")], distances={"d": F.col("NDVI") > 0.5})
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning(_tr") == 1 and text.count("FlatMapGroupsInPandas") == 1


def test_empty_table_has_no_neighbourhoods(cells):
    assert spatial.neighbourhood(cells.limit(0), elevation="Elevation", distances={"d": F.col("NDVI") > 0.5}).count() == 0


def test_several_values_are_resampled_in_one_join(spark, cells):
    coarse = local_table(spark, [(r, c, None if (r + c) % 5 == 0 else float(r * 10 + c), float(r - c)) for r in range(-3, 6) for c in range(-2, 7) if (r * c) % 7],
                         "row INT, col INT, a DOUBLE, b DOUBLE")
    both = spatial.resample_bilinear(cells, coarse, ["a", "b"], 4.0)
    one = spatial.resample_bilinear(spatial.resample_bilinear(cells, coarse.select("row", "col", "a"), "a", 4.0), coarse.select("row", "col", "b"), "b", 4.0)
    assert sorted(map(repr, both.select("PixelID", "a", "b").collect())) == sorted(map(repr, one.select("PixelID", "a", "b").collect()))
    assert both._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
