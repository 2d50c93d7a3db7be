"""Tiles give what pixel tables give, whatever the tile's size, and send aggregates only."""

import random

import pytest
from pyspark.sql import functions as F

from scriptorium.operators import imaging, rasters


@pytest.fixture(scope="module")
def images(spark):
    """Lines of three images: one of random tones, one blank, one partly known with a dark spine."""
    rng = random.Random(3)
    lines = []
    for y in range(150):
        lines.append(("a", y, list(range(130)), [rng.choice([0, 30, 90, 160, 200, 255]) if 60 < y < 90 else 255 for _ in range(130)]))
        lines.append(("b", y, list(range(90)), [255] * 90))
        xs = sorted(rng.sample(range(170), 100))
        lines.append(("c", y, xs, [20 if x in (12, 13) else rng.randint(100, 250) for x in xs]))
    lines.append(("d", 0, [5], [7]))
    return spark.createDataFrame(lines, "doc string, y int, xs array<int>, vs array<int>").repartition(3)


@pytest.fixture(scope="module")
def table(images):
    each = images.select("doc", "y", F.explode(F.arrays_zip("xs", "vs")).alias("p"))
    return each.select("doc", "y", F.col("p.xs").alias("x"), F.col("p.vs").alias("v"))


@pytest.mark.parametrize("size", [(64, 256), (7, 11)])
def test_tiles_are_the_pixels(images, table, size):
    rows = lambda frame: sorted(tuple(r) for r in frame.collect())
    tiles = rasters.tiled(images, ["doc"], *size).cache()
    keys = ["doc"]
    assert rows(rasters.pixels(tiles, keys)) == rows(table.select("doc", "y", "x", "v"))
    assert rows(rasters.pixels(rasters.filtered(tiles, keys), keys)) == rows(imaging.filter_image(table, keys).select("doc", "y", "x", "v"))
    assert rows(rasters.pixels(rasters.binarised(tiles, keys), keys)) == rows(imaging.binarised(table, keys).select("doc", "y", "x", "v"))
    assert rows(rasters.crop_bounds(rasters.binarised(tiles, keys), keys)) == rows(imaging.crop_bounds(imaging.binarised(table, keys), keys))
    assert rows(rasters.line_means(tiles, keys)) == rows(imaging.row_means(table, keys))
    assert rows(rasters.spine(tiles, keys)) == rows(imaging.spine(table, keys))
    box = images.select("doc").distinct().select("doc", F.lit(4).alias("ux"), F.lit(-3).alias("uy"), F.lit(30).alias("lx"), F.lit(70).alias("ly"))
    bit = F.col("doc") == "a"
    assert rows(rasters.pixels(rasters.processed(tiles, box, keys, bit), keys)) == rows(imaging.processed_images(table, box, keys, bit).select("doc", "y", "x", "v"))
    assert rows(rasters.histograms(tiles, keys)) == rows(table.groupBy("doc", "v").count())
    tiles.unpersist()


def test_only_aggregates_cross_shuffles(spark, images):
    tiles = rasters.tiled(images, ["doc"])
    plan = rasters.filtered(tiles.checkpoint(), ["doc"])._jdf.queryExecution().executedPlan().toString()
    exchanged = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert exchanged and all("data" not in line for line in exchanged)
    assert plan.count("FlatMapGroupsInArrow") == 0
