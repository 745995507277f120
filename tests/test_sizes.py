"""Literal cases of sizes and layouts."""

import numpy as np
from pyspark.sql import functions as F

from motionlake.functions import sizes as S


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_zones_in_another_frame(spark):
    zones = spark.createDataFrame([("rectangle", 10.0, 20.0, 30.0, None, 9.0), ("circle", 10.0, 20.0, 30.0, 40.0, 8.0), ("circle", 0.0, 0.0, None, None, None)], "s string, x double, y double, w double, h double, r double")
    got = zones.select(S.scaled_zone(*map(F.col, "sxywhr"), F.lit(2.0), F.lit(0.5)).alias("z")).select("z.*").collect()
    assert [tuple(r) for r in got] == [(20.0, 10.0, 60.0, 0.0, None), (20.0, 10.0, None, None, 10.0), (0.0, 0.0, None, None, 0.0)]


def test_presets_keep_proportions_and_come_once(spark):
    fit = lambda w, h, presets: [tuple(r) for r in one(spark, S.fitted(F.lit(w), F.lit(h), presets).alias("f")).f]
    assert fit(800, 600, [(1920, 1080), (1280, 720), (400, 400), (1, 1)]) == [(800, 600), (400, 300), (1, 1)]
    assert fit(1000, 1, [(10, 10)]) == [(10, 1)]
    # halves go to the even side
    assert fit(5, 3, [(2, 2), (5, 2)]) == [(2, 1), (3, 2)]


def test_encoder_sizes_are_even_and_no_larger(spark):
    size = lambda *v: one(spark, S.encoder_size(*map(F.lit, v)).alias("s")).s
    assert tuple(size(721, 405, 640, 999)) == (640, 404)
    assert tuple(size(1, 3, 9, 9)) == (1, 2)
    assert size(0, 8, 9, 9) is None and size(8, 8, 9, -1) is None


def test_layouts_equal_numpy(spark):
    sizes = [(405, 720), (720, 405), (1920, 1080), (64, 48), (10, 300), (13, 13), (331, 777)]
    rows, columns, tile = S.layout(F.col("w"), F.col("h"))
    told = spark.createDataFrame(sizes, "w int, h int").select("w", "h", rows.alias("r"), columns.alias("c"), tile.alias("t"))
    got = told.select("*", S.even_starts(F.col("h"), F.col("t"), F.col("r")).alias("down"), S.even_starts(F.col("w"), F.col("t"), F.col("c")).alias("across")).collect()
    for g in got:
        assert (g.r, g.c) == (min(max(round(g.h / 60), 6), 16), min(max(round(g.w / 60), 6), 10)) and g.t % 2 == 0
        for length, count, starts in ((g.h, g.r, g.down), (g.w, g.c, g.across)):
            want = sorted({int(round(float(v))) for v in np.linspace(0, length - g.t, count)}) if g.t < length else [0]
            assert starts == want
    assert {(g.w, g.h): g.t for g in got}[405, 720] == 84
