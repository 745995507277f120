"""Literal values, odd inputs and plain NumPy for the core operators."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionlake import functions as X
from motionlake.operators import bands as B
from motionlake.operators import clips as C
from motionlake.operators import frames as K
from motionlake.operators import grid as G
from motionlake.operators import quality as Q
from motionlake.operators import rules as R
from motionlake.operators import series as S
from motionlake.operators import suggestion as U


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_parsers(spark):
    texts = ["30000/1001", "16:9", "N/A", None, "", "5", "1/0", "a/b", "0:1"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.parse_fraction(F.col("t")).alias("f"), X.parse_ratio(F.col("t")).alias("r"), X.parse_int(F.col("t")).alias("n")).orderBy("i").collect()
    assert [r.f for r in rows] == pytest.approx([30000 / 1001, 16 / 9, 0, 0, 0, 5, 0, 0, 0])
    assert [r.r for r in rows] == pytest.approx([30000 / 1001, 16 / 9, 1, 1, 1, 5, 1, 1, 1])
    assert [r.n for r in rows] == [0, 0, 0, 0, 0, 5, 0, 0, 0]
    side = F.lit('{"side_data_list": [{"side_data_type": "x"}, {"side_data_type": "Display Matrix", "rotation": -90}], "tags": {"rotate": "180"}}')
    assert tuple(one(spark, X.rotation(side), X.rotation(F.lit('{"tags": {"rotate": "180"}}')), X.rotation(F.lit("{}")))) == (-90.0, 180.0, None)


def test_scalars(spark):
    got = one(spark, X.band_edge(F.lit(0.125)), X.centre_weight(F.lit(0.5), F.lit(0.5)), X.centre_weight(F.lit(0.0), F.lit(0.0)), X.square_width(F.lit(720), F.lit(1.0667)), X.confidence_label(F.lit(0.6)), X.parabolic(F.lit(1.0), F.lit(2.0), F.lit(1.5)), X.wrapped(F.lit(5.0), 8), X.wrapped(F.lit(4.0), 8))
    assert got[0] == pytest.approx(0.1) and got[1] == 1.0 and got[2] == pytest.approx(0.2) and got[3] == 768 and got[4] == "Moderate" and got[5] == pytest.approx(1 / 6) and (got[6], got[7]) == (-3.0, 4.0)
    none = F.lit(None)
    active, may = X.drift_gate(none.cast("boolean"), F.lit(2.0), none.cast("boolean"))
    assert tuple(one(spark, active, may)) == (True, False)


def test_zone_faults(spark):
    null = F.lit(None).cast("double")
    code = lambda shape, x, y, w, h, r: X.zone_fault(F.lit(shape), *[null if v is None else F.lit(float(v)) for v in (x, y, w, h, r)], F.lit(100), F.lit(50))
    got = one(spark, code("rectangle", -1, 0, 1, 1, None), code("rectangle", 0, 0, None, 1, None), code("rectangle", 0, 0, 0, 1, None), code("rectangle", 60, 0, 41, 1, None), code("circle", 10, 10, None, None, None), code("circle", 10, 10, None, None, 0), code("circle", 10, 10, None, None, 11), code("circle", 10, 10, None, None, 10))
    assert list(got) == ["negative_origin", "rectangle_dimensions_missing", "rectangle_dimensions_invalid", "rectangle_out_of_bounds", "circle_radius_missing", "circle_radius_invalid", "circle_out_of_bounds", None]


def test_bands_collapse_and_merge(spark):
    low, high = B.clamp(F.lit(5.0), F.lit(0.5), F.lit(9.0), 1.0, 4.0)
    assert tuple(one(spark, low, high)) == (4.0, 4.0)
    rows = [("a", 1.0, 2.0, 1.5, []), ("a", 2.05, 2.5, 2.2, []), ("a", 2.6, 3.0, 2.8, [1.5]), ("a", 3.05, 3.4, 3.2, [])]
    got = B.merged(spark.createDataFrame(rows, "series_key string, low_hz double, high_hz double, peak_hz double, cuts array<double>")).orderBy("band").collect()
    assert [(r.low_hz, r.high_hz, r.peak_hz) for r in got] == [(1.0, 2.5, 1.5), (2.6, 3.4, 2.8)]


def test_grids_with_holes_and_borders(spark):
    cells = [("g", r, c, float(r * r + c)) for r in range(3) for c in range(3)]
    df = spark.createDataFrame(cells, "grid_id string, row int, col int, value double")
    got = {(r.row, r.col): r.magnitude for r in G.gradient(df).collect()}
    assert got[1, 1] == pytest.approx(np.hypot(4, 2)) and got[0, 0] == 0 and got[0, 1] == 2 and got[1, 0] == 4
    holed = df.withColumn("value", F.when((F.col("row") == 1) & (F.col("col") == 1), float("nan")).otherwise(F.col("value")))
    near = {(r.row, r.col): r.support for r in G.local_mean(holed).collect()}
    assert near[1, 1] == 0 and near[0, 0] == pytest.approx((0 + 1 + 1) / 3)
    assert G.gradient(df.where("false")).count() == 0 and G.local_mean(df.where("false")).count() == 0


def test_short_and_flat_series_are_left_out(spark):
    rows = [("short", n, float(n % 3)) for n in range(31)] + [("flat", n, 0.0) for n in range(64)] + [("fine", n, float(n % 5)) for n in range(32)]
    got = S.smooth5(spark.createDataFrame(rows, "series_key string, n int, x double"))
    assert {r.series_key for r in got.collect()} == {"fine"}


def test_spectra_match_numpy(spark):
    rng = np.random.default_rng(1)
    xs = rng.normal(size=(5, 64))
    rows = S.spectrum(spark.createDataFrame([(str(i), x.tolist()) for i, x in enumerate(xs)], "series_key string, xs array<double>"), 64, 16.0).collect()
    for r in rows:
        x = xs[int(r.series_key)]
        assert r.amp == pytest.approx(np.abs(np.fft.rfft(x - x.mean()))[r.k] / 64, abs=1e-12)


def test_tiles():
    assert K.starts(16, 8, 4) == [0, 4, 8] and K.starts(17, 8, 4) == [0, 4, 8, 9] and K.starts(5, 8, 4) == [0]
    assert K.render_tile(360, 640, 1.0) == (60, 30) and K.render_tile(10, 10, 1.0) == (10, 5) and K.render_tile(360, 640, 0.1) == (46, 23)


def test_rolled_tiles_shift_back(spark):
    """Content moved by (1, 2) is brought back by -(1, 2)."""
    y, x = np.mgrid[:32, :32]
    still = sum(np.exp(-((x - a) ** 2 + (y - b) ** 2) / 6) for a, b in ((14, 15), (18, 12), (11, 19), (19, 20)))
    pairs = spark.createDataFrame([(1, still.ravel().tolist(), np.roll(still, (1, 2), (0, 1)).ravel().tolist())], "id int, first array<double>, second array<double>")
    dx, dy, _ = K.peak(F.col("surface"), 32)
    got = K.correlate(pairs, ["id"], 32).select(dx.alias("dx"), dy.alias("dy")).first()
    assert round(got.dx) == -2 and round(got.dy) == -1


def test_moving_texture_is_followed_and_amplified(spark):
    """A texture that swings along x by 1.75 pixels: motion has its sign, and the amplified one swings wider."""
    n, side = 8, 32
    y, x = np.mgrid[:side, :side]
    rows = []
    for f in range(n):
        at = side / 2 + 1.75 * np.sin(2 * np.pi * f / 8)
        spot = sum(np.exp(-((x - at - a) ** 2 + (y - b) ** 2) / 3) for a, b in ((-3, 13), (2, 12), (4, 17), (-2, 18), (0, 15), (-5, 16), (5, 20), (-4, 20)))
        spot = spot / 2
        rows += [("c", f, int(r), int(c), float(spot[r, c])) for r in range(side) for c in range(side)]
    df = spark.createDataFrame(rows, "clip string, frame int, row int, col int, value double")
    whole = C.packed(df, "clip", "frame")
    moves = C.motion(whole, C.reference(whole, side * side), side, side, 16, 8).where("ty = 8 and tx = 8").orderBy("frame").collect()
    assert moves[2].dx < -0.05 < 0.05 < moves[6].dx and abs(moves[2].dy) < 0.1
    out = C.cells(C.amplified(whole, side, side, 16, 8, C.iir(0.9, 0.05), 2.0), side, "clip", "frame")

    def centre(rows_):
        m = np.zeros((n, side, side))
        for r in rows_:
            m[r.frame, r.row, r.col] = r.value
        return (m * x).sum((1, 2)) / m.sum((1, 2))

    before, after = centre(df.collect()), centre(out.collect())
    assert np.ptp(after) > np.ptp(before)
    assert C.amplified(whole, side, side, 16, 8, C.iir(0.9, 0.05), 0.0) is whole


def test_purge_keeps_preserved_rows(spark):
    rows = [("o", i, 10.0, i == 0) for i in range(5)]
    got = R.purge(spark.createDataFrame(rows, "owner string, i int, size double, keep boolean"), "owner", [F.col("i")], "size", 25.0, F.col("keep"))
    assert sorted(r.i for r in got.collect()) == [1, 2, 3]


def test_slow_winner_gives_way_to_a_sharper_fast_one(spark):
    kind = "series_key string, k int, freq_hz double, amp double, median double, prominence double, support double, sharpness double, period double, bonus double, ubiquity double, edge double, score double"
    slow = ("a", 1, 0.3, 1.0, 0.1, 0.5, 0.9, 0.10, 0.2, 0.0, 1.0, 0.6, 0.80)
    fast = ("a", 5, 1.2, 0.9, 0.1, 0.5, 0.6, 0.40, 0.6, 0.0, 0.0, 0.2, 0.78)
    far = ("a", 9, 2.4, 0.9, 0.1, 0.5, 0.6, 0.40, 0.6, 0.0, 0.0, 0.2, 0.70)
    assert [r.k for r in U.chosen(spark.createDataFrame([slow, fast, far], kind)).collect()] == [5]
    assert [r.k for r in U.chosen(spark.createDataFrame([slow, far], kind)).collect()] == [1]


@pytest.mark.parametrize("name", ["band_resolution", "band_suggestion"])
def test_queries_without_sql_run(spark, name):
    from motionlake.plans import QUERIES

    rows = QUERIES[name](spark, "/root/testdata/sf0.001").collect()
    assert rows and all(r.low_hz <= r.high_hz for r in rows)


def test_every_reason_of_cells_and_heatmaps_occurs(spark):
    from motionlake.plans import QUERIES

    data = "/root/testdata/sf0.01"
    assert {r.reason for r in QUERIES["heatmap_reasons"](spark, data).select("reason").distinct().collect()} == {"valid", "outside_roi", "masked_out", "low_confidence", "weak_signal"}
    fails = {reason for r in QUERIES["roi_cell_records"](spark, data).collect() for reason in r.reasons.split(";")}
    assert fails >= {"", "no_weighted_signal", "insufficient_texture", "masked_out", "no_usable_motion_signal"}
    scores = QUERIES["roi_quality"](spark, data).collect()
    assert {r.warnings for r in scores} == {"", "quality_below_reporting"} and all(r.rejected_cells for r in scores)
    poor = {r.roi for r in scores if r.warnings}
    assert not poor & {r.series_key for r in QUERIES["supported_peaks"](spark, data).collect()}


def test_reported_peaks_raise_the_final_score(spark):
    cells = [("a", "p", 0.5, 0.5, 0.5, 0.5, 0.5, 0.5, 0.5, True), ("a", "q", 0.5, 0.5, 0.5, 0.5, 0.5, 0.5, 0.5, False), ("b", "p", 0.1, 0.1, 0.1, 0.1, 0.1, 0.1, 0.1, False)]
    records = spark.createDataFrame(cells, "roi string, parent string, texture double, stability double, agreement double, relevance double, mask double, drift double, composite double, valid boolean")
    agreement = spark.createDataFrame([("a", 0.5), ("b", 0.0)], "roi string, agreement double")
    peaks = spark.createDataFrame([("a", 0.8)], "roi string, consistency double")
    first = {r.roi: r for r in Q.roi_quality(records, agreement).collect()}
    final = {r.roi: r for r in Q.roi_quality(records, agreement, peaks).collect()}
    assert first["a"].overall == pytest.approx(0.415) and final["a"].overall == pytest.approx(0.415 + 0.17 * 0.8)
    assert (first["a"].warnings, final["a"].warnings, final["a"].label) == ("quality_below_reporting", "", "Low")
    assert final["b"].overall == first["b"].overall == pytest.approx(0.043) and (final["b"].label, final["b"].valid_cells, final["b"].rejected_cells) == ("Poor", 0, 1)


def test_strength_of_constant_series_is_nothing(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 3.0), ("b", 1.0, -2.0), ("b", 2.0, -4.0)], "k string, x double, y double")
    assert {r.k: r.s for r in df.groupBy("k").agg(X.strength("x", "y").alias("s")).collect()} == pytest.approx({"a": 0.0, "b": 1.0})
