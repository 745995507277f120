"""Promotion of suggested bands, and the band where nothing is found."""

import pytest

from motionlake.operators import suggestion as U

BAND = "series_key string, low_hz double, high_hz double, peak_hz double, confidence double"
PICKED = "series_key string, freq_hz double, ubiquity double, edge double, support double, sharpness double"
SCORED = "series_key string, low_hz double, high_hz double, score double"


def run(spark, picked, scores, confidence=0.4):
    out = U.promoted(spark.createDataFrame([("a", 0.3, 0.6, 0.4, confidence)], BAND), spark.createDataFrame([("a", *picked)], PICKED), spark.createDataFrame([("a", *s) for s in scores], SCORED))
    (row,) = out.collect()
    return tuple(row)[1:]


KEPT = (0.3, 0.6, 0.4, 0.4, False)
SLOW = (0.4, 0.2, 0.0, 0.0, 1.0)


@pytest.mark.parametrize("picked,doubtful", [
    (SLOW, True), ((0.85, 0.2, 0.9, 0.9, 0.0), False), ((0.4, 0.11, 0.54, 0.59, 0.0), False), ((0.4, 0.12, 0.0, 0.0, 1.0), True), ((0.4, 0.0, 0.55, 0.0, 1.0), True), ((0.4, 0.0, 0.0, 0.60, 0.17), True), ((0.4, 0.0, 0.0, 0.60, 0.18), False),
])
def test_only_doubtful_ones_are_promoted(spark, picked, doubtful):
    got = run(spark, picked, [(0.3, 0.6, 0.30), (1.0, 5.0, 0.50)])
    assert got == (pytest.approx((1.0, 5.0, 3.0, 0.72, True)) if doubtful else KEPT)


def test_a_faster_band_must_win_clearly(spark):
    assert run(spark, SLOW, [(0.3, 0.6, 0.50), (1.0, 5.0, 0.539)]) == KEPT
    assert run(spark, SLOW, [(0.3, 0.6, 0.50), (1.0, 5.0, 0.541)])[-1]
    assert run(spark, SLOW, [(0.3, 0.6, 0.10), (1.0, 5.0, 0.119)]) == KEPT  # eight per cent more, but no 0.02
    assert run(spark, SLOW, [(0.3, 0.6, 0.1), (0.5, 1.5, 0.9)]) == KEPT  # not fast
    assert run(spark, SLOW, []) == KEPT
    assert run(spark, SLOW, [(1.0, 5.0, 0.02)])[-1]  # the suggested band has no score
    assert run(spark, SLOW, [(1.0, 5.0, 0.9)], confidence=0.9)[3] == 1.0


def test_ties_reach_higher_then_lower(spark):
    assert run(spark, SLOW, [(1.0, 5.0, 0.5), (1.5, 5.0, 0.5), (1.0, 4.0, 0.5)])[:2] == (1.0, 5.0)


def test_bands_tried_are_held_and_distinct(spark):
    rows = U.tried(spark.createDataFrame([("a", 0.5, 1.5, 1.0, 0.0), ("b", 0.1, 0.3, 0.2, 0.0)], BAND), 0.25, 2.0).collect()
    got = {k: {(r.low_hz, r.high_hz) for r in rows if r.series_key == k} for k in "ab"}
    fixed = {(0.5, 1.5), (0.75, 2.0), (1.0, 2.0), (1.5, 2.0)}
    assert {tuple(round(x, 6) for x in t) for t in got["a"]} == fixed
    # 0.25 to 0.3 is too narrow, so "b" has the fixed ones only
    assert {tuple(round(x, 6) for x in t) for t in got["b"]} == fixed and len(rows) == 8


def test_a_series_without_candidates_falls_back(spark):
    keys = spark.createDataFrame([("a",), ("b",), ("b",)], "series_key string")
    known = spark.createDataFrame([("a", 1.0, 5.0, 3.0, 0.5, True)], BAND + ", promoted boolean")
    got = {r.series_key: tuple(r)[1:] for r in U.or_fallback(keys, known, 4.0, 16.0).collect()}
    assert got["a"] == (1.0, 5.0, 3.0, 0.5, True) and got["b"] == pytest.approx((0.5, 1.25, 0.5, 0.0, False))
