"""Whole frames: packed bytes, resize plans, warps, motion, the amplifier and its stream, against plain NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from motionlake import streaming as T
from motionlake.functions import centre_weight
from motionlake.operators import clips as C
from motionlake.operators import series as S
from motionlake.plans import QUERIES

FPS, BAND = 12.0, (1.0, 3.0)


def table(spark, clip, *arrays):
    """Frames (n, height, width or with colours) of clips, one row each."""
    rows = [(name, i, np.asarray(f, float).ravel().tolist()) for name, frames in zip([clip, "other"], arrays) for i, f in enumerate(frames)]
    return spark.createDataFrame(rows, "clip string, frame int, pixels array<double>")


def collected(df, clip, shape):
    return np.array([np.array(r.pixels).reshape(shape) for r in df.where(F.col("clip") == clip).orderBy("frame").collect()])


def blob(n=24, side=48, swing=1.0):
    """A spot that swings along x once in six frames."""
    y, x = np.mgrid[:side, :side]
    return np.array([np.exp(-((x - side / 2 - swing * np.sin(2 * np.pi * i / 6)) ** 2 + (y - side / 2) ** 2) / 32) for i in range(n)])


def swing_of(frames):
    x = np.arange(frames.shape[2])
    return np.ptp((frames * x).sum((1, 2)) / frames.sum((1, 2)))


def test_packed_frames_drop_what_is_left(spark):
    rows = [("a", bytes(range(24))), ("b", bytes(range(23))), ("c", None), ("d", b""), ("e", bytes([255]) * 30)]
    got = C.decoded(spark.createDataFrame(rows, "id string, content binary"), ["id"], "content", 2, 2)
    by = {(r.id, r.frame): r.pixels for r in got.collect()}
    assert sorted(by) == [("a", 0), ("a", 1), ("b", 0), ("e", 0), ("e", 1)]
    assert by["a", 1] == pytest.approx([x / 255 for x in range(12, 24)]) and by["e", 0] == [1.0] * 12
    back = C.encoded(got, ["id", "frame"], 12)
    assert {(r.id, r.frame): bytes(r.content) for r in back.collect()}["a", 1] == bytes(range(12, 24))
    odd = spark.createDataFrame([("x", 0, [-1.0, 2.0, 0.5 / 255, 1.5 / 255])], "id string, frame int, pixels array<double>")
    assert bytes(C.encoded(odd, ["id"], 4).first().content) == bytes([0, 255, 0, 2])


def test_luma_of_colours(spark):
    df = table(spark, "a", np.array([[[[1.0, 0, 0], [0, 1, 0], [0, 0, 1], [1, 1, 1]]]]))
    assert C.luma(df, ["clip", "frame"], 1, 4).first().pixels == pytest.approx([0.2126, 0.7152, 0.0722, 1.0])


def test_a_plan_is_reused_and_knows_its_shape():
    field = np.arange(16.0).reshape(4, 4)
    plan = C.resize_plan((4, 4), (9, 7))
    ys, xs = np.linspace(0, 3, 9), np.linspace(0, 3, 7)
    want = ys[:, None] * 4 + xs[None, :]
    assert plan is C.resize_plan((4, 4), (9, 7))
    assert np.allclose(plan(field), want) and np.allclose(plan(np.stack([field, 2 * field])), [want, 2 * want])
    assert C.resize_plan((4, 4), (4, 4))(field) is field
    one = C.resize_plan((1, 3), (5, 5))(np.array([[0.0, 1.0, 2.0]]))
    assert np.allclose(one, np.linspace(0, 2, 5))
    with pytest.raises(ValueError):
        plan(np.zeros((3, 4)))


def test_warp_is_a_gather_between_four_cells():
    rng = np.random.default_rng(1)
    pixels, dx, dy = rng.random((2, 12, 10, 3)), rng.normal(0, 3, (2, 3, 4)), rng.normal(0, 3, (2, 3, 4))
    got = C.warp_pixels(pixels, dx, dy, 2.0)
    plan = C.resize_plan((3, 4), (12, 10))
    for n in range(2):
        fx, fy = np.clip(plan(dx[n]), -2, 2), np.clip(plan(dy[n]), -2, 2)
        for r in range(12):
            for c in range(10):
                x, y = min(max(c + fx[r, c], 0), 10 - 1.001), min(max(r + fy[r, c], 0), 12 - 1.001)
                a, b = int(y), int(x)
                v, u = y - a, x - b
                want = (pixels[n, a, b] * (1 - u) + pixels[n, a, b + 1] * u) * (1 - v) + (pixels[n, a + 1, b] * (1 - u) + pixels[n, a + 1, b + 1] * u) * v
                assert np.allclose(got[n, r, c], want)


def test_reference_is_the_mean_of_each_clip(spark):
    rng = np.random.default_rng(2)
    a, b = rng.random((7, 4, 6)), rng.random((3, 4, 6))
    got = {r.clip: np.array(r.pixels) for r in C.reference(table(spark, "a", a, b).repartition(3), 24).collect()}
    assert np.allclose(got["a"], a.mean(0).ravel()) and np.allclose(got["other"], b.mean(0).ravel())


@pytest.mark.parametrize("band", ["fft", "iir"])
def test_amplifier_keeps_still_clips_and_widens_motion(spark, band):
    still = np.zeros((12, 48, 48))
    still[:, 8:16, 8:16] = 0.8
    moving = blob()
    gains = S.low_pass_gain(FPS, BAND[1]), S.low_pass_gain(FPS, BAND[0])
    passed = C.fft(FPS, *BAND) if band == "fft" else C.iir(*gains)
    out = C.amplified(table(spark, "moving", moving, still), 48, 48, 16, 8, passed, 4.0)
    assert np.allclose(collected(out, "other", (48, 48)), still, atol=2e-2)
    after = collected(out, "moving", (48, 48))
    assert after.min() >= 0 and after.max() <= 1 and swing_of(after) > (1.2 if band == "fft" else 1.1) * swing_of(moving)
    df = table(spark, "moving", moving)
    assert C.amplified(df, 48, 48, 16, 8, passed, 0.0) is df


def test_amplifier_of_colours_is_that_of_luma(spark):
    grey = blob(12)
    out = C.amplified(table(spark, "c", grey), 48, 48, 16, 8, C.fft(FPS, *BAND), 4.0)
    rgb = C.amplified(table(spark, "c", np.repeat(grey[..., None], 3, axis=3)), 48, 48, 16, 8, C.fft(FPS, *BAND), 4.0, colours=3)
    assert np.allclose(collected(rgb, "c", (48, 48, 3)), collected(out, "c", (48, 48))[..., None], atol=1e-6)


def test_other_motion_is_added_unless_attenuated(spark):
    moving = blob(24)
    outside = C.fft(FPS, 4.0, 5.0)
    df = table(spark, "m", moving)
    swings = [swing_of(collected(C.amplified(df, 48, 48, 16, 8, outside, 4.0, attenuate), "m", (48, 48))) for attenuate in (True, False)]
    assert swings[1] > swings[0]


@pytest.mark.parametrize("chunks", [1, 3, 7])
def test_stream_equals_batch_however_it_is_cut(spark, chunks):
    rows = table(spark, "a", blob(20), blob(9, swing=2.0))
    gains = S.low_pass_gain(FPS, BAND[1]), S.low_pass_gain(FPS, BAND[0])
    still = C.reference(rows, 48 * 48)
    weights = C.tile_weights(C.motion(rows, still, 48, 48, 16, 8)).groupBy("clip").agg(F.sort_array(F.collect_list(F.struct("ty", "tx", "weight"))).alias("w"))
    still = still.join(weights.select("clip", F.col("w.weight").alias("weights")), "clip")
    stream = T.in_chunks(rows.withColumn("us", F.col("frame").cast("long")), "clip", chunks).drop("us")
    got = T.appended(T.amplified(stream, still, 48, 48, 16, 8, gains, 4.0))
    want = C.amplified(rows, 48, 48, 16, 8, C.iir(*gains), 4.0)
    for clip in ("a", "other"):
        assert np.allclose(collected(got, clip, (48, 48)), collected(want, clip, (48, 48)), atol=1e-9)


def test_traces_follow_a_swing(spark):
    y, x = np.mgrid[:48, :60]
    frames = np.array([0.5 + 0.3 * np.sin((x - 0.4 * np.sin(2 * np.pi * i / 8)) / 4) + 0.1 * np.cos(y / 5) for i in range(16)])
    df = table(spark, "a", frames)
    still = C.reference(df, 48 * 60)
    rows = C.traces(df, still, 48, 60)
    cell = rows.where("cell = 7 and axis = 'x'").orderBy("frame").collect()
    base = frames.mean(0)
    gy, gx = np.gradient(base)
    ys, xs = np.linspace(0, 48, 5).round().astype(int), np.linspace(0, 60, 6).round().astype(int)
    part = (slice(ys[1], ys[2]), slice(xs[2], xs[3]))
    want = ((frames - base)[:, part[0], part[1]] * gx[part]).mean((1, 2)) / (gx[part] ** 2).mean()
    assert np.allclose([r.value for r in cell], want) and np.corrcoef(want, np.sin(2 * np.pi * np.arange(16) / 8))[0, 1] < -0.9
    weights = {(r.cell, r.axis): r.weight for r in C.trace_weights(rows, centre_weight).collect()}
    texture = np.sqrt((gx[part] ** 2).mean() + (gy[part] ** 2).mean())
    place = 1.10 - 0.70 * np.hypot((ys[1] + ys[2]) / 2 / 48 - 0.5, (xs[2] + xs[3]) / 2 / 60 - 0.5) / 0.5
    assert weights[7, "x"] == pytest.approx(texture * np.sqrt((want**2).mean()) * min(max(place, 0.2), 1.0))
    flat = table(spark, "a", np.zeros((4, 48, 60)))
    assert C.traces(flat, C.reference(flat, 48 * 60), 48, 60).count() == 0
    tiny = table(spark, "a", np.zeros((4, 8, 8)))
    assert C.traces(tiny, C.reference(tiny, 64), 8, 8).count() == 0


def test_frames_of_another_size_are_refused(spark):
    df = table(spark, "a", np.zeros((2, 4, 4)))
    with pytest.raises(Exception, match="arrays of 25 values are needed"):
        C.reference(df, 25).collect()


def test_frames_of_many_rows_are_worked_on_at_once(spark, monkeypatch):
    monkeypatch.setattr(C, "PIXELS_AT_ONCE", 12 * 5)
    blobs = {i: bytes((i * 7 + j) % 256 for j in range(n)) for i, n in enumerate((0, 11, 12, 40, 12 * 13 + 5, 24, 3, 12 * 5, 12))} | {99: None}
    df = spark.createDataFrame([(i, f"k{i}", b) for i, b in blobs.items()], "i long, k string, content binary").coalesce(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        sums = C.from_bytes(df, ["i", "k"], "content", 12, lambda p: C.check_sums(C.to_bytes(p)), "check_sum long, n long").collect()
        pixels = C.decoded(df, ["i", "k"], "content", 2, 2).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    frames = {(i, f"k{i}", f): b[12 * f : 12 * f + 12] for i, b in blobs.items() if b for f in range(len(b) // 12)}
    assert sorted(map(tuple, sums)) == sorted((*key, sum(x * (j + 1) for j, x in enumerate(b)), 12) for key, b in frames.items())
    assert {(r.i, r.k, r.frame): r.pixels for r in pixels} == {key: [x / 255 for x in b] for key, b in frames.items()}
    assert C.from_bytes(df.where("false"), ["i"], "content", 12, lambda p: C.check_sums(C.to_bytes(p)), "check_sum long, n long").count() == 0


def test_round_trip_keeps_pixels_in_one_task(spark):
    plan = QUERIES["frames_round_trip"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "lambda" not in plan
