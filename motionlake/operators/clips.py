"""Whole frames, one row each: clip, frame, pixels (array of height x width, or x 3 with colours).

A frame never leaves its row.  Work on pixels runs over Arrow batches, a few
frames at once; between frames only grids of tiles travel: motion, its
band-pass over time and the gains by confidence.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import frames as K
from . import grid as G
from ..sources import written

#: Pixels that one step of a task works on, and bytes of reference images that a join may broadcast.
PIXELS_AT_ONCE, BROADCAST_BYTES = 1 << 21, 64 << 20
#: BT.709 weights of red, green and blue.
BT709 = (0.2126, 0.7152, 0.0722)
GAIN = 1.4


def most_displacement(height: int, width: int) -> float:
    """Pixels that a cell moves at most."""
    return max(1.0, min(min(height, width) / 24, 6.0))


@dataclass(frozen=True, eq=False)
class ResizePlan:
    """Where each target cell lies between source cells, corners on corners: made once for a pair of sizes and used for every field."""

    source: tuple[int, int]
    target: tuple[int, int]
    y0: np.ndarray
    y1: np.ndarray
    wy: np.ndarray
    x0: np.ndarray
    x1: np.ndarray
    wx: np.ndarray

    def __call__(self, fields: np.ndarray) -> np.ndarray:
        """Fields (..., source) as (..., target)."""
        if fields.shape[-2:] != self.source:
            raise ValueError(f"a field of {fields.shape[-2:]} doesn't fit a plan for {self.source}")
        if self.source == self.target:
            return fields
        rows = fields[..., self.y0, :] * (1 - self.wy)[:, None] + fields[..., self.y1, :] * self.wy[:, None]
        return rows[..., self.x0] * (1 - self.wx) + rows[..., self.x1] * self.wx


@functools.lru_cache(maxsize=64)
def resize_plan(source: tuple[int, int], target: tuple[int, int]) -> ResizePlan:
    def axis(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.linspace(0.0, n - 1, m)
        first = np.floor(at).astype(int)
        return first, np.minimum(first + 1, n - 1), at - first

    return ResizePlan(source, target, *axis(source[0], target[0]), *axis(source[1], target[1]))


def warp_pixels(pixels: np.ndarray, dx: np.ndarray, dy: np.ndarray, most: float) -> np.ndarray:
    """Frames (n, height, width, colours) by fields (n, rows, columns) that are spread over them: each cell takes, between four cells, the value at its place plus its displacement."""
    n, height, width = pixels.shape[:3]
    plan = resize_plan(dx.shape[1:], (height, width))
    place = lambda field, base, size: np.clip(base + np.clip(plan(field), -most, most), 0, size - 1.001)
    x, y = place(dx, np.arange(width)[None, None, :], width), place(dy, np.arange(height)[None, :, None], height)
    x0, y0 = np.floor(x).astype(int), np.floor(y).astype(int)
    x1, y1 = np.clip(x0 + 1, 0, width - 1), np.clip(y0 + 1, 0, height - 1)
    wx, wy = (x - x0)[..., None], (y - y0)[..., None]
    at = np.arange(n)[:, None, None]
    top = pixels[at, y0, x0] * (1 - wx) + pixels[at, y0, x1] * wx
    low = pixels[at, y1, x0] * (1 - wx) + pixels[at, y1, x1] * wx
    return np.clip(top * (1 - wy) + low * wy, 0, 1)


def stacked(column: pa.Array, shape: tuple[int, ...]) -> np.ndarray:
    """A column of arrays as one array; all must have as many values as the shape."""
    size = int(np.prod(shape))
    if len(column) and not pc.all(pc.equal(pc.list_value_length(column), size)).as_py():
        raise ValueError(f"arrays of {size} values are needed")
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), *shape)


def lists(rows: np.ndarray) -> pa.Array:
    flat = rows.reshape(len(rows), -1)
    ends = np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1] if len(flat) else np.zeros(1, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.ravel().astype(float)))


def by_frames(rows: DataFrame, kept: list[str], used: list[str], size: int, work: Callable, made: str) -> DataFrame:
    """``kept`` columns and what ``work(columns of used)`` returns for them, so many frames of ``size`` pixels at once that memory stays bounded. made: its columns and types."""
    step = max(1, PIXELS_AT_ONCE // max(size, 1))
    names = [*kept, *[c.split()[0] for c in made.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                found = work(*part.columns[len(kept) :])
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *found], names=names)

    kinds = dict(rows.dtypes)
    return rows.select(*kept, *used).mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in kept) + ", " + made)


def from_bytes(blobs: DataFrame, keys: list[str], content: str, size: int, work: Callable, made: str) -> DataFrame:
    """keys, frame (from 0), and what ``work(pixels)`` returns for the packed frames of a binary column (a byte a value, 0 to 1 in an array (frames, size)); what is left of less than a frame, and a null, has none. made: its columns and types.

    Frames of many rows are worked on at once, and pixels don't leave the task.
    """
    step = max(1, PIXELS_AT_ONCE // size)
    kinds = dict(blobs.dtypes)
    names = [*keys, "frame", *[c.split()[0] for c in made.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(len(keys))
            counts = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False) // size
            held: list[tuple[int, int, np.ndarray]] = []  # row, first frame, bytes

            def done() -> pa.RecordBatch:
                pixels = np.concatenate([x for *_, x in held]).reshape(-1, size) / 255
                n = [len(x) // size for *_, x in held]
                rows = pa.array(np.repeat([i for i, *_ in held], n))
                frame = np.concatenate([np.arange(at, at + m) for (_, at, _), m in zip(held, n)])
                return pa.RecordBatch.from_arrays([*[batch.column(k).take(rows) for k in range(len(keys))], pa.array(frame, pa.int64()), *work(pixels)], names=names)

            free = step
            for i in np.flatnonzero(counts).tolist():
                blob, at = column[i].as_buffer(), 0
                while at < counts[i]:
                    n = int(min(free, counts[i] - at))
                    held.append((i, at, np.frombuffer(blob, np.uint8, n * size, at * size)))
                    at, free = at + n, free - n
                    if not free:
                        yield done()
                        held, free = [], step
            if held:
                yield done()

    return blobs.select(*keys, content).mapInArrow(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", frame long, " + made)


def decoded(blobs: DataFrame, keys: list[str], content: str, height: int, width: int, colours: int = 3) -> DataFrame:
    """keys, frame (from 0), pixels (0 to 1): the packed frames of a binary column, a byte a value; what is left of less than a frame, and a null, has none."""
    return from_bytes(blobs, keys, content, height * width * colours, lambda pixels: [lists(pixels)], "pixels array<double>")


def to_bytes(pixels: np.ndarray) -> pa.Array:
    """Frames (n, size) as bytes, values held to 0 .. 1 and rounded half to even."""
    rows = np.rint(np.clip(pixels, 0, 1) * 255).astype(np.uint8)
    return pa.array([r.tobytes() for r in rows], pa.binary())


def check_sums(contents: pa.Array) -> list[pa.Array]:
    """Sum of bytes times their places (from 1), and number of bytes, of each binary."""
    read = [np.frombuffer(c.as_buffer(), np.uint8).astype(np.int64) for c in contents]
    sums = [int(x @ np.arange(1, len(x) + 1)) for x in read]
    return [pa.array(sums, pa.int64()), pa.array([len(x) for x in read], pa.int64())]


def encoded(frames: DataFrame, keys: list[str], size: int) -> DataFrame:
    """keys, content: the frames as bytes, values held to 0 .. 1 and rounded half to even."""
    return by_frames(frames, keys, ["pixels"], size, lambda pixels: [to_bytes(stacked(pixels, (size,)))], "content binary")


def luma(frames: DataFrame, keys: list[str], height: int, width: int) -> DataFrame:
    """keys, pixels: BT.709 luma of frames with colours."""
    return by_frames(frames, keys, ["pixels"], height * width * 3, lambda p: [lists(stacked(p, (height * width, 3)) @ np.array(BT709))], "pixels array<double>")


def packed(cells: DataFrame, *keys: str) -> DataFrame:
    """keys, pixels from cells (keys, row, col, value): a frame has height x width of them."""
    rows = cells.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("row", "col", "value"))).alias("p"))
    return rows.select(*keys, F.col("p.value").cast("array<double>").alias("pixels"))


def cells(frames: DataFrame, width: int, *keys: str) -> DataFrame:
    """keys, row, col, value: pixels as rows."""
    rows = frames.select(*keys, F.posexplode("pixels").alias("i", "value"))
    return rows.select(*keys, F.floor(F.col("i") / width).cast("int").alias("row"), (F.col("i") % width).cast("int").alias("col"), "value")


def gaussian_clips(clips: DataFrame, count: int, height: int, width: int) -> DataFrame:
    """clip, frame, pixels: a Gaussian spot that swings along x, by ``swing`` pixels and once in ``period`` frames (clips: clip, swing, period)."""
    spread = max(min(height, width) / 14, 4.0)
    y, x = np.mgrid[:height, :width]

    def work(frame: pa.Array, swing: pa.Array, period: pa.Array) -> list[pa.Array]:
        f, s, p = (c.to_numpy(zero_copy_only=False).astype(float)[:, None, None] for c in (frame, swing, period))
        at = width / 2 + s * np.sin(f * 2 * np.pi / p)
        return [lists(np.exp(-((x - at) ** 2 + (y - height / 2) ** 2) / (2 * spread**2)))]

    rows = clips.withColumn("frame", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    return by_frames(rows, ["clip", "frame"], ["frame", "swing", "period"], height * width, work, "pixels array<double>")


def reference(frames: DataFrame, size: int) -> DataFrame:
    """clip, pixels: the mean frame of each clip. Tasks add up their own frames first, then the sums are added pixel by pixel."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict = {}

        def out() -> pa.RecordBatch:
            totals = lists(np.array([t for _, t in sums.values()]).reshape(len(sums), size))
            found = pa.RecordBatch.from_arrays([pa.array(list(sums), kind), pa.array([n for n, _ in sums.values()], pa.int64()), totals], names=["clip", "n", "total"])
            sums.clear()
            return found

        for batch in batches:
            kind = batch.schema.field(0).type
            rows = stacked(batch.column(1), (size,))
            for clip, row in zip(batch.column(0).to_pylist(), rows):
                n, total = sums.get(clip, (0, 0.0))
                sums[clip] = n + 1, total + row
                if len(sums) * size > PIXELS_AT_ONCE:
                    yield out()
        if sums:
            yield out()

    kind = dict(frames.dtypes)["clip"]
    parts = frames.select("clip", "pixels").mapInArrow(run, f"clip {kind}, n long, total array<double>")
    means = parts.select("clip", "n", F.posexplode("total").alias("i", "x")).groupBy("clip", "i").agg((F.sum("x") / F.sum("n")).alias("x"))
    return means.groupBy("clip").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("p")).select("clip", F.col("p.x").alias("pixels"))


def correlated(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """dx, dy and quality of tiles (n, size, size) against those of the reference: the peak of their phase correlation, between samples."""
    size = first.shape[-1]
    hann = np.outer(np.hanning(size), np.hanning(size))
    power = np.fft.fft2(first * hann) * np.conj(np.fft.fft2(second * hann))
    surface = np.abs(np.fft.ifft2(power / np.maximum(np.abs(power), 1e-6)))
    flat = surface.reshape(len(surface), -1)
    at = flat.argmax(axis=1)
    y, x, n = at // size, at % size, np.arange(len(at))
    top = flat[n, at]

    def between(before: np.ndarray, after: np.ndarray) -> np.ndarray:
        bend = before - 2 * top + after
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.clip(np.where(np.abs(bend) < 1e-6, 0.0, 0.5 * (before - after) / bend), -1, 1)

    dx = x + between(surface[n, y, (x - 1) % size], surface[n, y, (x + 1) % size])
    dy = y + between(surface[n, (y - 1) % size, x], surface[n, (y + 1) % size, x])
    back = lambda v: np.where(v > size / 2, v - size, v)
    return back(dx), back(dy), top / (flat.mean(axis=1) + 1e-6)


def tile_motion(pixels: np.ndarray, still: np.ndarray, corners: list[tuple[int, int]], size: int) -> tuple[np.ndarray, ...]:
    """dx, dy, texture, quality (n, tiles) of frames (n, height, width) against references; flat tiles stay."""
    cut = lambda rows, y, x: rows[:, y : y + size, x : x + size]
    out = np.zeros((4, len(pixels), len(corners)))
    for i, (y, x) in enumerate(corners):
        first = cut(still, y, x)
        out[2, :, i] = first.std(axis=(1, 2))
        live = out[2, :, i] >= 1e-4
        if live.any():
            out[[0, 1, 3], :, i] = np.where(live, np.array(correlated(first, cut(pixels, y, x))), 0.0)
    return tuple(out)


def _with_still(frames: DataFrame, still: DataFrame, size: int) -> DataFrame:
    """Frames and their clip's reference image, which is broadcast while all of them are small."""
    few = still.count() * size * 8 <= BROADCAST_BYTES
    named = still.select("clip", F.col("pixels").alias("still"))
    return frames.join(F.broadcast(named) if few else named, "clip")


def corners_of(height: int, width: int, size: int, step: int) -> list[tuple[int, int]]:
    return [(y, x) for y in K.starts(height, size, step) for x in K.starts(width, size, step)]


def motion(frames: DataFrame, still: DataFrame, height: int, width: int, size: int, step: int) -> DataFrame:
    """clip, frame, ty, tx, dx, dy, texture, quality: how each tile of each frame (clip, frame, pixels of luma) must shift to lie on the reference (clip, pixels)."""
    corners = corners_of(height, width, size, step)

    def work(pixels: pa.Array, ref: pa.Array) -> list[pa.Array]:
        return [lists(rows) for rows in tile_motion(stacked(pixels, (height, width)), stacked(ref, (height, width)), corners, size)]

    names = ("dx", "dy", "texture", "quality")
    found = by_frames(_with_still(frames, still, height * width), ["clip", "frame"], ["pixels", "still"], 2 * height * width, work, ", ".join(f"{n} array<double>" for n in names))
    at = F.array(*[F.struct(F.lit(y).alias("ty"), F.lit(x).alias("tx")) for y, x in corners])
    return found.select("clip", "frame", F.inline(F.arrays_zip(at.alias("at"), *names))).select("clip", "frame", "at.*", *names)


def fft_passed(rows: DataFrame, keys: list[str], value: str, fps: float, low: float, high: float) -> DataFrame:
    """keys, frame, y: frequencies from low to high of each key's values over its frames, all others cut off; a key has a clip's frames."""
    series = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("frame", F.col(value).cast("double").alias("x")))).alias("ps"))
    series = series.select(*keys, F.col("ps.frame").alias("frames"), F.col("ps.x").alias("xs"))

    def work(column: pa.Array) -> list[pa.Array]:
        out = []
        for xs in column:
            x = np.array(xs.as_py(), float)
            spectrum, at = np.fft.rfft(x), np.fft.rfftfreq(len(x), 1 / fps)
            out.append(np.fft.irfft(np.where((at >= low) & (at <= high), spectrum, 0), len(x)).tolist())
        return [pa.array(out, pa.list_(pa.float64()))]

    passed = by_frames(series, [*keys, "frames"], ["xs"], 1 << 10, work, "ys array<double>")
    return passed.select(*keys, F.inline(F.arrays_zip(F.col("frames").alias("frame"), F.col("ys").alias("y"))))


def tile_weights(moves: DataFrame) -> DataFrame:
    """clip, ty, tx, weight: how far each tile's motion counts, by its confidence among the clip's tiles."""
    sure = K.tile_confidence(moves).select(F.col("clip").alias("grid_id"), F.col("ty").alias("row"), F.col("tx").alias("col"), F.col("confidence").alias("value"))
    return G.confidence(sure, 0.97, 0.03, "render").select(F.col("grid_id").alias("clip"), F.col("row").alias("ty"), F.col("col").alias("tx"), "weight")


def displacements(moves: DataFrame, band: Callable[[DataFrame, list[str], str], DataFrame], magnification: float, attenuate: bool = True) -> DataFrame:
    """clip, frame, dx, dy (arrays by tile, in order): motion within the band, amplified by gain and confidence. Unless others are attenuated, a quarter of all motion around its mean is added."""
    keys = ["clip", "ty", "tx"]
    shifts = None
    for axis in ("dx", "dy"):
        passed = band(moves, keys, axis).withColumnRenamed("y", axis)
        if not attenuate:
            mean = moves.groupBy(*keys).agg(F.avg(axis).alias("mean"))
            around = moves.join(mean, keys).select(*keys, "frame", (0.25 * (F.col(axis) - F.col("mean"))).alias("rest"))
            passed = passed.join(around, [*keys, "frame"]).select(*keys, "frame", (F.col(axis) + F.col("rest")).alias(axis))
        shifts = passed if shifts is None else shifts.join(passed, [*keys, "frame"])
    gain = F.col("weight") * (GAIN * magnification)
    held = shifts.join(tile_weights(moves), keys).select("clip", "frame", F.struct("ty", "tx", (F.col("dx") * gain).alias("dx"), (F.col("dy") * gain).alias("dy")).alias("t"))
    grids = held.groupBy("clip", "frame").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return grids.select("clip", "frame", F.col("ts.dx").alias("dx"), F.col("ts.dy").alias("dy"))


def warped(frames: DataFrame, fields: DataFrame, height: int, width: int, field: tuple[int, int], most: float, colours: int = 1) -> DataFrame:
    """clip, frame, pixels: frames by fields (clip, frame, dx, dy: arrays of rows x columns) that are spread over them between their cells, corners on corners."""

    def work(pixels: pa.Array, dx: pa.Array, dy: pa.Array) -> list[pa.Array]:
        return [lists(warp_pixels(stacked(pixels, (height, width, colours)), stacked(dx, field), stacked(dy, field), most))]

    return by_frames(frames.join(fields, ["clip", "frame"]), ["clip", "frame"], ["pixels", "dx", "dy"], 4 * height * width * colours, work, "pixels array<double>")


def iir(high: float, low: float) -> Callable[[DataFrame, list[str], str], DataFrame]:
    """Band-pass as the difference of two one-pole low-passes, as in streams."""
    return lambda rows, keys, value: K.low_passed(rows, keys, value, high, low)


def fft(fps: float, low: float, high: float) -> Callable[[DataFrame, list[str], str], DataFrame]:
    """Band-pass over whole clips."""
    return lambda rows, keys, value: fft_passed(rows, keys, value, fps, low, high)


def amplified(frames: DataFrame, height: int, width: int, size: int, step: int, band: Callable, magnification: float, attenuate: bool = True, colours: int = 1) -> DataFrame:
    """clip, frame, pixels: the whole chain over frames (clip, frame, pixels): reference, tile motion, band-pass over time, gain by confidence, displacement between tiles, warp."""
    if magnification <= 0:
        return frames
    grey = frames.select("clip", "frame", "pixels") if colours == 1 else luma(frames, ["clip", "frame"], height, width)
    still = written(reference(grey, height * width))
    moves = written(motion(grey, still, height, width, size, step))
    field = len(K.starts(height, size, step)), len(K.starts(width, size, step))
    return warped(frames, displacements(moves, band, magnification, attenuate), height, width, field, most_displacement(height, width), colours)


def traces(frames: DataFrame, still: DataFrame, height: int, width: int) -> DataFrame:
    """clip, cell, axis, frame, value, weight, centre_row, centre_col: motion of each cell along x and y, from how the light changes along the reference's gradient (clip, frame, pixels; still: clip, pixels).

    The difference to the reference, times its gradient, over the gradient's
    energy, each averaged over the cell.  Cells without texture or an axis
    without gradient have no trace.  ``texture`` is the cell's mean gradient.
    """
    split = lambda n, k, low, high: np.round(np.linspace(0, n, int(np.clip(round(n / k), low, high)) + 1)).astype(int)
    ys, xs = split(height, 18.0, 4, 6), split(width, 18.0, 5, 8)
    places = [(a, b, c, d) for a, b in zip(ys, ys[1:]) for c, d in zip(xs, xs[1:]) if b - a >= 6 and d - c >= 6]

    def work(pixels: pa.Array, ref: pa.Array) -> list[pa.Array]:
        rows, base = stacked(pixels, (height, width)), stacked(ref, (height, width))
        gy, gx = np.gradient(base, axis=(1, 2))
        moved, texture = np.full((len(rows), len(places), 2), np.nan), np.zeros((len(rows), len(places)))
        for i, (a, b, c, d) in enumerate(places):
            apart = (rows - base)[:, a:b, c:d]
            energy = [np.mean(g[:, a:b, c:d] ** 2, axis=(1, 2)) for g in (gx, gy)]
            texture[:, i] = np.sqrt(energy[0] + energy[1])
            for j, g in enumerate((gx, gy)):
                fine = (energy[j] > 1e-5) & (texture[:, i] > 1e-4)
                moved[fine, i, j] = np.mean(apart * g[:, a:b, c:d], axis=(1, 2))[fine] / energy[j][fine]
        return [lists(moved), lists(texture)]

    found = by_frames(_with_still(frames, still, height * width), ["clip", "frame"], ["pixels", "still"], 4 * height * width, work, "moved array<double>, texture array<double>")
    rows = found.select("clip", "frame", "texture", F.posexplode("moved").alias("i", "value")).where(~F.isnan("value"))
    cell, axis = F.floor(F.col("i") / 2).cast("int"), F.when(F.col("i") % 2 == 0, "x").otherwise("y")
    centre = F.array(*[F.struct(F.lit((a + b) / 2 / height).alias("centre_row"), F.lit((c + d) / 2 / width).alias("centre_col")) for a, b, c, d in places] or [F.lit(None).cast("struct<centre_row: double, centre_col: double>")])
    return rows.select("clip", cell.alias("cell"), axis.alias("axis"), "frame", "value", F.get("texture", cell).alias("texture"), F.get(centre, cell)["centre_row"].alias("centre_row"), F.get(centre, cell)["centre_col"].alias("centre_col"))


def trace_weights(rows: DataFrame, centre_weight: Callable[[Column, Column], Column]) -> DataFrame:
    """clip, cell, axis, weight of traces that move: texture, times how far they move, times the weight of the cell's place."""
    found = rows.groupBy("clip", "cell", "axis").agg(F.max("texture").alias("texture"), F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"), F.first("centre_row").alias("r"), F.first("centre_col").alias("c"))
    return found.where("rms > 1e-5").select("clip", "cell", "axis", (F.col("texture") * F.col("rms") * centre_weight(F.col("r"), F.col("c"))).alias("weight"))
