"""Streaming forms: the same transformations over ``readStream``."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout
from pyspark.sql.types import IntegerType

from ..operators import clips as C
from ..operators import frames as K
from ..sources import shared_dir


def window_stats(events: DataFrame, width: str = "1 day") -> DataFrame:
    """start, event_type, n, total: counts and sums by tumbling window; serves batches and streams."""
    at = F.window(F.col("ts").cast("timestamp"), width)
    return events.groupBy(at.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.unix_micros("w.start").alias("start"), "event_type", "n", "total")


def run_to_end(stream: DataFrame) -> DataFrame:
    """All that a stateful aggregation yields for the files there are: each micro-batch replaces the table in the shared folder.

    State and progress are kept under ``spark.checkpoint.dir``, so that a lost executor costs a retry only.
    """
    spark = stream.sparkSession
    root = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out")

    query = stream.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files; the pattern also fits a single file."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/event[s].parquet")


def in_chunks(rows: DataFrame, key: str, chunks: int) -> DataFrame:
    """``rows`` (us, others) as a stream of chunks in order of time, written to the shared folder one after the other.

    A key's rows of a chunk are in one file, and files come in the order they
    were written, so a key's chunks do, however many files a micro-batch takes.
    """
    spark = rows.sparkSession
    root = f"{shared_dir(spark)}/chunks/{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = rows.stat.approxQuantile("us", [i / chunks for i in range(1, chunks)], 0.01) if chunks > 1 else []
    for i, (low, high) in enumerate(zip([None, *edges], [*edges, None])):
        part = rows if low is None else rows.where(F.col("us") > low)
        part = part if high is None else part.where(F.col("us") <= high)
        part.repartition(parts, key).write.parquet(f"{root}/chunk={i}")
    return spark.readStream.schema(rows.schema.add("chunk", IntegerType())).option("maxFilesPerTrigger", parts).parquet(root).drop("chunk")


def appended(stream: DataFrame) -> DataFrame:
    """All rows that a stateful stream emits; each micro-batch has a folder of its own, so a retried one isn't doubled."""
    spark = stream.sparkSession
    root = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/number={number}")

    stream.writeStream.outputMode("append").foreachBatch(put).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out").select(stream.columns)


def band_pass(rows: DataFrame, key: str, high: float, low: float) -> DataFrame:
    """key, event_id, y from key, us, event_id, value, in chunks whose times don't overlap: difference of two one-pole low-passes, whose states are carried from chunk to chunk."""

    def step(of: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        h, low_ = state.get if state.exists else (0.0, 0.0)
        chunk = pd.concat(parts).sort_values(["us", "event_id"])
        out = []
        for x in chunk["value"]:
            h, low_ = h + high * (x - h), low_ + low * (x - low_)
            out.append(h - low_)
        state.update((h, low_))
        yield pd.DataFrame({key: of[0], "event_id": chunk["event_id"], "y": out})

    return rows.groupBy(key).applyInPandasWithState(step, f"{key} long, event_id long, y double", "h double, l double", "append", GroupStateTimeout.NoTimeout)


def in_batches(rows: DataFrame, key: str, size: int = 8) -> DataFrame:
    """key, batch, n, total: parts of batches of just ``size`` rows each, however chunks cut them; how many rows came before is carried. The parts of a batch add up, the last one's too."""

    def step(of: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        (seen,) = state.get if state.exists else (0,)
        chunk = pd.concat(parts).sort_values(["us", "event_id"])
        state.update((seen + len(chunk),))
        batch = (seen + pd.RangeIndex(len(chunk)).to_numpy()) // size
        sums = chunk["value"].groupby(batch).agg(["count", "sum"])
        yield pd.DataFrame({key: of[0], "batch": sums.index, "n": sums["count"], "total": sums["sum"]})

    return rows.groupBy(key).applyInPandasWithState(step, f"{key} long, batch long, n long, total double", "seen long", "append", GroupStateTimeout.NoTimeout)


def amplified(frames: DataFrame, still: DataFrame, height: int, width: int, size: int, step: int, gains: tuple[float, float], magnification: float) -> DataFrame:
    """clip, frame, pixels of a stream of frames (clip, frame, pixels of luma), chunks of which follow one another in each clip.

    ``still`` is static: clip, pixels of the reference, weights of its tiles in
    order.  What is carried from chunk to chunk are the low-passes of each
    tile's motion, four arrays a clip, so a frame's result doesn't depend on
    where chunks were cut.  A chunk's frames of one clip are held at once.
    """
    corners = C.corners_of(height, width, size, step)
    field = len(K.starts(height, size, step)), len(K.starts(width, size, step))
    high, low = gains

    def work(pixels, ref):
        return [C.lists(rows) for rows in C.tile_motion(C.stacked(pixels, (height, width)), C.stacked(ref, (height, width)), corners, size)[:2]]

    small = still.count() * height * width * 8 <= C.BROADCAST_BYTES
    named = still.select("clip", F.col("pixels").alias("still"), "weights")
    met = frames.join(F.broadcast(named) if small else named, "clip")
    moves = C.by_frames(met, ["clip", "frame", "pixels", "weights"], ["pixels", "still"], 2 * height * width, work, "dx array<double>, dy array<double>")

    def carried(of: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        chunk = pd.concat(parts).sort_values("frame")
        passes = np.array(state.get) if state.exists else np.zeros((4, len(corners)))
        gain = np.array(chunk["weights"].iloc[0], float) * (C.GAIN * magnification)
        fields = []
        for seen in zip(chunk["dx"], chunk["dy"]):
            for axis, now in enumerate(seen):
                passes[2 * axis] += high * (now - passes[2 * axis])
                passes[2 * axis + 1] += low * (now - passes[2 * axis + 1])
            fields.append([(passes[0] - passes[1]) * gain, (passes[2] - passes[3]) * gain])
        state.update(tuple(passes.tolist()))
        fields = np.array(fields).reshape(len(chunk), 2, *field)
        pixels = np.array(chunk["pixels"].tolist(), float).reshape(len(chunk), height, width, 1)
        out = C.warp_pixels(pixels, fields[:, 0], fields[:, 1], C.most_displacement(height, width))
        yield pd.DataFrame({"clip": of[0], "frame": chunk["frame"].to_numpy(), "pixels": list(out.reshape(len(chunk), -1))})

    kinds = dict(frames.dtypes)
    state = ", ".join(f"{name} array<double>" for name in ("xh", "xl", "yh", "yl"))
    return moves.groupBy("clip").applyInPandasWithState(carried, f"clip {kinds['clip']}, frame {kinds['frame']}, pixels array<double>", state, "append", GroupStateTimeout.NoTimeout)
