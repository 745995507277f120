"""Operators on uniform series (series_key, n, x)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def arrays(series: DataFrame) -> DataFrame:
    """series_key, xs: a series as one array in order; a series has a bounded number of buckets."""
    return series.groupBy("series_key").agg(F.sort_array(F.collect_list(F.struct("n", "x"))).alias("s")).select("series_key", F.col("s.x").alias("xs"))


def centred(series: DataFrame) -> DataFrame:
    return series.withColumn("x", F.col("x") - F.avg("x").over(Window.partitionBy("series_key")))


def rms(series: DataFrame) -> DataFrame:
    return series.groupBy("series_key").agg(F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"))


def smooth5(series: DataFrame) -> DataFrame:
    """Taps 1, 2, 3, 2, 1 over nine, zeros beyond the ends, less the smoothed mean; series of under 32 samples, and flat ones, are left out."""
    w = Window.partitionBy("series_key").orderBy("n")
    at = lambda k: F.coalesce(F.lag("x", k).over(w), F.lit(0.0)) if k > 0 else F.coalesce(F.lead("x", -k).over(w), F.lit(0.0))
    raw = (at(2) + 2 * at(1) + 3 * F.col("x") + 2 * at(-1) + at(-2)) / 9
    every = Window.partitionBy("series_key")
    told = centred(series.select("series_key", "n", raw.alias("x"))).withColumn("c", F.count("*").over(every)).withColumn("s", F.stddev_pop("x").over(every))
    return told.where("c >= 32 and s > 1e-6").select("series_key", "n", "x")


def difference(series: DataFrame) -> DataFrame:
    w = Window.partitionBy("series_key").orderBy("n")
    return series.select("series_key", "n", (F.col("x") - F.coalesce(F.lag("x").over(w), F.col("x"))).alias("x"))


def rms_envelope(series: DataFrame, width: int) -> DataFrame:
    """Root of the moving sum of squares over an odd width, zeros beyond the ends."""
    half = width // 2
    w = Window.partitionBy("series_key").orderBy("n").rowsBetween(-half, half)
    return series.select("series_key", "n", F.sqrt(F.sum(F.col("x") * F.col("x")).over(w) / width).alias("x"))


def low_pass_gain(fps: float, cutoff_hz: float) -> float:
    """dt / (rc + dt); 1 if a rate is not positive."""
    if fps <= 0 or cutoff_hz <= 0:
        return 1.0
    return (1 / fps) / (1 / (2 * math.pi * cutoff_hz) + 1 / fps)


def iir_band_pass(series: DataFrame, fps: float, low_hz: float, high_hz: float) -> DataFrame:
    """Difference of two one-pole low-passes that start at zero: a fold over each series."""
    a, b = low_pass_gain(fps, high_hz), low_pass_gain(fps, low_hz)
    start = F.struct(F.lit(0.0).alias("h"), F.lit(0.0).alias("l"), F.array().cast("array<double>").alias("ys"))

    def step(s: Column, x: Column) -> Column:
        h, low = s.h + a * (x - s.h), s.l + b * (x - s.l)
        return F.struct(h.alias("h"), low.alias("l"), F.concat(s.ys, F.array(h - low)).alias("ys"))

    return arrays(series).select("series_key", F.posexplode(F.aggregate("xs", start, step, lambda s: s.ys)).alias("n", "x"))


def spectrum(packed: DataFrame, buckets: int, fps: float) -> DataFrame:
    """series_key, k, freq_hz, amp from series_key, xs: |DFT of the centred series| / N for k = 0 .. N/2.

    A series is one row of bounded length; Arrow batches of them are
    transformed at once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, buckets)
            amp = np.abs(np.fft.rfft(x - x.mean(axis=1, keepdims=True), axis=1)) / buckets
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * amp.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(amp.ravel()))], names=["series_key", "amps"])

    bins = packed.select("series_key", F.col("xs").cast("array<double>").alias("xs")).mapInArrow(run, "series_key string, amps array<double>")
    return bins.select("series_key", F.posexplode("amps").alias("k", "amp")).select("series_key", "k", (F.col("k") * (fps / buckets)).alias("freq_hz"), "amp")


def band_energy(spectra: DataFrame, low_hz: float, high_hz: float) -> DataFrame:
    """series_key, band, total: energy within a band and over all bins."""
    e = F.col("amp") * F.col("amp")
    inside = F.col("freq_hz").between(low_hz, high_hz)
    return spectra.groupBy("series_key").agg(F.sum(F.when(inside, e).otherwise(0.0)).alias("band"), F.sum(e).alias("total"))


def peaks(spectra: DataFrame, top: int) -> DataFrame:
    """series_key, rank, k, freq_hz, amp: local maxima above 0 Hz, above median + half a deviation of the maxima if any is, the highest first."""
    w = Window.partitionBy("series_key").orderBy("k")
    shaped = spectra.withColumn("before", F.lag("amp").over(w)).withColumn("after", F.lead("amp").over(w))
    found = shaped.where("before is not null and after is not null and amp >= before and amp >= after and freq_hz > 0")
    every = Window.partitionBy("series_key")
    found = found.withColumn("least", F.percentile("amp", F.lit(0.5)).over(every) + 0.5 * F.stddev_pop("amp").over(every))
    found = found.withColumn("any", F.max(F.col("amp") >= F.col("least")).over(every)).where("not any or amp >= least")
    order = every.orderBy(F.col("amp").desc(), "k")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("series_key", "rank", "k", "freq_hz", "amp")


def sharpness(spectra: DataFrame) -> DataFrame:
    """1 - mean of the five bins around / amplitude, held to 0 .. 1, where all five exist."""
    w = Window.partitionBy("series_key").orderBy("k").rowsBetween(-2, 2)
    rows = spectra.withColumn("m", F.avg("amp").over(w)).withColumn("c", F.count("amp").over(w))
    value = F.least(F.greatest(1 - F.col("m") / F.col("amp"), F.lit(0.0)), F.lit(1.0))
    return rows.where("c = 5 and amp > 1e-9").select("series_key", "k", value.alias("sharpness"))


def median_spectrum(spectra: DataFrame) -> DataFrame:
    return spectra.groupBy("k", "freq_hz").agg(F.percentile("amp", F.lit(0.5)).alias("amp"))


def support(spectra: DataFrame, peaks_: DataFrame) -> DataFrame:
    """k, support: for each bin that is some series' peak, the share of all series with their first highest value there, among the bin and its neighbours.

    The first and the last bin are no neighbours.
    """
    every = Window.partitionBy("series_key")
    at = every.orderBy("k")
    rows = spectra.withColumn("last", F.max("k").over(every)).withColumn("p", F.lag("amp").over(at)).withColumn("q", F.lead("amp").over(at))
    first = F.when(F.col("k") - 1 >= 1, F.col("amp") > F.col("p")).otherwise(F.lit(True))
    high = F.when(F.col("k") + 1 <= F.col("last") - 1, F.col("amp") >= F.col("q")).otherwise(F.lit(True))
    hit = (F.col("k") >= 1) & (F.col("k") <= F.col("last") - 1) & (F.col("amp") > 0) & first & high
    bins = peaks_.select("k").distinct()
    return rows.withColumn("hit", hit.cast("double")).join(bins, "k").groupBy("k").agg(F.avg("hit").alias("support"))


def ewma(rows: DataFrame, key: str, order: list[str], value: str, keep: float) -> DataFrame:
    """Last exponentially weighted mean of each key, started by its first value, and anew after a null.

    Rows are dealt by ranges of key and order, so a key may span several
    parts.  A part's rows are a weighted sum, and parts fold in order.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cols = [*order, value]
    dealt = rows.select(key, *cols).repartitionByRange(parts, key, *cols).withColumn("_part", F.spark_partition_id())
    back = Window.partitionBy(key, "_part").orderBy(*[F.desc(c) for c in cols]).rowsBetween(Window.unboundedPreceding, 0)
    ranked = dealt.withColumn("_age", F.count(F.lit(1)).over(back) - 1).withColumn("_nulls", F.count(F.when(F.col(value).isNull(), 1)).over(back))
    live = F.col("_nulls") == 0
    sums = ranked.groupBy(key, "_part").agg(
        F.sum(F.when(live, 1).otherwise(0)).alias("n"),
        F.sum(F.when(live, (1 - keep) * F.pow(F.lit(keep), F.col("_age")) * F.col(value))).alias("s"),
        F.max_by(F.when(live, F.col(value).cast("double")), F.when(live, F.col("_age"))).alias("x"),
        (F.max("_nulls") > 0).alias("anew"),
    )
    packed = sums.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_part", "n", "s", "x", "anew"))).alias("ps"))

    def step(a: Column, p: Column) -> Column:
        return F.pow(F.lit(keep), p.n) * F.when(a.isNull() | p.anew, p.x).otherwise(a) + p.s

    return packed.select(key, F.aggregate("ps", F.lit(None).cast("double"), step).alias("ewma"))
