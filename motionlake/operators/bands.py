"""Operators on frequency bands of spectra (series_key, k, freq_hz, amp) and pairs of series."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import strength


def edges(spectra: DataFrame, peaks: DataFrame, share: float, inner: int) -> DataFrame:
    """series_key, rank, k, k_low, k_high: the nearest bins on both sides of each peak that are under a share of its amplitude, at most ``inner`` bins from the ends.

    Peaks of a series are few (a top-k), so each bin meets a bounded number of them.
    """
    bins = spectra.select("series_key", F.col("k").alias("b"), F.col("amp").alias("a"))
    ends = spectra.groupBy("series_key").agg(F.max("k").alias("last"))
    low = F.col("a") < share * F.col("amp")
    walked = peaks.join(bins, "series_key").groupBy("series_key", "rank", "k").agg(
        F.max(F.when(low & (F.col("b") < F.col("k")), F.col("b"))).alias("under"), F.min(F.when(low & (F.col("b") > F.col("k")), F.col("b"))).alias("over")
    )
    return walked.join(ends, "series_key").select(
        "series_key", "rank", "k", F.greatest(F.coalesce("under", F.lit(inner)), F.lit(inner)).alias("k_low"),
        F.least(F.coalesce("over", F.col("last") - inner), F.col("last") - inner).alias("k_high"),
    )


def widths(low: Column, high: Column, peak: Column, bin_hz: float, least: float, most: float) -> tuple[Column, Column]:
    """Edges around a peak, held to a width of at least max(0.25, two bins) and at most half the range and 2.5, centred on the peak where they aren't; a peak at the floor of a narrow range keeps headroom."""
    low, high = F.greatest(F.lit(least), low), F.least(F.lit(most), high)
    thin = max(0.25, 2 * bin_hz)
    wide = max(thin, min(2.5, (most - least) / 2))
    for wrong, width in ((lambda a, b: b - a < thin, thin), (lambda a, b: b - a > wide, wide)):
        now = wrong(low, high)
        low, high = F.when(now, F.greatest(F.lit(least), peak - width / 2)).otherwise(low), F.when(now, F.least(F.lit(most), peak + width / 2)).otherwise(high)
    span = most - least
    if 0 < span <= 0.75:
        guard = min(most, least + span * 0.65)
        floor = (peak <= least + span * 0.25) & (high < guard)
        low, high = F.when(floor, F.lit(least)).otherwise(low), F.when(floor, F.lit(guard)).otherwise(high)
    return low, high


def suggested_widths(low: Column, high: Column, peak: Column, bin_hz: float, least: float, most: float) -> tuple[Column, Column]:
    """The same for band suggestions: at least max(0.2, three bins), at most 0.9 of the peak's frequency (0.75 or more), with exceptions for slow and for fast peaks."""
    low, high = F.greatest(F.lit(least), low), F.least(F.lit(most), high)
    thin, span = max(0.2, 3 * bin_hz), most - least
    wide = F.greatest(F.lit(thin), F.least(F.lit(span), F.greatest(F.lit(0.75), peak * 0.9)))
    wide = F.when(peak < 0.5, F.least(wide, F.lit(0.45))).when(peak > most * 0.65, F.greatest(wide, F.lit(min(span, 0.9)))).otherwise(wide)
    for now, width in ((high - low < thin, F.lit(thin)), (None, wide)):
        now = high - low > wide if now is None else now
        low, high = F.when(now, F.greatest(F.lit(least), peak - width / 2)).otherwise(low), F.when(now, F.least(F.lit(most), peak + width / 2)).otherwise(high)
    return low, high


def clamp(low: Column, high: Column, peak: Column, least: float, most: float) -> tuple[Column, Column]:
    """Both edges held to [least, most]; an inverted band collapses to its peak, held likewise, or to ``least`` without one."""
    most = max(least, most)
    hold = lambda x: F.greatest(F.lit(least), F.least(F.lit(most), x))
    a, b = hold(low), hold(high)
    centre = hold(F.coalesce(peak, F.lit(least)))
    return F.when(b < a, centre).otherwise(a), F.when(b < a, centre).otherwise(b)


def peaks_bb(spectra: DataFrame) -> DataFrame:
    """series_key, k, freq_hz, amp: inner bins not under the bin before and over the one after; of a series without any, its first highest bin."""
    w = Window.partitionBy("series_key").orderBy("k")
    rows = spectra.withColumn("p", F.lag("amp").over(w)).withColumn("q", F.lead("amp").over(w))
    rows = rows.withColumn("top", (F.col("p").isNotNull() & F.col("q").isNotNull() & (F.col("amp") >= F.col("p")) & (F.col("amp") > F.col("q"))))
    every = Window.partitionBy("series_key")
    rows = rows.withColumn("any", F.max("top").over(every)).withColumn("first", F.min(F.struct(-F.col("amp"), "k")).over(every)["k"])
    return rows.where("top or (not any and k = first)").select("series_key", "k", "freq_hz", "amp")


def prominence(spectra: DataFrame, peaks: DataFrame, bins: int) -> DataFrame:
    """series_key, k, prominence of peaks: amplitude over the highest of the series' median and the upper quartiles of a few bins on either side, at least 0."""
    radius = min(6, max(2, bins // 24))
    at = Window.partitionBy("series_key").orderBy("k")
    q = lambda lo, hi: F.percentile("amp", F.lit(0.75)).over(at.rowsBetween(lo, hi))
    base = F.greatest(F.percentile("amp", F.lit(0.5)).over(Window.partitionBy("series_key")), q(-radius, -1), q(1, radius))
    rows = spectra.withColumn("prominence", F.greatest(F.col("amp") - base, F.lit(0.0)))
    return rows.join(peaks.select("series_key", "k"), ["series_key", "k"]).select("series_key", "k", "prominence")


def harmonic_bonus(peaks: DataFrame, bin_hz: float) -> DataFrame:
    """series_key, k, bonus: for each peak, how strong the peaks near twice and three times its frequency are. Peaks of one series meet each other; they are bounded by its bins."""
    other = peaks.select("series_key", F.col("freq_hz").alias("f2"), F.col("amp").alias("a2"))
    count = peaks.groupBy("series_key").agg(F.count("*").alias("n"))
    met = peaks.join(other, "series_key")

    def part(factor: float, weight: float) -> Column:
        near = F.abs(F.col("f2") - F.col("freq_hz") * factor) <= F.greatest(F.lit(2 * bin_hz), F.col("freq_hz") * factor * 0.08)
        return F.coalesce(weight * F.least(F.lit(1.0), F.max(F.when(near, F.col("a2"))) / F.first("amp")), F.lit(0.0))

    found = met.groupBy("series_key", "k", "freq_hz", "amp").agg(part(2.0, 0.30).alias("two"), part(3.0, 0.12).alias("three")).join(count, "series_key")
    counts = (F.col("n") > 1) & (F.col("freq_hz") > 0) & (F.col("amp") > 1e-6)
    return found.select("series_key", "k", F.when(counts, F.least(F.col("two") + F.col("three"), F.lit(1.0))).otherwise(0.0).alias("bonus"))


def nearest_bin(peaks: DataFrame, freq: Column, bin_hz: float, last: int) -> DataFrame:
    """``peaks`` with ``bin``: of bins 0 .. last, the nearest to a frequency, the lower of two alike; bins are even, so no join is needed."""
    return peaks.withColumn("bin", F.greatest(F.lit(0), F.least(F.lit(last), F.ceil(freq / bin_hz - 0.5))).cast("int"))


def covering_score(bands: DataFrame, scored: DataFrame, bin_hz: float) -> DataFrame:
    """series_key, band, peak_score: the best score of peaks (freq_hz, score) within a band and one bin more; else that of the nearest peak to the band's own (peak_hz), 0 without one."""
    met = bands.join(scored.select("series_key", "freq_hz", "score"), "series_key", "left")
    inside = F.col("freq_hz").between(F.col("low_hz") - bin_hz, F.col("high_hz") + bin_hz)
    nearest = F.min(F.struct(F.abs(F.col("freq_hz") - F.col("peak_hz")).alias("d"), (-F.col("score")).alias("s")))
    out = met.groupBy("series_key", "band", "peak_hz").agg(F.max(F.when(inside, F.col("score"))).alias("best"), nearest.alias("near"))
    far = F.when(F.col("peak_hz").isNull(), 0.0).otherwise(F.coalesce(-F.col("near.s"), F.lit(0.0)))
    return out.select("series_key", "band", F.coalesce("best", far).alias("peak_score"))


def merged(bands: DataFrame) -> DataFrame:
    """series_key, band, low_hz, high_hz, peak_hz: bands in order, joined where the gap is at most 0.1 or 0.15 of the width so far and no clear valley parts them; the first peak stays.

    ``bands``: series_key, low_hz, high_hz, peak_hz, cuts, the peaks of earlier
    bands that a clear valley parts a band from.  A series has few bands.
    """
    packed = bands.groupBy("series_key").agg(F.sort_array(F.collect_list(F.struct("low_hz", "high_hz", "peak_hz", "cuts"))).alias("bs"))
    kind = "array<struct<low_hz: double, high_hz: double, peak_hz: double>>"
    band = lambda lo, hi, peak: F.struct(lo.alias("low_hz"), hi.alias("high_hz"), peak.alias("peak_hz"))

    def step(done: Column, b: Column) -> Column:
        last = F.element_at(done, -1)
        joined = (b.low_hz - last.high_hz <= F.greatest(F.lit(0.10), (last.high_hz - last.low_hz) * 0.15)) & ~F.array_contains(b.cuts, last.peak_hz)
        more = F.concat(done, F.array(band(b.low_hz, b.high_hz, b.peak_hz)))
        wider = F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(band(F.least(last.low_hz, b.low_hz), F.greatest(last.high_hz, b.high_hz), last.peak_hz)))
        return F.when(F.size(done) == 0, more).otherwise(F.when(joined, wider).otherwise(more))

    folded = packed.select("series_key", F.posexplode(F.aggregate("bs", F.array().cast(kind), step)).alias("band", "b"))
    return folded.select("series_key", (F.col("band") + 1).alias("band"), "b.*")


def valleys(spectra: DataFrame, bands: DataFrame, share: float = 0.55) -> DataFrame:
    """series_key, rank, rank2, peak_hz, valley_hz: the lowest bin between the peaks of two bands, where it is clear: strictly between, and at most a share of the smaller peak.

    ``bands``: series_key, rank (by low edge), k and peak_hz (of the peak).  A series has few bands, and each bin meets their pairs.
    """
    later = bands.select("series_key", F.col("rank").alias("rank2"), F.col("k").alias("k2"))
    pairs = bands.select("series_key", "rank", "k", "peak_hz").join(later, "series_key").where("rank < rank2 and k2 > k + 1")
    bins = spectra.select("series_key", F.col("k").alias("b"), "freq_hz", "amp")
    met = pairs.join(bins, "series_key").where("b between k and k2")
    ends = F.min(F.when((F.col("b") == F.col("k")) | (F.col("b") == F.col("k2")), F.col("amp"))).alias("small")
    out = met.groupBy("series_key", "rank", "rank2", "k", "k2", "peak_hz").agg(F.min(F.struct("amp", "b", "freq_hz")).alias("v"), ends)
    clear = (F.col("v.b") > F.col("k")) & (F.col("v.b") < F.col("k2")) & (F.col("small") > 1e-6) & (F.col("v.amp") <= share * F.col("small"))
    return out.where(clear).select("series_key", "rank", "rank2", "peak_hz", F.col("v.freq_hz").alias("valley_hz"))


def split(bands: DataFrame, cuts: DataFrame, bin_hz: float) -> DataFrame:
    """``bands`` (series_key, rank by low edge, low_hz, high_hz, others) with edges drawn back from the clear valley to the next band by a quarter bin, if that leaves the band any width."""
    w = Window.partitionBy("series_key").orderBy("rank")
    rows = bands.join(cuts.where("rank2 = rank + 1").select("series_key", "rank", "valley_hz"), ["series_key", "rank"], "left").withColumn("before", F.lag("valley_hz").over(w))
    pad = bin_hz * 0.25
    # the lower edge moves first, then the upper one is held to it
    low = F.greatest("low_hz", F.col("before") + pad)
    low = F.when(F.col("before").isNull(), F.col("low_hz")).otherwise(F.least(F.col("high_hz"), F.when(low >= F.col("high_hz"), F.greatest("low_hz", "before")).otherwise(low)))
    rows = rows.withColumn("low_hz", low)
    high = F.least("high_hz", F.col("valley_hz") - pad)
    high = F.when(F.col("valley_hz").isNull(), F.col("high_hz")).otherwise(F.greatest(F.col("low_hz"), F.when(high <= F.col("low_hz"), F.least("high_hz", "valley_hz")).otherwise(high)))
    return rows.withColumn("high_hz", high).drop("valley_hz", "before")


def fft_band_pass(packed: DataFrame, buckets: int, fps: float, low_hz: float, high_hz: float) -> DataFrame:
    """series_key, n, x from series_key, xs: the series from its bins within the band alone, batch by batch."""
    kept = np.array([low_hz <= k * fps / buckets <= high_hz for k in range(buckets // 2 + 1)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, buckets)
            y = np.fft.irfft(np.fft.rfft(x, axis=1) * kept, buckets, axis=1)
            ends = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * buckets)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(y.ravel()))], names=["series_key", "xs"])

    rows = packed.select("series_key", F.col("xs").cast("array<double>").alias("xs")).mapInArrow(run, "series_key string, xs array<double>")
    return rows.select("series_key", F.posexplode("xs").alias("n", "x"))


def correlations(series: DataFrame) -> DataFrame:
    """a, b, corr: absolute correlation of each two of a small set of series; 0 where one doesn't vary."""
    x = series.select(F.col("series_key").alias("a"), "n", F.col("x").alias("x"))
    y = series.select(F.col("series_key").alias("b"), "n", F.col("x").alias("y"))
    pairs = x.join(y, "n").where("a < b").groupBy("a", "b")
    return pairs.agg(strength("x", "y").alias("corr"))
