"""A frequency band suggested from motion traces (roi, cell, xs), their weights and places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import band_edge
from . import bands, series
from .quality import clip, spectra_of


def prepared(traces: DataFrame) -> DataFrame:
    """roi, cell, xs: traces smoothed and centred; short and flat ones are left out."""
    rows = traces.select(F.concat_ws("|", "roi", "cell").alias("series_key"), F.posexplode("xs").alias("n", "x"))
    packed = series.arrays(series.smooth5(rows))
    return packed.select(F.split_part("series_key", F.lit("|"), F.lit(1)).alias("roi"), F.split_part("series_key", F.lit("|"), F.lit(2)).alias("cell"), "xs")


def differences(traces: DataFrame) -> DataFrame:
    """The same of first differences; the first is 0."""
    return traces.withColumn("xs", F.transform("xs", lambda x, i: x - F.coalesce(F.get("xs", i - 1), x)))


def sway(freq: Column, support: Column) -> Column:
    """How far a slow peak looks like the whole frame swaying."""
    return clip((support - 0.80) / 0.15) * clip((0.65 - freq) / 0.30)


def suspicious(freq: Column, ubiquity: Column, edge: Column, support: Column, sharp: Column) -> Column:
    return (freq < 0.85) & ((ubiquity >= 0.12) | (edge >= 0.55) | ((support >= 0.60) & (sharp < 0.18)))


def searched(traces: DataFrame, places: DataFrame, buckets: int, fps: float, low_hz: float, high_hz: float) -> tuple[DataFrame, DataFrame]:
    """Bins of each trace (roi, cell, k, freq_hz, amp, damp, w, edge, whole) within the range, k from 0; and of each roi (series_key, k, freq_hz, amp, damp), by the traces' weights."""
    smooth = prepared(traces)
    bins = spectra_of(smooth, ["roi", "cell"], buckets, fps).join(
        spectra_of(differences(smooth), ["roi", "cell"], buckets, fps).select("roi", "cell", "k", F.col("amp").alias("damp")), ["roi", "cell", "k"]
    ).where(F.col("freq_hz").between(low_hz, high_hz))
    first = min(k for k in range(buckets // 2 + 1) if k * fps / buckets >= low_hz)
    cells = bins.withColumn("k", F.col("k") - first).join(places, ["roi", "cell"])
    mean = lambda c: (F.sum(F.col(c) * F.col("w")) / F.sum("w")).alias(c)
    return cells, cells.groupBy(F.col("roi").alias("series_key"), "k", "freq_hz").agg(mean("amp"), mean("damp"))


def candidates(cells: DataFrame, whole: DataFrame, bin_hz: float, bins: int) -> DataFrame:
    """series_key, k, freq_hz, amp and the features and score of each local peak of a roi's spectrum."""
    peaks = bands.peaks_bb(whole)
    key = ["series_key", "k"]
    near = Window.partitionBy("series_key").orderBy("k").rowsBetween(-2, 2)
    every = Window.partitionBy("series_key")
    told = whole.select(
        *key, "damp", F.max("amp").over(every).alias("top"), F.max("damp").over(every).alias("dtop"), F.percentile("amp", F.lit(0.5)).over(every).alias("median"),
        clip(1 - F.avg("amp").over(near) / F.greatest("amp", F.lit(1e-6))).alias("sharpness"),
    )
    # of each trace: the highest bin next to a peak, against its own median and highest
    mine = Window.partitionBy("roi", "cell")
    local = cells.withColumn("peak", F.max("amp").over(mine.orderBy("k").rowsBetween(-1, 1))).withColumn("cmax", F.max("amp").over(mine)).withColumn("cmed", F.percentile("amp", F.lit(0.5)).over(mine))
    backs = (F.col("peak") >= F.greatest(F.col("cmed") * 1.8, F.col("cmax") * 0.45)).cast("double")
    weight, power = F.greatest("cmax", F.lit(1e-6)), F.col("peak") * F.greatest("w", F.lit(1e-6))
    own = F.when(~F.col("whole"), power)
    share = lambda of: F.sum(F.when(F.col("edge"), of)) / F.greatest(F.sum(of), F.lit(1e-6))
    edge = F.coalesce(F.when(F.max(~F.col("whole")), share(own)).otherwise(share(power)), F.lit(0.0))
    spread = local.groupBy(F.col("roi").alias("series_key"), "k").agg((F.sum(backs * weight) / F.sum(weight)).alias("support"), edge.alias("edge"))
    rows = peaks.join(told, key).join(spread, key).join(bands.prominence(whole, peaks, bins), key).join(bands.harmonic_bonus(peaks, bin_hz), key)
    rows = rows.withColumn("period", F.when(F.col("dtop") > 1e-6, F.col("damp") / F.col("dtop")).otherwise(0.0)).withColumn("ubiquity", sway(F.col("freq_hz"), F.col("support")))
    score = (
        0.55 * F.col("amp") / F.greatest("top", F.lit(1e-6)) + 0.20 * F.col("support") + 0.15 * F.col("prominence") / F.greatest("amp", F.lit(1e-6)) + 0.10 * F.col("bonus")
        + 0.08 * F.col("period") + 0.08 * F.col("sharpness") + 0.10 * (1 - F.col("edge")) - 0.18 * F.col("ubiquity")
    )
    return rows.where("top > 1e-6").select(*key, "freq_hz", "amp", "median", "prominence", "support", "sharpness", "period", "bonus", "ubiquity", "edge", score.alias("score"))


def chosen(found: DataFrame) -> DataFrame:
    """The best candidate of each series; a slow one gives way to a clearly sharper, faster one that scores about the same. A series has few peaks."""
    top = found.groupBy("series_key").agg(F.max(F.struct("score", (-F.col("k")).alias("o"), "k")).alias("t")).select("series_key", F.col("t.k").alias("k"))
    best = found.join(top, ["series_key", "k"])
    b = best.select(*[F.col(c).alias(c if c == "series_key" else f"b_{c}") for c in best.columns])
    other = found.join(b, "series_key").where(
        (F.col("b_freq_hz") < 0.5) & (F.col("freq_hz") >= F.greatest(F.lit(0.5), F.col("b_freq_hz") * 1.4)) & (F.col("score") >= F.col("b_score") - 0.03) & (F.col("sharpness") >= F.col("b_sharpness") + 0.05)
        & (F.col("period") >= F.col("b_period") + 0.08) & (F.col("edge") <= F.col("b_edge") - 0.05)
    )
    other = other.groupBy("series_key").agg(F.max(F.struct("score", "sharpness", "period", "freq_hz", "k")).alias("t")).select("series_key", F.col("t.k").alias("other"))
    picked = top.join(other, "series_key", "left").select("series_key", F.coalesce("other", "k").alias("k"))
    return found.join(picked, ["series_key", "k"])


def tightened(rows: DataFrame, low_hz: float, high_hz: float) -> DataFrame:
    """``rows`` with edges drawn in around periodic and around well supported slow candidates."""
    freq = F.col("freq_hz")
    half = F.when(freq >= 0.5, F.when((F.col("period") >= 0.40) | (F.col("sharpness") >= 0.20), F.least(F.lit(0.18), F.greatest(F.lit(0.12), freq * 0.22)))).when(
        (F.col("edge") <= 0.55) & (F.col("support") >= 0.55) & (F.col("sharpness") >= 0.12), F.least(F.lit(0.14), F.greatest(F.lit(0.10), freq * 0.34))
    )
    now = half.isNotNull() & (F.col("high") - F.col("low") > half * 2)
    a, b = F.when(now, F.greatest(F.lit(low_hz), freq - half)).otherwise(F.col("low")), F.when(now, F.least(F.lit(high_hz), freq + half)).otherwise(F.col("high"))
    return rows.withColumns({"low": a, "high": b})


def suggested(found: DataFrame, whole: DataFrame, bin_hz: float, first_hz: float, low_hz: float, high_hz: float) -> DataFrame:
    """series_key, low_hz, high_hz, peak_hz, confidence: the chosen candidate's band, wider upwards where a slow one has a faster family behind it."""
    walked = bands.edges(whole, found.withColumn("rank", F.col("k")), 0.50, 0)
    low, high = bands.suggested_widths(F.col("k_low") * bin_hz + first_hz, F.col("k_high") * bin_hz + first_hz, F.col("k") * bin_hz + first_hz, bin_hz, low_hz, high_hz)
    banded = tightened(found.join(walked.select("series_key", "k", low.alias("low"), high.alias("high")), ["series_key", "k"]), low_hz, high_hz)
    best = banded.join(chosen(found).select("series_key", "k"), ["series_key", "k"])
    b = best.select(*[F.col(c).alias(c if c == "series_key" else f"b_{c}") for c in best.columns])
    more = banded.join(b, "series_key").where(
        (F.col("b_freq_hz") < 0.5) & (F.col("b_edge") <= 0.60) & ((F.col("b_ubiquity") >= 0.10) | (F.col("b_support") >= 0.75))
        & (F.col("freq_hz") >= F.greatest(F.lit(0.5), F.col("b_freq_hz") * 1.4)) & (F.col("freq_hz") <= F.greatest(F.lit(0.85), F.col("b_freq_hz") * 2.8)) & (F.col("score") >= F.col("b_score") - 0.20)
        & (F.col("support") >= 0.30) & (F.col("period") >= F.greatest(F.lit(0.35), F.col("b_period"))) & (F.col("edge") <= F.col("b_edge") + 0.10)
    )
    more = more.groupBy("series_key").agg(F.max(F.struct("freq_hz", "score", "period", "sharpness", "high")).alias("m")).select("series_key", F.col("m.high").alias("wider"))
    sure = clip(
        0.45 * F.col("support") + 0.35 * F.col("prominence") / F.greatest("amp", F.lit(1e-6)) + 0.20 * (F.col("amp") - F.col("median")) / F.greatest("amp", F.lit(1e-6))
        + 0.08 * F.col("period") + 0.05 * F.col("sharpness") + 0.08 * (1 - F.col("edge")) - 0.10 * F.col("ubiquity")
    )
    high = F.greatest("high", F.coalesce("wider", "high"))
    return best.join(more, "series_key", "left").select("series_key", band_edge(F.col("low")).alias("low_hz"), band_edge(high).alias("high_hz"), F.col("freq_hz").alias("peak_hz"), sure.alias("confidence"))


def fallback(seconds: Column, fps: Column) -> tuple[Column, Column]:
    """The band where nothing is found: from two periods in the clip."""
    low = band_edge(F.greatest(F.lit(0.15), F.greatest(F.lit(0.1), 2 / F.greatest(seconds, F.lit(1.0)))))
    return low, band_edge(F.least(fps / 2 * 0.7, F.greatest(low + 0.35, low * 2.5)))


#: Bands that are tried besides the suggested one, and how far one must win to be taken.
TRIED = ((0.50, 1.50), (0.75, 2.50), (1.00, 5.00), (1.50, 5.00), (2.00, 6.00))
WIN_RATIO, WIN_MARGIN, FAST_HZ = 1.08, 0.02, 0.95


def tried(suggestions: DataFrame, low_hz: float, high_hz: float) -> DataFrame:
    """series_key, low_hz, high_hz: the suggested band of each series and the fixed ones, held within the range, without narrow and repeated ones."""
    band = lambda low, high: F.struct(F.greatest(F.lit(low_hz), F.least(F.lit(high_hz), low)).alias("low"), F.greatest(F.lit(low_hz), F.least(F.lit(high_hz), high)).alias("high"))
    every = F.array(band(F.col("low_hz"), F.col("high_hz")), *[band(F.lit(lo), F.lit(hi)) for lo, hi in TRIED])
    rows = suggestions.select("series_key", F.inline(every)).where("high > low + 0.10D")
    return rows.select("series_key", band_edge(F.col("low")).alias("low_hz"), band_edge(F.col("high")).alias("high_hz")).distinct()


def promoted(suggestions: DataFrame, picked: DataFrame, scores: DataFrame) -> DataFrame:
    """Suggestions (series_key, low_hz, high_hz, peak_hz, confidence) with promoted: where the candidate behind one (``picked``) is suspicious, a faster band takes its place whole if it scores clearly better.

    ``scores``: series_key, low_hz, high_hz, score of the bands that were
    ``tried``; a suggested band without a score counts as 0.  A series has a
    handful of them.  Ties go to the band that reaches higher, then lower down.
    """
    doubted = picked.where(suspicious(*[F.col(c) for c in ("freq_hz", "ubiquity", "edge", "support", "sharpness")])).select("series_key", F.lit(True).alias("doubted"))
    same = (F.abs(F.col("s_low") - F.col("low_hz")) <= 1e-6) & (F.abs(F.col("s_high") - F.col("high_hz")) <= 1e-6)
    met = scores.select("series_key", F.col("low_hz").alias("s_low"), F.col("high_hz").alias("s_high"), "score").join(suggestions.select("series_key", "low_hz", "high_hz"), "series_key")
    fast = F.when(F.col("s_low") >= FAST_HZ, F.struct("score", F.col("s_high").alias("high"), (-F.col("s_low")).alias("minus_low")))
    best = met.groupBy("series_key").agg(F.coalesce(F.max(F.when(same, F.col("score"))), F.lit(0.0)).alias("own"), F.max(fast).alias("fast"))
    rows = suggestions.join(doubted, "series_key", "left").join(best, "series_key", "left")
    score, low, high = F.col("fast.score"), -F.col("fast.minus_low"), F.col("fast.high")
    takes = F.coalesce(F.col("doubted") & (score >= F.greatest(F.col("own") * WIN_RATIO, F.col("own") + WIN_MARGIN)), F.lit(False))
    or_ = lambda new, old: F.when(takes, new).otherwise(F.col(old)).alias(old)
    surer = clip(F.greatest(F.col("confidence"), F.col("confidence") + 0.12 + score - F.col("own")))
    return rows.select("series_key", or_(band_edge(low), "low_hz"), or_(band_edge(high), "high_hz"), or_((low + high) / 2, "peak_hz"), or_(surer, "confidence"), takes.alias("promoted"))


def or_fallback(series_keys: DataFrame, suggestions: DataFrame, seconds: float, fps: float) -> DataFrame:
    """A suggestion for each series (series_key): those without a candidate get the band of the clip's length, with no confidence."""
    low, high = fallback(F.lit(seconds), F.lit(fps))
    rows = series_keys.select("series_key").distinct().join(suggestions, "series_key", "left")
    return rows.select("series_key", F.coalesce("low_hz", low).alias("low_hz"), F.coalesce("high_hz", high).alias("high_hz"), F.coalesce("peak_hz", low).alias("peak_hz"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.coalesce("promoted", F.lit(False)).alias("promoted"))
