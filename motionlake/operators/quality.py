"""Base cells, ROI cells, their quality, supported peaks and heatmaps; relations are keyed by roi and cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import confidence_label, strength
from . import bands, series
from .grid import local_mean

#: Weights of a ROI cell's six scores, and of a ROI's.
CELL_WEIGHTS = {"texture": 0.22, "stability": 0.18, "agreement": 0.16, "relevance": 0.18, "mask": 0.12, "drift": 0.14}
ROI_WEIGHTS = {"texture": 0.18, "valid_fraction": 0.20, "agreement": 0.20, "consistency": 0.17, "mask": 0.10, "drift": 0.15}


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def weighted(value: str, weight: str) -> Column:
    """Weighted average; 0 where the weights don't pass 1e-6."""
    return F.when(F.sum(weight) > 1e-6, F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).otherwise(0.0)


def spectra_of(packed: DataFrame, keys: list[str], buckets: int, fps: float) -> DataFrame:
    """keys, k, freq_hz, amp from keys (strings without |) and xs."""
    named = series.spectrum(packed.select(F.concat_ws("|", *keys).alias("series_key"), "xs"), buckets, fps)
    return named.select(*[F.split_part("series_key", F.lit("|"), F.lit(i)).alias(k) for i, k in enumerate(keys, 1)], "k", "freq_hz", "amp")


def drift_bins(low_hz: float, bin_hz: float) -> Column:
    return (F.col("freq_hz") > 0) & (F.col("freq_hz") < max(low_hz * 0.5, bin_hz))


def energy(mask: Column | None = None) -> Column:
    e = F.col("amp") * F.col("amp")
    return F.sum(e if mask is None else F.when(mask, e).otherwise(0.0))


def base_traces(cells: DataFrame, buckets: int, fps: float) -> tuple[DataFrame, DataFrame]:
    """Traces (roi, cell, xs) and agreement (roi, cell, agreement) of cells' motion (roi, cell, xs, ys) along x, y and their main direction, weighted by strength and stability."""
    root = lambda a: F.sqrt(F.aggregate(a, F.lit(0.0), lambda t, x: t + x * x) / buckets)
    told = cells.withColumn("ex", root("xs")).withColumn("ey", root("ys"))
    norm = F.greatest(F.hypot("ex", "ey"), F.lit(1e-6))
    told = told.withColumn("ps", F.zip_with("xs", "ys", lambda x, y: (F.col("ex") * x + F.col("ey") * y) / norm))
    parts = told.select("roi", "cell", F.inline(F.array(*[F.struct(F.lit(c).alias("part"), F.col(f"{c}s").alias("xs")) for c in "xyp"])))
    bins = spectra_of(parts, ["roi", "cell", "part"], buckets, fps)
    total = energy(F.col("k") > 0)
    steady = F.when(total <= 1e-6, 0.0).otherwise(clip(1 - energy(drift_bins(1.0, fps / buckets)) / total))
    stable = bins.groupBy("roi", "cell", "part").agg(steady.alias("stable"))
    weights = parts.select("roi", "cell", "part", root("xs").alias("rms")).join(stable, ["roi", "cell", "part"])
    weights = weights.groupBy("roi", "cell").agg(*[F.max(F.when(F.col("part") == c, F.col("rms") * F.col("stable"))).alias(f"w{c}") for c in "xyp"])
    rows = told.join(weights, ["roi", "cell"])
    all_ = F.col("wx") + F.col("wy") + F.col("wp")
    mixed = F.transform("xs", lambda x, i: (F.col("wx") * x + F.col("wy") * F.get("ys", i) + F.col("wp") * F.get("ps", i)) / all_)
    traces = rows.select("roi", "cell", F.when(all_ > 1e-6, mixed).otherwise(F.col("ps")).alias("xs"))
    spelt = told.select("roi", "cell", F.inline(F.arrays_zip("xs", "ys", "ps")))
    return traces, spelt.groupBy("roi", "cell").agg(((strength("xs", "ps") + strength("ys", "ps")) / 2).alias("agreement"))


def base_metrics(spectra: DataFrame, low_hz: float, bin_hz: float) -> DataFrame:
    """roi, cell, relevance, stability, total: from spectra (roi, cell, k, freq_hz, amp)."""
    band, drift = energy(F.col("freq_hz") >= low_hz), energy(drift_bins(low_hz, bin_hz))
    relevance = F.when(energy() <= 1e-6, 0.0).otherwise(clip(band / energy()))
    return spectra.groupBy("roi", "cell").agg(relevance.alias("relevance"), clip(1 - drift / F.greatest(band + drift, F.lit(1e-6))).alias("stability"), energy().alias("total"))


def roi_traces(cells: DataFrame, traces: DataFrame) -> DataFrame:
    """roi, parent, xs: weighted mean trace of each ROI cell's base cells (roi, cell, parent, w); zeros where the weights don't pass 1e-6."""
    rows = traces.join(cells.select("roi", "cell", "parent", "w"), ["roi", "cell"]).select("roi", "parent", "w", F.posexplode("xs").alias("n", "x"))
    means = rows.groupBy("roi", "parent", "n").agg(weighted("x", "w").alias("x"))
    # a trace has a bounded number of buckets
    return means.groupBy("roi", "parent").agg(F.sort_array(F.collect_list(F.struct("n", "x"))).alias("s")).select("roi", "parent", F.col("s.x").alias("xs"))


def roi_cells(cells: DataFrame, traces: DataFrame, spectra: DataFrame, cutoff: float, low_hz: float, bin_hz: float, drift_warning: bool = False, acknowledged: bool = False) -> DataFrame:
    """roi, parent, six scores, composite, valid, hard_fail, reasons: from base cells (roi, cell, parent, w, usable, confidence, metrics) and the ROI cells' traces and spectra; scores of invalid cells are halved."""
    told = cells.groupBy("roi", "parent").agg(
        F.sum("w").alias("weights"), weighted("confidence", "w").alias("texture"), weighted("stability", "w").alias("stability"),
        weighted("agreement", "w").alias("agreement"), weighted("relevance", "w").alias("relevance"), weighted("usable", "w").alias("mask"),
    )
    band, drift = energy(F.col("freq_hz") >= low_hz), energy(drift_bins(low_hz, bin_hz))
    penalty = (0.20 if acknowledged else 0.35) if drift_warning else 0.0
    ratio = F.when(band <= 1e-6, 0.0).otherwise(clip(drift / band))
    told = told.join(spectra.groupBy("roi", "parent").agg(clip(1 - ratio - penalty).alias("drift")), ["roi", "parent"])
    strength = traces.select("roi", "parent", F.sqrt(F.aggregate("xs", F.lit(0.0), lambda t, x: t + x * x) / F.size("xs")).alias("rms"))
    told = told.join(strength, ["roi", "parent"])
    score = F.lit(0.0)
    for name, weight in CELL_WEIGHTS.items():
        score = score + weight * F.col(name)
    rules = [
        ("no_weighted_signal", F.col("weights") <= 1e-6), ("insufficient_texture", F.col("texture") < 0.08),
        ("masked_out", F.col("mask") < 0.35), ("no_usable_motion_signal", F.col("rms") <= 1e-5),
    ]
    fails = F.filter(F.array(*[F.when(cond, F.lit(code)) for code, cond in rules]), lambda x: x.isNotNull())
    told = told.withColumn("composite", clip(score)).withColumn("fails", fails).withColumn("hard_fail", F.size("fails") > 0)
    told = told.withColumn("valid", ~F.col("hard_fail") & (F.col("composite") >= max(0.30, min(0.55, cutoff * 0.8))))
    reasons = F.when(~F.col("valid") & ~F.col("hard_fail"), F.array(F.lit("quality_below_threshold"))).otherwise(F.col("fails"))
    half = F.when(F.col("valid"), 1.0).otherwise(0.5)
    return told.select("roi", "parent", *[(F.col(c) * half).alias(c) for c in (*CELL_WEIGHTS, "composite")], "valid", "hard_fail", F.array_join(reasons, ";").alias("reasons"))


def inter_cell_agreement(records: DataFrame, spectra: DataFrame) -> DataFrame:
    """roi, agreement: mean absolute correlation of the spectra of each two valid ROI cells; of one alone its component agreement, 0 without any. A ROI has few cells."""
    valid = records.where("valid").select("roi", "parent", F.col("agreement").alias("own"))
    rows = spectra.join(valid, ["roi", "parent"])
    a = rows.select("roi", F.col("parent").alias("a"), "k", F.col("amp").alias("x"))
    b = rows.select("roi", F.col("parent").alias("b"), "k", F.col("amp").alias("y"))
    pairs = a.join(b, ["roi", "k"]).where("a < b").groupBy("roi", "a", "b").agg(strength("x", "y").alias("r"))
    alone = valid.groupBy("roi").agg(F.when(F.count("*") == 1, F.max("own")).alias("own"))
    rois = records.select("roi").distinct()
    return rois.join(pairs.groupBy("roi").agg(F.avg("r").alias("r")), "roi", "left").join(alone, "roi", "left").select("roi", F.coalesce("r", "own", F.lit(0.0)).alias("agreement"))


def roi_quality(records: DataFrame, agreement: DataFrame, consistency: DataFrame | None = None) -> DataFrame:
    """roi, valid_cells, rejected_cells, agreement, overall, label, warnings; ``consistency`` (roi, consistency): mean support of reported peaks, 0 where missing."""
    means = records.groupBy("roi").agg(
        F.avg("texture").alias("texture"), F.avg("mask").alias("mask"), F.avg("drift").alias("drift"), F.avg(F.col("valid").cast("double")).alias("valid_fraction"),
        F.sum(F.col("valid").cast("long")).alias("valid_cells"), F.sum((~F.col("valid")).cast("long")).alias("rejected_cells"),
    ).join(agreement, "roi")
    means = means.withColumn("consistency", F.lit(0.0)) if consistency is None else means.join(consistency, "roi", "left").withColumn("consistency", F.coalesce("consistency", F.lit(0.0)))
    score = F.lit(0.0)
    for name, weight in ROI_WEIGHTS.items():
        score = score + weight * F.col(name)
    warnings = F.when(F.col("overall") < 0.45, "quality_below_reporting").otherwise("")
    return means.withColumn("overall", clip(score)).select("roi", "valid_cells", "rejected_cells", "agreement", "overall", confidence_label(F.col("overall")).alias("label"), warnings.alias("warnings"))


def roi_spectrum(records: DataFrame, spectra: DataFrame) -> DataFrame:
    """series_key (the roi), k, freq_hz, amp: the median over a ROI's valid cells, over all its cells without any."""
    any_ = records.groupBy("roi").agg(F.max("valid").alias("any"))
    rows = spectra.join(records.select("roi", "parent", "valid"), ["roi", "parent"]).join(any_, "roi").where("valid or not any")
    return rows.groupBy(F.col("roi").alias("series_key"), "k", "freq_hz").agg(F.percentile("amp", F.lit(0.5)).alias("amp"))


def supported_peaks(records: DataFrame, spectra: DataFrame, overall: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Reported peaks (series_key, k, freq_hz, amp, support, score, rank) of each ROI's spectrum, and the suppressed ones, whose support among valid cells is under ``least``."""
    whole = roi_spectrum(records, spectra)
    peaks = series.peaks(whole, 10)
    valid = records.where("valid").select("roi", "parent")
    cells = spectra.join(valid, ["roi", "parent"])
    every = Window.partitionBy("roi", "parent")
    at = every.orderBy("k")
    rows = cells.withColumn("last", F.max("k").over(every)).withColumn("p", F.lag("amp").over(at)).withColumn("q", F.lead("amp").over(at))
    first = (F.col("k") - 1 < 1) | (F.col("amp") > F.col("p"))
    high = (F.col("k") + 1 > F.col("last") - 1) | (F.col("amp") >= F.col("q"))
    hits = rows.withColumn("hit", (F.col("k").between(1, F.col("last") - 1) & (F.col("amp") > 0) & first & high).cast("double")).groupBy(F.col("roi").alias("series_key"), "k").agg(F.avg("hit").alias("support"))
    # without valid cells there are no supported peaks
    found = peaks.drop("rank").join(hits, ["series_key", "k"]).join(overall.select(F.col("roi").alias("series_key"), "overall"), "series_key")
    found = found.withColumn("top", F.max("amp").over(Window.partitionBy("series_key")))
    share = F.when(F.col("top") <= 1e-6, 0.0).otherwise(F.col("amp") / F.col("top"))
    found = found.withColumn("score", clip(0.55 * share + 0.35 * F.col("support") + 0.10 * F.col("overall"))).drop("top", "overall")
    ranked = found.where(F.col("support") >= least).withColumn("rank", F.row_number().over(Window.partitionBy("series_key").orderBy(F.desc("score"), F.desc("amp"), "k")))
    return ranked, found.where(F.col("support") < least)


def localization(bands_: DataFrame, records: DataFrame, spectra: DataFrame) -> DataFrame:
    """series_key, band, localization: how far a band's energy, weighted by quality, gathers in few of the valid ROI cells."""
    rows = spectra.join(records.where("valid").select("roi", "parent", "composite"), ["roi", "parent"])
    met = bands_.join(rows, bands_.series_key == rows.roi).where("freq_hz between low_hz and high_hz")
    cells = met.groupBy("series_key", "band", "parent").agg((F.sum(F.col("amp") * F.col("amp")) * F.greatest(F.first("composite"), F.lit(0.05))).alias("e")).where("e > 1e-12")
    nth = F.row_number().over(Window.partitionBy("series_key", "band").orderBy(F.desc("e")))
    told = cells.withColumn("nth", nth).groupBy("series_key", "band").agg(F.count("*").alias("n"), F.avg("e").alias("mean"), F.avg(F.when(F.col("nth") <= 3, F.col("e"))).alias("top"), F.percentile("e", F.lit(0.95)).alias("p95"))
    part = lambda c: clip((F.col(c) / F.col("mean") - 1) / 6)
    value = F.when((F.col("n") > 1) & (F.col("mean") > 1e-12), 0.55 * part("top") + 0.45 * part("p95")).otherwise(0.0)
    return bands_.select("series_key", "band").join(told.select("series_key", "band", value.alias("localization")), ["series_key", "band"], "left").fillna(0.0, ["localization"])


def resolved_bands(found: DataFrame, peak_scores: DataFrame, local: DataFrame, peaks: DataFrame, low_hz: float, high_hz: float, count: int) -> DataFrame:
    """series_key, band, low_hz, high_hz, peak_hz, display_score: the best ``count`` of merged bands, and one over the whole range if there is room and the peaks are spread widely."""
    span = max(high_hz - low_hz, 1e-6)
    width = F.greatest(F.col("high_hz") - F.col("low_hz"), F.lit(1e-6))
    special = clip(1 - width / F.greatest(F.lit(span), width))
    rows = found.join(peak_scores, ["series_key", "band"]).join(local, ["series_key", "band"])
    score = 0.45 * F.col("peak_score") + 0.40 * F.col("localization") + 0.15 * special - F.when(F.col("peak_hz").isNull(), 0.25).otherwise(0.0)
    rows = rows.select("series_key", "low_hz", "high_hz", "peak_hz", score.alias("display_score"), F.lit(0).alias("cover"), F.col("band").alias("old"))
    spread = peaks.groupBy("series_key").agg(F.count("*").alias("n"), (F.max("freq_hz") - F.min("freq_hz")).alias("spread"))
    wide = spread.where(F.lit(span >= 1.5) & (F.col("n") >= 3) & (F.col("spread") >= max(1.0, span * 0.35)))
    wide = wide.select("series_key", F.lit(low_hz).alias("low_hz"), F.lit(high_hz).alias("high_hz"), F.lit(None).cast("double").alias("peak_hz"), F.lit(None).cast("double").alias("display_score"), F.lit(1).alias("cover"), F.lit(0).alias("old"))
    order = Window.partitionBy("series_key").orderBy("cover", F.desc("display_score"), "old")
    return rows.unionByName(wide).withColumn("band", F.row_number().over(order)).where(F.col("band") <= count).drop("cover", "old")


def parent_quality(records: DataFrame) -> DataFrame:
    """roi, parent, parent_quality: a ROI cell's quality for heatmaps."""
    score = clip(0.45 * F.col("composite") + 0.20 * F.col("stability") + 0.15 * F.col("agreement") + 0.20 * F.col("relevance"))
    score = score * F.when(F.col("valid"), 1.0).otherwise(0.6) * F.when(F.col("hard_fail"), 0.5).otherwise(1.0)
    return records.select("roi", "parent", clip(score, 0.05).alias("parent_quality"))


def heatmaps(cells: DataFrame, spectra: DataFrame, records: DataFrame, bands_: DataFrame, least_confidence: float) -> DataFrame:
    """roi, band, cell, row, col, value, band_energy, quality, confidence, reason: for each band (series_key, band, low_hz, high_hz) and base cell; reason is null for valid cells, and a cell outside the ROI has nothing else."""
    fit = F.col("usable") >= 0.35
    base = cells.withColumn("in_roi", F.col("roi_fraction") > 0)
    told = base.groupBy("roi").agg(F.count(F.when(F.col("in_roi") & fit, 1)).alias("n"), F.percentile(F.when(F.col("in_roi") & fit, F.col("confidence")), F.lit(0.70)).alias("p70"))
    told = told.select("roi", F.when(F.col("n") < 4, F.lit(least_confidence)).otherwise(F.least(F.lit(least_confidence), F.greatest(F.lit(0.08), F.col("p70") * 0.85))).alias("threshold"))
    base = base.join(told, "roi")
    counts = F.when(F.col("in_roi") & fit & (F.col("confidence") >= F.col("threshold")) & (F.col("total") > 1e-8), F.col("total"))
    floors = base.groupBy("roi").agg(F.count(counts).alias("n"), F.percentile(counts, F.lit(0.75)).alias("p75"))
    floors = floors.select("roi", F.when(F.col("n") < 4, 0.0).otherwise(F.greatest(F.col("p75") * 0.05, F.lit(1e-8))).alias("floor"))
    base = base.join(floors, "roi").join(parent_quality(records), ["roi", "parent"], "left")
    local = clip(0.55 * F.coalesce("parent_quality", F.lit(0.50)) + 0.25 * F.col("stability") + 0.20 * F.col("agreement"))
    base = base.withColumn("quality", clip(local * F.greatest("usable", F.lit(0.10)), 0.05))
    shapes = bands_.select(F.col("series_key").alias("roi"), "band", "low_hz", "high_hz")
    met = base.join(shapes, "roi").join(spectra.select("roi", "cell", "freq_hz", "amp"), ["roi", "cell"])
    inside = F.sum(F.when(F.col("freq_hz").between(F.col("low_hz"), F.col("high_hz")), F.col("amp") * F.col("amp")).otherwise(0.0))
    rows = met.groupBy("roi", "band", "cell", "row", "col", "in_roi", "usable", "confidence", "threshold", "floor", "total", "quality").agg(inside.alias("e"))
    reason = (
        F.when(~F.col("in_roi"), "outside_roi").when(~fit, "masked_out").when(F.col("confidence") < F.col("threshold"), "low_confidence").when(F.col("total") < F.col("floor"), "weak_signal")
    )
    value = F.when(F.col("total") <= 1e-6, 0.0).otherwise(F.col("e") / F.col("total"))
    held = lambda c: F.when(F.col("in_roi"), c)
    return rows.select("roi", "band", "cell", "row", "col", held(value).alias("value"), held(F.col("e")).alias("band_energy"), held(F.col("quality")).alias("quality"), held(F.greatest("confidence", F.lit(0.0))).alias("confidence"), reason.alias("reason"))


def heatmap_scale(maps: DataFrame) -> DataFrame:
    """roi, display_min, display_max, energy_min, energy_max, clipped: 5th to 95th percentiles over the valid cells of all bands; clipped counts valid cells beyond."""
    ok = F.col("reason").isNull()
    q = lambda c, p: F.percentile(F.when(ok, F.col(c)), F.lit(p))
    told = maps.groupBy("roi").agg(q("value", 0.05).alias("lo"), q("value", 0.95).alias("hi"), q("band_energy", 0.05).alias("elo"), q("band_energy", 0.95).alias("ehi"))
    told = told.select(
        "roi", F.coalesce("lo", F.lit(0.0)).alias("display_min"), F.when(F.col("lo").isNull(), 1.0).otherwise(F.when(F.col("hi") <= F.col("lo"), F.col("lo") + 1e-6).otherwise(F.col("hi"))).alias("display_max"),
        F.coalesce("elo", F.lit(0.0)).alias("energy_min"), F.when(F.col("elo").isNull(), 1.0).otherwise(F.when(F.col("ehi") <= F.col("elo"), F.col("elo") + 1e-12).otherwise(F.col("ehi"))).alias("energy_max"),
    )
    beyond = maps.where(ok).join(told, "roi").groupBy("roi").agg(F.sum(((F.col("value") < F.col("display_min")) | (F.col("value") > F.col("display_max"))).cast("long")).alias("clipped"))
    return told.join(beyond, "roi", "left").fillna(0, ["clipped"])


def salience(maps: DataFrame, scale: DataFrame) -> DataFrame:
    """roi, band, cell, salience: energy seen through dominance, support of neighbours, quality and confidence."""
    grid = maps.select(F.concat_ws("|", "roi", "band").alias("grid_id"), "row", "col", (clip(F.col("value")) * clip(F.col("quality"))).alias("value"))
    support = local_mean(grid).withColumnRenamed("grid_id", "g").withColumnRenamed("row", "r").withColumnRenamed("col", "c")
    rows = maps.where("value is not null").join(scale, "roi")
    rows = rows.join(support, (F.concat_ws("|", "roi", "band") == F.col("g")) & (F.col("row") == F.col("r")) & (F.col("col") == F.col("c")))
    power = F.sqrt(clip((F.col("band_energy") - F.col("energy_min")) / F.greatest(F.col("energy_max") - F.col("energy_min"), F.lit(1e-12))))
    seen, quality, sure = F.sqrt(clip(F.col("value"))), F.sqrt(clip(F.col("quality"))), F.sqrt(clip(F.col("confidence")))
    value = power * (0.12 + 0.36 * seen + 0.30 * F.sqrt(clip(F.col("support"))) + 0.22 * quality) * sure * quality
    return rows.select("roi", "band", "cell", value.alias("salience"))


def overlay(rows: DataFrame) -> DataFrame:
    """``rows`` (value, salience, reason, ...) with alpha: how much of the heatmap's colour covers the picture."""
    seen = 0.20 + 0.80 * F.col("salience")
    colour = (0.14 + 0.56 * F.col("value")) * seen
    gray = (0.12 + 0.14 * F.col("value")) * seen
    return rows.withColumn("alpha", F.least(F.when(F.col("reason").isNull(), colour).otherwise(gray), F.lit(0.82)))


def merged_bands(spectra: DataFrame, peaks: DataFrame, bin_hz: float, low_hz: float, high_hz: float) -> DataFrame:
    """series_key, band, low_hz, high_hz, peak_hz: edges around peaks (series_key, rank, k, freq_hz, amp), split at clear valleys, held to the range and merged."""
    peak = F.col("k") * bin_hz
    low, high = bands.widths(F.col("k_low") * bin_hz, F.col("k_high") * bin_hz, peak, bin_hz, low_hz, high_hz)
    found = bands.edges(spectra, peaks, 0.45, 1).select("series_key", "k", peak.alias("peak_hz"), low.alias("low_hz"), high.alias("high_hz"))
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("series_key").orderBy("low_hz", "k")))
    cuts = bands.valleys(spectra, found)
    parted = cuts.groupBy("series_key", F.col("rank2").alias("rank")).agg(F.collect_set("peak_hz").alias("cuts"))
    pieces = bands.split(found, cuts, bin_hz)
    low, high = bands.clamp(F.col("low_hz"), F.col("high_hz"), F.col("peak_hz"), low_hz, high_hz)
    pieces = pieces.select("series_key", "rank", "peak_hz", low.alias("low_hz"), high.alias("high_hz"))
    return bands.merged(pieces.join(parted, ["series_key", "rank"], "left").withColumn("cuts", F.coalesce("cuts", F.array().cast("array<double>"))))
