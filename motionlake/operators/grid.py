"""Operators on grids (grid_id, row, col, value) and points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confidence(grid: DataFrame, quantile: float, floor: float, curve: str) -> DataFrame:
    """Weights of cells: value over a high quantile of the positive ones, a soft floor, then a transfer curve.

    Curve ``render`` is half the root plus half g^2 (3 - 2g); ``analysis`` is the root.
    """
    edges = grid.where("value > 0").groupBy("grid_id").agg(F.percentile("value", F.lit(quantile)).alias("edge"), F.max("value").alias("most"))
    ratio = F.least(F.greatest(F.col("value") / F.when(F.col("edge") > 1e-6, F.col("edge")).otherwise(F.col("most")), F.lit(0.0)), F.lit(1.0))
    g = F.least(F.greatest((ratio - floor) / (1 - floor), F.lit(0.0)), F.lit(1.0))
    joined = grid.join(edges, "grid_id", "left").withColumn("g", F.when(F.col("most") > 1e-6, g).otherwise(F.lit(0.0)))
    weight = F.sqrt("g") if curve == "analysis" else 0.5 * F.sqrt("g") + 0.5 * F.col("g") * F.col("g") * (3 - 2 * F.col("g"))
    return joined.select("grid_id", "row", "col", weight.alias("weight"))


def local_mean(grid: DataFrame) -> DataFrame:
    """Mean of the finite cells among a cell and its eight neighbours, 0 where the cell itself has no finite value: each cell is sent to the nine it counts for."""
    value = F.when(~F.isnan("value") & (F.abs("value") < float("inf")), F.col("value"))
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    own = (F.col("o.i") == 0) & (F.col("o.j") == 0)
    sent = grid.withColumn("value", value).withColumn("o", F.explode(offsets)).select("grid_id", (F.col("row") + F.col("o.i")).alias("row"), (F.col("col") + F.col("o.j")).alias("col"), "value", own.alias("own"))
    met = sent.groupBy("grid_id", "row", "col").agg(F.avg("value").alias("support"), F.max("own").alias("own"), F.max(F.when(F.col("own"), F.col("value").isNotNull())).alias("there")).where("own")
    return met.select("grid_id", "row", "col", F.when(F.col("there"), F.col("support")).otherwise(0.0).alias("support"))


def mean_pool(grid: DataFrame, size: int) -> DataFrame:
    return grid.groupBy("grid_id", F.floor(F.col("row") / size).cast("int").alias("row"), F.floor(F.col("col") / size).cast("int").alias("col")).agg(F.avg("value").alias("value"))


def trimmed(grid: DataFrame, share: float = 0.08) -> DataFrame:
    """A grid without a share of its rows and columns at each border, cut to even sizes, counted from 0."""
    ends = grid.groupBy("grid_id").agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))

    def span(lo: str, hi: str) -> tuple[Column, Column]:
        size = F.col(hi) - F.col(lo) + 1
        cut = F.floor(size * share)
        return F.col(lo) + cut, F.floor((size - 2 * cut) / 2) * 2

    (top, rows), (left, cols) = span("r0", "r1"), span("c0", "c1")
    moved = grid.join(ends, "grid_id").select("grid_id", (F.col("row") - top).cast("int").alias("row"), (F.col("col") - left).cast("int").alias("col"), "value", rows.alias("h"), cols.alias("w"))
    return moved.where("row >= 0 and col >= 0 and row < h and col < w").drop("h", "w")


def gradient(grid: DataFrame) -> DataFrame:
    """Magnitude of central differences (not halved); along an axis where a neighbour is missing, as on borders, the difference is 0."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 0), (-1, 0), (1, 0), (0, -1), (0, 1))])
    sent = grid.withColumn("o", F.explode(steps)).select("grid_id", (F.col("row") - F.col("o.i")).alias("row"), (F.col("col") - F.col("o.j")).alias("col"), "o", "value")
    axis = lambda c, other: F.when(F.count(F.when(F.col(f"o.{c}") != 0, 1)) == 2, F.sum(F.when(F.col(f"o.{c}") != 0, F.col("value") * F.col(f"o.{c}")))).otherwise(0.0)
    met = sent.groupBy("grid_id", "row", "col").agg(axis("i", "j").alias("dy"), axis("j", "i").alias("dx"), F.max((F.col("o.i") == 0) & (F.col("o.j") == 0)).alias("own"))
    return met.where("own").select("grid_id", "row", "col", F.hypot("dy", "dx").alias("magnitude"))


def resize(grid: DataFrame, height: int, width: int) -> DataFrame:
    """Bilinear, corners aligned: each target cell lies between four cells of the grid, found by equal row and column; where one is missing, there is none."""
    ends = grid.groupBy("grid_id").agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    target = ends.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(height - 1)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    y = F.col("row") * (F.col("r1") - F.col("r0")) / max(height - 1, 1)
    x = F.col("col") * (F.col("c1") - F.col("c0")) / max(width - 1, 1)
    placed = target.select("grid_id", "row", "col", "r0", "r1", "c0", "c1", F.floor(y).cast("int").alias("y0"), F.floor(x).cast("int").alias("x0"), (y - F.floor(y)).alias("wy"), (x - F.floor(x)).alias("wx"))
    taps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (0, 1) for j in (0, 1)])
    sent = placed.withColumn("o", F.explode(taps)).select(
        "grid_id", "row", "col", F.least(F.col("y0") + F.col("o.i") + F.col("r0"), F.col("r1")).alias("y"), F.least(F.col("x0") + F.col("o.j") + F.col("c0"), F.col("c1")).alias("x"),
        (F.when(F.col("o.i") == 1, F.col("wy")).otherwise(1 - F.col("wy")) * F.when(F.col("o.j") == 1, F.col("wx")).otherwise(1 - F.col("wx"))).alias("w"),
    )
    cells = grid.select("grid_id", F.col("row").alias("y"), F.col("col").alias("x"), "value")
    return sent.join(cells, ["grid_id", "y", "x"]).groupBy("grid_id", "row", "col").agg(F.sum(F.col("w") * F.col("value")).alias("value"), F.count("value").alias("c")).where("c = 4").drop("c")


def weighted_mean(rows: DataFrame, keys: list[str], value: Column, weight: Column) -> DataFrame:
    """Weighted mean; 0 where the weights don't pass 1e-6."""
    total = F.sum(weight)
    return rows.groupBy(*keys).agg(F.when(total > 1e-6, F.sum(value * weight) / total).otherwise(F.lit(0.0)).alias("mean"))


def adaptive_threshold(grid: DataFrame, threshold: float) -> DataFrame:
    """A floor of the values (a twentieth of their upper quartile) and a threshold that a grid of low values lowers."""
    stats = grid.groupBy("grid_id").agg(F.count("*").alias("n"), F.percentile("value", F.lit(0.75)).alias("p75"), F.percentile("value", F.lit(0.70)).alias("p70"))
    few = F.col("n") < 4
    return stats.select(
        "grid_id", F.when(few, 0.0).otherwise(F.greatest(F.col("p75") * 0.05, F.lit(1e-8))).alias("floor"),
        F.when(few, threshold).otherwise(F.least(F.lit(threshold), F.greatest(F.lit(0.08), F.col("p70") * 0.85))).alias("threshold"),
    )


def in_zone(zone: dict, x: Column, y: Column) -> Column:
    if zone["shape"] == "circle":
        return F.hypot(x - zone["x"], y - zone["y"]) <= zone["radius"]
    return x.between(zone["x"], zone["x"] + zone["width"]) & y.between(zone["y"], zone["y"] + zone["height"])


def effective(zones: list[dict], x: Column, y: Column, frame: tuple[float, float] | None = None, roi: dict | None = None) -> Column:
    """In some include zone (without any, in the frame), in the ROI if there is one, and in no exclude zone. Zones are a short parameter."""
    includes = [z for z in zones if z["mode"] == "include"]
    inside, outside = F.lit(not includes), F.lit(False)
    if not includes and frame:
        inside = x.between(0, frame[0]) & y.between(0, frame[1])
    for z in zones:
        if z["mode"] == "include":
            inside = inside | in_zone(z, x, y)
        else:
            outside = outside | in_zone(z, x, y)
    return inside & (in_zone(roi, x, y) if roi else F.lit(True)) & ~outside


def feathered(zone: dict, x: Column, y: Column, feather: float) -> Column:
    """1 in a zone, falling to 0 over ``feather`` beyond it."""
    if feather <= 0:
        raise ValueError("feather must be positive")
    if zone["shape"] == "circle":
        far = F.hypot(x - zone["x"], y - zone["y"]) - zone["radius"]
    else:
        dx = F.greatest(zone["x"] - x, x - zone["x"] - zone["width"], F.lit(0.0))
        dy = F.greatest(zone["y"] - y, y - zone["y"] - zone["height"], F.lit(0.0))
        far = F.hypot(dx, dy)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.greatest(far, F.lit(0.0)) / feather))


def exclusion(zones: list[dict], x: Column, y: Column, feather: float) -> Column:
    """How far a point is left as it was: 1 less the highest include zone, if there are any, or the highest exclude zone."""
    mode = lambda m: [feathered(z, x, y, feather) for z in zones if z["mode"] == m]
    highest = lambda cols: F.greatest(F.lit(0.0), *cols)
    includes, excludes = mode("include"), mode("exclude")
    return F.greatest(1 - highest(includes) if includes else F.lit(0.0), highest(excludes))


def coverage(cells: DataFrame, roi: dict, zones: list[dict], frame: tuple[float, float]) -> DataFrame:
    """``cells`` (x, y, width, height; others) with roi_fraction, usable_fraction, excluded_fraction of 5 x 5 samples of each cell."""
    i = F.explode(F.sequence(F.lit(0), F.lit(4)))
    rows = cells.withColumn("si", i).withColumn("sj", i)
    px, py = F.col("x") + 0.5 + F.col("si") * (F.col("width") - 1) / 4, F.col("y") + 0.5 + F.col("sj") * (F.col("height") - 1) / 4
    includes = [z for z in zones if z["mode"] == "include"]
    told = rows.withColumn("nominal", effective(includes, px, py, frame, roi)).withColumn("usable", effective(zones, px, py, frame, roi))
    out = told.groupBy(*cells.columns).agg(F.avg(F.col("nominal").cast("double")).alias("roi_fraction"), F.avg(F.col("usable").cast("double")).alias("usable_fraction"))
    lost = F.when(F.col("roi_fraction") <= 1e-6, 1.0).otherwise(F.least(F.greatest((F.col("roi_fraction") - F.col("usable_fraction")) / F.col("roi_fraction"), F.lit(0.0)), F.lit(1.0)))
    return out.withColumn("excluded_fraction", lost)


def active_bounds(profile: DataFrame) -> DataFrame:
    """key, start, stop: from (key, i, value), where moving means from either end first reach max(0.01, 0.08 of the 90th percentile); all, if nothing does."""
    every = Window.partitionBy("key")
    rows = profile.withColumn("n", F.count("*").over(every)).withColumn("least", F.greatest(F.lit(0.01), F.percentile("value", F.lit(0.9)).over(every) * 0.08))
    rows = rows.withColumn("w", F.greatest(F.lit(2), F.least(F.lit(12), F.floor(F.col("n") / 40))))
    run = Window.partitionBy("key").orderBy("i")
    rows = rows.withColumn("sum", F.sum("value").over(run.rowsBetween(Window.unboundedPreceding, 0)))
    ahead = rows.select("key", (F.col("i") - F.col("w") + 1).alias("i"), F.col("sum").alias("to"))
    before = rows.select("key", "i", "n", "w", "least", (F.col("sum") - F.col("value")).alias("from"))
    high = before.join(ahead, ["key", "i"]).where((F.col("to") - F.col("from")) / F.col("w") >= F.col("least"))
    found = high.groupBy("key").agg(F.min("i").alias("start"), F.max(F.col("i") + F.col("w")).alias("stop"))
    size = profile.groupBy("key").agg(F.count("*").alias("n"))
    return size.join(found, "key", "left").select("key", F.coalesce("start", F.lit(0)).cast("int").alias("start"), F.coalesce("stop", "n").cast("int").alias("stop"))
