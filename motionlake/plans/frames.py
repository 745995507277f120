"""Queries on frames: lineitem by return flag and year, on a grid of 16 x 16 (quantity by supplier)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import bands as B
from ..operators import clips as C
from ..operators import frames as K
from ..operators import grid as G
from ..operators import series as S
from ..sources import grid, series_arrays, table, written
from .queries import _GRID, _series_sql, FPS, N, ZONES, _r, _rounded, query

SIDE, TILE, STEP = 16, 8, 4


def frames(spark, sf_dir) -> DataFrame:
    """clip, frame, row, col, value: mean price in 0 .. 1; cells without lines are 0. Clips and years are few."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("clip"), (F.year(F.col("l_shipdate").cast("date")) - 1992).alias("frame"), (F.col("l_quantity") % SIDE).cast("int").alias("row"), (F.col("l_suppkey") % SIDE).cast("int").alias("col"), "l_extendedprice",
    )
    means = rows.groupBy("clip", "frame", "row", "col").agg((F.avg("l_extendedprice") / 100000).alias("value"))
    axis = F.sequence(F.lit(0), F.lit(SIDE - 1))
    places = means.select("clip", "frame").distinct().withColumn("row", F.explode(axis)).withColumn("col", F.explode(axis))
    return written(places.join(means, ["clip", "frame", "row", "col"], "left").fillna(0.0, ["value"]))


def _motion(spark, sf_dir) -> DataFrame:
    rows = written(C.packed(frames(spark, sf_dir), "clip", "frame"))
    return C.motion(rows, C.reference(rows, SIDE * SIDE), SIDE, SIDE, TILE, STEP)


_FRAMES = f"""fm AS (SELECT l_returnflag AS clip, CAST(year(l_shipdate) - 1992 AS INTEGER) AS frame, CAST(l_quantity AS INTEGER) % {SIDE} AS row, CAST(l_suppkey % {SIDE} AS INTEGER) AS col, avg(l_extendedprice) / 100000 AS value FROM lineitem GROUP BY 1, 2, 3, 4),
 fr AS (SELECT k.clip, k.frame, CAST(y AS INTEGER) AS row, CAST(x AS INTEGER) AS col, coalesce(value, 0.0) AS value FROM (SELECT DISTINCT clip, frame FROM fm) k CROSS JOIN range({SIDE}) a(y) CROSS JOIN range({SIDE}) b(x) LEFT JOIN fm ON fm.clip = k.clip AND fm.frame = k.frame AND fm.row = y AND fm.col = x),
 rf AS (SELECT clip, row, col, avg(value) AS value FROM fr GROUP BY 1, 2, 3)"""


@query(f"WITH {_FRAMES} SELECT clip, row, col, round(value, 6) + 0.0 AS value FROM rf")
def frame_reference(spark, sf_dir):
    return _rounded(K.reference(frames(spark, sf_dir)), "value")


def _correlation_sql(pairs: str, keys: str, size: int, least: str) -> str:
    """SQL CTEs from pairs (keys, y, x, a, b; two tiles of the size) to the surface sf (keys, y, x, c), by sums of cosines and sines."""
    t, hann = 2 * math.pi / size, "(0.5::DOUBLE - 0.5::DOUBLE * cos(2 * pi() * {0} / {1}))"
    window = f"{hann.format('y', size - 1)} * {hann.format('x', size - 1)}"
    angle = f"((u * y + v * x) % {size}) * {t}::DOUBLE"
    return f"""ft AS (SELECT {keys}, u, v, sum(a * {window} * cos({angle})) AS ar, -sum(a * {window} * sin({angle})) AS ai, sum(b * {window} * cos({angle})) AS br, -sum(b * {window} * sin({angle})) AS bi
   FROM {pairs} CROSS JOIN range({size}) g(u) CROSS JOIN range({size}) h(v) GROUP BY {keys}, u, v),
 pw AS (SELECT {keys}, u, v, ar * br + ai * bi AS re, ai * br - ar * bi AS im FROM ft),
 pn AS (SELECT {keys}, u, v, re / greatest(sqrt(re * re + im * im), {least}) AS re, im / greatest(sqrt(re * re + im * im), {least}) AS im FROM pw),
 sf AS (SELECT {keys}, y, x, sqrt(pow(sum(re * cos({angle}) - im * sin({angle})), 2) + pow(sum(re * sin({angle}) + im * cos({angle})), 2)) / {size * size} AS c FROM pn CROSS JOIN range({size}) g(y) CROSS JOIN range({size}) h(x) GROUP BY {keys}, y, x)"""


def _peak_sql(keys: str, size: int, tiny: str, hold: bool) -> str:
    """SQL CTE pk (keys, py, px, top, dx, dy) of sf."""
    on = " AND ".join(f"s.{k} = p.{k}" for k in keys.split(", "))
    near = lambda dy, dx: f"max(s.c) FILTER (WHERE s.y = (p.py + {size + dy}) % {size} AND s.x = (p.px + {size + dx}) % {size})"

    def offset(before: str, after: str) -> str:
        value = f"CASE WHEN abs({before} - 2 * any_value(p.top) + {after}) < {tiny} THEN 0 ELSE 0.5 * ({before} - {after}) / ({before} - 2 * any_value(p.top) + {after}) END"
        return f"least(greatest({value}, -1.0), 1.0)" if hold else value

    wrap = lambda c: f"CASE WHEN {c} > {size / 2} THEN {c} - {size} ELSE {c} END"
    return f"""tp AS (SELECT {keys}, max(c) AS top, avg(c) AS mean FROM sf GROUP BY {keys}),
 p AS (SELECT {', '.join('sf.' + k for k in keys.split(', '))}, min(y * {size} + x) // {size} AS py, min(y * {size} + x) % {size} AS px, any_value(tp.top) AS top, any_value(tp.mean) AS mean FROM sf JOIN tp USING ({keys}) WHERE sf.c = tp.top GROUP BY {', '.join('sf.' + k for k in keys.split(', '))}),
 po AS (SELECT {', '.join('p.' + k for k in keys.split(', '))}, py, px, any_value(p.top) AS top, any_value(p.mean) AS mean, px + {offset(near(0, -1), near(0, 1))} AS ox, py + {offset(near(-1, 0), near(1, 0))} AS oy FROM p JOIN sf s ON {on} GROUP BY {', '.join('p.' + k for k in keys.split(', '))}, py, px),
 pk AS (SELECT {keys}, py, px, top, mean, {wrap('ox')} AS dx, {wrap('oy')} AS dy FROM po)"""


_TILES = f"""ts AS (SELECT ty, tx FROM (VALUES (0), (4), (8)) a(ty), (VALUES (0), (4), (8)) b(tx)),
 pr AS (SELECT fr.clip, fr.frame, ty, tx, fr.row - ty AS y, fr.col - tx AS x, rf.value AS a, fr.value AS b FROM fr JOIN rf ON rf.clip = fr.clip AND rf.row = fr.row AND rf.col = fr.col JOIN ts ON fr.row >= ty AND fr.row < ty + {TILE} AND fr.col >= tx AND fr.col < tx + {TILE}),
 tex AS (SELECT clip, frame, ty, tx, stddev_pop(a) AS texture FROM pr GROUP BY 1, 2, 3, 4)"""
_MOVES = f"""{_FRAMES}, {_TILES}, {_correlation_sql('pr', 'clip, frame, ty, tx', TILE, '1e-6')}, {_peak_sql('clip, frame, ty, tx', TILE, '1e-6', True)},
 mv AS (SELECT clip, frame, ty, tx, texture, CASE WHEN texture < 1e-4 THEN 0 ELSE dx END AS dx, CASE WHEN texture < 1e-4 THEN 0 ELSE dy END AS dy, CASE WHEN texture < 1e-4 THEN 0 ELSE top / (mean + 1e-6) END AS quality FROM pk JOIN tex USING (clip, frame, ty, tx))"""


@query(f"WITH {_MOVES} SELECT clip, frame, ty, tx, round(dx, 4) + 0.0 AS dx, round(dy, 4) + 0.0 AS dy, round(texture, 4) + 0.0 AS texture, round(quality, 4) + 0.0 AS quality FROM mv")
def phase_corr_tile(spark, sf_dir):
    return _motion(spark, sf_dir).withColumns({c: _r(F.col(c), 4) for c in ("dx", "dy", "texture", "quality")})


@query(f"WITH {_MOVES} SELECT clip, ty, tx, round(max(texture) * least(greatest(quantile_cont(quality, 0.5) / 4, 0.0), 1.0), 6) + 0.0 AS confidence FROM mv GROUP BY 1, 2, 3")
def tile_confidence(spark, sf_dir):
    return _rounded(K.tile_confidence(_motion(spark, sf_dir)), "confidence")


_DRIFT = f"""{_FRAMES}, ed AS (SELECT clip, min(frame) AS a, max(frame) AS z FROM fr GROUP BY 1),
 e2 AS (SELECT clip, a AS frame, 0 AS which FROM ed UNION ALL SELECT clip, z, 1 FROM ed),
 ge AS (SELECT f.clip, e2.which, f.row, f.col, f.value * 255 AS value FROM fr f JOIN e2 USING (clip, frame)),
 gm AS (SELECT c.clip, c.which, c.row AS y, c.col AS x, sqrt(pow(coalesce(d.value - u.value, 0), 2) + pow(coalesce(r.value - l.value, 0), 2)) AS m FROM ge c
  LEFT JOIN ge u ON u.clip = c.clip AND u.which = c.which AND u.row = c.row - 1 AND u.col = c.col LEFT JOIN ge d ON d.clip = c.clip AND d.which = c.which AND d.row = c.row + 1 AND d.col = c.col
  LEFT JOIN ge l ON l.clip = c.clip AND l.which = c.which AND l.row = c.row AND l.col = c.col - 1 LEFT JOIN ge r ON r.clip = c.clip AND r.which = c.which AND r.row = c.row AND r.col = c.col + 1),
 gs AS (SELECT clip, which, avg(m) AS mean, stddev_pop(m) AS s FROM gm GROUP BY 1, 2),
 pr AS (SELECT g.clip, g.y, g.x, g.m - p.mean AS a, h.m - q.mean AS b FROM gm g JOIN gm h ON h.clip = g.clip AND h.y = g.y AND h.x = g.x AND h.which = 1 JOIN gs p ON p.clip = g.clip AND p.which = 0 JOIN gs q ON q.clip = g.clip AND q.which = 1 WHERE g.which = 0 AND p.s >= 1 AND q.s >= 1),
 {_correlation_sql('pr', 'clip', SIDE, '1e-9')}, {_peak_sql('clip', SIDE, '1e-9', False)},
 rt AS (SELECT pk.clip, any_value(dx) AS dx, any_value(dy) AS dy, any_value(top) / (coalesce(max(sf.c) FILTER (WHERE abs(sf.y - py) > 2 OR abs(sf.x - px) > 2), 0) + 1e-9) AS ratio FROM pk JOIN sf ON sf.clip = pk.clip GROUP BY pk.clip)"""


@query(f"WITH {_DRIFT} SELECT e.clip, round(CASE WHEN ratio >= 1.5 THEN dx END, 4) + 0.0 AS dx, round(CASE WHEN ratio >= 1.5 THEN dy END, 4) + 0.0 AS dy, round(CASE WHEN ratio >= 1.5 THEN ratio END, 4) + 0.0 AS ratio FROM ed e LEFT JOIN rt ON rt.clip = e.clip")
def global_drift(spark, sf_dir):
    rows = frames(spark, sf_dir).withColumn("value", F.col("value") * 255)
    return K.drift(rows, SIDE).withColumns({c: _r(F.col(c), 4) for c in ("dx", "dy", "ratio")})


_FIELD = "((row * 7 + col * 3 + frame) % 11 - 5) * 0.31::DOUBLE", "((row * 5 + col * 2 + frame) % 9 - 4) * 0.27::DOUBLE"


@query(f"""WITH {_FRAMES}, fd AS (SELECT clip, frame, row, col, least(greatest(col + least(greatest({_FIELD[0]}, -1.0), 1.0), 0), {SIDE - 1.001}::DOUBLE) AS x, least(greatest(row + least(greatest({_FIELD[1]}, -1.0), 1.0), 0), {SIDE - 1.001}::DOUBLE) AS y FROM fr)
SELECT a.clip, a.frame, a.row, a.col, round(least(greatest(sum(s.value * CASE WHEN s.row = floor(y) THEN 1 - (y - floor(y)) ELSE y - floor(y) END * CASE WHEN s.col = floor(x) THEN 1 - (x - floor(x)) ELSE x - floor(x) END), 0), 1), 6) + 0.0 AS value
FROM fd a JOIN fr s ON s.clip = a.clip AND s.frame = a.frame AND s.row BETWEEN floor(y) AND floor(y) + 1 AND s.col BETWEEN floor(x) AND floor(x) + 1 GROUP BY 1, 2, 3, 4""")
def frame_warp(spark, sf_dir):
    rows = frames(spark, sf_dir)
    field = rows.select("clip", "frame", "row", "col", (((F.col("row") * 7 + F.col("col") * 3 + F.col("frame")) % 11 - 5) * 0.31).alias("dx"), (((F.col("row") * 5 + F.col("col") * 2 + F.col("frame")) % 9 - 4) * 0.27).alias("dy"))
    return _rounded(K.warp(rows, field, SIDE, SIDE, 1.0), "value")


@query(f"""WITH {_FRAMES}, b AS (SELECT clip, frame // 3 AS batch, avg(value) AS value, count(DISTINCT frame) AS frames FROM fr GROUP BY 1, 2)
SELECT clip, round(sum(value * frames) / sum(frames), 6) + 0.0 AS mean FROM b GROUP BY 1""")
def batch_weighted_mean(spark, sf_dir):
    parts = K.batched(frames(spark, sf_dir), 3).groupBy("clip", "batch").agg(F.avg("value").alias("value"), F.count_distinct("frame").alias("frames"))
    return _rounded(K.batch_mean(parts), "mean")


@query(f"""WITH {_FRAMES}, pf AS (SELECT clip || '|' || frame AS key, row AS i, greatest(quantile_cont(value, 0.99), 3 * stddev_pop(value)) * CASE WHEN row BETWEEN 4 AND 10 THEN 1.0 ELSE 0.001 END AS value FROM fr GROUP BY clip, frame, row),
 ls AS (SELECT *, greatest(0.01, quantile_cont(value, 0.9) OVER (PARTITION BY key) * 0.08::DOUBLE) AS least FROM pf),
 mw AS (SELECT *, avg(value) OVER (PARTITION BY key ORDER BY i ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS m FROM ls)
SELECT key, coalesce(min(i) FILTER (WHERE m >= least AND i < {SIDE - 1}), 0)::INTEGER AS start, coalesce(max(i + 2) FILTER (WHERE m >= least AND i < {SIDE - 1}), {SIDE})::INTEGER AS stop FROM mw GROUP BY 1""")
def visible_bounds(spark, sf_dir):
    profile = K.edge_profile(frames(spark, sf_dir), "row")
    dark = F.when(F.col("i").between(4, 10), 1.0).otherwise(0.001)
    return G.active_bounds(profile.withColumn("value", F.col("value") * dark))


@query(f"""WITH {_GRID}, e AS (SELECT grid_id, min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM g GROUP BY 1),
 t AS (SELECT e.*, CAST(y AS INTEGER) AS row, CAST(x AS INTEGER) AS col, y * (r1 - r0) / 19.0::DOUBLE AS fy, x * (c1 - c0) / 6.0::DOUBLE AS fx FROM e CROSS JOIN range(20) a(y) CROSS JOIN range(7) b(x)),
 w AS (SELECT *, CAST(floor(fy) AS INTEGER) AS y0, CAST(floor(fx) AS INTEGER) AS x0, fy - floor(fy) AS wy, fx - floor(fx) AS wx FROM t)
SELECT w.grid_id, w.row, w.col, round(a.value * (1 - wy) * (1 - wx) + b.value * (1 - wy) * wx + c.value * wy * (1 - wx) + d.value * wy * wx, 4) + 0.0 AS value FROM w
JOIN g a ON a.grid_id = w.grid_id AND a.row = y0 + r0 AND a.col = x0 + c0 JOIN g b ON b.grid_id = w.grid_id AND b.row = y0 + r0 AND b.col = least(x0 + 1 + c0, c1)
JOIN g c ON c.grid_id = w.grid_id AND c.row = least(y0 + 1 + r0, r1) AND c.col = x0 + c0 JOIN g d ON d.grid_id = w.grid_id AND d.row = least(y0 + 1 + r0, r1) AND d.col = least(x0 + 1 + c0, c1)""")
def grid_resize_bilinear(spark, sf_dir):
    return G.resize(grid(table(spark, sf_dir, "lineitem")), 20, 7).withColumn("value", _r(F.col("value"), 4))


@query(f"""WITH {_GRID}, e AS (SELECT grid_id, min(row) AS r0, max(row) - min(row) + 1 AS h, min(col) AS c0, max(col) - min(col) + 1 AS w FROM g GROUP BY 1),
 t AS (SELECT g.grid_id, g.row - r0 - floor(h * 0.08::DOUBLE) AS y, g.col - c0 - floor(w * 0.08::DOUBLE) AS x, value, floor((h - 2 * floor(h * 0.08::DOUBLE)) / 2) * 2 AS hh, floor((w - 2 * floor(w * 0.08::DOUBLE)) / 2) * 2 AS ww FROM g JOIN e USING (grid_id))
SELECT grid_id, CAST(floor(y / 2) AS INTEGER) AS row, CAST(floor(x / 2) AS INTEGER) AS col, round(avg(value), 4) + 0.0 AS value FROM t WHERE y >= 0 AND x >= 0 AND y < hh AND x < ww GROUP BY 1, 2, 3""")
def grid_trim_pool(spark, sf_dir):
    return G.mean_pool(G.trimmed(grid(table(spark, sf_dir, "lineitem"))), 2).withColumn("value", _r(F.col("value"), 4))


_FEATHER = 40.0
_PX, _PY = "p_size::DOUBLE", "p_retailprice"
_CIRCLE = "greatest(0, least(1, 1 - greatest(sqrt(pow(p_size - {x}, 2) + pow(p_retailprice - {y}, 2)) - {radius}, 0) / 40.0))"
_MASK = f"""greatest(1 - greatest(0, greatest(0, least(1, 1 - sqrt(pow(greatest(5.0 - p_size, p_size - 35.0, 0), 2) + pow(greatest(900.0 - p_retailprice, p_retailprice - 1400.0, 0), 2)) / 40.0)), {_CIRCLE.format(x=40.0, y=1500.0, radius=120.0)}), {_CIRCLE.format(x=20.0, y=1100.0, radius=60.0)})"""


@query(f"SELECT p_partkey, round({_MASK}, 6) + 0.0 AS alpha FROM part")
def mask_raster(spark, sf_dir):
    alpha = G.exclusion(ZONES, F.col("p_size").cast("double"), F.col("p_retailprice"), _FEATHER)
    return table(spark, sf_dir, "part").select("p_partkey", _r(alpha).alias("alpha"))


@query(f"SELECT p_partkey, round(p_size * {_MASK} + p_retailprice / 100 * (1 - {_MASK}), 6) + 0.0 AS value FROM part")
def mask_composite(spark, sf_dir):
    alpha = G.exclusion(ZONES, F.col("p_size").cast("double"), F.col("p_retailprice"), _FEATHER)
    return table(spark, sf_dir, "part").select("p_partkey", _r(F.col("p_size") * alpha + F.col("p_retailprice") / 100 * (1 - alpha)).alias("value"))


_ACTIVITY = ((1, 1.0, 2.0), (2, 2.0, 4.0), (3, 4.0, 7.0))


def envelope_width(low: float, high: float, fps: float) -> int:
    """Frames of the envelope of a band, odd: half a period of its centre, 0.08 to 0.35 seconds."""
    width = max(3, round(min(max(0.5 / max((low + high) / 2, 0.25), 0.08), 0.35) * fps))
    return width + (width % 2 == 0)


@query(f"""WITH {_series_sql('event_type')}, bd AS (SELECT * FROM (VALUES {', '.join(f'({b}, {lo}, {hi}, {envelope_width(lo, hi, FPS) // 2}, {envelope_width(lo, hi, FPS)})' for b, lo, hi in _ACTIVITY)}) v(band, lo, hi, half, width)),
 q AS (SELECT series_key, band, half, width, k, sum(x * cos((k * n % {N}) * {2 * math.pi / N}::DOUBLE)) AS re, sum(x * sin((k * n % {N}) * {2 * math.pi / N}::DOUBLE)) AS im, CASE WHEN k IN (0, {N // 2}) THEN 1 ELSE 2 END AS w
  FROM c CROSS JOIN range({N // 2 + 1}) g(k) JOIN bd ON k * {FPS}::DOUBLE / {N} BETWEEN lo AND hi GROUP BY 1, 2, 3, 4, 5),
 y AS (SELECT series_key, band, half, width, CAST(n AS INTEGER) AS n, sum(w * (re * cos((k * n % {N}) * {2 * math.pi / N}::DOUBLE) + im * sin((k * n % {N}) * {2 * math.pi / N}::DOUBLE))) / {N} AS v FROM q CROSS JOIN range({N}) h(n) GROUP BY 1, 2, 3, 4, 5)
SELECT a.series_key, a.band, a.n, round(sqrt(sum(b.v * b.v) / any_value(a.width)), 6) + 0.0 AS x FROM y a JOIN y b ON b.series_key = a.series_key AND b.band = a.band AND abs(b.n - a.n) <= a.half GROUP BY 1, 2, 3""")
def band_activity(spark, sf_dir):
    packed = series_arrays(table(spark, sf_dir, "events"), "event_type", N)
    mean = F.aggregate("xs", F.lit(0.0), lambda t, x: t + x) / N
    packed = written(packed.select("series_key", F.transform("xs", lambda x: x - mean).alias("xs")))
    out = None
    for band, low, high in _ACTIVITY:
        rows = S.rms_envelope(B.fft_band_pass(packed, N, FPS, low, high), envelope_width(low, high, FPS)).withColumn("band", F.lit(band))
        out = rows if out is None else out.unionByName(rows)
    return _rounded(out.select("series_key", "band", "n", "x"), "x")
