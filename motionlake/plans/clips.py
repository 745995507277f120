"""Queries on whole frames: the bytes of documents as packed frames, and the frames of ``frames`` in rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import streaming as T
from ..functions import centre_weight
from ..operators import clips as C
from ..operators import series as S
from ..sources import table, written
from .frames import _FRAMES, _MOVES, SIDE, STEP, TILE, frames
from .queries import ORACLE, _r, _rounded, query

RGB, COLOURS = 16, 3
#: Grey frames for traces, and how many a document must have.
HEIGHT, WIDTH, LEAST_FRAMES = 24, 30, 8


def _bytes_sql(size: int, least: int = 1) -> str:
    """SQL CTE px (doc_id, frame, i, b): the bytes of documents in whole frames of a size."""
    digit = lambda at: f"(instr('0123456789ABCDEF', substr(h, {at}, 1)) - 1)"
    return f"""hx AS (SELECT doc_id, f AS frame, substr(hex(encode(text)), (f * {2 * size} + 1)::BIGINT, {2 * size}) AS h FROM documents, LATERAL (SELECT unnest(range(strlen(text) // {size})) AS f) WHERE strlen(text) >= {least * size}),
 px AS (SELECT doc_id, frame, i, 16 * {digit('2 * i + 1')} + {digit('2 * i + 2')} AS b FROM hx CROSS JOIN range({size}) r(i))"""


_RED, _GREEN, _BLUE = C.BT709


@query(f"""WITH {_bytes_sql(RGB * RGB * COLOURS)}
SELECT doc_id, frame::BIGINT AS frame, round(3 * avg(b * CASE i % 3 WHEN 0 THEN {_RED}::DOUBLE WHEN 1 THEN {_GREEN}::DOUBLE ELSE {_BLUE}::DOUBLE END) / 255, 6) + 0.0 AS luma, round(avg(b) FILTER (WHERE i % 3 = 1) / 255, 6) + 0.0 AS green FROM px GROUP BY 1, 2""")
def frames_from_bytes(spark, sf_dir):
    """The bytes of texts as rgb24 frames: mean luma and mean green of each; what doesn't fill a frame is left out."""
    blobs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    rows = C.decoded(blobs, ["doc_id"], "content", RGB, RGB)
    green = F.filter("pixels", lambda x, i: i % 3 == 1)
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda t, x: t + x) / F.size(a)
    grey = C.luma(rows.withColumn("green", mean(green)), ["doc_id", "frame", "green"], RGB, RGB)
    return _rounded(grey.select("doc_id", "frame", mean(F.col("pixels")).alias("luma"), "green"), "luma", "green")


@query(f"""WITH {_bytes_sql(RGB * RGB * COLOURS)} SELECT doc_id, frame::BIGINT AS frame, sum(b * (i + 1))::BIGINT AS check_sum, count(*)::BIGINT AS n FROM px GROUP BY 1, 2""")
def frames_round_trip(spark, sf_dir):
    """Packed frames decoded, encoded again, and their bytes read back, all in one task."""
    blobs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("content"))
    return C.from_bytes(blobs, ["doc_id"], "content", RGB * RGB * COLOURS, lambda pixels: C.check_sums(C.to_bytes(pixels)), "check_sum long, n long")


_SPREAD = max(SIDE / 14, 4.0)


@query(f"""WITH c AS (SELECT s_suppkey AS clip, 0.5 + s_suppkey % 7 / 2.0::DOUBLE AS swing, 6.0 + s_nationkey % 5 AS period FROM supplier),
 p AS (SELECT clip, f, x, exp(-(pow(x - ({SIDE / 2} + swing * sin(f * 2 * pi() / period)), 2) + pow(y - {SIDE / 2}, 2)) / {2 * _SPREAD**2}::DOUBLE) AS v FROM c CROSS JOIN range(8) a(f) CROSS JOIN range({SIDE}) b(y) CROSS JOIN range({SIDE}) d(x))
SELECT clip, f::INTEGER AS frame, round(avg(v), 6) + 0.0 AS mean, round(sum(v * x) / sum(v), 6) + 0.0 AS centre FROM p GROUP BY 1, 2""")
def swinging_spots(spark, sf_dir):
    """A clip for each supplier, whose spot swings as its keys say: mean light and its centre, frame by frame."""
    kinds = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("clip"), (0.5 + F.col("s_suppkey") % 7 / 2.0).alias("swing"), (6.0 + F.col("s_nationkey") % 5).alias("period"))
    rows = C.cells(C.gaussian_clips(kinds, 8, SIDE, SIDE), SIDE, "clip", "frame")
    return _rounded(rows.groupBy("clip", "frame").agg(F.avg("value").alias("mean"), (F.sum(F.col("value") * F.col("col")) / F.sum("value")).alias("centre")), "mean", "centre")


#: A field of 3 x 3 cells for each frame: what light the frame has in its first rows and columns.
_FIELD = "({value} - 0.3) * 8"


def _fields(rows):
    """clip, frame, dx, dy of the frames in cells."""
    few = rows.where("row < 3 and col < 3").withColumn("value", (F.col("value") - 0.3) * 8)
    down = few.groupBy("clip", "frame").agg(F.sort_array(F.collect_list(F.struct("row", "col", "value"))).alias("a"), F.sort_array(F.collect_list(F.struct("col", "row", "value"))).alias("b"))
    return down.select("clip", "frame", F.col("a.value").alias("dx"), F.col("b.value").alias("dy"))


def _spread_sql(source: str, value: str, name: str) -> str:
    """SQL CTE: a field (clip, frame, i, j, ``value``) of 3 x 3 as one of SIDE x SIDE (clip, frame, row, col, value), corners on corners."""
    part = lambda c, k: f"CASE WHEN s.{k} = floor({c}) THEN 1 - ({c} - floor({c})) ELSE {c} - floor({c}) END"
    return f"""{name} AS (SELECT s.clip, s.frame, t.row, t.col, sum(s.{value} * {part('t.y', 'i')} * {part('t.x', 'j')}) AS value
   FROM {source} s JOIN (SELECT r AS row, c AS col, r * 2 / {SIDE - 1}::DOUBLE AS y, c * 2 / {SIDE - 1}::DOUBLE AS x FROM range({SIDE}) a(r) CROSS JOIN range({SIDE}) b(c)) t
   ON s.i BETWEEN floor(t.y) AND floor(t.y) + 1 AND s.j BETWEEN floor(t.x) AND floor(t.x) + 1 GROUP BY 1, 2, 3, 4)"""


def _warp_sql(most: float) -> str:
    """SQL CTEs from fields fx, fy (clip, frame, row, col, value) and frames fr to the warped frames wp."""
    hold = lambda base, f: f"least(greatest({base} + least(greatest({f}.value, {-most}), {most}), 0), {SIDE - 1.001}::DOUBLE)"
    part = lambda c, k: f"CASE WHEN s.{k} = floor({c}) THEN 1 - ({c} - floor({c})) ELSE {c} - floor({c}) END"
    return f"""pl AS (SELECT fx.clip, fx.frame, fx.row, fx.col, {hold('fx.col', 'fx')} AS x, {hold('fx.row', 'fy')} AS y FROM fx JOIN fy USING (clip, frame, row, col)),
 wp AS (SELECT p.clip, p.frame, p.row, p.col, least(greatest(sum(s.value * {part('y', 'row')} * {part('x', 'col')}), 0), 1) AS value
   FROM pl p JOIN fr s ON s.clip = p.clip AND s.frame = p.frame AND s.row BETWEEN floor(y) AND floor(y) + 1 AND s.col BETWEEN floor(x) AND floor(x) + 1 GROUP BY 1, 2, 3, 4)"""


_GIVEN = f"""{_FRAMES}, gv AS (SELECT clip, frame, row AS i, col AS j, {_FIELD.format(value='value')} AS d FROM fr WHERE row < 3 AND col < 3), gt AS (SELECT clip, frame, j AS i, i AS j, d FROM gv)"""


@query(f"WITH {_GIVEN}, {_spread_sql('gv', 'd', 'fx')} SELECT clip, frame, row::INTEGER AS row, col::INTEGER AS col, round(value, 6) + 0.0 AS value FROM fx")
def field_resize_plan(spark, sf_dir):
    """A field of displacements spread over frames by one plan, made once."""
    fields = _fields(frames(spark, sf_dir))
    plan = C.resize_plan((3, 3), (SIDE, SIDE))
    wide = C.by_frames(fields, ["clip", "frame"], ["dx"], SIDE * SIDE, lambda dx: [C.lists(plan(C.stacked(dx, (3, 3))))], "pixels array<double>")
    return _rounded(C.cells(wide, SIDE, "clip", "frame"), "value")


@query(f"WITH {_GIVEN}, {_spread_sql('gv', 'd', 'fx')}, {_spread_sql('gt', 'd', 'fy')}, {_warp_sql(2.0)} SELECT clip, frame, row::INTEGER AS row, col::INTEGER AS col, round(value, 6) + 0.0 AS value FROM wp")
def frame_warp_field(spark, sf_dir):
    """Frames warped by coarse fields that are spread over them between their cells."""
    rows = frames(spark, sf_dir)
    out = C.warped(C.packed(rows, "clip", "frame"), _fields(rows), SIDE, SIDE, (3, 3), 2.0)
    return _rounded(C.cells(out, SIDE, "clip", "frame"), "value")


_MAGNIFICATION = 12.0
_HIGH, _LOW = S.low_pass_gain(4.0, 1.5), S.low_pass_gain(4.0, 0.25)
_WEIGHTS = f"""cf AS (SELECT clip, ty, tx, max(texture) * least(greatest(quantile_cont(quality, 0.5) / 4, 0.0), 1.0) AS c FROM mv GROUP BY 1, 2, 3),
 ce AS (SELECT clip, quantile_cont(c, 0.97) AS edge, max(c) AS most FROM cf WHERE c > 0 GROUP BY 1),
 cg AS (SELECT clip, ty, tx, CASE WHEN most > 1e-6 THEN least(greatest((least(c / CASE WHEN edge > 1e-6 THEN edge ELSE most END, 1.0) - 0.03::DOUBLE) / 0.97::DOUBLE, 0.0), 1.0) ELSE 0 END AS g FROM cf LEFT JOIN ce USING (clip)),
 cw AS (SELECT clip, ty, tx, (0.5::DOUBLE * sqrt(g) + 0.5::DOUBLE * g * g * (3 - 2 * g)) * {C.GAIN * _MAGNIFICATION}::DOUBLE AS w FROM cg)"""
_AFTER = f"""sx AS (SELECT clip, frame, ty // {STEP} AS i, tx // {STEP} AS j, px * w AS d FROM bp JOIN cw USING (clip, ty, tx)), sy AS (SELECT clip, frame, ty // {STEP} AS i, tx // {STEP} AS j, py * w AS d FROM bp JOIN cw USING (clip, ty, tx)),
 {_spread_sql('sx', 'd', 'fx')}, {_spread_sql('sy', 'd', 'fy')}, {_warp_sql(C.most_displacement(SIDE, SIDE))}
SELECT clip, frame, row::INTEGER AS row, col::INTEGER AS col, round(value, 4) + 0.0 AS value FROM wp"""
_NUMBERED = "nm AS (SELECT *, row_number() OVER (PARTITION BY clip, ty, tx ORDER BY frame) - 1 AS n, count(*) OVER (PARTITION BY clip, ty, tx) AS m FROM mv)"


@query(f"""WITH RECURSIVE {_MOVES}, {_WEIGHTS}, {_NUMBERED},
 it AS (SELECT clip, ty, tx, frame, n, {_HIGH}::DOUBLE * dx AS hx, {_LOW}::DOUBLE * dx AS lx, {_HIGH}::DOUBLE * dy AS hy, {_LOW}::DOUBLE * dy AS ly FROM nm WHERE n = 0
  UNION ALL SELECT b.clip, b.ty, b.tx, b.frame, b.n, a.hx + {_HIGH}::DOUBLE * (b.dx - a.hx), a.lx + {_LOW}::DOUBLE * (b.dx - a.lx), a.hy + {_HIGH}::DOUBLE * (b.dy - a.hy), a.ly + {_LOW}::DOUBLE * (b.dy - a.ly)
  FROM it a JOIN nm b ON b.clip = a.clip AND b.ty = a.ty AND b.tx = a.tx AND b.n = a.n + 1),
 bp AS (SELECT clip, ty, tx, frame, hx - lx AS px, hy - ly AS py FROM it), {_AFTER}""")
def frame_amplify(spark, sf_dir):
    """The whole amplifier as streams have it: band-pass by two one-pole filters."""
    rows = C.packed(frames(spark, sf_dir), "clip", "frame")
    out = C.amplified(rows, SIDE, SIDE, TILE, STEP, C.iir(_HIGH, _LOW), _MAGNIFICATION)
    return C.cells(out, SIDE, "clip", "frame").withColumn("value", _r(F.col("value"), 4))


@query()
def stream_amplify(spark, sf_dir):
    """The same of a stream of frames in three chunks; references and weights come from a first pass."""
    rows = written(C.packed(frames(spark, sf_dir), "clip", "frame"))
    out = T.appended(T.amplified(T.in_chunks(rows.withColumn("us", F.col("frame").cast("long")), "clip", 3).drop("us"), still_of(rows), SIDE, SIDE, TILE, STEP, (_HIGH, _LOW), _MAGNIFICATION))
    return C.cells(out, SIDE, "clip", "frame").withColumn("value", _r(F.col("value"), 4))


ORACLE["stream_amplify"] = ORACLE["frame_amplify"]


def still_of(rows):
    """clip, pixels, weights: the reference image of each clip of frames, and how far its tiles count."""
    still = written(C.reference(rows, SIDE * SIDE))
    weights = C.tile_weights(C.motion(rows, still, SIDE, SIDE, TILE, STEP))
    packed = weights.groupBy("clip").agg(F.sort_array(F.collect_list(F.struct("ty", "tx", "weight"))).alias("ws"))
    return written(still.join(packed.select("clip", F.col("ws.weight").alias("weights")), "clip"))


_FPS, _BAND = 4.0, (0.5, 1.5)


@query(f"""WITH {_MOVES}, {_WEIGHTS}, {_NUMBERED},
 sp AS (SELECT clip, ty, tx, k, any_value(m) AS m, sum(dx * cos(2 * pi() * ((k * n) % m) / m)) AS xr, -sum(dx * sin(2 * pi() * ((k * n) % m) / m)) AS xi, sum(dy * cos(2 * pi() * ((k * n) % m) / m)) AS yr, -sum(dy * sin(2 * pi() * ((k * n) % m) / m)) AS yi,
  CASE WHEN k = 0 OR 2 * k = any_value(m) THEN 1 ELSE 2 END AS w FROM nm, LATERAL (SELECT unnest(range(m // 2 + 1)) AS k) WHERE k * {_FPS}::DOUBLE / m BETWEEN {_BAND[0]} AND {_BAND[1]} GROUP BY clip, ty, tx, k),
 av AS (SELECT clip, ty, tx, avg(dx) AS ax, avg(dy) AS ay FROM nm GROUP BY 1, 2, 3),
 bp AS (SELECT nm.clip, nm.ty, nm.tx, frame, coalesce(sum(w * (xr * cos(2 * pi() * ((k * n) % sp.m) / sp.m) - xi * sin(2 * pi() * ((k * n) % sp.m) / sp.m))) / any_value(nm.m), 0) + 0.25 * (any_value(dx) - any_value(ax)) AS px,
   coalesce(sum(w * (yr * cos(2 * pi() * ((k * n) % sp.m) / sp.m) - yi * sin(2 * pi() * ((k * n) % sp.m) / sp.m))) / any_value(nm.m), 0) + 0.25 * (any_value(dy) - any_value(ay)) AS py
  FROM nm JOIN av USING (clip, ty, tx) LEFT JOIN sp ON sp.clip = nm.clip AND sp.ty = nm.ty AND sp.tx = nm.tx GROUP BY nm.clip, nm.ty, nm.tx, frame, n), {_AFTER}""")
def frame_amplify_fft(spark, sf_dir):
    """The whole amplifier over whole clips: frequencies within a band, and a quarter of all other motion."""
    rows = C.packed(frames(spark, sf_dir), "clip", "frame")
    out = C.amplified(rows, SIDE, SIDE, TILE, STEP, C.fft(_FPS, *_BAND), _MAGNIFICATION, attenuate=False)
    return C.cells(out, SIDE, "clip", "frame").withColumn("value", _r(F.col("value"), 4))


#: Cells of six pixels, as many as such frames have.
_YS, _XS = range(0, HEIGHT + 1, 6), range(0, WIDTH + 1, 6)
_PLACES = [(a, b, c, d) for a, b in zip(_YS, _YS[1:]) for c, d in zip(_XS, _XS[1:])]
_TRACES = f"""{_bytes_sql(HEIGHT * WIDTH, LEAST_FRAMES)},
 lt AS (SELECT doc_id, frame, i // {WIDTH} AS y, i % {WIDTH} AS x, b / 255.0::DOUBLE AS v FROM px),
 rf AS (SELECT doc_id, y, x, avg(v) AS v FROM lt GROUP BY 1, 2, 3),
 gr AS (SELECT doc_id, y, x, v,
   (coalesce(lead(v) OVER r, v) - coalesce(lag(v) OVER r, v)) / CASE WHEN x IN (0, {WIDTH - 1}) THEN 1 ELSE 2 END AS gx, (coalesce(lead(v) OVER c, v) - coalesce(lag(v) OVER c, v)) / CASE WHEN y IN (0, {HEIGHT - 1}) THEN 1 ELSE 2 END AS gy
   FROM rf WINDOW r AS (PARTITION BY doc_id, y ORDER BY x), c AS (PARTITION BY doc_id, x ORDER BY y)),
 ce AS (SELECT * FROM (VALUES {', '.join(f'({i}, {a}, {b}, {c}, {d})' for i, (a, b, c, d) in enumerate(_PLACES))}) v(cell, y0, y1, x0, x1)),
 en AS (SELECT doc_id, cell, y0, y1, x0, x1, avg(gx * gx) AS ex, avg(gy * gy) AS ey, sqrt(avg(gx * gx) + avg(gy * gy)) AS texture FROM gr JOIN ce ON y >= y0 AND y < y1 AND x >= x0 AND x < x1 GROUP BY 1, 2, 3, 4, 5, 6),
 tr AS (SELECT lt.doc_id, cell, frame, any_value(texture) AS texture, CASE WHEN any_value(ex) > 1e-5 THEN avg((lt.v - gr.v) * gx) / any_value(ex) END AS tx, CASE WHEN any_value(ey) > 1e-5 THEN avg((lt.v - gr.v) * gy) / any_value(ey) END AS ty
   FROM lt JOIN gr USING (doc_id, y, x) JOIN en ON en.doc_id = lt.doc_id AND lt.y >= y0 AND lt.y < y1 AND lt.x >= x0 AND lt.x < x1 WHERE texture > 1e-4 GROUP BY 1, 2, 3),
 tl AS (SELECT doc_id, cell, frame, texture, 'x' AS axis, tx AS value FROM tr WHERE tx IS NOT NULL UNION ALL SELECT doc_id, cell, frame, texture, 'y', ty FROM tr WHERE ty IS NOT NULL)"""


def _grey(spark, sf_dir):
    """clip, frame, pixels and clip, pixels: documents of LEAST_FRAMES grey frames or more, and their means."""
    rows = table(spark, sf_dir, "documents").where(F.octet_length("text") >= LEAST_FRAMES * HEIGHT * WIDTH).select(F.col("doc_id").alias("clip"), F.col("text").cast("binary").alias("content"))
    grey = written(C.decoded(rows, ["clip"], "content", HEIGHT, WIDTH, 1))
    return grey, written(C.reference(grey, HEIGHT * WIDTH))


@query(f"WITH {_TRACES} SELECT doc_id AS clip, cell::INTEGER AS cell, axis, frame::BIGINT AS frame, round(value, 6) + 0.0 AS value FROM tl")
def gradient_traces(spark, sf_dir):
    """Motion of cells from how the light changes along the gradient of the mean frame."""
    rows = C.traces(*_grey(spark, sf_dir), HEIGHT, WIDTH)
    return _rounded(rows.select("clip", "cell", "axis", "frame", "value"), "value")


@query(f"""WITH {_TRACES}, wt AS (SELECT doc_id, cell, axis, any_value(texture) * sqrt(avg(value * value)) AS w, sqrt(avg(value * value)) AS rms FROM tl GROUP BY 1, 2, 3)
SELECT doc_id AS clip, cell::INTEGER AS cell, axis, round(w * least(greatest(1.10::DOUBLE - 0.70::DOUBLE * sqrt(pow((y0 + y1) / 2.0 / {HEIGHT} - 0.5, 2) + pow((x0 + x1) / 2.0 / {WIDTH} - 0.5, 2)) / 0.5, 0.20), 1.0), 6) + 0.0 AS weight FROM wt JOIN ce USING (cell) WHERE rms > 1e-5""")
def trace_weights(spark, sf_dir):
    """How much each cell's trace counts: texture, how far it moves, and its place."""
    rows = C.traces(*_grey(spark, sf_dir), HEIGHT, WIDTH)
    return _rounded(C.trace_weights(rows, centre_weight), "weight")

