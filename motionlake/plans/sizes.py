"""Queries on sizes: zones in another frame, resolutions on offer, tiles of the analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sizes as S
from ..sources import table
from .documents import _JOBS, _ZONE, jobs
from .queries import _rounded, query

#: Frame that zones are drawn in.
FRAME = (640, 360)
#: Sizes on offer.
PRESETS = ((1920, 1080), (1280, 720), (640, 360))
_TO = {"tw": "320 + (p_partkey % 7) * 40", "th": "181 + (p_size % 6) * 30"}


@query(f"""WITH z AS (SELECT p_partkey, {', '.join(f'{sql} AS {name}' for name, sql in {**_ZONE, **_TO}.items())} FROM part),
 s AS (SELECT *, tw / {FRAME[0]}.0::DOUBLE AS across, th / {FRAME[1]}.0::DOUBLE AS down FROM z)
SELECT p_partkey, shape, round(x * across, 6) + 0.0 AS x, round(y * down, 6) + 0.0 AS y, round(CASE WHEN shape = 'rectangle' THEN coalesce(w, 0) * across END, 6) + 0.0 AS width, round(CASE WHEN shape = 'rectangle' THEN coalesce(h, 0) * down END, 6) + 0.0 AS height,
 round(CASE WHEN shape <> 'rectangle' THEN coalesce(r, 0) * ((across + down) / 2) END, 6) + 0.0 AS radius FROM s""")
def zones_scaled(spark, sf_dir):
    """Zones drawn in one frame, carried to the frame that is put out."""
    c = F.col
    zones = table(spark, sf_dir, "part").select("p_partkey", *[F.expr(sql).alias(name) for name, sql in {**_ZONE, **_TO}.items()])
    moved = S.scaled_zone(c("shape"), c("x"), c("y"), c("w"), c("h"), c("r"), c("tw") / float(FRAME[0]), c("th") / float(FRAME[1]))
    return _rounded(zones.select("p_partkey", "shape", moved.alias("z")).select("p_partkey", "shape", "z.*"), "x", "y", "width", "height", "radius")


def _even(side: str, most: str) -> str:
    return f"CASE WHEN least({side}, {most}) > 1 AND least({side}, {most}) % 2 <> 0 THEN least({side}, {most}) - 1 ELSE least({side}, {most}) END"


@query(f"""WITH {_JOBS}, p AS (SELECT * FROM (VALUES {', '.join(f'({i}, {w}, {h})' for i, (w, h) in enumerate(PRESETS))}) v(i, across, down)),
 f AS (SELECT o_orderkey, i, pw, ph, sw, sh, least(across::DOUBLE / sw, down::DOUBLE / sh, 1.0::DOUBLE) AS scale FROM j, p),
 s AS (SELECT o_orderkey, pw, ph, i, CAST(greatest(1, round_even(sw * scale, 0)) AS INTEGER) AS width, CAST(greatest(1, round_even(sh * scale, 0)) AS INTEGER) AS height FROM f),
 d AS (SELECT o_orderkey, width, height, any_value(pw) AS pw, any_value(ph) AS ph, min(i) AS i FROM s GROUP BY 1, 2, 3)
SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY i) AS INTEGER) AS nth, width, height, CAST({_even('width', 'pw')} AS INTEGER) AS safe_width, CAST({_even('height', 'ph')} AS INTEGER) AS safe_height FROM d""")
def resolution_options(spark, sf_dir):
    """The sizes that each job's source can be put out in, and what the encoder makes of them under the job's processing size."""
    c = F.col
    rows = jobs(spark, sf_dir).select("o_orderkey", "pw", "ph", F.posexplode(S.fitted(c("sw"), c("sh"), PRESETS)).alias("at", "size"))
    safe = S.encoder_size(c("size.width"), c("size.height"), c("pw"), c("ph"))
    rows = rows.select("o_orderkey", (c("at") + 1).alias("nth"), "size.*", safe.alias("safe"))
    return rows.select("o_orderkey", "nth", "width", "height", c("safe.width").alias("safe_width"), c("safe.height").alias("safe_height"))


_COUNT = "CAST(least(greatest(round_even({0} / 60.0::DOUBLE, 0), 6), {1}) AS INTEGER)"


@query(f"""WITH {_JOBS}, r AS (SELECT pw AS width, ph AS height, count(*) AS jobs FROM j GROUP BY 1, 2), n AS (SELECT *, {_COUNT.format('height', 16)} AS rows_, {_COUNT.format('width', 10)} AS columns_, least(width, height) AS short FROM r),
 t AS (SELECT *, greatest(12, least(CAST(round_even(least(height::DOUBLE / rows_, width::DOUBLE / columns_) * 1.45::DOUBLE, 0) AS INTEGER), short)) AS side FROM n),
 e AS (SELECT *, CASE WHEN side % 2 = 0 THEN side WHEN side = short THEN side - 1 ELSE side + 1 END AS tile FROM t),
 a AS (SELECT width, height, jobs, tile, 'row' AS axis, height AS length, rows_ AS n FROM e UNION ALL SELECT width, height, jobs, tile, 'column', width, columns_ FROM e),
 s AS (SELECT DISTINCT width, height, jobs, tile, axis, CAST(CASE WHEN tile >= length THEN 0 ELSE round_even(i * ((length - tile)::DOUBLE / (n - 1)), 0) END AS INTEGER) AS start FROM a, range(16) g(i) WHERE i < n)
SELECT CAST(width AS INTEGER) AS width, CAST(height AS INTEGER) AS height, jobs, CAST(tile AS INTEGER) AS tile, axis, start, CAST(row_number() OVER (PARTITION BY width, height, axis ORDER BY start) AS INTEGER) AS nth FROM s""")
def analysis_layout(spark, sf_dir):
    """Where the tiles begin that jobs of each processing size are analysed in, and how many jobs share them."""
    c = F.col
    sizes = jobs(spark, sf_dir).select(c("pw").cast("int").alias("width"), c("ph").cast("int").alias("height")).groupBy("width", "height").agg(F.count("*").alias("jobs"))
    rows, columns, tile = S.layout(c("width"), c("height"))
    sizes = sizes.select("*", rows.alias("rows"), columns.alias("columns"), tile.cast("int").alias("tile"))
    axis = lambda name, length, count: F.struct(F.lit(name).alias("axis"), S.even_starts(c(length), c("tile"), c(count)).alias("starts"))
    axes = sizes.select("width", "height", "jobs", "tile", F.inline(F.array(axis("row", "height", "rows"), axis("column", "width", "columns"))))
    return axes.select("width", "height", "jobs", "tile", "axis", F.posexplode("starts").alias("at", "start")).withColumn("nth", c("at") + 1).drop("at")
