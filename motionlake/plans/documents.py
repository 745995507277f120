"""Queries on jobs and documents: admission, validation, cost, normalisation, scalar maps. Jobs are derived from orders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import functions as X
from ..functions import jobs as J
from ..operators import rules as R
from ..sources import table
from .queries import _r, query

MIB = 1 << 20
#: Columns of a job from columns of an order, in SQL that both engines read.
JOB = {
    "sw": "640 + (o_orderkey % 13) * 80", "sh": "360 + (o_custkey % 11) * 48", "pw": "320 + (o_orderkey % 7) * 40", "ph": "181 + (o_custkey % 6) * 30",
    "ow": "320 + (o_orderkey % 7) * 40 + CASE WHEN o_orderkey % 31 = 0 THEN 2 ELSE 0 END", "oh": "181 + (o_custkey % 6) * 30",
    "fps": "CAST(6 + (o_orderkey % 5) * 6 AS DOUBLE)", "low": "CAST(0.25 AS DOUBLE) + (o_custkey % 7) * CAST(0.5 AS DOUBLE)", "high": "CAST(0.2 AS DOUBLE) + (o_custkey % 7) * CAST(0.5 AS DOUBLE) + (o_orderkey % 9) * CAST(1.5 AS DOUBLE)",
    "seconds": "CAST(2 + o_orderkey % 20 AS DOUBLE)", "depth": "CASE WHEN o_custkey % 3 = 0 THEN 10 ELSE 8 END", "container": "CASE WHEN o_orderkey % 17 = 0 THEN 'mkv' ELSE 'MP4' END",
    "vfr": "o_orderkey % 4 = 0", "display": "o_orderkey % 23 = 0", "rotated": "o_custkey % 19 = 0", "non_square": "o_orderkey % 6 = 0", "hdr": "o_custkey % 29 = 0", "contradictory": "o_orderkey % 37 = 0", "decodable": "o_custkey % 41 <> 0",
    "rec709": "o_orderkey % 3 <> 0", "heuristic": "o_custkey % 2 = 0", "gpu": "o_orderkey % 8 = 0", "scratch_free": "CAST((o_custkey % 50) AS BIGINT) * 256 * 1048576", "output_free": "CAST((o_orderkey % 40) AS BIGINT) * 64 * 1048576",
    "retained": "CAST((o_custkey % 30) AS BIGINT) * 128 * 1048576", "budget": "CAST(3072 AS BIGINT) * 1048576", "ram": "CAST(512 + (o_orderkey % 24) * 256 AS BIGINT) * 1048576", "headroom": "CAST(512 AS BIGINT) * 1048576",
    "level": "o_custkey % 4", "policy": "CASE o_orderkey % 3 WHEN 0 THEN 'conservative' WHEN 1 THEN 'balanced' ELSE 'aggressive' END", "cores": "CAST(1 + o_custkey % 16 AS BIGINT)",
}
_JOBS = f"j AS (SELECT o_orderkey, {', '.join(f'{sql} AS {name}' for name, sql in JOB.items())} FROM orders)"


def jobs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", *[F.expr(sql).alias(name) for name, sql in JOB.items()])


def costed(rows: DataFrame) -> DataFrame:
    """Jobs with chunk, workers, queue and bytes of staging, scratch and RAM, by policy."""
    frames = F.greatest(F.lit(1), F.ceil(F.col("seconds") * F.col("fps") - 1e-9)).cast("long")
    s, p, o = (F.col(f"{c}w").cast("long") * F.col(f"{c}h").cast("long") for c in "spo")
    diag = F.element_at(F.array(*[F.lit(n * MIB) for n in (0, 32, 128, 256)]), (F.col("level") + 1).cast("int")).cast("long")
    div = lambda x, n: F.floor(x / n).cast("long")
    per_frame = 3 * s + 12 * s + 24 * p + 9 * o + 8 * p + 4 * F.greatest(div(p, 8), F.lit(1))
    fixed = diag + 4 * p + 4 * o + 4 * F.greatest(div(p, 4), F.lit(1)) + 96 * MIB
    admissible = F.greatest(F.col("ram") - F.col("headroom"), F.lit(64 * MIB))
    pick = lambda a, b, c: F.when(F.col("policy") == "conservative", a).when(F.col("policy") == "balanced", b).otherwise(c)
    spare = F.greatest(F.col("cores") - 1, F.lit(1))
    workers = pick(F.lit(1), F.greatest(F.lit(2), F.least(F.lit(4), F.greatest(div(spare, 2), F.lit(1)))), F.greatest(F.lit(2), F.least(F.lit(8), spare))).cast("long")
    cap = pick(F.lit(24), F.lit(48), F.least(F.lit(256), F.greatest(F.lit(96), div(admissible, 128 * MIB)))).cast("long")
    room = F.floor((admissible * pick(F.lit(0.35), F.lit(0.5), F.lit(0.65)) - fixed) / per_frame)
    chunk = F.greatest(F.lit(1), F.least(room, F.least(frames, cap))).cast("long")
    staging = F.greatest(o * frames, F.lit(64 * MIB))
    normal = F.when(F.col("vfr") | F.col("non_square"), 3 * s * frames).otherwise(F.lit(0))
    out = rows.withColumn("chunk", chunk).withColumn("workers", workers)
    scratch = F.floor(12 * p * F.col("chunk") * pick(F.lit(2.0), F.lit(2.5), F.lit(3.0))).cast("long") + diag + p + staging + normal
    need = fixed + per_frame * F.least("chunk", frames) + per_frame * (F.col("workers") - 1)
    return out.select("*", pick(F.lit(1), F.lit(2), F.lit(3)).cast("long").alias("queue"), diag.alias("diag"), staging.alias("staging"), scratch.alias("scratch"), need.alias("need"))


_COST = f"""{_JOBS}, k AS (SELECT *, CAST(greatest(1, ceil(seconds * fps - 1e-9)) AS BIGINT) AS frames, CAST(sw AS BIGINT) * sh AS s, CAST(pw AS BIGINT) * ph AS p, CAST(ow AS BIGINT) * oh AS o, (CASE level WHEN 0 THEN 0 WHEN 1 THEN 32 WHEN 2 THEN 128 ELSE 256 END)::BIGINT * {MIB} AS diag,
   greatest(ram - headroom, 64 * {MIB}) AS adm, greatest(cores - 1, 1) AS spare, CASE policy WHEN 'conservative' THEN 0.35 WHEN 'balanced' THEN 0.5 ELSE 0.65 END::DOUBLE AS frac, CASE policy WHEN 'conservative' THEN 2.0 WHEN 'balanced' THEN 2.5 ELSE 3.0 END::DOUBLE AS mult FROM j),
 m AS (SELECT *, 3 * s + 12 * s + 2 * 12 * p + 9 * o + 8 * p + 4 * greatest(p // 8, 1) AS pf, diag + 4 * p + 4 * o + 4 * greatest(p // 4, 1) + 96 * {MIB} AS fixed,
   CASE policy WHEN 'conservative' THEN 1 WHEN 'balanced' THEN greatest(2, least(4, greatest(spare // 2, 1))) ELSE greatest(2, least(8, spare)) END::BIGINT AS workers, CASE policy WHEN 'conservative' THEN 1 WHEN 'balanced' THEN 2 ELSE 3 END::BIGINT AS queue,
   CASE policy WHEN 'conservative' THEN 24 WHEN 'balanced' THEN 48 ELSE least(256, greatest(96, adm // {128 * MIB})) END::BIGINT AS cap FROM k),
 n AS (SELECT *, CAST(greatest(1, least(floor((adm * frac - fixed) / pf), least(frames, cap))) AS BIGINT) AS chunk, greatest(o * frames, 64 * {MIB})::BIGINT AS staging FROM m),
 cost AS (SELECT *, CAST(floor(12 * p * chunk * mult) AS BIGINT) + diag + p + staging + CASE WHEN vfr OR non_square THEN 3 * s * frames ELSE 0 END AS scratch, fixed + pf * least(chunk, frames) + pf * (workers - 1) AS need FROM n)"""


@query(f"WITH {_COST} SELECT o_orderkey, chunk, workers, queue, staging::BIGINT AS staging, scratch::BIGINT AS scratch, need::BIGINT AS need FROM cost")
def cost_model(spark, sf_dir):
    return costed(jobs(spark, sf_dir)).select("o_orderkey", "chunk", "workers", "queue", "staging", "scratch", "need")


#: Severity, code and condition of each issue, in order; a condition may build on the one before it.
ISSUES = (
    ("blocker", "output_container_invalid", "lower(container) <> 'mp4'"), ("blocker", "output_resolution_mismatch", "ow <> pw OR oh <> ph"), ("blocker", "output_resolution_even_required", "ow % 2 <> 0 OR oh % 2 <> 0"),
    ("blocker", "invalid_frequency_band", "high <= low"), ("blocker", "frequency_above_nyquist", "high >= fps / 2"), ("warning", "frequency_near_nyquist", "high < fps / 2 AND high >= fps / 2 * CAST(0.9 AS DOUBLE)"),
    ("warning", "low_frequency_under_supported_duration", "seconds * low < 2"), ("warning", "frequency_band_narrow", "high - low < greatest(CAST(0.5 AS DOUBLE), high * CAST(0.1 AS DOUBLE))"),
    ("warning", "variable_frame_rate_normalized", "vfr"), ("blocker", "display_transform_unsupported", "display"), ("blocker", "rotation_unsupported", "rotated"), ("warning", "pixel_aspect_ratio_normalized", "non_square"),
    ("blocker", "hdr_unsupported", "hdr"), ("blocker", "color_metadata_contradictory", "contradictory"), ("blocker", "decoded_format_unsupported", "NOT decodable"),
    ("warning", "heuristic_sdr_acceptance", "NOT rec709 AND heuristic"), ("blocker", "color_workflow_unsupported", "NOT rec709 AND NOT heuristic"), ("warning", "eight_bit_input_warning", "depth <= 8"), ("warning", "hardware_acceleration_fallback", "gpu"),
    ("blocker", "active_scratch_reservation_failed", f"scratch_free - scratch < {1024 * MIB}"), ("blocker", "output_volume_staging_insufficient", "output_free < staging"),
    ("warning", "retention_budget_likely_exceeded", "retained + diag > budget"), ("blocker", "ram_admission_failed", "ram - headroom < need"),
)


@query(f"WITH {_COST} " + " UNION ALL ".join(f"SELECT o_orderkey, '{s}' AS severity, '{c}' AS code FROM cost WHERE {cond}" for s, c, cond in ISSUES))
def admission_issues(spark, sf_dir):
    rules = [(s, c, F.expr(cond)) for s, c, cond in ISSUES]
    return R.issues(costed(jobs(spark, sf_dir)), rules).select("o_orderkey", "severity", "code")


_BLOCKED = " OR ".join(f"({cond})" for s, _, cond in ISSUES if s == "blocker")


@query(f"WITH {_COST} SELECT o_orderkey, NOT ({_BLOCKED}) AS can_render FROM cost")
def admission_report(spark, sf_dir):
    return costed(jobs(spark, sf_dir)).select("o_orderkey", (~F.expr(_BLOCKED)).alias("can_render"))


#: What a staged file shows against what was expected: code and condition.
STAGED = (
    ("encoder_exit", "l_linenumber = 7"), ("zero_size", "l_quantity < 2"), ("stream_count", "l_suppkey % 17 = 0"), ("has_audio", "l_partkey % 23 = 0"), ("dimensions", "l_suppkey % 13 = 0"), ("codec", "l_partkey % 19 = 0"), ("pixel_format", "l_orderkey % 29 = 0"),
    ("frames_and_duration", "fc IS NOT NULL AND du IS NOT NULL AND abs(fc - l_quantity) > 1 AND abs(du - l_quantity / 8) > CAST(0.125 AS DOUBLE)"), ("frames", "fc IS NOT NULL AND du IS NULL AND abs(fc - l_quantity) > 1"),
    ("duration", "fc IS NULL AND du IS NOT NULL AND abs(du - l_quantity / 8) > CAST(0.125 AS DOUBLE)"), ("no_evidence", "fc IS NULL AND du IS NULL"),
)
_SEEN = {"fc": "CASE WHEN l_orderkey % 5 <> 0 THEN l_quantity + l_partkey % 4 END", "du": "CASE WHEN l_suppkey % 3 <> 0 THEN l_quantity / 8 + (l_partkey % 5) * CAST(0.0625 AS DOUBLE) END"}
_STAGED = f"s AS (SELECT *, {', '.join(f'{sql} AS {name}' for name, sql in _SEEN.items())} FROM lineitem)"


@query(f"WITH {_STAGED} " + " UNION ALL ".join(f"SELECT l_orderkey, l_linenumber, '{c}' AS code FROM s WHERE {cond}" for c, cond in STAGED))
def staged_validation(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("*", *[F.expr(sql).alias(name) for name, sql in _SEEN.items()])
    return R.issues(rows, [("error", c, F.expr(cond)) for c, cond in STAGED]).select("l_orderkey", "l_linenumber", "code")


_ZONE = {
    "shape": "CASE WHEN p_partkey % 2 = 0 THEN 'rectangle' ELSE 'circle' END", "x": "CAST(p_partkey % 50 - 3 AS DOUBLE) * 20", "y": "CAST(p_size - 2 AS DOUBLE) * 8", "w": "CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_size * 6 - 12 AS DOUBLE) END",
    "h": "CAST(p_size * 4 - 8 AS DOUBLE)", "r": "CASE WHEN p_partkey % 7 <> 0 THEN CAST(p_size * 3 - 15 AS DOUBLE) END",
}


@query(f"""WITH z AS (SELECT p_partkey, {', '.join(f'{sql} AS {name}' for name, sql in _ZONE.items())} FROM part),
 c AS (SELECT p_partkey, CASE WHEN x < 0 OR y < 0 THEN 'negative_origin' WHEN shape = 'rectangle' THEN CASE WHEN w IS NULL OR h IS NULL THEN 'rectangle_dimensions_missing' WHEN w <= 0 OR h <= 0 THEN 'rectangle_dimensions_invalid' WHEN x + w > 640 OR y + h > 360 THEN 'rectangle_out_of_bounds' END
   ELSE CASE WHEN r IS NULL THEN 'circle_radius_missing' WHEN r <= 0 THEN 'circle_radius_invalid' WHEN x - r < 0 OR y - r < 0 OR x + r > 640 OR y + r > 360 THEN 'circle_out_of_bounds' END END AS code FROM z)
SELECT * FROM c WHERE code IS NOT NULL""")
def zone_validation(spark, sf_dir):
    zones = table(spark, sf_dir, "part").select("p_partkey", *[F.expr(sql).alias(name) for name, sql in _ZONE.items()])
    fault = X.zone_fault(*[F.col(c) for c in ("shape", "x", "y", "w", "h", "r")], F.lit(640), F.lit(360))
    return zones.select("p_partkey", fault.alias("code")).where("code is not null")


_TEXTS = "CASE o_orderkey % 9 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN 'N/A' WHEN 3 THEN '30' WHEN 4 THEN '24000/1001' WHEN 5 THEN concat(CAST(o_custkey AS STRING), ':', CAST(o_custkey % 4 AS STRING)) WHEN 6 THEN 'x/2' WHEN 7 THEN '0:1' ELSE concat(CAST(o_custkey AS STRING), '.75') END"
_DUCK = _TEXTS.replace("AS STRING", "AS VARCHAR")


@query(f"""WITH t AS (SELECT o_orderkey, {_DUCK} AS t, '{{"side_data_list": [' || CASE WHEN o_custkey % 3 = 0 THEN '{{"side_data_type": "Display Matrix", "rotation": ' || CAST(o_custkey % 4 * -90 AS VARCHAR) || '}}' ELSE '' END || '], "tags": {{"rotate": "' || CASE WHEN o_custkey % 5 = 0 THEN 'none' ELSE CAST(o_custkey % 4 * 90 AS VARCHAR) END || '"}}}}' AS js FROM orders),
 s AS (SELECT *, CASE WHEN contains(t, '/') THEN '/' WHEN contains(t, ':') THEN ':' END AS f, CASE WHEN contains(t, ':') THEN ':' WHEN contains(t, '/') THEN '/' END AS g FROM t),
 v AS (SELECT *, TRY_CAST(split_part(t, f, 1) AS DOUBLE) AS a, TRY_CAST(split_part(t, f, 2) AS DOUBLE) AS b, TRY_CAST(t AS DOUBLE) AS n FROM s)
SELECT o_orderkey, round(CASE WHEN t IS NULL OR t IN ('', 'N/A') THEN 0 WHEN f IS NULL THEN coalesce(n, 0) WHEN a IS NULL OR b IS NULL OR b = 0 THEN 0 ELSE a / b END, 6) + 0.0 AS rate,
 round(CASE WHEN t IS NULL OR t IN ('', 'N/A', '0:1', '1:0') THEN 1 WHEN g IS NULL THEN coalesce(n, 1) WHEN a IS NULL OR b IS NULL OR b = 0 THEN 1 ELSE a / b END, 6) + 0.0 AS ratio, coalesce(trunc(n)::BIGINT, 0) AS whole,
 CASE WHEN json_array_length(js, '$.side_data_list') > 0 THEN TRY_CAST(json_extract_string(js, '$.side_data_list[0].rotation') AS DOUBLE) ELSE TRY_CAST(json_extract_string(js, '$.tags.rotate') AS DOUBLE) END AS rotation FROM v""")
def probe_parsers(spark, sf_dir):
    text = F.expr(_TEXTS)
    matrix = F.when(F.col("o_custkey") % 3 == 0, F.format_string('{"side_data_type": "Display Matrix", "rotation": %d}', (F.col("o_custkey") % 4 * -90).cast("long"))).otherwise("")
    tag = F.when(F.col("o_custkey") % 5 == 0, "none").otherwise((F.col("o_custkey") % 4 * 90).cast("string"))
    stream = F.concat(F.lit('{"side_data_list": ['), matrix, F.lit('], "tags": {"rotate": "'), tag, F.lit('"}}'))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("t"), stream.alias("js"))
    return rows.select("o_orderkey", _r(X.parse_fraction(F.col("t"))).alias("rate"), _r(X.parse_ratio(F.col("t"))).alias("ratio"), X.parse_int(F.col("t")).alias("whole"), X.rotation(F.col("js")).alias("rotation"))


@query(f"""WITH {_JOBS}, r AS (SELECT *, CASE WHEN non_square THEN 1.25 ELSE 1.0 END::DOUBLE AS sar, sqrt(700000.0::DOUBLE / (sw * sh)) AS sc FROM j)
SELECT o_orderkey, round(round_even(high / 0.05::DOUBLE, 0) * 0.05::DOUBLE, 6) + 0.0 AS edge, round(least(greatest(1.10::DOUBLE - 0.70::DOUBLE * sqrt(pow(low / 4 - 0.5, 2) + pow(seconds / 25 - 0.5, 2)) / 0.5, 0.20), 1.0), 6) + 0.0 AS centre,
 CASE WHEN seconds / 20 >= 0.8 THEN 'High' WHEN seconds / 20 >= 0.6 THEN 'Moderate' WHEN seconds / 20 >= 0.4 THEN 'Low' ELSE 'Poor' END AS label, CAST(CASE WHEN abs(sar - 1) > 1e-3 THEN greatest(1, round_even(sw * sar, 0)) ELSE sw END AS INTEGER) AS square,
 CAST(CASE WHEN sw * sh <= pw * ph THEN pw WHEN sw * sh <= 700000 THEN sw ELSE greatest(greatest(2, floor(floor(sw * sc) / 2) * 2), pw) END AS INTEGER) AS aw, CAST(CASE WHEN sw * sh <= pw * ph THEN ph WHEN sw * sh <= 700000 THEN sh ELSE greatest(greatest(2, floor(floor(sh * sc) / 2) * 2), ph) END AS INTEGER) AS ah,
 (CASE WHEN rotated THEN NULL ELSE hdr END IS TRUE) OR coalesce(CASE WHEN vfr THEN low END >= 2.0, false) AS warned, NOT ((CASE WHEN rotated THEN NULL ELSE hdr END IS TRUE) OR coalesce(CASE WHEN vfr THEN low END >= 2.0, false)) OR coalesce(CASE WHEN display THEN NULL ELSE gpu END, false) AS may_render FROM r""")
def scalar_maps(spark, sf_dir):
    c = F.col
    rows = jobs(spark, sf_dir)
    aw, ah = X.analysis_size(c("sw"), c("sh"), c("pw"), c("ph"))
    warned, may = X.drift_gate(F.when(~c("rotated"), c("hdr")), F.when(c("vfr"), c("low")), F.when(~c("display"), c("gpu")))
    return rows.select(
        "o_orderkey", _r(X.band_edge(c("high"))).alias("edge"), _r(X.centre_weight(c("low") / 4, c("seconds") / 25)).alias("centre"), X.confidence_label(c("seconds") / 20).alias("label"),
        X.square_width(c("sw"), F.when(c("non_square"), 1.25).otherwise(1.0)).cast("int").alias("square"), aw.alias("aw"), ah.alias("ah"), warned.alias("warned"), may.alias("may_render"),
    )


@query(f"""WITH {_JOBS}, r AS (SELECT o_orderkey, CASE WHEN vfr THEN 0 ELSE fps END AS average, CASE WHEN display THEN 0 ELSE fps END AS nominal, vfr, non_square, seconds FROM j),
 f AS (SELECT *, CASE WHEN average > 0 THEN average WHEN nominal > 0 THEN nominal ELSE 1.0 END AS rate FROM r)
SELECT o_orderkey, rate, NOT (average > 0 AND nominal > 0 AND abs(average - nominal) < 1e-6) AS resample, non_square AS resize, greatest(1, ceil(seconds * rate - 1e-9))::BIGINT AS frames FROM f""")
def normalization_plan(spark, sf_dir):
    c = F.col
    rows = jobs(spark, sf_dir).select("o_orderkey", F.when(c("vfr"), 0.0).otherwise(c("fps")).alias("average"), F.when(c("display"), 0.0).otherwise(c("fps")).alias("nominal"), "non_square", "seconds")
    rate = F.when(c("average") > 0, c("average")).when(c("nominal") > 0, c("nominal")).otherwise(1.0)
    even = (c("average") > 0) & (c("nominal") > 0) & (F.abs(c("average") - c("nominal")) < 1e-6)
    return rows.select("o_orderkey", rate.alias("rate"), (~even).alias("resample"), c("non_square").alias("resize"), F.greatest(F.lit(1), F.ceil(c("seconds") * rate - 1e-9)).cast("long").alias("frames"))


#: Bands that a proxy tries besides the suggested one.
PROXY_BANDS = ((0.50, 1.50), (0.75, 2.50), (1.00, 5.00), (1.50, 5.00), (2.00, 6.00))


@query(f"""WITH {_JOBS}, c AS (SELECT o_orderkey, 0 AS i, low AS l, high AS h, fps FROM j UNION ALL SELECT o_orderkey, i, l, h, fps FROM j, (VALUES {', '.join(f'({i}, {lo}, {hi})' for i, (lo, hi) in enumerate(PROXY_BANDS, 1))}) v(i, l, h)),
 d AS (SELECT o_orderkey, i, least(greatest(l, 0.4::DOUBLE), least(fps * 0.45::DOUBLE, 6.0)) AS l, least(greatest(h, 0.4::DOUBLE), least(fps * 0.45::DOUBLE, 6.0)) AS h FROM c),
 e AS (SELECT o_orderkey, min(i) AS i, round(round_even(l / 0.05::DOUBLE, 0) * 0.05::DOUBLE, 6) + 0.0 AS low_hz, round(round_even(h / 0.05::DOUBLE, 0) * 0.05::DOUBLE, 6) + 0.0 AS high_hz FROM d WHERE h > l + 0.10::DOUBLE GROUP BY 1, 3, 4)
SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderkey ORDER BY i) AS INTEGER) AS nth, low_hz, high_hz FROM e""")
def candidate_bands_distinct(spark, sf_dir):
    from pyspark.sql import Window

    fixed = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(lo).alias("l"), F.lit(hi).alias("h")) for i, (lo, hi) in enumerate(PROXY_BANDS, 1)])
    own = F.array(F.struct(F.lit(0).alias("i"), F.col("low").alias("l"), F.col("high").alias("h")))
    rows = jobs(spark, sf_dir).select("o_orderkey", "fps", F.inline(F.concat(own, fixed)))
    hold = lambda c: F.least(F.greatest(F.col(c), F.lit(0.4)), F.least(F.col("fps") * 0.45, F.lit(6.0)))
    held = rows.withColumn("l", hold("l")).withColumn("h", hold("h")).where("h > l + 0.10D")
    held = held.select("o_orderkey", "i", _r(X.band_edge(F.col("l"))).alias("low_hz"), _r(X.band_edge(F.col("h"))).alias("high_hz"))
    first = held.groupBy("o_orderkey", "low_hz", "high_hz").agg(F.min("i").alias("i"))
    return first.select("o_orderkey", F.row_number().over(Window.partitionBy("o_orderkey").orderBy("i")).alias("nth"), "low_hz", "high_hz")


@query(f"""WITH {_JOBS}, t AS (SELECT DISTINCT ph AS h, CASE WHEN pw > ph THEN ph ELSE pw END AS s FROM j), z AS (SELECT *, least(greatest(16, round_even(s / 6.0::DOUBLE * 0.75, 0)), s) AS a FROM t),
 e AS (SELECT *, CAST(greatest(8, CASE WHEN a % 2 = 1 THEN a + CASE WHEN a = s THEN -1 ELSE 1 END ELSE a END) AS INTEGER) AS size FROM z), p AS (SELECT DISTINCT h, size, CAST(greatest(4, size // 2) AS INTEGER) AS step FROM e)
SELECT h AS height, size, CAST(g.i * step AS INTEGER) AS start FROM p, range(100) g(i) WHERE g.i * step <= h - size UNION SELECT h, size, h - size FROM p WHERE h > size""")
def tile_starts(spark, sf_dir):
    """Where the tiles of each processing size begin along its height."""
    small = F.least("pw", "ph")
    size = F.least(F.greatest(F.lit(16), F.rint(small / 6 * 0.75).cast("int")), small)
    even = F.greatest(F.lit(8), F.when(size % 2 == 1, F.when(size == small, size - 1).otherwise(size + 1)).otherwise(size))
    rows = jobs(spark, sf_dir).select(F.col("ph").cast("int").alias("height"), even.cast("int").alias("size")).distinct()
    step, last = F.greatest(F.lit(4), F.floor(F.col("size") / 2).cast("int")), F.greatest(F.col("height") - F.col("size"), F.lit(0))
    found = F.array_distinct(F.concat(F.sequence(F.lit(0), last, step), F.array(last)))
    return rows.select("height", "size", F.explode(found).alias("start"))


@query("""WITH t AS (SELECT c_custkey, list_filter([CASE WHEN c_custkey % 3 = 0 THEN 'bt709' WHEN c_custkey % 3 = 1 THEN 'bt2020' ELSE '' END, CASE WHEN c_nationkey % 4 = 0 THEN 'smpte2084' ELSE 'bt709' END, CASE WHEN c_custkey % 5 = 0 THEN 'tv' ELSE 'pc' END], lambda x: x <> '') AS tags FROM customer)
SELECT c_custkey, list_has_any(tags, ['bt2020', 'smpte2084', 'arib-std-b67']) AS hdr, len(list_filter(tags, lambda x: x NOT IN ('', 'bt709', 'tv', 'pc', 'gbr'))) = 0 AS rec709, array_to_string(list_sort(list_distinct(tags)), ',') AS tags FROM t""")
def colour_tags(spark, sf_dir):
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    given = F.array(F.when(key % 3 == 0, "bt709").when(key % 3 == 1, "bt2020").otherwise(""), F.when(nation % 4 == 0, "smpte2084").otherwise("bt709"), F.when(key % 5 == 0, "tv").otherwise("pc"))
    tags = F.array_union(F.filter(given, lambda x: x != ""), F.array().cast("array<string>"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", tags.alias("tags"))
    known = F.array(*map(F.lit, ("", "bt709", "tv", "pc", "gbr")))
    return rows.select("c_custkey", F.arrays_overlap("tags", F.array(*map(F.lit, ("bt2020", "smpte2084", "arib-std-b67")))).alias("hdr"), F.forall("tags", lambda x: F.array_contains(known, x)).alias("rec709"), F.array_join(F.array_sort("tags"), ",").alias("tags"))




#: The version that documents are written in, and the older minor versions that are read with a warning.
VERSION, OLDEST = (1, 5, 0), (1, 0)
_VERSION_TEXT = "CASE o_orderkey % 8 WHEN 0 THEN '1.5.0' WHEN 1 THEN '1.4.2' WHEN 2 THEN '1.0.0' WHEN 3 THEN '2.0.0' WHEN 4 THEN '1.6.0' WHEN 5 THEN '0.9.1' WHEN 6 THEN 'one' ELSE '1.5.0' END"


def sidecars(spark, sf_dir) -> DataFrame:
    """o_orderkey, body: a document (JSON) for each job: version, intent, what was observed, results."""
    rows = jobs(spark, sf_dir).join(table(spark, sf_dir, "orders").select("o_orderkey", F.expr(_VERSION_TEXT).alias("version")), "o_orderkey")
    intent = F.struct("low", "high", F.col("container"), F.struct(F.col("pw").alias("width"), F.col("ph").alias("height")).alias("size"))
    seen = F.struct(F.col("fps"), F.col("seconds"))
    body = F.struct(F.col("version").alias("schema_version"), intent.alias("intent"), seen.alias("observed_environment"), F.struct((F.col("fps") * F.col("seconds")).alias("frames")).alias("results"))
    return rows.select("o_orderkey", F.to_json(body).alias("body"))


def read_sidecars(docs: DataFrame) -> DataFrame:
    """o_orderkey, status, warning, low, high, width: documents read with a strict schema; only the intent is kept. Older minor versions are read with a warning; other versions, and bands that are none, are refused."""
    schema = "schema_version string, intent struct<low: double, high: double, container: string, size: struct<width: int, height: int>>"
    rows = docs.select("o_orderkey", F.from_json("body", schema).alias("d"))
    part = lambda i: F.regexp_extract("d.schema_version", r"^(\d+)\.(\d+)\.(\d+)$", i).try_cast("int")
    rows = rows.select("o_orderkey", part(1).alias("major"), part(2).alias("minor"), F.col("d.intent.*"))
    status = (
        F.when(F.col("major").isNull(), "version_malformed").when((F.col("major") != VERSION[0]) | (F.col("minor") > VERSION[1]), "version_unsupported").when(F.col("high") <= F.col("low"), "band_invalid").otherwise("valid")
    )
    rows = rows.withColumn("status", status)
    ok = F.col("status") == "valid"
    return rows.select("o_orderkey", "status", (ok & (F.col("minor") < VERSION[1])).alias("warning"), *[F.when(ok, F.col(c)).alias(c) for c in ("low", "high")], F.when(ok, F.col("size.width")).alias("width"))


@query(f"""WITH {_JOBS}, v AS (SELECT j.*, {_VERSION_TEXT} AS t FROM j), p AS (SELECT *, TRY_CAST(split_part(t, '.', 1) AS INTEGER) AS major, TRY_CAST(split_part(t, '.', 2) AS INTEGER) AS minor FROM v),
 s AS (SELECT *, CASE WHEN major IS NULL THEN 'version_malformed' WHEN major <> 1 OR minor > 5 THEN 'version_unsupported' WHEN high <= low THEN 'band_invalid' ELSE 'valid' END AS status FROM p)
SELECT o_orderkey, status, status = 'valid' AND coalesce(minor, 0) < 5 AS warning, CASE WHEN status = 'valid' THEN low END AS low, CASE WHEN status = 'valid' THEN high END AS high, CASE WHEN status = 'valid' THEN pw END AS width FROM s""")
def sidecar_validation(spark, sf_dir):
    return read_sidecars(sidecars(spark, sf_dir)).withColumn("warning", F.coalesce("warning", F.lit(False)))


@query("""WITH o AS (SELECT o_custkey, count(*) AS n, max(CASE WHEN o_orderstatus = 'F' THEN 'failed' WHEN o_orderstatus = 'O' THEN 'completed' END) AS status FROM orders GROUP BY 1)
SELECT c_custkey, coalesce(status, 'failed') AS status FROM customer LEFT JOIN o ON o_custkey = c_custkey WHERE coalesce(status, 'failed') <> 'completed'""")
def failed_runs(spark, sf_dir):
    """Scratch entries whose run didn't complete, or left no record."""
    state = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "completed")
    known = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(state).alias("status"))
    rows = table(spark, sf_dir, "customer").join(known, F.col("c_custkey") == F.col("o_custkey"), "left")
    return rows.select("c_custkey", F.coalesce("status", F.lit("failed")).alias("status")).where("status <> 'completed'")


@query("SELECT l_orderkey, l_linenumber, l_partkey % 3 IS DISTINCT FROM CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE l_suppkey % 3 END OR l_quantity IS DISTINCT FROM CASE WHEN l_partkey % 5 = 0 THEN l_quantity + 1 ELSE l_quantity END AS stale FROM lineitem")
def stale_sources(spark, sf_dir):
    """Whether a source's path, size or time differs from what was recorded; a missing record differs."""
    path, size = F.when(F.col("l_suppkey") % 4 != 0, F.col("l_suppkey") % 3), F.when(F.col("l_partkey") % 5 == 0, F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (~(F.col("l_partkey") % 3).eqNullSafe(path) | ~F.col("l_quantity").eqNullSafe(size)).alias("stale"))


#: A job's analysis settings from columns of a job, in SQL that both engines read; its manual bands are 0 to 12, not all rising or inside the phase band.
_SETTING = {
    "enabled": "o_custkey % 5 <> 0", "cutoff": "CAST(o_orderkey % 22 AS DOUBLE) / 20", "sure": "CAST(o_custkey % 22 AS DOUBLE) / 20", "support": "CAST(o_orderkey % 21 AS DOUBLE) / 19", "bands_asked": "o_custkey % 12",
    "mode": "CASE o_orderkey % 3 WHEN 0 THEN 'manual_single' WHEN 1 THEN 'manual_multi' ELSE 'auto' END", "n_manual": "CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE o_custkey % 13 END",
    "first": "low - CASE WHEN o_custkey % 7 = 0 THEN CAST(0.5 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END", "width": "CAST(o_custkey % 6 AS DOUBLE) / 4",
}
_SETTINGS = f"{_JOBS}, t AS (SELECT o_orderkey, o_custkey, low, high, {', '.join(f'{sql} AS {name}' for name, sql in _SETTING.items())} FROM j JOIN orders USING (o_orderkey)), st AS (SELECT *, list_transform(range(n_manual), lambda i: struct_pack(low_hz := first + i / 4::DOUBLE, high_hz := first + i / 4::DOUBLE + width)) AS manual FROM t)"


def settings(spark, sf_dir) -> DataFrame:
    """o_orderkey, o_custkey, low, high and a job's analysis settings, manual bands (low_hz, high_hz) among them."""
    keys = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    rows = jobs(spark, sf_dir).select("o_orderkey", "low", "high").join(keys, "o_orderkey").select("*", *[F.expr(sql).alias(name) for name, sql in _SETTING.items()])
    places = F.slice(F.sequence(F.lit(0), F.lit(12)), F.lit(1), F.col("n_manual").cast("int"))
    return rows.withColumn("manual", F.transform(places, lambda i: F.struct((F.col("first") + i / 4).alias("low_hz"), (F.col("first") + i / 4 + F.col("width")).alias("high_hz"))))


@query(f"""WITH {_SETTINGS} SELECT o_orderkey, NOT enabled OR (cutoff BETWEEN 0 AND 1 AND sure BETWEEN 0 AND 1 AND support > 0 AND support <= 1 AND bands_asked BETWEEN 1 AND 10 AND (mode = 'auto' OR (
  CASE mode WHEN 'manual_single' THEN n_manual = 1 ELSE n_manual BETWEEN 1 AND 10 END AND len(list_filter(manual, lambda b: b.high_hz <= b.low_hz OR b.low_hz < low OR b.high_hz > high)) = 0))) AS valid FROM st""")
def settings_valid(spark, sf_dir):
    """Whether a job's analysis settings can be run."""
    rows = settings(spark, sf_dir)
    return rows.select("o_orderkey", J.settings_fit(*[F.col(c) for c in ("enabled", "cutoff", "sure", "support", "bands_asked", "mode", "manual", "low", "high")]).alias("valid"))
