"""Queries on documents that are written, broken ones among them, read back and checked."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import documents as D
from ..sources import shared_dir
from .documents import _JOBS, _SETTINGS, jobs, settings
from .queries import query

#: What a document says beyond its job's settings, in SQL that both engines read; keys are an order's.
_SAID = {
    "version": "CASE o_orderkey % 9 WHEN 0 THEN '1.4.0' WHEN 1 THEN '1.4.2' WHEN 2 THEN '1.0.0' WHEN 3 THEN '2.0.0' WHEN 4 THEN '1.6.0' WHEN 5 THEN '1.5' ELSE '1.5.0' END",
    "seen": "'f' || CAST(o_custkey % 7 AS VARCHAR(20))", "reviewed": "CASE WHEN o_custkey % 5 = 0 THEN 'f' || CAST(o_orderkey % 7 AS VARCHAR(20)) END", "fps_given": "o_orderkey % 3 <> 0", "size_given": "o_orderkey % 5 <> 0", "steps": "CASE WHEN o_orderkey % 4 < 2 THEN 'cfr' END",
    "broken": "o_orderkey % 41 = 0", "text_low": "o_orderkey % 43 = 0", "no_size": "o_orderkey % 47 = 0", "noted": "o_custkey % 53 = 0", "odd_mode": "o_custkey % 59 = 0",
}
_COLUMNS = "pw, ph, ow, oh, vfr"
_DOCS = f"{_SETTINGS}, d AS (SELECT st.*, {_COLUMNS}, {', '.join(f'{sql} AS {name}' for name, sql in _SAID.items())} FROM st JOIN (SELECT o_orderkey, {_COLUMNS} FROM j) USING (o_orderkey))"


def bodies(spark, sf_dir) -> DataFrame:
    """raw: a document of each order's job, which begins with its number."""
    rows = settings(spark, sf_dir).join(jobs(spark, sf_dir).select("o_orderkey", *_COLUMNS.split(", ")), "o_orderkey").select("*", *[F.expr(sql).alias(name) for name, sql in _SAID.items()])
    size = lambda w, h: F.struct(F.col(w).alias("width"), F.col(h).alias("height"))
    mode = F.when(F.col("odd_mode"), "some").otherwise(F.col("mode"))
    analysis = F.struct(F.col("bands_asked").alias("auto_band_count"), mode.alias("band_mode"), F.col("manual").alias("manual_bands"), F.when(F.col("noted"), "x").alias("note"))
    intent = F.struct(F.struct(F.col("low").alias("low_hz"), F.col("high").alias("high_hz")).alias("phase"), F.when(~F.col("no_size"), size("pw", "ph")).alias("processing_resolution"), size("ow", "oh").alias("output_resolution"), analysis.alias("analysis"))
    ready = F.struct((~F.col("vfr")).alias("source_is_cfr"), F.when(F.col("fps_given"), 24.0).alias("working_fps"), F.when(F.col("size_given"), size("pw", "ph")).alias("working_source_resolution"), F.when(F.col("steps").isNotNull(), F.array("steps")).alias("normalization_steps"))
    ack = F.when(F.col("reviewed").isNotNull(), F.struct(F.col("reviewed").alias("reviewed_source_fingerprint_sha256")))
    results = F.struct(F.struct(F.col("seen").alias("fingerprint_sha256")).alias("source"), ready.alias("preflight"), ack.alias("drift_acknowledgement"))
    body = F.to_json(F.struct(F.col("o_orderkey").alias("job"), F.col("version").alias("schema_version"), intent.alias("intent"), results.alias("results")))
    body = F.when(F.col("text_low"), F.regexp_replace(body, r'"phase":\{"low_hz":([0-9.]+)', r'"phase":{"low_hz":"$1"')).otherwise(body)
    return rows.select(F.when(F.col("broken"), F.substring(body, F.lit(1), F.length(body) - 3)).otherwise(body).alias("raw"))


def _read(spark, sf_dir) -> DataFrame:
    """o_orderkey and each document, written as lines and read back, checked; a broken one's number is found in its text."""
    path = f"{shared_dir(spark)}/sidecars/{uuid.uuid4().hex}"
    bodies(spark, sf_dir).write.text(path)
    number = F.regexp_extract("raw", r'^\{"job":(\d+)', 1).try_cast("bigint")
    return D.checked(D.read_lines(spark, path)).withColumn("o_orderkey", number)


_TOLD = f"""{_DOCS}, shape AS (SELECT o_orderkey, unnest([CASE WHEN text_low THEN ['intent.phase.low_hz', 'kind'] END, CASE WHEN no_size THEN ['intent.processing_resolution', 'required'] END, CASE WHEN noted THEN ['intent.analysis.note', 'unknown'] END, CASE WHEN odd_mode THEN ['intent.analysis.band_mode', 'choice'] END]) AS v FROM d WHERE NOT broken),
 ver AS (SELECT o_orderkey, CASE version WHEN '1.4.0' THEN 'version_compatible' WHEN '1.0.0' THEN 'version_compatible' WHEN '1.4.2' THEN 'version_older' WHEN '2.0.0' THEN 'version_major' WHEN '1.6.0' THEN 'version_newer' WHEN '1.5' THEN 'version_malformed' END AS rule FROM d WHERE NOT (broken OR text_low OR no_size OR noted OR odd_mode)),
 fit AS (SELECT *, vfr OR steps IS NOT NULL AS derived FROM d JOIN ver USING (o_orderkey) WHERE coalesce(rule, 'version_compatible') = 'version_compatible'),
 sense AS (SELECT o_orderkey, unnest([CASE WHEN high <= low THEN ['intent.phase.high_hz', 'not_above_low'] END, CASE WHEN bands_asked NOT BETWEEN 1 AND 10 THEN ['intent.analysis.auto_band_count', 'out_of_range'] END, CASE WHEN n_manual > 10 THEN ['intent.analysis.manual_bands', 'too_many'] END,
   CASE WHEN mode <> 'auto' AND n_manual = 0 THEN ['intent.analysis.manual_bands', 'none_given'] END, CASE WHEN pw <> ow OR ph <> oh THEN ['intent.output_resolution', 'not_as_processed'] END, CASE WHEN reviewed <> seen THEN ['results.drift_acknowledgement.reviewed_source_fingerprint_sha256', 'not_the_source'] END,
   CASE WHEN derived AND NOT fps_given THEN ['results.preflight.working_fps', 'needed_when_derived'] END, CASE WHEN derived AND NOT size_given THEN ['results.preflight.working_source_resolution', 'needed_when_derived'] END, CASE WHEN derived AND steps IS NULL THEN ['results.preflight.normalization_steps', 'needed_when_derived'] END]) AS v FROM fit
  UNION ALL SELECT o_orderkey, ['intent.analysis.manual_bands.' || i || '.high_hz', 'not_above_low'] FROM fit, range(12) r(i) WHERE i < n_manual AND width <= 0),
 told AS (SELECT o_orderkey, '' AS path, 'malformed' AS rule, 'error' AS severity FROM d WHERE broken UNION ALL SELECT o_orderkey, v[1], v[2], 'error' FROM shape WHERE v IS NOT NULL
  UNION ALL SELECT o_orderkey, 'schema_version', rule, CASE rule WHEN 'version_compatible' THEN 'warning' ELSE 'error' END FROM ver WHERE rule IS NOT NULL UNION ALL SELECT o_orderkey, v[1], v[2], 'error' FROM sense WHERE v IS NOT NULL)"""


@query(f"WITH {_TOLD} SELECT * FROM told")
def sidecar_violations(spark, sf_dir):
    """Each rule that a document breaks, and where."""
    return _read(spark, sf_dir).select("o_orderkey", F.inline("violations"))


@query(f"""WITH {_TOLD}, bad AS (SELECT o_orderkey, bool_or(severity = 'error') AS error FROM told GROUP BY 1)
SELECT o_orderkey, CASE WHEN error THEN 'invalid' ELSE 'valid_with_warnings' END AS status, CASE WHEN NOT error THEN low END AS low_hz, CASE WHEN NOT error THEN high END AS high_hz, CASE WHEN NOT error THEN pw END AS width, CASE WHEN NOT error THEN ph END AS height, CASE WHEN NOT error THEN mode END AS band_mode, CASE WHEN NOT error THEN n_manual END AS n_bands FROM d JOIN bad USING (o_orderkey)
UNION ALL SELECT o_orderkey, 'valid', low, high, pw, ph, mode, n_manual FROM d WHERE o_orderkey NOT IN (SELECT o_orderkey FROM bad)""")
def sidecar_intents(spark, sf_dir):
    """Each document's status, and what a valid one intends; results and environment are left behind."""
    rows = D.intended(_read(spark, sf_dir))  # all in one pass: each document is read and checked once
    return rows.select("o_orderkey", "status", "low_hz", "high_hz", "width", "height", "band_mode", F.when(F.col("bands").isNotNull(), F.size("bands")).alias("n_bands"))
