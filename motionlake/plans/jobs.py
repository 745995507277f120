"""Queries on runs of jobs: users' events as a job's, in order."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.jobs import EVENTS, exit_verdict, machine
from ..operators import scans as Z
from ..sources import micros, table
from ..streaming import appended
from ..streaming import watch as W
from .queries import _rounded, query

#: What an event does, by its number: mostly what a run needs, one after another.
SCRIPT = ("load", "settings_done", "hash_done", "start", "render", "complete", "load", "hash_done", "start", "render", "fail", "source_changed", "reset", "hash_done", "start", "abort", "source_same", "start", "cancel", "settings_open", "settings_done", "reset", "hash_failed", "load", "hash_done", "start", "render")
_WHAT = "CASE (event_id // 5 + user_id) % 27 " + " ".join(f"WHEN {i} THEN '{e}'" for i, e in enumerate(SCRIPT)) + " END"
_RUN, _END = "mode IN ('preflight', 'rendering')", "mode IN ('complete', 'failed', 'cancelled')"
_READY = "mode = 'setup' AND loaded AND NOT pending AND settings AND hashed AND NOT stale"
_LEGAL = f"CASE what WHEN 'start' THEN {_READY} WHEN 'render' THEN mode = 'preflight' WHEN 'abort' THEN mode = 'preflight' WHEN 'complete' THEN mode = 'rendering' WHEN 'fail' THEN {_RUN} WHEN 'cancel' THEN {_RUN} WHEN 'reset' THEN {_END} ELSE true END"
_STATE = "CASE WHEN mode <> 'setup' THEN mode WHEN NOT loaded THEN 'idle' WHEN pending THEN 'fingerprint_pending' WHEN settings AND hashed AND NOT stale THEN 'ready' ELSE 'loaded' END"


def _actions(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("user_id is not null").select("user_id", "event_id", micros(F.col("ts")).alias("us"))
    at = ((F.floor(F.col("event_id") / 5) + F.col("user_id")) % len(SCRIPT)).cast("int")
    return Z.placed(rows.withColumn("what", F.get(F.array(*map(F.lit, SCRIPT)), at)), "user_id", ["us", "event_id"])


@query(f"""WITH RECURSIVE e AS (SELECT user_id, event_id, {_WHAT} AS what, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE user_id IS NOT NULL),
 s AS (SELECT DISTINCT user_id, NULL::BIGINT AS event_id, 0::BIGINT AS i, true AS legal, 'setup' AS mode, false AS loaded, false AS known, false AS settings, false AS pending, false AS hashed, false AS stale FROM e
  UNION ALL SELECT e.user_id, e.event_id, e.i, {_LEGAL},
   CASE WHEN NOT {_LEGAL} THEN mode WHEN what = 'load' AND {_END} THEN 'setup' WHEN what = 'start' THEN 'preflight' WHEN what = 'render' THEN 'rendering' WHEN what IN ('abort', 'reset') THEN 'setup' WHEN what = 'complete' THEN 'complete' WHEN what = 'fail' THEN 'failed' WHEN what = 'cancel' THEN 'cancelled' ELSE mode END,
   loaded OR what = 'load', known OR what IN ('load', 'hash_done'), CASE what WHEN 'settings_done' THEN true WHEN 'settings_open' THEN false ELSE settings END,
   CASE WHEN what = 'load' THEN true WHEN what IN ('hash_done', 'hash_failed') OR (what = 'source_changed' AND known) THEN false ELSE pending END,
   CASE WHEN what = 'hash_done' THEN true WHEN what IN ('load', 'hash_failed') OR (what = 'source_changed' AND known) THEN false ELSE hashed END,
   CASE WHEN what IN ('load', 'hash_done') OR (what = 'source_same' AND known) THEN false WHEN what = 'source_changed' AND known THEN true ELSE stale END
  FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1)
SELECT user_id, event_id, legal, {_STATE} AS state FROM s WHERE i > 0""")
def job_states(spark, sf_dir):
    """The state of each user's job after each event; illegal ones move nothing and are told."""
    jobs, moves = machine()
    rows = Z.states(_actions(spark, sf_dir), "user_id", "what", moves)
    illegal = F.array(*[F.concat_ws(":", F.lit(e), F.lit(i)) for e in EVENTS for i, to in enumerate(moves[e]) if to < 0])
    names = F.array(*[F.lit(job.state) for job in jobs])
    return rows.select("user_id", "event_id", (~F.array_contains(illegal, F.concat_ws(":", "what", "before"))).alias("legal"), F.get(names, F.col("after")).alias("state"))


@query("""WITH e AS (SELECT *, value AS v, event_type = 'signup' AS fresh FROM events WHERE user_id IS NOT NULL),
 r AS (SELECT *, count(*) FILTER (WHERE fresh) OVER w AS run FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))
SELECT user_id, event_id, run::BIGINT AS run, round(max(v) OVER w, 6) + 0.0 AS progress, last_value(CASE WHEN event_type = 'click' THEN v END IGNORE NULLS) OVER w AS latest
FROM r WINDOW w AS (PARTITION BY user_id, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def monotone_progress(spark, sf_dir):
    """Progress that never falls within a run, each signup beginning a new one; and what the last click reported. Long histories are scanned in ranges."""
    rows = table(spark, sf_dir, "events").where("user_id is not null").select("user_id", "event_id", "event_type", "value", micros(F.col("ts")).alias("us"))
    told = Z.running(Z.placed(rows, "user_id", ["us", "event_id"]), "user_id", run=("sum", (F.col("event_type") == "signup").cast("long")))
    named = told.drop("part_", "at_").withColumn("job", F.concat_ws("|", F.col("user_id").cast("string"), F.lpad(F.col("run").cast("string"), 12, "0")))
    found = Z.running(Z.placed(named, "job", ["us", "event_id"]), "job", progress=("max", F.col("value")), latest=("last", F.when(F.col("event_type") == "click", F.col("value"))))
    return _rounded(found.select("user_id", "event_id", "run", "progress", "latest"), "progress")


@query("""WITH f AS (SELECT page_id, regexp_replace(split_part(split_part(url, '?', 1), '#', 1), '^[a-z]+://', '') AS path, coalesce(strlen(html), 0) AS size FROM pages WHERE url IS NOT NULL),
 r AS (SELECT DISTINCT split_part(path, '/', 1) AS root FROM f WHERE page_id % 3 = 0 UNION SELECT DISTINCT array_to_string(string_split(path, '/')[1:2], '/') FROM f WHERE page_id % 5 < 3),
 m AS (SELECT page_id, arg_min(root, length(root)) AS root, any_value(size) AS size FROM f JOIN r ON f.path = r.root OR starts_with(f.path, r.root || '/') WHERE NOT contains(path, '/fr/') GROUP BY 1)
SELECT root, count(*)::BIGINT AS files, sum(size)::BIGINT AS bytes FROM m GROUP BY 1""")
def retained_bytes(spark, sf_dir):
    """Bytes under each root of a tree of pages, with a part excluded; a root within another one counts with it, once."""
    path = F.regexp_replace(F.split_part(F.split_part("url", F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1)), "^[a-z]+://", "")
    files = table(spark, sf_dir, "pages").where("url is not null").select("page_id", path.alias("path"), F.coalesce(F.octet_length("html"), F.lit(0)).cast("long").alias("size"))
    first = lambda n: F.array_join(F.slice(F.split("path", "/"), 1, n), "/").alias("root")
    roots = files.where("page_id % 3 = 0").select(first(1)).union(files.where("page_id % 5 < 3").select(first(2)))
    kept = Z.topmost(files.where(~F.contains("path", F.lit("/fr/"))), roots)
    return kept.groupBy("root").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


_HOUR = 3_600_000_000
_SOFT, _HARD, _STALL, _SPANS = 4 * _HOUR, 12 * _HOUR, 30 * _HOUR, 4
#: What an event says of its worker, in SQL that both engines read.
_SAYS = "CASE event_type WHEN 'view' THEN 'heartbeat' WHEN 'signup' THEN 'stage_started' WHEN 'click' THEN 'progress_update' WHEN 'purchase' THEN 'child_counter' ELSE 'hello' END"
_TOKEN, _COUNT = "CAST(CAST(floor(value / 40) AS BIGINT) AS VARCHAR(20))", "CAST(floor(value) AS BIGINT)"


@query(f"""WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS us, {_SAYS} AS what, {_TOKEN} AS token, {_COUNT} AS counter FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL),
 edge AS (SELECT max(us) // 1000 - (((max(us) - min(us)) // {_SPANS} + 1) // 1000 + 1) AS wm FROM e), o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS i FROM e),
 b AS (SELECT *, count(*) FILTER (WHERE what = 'heartbeat') OVER w AS beats, max(us) OVER (PARTITION BY user_id) AS seen, max(counter) FILTER (WHERE what = 'child_counter') OVER p AS top FROM o WINDOW w AS (PARTITION BY user_id ORDER BY i), p AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 t AS (SELECT user_id, i, lag(token) OVER (PARTITION BY user_id ORDER BY i) AS before FROM o WHERE what = 'progress_update' AND token IS NOT NULL),
 s AS (SELECT b.user_id, us, seen, i, what = 'heartbeat' OR (beats = 0 AND what <> 'child_counter') AS heard, what = 'stage_started' OR (what = 'progress_update' AND token IS NOT NULL AND token IS DISTINCT FROM t.before) OR (what = 'child_counter' AND counter > coalesce(top, counter - 1)) AS moved FROM b LEFT JOIN t USING (user_id, i)),
 a AS (SELECT user_id, us, coalesce(lead(us) OVER (PARTITION BY user_id ORDER BY i), greatest(seen, wm * 1000)) AS next, unnest([('warning', {_SOFT}), ('unresponsive', {_HARD})]) AS l FROM s, edge WHERE heard
  UNION ALL SELECT user_id, us, coalesce(lead(us) OVER (PARTITION BY user_id ORDER BY i), greatest(seen, wm * 1000)), ('stalled', {_STALL}) FROM s, edge WHERE moved)
SELECT user_id, l[1] AS kind, us + l[2] AS due FROM a WHERE next - us > l[2]""")
def stream_inactivity(spark, sf_dir):
    """Silences and stalls of each user's worker, found by timers while its messages stream in."""
    rows = table(spark, sf_dir, "events").where("user_id is not null").select("user_id", micros(F.col("ts")).alias("us"), "event_id", F.expr(_SAYS).alias("what"), F.expr(_TOKEN).cast("string").alias("token"), F.expr(_COUNT).alias("counter"))
    stream, late = W.in_spans(rows, "user_id", _SPANS)
    return appended(W.alarms(stream, "user_id", late, _SOFT, _HARD, _STALL))


_LAST = "CASE event_type WHEN 'click' THEN 'job_completed' WHEN 'purchase' THEN 'failure' WHEN 'signup' THEN 'job_cancelled' END"


@query(f"""WITH l AS (SELECT user_id, arg_max({_LAST}, (epoch_us(ts), event_id)) FILTER (WHERE value > 150 AND {_LAST} IS NOT NULL) AS last, CASE user_id % 4 WHEN 2 THEN 1 WHEN 3 THEN NULL ELSE 0 END AS code, user_id % 8 < 5 AS asked FROM events WHERE user_id IS NOT NULL GROUP BY user_id)
SELECT user_id, CASE WHEN last = 'job_completed' AND code = 0 THEN 'complete' WHEN last = 'job_cancelled' AND coalesce(code, 0) = 0 AND asked THEN 'cancelled' ELSE 'failed' END AS status,
 CASE WHEN last = 'job_completed' THEN CASE WHEN code = 0 THEN NULL ELSE 'worker_claimed_success_then_nonzero_exit' END WHEN last = 'failure' THEN 'worker_reported_failure'
  WHEN last = 'job_cancelled' THEN CASE WHEN code <> 0 THEN 'worker_reported_cancel_then_nonzero_exit' WHEN asked THEN NULL ELSE 'unexpected_job_cancelled' END WHEN code = 0 THEN 'worker_protocol_failure' ELSE 'worker_terminated_unexpectedly' END AS reason FROM l""")
def worker_exits(spark, sf_dir):
    """How each user's worker ended: its exit code against the last terminal message of those that weren't lost: here, those of a value over 150."""
    said = F.expr(_LAST)
    at = F.when(said.isNotNull() & (F.col("value") > 150), F.struct(micros(F.col("ts")), F.col("event_id")))
    rows = table(spark, sf_dir, "events").where("user_id is not null").groupBy("user_id").agg(F.max_by(said, at).alias("last"))
    code = F.when(F.col("user_id") % 4 == 2, 1).when(F.col("user_id") % 4 != 3, 0)
    return rows.select("user_id", exit_verdict(code, F.col("last"), F.col("user_id") % 8 < 5).alias("v")).select("user_id", "v.status", "v.reason")
