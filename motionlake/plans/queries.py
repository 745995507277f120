"""Queries over the driver's tables and the SQL that they are held against."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import streaming as T
from ..operators import bands as B
from ..operators import grid as G
from ..operators import rules as R
from ..operators import series as S
from ..sources import grid, micros, series, series_arrays, table

N, FPS = 128, 16.0
LOW, HIGH = 1.0, 4.0
ZONES = [
    {"shape": "rectangle", "mode": "include", "x": 5.0, "y": 900.0, "width": 30.0, "height": 500.0},
    {"shape": "circle", "mode": "include", "x": 40.0, "y": 1500.0, "radius": 120.0},
    {"shape": "circle", "mode": "exclude", "x": 20.0, "y": 1100.0, "radius": 60.0},
]
QUERIES: dict = {}
ORACLE: dict = {}


_OFF = {4: 1e-7, 6: 1e-9}


def _r(column, places: int = 6):
    """Rounded a hair off, so that sums in another order don't part at exact halves."""
    return F.round(column + _OFF[places], places) + F.lit(0.0)


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: _r(F.col(c)) for c in columns})


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql.replace(", 4) + 0.0", " + 1e-7::DOUBLE, 4) + 0.0").replace(", 6) + 0.0", " + 1e-9::DOUBLE, 6) + 0.0")
        return f

    return add


_BOUNDS = "b AS (SELECT min(epoch_us(ts)) AS lo, max(epoch_us(ts)) AS hi FROM events)"


def _series_sql(key: str) -> str:
    return f"""{_BOUNDS}, m AS (
      SELECT CAST({key} AS VARCHAR) AS series_key, CAST((epoch_us(ts) - lo) * {N} // (hi - lo + 1) AS INTEGER) AS n, avg(value) AS x FROM events, b GROUP BY 1, 2
    ), s AS (
      SELECT k.series_key, CAST(g.n AS INTEGER) AS n, coalesce(m.x, 0.0) AS x FROM (SELECT DISTINCT series_key FROM m) k CROSS JOIN range({N}) g(n)
      LEFT JOIN m ON m.series_key = k.series_key AND m.n = g.n
    ), c AS (SELECT series_key, n, x - avg(x) OVER (PARTITION BY series_key) AS x FROM s)"""


def _spectra_sql(key: str) -> str:
    return f"""{_series_sql(key)}, f AS (
      SELECT series_key, CAST(k AS INTEGER) AS k, k * ({FPS} / {N})::DOUBLE AS freq_hz,
        sqrt(pow(sum(x * cos((k * n % {N}) * {2 * math.pi / N}::DOUBLE)), 2) + pow(sum(x * sin((k * n % {N}) * {2 * math.pi / N}::DOUBLE)), 2)) / {N} AS amp
      FROM c CROSS JOIN range({N // 2 + 1}) g(k) GROUP BY series_key, k
    )"""


def _events(spark: SparkSession, sf_dir: str, key: str = "event_type") -> DataFrame:
    return series(table(spark, sf_dir, "events"), key, N)


def _spectra(spark: SparkSession, sf_dir: str, key: str = "event_type") -> DataFrame:
    return S.spectrum(series_arrays(table(spark, sf_dir, "events"), key, N), N, FPS)


@query(f"WITH {_series_sql('event_type')} SELECT series_key, n, round(x, 6) + 0.0 AS x FROM s")
def series_bucketize(spark, sf_dir):
    return _rounded(_events(spark, sf_dir), "x")


@query(f"WITH {_series_sql('user_id')} SELECT series_key, round(sqrt(avg(x * x)), 6) + 0.0 AS rms FROM c GROUP BY 1")
def series_center_rms(spark, sf_dir):
    return _rounded(S.rms(S.centred(_events(spark, sf_dir, "user_id"))), "rms")


@query(f"WITH {_spectra_sql('event_type')} SELECT series_key, k, round(freq_hz, 6) + 0.0 AS freq_hz, round(amp, 6) + 0.0 AS amp FROM f")
def series_dft_amplitude(spark, sf_dir):
    return _rounded(_spectra(spark, sf_dir), "freq_hz", "amp")


@query(f"""WITH {_spectra_sql('user_id')} SELECT series_key, round(sum(CASE WHEN freq_hz BETWEEN {LOW} AND {HIGH} THEN amp * amp ELSE 0 END), 6) + 0.0 AS band, round(sum(amp * amp), 6) + 0.0 AS total FROM f GROUP BY 1""")
def heatmap_energy(spark, sf_dir):
    return _rounded(S.band_energy(_spectra(spark, sf_dir, "user_id"), LOW, HIGH), "band", "total")


@query(f"""WITH {_series_sql('event_type')}, t AS (
  SELECT series_key, n, (coalesce(lag(x, 2) OVER w, 0) + 2 * coalesce(lag(x) OVER w, 0) + 3 * x + 2 * coalesce(lead(x) OVER w, 0) + coalesce(lead(x, 2) OVER w, 0)) / 9 AS x
  FROM s WINDOW w AS (PARTITION BY series_key ORDER BY n)
) SELECT series_key, n, round(x - avg(x) OVER (PARTITION BY series_key), 6) + 0.0 AS x FROM t QUALIFY count(*) OVER (PARTITION BY series_key) >= 32 AND stddev_pop(x) OVER (PARTITION BY series_key) > 1e-6""")
def series_smooth5(spark, sf_dir):
    return _rounded(S.smooth5(_events(spark, sf_dir)), "x")


@query(f"WITH {_series_sql('event_type')} SELECT series_key, n, round(x - coalesce(lag(x) OVER (PARTITION BY series_key ORDER BY n), x), 6) + 0.0 AS x FROM s")
def series_diff(spark, sf_dir):
    return _rounded(S.difference(_events(spark, sf_dir)), "x")


@query(f"WITH {_series_sql('event_type')} SELECT series_key, n, round(sqrt(sum(x * x) OVER (PARTITION BY series_key ORDER BY n ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) / 7), 6) + 0.0 AS x FROM c")
def series_rms_envelope(spark, sf_dir):
    return _rounded(S.rms_envelope(S.centred(_events(spark, sf_dir)), 7), "x")


@query(f"""WITH RECURSIVE {_series_sql('event_type')}, y AS (
  SELECT series_key, n, {S.low_pass_gain(FPS, HIGH)}::DOUBLE * x AS h, {S.low_pass_gain(FPS, LOW)}::DOUBLE * x AS l FROM s WHERE n = 0
  UNION ALL
  SELECT s.series_key, s.n, y.h + {S.low_pass_gain(FPS, HIGH)}::DOUBLE * (s.x - y.h), y.l + {S.low_pass_gain(FPS, LOW)}::DOUBLE * (s.x - y.l) FROM y JOIN s ON s.series_key = y.series_key AND s.n = y.n + 1
) SELECT series_key, n, round(h - l, 6) + 0.0 AS x FROM y""")
def series_iir_bandpass(spark, sf_dir):
    return _rounded(S.iir_band_pass(_events(spark, sf_dir), FPS, LOW, HIGH), "x")


_PEAKS = """, w AS (SELECT *, lag(amp) OVER v AS p, lead(amp) OVER v AS q FROM f WINDOW v AS (PARTITION BY series_key ORDER BY k)),
  l AS (SELECT * FROM w WHERE p IS NOT NULL AND q IS NOT NULL AND amp >= p AND amp >= q AND freq_hz > 0),
  z AS (SELECT *, quantile_cont(amp, 0.5) OVER (PARTITION BY series_key) + 0.5 * stddev_pop(amp) OVER (PARTITION BY series_key) AS least FROM l),
  a AS (SELECT *, bool_or(amp >= least) OVER (PARTITION BY series_key) AS any_ FROM z),
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY series_key ORDER BY amp DESC, k) AS INTEGER) AS rank FROM a WHERE NOT any_ OR amp >= least)"""


@query(f"WITH {_spectra_sql('event_type')} {_PEAKS} SELECT series_key, rank, k, round(freq_hz, 6) + 0.0 AS freq_hz, round(amp, 6) + 0.0 AS amp FROM r WHERE rank <= 3")
def peaks_qa_top3(spark, sf_dir):
    return _rounded(S.peaks(_spectra(spark, sf_dir), 3), "freq_hz", "amp")


@query(f"WITH {_spectra_sql('user_id')} {_PEAKS} SELECT series_key, rank, k, round(freq_hz, 6) + 0.0 AS freq_hz, round(amp, 6) + 0.0 AS amp FROM r WHERE rank <= 10")
def peaks_qa_top10(spark, sf_dir):
    return _rounded(S.peaks(_spectra(spark, sf_dir, "user_id"), 10), "freq_hz", "amp")


@query(f"""WITH {_spectra_sql('event_type')}, w AS (SELECT *, avg(amp) OVER v AS m, count(amp) OVER v AS c FROM f WINDOW v AS (PARTITION BY series_key ORDER BY k ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
SELECT series_key, k, round(least(greatest(1 - m / amp, 0.0), 1.0), 6) + 0.0 AS sharpness FROM w WHERE c = 5 AND amp > 1e-9""")
def peak_sharpness(spark, sf_dir):
    return _rounded(S.sharpness(_spectra(spark, sf_dir)), "sharpness")


@query(f"WITH {_spectra_sql('user_id')} SELECT k, round(freq_hz, 6) + 0.0 AS freq_hz, round(quantile_cont(amp, 0.5), 6) + 0.0 AS amp FROM f GROUP BY k, freq_hz")
def median_spectrum(spark, sf_dir):
    return _rounded(S.median_spectrum(_spectra(spark, sf_dir, "user_id")), "freq_hz", "amp")


@query(f"""WITH {_spectra_sql('user_id')} {_PEAKS}, h AS (SELECT series_key, k, CASE WHEN k BETWEEN 1 AND {N // 2 - 1} AND amp > 0 AND (k = 1 OR amp > lag(amp) OVER v) AND (k = {N // 2 - 1} OR amp >= lead(amp) OVER v) THEN 1.0 ELSE 0.0 END::DOUBLE AS hit FROM f WINDOW v AS (PARTITION BY series_key ORDER BY k))
SELECT k, round(avg(hit), 6) + 0.0 AS support FROM h WHERE k IN (SELECT k FROM r WHERE rank <= 10) GROUP BY k""")
def peak_support_fraction(spark, sf_dir):
    spectra = _spectra(spark, sf_dir, "user_id")
    return _rounded(S.support(spectra, S.peaks(spectra, 10)), "support")


@query("""WITH RECURSIVE e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
  y AS (SELECT user_id, i, value AS v FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.i, 0.85::DOUBLE * y.v + 0.15::DOUBLE * e.value FROM y JOIN e ON e.user_id = y.user_id AND e.i = y.i + 1)
SELECT user_id, round(arg_max(v, i), 6) + 0.0 AS ewma FROM y GROUP BY user_id""")
def ewma_rate(spark, sf_dir):
    return _rounded(S.ewma(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "value", 0.85), "ewma")


_GRID = "g AS (SELECT l_returnflag AS grid_id, CAST(l_quantity AS INTEGER) AS row, CAST(round_even(l_discount * 100, 0) AS INTEGER) AS col, avg(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2, 3)"


def _confidence_sql(q: float, floor: float, weight: str) -> str:
    return f"""WITH {_GRID}, e AS (SELECT grid_id, quantile_cont(value, {q}) AS edge, max(value) AS most FROM g WHERE value > 0 GROUP BY 1),
    r AS (SELECT g.*, least(greatest((least(value / CASE WHEN edge > 1e-6 THEN edge ELSE most END, 1.0) - {floor}::DOUBLE) / {1 - floor}::DOUBLE, 0.0), 1.0) AS s FROM g JOIN e USING (grid_id))
    SELECT grid_id, row, col, round({weight}, 6) + 0.0 AS weight FROM r"""


@query(_confidence_sql(0.97, 0.03, "0.5::DOUBLE * sqrt(s) + 0.5::DOUBLE * s * s * (3 - 2 * s)"))
def confidence_render(spark, sf_dir):
    return _rounded(G.confidence(grid(table(spark, sf_dir, "lineitem")), 0.97, 0.03, "render"), "weight")


@query(_confidence_sql(0.98, 0.01, "sqrt(s)"))
def confidence_analysis(spark, sf_dir):
    return _rounded(G.confidence(grid(table(spark, sf_dir, "lineitem")), 0.98, 0.01, "analysis"), "weight")


@query(f"""WITH {_GRID}, h AS (SELECT grid_id, row, col, CASE WHEN (row * 3 + col) % 7 <> 0 THEN value END AS value FROM g)
SELECT a.grid_id, a.row, a.col, round(CASE WHEN any_value(a.value) IS NULL THEN 0 ELSE avg(b.value) END, 4) + 0.0 AS support FROM h a JOIN h b ON a.grid_id = b.grid_id AND abs(a.row - b.row) <= 1 AND abs(a.col - b.col) <= 1 GROUP BY 1, 2, 3""")
def grid_local_support(spark, sf_dir):
    holed = F.when((F.col("row") * 3 + F.col("col")) % 7 != 0, F.col("value")).otherwise(F.lit(float("nan")))
    return G.local_mean(grid(table(spark, sf_dir, "lineitem")).withColumn("value", holed)).withColumn("support", _r(F.col("support"), 4))


@query(f"WITH {_GRID} SELECT grid_id, CAST(floor(row / 4) AS INTEGER) AS row, CAST(floor(col / 4) AS INTEGER) AS col, round(avg(value), 4) + 0.0 AS value FROM g GROUP BY 1, 2, 3")
def grid_meanpool(spark, sf_dir):
    return G.mean_pool(grid(table(spark, sf_dir, "lineitem")), 4).withColumn("value", _r(F.col("value"), 4))


@query(f"""WITH {_GRID} SELECT c.grid_id, c.row, c.col, round(sqrt(pow(coalesce(d.value - u.value, 0), 2) + pow(coalesce(r.value - l.value, 0), 2)), 4) + 0.0 AS magnitude FROM g c
LEFT JOIN g u ON u.grid_id = c.grid_id AND u.row = c.row - 1 AND u.col = c.col LEFT JOIN g d ON d.grid_id = c.grid_id AND d.row = c.row + 1 AND d.col = c.col
LEFT JOIN g l ON l.grid_id = c.grid_id AND l.row = c.row AND l.col = c.col - 1 LEFT JOIN g r ON r.grid_id = c.grid_id AND r.row = c.row AND r.col = c.col + 1""")
def grid_gradient(spark, sf_dir):
    return G.gradient(grid(table(spark, sf_dir, "lineitem"))).withColumn("magnitude", _r(F.col("magnitude"), 4))


@query(f"""WITH {_GRID}, t AS (SELECT grid_id, count(*) AS n, quantile_cont(value, 0.75) AS p75, quantile_cont(value, 0.7) AS p70 FROM g GROUP BY 1)
SELECT grid_id, round(CASE WHEN n < 4 THEN 0 ELSE greatest(p75 * 0.05, 1e-8) END, 4) + 0.0 AS floor, round(CASE WHEN n < 4 THEN 60000 ELSE least(60000, greatest(0.08, p70 * 0.85)) END, 4) + 0.0 AS threshold FROM t""")
def adaptive_threshold(spark, sf_dir):
    return G.adaptive_threshold(grid(table(spark, sf_dir, "lineitem")), 60000.0).withColumns({c: _r(F.col(c), 4) for c in ("floor", "threshold")})


@query("SELECT l_suppkey, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) + 0.0 AS mean FROM lineitem GROUP BY 1")
def weighted_mean_price(spark, sf_dir):
    return G.weighted_mean(table(spark, sf_dir, "lineitem"), ["l_suppkey"], F.col("l_extendedprice"), F.col("l_quantity")).withColumn("mean", _r(F.col("mean"), 4))


@query("""SELECT p_partkey, ((p_size BETWEEN 5 AND 35 AND p_retailprice BETWEEN 900 AND 1400) OR sqrt(pow(p_size - 40, 2) + pow(p_retailprice - 1500, 2)) <= 120)
 AND NOT sqrt(pow(p_size - 20, 2) + pow(p_retailprice - 1100, 2)) <= 60 AS inside FROM part""")
def zone_membership(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", G.effective(ZONES, F.col("p_size").cast("double"), F.col("p_retailprice")).alias("inside"))


@query("SELECT l_orderkey, l_linenumber, round(0.2126::DOUBLE * l_quantity + 0.7152::DOUBLE * l_discount + 0.0722::DOUBLE * l_tax, 6) + 0.0 AS luma, CAST(round_even(least(greatest(l_discount * 10, 0), 1) * 255, 0) AS INTEGER) AS level FROM lineitem")
def luma_projection(spark, sf_dir):
    luma = 0.2126 * F.col("l_quantity") + 0.7152 * F.col("l_discount") + 0.0722 * F.col("l_tax")
    level = F.rint(F.least(F.greatest(F.col("l_discount") * 10, F.lit(0.0)), F.lit(1.0)) * 255).cast("int")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", _r(luma).alias("luma"), level.alias("level"))


@query("SELECT date_trunc('month', l_shipdate)::DATE AS month, round(avg(l_quantity), 6) + 0.0 AS mean FROM lineitem GROUP BY 1")
def reference_mean(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy(F.trunc(F.col("l_shipdate").cast("date"), "month").alias("month")).agg(_r(F.avg("l_quantity")).alias("mean"))


@query("""SELECT o_orderkey, 'blocker' AS severity, 'over_budget' AS code FROM orders WHERE o_totalprice > 300000 UNION ALL
SELECT o_orderkey, 'blocker', 'unknown_status' FROM orders WHERE o_orderstatus NOT IN ('F', 'O') UNION ALL
SELECT o_orderkey, 'warning', 'near_budget' FROM orders WHERE o_totalprice > 270000 AND o_totalprice <= 300000 UNION ALL
SELECT o_orderkey, 'warning', 'urgent' FROM orders WHERE o_orderpriority = '1-URGENT'""")
def admission_rules(spark, sf_dir):
    price = F.col("o_totalprice")
    rules = [
        ("blocker", "over_budget", price > 300000), ("blocker", "unknown_status", ~F.col("o_orderstatus").isin("F", "O")),
        ("warning", "near_budget", (price > 270000) & (price <= 300000)), ("warning", "urgent", F.col("o_orderpriority") == "1-URGENT"),
    ]
    return R.issues(table(spark, sf_dir, "orders"), rules).select("o_orderkey", "severity", "code")


@query("""SELECT o_custkey, o_orderkey FROM (SELECT *, sum(o_totalprice) OVER (PARTITION BY o_custkey) AS total,
  coalesce(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE o_totalprice END) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM orders)
WHERE o_orderpriority <> '1-URGENT' AND total - gone > 500000""")
def retention_purge(spark, sf_dir):
    order = [F.col("o_orderdate"), F.col("o_orderkey")]
    return R.purge(table(spark, sf_dir, "orders"), "o_custkey", order, "o_totalprice", 500000.0, F.col("o_orderpriority") == "1-URGENT").select("o_custkey", "o_orderkey")


@query("""WITH c AS (SELECT *, CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN 1 WHEN '5-LOW' THEN 2 WHEN '3-MEDIUM' THEN 3 WHEN '2-HIGH' THEN 4 END AS p FROM orders)
SELECT o_custkey, o_orderkey FROM (SELECT *, sum(o_totalprice) OVER (PARTITION BY o_custkey) - coalesce(sum(CASE WHEN p IS NULL THEN 0 ELSE o_totalprice END) OVER (PARTITION BY o_custkey ORDER BY p NULLS FIRST, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l FROM c)
WHERE p IS NOT NULL AND l > 400000""")
def diagnostics_cap(spark, sf_dir):
    classes = ("4-NOT SPECIFIED", "5-LOW", "3-MEDIUM", "2-HIGH")
    priority = F.expr("case o_orderpriority " + " ".join(f"when '{c}' then {i}" for i, c in enumerate(classes, 1)) + " end")
    return R.capped(table(spark, sf_dir, "orders").withColumn("priority", priority), "o_custkey", "priority", ["o_orderkey"], "o_totalprice", 400000.0).select("o_custkey", "o_orderkey")


@query("SELECT event_id FROM (SELECT event_id, event_id % 7 AS seq, lag(event_id % 7) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) WHERE seq <= p")
def seq_violation(spark, sf_dir):
    return R.sequence_faults(table(spark, sf_dir, "events").withColumn("seq", F.col("event_id") % 7), "user_id", ["ts", "event_id"], "seq").select("event_id")


@query("SELECT user_id, event_type, CAST(sum(t) AS BIGINT) AS took FROM (SELECT user_id, event_type, lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) - epoch_us(ts) AS t FROM events) WHERE t IS NOT NULL GROUP BY 1, 2")
def stage_timing(spark, sf_dir):
    return R.stage_time(table(spark, sf_dir, "events").withColumn("us", micros(F.col("ts"))), "user_id", "us", "event_type", "event_id")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, coalesce(CAST(json_extract_string(props, '$.k') AS INTEGER) >= 50, false) AS high FROM events")
def json_props_rules(spark, sf_dir):
    k = F.expr("try_cast(get_json_object(props, '$.k') as int)")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), F.coalesce(k >= 50, F.lit(False)).alias("high"))


@query("""SELECT vec_id, CAST(k AS INTEGER) AS k, round(sqrt(pow(sum(x * cos((k * n % 64) * (2 * pi() / 64))), 2) + pow(sum(x * sin((k * n % 64) * (2 * pi() / 64))), 2)) / 64, 6) + 0.0 AS amp
FROM (SELECT vec_id, i - 1 AS n, embedding[i]::DOUBLE - list_avg(embedding::DOUBLE[]) AS x FROM embeddings, range(1, 65) t(i)) CROSS JOIN range(33) g(k) GROUP BY vec_id, k""")
def array_spectrum(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("series_key"), F.col("embedding").alias("xs"))
    return S.spectrum(rows, 64, 64.0).select(F.col("series_key").cast("long").alias("vec_id"), "k", _r(F.col("amp")).alias("amp"))


def _edges_sql(share: float, inner: int) -> str:
    return f"""{_spectra_sql('event_type')} {_PEAKS}, e AS (SELECT r.series_key, r.rank, r.k, r.freq_hz AS peak_hz, max(f.k) AS last,
      max(f.k) FILTER (WHERE f.k < r.k AND f.amp < {share}::DOUBLE * r.amp) AS under, min(f.k) FILTER (WHERE f.k > r.k AND f.amp < {share}::DOUBLE * r.amp) AS over_
      FROM r JOIN f ON f.series_key = r.series_key WHERE r.rank <= 10 GROUP BY 1, 2, 3, 4),
    eb AS (SELECT series_key, rank, k, peak_hz, greatest(coalesce(under, {inner}), {inner})::INTEGER AS k_low, least(coalesce(over_, last - {inner}), last - {inner})::INTEGER AS k_high FROM e)"""


def _edges(spark: SparkSession, sf_dir: str, share: float, inner: int) -> DataFrame:
    spectra = _spectra(spark, sf_dir)
    return B.edges(spectra, S.peaks(spectra, 10), share, inner)


_BIN, RANGE = FPS / N, (0.5, 7.0)
_QA_WIDTHS = f"""wa AS (SELECT *, greatest({RANGE[0]}::DOUBLE, k_low * {_BIN}::DOUBLE) AS l0, least({RANGE[1]}::DOUBLE, k_high * {_BIN}::DOUBLE) AS h0 FROM eb),
 wt AS (SELECT *, CASE WHEN h0 - l0 < 0.25 THEN greatest({RANGE[0]}::DOUBLE, peak_hz - 0.125) ELSE l0 END AS l1, CASE WHEN h0 - l0 < 0.25 THEN least({RANGE[1]}::DOUBLE, peak_hz + 0.125) ELSE h0 END AS h1 FROM wa),
 wd AS (SELECT *, CASE WHEN h1 - l1 > 2.5 THEN greatest({RANGE[0]}::DOUBLE, peak_hz - 1.25) ELSE l1 END AS low_hz, CASE WHEN h1 - l1 > 2.5 THEN least({RANGE[1]}::DOUBLE, peak_hz + 1.25) ELSE h1 END AS high_hz FROM wt)"""
_BB_WIDTHS = f"""wa AS (SELECT *, greatest({RANGE[0]}::DOUBLE, k_low * {_BIN}::DOUBLE) AS l0, least({RANGE[1]}::DOUBLE, k_high * {_BIN}::DOUBLE) AS h0,
   greatest(0.375, least({RANGE[1] - RANGE[0]}::DOUBLE, greatest(0.75, peak_hz * 0.9::DOUBLE))) AS m0 FROM eb),
 wm AS (SELECT *, CASE WHEN peak_hz < 0.5 THEN least(m0, 0.45::DOUBLE) WHEN peak_hz > {RANGE[1]}::DOUBLE * 0.65::DOUBLE THEN greatest(m0, 0.9::DOUBLE) ELSE m0 END AS most FROM wa),
 wt AS (SELECT *, CASE WHEN h0 - l0 < 0.375 THEN greatest({RANGE[0]}::DOUBLE, peak_hz - 0.1875) ELSE l0 END AS l1, CASE WHEN h0 - l0 < 0.375 THEN least({RANGE[1]}::DOUBLE, peak_hz + 0.1875) ELSE h0 END AS h1 FROM wm),
 wd AS (SELECT *, CASE WHEN h1 - l1 > most THEN greatest({RANGE[0]}::DOUBLE, peak_hz - most / 2) ELSE l1 END AS low_hz, CASE WHEN h1 - l1 > most THEN least({RANGE[1]}::DOUBLE, peak_hz + most / 2) ELSE h1 END AS high_hz FROM wt)"""


def _wide(edges: DataFrame, how) -> DataFrame:
    peak = F.col("k") * _BIN
    low, high = how(F.col("k_low") * _BIN, F.col("k_high") * _BIN, peak, _BIN, *RANGE)
    return edges.select("series_key", "rank", "k", peak.alias("peak_hz"), low.alias("low_hz"), high.alias("high_hz"))


@query(f"WITH {_edges_sql(0.5, 0)}, {_BB_WIDTHS} SELECT series_key, rank, k_low, k_high, round(low_hz, 6) + 0.0 AS low_hz, round(high_hz, 6) + 0.0 AS high_hz FROM wd")
def band_edges_half(spark, sf_dir):
    edges = _edges(spark, sf_dir, 0.5, 0)
    return _rounded(_wide(edges, B.suggested_widths).join(edges.select("series_key", "rank", "k_low", "k_high"), ["series_key", "rank"]).drop("k", "peak_hz"), "low_hz", "high_hz")


@query(f"WITH {_edges_sql(0.45, 1)}, {_QA_WIDTHS} SELECT series_key, rank, k_low, k_high, round(low_hz, 6) + 0.0 AS low_hz, round(high_hz, 6) + 0.0 AS high_hz FROM wd")
def band_edges_45(spark, sf_dir):
    edges = _edges(spark, sf_dir, 0.45, 1)
    return _rounded(_wide(edges, B.widths).join(edges.select("series_key", "rank", "k_low", "k_high"), ["series_key", "rank"]).drop("k", "peak_hz"), "low_hz", "high_hz")


@query(f"""WITH {_spectra_sql('user_id')} {_PEAKS}, p AS (SELECT *, freq_hz - 0.5::DOUBLE AS a, freq_hz + (CASE WHEN k % 2 = 0 THEN 0.5 ELSE -1.5 END)::DOUBLE AS b FROM r WHERE rank <= 10),
held AS (SELECT *, least(greatest(a, {LOW}::DOUBLE), {HIGH}::DOUBLE) AS lo, least(greatest(b, {LOW}::DOUBLE), {HIGH}::DOUBLE) AS hi, least(greatest(freq_hz, {LOW}::DOUBLE), {HIGH}::DOUBLE) AS c FROM p)
SELECT series_key, rank, CASE WHEN hi < lo THEN c ELSE lo END AS low, CASE WHEN hi < lo THEN c ELSE hi END AS high FROM held""")
def band_clamp(spark, sf_dir):
    peak = F.col("freq_hz")
    low, high = B.clamp(peak - 0.5, peak + F.when(F.col("k") % 2 == 0, 0.5).otherwise(-1.5), peak, LOW, HIGH)
    return S.peaks(_spectra(spark, sf_dir, "user_id"), 10).select("series_key", "rank", low.alias("low"), high.alias("high"))


_BB = """, w2 AS (SELECT *, lag(amp) OVER v AS p2, lead(amp) OVER v AS q2 FROM f WINDOW v AS (PARTITION BY series_key ORDER BY k)),
  t2 AS (SELECT *, coalesce(amp >= p2 AND amp > q2, false) AS top, row_number() OVER (PARTITION BY series_key ORDER BY amp DESC, k) AS nth FROM w2),
  bb AS (SELECT series_key, k, freq_hz, amp FROM t2 QUALIFY top OR (NOT bool_or(top) OVER (PARTITION BY series_key) AND nth = 1))"""


@query(f"WITH {_spectra_sql('event_type')} {_BB} SELECT series_key, k, round(freq_hz, 6) + 0.0 AS freq_hz, round(amp, 6) + 0.0 AS amp FROM bb")
def peaks_bb(spark, sf_dir):
    return _rounded(B.peaks_bb(_spectra(spark, sf_dir)), "freq_hz", "amp")


@query(f"""WITH {_spectra_sql('event_type')} {_BB}, o AS (SELECT series_key, k, amp, quantile_cont(amp, 0.5) OVER (PARTITION BY series_key) AS m, quantile_cont(amp, 0.75) OVER (PARTITION BY series_key ORDER BY k ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS l,
  quantile_cont(amp, 0.75) OVER (PARTITION BY series_key ORDER BY k ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS r FROM f)
SELECT o.series_key, o.k, round(greatest(o.amp - greatest(m, coalesce(l, m), coalesce(r, m)), 0), 6) + 0.0 AS prominence FROM o JOIN bb ON bb.series_key = o.series_key AND bb.k = o.k""")
def peak_prominence(spark, sf_dir):
    spectra = _spectra(spark, sf_dir)
    return _rounded(B.prominence(spectra, B.peaks_bb(spectra), N // 2 + 1), "prominence")


@query(f"""WITH {_spectra_sql('event_type')} {_BB}, x AS (SELECT a.series_key, a.k, a.freq_hz, a.amp, count(*) AS n,
  coalesce(0.30::DOUBLE * least(1.0, max(b.amp) FILTER (WHERE abs(b.freq_hz - a.freq_hz * 2) <= greatest({2 * FPS / N}::DOUBLE, a.freq_hz * 2 * 0.08::DOUBLE)) / a.amp), 0.0) AS two,
  coalesce(0.12::DOUBLE * least(1.0, max(b.amp) FILTER (WHERE abs(b.freq_hz - a.freq_hz * 3) <= greatest({2 * FPS / N}::DOUBLE, a.freq_hz * 3 * 0.08::DOUBLE)) / a.amp), 0.0) AS three
  FROM bb a JOIN bb b ON a.series_key = b.series_key GROUP BY 1, 2, 3, 4)
SELECT series_key, k, round(CASE WHEN n > 1 AND freq_hz > 0 AND amp > 1e-6 THEN least(two + three, 1.0) ELSE 0 END, 6) + 0.0 AS bonus FROM x""")
def harmonic_bonus(spark, sf_dir):
    return _rounded(B.harmonic_bonus(B.peaks_bb(_spectra(spark, sf_dir)), FPS / N), "bonus")


@query(f"""WITH {_spectra_sql('event_type')} {_PEAKS}, p AS (SELECT series_key, rank, freq_hz * 1.37::DOUBLE AS hz FROM r WHERE rank <= 5)
SELECT p.series_key, p.rank, CAST(arg_min(g.k, (abs(g.k * {FPS / N}::DOUBLE - hz), g.k)) AS INTEGER) AS bin FROM p, range({N // 2 + 1}) g(k) GROUP BY 1, 2""")
def nearest_bin(spark, sf_dir):
    peaks = S.peaks(_spectra(spark, sf_dir), 5)
    return B.nearest_bin(peaks, F.col("freq_hz") * 1.37, FPS / N, N // 2).select("series_key", "rank", "bin")


_COVER = f"""{_edges_sql(0.45, 1)}, {_QA_WIDTHS}, sc AS (SELECT series_key, freq_hz, amp / max(amp) OVER (PARTITION BY series_key) AS score FROM r WHERE rank <= 10 AND rank % 2 = 1),
 cs AS (SELECT wd.series_key, wd.rank AS band, coalesce(max(sc.score) FILTER (WHERE sc.freq_hz BETWEEN wd.low_hz - {_BIN}::DOUBLE AND wd.high_hz + {_BIN}::DOUBLE), arg_min(sc.score, (abs(sc.freq_hz - wd.peak_hz), -sc.score)), 0.0) AS peak_score
  FROM wd LEFT JOIN sc ON sc.series_key = wd.series_key GROUP BY 1, 2)"""


@query(f"WITH {_COVER} SELECT series_key, band, round(peak_score, 6) + 0.0 AS peak_score FROM cs")
def band_contains_peak(spark, sf_dir):
    spectra = _spectra(spark, sf_dir)
    peaks = S.peaks(spectra, 10)
    bands = _wide(B.edges(spectra, peaks, 0.45, 1), B.widths).withColumnRenamed("rank", "band")
    top = peaks.groupBy("series_key").agg(F.max(F.when(F.col("rank") % 2 == 1, F.col("amp"))).alias("top"))
    scored = peaks.where("rank % 2 = 1").join(top, "series_key").withColumn("score", F.col("amp") / F.col("top"))
    return _rounded(B.covering_score(bands, scored, _BIN), "peak_score")


_SPLIT = f"""{_edges_sql(0.45, 1)}, {_QA_WIDTHS}, o AS (SELECT *, CAST(row_number() OVER (PARTITION BY series_key ORDER BY low_hz, k) AS INTEGER) AS nth FROM wd),
 pr AS (SELECT a.series_key, a.nth, b.nth AS nth2, a.k AS ka, b.k AS kb, a.peak_hz FROM o a JOIN o b ON a.series_key = b.series_key AND a.nth < b.nth AND b.k > a.k + 1),
 va AS (SELECT pr.series_key, nth, nth2, peak_hz, ka, kb, arg_min(f.k, (f.amp, f.k)) AS kv, min(f.amp) AS v, min(f.amp) FILTER (WHERE f.k IN (ka, kb)) AS small FROM pr JOIN f ON f.series_key = pr.series_key AND f.k BETWEEN ka AND kb GROUP BY 1, 2, 3, 4, 5, 6),
 vc AS (SELECT series_key, nth, nth2, peak_hz, kv * {_BIN}::DOUBLE AS valley FROM va WHERE kv > ka AND kv < kb AND small > 1e-6 AND v <= 0.55::DOUBLE * small),
 sb AS (SELECT o.series_key, o.nth, o.k, o.peak_hz, o.low_hz, o.high_hz, x.valley AS right_, y.valley AS left_ FROM o LEFT JOIN vc x ON x.series_key = o.series_key AND x.nth = o.nth AND x.nth2 = o.nth + 1
   LEFT JOIN vc y ON y.series_key = o.series_key AND y.nth2 = o.nth AND y.nth = o.nth - 1),
 sl AS (SELECT series_key, nth, k, peak_hz, high_hz, right_, CASE WHEN left_ IS NULL THEN low_hz WHEN greatest(low_hz, left_ + {_BIN / 4}::DOUBLE) >= high_hz THEN least(high_hz, greatest(low_hz, left_)) ELSE greatest(low_hz, left_ + {_BIN / 4}::DOUBLE) END AS low_hz FROM sb),
 sp AS (SELECT series_key, nth, k, peak_hz, low_hz, CASE WHEN right_ IS NULL THEN high_hz WHEN least(high_hz, right_ - {_BIN / 4}::DOUBLE) <= low_hz THEN greatest(low_hz, least(high_hz, right_)) ELSE least(high_hz, right_ - {_BIN / 4}::DOUBLE) END AS high_hz FROM sl)"""


def _split_bands(spectra: DataFrame) -> tuple[DataFrame, DataFrame]:
    bands = _wide(B.edges(spectra, S.peaks(spectra, 10), 0.45, 1), B.widths)
    order = Window.partitionBy("series_key").orderBy("low_hz", "k")
    bands = bands.withColumn("rank", F.row_number().over(order))
    cuts = B.valleys(spectra, bands)
    return B.split(bands, cuts, _BIN), cuts


@query(f"WITH {_SPLIT} SELECT series_key, nth AS rank, round(low_hz, 6) + 0.0 AS low_hz, round(high_hz, 6) + 0.0 AS high_hz FROM sp")
def band_valley_split(spark, sf_dir):
    bands, _ = _split_bands(_spectra(spark, sf_dir))
    return _rounded(bands.select("series_key", "rank", "low_hz", "high_hz"), "low_hz", "high_hz")


_MERGE = f"""{_SPLIT}, ms AS (SELECT *, row_number() OVER (PARTITION BY series_key ORDER BY low_hz, high_hz, peak_hz) AS i FROM sp),
 fold AS (SELECT series_key, i, 1 AS band, low_hz, high_hz, peak_hz FROM ms WHERE i = 1 UNION ALL
  SELECT m.series_key, m.i, CASE WHEN j THEN c.band ELSE c.band + 1 END, CASE WHEN j THEN least(c.low_hz, m.low_hz) ELSE m.low_hz END, CASE WHEN j THEN greatest(c.high_hz, m.high_hz) ELSE m.high_hz END, CASE WHEN j THEN c.peak_hz ELSE m.peak_hz END
  FROM (SELECT c.*, m.low_hz - c.high_hz <= greatest(0.10::DOUBLE, (c.high_hz - c.low_hz) * 0.15::DOUBLE) AND NOT EXISTS (SELECT 1 FROM vc WHERE vc.series_key = m.series_key AND vc.nth2 = m.nth AND vc.peak_hz = c.peak_hz) AS j
    FROM fold c JOIN ms m ON m.series_key = c.series_key AND m.i = c.i + 1) c JOIN ms m ON m.series_key = c.series_key AND m.i = c.i + 1),
 md AS (SELECT series_key, CAST(band AS INTEGER) AS band, arg_max(low_hz, i) AS low_hz, arg_max(high_hz, i) AS high_hz, arg_max(peak_hz, i) AS peak_hz FROM fold GROUP BY 1, 2)"""


def _merged_bands(spectra: DataFrame) -> DataFrame:
    bands, cuts = _split_bands(spectra)
    parted = cuts.groupBy("series_key", F.col("rank2").alias("rank")).agg(F.collect_set("peak_hz").alias("cuts"))
    return B.merged(bands.join(parted, ["series_key", "rank"], "left").withColumn("cuts", F.coalesce("cuts", F.array().cast("array<double>"))))


@query(f"WITH RECURSIVE {_MERGE} SELECT series_key, band, round(low_hz, 6) + 0.0 AS low_hz, round(high_hz, 6) + 0.0 AS high_hz, round(peak_hz, 6) + 0.0 AS peak_hz FROM md")
def band_merge_fold(spark, sf_dir):
    return _rounded(_merged_bands(_spectra(spark, sf_dir)), "low_hz", "high_hz", "peak_hz")


@query(f"""WITH {_series_sql('event_type')}, q AS (
  SELECT series_key, k, sum(x * cos((k * n % {N}) * {2 * math.pi / N}::DOUBLE)) AS re, sum(x * sin((k * n % {N}) * {2 * math.pi / N}::DOUBLE)) AS im, CASE WHEN k IN (0, {N // 2}) THEN 1 ELSE 2 END AS w
  FROM s CROSS JOIN range({N // 2 + 1}) g(k) WHERE k * {FPS}::DOUBLE / {N} BETWEEN {LOW} AND {HIGH} GROUP BY series_key, k
) SELECT series_key, CAST(n AS INTEGER) AS n, round(sum(w * (re * cos((k * n % {N}) * {2 * math.pi / N}::DOUBLE) + im * sin((k * n % {N}) * {2 * math.pi / N}::DOUBLE))) / {N}, 6) + 0.0 AS x FROM q CROSS JOIN range({N}) h(n) GROUP BY series_key, n""")
def series_fft_bandpass(spark, sf_dir):
    return _rounded(B.fft_band_pass(series_arrays(table(spark, sf_dir, "events"), "event_type", N), N, FPS, LOW, HIGH), "x")


@query(f"WITH {_series_sql('event_type')} SELECT a.series_key AS a, b.series_key AS b, round(abs(corr(a.x, b.x)), 6) + 0.0 AS corr FROM s a JOIN s b ON a.n = b.n AND a.series_key < b.series_key GROUP BY 1, 2")
def pairwise_abs_corr(spark, sf_dir):
    return _rounded(B.correlations(_events(spark, sf_dir)), "corr")


@query("SELECT user_id, arg_max(event_type, (epoch_us(ts), event_id)) AS event_type, max(epoch_us(ts))::BIGINT AS at FROM events GROUP BY user_id")
def snapshot_fold(spark, sf_dir):
    return R.snapshot(table(spark, sf_dir, "events").withColumn("us", micros(F.col("ts"))), "user_id", ["us", "event_id"], "event_type").select("user_id", "event_type", F.col("us").alias("at"))


@query("""WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS i, first_value(event_type) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS t FROM events),
 f AS (SELECT user_id, any_value(t) AS event_type, min(i) FILTER (WHERE event_type <> t) AS j, count(*) AS c FROM r GROUP BY 1) SELECT user_id, event_type, (coalesce(j, c + 1) - 1)::BIGINT AS n FROM f""")
def stage_counters(spark, sf_dir):
    return R.last_stage(table(spark, sf_dir, "events").withColumn("us", micros(F.col("ts"))), "user_id", ["us", "event_id"], "event_type")


@query("""WITH l AS (SELECT user_id, max(epoch_us(ts)) AS seen FROM events GROUP BY 1), e AS (SELECT max(seen) AS last FROM l)
SELECT user_id, CASE WHEN last - seen > 30 * 3600000000 THEN 'stalled' WHEN last - seen > 12 * 3600000000 THEN 'unresponsive' WHEN last - seen > 4 * 3600000000 THEN 'warning' ELSE 'alive' END AS state FROM l, e""")
def liveness(spark, sf_dir):
    hour = 3_600_000_000
    return R.liveness(table(spark, sf_dir, "events").withColumn("us", micros(F.col("ts"))), "user_id", "us", 4 * hour, 12 * hour, 30 * hour)


@query("SELECT epoch_us(time_bucket(INTERVAL 1 DAY, ts))::BIGINT AS start, event_type, count(*)::BIGINT AS n, round(sum(value), 4) + 0.0 AS total FROM events GROUP BY 1, 2")
def stream_window_stats(spark, sf_dir):
    return T.run_to_end(T.window_stats(T.events(spark, sf_dir))).withColumn("total", _r(F.col("total"), 4))


def _ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of four chunks in order of time."""
    rows = table(spark, sf_dir, "events").select("user_id", micros(F.col("ts")).alias("us"), "event_id", "value").where("value is not null")
    return T.in_chunks(rows, "user_id", 4)


_GAINS = S.low_pass_gain(4.0, 1.0), S.low_pass_gain(4.0, 0.1)


@query(f"""WITH RECURSIVE e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE value IS NOT NULL),
 y AS (SELECT user_id, event_id, i, {_GAINS[0]}::DOUBLE * value AS h, {_GAINS[1]}::DOUBLE * value AS l FROM e WHERE i = 1 UNION ALL
  SELECT e.user_id, e.event_id, e.i, y.h + {_GAINS[0]}::DOUBLE * (e.value - y.h), y.l + {_GAINS[1]}::DOUBLE * (e.value - y.l) FROM y JOIN e ON e.user_id = y.user_id AND e.i = y.i + 1)
SELECT user_id, event_id, round(h - l, 6) + 0.0 AS y FROM y""")
def stream_iir_equals_batch(spark, sf_dir):
    return _rounded(T.appended(T.band_pass(_ticks(spark, sf_dir), "user_id", *_GAINS)), "y")


@query("""WITH e AS (SELECT user_id, value, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 8 AS batch FROM events WHERE value IS NOT NULL)
SELECT user_id, batch::BIGINT AS batch, count(*)::BIGINT AS n, round(avg(value), 6) + 0.0 AS mean FROM e GROUP BY 1, 2""")
def stream_batch8(spark, sf_dir):
    parts = T.appended(T.in_batches(_ticks(spark, sf_dir), "user_id"))
    return parts.groupBy("user_id", "batch").agg(F.sum("n").alias("n"), _r(F.sum("total") / F.sum("n")).alias("mean"))
