"""Queries on cells of regions: events of a type are a ROI, its twelve base cells lie on a frame of 640 x 360 and have unequal shares of the events."""

from __future__ import annotations

import math
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import centre_weight
from ..operators import bands as B
from ..operators import grid as G
from ..operators import quality as Q
from ..operators import suggestion as U
from ..sources import cell_traces, table, written
from .queries import _BOUNDS, FPS, N, _r, _rounded, query

FRAME = (640.0, 360.0)
ROI = {"shape": "rectangle", "x": 0.0, "y": 0.0, "width": 640.0, "height": 239.0}
ZONES = [{"shape": "circle", "mode": "exclude", "x": 400.0, "y": 60.0, "radius": 85.0}, {"shape": "rectangle", "mode": "exclude", "x": 480.0, "y": 0.0, "width": 160.0, "height": 120.0}]
#: How many of 60 events lie in each cell; so few that one has too little texture, and others too little confidence.
SHARES = (1, 8, 2, 2, 8, 14, 8, 3, 4, 4, 3, 3)
CELL = "CASE " + " ".join(f"WHEN event_id % 60 < {sum(SHARES[: i + 1])} THEN {i}" for i in range(len(SHARES))) + " END"
#: What is left of a cell's motion: cell 4 hardly moves, cell 7 not at all.
MOVE = f"CASE {CELL} WHEN 4 THEN 0.02 WHEN 7 THEN 0.0 ELSE 1.0 END"
BANDS = ((1, 1.0, 2.0), (2, 2.0, 4.0), (3, 4.0, 7.0))
LOW_HZ, HIGH_HZ, BIN, CUTOFF, LEAST = 1.0, 7.0, FPS / N, 0.45, 0.30


def base_cells(spark, sf_dir) -> DataFrame:
    """cell, row, col, x, y, width, height, roi_fraction, usable, parent: the rectangles that have events, alike in every ROI; at most twelve."""
    found = table(spark, sf_dir, "events").select(F.expr(CELL).alias("id")).distinct()
    numbers = found.select(F.col("id").cast("string").alias("cell"), (F.col("id") / 4).cast("int").alias("row"), (F.col("id") % 4).cast("int").alias("col"))
    places = numbers.select("cell", "row", "col", (F.col("col") * 160.0).alias("x"), (F.col("row") * 120.0).alias("y"), F.lit(160.0).alias("width"), F.lit(120.0).alias("height"))
    covered = G.coverage(places, ROI, ZONES, FRAME)
    parent = F.floor((F.col("y") + 60) / 180).cast("int") * 4 + F.floor((F.col("x") + 80) / 160).cast("int")
    return covered.withColumnRenamed("usable_fraction", "usable").withColumn("parent", parent.cast("string"))


class Region:
    """The relations that the queries below share, each made when it is first asked for; what several plans need is written once."""

    def __init__(self, spark, sf_dir):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def _motion(self) -> DataFrame:
        events = table(self.spark, self.sf_dir, "events")
        return written(cell_traces(events, "event_type", CELL, f"value * {MOVE}", f"try_cast(get_json_object(props, '$.k') as double) / 100 * {MOVE}", N))

    @cached_property
    def _base(self) -> tuple[DataFrame, DataFrame]:
        traces, agreement = Q.base_traces(self._motion, N, FPS)
        return written(traces), agreement

    @cached_property
    def spectra(self) -> DataFrame:
        return written(Q.spectra_of(self._base[0], ["roi", "cell"], N, FPS))

    @cached_property
    def cells(self) -> DataFrame:
        most = self._motion.groupBy("roi").agg(F.max("n_events").alias("most"))
        sure = self._motion.select("roi", "cell", "n_events").join(most, "roi").select("roi", "cell", (F.col("n_events") / F.col("most")).alias("confidence"))
        places = F.broadcast(base_cells(self.spark, self.sf_dir))  # twelve rows
        base = sure.join(Q.base_metrics(self.spectra, LOW_HZ, BIN), ["roi", "cell"]).join(self._base[1], ["roi", "cell"]).join(places, "cell")
        return written(base.withColumn("w", Q.clip(F.col("usable") * F.greatest("confidence", F.lit(0.05)))))

    @cached_property
    def _roi_traces(self) -> DataFrame:
        return written(Q.roi_traces(self.cells.where("roi_fraction > 0"), self._base[0]))

    @cached_property
    def roi_spectra(self) -> DataFrame:
        return written(Q.spectra_of(self._roi_traces, ["roi", "parent"], N, FPS))

    @cached_property
    def records(self) -> DataFrame:
        return written(Q.roi_cells(self.cells.where("roi_fraction > 0"), self._roi_traces, self.roi_spectra, CUTOFF, LOW_HZ, BIN))

    @cached_property
    def agreement(self) -> DataFrame:
        return written(Q.inter_cell_agreement(self.records, self.roi_spectra))

    @cached_property
    def _found(self) -> tuple[DataFrame, DataFrame]:
        """Supported peaks and suppressed ones, ranked by a first score."""
        found, lost = Q.supported_peaks(self.records, self.roi_spectra, Q.roi_quality(self.records, self.agreement), LEAST)
        return written(found), lost

    @property
    def lost(self) -> DataFrame:
        return self._found[1]

    @cached_property
    def overall(self) -> DataFrame:
        """The final score, with how well the peaks are supported."""
        consistency = self._found[0].groupBy(F.col("series_key").alias("roi")).agg(F.avg("support").alias("consistency"))
        return written(Q.roi_quality(self.records, self.agreement, consistency))

    @property
    def peaks(self) -> DataFrame:
        """What is reported: nothing of a ROI whose final score is under the cutoff."""
        poor = self.overall.where(F.col("overall") < CUTOFF).select(F.col("roi").alias("series_key"))
        return self._found[0].join(poor, "series_key", "left_anti")

    def heat(self) -> DataFrame:
        spark = self.cells.sparkSession
        fixed = spark.createDataFrame(BANDS, "band int, low_hz double, high_hz double")
        shapes = self.cells.select(F.col("roi").alias("series_key")).distinct().join(F.broadcast(fixed))
        return written(Q.heatmaps(self.cells, self.spectra, self.records, shapes, 0.5))


def _dft(rows: str, keys: str) -> str:
    """SQL of keys, k, freq_hz, amp for rows (keys, n, v)."""
    turn = 2 * math.pi / N
    return f"""(SELECT {keys}, CAST(k AS INTEGER) AS k, k * {BIN}::DOUBLE AS freq_hz, sqrt(pow(sum(v * cos((k * n % {N}) * {turn}::DOUBLE)), 2) + pow(sum(v * sin((k * n % {N}) * {turn}::DOUBLE)), 2)) / {N} AS amp
      FROM (SELECT {keys}, n, v - avg(v) OVER (PARTITION BY {keys}) AS v FROM {rows}) CROSS JOIN range({N // 2 + 1}) g(k) GROUP BY {keys}, k)"""


def _clip(x: str, low: float = 0.0) -> str:
    return f"least(greatest({x}, {low}::DOUBLE), 1.0::DOUBLE)"


_DRIFT = "freq_hz > 0 AND freq_hz < 0.5"
_BASE = f"""{_BOUNDS}, ev AS (SELECT event_type AS roi, CAST({CELL} AS VARCHAR) AS cell, CAST((epoch_us(ts) - lo) * {N} // (hi - lo + 1) AS INTEGER) AS n, value * {MOVE} AS value, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) / 100 * {MOVE} AS y FROM events, b),
 mm AS (SELECT roi, cell, n, avg(value) AS x, avg(y) AS y FROM ev GROUP BY 1, 2, 3),
 ids AS (SELECT roi, cell, count(*) AS c, count(*) / (max(count(*)) OVER (PARTITION BY roi))::DOUBLE AS confidence FROM ev GROUP BY 1, 2),
 tr AS (SELECT i.roi, i.cell, CAST(g.n AS INTEGER) AS n, coalesce(mm.x, 0.0) AS x, coalesce(mm.y, 0.0) AS y FROM ids i CROSS JOIN range({N}) g(n) LEFT JOIN mm ON mm.roi = i.roi AND mm.cell = i.cell AND mm.n = g.n),
 ee AS (SELECT roi, cell, sqrt(avg(x * x)) AS ex, sqrt(avg(y * y)) AS ey FROM tr GROUP BY 1, 2),
 co AS (SELECT tr.*, (ex * x + ey * y) / greatest(sqrt(ex * ex + ey * ey), 1e-6) AS p FROM tr JOIN ee USING (roi, cell)),
 cl AS (SELECT roi, cell, 'x' AS part, n, x AS v FROM co UNION ALL SELECT roi, cell, 'y', n, y FROM co UNION ALL SELECT roi, cell, 'p', n, p FROM co),
 cs AS {_dft('cl', 'roi, cell, part')},
 stb AS (SELECT roi, cell, part, CASE WHEN sum(amp * amp) FILTER (WHERE k > 0) <= 1e-6 THEN 0 ELSE {_clip(f'1 - coalesce(sum(amp * amp) FILTER (WHERE {_DRIFT}), 0) / sum(amp * amp) FILTER (WHERE k > 0)')} END AS stable FROM cs GROUP BY 1, 2, 3),
 rm AS (SELECT roi, cell, part, sqrt(avg(v * v)) AS rms FROM cl GROUP BY 1, 2, 3),
 wt3 AS (SELECT roi, cell, max(rms * stable) FILTER (WHERE part = 'x') AS wx, max(rms * stable) FILTER (WHERE part = 'y') AS wy, max(rms * stable) FILTER (WHERE part = 'p') AS wp FROM rm JOIN stb USING (roi, cell, part) GROUP BY 1, 2),
 bt AS (SELECT roi, cell, n, CASE WHEN wx + wy + wp > 1e-6 THEN (wx * x + wy * y + wp * p) / (wx + wy + wp) ELSE p END AS v FROM co JOIN wt3 USING (roi, cell)),
 bs AS {_dft('bt', 'roi, cell')},
 ag AS (SELECT roi, cell, (CASE WHEN stddev_pop(x) > 1e-6 AND stddev_pop(p) > 1e-6 THEN abs(corr(x, p)) ELSE 0 END + CASE WHEN stddev_pop(y) > 1e-6 AND stddev_pop(p) > 1e-6 THEN abs(corr(y, p)) ELSE 0 END) / 2 AS agreement FROM co GROUP BY 1, 2),
 en AS (SELECT roi, cell, sum(amp * amp) AS total, sum(CASE WHEN freq_hz >= {LOW_HZ} THEN amp * amp ELSE 0 END) AS band, sum(CASE WHEN {_DRIFT} THEN amp * amp ELSE 0 END) AS drift FROM bs GROUP BY 1, 2),
 me AS (SELECT roi, cell, total, CASE WHEN total <= 1e-6 THEN 0 ELSE {_clip('band / total')} END AS relevance, {_clip('1 - drift / greatest(band + drift, 1e-6)')} AS stability FROM en)"""

_NOMINAL = f"px BETWEEN {ROI['x']} AND {ROI['x'] + ROI['width']} AND py BETWEEN {ROI['y']} AND {ROI['y'] + ROI['height']} AND px BETWEEN 0 AND {FRAME[0]} AND py BETWEEN 0 AND {FRAME[1]}"
_EXCLUDED = "sqrt(pow(px - 400, 2) + pow(py - 60, 2)) <= 85 OR (px BETWEEN 480 AND 640 AND py BETWEEN 0 AND 120)"
_GEOMETRY = f"""smp AS (SELECT CAST(c AS VARCHAR) AS cell, CAST(c // 4 AS INTEGER) AS row, CAST(c % 4 AS INTEGER) AS col, (c % 4) * 160.0::DOUBLE AS x, (c // 4) * 120.0::DOUBLE AS y, (c % 4) * 160 + 0.5 + i * 159.0 / 4 AS px, (c // 4) * 120 + 0.5 + j * 119.0 / 4 AS py FROM (SELECT DISTINCT {CELL} AS c FROM events) a, range(5) s(i), range(5) t(j)),
 cov AS (SELECT cell, row, col, x, y, avg(CASE WHEN {_NOMINAL} THEN 1.0 ELSE 0.0 END)::DOUBLE AS roi_fraction, avg(CASE WHEN {_NOMINAL} AND NOT ({_EXCLUDED}) THEN 1.0 ELSE 0.0 END)::DOUBLE AS usable,
   CAST(CAST(floor((y + 60) / 180) AS INTEGER) * 4 + CAST(floor((x + 80) / 160) AS INTEGER) AS VARCHAR) AS parent FROM smp GROUP BY cell, row, col, x, y)"""
_RECORDS = f"""{_BASE}, {_GEOMETRY}, bc AS (SELECT ids.roi, ids.cell, confidence, total, relevance, stability, agreement, row, col, roi_fraction, usable, parent, {_clip('usable * greatest(confidence, 0.05::DOUBLE)')} AS w
   FROM ids JOIN me USING (roi, cell) JOIN ag USING (roi, cell) JOIN cov USING (cell)),
 ins AS (SELECT * FROM bc WHERE roi_fraction > 0),
 rt AS (SELECT roi, parent, n, CASE WHEN sum(w) > 1e-6 THEN sum(v * w) / sum(w) ELSE 0 END AS v FROM bt JOIN ins USING (roi, cell) GROUP BY 1, 2, 3),
 rs AS {_dft('rt', 'roi, parent')},
 sc AS (SELECT roi, parent, sum(w) AS weights, {', '.join(f"CASE WHEN sum(w) > 1e-6 THEN sum({c} * w) / sum(w) ELSE 0 END AS {name}" for c, name in (('confidence', 'texture'), ('stability', 'stability'), ('agreement', 'agreement'), ('relevance', 'relevance'), ('usable', 'mask')))} FROM ins GROUP BY 1, 2),
 dr AS (SELECT roi, parent, {_clip(f'1 - CASE WHEN sum(CASE WHEN freq_hz >= {LOW_HZ} THEN amp * amp ELSE 0 END) <= 1e-6 THEN 0 ELSE {_clip(f"sum(CASE WHEN {_DRIFT} THEN amp * amp ELSE 0 END) / sum(CASE WHEN freq_hz >= {LOW_HZ} THEN amp * amp ELSE 0 END)")} END')} AS drift FROM rs GROUP BY 1, 2),
 rr AS (SELECT roi, parent, sqrt(avg(v * v)) AS rms FROM rt GROUP BY 1, 2),
 cq AS (SELECT *, {_clip('0.22::DOUBLE * texture + 0.18::DOUBLE * stability + 0.16::DOUBLE * agreement + 0.18::DOUBLE * relevance + 0.12::DOUBLE * mask + 0.14::DOUBLE * drift')} AS composite,
   concat_ws(';', CASE WHEN weights <= 1e-6 THEN 'no_weighted_signal' END, CASE WHEN texture < 0.08 THEN 'insufficient_texture' END, CASE WHEN mask < 0.35 THEN 'masked_out' END, CASE WHEN rms <= 1e-5 THEN 'no_usable_motion_signal' END) AS fails
   FROM sc JOIN dr USING (roi, parent) JOIN rr USING (roi, parent)),
 cv AS (SELECT *, fails <> '' AS hard_fail, fails = '' AND composite >= {max(0.30, min(0.55, CUTOFF * 0.8))}::DOUBLE AS valid FROM cq),
 rec AS (SELECT roi, parent, {', '.join(f'{c} * CASE WHEN valid THEN 1.0 ELSE 0.5 END::DOUBLE AS {c}' for c in (*Q.CELL_WEIGHTS, 'composite'))}, valid, hard_fail, CASE WHEN NOT valid AND NOT hard_fail THEN 'quality_below_threshold' ELSE fails END AS reasons FROM cv),
 pc AS (SELECT a.roi, a.parent AS a, d.parent AS d, CASE WHEN stddev_pop(a.amp) > 1e-6 AND stddev_pop(d.amp) > 1e-6 THEN abs(corr(a.amp, d.amp)) ELSE 0 END AS r
   FROM rs a JOIN rs d ON a.roi = d.roi AND a.k = d.k AND a.parent < d.parent JOIN rec ra ON ra.roi = a.roi AND ra.parent = a.parent AND ra.valid JOIN rec rd ON rd.roi = d.roi AND rd.parent = d.parent AND rd.valid GROUP BY 1, 2, 3),
 ia AS (SELECT rec.roi, coalesce((SELECT avg(r) FROM pc WHERE pc.roi = rec.roi), CASE WHEN count(*) FILTER (WHERE valid) = 1 THEN max(agreement) FILTER (WHERE valid) END, 0) AS agreement FROM rec GROUP BY 1),
 ov AS (SELECT rec.roi, sum(CASE WHEN valid THEN 1 ELSE 0 END)::BIGINT AS valid_cells, sum(CASE WHEN valid THEN 0 ELSE 1 END)::BIGINT AS rejected_cells, any_value(ia.agreement) AS agreement,
   {_clip('0.18::DOUBLE * avg(texture) + 0.20::DOUBLE * avg(CASE WHEN valid THEN 1.0 ELSE 0.0 END) + 0.20::DOUBLE * any_value(ia.agreement) + 0.10::DOUBLE * avg(mask) + 0.15::DOUBLE * avg(drift)')} AS overall FROM rec JOIN ia USING (roi) GROUP BY 1)"""


def _round_sql(*columns: str, places: int = 6) -> str:
    return ", ".join(f"round({c}, {places}) + 0.0 AS {c}" for c in columns)


@query(f"WITH {_GEOMETRY} SELECT cell, parent, {_round_sql('roi_fraction', 'usable')} FROM cov")
def cell_coverage(spark, sf_dir):
    return _rounded(base_cells(spark, sf_dir).select("cell", "parent", "roi_fraction", "usable"), "roi_fraction", "usable")


@query(f"WITH {_BASE} SELECT roi, cell, {_round_sql('relevance', 'stability', 'agreement')} FROM me JOIN ag USING (roi, cell)")
def base_cell_metrics(spark, sf_dir):
    r = Region(spark, sf_dir)
    return _rounded(r.cells.select("roi", "cell", "relevance", "stability", "agreement"), "relevance", "stability", "agreement")


@query(f"WITH {_RECORDS} SELECT roi, parent, {_round_sql(*Q.CELL_WEIGHTS, 'composite')}, valid, hard_fail, reasons FROM rec")
def roi_cell_records(spark, sf_dir):
    return _rounded(Region(spark, sf_dir).records, *Q.CELL_WEIGHTS, "composite")


_ROI_PEAKS = f"""{_RECORDS}, hv AS (SELECT roi, bool_or(valid) AS any_ FROM rec GROUP BY 1),
 f AS (SELECT rs.roi AS series_key, k, freq_hz, quantile_cont(amp, 0.5) AS amp FROM rs JOIN rec USING (roi, parent) JOIN hv ON hv.roi = rs.roi WHERE valid OR NOT any_ GROUP BY 1, 2, 3),
 pw AS (SELECT *, lag(amp) OVER v AS p, lead(amp) OVER v AS q FROM f WINDOW v AS (PARTITION BY series_key ORDER BY k)),
 pl AS (SELECT * FROM pw WHERE p IS NOT NULL AND q IS NOT NULL AND amp >= p AND amp >= q AND freq_hz > 0),
 pz AS (SELECT *, quantile_cont(amp, 0.5) OVER (PARTITION BY series_key) + 0.5 * stddev_pop(amp) OVER (PARTITION BY series_key) AS least FROM pl),
 py AS (SELECT *, bool_or(amp >= least) OVER (PARTITION BY series_key) AS any_ FROM pz),
 pr0 AS (SELECT *, CAST(row_number() OVER (PARTITION BY series_key ORDER BY amp DESC, k) AS INTEGER) AS rank FROM py WHERE NOT any_ OR amp >= least),
 r AS (SELECT * FROM pr0 WHERE rank <= 10),
 sh AS (SELECT rs.roi, rs.parent, k, CASE WHEN k BETWEEN 1 AND {N // 2 - 1} AND amp > 0 AND (k = 1 OR amp > lag(amp) OVER v) AND (k = {N // 2 - 1} OR amp >= lead(amp) OVER v) THEN 1.0 ELSE 0.0 END AS hit
   FROM rs JOIN rec ON rec.roi = rs.roi AND rec.parent = rs.parent AND rec.valid WINDOW v AS (PARTITION BY rs.roi, rs.parent ORDER BY k)),
 su AS (SELECT roi AS series_key, k, avg(hit)::DOUBLE AS support FROM sh GROUP BY 1, 2),
 sq AS (SELECT r.series_key, r.k, r.freq_hz, r.amp, support, {_clip('0.55::DOUBLE * CASE WHEN max(r.amp) OVER (PARTITION BY r.series_key) <= 1e-6 THEN 0 ELSE r.amp / max(r.amp) OVER (PARTITION BY r.series_key) END + 0.35::DOUBLE * support + 0.10::DOUBLE * overall')} AS score
   FROM r JOIN su ON su.series_key = r.series_key AND su.k = r.k JOIN ov ON ov.roi = r.series_key),
 rp AS (SELECT *, CAST(row_number() OVER (PARTITION BY series_key ORDER BY score DESC, amp DESC, k) AS INTEGER) AS rank FROM sq WHERE support >= {LEAST}::DOUBLE),
 fo AS (SELECT ov.roi, valid_cells, rejected_cells, agreement, {_clip('overall + 0.17::DOUBLE * coalesce(c, 0)')} AS overall FROM ov LEFT JOIN (SELECT series_key, avg(support) AS c FROM rp GROUP BY 1) z ON z.series_key = ov.roi)"""


@query(f"""WITH {_ROI_PEAKS} SELECT roi, valid_cells, rejected_cells, {_round_sql('agreement', 'overall')}, CASE WHEN overall >= 0.8 THEN 'High' WHEN overall >= 0.6 THEN 'Moderate' WHEN overall >= 0.4 THEN 'Low' ELSE 'Poor' END AS label,
  CASE WHEN overall < 0.45 THEN 'quality_below_reporting' ELSE '' END AS warnings FROM fo""")
def roi_quality(spark, sf_dir):
    """A ROI's final score: with how well its reported peaks are supported."""
    return _rounded(Region(spark, sf_dir).overall, "agreement", "overall")


@query(f"WITH {_ROI_PEAKS} SELECT series_key, rank, k, {_round_sql('freq_hz', 'amp', 'support', 'score')} FROM rp JOIN fo ON fo.roi = rp.series_key WHERE fo.overall >= {CUTOFF}::DOUBLE")
def supported_peaks(spark, sf_dir):
    return _rounded(Region(spark, sf_dir).peaks.select("series_key", "rank", "k", "freq_hz", "amp", "support", "score"), "freq_hz", "amp", "support", "score")


@query(f"WITH {_ROI_PEAKS} SELECT series_key, k, round(support, 6) + 0.0 AS support FROM sq WHERE support < {LEAST}::DOUBLE")
def suppressed_peaks(spark, sf_dir):
    return _rounded(Region(spark, sf_dir).lost.select("series_key", "k", "support"), "support")


_LOCAL = f"""ce AS (SELECT rs.roi, band, rs.parent, sum(amp * amp) * greatest(any_value(composite), 0.05::DOUBLE) AS e FROM rs JOIN rec ON rec.roi = rs.roi AND rec.parent = rs.parent AND rec.valid, (VALUES {', '.join(f'({b}, {lo}, {hi})' for b, lo, hi in BANDS)}) v(band, lo, hi)
   WHERE freq_hz BETWEEN lo AND hi GROUP BY 1, 2, 3 HAVING e > 1e-12),
 cr AS (SELECT *, row_number() OVER (PARTITION BY roi, band ORDER BY e DESC) AS nth FROM ce),
 lo AS (SELECT roi, band, CASE WHEN count(*) > 1 AND avg(e) > 1e-12 THEN 0.55::DOUBLE * {_clip('(avg(e) FILTER (WHERE nth <= 3) / avg(e) - 1) / 6')} + 0.45::DOUBLE * {_clip('(quantile_cont(e, 0.95) / avg(e) - 1) / 6')} ELSE 0 END AS localization FROM cr GROUP BY 1, 2)"""


@query(f"WITH {_RECORDS}, {_LOCAL} SELECT i.roi AS series_key, v.band, round(coalesce(localization, 0), 6) + 0.0 AS localization FROM (SELECT DISTINCT roi FROM ids) i CROSS JOIN (VALUES (1), (2), (3)) v(band) LEFT JOIN lo ON lo.roi = i.roi AND lo.band = v.band")
def localization_top3_p95(spark, sf_dir):
    r = Region(spark, sf_dir)
    fixed = spark.createDataFrame(BANDS, "band int, low_hz double, high_hz double")
    shapes = r.cells.select(F.col("roi").alias("series_key")).distinct().join(F.broadcast(fixed))
    return _rounded(Q.localization(shapes, r.records, r.roi_spectra), "localization")


_HEAT = f"""{_RECORDS}, th AS (SELECT roi, CASE WHEN count(*) FILTER (WHERE roi_fraction > 0 AND usable >= 0.35) < 4 THEN 0.5 ELSE least(0.5, greatest(0.08, quantile_cont(confidence, 0.7) FILTER (WHERE roi_fraction > 0 AND usable >= 0.35) * 0.85::DOUBLE)) END AS threshold FROM bc GROUP BY 1),
 fl AS (SELECT bc.roi, CASE WHEN count(*) FILTER (WHERE roi_fraction > 0 AND usable >= 0.35 AND confidence >= threshold AND total > 1e-8) < 4 THEN 0 ELSE greatest(quantile_cont(total, 0.75) FILTER (WHERE roi_fraction > 0 AND usable >= 0.35 AND confidence >= threshold AND total > 1e-8) * 0.05::DOUBLE, 1e-8) END AS floor_ FROM bc JOIN th USING (roi) GROUP BY 1),
 pq AS (SELECT roi, parent, {_clip(f"{_clip('0.45::DOUBLE * composite + 0.20::DOUBLE * stability + 0.15::DOUBLE * agreement + 0.20::DOUBLE * relevance')} * CASE WHEN valid THEN 1.0 ELSE 0.6 END::DOUBLE * CASE WHEN hard_fail THEN 0.5 ELSE 1.0 END::DOUBLE", 0.05)} AS parent_quality FROM rec),
 hb AS (SELECT bc.roi, bc.cell, band, sum(CASE WHEN freq_hz BETWEEN l AND h THEN amp * amp ELSE 0 END) AS e FROM bc JOIN bs USING (roi, cell), (VALUES {', '.join(f'({b}, {lo}, {hi})' for b, lo, hi in BANDS)}) v(band, l, h) GROUP BY 1, 2, 3),
 hm AS (SELECT hb.roi, band, hb.cell, row, col, confidence, total, threshold, floor_, CASE WHEN roi_fraction > 0 THEN CASE WHEN total <= 1e-6 THEN 0 ELSE e / total END END AS value, CASE WHEN roi_fraction > 0 THEN e END AS band_energy,
   {_clip(f"{_clip('0.55::DOUBLE * coalesce(parent_quality, 0.5) + 0.25::DOUBLE * stability + 0.20::DOUBLE * agreement')} * greatest(usable, 0.10::DOUBLE)", 0.05)} AS quality,
   CASE WHEN roi_fraction <= 0 THEN 'outside_roi' WHEN usable < 0.35 THEN 'masked_out' WHEN confidence < threshold THEN 'low_confidence' WHEN total < floor_ THEN 'weak_signal' END AS reason
   FROM hb JOIN bc USING (roi, cell) JOIN th USING (roi) JOIN fl USING (roi) LEFT JOIN pq ON pq.roi = bc.roi AND pq.parent = bc.parent),
 hq AS (SELECT roi, quantile_cont(value, 0.05) FILTER (WHERE reason IS NULL) AS lo, quantile_cont(value, 0.95) FILTER (WHERE reason IS NULL) AS hi, quantile_cont(band_energy, 0.05) FILTER (WHERE reason IS NULL) AS elo, quantile_cont(band_energy, 0.95) FILTER (WHERE reason IS NULL) AS ehi FROM hm GROUP BY 1),
 hs AS (SELECT roi, coalesce(lo, 0.0) AS display_min, CASE WHEN lo IS NULL THEN 1.0 WHEN hi <= lo THEN lo + 1e-6 ELSE hi END AS display_max, coalesce(elo, 0.0) AS energy_min, CASE WHEN elo IS NULL THEN 1.0 WHEN ehi <= elo THEN elo + 1e-12 ELSE ehi END AS energy_max FROM hq)"""


@query(f"WITH {_HEAT} SELECT roi, band, cell, coalesce(reason, 'valid') AS reason, {_round_sql('value', 'band_energy')} FROM hm")
def heatmap_reasons(spark, sf_dir):
    rows = Region(spark, sf_dir).heat()
    return _rounded(rows.select("roi", "band", "cell", F.coalesce("reason", F.lit("valid")).alias("reason"), "value", "band_energy"), "value", "band_energy")


@query(f"WITH {_HEAT} SELECT hs.roi, {_round_sql('display_min', 'display_max', 'energy_min', 'energy_max')}, (SELECT count(*) FROM hm WHERE hm.roi = hs.roi AND reason IS NULL AND (value < display_min OR value > display_max))::BIGINT AS clipped FROM hs")
def heatmap_scale(spark, sf_dir):
    return _rounded(Q.heatmap_scale(Region(spark, sf_dir).heat()), "display_min", "display_max", "energy_min", "energy_max")


_SAL = f"""{_HEAT}, sv AS (SELECT a.roi, a.band, a.cell, avg(least(greatest(d.value, 0), 1) * d.quality) AS support FROM hm a JOIN hm d ON a.roi = d.roi AND a.band = d.band AND abs(a.row - d.row) <= 1 AND abs(a.col - d.col) <= 1 WHERE a.value IS NOT NULL GROUP BY 1, 2, 3),
 sa AS (SELECT hm.roi, hm.band, hm.cell, value, reason, sqrt({_clip('(band_energy - energy_min) / greatest(energy_max - energy_min, 1e-12)')}) * (0.12::DOUBLE + 0.36::DOUBLE * sqrt({_clip('value')}) + 0.30::DOUBLE * sqrt({_clip('support')}) + 0.22::DOUBLE * sqrt(quality)) * sqrt({_clip('confidence')}) * sqrt(quality) AS salience
   FROM hm JOIN hs USING (roi) JOIN sv USING (roi, band, cell))"""


@query(f"WITH {_SAL} SELECT roi, band, cell, round(salience, 6) + 0.0 AS salience, round(least(CASE WHEN reason IS NULL THEN 0.14::DOUBLE + 0.56::DOUBLE * value ELSE 0.12::DOUBLE + 0.14::DOUBLE * value END * (0.20::DOUBLE + 0.80::DOUBLE * salience), 0.82), 6) + 0.0 AS alpha FROM sa")
def heatmap_salience(spark, sf_dir):
    maps = Region(spark, sf_dir).heat()
    seen = Q.salience(maps, Q.heatmap_scale(maps)).join(maps.select("roi", "band", "cell", "value", "reason"), ["roi", "band", "cell"])
    return _rounded(Q.overlay(seen).select("roi", "band", "cell", "salience", "alpha"), "salience", "alpha")


@query()
def band_resolution(spark, sf_dir):
    """The bands that a ROI's heatmaps show: edges around supported peaks, split, merged, scored and ranked; too long a chain for SQL, its parts have queries of their own."""
    r = Region(spark, sf_dir)
    peaks = written(r.peaks)
    whole = written(Q.roi_spectrum(r.records, r.roi_spectra))
    search = min(FPS / 2, HIGH_HZ + max(0.75, 6 * BIN))
    chosen = peaks.where(F.col("freq_hz").between(LOW_HZ, search)).where("rank <= 5")
    found = written(Q.merged_bands(whole, chosen, BIN, LOW_HZ, search))
    scores = B.covering_score(found, peaks, BIN)
    out = Q.resolved_bands(found, scores, Q.localization(found, r.records, r.roi_spectra), peaks, LOW_HZ, HIGH_HZ, 3)
    return _rounded(out.select("series_key", "band", "low_hz", "high_hz", "peak_hz", "display_score"), "low_hz", "high_hz", "peak_hz", "display_score")


SEARCH = (0.25, FPS / 2 * 0.85)
FIRST = min(k for k in range(N) if k * BIN >= SEARCH[0])
LAST = max(k for k in range(N // 2 + 1) if k * BIN <= SEARCH[1])


def _candidates(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Candidates of each ROI's suggestion from the motion of its cells along x, and its spectrum."""
    cells = written(cell_traces(table(spark, sf_dir, "events"), "event_type", "user_id % 12", "value", "value", N))
    traces = cells.select("roi", "cell", "xs")
    number = F.col("cell").cast("int")
    fr, fc = (F.floor(number / 4) + 0.5) / 3, (number % 4 + 0.5) / 4
    off = (fr < 0.18) | (fr > 0.82) | (fc < 0.18) | (fc > 0.82)
    root = F.sqrt(F.aggregate("xs", F.lit(0.0), lambda t, x: t + x * x) / N)
    places = traces.select("roi", "cell", F.greatest(root * centre_weight(fr, fc), F.lit(1e-6)).alias("w"), off.alias("edge"), (number == 11).alias("whole"))
    bins, whole = U.searched(traces, places, N, FPS, *SEARCH)
    whole = written(whole)
    return written(U.candidates(written(bins), whole, BIN, LAST - FIRST + 1)), whole


_CAND = f"""{_BOUNDS}, ev AS (SELECT event_type AS roi, CAST(user_id % 12 AS VARCHAR) AS cell, CAST((epoch_us(ts) - lo) * {N} // (hi - lo + 1) AS INTEGER) AS n, value FROM events, b),
 mm AS (SELECT roi, cell, n, avg(value) AS x FROM ev GROUP BY 1, 2, 3), ids AS (SELECT DISTINCT roi, cell FROM ev),
 tr AS (SELECT i.roi, i.cell, CAST(g.n AS INTEGER) AS n, coalesce(mm.x, 0.0) AS x FROM ids i CROSS JOIN range({N}) g(n) LEFT JOIN mm ON mm.roi = i.roi AND mm.cell = i.cell AND mm.n = g.n),
 sm AS (SELECT roi, cell, n, (coalesce(lag(x, 2) OVER v, 0) + 2 * coalesce(lag(x) OVER v, 0) + 3 * x + 2 * coalesce(lead(x) OVER v, 0) + coalesce(lead(x, 2) OVER v, 0)) / 9 AS v FROM tr WINDOW v AS (PARTITION BY roi, cell ORDER BY n)),
 sc AS (SELECT roi, cell, n, v - avg(v) OVER (PARTITION BY roi, cell) AS v FROM sm QUALIFY stddev_pop(v) OVER (PARTITION BY roi, cell) > 1e-6),
 sd AS (SELECT roi, cell, n, v - coalesce(lag(v) OVER (PARTITION BY roi, cell ORDER BY n), v) AS v FROM sc),
 pl AS (SELECT roi, cell, sqrt(avg(x * x)) AS rms, (CAST(cell AS INTEGER) // 4 + 0.5) / 3 AS fr, (CAST(cell AS INTEGER) % 4 + 0.5) / 4 AS fc FROM tr GROUP BY 1, 2),
 pw AS (SELECT roi, cell, greatest(rms * least(greatest(1.10::DOUBLE - 0.70::DOUBLE * sqrt(pow(fr - 0.5, 2) + pow(fc - 0.5, 2)) / 0.5, 0.20), 1.0), 1e-6) AS w, fr < 0.18 OR fr > 0.82 OR fc < 0.18 OR fc > 0.82 AS edge, cell = '11' AS whole FROM pl),
 s1 AS {_dft('sc', 'roi, cell')}, s2 AS {_dft('sd', 'roi, cell')},
 cb AS (SELECT s1.roi, s1.cell, CAST(s1.k - {FIRST} AS INTEGER) AS k, s1.freq_hz, s1.amp, s2.amp AS damp, w, edge, whole FROM s1 JOIN s2 USING (roi, cell, k) JOIN pw USING (roi, cell) WHERE s1.k BETWEEN {FIRST} AND {LAST}),
 f AS (SELECT roi AS series_key, k, freq_hz, sum(amp * w) / sum(w) AS amp, sum(damp * w) / sum(w) AS damp FROM cb GROUP BY 1, 2, 3),
 w2 AS (SELECT *, lag(amp) OVER v AS p2, lead(amp) OVER v AS q2, max(amp) OVER e AS top, max(damp) OVER e AS dtop, quantile_cont(amp, 0.5) OVER e AS median, avg(amp) OVER (PARTITION BY series_key ORDER BY k ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m5,
   quantile_cont(amp, 0.75) OVER (PARTITION BY series_key ORDER BY k ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS l2, quantile_cont(amp, 0.75) OVER (PARTITION BY series_key ORDER BY k ROWS BETWEEN 1 FOLLOWING AND 2 FOLLOWING) AS r2 FROM f WINDOW v AS (PARTITION BY series_key ORDER BY k), e AS (PARTITION BY series_key)),
 bb AS (SELECT * FROM w2 WHERE amp >= p2 AND amp > q2),
 lc AS (SELECT roi, cell, k, w, edge, whole, max(amp) OVER (PARTITION BY roi, cell ORDER BY k ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS peak, max(amp) OVER (PARTITION BY roi, cell) AS cmax, quantile_cont(amp, 0.5) OVER (PARTITION BY roi, cell) AS cmed FROM cb),
 sp AS (SELECT roi, k, sum(CASE WHEN peak >= greatest(cmed * 1.8::DOUBLE, cmax * 0.45::DOUBLE) THEN greatest(cmax, 1e-6) ELSE 0 END) / sum(greatest(cmax, 1e-6)) AS support,
   coalesce(CASE WHEN bool_or(NOT whole) THEN sum(peak * w) FILTER (WHERE edge AND NOT whole) / greatest(sum(peak * w) FILTER (WHERE NOT whole), 1e-6) ELSE sum(peak * w) FILTER (WHERE edge) / greatest(sum(peak * w), 1e-6) END, 0) AS edge FROM lc GROUP BY 1, 2),
 hb AS (SELECT a.series_key, a.k, count(*) AS n, coalesce(0.30::DOUBLE * least(1.0, max(c.amp) FILTER (WHERE abs(c.freq_hz - a.freq_hz * 2) <= greatest({2 * BIN}::DOUBLE, a.freq_hz * 2 * 0.08::DOUBLE)) / any_value(a.amp)), 0.0) + coalesce(0.12::DOUBLE * least(1.0, max(c.amp) FILTER (WHERE abs(c.freq_hz - a.freq_hz * 3) <= greatest({2 * BIN}::DOUBLE, a.freq_hz * 3 * 0.08::DOUBLE)) / any_value(a.amp)), 0.0) AS bonus FROM bb a JOIN bb c ON a.series_key = c.series_key GROUP BY 1, 2),
 ft AS (SELECT bb.series_key, bb.k, bb.freq_hz, bb.amp, support, edge, CASE WHEN n > 1 THEN least(bonus, 1.0) ELSE 0 END AS bonus, greatest(bb.amp - greatest(median, coalesce(l2, median), coalesce(r2, median)), 0) AS prominence, {_clip('1 - m5 / greatest(bb.amp, 1e-6)')} AS sharpness, CASE WHEN dtop > 1e-6 THEN damp / dtop ELSE 0 END AS period,
   {_clip('(support - 0.80::DOUBLE) / 0.15::DOUBLE')} * {_clip('(0.65::DOUBLE - bb.freq_hz) / 0.30::DOUBLE')} AS ubiquity, top FROM bb JOIN sp ON sp.roi = bb.series_key AND sp.k = bb.k JOIN hb ON hb.series_key = bb.series_key AND hb.k = bb.k)"""


@query(f"""WITH {_CAND} SELECT series_key, k, {_round_sql('support', 'edge', 'prominence', 'sharpness', 'period', 'ubiquity')}, round(0.55::DOUBLE * amp / greatest(top, 1e-6) + 0.20::DOUBLE * support + 0.15::DOUBLE * prominence / greatest(amp, 1e-6) + 0.10::DOUBLE * bonus
 + 0.08::DOUBLE * period + 0.08::DOUBLE * sharpness + 0.10::DOUBLE * (1 - edge) - 0.18::DOUBLE * ubiquity, 6) + 0.0 AS score FROM ft""")
def band_candidates(spark, sf_dir):
    found, _ = _candidates(spark, sf_dir)
    names = ("support", "edge", "prominence", "sharpness", "period", "ubiquity", "score")
    return _rounded(found.select("series_key", "k", *names), *names)


@query()
def band_suggestion(spark, sf_dir):
    """The band suggested for each ROI; its candidates and their scores have SQL, the rules that follow are tested on their own."""
    found, whole = _candidates(spark, sf_dir)
    out = U.suggested(found, whole, BIN, FIRST * BIN, *SEARCH)
    return _rounded(out, "low_hz", "high_hz", "peak_hz", "confidence")


@query(f"""WITH {_BASE}, cn AS (SELECT roi, cell, count(*)::DOUBLE AS c FROM ev GROUP BY 1, 2),
 pe AS (SELECT roi, cell, band, sum(CASE WHEN freq_hz BETWEEN l AND h THEN amp * amp ELSE 0 END) / greatest(sum(amp * amp), 1e-9) AS e FROM bs, (VALUES {', '.join(f'({b}, {lo}, {hi})' for b, lo, hi in BANDS)}) v(band, l, h) GROUP BY 1, 2, 3),
 ps AS (SELECT pe.roi, band, CAST(pe.cell AS INTEGER) // 4 AS row, CAST(pe.cell AS INTEGER) % 4 AS col, e * confidence * least(greatest(1.10::DOUBLE - 0.70::DOUBLE * sqrt(pow((CAST(pe.cell AS INTEGER) // 4 + 0.5) / 3 - 0.5, 2) + pow((CAST(pe.cell AS INTEGER) % 4 + 0.5) / 4 - 0.5, 2)) / 0.5, 0.20), 1.0) AS v FROM pe JOIN ids USING (roi, cell)),
 pn AS (SELECT a.roi, a.band, a.row, a.col, avg(d.v) AS m FROM ps a JOIN ps d ON a.roi = d.roi AND a.band = d.band AND abs(a.row - d.row) <= 1 AND abs(a.col - d.col) <= 1 GROUP BY 1, 2, 3, 4)
SELECT roi, band, round(max(m), 6) + 0.0 AS score FROM pn GROUP BY 1, 2""")
def patch_score(spark, sf_dir):
    """How well the best patch of 3 x 3 cells moves within each band."""
    r = Region(spark, sf_dir)
    fixed = F.broadcast(spark.createDataFrame(BANDS, "band int, low_hz double, high_hz double"))
    best = patch_scores(r, r.spectra.join(fixed))
    return best.select("roi", F.col("band").cast("int").alias("band"), _r(F.col("score")).alias("score"))


def patch_scores(r: Region, banded: DataFrame) -> DataFrame:
    """roi, band (string), score from bins of cells (roi, cell, freq_hz, amp) with the bands (band, low_hz, high_hz) that each roi tries."""
    inside = F.sum(F.when(F.col("freq_hz").between(F.col("low_hz"), F.col("high_hz")), F.col("amp") * F.col("amp")).otherwise(0.0))
    rows = banded.groupBy("roi", "cell", "band").agg((inside / F.greatest(F.sum(F.col("amp") * F.col("amp")), F.lit(1e-9))).alias("e"))
    weight = centre_weight((F.col("row") + 0.5) / 3, (F.col("col") + 0.5) / 4)
    rows = rows.join(r.cells.select("roi", "cell", "row", "col", "confidence"), ["roi", "cell"]).withColumn("value", F.col("e") * F.col("confidence") * weight)
    near = G.local_mean(rows.select(F.concat_ws("|", "roi", "band").alias("grid_id"), "row", "col", "value"))
    best = near.groupBy("grid_id").agg(F.max("support").alias("score"))
    return best.select(F.split_part("grid_id", F.lit("|"), F.lit(1)).alias("roi"), F.split_part("grid_id", F.lit("|"), F.lit(2)).alias("band"), "score")


@query()
def band_promotion(spark, sf_dir):
    """The band suggested for each ROI, or a faster one in its place where the motion of its best patch says so; one of the clip's length where there are no candidates. Its rules are tested on their own."""
    found, whole = _candidates(spark, sf_dir)
    out = written(U.suggested(found, whole, BIN, FIRST * BIN, *SEARCH))
    r = Region(spark, sf_dir)
    bands = written(U.tried(out, SEARCH[0], min(FPS * 0.45, 6.0)).withColumn("band", F.concat_ws("_", "low_hz", "high_hz")))
    scores = patch_scores(r, r.spectra.join(bands.withColumnRenamed("series_key", "roi"), "roi"))
    told = bands.join(scores.withColumnRenamed("roi", "series_key"), ["series_key", "band"]).drop("band")
    done = U.or_fallback(whole, U.promoted(out, U.chosen(found), told), N / FPS, FPS)
    return _rounded(done, "low_hz", "high_hz", "peak_hz", "confidence")


@query(f"""WITH {_ROI_PEAKS}, t AS (SELECT series_key, string_agg(printf('%.3f', freq_hz), ';' ORDER BY rank) AS peaks FROM rp JOIN fo ON fo.roi = rp.series_key WHERE rank <= 5 AND fo.overall >= {CUTOFF}::DOUBLE GROUP BY 1)
SELECT fo.roi, m.metric, m.value FROM fo LEFT JOIN t ON t.series_key = fo.roi, LATERAL (VALUES ('valid_cells', CAST(valid_cells AS VARCHAR)), ('rejected_cells', CAST(rejected_cells AS VARCHAR)), ('overall_quality', printf('%.4f', overall)), ('peaks_hz', coalesce(peaks, ''))) m(metric, value)""")
def roi_metrics(spark, sf_dir):
    """A ROI's figures as rows of metric and value, as an artefact lists them; its first five peaks are one text."""
    r = Region(spark, sf_dir)
    few = r.peaks.where("rank <= 5").groupBy("series_key").agg(F.sort_array(F.collect_list(F.struct("rank", "freq_hz"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: F.format_string("%.3f", x.freq_hz)), ";")
    rows = r.overall.join(few.select(F.col("series_key").alias("roi"), text.alias("peaks")), "roi", "left")
    pairs = (("valid_cells", F.col("valid_cells").cast("string")), ("rejected_cells", F.col("rejected_cells").cast("string")), ("overall_quality", F.format_string("%.4f", "overall")), ("peaks_hz", F.coalesce("peaks", F.lit(""))))
    return rows.select("roi", F.inline(F.array(*[F.struct(F.lit(name).alias("metric"), value.alias("value")) for name, value in pairs])))
