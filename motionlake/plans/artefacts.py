"""Queries on artefacts that are written and read back, and on the given tables' files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import artefacts as A
from ..sources import files, grid, table
from .frames import _ACTIVITY, band_activity
from .queries import FPS, ORACLE, _r, _rounded, _spectra, _spectra_sql, query

_BANDS = {band: f"band_{band}" for band, *_ in _ACTIVITY}
_MOST = 4  # more bands are named than there are; what isn't there is 0


# the rounding of the inner query has its offset already
@query(f"""WITH a AS ({ORACLE['band_activity'].replace(', 6) + 0.0', ', 6)+0.0')}) SELECT series_key, n AS frame_index, CAST(printf('%.6f', n / {FPS}::DOUBLE) AS DOUBLE) AS time_seconds, {', '.join(f"coalesce(max(CASE WHEN band = {b} THEN x END), 0.0) AS band_{b}" for b in range(1, _MOST + 1))} FROM a GROUP BY 1, 2""")
def activity_artefact(spark, sf_dir):
    """Bands' activity over time, a column a band, as the files of each series give it back."""
    names = _BANDS | {_MOST: f"band_{_MOST}"}
    rows = band_activity(spark, sf_dir).withColumn("text", A.fixed(F.col("x"), 8))
    out = A.wide(rows, ["series_key", "n"], "band", names, "text", F.lit("0.00000000"))
    out = out.select("series_key", F.col("n").alias("frame_index"), A.fixed(F.col("n") / FPS, 6).alias("time_seconds"), *names.values())
    path = A.put_csv(out, "band_activity_vs_time", "series_key", ["frame_index"])
    return A.read_csv(spark, path, f"frame_index int, time_seconds double, {', '.join(f'{c} double' for c in names.values())}, series_key string")


_COLS = 12  # the last column has no cell


@query(f"""WITH c AS (SELECT l_returnflag AS grid_id, CAST(l_quantity AS INTEGER) AS row, CAST(round_even(l_discount * 100, 0) AS INTEGER) AS col, round(avg(l_extendedprice), 4) + 0.0 AS v FROM lineitem GROUP BY 1, 2, 3)
SELECT grid_id, row, {', '.join(f'max(CASE WHEN col = {c} AND (row + col) % 7 <> 0 THEN v END) AS c{c}' for c in range(_COLS))} FROM c GROUP BY 1, 2""")
def heatmap_artefact(spark, sf_dir):
    """Grids as files of one line a row, blank where there is no finite value, read back. Every seventh diagonal is made not finite."""
    value = F.when((F.col("row") + F.col("col")) % 7 == 0, float("nan")).otherwise(_r(F.col("value"), 4))
    rows = grid(table(spark, sf_dir, "lineitem")).withColumn("text", A.fixed(value, 8))
    names = {c: f"c{c}" for c in range(_COLS)}
    path = A.put_csv(A.wide(rows, ["grid_id", "row"], "col", names, "text"), "heatmap", "grid_id", ["row"])
    return A.read_csv(spark, path, f"row int, {', '.join(f'{c} double' for c in names.values())}, grid_id string")


@query(f"WITH {_spectra_sql('event_type')} SELECT series_key AS roi_label, k AS place, round(freq_hz, 6) + 0.0 AS frequency_hz, round(amp, 6) + 0.0 AS amplitude FROM f")
def spectrum_artefact(spark, sf_dir):
    """Each series' spectrum as one document of two lists, read back and taken apart."""
    rows = _rounded(_spectra(spark, sf_dir), "freq_hz", "amp")
    bins = F.sort_array(F.collect_list(F.struct("k", "freq_hz", "amp")))
    docs = rows.groupBy(F.col("series_key").alias("roi_label")).agg(bins.alias("b")).select("roi_label", F.col("b.freq_hz").alias("frequency_hz"), F.col("b.amp").alias("amplitude"))
    back = spark.read.schema(docs.schema).json(A.put_json(docs, "roi_spectrum"))
    return back.select("roi_label", F.posexplode(F.arrays_zip("frequency_hz", "amplitude")).alias("place", "b")).select("roi_label", "place", "b.frequency_hz", "b.amplitude")


@query()
def source_hashes(spark, sf_dir):
    """Name, size and hash of each given table's file; tests hold it against a hash of the bytes."""
    return files.hashed(spark, sf_dir, "*.parquet").select(F.element_at(F.split("path", "/"), -1).alias("name"), "size", "sha256")
