"""Documents that are broken in each way, one at a time."""

import copy
import json

from motionlake.plans import QUERIES
from motionlake.sources import documents as D

GOOD = {
    "schema_version": "1.5.0",
    "intent": {
        "phase": {"low_hz": 1, "high_hz": 5.5}, "processing_resolution": {"width": 320, "height": 180}, "output_resolution": {"width": 320, "height": 180},
        "analysis": {"auto_band_count": 3, "band_mode": "manual_single", "manual_bands": [{"low_hz": 1.5, "high_hz": 2}]},
    },
    "results": {"source": {"fingerprint_sha256": "ab"}, "preflight": {"source_is_cfr": True}, "drift_acknowledgement": {"reviewed_source_fingerprint_sha256": "ab"}, "more": [1]},
    "observed_environment": {"anything": None},
}


def changed(path, value=None, remove=False):
    doc = copy.deepcopy(GOOD)
    *parents, last = path.split(".")
    at = doc
    for name in parents:
        at = at[name]
    if remove:
        del at[last]
    else:
        at[last] = value
    return json.dumps(doc)


BAND = "intent.analysis.manual_bands"
CASES = [
    (json.dumps(GOOD), set()), (None, {("", "malformed")}), ("", {("", "malformed")}), ("[1]", {("", "malformed")}), ("7", {("", "malformed")}), (json.dumps(GOOD)[:-1], {("", "malformed")}),
    ("{}", {("schema_version", "required"), ("intent", "required"), ("results", "required")}),
    (changed("intent", {}), {("intent.phase", "required"), ("intent.processing_resolution", "required"), ("intent.output_resolution", "required")}), (changed("intent", 3), {("intent", "kind")}),
    (changed("intent.phase.low_hz", "1"), {("intent.phase.low_hz", "kind")}), (changed("intent.phase.low_hz", None), {("intent.phase.low_hz", "required")}), (changed("intent.processing_resolution.width", 3.5), {("intent.processing_resolution.width", "kind")}),
    (changed("intent.phase.note", 1), {("intent.phase.note", "unknown")}), (changed("intent.note", 1), set()), (changed("intent.analysis.band_mode", "none"), {("intent.analysis.band_mode", "choice")}),
    (changed(BAND, {"low_hz": 1}), {(BAND, "kind")}), (changed(BAND, [{"low_hz": 1, "high_hz": 2}, {"low_hz": 1}, None, 4]), {(f"{BAND}.{i}", "kind") for i in (1, 2, 3)}),
    (changed("schema_version", "1.3.0"), {("schema_version", "version_compatible")}), (changed("schema_version", "1.3.1"), {("schema_version", "version_older")}), (changed("schema_version", "1.10.0"), {("schema_version", "version_newer")}),
    (changed("schema_version", "2.5.0"), {("schema_version", "version_major")}), (changed("schema_version", "v1"), {("schema_version", "version_malformed")}), (changed("schema_version", 1), {("schema_version", "kind")}),
    (changed("intent.phase.high_hz", 1), {("intent.phase.high_hz", "not_above_low")}), (changed("intent.analysis.auto_band_count", 0), {("intent.analysis.auto_band_count", "out_of_range")}),
    (changed(BAND, []), {(BAND, "none_given")}), (changed(BAND, [{"low_hz": 1, "high_hz": 2}] * 11), {(BAND, "too_many")}), (changed(BAND, [{"low_hz": 1, "high_hz": 2}, {"low_hz": 2, "high_hz": 2}]), {(f"{BAND}.1.high_hz", "not_above_low")}),
    (changed("intent.output_resolution.height", 90), {("intent.output_resolution", "not_as_processed")}), (changed("results.source.fingerprint_sha256", "cd"), {("results.drift_acknowledgement.reviewed_source_fingerprint_sha256", "not_the_source")}),
    (changed("results.drift_acknowledgement", remove=True), set()), (changed("intent.analysis", remove=True), set()),
    (changed("results.preflight", {"source_is_cfr": False}), {(f"results.preflight.{n}", "needed_when_derived") for n in ("working_fps", "working_source_resolution", "normalization_steps")}),
    (changed("results.preflight", {"normalization_steps": ["cfr"], "working_fps": 24}), {("results.preflight.working_source_resolution", "needed_when_derived")}),
    (changed("results.diagnostics_summary", {"normalized_source_path": "x"}), {(f"results.preflight.{n}", "needed_when_derived") for n in ("working_fps", "working_source_resolution", "normalization_steps")}),
]


def test_each_rule_and_nothing_else(spark):
    # repeated documents are rows like any other; a column of the caller's stays
    df = spark.createDataFrame([(i, text, "kept") for i, (text, _) in enumerate(CASES * 2)], "i long, raw string, path string")
    rows = D.checked(df).select("i", "path", "violations", "status").collect()
    assert len(rows) == 2 * len(CASES) and {r.path for r in rows} == {"kept"}
    for r in rows:
        text, told = CASES[r.i % len(CASES)]
        assert {(v.path, v.rule) for v in r.violations} == told and len(r.violations) == len(told), text
        assert r.status == ("valid" if not told else "valid_with_warnings" if told == {("schema_version", "version_compatible")} else "invalid")


def test_lines_are_read_as_they_are_and_intents_loaded(spark, tmp_path):
    (tmp_path / "a.json").write_text("\n".join([json.dumps(GOOD), "{broken", "", json.dumps(GOOD)]))
    rows = D.checked(D.read_lines(spark, str(tmp_path)))
    assert sorted(r.status for r in rows.collect()) == ["invalid", "invalid", "valid", "valid"]
    loaded = D.intents(rows).collect()
    assert [(r.low_hz, r.high_hz, r.width, r.height, r.band_mode, [tuple(b) for b in r.bands]) for r in loaded] == [(1.0, 5.5, 320, 180, "manual_single", [(1.5, 2.0)])] * 2
    assert "doc" not in D.intents(rows).columns and D.intents(rows.where("false")).count() == 0


def test_further_fields_are_told_in_their_order(spark):
    text = changed("intent.phase", {"z": 1, "low_hz": 1, "b": {"c": 2}, "high_hz": 2, "a.b": None})
    found = D.checked(spark.createDataFrame([(text,)], "raw string")).first().violations
    assert [tuple(v) for v in found] == [(f"intent.phase.{n}", "unknown", "error") for n in ("z", "b", "a.b")]


def test_each_document_is_read_and_walked_once(spark):
    """Whole objects' kinds, and a second pass for what can't be loaded, made the time many times that of parsing."""
    for name in ("sidecar_violations", "sidecar_intents"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("parseJson") == 1 and plan.count("Relation [value") == 1, name
        assert plan.count("SchemaOfVariant") < 2 * len(D.FIELDS), name
