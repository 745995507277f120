"""Nested documents of a line each: read as they are, checked against rules that are data, every violation a row."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fields by path: kind, and whether they must be there. A list's items are at ``[]``; objects that aren't open have no fields but these.
FIELDS = {
    "schema_version": ("string", True), "intent": ("object", True), "intent.phase": ("object", True), "intent.phase.low_hz": ("number", True), "intent.phase.high_hz": ("number", True),
    "intent.processing_resolution": ("object", True), "intent.processing_resolution.width": ("integer", True), "intent.processing_resolution.height": ("integer", True),
    "intent.output_resolution": ("object", True), "intent.output_resolution.width": ("integer", True), "intent.output_resolution.height": ("integer", True),
    "intent.analysis": ("object", False), "intent.analysis.auto_band_count": ("integer", False), "intent.analysis.band_mode": ("string", False), "intent.analysis.manual_bands": ("array", False),
    "results": ("object", True), "results.source": ("object", True), "results.source.fingerprint_sha256": ("string", True), "results.preflight": ("object", True), "results.preflight.source_is_cfr": ("boolean", False),
    "results.preflight.working_fps": ("number", False), "results.preflight.working_source_resolution": ("object", False), "results.preflight.normalization_steps": ("array", False),
    "results.drift_acknowledgement": ("object", False), "results.drift_acknowledgement.reviewed_source_fingerprint_sha256": ("string", True),
}
#: Objects whose further fields are violations.
CLOSED = ("intent.phase", "intent.processing_resolution", "intent.output_resolution", "intent.analysis")
#: Texts that a field may hold.
CHOICES = {"intent.analysis.band_mode": ("auto", "manual_single", "manual_multi")}
#: The version that is written, and older ones that are read with a warning.
CURRENT, OLDER = "1.5.0", ("1.0.0", "1.1.0", "1.2.0", "1.3.0", "1.4.0")
MOST_BANDS = 10
_KINDS = {"string": ("STRING",), "boolean": ("BOOLEAN",), "integer": ("BIGINT",), "number": ("BIGINT", "DOUBLE", "FLOAT"), "object": ("object",), "array": ("array",)}
_BANDS, _STEPS = "intent.analysis.manual_bands", "results.preflight.normalization_steps"
#: Where a normalized source is named; its kind isn't asked.
_NORMALIZED = "results.diagnostics_summary.normalized_source_path"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """raw: a document a line, as it is; nothing is dropped for being broken."""
    return spark.read.text(path).select(F.col("value").alias("raw"))


def _found(doc: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(doc, f"$.{path}", kind)


def _nested(paths: dict[str, str], at: str = "") -> str:
    """The type of the values at ``paths`` (path: type) under ``at``, nested as they are."""
    names = dict.fromkeys(p[len(at):].split(".")[0] for p in paths if p.startswith(at))
    return f"struct<{', '.join(f'{n}: ' + (paths.get(at + n) or _nested(paths, f'{at}{n}.')) for n in names)}>"


#: The type of an object of which no field is asked.
_OBJECT = "struct<none: variant>"
_LISTS = {_BANDS: "array<struct<low_hz: variant, high_hz: variant>>", _STEPS: "array<variant>"}
#: A document as nested values, taken in one walk; null where it has nothing, or no object or list where one belongs. Walking from the top to each value, and naming the kind of whole objects with all that is in them, would take most of the time.
_TREE = _nested({p: _LISTS.get(p, _OBJECT if kind == "object" else "variant") for p, (kind, _) in FIELDS.items() if not any(q.startswith(f"{p}.") for q in FIELDS)} | {_NORMALIZED: "variant"})


def _at(tree: Column, path: str) -> Column:
    return functools.reduce(lambda c, name: c[name], path.split("."), tree)


def _value(tree: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(_at(tree, path), "$", kind)


def _kind(doc: Column, tree: Column, path: str) -> Column:
    """Spark's name of the kind; of what is an object or a list where one belongs, just that."""
    kind = FIELDS[path][0]
    if kind not in ("object", "array"):
        return F.schema_of_variant(_at(tree, path))
    return F.when(_at(tree, path).isNotNull(), kind).otherwise(F.schema_of_variant(_found(doc, path)))


def _is(found: Column, kind: str) -> Column:
    fits = found.isin(*_KINDS[kind])
    return fits | found.startswith("DECIMAL") if kind == "number" else fits


def _told(path: str | Column, rule: str, severity: str = "error") -> Column:
    return F.struct((F.lit(path) if isinstance(path, str) else path).alias("path"), F.lit(rule).alias("rule"), F.lit(severity).alias("severity"))


def _numbers(rules: list[tuple], first: int) -> Column:
    """Text: the numbers, from ``first`` on, of the rules (whether it is broken, path, rule, severity) that are broken. Unlike functions of arrays, which are interpreted, this is compiled with all its conditions."""
    return F.concat_ws(",", *[F.when(broken, str(i)) for i, (broken, *_) in enumerate(rules, first)])


def _unknown(path: str):
    return lambda name: _told(F.concat(F.lit(f"{path}."), name), "unknown")


def _once(rows: DataFrame, *names: str) -> DataFrame:
    """``rows`` with these columns behind a generator of one row, which keeps filters and later uses from repeating what they are worked out of."""
    return rows.select(*[c for c in rows.columns if c not in names], F.inline(F.array(F.struct(*names))))


def _shape(kinds: Column, tree: Column) -> list[tuple]:
    """What is missing, of another kind, or none of the choices. A missing object's fields aren't told one by one."""
    out = []
    for path, (kind, required) in FIELDS.items():
        parent = path.rpartition(".")[0]
        there = _is(kinds[parent], "object") if parent else F.lit(True)
        is_ = kinds[path]
        if required:
            out.append((F.coalesce(there, F.lit(False)) & (is_.isNull() | (is_ == "VOID")), path, "required", "error"))
        out.append(((is_ != "VOID") & ~_is(is_, kind), path, "kind", "error"))
    for path, choices in CHOICES.items():
        out.append(((kinds[path] == "STRING") & ~_value(tree, path, "string").isin(*choices), path, "choice", "error"))
    return out


def _further(doc: Column, tree: Column, raw: Column) -> Column:
    """The same of a list's items, as violations, and fields that aren't known."""
    none = F.array().cast("array<struct<path: string, rule: string, severity: string>>")
    unknown = []
    for path in CLOSED:
        known = F.array(*[F.lit(p.rpartition(".")[2]) for p in FIELDS if p.rpartition(".")[0] == path])
        # only names are asked, so values become structs of nothing, which costs least; a text is read for their order where there are further ones
        names = F.map_keys(_found(doc, path, f"map<string, {_OBJECT}>"))
        listed = F.coalesce(F.json_object_keys(F.get_json_object(raw, f"$.{path}")), F.array().cast("array<string>"))
        told = F.transform(F.array_except(listed, known), _unknown(path))
        unknown.append(F.when(F.size(F.array_except(names, known)) > 0, told).otherwise(none))
    bands = F.coalesce(_at(tree, _BANDS), F.array().cast(_LISTS[_BANDS]))
    number = lambda v: F.coalesce(_is(F.schema_of_variant(v), "number"), F.lit(False))
    items = F.transform(bands, lambda b, i: F.when(~(number(b.low_hz) & number(b.high_hz)), _told(F.concat(F.lit(f"{_BANDS}."), i.cast("string")), "kind")))
    return F.concat(F.array_compact(items), *unknown)


def _version(tree: Column) -> list[tuple]:
    """Whether the version can be read: the current one, or with a warning one of the older ones."""
    text = _value(tree, "schema_version", "string")
    number = F.transform(F.split(text, r"\."), lambda p: p.try_cast("int"))
    now = F.array(*[F.lit(int(p)) for p in CURRENT.split(".")])
    shaped = text.rlike(r"^\d+\.\d+\.\d+$")
    other = shaped & (text != CURRENT) & ~text.isin(*OLDER)
    major = F.get(number, 0) != F.get(now, 0)
    told = lambda when, rule, severity="error": (when, "schema_version", rule, severity)
    return [told(~shaped, "version_malformed"), told(other & major, "version_major"), told(other & ~major & (number > now), "version_newer"), told(other & ~major & (number < now), "version_older"), told(text.isin(*OLDER), "version_compatible", "warning")]


def _sense(kinds: Column, tree: Column) -> list[tuple]:
    """Rules between fields of a document of the right shape."""
    at = lambda path, kind: _value(tree, path, kind)
    phase, analysis, ready = "intent.phase.", "intent.analysis.", "results.preflight."
    bands = F.coalesce(_at(tree, _BANDS), F.array().cast(_LISTS[_BANDS]))
    count, mode = F.coalesce(at(analysis + "auto_band_count", "bigint"), F.lit(1)), at(analysis + "band_mode", "string")
    side = lambda which, name: at(f"intent.{which}_resolution.{name}", "bigint")
    reviewed, fingerprint = at("results.drift_acknowledgement.reviewed_source_fingerprint_sha256", "string"), at("results.source.fingerprint_sha256", "string")
    steps = F.coalesce(F.size(_at(tree, _STEPS)), F.lit(0))
    path = F.coalesce(at(_NORMALIZED, "string"), F.lit(""))
    derived = F.coalesce(~at(ready + "source_is_cfr", "boolean"), F.lit(False)) | (path != "") | (steps > 0)
    absent = lambda name: F.coalesce(kinds[ready + name], F.lit("VOID")) == "VOID"
    found = [
        (at(phase + "high_hz", "double") <= at(phase + "low_hz", "double"), phase + "high_hz", "not_above_low"), (~count.between(1, MOST_BANDS), analysis + "auto_band_count", "out_of_range"),
        (F.size(bands) > MOST_BANDS, _BANDS, "too_many"), (mode.isin("manual_single", "manual_multi") & (F.size(bands) == 0), _BANDS, "none_given"),
        ((side("processing", "width") != side("output", "width")) | (side("processing", "height") != side("output", "height")), "intent.output_resolution", "not_as_processed"),
        (reviewed != fingerprint, "results.drift_acknowledgement.reviewed_source_fingerprint_sha256", "not_the_source"),
        (derived & absent("working_fps"), ready + "working_fps", "needed_when_derived"), (derived & absent("working_source_resolution"), ready + "working_source_resolution", "needed_when_derived"), (derived & (steps == 0), _STEPS, "needed_when_derived"),
    ]
    return [(*rule, "error") for rule in found]


def _turned(tree: Column) -> Column:
    """Bands that aren't above their low end, as violations."""
    bands = F.coalesce(_at(tree, _BANDS), F.array().cast(_LISTS[_BANDS]))
    number = lambda v: F.try_variant_get(v, "$", "double")
    return F.array_compact(F.transform(bands, lambda b, i: F.when(number(b.high_hz) <= number(b.low_hz), _told(F.concat(F.lit(f"{_BANDS}."), i.cast("string"), F.lit(".high_hz")), "not_above_low"))))


def checked(docs: DataFrame, raw: str = "raw") -> DataFrame:
    """``docs`` with doc (variant; null where the text is no document), violations (path, rule, severity) and status.

    Later rules are asked only where earlier ones hold: text, shape, version,
    then sense.  A document is valid, valid_with_warnings or invalid.  A null
    text is malformed, as is one whose outermost value is no object.
    """
    rows = docs.withColumn("parsed_", F.try_parse_json(raw))
    rows = rows.withColumn("tree_", F.try_variant_get("parsed_", "$", _TREE))
    doc, tree, kinds = F.col("doc"), F.col("tree_"), F.col("kinds_")
    rows = rows.withColumns({"doc": F.when(tree.isNotNull(), F.col("parsed_")), "kinds_": F.struct(*[_kind(F.col("parsed_"), tree, path).alias(path) for path in FIELDS])})
    shape, version, sense = _shape(kinds, tree), _version(tree), _sense(kinds, tree)
    rules = [("", "malformed", "error"), *[rule[1:] for rule in (*shape, *version, *sense)]]
    rows = rows.withColumns({"shape_": _numbers(shape, 2), "version_": _numbers(version, 2 + len(shape)), "sense_": F.when(_value(tree, "schema_version", "string").isin(CURRENT, *OLDER), _numbers(sense, 2 + len(shape) + len(version))), "further_": _further(doc, tree, F.col(raw))})
    warned = [str(i) for i, (*_, severity) in enumerate(rules, 1) if severity == "warning"]
    misshapen, unread = (F.col("shape_") != "") | (F.size("further_") > 0), (F.col("version_") != "") & ~F.col("version_").isin(*warned)
    rows = rows.withColumn("step_", F.when(doc.isNull(), 0).when(misshapen, 1).when(unread, 2).otherwise(3))
    step, none = F.col("step_"), F.array().cast("array<struct<path: string, rule: string, severity: string>>")
    numbers = F.when(step == 0, "1").when(step == 1, F.col("shape_")).when(step == 2, F.col("version_")).otherwise(F.concat_ws(",", F.nullif("version_", F.lit("")), F.nullif("sense_", F.lit(""))))
    every = F.array(*[_told(*rule) for rule in rules])
    told = F.when(numbers != "", F.transform(F.split(numbers, ","), lambda i: F.element_at(every, i.cast("int")))).otherwise(none)
    beside = F.when(step == 1, F.col("further_")).when(step == 3, _turned(tree)).otherwise(none)
    rows = rows.withColumn("violations", F.concat(told, beside)).drop("parsed_", "tree_", "kinds_", "shape_", "version_", "sense_", "further_", "step_")
    rows = _once(rows, "doc", "violations")
    bad = lambda c: F.exists(c, lambda v: v.severity == "error")
    return rows.withColumn("status", F.when(bad("violations"), "invalid").when(F.size("violations") > 0, "valid_with_warnings").otherwise("valid"))


def intended(docs: DataFrame) -> DataFrame:
    """``checked`` documents with what they intend and nothing of their results: low_hz, high_hz, width, height, band_mode, bands; null where one can't be loaded."""
    get = lambda path, kind: F.when(F.col("status") != "invalid", _found(F.col("doc"), f"intent.{path}", kind))
    columns = {
        "low_hz": get("phase.low_hz", "double"), "high_hz": get("phase.high_hz", "double"), "width": get("processing_resolution.width", "int"), "height": get("processing_resolution.height", "int"),
        "band_mode": get("analysis.band_mode", "string"), "bands": get("analysis.manual_bands", "array<struct<low_hz: double, high_hz: double>>"),
    }
    return docs.withColumns(columns).drop("doc", "violations")


def intents(docs: DataFrame) -> DataFrame:
    """The same of those that can be loaded."""
    return intended(docs.where("status <> 'invalid'"))
