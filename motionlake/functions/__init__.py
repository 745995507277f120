"""Scalar functions of columns: tolerant parsers, rounding, labels, resolutions and zones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_number(text: Column, default: float = 0.0) -> Column:
    return F.when(text.isNull(), default).otherwise(F.coalesce(text.try_cast("double"), F.lit(default)))


def parse_fraction(text: Column, default: float = 0.0, marks: str = "/:", none: tuple[str, ...] = ("", "N/A")) -> Column:
    """a/b or a:b as a number; the default for nothing, for what isn't numbers, and for a zero denominator. The first of ``marks`` that occurs parts the two."""
    value = parse_number(text, default)
    for mark in reversed(marks):
        a = F.substring_index(text, mark, 1).try_cast("double")
        b = F.substring(text, F.instr(text, mark) + 1, F.length(text)).try_cast("double")
        value = F.when(F.instr(text, mark) > 0, F.when(a.isNull() | b.isNull() | (b == 0), default).otherwise(a / b)).otherwise(value)
    return F.when(text.isNull() | text.isin(*none), default).otherwise(value)


def parse_ratio(text: Column) -> Column:
    """A pixel's aspect ratio: like a fraction, 1 for nothing."""
    return parse_fraction(text, 1.0, ":/", ("", "N/A", "0:1", "1:0"))


def parse_int(text: Column, default: int = 0) -> Column:
    """Cut off after the point."""
    return F.coalesce(text.try_cast("double").cast("long"), F.lit(default))


def rotation(stream: Column) -> Column:
    """Degrees of a stream (JSON text): those of the first display matrix, else of the tag; null for nothing."""
    side = F.from_json(F.get_json_object(stream, "$.side_data_list"), "array<struct<side_data_type: string, rotation: string>>")
    matrix = F.get(F.filter(F.coalesce(side, F.array().cast("array<struct<side_data_type: string, rotation: string>>")), lambda x: x.side_data_type == "Display Matrix"), 0)
    return F.when(matrix.isNotNull(), matrix.rotation.try_cast("double")).otherwise(F.get_json_object(stream, "$.tags.rotate").try_cast("double"))


def band_edge(hz: Column) -> Column:
    """To the nearest 0.05, halves to even."""
    return F.rint(hz / 0.05) * 0.05


def centre_weight(row: Column, col: Column) -> Column:
    """By how far fractions of height and width are from the centre."""
    return F.least(F.greatest(1.10 - 0.70 * F.hypot(row - 0.5, col - 0.5) / 0.5, F.lit(0.20)), F.lit(1.0))


def strength(x: str, y: str) -> Column:
    """Aggregate: the absolute correlation of two columns; 0 if either hardly varies."""
    varies = (F.stddev_pop(x) > 1e-6) & (F.stddev_pop(y) > 1e-6)
    # without variation there is nothing to divide by
    return F.when(varies, F.abs(F.covar_pop(x, y)) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))).otherwise(0.0)


def confidence_label(score: Column) -> Column:
    return F.when(score >= 0.80, "High").when(score >= 0.60, "Moderate").when(score >= 0.40, "Low").otherwise("Poor")


def square_width(width: Column, ratio: Column) -> Column:
    """The width of square pixels, where the ratio isn't one already."""
    return F.when(F.abs(ratio - 1) > 1e-3, F.greatest(F.lit(1), F.rint(width * ratio).cast("int"))).otherwise(width)


def analysis_size(sw: Column, sh: Column, pw: Column, ph: Column, most: int = 700_000) -> tuple[Column, Column]:
    """Width and height that a source is analysed at: the processing size if the source is no larger, the source up to ``most`` pixels, else about as many, even, and never below the processing size."""
    scale = F.sqrt(F.lit(float(most)) / (sw * sh))
    even = lambda x: F.greatest(F.lit(2), (F.floor(F.floor(x) / 2) * 2).cast("int"))
    cut = lambda s, p: F.greatest(even(s * scale), p)
    pick = lambda s, p: F.when(sw * sh <= pw * ph, p).when(sw * sh <= most, s).otherwise(cut(s, p)).cast("int")
    return pick(sw, pw), pick(sh, ph)


def parabolic(before: Column, at: Column, after: Column, tiny: float = 1e-6, hold: bool = True) -> Column:
    """Offset of a peak between samples; 0 where it is flat."""
    bend = before - 2 * at + after
    value = F.when(F.abs(bend) < tiny, 0.0).otherwise(0.5 * (before - after) / bend)
    return F.least(F.greatest(value, F.lit(-1.0)), F.lit(1.0)) if hold else value


def wrapped(at: Column, length: int) -> Column:
    """Positions beyond half the length count backwards."""
    return F.when(at > length / 2, at - length).otherwise(at)


def drift_gate(seen: Column, pixels: Column, acknowledged: Column, limit: float = 2.0) -> tuple[Column, Column]:
    """Whether a drift warning is active, and whether rendering may go on; unknown counts as no."""
    active = F.coalesce(seen, F.lit(False)) | F.coalesce(pixels >= limit, F.lit(False))
    return active, ~active | F.coalesce(acknowledged, F.lit(False))


def zone_fault(shape: Column, x: Column, y: Column, width: Column, height: Column, radius: Column, frame_w: Column, frame_h: Column) -> Column:
    """The first rule that a zone breaks, or null."""
    box, circle = shape == "rectangle", shape == "circle"
    out = (x + width > frame_w) | (y + height > frame_h)
    beyond = (x - radius < 0) | (y - radius < 0) | (x + radius > frame_w) | (y + radius > frame_h)
    return (
        F.when((x < 0) | (y < 0), "negative_origin")
        .when(box & (width.isNull() | height.isNull()), "rectangle_dimensions_missing").when(box & ((width <= 0) | (height <= 0)), "rectangle_dimensions_invalid").when(box & out, "rectangle_out_of_bounds")
        .when(circle & radius.isNull(), "circle_radius_missing").when(circle & (radius <= 0), "circle_radius_invalid").when(circle & beyond, "circle_out_of_bounds")
    )
