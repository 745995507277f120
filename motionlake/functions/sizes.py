"""Sizes: zones carried to another frame, presets fitted to a source, sizes that encoders take, layouts of analysis tiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def scaled_zone(shape: Column, x: Column, y: Column, width: Column, height: Column, radius: Column, across: Column, down: Column) -> Column:
    """A zone's x, y, width, height and radius in a frame ``across`` times as wide and ``down`` times as high; what its shape hasn't is null, what it lacks counts as 0."""
    box, none = shape == "rectangle", F.lit(0.0)
    return F.struct(
        (x * across).alias("x"), (y * down).alias("y"), F.when(box, F.coalesce(width, none) * across).alias("width"), F.when(box, F.coalesce(height, none) * down).alias("height"),
        F.when(~box, F.coalesce(radius, none) * ((across + down) / 2)).alias("radius"),
    )


def fitted(width: Column, height: Column, presets: Sequence[tuple[int, int]]) -> Column:
    """Array of (width, height): a source made to fit each preset in its own proportions, never enlarged, each size once."""

    def fit(across: int, down: int) -> Column:
        scale = F.least(F.lit(float(across)) / width, F.lit(float(down)) / height, F.lit(1.0))
        side = lambda x: F.greatest(F.lit(1), F.rint(x * scale).cast("int"))
        return F.struct(side(width).alias("width"), side(height).alias("height"))

    return F.array_distinct(F.array(*[fit(*preset) for preset in presets]))


def encoder_size(width: Column, height: Column, most_width: Column, most_height: Column) -> Column:
    """(width, height) of even sides, at most those given; a side of one stays, and null stands for a side of none."""

    def side(x: Column, most: Column) -> Column:
        held = F.least(x, most)
        return F.when((held > 1) & (held % 2 != 0), held - 1).otherwise(held)

    w, h = side(width, most_width), side(height, most_height)
    return F.when((w > 0) & (h > 0), F.struct(w.cast("int").alias("width"), h.cast("int").alias("height")))


def layout(width: Column, height: Column) -> tuple[Column, Column, Column]:
    """Rows, columns and the even side of the tiles that a frame is analysed in: about one per 60 pixels, 6 to 16 rows and 6 to 10 columns, tiles wider than their cells."""
    count = lambda x, most: F.least(F.greatest(F.rint(x / 60.0), F.lit(6.0)), F.lit(float(most))).cast("int")
    rows, columns, short = count(height, 16), count(width, 10), F.least(width, height).cast("int")
    side = F.greatest(F.lit(12), F.least(F.rint(F.least(height / rows, width / columns) * 1.45).cast("int"), short))
    return rows, columns, F.when(side % 2 == 0, side).when(side == short, side - 1).otherwise(side + 1)


def even_starts(length: Column, tile: Column, count: Column) -> Column:
    """Where ``count`` tiles begin along a length, evenly, the last one at its end; fewer where they coincide, and one where a tile fills it."""
    step = (length - tile) / F.greatest(count - 1, F.lit(1))
    found = F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.rint(i * step).cast("int"))
    return F.when((tile >= length) | (count <= 1), F.array(F.lit(0))).otherwise(F.array_distinct(found))
