"""Box and ring geometry as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, hi: Column) -> Column:
    """x within [0, hi]; a NaN becomes hi."""
    return F.greatest(F.lit(0.0), F.least(hi.cast("double"), x))


def perturbed(box: dict[str, Column], scale: Column, dx: Column, dy: Column, width: Column, height: Column) -> dict[str, Column]:
    """A box grown by `scale` in total and shifted by shares of its unscaled sides (at least 1), then clamped to the frame."""
    w = F.greatest(F.lit(1.0), box["x1"] - box["x0"])
    h = F.greatest(F.lit(1.0), box["y1"] - box["y0"])
    grow_x, grow_y, move_x, move_y = w * scale / 2, h * scale / 2, w * dx, h * dy
    return {
        "x0": clamp(box["x0"] - grow_x + move_x, width - 1),
        "y0": clamp(box["y0"] - grow_y + move_y, height - 1),
        "x1": clamp(box["x1"] + grow_x + move_x, width - 1),
        "y1": clamp(box["y1"] + grow_y + move_y, height - 1),
    }


def region(box: dict[str, Column], width: Column, height: Column) -> dict[str, Column]:
    """The window around a box in which its masks are held: padded by its longer side, 64 pixels at least, and cut at the frame."""
    pad = F.greatest(F.lit(64.0), box["x1"] - box["x0"], box["y1"] - box["y0"])
    return {
        "rx0": F.greatest(F.lit(0), F.floor(box["x0"] - pad)).cast("int"),
        "ry0": F.greatest(F.lit(0), F.floor(box["y0"] - pad)).cast("int"),
        "rx1": F.least(width.cast("long"), F.ceil(box["x1"] + pad)).cast("int"),
        "ry1": F.least(height.cast("long"), F.ceil(box["y1"] + pad)).cast("int"),
    }


def _edges(ring: Column) -> Column:
    """(point, next point) around a closed ring."""
    rest = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    return F.zip_with(ring, rest, lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def _sum(values: Column, f) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, e: s + f(e))


def ring_area(ring: Column) -> Column:
    """Signed area (shoelace); 0 below three points."""
    return F.when(F.size(ring) < 3, F.lit(0.0)).otherwise(_sum(_edges(ring), lambda e: e["a"]["x"] * e["b"]["y"] - e["b"]["x"] * e["a"]["y"]) / 2)


def ring_perimeter(ring: Column) -> Column:
    return _sum(_edges(ring), lambda e: F.sqrt((e["a"]["x"] - e["b"]["x"]) * (e["a"]["x"] - e["b"]["x"]) + (e["a"]["y"] - e["b"]["y"]) * (e["a"]["y"] - e["b"]["y"])))


def ring_bbox(ring: Column) -> Column:
    side = lambda f, c: f(F.transform(ring, lambda p: p[c]))
    return F.struct(side(F.array_min, "x").alias("x0"), side(F.array_min, "y").alias("y0"), side(F.array_max, "x").alias("x1"), side(F.array_max, "y").alias("y1"))


def part_area(exterior: Column, holes: Column) -> Column:
    return F.abs(ring_area(exterior)) - F.aggregate(holes, F.lit(0.0), lambda s, h: s + F.abs(ring_area(h)))


def epsilon_bound(area: Column, perimeter: Column, extent: Column) -> Column:
    """The largest simplification tolerance worth trying: bounded by the extent and by the mean thickness."""
    by_extent = F.greatest(F.lit(1.0), 0.02 * extent)
    return F.when((area <= 0) | (perimeter <= 0), by_extent).otherwise(F.least(by_extent, F.greatest(F.lit(1.0), 3 * area / perimeter)))
