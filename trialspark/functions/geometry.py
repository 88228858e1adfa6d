"""Geometry as column expressions. y grows downwards, so angles run clockwise."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TURN = 2 * math.pi


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    dx, dy = ax - bx, ay - by
    return F.sqrt(dx * dx + dy * dy)


def angle_from(cx: Column, cy: Column, x: Column, y: Column) -> Column:
    return F.atan2(y - cy, x - cx)


def normalize_angle(a: Column) -> Column:
    """The angle in [0, 2 pi)."""
    return ((a % TURN) + TURN) % TURN


def hole_ring(cx: Column, cy: Column, radius: Column, rotation: Column, count: Column) -> Column:
    """count points on a circle, as array<struct<x, y>>; fails on no hole or radius."""
    steps = F.transform(
        F.sequence(F.lit(0), count - 1),
        lambda i: F.struct(
            (cx + radius * F.cos(rotation + i * F.lit(TURN) / count)).alias("x"),
            (cy + radius * F.sin(rotation + i * F.lit(TURN) / count)).alias("y"),
        ),
    )
    return F.when(count < 1, F.raise_error(F.lit("a ring needs a hole"))).when(radius <= 0, F.raise_error(F.lit("a ring needs a radius"))).otherwise(steps)


def ring_from_clicks(cx: Column, cy: Column, edge_x: Column, edge_y: Column, hole_x: Column, hole_y: Column, count: Column) -> Column:
    """Platform radius and ring from a centre, a rim point and one hole."""
    return F.struct(
        distance(cx, cy, edge_x, edge_y).alias("platform_radius"),
        distance(cx, cy, hole_x, hole_y).alias("ring_radius"),
        angle_from(cx, cy, hole_x, hole_y).alias("rotation"),
        count.alias("hole_count"),
    )


def nearest_hole(x: Column, y: Column, holes: Column) -> Column:
    """struct<d, i> of the nearest of an array of holes; the first of equals."""
    return F.array_min(F.transform(holes, lambda h, i: F.struct(distance(x, y, h["x"], h["y"]).alias("d"), i.cast("long").alias("i"))))


def nearest_hole_within(x: Column, y: Column, holes: Column, radius: Column) -> Column:
    """Index of the nearest hole no further than ``radius``; the last of equals."""
    ranked = F.transform(holes, lambda h, i: F.struct(distance(x, y, h["x"], h["y"]).alias("d"), (-i).cast("long").alias("i")))
    return -F.array_min(F.filter(ranked, lambda s: s["d"] <= radius))["i"]


def pixels_per_cm(platform_radius: Column, diameter_cm: Column) -> Column:
    """NULL where there is no diameter above zero."""
    return F.when(diameter_cm > 0, 2 * platform_radius / diameter_cm)


def px_to_cm(px: Column, per_cm: Column) -> Column:
    return F.try_divide(px, per_cm)


def is_inside_platform(x: Column, y: Column, cx: Column, cy: Column, radius: Column) -> Column:
    return distance(x, y, cx, cy) <= radius


def quadrant(x: Column, y: Column, cx: Column, cy: Column, target_x: Column, target_y: Column) -> Column:
    """target, cw, opposite or ccw: by the angle clockwise from the target."""
    d = normalize_angle(normalize_angle(angle_from(cx, cy, x, y)) - normalize_angle(angle_from(cx, cy, target_x, target_y)))
    eighth = math.pi / 4
    return (
        F.when(d.isNull(), None)
        .when((d < eighth) | (d >= 7 * eighth), "target")
        .when(d < 3 * eighth, "cw")
        .when(d < 5 * eighth, "opposite")
        .otherwise("ccw")
    )
