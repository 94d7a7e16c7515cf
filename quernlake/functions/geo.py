"""Distances on the globe and in space, planar polygons, and a distance join over a grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the earth's radius in metres that earth distances use.
EARTH_RADIUS = 6378168.0


def cube_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two points given as arrays."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def earth_point(lat: Column, lon: Column) -> Column:
    """A point on the sphere as three coordinates."""
    p, q = F.radians(lat), F.radians(lon)
    return F.array(EARTH_RADIUS * F.cos(p) * F.cos(q), EARTH_RADIUS * F.cos(p) * F.sin(q), EARTH_RADIUS * F.sin(p))


def earth_distance(a: Column, b: Column) -> Column:
    """Metres along the great circle between two earth points, from the chord between them."""
    half = F.least(cube_distance(a, b) / (2 * EARTH_RADIUS), F.lit(1.0))
    return 2 * EARTH_RADIUS * F.asin(half)


def polygon_area(xs: Column, ys: Column) -> Column:
    """Area of a closed ring (first point repeated at the end), by the shoelace formula."""
    n = F.size(xs) - 1
    cross = F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(xs, i) * F.element_at(ys, i + 1) - F.element_at(xs, i + 1) * F.element_at(ys, i))
    return F.abs(F.aggregate(cross, F.lit(0.0), lambda s, v: s + v)) / 2


def line_length(xs: Column, ys: Column) -> Column:
    """Length of a line through points, the perimeter of a closed ring."""
    steps = F.transform(F.sequence(F.lit(1), F.size(xs) - 1), lambda i: F.hypot(F.element_at(xs, i + 1) - F.element_at(xs, i), F.element_at(ys, i + 1) - F.element_at(ys, i)))
    return F.aggregate(steps, F.lit(0.0), lambda s, v: s + v)


def polygon_centroid(xs: Column, ys: Column) -> Column:
    """The centre of mass of a closed ring's area, as a struct of x and y; null if it has none."""
    cross = lambda i: F.element_at(xs, i) * F.element_at(ys, i + 1) - F.element_at(xs, i + 1) * F.element_at(ys, i)
    places = F.sequence(F.lit(1), F.size(xs) - 1)
    total = lambda each: F.aggregate(F.transform(places, each), F.lit(0.0), lambda s, v: s + v)
    twice = total(cross)
    mean = lambda c: total(lambda i: (F.element_at(c, i) + F.element_at(c, i + 1)) * cross(i)) / (3 * F.when(twice != 0, twice))
    return F.struct(mean(xs).alias("x"), mean(ys).alias("y"))


def bounds(xs: Column, ys: Column) -> Column:
    """The smallest box around points."""
    return F.struct(F.array_min(xs).alias("x_min"), F.array_min(ys).alias("y_min"), F.array_max(xs).alias("x_max"), F.array_max(ys).alias("y_max"))


def bounds_overlap(a: Column, b: Column) -> Column:
    """Whether two boxes share a point: the test that goes before an exact one."""
    return (a["x_min"] <= b["x_max"]) & (b["x_min"] <= a["x_max"]) & (a["y_min"] <= b["y_max"]) & (b["y_min"] <= a["y_max"])


def within_polygon(x: Column, y: Column, xs: Column, ys: Column) -> Column:
    """Whether a point lies inside a closed ring: an odd number of edges lies to its right."""
    n = F.size(xs) - 1

    def crosses(i: Column) -> Column:
        x1, y1, x2, y2 = F.element_at(xs, i), F.element_at(ys, i), F.element_at(xs, i + 1), F.element_at(ys, i + 1)
        return (((y1 > y) != (y2 > y)) & (x < (x2 - x1) * (y - y1) / F.when(y2 == y1, F.lit(1.0)).otherwise(y2 - y1) + x1)).cast("int")

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), crosses), F.lit(0), lambda s, v: s + v) % 2 == 1


def point_wkt(x: Column, y: Column) -> Column:
    return F.concat(F.lit("POINT("), x.cast("string"), F.lit(" "), y.cast("string"), F.lit(")"))


def distance_join(left: DataFrame, right: DataFrame, radius: float, xy_left: tuple[str, str], xy_right: tuple[str, str]) -> DataFrame:
    """Pairs of rows at most `radius` apart in the plane. Rows meet on grid cells of that width: an equi-join, then the exact test."""
    (ax, ay), (bx, by) = xy_left, xy_right
    cell = lambda c: F.floor(F.col(c) / radius)
    around = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    a = left.withColumn("_gx", cell(ax)).withColumn("_gy", cell(ay))
    b = right.withColumn("_dx", F.explode(around)).withColumn("_dy", F.explode(around)).withColumn("_gx", cell(bx) + F.col("_dx")).withColumn("_gy", cell(by) + F.col("_dy"))
    near = (F.col(ax) - F.col(bx)) ** 2 + (F.col(ay) - F.col(by)) ** 2 <= radius**2
    return a.join(b, ["_gx", "_gy"]).where(near).drop("_gx", "_gy", "_dx", "_dy")
