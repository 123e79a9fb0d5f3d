"""Polyline expressions. A polyline is ``array<struct<x: double, y: double>>``; all functions map columns to columns.

They stay in the row: no shuffle and no Python. Null stands for an unusable polyline. Tolerances are fixed values of the
data model: points closer than 1e-12 to the last kept one are repeats, segments or curves up to 1e-12 long are none.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REPEAT_SQUARED = 1e-24
SHORTEST = 1e-12
POINT = "struct<x: double, y: double>"
POLYLINE = f"array<{POINT}>"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def _squared(a: Column, b: Column) -> Column:
    return (a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"])


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def clean(line: Column) -> Column:
    """Without points that repeat the last kept one; null unless two points, all finite, and some length remain.

    A comparison with the neighbour would differ: many small steps may add up to a new point.
    """
    first = F.slice(line, 1, 1)
    kept = F.aggregate(line, first, lambda acc, p: F.when(_squared(F.element_at(acc, -1), p) > REPEAT_SQUARED, F.concat(acc, F.array(p))).otherwise(acc))
    good = (F.size(line) >= 2) & F.forall(line, lambda p: finite(p["x"]) & finite(p["y"]))
    return F.when(good, let(kept, lambda k: F.when((F.size(k) >= 2) & (length(k) > SHORTEST), k)))


def steps(line: Column) -> Column:
    """Segments (sx, sy, vx, vy, len) in order, also those without length."""
    n = F.size(line)
    return F.zip_with(
        F.slice(line, F.lit(1), F.greatest(n - 1, F.lit(0))),
        F.slice(line, F.lit(2), F.greatest(n - 1, F.lit(0))),
        lambda a, b: F.struct(a["x"].alias("sx"), a["y"].alias("sy"), (b["x"] - a["x"]).alias("vx"), (b["y"] - a["y"]).alias("vy"), F.sqrt(_squared(a, b)).alias("len")),
    )


def length(line: Column) -> Column:
    return F.aggregate(steps(line), F.lit(0.0), lambda acc, s: acc + s["len"])


_MEASURED = "array<struct<sx: double, sy: double, vx: double, vy: double, len: double, start: double>>"


def measured(line: Column) -> Column:
    """Segments longer than 1e-12 with the arc length at which each begins."""
    zero = F.struct(F.lit(0.0).alias("at"), F.expr(f"cast(array() as {_MEASURED})").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        one = F.array(F.struct(s["sx"].alias("sx"), s["sy"].alias("sy"), s["vx"].alias("vx"), s["vy"].alias("vy"), s["len"].alias("len"), acc["at"].alias("start")))
        return F.struct((acc["at"] + s["len"]).alias("at"), F.concat(acc["out"], one).alias("out"))

    return F.aggregate(F.filter(steps(line), lambda s: s["len"] > SHORTEST), zero, step, lambda acc: acc["out"])


def total(segments: Column) -> Column:
    last = F.element_at(segments, -1)
    return last["start"] + last["len"]


def along(segments: Column, distance: Column) -> Column:
    """The point at an arc length; at a bend the later segment is used."""
    found = F.coalesce(F.try_element_at(F.filter(segments, lambda s: s["start"] <= distance), F.lit(-1)), F.element_at(segments, 1))

    def at(s: Column) -> Column:
        share = (distance - s["start"]) / s["len"]
        return point(s["sx"] + share * s["vx"], s["sy"] + share * s["vy"])

    return let(found, at)


def _at_fraction(line: Column, segs: Column, fraction: Column) -> Column:
    d = fraction * total(segs)
    return F.when(d <= 0, F.element_at(line, 1)).when(d >= total(segs), F.element_at(line, -1)).otherwise(along(segs, d))


def point_at_fraction(line: Column, fraction: Column) -> Column:
    """The point at a share of the arc length; an error unless the share is from 0 to 1."""
    valid = finite(fraction) & (fraction >= 0) & (fraction <= 1)
    return F.when(valid, let(measured(line), lambda segs: _at_fraction(line, segs, fraction))).otherwise(F.raise_error(F.lit("a fraction must be from 0 to 1")).cast(POINT))


def subpolyline(line: Column, start: Column, stop: Column) -> Column:
    """The part between two shares of the arc length, with the bends strictly between them."""

    def part(segs: Column) -> Column:
        a, b = start * total(segs), stop * total(segs)
        middle = F.transform(F.filter(segs, lambda s: (s["start"] > a) & (s["start"] < b)), lambda s: point(s["sx"], s["sy"]))
        return F.concat(F.array(_at_fraction(line, segs, start)), middle, F.array(_at_fraction(line, segs, stop)))

    valid = (start >= 0) & (start < stop) & (stop <= 1)
    return F.when(valid, let(measured(line), part)).otherwise(F.raise_error(F.lit("a part needs 0 <= start < stop <= 1")).cast(POLYLINE))


def resample(line: Column, samples: int) -> Column:
    """``samples`` (2 at least) points at equal steps of arc length; both ends are exact."""
    n = max(2, samples)

    def every(segs: Column) -> Column:
        def at(i: Column) -> Column:
            return F.when(i == 0, F.element_at(line, 1)).when(i == n - 1, F.element_at(line, -1)).otherwise(along(segs, i * total(segs) / F.lit(float(n - 1))))

        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at)

    return let(measured(line), every)


def reverse(line: Column) -> Column:
    return F.reverse(line)


def orient(line: Column, first: Column, last: Column) -> Column:
    """Reversed if its ends lie nearer to the other points; ties stay."""
    head, tail = F.element_at(line, 1), F.element_at(line, -1)
    kept = F.sqrt(_squared(head, first)) + F.sqrt(_squared(tail, last))
    turned = F.sqrt(_squared(tail, first)) + F.sqrt(_squared(head, last))
    return F.when(turned < kept, F.reverse(line)).otherwise(line)


def concat(a: Column, b: Column) -> Column:
    """One after the other, without the repeated seam."""
    seam = _squared(F.element_at(a, -1), F.element_at(b, 1)) <= REPEAT_SQUARED
    return F.concat(a, F.when(seam, F.slice(b, F.lit(2), F.greatest(F.size(b) - 1, F.lit(0)))).otherwise(b))


def squared_distance(px: Column, py: Column, sx: Column, sy: Column, vx: Column, vy: Column, len2: Column) -> Column:
    """Of a point from a segment: to the projection, kept between the ends."""
    t = F.least(F.greatest(((px - sx) * vx + (py - sy) * vy) / len2, F.lit(0.0)), F.lit(1.0))
    dx, dy = px - (sx + t * vx), py - (sy + t * vy)
    return dx * dx + dy * dy


def closest(px: Column, py: Column, line: Column) -> Column:
    """(d2, along, ix, tx, ty) of the nearest segment: smallest squared distance, then smallest arc length."""
    segs = measured(line)

    def one(s: Column, i: Column) -> Column:
        # not the square of the rounded length: equal distances must stay equal
        len2 = s["vx"] * s["vx"] + s["vy"] * s["vy"]
        t = F.least(F.greatest(((px - s["sx"]) * s["vx"] + (py - s["sy"]) * s["vy"]) / len2, F.lit(0.0)), F.lit(1.0))
        dx, dy = px - (s["sx"] + t * s["vx"]), py - (s["sy"] + t * s["vy"])
        return F.struct((dx * dx + dy * dy).alias("d2"), (s["start"] + t * s["len"]).alias("along"), i.alias("ix"), (s["vx"] / s["len"]).alias("tx"), (s["vy"] / s["len"]).alias("ty"))

    return F.array_min(F.transform(segs, one))


def point_to_polyline(px: Column, py: Column, line: Column) -> Column:
    return F.sqrt(closest(px, py, line)["d2"])


def box_lower_bound(px: Column, py: Column, minx: Column, miny: Column, maxx: Column, maxy: Column) -> Column:
    """No point of the box is nearer than this."""
    dx = F.greatest(minx - px, F.lit(0.0), px - maxx)
    dy = F.greatest(miny - py, F.lit(0.0), py - maxy)
    return F.hypot(dx, dy)
