"""Plane transformations of points, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def similarity(x, y, dx, dy, angle, scale, cx, cy) -> tuple[Column, Column]:
    """Rotation by degrees and scaling about a centre, then a shift."""
    x, y, dx, dy, angle, scale, cx, cy = map(_c, (x, y, dx, dy, angle, scale, cx, cy))
    cos, sin = F.cos(F.radians(angle)), F.sin(F.radians(angle))
    u, v = x - cx, y - cy
    return scale * (cos * u - sin * v) + cx + dx, scale * (sin * u + cos * v) + cy + dy


def corner_displacement(a: tuple, b: tuple, width: float, height: float, cy: float | None = None) -> Column:
    """How far the most moved image corner lies apart under two similarities (dx, dy, angle, scale)."""
    cx, cy = width / 2, height / 2 if cy is None else cy
    apart = []
    for x, y in ((0, 0), (width, 0), (0, height), (width, height)):
        (ax, ay), (bx, by) = similarity(x, y, *a, cx, cy), similarity(x, y, *b, cx, cy)
        apart.append(F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by)))
    return F.greatest(*apart)


def distort(x: Column, y: Column, k: tuple, width: float, height: float) -> tuple[Column, Column]:
    """The rational lens model with parameters k1, k2, k3, p1, p2, k4, k5, k6, about the image centre."""
    k1, k2, k3, p1, p2, k4, k5, k6 = (F.lit(float(v)) for v in k)
    f = F.lit(float(max(width, height)))
    cx, cy = F.lit(width / 2.0), F.lit(height / 2.0)
    u, v = (x - cx) / f, (y - cy) / f
    r2 = u * u + v * v
    radial = (F.lit(1.0) + k1 * r2 + k2 * r2 * r2 + k3 * r2 * r2 * r2) / (F.lit(1.0) + k4 * r2 + k5 * r2 * r2 + k6 * r2 * r2 * r2)
    du = u * radial + F.lit(2.0) * p1 * u * v + p2 * (r2 + F.lit(2.0) * u * u)
    dv = v * radial + p1 * (r2 + F.lit(2.0) * v * v) + F.lit(2.0) * p2 * u * v
    return du * f + cx, dv * f + cy


def project(x: Column, y: Column, h: list[float]) -> tuple[Column, Column]:
    """A homography given by nine numbers, row by row; a vanishing denominator counts as 1e-10."""
    a = [F.lit(float(v)) for v in h]
    w = a[6] * x + a[7] * y + a[8]
    w = F.when(w == 0, F.lit(1e-10)).otherwise(w)
    return (a[0] * x + a[1] * y + a[2]) / w, (a[3] * x + a[4] * y + a[5]) / w


def tile_origins(length: Column, crop: int, stride: int) -> Column:
    """Origins of tiles along an axis; the last tile is flush with the edge."""
    last = F.greatest(length - F.lit(crop), F.lit(0))
    return F.array_sort(F.array_union(F.sequence(F.lit(0), last, F.lit(stride)), F.array(last)))
