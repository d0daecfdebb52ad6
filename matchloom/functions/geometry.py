"""Geometry as column expressions: boxes, homographies, vectors, the pitch."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PITCH_LENGTH, PITCH_WIDTH = 105.0, 68.0
PX_PER_METER = 10.0
FLAT = 1e-8
H = [f"h{i}" for i in range(9)]


def _box(prefix: str) -> list[Column]:
    return [F.col(prefix + c) for c in ("x1", "y1", "x2", "y2")]


def area(x1, y1, x2, y2) -> Column:
    return F.greatest(x2 - x1, F.lit(0.0)) * F.greatest(y2 - y1, F.lit(0.0))


def iou(a, b) -> Column:
    """Intersection over union of two boxes (x1, y1, x2, y2); 0 where the union has no area."""
    both = area(F.greatest(a[0], b[0]), F.greatest(a[1], b[1]), F.least(a[2], b[2]), F.least(a[3], b[3]))
    union = area(*a) + area(*b) - both
    return F.when(union > 0, both / union).otherwise(0.0)


def centre(prefix: str = "") -> tuple[Column, Column]:
    x1, y1, x2, y2 = _box(prefix)
    return (x1 + x2) / 2, (y1 + y2) / 2


def foot(prefix: str = "") -> tuple[Column, Column]:
    x1, _, x2, y2 = _box(prefix)
    return (x1 + x2) / 2, y2


def project(x: Column, y: Column, scale: float = PX_PER_METER) -> tuple[Column, Column]:
    """Image to pitch coordinates by the matrix in h0..h8; null without a matrix or near its horizon."""
    h = [F.col(c) for c in H]
    u, v, w = h[0] * x + h[1] * y + h[2], h[3] * x + h[4] * y + h[5], h[6] * x + h[7] * y + h[8]
    ok = F.abs(w) >= FLAT
    return F.when(ok, u / w / scale), F.when(ok, v / w / scale)


def point_to_box(cx: Column, cy: Column, prefix: str = "") -> Column:
    """Distance of a point from a box, 0 inside."""
    x1, y1, x2, y2 = _box(prefix)
    dx = F.greatest(x1 - cx, F.lit(0.0), cx - x2)
    dy = F.greatest(y1 - cy, F.lit(0.0), cy - y2)
    return F.sqrt(dx * dx + dy * dy)


def distance(ax, ay, bx, by) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column) -> Column:
    """The vector over its length; a zero vector stays."""
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(x))


def torso(img_w, img_h, prefix: str = "", min_area: float = 900, top: float = 0.15, bottom: float = 0.5, side: float = 0.2) -> Column:
    """Crop rectangle of the upper body, rounded half to even and clamped; null if the box is small or
    nothing is left."""
    x1, y1, x2, y2 = _box(prefix)
    w, h = x2 - x1, y2 - y1
    lo, hi = lambda c: F.greatest(F.bround(c).cast("int"), F.lit(0)), lambda c, m: F.least(F.bround(c).cast("int"), m)
    cx1, cy1 = lo(x1 + side * w), lo(y1 + top * h)
    cx2, cy2 = hi(x2 - side * w, img_w), hi(y1 + bottom * h, img_h)
    ok = (w > 0) & (h > 0) & (w * h >= min_area) & (cx2 > cx1) & (cy2 > cy1)
    return F.when(ok, F.struct(cx1.alias("cx1"), cy1.alias("cy1"), cx2.alias("cx2"), cy2.alias("cy2")))


CLASS_IDS = {"player": 0, "goalkeeper": 1, "referee": 2}


def class_id(name: Column) -> Column:
    out = F.lit(None).cast("int")
    for k, v in CLASS_IDS.items():
        out = F.when(name == k, v).otherwise(out)
    return out


def resolution_tag(labels: Column) -> Column:
    """unresolved, bootstrap or anchor, in this order, if any label ends so."""
    ends = lambda t: F.exists(labels, lambda x: x.endswith(f"_{t}"))
    return F.when(ends("unresolved"), "unresolved").when(ends("bootstrap"), "bootstrap").when(ends("anchor"), "anchor")
