"""Boxes, distances and projections as Column expressions.

A box is a struct or a set of columns x1, y1, x2, y2; all functions take four Columns for each box, so they stay in generated code."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from trackweave.config import DEFAULT, Config

Box = tuple[Column, Column, Column, Column]
#: Doubles are reported as thousandths, cut at an offset that lies on no decimal midpoint, so engines agree.
MILLI_SHIFT = 0.50037


def box(prefix: str = "") -> Box:
    """Columns of a box by the prefix of their names."""
    return tuple(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2"))  # type: ignore[return-value]


def of_struct(s: Column) -> Box:
    return s["x1"], s["y1"], s["x2"], s["y2"]


def milli(v: Column) -> Column:
    return F.floor(v * 1000.0 + MILLI_SHIFT).cast("bigint")


def overlap_area(a: Box, b: Box) -> Column:
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(F.lit(0), w) * F.greatest(F.lit(0), h)


def area(a: Box) -> Column:
    return F.greatest(F.lit(1), (a[2] - a[0]) * (a[3] - a[1]))


def iou(a: Box, b: Box) -> Column:
    """Intersection over union of corner boxes; 0 without overlap, each area at least 1."""
    inter = overlap_area(a, b)
    return inter.cast("double") / (area(a) + area(b) - inter)


def iou_tlwh(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """The same for boxes of corner, width and height; the union, too, is at least 1."""
    ca, cb = ((x, y, x + w, y + h) for x, y, w, h in (a, b))
    inter = overlap_area(ca, cb)
    return inter.cast("double") / F.greatest(F.lit(1), F.greatest(F.lit(1), a[2] * a[3]) + F.greatest(F.lit(1), b[2] * b[3]) - inter)


def center(a: Box) -> tuple[Column, Column]:
    return (a[0] + a[2]) / 2.0, (a[1] + a[3]) / 2.0


def distance(p: tuple[Column, Column], q: tuple[Column, Column]) -> Column:
    dx, dy = p[0] - q[0], p[1] - q[1]
    return F.sqrt(dx * dx + dy * dy)


def box_distance(a: Box, b: Box) -> Column:
    return distance(center(a), center(b))


def tlwh_to_corners(x: Column, y: Column, w: Column, h: Column) -> Box:
    """Rounded half to even."""
    return tuple(F.bround(v).cast("long") for v in (x, y, x + w, y + h))  # type: ignore[return-value]


def corners_from_center(cx: Column, cy: Column, w: Column, h: Column) -> Box:
    """Truncated toward zero, as integers are made from floats."""
    return tuple(v.cast("long") for v in (cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2))  # type: ignore[return-value]


def expand(a: Box, ratio: float, width: int, height: int) -> Box:
    """A box grown on each side by a ratio of its sides (1 at least), inside the frame."""
    dx, dy = (F.greatest(F.lit(1), v) * ratio for v in (a[2] - a[0], a[3] - a[1]))
    low = [F.greatest(F.lit(0), F.bround(v).cast("long")) for v in (a[0] - dx, a[1] - dy)]
    high = [F.least(F.lit(m), F.bround(v).cast("long")) for v, m in ((a[2] + dx, width), (a[3] + dy, height))]
    return low[0], low[1], high[0], high[1]


def ocr_crop(a: Box, scale: float, width: int, height: int) -> Box:
    """A window around the centre of a number box, its sides scaled and halved as integers, inside the frame."""
    cx, cy = F.floor((a[0] + a[2]) / 2), F.floor((a[1] + a[3]) / 2)
    hw, hh = F.floor(((a[2] - a[0]) * scale).cast("long") / 2), F.floor(((a[3] - a[1]) * scale).cast("long") / 2)
    return F.greatest(F.lit(0), cx - hw), F.greatest(F.lit(0), cy - hh), F.least(F.lit(width), cx + hw), F.least(F.lit(height), cy + hh)


def jersey_crop(a: Box) -> tuple[Column, Column]:
    """First and last row of the number's part of a player box: from 20 to 65 percent of its height."""
    h = a[3] - a[1]
    return (a[1] + (h * 0.20).cast("long")), (a[1] + (h * 0.65).cast("long"))


def foot(a: Box, lift: int = DEFAULT.foot_lift) -> tuple[Column, Column]:
    """Where a player stands: below the centre, a few pixels above the box's end."""
    return (a[0] + a[2]) / 2.0, F.greatest(a[1], a[3] - lift)


def clamp(v: Column, size: int) -> Column:
    return F.least(F.greatest(F.bround(v).cast("long"), F.lit(0)), F.lit(size - 1))


def project(x: Column, y: Column, h: Sequence[Column | float]) -> tuple[Column, Column]:
    """A point through a 3 by 3 homography, given row by row."""
    g = [v if isinstance(v, Column) else F.lit(float(v)) for v in h]
    w = g[6] * x + g[7] * y + g[8]
    return (g[0] * x + g[1] * y + g[2]) / w, (g[3] * x + g[4] * y + g[5]) / w


def determinant(h: Sequence[Column]) -> Column:
    a, b, c, d, e, f, g, i, j = h
    return a * (e * j - f * i) - b * (d * j - f * g) + c * (d * i - e * g)


def valid_homography(n: Column, h: Sequence[Column], residual: Column, cfg: Config = DEFAULT) -> Column:
    """Four points at least, finite entries, a determinant away from 0, and a median residual within bounds."""
    finite = ~F.greatest(*(F.isnan(v) | F.isnull(v) | (F.abs(v) == float("inf")) for v in h))
    return (n >= 4) & finite & (F.abs(determinant(h)) >= 1e-8) & (residual <= cfg.max_reproj)


def inside_court(x: Column, y: Column, margin: float, cfg: Config = DEFAULT) -> Column:
    return x.between(-margin, cfg.court_w + margin) & y.between(-margin, cfg.court_h + margin)


def on_court(v: Column, size: int) -> Column:
    """A coordinate held within the court's pixels, without rounding."""
    return F.least(F.greatest(v, F.lit(0.0)), F.lit(float(size - 1)))


def choose_projection(relative: Column, direct: Column, cfg: Config = DEFAULT) -> Column:
    """Struct (x, y, source) from two nullable points (structs x, y): that of the homography (held within the court) where it lies inside
    the court or a margin around it; outside it, mostly the relative point; without one there, nothing. Without a homography, the
    relative point."""
    inside = inside_court(direct["x"], direct["y"], cfg.inside_margin, cfg)
    held = {"x": on_court(direct["x"], cfg.court_w), "y": on_court(direct["y"], cfg.court_h)}
    guard = lambda c, size: on_court(held[c] * (1.0 - cfg.relative_share) + relative[c] * cfg.relative_share, size)
    point = lambda x, y, s: F.struct(x.alias("x"), y.alias("y"), F.lit(s).alias("source"))
    return (
        F.when(direct.isNull() & relative.isNotNull(), point(relative["x"], relative["y"], "relative"))
        .when(direct.isNotNull() & inside, point(held["x"], held["y"], "H"))
        .when(direct.isNotNull() & relative.isNotNull(), point(guard("x", cfg.court_w), guard("y", cfg.court_h), "relative-guard"))
    )


def interpolate(y: Column, points: Column) -> Column:
    """x at y on the line through points (structs with y and x, in order of y): extrapolated at both ends; none gives 0, one gives its x.

    Where the end that counts has two points of one height, it is the outer one's x."""
    n = F.size(points)
    below = F.size(F.filter(points, lambda q: q["y"] < y))
    at = lambda k: F.get(points, (F.lit(k) if isinstance(k, int) else k) - 1)
    first, last = y <= at(1)["y"], y >= at(n)["y"]
    left = F.when(first, F.lit(1)).when(last, n - 1).otherwise(below)
    a, b = at(left), at(left + 1)
    share = F.when(a["y"] == b["y"], F.when(first, 0.0).otherwise(1.0)).otherwise((y - a["y"]) / (b["y"] - a["y"]))
    return F.when(n == 0, F.lit(0.0)).when(n == 1, at(1)["x"].cast("double")).otherwise(a["x"] + share * (b["x"] - a["x"]))


def sample_points(cfg: Config = DEFAULT) -> list[tuple[float, float]]:
    """The frame's corners, the middles of its edges, and its centre."""
    return [(x, y) for y in (0.0, cfg.frame_h * 0.5, cfg.frame_h - 1.0) for x in (0.0, cfg.frame_w * 0.5, cfg.frame_w - 1.0)]


def sample_shift(h: Sequence[Column], g: Sequence[Column], points: Sequence[tuple[float, float]]) -> tuple[Column, Column]:
    """Mean and greatest distance between two homographies' images of some points."""
    d = [distance(project(F.lit(x), F.lit(y), h), project(F.lit(x), F.lit(y), g)) for x, y in points]
    total = d[0]
    for v in d[1:]:
        total = total + v
    return total / len(d), F.greatest(*d)


def mirror_x(x: Column, cfg: Config = DEFAULT) -> Column:
    return F.lit(cfg.court_w) - x
