"""Plane geometry as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def dist_point_seg(px, py, x1, y1, x2, y2) -> Column:
    """Distance of a point from a segment; a segment without length is a point."""
    px, py, x1, y1, x2, y2 = map(_c, (px, py, x1, y1, x2, y2))
    dx, dy = x2 - x1, y2 - y1
    square = dx * dx + dy * dy
    t = F.when(square > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - x1) * dx + (py - y1) * dy) / square))).otherwise(0.0)
    ex, ey = x1 + t * dx - px, y1 + t * dy - py
    return F.sqrt(ex * ex + ey * ey)


def axis_gap(a0, a1, b0, b1) -> Column:
    """How far two intervals lie apart; 0 where they meet."""
    return F.greatest(_c(b0) - _c(a1), _c(a0) - _c(b1), F.lit(0.0))


def box_gap(a: tuple, b: tuple) -> Column:
    """Distance of two boxes given as (x0, y0, x1, y1)."""
    gx, gy = axis_gap(a[0], a[2], b[0], b[2]), axis_gap(a[1], a[3], b[1], b[3])
    return F.sqrt(gx * gx + gy * gy)


def dist_box_seg(b: tuple, x1, y1, x2, y2) -> Column:
    """Distance of a box from a segment; exact for level and upright ones, the least of nine samples for slanted ones."""
    x1, y1, x2, y2 = map(_c, (x1, y1, x2, y2))
    straight = box_gap(b, (F.least(x1, x2), F.least(y1, y2), F.greatest(x1, x2), F.greatest(y1, y2)))

    def sample(k: int) -> Column:
        x, y = x1 + (x2 - x1) * (k / 8), y1 + (y2 - y1) * (k / 8)
        return box_gap(b, (x, y, x, y))

    slanted = (F.abs(x1 - x2) > 0.05) & (F.abs(y1 - y2) > 0.05)
    return F.when(slanted, F.least(*[sample(k) for k in range(9)])).otherwise(straight)


def affine_apply(m: Column, x, y) -> tuple[Column, Column]:
    """A point under a matrix [a, b, c, d, e, f]."""
    x, y = _c(x), _c(y)
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def affine_compose(m: Column, n: Column) -> Column:
    """The matrix that applies n first, then m."""
    return F.array(m[0] * n[0] + m[2] * n[1], m[1] * n[0] + m[3] * n[1], m[0] * n[2] + m[2] * n[3], m[1] * n[2] + m[3] * n[3], m[0] * n[4] + m[2] * n[5] + m[4], m[1] * n[4] + m[3] * n[5] + m[5])


def color_distance(a: Column, b: Column) -> Column:
    """Sum of the channel differences of two colours written #rrggbb."""
    channel = lambda c, at: F.conv(F.substring(c, at, 2), 16, 10).cast("int")
    return sum((F.abs(channel(a, at) - channel(b, at)) for at in (2, 4, 6)), F.lit(0))


def is_neutral(c: Column) -> Column:
    """Whether a colour is close to grey."""
    channels = [F.conv(F.substring(c, at, 2), 16, 10).cast("int") for at in (2, 4, 6)]
    return F.greatest(*channels) - F.least(*channels) < 24
