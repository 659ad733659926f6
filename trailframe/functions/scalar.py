"""Column expressions (P1-P17, S2).  All are built-in Spark expressions, so
they stay inside whole-stage code generation; none is a Python UDF."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def frame_name(i: Column | str) -> Column:
    """Zero-pad to 7 digits; a longer number keeps its last 7 digits."""
    return F.lpad(F.substring(_c(i).cast("string"), -7, 7), 7, "0")


def unpack_rgb(rgb: Column | str) -> tuple[Column, Column, Column]:
    """Red, green, blue of a packed colour, scaled as in the reference:
    red = (c & 0xff0000) / 65536.0, green = (c & 0xff00) / 256.0, blue = c & 0xff."""
    c = _c(rgb)
    r = c.bitwiseAND(0xFF0000).cast("double") / F.lit(65536.0)
    g = c.bitwiseAND(0xFF00).cast("double") / F.lit(256.0)
    b = c.bitwiseAND(0xFF).cast("double")
    return r, g, b


def inverted_gray(r: Column, g: Column, b: Column) -> Column:
    """255 - (r + g + b) / 3.0 in double."""
    return F.lit(255.0) - (r + g + b) / F.lit(3.0)


def rounded(x: Column | str, digits: int = 4) -> Column:
    """``F.round`` of a double.  Spark rounds through a decimal number; only
    values close to the middle of two results, very large ones, infinities
    and NaN need that, the rest is rounded as a whole number of units, which
    divides to the same double."""
    c = _c(x).cast("double")
    t = c * F.lit(10.0 ** digits)
    clear = (F.abs(t) < F.lit(2.0 ** 40)) & (F.abs(t - F.floor(t) - F.lit(0.5)) > F.lit(1e-3))
    return F.when(clear, F.floor(t + F.lit(0.5)) / F.lit(10.0 ** digits)).otherwise(F.round(c, digits))


def truncate_to_cell(x: Column | str) -> Column:
    """Double to int toward zero."""
    return _c(x).cast("int")


def bin_index(x: Column | str, size: int = 15) -> Column:
    """``x.toInt / size``, integer division toward zero (Spark ``div``)."""
    return _int_div(truncate_to_cell(x), int(size))


def _int_div(a: Column, n: int) -> Column:
    # a / n in double, then truncation: exact for |a| < 2**53
    return (a / F.lit(n)).cast("int")


def euclidean(x1, y1, x2, y2) -> Column:
    """sqrt(dx^2 + dy^2)."""
    dx = _c(x1) - _c(x2)
    dy = _c(y1) - _c(y2)
    return F.sqrt(dx * dx + dy * dy)


def squared_distance(x1, y1, x2, y2) -> Column:
    dx = _c(x1) - _c(x2)
    dy = _c(y1) - _c(y2)
    return dx * dx + dy * dy


def slow_only(vx, vy, limit: float = 0.3, absolute: bool = False) -> Column:
    """P10: keep small moves.  As coded the test is signed (``vx < limit``),
    so a large negative move passes; ``absolute=True`` compares |v|."""
    a, b = _c(vx), _c(vy)
    if absolute:
        a, b = F.abs(a), F.abs(b)
    return (a < F.lit(limit)) & (b < F.lit(limit))


def unit_vector(vx, vy) -> tuple[Column, Column]:
    """Divide by length; a zero-length vector gives NULL (the
    reference's 0/0 NaN; plain division under ANSI would throw)."""
    a, b = _c(vx), _c(vy)
    n = F.sqrt(a * a + b * b)
    return F.try_divide(a, n), F.try_divide(b, n)


def glyph_segment(bx, by, ux, uy, size: int = 15) -> tuple[Column, Column, Column, Column]:
    """End points ``centre +- (v/2)*size`` with integer centre
    ``i*size + size/2``."""
    cx = _c(bx) * F.lit(size) + F.lit(size // 2)
    cy = _c(by) * F.lit(size) + F.lit(size // 2)
    hx = (_c(ux) / F.lit(2.0)) * F.lit(float(size))
    hy = (_c(uy) / F.lit(2.0)) * F.lit(float(size))
    return cx + hx, cy + hy, cx - hx, cy - hy


# Colour stops of the reference's gradients (ARGB).
BLUE_ARGB = 0xFF0000FF
GREEN_ARGB = 0xFF00FF00
RED_ARGB = 0xFFFF0000


def color_ramp(value, stops: Sequence[tuple[Column | float, int]]) -> Column:
    """Packed RGB for ``value`` on a piecewise-linear gradient.

    Below the first stop the first colour, above the last the last colour;
    between stops each channel is interpolated linearly and truncated.  Stop
    positions may be columns (e.g. taken from the heat-map extent).
    """
    v = _c(value).cast("double")
    pos = [(_c(p) if isinstance(p, Column) else F.lit(float(p))).cast("double") for p, _ in stops]
    cols = [c & 0xFFFFFF for _, c in stops]

    def chan(c: int, shift: int) -> Column:
        return F.lit((c >> shift) & 0xFF)

    def lerp(i: int) -> Column:
        t = F.try_divide(v - pos[i], pos[i + 1] - pos[i])
        t = F.coalesce(t, F.lit(1.0))
        out = F.lit(0)
        for shift in (16, 8, 0):
            a, b = chan(cols[i], shift), chan(cols[i + 1], shift)
            ch = (a + (b - a) * t).cast("int")
            out = out.bitwiseOR(F.shiftleft(ch, shift))
        return out

    expr = F.when(v <= pos[0], F.lit(cols[0]))
    for i in range(len(stops) - 1):
        expr = expr.when(v < pos[i + 1], lerp(i))
    return expr.otherwise(F.lit(cols[-1]))


def rgb_channels(packed) -> tuple[Column, Column, Column]:
    """Split a packed colour with ``>>16 & 0xff``, ``>>8 & 0xff``, ``& 0xff``."""
    p = _c(packed)
    return (F.shiftright(p, 16).bitwiseAND(0xFF), F.shiftright(p, 8).bitwiseAND(0xFF), p.bitwiseAND(0xFF))


def advance(c, v, speed: float = 3500.0, dt: float = 1.0 / 60.0) -> Column:
    """``c + v * speed * dt``."""
    return _c(c) + _c(v) * F.lit(float(speed)) * F.lit(float(dt))
