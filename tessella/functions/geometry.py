"""Geometry, units and colours (Column -> Column)."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EMU_POINT, EMU_PIXEL, DEGREE, CROP = 12700, 9525, 60000, 100000


def decimal3(x: Column) -> Column:
    """Three decimals, half up, without trailing zeros."""
    text = F.round(x, 3).cast("decimal(20,3)").cast("string")
    return F.regexp_replace(F.regexp_replace(text, r"0+\z", ""), r"\.\z", "")


def apply(m: list[Column], x: Column, y: Column) -> tuple[Column, Column]:
    """(a b c d e f) applied to a point."""
    a, b, c, d, e, f = m
    return a * x + c * y + e, b * x + d * y + f


def compose(m: list[Column], n: list[Column]) -> list[Column]:
    """First n, then m."""
    a, b, c, d, e, f = m
    g, h, i, j, k, l = n  # noqa: E741
    return [a * g + c * h, b * g + d * h, a * i + c * j, b * i + d * j, a * k + c * l + e, b * k + d * l + f]


def decompose(m: list[Column], eps: float = 1e-6) -> Column:
    """rotation (degrees), sx, sy and an error for shear or mirroring."""
    a, b, c, d = m[:4]
    sx, det = F.sqrt(a * a + b * b), a * d - b * c
    sy = F.when(sx > 0, det / sx)
    error = F.when(det <= 0, "MIRROR").when(F.abs(a * c + b * d) > eps * sx * F.abs(sy), "SHEAR")
    return F.struct(F.degrees(F.atan2(b, a)).alias("rotation"), sx.alias("sx"), sy.alias("sy"), error.alias("error"))


def readable_scale(base: Column, fit: Column, min_font: Column, min_text: Column) -> Column:
    """min(base, max(fit, readable)); half the base where there is no text."""
    readable = F.coalesce(min_text / F.greatest(F.lit(1.0), min_font), base / 2)
    return F.least(base, F.greatest(fit, readable))


def slide_scale(width: Column, height: Column, most_pixels: Column, base: float = 2.0) -> Column:
    want = width * height * base * base
    return F.when(want <= most_pixels, F.lit(base)).otherwise(base * F.sqrt(most_pixels / want))


def crop(left: Column, right: Column, size: Column, whole: int = CROP) -> Column:
    """Pixel bounds of a crop given in parts of ``whole`` (1/100000, or 1/65536 in old files):
    the first pixel that is left and the end; null if nothing is left or a share is negative."""
    a, b = left / whole, right / whole
    first, end = F.ceil(a * size).cast("int"), F.floor((1 - b) * size).cast("int")
    return F.when((a >= 0) & (b >= 0) & (a + b < 1) & (first < end), F.struct(first.alias("first"), end.alias("end")))


def render_size(width: Column, height: Column, output_width: Column, unit: Column, most_pixels: int) -> Column:
    """Pixels of a page and an error. A page is rendered at 96 dots for its 72 units, or to
    a given width; sides are rounded half up and are one pixel at least."""
    scale = F.when(output_width.isNull(), F.lit(96.0) / 72.0 * unit).otherwise(output_width / width)
    side = lambda v: F.greatest(F.lit(1).cast("long"), F.floor(v + 0.5))
    w, h = side(F.when(output_width.isNull(), width * scale).otherwise(output_width)), side(height * scale)
    fine = (width > 0) & (height > 0) & (unit > 0)
    error = F.when(~F.coalesce(fine, F.lit(False)), "INVALID_DOCUMENT").when(w * h > most_pixels, "PIXEL_LIMIT_EXCEEDED")
    return F.struct(F.when(error.isNull(), w).alias("width"), F.when(error.isNull(), h).alias("height"), error.alias("error"))


def aac_bitrate(channels: Column) -> Column:
    return F.when(channels.isNotNull(), F.least(F.lit(512_000), channels * 96_000))


def tint(channel: Column, amount: Column) -> Column:
    """A colour channel (0..255) drawn towards white by a tint (0..1) in linear light."""
    s = channel / 255.0
    linear = F.when(s <= 0.04045, s / 12.92).otherwise(F.pow((s + 0.055) / 1.055, F.lit(2.4)))
    mixed = linear * amount + (1 - amount)
    back = F.when(mixed <= 0.0031308, mixed * 12.92).otherwise(F.pow(mixed, F.lit(1 / 2.4)) * 1.055 - 0.055)
    return F.round(back * 255).cast("int")


def rounded_box(width: Column, height: Column, radii: Column, fine: float = 0.025) -> Column:
    """The outline of a box with elliptic corners, clockwise from the upper left: an array of (x, y). radii: an
    array of (rx, ry) for the upper left, upper right, lower right and lower left corner. A corner has as many chords
    as keep it within ``fine`` of its arc; one without a radius is its point twice."""
    right, bottom = width, height

    def corner(k: int, cx: Column, cy: Column) -> Column:
        rx, ry = radii[k]["rx"], radii[k]["ry"]
        most = F.greatest(rx, ry)
        count = F.greatest(F.lit(1), F.ceil(F.lit(math.pi / 2) / F.acos(F.greatest(F.lit(-1.0), 1 - fine / F.greatest(most, F.lit(fine)))))).cast("int")
        angle = lambda i: F.lit(math.pi + k * math.pi / 2) + i / count * (math.pi / 2)
        return F.transform(F.sequence(F.lit(0), count), lambda i: F.struct((cx + rx * F.cos(angle(i))).alias("x"), (cy + ry * F.sin(angle(i))).alias("y")))

    r = lambda k, side: radii[k][side]
    return F.concat(corner(0, r(0, "rx"), r(0, "ry")), corner(1, right - r(1, "rx"), r(1, "ry")), corner(2, right - r(2, "rx"), bottom - r(2, "ry")), corner(3, r(3, "rx"), bottom - r(3, "ry")))


def half_plane(points: Column, axis: str, bound: Column, sign: int, slack: float = 1e-8) -> Column:
    """The part of a closed polygon where axis lies at or beyond the bound (sign 1) or up to it (-1)."""
    return F.get(F.transform(F.array(points), lambda held: _half_plane(held, axis, bound, sign, slack)), 0)  # points are computed once


def _half_plane(points: Column, axis: str, bound: Column, sign: int, slack: float) -> Column:
    other = "y" if axis == "x" else "x"
    n = F.size(points)
    inside = lambda p: (p[axis] - bound) * sign >= -slack

    def edge(i: Column) -> Column:
        a, b = F.get(points, i), F.get(points, (i + 1) % n)
        t = (bound - a[axis]) / (b[axis] - a[axis])
        cut = {axis: a[axis] + t * (b[axis] - a[axis]), other: a[other] + t * (b[other] - a[other])}
        crossing = F.struct(cut["x"].alias("x"), cut["y"].alias("y"))
        return F.array(F.when(inside(a), a), F.when(inside(a) != inside(b), crossing))

    kept = F.filter(F.flatten(F.transform(F.sequence(F.lit(0), n - 1), edge)), lambda p: p.isNotNull())
    return F.when(n > 0, kept).otherwise(points)


def clipped(points: Column, x: Column, y: Column, width: Column, height: Column) -> Column:
    """A closed polygon within a rectangle; empty if nothing of it is."""
    out = half_plane(points, "x", x, 1)
    out = half_plane(out, "x", x + width, -1)
    out = half_plane(out, "y", y, 1)
    return half_plane(out, "y", y + height, -1)
