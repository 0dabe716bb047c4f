"""Native animation effects: the first reason why one cannot be written, or null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Channels of a frame and their values at rest.
CHANNELS = {"opacity": 1.0, "x": 0.0, "y": 0.0, "scaleX": 1.0, "scaleY": 1.0, "rotation": 0.0}
FRAME = "struct<offset:double,opacity:double,x:double,y:double,scaleX:double,scaleY:double,rotation:double,other:boolean>"


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def _near(a: Column, b) -> Column:
    return F.abs(a - b) < 1e-5


def _any(parts) -> Column:
    return reduce(lambda a, b: a | b, parts)


def _round(c: Column) -> Column:
    return F.floor(c + 0.5)


def _before(frames: Column, test) -> Column:
    """Whether test(frame, the one before it) holds anywhere."""
    return F.exists(F.sequence(F.lit(2), F.greatest(F.size(frames), F.lit(2))), lambda i: (i <= F.size(frames)) & test(F.get(frames, i - 1), F.get(frames, i - 2)))


def reason(id: Column, duration: Column, delay: Column, frames: Column, bounds: Column, origin: Column) -> Column:
    """frames: an array of FRAME, where null stands for a channel that a frame lacks and
    other for one with a further key; bounds: x, y, width, height; origin: x, y, or null."""
    at = lambda f, k: F.coalesce(f[k], F.lit(CHANNELS[k]))
    some = lambda test: F.exists(frames, test)
    first, last, n = F.get(frames, 0), F.get(frames, F.size(frames) - 1), F.size(frames)
    wait = F.coalesce(delay, F.lit(0.0))
    timing = ~_finite(duration) | (duration < 1) | (duration > 3_600_000) | ~_finite(wait) | (wait < 0) | (wait > 3_600_000)
    shape = frames.isNull() | (n < 2) | (n > 257) | some(lambda f: f.isNull()) | ~F.coalesce(_near(first["offset"], 0) & _near(last["offset"], 1), F.lit(False))
    # Frame by frame, as the first fault decides: a bad offset before a further key of the same frame.
    bad = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.struct(i.alias("i"), F.get(frames, i - 1).alias("f"), F.get(frames, F.greatest(i - 2, F.lit(0))).alias("b")))
    fault = lambda x: F.when(~_finite(x["f"]["offset"]) | (x["f"]["offset"] < 0) | (x["f"]["offset"] > 1) | ((x["i"] > 1) & (x["f"]["offset"] <= x["b"]["offset"])), "invalid_keyframes").when(x["f"]["other"], "unsupported_channel")
    faults = F.get(F.filter(F.transform(bad, fault), lambda r: r.isNotNull()), 0)
    holes = _any([_hole(frames, k) for k in CHANNELS])
    box = bounds.isNull() | _any(~_finite(bounds[k]) for k in ("x", "y", "width", "height")) | (bounds["width"] <= 0) | (bounds["height"] <= 0)
    pivot = origin.isNotNull() & _any(~_finite(origin[k]) | (F.abs(origin[k] - bounds[k] - bounds[s] / 2) > 1) for k, s in (("x", "width"), ("y", "height")))
    final = _any(~_near(at(last, k), base) for k, base in CHANNELS.items())
    o = lambda f: at(f, "opacity")
    fade = some(lambda f: ~_near(o(f), 1)) & (~_near(o(first), 0) | ~_near(o(last), 1) | some(lambda f: (o(f) < 0) | (o(f) > 1)) | _before(frames, lambda f, b: o(f) < o(b) - 1e-5))
    scale = some(lambda f: _any((at(f, k) < 0) | (at(f, k) > 1000) for k in ("scaleX", "scaleY")))
    far = some(lambda f: (F.abs(at(f, "rotation")) > 30_000) | (F.abs(at(f, "x")) > 1_000_000) | (F.abs(at(f, "y")) > 1_000_000))
    moved = {k: _moved(frames, k) for k in CHANNELS}
    d, t = _round(wait), _round(duration)
    ticks = F.transform(frames, lambda f: _round((d + f["offset"] * t) / (d + t) * 100_000))
    ticks = F.when(d > 0, F.concat(F.array(F.lit(0).cast("long")), ticks)).otherwise(ticks)
    tight = _any(moved[k] for k in ("x", "y", "scaleX", "scaleY")) & (F.size(F.array_distinct(ticks)) != F.size(ticks))
    return (
        F.when(id.isNull() | (id == ""), "invalid_effect").when(timing, "invalid_timing").when(shape, "invalid_keyframes").when(faults.isNotNull(), faults)
        .when(holes, "invalid_keyframes").when(box, "invalid_bounds").when(pivot, "unsupported_pivot").when(final, "non_final_base").when(fade, "unsupported_opacity")
        .when(scale, "unsupported_scale").when(far, "invalid_keyframes").when(~_any(moved.values()), "no_visible_change").when(tight, "timing_resolution")
    )


def _hole(frames: Column, k: str) -> Column:
    return F.exists(frames, lambda f: f[k].isNotNull()) & F.exists(frames, lambda f: ~_finite(f[k]))


def _moved(frames: Column, k: str) -> Column:
    return F.exists(frames, lambda f: F.abs(F.coalesce(f[k], F.lit(CHANNELS[k])) - CHANNELS[k]) > (0.001 if k in ("x", "y", "rotation") else 1e-5))


def trajectory(samples: Column) -> Column:
    """samples: an array of structs with the channels, all of them set."""
    first, last = F.get(samples, 0), F.get(samples, F.size(samples) - 1)
    some = lambda test: F.exists(samples, test)
    angle = F.pmod(last["rotation"], F.lit(360.0))
    skew = (F.least(angle, 360 - angle) > 0.001) & some(lambda f: F.abs(F.try_divide(f["scaleX"], last["scaleX"]) - F.try_divide(f["scaleY"], last["scaleY"])) > 0.0001)
    fade = some(lambda f: F.abs(f["opacity"] - 1) >= 0.0001) & ((first["opacity"] > 0.0001) | (F.abs(last["opacity"] - 1) >= 0.0001) | _before(samples, lambda f, b: f["opacity"] < b["opacity"] - 0.0001))
    still = ~_any([_differs(samples, last, k) for k in CHANNELS])
    return F.when(F.coalesce(skew, F.lit(False)), "unsupported-transform").when(last["opacity"] <= 0.0001, "exit-animation").when(fade, "unsupported-opacity").when(still, "no-visible-change")


def _differs(samples: Column, last: Column, k: str) -> Column:
    return F.exists(samples, lambda f: F.abs(f[k] - last[k]) > 0.0001)
