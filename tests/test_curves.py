"""Clipped outlines and joined animations, against plain versions."""

import math
import random

from pyspark.sql import functions as F

from tessella.functions import geometry
from tessella.operators import curves


def area(points):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1])) / 2


def test_rounded_boxes(spark):
    """Outlines have the area of the box less its corners; a clip of a clip is the clip of both."""
    rng = random.Random(4)
    rows = [(k, 100.0 + k, 60.0, [(float(rng.randint(0, 30)), float(rng.randint(0, 30))) for _ in range(4)]) for k in range(30)] + [(99, 40.0, 20.0, [(0.0, 0.0)] * 4)]
    df = spark.createDataFrame(rows, "id int, w double, h double, radii array<struct<rx:double,ry:double>>")
    outline = geometry.rounded_box(F.col("w"), F.col("h"), F.col("radii"))
    clip = geometry.clipped(F.col("pts"), F.lit(10.0), F.lit(5.0), F.lit(25.0), F.lit(30.0))
    none = geometry.clipped(F.col("pts"), F.lit(500.0), F.lit(5.0), F.lit(25.0), F.lit(30.0))
    for r, (_, w, h, radii) in zip(df.withColumn("pts", outline).withColumn("in", clip).withColumn("no", none).orderBy("id").collect(), rows, strict=True):
        want = w * h - sum((1 - math.pi / 4) * x * y for x, y in radii)
        assert abs(area([tuple(p) for p in r.pts]) - want) < 0.004 * want and r.no == []
        inside = [tuple(p) for p in r["in"]]
        assert all(10 - 1e-6 <= x <= 35 + 1e-6 and 5 - 1e-6 <= y <= 35 + 1e-6 for x, y in inside)
        # Points of a fine grid, counted.
        held = sum(within((10 + (i + 0.5) / 4, 5 + (j + 0.5) / 4), w, h, radii) for i in range(100) for j in range(120) if 10 + (i + 0.5) / 4 < w and 5 + (j + 0.5) / 4 < h) / 16
        assert abs(area(inside) - held) < 2.5


def within(p, w, h, radii):
    x, y = p
    for (rx, ry), left, top in zip(radii, (True, False, False, True), (True, True, False, False), strict=True):
        dx, dy = (rx - x if left else x - (w - rx)), (ry - y if top else y - (h - ry))
        if rx and ry and dx > 0 and dy > 0 and (dx / rx) ** 2 + (dy / ry) ** 2 > 1:
            return False
    return True


def curve(element, member, points):
    """points: (t, x, rotation, scale)."""
    return [(element, member, float(t), float(x), 0.0, float(r), float(s), 1.0, 1.0) for t, x, r, s in points]


def test_joined(spark):
    rows = curve("both", 1, [(0, 0, 0, 1), (100, 10, 0, 1)]) + curve("both", 2, [(50, 0, 0, 1), (90, 0, 80, 2), (150, 0, 80, 3)])
    rows += curve("jump", 1, [(0, 0, 0, 1), (100, 10, 0, 1)]) + curve("jump", 2, [(50, 7, 0, 1), (90, 0, 0, 1)])
    rows += curve("turn", 1, [(0, 0, 0, 1), (10, 0, 170, 1)]) + curve("slow", 1, [(0, 0, 0, 1), (4_000_000, 1, 0, 1)])
    rows += curve("many", 1, [(k, k * 0.01, 0, 1) for k in range(300)])
    df = spark.createDataFrame(rows, "element string, member int, t double, x double, y double, rotation double, scaleX double, scaleY double, opacity double")
    got = {(r.element, r.t): (r.x, r.rotation, r.scaleX) for r in curves.composed(df, ["element"]).where("element = 'both'").collect()}
    assert got == {("both", 0.0): (0, 0, 1), ("both", 50.0): (5, 0, 1), ("both", 90.0): (9, 80, 2), ("both", 100.0): (10, 80, 2 + 1 / 6), ("both", 150.0): (10, 80, 3)}
    why = {r.element: r.reason for r in curves.reasons(df, ["element"]).collect()}
    # A curve that waits in its first value does not jump; one sample only within 1e-7 of another counts once.
    assert why == {"both": None, "jump": None, "turn": "unsupported-transform", "slow": "unsupported-timing", "many": "too-many-keyframes"}
    cut = spark.createDataFrame(curve("cut", 1, [(0, 0, 0, 1), (50, 5, 0, 1), (50.00000005, 90, 0, 1), (100, 90, 0, 1)]) + curve("cut", 2, [(50, 0, 0, 1), (80, 0, 0, 1)]), df.schema)
    assert [r.reason for r in curves.reasons(cut, ["element"]).collect()] == ["discontinuous-composition"]
    assert curves.times(cut, ["element"]).count() == 4
