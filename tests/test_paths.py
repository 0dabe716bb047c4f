"""Path data against points of the curves themselves."""

import math
import random

from pyspark.sql import functions as F

from tessella.functions import paths


def bezier(p, s, t):
    u = 1 - t
    return tuple(u**3 * p[k] + 3 * u * u * t * a + 3 * u * t * t * b + t**3 * e for k, (a, b, e) in enumerate(((s.x1, s.x2, s.x), (s.y1, s.y2, s.y))))


def test_arcs_lie_on_their_ellipse(spark):
    rng = random.Random(6)
    rows = []
    for k in range(60):
        rx, ry, phi = rng.uniform(1, 9), rng.uniform(1, 9), rng.uniform(-200, 200)
        a, b = rng.uniform(0, 6), rng.uniform(0, 6)
        turn = math.radians(phi)
        at = lambda t: (math.cos(turn) * rx * math.cos(t) - math.sin(turn) * ry * math.sin(t) + 20, math.sin(turn) * rx * math.cos(t) + math.cos(turn) * ry * math.sin(t) + 30)  # noqa: E731, B023
        (x0, y0), (x1, y1) = at(a), at(b)
        sweep = (b - a) % (2 * math.pi)
        rows.append((k, f"M{x0!r} {y0!r}A{rx!r},{ry!r} {phi!r} {int(sweep > math.pi)}1{x1!r} {y1!r}", rx, ry, turn, sweep))
    df = spark.createDataFrame([r[:2] for r in rows], "id int, d string")
    for r in df.withColumn("s", paths.segments(F.col("d"))).collect():
        _, _, rx, ry, turn, sweep = rows[r.id]
        p, length = (r.s[0].x, r.s[0].y), 0.0
        for s in r.s[1:]:
            last = p
            for i in range(1, 9):
                x, y = bezier(p, s, i / 8)
                u, v = x - 20, y - 30
                e, f = (math.cos(turn) * u + math.sin(turn) * v) / rx, (math.cos(turn) * v - math.sin(turn) * u) / ry
                assert abs(math.hypot(e, f) - 1) < 6e-4
                lu, lv = last[0] - 20, last[1] - 30
                le, lf = (math.cos(turn) * lu + math.sin(turn) * lv) / rx, (math.cos(turn) * lv - math.sin(turn) * lu) / ry
                length += math.remainder(math.atan2(f, e) - math.atan2(lf, le), 2 * math.pi)
                last = (x, y)
            p = (s.x, s.y)
        assert abs(length - sweep) < 1e-6 and len(r.s) <= 5


def test_odd_paths(spark):
    cases = {
        "M0 0A0 5 0 0 1 3 4": [("M", 0, 0), ("L", 3, 4)], "M1 1A5 5 0 0 1 1 1L2 2": [("M", 1, 1), ("L", 2, 2)], "M-1-2.5.5e1-3": [("M", -1, -2.5), ("L", 5, -3)], "M0 0z": [("M", 0, 0), ("Z", None, None)],
        "L1 1": None, "M1": None, "M1 1 2": None, "M1 x": None, "": None, None: None, "M0 0z1": None, "M0 0C1 1": None,
    }
    df = spark.createDataFrame([(k,) for k in cases], "d string").withColumn("s", paths.segments(F.col("d")))
    assert {r.d: None if r.s is None else [(s.op, s.x, s.y) for s in r.s] for r in df.collect()} == cases
    small = spark.createDataFrame([("M0 0A1 1 0 0 1 10 0",)], "d string").select(F.explode(paths.segments(F.col("d"))).alias("s")).collect()
    assert [round(r.s.y, 9) for r in small[1:]] == [-5.0, 0.0]  # a radius too small grows
