"""Path data of vector pictures: absolute lines and cubic curves (Columns only)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Arguments of each command (fixed values).
ARGUMENTS = {"M": 2, "L": 2, "H": 1, "V": 1, "C": 6, "S": 4, "Q": 4, "T": 2, "A": 7, "Z": 0}
SEGMENT = "struct<op:string,x1:double,y1:double,x2:double,y2:double,x:double,y:double>"
_STATE = "struct<x:double,y:double,sx:double,sy:double,cx:double,cy:double,last:string,out:array<%s>>" % SEGMENT
_TOKEN = r"[MmLlHhVvCcSsQqTtAaZz]|[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"
#: The flags of an arc may stand without a gap before what follows.
_ARC = r"([Aa][^MmLlHhVvCcSsQqTtAaZz]*)"
_FLAGS = r"((?:[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?[\s,]*){3})([01])[\s,]*([01])[\s,]*((?:[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?[\s,]*){2})"


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def commands(data: Column) -> Column:
    """Path data as an array of (op, a): each command with its numbers, repeated ones apart; what follows a move is a
    line. Null for what is no path: it begins with no move, a number is missing, or other text stands between."""
    plain = F.when(data.rlike("[Aa]"), F.array_join(F.transform(F.split(F.regexp_replace(data, _ARC, "\u0001$1\u0001"), "\u0001"), lambda s: F.when(s.rlike("^[Aa]"), F.regexp_replace(s, _FLAGS, "$1 $2 $3 $4 ")).otherwise(s)), " ")).otherwise(data)
    words = F.regexp_extract_all(plain, F.lit("(" + _TOKEN + ")"), 1)
    rest = F.regexp_replace(F.regexp_replace(plain, _TOKEN, ""), r"[\s,]+", "")
    letter = lambda w: w.rlike(r"^[A-Za-z]$")
    count = F.create_map(*[F.lit(v) for kv in ARGUMENTS.items() for v in kv])
    one = "struct<op:string,a:array<double>>"

    def step(acc: Column, w: Column) -> Column:
        last = F.element_at(acc, -1)
        need = count[F.upper(last["op"])]
        again = F.when(last["op"] == "M", "L").when(last["op"] == "m", "l").otherwise(last["op"])
        full = F.size(last["a"]) >= need
        new = lambda op, a: F.struct(op.alias("op"), a.cast("array<double>").alias("a"))
        number = F.array(w.try_cast("double"))
        return F.when(letter(w), F.concat(acc, F.array(new(w, F.array())))).when(full, F.concat(acc, F.array(new(again, number)))).otherwise(F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(new(last["op"], F.concat(last["a"], number)))))

    begins = F.get(words, 0).isin("M", "m")
    found = F.aggregate(words, F.array().cast(f"array<{one}>"), step)
    whole = lambda xs: F.forall(xs, lambda c: F.size(c["a"]) == count[F.upper(c["op"])])
    return F.when(begins & (rest == ""), _let(found, lambda xs: F.when(whole(xs), xs)))


def _piece(op: str, **at: Column) -> Column:
    return F.struct(F.lit(op).alias("op"), *[at.get(n, F.lit(None)).cast("double").alias(n) for n in ("x1", "y1", "x2", "y2", "x", "y")])


def _arc(x0: Column, y0: Column, a: Column, x1: Column, y1: Column) -> Column:
    """An elliptic arc from (x0, y0) to (x1, y1) as up to four cubic curves; a line if a radius is 0."""
    turn = F.radians(F.pmod(a[2], F.lit(360.0)))
    local = F.struct(F.cos(turn).alias("c"), F.sin(turn).alias("s"), F.abs(a[0]).alias("rx"), F.abs(a[1]).alias("ry"))

    def sized(v: Column) -> Column:
        dx, dy = (x0 - x1) / 2, (y0 - y1) / 2
        px, py = v["c"] * dx + v["s"] * dy, v["c"] * dy - v["s"] * dx
        grow = F.sqrt(F.greatest(F.lit(1.0), (px / v["rx"]) ** 2 + (py / v["ry"]) ** 2))
        return F.struct(v["c"].alias("c"), v["s"].alias("s"), (v["rx"] * grow).alias("rx"), (v["ry"] * grow).alias("ry"), px.alias("px"), py.alias("py"))

    def centred(v: Column) -> Column:
        over = (v["rx"] * v["py"]) ** 2 + (v["ry"] * v["px"]) ** 2
        root = F.sqrt(F.greatest(F.lit(0.0), (v["rx"] * v["ry"]) ** 2 / over - 1)) * F.when((a[3] != 0) == (a[4] != 0), -1).otherwise(1)
        ux, uy = root * v["rx"] * v["py"] / v["ry"], -root * v["ry"] * v["px"] / v["rx"]
        first, last = F.atan2((v["py"] - uy) / v["ry"], (v["px"] - ux) / v["rx"]), F.atan2((-v["py"] - uy) / v["ry"], (-v["px"] - ux) / v["rx"])
        sweep = F.pmod(last - first, F.lit(2 * math.pi))
        way = F.when(a[4] != 0, sweep).otherwise(sweep - 2 * math.pi)
        mx, my = v["c"] * ux - v["s"] * uy + (x0 + x1) / 2, v["s"] * ux + v["c"] * uy + (y0 + y1) / 2
        return F.struct(*[v[n].alias(n) for n in ("c", "s", "rx", "ry")], mx.alias("mx"), my.alias("my"), first.alias("first"), way.alias("way"), F.greatest(F.lit(1), F.ceil(F.abs(way) / (math.pi / 2) - 1e-9)).cast("int").alias("n"))

    def curves(v: Column) -> Column:
        step = v["way"] / v["n"]
        k = F.tan(step / 4) * 4 / 3

        def at(angle: Column, along: Column | float) -> tuple[Column, Column]:
            ex, ey = v["rx"] * (F.cos(angle) - along * F.sin(angle)), v["ry"] * (F.sin(angle) + along * F.cos(angle))
            return v["c"] * ex - v["s"] * ey + v["mx"], v["s"] * ex + v["c"] * ey + v["my"]

        def one(i: Column) -> Column:
            b, e = v["first"] + i * step, v["first"] + (i + 1) * step
            (xa, ya), (xb, yb), (xe, ye) = at(b, k), at(e, -k), at(e, 0.0)
            ends = i == v["n"] - 1  # the last point is the one that was written
            return _piece("C", x1=xa, y1=ya, x2=xb, y2=yb, x=F.when(ends, x1).otherwise(xe), y=F.when(ends, y1).otherwise(ye))

        return F.transform(F.sequence(F.lit(0), v["n"] - 1), one)

    real = _let(_let(_let(local, sized), centred), curves)
    return F.when((x0 == x1) & (y0 == y1), F.array().cast(f"array<{SEGMENT}>")).when((a[0] == 0) | (a[1] == 0), F.array(_piece("L", x=x1, y=y1))).otherwise(real)


def segments(data: Column) -> Column:
    """Path data as an array of M, L, C and Z segments with absolute points: horizontals and verticals are lines;
    quadratic, smooth and elliptic curves are cubic. Null for what is no path."""
    zero = F.lit(0.0)
    start = F.struct(*[zero.alias(n) for n in ("x", "y", "sx", "sy", "cx", "cy")], F.lit("").alias("last"), F.array().cast(f"array<{SEGMENT}>").alias("out")).cast(_STATE)

    def step(acc: Column, c: Column) -> Column:
        op, a = F.upper(c["op"]), c["a"]
        ox, oy = F.when(op == c["op"], 0.0).otherwise(acc["x"]), F.when(op == c["op"], 0.0).otherwise(acc["y"])
        g = lambda i: F.get(a, F.lit(i))
        pick = lambda *cases: F.coalesce(*[F.when(op.isin(*ops), v) for ops, v in cases])
        ex = pick((("M", "L", "T", "H"), g(0) + ox), (("V",), acc["x"]), (("C",), g(4) + ox), (("S", "Q"), g(2) + ox), (("A",), g(5) + ox), (("Z",), acc["sx"]))
        ey = pick((("M", "L", "T"), g(1) + oy), (("H",), acc["y"]), (("V",), g(0) + oy), (("C",), g(5) + oy), (("S", "Q"), g(3) + oy), (("A",), g(6) + oy), (("Z",), acc["sy"]))
        smooth = lambda ops: acc["last"].isin(*ops)
        mirror = lambda n, m, ops: F.when(smooth(ops), 2 * acc[n] - acc[m]).otherwise(acc[n])
        # The control point that counts for what follows: the second of a cubic, the one of a quadratic.
        qx, qy = pick((("C",), g(2) + ox), (("S", "Q"), g(0) + ox), (("T",), mirror("x", "cx", ("Q", "T"))), (("M", "L", "H", "V", "A", "Z"), ex)), pick((("C",), g(3) + oy), (("S", "Q"), g(1) + oy), (("T",), mirror("y", "cy", ("Q", "T"))), (("M", "L", "H", "V", "A", "Z"), ey))
        fx, fy = F.when(op == "C", g(0) + ox).otherwise(mirror("x", "cx", ("C", "S"))), F.when(op == "C", g(1) + oy).otherwise(mirror("y", "cy", ("C", "S")))
        known = F.struct(op.alias("op"), *[v.alias(n) for n, v in (("ex", ex), ("ey", ey), ("qx", qx), ("qy", qy), ("fx", fx), ("fy", fy))])

        def moved(k: Column) -> Column:
            third = lambda p, q: p + (q - p) * 2 / 3
            cubic = _piece("C", x1=k["fx"], y1=k["fy"], x2=k["qx"], y2=k["qy"], x=k["ex"], y=k["ey"])
            raised = _piece("C", x1=third(acc["x"], k["qx"]), y1=third(acc["y"], k["qy"]), x2=third(k["ex"], k["qx"]), y2=third(k["ey"], k["qy"]), x=k["ex"], y=k["ey"])
            pieces = F.when(k["op"] == "M", F.array(_piece("M", x=k["ex"], y=k["ey"]))).when(k["op"] == "Z", F.array(_piece("Z"))).when(k["op"].isin("L", "H", "V"), F.array(_piece("L", x=k["ex"], y=k["ey"])))
            pieces = pieces.when(k["op"].isin("C", "S"), F.array(cubic)).when(k["op"].isin("Q", "T"), F.array(raised)).otherwise(_arc(acc["x"], acc["y"], a, k["ex"], k["ey"]))
            home = lambda n, e: F.when(k["op"] == "M", k[e]).otherwise(acc[n])
            return F.struct(k["ex"].alias("x"), k["ey"].alias("y"), home("sx", "ex").alias("sx"), home("sy", "ey").alias("sy"), k["qx"].alias("cx"), k["qy"].alias("cy"), k["op"].alias("last"), F.concat(acc["out"], pieces).alias("out")).cast(_STATE)

        return _let(known, moved)

    return _let(commands(data), lambda xs: F.when(xs.isNotNull(), F.aggregate(xs, start, step, lambda s: s["out"])))
