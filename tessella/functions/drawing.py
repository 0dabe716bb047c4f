"""Drawings: names, places, colours and backgrounds (Columns only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import markdown

#: Names of preset shapes, by their keys without separators in lower case (fixed values).
TYPE_NAMES = {
    "rect": "長方形", "rectangle": "長方形", "roundrect": "角丸長方形", "roundrectangle": "角丸長方形", "ellipse": "楕円", "oval": "楕円", "line": "直線", "straightconnector1": "直線コネクタ",
    **dict.fromkeys((f"bentconnector{n}" for n in range(2, 6)), "折れ線コネクタ"), **dict.fromkeys((f"curvedconnector{n}" for n in range(2, 6)), "曲線コネクタ"),
    "text": "テキストボックス", "textbox": "テキストボックス", "picture": "画像", "image": "画像", "group": "グループ", "triangle": "三角形", "rttriangle": "直角三角形", "righttriangle": "直角三角形", "diamond": "ひし形",
    "parallelogram": "平行四辺形", "trapezoid": "台形", "nonisoscelestrapezoid": "不等辺台形", "pentagon": "五角形", "hexagon": "六角形", "heptagon": "七角形", "octagon": "八角形", "decagon": "十角形", "dodecagon": "十二角形",
    "rightarrow": "右矢印", "arrow": "右矢印", "thickarrow": "右矢印", "leftarrow": "左矢印", "uparrow": "上矢印", "downarrow": "下矢印", "leftrightarrow": "左右矢印", "updownarrow": "上下矢印", "quadarrow": "四方向矢印",
    "leftuparrow": "左上矢印", "leftrightuparrow": "左右上矢印", "bentarrow": "屈曲矢印", "uturnarrow": "Uターン矢印", "circulararrow": "環状矢印", "leftcirculararrow": "左環状矢印",
    "curvedrightarrow": "右カーブ矢印", "curvedleftarrow": "左カーブ矢印", "curveduparrow": "上カーブ矢印", "curveddownarrow": "下カーブ矢印", "chevron": "山形", "homeplate": "ホームベース",
    **{f"star{n}": f"星（{n}角）" for n in (4, 5, 6, 7, 8, 10, 12, 16, 24, 32)},
    "heart": "ハート", "cloud": "雲", "sun": "太陽", "moon": "月", "smileyface": "スマイル", "lightningbolt": "稲妻", "plus": "十字", "arc": "円弧", "pie": "扇形", "chord": "弦", "donut": "ドーナツ", "can": "円柱", "cylinder": "円柱",
    "cube": "立方体", "bevel": "額縁", "leftbracket": "左角かっこ", "rightbracket": "右角かっこ", "leftbrace": "左波かっこ", "rightbrace": "右波かっこ",
    "wedgerectcallout": "四角形吹き出し", "wedgeroundrectcallout": "角丸四角形吹き出し", "wedgeellipsecallout": "円形吹き出し", "cloudcallout": "雲形吹き出し",
    "flowchartprocess": "フローチャート・処理", "flowchartdecision": "フローチャート・判断", "flowchartinputoutput": "フローチャート・データ", "flowchartdocument": "フローチャート・書類", "flowchartterminator": "フローチャート・端子",
    "flowchartpredefinedprocess": "フローチャート・定義済み処理", "flowchartconnector": "フローチャート・結合子", "custom": "フリーフォーム", "custgeom": "フリーフォーム", "freeform": "フリーフォーム", "graphicframe": "グラフ・SmartArt等",
}


def type_name(preset: Column) -> Column:
    """The name of a preset shape; an unknown one is shown as it is."""
    one = F.coalesce(markdown.single_line(preset), F.lit(""))
    key = F.lower(F.translate(one, "_- ", ""))
    known = F.create_map(*[F.lit(x) for kv in TYPE_NAMES.items() for x in kv])
    return F.when(key == "", "図形（種類不明）").otherwise(F.coalesce(F.try_element_at(known, key), F.concat(F.lit("図形（"), one, F.lit("）"))))


def points(value: Column) -> Column:
    """A length in points: three decimals at most, half up, without trailing zeros."""
    text = value.cast("decimal(30,9)").cast("decimal(24,3)").cast("string")
    return F.concat(F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+\z", "$1"), r"\.\z", ""), F.lit("pt"))


def geometry_text(reference: Column, x: Column, y: Column, width: Column, height: Column) -> Column:
    """Where a drawing lies: its reference and its bounding box, or that it is unknown."""
    origin = F.coalesce(markdown.single_line(reference), F.lit(""))
    prefix = F.when(origin == "", "基準不明").otherwise(F.concat(F.lit("基準="), origin))
    finite = F.lit(True)
    for c in (x, y, width, height):
        finite = finite & F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    told = F.concat(F.lit("、外接矩形 X="), points(x), F.lit("、Y="), points(y), F.lit("、幅="), points(width), F.lit("、高さ="), points(height))
    return F.concat(prefix, F.when(finite & (width >= 0) & (height >= 0), told).otherwise(F.lit("、位置・サイズ不明")))


def slide_position(x: Column, y: Column, width: Column, height: Column) -> Column:
    """Which ninth of a slide holds a centre: left, center or right and top, middle or bottom;
    null for a centre that is unknown or outside."""
    third = lambda v, size: F.least(F.floor(v * 3 / size), F.lit(2))
    name = lambda v, size, names: F.element_at(F.array(*[F.lit(n) for n in names]), (third(v, size) + 1).cast("int"))
    inside = (x >= 0) & (x <= width) & (y >= 0) & (y <= height)
    return F.when(inside, F.concat_ws("-", name(x, width, ("left", "center", "right")), name(y, height, ("top", "middle", "bottom"))))


def points_toward(dx: Column, dy: Column) -> Column:
    """The direction of an arrow's tip by eighths of a turn (y grows downwards); null without length."""
    eighth = F.pmod(F.floor(F.atan2(dy, dx) / (F.pi() / 4) + 0.5), F.lit(8))
    names = F.array(*[F.lit(n) for n in ("right", "right-bottom", "bottom", "left-bottom", "left", "left-top", "top", "right-top")])
    return F.when((dx != 0) | (dy != 0), F.element_at(names, (eighth + 1).cast("int")))


# --- colours --------------------------------------------------------------------


def linear(s: Column) -> Column:
    return F.when(s <= 0.04045, s / 12.92).otherwise(F.pow((s + 0.055) / 1.055, F.lit(2.4)))


def gamma(v: Column) -> Column:
    return F.when(v <= 0.0031308, v * 12.92).otherwise(F.pow(v, F.lit(1 / 2.4)) * 1.055 - 0.055)


def hsl(r: Column, g: Column, b: Column) -> Column:
    """Hue, saturation and light, each from 0 to 1."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    d, light = top - low, (top + low) / 2
    hue = F.when(d == 0, 0.0).when(top == r, (g - b) / d).when(top == g, (b - r) / d + 2).otherwise((r - g) / d + 4)
    turn, room = hue / 6 + 1, 1 - F.abs(light * 2 - 1)
    # Channels beyond 0..1 may have a light of exactly 0 or 1: an infinite saturation, as in the reference.
    full = F.when(d == 0, 0.0).when(room == 0, float("inf")).otherwise(d / room)
    return F.struct((turn - F.floor(turn)).alias("h"), full.alias("s"), light.alias("l"))


def rgb(h: Column, s: Column, li: Column) -> list[Column]:
    """Red, green and blue of a hue, saturation and light; the last two are clamped."""
    s, li = (F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)) for x in (s, li))
    amplitude = s * F.least(li, 1 - li)

    def channel(n: int) -> Column:
        k = h * 12 + n
        k = k - F.floor(k / 12) * 12
        return li - amplitude * F.greatest(F.lit(-1.0), F.least(k - 3, 9 - k, F.lit(1.0)))

    return [channel(0), channel(8), channel(4)]


MODIFIERS = "alpha alphaMod alphaOff tint shade red green blue redMod greenMod blueMod redOff greenOff blueOff lumMod lumOff satMod satOff hueMod hueOff".split()


def modified(base: Column, modifiers: Column) -> Column:
    """base: struct of r, g, b, a (0..1); modifiers: array of (kind, amount), applied in
    their order. Amounts are shares; that of hueOff is a share of a turn. Unknown kinds
    change nothing."""

    def step(c: Column, m: Column) -> Column:
        kind, v = m["kind"], m["amount"]
        shape = lambda r, g, b, a: F.struct(r.alias("r"), g.alias("g"), b.alias("b"), a.alias("a"))
        each = lambda f: shape(f(c["r"]), f(c["g"]), f(c["b"]), c["a"])
        x = hsl(c["r"], c["g"], c["b"])
        turned = F.transform(F.array(x), lambda t: shape(*rgb(F.when(kind == "hueMod", t["h"] * v).when(kind == "hueOff", t["h"] + v).otherwise(t["h"]), F.when(kind == "satMod", t["s"] * v).when(kind == "satOff", t["s"] + v).otherwise(t["s"]), F.when(kind == "lumMod", t["l"] * v).when(kind == "lumOff", t["l"] + v).otherwise(t["l"])), c["a"]))
        out = F.when(kind == "tint", each(lambda s: gamma(1 - (1 - linear(s)) * v))).when(kind == "shade", each(lambda s: gamma(linear(s) * v)))
        out = out.when(kind.isin("lumMod", "lumOff", "satMod", "satOff", "hueMod", "hueOff"), F.element_at(turned, 1))
        one = lambda name, now: F.when(kind == name, v).when(kind == name + "Mod", now * v).when(kind == name + "Off", now + v).otherwise(now)
        return out.otherwise(shape(one("red", c["r"]), one("green", c["g"]), one("blue", c["b"]), one("alpha", c["a"])))

    return F.aggregate(modifiers, base, step)


def channel(value: Column) -> Column:
    """A channel of 0..1 as 0..255, rounded half up."""
    return F.floor(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)) * 255 + 0.5).cast("int")


def hex_colour(code: Column) -> Column:
    """struct of r, g, b, a of six hexadecimal digits; null for anything else."""
    part = lambda i: F.conv(F.substring(code, i, 2), 16, 10).cast("double") / 255
    return F.when(code.rlike(r"\A[0-9A-Fa-f]{6}\z"), F.struct(part(1).alias("r"), part(3).alias("g"), part(5).alias("b"), F.lit(1.0).alias("a")))


def background(kind: Column, solid: Column, index: Column, themed: Column) -> Column:
    """colour and approximated. kind: none, properties or reference; solid: the colour of
    the only, solid fill of the properties ('none' for no fill); index: the reference's number;
    themed: the solid colour that the theme holds under it. Anything else is white, approximated."""
    plain = lambda c, a: F.struct(c.alias("colour"), a.alias("approximated"))
    white = lambda a: plain(F.lit("FFFFFF"), F.lit(a))
    found = lambda c: F.when(c.isNull(), white(True)).otherwise(plain(c, F.lit(False)))
    return (
        F.when((kind == "properties") & (solid == "none"), white(False)).when(kind == "properties", found(solid))
        .when((kind == "reference") & index.isin(0, 1000), white(False)).when(kind == "reference", found(F.when(index > 0, themed)))
        .otherwise(white(False))
    )
