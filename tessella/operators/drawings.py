"""Drawings on a sheet: anchors, what is visible, groups for one preview, slide issues."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import shared
from ..functions.geometry import EMU_PIXEL, EMU_POINT
from . import graph, pages, ranges

FALLBACK = (240.0, 90.0)  # size in points of a drawing whose place is unknown
TOLERANCE = 2.0  # pixels by which an element may leave its slide
REPORTED = 20  # issues that a report names
TILE, MOST_HELD = 256, 1 << 16  # side of a tile of a page, and boxes of one that a worker holds


def anchored(drawings: DataFrame, xs: DataFrame, ys: DataFrame, by: list[str]) -> DataFrame:
    """drawings: by, id, c1, dx1, c2, dx2, r1, dy1, r2, dy2 and old (whether the offsets are
    1024ths and 256ths of the cell, else EMU). xs and ys: by, line, start, size in points.
    Adds x, y, width and height in points."""
    out = drawings
    for axis, tracks, whole, ends in (("x", xs, 1024.0, (("c1", "dx1"), ("c2", "dx2"))), ("y", ys, 256.0, (("r1", "dy1"), ("r2", "dy2")))):
        for line, offset in ends:
            named = tracks.select(*by, F.col("line").alias(line), F.col("start").alias("_start"), F.col("size").alias("_size"))
            out = out.join(named, [*by, line])
            inside = F.when(F.col("old"), F.col("_size") * F.col(offset) / whole).otherwise(F.col(offset) / EMU_POINT)
            out = out.withColumn(f"_{axis}{line[-1]}", F.col("_start") + inside).drop("_start", "_size")
    side = lambda a: (F.least(f"_{a}1", f"_{a}2"), F.abs(F.col(f"_{a}2") - F.col(f"_{a}1")))
    (x, w), (y, h) = side("x"), side("y")
    return out.select(*drawings.columns, x.alias("x"), y.alias("y"), w.alias("width"), h.alias("height"))


def visible(drawings: DataFrame, rows: DataFrame, columns: DataFrame, by: list[str]) -> DataFrame:
    """drawings (by, id, hidden, row, col: of the top left corner, null where unknown) without
    those that are hidden themselves or begin in a hidden row or column (rows and columns:
    by, line); warning marks an unknown place, which stays."""
    gone = lambda df, name: df.select(*by, F.col("line").alias(name), F.lit(True).alias(f"_no_{name}"))
    out = drawings.where("NOT hidden").join(gone(rows, "row"), [*by, "row"], "left").join(gone(columns, "col"), [*by, "col"], "left")
    known = F.col("row").isNotNull() & F.col("col").isNotNull()
    out = out.where(~known | (F.col("_no_row").isNull() & F.col("_no_col").isNull()))
    return out.select(*drawings.columns, F.when(~known, "DRAWING_POSITION_UNKNOWN").alias("warning"))


def shown_text(run: Column, struck: Column, placeholder: Column) -> Column:
    """A slide run's text, or nothing for struck ones and those of headers and footers."""
    text = F.regexp_replace(F.translate(run, "\x0b", "\n"), r"\r\n?", "\n")
    return F.when(struck | F.coalesce(placeholder.isin("hdr", "ftr", "dt", "sldNum"), F.lit(False)), "").otherwise(F.coalesce(text, F.lit("")))


def has_content(kind: Column, fill: Column, *borders: Column) -> Column:
    """Whether a preview shows a cell: a value, a fill or a border on any side."""
    out = (kind != "BLANK") | F.coalesce(fill, F.lit(False))
    for b in borders:
        out = out | F.coalesce(b, F.lit(False))
    return out


def grouped(items: DataFrame, links: DataFrame, regions: DataFrame, touching: DataFrame, most_pixels: int, by: list[str]) -> DataFrame:
    """Which drawings share one preview. items: by, id and x, y, width, height. links: by, a,
    b: groups, resolved connections, overlaps of pictures. regions: by, id, r1, r2, c1, c2
    and x, y, width, height of cell regions; touching: by, region, item. A component whose
    cells or pixels pass the limits of a preview loses its regions, and the rest is joined
    anew. by, id, kind (item or region) and root, the least name of the component."""
    name = lambda kind, c: F.struct(*by, F.lit(kind).alias("kind"), F.col(c).alias("id"))
    own = links.select(name("item", "a").alias("a"), name("item", "b").alias("b"))
    # Items are joined by their own links once; regions then join whole components of items.
    alone = graph.settled(graph.components(items.select(name("item", "id").alias("id")), own))
    cells = touching.select(name("region", "region").alias("a"), name("item", "item").alias("id")).join(alone, "id")
    cells = graph.settled(cells.select("a", F.col("root").alias("b")).distinct())
    joined = graph.components(cells.select(F.col("b").alias("id")).unionByName(regions.select(name("region", "id").alias("id"))), cells)
    joined = graph.settled(joined.select(F.col("id").alias("root"), F.col("root").alias("whole")))
    whole = alone.join(joined, "root", "left").select("id", "root", F.coalesce("whole", "root").alias("whole"))
    whole = graph.settled(whole.unionByName(joined.where("root.kind = 'region'").select(F.col("root").alias("id"), "root", "whole")))
    none = F.lit(None).cast("int")
    boxes = regions.select(name("region", "id").alias("id"), "r1", "r2", "c1", "c2", "x", "y", "width", "height")
    boxes = boxes.unionByName(items.select(name("item", "id").alias("id"), none.alias("r1"), none.alias("r2"), none.alias("c1"), none.alias("c2"), "x", "y", "width", "height"))
    large = pages.previews(boxes.join(whole, "id"), ["whole"], most_pixels).where("NOT fits AND cells IS NOT NULL").select("whole", F.lit(True).alias("_large"))
    again = whole.join(large, "whole", "left").where("_large IS NULL OR id.kind = 'item'").select("id", F.when(F.col("_large"), F.col("root")).otherwise(F.col("whole")).alias("root"))
    return again.select(*[F.col(f"id.{c}").alias(c) for c in by], F.col("id.id").alias("id"), F.col("id.kind").alias("kind"), F.struct("root.kind", "root.id").alias("root"))


def slide_issues(elements: DataFrame, slides: DataFrame) -> DataFrame:
    """elements: slide (null outside of any), ord, tag, visible and left, top, right, bottom;
    slides: slide and its box. The first REPORTED issues in their order: content outside of
    the slides, and elements that leave their slide by more than TOLERANCE."""
    box = slides.select("slide", *[F.col(c).alias(f"_{c}") for c in ("left", "top", "right", "bottom")])
    seen = elements.where("visible AND right > left AND bottom > top").join(box, "slide", "left")
    over = F.expr(f"left < _left - {TOLERANCE} OR top < _top - {TOLERANCE} OR right > _right + {TOLERANCE} OR bottom > _bottom + {TOLERANCE}")
    code = F.when(F.col("slide").isNull(), "CONTENT_OUTSIDE_SLIDES").when(over, "SLIDE_OVERFLOW")
    found = seen.withColumn("code", code).where("code IS NOT NULL").select("code", "slide", "ord", "tag")
    return found.orderBy(F.col("slide").asc_nulls_first(), "ord").limit(REPORTED)


def table_patches(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """What a table's rows and cells get in a slide's units: heights and margins in EMU (a
    height is one at least), line spacing in hundredths of a point where the measured line
    is the font's own. rows: tbl, row, height; cells: tbl, row, col, margins, line, font, most."""
    emu = lambda c: F.floor(c * EMU_PIXEL + 0.5).cast("long")
    spacing = F.when((F.col("line") > 0) & (F.col("most") <= F.col("font") * 75 + 0.5), F.floor(F.col("line") * 75 + 0.5).cast("long"))
    told = cells.select("tbl", "row", "col", F.transform("margins", lambda m: F.greatest(F.lit(0).cast("long"), emu(m))).alias("margins"), spacing.alias("spacing"))
    return told.join(rows.select("tbl", "row", F.greatest(F.lit(1).cast("long"), emu(F.col("height"))).alias("height")), ["tbl", "row"])


def image_block(kind: Column, path: Column, section: Column, sha256: Column, size: Column, eligible: Column, text: Column) -> tuple[Column, Column]:
    """The report's block of an image, as JSON, and its Markdown: inline for the formats that
    a reader shows, with the recognised text after it."""
    status = F.when(~eligible, "skipped").when(text.isNull(), "notRequested").when(text.rlike(r"\S"), "succeeded").otherwise("noText")
    block = F.to_json(F.struct(kind.alias("type"), section.alias("section"), path.alias("path"), F.array(F.struct(sha256.alias("sha256"), size.alias("sizeBytes"), F.struct(status.alias("status")).alias("ocr"))).alias("sourceImages")))
    inline = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)\z", 1)).isin("png", "jpg", "jpeg", "gif", "webp")
    shown = F.concat(F.when(inline, "!").otherwise(""), F.lit("["), F.lit("図形"), F.lit("]("), path, F.lit(")"))
    return block, F.concat(shown, F.when(status == "succeeded", F.concat(F.lit("\n\n画像内の文字（OCR）:\n\n"), text)).otherwise(""))


def first_of_each(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    """The first row of each group in an order."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where("_k = 1").drop("_k")


def pinned(drawings: DataFrame, tables: DataFrame, by: list[str]) -> DataFrame:
    """drawings with after: the place (ord) of the last table that each overlaps, null for none.
    Both: by, r1, r2, c1, c2; drawings: id; tables: ord."""
    bins = lambda df: df.withColumn("_bin", F.explode(F.expr("sequence(r1 div 64, r2 div 64)")))
    near = bins(tables.select(*by, "ord", "r1", "r2", F.col("c1").alias("t1"), F.col("c2").alias("t2"))).withColumnsRenamed({"r1": "s1", "r2": "s2"})
    hit = bins(drawings).join(near, [*by, "_bin"]).where("s1 <= r2 AND r1 <= s2 AND t1 <= c2 AND c1 <= t2")
    last = hit.groupBy(*by, "id").agg(F.max("ord").alias("after"))
    return drawings.join(last, [*by, "id"], "left")


def _met(rows: Iterator[tuple], most: int) -> Iterator[tuple]:
    """The boxes of a tile (id, x, y, w, h, own, tied, behind, z, in order of x), each with the least id that it is
    linked with in there. A sweep along x keeps, for each stretch of y, the box that reaches furthest: whatever covers
    a point together is linked, so one of them stands for all. After most boxes those that are told are dropped;
    what the sweep still needs of them comes again, tied by its id."""
    held: list[tuple] = []
    up: list[int] = []
    starts, reach, who = [-math.inf], [-math.inf], [-1]

    def top(k: int) -> int:
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    def told(needed: set[int]) -> Iterator[tuple]:
        least: dict = {}
        for k, (n, *_) in enumerate(held):
            r = top(k)
            least[r] = min(least.get(r, n), n)
        yield from ((n, least[top(k)], own, tied or k in needed, behind, z) for k, (n, own, tied, behind, z) in enumerate(held))

    for n, x, y, w, h, *rest in rows:
        if None in (x, y, w, h) or not (x + w > x and y + h > y):
            yield n, n, *rest
            continue
        if len(held) >= most:
            needed = {k for k, far in zip(who, reach, strict=True) if far > x}
            yield from told(needed)
            again = {k: j for j, k in enumerate(sorted(needed))}
            held = [(held[k][0], False, True, *held[k][3:]) for k in again]
            up, who = list(range(len(held))), [again.get(k, -1) for k in who]
            kept = [(at, k, far if k >= 0 else -math.inf) for at, k, far in zip(starts, who, reach, strict=True)]
            kept = [s for s, was in zip(kept, [None, *kept], strict=False) if was is None or s[1:] != was[1:]]
            starts, who, reach = map(list, zip(*kept, strict=True))
        me, right = len(held), x + w
        held.append((n, *rest))
        up.append(me)
        i = bisect_right(starts, y)
        if starts[i - 1] == y:
            i -= 1
        else:
            for all_, new in ((starts, y), (reach, reach[i - 1]), (who, who[i - 1])):
                all_.insert(i, new)
        j = bisect_left(starts, y + h, i)
        if j == len(starts) or starts[j] != y + h:
            for all_, new in ((starts, y + h), (reach, reach[j - 1]), (who, who[j - 1])):
                all_.insert(j, new)
        now: list[tuple] = []
        for s in range(i, j):
            if reach[s] > x:
                up[top(who[s])] = top(me)
            new = (reach[s], who[s]) if reach[s] > right else (right, me)
            if not now or now[-1][1:] != new:
                now.append((starts[s], *new))
        starts[i:j], reach[i:j], who[i:j] = zip(*now, strict=True)
    yield from told(set())


def merged_scopes(scopes: DataFrame, guards: list[str]) -> DataFrame:
    """Which drawings of a paragraph are rendered as one: those that overlap and agree in all
    guards (page, paragraph, reference, layout). scopes: guards, id, x, y, w, h, behind, z.
    guards, id, root (the least id) and paint: what is behind the text first, then by z.
    Tiles are swept one by one, so no pair is written, however many overlap; what a box in several tiles
    ties together are whole groups of tiles. Boxes without an extent are compared in pairs."""
    low, high = (lambda c: F.floor(F.col(c) / TILE)), (lambda c, size: F.floor((F.col(c) + F.col(size)) / TILE))
    tiles = lambda c, size: F.explode_outer(F.when(F.col(c) + F.col(size) > F.col(c), F.sequence(low(c), high(c, size))).otherwise(F.array(low(c))))
    cut = scopes.select(*guards, "id", "x", "y", "w", "h", "behind", "z").withColumn("_tx", tiles("x", "w")).withColumn("_ty", tiles("y", "h"))
    first = F.col("_tx").eqNullSafe(low("x")) & F.col("_ty").eqNullSafe(low("y"))
    cut = cut.withColumn("_own", first).withColumn("_tied", ~first | (high("x", "w") > low("x")) | (high("y", "h") > low("y")))
    outputs, most = {"id": "id", "_least": "id", "_own": "_own", "_tied": "_tied", "behind": "behind", "z": "z"}, MOST_HELD
    met = shared.table(shared.folded(cut, [*guards, "_tx", "_ty"], ["x"], ["id", "x", "y", "w", "h", "_own", "_tied", "behind", "z"], outputs, lambda rows: _met(rows, most)).drop("_tx", "_ty"))
    ends = met.where("_tied").groupBy("id").agg(F.min("_least").alias("a"), F.collect_set("_least").alias("_all"))
    links = ends.select("a", F.explode("_all").alias("b")).where("a <> b").distinct()
    flat = scopes.where("NOT (x + w > x AND y + h > y)")
    if flat.limit(1).count():
        boxes = lambda df: df.select(F.struct(*guards).alias("_g"), "id", "x", "y", "w", "h")
        pairs = ranges.overlapping(boxes(flat), boxes(scopes), ["_g"], 64).where("id_l <> id_r")
        for end, name in (("id_l", "a"), ("id_r", "b")):
            pairs = pairs.join(met.where("_own").select(F.col("id").alias(end), F.col("_least").alias(name)).hint("merge"), end)
        links = links.unionByName(pairs.select("a", "b").where("a <> b"))
    links = shared.table(links)
    roots = graph.components(links.select(F.explode(F.array("a", "b")).alias("_least")), links, node="_least", inside=True)
    out = met.where("_own").join(roots.hint("merge"), "_least", "left").withColumn("root", F.coalesce("root", "_least"))
    order = Window.partitionBy("root").orderBy(F.col("behind").desc(), "z", "id")
    return out.select(*guards, "id", "root", F.row_number().over(order).alias("paint"))
