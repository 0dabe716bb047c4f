"""Pages: readable scales, dense tables, previews, row chunks, broken lines, single pages."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import folded
from . import ranges

PREVIEW_CELLS = 10_000
HEADER_LINES = 8


def least_font(cells: DataFrame, ranges: DataFrame, by: list[str]) -> DataFrame:
    """ranges (by, r1, r2, c1, c2) with the least font size of their visible cells with a
    text; cells: by, row, col, text, size, hidden. Null where no text is visible."""
    seen = cells.where("NOT hidden AND text <> ''").select(*by, "row", "col", "size")
    # Rows of a range are cut into bins, so that the join is by equality.
    spread = ranges.withColumn("_bin", F.explode(F.expr("sequence(r1 div 256, r2 div 256)")))
    held = spread.join(seen.withColumn("_bin", F.expr("row div 256")), [*by, "_bin"]).where("row BETWEEN r1 AND r2 AND col BETWEEN c1 AND c2")
    key = [*by, "r1", "r2", "c1", "c2"]
    return ranges.join(held.groupBy(*key).agg(F.min("size").alias("least_font")), key, "left")


def scale(base: Column, width: Column, most_width: Column, least: Column, text_pixels: Column) -> Column:
    """Pixels for a point: shrunk to fit the width, but not below what keeps the least font
    readable, nor below half of the base without text; never above the base."""
    fit = F.least(base, most_width / width)
    readable = F.when(least.isNull(), base / 2).otherwise(text_pixels / F.greatest(F.lit(1.0), least))
    small = least.isNotNull() & (least * base + 1e-6 < text_pixels)
    return F.when(small, base).otherwise(F.least(base, F.greatest(fit, readable)))


def dense(cells: DataFrame, by: list[str]) -> DataFrame:
    """Rows of a sheet without its empty rows and columns: by, row, values (an array with a
    place for each column that has a text in any row, in order). cells: by, row, col, value."""
    told = cells.withColumn("value", F.trim("value")).where("value <> ''")
    place = F.dense_rank().over(Window.partitionBy(*by).orderBy("col"))
    columns = told.select(*by, "col").distinct().withColumn("_place", place)
    width = columns.groupBy(*by).agg(F.max("_place").alias("_width"))
    rows = told.join(columns, [*by, "col"]).groupBy(*by, "row").agg(F.map_from_entries(F.collect_list(F.struct("_place", "value"))).alias("_at"))
    fill = F.transform(F.sequence(F.lit(1), F.col("_width")), lambda i: F.coalesce(F.try_element_at("_at", i), F.lit("")))
    return rows.join(width, by).select(*by, "row", fill.alias("values"))


def previews(boxes: DataFrame, by: list[str], most_pixels: int, most_cells: int = PREVIEW_CELLS) -> DataFrame:
    """by, cells and fits for groups of boxes (by, r1, r2, c1, c2 and x, y, width, height in
    points): whether all their cells and the pixels around them are within the limits."""
    side = lambda a, b: F.ceil((F.max(b) - F.min(a) + 6) * 96.0 / 72)
    out = boxes.withColumn("_x2", F.col("x") + F.col("width")).withColumn("_y2", F.col("y") + F.col("height"))
    out = out.groupBy(*by).agg(F.sum(F.expr("cast(r2 - r1 + 1 as long) * (c2 - c1 + 1)")).alias("cells"), side("x", "_x2").alias("_w"), side("y", "_y2").alias("_h"))
    return out.select(*by, "cells", ((F.col("cells") <= most_cells) & (F.col("_w") * F.col("_h") <= most_pixels)).alias("fits"))


def painted(items: DataFrame, by: list[str]) -> DataFrame:
    """items (by, id, behind, z) with their place in the paint order: what lies behind the
    document first, then by z, then as listed."""
    order = Window.partitionBy(*by).orderBy(F.col("behind").desc(), "z", "id")
    return items.withColumn("paint", F.row_number().over(order))


def selected(pages: DataFrame, wanted: DataFrame, by: list[str], most: int) -> DataFrame:
    """by, page and error. pages: by, n. wanted: by, page (null for all). A document without
    pages, over the limit or without the wanted page has one row with the error."""
    rows = pages.join(wanted, by, "left")
    error = F.when(F.col("n") < 1, "EMPTY_DOCUMENT").when(F.col("n") > most, "PAGE_LIMIT_EXCEEDED").when(F.col("page") > F.col("n"), "INVALID_PAGE")
    rows = rows.withColumn("error", error)
    all_pages = F.sequence(F.lit(1), F.greatest("n", F.lit(1)))
    found = F.when(F.col("error").isNotNull(), F.array(F.lit(None).cast("int"))).when(F.col("page").isNotNull(), F.array("page")).otherwise(all_pages)
    return rows.select(*by, F.explode(found).alias("page"), "error")


def chunked(rows: DataFrame, by: list[str], page: int, line: int, padding: int) -> DataFrame:
    """by, row, first, count, page: how the rows of a table (by, row from 0, lines) flow over
    pages of a height, in the unit of line and padding (above and below a chunk). The first
    row is the header; one of HEADER_LINES lines at most is repeated at the top of each page."""

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        head, left, number = None, page, 0
        for r, count in rows:
            top = head is None
            head = count if top else head
            again = 0 if top or head > HEADER_LINES else head * line + 2 * padding
            done = 0
            while done < count:
                room = (left - 2 * padding) // line
                if room < 1:
                    number, left = number + 1, page - again
                    room = (left - 2 * padding) // line
                part = min(count - done, max(1, room))
                yield r, done, part, number
                left -= part * line + 2 * padding
                done += part
                if done < count:
                    number, left = number + 1, page - again

    return folded(rows, by, [F.col("row").asc_nulls_last()], ["row", "lines"], {"row": "row", "first": "long", "count": "long", "page": "long"}, run)


def broken(text: Column, widest: float, narrow: float, wide: float) -> Column:
    """Lines of a text, broken at each newline and before the character that would pass the
    widest; ASCII advances by narrow, all else by wide."""
    state = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("line"), F.lit(0.0).alias("width"))

    def step(s: Column, c: Column) -> Column:
        advance = F.when(F.ascii(c) < 128, narrow).otherwise(wide)
        full = (s["line"] != "") & (s["width"] + advance > widest + 0.001)
        shape = lambda a, b, w: F.struct(a.alias("lines"), b.alias("line"), w.alias("width"))
        ended = F.concat(s["lines"], F.array(s["line"]))
        return F.when(c == "\n", shape(ended, F.lit(""), F.lit(0.0))).when(full, shape(ended, c, advance)).otherwise(shape(s["lines"], F.concat(s["line"], c), s["width"] + advance))

    return F.aggregate(F.split(text, ""), state, step, lambda s: F.concat(s["lines"], F.array(s["line"])))


def differences(pixels: DataFrame, by: list[str], threshold: int, edge: int) -> DataFrame:
    """Metrics of two pictures, from pixels (by, x, y, a, b: grey values): changed pixels,
    mean and root mean square error, and how far edges (a Laplacian, without the border) agree."""
    near = F.explode(F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"), (F.col("a") * w).alias("a"), (F.col("b") * w).alias("b")) for dx in (-1, 0, 1) for dy in (-1, 0, 1) for w in [8 if dx == dy == 0 else -1]]))
    folded = pixels.select(*by, near.alias("p")).groupBy(*by, "p.x", "p.y").agg(F.sum("p.a").alias("la"), F.sum("p.b").alias("lb"), F.count("*").alias("k"))
    inner = folded.where("k = 9").select(*by, (F.col("la") > edge).alias("ea"), (F.col("lb") > edge).alias("eb"))
    count = lambda c: F.sum(c.cast("int")).cast("long")
    edges = inner.groupBy(*by).agg(count(F.col("ea")).alias("source_edges"), count(F.col("eb")).alias("target_edges"), count(F.col("ea") != F.col("eb")).alias("edge_mismatch"), count(F.col("ea") | F.col("eb")).alias("_union"))
    off = F.abs(F.col("a") - F.col("b"))
    whole = pixels.groupBy(*by).agg(F.count("*").alias("pixels"), count(off > threshold).alias("changed"), F.avg(off).alias("mean_error"), F.sqrt(F.avg(off * off)).alias("rms_error"), F.max(off).alias("max_error"))
    out = whole.join(edges, by, "left")
    return out.withColumn("edge_mismatch_ratio", F.when(F.col("_union") > 0, F.col("edge_mismatch") / F.col("_union")).otherwise(F.lit(0.0))).drop("_union")


def planned(lines: DataFrame, merges: DataFrame, by: list[str], sizes: dict[str, float]) -> DataFrame:
    """Pages of a range: by, number, x, y, width, height, left to right within each band. lines:
    by, axis (x or y), line, size of what is visible; merges: by, axis, first, last line.
    sizes: the most of each axis in points. A page ends at a line, before merged lines
    that fit a page, or where a single line is larger than a page."""
    offsets = ranges.prefix_offsets(lines, [*by, "axis"], "line", "size")
    edges = offsets.groupBy(*by, "axis").agg(F.array_sort(F.collect_set("end")).alias("edges"))
    place = offsets.select(*by, "axis", "line", "start", "end")
    ends = merges.join(place.select(*by, "axis", F.col("line").alias("first"), "start"), [*by, "axis", "first"]).join(place.select(*by, "axis", F.col("line").alias("last"), "end"), [*by, "axis", "last"])
    blocks = None
    for axis, most in sizes.items():  # merges that cannot fit a page protect nothing
        held = ranges.islands(ends.where((F.col("axis") == axis) & (F.col("end") - F.col("start") <= most)), [*by, "axis"])
        blocks = held if blocks is None else blocks.unionByName(held)
    blocks = blocks.groupBy(*by, "axis").agg(F.collect_list(F.struct(F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end"))).alias("blocks"))
    none = F.array().cast("array<struct<start:double,end:double>>")
    bounds = edges.join(blocks, [*by, "axis"], "left").select(*by, "axis", F.expr("concat(array(0D), cast(edges as array<double>))").alias("edges"), F.coalesce("blocks", none).alias("blocks"))
    parts = {axis: ranges.slices(bounds.where(F.col("axis") == axis).drop("axis"), by, most) for axis, most in sizes.items()}
    across = parts["x"].selectExpr(*by, "page AS i", "start AS x", "`end` - start AS width")
    down = parts["y"].selectExpr(*by, "page AS j", "start AS y", "`end` - start AS height")
    number = F.row_number().over(Window.partitionBy(*by).orderBy("j", "i"))
    return down.join(across, by).withColumn("number", number).select(*by, "number", "x", "y", "width", "height")
