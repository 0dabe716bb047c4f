"""Where the text of a spreadsheet's cells shows: over blank neighbours, and cut at its box and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import ranges

INSET = 2.0  # points between a box and its text
EDGE = 1.0  # points by which a clip lies within its box


def boxes(cells: DataFrame, tracks: DataFrame, by: list[str]) -> DataFrame:
    """cells: by, row, col, kind (STRING, NUMERIC, FORMULA or BLANK; of a formula that shows text, STRING),
    text, align (null: general), wrap, shrink, rotation, merged (under a merge or its anchor), width (the
    advance of its widest line) and indent, in points. tracks: by, line, start, size of the columns that are
    painted. A row for each text: its cells' columns and left, right (the edges within which it shows).

    A text that is left or general runs over the blank cells to its right until it fits, up to the next cell
    with a content, a merge or the end. One centred over a selection takes the blank
    cells beside it that are centred likewise. Windows run over a row, which the format bounds."""
    line = Window.partitionBy(*by, "row").orderBy("col")
    filled = ~((F.col("kind") == "BLANK") | ((F.col("kind") == "STRING") & (F.coalesce("text", F.lit("")) == "")))
    blocks = F.col("merged") | filled
    centred = F.coalesce(F.col("align") == "centerContinuous", F.lit(False))
    goes_on = ~blocks & centred & (F.col("col") == F.lag("col").over(line) + 1)
    out = cells.withColumn("_stop", F.min(F.when(blocks, F.col("col"))).over(line.rowsBetween(1, Window.unboundedFollowing)))
    out = out.withColumn("_run", F.sum(F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    out = out.withColumn("_upto", F.max("col").over(Window.partitionBy(*by, "row", "_run")))
    out = out.where(filled & (F.coalesce("text", F.lit("")) != ""))
    edges = lambda c, start, end: tracks.select(*by, F.col("line").alias(c), F.col("start").alias(start), (F.col("start") + F.col("size")).alias(end))
    last = tracks.groupBy(*by).agg(F.max(F.col("start") + F.col("size")).alias("_end"))
    out = out.join(edges("col", "left", "_own"), [*by, "col"]).join(edges("_stop", "_wall", "_x"), [*by, "_stop"], "left").drop("_x").join(edges("_upto", "_y", "_far"), [*by, "_upto"], "left").drop("_y").join(last, by)
    plain = (F.col("kind") == "STRING") & ~F.col("wrap") & ~F.col("shrink") & ~F.col("merged") & (F.col("rotation") == 0)
    spills = plain & (F.col("align").isNull() | F.col("align").isin("general", "left"))
    out = out.withColumn("_wanted", F.col("left") + F.col("width") + 2 * INSET + F.col("indent")).withColumn("_spills", spills).withColumn("_centred", plain & centred)
    # The first edge at or beyond what it wants: the end of the column that holds that point.
    out = ranges.locate(out, tracks.withColumn("_a", F.col("start").cast("double")).withColumn("_b", (F.col("start") + F.col("size")).cast("double")), by, "_wanted", ["_a", "_b"])
    fits = F.when(F.col("_a") == F.col("_wanted"), F.col("_a")).otherwise(F.coalesce("_b", "_end"))
    right = F.when(F.col("_spills"), F.greatest("_own", F.least(fits, F.coalesce("_wall", "_end")))).when(F.col("_centred"), F.coalesce("_far", "_own")).otherwise(F.col("_own"))
    return out.select(*cells.columns, "left", right.alias("right"))


def visible(texts: DataFrame, pages: DataFrame, by: list[str], tile: int = 1024) -> DataFrame:
    """texts: of boxes(). pages: by, page, start, end, the cuts along the columns. A row for each text and page
    on which some of it shows: its cells' key, page, from and upto of what shows, at (where the text begins) and
    clipped (whether some of it lies beyond its box)."""
    numeric = F.col("kind") == "NUMERIC"
    general = F.col("align").isNull() | (F.col("align") == "general")
    right, centre = (F.col("align") == "right") | (general & numeric), F.col("align").isin("center", "centerContinuous")
    at = F.when(F.coalesce(right, F.lit(False)), F.col("right") - INSET - F.col("width")).when(F.coalesce(centre, F.lit(False)), (F.col("left") + F.col("right") - F.col("width")) / 2).otherwise(F.col("left") + INSET + F.col("indent"))
    low, high = F.col("left") + EDGE, F.greatest(F.col("left") + EDGE, F.col("right") - EDGE)
    told = texts.select(*by, "row", "col", at.alias("at"), F.col("width"), low.alias("low"), high.alias("high"))
    shown = told.withColumn("_from", F.greatest("low", "at")).withColumn("_upto", F.least("high", F.col("at") + F.col("width")))
    clipped = (F.col("at") < F.col("low") - EDGE) | (F.col("at") + F.col("width") > F.col("high") + EDGE)
    left = shown.select(*by, "row", "col", "at", clipped.alias("clipped"), F.col("_from").alias("x"), (F.col("_upto") - F.col("_from")).alias("w"), F.lit(0.0).alias("y"), F.lit(1.0).alias("h")).where("w > 0")
    cuts = pages.select(*by, "page", F.col("start").cast("double").alias("x"), (F.col("end") - F.col("start")).cast("double").alias("w"), F.lit(0.0).alias("y"), F.lit(1.0).alias("h"))
    both = ranges.overlapping(left, cuts, by, tile)
    return both.select(*by, F.col("row_l").alias("row"), F.col("col_l").alias("col"), F.col("page_r").alias("page"), F.greatest("x_l", "x_r").alias("from"), F.least(F.col("x_l") + F.col("w_l"), F.col("x_r") + F.col("w_r")).alias("upto"), F.col("at_l").alias("at"), F.col("clipped_l").alias("clipped"))
