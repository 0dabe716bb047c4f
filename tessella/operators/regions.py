"""Which cells are painted along with drawings: whole tables, or the cells near a drawing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import table
from . import ranges

BOX = ["r1", "r2", "c1", "c2"]
MOST_CELLS = 10_000
MARGIN = 6  # points around a preview


def boxed(spans: DataFrame, rows: DataFrame, columns: DataFrame, by: list[str]) -> DataFrame:
    """spans (by, r1, r2, c1, c2) with x, y, w and h in points. rows and columns: by, line, start, size."""
    out = spans
    for tracks, first, last, at, size in ((columns, "c1", "c2", "x", "w"), (rows, "r1", "r2", "y", "h")):
        low = tracks.select(*by, F.col("line").alias(first), F.col("start").alias(at))
        high = tracks.select(*by, F.col("line").alias(last), (F.col("start") + F.col("size")).alias("_end"))
        out = out.join(low, [*by, first]).join(high, [*by, last]).withColumn(size, F.col("_end") - F.col(at)).drop("_end")
    return out


def _items(items: DataFrame, by: list[str]) -> DataFrame:
    return items.select(*by, "id", "x", "y", F.col("width").alias("w"), F.col("height").alias("h"))


def _fits(low: dict[str, Column], high: dict[str, Column], cells: Column, most_cells: int, most_pixels: int) -> Column:
    side = lambda a: F.ceil((high[a] - low[a] + MARGIN) * 96 / 72)
    return (cells <= most_cells) & (side("x") * side("y") <= most_pixels)


def _judged(spans: DataFrame, items: DataFrame, by: list[str], tile: int, most_cells: int, most_pixels: int) -> DataFrame:
    """spans (by, box, x, y, w, h) that overlap an item, and fits: whether its cells and the union of its box
    with those items stay within the bounds of a preview."""
    key = [*by, *BOX]
    pairs = ranges.overlapping(spans.select(*key, "x", "y", "w", "h"), _items(items, by), by, tile)
    low = {a: F.least(F.min(f"{a}_r"), F.min(f"{a}_l")) for a in ("x", "y")}
    high = {a: F.greatest(F.max(F.col(f"{a}_r") + F.col(f"{s}_r")), F.max(F.col(f"{a}_l") + F.col(f"{s}_l"))) for a, s in (("x", "w"), ("y", "h"))}
    named = pairs.withColumnsRenamed({f"{b}_l": b for b in BOX})
    cells = (F.col("r2") - F.col("r1") + 1).cast("long") * (F.col("c2") - F.col("c1") + 1)
    told = named.groupBy(*key).agg(*[low[a].alias(f"_{a}1") for a in low], *[high[a].alias(f"_{a}2") for a in high])
    fits = _fits({a: F.col(f"_{a}1") for a in "xy"}, {a: F.col(f"_{a}2") for a in "xy"}, cells, most_cells, most_pixels)
    return spans.join(told.select(*key, fits.alias("fits")), key)


def _near(tables: DataFrame, items: DataFrame, rows: DataFrame, columns: DataFrame, by: list[str], tile: int, most_cells: int) -> DataFrame:
    """The cells of tables under each item that overlaps them: by, row, col."""
    out = ranges.overlapping(tables.select(*by, *BOX, "x", "y", "w", "h"), _items(items, by), by, tile)
    for tracks, at, size, name in ((columns, "x", "w", "col"), (rows, "y", "h", "row")):
        lines = tracks.select(*by, F.col("start").cast("double").alias("start"), F.col("line").alias("_line"))
        for end, point in (("first", F.greatest(f"{at}_l", f"{at}_r")), ("last", F.least(F.col(f"{at}_l") + F.col(f"{size}_l"), F.col(f"{at}_r") + F.col(f"{size}_r")) - 1e-9)):
            out = ranges.locate(out.withColumn("_at", point.cast("double")), lines, by, "_at", ["_line"]).withColumnRenamed("_line", f"_{name}_{end}").drop("_at")
    clamp = lambda name, low, high: (F.greatest(f"_{name}_first", f"{low}_l"), F.least(f"_{name}_last", f"{high}_l"))
    (r1, r2), (c1, c2) = clamp("row", "r1", "r2"), clamp("col", "c1", "c2")
    out = out.select(*by, r1.alias("r1"), r2.alias("r2"), c1.alias("c1"), c2.alias("c2")).where(f"r2 >= r1 AND c2 >= c1 AND (r2 - r1 + 1) * (c2 - c1 + 1) <= {most_cells}").distinct()
    return out.select(*by, F.explode(F.sequence("r1", "r2")).alias("row"), "c1", "c2").select(*by, "row", F.explode(F.sequence("c1", "c2")).alias("col")).distinct()


def touching(tables: DataFrame, cells: DataFrame, merges: DataFrame, items: DataFrame, rows: DataFrame, columns: DataFrame, by: list[str], most_cells: int = MOST_CELLS, most_pixels: int = 40_000_000, tile: int = 256) -> DataFrame:
    """tables and merges: by, r1, r2, c1, c2, each disjoint among themselves. cells: by, row, col, those with a content.
    items: by, id, x, y, width, height. rows and columns: by, line, start, size, 0 for hidden ones.

    by, box, kind and x, y, w, h of what is painted with the drawings that it overlaps: a table as a
    whole if it fits a preview with them; of a table that does not, the shown cells under the
    drawings, or the merges over these; and outside of tables, merges with a content and single cells.
    What does not fit by itself is left out. The tables of its steps stay in the shared folder. A region's preview is judged with the items it touches; of
    what several regions join, drawings.grouped judges the whole."""
    shown = lambda df, name: df.where("size > 0").select(*by, F.col("line").alias(name))
    see = lambda df, r, c: df.join(shown(rows, "_r").withColumnRenamed("_r", r), [*by, r], "left_semi").join(shown(columns, "_c").withColumnRenamed("_c", c), [*by, c], "left_semi")
    rows, columns, items, cells = table(rows), table(columns), table(items), table(cells.select(*by, "row", "col").distinct())
    whole = table(_judged(boxed(tables.select(*by, *BOX), rows, columns, by), items, by, tile, most_cells, most_pixels))
    near = table(see(_near(whole.where("NOT fits"), items, rows, columns, by, tile, most_cells), "row", "col"))
    under = ranges.cells_in_ranges(near, merges.select(*by, *BOX), by)
    single = near.join(under.select(*by, "row", "col"), [*by, "row", "col"], "left_anti")
    alone = lambda df: df.select(*by, F.col("row").alias("r1"), F.col("row").alias("r2"), F.col("col").alias("c1"), F.col("col").alias("c2"))
    anchors = merges.select(*by, *BOX, F.col("r1").alias("row"), F.col("c1").alias("col"))
    anchors = anchors.join(cells, [*by, "row", "col"], "left_semi")
    loose = see(cells, "row", "col")
    out_of = lambda df, others: df.join(ranges.cells_in_ranges(df.select(*by, "row", "col"), others.select(*by, *BOX), by).select(*by, "row", "col").distinct(), [*by, "row", "col"], "left_anti")
    spans = under.select(*by, *BOX).unionByName(alone(single)).unionByName(out_of(anchors, tables).select(*by, *BOX)).unionByName(alone(out_of(out_of(loose, tables), merges)))
    spans = table(see(spans.distinct(), "r1", "c1"))
    local = _judged(boxed(spans, rows, columns, by), items, by, tile, most_cells, most_pixels)
    both = whole.withColumn("kind", F.lit("table")).unionByName(local.withColumn("kind", F.lit("cells")))
    return both.where("fits").drop("fits").select(*by, *BOX, "kind", "x", "y", "w", "h")
