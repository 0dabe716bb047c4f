"""Ranges, prefixes and islands: joins by cells of a coarse grid, windows by section."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(spans: DataFrame, by: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Union of half-open spans of each group: by, start, end; spans that only touch stay apart."""
    order = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col(start) >= reach), 1).otherwise(0)
    marked = spans.where(F.col(end) > F.col(start)).withColumn("_new", new)
    marked = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*by, "_island").agg(F.min(start).alias("start"), F.max(end).alias("end")).drop("_island")


#: Width of the slices of an ordering number over which running sums and sweeps are cut.
SLICE = 1 << 16


def running(rows: DataFrame, by: list[str], order: str, sums: dict[str, Column], width: int = SLICE) -> DataFrame:
    """rows with running sums in order of a whole number, each row's own value included. The
    sums run within slices of the number on top of the totals of the slices before, so a
    group of any size is spread over many tasks; a row for each slice passes one. An order
    that is no number has no slices: then a group passes one task."""
    if dict(rows.dtypes)[order].startswith(("struct", "string", "array", "binary")):
        whole = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumns({n: F.sum(c).over(whole) for n, c in sums.items()})
    own = rows.withColumns({f"_{n}": c for n, c in sums.items()}).withColumn("_slice", F.floor(F.col(order) / width))
    totals = own.groupBy(*by, "_slice").agg(*[F.sum(f"_{n}").alias(f"_{n}") for n in sums])
    earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_slice").alias("_s"), *[F.coalesce(F.sum(f"_{n}").over(earlier), F.lit(0)).alias(f"_{n}0") for n in sums])
    same = F.col("_slice") == F.col("_s")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    inside = Window.partitionBy(*by, "_slice").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = own.withColumns({n: F.sum(f"_{n}").over(inside) for n in sums}).join(base, same)
    return out.select(*[F.col(c) for c in rows.columns if c not in sums], *[(F.col(n) + F.col(f"_{n}0")).alias(n) for n in sums])


def prefix_offsets(sizes: DataFrame, by: list[str], order: str, size: str) -> DataFrame:
    """Adds start and end: the running sum of sizes before and with each row."""
    out = running(sizes, by, order, {"end": F.col(size)})
    return out.select(*sizes.columns, (F.col("end") - F.col(size)).alias("start"), "end")


def locate(points: DataFrame, tracks: DataFrame, by: list[str], at: str, carry: list[str], width: int = SLICE) -> DataFrame:
    """points with the carry columns of the last track that starts at or before them
    (tracks: by, start). One sweep over both within slices of the position, and the last
    track of the slices before: no range join, and no task holds a whole group."""
    left = points.select(*by, F.col(at).alias("_at"), F.struct(*points.columns).alias("_p"))
    right = tracks.select(*by, F.col("start").cast(dict(points.dtypes)[at]).alias("_at"), F.struct(*carry).alias("_t"))
    both = left.unionByName(right, allowMissingColumns=True).withColumn("_slice", F.floor(F.col("_at") / width))
    lasts = both.groupBy(*by, "_slice").agg(F.max_by("_t", F.when(F.col("_t").isNotNull(), F.col("_at"))).alias("_own"))
    earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    lasts = lasts.select(*by, "_slice", F.last("_own", ignorenulls=True).over(earlier).alias("_before"))
    w = Window.partitionBy(*by, "_slice").orderBy("_at", F.col("_p").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    swept = both.withColumn("_t", F.last("_t", ignorenulls=True).over(w)).where("_p is not null").join(lasts, [*by, "_slice"])
    found = F.coalesce("_t", "_before")
    return swept.withColumn("_t", found).select("_p.*", *[F.col(f"_t.{c}").alias(c) for c in carry])


def overlap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Closed integer rectangles r1..r2, c1..c2 share a cell."""
    return (a["r1"] <= b["r2"]) & (b["r1"] <= a["r2"]) & (a["c1"] <= b["c2"]) & (b["c1"] <= a["c2"])


def intersection(a: dict[str, Column], b: dict[str, Column]) -> Column:
    out = F.struct(F.greatest(a["r1"], b["r1"]).alias("r1"), F.least(a["r2"], b["r2"]).alias("r2"), F.greatest(a["c1"], b["c1"]).alias("c1"), F.least(a["c2"], b["c2"]).alias("c2"))
    return F.when(overlap(a, b), out)


def cells_in_ranges(cells: DataFrame, ranges: DataFrame, by: list[str], rows_per_bin: int = 64) -> DataFrame:
    """cells with the range (r1, r2, c1, c2, and other columns of ranges) that holds
    them; cells in none are dropped. An equi-join on row bins, then a filter: a range
    is repeated once for each bin that it spans."""
    left = cells.withColumn("_bin", F.expr(f"row div {rows_per_bin}"))
    right = ranges.withColumn("_bin", F.explode(F.sequence(F.expr(f"r1 div {rows_per_bin}"), F.expr(f"r2 div {rows_per_bin}"))))
    return left.join(right, [*by, "_bin"]).where("row BETWEEN r1 AND r2 AND col BETWEEN c1 AND c2").drop("_bin")


def covered(cells: DataFrame, merges: DataFrame, by: list[str]) -> DataFrame:
    """Cells under a merge that are not its anchor."""
    return cells_in_ranges(cells, merges, by).where("NOT (row = r1 AND col = c1)")


def overlapping(left: DataFrame, right: DataFrame, by: list[str], tile: int, touch: bool = False) -> DataFrame:
    """Pairs of boxes (x, y, w, h with suffixes _l and _r) that overlap: an equi-join on
    square tiles; a pair that shares several tiles counts in the one that holds the
    corner of its intersection. Touching edges are no overlap unless asked for."""

    def tiled(df: DataFrame, s: str) -> DataFrame:
        rename = {c: f"{c}_{s}" for c in df.columns if c not in by}
        out = df.withColumnsRenamed(rename)
        for axis, size in (("x", "w"), ("y", "h")):
            low, high = F.floor(F.col(f"{axis}_{s}") / tile), F.floor((F.col(f"{axis}_{s}") + F.col(f"{size}_{s}")) / tile)
            out = out.withColumn(f"_t{axis}", F.explode(F.sequence(low, high)))
        return out

    pairs = tiled(left, "l").join(tiled(right, "r"), [*by, "_tx", "_ty"])
    sign = (lambda a, b: a <= b) if touch else (lambda a, b: a < b)
    c = F.col
    fits = sign(c("x_l"), c("x_r") + c("w_r")) & sign(c("x_r"), c("x_l") + c("w_l")) & sign(c("y_l"), c("y_r") + c("h_r")) & sign(c("y_r"), c("y_l") + c("h_l"))
    corner = (c("_tx") == F.floor(F.greatest("x_l", "x_r") / tile)) & (c("_ty") == F.floor(F.greatest("y_l", "y_r") / tile))
    return pairs.where(fits & corner).drop("_tx", "_ty")


def slices(bounds: DataFrame, by: list[str], capacity: float) -> DataFrame:
    """Greedy pages along an axis. bounds: by, edges (sorted array of boundaries from the
    first to the last) and blocks (array of protected (start, end), disjoint). A page ends
    at the last boundary within the capacity, before a protected block that fits a page, or
    at the capacity where a cell is larger. One pass over a section's edges, which the file
    format bounds; each step finds its boundary by bisection."""
    kinds = dict(bounds.dtypes)

    def pages(edges: list[float], blocks: list[tuple[float, float]]) -> Iterator[tuple[float, float]]:
        now, last = edges[0], edges[-1]
        starts = [b[0] for b in blocks]
        while now < last:
            stop = min(now + capacity, last)
            if stop < last:
                k = bisect_right(edges, stop) - 1
                if k >= 0 and edges[k] > now:
                    stop = edges[k]
                k = bisect_left(starts, stop) - 1
                if k >= 0 and blocks[k][1] > stop and blocks[k][1] - blocks[k][0] <= capacity and blocks[k][0] > now:
                    stop = blocks[k][0]
            yield now, stop
            now = stop

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for key, edges, blocks in zip(b[by].itertuples(index=False), b["edges"], b["blocks"], strict=True):
                held = sorted((x["start"], x["end"]) for x in blocks)
                out += [(*key, i, s, e) for i, (s, e) in enumerate(pages(list(edges), held))]
            yield pd.DataFrame(out, columns=[*by, "page", "start", "end"])

    schema = ", ".join(f"{c} {kinds[c]}" for c in by) + ", page int, start double, end double"
    return bounds.select(*by, "edges", "blocks").mapInPandas(run, schema)
