"""Tables split by the named ranges within them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import table

BOX = ["r1", "r2", "c1", "c2"]
SPLIT, SKIPPED = "NAMED_TABLE_SPLIT", "NAMED_TABLE_SPLIT_SKIPPED"


def _within(inner: DataFrame, tables: DataFrame, by: list[str], meets: str, rows_per_bin: int = 64) -> DataFrame:
    """inner (by, box and more) with the tables (by, tab, and their box as t_r1 ...) that it meets: an
    equi-join on row bins and a filter; a pair counts in the first bin that both have."""
    bins = lambda a, b: F.explode(F.sequence(F.expr(f"{a} div {rows_per_bin}"), F.expr(f"{b} div {rows_per_bin}")))
    left = inner.withColumn("_bin", bins("r1", "r2"))
    right = tables.select(*by, "tab", *[F.col(c).alias(f"t_{c}") for c in BOX]).withColumn("_bin", bins("t_r1", "t_r2"))
    both = left.join(right.hint("merge"), [*by, "_bin"]).where(meets)
    return both.where(F.col("_bin") == F.greatest(F.expr(f"r1 div {rows_per_bin}"), F.expr(f"t_r1 div {rows_per_bin}"))).drop("_bin")


_CONTAINED = "r1 >= t_r1 AND r2 <= t_r2 AND c1 >= t_c1 AND c2 <= t_c2"
_MEETS = "r1 <= t_r2 AND t_r1 <= r2 AND c1 <= t_c2 AND t_c1 <= c2"


def by_names(tables: DataFrame, names: DataFrame, columns: DataFrame, merges: DataFrame, by: list[str]) -> DataFrame:
    """tables: by, tab, r1, r2, c1, c2. names: by, name, box and fit (whether it is a band that may
    stand alone, as of grid.eligible_bands). columns: by, tab, col, the columns that a table shows.
    merges: by, box, of merged and of inferred spans.

    by, tab, part (from 1), box, names and outcome. Names that are all full columns, or all full rows, of their
    table, and do not overlap, tile it in order, with bands of their own for the gaps; a gap without a
    shown column goes. A table stays whole, with a reason, if a name is the table itself, if the
    names have other shapes or overlap, if they leave one part alone, or if a merge lies in no part. Every
    side of a join grows with the tables, so none is broadcast; what is read more than once is a table."""
    key = [*by, "tab"]
    tables = table(tables)
    held = table(_within(names, tables, by, _CONTAINED))
    same = F.expr("r1 = t_r1 AND r2 = t_r2 AND c1 = t_c1 AND c2 = t_c2")
    exact = held.where(same).groupBy(*key).agg(F.array_sort(F.collect_list("name")).alias("exact"))
    inner = held.where(~same & F.col("fit"))
    shape = inner.groupBy(*key).agg(F.bool_and(F.expr("r1 = t_r1 AND r2 = t_r2")).alias("columns"), F.bool_and(F.expr("c1 = t_c1 AND c2 = t_c2")).alias("rows"))
    told = tables.join(exact.hint("merge"), key, "left").join(shape.hint("merge"), key, "left").withColumn("may", F.col("exact").isNull() & (F.col("columns") | F.col("rows")))
    axis = lambda a, b: F.when(F.col("columns"), F.col(b)).otherwise(F.col(a))
    bands = inner.join(told.where("may").select(*key, "columns").hint("merge"), key)
    bands = bands.select(*key, "columns", "name", axis("r1", "c1").alias("lo"), axis("r2", "c2").alias("hi"), axis("t_r1", "t_c1").alias("t_lo"), axis("t_r2", "t_c2").alias("t_hi"))
    order = Window.partitionBy(*key).orderBy("lo", "hi", "name")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    bands = bands.withColumn("_next", F.coalesce(F.max("hi").over(before) + 1, F.col("t_lo"))).withColumn("_last", F.lead("lo").over(order).isNull())
    clash = bands.where("lo < _next").select(*key).distinct()
    part = lambda lo, hi, name: F.struct(lo.alias("lo"), hi.alias("hi"), name.alias("name"))
    none, c = F.lit(None).cast("string"), F.col
    pieces = F.array(F.when(c("_next") < c("lo"), part(c("_next"), c("lo") - 1, none)), part(c("lo"), c("hi"), c("name")), F.when(c("_last") & (c("hi") < c("t_hi")), part(c("hi") + 1, c("t_hi"), none)))
    tiles = bands.join(clash.hint("merge"), key, "left_anti").select(*key, "columns", F.explode(pieces).alias("p")).where("p is not null").select(*key, "columns", "p.*")
    shown = columns.join(tiles.select(*key, "columns", "lo", "hi").hint("merge"), key).where("NOT columns OR col BETWEEN lo AND hi").select(*key, "lo").distinct()
    tiles = tiles.join(shown.hint("merge"), [*key, "lo"], "left_semi")
    wide = tiles.join(tables.hint("merge"), key)
    side = lambda c_, own: F.when(own, F.col({"1": "lo", "2": "hi"}[c_[1]])).otherwise(F.col(c_))
    wide = table(wide.select(*key, "lo", "name", *[side(b, F.col("columns") if b[0] == "c" else ~F.col("columns")).alias(b) for b in BOX]))
    count = wide.groupBy(*key).agg(F.count("*").alias("_parts"))
    spans = _within(merges.select(*by, *BOX).distinct(), tables, by, _MEETS).select(*key, *[F.col(b).alias(f"m_{b}") for b in BOX])
    owners = spans.join(wide.hint("merge"), key).groupBy(*key, *[f"m_{b}" for b in BOX]).agg(F.count_if(F.expr("m_r1 >= r1 AND m_r2 <= r2 AND m_c1 >= c1 AND m_c2 <= c2")).alias("_owners"))
    cut = owners.where("_owners <> 1").select(*key).distinct()
    good = table(count.where("_parts >= 2").join(cut.hint("merge"), key, "left_anti"))
    number = F.row_number().over(Window.partitionBy(*key).orderBy("lo"))
    named = F.when(F.col("name").isNull(), F.array().cast("array<string>")).otherwise(F.array("name"))
    split = wide.join(good.hint("merge"), key, "left_semi").select(*key, number.alias("part"), *BOX, named.alias("names"), F.lit(SPLIT).alias("outcome"))
    whole = told.join(good.hint("merge"), key, "left_anti")
    whole = whole.select(*key, F.lit(1).alias("part"), *BOX, F.coalesce("exact", F.array().cast("array<string>")).alias("names"), F.when(F.col("columns").isNotNull(), SKIPPED).alias("outcome"))
    return split.unionByName(whole)
