"""Blocks, assets, limits and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ranges


def numbered_assets(assets: DataFrame, by: list[str], seq: str = "seq") -> DataFrame:
    """assets: by, seq, category, source_kind, sha256. The first asset of each content,
    numbered by category in order of first sight, and its path."""
    key = [*by, "source_kind", "sha256"]
    first = assets.groupBy(*key).agg(F.min(F.struct(seq, "category")).alias("m"), F.count("*").alias("uses")).select(*key, "uses", f"m.{seq}", "m.category")
    numbered = ranges.running(first, list(dict.fromkeys([*by, "category"])), seq, {"number": F.lit(1)})
    return numbered.withColumn("path", F.format_string("images/%s-%04d.bin", "category", "number"))


def running_limit(rows: DataFrame, by: list[str], seq: str, size: Column, most: int) -> DataFrame:
    """Adds total (running) and over: whether the limit is passed; 0 means none."""
    out = ranges.running(rows, by, seq, {"total": size})
    return out.withColumn("over", (F.col("total") > most) if most else F.lit(False))


def combined_limit(*most: Column) -> Column:
    """The limit of several amounts together: their sum, or none (0) if one of them has none."""
    total, free = most[0], most[0] == 0
    for m in most[1:]:
        total, free = total + m, free | (m == 0)
    return F.when(free, 0).otherwise(total)


def limited(rows: DataFrame, by: list[str], seq: str, limits: dict[str, tuple[Column, Column]]) -> DataFrame:
    """limits: by code, in the order in which they are looked at, what a row adds and the most of its group (0: none). by,
    code and at (the row's place) of the first limit that is passed, and the group's totals as n_<code>; a group that
    stays within all has no code."""
    names = [f"_n{i}" for i in range(len(limits))]
    most = {f"_most{i}": m for i, (_, m) in enumerate(limits.values())}
    held = rows.withColumns(most)
    out = ranges.running(held, by, seq, {n: size for n, (size, _) in zip(names, limits.values(), strict=True)})
    passed = [F.when((F.col(f"_most{i}") > 0) & (F.col(n) > F.col(f"_most{i}")), F.struct(F.col(seq).alias("at"), F.lit(i).alias("rank"), F.lit(code).alias("code"))) for i, (n, code) in enumerate(zip(names, limits, strict=True))]
    first = F.array_min(F.filter(F.array(*passed), lambda x: x.isNotNull()))
    told = out.withColumn("_first", first).groupBy(*by).agg(F.min("_first").alias("_f"), *[F.max(n).alias(f"n_{code}") for n, code in zip(names, limits, strict=True)])
    return told.select(*by, F.col("_f.code").alias("code"), F.col("_f.at").alias("at"), *[f"n_{code}" for code in limits])


def capped_diagnostics(notes: DataFrame, by: list[str], key: list[str], seq: str, cap: int) -> DataFrame:
    """by, kept, omitted. A note is kept the first time its key is seen; once ``cap``
    are kept, all that follow count as omitted, repeats included."""
    first = F.row_number().over(Window.partitionBy(*by, *key).orderBy(seq)) == 1
    marked = ranges.running(notes.withColumn("_first", first.cast("int")), by, seq, {"_n": F.col("_first")})
    kept = F.sum(F.when((F.col("_first") == 1) & (F.col("_n") <= cap), 1).otherwise(0))
    # After the note that filled the cap, whatever comes is omitted.
    full = (F.col("_n") > cap) | ((F.col("_n") == cap) & (F.col("_first") == 0))
    return marked.groupBy(*by).agg(kept.alias("kept"), F.sum(F.when(full, 1).otherwise(0)).alias("omitted"))


def placed(blocks: DataFrame, by: list[str]) -> DataFrame:
    """blocks: by, kind, row, col, ord, markdown. Order by (row, col, ord), unknown places
    last; start and end lines in the assembled text. A text block right below another
    continues it with a line break, any other follows a blank line."""
    order = Window.partitionBy(*by).orderBy(F.coalesce("row", F.lit(2**31 - 1)), F.coalesce("col", F.lit(2**31 - 1)), "ord")
    joined = (F.col("kind") == "text") & (F.lag("kind").over(order) == "text") & (F.lag("row").over(order) == F.col("row") - 1)
    out = blocks.withColumn("position", F.row_number().over(order)).withColumn("_joined", F.coalesce(joined, F.lit(False)))
    lines = F.length("markdown") - F.length(F.replace("markdown", F.lit("\n"), F.lit(""))) + 1
    gap = F.when(F.col("position") == 1, 0).when(F.col("_joined"), 0).otherwise(1)
    out = out.withColumn("_lines", lines).withColumn("_gap", gap)
    end = F.sum(F.col("_lines") + F.col("_gap")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    separator = F.when(F.col("position") == 1, "").when(F.col("_joined"), "  \n").otherwise("\n\n")
    return out.withColumn("end_line", end).withColumn("start_line", end - F.col("_lines") + 1).withColumn("separator", separator).drop("_joined", "_lines", "_gap")


def assembled(placed_blocks: DataFrame, by: list[str]) -> DataFrame:
    """One Markdown text for each document."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("position", "separator", "markdown"))), lambda b: F.concat(b["separator"], b["markdown"]))
    return placed_blocks.groupBy(*by).agg(F.array_join(parts, "").alias("markdown"))


#: Warnings that leave a result complete (fixed values).
BENIGN = ("FONT_SUBSTITUTED", "FORMULA_CACHED_VALUE", "RANGE_SCALED", "DRAWING_PAGINATION", "HORIZONTAL_PAGINATION")


def outcome(code: Column) -> Column:
    """complete or partial, over the warnings of a group."""
    return F.when(F.coalesce(F.bool_or(~code.isin(*BENIGN)), F.lit(False)), "partial").otherwise("complete")
