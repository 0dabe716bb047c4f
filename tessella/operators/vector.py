"""Vector pictures as nodes: references between their elements and bounds on what they expand to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import expansion

HREFS = ("href", "xlink:href")


def references(nodes: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """nodes: by, node_id, parent_id, name, attrs (of sources.html.nodes). The uses (by, node, target)
    of elements by href and by url(#...) in any attribute, and the ids that stand twice (by, id)."""
    elements = nodes.where("name <> '#text'")
    ids = elements.select(*by, F.col("node_id").alias("target"), F.col("attrs")["id"].alias("id")).where("id <> ''")
    named = ids.groupBy(*by, "id").agg(F.min("target").alias("target"), F.count("*").alias("n"))
    links = F.transform(F.array(*[F.col("attrs")[h] for h in HREFS]), lambda v: F.when(v.startswith("#"), F.substring(v, 2, 1 << 20)))
    first = F.filter(links, lambda v: v.isNotNull())
    paints = F.flatten(F.transform(F.map_values("attrs"), lambda v: F.regexp_extract_all(v, F.lit(r"""(?i)url\(\s*["']?\s*#([^"')\s]+)"""), 1)))
    used = F.when(F.col("name") == "image", F.array().cast("array<string>")).otherwise(F.concat(F.slice(first, 1, 1), paints))
    uses = elements.select(*by, F.col("node_id").alias("node"), F.explode(used).alias("id"))
    return uses.join(named, [*by, "id"]).select(*by, "node", "target"), named.where("n > 1").select(*by, "id")


def complexity(nodes: DataFrame, by: list[str], most: int = expansion.MOST_NODES, depth: int = expansion.MOST_DEPTH) -> DataFrame:
    """by, n_nodes and deepest as written, n_expanded and the first reason why a picture is too complex,
    or null: its nodes or their depth, an id that stands twice, a cycle, or its expansion."""
    refs, twice = references(nodes, by)
    plain = nodes.groupBy(*by).agg(F.count("*").alias("n_nodes"), F.max("depth").alias("deepest"))
    tree = nodes.where("name <> '#text'").select(*by, F.col("node_id").alias("node"), F.when(F.col("parent_id") >= 0, F.col("parent_id")).alias("parent"))
    told = expansion.checked(tree, refs, by, most, depth)
    told = told.groupBy(*by).agg(F.sum("size").alias("n_expanded"), F.min("problem").alias("expanded_problem"))
    out = plain.join(told, by, "left").join(twice.select(*by).distinct().withColumn("_twice", F.lit(True)), by, "left")
    why = F.when((F.col("n_nodes") > most) | (F.col("deepest") > depth), "COMPLEXITY").when(F.col("_twice"), "DUPLICATE_ID").otherwise(F.col("expanded_problem"))
    return out.select(*by, "n_nodes", "deepest", F.when(F.col("expanded_problem").isNull(), F.col("n_expanded")).alias("n_expanded"), why.alias("problem"))
