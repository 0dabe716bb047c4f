"""Parts of a package and the relationships between them: what is left out, and what the package says of itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph

#: Content types by extension of what a presentation holds (fixed values).
TYPES = {"xml": "application/xml", "rels": "application/vnd.openxmlformats-package.relationships+xml", "png": "image/png", "jpeg": "image/jpeg", "jpg": "image/jpeg", "gif": "image/gif"}


def target(source: Column, reference: Column) -> Column:
    """The part that a relationship of a part names, without . and .. steps; null if it leaves the package."""
    folder = F.when(reference.startswith("/"), F.lit("")).otherwise(F.regexp_replace(source, r"[^/]*\z", ""))
    steps = F.filter(F.split(F.concat(folder, reference), "/"), lambda s: ~s.isin("", "."))

    def walk(acc: Column, step: Column) -> Column:
        deep = F.size(acc) > 0
        return F.when(step != "..", F.concat(acc, F.array(step))).when(deep, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array(F.lit("\0")))

    out = F.array_join(F.aggregate(steps, F.array().cast("array<string>"), walk), "/")
    return F.when(~out.contains("\0"), out)


def finalised(parts: DataFrame, relations: DataFrame, uses: DataFrame, by: str, media: str = "ppt/media/") -> tuple[DataFrame, DataFrame, DataFrame]:
    """parts: by, part. relations: by, source (empty for the package itself), id, type (its last word), target, external. uses:
    by, source, id: the ids that a part's text names.

    The relations that stay (an image that its part does not name goes); the parts that stay, numbered as
    they are packed, with their content type (media that no relation reaches go); and a row for each package with its
    problem, or null: an external reference that is no link, one that leads nowhere, or a vector picture."""
    named = uses.select(by, "source", "id").distinct().withColumn("_used", F.lit(True))
    kept = relations.join(named, [by, "source", "id"], "left").where("type <> 'image' OR _used").drop("_used")
    kept = graph.settled(kept.withColumn("part", F.when(~F.col("external"), target(F.col("source"), F.col("target")))))
    node = lambda c: F.struct(F.col(by).alias("k"), F.col(c).alias("p"))
    # The rounds of the closure read the steps again and again: a table, not the joins behind them.
    steps = graph.settled(kept.where("part IS NOT NULL").select(node("source").alias("a"), node("part").alias("b")).distinct())
    start = parts.select(F.struct(F.col(by).alias("k"), F.lit("").alias("p")).alias("n")).distinct()
    reached = graph.closure(steps, start).select(F.col("n.k").alias(by), F.col("n.p").alias("part"))
    is_media = F.col("part").startswith(media)
    found = parts.join(reached.withColumn("_there", F.lit(True)), [by, "part"], "left").where(~is_media | F.col("_there"))
    extension = F.lower(F.regexp_extract("part", r"\.([A-Za-z0-9]+)\z", 1))
    kind = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])[extension]
    packed = graph.settled(found.select(by, "part", kind.alias("content_type")))
    link = (F.col("type") == "hyperlink") & F.lower("target").rlike(r"\A(https?:|mailto:)")
    there = parts.select(by, "part").withColumn("_is", F.lit(True))
    faults = kept.join(there, [by, "part"], "left")
    why = F.when(F.col("external") & ~link, "EXTERNAL_REFERENCE").when(~F.col("external") & F.col("_is").isNull(), "DANGLING_REFERENCE")
    faults = faults.select(by, why.alias("why")).unionByName(packed.where(F.col("part").startswith(media) & F.lower("part").endswith(".svg")).select(by, F.lit("VECTOR_PICTURE").alias("why")))
    verdict = parts.select(by).distinct().join(faults.groupBy(by).agg(F.min("why").alias("problem")), by, "left")
    return kept, packed, verdict
