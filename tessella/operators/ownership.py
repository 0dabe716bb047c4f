"""Who owns a slide's objects: targets of effects, and ids given anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def targets(claims: DataFrame, shapes: DataFrame, by: list[str]) -> DataFrame:
    """claims: by, effect, shape: a row for each object that an effect would move, and one with a null shape
    for an effect without any; reason, if given, is why an effect is out already. shapes: by, shape, pos, in
    paint order. by, effect, first (the place of its group) and reason, or null: a target that is not on
    the slide, targets with other objects between them, or a target that another effect, itself
    without a reason, claims too; then all rivals are out."""
    key = [*by, "effect"]
    claims = claims if "reason" in claims.columns else claims.withColumn("reason", F.lit(None).cast("string"))
    each = claims.select(*key, "shape", "reason").distinct().join(shapes.select(*by, "shape", "pos"), [*by, "shape"], "left")
    own = each.groupBy(*key).agg(F.min("reason").alias("_had"), F.count_if(F.col("pos").isNull()).alias("_lost"), F.count("*").alias("_n"), F.min("pos").alias("first"), F.max("pos").alias("_last"))
    apart = F.col("_last") - F.col("first") + 1 != F.col("_n")
    own = own.withColumn("_why", F.coalesce("_had", F.when(F.col("_lost") > 0, "unresolved_target").when(apart, "interleaved_target")))
    rivals = each.join(own.where("_why IS NULL").select(*key), key, "left_semi").withColumn("_rivals", F.count("*").over(Window.partitionBy(*by, "shape")))
    shared = rivals.where("_rivals > 1").select(*key).distinct().withColumn("_shared", F.lit("shared_target"))
    out = own.join(shared, key, "left")
    return out.select(*key, F.when(F.coalesce("_why", "_shared").isNull(), F.col("first")).alias("first"), F.coalesce("_why", "_shared").alias("reason"))


def renumbered(objects: DataFrame, by: list[str]) -> DataFrame:
    """objects: by, id, pos. Adds new_id, from 1 in document order."""
    return objects.withColumn("new_id", F.row_number().over(Window.partitionBy(*by).orderBy("pos")))


def reconnected(connectors: DataFrame, objects: DataFrame, by: list[str]) -> DataFrame:
    """connectors: by, connector, start_id, end_id (null where an end is free). objects: of renumbered(). The
    ends under their new ids, and error: a saved id that stands twice or nowhere cannot be told."""
    known = objects.groupBy(*by, "id").agg(F.count("*").alias("_n"), F.min("new_id").alias("_new"))
    out = connectors
    for end in ("start", "end"):
        out = out.join(known.withColumnsRenamed({"id": f"{end}_id", "_n": f"_n_{end}", "_new": f"{end}_new"}), [*by, f"{end}_id"], "left")
    bad = lambda end: F.col(f"{end}_id").isNotNull() & (F.coalesce(f"_n_{end}", F.lit(0)) != 1)
    error = F.when(bad("start") | bad("end"), "OUTPUT_INVALID")
    return out.select(*by, "connector", *[F.when(F.col(f"_n_{e}") == 1, F.col(f"{e}_new")).alias(f"{e}_id") for e in ("start", "end")], error.alias("error"))
