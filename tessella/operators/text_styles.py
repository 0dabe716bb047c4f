"""Text of shapes with the properties it inherits: by level, from the run to the master, with theme fonts and colours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = 9
PROPERTIES = ["size", "bold", "italic", "strike", "underline", "ea", "latin", "colour"]
FALLBACK = "fallback"
DEFAULT_SIZE, SMALLEST, LARGEST = 1200, 1.0, 400.0  # hundredths of a point, and points


def defaults_of(defaults: DataFrame, by: list[str]) -> DataFrame:
    """defaults: by, scope (0 for the shape, then its layout, its master), level (1 to 9, null for all) and the
    properties, as they are written, null where not. by, level and each property from the nearest scope that sets
    it, in each scope the level's own before that of all levels."""
    level = F.when(F.col("level").isNull(), F.sequence(F.lit(1), F.lit(LEVELS))).otherwise(F.array(F.col("level").cast("int")))
    rows = defaults.withColumn("_rank", F.col("scope") * 2 + F.col("level").isNull().cast("int")).withColumn("level", F.explode(level))
    return rows.groupBy(*by, "level").agg(*[F.min_by(p, F.when(F.col(p).isNotNull(), F.col("_rank"))).alias(p) for p in PROPERTIES])



def runs(texts: DataFrame, paragraphs: DataFrame, defaults: DataFrame, fonts: DataFrame, colours: DataFrame, by: list[str]) -> DataFrame:
    """texts: by, paragraph, ord, kind (r, fld or br), text and the properties of runs. paragraphs: by, paragraph, level
    (0 to 8, out of range or null: the nearest), bullet, align and the properties of the paragraph's own
    defaults. defaults: of defaults_of(). fonts: name (+mj-ea and the like), value. colours: name as a shape
    writes it, value, the theme's colour behind the colour map.

    by, paragraph, ord (-1 for a bullet), text, family, points, bold, italic, strike, underline, colour and
    alignment (1 left, 2 centre, 3 right). Runs without text are left out, a break is one line feed."""
    key = [*by, "paragraph"]
    level = (F.greatest(F.lit(0), F.least(F.lit(LEVELS - 1), F.coalesce(F.col("level"), F.lit(0)))) + 1).cast("int")
    own = paragraphs.select(*key, level.alias("level"), "bullet", "align", *[F.col(p).alias(f"_own_{p}") for p in PROPERTIES])
    own = own.join(defaults.select(*by, "level", *[F.col(p).alias(f"_far_{p}") for p in PROPERTIES]), [*by, "level"], "left")
    said = F.when(F.col("kind") == "br", "\n").otherwise(F.translate(F.regexp_replace(F.coalesce("text", F.lit("")), r"\r\n?", "\n"), "\t", " "))
    rows = texts.withColumn("text", said).where("text <> ''").join(own, key)
    rows = rows.select(*key, "ord", "text", "align", *[F.coalesce(p, f"_own_{p}", f"_far_{p}").alias(p) for p in PROPERTIES])
    none = [F.lit(None).cast("string").alias(p) for p in PROPERTIES]
    marks = own.where("bullet IS NOT NULL").select(*key, F.lit(-1).alias("ord"), F.concat("bullet", F.lit(" ")).alias("text"), "align", *none)
    rows = rows.unionByName(marks)
    face = F.when(F.trim(F.coalesce("ea", F.lit(""))) != "", F.col("ea")).otherwise(F.col("latin"))
    rows = rows.withColumn("_face", face).join(fonts.select(F.col("name").alias("_face"), F.col("value").alias("_theme")), "_face", "left")
    family = F.coalesce("_theme", F.when((F.trim("_face") != "") & ~F.col("_face").startswith("+"), F.col("_face")), F.lit(FALLBACK))
    rows = rows.join(colours.select(F.col("name").alias("colour"), F.col("value").alias("_colour")), "colour", "left")
    truth = lambda c: F.coalesce(F.col(c).isin("1", "true", "on"), F.lit(False))
    drawn = lambda c, off: F.coalesce((F.col(c) != "") & (F.col(c) != off), F.lit(False))
    points = F.greatest(F.lit(SMALLEST), F.least(F.lit(LARGEST), F.coalesce(F.col("size").try_cast("double"), F.lit(float(DEFAULT_SIZE))) / 100))
    literal = F.when(F.col("colour").rlike(r"\A[0-9A-Fa-f]{6}\z"), F.upper("colour"))
    place = F.when(F.col("align") == "ctr", 2).when(F.col("align") == "r", 3).otherwise(1)
    return rows.select(*key, "ord", "text", family.alias("family"), points.alias("points"), truth("bold").alias("bold"), truth("italic").alias("italic"), drawn("strike", "noStrike").alias("strike"), drawn("underline", "none").alias("underline"), F.coalesce("_colour", literal, F.lit("000000")).alias("colour"), place.alias("alignment"))
