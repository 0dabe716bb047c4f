"""Animations of one element joined into one: samples of several curves on a common axis of time."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How channels of several animations work together: sums, and products (fixed values).
SUMS, PRODUCTS = ("x", "y", "rotation"), ("scaleX", "scaleY", "opacity")
CHANNELS = SUMS + PRODUCTS
MOST_TIMES, SAME_TIME, MOST_TURN, LONGEST = 257, 1e-7, 90.001, 3_600_000
#: By how much two limits at a boundary may differ (fixed values).
CLOSE = {"x": 0.05, "y": 0.05, "rotation": 0.05, "scaleX": 1e-4, "scaleY": 1e-4, "opacity": 1e-4}


def times(samples: DataFrame, by: list[str]) -> DataFrame:
    """samples: by, member, t. by, t: the times of all members, those within SAME_TIME of the one before them once."""
    gap = F.col("t") - F.lag("t").over(Window.partitionBy(*by).orderBy("t"))
    return samples.select(*by, "t").distinct().withColumn("_gap", gap).where(f"_gap IS NULL OR _gap > {SAME_TIME}").drop("_gap")


def sampled(samples: DataFrame, at: DataFrame, by: list[str]) -> DataFrame:
    """samples: by, member, t and the channels. at: by, member, t. The members' values at these times: between
    the last sample before and the first one after, as far between as the time is; beyond its ends a
    member keeps its first or last value."""
    line = Window.partitionBy(*by, "member").orderBy("t", "_asked")
    packed = F.struct("t", *CHANNELS)
    rows = samples.select(*by, "member", "t", F.lit(0).alias("_asked"), packed.alias("_s")).unionByName(at.select(*by, "member", "t", F.lit(1).alias("_asked")), allowMissingColumns=True)
    before = F.last("_s", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_s", ignorenulls=True).over(line.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.select(*by, "member", "t", "_asked", before.alias("_b"), after.alias("_a")).where("_asked = 1")
    share = F.when(F.col("_a.t") > F.col("_b.t"), (F.col("t") - F.col("_b.t")) / (F.col("_a.t") - F.col("_b.t"))).otherwise(0.0)
    value = lambda c: F.when(F.col("_b").isNull(), F.col(f"_a.{c}")).when(F.col("_a").isNull(), F.col(f"_b.{c}")).otherwise(F.col(f"_b.{c}") + share * (F.col(f"_a.{c}") - F.col(f"_b.{c}")))
    return rows.select(*by, "member", "t", *[value(c).alias(c) for c in CHANNELS])


def _joined(rows: DataFrame, key: list[str]) -> DataFrame:
    """One row for each key: sums and products over its members."""
    total = [F.sum(c).alias(c) for c in SUMS]
    every = [F.collect_list(F.struct("member", c)).alias(c) for c in PRODUCTS]
    out = rows.groupBy(*key).agg(*total, *every)
    product = lambda c: F.aggregate(F.array_sort(F.col(c)), F.lit(1.0), lambda p, x: p * x[c])
    return out.select(*key, *SUMS, *[product(c).alias(c) for c in PRODUCTS])


def composed(samples: DataFrame, by: list[str]) -> DataFrame:
    """samples: by (an element), member, t in milliseconds and the channels. by, t and the joint channels at the
    times of all members, so that no short animation is lost in a long one."""
    members = samples.select(*by, "member").distinct()
    axis = times(samples, by).join(members, by)
    return _joined(sampled(samples, axis, by), [*by, "t"])


def reasons(samples: DataFrame, by: list[str]) -> DataFrame:
    """by and the first reason why an element's animations cannot be one, or null: they last too long, have
    too many times, turn by more than a quarter between two of them, or jump where one of them begins or
    ends (the limits from both sides, each from two points well inside, against the value itself)."""
    spans = samples.groupBy(*by, "member").agg(F.min("t").alias("start"), F.max("t").alias("end"))
    whole = spans.groupBy(*by).agg((F.max("end") - F.min("start")).alias("length"), F.min("start").alias("first"), F.max("end").alias("last"))
    count = times(samples, by).groupBy(*by).agg(F.count("*").alias("n_times"))
    joint = composed(samples, by)
    turn = F.abs(F.col("rotation") - F.lag("rotation").over(Window.partitionBy(*by).orderBy("t")))
    turns = joint.withColumn("_turn", turn).groupBy(*by).agg(F.max("_turn").alias("turn"))
    edges = spans.select(*by, F.explode(F.array("start", "end")).alias("edge")).distinct().where("edge > 0")
    line = Window.partitionBy(*by).orderBy("edge")
    edges = edges.withColumn("_was", F.coalesce(F.lag("edge").over(line), F.lit(0.0))).withColumn("_next", F.lead("edge").over(line))
    step = F.least(F.lit(0.01), (F.col("edge") - F.col("_was")) / 4, F.coalesce((F.col("_next") - F.col("edge")) / 4, F.lit(0.01)))
    edges = edges.withColumn("_e", step)
    probe = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), (F.col("edge") + k * F.col("_e")).alias("t")) for k in (-2, -1, 0, 1, 2)]))
    probes = edges.select(*by, "edge", "_e", probe.alias("p")).select(*by, "edge", "_e", "p.k", "p.t")
    at = probes.select(*by, "t").distinct().join(samples.select(*by, "member").distinct(), by)
    seen = probes.join(_joined(sampled(samples, at, by), [*by, "t"]), [*by, "t"])
    value = lambda c, k: F.max(F.when(F.col("k") == k, F.col(c)))

    def apart(c: str) -> Column:
        left, right = 2 * value(c, -1) - value(c, -2), 2 * value(c, 1) - value(c, 2)
        return (F.abs(left - value(c, 0)) >= CLOSE[c]) | (F.abs(right - value(c, 0)) >= CLOSE[c])

    # At the last edge nothing follows: the end is held.
    jumps = seen.groupBy(*by, "edge").agg((reduce(lambda a, b: a | b, [apart(c) for c in CHANNELS]) | (F.max("_e") < 0.001)).alias("_jump"))
    jumps = jumps.groupBy(*by).agg(F.bool_or("_jump").alias("jumps"))
    out = whole.join(count, by).join(turns, by).join(jumps, by, "left")
    why = F.when(F.col("length") > LONGEST, "unsupported-timing").when(F.col("n_times") > MOST_TIMES, "too-many-keyframes").when(F.col("turn") > MOST_TURN, "unsupported-transform").when(F.col("jumps"), "discontinuous-composition")
    return out.select(*by, "n_times", why.alias("reason"))
