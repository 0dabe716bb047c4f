"""Uniform shuffle into shards of exact sizes by a communication matrix.

Rows lie in hash partitions. How many rows a partition sends to each shard is drawn
exactly: given the room left, a partition's row of the matrix is multivariate
hypergeometric, so the whole is distributed as for a uniform permutation. A partition
permutes its rows and deals them out by its row of the matrix, and each shard permutes
what it got. Shards are cut into fine shards of known sizes.

The matrix comes in two levels. The driver draws that of P coarse partitions and F fine
shards, both at most MAX_PARTS (33 MB), and never sees rows. A coarse partition that
would hold more than PART_ROWS rows is cut into parts, and a task for each draws the
matrix of its parts from its own row. A fine shard is permuted in buckets of random
keys, numbered by the buckets' running counts. So tasks stay at about PART_ROWS rows
whatever the size of the table.
"""

from __future__ import annotations

import math

from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import table

PART_ROWS = 20_000
MAX_PARTS = 2048
_BIG = 500_000_000


def _lgamma_sum(a: float, b: float, c: float, d: float) -> float:
    return math.lgamma(a + 1) + math.lgamma(b + 1) + math.lgamma(c + 1) + math.lgamma(d + 1)


def hypergeometric(good: int, bad: int, sample: int, rng: np.random.Generator) -> int:
    """Exact at any size: numpy's draw up to its limit, else rejection under a
    ratio-of-uniforms hat (Stadlober)."""
    if not sample or not good:
        return 0
    if not bad:
        return sample
    if good + bad < _BIG:
        return int(rng.hypergeometric(good, bad, sample))
    pop, few, many = good + bad, min(good, bad), max(good, bad)
    m = min(sample, pop - sample)
    mean = m * few / pop
    spread = 1.7155277699214135 * math.sqrt((pop - m) * sample * (few / pop) * (many / pop) / (pop - 1) + 0.5) + 0.8989161620588988
    mode = (m + 1) * (few + 1) // (pop + 2)
    top = _lgamma_sum(mode, few - mode, m - mode, many - m + mode)
    while True:
        u, v = 1.0 - rng.random(), rng.random()
        z = math.floor(mean + 0.5 + spread * (v - 0.5) / u)
        if 0 <= z <= min(m, few) and many - m + z >= 0 and 2 * math.log(u) <= top - _lgamma_sum(z, few - z, m - z, many - m + z):
            break
    z = z if good <= bad else m - z
    return z if m == sample else good - z


def matrix(rows: list[int], rooms: list[int], rng: np.random.Generator) -> list[list[int]]:
    """Rows of each partition sent to each shard; sums are ``rows`` and ``rooms``."""
    assert sum(rows) == sum(rooms)
    left, out = list(rooms), []
    for n in rows:
        rest, need, dealt = sum(left), n, []
        for room in left:
            got = hypergeometric(room, rest - room, need, rng)
            dealt.append(got)
            rest, need = rest - room, need - got
        left = [a - b for a, b in zip(left, dealt, strict=True)]
        out.append(dealt)
    return out


def even(total: int, parts: int) -> list[int]:
    return [total // parts + (i < total % parts) for i in range(parts)]


def place(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = 8, *, keep: list[str] | None = None, part_rows: int = PART_ROWS, max_parts: int = MAX_PARTS, seed: int = 29) -> DataFrame:
    """The kept columns (the id, unless given), size, text_crc32, shard and slot of
    every row. Counts of shards differ by one at most, slots have no gaps.

    A null text has no bytes (size 1, crc 0), a text of any length is read whole, and a
    null id is an id like any other; repeated rows take a slot each, equal rows that differ in a
    kept column in an order of their own; an empty table gives
    an empty result; columns not in ``keep`` are not read. A kept column may not be called
    size, text_crc32, shard or slot: that is an error."""
    spark = docs.sparkSession
    keep = [id_col] if keep is None else keep
    if clash := {"size", "text_crc32", "shard", "slot"} & set(keep):
        raise ValueError(f"kept columns named like results: {sorted(clash)}")
    raw = F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8")
    base = docs.select(F.struct(*keep).alias("kept"), F.col(id_col).alias("id"), (F.length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    base = table(base.withColumn("same", F.xxhash64("id", "text_crc32", "size")).withColumn("mark", F.monotonically_increasing_id()))
    n = base.count()
    # Rows alike in all that the keys see would be one task's: where they are more than a task should
    # hold, a mark tells them apart. Others are placed by what they are alone.
    heavy = table(base.groupBy("same").count().where(F.col("count") > part_rows).select("same", F.lit(True).alias("heavy")))
    base = base.join(heavy, "same", "left").withColumn("mark", F.when(F.col("heavy"), F.col("mark")).otherwise(0)).drop("same", "heavy")
    parts = max(1, min(max_parts, -(-n // part_rows)))
    within = max(1, -(-n // (part_rows * parts)))  # parts of a coarse partition
    per_shard = max(1, min(max_parts // shards, -(-parts // shards)))
    key = lambda k: F.xxhash64(F.lit(seed + k), "id", "text_crc32", "size", "mark")
    base = base.withColumn("p", F.pmod(key(0), F.lit(parts)).cast("int")).withColumn("s", F.pmod(key(3), F.lit(within)).cast("int"))

    sizes = base.groupBy("p", "s").count()
    counts = dict(sizes.groupBy("p").agg(F.sum("count")).collect())  # at most max_parts rows
    rows = [counts.get(p, 0) for p in range(parts)]
    coarse = even(n, shards)
    rooms = [r for s in coarse for r in even(s, per_shard)]
    dealt = matrix(rows, rooms, np.random.default_rng(seed))
    fine_lo = [lo for s in coarse for lo in np.cumsum([0, *even(s, per_shard)])[:-1].tolist()]
    drawn = spark.createDataFrame(list(enumerate(dealt)), "p int, dealt array<long>")

    def divide(group: tuple[Any, ...], b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("s")
        own = matrix(b["count"].tolist(), [int(x) for x in b["dealt"].iloc[0]], np.random.default_rng([seed, int(group[0])]))
        ends = [np.cumsum(d).reshape(shards, per_shard).tolist() for d in own]
        return pd.DataFrame({"p": b["p"], "s": b["s"], "ends": ends})

    sent = sizes.join(drawn, "p").groupBy("p").applyInPandas(divide, "p int, s int, ends array<array<long>>")
    order = lambda k: [key(k), "id", "text_crc32", "size", "mark", F.xxhash64("kept")]
    out = base.withColumn("_r", F.row_number().over(Window.partitionBy("p", "s").orderBy(*order(1))) - 1).join(sent, ["p", "s"])
    out = out.withColumn("shard", F.size(F.filter("ends", lambda e: F.element_at(e, -1) <= F.col("_r"))))
    out = out.withColumn("_q", F.size(F.filter(F.element_at("ends", F.col("shard") + 1), lambda e: e <= F.col("_r"))))
    out = out.withColumn("_fine", F.col("shard") * per_shard + F.col("_q")).drop("ends", "_r", "_q", "p", "s")
    lo = spark.createDataFrame([(i, x) for i, x in enumerate(fine_lo)], "_fine int, _lo long")
    buckets = max(1, -(-n // (part_rows * len(rooms))))
    out = out.withColumn("_b", F.pmod(key(4), F.lit(buckets)).cast("int"))
    if buckets > 1:
        out = table(out)
    before = F.coalesce(F.sum("count").over(Window.partitionBy("_fine").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = out.groupBy("_fine", "_b").count().select("_fine", "_b", before.alias("_before")) if buckets > 1 else lo.select("_fine", F.lit(0).alias("_b"), F.lit(0).alias("_before"))
    out = out.withColumn("_k", F.row_number().over(Window.partitionBy("_fine", "_b").orderBy(*order(2))) - 1)
    out = out.join(starts, ["_fine", "_b"]).join(lo, "_fine")
    return out.select("kept.*", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), (F.col("_lo") + F.col("_before") + F.col("_k")).cast("long").alias("slot"))
