"""SimHash near duplicates by multi-index hashing.

A text's fingerprint has a bit for each bit that is set in over half of its shingles'
hashes. Fingerprints link at DISTANCE or fewer differing bits. Of two such fingerprints, cut
into two segments of 32 bits, one segment differs in RADIUS = DISTANCE // 2 bits at most:

1. Each distinct fingerprint stands in a table under both of its segments.
2. It asks, by segment, for every value of the Hamming ball of RADIUS around its own; a
   table match is verified on the complete distance.
3. A segment value with more than HOT fingerprints is not paired up. Its fingerprints and those that
   asked for it meet at values of the other segment instead: those of the bucket at all values within one
   bit, the askers at all within the bits that remain. Whoever meets at a value is within DISTANCE, all of
   them, so one star per value holds the links' components, whatever the size of the bucket.
4. Components of the links come from large-star / small-star rounds over tables.

A fingerprint makes 66 questions, and 562 rows in a hot bucket: a constant of the method. Every
side of a join grows with the texts, so all are merge joins: none is sent through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, returned, small_batches, table
from .near_dup import components

NGRAM = 3
SEED = 42
DISTANCE = 3
RADIUS = DISTANCE // 2
HOT = 128
_CHUNK = 1 << 16
_LOW = (1 << 32) - 1


def fingerprint(text: str | None) -> int:
    """64 bits; 0 for a text without words. A-Z are lower-cased; a text of one or two words
    is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = min(NGRAM, len(words))
    total, ones = len(words) - n + 1, np.zeros(64, np.int64)
    for at in range(0, total, _CHUNK):
        part = words[at : at + _CHUNK + n - 1]
        joined = b" ".join(part)
        sizes = np.fromiter(map(len, part), np.int64, len(part))
        ends = np.cumsum(sizes + 1) - 1
        starts, ends = (ends - sizes)[: len(part) - n + 1].tolist(), ends[n - 1 :].tolist()
        h = np.fromiter((xxhash.xxh64_intdigest(joined[a:z], SEED) for a, z in zip(starts, ends, strict=True)), "<u8", len(starts))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(i) for i in np.flatnonzero(2 * ones > total))


def fingerprinted(rows: DataFrame) -> DataFrame:
    """rows: id, text. id and fp, the fingerprint as a signed long."""
    small_batches(rows.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = np.fromiter(map(fingerprint, b["text"]), np.uint64, len(b))
            yield pd.DataFrame({"id": b["id"], "fp": found.view(np.int64)})
        returned()

    return rows.mapInPandas(run, f"id {dict(rows.dtypes)['id']}, fp long")


def ball(value: Column, radius: int, bits: int = 32) -> Column:
    """All values within radius (2 at most) of a segment's value."""
    one = [1 << i for i in range(bits)]
    masks = [0, *one] + ([a | b for i, a in enumerate(one) for b in one[i + 1 :]] if radius > 1 else [])
    return F.transform(F.lit(masks).cast("array<long>"), lambda m: value.bitwiseXOR(m))


def links(prints: DataFrame, hot: int = HOT) -> DataFrame:
    """prints: fp, each once. Edges u, v whose components are those of all pairs within
    DISTANCE; every pair of a bucket of at most ``hot`` fingerprints is an edge of its own."""
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(_LOW)
    both = F.array(F.struct(F.lit(0).alias("seg"), high.alias("own"), low.alias("other")), F.struct(F.lit(1).alias("seg"), low.alias("own"), high.alias("other")))
    homes = prints.select("fp", F.explode(both).alias("s")).select("fp", "s.*")
    full = table(homes.groupBy("seg", "own").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("seg", "own"))
    cold = homes.join(full.hint("merge"), ["seg", "own"], "left_anti").select("seg", F.col("own").alias("value"), F.col("fp").alias("home"))
    marks = full.select("seg", F.col("own").alias("value"), F.lit(None).cast("long").alias("home"))
    index = table(cold.unionByName(marks))
    asked = homes.select("fp", "seg", "own", "other", F.explode(ball(F.col("own"), RADIUS)).alias("value"))
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("home"))) <= DISTANCE
    met = asked.join(index.hint("merge"), ["seg", "value"]).where(F.col("home").isNull() | ((F.col("fp") < F.col("home")) & near))
    met = table(met.select("fp", "home", "seg", "value", "other", (F.col("own") == F.col("value")).alias("inside")))
    release(full, index)
    pairs = met.where("home is not null").select(F.col("fp").alias("u"), F.col("home").alias("v"))
    crowd = met.where("home is null")
    meeting = ["seg", "value", "at"]
    first = crowd.where("inside").select("seg", "value", "fp", F.explode(ball(F.col("other"), 1)).alias("at")).groupBy(*meeting).agg(F.min("fp").alias("root"))
    reach = F.when(F.col("inside"), ball(F.col("other"), 2)).otherwise(ball(F.col("other"), 1))
    stars = crowd.select("seg", "value", "fp", F.explode(reach).alias("at")).join(first.hint("merge"), meeting).where("fp != root")
    return pairs.unionByName(stars.select(F.col("fp").alias("u"), F.col("root").alias("v")).distinct())


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, hot: int = HOT) -> DataFrame:
    """id, fp (signed long), component_id (the least id reachable over links, itself included)
    and copies (rows of the same fingerprint).

    A null text is an empty one; texts without words have the fingerprint 0 and link like any
    other. Texts of any length are read whole. Repeated rows are copies. A null id is never
    the least; a component of null ids alone has none. Other columns are not read; an empty
    table gives an empty result. The table behind the result lives in the shared folder
    until the caller deletes it."""
    signed = table(fingerprinted(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))))
    classes = table(signed.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("copies")))
    roots = components(links(classes.select("fp"), hot)).withColumnRenamed("u", "fp")
    named = table(classes.join(roots.hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    least = table(named.groupBy("root").agg(F.min("least").alias("component_id")))
    told = table(named.join(least.hint("merge"), "root").select("fp", "component_id", "copies"))
    release(classes, named, least)
    return signed.join(told.hint("merge"), "fp").select(F.col("id").alias(id_col), "fp", "component_id", "copies")
