"""Mixing sources to target weights, with DataFrame functions only.

Each source is a stream of words in a pseudorandom document order, cut into
blocks of a fixed length. Every slot of every output shard draws its source
from the target distribution, which makes the counts of a shard a multinomial
draw; the few slots drawn beyond a source's quota are passed on to sources
below theirs, so the totals are exact. A slot of rank i in its source reads
block perm(i), where perm is a keyed permutation of the source's block indices
(swap-or-not), another one on each pass. Slots and blocks meet in an equi-join.

Scale: rows that move are (document, offset) and (slot, block) pairs; texts move
once, where they are asked for. The running offsets use (source, hash bucket) windows
and a prefix over bucket totals; buckets grow with the rows, so a source with a third of
all rows is spread over at least BUCKETS tasks of bounded size. What passes one task is a
row for each source, and of one source a row for each of its buckets or output shards.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import few, locate, n_words, opened, sealed, table

BLOCK = 256  # words in a block
SHARD_SLOTS = 4096  # blocks in an output shard
BUCKETS = 1024  # hash buckets of one source, at least
BUCKET_ROWS = 1 << 15  # documents for each bucket beyond
WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
ROUNDS = 16
SLICE = 1 << 16


def permuted(index: Column, n: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """A keyed bijection of 0..n-1 (swap-or-not shuffle): each round pairs x with
    its mirror k - x and swaps the two on a hash bit of the larger."""

    def turn(x: Column, r: Column) -> Column:
        mirror = F.pmod(F.pmod(F.xxhash64(key, r), n) - x, n)
        return F.when(F.pmod(F.xxhash64(key, r, F.greatest(x, mirror)), F.lit(2)) == 1, mirror).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), index.cast("long"), turn)


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """sizes: src, src_name, source_size. Adds the target in words.

    Sources by code point, null last, weigh ``weights`` in turn and share
    ``share`` of all words; none gets more than ``cap`` times its own. The level
    at which min(cap * size, weight * level) sums up to the share is the
    greatest root of its linear pieces, since that sum is concave."""
    whole = Window.partitionBy()
    by_name = Window.orderBy(F.col("src_name").isNull(), "src_name")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    out = sizes.withColumn("_w", weight).withColumn("_most", F.lit(float(cap)) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("_most") / F.col("_w"), "src").rowsBetween(Window.unboundedPreceding, -1)
    full, spent = F.coalesce(F.sum("_most").over(by_ratio), F.lit(0.0)), F.coalesce(F.sum("_w").over(by_ratio), F.lit(0.0))
    out = out.withColumn("_root", (F.lit(float(share)) * F.sum("source_size").over(whole) - full) / (F.sum("_w").over(whole) - spent))
    level = F.max("_root").over(whole)
    return out.withColumn("target", F.least("_most", F.col("_w") * level)).drop("_w", "_most", "_root")


@dataclass
class Mix:
    docs: DataFrame  # the kept columns, id, mark, src, row key (bucket, row), size, lo: the offset in its source
    sources: DataFrame  # src, src_name, source_size, target
    slots: DataFrame | None  # shard, slot, src, pass, block, take: one row for each block of the mix

    def pieces(self) -> DataFrame:
        """One row for each (document, block) overlap: at, end within the block."""
        d = self.docs.select("src", "bucket", "row", "size", "lo").where("size > 0")
        d = d.withColumn("block", F.explode(F.sequence(F.expr(f"lo div {BLOCK}"), F.expr(f"(lo + size - 1) div {BLOCK}"))))
        start = F.col("block") * BLOCK
        return d.withColumn("at", F.greatest(F.col("lo") - start, F.lit(0))).withColumn("end", F.least(F.col("lo") + F.col("size") - start, F.lit(BLOCK)))


def marked(docs: DataFrame, id_col: str) -> DataFrame:
    """docs with id (never null) and mark, a hash of all columns that can be hashed: rows
    that agree in both count as equal and may stand for each other."""
    plain = [F.col(c) for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    name = F.when(F.col(id_col).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(id_col).cast("string")))
    return docs.withColumns({"id": name, "mark": F.xxhash64(*plain)})


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = 17, keep: list[str] | None = None) -> Mix:
    """Null texts have size 0, a null source is a source of its own (last), a text of any
    length is cut into blocks, repeated rows count each, an empty table gives an empty mix.
    Other columns
    are not read unless they are in ``keep``, which may not name a column size, source_size,
    target or taken: that is an error. The same rows give the same mix,
    however they are partitioned."""
    keep = [id_col] if keep is None else keep
    if clash := {"size", "source_size", "target", "taken"} & set(keep):
        raise ValueError(f"kept columns named like results: {sorted(clash)}")
    src = F.when(F.col(source_col).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(source_col)))
    plain, names = sealed(docs)
    rows = marked(plain, names[id_col]).select(F.struct(*[F.col(names[c]).alias(c) for c in keep]).alias("kept"), "id", "mark", *[F.col(names[c]).alias(c) for c in dict.fromkeys([text_col, source_col]) if c not in ("id", "mark")])
    sized = rows.select("kept", "id", "mark", src.alias("src"), F.col(source_col).alias("src_name"), n_words(F.col(text_col)).alias("size"))
    sized = table(sized.withColumn("h", F.xxhash64(F.lit(seed), "id", "size")))
    buckets = max(BUCKETS, -(-sized.count() // BUCKET_ROWS))
    sized = sized.withColumn("bucket", F.pmod("h", F.lit(buckets)))

    per_bucket = sized.groupBy("src", "src_name", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = per_bucket.select("src", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("src", "bucket").orderBy("h", "id", "size", "mark")
    offset = F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    laid = sized.withColumn("row", F.row_number().over(inside)).withColumn("_in", offset)
    laid = laid.join(starts, ["src", "bucket"]).select("kept", "id", "mark", "src", "bucket", "row", "size", (F.col("base") + F.col("_in")).alias("lo"))

    sources = per_bucket.groupBy("src", "src_name").agg(F.sum("words").alias("source_size"))
    sources = table(targets(sources, weights, share, cap))
    laid = table(laid)
    return Mix(laid, sources, draw(sources, seed))


def draw(sources: DataFrame, seed: int) -> DataFrame | None:
    spark = sources.sparkSession
    n, full = F.col("source_size"), F.expr(f"source_size div {BLOCK}")
    quota = sources.where("source_size > 0").select("src", n.alias("n"), F.floor(F.col("target") + 1e-6).alias("take_all")).withColumn("full", F.expr(f"n div {BLOCK}")).withColumn("blocks", F.expr(f"(n + {BLOCK - 1}) div {BLOCK}"))
    quota = quota.withColumn("quota", F.expr(f"(take_all div n) * blocks + ((take_all % n) + {BLOCK - 1}) div {BLOCK}"))
    total = quota.agg(F.sum("quota")).first()[0]
    if not total:
        return None
    upto = Window.orderBy("src").rowsBetween(Window.unboundedPreceding, -1)
    quota = quota.withColumn("lo", F.coalesce(F.sum("quota").over(upto), F.lit(0))).withColumn("len", F.col("quota"))

    # The draw: shard k's counts by source are a multinomial sample.
    slots = spark.range(total).select(F.col("id").alias("slot"), F.expr(f"id div {SHARD_SLOTS}").alias("shard"), F.pmod(F.xxhash64(F.lit(seed), F.lit("slot"), "id"), F.lit(total)).alias("u"))
    slots = table(locate(slots, "u", quota, ["src"], SLICE).drop("u"))
    counts = slots.groupBy("shard", "src").agg(F.count("*").alias("c"))
    earlier = Window.partitionBy("src").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("base", F.coalesce(F.sum("c").over(earlier), F.lit(0)))
    drawn = counts.groupBy("src").agg(F.sum("c").alias("drawn"))
    state = quota.drop("lo", "len").join(drawn, "src", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    state = state.withColumn("over", F.greatest(F.col("drawn") - F.col("quota"), F.lit(0))).withColumn("under", F.greatest(F.col("quota") - F.col("drawn"), F.lit(0)))
    state = state.withColumn("over_lo", F.coalesce(F.sum("over").over(upto), F.lit(0))).withColumn("under_lo", F.coalesce(F.sum("under").over(upto), F.lit(0)))
    state = table(state)

    shape = ["n", "take_all", "full", "blocks"]
    counts = counts.drop("c").join(state.select("src", "quota", "over_lo", *shape), "src")
    in_shard = Window.partitionBy("shard", "src").orderBy("slot")
    ranked = slots.withColumn("_r", F.row_number().over(in_shard) - 1).join(counts, ["shard", "src"]).withColumn("i", F.col("base") + F.col("_r"))
    ranked = table(ranked.select("shard", "slot", "src", "i", "quota", "over_lo", *shape))
    within = ranked.where("i < quota").select("shard", "slot", "src", "i", *shape)
    spare = ranked.where("i >= quota").select("shard", "slot", (F.col("over_lo") + F.col("i") - F.col("quota")).alias("e"))
    gaps = state.select(F.col("under_lo").alias("lo"), F.col("under").alias("len"), "under_lo", "drawn", "src", *shape)
    moved = locate(spare, "e", gaps, ["under_lo", "drawn", "src", *shape], SLICE)
    moved = moved.select("shard", "slot", "src", (F.col("drawn") + F.col("e") - F.col("under_lo")).alias("i"), *shape)

    out = within.unionByName(moved).withColumn("pass", F.expr("i div blocks")).withColumn("j", F.expr("i % blocks"))
    picked = permuted(F.col("j"), F.greatest("full", F.lit(1)), F.xxhash64(F.lit(seed), F.lit("perm"), "src", "pass"))
    out = out.withColumn("block", F.when(F.col("j") >= F.col("full"), F.col("full")).otherwise(picked))
    length = F.least(F.lit(BLOCK), F.col("n") - F.col("block") * BLOCK)
    left = F.col("take_all") - F.col("pass") * F.col("n") - F.col("j") * BLOCK
    return out.select("shard", "slot", "src", "pass", "block", F.least(length, left).alias("take"), (left < length).alias("cut"))


def taken(mix: Mix) -> DataFrame:
    """doc columns, size, source_size, target and the words that the mix takes."""
    key = ["src", "bucket", "row"]
    if mix.slots is None:
        got = mix.docs.select(*key).where("false").withColumn("taken", F.lit(0).cast("long"))
    else:
        reads = mix.slots.groupBy("src", "block").agg(F.sum(F.when(F.col("cut"), 0).otherwise(1)).alias("whole"), F.coalesce(F.max(F.when(F.col("cut"), F.col("take"))), F.lit(0)).alias("part"))
        got = mix.pieces().join(reads, ["src", "block"])
        got = got.withColumn("w", F.col("whole") * (F.col("end") - F.col("at")) + F.greatest(F.least("end", "part") - F.col("at"), F.lit(0)))
        got = got.groupBy(*key).agg(F.sum("w").alias("taken"))
    out = mix.docs.join(got, key, "left").join(F.broadcast(mix.sources) if few(mix.sources) else mix.sources, "src")
    return out.select("kept.*", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_texts(docs: DataFrame, mix: Mix, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs as the mix takes them: each row once for every pass that takes words of it,
    with the words taken in that pass (the text itself if all were), each with the white
    space that follows it. docs: the rows that the mix was planned for. Texts are shuffled
    once, by id and mark.

    Null and empty texts have no words and are not taken; a text of any length is cut where
    the mix cuts it; repeated rows stand for each other; all columns stay, whatever their
    names. An empty table or mix gives an empty result."""
    if mix.slots is None:
        return docs.where("false")
    key = ["src", "bucket", "row"]
    runs = mix.pieces().join(mix.slots.select("src", "block", "pass", "take"), ["src", "block"])
    runs = runs.withColumn("end", F.least("end", "take")).where("end > at")
    at = F.col("block") * BLOCK + F.col("at") - F.col("lo")
    runs = runs.select(*key, "pass", "size", F.struct(at.alias("a"), (at + F.col("end") - F.col("at")).alias("b")).alias("run"))
    runs = runs.groupBy(*key, "pass", "size").agg(F.array_sort(F.collect_list("run")).alias("runs"), F.sum(F.expr("run.b - run.a")).alias("got"))
    runs = runs.join(mix.docs.select(*key, "id", "mark"), key).select("id", "mark", "pass", "runs", (F.col("got") == F.col("size")).alias("whole"))

    plain, names = sealed(docs)
    first = F.row_number().over(Window.partitionBy("id", "mark").orderBy("mark"))
    texts = marked(plain, names[id_col]).withColumn("_first", first).where("_first = 1")
    text = F.col(names[text_col])
    # Each unit is a word with the white space after it. The outer lambda holds the units, so
    # that a text is split once and not once for every run.
    units = F.split(F.regexp_replace(text, r"\A[\x20\x09-\x0D]+", ""), r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    cut = lambda u: F.flatten(F.transform("runs", lambda r: F.slice(u, (r["a"] + 1).cast("int"), (r["b"] - r["a"]).cast("int"))))
    some = F.array_join(F.element_at(F.transform(F.array(units), cut), 1), "")
    out = texts.join(runs, ["id", "mark"]).withColumn(names[text_col], F.when(F.col("whole"), text).otherwise(some))
    return opened(out, names)
