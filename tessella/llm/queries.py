"""Queries over whole tables with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read
from .sql import SQL  # noqa: F401


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import mixing

    return mixing.taken(mixing.plan(read(spark, sf_dir, "documents").select("doc_id", "text", "source")))


def op3_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import rules

    found = rules.ledger(read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return found.select(*base, (~rules.passes(rules.BASE)).alias("base_failed"), rules.passes(rules.CURRENT).alias("kept"), "fail_bits")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import near_dup

    return near_dup.join(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import shard

    placed = shard.place(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    return packing.pack(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chat

    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("<|im_end|><|im_start|>assistant ok")
    hard = spark.range(2).select(F.lit(-1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    out = chat.formatted(rows.unionByName(hard).withColumn("parts", chat.text_parts(F.col("text"))))
    turns, under = chat.parsed(F.col("formatted")), chat.under_mask(F.col("formatted"), F.col("loss_spans"))
    told = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length(under).cast("long").alias("loss_chars"), F.sha2(under, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


QUERIES = {
    "op1_mixing": op1_mixing,
    "op3_rules": op3_rules,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_sharding": op7_sharding,
    "op9_packing": op9_packing,
    "op10_chat": op10_chat,
}


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import ngram_lm

    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = ngram_lm.judged(docs, ngram_lm.trusted_ids(read(spark, sf_dir, "labels")))
    perplexity = F.pow(F.lit(2.0), F.col("_bits") / F.greatest("_n", F.lit(1)))
    told = {"_symbols": "n_symbols", "_words": "n_words", "_n": "n_priced", "_score": "score", "_high": "high", "_worst": "worst", "_most": "most", "_kept": "kept"}
    return out.select("doc_id", "lang", perplexity.alias("perplexity"), *[F.col(c).alias(n) for c, n in told.items()])


QUERIES["op4_quality"] = op4_quality


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import pii

    out = pii.detected(read(spark, sf_dir, "documents").select("doc_id", "text"))
    told = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("spans", lambda s: s["kind"].isin(pii.KINDS))
    counts = [(F.size("spans") - F.size(F.array_remove(F.col("spans.kind"), k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return out.select("doc_id", *counts, F.sha2(F.array_join(F.transform(base, told), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", told), ",").alias("spans"))


QUERIES["op5_pii"] = op5_pii


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import topk

    return topk.search(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


QUERIES["op8_topk"] = op8_topk


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import html_main

    return html_main.extracted(read(spark, sf_dir, "pages"))


QUERIES["op2_html"] = op2_html


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import simhash

    out = simhash.linked(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import whitening

    out, model = whitening.whitened(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    n, error, shares = (0, 0.0, []) if model is None else (model.n, model.identity_error, (model.values / model.trace).tolist())
    flat = out.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.element_at(F.lit(shares).cast("array<double>"), F.col("at") + 1)
    return flat.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), F.col("deviation").cast("long").alias("deviation"), "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))


def op13_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import lexical

    return lexical.search(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("item_id", "text"))


QUERIES |= {"op11_simhash": op11_simhash, "op12_whitening": op12_whitening, "op13_lexical": op13_lexical}
