"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model.

The model is one of ORDER symbols, trained on the trusted texts: each symbol of a word and the word's
end have a probability given the ORDER - 1 symbols before them. A word's context reaches back over the
white space to the kind of the last symbol of the word before it, so it tells how words follow each other:
a capital after no full stop, a list of cells, a shout. Symbols are code points as they are;
nothing is folded, and all white space is one symbol. All tables grow with the texts.

Texts fall into tokens, a word with that kind before it. Word n-grams proper are no
better a judge here, and dearer (README).

1. Documents become bags: BLOCK_WORDS words of text in one row, which holds the distinct
   tokens once and each document as numbers of them. Texts are read once and never shuffled.
2. Bags ask for their tokens, a packed message for each (bag, shard of the vocabulary) with
   the counts in trusted documents. A shard merges its messages into a sorted vocabulary.
3. Counts of n-grams, continuation counts, discounts and back-off weights are aggregations
   and merge joins by n-gram. Only n-grams that some token needs are priced.
4. A shard prices its tokens by their n-grams and answers each bag in the bag's order. A bag
   sums up its documents.

So a token costs a few bytes for each bag that holds it, not for each place it stands at.
Trusted texts are dealt by a hash of the text: one of FOLDS sets the thresholds and is not
counted, the others are counted. A document is rejected if its mean surprise of a symbol (the
logarithm of its perplexity) or the worst mean surprise within a word that no counted text has lies above
its language's quantile, plus a margin. Where no calibration text of that quantile has an unknown word,
there is nothing to compare one with, and the mean decides alone. Means are drawn towards the
language's mean by PRIOR symbols, so that a few words prove little. There is no lower
threshold: copies of counted texts lie low.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from operator import add
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import few, opened, release, returned, sealed, small_batches, table, word_hashes

ORDER = 5
BLOCK_WORDS, BLOCK_DOCS = 1 << 21, 1 << 13  # a bag ends beyond either
SHARD_TOKENS = 1 << 18  # distinct tokens for each shard of the vocabulary, or so
SIZED_BY = 1 << 8  # of so many hash values one is counted to size the shards
FLAG_BAGS = 1 << 14  # bags up to which the marks of trusted documents are broadcast
FOLDS = 4
PRIOR = 200
MEAN, WORST = 0.9975, 0.98  # quantiles of the calibration texts
MARGIN, WORST_MARGIN = 0.05, 0.5  # in bits
EDGES = 1.5  # symbols added to a word's length, so that short words prove less
STEPS = 128  # surprise is kept and ranked in steps of one bit by STEPS
LEAST = 50  # calibration texts that a language needs for thresholds of its own
START, END = "\x02", "\x03"
_START = START.encode()


def _deflated(raw: bytes, level: int = 1) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", compression_level=level).compress(raw, asbytes=True)


def _inflated(raw: bytes) -> bytes:
    return pa.decompress(raw[8:], decompressed_size=int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True)


def packed(a: np.ndarray, width: int = 4) -> bytes:
    """Unsigned numbers of ``width`` bytes, their bytes by place, compressed."""
    return _deflated(np.asarray(a, f"<u{width}").reshape(-1, 1).view(np.uint8).T.tobytes())


def unpacked(raw: bytes, width: int = 4) -> np.ndarray:
    return np.frombuffer(_inflated(raw), np.uint8).reshape(width, -1).T.copy().view(f"<u{width}").ravel().astype(np.int64)


def listed(words: list[bytes]) -> bytes:
    return _deflated(b"\n".join(words), 6)


def unlisted(raw: bytes) -> list[bytes]:
    text = _inflated(raw)
    return text.split(b"\n") if text else []


def kind(symbol: str) -> str:
    """What a word's last symbol is to the next word: a capital, a letter, a digit or itself."""
    return "A" if symbol.isupper() else "a" if symbol.isalpha() else "9" if symbol.isdigit() else symbol


class _Ends(dict):
    """The kind of the last symbol of a word, in bytes."""

    def __missing__(self, word: bytes) -> bytes:
        self[word] = out = kind(word.decode("utf-8", "surrogatepass")[-1]).encode("utf-8", "surrogatepass")
        return out


def tokens(words: list[bytes], ends: _Ends) -> list[bytes]:
    """Each word behind the kind of the last symbol of the one before it; behind START, the first one."""
    return [_START + words[0], *map(add, map(ends.__getitem__, words[:-1]), words[1:])] if words else []


def bare(token: bytes) -> bytes:
    """A token's word."""
    first = token[0]
    return token[1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4 :]


def grams(token: str) -> list[str]:
    """The n-gram that ends in each symbol of a token's word and in its end."""
    p = START * (ORDER - 3) + token[0] + " " + token[1:] + END
    return [p[i : i + ORDER] for i in range(len(token))]


# --- bags -----------------------------------------------------------------------


def _bag(held: list[tuple], index: dict[bytes, int], number: int) -> pd.DataFrame:
    """held: id, key, lang, fold, symbols, words and counts of each document; it is emptied."""
    ids, keys, langs, folds, symbols, found, counts = zip(*held, strict=True)
    held.clear()
    each = np.array([len(x) for x in found], np.int64)
    flat, count = np.concatenate(found), np.concatenate(counts)
    del found, counts
    names = list(index)
    spread = np.bincount(flat, minlength=len(names)).astype(np.int32)
    order = np.array(sorted(range(len(names)), key=names.__getitem__), np.int32)
    order = order[np.argsort(-spread[order], kind="stable")]  # common words have small numbers
    rank = np.empty(len(names), np.int32)
    rank[order] = np.arange(len(names), dtype=np.int32)
    flat = rank[flat]
    doc = np.repeat(np.arange(len(each), dtype=np.int32), each)
    at = np.lexsort((flat, doc))
    numbers = flat[at]
    gaps = np.diff(numbers, prepend=np.int32(0))
    first = np.flatnonzero(np.diff(doc, prepend=np.int32(-1)))
    gaps[first] = numbers[first]
    row = {"bag": number, "ids": list(ids), "keys": list(keys), "langs": list(langs), "folds": bytes(folds), "symbols": packed(np.array(symbols)), "each": packed(each), "gaps": packed(gaps), "counts": packed(count[at]), "words": listed([names[k] for k in order.tolist()]), "total": int(count.sum(dtype=np.int64))}
    return pd.DataFrame([row])


def postings(row: Any) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, word and count of each distinct word of each document of a bag."""
    each, gaps, counts = unpacked(row.each), unpacked(row.gaps), unpacked(row.counts)
    doc = np.repeat(np.arange(len(each)), each)
    total = np.cumsum(gaps)
    first = np.concatenate([[0], np.cumsum(each)[:-1]])
    base = np.where(each > 0, np.concatenate([[0], total])[np.minimum(first, len(total))], 0)
    return doc, total - np.repeat(base, each), counts


def bags(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """One row for every bag of consecutive documents of a task."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(id_col, text_col, lang_col).alias("key"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32
        held, size, index = [], 0, defaultdict()
        index.default_factory = index.__len__
        ends = _Ends()
        for b in batches:
            for i, t, lang, key in zip(b["id"], b["text"], b["lang"], b["key"], strict=True):
                raw = (t or "").encode("utf-8", "surrogatepass")
                words = tokens(raw.split(), ends)
                found, counts = np.unique(np.fromiter(map(index.__getitem__, words), np.int32, len(words)), return_counts=True)
                held.append((i, key, lang, zlib.crc32(raw) % FOLDS, len(t or ""), found, counts.astype(np.int32)))
                size += len(words)
                if size >= BLOCK_WORDS or len(held) >= BLOCK_DOCS:
                    yield _bag(held, index, number)
                    number, size = number + 1, 0
                    index.clear()
                    ends.clear()
        if held:
            yield _bag(held, index, number)
        index.clear()
        ends.clear()
        returned()

    return rows.mapInPandas(run, "bag long, ids array<string>, keys array<long>, langs array<string>, folds binary, symbols binary, each binary, gaps binary, counts binary, words binary, total long")


def flags(held: DataFrame, trusted: DataFrame) -> DataFrame:
    """bag and the numbers of its trusted documents; at most BLOCK_DOCS for a bag."""
    ids = trusted.select(F.col(trusted.columns[0]).cast("string").alias("id")).where("id is not null").distinct()
    each = held.select("bag", F.posexplode("ids").alias("at", "id"))
    return each.join(ids.hint("merge"), "id", "left_semi").groupBy("bag").agg(F.collect_list("at").alias("trusted"))


# --- vocabulary -----------------------------------------------------------------


def _shards(words: list[bytes], shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens' places in order of (shard, token), and each one's shard, which is its word's."""
    h = (word_hashes(b"\n".join(map(bare, words))) % np.uint64(shards)).astype(np.int64)
    order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
    order = order[np.argsort(h[order], kind="stable")]
    return order, h[order]


def requests(held: DataFrame, shards: int) -> DataFrame:
    """held: bags with their trusted documents. shard, bag, words and their counts in
    the trusted documents that are counted."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples(index=False):
                words = unlisted(row.words)
                if not words:
                    continue
                doc, word, count = postings(row)
                use = np.zeros(len(row.folds), bool)
                if row.trusted is not None:
                    use[np.asarray(row.trusted, np.int64)] = True
                use &= np.frombuffer(row.folds, np.uint8) > 0
                mine = use[doc]
                total = np.bincount(word[mine], weights=count[mine], minlength=len(words)).astype(np.int64)
                order, shard = _shards(words, shards)
                cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
                out = [(int(shard[a]), row.bag, listed([words[k] for k in order[a:z]]), packed(total[order[a:z]])) for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pd.DataFrame(out, columns=["shard", "bag", "words", "counts"])
        returned()

    return held.select("bag", "folds", "each", "gaps", "counts", "words", "trusted").mapInPandas(run, "shard int, bag long, words binary, counts binary")


def _merged(key: tuple[Any, ...], b: pd.DataFrame) -> pd.DataFrame:
    """A shard's vocabulary (bag -1: sorted words, counts) and, for each bag that asked,
    the numbers of its words."""
    total: dict[bytes, int] = defaultdict(int)
    for words, counts in zip(b["words"], b["counts"], strict=True):
        for w, c in zip(unlisted(words), unpacked(counts).tolist(), strict=True):
            total[w] += c
    names = sorted(total)
    rows = [(key[0], -1, listed(names), packed(np.array([total[w] for w in names])))]
    total.update(zip(names, range(len(names)), strict=True))  # from here on, a word's number
    for bag, words in zip(b["bag"], b["words"], strict=True):
        asked = np.fromiter(map(total.__getitem__, unlisted(words)), np.int64)
        rows.append((key[0], bag, None, packed(np.diff(asked, prepend=0))))
    del total, names
    returned()
    return pd.DataFrame(rows, columns=["shard", "bag", "words", "counts"])


def vocabulary(asked: DataFrame) -> DataFrame:
    return asked.groupBy("shard").applyInPandas(_merged, "shard int, bag long, words binary, counts binary")


def needed(vocab: DataFrame) -> DataFrame:
    """shard, gram, c: the n-grams of a shard's words, with their counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for shard, words, counts in zip(b["shard"], b["words"], b["counts"], strict=True):
                total: Counter = Counter()
                for w, c in zip(unlisted(words), unpacked(counts).tolist(), strict=True):
                    for g in grams(w.decode("utf-8", "surrogatepass")):
                        total[g] += c
                yield pd.DataFrame({"shard": np.full(len(total), shard, np.int32), "gram": list(total), "c": np.fromiter(total.values(), np.int64, len(total))})

    return vocab.where("bag = -1").select("shard", "words", "counts").mapInPandas(run, "shard int, gram string, c long")


# --- the model ------------------------------------------------------------------


def discounts(counts: DataFrame) -> DataFrame:
    """One row: d1, d2, d3 of modified Kneser-Ney for a histogram (c, n: how many n-grams
    have the count c; c = 0 does not count), the sum of the counts and the share of it that
    the discounts free. n1 to n4 are how many have a count of exactly 1 to 4; where the
    formula lacks a term or is not positive, a discount is half of its count."""
    n = counts.where("c > 0")
    sums = [F.coalesce(F.sum(F.when(F.col("c") == i, F.col("n"))), F.lit(0)).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)]
    r = n.agg(*sums, F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("c") * F.col("n")), F.lit(0)).cast("double").alias("total"))
    y = "n1 / (n1 + 2 * n2)"
    found = r.select("*", *[F.expr(f"CASE WHEN n{i} > 0 AND n1 > 0 THEN {i} - {i + 1} * {y} * n{i + 1} / n{i} ELSE 0D END").alias(f"f{i}") for i in (1, 2, 3)])
    terms = [f"CASE WHEN f{i} > 0 THEN f{i} ELSE {i} / 2D END AS d{i}" for i in (1, 2, 3)]
    out = found.selectExpr(*terms, "n", "n1", "n2", "total")
    freed = "greatest((d1 * n1 + d2 * n2 + d3 * (n - n1 - n2)) / total, 1 / (1 + total))"
    return out.selectExpr("d1", "d2", "d3", "total", f"CASE WHEN total > 0 THEN {freed} ELSE 1D END AS freed")


_DISCOUNT = "CASE WHEN c = 0 THEN 0D WHEN c = 1 THEN d1 WHEN c = 2 THEN d2 ELSE d3 END"


def spelled(counts: DataFrame) -> DataFrame:
    """gram and p, the probability of the last symbol of each n-gram of counts (gram, c).
    A gram with c = 0 is only asked for. Below the single symbols lies a uniform share for
    each symbol seen and one for all others."""
    levels = [table(counts)]
    for _ in range(ORDER - 1):
        upper = levels[-1].select(F.expr("substring(gram, 2)").alias("gram"), F.expr("CAST(c > 0 AS LONG)").alias("c"))
        levels.append(table(upper.groupBy("gram").agg(F.sum("c").alias("c"))))
    below = None
    for now in reversed(levels):
        drop = discounts(now.groupBy("c").agg(F.count("*").alias("n"))).select("d1", "d2", "d3")
        told = now.join(F.broadcast(drop)).withColumn("d", F.expr(_DISCOUNT)).drop("d1", "d2", "d3")  # one row
        told = told.withColumn("ctx", F.expr("substring(gram, 1, length(gram) - 1)"))
        stats = told.groupBy("ctx").agg(F.sum("c").cast("double").alias("total"), F.sum("d").alias("held"))
        told = told.join(stats.hint("merge"), "ctx")
        if below is None:
            told = told.join(F.broadcast(now.agg(F.expr("1D / (1 + count_if(c > 0))").alias("low"))))  # one row
        else:
            told = told.withColumn("rest", F.expr("substring(gram, 2)")).join(below.select(F.col("gram").alias("rest"), F.col("p").alias("low")).hint("merge"), "rest")
        p = F.expr("CASE WHEN total > 0 THEN (greatest(0D, c - d) + held * low) / total ELSE low END")
        last, below = below, table(told.select("gram", p.alias("p")))
        release(now, last)
    return below


def answers(vocab: DataFrame, bits: DataFrame) -> DataFrame:
    """vocab with the bits of each shard's n-grams (shard, gram, bits): shard, bag and, for
    each token that the bag asked for, twice its surprise in steps, plus 1 if its word is known."""

    def run(key: tuple[Any, ...], v: pd.DataFrame, g: pd.DataFrame) -> pd.DataFrame:
        found = dict(zip(g["gram"], g["bits"], strict=True))
        own = v[v["bag"] == -1]
        if not len(own):
            return pd.DataFrame({"bag": [], "shard": [], "prices": []}).astype({"bag": "int64", "shard": "int32"})
        names, c = unlisted(own["words"].iloc[0]), unpacked(own["counts"].iloc[0])
        surprise = np.fromiter((sum(map(found.__getitem__, grams(w.decode("utf-8", "surrogatepass")))) for w in names), np.float64, len(names))
        words = list(map(bare, names))
        seen = {words[i] for i in np.flatnonzero(c).tolist()}
        price = 2 * np.rint(surprise * STEPS).astype(np.int64) + np.fromiter(map(seen.__contains__, words), bool, len(words))
        rows = [(bag, key[0], packed(price[np.cumsum(unpacked(gaps))], 8)) for bag, gaps in zip(v["bag"], v["counts"], strict=True) if bag >= 0]
        del found, names, words, seen, g
        returned()
        return pd.DataFrame(rows, columns=["bag", "shard", "prices"])

    return vocab.groupBy("shard").cogroup(bits.groupBy("shard")).applyInPandas(run, "bag long, shard int, prices binary")


def scored(held: DataFrame, told: DataFrame, shards: int) -> DataFrame:
    """id, key, lang, fold, symbols, words, n (symbols priced: those of the words and their ends), bits and
    worst of every document of the bags; worst is the greatest mean surprise within an unknown word."""

    def run(key: tuple[Any, ...], left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row = next(left.itertuples(index=False))
        words = unlisted(row.words)
        size = len(row.folds)
        n, many, bits, worst = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size), np.zeros(size)
        if words:
            order, shard = _shards(words, shards)
            price = np.empty(len(words), np.int64)
            for s, prices in zip(right["shard"], right["prices"], strict=True):
                price[order[np.searchsorted(shard, s) : np.searchsorted(shard, s, "right")]] = unpacked(prices, 8)
            steps, known = price >> 1, price & 1
            length = np.array([len(w.decode("utf-8", "surrogatepass")) for w in words])  # of its word, and one for its end
            odd = np.where(known, 0.0, steps / STEPS / (length - 1 + EDGES))
            doc, word, count = postings(row)
            many = np.bincount(doc, weights=count, minlength=size).astype(np.int64)
            n = np.bincount(doc, weights=count * length[word], minlength=size).astype(np.int64)
            total = np.zeros(size, np.int64)
            np.add.at(total, doc, steps[word] * count)
            bits = total / STEPS
            np.maximum.at(worst, doc, odd[word])
        return pd.DataFrame({"id": row.ids, "key": row.keys, "lang": row.langs, "fold": np.frombuffer(row.folds, np.uint8).astype(np.int32), "at": np.arange(size, dtype=np.int32), "bag": np.full(size, row.bag), "symbols": unpacked(row.symbols), "words": many, "n": n, "bits": bits, "worst": worst})

    left = held.drop("total").groupBy("bag")
    return left.cogroup(told.groupBy("bag")).applyInPandas(run, "id string, key long, lang string, fold int, at int, bag long, symbols long, words long, n long, bits double, worst double")


# --- thresholds -----------------------------------------------------------------


def thresholds(known: DataFrame) -> DataFrame:
    """known: lang, n, bits and worst of the calibration texts. lang, texts, mean, high
    and most by language, and one row of lang null and every true over all of them.
    Quantiles are exact over values in steps: a histogram by language, summed in order."""
    both = known.withColumn("every", F.lit(False)).unionByName(known.withColumn("lang", F.lit(None).cast("string")).withColumn("every", F.lit(True)))
    means = table(both.groupBy("lang", "every").agg((F.sum("bits") / F.greatest(F.sum("n"), F.lit(1))).alias("mean"), F.count("*").alias("texts")))
    each = both.join(means.select(F.col("lang").alias("l"), F.col("every").alias("e"), "mean"), F.expr("lang <=> l AND every = e"))
    score = (F.col("bits") + PRIOR * F.col("mean")) / (F.col("n") + PRIOR)
    values = F.explode(F.array(F.struct(F.lit("mean").alias("kind"), score.alias("value")), F.struct(F.lit("worst").alias("kind"), F.col("worst").alias("value"))))
    steps = each.select("lang", "every", values.alias("v")).groupBy("lang", "every", "v.kind", F.floor(F.col("v.value") * STEPS).alias("step")).count()
    group = Window.partitionBy("lang", "every", "kind")
    steps = steps.withColumn("upto", F.sum("count").over(group.orderBy("step"))).withColumn("all", F.sum("count").over(group))

    def quantile(kind: str, q: float):
        reached = (F.col("kind") == kind) & (F.col("upto") >= F.ceil(F.lit(q) * F.col("all")))
        return (F.min(F.when(reached, F.col("step"))) + 1) / STEPS

    cut = steps.groupBy("lang", "every").agg((quantile("mean", MEAN) + MARGIN).alias("high"), F.when(quantile("worst", WORST) > 1 / STEPS, quantile("worst", WORST) + WORST_MARGIN).otherwise(float("inf")).alias("most"))
    out = means.join(cut.withColumnRenamed("lang", "l").withColumnRenamed("every", "e"), F.expr("lang <=> l AND every = e"))
    return out.select("lang", "every", "texts", "mean", "high", "most")


def scores(docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str, lang_col: str) -> tuple[DataFrame, DataFrame]:
    """The scores of every document, and of the calibration texts."""
    held = table(bags(docs, id_col, text_col, lang_col))
    number = held.count()
    shards = max(1, -(-distinct_tokens(held) // SHARD_TOKENS))
    marks = table(flags(held, trusted))
    near = "broadcast" if number <= FLAG_BAGS else "merge"
    vocab = table(vocabulary(requests(held.join(marks.hint(near), "bag", "left"), shards)))
    grams_ = table(needed(vocab))
    below = spelled(grams_.groupBy("gram").agg(F.sum("c").alias("c")))
    asked = grams_.select("shard", "gram").join(below.hint("merge"), "gram").select("shard", "gram", (-F.log2("p")).alias("bits"))
    told = answers(vocab, asked)
    out = table(scored(held, told, shards))
    known = out.join(marks.select("bag", F.explode("trusted").alias("at")).hint("merge"), ["bag", "at"], "left_semi").where("fold = 0")
    known = table(known.select("lang", "n", "bits", "worst"))
    release(held, marks, vocab, grams_, below)
    return out.drop("bag", "at", "fold"), known


def distinct_tokens(held: DataFrame) -> int:
    """About how many distinct tokens the bags hold: those of every SIZED_BY-th hash value are
    counted. It sizes the shards alone; results do not depend on it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for raw in b["words"]:
                h = word_hashes(b"\n".join(unlisted(raw)))
                yield pd.DataFrame({"h": np.unique(h[h % np.uint64(SIZED_BY) == 0]).view(np.int64)})

    return SIZED_BY * held.select("words").mapInPandas(run, "h long").distinct().count()


def judged(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """id and lang (under their names), _key, _symbols, _words, _n (symbols of words and their ends), _bits, _score (the mean
    surprise of a symbol, drawn towards the language's mean), _high, _worst, _most and
    _kept, for every row of docs. trusted: ids of the trusted texts.

    A null text is an empty one; it scores the mean and stays. A null language is a
    language of its own; one with fewer than LEAST calibration texts takes the thresholds
    over all languages, and with fewer than LEAST over all the mean decides alone. Repeated rows are judged alike and count each in training. A text
    or a word of any length is read whole, in one bag. Without trusted texts everything is
    kept. An empty table gives an empty result. Other columns are not read."""
    out, known = scores(docs, trusted, id_col, text_col, lang_col)
    limits = table(thresholds(known))
    own = limits.where((F.col("texts") >= LEAST) & ~F.col("every")).select(F.col("lang").alias("l"), *[F.col(c).alias(f"{c}_own") for c in ("mean", "high", "most")])
    # The worst of a few texts says little about the worst of many.
    limits = limits.withColumn("most", F.when(F.col("texts") >= LEAST, F.col("most")).otherwise(float("inf")))
    rest = limits.where("every").select(*[F.col(c).alias(f"{c}_all") for c in ("mean", "high", "most")])
    out = out.join(F.broadcast(own) if few(own) else own, F.expr("lang <=> l"), "left").join(F.broadcast(rest), how="left")  # rest: one row
    far = {"mean": 0.0, "high": float("inf"), "most": float("inf")}
    at = {c: F.coalesce(f"{c}_own", f"{c}_all", F.lit(d)) for c, d in far.items()}
    score = (F.col("bits") + PRIOR * at["mean"]) / (F.col("n") + PRIOR)
    out = out.select(F.col("id").cast(dict(docs.dtypes)[id_col]).alias("id"), "lang", F.col("key").alias("_key"), F.col("symbols").alias("_symbols"), F.col("words").alias("_words"), F.col("n").alias("_n"), F.col("bits").alias("_bits"), score.alias("_score"), at["high"].alias("_high"), F.col("worst").alias("_worst"), at["most"].alias("_most"))
    kept = (F.col("_score") <= F.col("_high")) & (F.col("_worst") <= F.col("_most"))
    return out.withColumn("_kept", kept).withColumnsRenamed({"id": id_col, "lang": lang_col})


def accepted(docs: DataFrame, trusted: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs without the texts that judged() rejects; all columns stay, whatever their names.
    Rows of one id, text and language are judged alike, so the rejected ones meet docs by
    a hash of the three. Null, empty, repeated and very long texts: as in judged()."""
    plain, names = sealed(docs)
    i, t, lang = names[id_col], names[text_col], names[lang_col]
    gone = judged(plain, trusted, i, t, lang).where("not _kept").select("_key").distinct()
    out = plain.withColumn("_key", F.xxhash64(i, t, lang)).join(table(gone).hint("merge"), "_key", "left_anti")
    return opened(out, names)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Texts labelled as good and not toxic."""
    return labels.where("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id")
