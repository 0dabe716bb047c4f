"""N-gram Jaccard join with Bayesian candidate pruning.

1. Each text becomes its set of hashed five-word shingles, a fingerprint of the
   set and a MinHash signature. Texts of one fingerprint are one class.
2. Classes that agree on a band of the signature are candidates. Buckets with one
   class go; a larger bucket is cut into blocks of BLOCK classes, and each pair of
   blocks is a unit of work of bounded size, whatever the size of the bucket.
3. A unit compares signatures a few values at a time. A pair is dropped as soon as
   the posterior probability that its similarity reaches the threshold, under a
   uniform prior, falls below TOLERANCE. A pair that shares several bands is
   treated in the first of them. No pair leaves the unit: what remains is the
   classes of the unit that still have a partner.
4. The texts of those classes meet again in their units and the pairs that
   remain are verified exactly on their shingle sets. A unit returns a row for
   each class: its links and one edge of a spanning forest.
5. Components of the forest come from large-star / small-star rounds over tables.

With BANDS bands of ROWS values, a pair of similarity 0.8 is missed by all bands with
a probability of 3e-6; pairs above it, less.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import opened, release, returned, sealed, small_batches, table, word_hashes

NGRAM = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 4
SIGNATURE = BANDS * ROWS
STAGES = (16, 32, 64, 96)
TOLERANCE = 1e-7
BLOCK = 512

_MULTIPLIERS = np.random.default_rng(20240601).integers(1, 2**63, SIGNATURE, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, n: int = NGRAM) -> np.ndarray:
    """Sorted hashes of the distinct n-word shingles; a shorter text is one shingle."""
    h = word_hashes((text or "").encode("utf-8", "surrogatepass"))
    if not len(h):
        return h
    out = np.zeros(max(1, len(h) - n + 1), np.uint64)
    for k in range(min(n, len(h))):
        out = out * np.uint64(0xA0761D6478BD642F) + h[k : k + len(out)]
        out ^= out >> np.uint64(29)
    return np.unique(out)


def signature(found: np.ndarray) -> np.ndarray:
    low = np.full(SIGNATURE, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), 4096):
        part = found[at : at + 4096]
        np.minimum(low, np.multiply.outer(_MULTIPLIERS, part ^ (part >> np.uint64(33))).min(axis=1), out=low)
    return (low >> np.uint64(32)).astype("<u4")


@cache
def fewest(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> dict[int, int]:
    """For each stage n, the fewest equal values of n with which a pair stays. With a
    uniform prior, the posterior of the similarity after m of n is
    Beta(m + 1, n - m + 1), whose tail is a binomial sum."""

    def tail(m: int, n: int) -> float:
        return sum(comb(n + 1, k) * threshold**k * (1 - threshold) ** (n + 1 - k) for k in range(m + 1))

    return {n: next(m for m in range(n + 1) if tail(m, n) >= tolerance) for n in STAGES}


def survivors(a: np.ndarray, b: np.ndarray, band: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of two signature blocks that meet first in this band and are not
    pruned; for one block with itself, each pair once."""
    keep = (a[:, None, band * ROWS] == b[None, :, band * ROWS]) & ~np.zeros((len(a), len(b)), bool)
    if same:
        keep &= np.triu(np.ones(keep.shape, bool), 1)
    i, j = np.nonzero(keep)
    for n, least in fewest().items():
        if not len(i):
            break
        parts = [slice(k, k + 65536) for k in range(0, len(i), 65536)]
        good = np.concatenate([(a[i[p], :n] == b[j[p], :n]).sum(axis=1) >= least for p in parts])
        i, j = i[good], j[good]
    if len(i):
        first = []
        for k in range(0, len(i), 65536):
            equal = (a[i[k : k + 65536]] == b[j[k : k + 65536]]).reshape(-1, BANDS, ROWS).all(axis=2)
            first.append(equal.argmax(axis=1) == band)
        good = np.concatenate(first)
        i, j = i[good], j[good]
    return i, j


def fingerprinted(docs: DataFrame, text_col: str = "text", *, sign: bool = True) -> DataFrame:
    """All columns of docs, fp (16 bytes), n_shingles and, with sign, the signature."""
    small_batches(docs.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fps, ns, sigs = [], [], []
            for t in b[text_col]:
                s = shingles(t)
                fps.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                ns.append(len(s))
                if sign:
                    sigs.append(signature(s).tobytes())
            yield b.assign(_fp=fps, _n=np.array(ns, np.int64), **({"_sig": sigs} if sign else {}))
        returned()

    return docs.mapInPandas(run, fields + ", _fp binary, _n long" + ", _sig binary" * sign)


def grouped(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Groups of rows that stand together, over batch borders."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        if held:
            last = held[-1].iloc[-1]
            if any(b[k].iloc[0] != last[k] for k in keys):
                yield pd.concat(held, ignore_index=True)
                held = []
        change = np.zeros(len(b), bool)
        for k in keys:
            v = b[k].to_numpy()
            change[1:] |= v[1:] != v[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), len(b)]
        for at, upto in zip(cuts[:-1], cuts[1:], strict=True):
            if at:
                yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
                held = []
            held.append(b.iloc[at:upto])
    if held:
        yield pd.concat(held, ignore_index=True)


UNIT = ["band", "key", "bi", "bj"]


def _unit_pairs(g: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, np.ndarray, np.ndarray]:
    bi, bj, band = g["bi"].iloc[0], g["bj"].iloc[0], int(g["band"].iloc[0])
    left = g[g["block"] == bi]
    right = left if bi == bj else g[g["block"] == bj]
    a, b = (np.frombuffer(b"".join(x["sig"]), "<u4").reshape(-1, SIGNATURE) for x in (left, right))
    i, j = survivors(a, b, band, bi == bj)
    return left, right, i, j


def _prune(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for g in grouped(batches, UNIT):
        if len(g) > 1:
            left, right, i, j = _unit_pairs(g)
            if len(i):
                out = [left.iloc[np.unique(i)], right.iloc[np.unique(j)]]
                yield pd.concat(out).drop_duplicates(subset=["fp"]).drop(columns=["sig"])
    returned()


def jaccard_at_least(sets: list[np.ndarray], i: np.ndarray, others: list[np.ndarray], j: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Which of the pairs (sets[i], others[j]), sorted by i, reach the threshold."""
    ids, inverse = np.unique(np.concatenate([*sets, *others]), return_inverse=True)
    cuts = np.cumsum([0, *map(len, sets), *map(len, others)])
    own = [inverse[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    size = np.diff(cuts)
    marked, out = np.zeros(len(ids), np.int64), np.zeros(len(i), bool)
    edges = np.flatnonzero(np.diff(i, prepend=-1, append=-1))
    for at, upto in zip(edges[:-1], edges[1:], strict=True):
        x, ys = i[at], j[at:upto] + len(sets)
        marked[own[x]] = 1
        lengths = size[ys]
        both = np.add.reduceat(marked[np.concatenate([own[y] for y in ys])], np.concatenate([[0], np.cumsum(lengths)[:-1]]))
        out[at:upto] = both >= threshold * (size[x] + lengths - both) - 1e-9
        marked[own[x]] = 0
    return out


def _verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for g in grouped(batches, UNIT):
        left, right, i, j = _unit_pairs(g)
        if not len(i):
            continue
        texts = {f: shingles(t) for f, t in zip(g["fp"], g["text"], strict=True)}
        sets, others = ([texts[f] for f in x["fp"]] for x in (left, right))
        good = jaccard_at_least(sets, i, others, j)
        i, j = i[good], j[good]
        if not len(i):
            continue
        fps = np.array([*left["fp"], *right["fp"]], object)
        copies = np.array([*left["copies"], *right["copies"]], np.int64)
        shift = len(left)
        both = np.concatenate([i, j + shift]), np.concatenate([j + shift, i])
        texts_linked = np.bincount(both[0], minlength=len(fps))
        docs_linked = np.bincount(both[0], weights=copies[both[1]], minlength=len(fps)).astype(np.int64)
        # A spanning forest of the unit's links, by repeated minima over names.
        name = np.unique(fps, return_inverse=True)[1]
        root = np.arange(name.max() + 1)
        u, v = name[both[0]], name[both[1]]
        while True:
            new = root.copy()
            np.minimum.at(new, u, root[v])
            new = new[new]
            if (new == root).all():
                break
            root = new
        at = np.flatnonzero(texts_linked)
        names = np.unique(fps)
        yield pd.DataFrame({"fp": fps[at], "texts_linked": texts_linked[at], "docs_linked": docs_linked[at], "root": names[root[name[at]]]})
    returned()


def components(edges: DataFrame) -> DataFrame:
    """edges: u, v (u != v). Returns u and root, the least name of its component, for
    every u with an edge: large-star and small-star rounds until nothing changes.
    Each round is a table; the driver sees a count and a checksum only. Both sides of a join
    grow with the edges, so none is broadcast."""
    now = table(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct())

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    seen = mark(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # The minima are tables, so that both sides of a join are plain exchanges and the
        # edges of a hub can be split.
        low = table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = table(both.join(low.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct())
        least = table(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least.hint("merge"), "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct()
        last, now = now, table(small)
        release(last, low, large, least)
        if (new := mark(now)) == seen:
            break
        seen = new
    return now.select("u", F.col("v").alias("root"))


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, copy_id (the least id among texts of the same shingles), class_id (the least
    id of its component of links), n_links (other documents at the threshold or
    above, copies counted), n_text_links (other texts so linked).

    A null text is an empty one; texts without words are copies of each other and
    link to nothing else; a text of fewer than five words is one shingle, and one of any
    length is shingled whole. Repeated rows are copies. An empty table gives an empty result; no other column is read."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    signed, classes = _classes(rows)
    links, forest = _links(rows, classes)
    linked = links.groupBy("fp").agg(F.sum("texts_linked").alias("n_text_links"), F.sum("docs_linked").alias("_docs"))
    roots = components(forest).withColumnRenamed("u", "fp")
    named = classes.select("fp", "copy_id", "copies").join(linked.hint("merge"), "fp", "left").join(roots.hint("merge"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("copy_id").alias("class_id"))
    named = table(named.join(least.hint("merge"), "root"))
    release(classes, links)
    out = signed.select("id", F.col("_fp").alias("fp")).join(named.hint("merge"), "fp")
    return out.select(F.col("id").alias(id_col), "copy_id", "class_id", (F.coalesce("_docs", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("n_text_links", F.lit(0)).cast("long").alias("n_text_links"))


def _classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows: id, text. The rows by fingerprint, and a row for each fingerprint."""
    signed = table(fingerprinted(rows).drop("text"))
    classes = signed.groupBy("_fp").agg(F.min("id").alias("copy_id"), F.count("*").alias("copies"), F.first("_n").alias("n"), F.first("_sig").alias("sig"))
    return signed, table(classes.withColumnRenamed("_fp", "fp"))


def _links(rows: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1)))
    keyed = classes.where("n > 0").select("fp", "sig", band.alias("band")).withColumn("key", F.xxhash64("band", F.expr(f"substring(sig, band * {4 * ROWS} + 1, {4 * ROWS})"))).drop("sig")
    full = keyed.groupBy("band", "key").agg(F.count("*").alias("m")).where("m > 1")
    members = keyed.join(full.hint("merge"), ["band", "key"])
    blocks = F.expr(f"cast((m + {BLOCK - 1}) div {BLOCK} as int)")
    members = members.withColumn("nb", blocks).withColumn("block", F.pmod(F.xxhash64("fp", "band"), F.col("nb")).cast("int"))
    units = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    units = table(units.select("fp", *["band", "key"], "block", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj")))

    def by_unit(df: DataFrame) -> DataFrame:
        return df.repartition(*[F.col(c) for c in UNIT]).sortWithinPartitions(*UNIT, "fp")

    shape = classes.select("fp", "copies", "sig")
    kept = by_unit(units.join(shape.hint("merge"), "fp")).mapInPandas(_prune, "fp binary, band int, key long, block int, bi int, bj int, copies long")
    kept = table(kept.select("fp", *UNIT, "block"))
    need = kept.select("fp").distinct()
    chosen = need.join(classes.select("fp", "copies", "sig", F.col("copy_id").alias("id")).hint("merge"), "fp")
    texts = fingerprinted(rows.join(chosen.select("id").distinct().hint("merge"), rows["id"].eqNullSafe(chosen["id"]), "left_semi"), sign=False)
    texts = texts.groupBy(F.col("_fp").alias("fp")).agg(F.min("text").alias("text"))
    found = by_unit(kept.join(chosen.drop("id").hint("merge"), "fp").join(texts.hint("merge"), "fp")).mapInPandas(_verify, "fp binary, texts_linked long, docs_linked long, root binary")
    found = table(found)
    release(units, kept)
    return found, found.where("fp != root").select(F.col("fp").alias("u"), F.col("root").alias("v"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each class of join(): of its least id and that id's least
    fingerprint, repeated rows once. All columns stay, whatever their names. Null, empty and
    very long texts and null ids: as in join(); an empty table gives an empty result."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    plain, names = sealed(docs)
    marked, chosen, key = fingerprinted(plain, names[text_col], sign=False), _chosen(rows), names[id_col]
    same = marked[key].eqNullSafe(chosen["_id"]) & (marked["_fp"] == chosen["_f"])
    return opened(marked.join(chosen.hint("merge"), same, "left_semi").dropDuplicates([key, "_fp"]), names)


def _chosen(rows: DataFrame) -> DataFrame:
    """_id and _f of the row of each class that stays."""
    signed, classes = _classes(rows)
    release(signed)
    found, forest = _links(rows, classes)
    roots = components(forest).withColumnRenamed("u", "fp")
    named = classes.select("fp", "copy_id").join(roots.hint("merge"), "fp", "left")
    first = named.groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min(F.struct("copy_id", "fp")).alias("m"))
    out = table(first.select(F.col("m.copy_id").alias("_id"), F.col("m.fp").alias("_f")))
    release(classes, found)
    return out
