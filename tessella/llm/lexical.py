"""Ranked lexical search by TPUT (three-phase uniform threshold) over term-partitioned postings.

Documents are read once, into segments of consecutive documents, which hold for each
document its length and its counts of the queries' terms. From them come the statistics and the
index: a posting list for each term, cut by segment, each part sorted by falling impact.
A query's lists are those of its terms; a posting's share of a score is its impact
times the list's weight, and a query of m lists wants its k best documents.

1. Every list sends its head. The heads' documents are scored, and the k-th best score of a
   query is its first lower bound.
2. Every list sends each posting whose share reaches the uniform threshold, lower bound / m.
   Lists send to the segments' accumulators, once for all queries that hold the term.
   A document whose lists sent nothing cannot reach the bound. The k-th best partial sum
   is the second lower bound.
3. A document is a candidate if its partial sum, plus the most that each list may have held
   back, reaches that bound. Candidates are looked up in their segment and scored exactly.

A part of a list belongs to one segment, so the list of a word that every text holds is
spread over as many tasks as there are segments.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import release, returned, small_batches, table

K = 10
SEGMENT_DOCS, SEGMENT_POSTINGS = 1 << 14, 1 << 21  # a segment ends beyond either
MOST_CHARS = 1 << 25  # of queries that are searched at once, and whose terms every task holds
IMPACT = 10**9
#: Bytes that stand in no term become spaces and A-Z small letters; bytes of other scripts stay.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def impact(tf: np.ndarray, length: np.ndarray, docs: int, total: int) -> np.ndarray:
    return IMPACT * tf // (1000 * tf + 8 * (25 + 75 * length * docs // total))


class Queries:
    """Queries as arrays: of query i, terms[ptr[i]:ptr[i + 1]] and how often it holds each."""

    def __init__(self, texts: list[tuple[Any, str | None]]):
        self.ids, self.index, flat, times, ptr = [], {}, [], [], [0]
        for i, text in texts:
            found = Counter(terms(text))
            if found:
                self.ids.append(i)
                flat += [self.index.setdefault(t, len(self.index)) for t in found]
                times += found.values()
                ptr.append(len(flat))
        self.terms, self.times, self.ptr = np.array(flat, np.int64), np.array(times, np.int64), np.array(ptr, np.int64)

    def weighted(self, docs: int, df: dict[int, int]) -> None:
        own = np.array([weight(docs, df.get(t, 0)) for t in range(len(self.index))], np.int64)
        self.weights = self.times * own[self.terms]

    def each(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Number, terms and weights of each query."""
        for i in range(len(self.ids)):
            at = slice(self.ptr[i], self.ptr[i + 1])
            yield i, self.terms[at], self.weights[at]


def _best(score: np.ndarray, k: int) -> np.ndarray:
    return np.argpartition(-score, k - 1)[:k] if len(score) > k else np.arange(len(score))


def _raw(a: np.ndarray, kind: str = "<i4") -> bytes:
    return np.ascontiguousarray(a, kind).tobytes()


def _read(raw: bytes, kind: str = "<i4") -> np.ndarray:
    return np.frombuffer(raw, kind).astype(np.int64)


def segments(docs: DataFrame, index: Any) -> DataFrame:
    """docs: id (long), text. index: a broadcast of the queries' terms by number. seg, ids,
    lengths (terms of each document), each (its distinct queried terms), terms and tfs."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, known = TaskContext.get().partitionId() << 32, index.value.get
        ids, lengths, each, found, tfs = [], [], [], [], []

        def row() -> pd.DataFrame:
            return pd.DataFrame({"seg": [number], "ids": [ids[:]], "lengths": [_raw(lengths, "<i8")], "each": [_raw(each)], "terms": [_raw(found)], "tfs": [_raw(tfs)]})

        for b in batches:
            for i, text in zip(b["id"].astype("Int64"), b["text"], strict=True):
                words = terms(text)
                if not words:
                    continue
                had = len(found)
                for w, c in Counter(words).items():
                    if (t := known(w)) is not None:
                        found.append(t)
                        tfs.append(c)
                ids.append(None if i is pd.NA else int(i))
                lengths.append(len(words))
                each.append(len(found) - had)
                if len(ids) >= SEGMENT_DOCS or len(found) >= SEGMENT_POSTINGS:
                    yield row()
                    number += 1
                    for x in (ids, lengths, each, found, tfs):
                        x.clear()
        if ids:
            yield row()
        returned()

    return docs.mapInPandas(run, "seg long, ids array<long>, lengths binary, each binary, terms binary, tfs binary")


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents by term; at -1 all documents, at -2 all their terms."""
    for b in batches:
        for r in b.itertuples(index=False):
            t, c = np.unique(_read(r.terms), return_counts=True)
            lengths = _read(r.lengths, "<i8")
            yield pd.DataFrame({"term": [-1, -2, *t.tolist()], "n": [len(lengths), int(lengths.sum()), *c.tolist()]})


def _postings(r: Any, docs: int, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a segment: where each document's postings begin (and the last end), the document,
    term and impact of each."""
    each = _read(r.each)
    doc = np.repeat(np.arange(len(each)), each)
    return np.concatenate([[0], np.cumsum(each)]), doc, _read(r.terms), impact(_read(r.tfs), _read(r.lengths, "<i8")[doc], docs, total)


def lists(segs: DataFrame, docs: int, total: int) -> DataFrame:
    """term, seg, top (its greatest impact), docs (places in the segment) and impacts, by
    falling impact: the parts of every posting list."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                _, doc, term, g = _postings(r, docs, total)
                order = np.lexsort((doc, -g, term))
                doc, term, g = doc[order], term[order], g[order]
                cuts = np.flatnonzero(np.diff(term, prepend=-1, append=-1)) if len(term) else np.zeros(1, np.int64)
                parts = list(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
                yield pd.DataFrame({"term": term[cuts[:-1]].astype(np.int32), "seg": np.full(len(parts), r.seg), "top": g[cuts[:-1]], "docs": [_raw(doc[a:z]) for a, z in parts], "impacts": [_raw(g[a:z]) for a, z in parts]})
        returned()

    rows = segs.mapInPandas(run, "term int, seg long, top long, docs binary, impacts binary")
    return rows.repartition("term", "seg").sortWithinPartitions("term", F.col("top").desc())


def _ranked(df: DataFrame, k: int, score: str, *more: Any) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col(score).desc(), *more)
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _bound(df: DataFrame, k: int, size: int) -> np.ndarray:
    """The k-th best score of each query; 0 where there are fewer."""
    out = np.zeros(size, np.int64)
    for item, score in _ranked(df, k, "score").where(F.col("rank") == k).select("item", "score").collect():
        out[item] = score
    return out


def _scored(at: np.ndarray, weights: np.ndarray, view: tuple) -> np.ndarray:
    """Exact scores of the documents at these places of a segment, looked up one by one."""
    ptr, _, term, g = view
    sizes = ptr[at + 1] - ptr[at]
    i = np.repeat(ptr[at] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
    total = np.concatenate([[0], np.cumsum(weights[term[i]] * g[i])])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def first_bounds(segs: DataFrame, index: DataFrame, told: Any, k: int, docs: int, total: int) -> np.ndarray:
    """Phase 1: the k-th best exact score among the documents of the lists' heads."""

    def heads(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at, g = [_read(x[: 4 * k]) for x in b["docs"]], [_read(x[: 4 * k]) for x in b["impacts"]]
            sizes = [len(x) for x in at]
            if sizes:
                yield pd.DataFrame({"item": np.repeat(b["term"].to_numpy(np.int64), sizes), "seg": np.repeat(b["seg"].to_numpy(), sizes), "at": np.concatenate(at), "g": np.concatenate(g)})

    # The k best of each list: Spark keeps k rows of a list in each partition before it deals them out.
    head = _ranked(index.select("term", "seg", "docs", "impacts").mapInPandas(heads, "item long, seg long, at long, g long"), k, "g", "seg", "at")
    head = head.groupBy("seg").agg(F.collect_list(F.struct(F.col("item").alias("term"), "at")).alias("heads"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q = told.value
        size = len(q.index)
        for b in batches:
            for r in b.itertuples(index=False):
                view = _postings(r, docs, total)
                t, at = (np.array([h[n] for h in r.heads], np.int64) for n in ("term", "at"))
                order = np.argsort(t, kind="stable")
                t, at = t[order], at[order]
                weights, out = np.zeros(size, np.int64), []
                for i, own, w in q.each():
                    lo, hi = np.searchsorted(t, own), np.searchsorted(t, own, "right")
                    found = np.unique(np.concatenate([at[a:z] for a, z in zip(lo, hi, strict=True)]))
                    if len(found):
                        weights[own] = w
                        score = _scored(found, weights, view)
                        weights[own] = 0
                        out.append(pd.DataFrame({"item": i, "score": score[_best(score, k)]}))
                if out:
                    yield pd.concat(out, ignore_index=True)
        returned()

    rows = segs.drop("ids").join(head, "seg").mapInPandas(run, "item long, score long")
    return _bound(rows, k, len(told.value.ids))


def _needed(bound: np.ndarray, q: Queries) -> np.ndarray:
    """For each list of each query the least impact whose share reaches bound / m."""
    m = np.diff(q.ptr)
    share = np.repeat(bound, m)
    per = np.repeat(m, m) * q.weights
    return np.where(q.weights > 0, -(-share // np.maximum(per, 1)), IMPACT)


def fetched(index: DataFrame, told: Any, need: np.ndarray) -> DataFrame:
    """Phase 2: a row for each segment, with what the lists send it: terms, sizes, docs and
    impacts. A list sends what the least threshold among its queries lets through."""
    q: Queries = told.value
    least = np.full(len(q.index), IMPACT, np.int64)
    np.minimum.at(least, q.terms, need)

    def sent(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b[b["top"].to_numpy() >= least[b["term"].to_numpy()]]
            if len(b):
                cut = [int(np.searchsorted(-_read(g), -least[t], "right")) for t, g in zip(b["term"], b["impacts"], strict=True)]
                for c in ("docs", "impacts"):
                    b[c] = [x[: 4 * n] for x, n in zip(b[c], cut, strict=True)]
                yield b[["seg", "term", "docs", "impacts"]]

    def gathered(key: tuple[Any, ...], b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("term")
        row = {"seg": key[0], "sent": _raw(b["term"]), "sizes": _raw(b["docs"].map(len) // 4), "docs": b"".join(b["docs"]), "impacts": b"".join(b["impacts"])}
        returned()
        return pd.DataFrame([row])

    rows = index.mapInPandas(sent, "seg long, term int, docs binary, impacts binary")
    return rows.groupBy("seg").applyInPandas(gathered, "seg long, sent binary, sizes binary, docs binary, impacts binary")


def _sums(r: Any, q: Queries, need: np.ndarray, held: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Of each query that a segment has postings for: the partial sums of its documents
    and the most that each may reach. held: the most that a list may have held back."""
    sent, sizes, docs, g = _read(r.sent), _read(r.sizes), _read(r.docs), _read(r.impacts)
    ends = np.cumsum(sizes)
    size = int(docs.max()) + 1 if len(docs) else 0
    for i, own, w in q.each():
        lists = slice(q.ptr[i], q.ptr[i + 1])
        at = np.searchsorted(sent, own)
        at[at == len(sent)] = 0
        there = np.flatnonzero((sent[at] == own) & (w > 0)) if len(sent) else ()
        if len(there):
            part, seen = np.zeros(size, np.int64), np.zeros(size, np.int64)
            for j in there.tolist():
                a, z = int(ends[at[j]] - sizes[at[j]]), int(ends[at[j]])
                z = a + int(np.searchsorted(-g[a:z], -need[lists][j], "right"))
                part[docs[a:z]] += w[j] * g[a:z]
                seen[docs[a:z]] += held[lists][j]
            yield i, part, part + int(held[lists].sum()) - seen


def search(docs: DataFrame, queries: DataFrame, doc_id: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = K, *, most_chars: int = MOST_CHARS) -> DataFrame:
    """item, rank, doc and score of the k best documents of each query with a score above 0.

    A null text has no terms; a document without terms is none, a query without terms finds
    nothing. Texts of any length are read whole. Repeated rows of docs are documents each; equal
    scores go by ascending id, null ids last. Repeated queries are one; of different texts under
    one id the least is asked; a null id is an id. Queries whose texts sum up to more than most_chars
    are searched in several rounds. Empty tables give empty results; other columns are not read."""
    asked = table(queries.select(F.col(item_id).alias("id"), F.col(item_text).alias("text")).groupBy("id").agg(F.min("text").alias("text")))
    size = asked.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text_col).alias("text"))
    rounds, kind = -(-size // most_chars), dict(asked.dtypes)["id"]
    parts = [_found(rows, [tuple(r) for r in asked.where(F.pmod(F.xxhash64("id"), F.lit(rounds)) == part).collect()], k, kind) for part in range(rounds)]  # at most most_chars each, or so
    release(asked)
    out = docs.sparkSession.createDataFrame([], f"item {kind}, rank int, doc long, score long")
    for p in parts:
        out = p if p is parts[0] else out.unionByName(p)
    return out.select(F.col("item").alias(item_id), "rank", F.col("doc").alias(doc_id), "score")


def _found(rows: DataFrame, texts: list[tuple[Any, str | None]], k: int, kind: str) -> DataFrame:
    spark = rows.sparkSession
    q = Queries(texts)
    words = spark.sparkContext.broadcast(q.index)
    segs = table(segments(rows, words))
    count = {r[0]: r[1] for r in segs.select("lengths", "terms").mapInPandas(_counts, "term long, n long").groupBy("term").agg(F.sum("n")).collect()}
    n, total = count.get(-1, 0), count.get(-2, 0)
    if not n or not q.ids:
        release(segs)
        return spark.createDataFrame([], f"item {kind}, rank int, doc long, score long")
    q.weighted(n, count)
    told = spark.sparkContext.broadcast(q)
    index = table(lists(segs, n, total))
    bound = first_bounds(segs, index, told, k, n, total)
    need = _needed(bound, q)
    got = table(fetched(index, told, need))
    release(index)
    m = np.diff(q.ptr)
    held = np.minimum(np.repeat(np.maximum(bound - 1, 0) // np.maximum(m, 1), m), q.weights * (IMPACT // 1000 - 1))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                for i, part, _ in _sums(r, told.value, need, held):
                    yield pd.DataFrame({"item": i, "score": part[_best(part, k)]})
        returned()

    bound = np.maximum(bound, _bound(got.mapInPandas(partial, "item long, score long"), k, len(q.ids)))

    def looked_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q = told.value
        weights = np.zeros(len(q.index), np.int64)
        for b in batches:
            for r in b.itertuples(index=False):
                view, ids = _postings(r, n, total), np.array([np.inf if x is None else x for x in r.ids], object)
                for i, _, most in _sums(r, q, need, held):
                    at = np.flatnonzero(most >= max(int(bound[i]), 1))
                    if len(at):
                        own = slice(q.ptr[i], q.ptr[i + 1])
                        weights[q.terms[own]] = q.weights[own]
                        score = _scored(at, weights, view)
                        weights[q.terms[own]] = 0
                        good = score >= max(int(bound[i]), 1)
                        best = sorted(zip((-score[good]).tolist(), ids[at[good]].tolist(), strict=True))[:k]
                        if best:
                            yield pd.DataFrame({"item": i, "doc": [None if d == np.inf else d for _, d in best], "score": [-x for x, _ in best]}).astype({"doc": "Int64"})
        returned()

    out = got.join(segs, "seg").mapInPandas(looked_up, "item long, doc long, score long")
    out = table(_ranked(out, k, "score", F.col("doc").asc_nulls_last()).select("item", F.col("rank").cast("int").alias("rank"), "doc", "score"))
    release(segs, got)
    names = spark.createDataFrame(list(enumerate(q.ids)), f"number long, name {kind}")
    return out.join(names, out["item"] == names["number"]).select(F.col("name").alias("item"), "rank", "doc", "score")
