"""Fingerprints, whitening and ranked search against brute force, and their hard rows."""

import math
import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessella.llm import lexical, simhash, whitening
from tessella.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def plain_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, distance=3):
    """prints: id -> fingerprint. The least id reachable, pair by pair."""
    ids = sorted(prints)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    p = np.array([prints[i] for i in ids], np.uint64)
    for k, i in enumerate(ids):
        x = p[k + 1 :] ^ p[k]
        near = np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=1) <= distance
        for j in np.flatnonzero(near):
            a, b = find(i), find(ids[k + 1 + j])
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@tables
def test_simhash_query(spark):
    docs = dict(duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall())
    out = QUERIES["op11_simhash"](spark, DATA).collect()
    prints = {i: plain_print(t) for i, t in docs.items()}
    want = plain_components(prints)
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in out) == sorted((i, f"{prints[i]:016x}", want[i]) for i in docs)
    assert out[0].asDict().keys() == {"doc_id", "fingerprint", "component_id"}


def test_simhash_texts():
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n\x0b") == 0
    rng = random.Random(2)
    long = " ".join(rng.choice(["Aé", "b", "C", "日本", "x" * 50]) + str(rng.randint(0, 9999)) for _ in range(70_000))
    for t in ("One", "one TWO", "one two three", "É É b\x1cc d", "a a a a a a a", long):
        assert simhash.fingerprint(t) == plain_print(t)


def scattered(rng, n):
    """Fingerprints in dense clumps, in chains of steps of 3 bits, and alone."""
    out = {0, 1, (1 << 64) - 1}
    while len(out) < n:
        f = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 40])):
            out.add(f)
            f ^= sum(1 << b for b in rng.sample(range(64) if rng.random() < 0.5 else range(32), rng.randint(1, 4)))
    return sorted(out)


@pytest.mark.parametrize("hot", [0, 2, simhash.HOT])
def test_links_whatever_is_hot(spark, hot):
    """The components are those of all pairs, by questions alone, by meeting values alone, and by both."""
    prints = scattered(random.Random(hot), 400)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), hot).collect()
    assert all(bin((e.u ^ e.v) & (1 << 64) - 1).count("1") <= 3 for e in edges)
    want = plain_components(dict(enumerate(prints)))
    at = {s: i for i, s in enumerate(signed)}
    root = {i: i for i in at.values()}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for e in edges:
        a, b = find(at[e.u]), find(at[e.v])
        root[max(a, b)] = min(a, b)
    assert {i: find(i) for i in root} == want


def test_simhash_hard_rows(spark):
    rows = [(5, None, "x"), (4, "", "y"), (None, " ", "z"), (7, "a b c d e f g", "x"), (7, "a b c d e f g", "x"), (3, "a b c d e f g", "x"), (None, "lonely words stand here", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    out = Counter(map(tuple, simhash.linked(docs).select("doc_id", "component_id", "copies").collect()))
    assert out == Counter([(5, 4, 3), (4, 4, 3), (None, 4, 3), (7, 3, 3), (7, 3, 3), (3, 3, 3), (None, None, 1)])
    assert simhash.linked(docs.where("false")).count() == 0


def plain_whitening(x, k=4):
    """Of whole vectors: n, deviations, eigenvalues, vectors (unit columns) and trace."""
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    c = (n * fit - s) / n
    values, vectors = np.linalg.eigh(c.T @ c / n)
    return n, [int(sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s, strict=True))) for r in x], values[::-1][:k], vectors[:, ::-1][:, :k], values.sum(), (n * x - s) / n


@tables
def test_whitening_query(spark):
    raw = duckdb.sql(f"SELECT vec_id, embedding FROM '{DATA}/embeddings.parquet' ORDER BY vec_id").fetchall()
    ids, x = [r[0] for r in raw], np.floor(256 * np.array([r[1] for r in raw], np.float32).astype(np.float64)).astype(np.int64)
    n, deviation, values, vectors, trace, centred = plain_whitening(x)
    out = QUERIES["op12_whitening"](spark, DATA).toPandas().sort_values(["component", "vec_id"])
    assert list(out.columns) == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and set(out.n) == {n}
    assert out.identity_error.nunique() == 1 and out.identity_error.iloc[0] < 1e-12
    for j, g in out.groupby("component"):
        want = centred @ vectors[:, j - 1] / math.sqrt(values[j - 1])
        got = g.whitened.to_numpy()
        assert list(g.vec_id) == ids and list(g.deviation) == deviation
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-9
        assert abs(g.explained.iloc[0] * trace / values[j - 1] - 1) < 1e-12
    assert set(out.component) == {1, 2, 3, 4}


def test_lobpcg():
    """Spectra with gaps, without, of low rank and of one dimension; the product is all it sees."""
    rng = np.random.default_rng(3)
    for spectrum in (1 / np.arange(1, 121), np.linspace(1, 0.9, 64), [5, 1, 1, 1, 1, 0, 0], [3.0], np.r_[[1e6], np.full(40, 1.0)], np.zeros(9)):
        q = np.linalg.qr(rng.standard_normal((len(spectrum), len(spectrum))))[0]
        a = q * np.sort(spectrum)[::-1] @ q.T
        values, vectors, residuals, _ = whitening.lobpcg(lambda b, a=a: a @ b, len(spectrum), 3)
        top = max(np.max(spectrum), 1e-300)
        assert np.allclose(values, np.sort(spectrum)[::-1][:3], atol=1e-11 * top, rtol=0) and (residuals <= 1e-11 * top).all()
        assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-12)
        assert np.abs(a @ vectors - vectors * values).max() <= 1e-11 * top


def test_whitening_hard_rows(spark):
    nan, inf = float("nan"), float("inf")
    rng = random.Random(1)
    good = [(i, [rng.uniform(-1, 1) for _ in range(6)]) for i in range(60)]
    rows = good + [(3, good[3][1])] * 40 + [(None, [0.5, 0.25]), (70, []), (71, None), (72, [1.0, nan]), (73, [inf]), (74, [1.0, None])]
    df = spark.createDataFrame([(*r, 1.5) for r in rows], "vec_id long, embedding array<double>, whitened double")
    out, model = whitening.whitened(df)
    got = out.collect()
    used = [r for r in rows if r[1] is not None and all(v is not None and math.isfinite(v) for v in r[1])]
    x = np.array([[math.floor(256 * v) for v in (r[1] + [0.0] * 6)[:6]] for r in used])
    n, deviation, values, _, trace, centred = plain_whitening(x)
    assert model.n == n == 62 and np.allclose(model.values, values, rtol=1e-12) and abs(model.trace / trace - 1) < 1e-12 and model.identity_error < 1e-12
    assert Counter((r.vec_id, int(r.deviation)) for r in got) == Counter((u[0], d) for u, d in zip(used, deviation, strict=True))
    none, no_model = whitening.whitened(df.where("false"))
    assert none.count() == 0 and no_model is None
    one, flat = whitening.whitened(df.where("vec_id = 3"))
    assert flat.n == 1 and [r.whitened for r in one.collect()] == [[]] * 41
    line, rank = whitening.whitened(spark.range(5).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("double"), F.col("id") * 2.0).alias("embedding")))
    assert rank.n == 5 and {len(r.whitened) for r in line.collect()} == {1}


def test_deviations_beyond_64_bits():
    x = np.array([[10**12, -(10**12)], [3, 4]])
    sums = [int(v) for v in x.sum(axis=0)]
    n = 10**7
    assert whitening.deviations(x, n, sums) == [sum((n * int(v) - s) ** 2 for v, s in zip(r, sums, strict=True)) for r in x]
    assert np.allclose(whitening.centred(x, n, sums), x - np.array(sums) / n)


def plain_search(docs, items, k=10):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    held = [(i, Counter(split(t))) for i, t in docs if split(t)]
    n, total = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in items.items():
        asked, found = Counter(split(text)), []
        for i, c in held:
            m = 25 + 75 * c.total() * n // total
            score = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t, times in asked.items() if c[t])
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return out


@pytest.mark.parametrize("sizes", [(1 << 14, 1 << 21, 1 << 25), (7, 60, 40)])
def test_search_against_every_document(spark, monkeypatch, sizes):
    """Also in segments of seven documents and in rounds of forty characters of queries."""
    rng = random.Random(8)
    words = ["The", "of", "été", "日本", "x1", *[f"w{i}" for i in range(60)]]
    some = lambda n: " ".join(rng.choices(words, weights=[200, 100, 30, 20, 10, *range(60, 0, -1)], k=n))
    docs = [(i, some(rng.choice([1, 5, 30, 300])) + rng.choice([".", "-the", "", "\x00"])) for i in range(300)]
    docs += [(i, docs[i % 5][1]) for i in range(300, 360)] + [(7, docs[7][1]), (None, docs[3][1]), (400, None), (401, " ... ")]
    items = {1: some(4), 2: some(30), 3: "", 4: None, 5: "the the THE of", 6: "w59 unheard-of", 7: docs[20][1], None: "w1 w2"}
    monkeypatch.setattr(lexical, "SEGMENT_DOCS", sizes[0])
    monkeypatch.setattr(lexical, "SEGMENT_POSTINGS", sizes[1])
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, score int").repartition(5)
    q = spark.createDataFrame([*items.items(), (1, items[1])], "item_id long, text string")
    got = lexical.search(d, q, most_chars=sizes[2]).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(plain_search(docs, items), key=key)


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert [tuple(r)[:3] for r in lexical.search(docs, items).collect()] == [(1, 1, 1)]
    for d, q in ((docs.where("false"), items), (docs, items.where("false")), (docs.where("text is null"), items), (docs, items.withColumn("text", F.lit("?")))):
        assert lexical.search(d, q).count() == 0
    assert lexical.search(docs, items).columns == ["item_id", "rank", "doc_id", "score"]


def test_uniform_threshold_prunes(spark):
    """A text that repeats the query sets a bound that most other postings of common words miss."""
    docs = [(i, f"common words stand here {'filler ' * (i % 50)} w{i % 97}") for i in range(3000)] + [(5000, "rare treasure common words")]
    told = {}
    keep = lexical.fetched

    def watched(index, t, need):
        told["all"], told["sent"] = index, keep(index, t, need)
        told["n"] = sum(len(lexical._read(r.docs)) for r in index.collect()), sum(len(lexical._read(r.docs)) for r in told["sent"].collect())
        return told["sent"]

    lexical.fetched = watched
    try:
        out = lexical.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, "rare treasure common words")], "item_id long, text string"), k=1).collect()
    finally:
        lexical.fetched = keep
    assert [(r.doc_id, r["rank"]) for r in out] == [(5000, 1)] and told["n"][1] < told["n"][0] / 100
