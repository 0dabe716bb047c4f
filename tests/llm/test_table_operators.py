"""Operators over whole tables: exact totals, brute force and hard rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.llm import mixing, near_dup, packing, shard, topk

from .test_text_operators import hard_rows


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w, total = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, 1.5 * sum(sizes.values())
    full = set()
    while True:
        rest = [s for s in names if s not in full]
        level = (total - sum(2 * sizes[s] for s in full)) / max(1e-9, sum(w[s] for s in rest))
        over = {s for s in rest if w[s] * level > 2 * sizes[s] + 1e-9}
        if not over:
            return {s: 2.0 * sizes[s] if s in full else w[s] * level for s in names}
        full |= over


def mixed_docs(spark):
    rng = random.Random(4)
    rows = [(i, " ".join("w" for _ in range(rng.randint(0, 700))), rng.choice(["a", "b", "Z", "é", None, "hot", "hot", "hot"])) for i in range(400)]
    rows += [(400, None, "a"), (401, "", "only-empty"), (None, "x y", "b"), (3, "p q r", "b"), (3, "p q r", "b")]
    return rows, spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, text string, source string, size int, target int, src string")


def test_mixing(spark):
    rows, docs = mixed_docs(spark)
    mix = mixing.plan(docs, keep=["doc_id", "source"])
    out = mixing.taken(mix).collect()
    assert Counter((r.doc_id, r.size) for r in out) == Counter((i, len(words(t))) for i, t, _ in rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    want, got = brute_targets(sizes), Counter()
    for r in out:
        got[r.source] += r.taken
        assert r.taken <= 2 * r.size and abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source]
    assert all(abs(got[s] - t) <= 1 for s, t in want.items())
    again = mixing.taken(mixing.plan(docs.repartition(3), keep=["doc_id", "source"])).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, out))
    # Slots: every pass reads each block once at most, and blocks stay in range.
    slots = mix.slots.collect()
    assert max(Counter((s.src, s["pass"], s.block) for s in slots).values()) == 1
    # Texts: their words are those taken.
    texts = mixing.mixed_texts(docs, mixing.plan(docs)).collect()
    told = Counter()
    for r in texts:
        told[r.source] += len(words(r.text))
    assert told == +got


def test_mixed_texts_keep_their_white_space(spark):
    """Every text of the mix is a row of the plan's runs, character by character."""
    rng = random.Random(9)
    gap = lambda: rng.choice([" ", "  ", "\n", "\n\n", "\t", " \r\n "])
    rows = [(i, "".join(gap() * (k > 0) + f"w{i}-{k}" for k in range(rng.randint(1, 900))), rng.choice("abc")) for i in range(60)]
    rows += [(100, "\n lead and trail \n", "a"), (101, "x" * 100_000, "b"), (102, " ".join(f"v{k}" for k in range(20_000)) + "\n", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    source = {i: t for i, t, _ in rows}
    parts = 0
    for r in mixing.mixed_texts(docs, mixing.plan(docs)).collect():
        if r.text == source[r.doc_id]:
            continue
        parts += 1
        units = re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", source[r.doc_id])
        mine = re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", r.text)
        at = -1
        for u in mine:  # in order, each with the white space that follows it
            at = units.index(u, at + 1)
        assert "".join(mine) == r.text
    assert parts > 3


def test_mixing_empty(spark):
    _, docs = mixed_docs(spark)
    assert mixing.taken(mixing.plan(docs.where("false"))).count() == 0
    only = mixing.taken(mixing.plan(docs.where("source = 'only-empty'"))).collect()
    assert [(r.size, r.target, r.taken) for r in only] == [(0, 0.0, 0)]


def test_permutation(spark):
    for n in (1, 2, 7, 64, 101):
        df = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(5)).alias("x"))
        assert sorted(r.x for r in df.collect()) == list(range(n))


def test_sharding(spark):
    rows, docs = mixed_docs(spark)
    out = shard.place(docs, part_rows=20).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = [len(by[s]) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1
    assert Counter((r.size, r.text_crc32) for r in out) == Counter((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, _ in rows)
    assert shard.place(docs.where("false")).count() == 0
    assert shard.place(docs.limit(3)).count() == 3
    with pytest.raises(ValueError):
        shard.place(docs.withColumn("slot", F.lit(1)), keep=["doc_id", "slot"])


def test_sharding_in_two_levels(spark):
    """More rows than the coarse matrix holds: the same law, every pair of shards and parts met."""
    docs = spark.range(4000).selectExpr("id AS doc_id", "repeat('x', cast(id % 50 as int)) AS text")
    out = shard.place(docs, part_rows=20, max_parts=16).collect()
    assert sorted(r.doc_id for r in out) == list(range(4000))
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r)
    assert sorted(by) == list(range(8)) and all(len(v) == 500 and sorted(r.slot for r in v) == list(range(500)) for v in by.values())
    # Ids are spread over shards and slots: the mean of each shard's ids and of its first slots' is near the middle.
    assert all(abs(sum(r.doc_id for r in v) / 500 - 2000) < 250 for v in by.values())
    first = [r.doc_id for r in out if r.slot < 60]
    assert abs(sum(first) / len(first) - 2000) < 250
    again = shard.place(docs.repartition(3), part_rows=20, max_parts=16).collect()
    assert set(map(tuple, again)) == set(map(tuple, out))


def test_matrix_is_uniform():
    """A shuffle of 4 rows from two partitions into two shards: 1/6, 4/6, 1/6."""
    seen = Counter(shard.matrix([2, 2], [2, 2], np.random.default_rng(s))[0][0] for s in range(3000))
    assert abs(seen[1] / 3000 - 4 / 6) < 0.04 and abs(seen[0] / 3000 - 1 / 6) < 0.03


def test_hypergeometric_beyond_numpy():
    rng = np.random.default_rng(1)
    kept, shard._BIG = shard._BIG, 10
    try:
        for good, bad, n in ((30, 50, 20), (50, 30, 60), (7, 100, 90)):
            x = [shard.hypergeometric(good, bad, n, rng) for _ in range(4000)]
            mean = n * good / (good + bad)
            var = mean * bad / (good + bad) * (good + bad - n) / (good + bad - 1)
            assert min(x) >= max(0, n - bad) and max(x) <= min(n, good)
            assert abs(np.mean(x) - mean) < 4 * math.sqrt(var / 4000) and 0.85 < np.var(x) / var < 1.15
    finally:
        shard._BIG = kept
    assert 0 < shard.hypergeometric(10**10, 3 * 10**10, 10**6, rng) < 10**6


def brute_sets(texts):
    out = []
    for t in texts:
        w = words(t)
        out.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    return out


def near_docs(spark):
    rng = random.Random(8)
    rows = []
    for g in range(12):
        base = [f"g{g}w{rng.randint(0, 400)}" for _ in range(120)]
        for c in range(rng.choice([1, 2, 5, 40])):
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = f"new{rng.random()}"
            rows.append((len(rows), " ".join(w)))
    rows += [(900, rows[0][1]), (901, rows[0][1]), (901, rows[0][1]), (902, None), (903, ""), (904, "a b"), (905, "a b"), (None, "some words without an id here at all")]
    return rows, spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, fp int, copies string, u int")


def test_jaccard_join(spark):
    rows, docs = near_docs(spark)
    kept, near_dup.BLOCK = near_dup.BLOCK, 8  # several blocks in a bucket
    try:
        out = near_dup.join(docs).collect()
    finally:
        near_dup.BLOCK = kept
    sets = brute_sets([t for _, t in rows])
    n = len(rows)
    links = [[j for j in range(n) if j != i and ((sets[i] == sets[j]) if not (sets[i] and sets[j]) else len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))] for i in range(n)]
    root = list(range(n))
    for _ in range(n):
        new = [min([root[i], *(root[j] for j in links[i])]) for i in range(n)]
        if new == root:
            break
        root = new
    ids = [i for i, _ in rows]
    least = {r: min((ids[i] for i in range(n) if root[i] == r and ids[i] is not None), default=None) for r in set(root)}
    assert Counter((r.doc_id, r.class_id, r.n_links) for r in out) == Counter((ids[i], least[root[i]], len(links[i])) for i in range(n))
    assert near_dup.join(docs.where("false")).count() == 0
    one = near_dup.one_of_each(docs).collect()
    assert len(one) == len(set(root)) and all(r.copies == "x" for r in one)


def test_posterior_bounds():
    least = near_dup.fewest()
    assert list(least) == sorted(least) and all(0 < m < 0.8 * n for n, m in least.items())


def test_topk(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=12)]) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(30)]  # ties
    rows += [(2000, None), (2001, [1.0, None]), (2050, [float("nan")] * 12), (2100, [float("inf")] * 12), (2150, [0.5]), (None, rows[1][1]), (1000, rows[0][1])]
    df = spark.createDataFrame([(i, v, 7) for i, v in rows], "vec_id long, embedding array<float>, score int")
    out = topk.search(df, F.col("vec_id") % 50 == 0, block=64, query_block=3).collect()
    vecs = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    want = set()
    for q, v in {i: v for i, v in vecs if i % 50 == 0}.items():
        found = sorted((-sum(a * b for a, b in zip(v, x, strict=False)), i) for i, x in vecs if i != q)[:5]
        want |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(found)}
    assert {(r.query_id, r.rank, r.vec_id, r.score) for r in out} == want and len(out) == len(want)
    assert topk.search(df.where("false"), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.search(df.where("vec_id < 3"), F.col("vec_id") % 50 == 0).count() == 2


def test_topk_without_components(spark):
    df = spark.createDataFrame([(0, []), (1, []), (50, []), (51, None)], "vec_id long, embedding array<float>")
    out = topk.search(df, F.col("vec_id") % 50 == 0).collect()
    assert {tuple(r) for r in out} == {(0, 1, 1, 0), (0, 2, 50, 0), (50, 1, 0, 0), (50, 2, 1, 0)}
    mixed = spark.createDataFrame([(0, []), (1, [1.0, -2.0]), (50, [-1.0]), (50, [2.0]), (2, [0.5, 0.5, 0.5])], "vec_id long, embedding array<float>")
    out = topk.search(mixed, F.col("vec_id") % 50 == 0, k=2).collect()
    assert {tuple(r) for r in out} == {(0, 1, 1, 0), (0, 2, 2, 0), (50, 1, 0, 0), (50, 2, 2, -256 * 128)}


def test_topk_proof_stops_early():
    """The proof comes before half of the postings are read, and the result is exact."""
    rng = np.random.default_rng(7)
    x = np.floor(rng.normal(size=(8192, 64)) * 32).astype(np.int64)
    ids = rng.permutation(8192) * 3
    index = topk.Index(ids, x)
    for k in range(20):
        got, score = index.search(int(ids[k]), x[k], 5)
        exact = x @ x[k]
        order = [i for i in np.lexsort((ids, -exact)) if i != k][:5]
        assert got.tolist() == ids[order].tolist() and score.tolist() == exact[order].tolist()
    assert index.read < 0.5 * 20 * x.size
    line = float(np.sort(x @ x[0])[-4])
    assert set(index.search(int(ids[0]), x[0], 5, line)[1].tolist()) == {s for s in (x[1:] @ x[0]).tolist() if s >= line}


def test_cached_ids_are_the_tokenizers():
    known = packing.Words(None)
    rng = random.Random(6)
    letters = [chr(c) for c in range(33, 0x250)] + [" "] * 60 + list("'svetlmd" * 10)
    texts = ["don't IT'S a_b <|endoftext|> x", "Σας ΣΑΣ 日本 語", "a\x1cb\xa0c", "12ab34 ²³", ""] + ["".join(rng.choice(letters) for _ in range(40)) for _ in range(300)]
    for t in texts:
        want = [*known.whole.encode(t, add_special_tokens=False).ids]
        assert np.frombuffer(known.ids(t), "<u4").tolist() == want


def test_packing(spark):
    known = packing.Words(None)
    for parts in (1, 4):
        docs = hard_rows(spark).repartition(parts)
        out = packing.pack(docs, with_ids=True).collect()
        by, pieces = {}, {}
        for r in out:
            by.setdefault(r.sequence_id, []).append((r.offset, r.length))
            pieces.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, bytes(r.ids)))
            assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        for v in by.values():
            v.sort()
            assert [o for o, _ in v] == [sum(n for _, n in v[:k]) for k in range(len(v))] and sum(n for _, n in v) <= 2048
        assert sum(sum(n for _, n in v) < 2048 for v in by.values()) <= parts
        assert sum(r.length for r in out) == sum(r.doc_tokens for r in out if r.start == 0)
        for d in docs.collect():
            ids = known.whole.encode(d.text or "", add_special_tokens=False).ids + [1]
            mine = sorted(set(pieces[d.doc_id, len(ids)]))
            assert np.frombuffer(b"".join(x for _, x in mine), "<u4").tolist() == ids
    assert packing.pack(docs.where("false")).count() == 0


def test_closing_cuts():
    """Whatever is open, at most one window stays open, and each id keeps its place."""
    rng = random.Random(8)
    for _ in range(50):
        held, want = {}, {}
        for w in range(rng.randint(0, 12)):
            sizes, room = [], rng.randint(1, 15)
            while room > 0:
                sizes.append(rng.randint(1, room))
                room -= sizes[-1]
            held[w] = []
            for k, n in enumerate(sizes):
                ids = np.array([rng.randrange(1000) for _ in range(n)], "<u4").tobytes()
                held[w].append((f"{w}-{k}", 0, ids, n))
                want[f"{w}-{k}"] = ids
        out = packing.closed(held, 16)
        sums = [sum(len(p[2]) for p in ps) // 4 for ps in out.values()]
        assert sum(x < 16 for x in sums) <= 1 and max(sums, default=0) <= 16
        got = {}
        for ps in out.values():
            for i, start, ids, _ in ps:
                got.setdefault(i, []).append((start, ids))
        assert {i: b"".join(x for _, x in sorted(v)) for i, v in got.items()} == want


def test_sum_of_squares_rule():
    """Every placement has the least sum of squares among all choices."""
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 17, 400)
    packer, fill = packing.Packer(16), {}
    for s in sizes.tolist():
        w, o = packer.place(s)
        assert fill.get(w, 0) == o

        def after(h, s=s):
            c = Counter(f for f in fill.values() if f < 16)
            if h:
                c[h] -= 1
            if h + s < 16:
                c[h + s] += 1
            return sum(x * x for x in c.values())

        best = min(after(h) for h in {0, *(f for f in fill.values() if f + s <= 16)})
        assert after(o) == best
        fill[w] = o + s
        assert fill[w] <= 16


def test_equal_rows_are_spread(spark):
    """More equal rows than a task holds, with other columns that tell them apart."""
    docs = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("t")).alias("text"), F.col("id").alias("n"))
    out = shard.place(docs, keep=["doc_id", "n"], part_rows=100, max_parts=16).toPandas()
    assert sorted(out.n) == list(range(3000)) and sorted(out.groupby("shard").size()) == [375] * 8
    assert all(sorted(g.slot) == list(range(375)) for _, g in out.groupby("shard"))
    null = out[out.doc_id.isna()]
    assert 60 < null.groupby("shard").size().min() and null.groupby("shard").size().max() < 190
