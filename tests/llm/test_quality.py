"""The quality classifier against a version written from the published formulas:
interpolated modified Kneser-Ney with dictionaries, quantiles of sorted lists."""

import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessella.llm import ngram_lm
from tessella.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def said(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def kn_discounts(counts):
    """D1, D2 and D3+ of Chen and Goodman, from how many counts are exactly 1, 2, 3 and 4."""
    n1, n2, n3, n4 = (sum(c == i for c in counts) for i in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 else 0
    raw = [1 - 2 * y * n2 / n1 if n1 else 0, 2 - 3 * y * n3 / n2 if n2 and n1 else 0, 3 - 4 * y * n4 / n3 if n3 and n1 else 0]
    d = [x if x > 0 else (i + 1) / 2 for i, x in enumerate(raw)]
    return lambda c: 0 if c == 0 else d[min(c, 3) - 1]


def tokens(text):
    """(kind of the last symbol of the word before, word) for each word."""
    w = said(text)
    kind = lambda c: "A" if c.isupper() else "a" if c.isalpha() else "9" if c.isdigit() else c
    return [(kind(b[-1]) if b else "\x02", x) for b, x in zip([None, *w], w)]


class BruteModel:
    def __init__(self, texts):
        self.words = {w for t in texts for w in said(t)}
        n = ngram_lm.ORDER
        top = Counter(g for t in texts for x in tokens(t) for g in self.grams(x))
        self.levels = {n: top}
        for k in range(n - 1, 0, -1):
            self.levels[k] = Counter(g[1:] for g in self.levels[k + 1])  # continuation counts
        self.drop = {k: kn_discounts(c.values()) for k, c in self.levels.items()}
        self.by = {k: defaultdict(list) for k in self.levels}
        for k, c in self.levels.items():
            for g, x in c.items():
                self.by[k][g[:-1]].append(x)

    @staticmethod
    def grams(token):
        """Symbols with the four before them, no further back than the last symbol of the word before."""
        p = "\x02\x02" + token[0] + " " + token[1] + "\x03"
        return [p[i - 4 : i + 1] for i in range(4, len(p))]

    def p(self, g):
        k = len(g)
        if k == 0:
            return 1 / (1 + len(self.levels[1]))
        mine, low = self.by[k].get(g[:-1]), self.p(g[1:])
        if not mine:
            return low
        c, d = self.levels[k].get(g, 0), self.drop[k]
        return (max(0, c - d(c)) + sum(map(d, mine)) * low) / sum(mine)

    def price(self, token):
        return -sum(math.log2(self.p(g)) for g in self.grams(token))


def brute_judged(docs, trusted):
    """docs: (id, text, lang). bits, worst and verdict of each."""
    fold = [zlib.crc32((t or "").encode()) % ngram_lm.FOLDS for _, t, _ in docs]
    model = BruteModel([t for (i, t, _), f in zip(docs, fold, strict=True) if i in trusted and f])
    price = {x: round(model.price(x) * ngram_lm.STEPS) / ngram_lm.STEPS for _, t, _ in docs for x in tokens(t)}
    out = []
    for _, t, _ in docs:
        w = tokens(t)
        odd = [price[x] / (len(x[1]) + ngram_lm.EDGES) for x in w if x[1] not in model.words]
        out.append((sum(len(x) + 1 for _, x in w), sum(price[x] for x in w), max(odd, default=0.0)))

    def limits(rows):
        mean = sum(b for _, b, _ in rows) / max(1, sum(n for n, _, _ in rows))
        means = sorted((b + ngram_lm.PRIOR * mean) / (n + ngram_lm.PRIOR) for n, b, _ in rows)
        worst = sorted(w for _, _, w in rows)
        at = lambda xs, q: (math.floor(xs[math.ceil(q * len(xs)) - 1] * ngram_lm.STEPS) + 1) / ngram_lm.STEPS
        odd = at(worst, ngram_lm.WORST)
        return mean, at(means, ngram_lm.MEAN) + ngram_lm.MARGIN, odd + ngram_lm.WORST_MARGIN if odd > 1 / ngram_lm.STEPS else math.inf

    calibration = defaultdict(list)
    for (i, _, lang), f, x in zip(docs, fold, out, strict=True):
        if i in trusted and not f:
            calibration[lang].append(x)
    every = [x for xs in calibration.values() for x in xs]
    whole = limits(every) if every else (0.0, math.inf, math.inf)
    if len(every) < ngram_lm.LEAST:
        whole = (*whole[:2], math.inf)
    verdicts = []
    for (_, _, lang), (n, bits, worst) in zip(docs, out, strict=True):
        own = calibration.get(lang, [])
        mean, high, most = limits(own) if len(own) >= ngram_lm.LEAST else whole
        score = (bits + ngram_lm.PRIOR * mean) / (n + ngram_lm.PRIOR)
        verdicts.append((n, bits, score, high, worst, most, score <= high and worst <= most))
    return verdicts


def agree(spark, rows, trusted):
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, lang string, bits int, key string").repartition(3)
    ids = spark.createDataFrame([(i,) for i in trusted], "doc_id long")
    got = Counter()
    for r in ngram_lm.judged(docs, ids).collect():
        got[r.doc_id, r.lang, r._n, round(r._bits, 1), round(r._score, 3), round(r._high, 3), round(r._worst, 3), round(r._most, 3), r._kept] += 1
    want = Counter((i, lang, n, round(b, 1), round(s, 3), round(h, 3), round(w, 3), round(m, 3), k) for (i, _, lang), (n, b, s, h, w, m, k) in zip(rows, brute_judged(rows, set(trusted) - {None}), strict=True))
    far = [x for x in want if x not in got]
    assert all(any(x[:3] == y[:3] and x[-1] == y[-1] and np.allclose(x[3:8], y[3:8], atol=0.15) for y in got) for x in far) and len(far) <= 0.02 * len(want) + 1
    assert sum(got.values()) == len(rows)
    return got


def texts_of(rng, parts, count):
    """Texts of common words, and now and then a new one of the same parts."""
    made = lambda: "".join(rng.choice(parts) for _ in range(rng.randint(1, 5)))
    common = [made() for _ in range(120)]
    return [" ".join(made() if rng.random() < 0.05 else rng.choice(common) for _ in range(rng.randint(5, 60))) for _ in range(count)]


def hard(rng):
    english, german = texts_of(rng, "the on ing an er st wh".split(), 260), texts_of(rng, "der ein sch ung über keit ße".split(), 90)
    rows = [(i, t, "en") for i, t in enumerate(english)] + [(1000 + i, t, "de") for i, t in enumerate(german)]
    rows += [(2000, "ZXQ## $$$ %%% QQ!! " * 20, "en"), (2001, None, None), (2002, "", "xx"), (2003, "the on", None), (None, "the ing", "en"), (0, rows[0][1], "en"), (2004, " \t\n ", "de")]
    rows += [(2005, rows[3][1] + " kkvqzx " + rows[4][1], "en"), (2006, "漢字かな交じり文 " * 30, "ja"), (2007, " ".join(f"the{i}on" for i in range(30_000)), "en"), (2008, "x" * 300_000, "en"), (2009, rows[7][1].replace(" ", "\x1c"), "en")]
    return rows


def test_judged_matches_brute_force(spark):
    rows = hard(random.Random(3))
    got = agree(spark, rows, [i for i, _, _ in rows if i is not None and i < 2000] + [None])
    kept = {x[0]: x[-1] for x in got}
    assert not any(kept[i] for i in (2000, 2005, 2006)) and all(kept[i] for i in (2001, 2002, 2003, None, 2004))
    assert sum(kept.values()) > 0.97 * len(kept)


def test_closed_vocabulary(spark):
    """Where all trusted words are known, an unknown word alone rejects nothing."""
    rng = random.Random(6)
    say = lambda: " ".join(rng.choice("the cat sat on a mat by day".split()) for _ in range(60))
    rows = [(i, say(), "en") for i in range(300)] + [(500, say() + " end", "en"), (501, "QX## $$%% " * 40, "en")]
    kept = {x[0]: x[-1] for x in agree(spark, rows, range(300))}
    assert not kept[501] and all(v for k, v in kept.items() if k != 501)


def test_bag_borders_change_nothing(spark, monkeypatch):
    """Small bags and many shards give what one bag and one shard give."""
    rows = hard(random.Random(4))[:200]
    monkeypatch.setattr(ngram_lm, "BLOCK_WORDS", 500)
    monkeypatch.setattr(ngram_lm, "SHARD_TOKENS", 300)
    monkeypatch.setattr(ngram_lm, "SIZED_BY", 2)
    agree(spark, rows, [i for i, _, _ in rows])


def test_untrusted_and_empty(spark):
    rows = [(1, "some text", "en"), (2, None, None), (None, "", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    none = spark.createDataFrame([], "doc_id long")
    assert ngram_lm.judged(docs, none).where("_kept").count() == 3
    assert ngram_lm.judged(docs.where("false"), none).count() == 0
    assert ngram_lm.accepted(docs, none).count() == 3


def test_probabilities_sum_to_one():
    model = BruteModel(["the cat sat on the mat", "a hat that the cat has"])
    symbols = [g for g in model.levels[1]]
    for ctx in ("\x02\x02th", "\x02\x02\x02c", "zzzz"):
        assert abs(sum(model.p(ctx + s) for s in symbols) + model.p(ctx + "￿") - 1) < 1e-9


def test_packing_of_numbers():
    rng = np.random.default_rng(1)
    for width in (4, 8):
        a = rng.integers(0, 1 << 8 * width - 1, 1000)
        assert (ngram_lm.unpacked(ngram_lm.packed(a, width), width) == a).all()
    assert len(ngram_lm.unpacked(ngram_lm.packed(np.array([], np.int64)))) == 0
    assert ngram_lm.unlisted(ngram_lm.listed([])) == []


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang").collect()]
    trusted = {r.doc_id for r in spark.read.parquet(f"{DATA}/labels.parquet").collect() if r.quality == 1 and not r.toxic}
    out = {r.doc_id: r for r in QUERIES["op4_quality"](spark, DATA).collect()}
    assert len(out) == len(docs)
    for (i, t, _), (n, bits, score, high, worst, most, kept) in zip(docs, brute_judged(docs, trusted), strict=True):
        r = out[i]
        assert r.n_words == len(said(t)) and r.n_priced == n and r.n_symbols == len(t or "") and r.kept == kept
        assert np.allclose([r.score, r.high, r.worst, min(r.most, 99), math.log2(r.perplexity)], [score, high, worst, min(most, 99), bits / max(n, 1)], atol=2e-3)
