"""The pipeline's stages against plain versions, on small tables."""

import random
import re

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tessella.llm import packing  # noqa: E402

from .test_table_operators import brute_sets, brute_targets, words  # noqa: E402

CLEAN = "the cat sat on the mat and the dog ran to the house by the river in the rain with a hat".split()


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = random.Random(12)
    rows = []
    for i in range(90):
        rows.append((i, " ".join(rng.choice(CLEAN) for _ in range(rng.randint(30, 300))) + (" mail joe.doe@mail.example.com now." if i % 6 == 0 else "."), "en", f"s{i % 4}"))
    rows += [(200 + i, rows[i][1], "en", "s1") for i in range(10)]  # copies
    rows += [(300 + i, rows[i][1].replace("river", "river", 1) + " end", "en", "s2") for i in range(5)]  # near copies
    rows += [(400, "QX## $$%% ZZ!! " * 30, "en", "s0"), (401, rows[3][1] + " mail joe.doe@mail.example.com now", "en", "s3"), (402, None, None, None), (403, "", "en", "s0")]
    at = tmp_path_factory.mktemp("sf")
    docs = spark.createDataFrame([(*r, len(r[1] or ""), "extra") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, _fp string")
    docs.write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return rows, docs, str(at)


def test_stages(spark, made):
    rows, docs, at = made
    docs = docs.drop("_fp")
    texts = {r[0]: r[1] for r in rows}
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality", "near_duplicates", "personal_data", "mixing", "packing"]

    kept = stage["quality"](spark, docs, at)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert ids == set(texts) - {400}

    kept = corpus_pipeline.table(kept)
    one = corpus_pipeline.table(stage["near_duplicates"](spark, kept, at))
    order = sorted(ids)
    sets = dict(zip(order, brute_sets([texts[i] for i in order]), strict=True))
    root = {i: i for i in order}
    for i in order:
        for j in order:
            a, b = sets[i], sets[j]
            if i < j and (a == b or a and b and len(a & b) >= 0.8 * len(a | b)):
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = {k: new if v == old else v for k, v in root.items()}
    assert {r.doc_id for r in one.collect()} == set(root.values()) and one.columns == docs.columns

    safe = corpus_pipeline.table(stage["personal_data"](spark, one, at))
    assert safe.count() == one.count() and safe.columns == docs.columns
    assert not any(re.search(r"@", r.text or "") for r in safe.collect())

    mixed = corpus_pipeline.table(stage["mixing"](spark, safe, at))
    assert mixed.columns == docs.columns
    sizes, got = {}, {}
    for r in safe.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(words(r.text))
    for r in mixed.collect():
        got[r.source] = got.get(r.source, 0) + len(words(r.text))
        assert r.n_chars == len(r.text)
    assert all(abs(got.get(s, 0) - t) <= 1 for s, t in brute_targets(sizes).items())

    packed = stage["packing"](spark, mixed, at).collect()
    known = packing.Words(None)
    want = sum(len(known.ids(r.text or "")) // 4 + 1 for r in mixed.collect())
    assert sum(r.length for r in packed) == want
    total: dict = {}
    for r in packed:
        total[r.sequence_id] = total.get(r.sequence_id, 0) + r.length
    assert max(total.values()) <= packing.WINDOW


def test_run(spark, made):
    """The whole is its stages one after the other, and its pieces are the plain tokenizer's
    ids of what the mix holds."""
    _, _, at = made
    got = [tuple(r) for r in corpus_pipeline.run(spark, at).select("doc_id", "start", "length", "ids_crc32", "doc_tokens").collect()]
    docs = spark.read.parquet(f"{at}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.table(stage(spark, docs, at))
    whole, want = packing.Words(None).whole, []
    for r in docs.collect():
        want.append((r.doc_id, len(whole.encode(r.text or "", add_special_tokens=False).ids) + 1))
    assert sum(r[2] for r in got) == sum(n for _, n in want)
    assert sorted((r[0], r[4]) for r in got if r[1] == 0) == sorted(want)


def test_empty(spark, made):
    _, docs, at = made
    none = docs.drop("_fp").where("false")
    for _, f in corpus_pipeline.STAGES:
        assert f(spark, none, at).count() == 0


def test_extra_columns_clash(spark, made):
    _, docs, at = made
    extra = docs.selectExpr("*", "1 AS size", "2 AS _n", "'x' AS _kept", "3 AS kept", "4 AS fp", "5 AS c0")
    for name in ("quality", "near_duplicates", "personal_data", "mixing"):
        out = dict(corpus_pipeline.STAGES)[name](spark, extra, at)
        assert out.columns == extra.columns and out.count() > 0


def test_sizes_are_words():
    assert np.array_equal([len(words(t)) for t in ("a b", None, " ")], [2, 0, 0])
