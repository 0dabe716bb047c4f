"""The registered queries on the smallest tables: SQL where there is one, contracts elsewhere."""

import hashlib
import math
import os
import zlib

import duckdb
import numpy as np
import pytest

from tessella.llm import packing, pii
from tessella.llm.queries import QUERIES
from tessella.llm.sql import SQL

from .test_table_operators import brute_targets, words
from .test_text_operators import brute_base

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "pages", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def texts(duck):
    return dict(duck.sql("SELECT doc_id, text FROM documents").fetchall())


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), duck.sql(SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda df: sorted(map(tuple, df[cols].astype(object).values.tolist()))
    assert rows(got) == rows(want)


def test_mixing(spark, duck):
    out = QUERIES["op1_mixing"](spark, DATA).toPandas().set_index("doc_id")
    docs = duck.sql("SELECT doc_id, text, source FROM documents").fetchall()
    sizes: dict = {}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + len(words(t))
    want = brute_targets(sizes)
    taken: dict = {}
    for i, t, s in docs:
        r = out.loc[i]
        assert r["size"] == len(words(t)) and abs(r.target - want[s]) < 1e-6 and r.taken <= 2 * r["size"]
        taken[s] = taken.get(s, 0) + r.taken
    assert all(abs(taken[s] - w) <= 1 for s, w in want.items())


def test_pages(spark, duck):
    out = QUERIES["op2_html"](spark, DATA).toPandas()
    assert list(out.columns) == ["page_id", "url", "text", "n_chars"] and len(out) == duck.sql("SELECT count(*) FROM pages").fetchall()[0][0]
    assert (out.text.str.len() == out.n_chars).all() and not out.text.str.contains("©|track\\(").any()


def test_personal_data(spark, texts):
    for r in QUERIES["op5_pii"](spark, DATA).collect():
        base = brute_base(texts[r.doc_id])
        told = pii.joined(base)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest() and r.spans.startswith(told)


def test_shards(spark, texts):
    out = QUERIES["op7_sharding"](spark, DATA).toPandas()
    assert sorted(out.doc_id) == sorted(texts) and set(out.law) == {"rows"} and out.grown_shard.isna().all()
    for shard, g in out.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g))) and len(g) in (math.floor(len(texts) / 8), math.ceil(len(texts) / 8)) and 0 <= shard < 8
    assert all(z == zlib.crc32(texts[i].encode()) and n == len(texts[i].encode()) + 1 for i, n, z in zip(out.doc_id, out["size"], out.text_crc32, strict=True))


def test_packing(spark, texts):
    out = QUERIES["op9_packing"](spark, DATA).toPandas().sort_values(["sequence_id", "offset"])
    ends = (out.offset + out.length).groupby(out.sequence_id).shift().fillna(0)
    filled = out.groupby("sequence_id").length.sum()
    assert (out.offset == ends).all() and filled.max() <= 2048 and (filled < 2048).sum() <= 1
    per = {i: sorted(zip(g.start, g.length, g.ids_crc32, g.doc_tokens, strict=True)) for i, g in out.groupby("doc_id")}
    whole = packing.Words(None).whole
    for i, t in texts.items():
        ids, at = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4"), 0
        for start, length, crc, tokens in per[i]:
            assert start == at and tokens == len(ids) and crc == zlib.crc32(ids[at : at + length].tobytes())
            at += length
        assert at == len(ids)
    assert len(per) == len(texts)
