"""Every catalog query against its SQL on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from tessella.plans import catalog, catalog_deep, catalog_drawings, catalog_more, catalog_parts, flows  # noqa: F401

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NA or v != v:
            return None
        return int(v) if isinstance(v, float) and v == int(v) else v.item() if hasattr(v, "item") else v

    cols = sorted(df.columns)
    return sorted((tuple(plain(v) for v in r) for r in df[cols].astype(object).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted({**catalog.SQL, **flows.SQL}))
def test_matches_sql(spark, duck, name):
    got, want = {**catalog.QUERIES, **flows.QUERIES}[name](spark, DATA).toPandas(), duck.sql({**catalog.SQL, **flows.SQL}[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_rotations_never_jump(spark):
    rows = {}
    for r in catalog.QUERIES["rotation_unwrap"](spark, DATA).collect():
        rows.setdefault(r.vec_id, {})[r.pos] = r.unwrapped
    for v in rows.values():
        assert all(abs(v[i] - v[i - 1]) <= 180 + 1e-6 for i in range(1, len(v)))


def test_field_visibility(spark, duck):
    events = duck.sql("SELECT user_id * 100 + event_id % 100, event_id FROM events ORDER BY event_id").fetchall()
    stacks, seen = {}, set()
    for p, e in events:
        s = stacks.setdefault(p, [])
        kind = e % 5
        if kind == 0:
            s.append(False)
        elif kind == 1 and s:
            s[-1] = True
        elif kind == 2 and s:
            s.pop()
        elif kind > 2 and all(s):
            seen.add((p, e))
    got = flows.QUERIES["note_field_visibility"](spark, DATA).collect()
    assert {(r.paragraph, r.event_id) for r in got} == seen and len(got) == len(seen)


def test_stream_equals_batch(spark):
    batch = {str(r.job): r for r in catalog.QUERIES["job_state_fold"](spark, DATA).collect()}
    stream = {r.job: r for r in flows.QUERIES["job_stream"](spark, DATA).collect()}
    ended = {j for j, r in batch.items() if r.status in ("succeeded", "failed")}
    assert set(stream) == ended and all(stream[j].status == batch[j].status for j in ended)


def test_archives_repeat(spark):
    a, b = (sorted(map(tuple, flows.QUERIES["archive_bundle"](spark, DATA).collect())) for _ in range(2))
    assert a == b


def test_html_queries(spark, duck):
    n = duck.sql("SELECT count(*) FROM pages").fetchall()[0][0]
    nodes = flows.QUERIES["html_nodes"](spark, DATA)
    assert nodes.where("name = 'html'").count() == n
    bad = flows.QUERIES["html_allowlist"](spark, DATA).groupBy("code").count().collect()
    assert {r.code for r in bad} == {"UNSUPPORTED_HTML"}  # scripts
    assert flows.QUERIES["html_text_blocks"](spark, DATA).where("text = ''").count() == 0


def test_ocr_by_whole_content(spark, tmp_path):
    head = "x" * 40
    docs = [(1, head + "a", "en", 50), (2, head + "b", "en", 500), (3, head + "b", "fr", 500), (4, head + "c", "fr", 500)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.ocr for r in catalog.QUERIES["ocr_status"](spark, str(tmp_path)).collect()}
    assert got == {1: "noText", 2: "succeeded", 3: "succeeded", 4: "failed"}


def test_diagram_lists_every_edge(spark):
    from tessella.operators import graph

    v = spark.createDataFrame([(1, "a", 1, "box", "x*\ny"), (1, "b", 2, "box", ""), (1, "c", 3, "box", " ")], "section int, id string, pos int, type string, text string")
    ways = ["start-to-end", "end-to-start", "bidirectional", "undirected"]
    edges = [(1, k, "a", "b", w, "resolved", "") for k, w in enumerate(ways)] + [(1, 9, "a", None, "undirected", "unresolved", "MISSING_ENDPOINT"), (2, 1, None, None, "unknown", "unresolved", "UNKNOWN_ARROWHEAD")]
    e = spark.createDataFrame(edges, "section int, id int, start_vertex string, end_vertex string, direction string, status string, reason string")
    got = {r.section: r.markdown for r in graph.diagram(v, e, ["section"]).collect()}
    a, b = "a「x\\* y」", "b（文字なし）"
    assert got[1] == (
        f"図中の項目:\n\n- a（box）：x\\*<br>y\n- b（box）：文字なし\n\n接続関係:\n\n- 0：{a} → {b}\n- 1：{b} → {a}\n- 2：{a} ↔ {b}\n- 3：{a} — {b}（向きなし）\n"
        "- 9：接続関係不明（接続先の保存情報がありません）\n\n"
    )
    assert got[2] == "接続関係:\n\n- 1：接続関係不明（矢印の向きを確定できません）\n\n"


def test_slide_sizes_of_every_page(spark, tmp_path):
    m = lambda k, v: f'<meta name="slide-{k}" content="{v}">'
    pages = [
        m("width", 800) + m("height", 600), "<p>x", m("width", 800), m("width", 800) * 2 + m("height", 600), m("width", "8e2") + m("height", 600), m("width", 10) + m("height", 600),
        "<META content='1024' data-x=1 name='Slide-Width'/><meta content=768 name=slide-height>", f"<!-- {m('width', 800)} --><script>'{m('height', 1)}'</script>", None,
    ]
    spark.createDataFrame(list(enumerate(pages)), "page_id int, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = [(r.width, r.height, r.origin, r.width_emu) for r in catalog.QUERIES["slide_meta"](spark, str(tmp_path)).orderBy("page_id").collect()]
    default, error = (1280, 720, "default", 1280 * 9525), (None, None, "error", None)
    assert got == [(800, 600, "meta", 800 * 9525), default, error, error, error, error, (1024, 768, "meta", 1024 * 9525), default, default]


def test_effect_reasons(spark):
    from pyspark.sql import functions as F

    from tessella.operators import effects

    def frame(offset, other=False, **k):
        return (offset, *[k.get(c) for c in effects.CHANNELS], other)

    box, fine = (0.0, 0.0, 10.0, 10.0), [frame(0.0, x=5.0), frame(1.0, x=0.0)]
    ramp = [frame(i / 9, opacity=i / 9) for i in range(10)]
    cases = [
        (None, "e", 100.0, 0.0, fine, box, None), (None, "e", 100.0, None, ramp, box, (5.0, 5.0)), ("invalid_effect", "", 0.0, 0.0, fine, box, None), ("invalid_timing", "e", 0.0, 0.0, fine, box, None),
        ("invalid_keyframes", "e", 1.0, 0.0, fine[:1], box, None), ("invalid_keyframes", "e", 1.0, 0.0, [fine[0], frame(0.5, x=1.0), frame(0.5, x=1.0), fine[1]], box, None),
        ("unsupported_channel", "e", 1.0, 0.0, [fine[0], frame(0.5, True, x=1.0), fine[1]], box, None), ("invalid_keyframes", "e", 1.0, 0.0, [frame(0.0), fine[1]], box, None),
        ("invalid_bounds", "e", 1.0, 0.0, fine, (0.0, 0.0, 0.0, 1.0), None), ("unsupported_pivot", "e", 1.0, 0.0, fine, box, (0.0, 5.0)), ("non_final_base", "e", 1.0, 0.0, [frame(0.0, x=0.0), frame(1.0, x=3.0)], box, None),
        ("unsupported_opacity", "e", 100.0, 0.0, [*ramp[:8], frame(0.85, opacity=0.1), ramp[9]], box, None), ("unsupported_scale", "e", 1.0, 0.0, [frame(0.0, scaleX=-1.0), frame(1.0, scaleX=1.0)], box, None),
        ("invalid_keyframes", "e", 1.0, 0.0, [frame(0.0, rotation=4e4), frame(1.0, rotation=0.0)], box, None), ("no_visible_change", "e", 1.0, 0.0, [frame(0.0), frame(1.0)], box, None),
        ("timing_resolution", "e", 1.0, 3_600_000.0, fine, box, None),
    ]
    schema = f"want string, id string, duration double, delay double, frames array<{effects.FRAME}>, bounds struct<x:double,y:double,width:double,height:double>, origin struct<x:double,y:double>"
    df = spark.createDataFrame(cases, schema)
    got = df.select("want", effects.reason(*[F.col(c) for c in df.columns[1:]]).alias("got")).collect()
    assert [r.got for r in got] == [c[0] for c in cases]
    samples = [
        (None, ramp), ("exit-animation", ramp[::-1]), ("unsupported-opacity", [ramp[5], ramp[9]]), ("no-visible-change", [frame(0.0), frame(1.0)]),
        ("unsupported-transform", [frame(0.0, scaleX=2.0), frame(1.0, rotation=30.0)]), (None, [frame(0.0, scaleX=2.0), frame(1.0)]),
    ]
    full = [(w, [(f[0], *[b if v is None else v for v, b in zip(f[1:7], effects.CHANNELS.values(), strict=True)], False) for f in fs]) for w, fs in samples]
    got = spark.createDataFrame(full, f"want string, s array<{effects.FRAME}>").select("want", effects.trajectory(F.col("s")).alias("got")).collect()
    assert [r.got for r in got] == [w for w, _ in samples]


def test_deep_chains(spark):
    from tessella.operators import graph

    rows = [(f"s{k}", f"s{k + 1}", None) for k in range(20)] + [("s20", None, 7), ("a", "b", None), ("b", "a", 5)]
    got = {r.id: r.outline for r in graph.inherited(spark.createDataFrame(rows, "id string, based_on string, outline int"), ["outline"]).collect()}
    assert got == {**{f"s{k}": 7 for k in range(21)}, "a": 5, "b": 5}
    edges = spark.createDataFrame([(k, k + 1) for k in range(66)], "a int, b int")
    assert graph.closure(edges, spark.createDataFrame([(0,)], "n int")).count() == 67


def test_archives_in_parts(spark):
    import io
    import zipfile

    from pyspark.sql import functions as F

    from tessella.sources import archive

    files = spark.range(40).select(F.when(F.col("id") % 2 == 0, "a").alias("doc"), F.col("id").alias("seq"), F.format_string("f%02d", "id").alias("name"), F.encode(F.repeat(F.lit("x"), (F.col("id") + 1).cast("int")), "UTF-8").alias("content"))
    held = {}
    for r in archive.zipped_parts(files, "doc", 100).collect():
        with zipfile.ZipFile(io.BytesIO(bytes(r.archive))) as z:
            held.setdefault(r.doc, {})[r.part] = [(n, len(z.read(n))) for n in z.namelist()]
    for k, doc in enumerate(("a", None)):
        parts = [held[doc][p] for p in sorted(held[doc])]
        assert [n for p in parts for n in p] == [(f"f{i:02d}", i + 1) for i in range(k, 40, 2)]
        assert len(parts) > 3 and all(sum(n for _, n in p[:-1]) <= 100 for p in parts)
