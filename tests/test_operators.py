"""Functions and operators on small made inputs."""

import io
import json
import zipfile
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessella.functions import geometry, markdown, names, urls
from tessella.operators import blocks, graph, grid, jobs, ranges
from tessella.sources import archive, html, ooxml, probe
from tessella.sources import markdown as md
from tessella.streaming import jobs as stream


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_escape(spark):
    cases = {"a&b <c>": "a&amp;b &lt;c&gt;", "1. x": "1\\. x", "x\r\n12.": "x\n12\\.", "1.5": "1.5", "a*b_c": "a\\*b\\_c", "\\|#": "\\\\\\|\\#", "": "", "a\0b": "ab"}
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    assert {r.x: r.y for r in df.select("x", markdown.escape(F.col("x")).alias("y")).collect()} == cases


def test_bold_and_links(spark):
    r = one(spark, markdown.bold(F.lit("ab\n\n(x)\né9")).alias("b"), markdown.link(F.lit("t"), F.lit("https://a.b/c d(1)")).alias("l"), markdown.link(F.lit("t"), F.lit("javascript:x")).alias("j"), markdown.link(F.lit("t"), F.lit("http://u@a.b/")).alias("u"), markdown.link(F.lit("t"), F.lit("mailto:a@b.c")).alias("m"))
    assert tuple(r) == ("**ab**\n\n<strong>(x)</strong>\n**é9**", "[t](https://a.b/c%20d%281%29)", "t", "t", "[t](mailto:a@b.c)")


def test_names(spark):
    r = one(spark, *[names.column_name(F.lit(i)).alias(f"c{i}") for i in (0, 25, 26, 701, 702, 16383)], names.roman(F.lit(1994)).alias("r"), names.roman(F.lit(4000)).alias("big"), names.letters(F.lit(28)).alias("l"), names.rotation_text(F.lit(-90.0)).alias("t"), names.rotation_text(F.lit(360.0)).alias("z"), names.safe_basename(F.lit("../a b/ü.x.md")).alias("s"), names.page_name(F.lit(7)).alias("p"))
    assert tuple(r) == ("A", "Z", "AA", "ZZ", "AAA", "XFD", "MCMXCIV", "4000", "bb", "時計回り270度", None, "__x", "page-0007.png")
    q = one(spark, names.rectangle(F.lit("$AB$3:C10")).alias("a"), names.rectangle(F.lit("A:A")).alias("b"), names.rectangle(F.lit("b2")).alias("c"))
    assert tuple(q.a) == (2, 9, 2, 27) and q.b is None and q.c is None


def test_urls(spark):
    ips = {"8.8.8.8": True, "10.1.2.3": False, "127.0.0.1": False, "172.15.0.1": True, "172.31.0.1": False, "1.2.3": False, "256.1.1.1": False, "223.255.255.255": True, "224.0.0.1": False}
    df = spark.createDataFrame([(k,) for k in ips], "x string")
    assert {r.x: r.y for r in df.select("x", urls.is_public_v4(F.col("x")).alias("y")).collect()} == ips
    now = F.lit(datetime(2030, 1, 1))
    sas = "https://a/b?sr=b&sp=cw&se=2031-01-01T00%3A00%3A00Z&sig=x"
    r = one(spark, urls.sas_error(F.lit(sas), now).alias("a"), urls.sas_error(F.lit(sas.replace("2031", "2029")), now).alias("b"), urls.sas_error(F.lit(sas.replace("sr=b", "sr=c")), now).alias("c"), urls.policy(F.lit("https://x.a.com/p"), ["a.com"]).alias("d"), urls.policy(F.lit("https://ba.com/"), ["a.com"]).alias("e"))
    assert tuple(r) == ("ok", "EXPIRED", "RESOURCE", "ok", "HOST_NOT_ALLOWED")


def test_geometry(spark):
    lit = lambda *xs: [F.lit(float(x)) for x in xs]
    turn = lit(0, 2, -2, 0, 5, 6)
    x, y = geometry.apply(turn, F.lit(1.0), F.lit(0.0))
    d = geometry.decompose(turn)
    r = one(spark, x.alias("x"), y.alias("y"), d.alias("d"), geometry.decompose(lit(1, 0, 0, -1, 0, 0))["error"].alias("m"), geometry.decompose(lit(1, 0, 0.5, 1, 0, 0))["error"].alias("s"), geometry.crop(F.lit(10000), F.lit(20000), F.lit(50)).alias("c"), geometry.crop(F.lit(60000), F.lit(40000), F.lit(50)).alias("n"), geometry.decimal3(F.lit(2.0005)).alias("q"), geometry.decimal3(F.lit(3.0)).alias("w"))
    assert (r.x, r.y) == (5.0, 8.0) and abs(r.d.rotation - 90) < 1e-9 and r.d.sx == 2 and r.d.error is None
    assert (r.m, r.s, tuple(r.c), r.n, r.q, r.w) == ("MIRROR", "SHEAR", (5, 40), None, "2.001", "3")


def test_islands_and_locate(spark):
    s = spark.createDataFrame([(1, 0, 5), (1, 3, 8), (1, 8, 9), (1, 20, 20), (2, 1, 2)], "g int, start long, end long")
    assert sorted(map(tuple, ranges.islands(s, ["g"]).collect())) == [(1, 0, 8), (1, 8, 9), (2, 1, 2)]
    tracks = spark.createDataFrame([(1, 0, "a"), (1, 10, "b")], "g int, start long, n string")
    pts = spark.createDataFrame([(1, 9), (1, 10), (1, 99), (2, 5)], "g int, at long")
    assert {(r.g, r["at"]): r.n for r in ranges.locate(pts, tracks, ["g"], "at", ["n"]).collect()} == {(1, 9): "a", (1, 10): "b", (1, 99): "b", (2, 5): None}


def test_slices_protect_merges(spark):
    df = spark.createDataFrame([(1, [0.0, 40.0, 80.0, 120.0, 350.0], [(60.0, 120.0)])], "s int, edges array<double>, blocks array<struct<start:double,end:double>>")
    out = [(r.start, r.end) for r in ranges.slices(df, ["s"], 100.0).orderBy("page").collect()]
    assert out == [(0.0, 60.0), (60.0, 120.0), (120.0, 220.0), (220.0, 320.0), (320.0, 350.0)]


def test_tables_from_borders(spark):
    """A 2 x 2 grid is a table, a lone box is none, and a merge counts as one unit."""
    box = lambda r, c: (0, r, c, True, True, True, True)
    cells = spark.createDataFrame([box(0, 0), box(0, 1), box(1, 0), box(1, 1), box(9, 9), box(5, 0), box(5, 1), box(6, 0), box(6, 1)], "s int, row int, col int, bt boolean, bb boolean, bl boolean, br boolean")
    merges = spark.createDataFrame([(0, 5, 5, 0, 1)], "s int, r1 int, r2 int, c1 int, c2 int")
    segs = grid.segments(cells, ["s"])
    units = grid.units(segs, merges, ["s"])
    tables = grid.accepted(grid.component_of(units, ["s"]), segs, ["s"]).select("r1", "r2", "c1", "c2", "n").collect()
    assert sorted(map(tuple, tables)) == [(0, 1, 0, 1, 4), (5, 6, 0, 1, 3)]


def test_components_of_a_long_chain(spark):
    n = 60
    nodes = spark.range(n).select(F.col("id"))
    out = graph.components(nodes, spark.range(n - 1).selectExpr("id AS a", "id + 1 AS b")).collect()
    assert {r.root for r in out} == {0} and len(out) == n
    none = graph.components(nodes, spark.createDataFrame([], "a long, b long")).collect()
    assert all(r.id == r.root for r in none)


def test_block_assembly(spark):
    b = spark.createDataFrame([(1, "text", 0, 0, 0, "a"), (1, "text", 1, 0, 1, "b"), (1, "table", 2, 0, 2, "x\ny"), (1, "drawing", None, None, 3, "z")], "d int, kind string, row int, col int, ord int, markdown string")
    p = blocks.placed(b, ["d"])
    assert blocks.assembled(p, ["d"]).first().markdown == "a  \nb\n\nx\ny\n\nz"
    assert [(r.start_line, r.end_line) for r in p.orderBy("position").collect()] == [(1, 1), (2, 2), (4, 5), (7, 7)]


def test_request_contract(spark):
    good = {"version": 1, "jobId": "123e4567-e89b-12d3-a456-426614174000", "input": {"container": "abc", "path": "a/b.xlsx"}, "output": {"storage": "main"}}
    g = json.dumps(good)
    cases = {g: None, g + " {}": "INVALID_JSON", g[:-1] + ',"version":1}': "INVALID_JSON", g.replace("1,", '"1",', 1): "INVALID_VERSION", g[:-1] + ',"ocr":true}': "UNKNOWN_FIELD", g.replace('"version": 1', '"version": 2')[:-1] + ',"ocr":true}': None, g.replace("a/b", "a/../b"): "INVALID_PATH", g.replace('"abc"', '"A"'): "INVALID_CONTAINER", "[]": "INVALID_JSON", g + ", " + g: "INVALID_JSON"}
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    got = {r.x: r.y for r in df.select("x", jobs.request_error(F.col("x")).alias("y")).collect()}
    assert got == cases


def test_stream_replays(spark, tmp_path):
    """Late, repeated and conflicting deliveries over three triggers."""
    files = [[("a", 1, "submitted", "r"), ("b", 1, "submitted", "r")], [("a", 2, "running", None), ("a", 3, "succeeded", None), ("b", 2, "running", None)], [("a", 3, "succeeded", None), ("a", 4, "failed", None), ("a", 5, "submitted", "other"), ("b", 3, "failed", None)]]
    (tmp_path / "in").mkdir()
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", stream.PROVIDER)
    seen: list = []
    try:
        for k, rows in enumerate(files):
            (tmp_path / "in" / f"{k}.json").write_text("\n".join(json.dumps({"job": j, "seq": s, "kind": kind, "request": r}) for j, s, kind, r in rows))
            q = stream.lifecycle(stream.read_events(spark, str(tmp_path / "in"))).writeStream.option("checkpointLocation", str(tmp_path / "state")).foreachBatch(lambda b, n: seen.extend(map(tuple, b.collect()))).trigger(availableNow=True).start()
            q.awaitTermination()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    fresh = sorted(x for x in seen if not x[4])
    assert fresh == [("a", "succeeded", 1, False, False, "a:succeeded"), ("b", "failed", 1, False, False, "b:failed")]
    assert {x[5] for x in seen} == {"a:succeeded", "b:failed"} and any(x[3] for x in seen)


def pack(files: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


S, W = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PKG = "http://schemas.openxmlformats.org/package/2006/relationships"


def book() -> bytes:
    return pack(
        {
            "xl/workbook.xml": f'<workbook xmlns="{S}" xmlns:r="{REL}"><sheets><sheet name="One" r:id="r1"/><sheet name="Gone" state="hidden" r:id="r2"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{PKG}"><Relationship Id="r1" Target="worksheets/s1.xml"/><Relationship Id="r2" Target="/xl/worksheets/s1.xml"/></Relationships>',
            "xl/sharedStrings.xml": f'<sst xmlns="{S}"><si><t>plain</t></si><si><r><t>kept</t></r><r><rPr><strike/></rPr><t>struck</t></r></si></sst>',
            "xl/styles.xml": f'<styleSheet xmlns="{S}"><fonts><font/><font><b/></font></fonts><fills><fill/></fills><borders><border/><border><top style="thin"/><left style="none"/></border></borders><cellXfs><xf/><xf fontId="1" borderId="1"/></cellXfs></styleSheet>',
            "xl/worksheets/s1.xml": f'<worksheet xmlns="{S}"><cols><col min="3" max="3" hidden="1"/></cols><sheetData><row r="1"><c r="A1" t="s" s="1"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1"><v>7</v></c></row><row r="2"><c r="A2"><f>1+1</f></c><c r="AA2" t="b"><v>1</v></c></row></sheetData><mergeCells><mergeCell ref="A1:B2"/></mergeCells></worksheet>',
        }
    )


def docx() -> bytes:
    run = lambda t, pr="": f"<w:r>{pr}<w:t>{t}</w:t></w:r>"
    fld = lambda k: f'<w:r><w:fldChar w:fldCharType="{k}"/></w:r>'
    p1 = f'<w:p><w:pPr><w:pStyle w:val="Heading1"/><w:outlineLvl w:val="0"/></w:pPr>{run("Head")}<w:del>{run("gone")}</w:del><w:ins>{run(" new")}</w:ins></w:p>'
    p2 = f'<w:p>{run("a")}{fld("begin")}{run("CODE")}{fld("separate")}{run("shown")}{fld("end")}{run("hid", "<w:rPr><w:vanish/></w:rPr>")}</w:p>'
    tbl = f"<w:tbl><w:tr><w:tc><w:p>{run('x')}</w:p></w:tc><w:tc><w:p>{run('y')}</w:p><w:p>{run('z')}</w:p></w:tc></w:tr></w:tbl>"
    return pack({"word/document.xml": f'<w:document xmlns:w="{W}"><w:body>{p1}{p2}{tbl}</w:body></w:document>'})


def test_markdown_inlines(spark):
    t = lambda x, *styles, target=None: ("text", x, sorted(styles), target)
    cases = {
        "a *b* **c** ***d***": [t("a "), t("b", "em"), t(" "), t("c", "strong"), t(" "), t("d", "em", "strong")],
        "**bold *both* bold**": [t("bold ", "strong"), t("both", "em", "strong"), t(" bold", "strong")],
        "snake_case_name and _em_": [t("snake_case_name and "), t("em", "em")],
        "2 * 3 * 4 and **open": [t("2 * 3 * 4 and **open")],
        "`a *b*` ``c ` d``": [("code", "a *b*", [], None), t(" "), ("code", "c ` d", [], None)],
        "`open": [t("`open")],
        "[l *x*](http://a.b/c_(d) 'T') ![alt *t*](i.png)": [t("l ", target="http://a.b/c_(d)"), t("x", "em", target="http://a.b/c_(d)"), t(" "), ("image", "alt t", [], "i.png")],
        "[not](a b) [x] ]": [t("[not](a b) [x] ]")],
        "<http://x.y/z> <a@b.cd> <b>raw</b> 1 < 2": [t("http://x.y/z", target="http://x.y/z"), t(" "), t("a@b.cd", target="mailto:a@b.cd"), t(" "), ("html", "<b>", [], None), t("raw"), ("html", "</b>", [], None), t(" 1 < 2")],
        "\\*no\\* &amp; &#169;": [t("*no* & ©")],
        "one  \ntwo\nthree\\\nfour": [t("one"), ("break", "\n", [], None), t("two"), ("soft", "\n", [], None), t("three"), ("break", "\n", [], None), t("four")],
        "~~gone~~ *a _b_ c*": [t("gone", "strike"), t(" "), t("a ", "em"), t("b", "em"), t(" c", "em")],
        "[a [b](c) d](e)": [t("[a "), t("b", target="c"), t(" d](e)")],
        "": [],
    }
    for text, want in cases.items():
        got = md.inline_runs(text)
        joined = []
        for r in got:  # neighbours of one look count as one here
            if joined and r[0] == "text" == joined[-1][0] and r[2:] == joined[-1][2:]:
                joined[-1] = ("text", joined[-1][1] + r[1], *r[2:])
            else:
                joined.append(r)
        flat = []
        for r in want:
            if flat and r[0] == "text" == flat[-1][0] and r[2:] == flat[-1][2:]:
                flat[-1] = ("text", flat[-1][1] + r[1], *r[2:])
            else:
                flat.append(r)
        assert joined == flat, text
    docs = spark.createDataFrame([(1, "# H *e*\n\n- i `c`\n\n```\n*x*\n```"), (2, None)], "doc_id long, text string")
    rows = md.inlines(md.blocks(docs)).orderBy("doc_id", "ord", "run").collect()
    assert [(r.ord, r.kind, r.text, r.styles) for r in rows] == [(1, "text", "H ", []), (1, "text", "e", ["em"]), (2, "text", "i ", []), (2, "code", "c", [])]


def test_html_entries(spark):
    rows = [("a", "index.html"), ("a", "x.css"), ("b", "index.htm"), ("c", "index.htm"), ("c", "index.html"), ("d", "sub/index.html"), ("e", "INDEX.html")]
    got = {r.doc: (r.entry, r.error) for r in archive.html_entry(spark.createDataFrame(rows, "doc string, name string")).collect()}
    missing = (None, "HTML_ENTRYPOINT_NOT_FOUND")
    assert got == {"a": ("index.html", None), "b": ("index.htm", None), "c": (None, "AMBIGUOUS_ENTRYPOINT"), "d": missing, "e": missing}


def test_books_that_are_refused(spark):
    types = lambda k: f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Override PartName="/xl/workbook.xml" ContentType="{k}"/></Types>'
    plain = {n: zipfile.ZipFile(io.BytesIO(book())).read(n).decode() for n in zipfile.ZipFile(io.BytesIO(book())).namelist()}
    kinds = {"fine": ooxml.BOOK, "template": "application/vnd.openxmlformats-officedocument.spreadsheetml.template.main+xml", "macro": "application/vnd.ms-excel.sheet.macroEnabled.main+xml"}
    files = [(f"{n}.xlsx", bytearray(pack({"[Content_Types].xml": types(k), **plain}))) for n, k in kinds.items()] + [("vba.xlsx", bytearray(pack({**plain, "xl/vbaProject.bin": "x"})))]
    df = spark.createDataFrame(files, "path string, content binary")
    assert {(r.doc, r.code) for r in ooxml.failures(df).collect()} == {("template.xlsx", "UNSUPPORTED_FORMAT"), ("macro.xlsx", "MACRO_NOT_SUPPORTED"), ("vba.xlsx", "MACRO_NOT_SUPPORTED")}
    assert {r.doc for r in ooxml.cells(df).select("doc").distinct().collect()} == {"fine.xlsx"}
    for bound, code in (({"most_sheets": 0}, "SHEET_LIMIT"), ({"most_cells": 4}, "READ_CELLS_LIMIT")):
        with pytest.raises(ValueError, match=code):
            ooxml.workbook("x", book(), **bound)
    ole = bytes.fromhex(probe.OLE2) + b"x" * 100 + "PowerPoint Document".encode("utf-16-le") + b"y"
    df = spark.createDataFrame([(1, bytearray(ole)), (2, bytearray(ole[:60])), (3, bytearray(b"PK" + ole))], "n int, content binary")
    assert {r.n: r.ok for r in df.select("n", probe.is_old_slides(F.col("content")).alias("ok")).collect()} == {1: True, 2: False, 3: False}


def test_office_readers(spark):
    files = spark.createDataFrame([("a.xlsx", bytearray(book())), ("b.docx", bytearray(docx())), ("c.xlsx", bytearray(b"PK\x03\x04junk")), ("d.txt", bytearray(b"x"))], "path string, content binary")
    cells = {(r.row, r.col): r for r in ooxml.cells(files.where("path LIKE '%.xlsx'")).collect()}
    assert cells[0, 0].display == "plain" and cells[0, 0].bold and cells[0, 0].bt and not cells[0, 0].bl
    assert cells[0, 1].display == "kept" and cells[0, 2].hidden and cells[1, 26].display == "TRUE" and cells[1, 0].cell_type == "FORMULA"
    shown = {(r.row, r.col): r.display for r in ooxml.visible(ooxml.cells(files.where("path LIKE '%.xlsx'"))).collect()}
    assert shown == {(0, 0): "plain", (0, 1): "kept", (1, 0): "=1+1", (1, 26): "TRUE"}
    assert [tuple(r)[1:] for r in ooxml.merges(files.where("path = 'a.xlsx'")).collect()] == [(0, 0, 1, 0, 1)]
    assert [(r.kind, r.level, r.text) for r in ooxml.blocks(files.where("path = 'b.docx'")).orderBy("ord").collect()] == [("paragraph", 0, "Head new"), ("paragraph", None, "ashown"), ("table_row", None, "| x | y<br>z |")]
    assert sorted((r.doc, r.code) for r in ooxml.failures(files).collect()) == [("c.xlsx", "INVALID_DOCUMENT"), ("d.txt", "UNSUPPORTED_TYPE")]
    fine = files.select("path", probe.is_office(F.col("path"), F.col("content")).alias("ok")).collect()
    assert {r.path: r.ok for r in fine} == {"a.xlsx": True, "b.docx": True, "c.xlsx": True, "d.txt": False}


def test_archives(spark):
    zips = {"ok": pack({"document.md": "a", "images/x.png": "b"}), "up": pack({"../x": "a"}), "twice": pack({"a.md": "1", "A.md": "2"}), "bad": b"no zip"}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in zips.items()], "path string, content binary")
    e = archive.entries(df)
    assert {r.doc: r.error for r in archive.checked(e).collect()} == {"ok": None, "up": "UNSAFE_PATH", "twice": "DUPLICATE_NAME", "bad": "INVALID_ARCHIVE"}
    assert {r.doc: r.entry for r in archive.root_document(e).collect()} == {"ok": "document.md", "twice": None}


def test_html_rules(spark):
    pages = spark.createDataFrame([(1, '<div data-slide="1" onclick="x"><p>a  b<p>c</div>'), (2, '<p data-x="1">t</p><iframe></iframe><meta http-equiv="refresh">'), (3, None)], "page_id long, html string")
    n = html.nodes(pages)
    assert sorted((r.page_id, r.code) for r in html.violations(n).collect()) == [(1, "ACTIVE_ATTRIBUTE"), (2, "CUSTOM_DATA"), (2, "META_HTTP_EQUIV"), (2, "UNSUPPORTED_HTML")]
    assert [(r.name, r.text) for r in html.text_blocks(n).where("page_id = 1").orderBy("at").collect()] == [("p", "a b"), ("p", "c")]


def test_markdown_blocks(spark):
    text = "# T #\n\npara\nmore\n\n- a\n  - b\n1. c\n> q\n> r\n```\n# no\n```\n| a | b |\n| - | - |\n<!-- pagebreak -->\n***\nend"
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    got = [(r.kind, r.level, r.text) for r in md.blocks(df).orderBy("ord").collect()]
    assert got == [("heading", 1, "T"), ("paragraph", None, "para\nmore"), ("item", 1, "a"), ("item", 2, "b"), ("item", 1, "c"), ("quote", None, "q\nr"), ("code", None, "```\n# no\n```"), ("table", None, "| a | b |\n| - | - |"), ("pagebreak", None, "<!-- pagebreak -->"), ("rule", None, "***"), ("paragraph", None, "end")]


def test_probes(spark):
    cases = {b"\xef\xbb\xbfa\n": "a\n", b"\xff\xfe": None, b"a\x01": None, b"ok\t": "ok\t"}
    df = spark.createDataFrame(pd.DataFrame({"c": [bytearray(k) for k in cases]}))
    assert [r.t for r in df.select(probe.markdown_text(F.col("c")).alias("t")).collect()] == list(cases.values())
    pdf = spark.createDataFrame([(bytearray(b"junk%PDF-1.7"),), (bytearray(b"x" * 1100 + b"%PDF-"),)], "c binary")
    assert [r.p for r in pdf.select(probe.is_pdf(F.col("c")).alias("p")).collect()] == [True, False]


def test_full_height_seeds(spark):
    """A regular two-column grid beside a merged block that leaves a hole."""
    rows = []
    for r in range(3):
        for c in range(3):
            if (r, c) != (1, 2):  # no closed cell here: the outer border runs on, the inner ones do not
                rows.append((0, r, c, True, True, True, True))
    rows.append((0, 1, 2, False, False, False, True))
    cells = spark.createDataFrame(rows, "g int, row int, col int, bt boolean, bb boolean, bl boolean, br boolean")
    segs = grid.segments(cells, ["g"]).where("NOT (kind = 'h' AND col = 2 AND row IN (1, 2))")
    none = spark.createDataFrame([], "g int, r1 int, r2 int, c1 int, c2 int")
    members = grid.component_of(grid.units(segs, none, ["g"]), ["g"])
    tables = grid.accepted(members, segs, ["g"])
    out = grid.full_height_seeds(members, tables, segs, ["g"])
    boxes = {tuple(r)[1:] for r in out.collect()} | {tuple(r) for r in tables.select("r1", "r2", "c1", "c2").collect()}
    assert boxes == {(0, 2, 0, 1)}


def test_visual_spans(spark):
    line = [("h", r, c) for r in (0, 1) for c in range(5)] + [("v", 0, 0), ("v", 0, 3), ("v", 0, 4), ("v", 0, 5)]
    segs = spark.createDataFrame([(1, *x) for x in line], "g int, kind string, row int, col int")
    cells = spark.createDataFrame([(1, 0, 1), (1, 0, 4)], "g int, row int, col int")
    none = spark.createDataFrame([], "g int, row int, col int")
    hidden = spark.createDataFrame([], "g int, col int")
    assert [tuple(r) for r in grid.visual_spans(cells, segs, hidden, none, ["g"]).collect()] == [(1, 0, 0, 2)]
    merged = spark.createDataFrame([(1, 0, 1)], "g int, row int, col int")
    assert grid.visual_spans(cells, segs, hidden, merged, ["g"]).count() == 0


def test_numbering(spark):
    from tessella.operators import numbering

    p = [(1, 1, "n", 0, "decimal", "%1.", None, None), (1, 2, "n", 1, "lowerLetter", "%1.%2", None, None), (1, 3, "n", 1, "lowerLetter", "%1.%2", None, None), (1, 4, "n", 0, "decimal", "%1.", None, None), (1, 5, "n", 1, "lowerLetter", "%1.%2", None, None), (1, 6, "m", 0, "upperRoman", "(%1)", 4, None), (1, 7, "m", 0, "bullet", "", None, None), (2, 1, "k", 0, "decimal", "%1", None, None), (2, 2, "k", 1, "decimal", "%2", None, -1), (2, 3, "k", 0, "decimal", "%1", None, None), (2, 4, "k", 1, "decimal", "%2", None, -1)]
    df = spark.createDataFrame(p, "doc int, ord int, num_id string, level int, format string, pattern string, start int, restart int")
    got = [r.label for r in numbering.numbered(df, ["doc"]).orderBy("doc", "ord").collect()]
    assert got == ["1.", "1.a", "1.b", "2.", "2.a", "(IV)", "•", "1", "1", "2", "2"]


def test_slides(spark):
    P, A = "http://schemas.openxmlformats.org/presentationml/2006/main", "http://schemas.openxmlformats.org/drawingml/2006/main"
    shape = '<p:sp><p:nvSpPr><p:cNvPr id="2" name="Box"/></p:nvSpPr><p:spPr><a:xfrm><a:off x="12700" y="0"/><a:ext cx="25400" cy="12700"/></a:xfrm></p:spPr><p:txBody><a:p><a:r><a:t>one</a:t></a:r></a:p><a:p><a:r><a:t>two</a:t></a:r></a:p></p:txBody></p:sp>'
    deck = pack(
        {
            "ppt/presentation.xml": f'<p:presentation xmlns:p="{P}" xmlns:r="{REL}"><p:sldIdLst><p:sldId id="256" r:id="r1"/><p:sldId id="257" r:id="r2"/></p:sldIdLst></p:presentation>',
            "ppt/_rels/presentation.xml.rels": f'<Relationships xmlns="{PKG}"><Relationship Id="r1" Target="slides/s1.xml"/><Relationship Id="r2" Target="slides/s2.xml"/></Relationships>',
            "ppt/slides/s1.xml": f'<p:sld xmlns:p="{P}" xmlns:a="{A}"><p:cSld><p:spTree>{shape}</p:spTree></p:cSld></p:sld>',
            "ppt/slides/s2.xml": f'<p:sld xmlns:p="{P}" xmlns:a="{A}" show="0"><p:cSld><p:spTree>{shape}</p:spTree></p:cSld></p:sld>',
        }
    )
    files = spark.createDataFrame([("a.pptx", bytearray(deck))], "path string, content binary")
    out = [tuple(r)[1:] for r in ooxml.shapes(files).orderBy("slide").collect()]
    assert out == [(1, 0, "sp", "Box", "one\ntwo", 12700, 0, 25400, 12700, False), (2, 0, "sp", "Box", "one\ntwo", 12700, 0, 25400, 12700, True)]
