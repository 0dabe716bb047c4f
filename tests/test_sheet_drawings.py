"""Drawings of workbooks, from the file to resolved connections and anchors."""

import io
import zipfile

from pyspark.sql import functions as F

from tessella.operators import drawings as op
from tessella.operators import graph
from tessella.sources import sheet_drawings

S = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PKG = "http://schemas.openxmlformats.org/package/2006/relationships"
D = "http://schemas.openxmlformats.org/drawingml/2006/spreadsheetDrawing"
A = "http://schemas.openxmlformats.org/drawingml/2006/main"


def shape(i, text, preset="rect", extra="", at=(0, 0, 12700, 25400), more=""):
    x, y, cx, cy = at
    return f'<d:sp><d:nvSpPr><d:cNvPr id="{i}" name="n{i}" {extra}/></d:nvSpPr><d:spPr><a:xfrm {more}><a:off x="{x}" y="{y}"/><a:ext cx="{cx}" cy="{cy}"/></a:xfrm><a:prstGeom prst="{preset}"/></d:spPr><d:txBody><a:p><a:r><a:t>{text}</a:t></a:r><a:r><a:rPr strike="sngStrike"/><a:t>gone</a:t></a:r></a:p><a:p><a:r><a:t>two</a:t></a:r></a:p></d:txBody></d:sp>'


def anchored(x, c1=1, r1=2, c2=3, r2=4):
    corner = lambda n, c, r: f"<d:{n}><d:col>{c}</d:col><d:colOff>12700</d:colOff><d:row>{r}</d:row><d:rowOff>0</d:rowOff></d:{n}>"
    return f"<d:twoCellAnchor>{corner('from', c1, r1)}{corner('to', c2, r2)}{x}</d:twoCellAnchor>"


def book(drawing):
    rel = lambda *xs: f'<Relationships xmlns="{PKG}">' + "".join(f'<Relationship Id="{i}" Target="{t}"/>' for i, t in xs) + "</Relationships>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{S}" xmlns:r="{R}"><sheets><sheet name="A" r:id="r1"/><sheet name="H" state="hidden" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", rel(("r1", "worksheets/s1.xml")))
        z.writestr("xl/worksheets/s1.xml", f'<worksheet xmlns="{S}" xmlns:r="{R}"><sheetData/><drawing r:id="d1"/></worksheet>')
        z.writestr("xl/worksheets/_rels/s1.xml.rels", rel(("d1", "../drawings/drawing1.xml")))
        z.writestr("xl/drawings/drawing1.xml", f'<d:wsDr xmlns:d="{D}" xmlns:a="{A}" xmlns:r="{R}">{drawing}</d:wsDr>')
        z.writestr("xl/drawings/_rels/drawing1.xml.rels", rel(("m1", "../media/image1.png")))
    return out.getvalue()


def test_drawings(spark):
    line = '<d:cxnSp><d:nvCxnSpPr><d:cNvPr id="9" name="c"/><d:cNvCxnSpPr><a:stCxn id="2" idx="0"/><a:endCxn id="3" idx="1"/></d:cNvCxnSpPr></d:nvCxnSpPr><d:spPr><a:xfrm><a:off x="0" y="0"/><a:ext cx="5" cy="5"/></a:xfrm><a:prstGeom prst="line"/><a:ln><a:tailEnd type="triangle"/></a:ln></d:spPr></d:cxnSp>'
    picture = '<d:pic><d:nvPicPr><d:cNvPr id="5" name="p"/></d:nvPicPr><d:blipFill><a:blip r:embed="m1"/><a:srcRect l="1000" b="2000"/></d:blipFill><d:spPr><a:xfrm rot="5400000"><a:off x="1" y="2"/><a:ext cx="3" cy="4"/></a:xfrm><a:prstGeom prst="rect"/></d:spPr></d:pic>'
    group = f'<d:grpSp><d:nvGrpSpPr><d:cNvPr id="20" name="g"/></d:nvGrpSpPr><d:grpSpPr><a:xfrm><a:off x="100" y="200"/><a:ext cx="400" cy="400"/><a:chOff x="10" y="10"/><a:chExt cx="200" cy="100"/></a:xfrm></d:grpSpPr>{shape(21, "in", at=(20, 30, 50, 25))}{picture}</d:grpSp>'
    content = book(anchored(shape(2, "a")) + anchored(shape(3, "b", "ellipse", 'hidden="1"', more='flipH="1"')) + anchored(line) + anchored(group, 0, 0, 1, 1))
    rows = sheet_drawings.drawings(spark.createDataFrame([("x.xlsx", bytearray(content)), ("bad.xlsx", bytearray(b"PK"))], "path string, content binary")).cache()
    got = {r.source_id: r for r in rows.collect()}
    assert sorted(got) == ["2", "21", "3", "5", "9"] and {r.sheet_idx for r in got.values()} == {0}
    assert got["2"].text == "a\ntwo" and got["2"].kind == "shape" and got["2"].preset == "rect" and not got["2"].hidden
    assert got["3"].hidden and got["3"].flip_h and not got["3"].flip_v
    assert (got["9"].start_id, got["9"].end_id, got["9"].start_arrow, got["9"].end_arrow) == ("2", "3", None, "triangle")
    # Group: scale 2 and 4, so (20, 30) lies at 100 + 2 * 10, 200 + 4 * 20.
    assert (got["21"].x, got["21"].y, got["21"].cx, got["21"].cy) == (120, 280, 100, 100) and got["21"].group_key == got["5"].group_key == "group-0-1"
    assert got["5"].media == "xl/media/image1.png" and got["5"].crop == "1000,0,0,2000" and got["5"].rotation == 90.0

    vertices = rows.where("kind = 'shape' AND NOT hidden").select("doc", "id", "source_id")
    edges = graph.resolve(vertices, rows.where("kind = 'connector'").select("doc", "id", "start_id", "end_id", "start_arrow", "end_arrow"), ["doc"])
    assert [(e.start_vertex, e.end_vertex, e.direction, e.reason) for e in edges.collect()] == [(got["2"].id, None, "start-to-end", "TARGET_UNAVAILABLE")]
    tracks = spark.range(10).selectExpr("'x.xlsx' AS doc", "cast(id as int) AS line", "id * 20.0D AS start", "20.0D AS size")
    boxes = op.anchored(rows.where("source_id = '2'").drop("x", "y").withColumn("old", F.lit(False)), tracks, tracks, ["doc"]).first()
    assert (boxes.x, boxes.y, boxes.width, boxes.height) == (21.0, 40.0, 40.0, 40.0)


def test_deep_groups_are_refused(spark):
    deep = shape(1, "x")
    for _ in range(30):
        deep = f"<d:grpSp><d:grpSpPr/>{deep}</d:grpSp>"
    assert sheet_drawings.drawings(spark.createDataFrame([("d.xlsx", bytearray(book(anchored(deep))))], "path string, content binary")).count() == 0
