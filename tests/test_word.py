"""Word files: tables, notes, links, numbers, pages, and what is refused."""

import io
import zipfile

from tessella.sources import word

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PKG = "http://schemas.openxmlformats.org/package/2006/relationships"
TYPES = '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Override PartName="/word/document.xml" ContentType="{}"/></Types>'


def r(text, pr=""):
    return f"<w:r><w:rPr>{pr}</w:rPr><w:t>{text}</w:t></w:r>"


def p(*runs, pr=""):
    return f"<w:p><w:pPr>{pr}</w:pPr>{''.join(runs)}</w:p>"


def made(body, *, styles="", numbering="", footnotes="", rels="", kind=word.MAIN, more=None):
    out = io.BytesIO()
    wrap = lambda name, x: f'<w:{name} xmlns:w="{W}" xmlns:r="{R}">{x}</w:{name}>'
    files = {"[Content_Types].xml": TYPES.format(kind), "word/document.xml": wrap("document", f"<w:body>{body}</w:body>"), "word/styles.xml": wrap("styles", styles), "word/numbering.xml": wrap("numbering", numbering), "word/footnotes.xml": wrap("footnotes", footnotes)}
    files["word/_rels/document.xml.rels"] = f'<Relationships xmlns="{PKG}">{rels}</Relationships>'
    with zipfile.ZipFile(out, "w") as z:
        for name, text in {**files, **(more or {})}.items():
            z.writestr(name, text)
    return out.getvalue()


def text_of(content):
    return [x[5] for x in word.read("d", content) if x[3] not in ("notice", "page")]


def codes(content):
    return [x[5] for x in word.read("d", content) if x[3] == "notice"]


def test_runs_links_and_fields():
    rels = '<Relationship Id="a" Target="https://x.example/a (b)" TargetMode="External"/><Relationship Id="b" Target="file:///c" TargetMode="External"/>'
    fld = lambda k: f'<w:r><w:fldChar w:fldCharType="{k}"/></w:r>'
    body = p(r("1. a*b"), r("bold", "<w:b/>"), r("not", '<w:b w:val="0"/>'), r("gone", "<w:strike/>"), f"<w:del>{r('del')}</w:del><w:ins>{r('ins')}</w:ins>")
    body += p(f'<w:hyperlink r:id="a">{r("site")}</w:hyperlink>', f'<w:hyperlink r:id="b">{r("file")}</w:hyperlink>')
    body += p(fld("begin"), r("CODE"), fld("begin"), r("IN"), fld("separate"), r("inner"), fld("end"), fld("separate"), r("shown"), fld("end"), "<w:r><w:tab/><w:t>t</w:t><w:br/><w:t>u</w:t></w:r>")
    c = made(body, rels=rels)
    assert text_of(c) == ["1\\. a\\*b**bold**notins", "[site](https://x.example/a%20%28b%29)file", "shown    t\nu"]
    assert set(codes(c)) == {"HIDDEN_OR_STRUCK_REMOVED", "UNSUPPORTED_LINK", "FIELD_CACHED_RESULT"}


def test_styles_and_headings():
    style = lambda i, x, kind="paragraph": f'<w:style w:type="{kind}" w:styleId="{i}">{x}</w:style>'
    styles = style("A", '<w:name w:val="heading 2"/><w:rPr><w:b/></w:rPr>') + style("B", '<w:basedOn w:val="A"/>') + style("L", '<w:basedOn w:val="L2"/>') + style("L2", '<w:basedOn w:val="L"/>') + style("V", "<w:rPr><w:vanish/></w:rPr>", "character")
    body = p(r("from its ancestor"), pr='<w:pStyle w:val="B"/>') + p(r("outline"), pr='<w:pStyle w:val="B"/><w:outlineLvl w:val="0"/>') + p(r("none"), pr='<w:outlineLvl w:val="9"/>') + p(r("loop"), pr='<w:pStyle w:val="L"/>') + p(r("seen"), r("unseen", '<w:rStyle w:val="V"/>'))
    assert text_of(made(body, styles=styles)) == ["## **from its ancestor**", "# **outline**", "none", "loop", "seen"]


def test_tables():
    tc = lambda x, pr="": f"<w:tc><w:tcPr>{pr}</w:tcPr>{x}</w:tc>"
    tr = lambda *cs, pr="": f"<w:tr><w:trPr>{pr}</w:trPr>{''.join(cs)}</w:tr>"
    nested = f"<w:tbl>{tr(tc(p(r('in')) + p(r('side|'))))}</w:tbl>"
    t = "<w:tbl><w:tblGrid><w:gridCol/><w:gridCol/><w:gridCol/></w:tblGrid>"
    t += tr(tc(p(r("wide")), '<w:gridSpan w:val="2"/>'), tc(p(r("v")), '<w:vMerge w:val="restart"/>'), pr="<w:tblHeader/>")
    t += tr(tc(p(r("a")) + p(r("b"))), tc(nested), tc(p(r("x")), "<w:vMerge/>")) + tr(tc(p(r("z"))), pr='<w:gridBefore w:val="1"/><w:gridAfter w:val="1"/>')
    t += tr(tc(p(r("no"))), pr="<w:del/>") + "</w:tbl>"
    c = made(t)
    assert text_of(c) == ["| wide |  | v |\n| --- | --- | --- |\n| a<br>b | in<br>side\\| |  |\n|  | z |  |"] and codes(c) == ["NESTED_TABLE_UNSUPPORTED"]
    assert text_of(made(f"<w:tbl>{tr(tc(p(r('q'))))}</w:tbl>")) == ["|  |\n| --- |\n| q |"]


def test_notes_in_order():
    ref = lambda n: f'<w:r><w:footnoteReference w:id="{n}"/></w:r>'
    foot = f'<w:footnote w:id="2">{p(r("two"), ref(5))}</w:footnote><w:footnote w:id="3">{p(r("three"), ref(2))}{p(r("more"))}</w:footnote><w:footnote w:id="5">{p(r("five"), ref(3))}</w:footnote>'
    c = made(p(r("see"), ref(3), ref(2), ref(9), ref(3)), footnotes=foot)
    assert text_of(c) == ["see[^footnote-3][^footnote-2][^footnote-9][^footnote-3]", "[^footnote-3]: three[^footnote-2]\n    \n    more", "[^footnote-2]: two[^footnote-5]", "[^footnote-9]: （参照先なし）", "[^footnote-5]: five[^footnote-3]"]
    assert codes(c) == ["MISSING_NOTE"]


def test_numbers():
    lvl = lambda k, fmt, text, start=1, more="": f'<w:lvl w:ilvl="{k}"><w:start w:val="{start}"/><w:numFmt w:val="{fmt}"/><w:lvlText w:val="{text}"/>{more}</w:lvl>'
    numbering = f'<w:abstractNum w:abstractNumId="0">{lvl(0, "decimal", "%1.")}{lvl(1, "lowerLetter", "%1.%2)")}{lvl(2, "bullet", "o")}{lvl(3, "upperRoman", "%4", 4, "<w:lvlRestart w:val=chr0/>".replace("chr0", chr(34) + "0" + chr(34)))}</w:abstractNum>'
    numbering += '<w:num w:numId="1"><w:abstractNumId w:val="0"/></w:num><w:num w:numId="2"><w:abstractNumId w:val="0"/><w:lvlOverride w:ilvl="0"><w:startOverride w:val="7"/></w:lvlOverride></w:num>'
    item = lambda n, k, x: p(r(x), pr=f'<w:numPr><w:ilvl w:val="{k}"/><w:numId w:val="{n}"/></w:numPr>')
    c = made("".join(item(*x) for x in [(1, 0, "a"), (1, 1, "b"), (1, 1, "c"), (1, 3, "r"), (1, 0, "d"), (1, 1, "e"), (1, 2, "f"), (1, 3, "s"), (2, 0, "g"), (9, 1, "h"), (0, 0, "i")]), numbering=numbering)
    assert text_of(c) == ["1\\. a", "  1.a) b", "  1.b) c", "      IV r", "2\\. d", "  2.a) e", "    - f", "      V s", "7\\. g", "  - h", "i"]
    assert codes(c) == ["NUMBERING_APPROXIMATED"]


def test_pages():
    br = '<w:r><w:br w:type="page"/></w:r>'
    c = made(p(br, r("first")) + p(r("a"), br, r("b")) + p(r("c"), pr="<w:pageBreakBefore/>") + p(r("hidden", "<w:vanish/>"), pr=""))
    rows = [(x[2], x[3], x[5]) for x in word.read("d", c) if x[3] != "notice"]
    assert rows == [(1, "page", "[page 1]"), (1, "paragraph", "first"), (1, "paragraph", "a"), (2, "page", "[page 2]"), (2, "paragraph", "b"), (3, "page", "[page 3]"), (3, "paragraph", "c")]


def test_refused_and_assembled(spark):
    deep = "<w:p>" + "<w:ins>" * 200 + r("x") + "</w:ins>" * 200 + "</w:p>"
    files = [("a", made(p(r("ok")))), ("b", made("", kind="application/vnd.ms-word.document.macroEnabled.main+xml")), ("c", made("", kind="application/vnd.openxmlformats-officedocument.wordprocessingml.template.main+xml")), ("d", b"junk"), ("e", made(deep)), ("f", made("", more={"word/vbaProject.bin": "x"})), ("g", None)]
    rows = word.blocks(spark.createDataFrame([(n, bytearray(c) if c is not None else None) for n, c in files], "path string, content binary")).cache()
    assert {x.doc: x.markdown for x in rows.where("kind = 'error'").collect()} == {"b": "MACRO_NOT_SUPPORTED", "c": "UNSUPPORTED_FORMAT", "d": "INVALID_DOCUMENT", "e": "DOCUMENT_DEPTH_LIMIT", "f": "MACRO_NOT_SUPPORTED", "g": "INVALID_DOCUMENT"}
    assert {x.doc: x.markdown for x in word.markdown(rows).collect()} == {"a": "[page 1]\n\nok\n\n"}
