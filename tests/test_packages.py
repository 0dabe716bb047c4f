"""Packages and inherited text, case by case."""

from pyspark.sql import functions as F

from tessella.operators import packages, text_styles


def test_targets(spark):
    cases = [("ppt/slides/slide1.xml", "../media/a.png", "ppt/media/a.png"), ("", "ppt/presentation.xml", "ppt/presentation.xml"), ("ppt/presentation.xml", "/docProps/core.xml", "docProps/core.xml"), ("ppt/a.xml", "./b/../c.xml", "ppt/c.xml"), ("a.xml", "../x", None), ("a/b.xml", "../../x/y", None)]
    df = spark.createDataFrame(cases, "source string, ref string, want string").withColumn("got", packages.target(F.col("source"), F.col("ref")))
    assert all(r.got == r.want for r in df.collect())


def test_finalised(spark):
    parts = [(1, p) for p in ("ppt/presentation.xml", "ppt/slides/slide1.xml", "ppt/slides/slide2.xml", "ppt/media/a.png", "ppt/media/b.jpeg", "ppt/media/c.svg", "ppt/media/d.gif")] + [(2, "ppt/presentation.xml")]
    rel = [
        (1, "", "r1", "officeDocument", "ppt/presentation.xml", False), (1, "ppt/presentation.xml", "r1", "slide", "slides/slide1.xml", False), (1, "ppt/slides/slide1.xml", "r1", "image", "../media/a.png", False), (1, "ppt/slides/slide1.xml", "r2", "image", "../media/b.jpeg", False),
        (1, "ppt/slides/slide2.xml", "r1", "image", "../media/d.gif", False), (1, "ppt/slides/slide1.xml", "r3", "hyperlink", "HTTPS://example.com", True), (2, "", "r1", "officeDocument", "ppt/presentation.xml", False), (2, "ppt/presentation.xml", "r9", "slide", "slides/none.xml", False),
    ]
    uses = [(1, "ppt/slides/slide1.xml", "r1"), (1, "ppt/slides/slide2.xml", "r1"), (1, "ppt/slides/slide1.xml", "r3")]
    kept, packed, verdict = packages.finalised(spark.createDataFrame(parts, "doc int, part string"), spark.createDataFrame(rel, "doc int, source string, id string, type string, target string, external boolean"), spark.createDataFrame(uses, "doc int, source string, id string"), "doc")
    assert kept.where("doc = 1 AND id = 'r2'").count() == 0 and kept.count() == 7
    # An unreachable slide keeps its part, but what it alone shows goes.
    assert {(r.part, r.content_type) for r in packed.where("doc = 1").collect()} == {("ppt/presentation.xml", "application/xml"), ("ppt/slides/slide1.xml", "application/xml"), ("ppt/slides/slide2.xml", "application/xml"), ("ppt/media/a.png", "image/png")}
    assert {r.doc: r.problem for r in verdict.collect()} == {1: None, 2: "DANGLING_REFERENCE"}


def test_inherited_text(spark):
    props = ", ".join(f"{p} string" for p in text_styles.PROPERTIES)

    def own(**k):
        return [k.get(p) for p in text_styles.PROPERTIES]

    texts = [(1, 0, 0, "r", "a\tb", *own(bold="1")), (1, 0, 1, "br", None, *own()), (1, 0, 2, "r", "", *own()), (1, 1, 0, "fld", "x\r\ny", *own(latin="Mono", strike="noStrike", underline="sng")), (2, 0, 0, "r", "z", *own(size="90", colour="ff0000", ea=" "))]
    paragraphs = [(1, 0, 0, None, "ctr", *own(size="2000")), (1, 1, 11, "-", None, *own()), (2, 0, None, None, "r", *own())]
    defaults = [(1, 0, None, *own(size="1000", ea="+mj-ea")), (1, 1, 9, *own(size="700", ea="Far", colour="accent1")), (1, 0, 9, *own(italic="true"))]
    table = lambda rows, cols: spark.createDataFrame(rows, f"{cols}, {props}")
    theme = lambda *xs: spark.createDataFrame([*xs], "name string, value string")
    far = text_styles.defaults_of(table(defaults, "shape int, scope int, level int"), ["shape"])
    out = text_styles.runs(table(texts, "shape int, paragraph int, ord int, kind string, text string"), table(paragraphs, "shape int, paragraph int, level int, bullet string, align string"), far, theme(("+mj-ea", "Major")), theme(("accent1", "112233")), ["shape"])
    got = {(r.shape, r.paragraph, r.ord): tuple(r)[3:] for r in out.collect()}
    assert got == {
        (1, 0, 0): ("a b", "Major", 20.0, True, False, False, False, "000000", 2), (1, 0, 1): ("\n", "Major", 20.0, False, False, False, False, "000000", 2),
        (1, 1, -1): ("- ", "fallback", 12.0, False, False, False, False, "000000", 1), (1, 1, 0): ("x\ny", "Major", 10.0, False, True, False, True, "112233", 1),
        (2, 0, 0): ("z", "fallback", 1.0, False, False, False, False, "FF0000", 3),
    }
