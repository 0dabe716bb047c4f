"""Style sheets, vector pictures and text units (Columns only)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: At-rules that may be used, and functions that may not (fixed values).
AT_RULES = "media supports layer container page charset keyframes -webkit-keyframes".split()
UNSAFE_FUNCTIONS = "expression paint image image-set -webkit-image-set cross-fade -webkit-cross-fade element -moz-element -webkit-canvas src".split()
SVG_ELEMENTS = "svg g defs rect circle ellipse line polyline polygon path text tspan linearGradient radialGradient stop marker use clipPath title desc style".split()
LOCAL_PAINT = r"#[A-Za-z_][\w:.-]*"


def bare(css: Column) -> Column:
    """A style sheet without comments and without the contents of its strings."""
    return F.regexp_replace(F.regexp_replace(css, r"(?s)/\*.*?(\*/|\z)", " "), r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'", "''")


def css_problem(css: Column) -> Column:
    """First reason why a style sheet may not be used, or null: an at-rule that is not allowed,
    an unsafe or escaped function, an active property, a url() that is neither data nor local."""
    text = bare(css)
    rules = F.transform(F.regexp_extract_all(text, F.lit(r"@([A-Za-z-]+)"), 1), lambda r: F.lower(r))
    calls = F.transform(F.regexp_extract_all(text, F.lit(r"([A-Za-z-][\w-]*)\("), 1), lambda r: F.lower(r))
    # Addresses are read where strings still have their contents.
    held = F.regexp_replace(css, r"(?s)/\*.*?(\*/|\z)", " ")
    urls = F.regexp_extract_all(held, F.lit(r"(?i)\burl\(\s*[\"']?([^\"')]*)"), 1)
    listed = lambda xs: F.array(*[F.lit(x) for x in xs])
    return (
        F.when(F.size(F.array_except(rules, listed(AT_RULES))) > 0, "AT_RULE")
        .when(F.size(F.array_intersect(calls, listed(UNSAFE_FUNCTIONS))) > 0, "FUNCTION")
        .when(text.rlike(r"[\w-]*\\[^\s{};:]*[(:]"), "ESCAPE")
        .when(text.rlike(r"(?i)(\A|[;{\s])(behavior|-moz-binding)\s*:"), "ACTIVE_PROPERTY")
        .when(F.exists(urls, lambda u: ~F.trim(u).rlike(rf"\A(data:image/|{LOCAL_PAINT}\z)")), "EXTERNAL_URL")
    )


def svg_problem(svg: Column, most_nodes: int = 20_000, most_bytes: int = 8 << 20) -> Column:
    """First reason why a vector picture is no static one, or null."""
    names = F.regexp_extract_all(svg, F.lit(r"<([A-Za-z][\w:.-]*)"), 1)
    values = F.regexp_extract_all(svg, F.lit(r"\shref\s*=\s*[\"']\s*([^\"']*)"), 1)
    paints = F.regexp_extract_all(svg, F.lit(r"(?i)url\s*\(\s*['\"]?([^)'\"]*)"), 1)
    return (
        F.when(svg.rlike(r"(?i)<!DOCTYPE|<!ENTITY"), "DECLARATION")
        .when(~svg.rlike(r"(?s)\A\s*(<\?xml[^>]*\?>)?\s*<svg[\s>]"), "NO_SVG")
        .when((F.size(names) > most_nodes) | (F.octet_length(svg) > most_bytes), "COMPLEXITY")
        .when(F.size(F.array_except(names, F.array(*[F.lit(x) for x in SVG_ELEMENTS]))) > 0, "ELEMENT")
        .when(svg.rlike(r"(?i)<[^>]*\son\w*\s*="), "EVENT")
        .when(F.exists(values, lambda v: ~v.startswith("#")), "EXTERNAL_REFERENCE")
        .when(svg.contains("\\"), "ESCAPE")
        .when(F.exists(paints, lambda v: ~F.trim(v).rlike(r"\A#\S+\z")), "EXTERNAL_PAINT")
        .when(svg.rlike(r"(?i)@import|@font-face|\b(image|image-set|-webkit-image-set|paint|src)\s*\("), "EXTERNAL_STYLE")
    )


def rectangular_picture(xml: Column) -> Column:
    """Whether a picture shows its whole rectangle: a plain rectangle without effects, masks,
    tiles or insets. Names are compared without their prefixes."""
    at = lambda *names: "".join(f"/*[local-name()='{n}']" for n in names)
    there = lambda path: F.xpath_boolean(xml, F.lit(path))
    shape, fill = "/*" + at("spPr"), "/*" + at("blipFill")
    gone = [shape + at("custGeom"), shape + at("effectLst") + "/*", shape + at("effectDag"), shape + at("scene3d"), shape + at("sp3d"), fill + at("tile"), fill + at("blip") + "/*"]
    inset = fill + at("stretch", "fillRect") + "/@*[. != '0' and . != '0%']"
    fine = there(shape + at("prstGeom") + "[@prst='rect']") & there(fill + at("blip"))
    for path in [*gone, inset]:
        fine = fine & ~there(path)
    return F.coalesce(fine, F.lit(False))


def graphemes(text: Column) -> Column:
    """How many characters a reader sees: extended grapheme clusters."""
    return F.regexp_count(text, F.lit(r"\X"))
