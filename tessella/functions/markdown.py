"""Markdown text functions (Column -> Column, within code generation)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that a backslash protects in Markdown (fixed values).
PROTECTED = r"([\\`*_\[\]|#!{}~+\-])"


def escape(text: Column) -> Column:
    """Line ends to LF, markup characters protected, NUL dropped, and a leading
    number with a period kept from becoming a list. Backslashes come first, so that
    the entities made afterwards are left alone."""
    x = F.regexp_replace(text, r"\r\n?", "\n")
    x = F.regexp_replace(F.replace(x, F.lit("\0"), F.lit("")), PROTECTED, r"\\$1")
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        x = F.replace(x, F.lit(raw), F.lit(entity))
    return F.regexp_replace(x, r"(?m)^(\d+)\.(?=\s|$)", r"$1\\.")


def bold(escaped: Column) -> Column:
    """Line by line: ** where both ends are alphanumeric, <strong> elsewhere."""
    plain = r"\A[\p{L}\p{Nd}](?s:.*[\p{L}\p{Nd}])?\z"

    def line(x: Column) -> Column:
        return F.when(x == "", "").when(x.rlike(plain), F.concat(F.lit("**"), x, F.lit("**"))).otherwise(F.concat(F.lit("<strong>"), x, F.lit("</strong>")))

    return F.array_join(F.transform(F.split(escaped, "\n", -1), line), "\n")


def safe_link(address: Column) -> Column:
    """http(s) with an authority and no user part, or mailto with an address."""
    clean = ~address.rlike(r"[\x00-\x1f\x7f\\]") & (F.trim(address) != "")
    web = address.rlike(r"(?i)\Ahttps?://[^/?#@\s]+([/?#][^<>\"{}|^`]*)?\z")
    return F.coalesce(clean & (web | address.rlike(r"(?i)\Amailto:[^\s]+\z")), F.lit(False))


def link(escaped_label: Column, address: Column) -> Column:
    """The label as a link, or alone where the address is not safe."""
    target = address
    for raw, code in ((" ", "%20"), ("(", "%28"), (")", "%29"), ("<", "%3C"), (">", "%3E"), ('"', "%22"), ("|", "%7C")):
        target = F.replace(target, F.lit(raw), F.lit(code))
    return F.when(safe_link(address), F.concat(F.lit("["), escaped_label, F.lit("]("), target, F.lit(")"))).otherwise(escaped_label)


def single_line(text: Column) -> Column:
    """White space collapsed, ISO controls dropped, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\s+", " "), r"[\x00-\x1f\x7f-\x9f]", ""))


def is_break(html: Column) -> Column:
    """page, line or null: the HTML tokens that break pages and lines."""
    t = F.lower(F.trim(html))
    return F.when(t == "<!-- pagebreak -->", "page").when(t.isin("<br>", "<br/>", "<br />"), "line")


def heading_level(style_name: Column) -> Column:
    """1..6 from a style name such as "heading 2", else null."""
    n = F.regexp_extract(F.lower(style_name), r"\A(?:heading|見出し)\s*(\d)\z", 1)
    return F.when(n.between("1", "6"), n.cast("int"))


def pdf_text(text: Column) -> Column:
    """LF line ends, controls dropped, no-break spaces plain."""
    x = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"[\x00-\x08\x0b-\x1f\x7f]", "")
    return F.replace(x, F.lit(" "), F.lit(" "))


def formula_display(cached: Column, formula: Column, images: bool = False) -> Column:
    """The cached value; without one, the formula or the marker of the image app."""
    return F.coalesce(cached, F.lit("#UNCALCULATED") if images else F.concat(F.lit("="), formula))


def table_row(cells: Column) -> Column:
    """A Markdown table row; line ends within cells become <br>."""
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit("<br>"))), " | "), F.lit(" |"))
