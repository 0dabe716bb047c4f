"""Markdown text as blocks, with DataFrame functions only: a line table, its kinds, and
runs of lines of one kind (gaps and islands); and the inline runs of a block's text."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, ord, kind, level and text: headings, list items, quotes, tables, fenced code,
    page breaks, rules and paragraphs. HTML stays literal."""
    lines = docs.select(key, F.posexplode(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n"), "\n", -1)).alias("pos", "line"))
    order = Window.partitionBy(key).orderBy("pos")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    fence = F.col("line").rlike(r"\A {0,3}(```|~~~)")
    lines = lines.withColumn("_fence", fence).withColumn("_open", F.coalesce(F.sum(F.col("_fence").cast("int")).over(before), F.lit(0)) % 2 == 1)
    kind = (
        F.when(F.col("_open") | F.col("_fence"), "code")
        .when(F.trim("line") == "", "blank")
        .when(F.lower(F.trim("line")) == "<!-- pagebreak -->", "pagebreak")
        .when(F.col("line").rlike(r"\A {0,3}#{1,6}(\s|\z)"), "heading")
        .when(F.col("line").rlike(r"\A {0,3}([-*_])\s*(\1\s*){2,}\z"), "rule")
        .when(F.col("line").rlike(r"\A\s*([-*+]|\d{1,9}[.)])\s"), "item")
        .when(F.col("line").rlike(r"\A {0,3}>"), "quote")
        .when(F.col("line").rlike(r"\A\s*\|.*\|\s*\z"), "table")
        .otherwise("paragraph")
    )
    lines = lines.withColumn("kind", kind)
    opens = F.col("_fence") & ~F.col("_open")
    new = opens | (F.lag("kind").over(order) != F.col("kind")) | F.col("kind").isin("heading", "item", "rule", "pagebreak") | F.lag("kind").over(order).isNull()
    lines = lines.withColumn("_run", F.sum(F.coalesce(new, F.lit(True)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    clean = (
        F.when(F.col("kind") == "heading", F.regexp_replace("line", r"\A {0,3}#{1,6}\s*|\s*#*\s*\z", ""))
        .when(F.col("kind") == "item", F.regexp_replace("line", r"\A\s*([-*+]|\d{1,9}[.)])\s+", ""))
        .when(F.col("kind") == "quote", F.regexp_replace("line", r"\A {0,3}> ?", ""))
        .otherwise(F.col("line"))
    )
    level = F.when(F.col("kind") == "heading", F.length(F.regexp_extract("line", r"(#{1,6})", 1))).when(F.col("kind") == "item", F.floor(F.length(F.regexp_extract("line", r"\A(\s*)", 1)) / 2) + 1)
    rows = lines.where("kind <> 'blank'").withColumn("_text", clean).withColumn("_level", level.cast("int"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_text"))), lambda x: x["_text"]), "\n")
    out = rows.groupBy(key, "_run").agg(F.first("kind").alias("kind"), F.first("_level").alias("level"), joined.alias("text"))
    return out.withColumn("ord", F.row_number().over(Window.partitionBy(key).orderBy("_run"))).drop("_run")


# --- inline runs ------------------------------------------------------------------

#: Where an inline construct may begin.
_MARK = re.compile(r"\\[!-/:-@\[-`{-~]|\\\n| {2,}\n|\n|`+|!\[|\[|\]|\*+|_+|~~|<[^<>\n]*>|&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_TARGET = re.compile(r"\(\s*(?:<([^<>\n]*)>|((?:[^\s()\\]|\\.|\((?:[^\s()\\]|\\.)*\))*))(?:\s+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?\s*\)")
_AUTO = re.compile(r"<(?:([a-zA-Z][a-zA-Z0-9+.-]{1,31}:[^\s<>]*)|([\w.!#$%&'*+/=?^`{|}~-]+@[\w-]+(?:\.[\w-]+)+))>\Z")
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>\Z|<!--.*-->\Z")
INLINES = "kind string, text string, styles array<string>, target string"


class _Run:
    """A piece of a line: text, or a row of * or _ that may open or close emphasis."""

    __slots__ = ("kind", "text", "styles", "target", "opens", "closes")

    def __init__(self, kind: str, text: str, target: str | None = None, opens: bool = False, closes: bool = False):
        self.kind, self.text, self.target, self.opens, self.closes = kind, text, target, opens, closes
        self.styles: set[str] = set()


def _flanks(text: str, start: int, end: int) -> tuple[bool, bool]:
    """Whether a row of delimiters may open and close emphasis."""
    before, after = text[start - 1 : start] or " ", text[end : end + 1] or " "
    space = (before.isspace(), after.isspace())
    sign = tuple(not c.isalnum() and not c.isspace() for c in (before, after))
    left = not space[1] and (not sign[1] or space[0] or sign[0])
    right = not space[0] and (not sign[0] or space[1] or sign[1])
    if text[start] == "_":
        return left and (not right or sign[0]), right and (not left or sign[1])
    return left, right


def _emphasised(runs: list[_Run]) -> None:
    """Pairs closing rows of delimiters with the nearest that may open them: two signs make
    strong text, one makes emphasis, and what stands between gets the style."""
    k = 0
    while k < len(runs):
        close = runs[k]
        if close.kind != "delimiter" or not close.closes or not close.text:
            k += 1
            continue
        for j in range(k - 1, -1, -1):
            o = runs[j]
            odd = (o.closes or close.opens) and (len(o.text) + len(close.text)) % 3 == 0 and (len(o.text) % 3 or len(close.text) % 3)
            if o.kind == "delimiter" and o.opens and o.text and o.text[0] == close.text[0] and not odd and (o.text[0] != "~" or len(o.text) == len(close.text)):
                n = 2 if len(o.text) > 1 and len(close.text) > 1 else 1
                style = "strike" if o.text[0] == "~" else ("em", "strong")[n - 1]
                for x in runs[j + 1 : k]:
                    x.styles.add(style)
                    if x.kind == "delimiter":
                        x.opens = x.closes = False
                o.text, close.text = o.text[n:], close.text[n:]
                break
        else:
            k += 1


def _parsed(text: str) -> list[_Run]:
    runs: list[_Run] = []
    brackets: list[int] = []  # places of [ and ![ that may begin a link
    at = 0

    def put(t: str) -> None:
        if t:
            runs.append(_Run("text", t))

    while m := _MARK.search(text, at):
        put(text[at : m.start()])
        sign, at = m[0], m.end()
        if sign[0] == "`":
            end = re.compile(rf"(?<!`){sign}(?!`)").search(text, at)
            if end:
                code = text[at : end.start()].replace("\n", " ")
                runs.append(_Run("code", code[1:-1] if len(code) > 2 and code[0] == code[-1] == " " and code.strip() else code))
                at = end.end()
            else:
                put(sign)
        elif sign == "\n" or sign.endswith("\n"):
            runs.append(_Run("soft" if sign == "\n" else "break", "\n"))
        elif sign[0] == "\\":
            put(sign[1])
        elif sign in ("[", "!["):
            brackets.append(len(runs))
            runs.append(_Run("bracket", sign))
        elif sign == "]":
            target = _TARGET.match(text, at) if brackets else None
            if target is None:
                if brackets:
                    runs[brackets.pop()].kind = "text"
                put("]")
                continue
            first = brackets.pop()
            image = runs[first].text == "!["
            held = runs[first + 1 :]
            _emphasised(held)
            address = html.unescape(re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", target[1] if target[1] is not None else target[2]))
            del runs[first:]
            if image:
                runs.append(_Run("image", "".join(x.text for x in held if x.kind != "delimiter" or x.text), address))
            else:
                for x in held:
                    if x.kind == "delimiter":
                        x.kind = "text"
                    x.target = x.target or address
                runs += [x for x in held if x.text]
                for b in brackets:  # no link within a link
                    if runs[b].text == "[":
                        runs[b].kind = "text"
                brackets = [b for b in brackets if runs[b].kind == "bracket"]
            at = target.end()
        elif sign[0] in "*_~":
            opens, closes = _flanks(text, m.start(), m.end())
            runs.append(_Run("delimiter", sign, None, opens, closes))
        elif sign[0] == "&":
            put(html.unescape(sign))
        elif auto := _AUTO.match(sign):
            runs.append(_Run("text", auto[1] or auto[2], auto[1] or "mailto:" + auto[2]))
        elif _TAG.match(sign):
            runs.append(_Run("html", sign))  # kept literally
        else:
            put("<")
            at = m.start() + 1
    put(text[at:])
    _emphasised(runs)
    return runs


def inline_runs(text: str) -> list[tuple[str, str, list[str], str | None]]:
    """kind, text, styles and target of the runs of a paragraph, equal neighbours joined."""
    out: list[tuple[str, str, list[str], str | None]] = []
    for r in _parsed(text):
        kind = "text" if r.kind in ("bracket", "delimiter") else r.kind
        row = (kind, r.text, sorted(r.styles), r.target)
        if not r.text:
            continue
        if kind == "text" and out and out[-1][0] == "text" and out[-1][2:] == row[2:]:
            out[-1] = ("text", out[-1][1] + r.text, *row[2:])
        else:
            out.append(row)
    return out


def inlines(block_table: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, ord (the block's), run, kind, text, styles and target of the inline runs of
    paragraphs, headings, items and quotes."""
    kind = dict(block_table.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, o, i, *r) for k, o, t in zip(b[key], b["ord"], b["text"], strict=True) for i, r in enumerate(inline_runs(t or ""))]
            yield pd.DataFrame(rows, columns=[key, "ord", "run", "kind", "text", "styles", "target"])

    held = block_table.where("kind IN ('paragraph', 'heading', 'item', 'quote')").select(key, "ord", "text")
    return held.mapInPandas(run, f"{key} {kind}, ord int, run int, {INLINES}")
