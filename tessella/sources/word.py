"""Word files as Markdown blocks.

A document is read once into a stream of pieces (text with its weight, page breaks, notes,
links, notices), paragraph by paragraph; a second step renders pieces as Markdown and cuts
blocks at page breaks. Styles are resolved through their ancestors, list numbers are kept by
list, and notes follow in the order in which they were first referred to, notes of notes last.
Deleted text, text that has moved away, struck and hidden runs and field codes do not show.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from functools import cached_property
from typing import Any
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.numbering import roman
from .ooxml import R, W, _rels

BLOCKS = "doc string, ord int, page int, kind string, ref string, markdown string"
MAIN = "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"
MATH = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"
COMPAT = "{http://schemas.openxmlformats.org/markup-compatibility/2006}"
DEPTH, ITEMS = 128, 2_000_000
GONE = frozenset(W + n for n in ("del", "moveFrom"))
#: Elements whose children stand in their place.
THROUGH = frozenset(W + n for n in ("ins", "moveTo", "smartTag", "customXml", "sdtContent", "fldSimple"))
OFF = ("false", "0", "off")
_HEADING = re.compile(r"(?i)\s*(?:heading|見出し)\s*([1-6])\s*")
_PROTECTED = re.compile(r"[\\`*_\[\]|#!{}~+\-]")
_LEADING = re.compile(r"(?m)^(\d+)\.(?=\s|$)")
_WEB = re.compile(r"(?i)https?://[^/?#@\s\\]+([/?#][^<>\"{}|^`\\\s]*)?\Z|mailto:[^\s\\]+\Z")


class Refused(ValueError):
    """A document that is not read; its code says why."""


# --- Markdown ---------------------------------------------------------------------


def escaped(text: str) -> str:
    text = text.replace("\r\n", "\n").replace("\r", "\n").replace("\0", "")
    text = _PROTECTED.sub(lambda m: "\\" + m[0], text)
    return _LEADING.sub(r"\1\\.", text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;"))


def strong(text: str) -> str:
    mark = lambda x: x and (f"**{x}**" if x[0].isalnum() and x[-1].isalnum() else f"<strong>{x}</strong>")
    return "\n".join(map(mark, text.split("\n")))


def linked(label: str, address: str) -> str | None:
    """The label as a link, or nothing where the address is not safe."""
    if not _WEB.match(address.replace(" ", "%20")):
        return None
    for raw, code in ((" ", "%20"), ("(", "%28"), (")", "%29"), ("|", "%7C")):
        address = address.replace(raw, code)
    return f"[{label}]({address})"


# --- properties -------------------------------------------------------------------


def attr(node: ET.Element | None, name: str = "val", default: str = "") -> str:
    return default if node is None else node.get(W + name, default)


def number(text: str, default: int) -> int:
    return int(text) if re.fullmatch(r"[+-]?\d{1,9}", text) else default


def child(node: ET.Element | None, path: str) -> ET.Element | None:
    return None if node is None else node.find("/".join(W + n for n in path.split("/")))


class Styles:
    def __init__(self, root: ET.Element | None):
        self.defaults = child(root, "docDefaults")
        self.by_id = {attr(s, "styleId"): s for s in (root if root is not None else ()) if s.tag == W + "style"}
        self.plain = next((i for i, s in self.by_id.items() if attr(s, "type") == "paragraph" and attr(s, "default") == "1"), "")

    def lineage(self, name: str) -> list[ET.Element]:
        """A style and its ancestors, the farthest first: 64 at most, each once."""
        found: dict[str, ET.Element] = {}
        while name in self.by_id and name not in found and len(found) < 64:
            found[name] = self.by_id[name]
            name = attr(child(found[name], "basedOn"))
        return [*found.values()][::-1]

    def _layers(self, props: ET.Element | None, kind: str) -> Iterator[ET.Element | None]:
        """What sets a paragraph's or run's properties, the weakest first."""
        yield child(self.defaults, f"{kind}Default/{kind}")
        for s in self.lineage(attr(child(props, "pStyle")) or self.plain):
            yield child(s, kind)

    def paragraph(self, p: ET.Element, *names: str) -> dict[str, ET.Element]:
        """The strongest setting of each named property of a paragraph."""
        props, out = child(p, "pPr"), {}
        for layer in (*self._layers(props, "pPr"), props):
            for n in names:
                if (e := child(layer, n)) is not None:
                    out[n] = e
        return out

    def run(self, p: ET.Element, r: ET.Element) -> tuple[bool, bool]:
        """Whether a run is bold, and whether it shows."""
        own, state = child(r, "rPr"), {}
        layers = [*self._layers(child(p, "pPr"), "rPr"), *(child(s, "rPr") for s in self.lineage(attr(child(own, "rStyle")))), own]
        for layer in layers:
            for e in layer if layer is not None else ():
                state[e.tag] = attr(e).lower() not in OFF
        return state.get(W + "b", False), not any(state.get(W + n) for n in ("strike", "dstrike", "vanish", "webHidden"))

    def heading(self, p: ET.Element) -> int:
        level = self.paragraph(p, "outlineLvl").get("outlineLvl")
        if level is not None:
            n = number(attr(level), 9)
            return n + 1 if 0 <= n < 6 else 0
        name = attr(child(p, "pPr/pStyle"))
        for s in reversed(self.lineage(name)):
            if m := _HEADING.fullmatch(attr(child(s, "name"))) or _HEADING.fullmatch(attr(s, "styleId")):
                return int(m[1])
        m = _HEADING.fullmatch(name)
        return int(m[1]) if m else 0


class Numbers:
    """Counters of the lists of a document."""

    def __init__(self, root: ET.Element | None):
        self.root, self.counts = root, {}

    @cached_property
    def lists(self) -> dict[str, dict[int, tuple[int, str, str, int]]]:
        """Start, format, pattern and restart of each level of each list."""
        kinds: dict[str, dict] = {}
        out: dict[str, dict] = {}

        def level(e: ET.Element, k: int) -> tuple[int, str, str, int]:
            return number(attr(child(e, "start")), 1), attr(child(e, "numFmt")), attr(child(e, "lvlText")), number(attr(child(e, "lvlRestart")), k)

        for e in self.root if self.root is not None else ():
            if e.tag == W + "abstractNum":
                kinds[attr(e, "abstractNumId")] = {(k := number(attr(x, "ilvl"), -1)): level(x, k) for x in e.findall(W + "lvl")}
        for e in self.root if self.root is not None else ():
            if e.tag == W + "num" and (kind := kinds.get(attr(child(e, "abstractNumId")))) is not None:
                own = dict(kind)
                for o in e.findall(W + "lvlOverride"):
                    k = number(attr(o, "ilvl"), -1)
                    if (x := child(o, "lvl")) is not None:
                        own[k] = level(x, k)
                    if (x := child(o, "startOverride")) is not None:
                        own[k] = (number(attr(x), 1), *own.get(k, (1, "", "", k))[1:])
                out[attr(e, "numId")] = own
        return out

    def shown(self, value: int, fmt: str) -> str:
        if fmt == "decimalZero":
            return f"{value:02d}" if value >= 0 else str(value)
        if fmt in ("lowerLetter", "upperLetter") and value > 0:
            text = ""
            while value:
                value, k = divmod(value - 1, 26)
                text = chr(97 + k) + text
            return text if fmt[0] == "l" else text.upper()
        if fmt in ("lowerRoman", "upperRoman") and 0 < value < 4000:
            return roman(value).lower() if fmt[0] == "l" else roman(value)
        return str(value)

    def prefix(self, settings: list[ET.Element]) -> tuple[str, str | None]:
        """What a paragraph's number puts before it, and a notice. settings: the numPr
        elements that apply, the weakest first."""
        name, at = "", 0
        for s in settings:
            if (e := child(s, "numId")) is not None:
                name = attr(e)
            if (e := child(s, "ilvl")) is not None:
                at = number(attr(e), 0)
        if name in ("", "0"):
            return "", None
        at = min(max(at, 0), 8)
        levels = self.lists.get(name)
        if levels is None:
            return "  " * at + "- ", "NUMBERING_APPROXIMATED"
        have = self.counts.setdefault(name, {})
        get = lambda k: levels.get(k, (1, "", "", k))
        have[at] = have[at] + 1 if at in have else get(at)[0]
        for k in [k for k in have if k > at and get(k)[3] and at < get(k)[3]]:
            del have[k]
        _, fmt, pattern, _ = get(at)
        if fmt in ("bullet", "none"):
            return ("  " * at + "- ") if fmt == "bullet" else "", None
        told = re.sub(r"%([1-9])", lambda m: self.shown(have.get(int(m[1]) - 1, get(int(m[1]) - 1)[0]), get(int(m[1]) - 1)[1]), pattern or f"%{at + 1}.")
        known = ("", "decimal", "decimalZero", "lowerLetter", "upperLetter", "lowerRoman", "upperRoman")
        return "  " * at + escaped(told + " "), None if fmt in known else "NUMBERING_APPROXIMATED"


# --- pieces -----------------------------------------------------------------------

Piece = tuple[str, Any]  # text, bold, line, page, note, link, mark, notice


class Reader:
    def __init__(self, archive: zipfile.ZipFile, depth: int = DEPTH, items: int = ITEMS):
        names = set(archive.namelist())
        part = lambda n: ET.fromstring(archive.read(n)) if n in names else None
        types = part("[Content_Types].xml")
        for t in types if types is not None else ():
            kind = t.get("ContentType", "").lower()
            if "vba" in kind or "macroenabled" in kind:
                raise Refused("MACRO_NOT_SUPPORTED")
            if t.get("PartName") == "/word/document.xml" and kind != MAIN.lower():
                raise Refused("UNSUPPORTED_FORMAT")
        if any("vbaproject" in n.lower() for n in names):
            raise Refused("MACRO_NOT_SUPPORTED")
        self.body = child(part("word/document.xml"), "body")
        self.rels = _rels(archive, "word/document.xml")
        self.external = _external(archive, "word/_rels/document.xml.rels") if "word/_rels/document.xml.rels" in names else {}
        self.styles, self.numbers = Styles(part("word/styles.xml")), Numbers(part("word/numbering.xml"))
        self.note_parts = {"footnote": part("word/footnotes.xml"), "endnote": part("word/endnotes.xml")}
        self.notes: dict[str, ET.Element | None] = {}
        self.fields: list[bool] = []
        self.paragraphs = self.tables = 0
        self.left = items
        for root in (self.body, *self.note_parts.values()):
            self._bounded(root, depth)

    def _bounded(self, root: ET.Element | None, depth: int) -> None:
        level = [] if root is None else [root]
        while level:
            self.left -= len(level)
            depth -= 1
            if depth < 0 or self.left < 0:
                raise Refused("DOCUMENT_DEPTH_LIMIT" if depth < 0 else "READ_ITEMS_LIMIT")
            level = [y for x in level for y in x]

    def seen(self) -> bool:
        return all(self.fields)

    def pieces(self, node: ET.Element, p: ET.Element) -> Iterator[Piece]:
        for x in node:
            yield from self.piece(x, p)

    def piece(self, x: ET.Element, p: ET.Element) -> Iterator[Piece]:
        tag = x.tag
        if tag in GONE:
            return
        if tag == W + "r":
            bold, shows = self.styles.run(p, x)
            if not shows:
                yield "notice", "HIDDEN_OR_STRUCK_REMOVED"
            for y in x:
                for kind, value in self.piece(y, p):
                    if shows or kind == "page":  # what is hidden keeps its page breaks and fields
                        yield ("bold", value) if kind == "text" and bold else (kind, value)
        elif tag == W + "fldChar":
            kind = attr(x, "fldCharType")
            if kind == "begin":
                self.fields.append(False)
                yield "notice", "FIELD_CACHED_RESULT"
            elif self.fields and kind == "separate":
                self.fields[-1] = True
            elif self.fields and kind == "end":
                self.fields.pop()
        elif tag == W + "hyperlink":
            yield "link", (self.external.get(x.get(R + "id", ""), ""), list(self.pieces(x, p)))
        elif tag in THROUGH:
            yield from self.pieces(x, p)
        elif tag == W + "sdt":
            if (held := child(x, "sdtContent")) is not None:
                yield from self.pieces(held, p)
        elif tag == COMPAT + "AlternateContent":
            first = x.find(COMPAT + "Choice")
            last = x.findall(COMPAT + "Fallback")
            if (held := first if first is not None else last[-1] if last else None) is not None:
                yield from self.pieces(held, p)
        elif not self.seen():
            return
        elif tag == W + "t":
            yield "text", x.text or ""
        elif tag == W + "tab":
            yield "mark", "    "
        elif tag == W + "noBreakHyphen":
            yield "text", "‑"
        elif tag == W + "cr" or tag == W + "br" and attr(x, "type") != "page":
            yield "mark", "\n"
        elif tag in (W + "br", W + "lastRenderedPageBreak"):
            yield "page", None
        elif tag in (W + "footnoteReference", W + "endnoteReference"):
            if (n := number(attr(x, "id"), -1)) >= 0:
                yield "note", (tag[len(W) : -len("Reference")], n)
        elif tag.startswith(MATH):
            yield "notice", "EQUATION_UNSUPPORTED"
            yield "mark", "（数式オブジェクトは未対応）"

    def rendered(self, pieces: Iterator[Piece], *, pages: bool, notices: list[str]) -> list[str]:
        """The Markdown of a paragraph's pieces, cut at its page breaks."""
        out = [""]
        for kind, value in pieces:
            if kind == "text":
                out[-1] += escaped(value)
            elif kind == "bold":
                out[-1] += strong(escaped(value))
            elif kind == "mark":
                out[-1] += value
            elif kind == "page":
                if pages:
                    out.append("")
                elif value is None:
                    out[-1] += "\n"
            elif kind == "note":
                key = f"{value[0]}-{value[1]}"
                self.notes.setdefault(key, next((e for e in (self.note_parts[value[0]] if self.note_parts[value[0]] is not None else ()) if attr(e, "id") == str(value[1])), None))
                out[-1] += f"[^{key}]"
            elif kind == "link":
                address, held = value
                label, *more = self.rendered(iter(held), pages=pages, notices=notices)
                made = linked(label, address) if label and not more else None
                if made is None and label:
                    notices.append("UNSUPPORTED_LINK")
                out[-1] += made or label
                out += more
            elif kind == "notice":
                notices.append(value)
        return out

    def paragraph(self, p: ET.Element, notices: list[str], *, cell: bool = False, pages: bool = True) -> tuple[bool, list[str]]:
        """Whether a page begins before a paragraph, and its Markdown by page."""
        layers = (*self.styles._layers(child(p, "pPr"), "pPr"), child(p, "pPr"))
        prefix, notice = self.numbers.prefix([e for layer in layers if (e := child(layer, "numPr")) is not None])
        if notice:
            notices.append(notice)
        parts = self.rendered(self.pieces(p, p), pages=pages, notices=notices)
        before = child(p, "pPr/pageBreakBefore")
        first = next((k for k, x in enumerate(parts) if x.strip()), None)
        if first is not None:
            head = self.styles.heading(p)
            parts[first] = prefix + ("#" * head + " " if head and not cell else "") + parts[first]
        return pages and before is not None and attr(before).lower() not in OFF, parts

    def cell(self, c: ET.Element, notices: list[str]) -> str:
        """Paragraphs of a cell, joined by line breaks; a table within is its text."""
        out = []
        for x in _content(c):
            if x.tag == W + "p":
                out.append("".join(self.paragraph(x, notices, cell=True, pages=False)[1]))
            elif x.tag == W + "tbl":
                notices.append("NESTED_TABLE_UNSUPPORTED")
                was, self.fields = self.fields, []
                lines = ("".join(v for k, v in self.pieces(p, p) if k in ("text", "bold", "mark")) for p in _paragraphs(x))
                out.append(escaped("\n".join(t for t in lines if t).strip()))
                self.fields = was
        return "<br>".join(x.replace("\n", "<br>") for x in out if x.strip())

    def table(self, t: ET.Element, notices: list[str]) -> str:
        """A Markdown table: spans leave empty cells, continued merges are empty."""
        rows, head = [], False
        for r in _content(t, "tr"):
            props = child(r, "trPr")
            on = lambda n: (e := child(props, n)) is not None and attr(e).lower() not in OFF  # noqa: E731, B023
            if on("del"):
                continue
            if not rows:
                head = on("tblHeader")
            line = [""] * max(0, number(attr(child(props, "gridBefore")), 0))
            for c in _content(r, "tc"):
                own = child(c, "tcPr")
                if child(own, "cellDel") is not None:
                    continue
                continued = any((e := child(own, n)) is not None and attr(e) != "restart" for n in ("vMerge", "hMerge"))
                line += ["" if continued else self.cell(c, notices)] + [""] * (number(attr(child(own, "gridSpan")), 1) - 1)
            rows.append(line + [""] * max(0, number(attr(child(props, "gridAfter")), 0)))
        grid = child(t, "tblGrid")
        width = max([len(grid.findall(W + "gridCol")) if grid is not None else 0, *map(len, rows)])
        if not rows or not width:
            return ""
        told = ["|" + "".join(f" {x} |" for x in [*r, *[""] * (width - len(r))]) for r in rows]
        top = told[0] if head else "|" + "  |" * width
        return "\n".join([top, "|" + " --- |" * width, *told[head:]])

    def blocks(self, root: ET.Element | None, *, note: bool = False) -> Iterator[tuple[str, str, bool, list[str], list[str]]]:
        """kind, ref, whether a page begins before, Markdown by page, notices."""
        for x in _content(root) if root is not None else ():
            notices: list[str] = []
            if x.tag == W + "p":
                self.paragraphs += 1
                before, parts = self.paragraph(x, notices, pages=not note)
                yield "paragraph", f"paragraph:{self.paragraphs}", before, parts, notices
            elif x.tag == W + "tbl":
                self.tables += 1
                yield "table", f"table:{self.tables}", False, [self.table(x, notices)], notices
            elif x.tag == W + "altChunk":
                yield "unsupported", "document", False, ["（挿入文書は未対応）"], ["ALTERNATIVE_CONTENT_UNSUPPORTED"]


def _content(node: ET.Element, *names: str) -> Iterator[ET.Element]:
    """Children that count, through containers and insertions."""
    for x in node:
        if x.tag in GONE:
            continue
        if x.tag in THROUGH or x.tag == W + "sdt":
            yield from _content(x, *names)
        elif not names or x.tag in [W + n for n in names]:
            yield x


def _paragraphs(node: ET.Element) -> Iterator[ET.Element]:
    for x in _content(node):
        if x.tag == W + "p":
            yield x
        else:
            yield from _paragraphs(x)


def _external(archive: zipfile.ZipFile, name: str) -> dict[str, str]:
    return {r.get("Id", ""): r.get("Target", "") for r in ET.fromstring(archive.read(name)) if r.get("TargetMode") == "External"}


def read(doc: str, content: bytes) -> list[tuple]:
    """The rows of a document: its pages, blocks and notes in order, and its notices."""
    out: list[tuple] = []
    told: set[tuple[str, str]] = set()
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        reader = Reader(z)
    page, any_text = 1, False

    def put(kind: str, ref: str, text: str) -> None:
        out.append((doc, len(out), page, kind, ref, text))

    def note_all(ref: str, notices: list[str]) -> None:
        for code in notices:
            if (code, ref) not in told:
                told.add((code, ref))
                put("notice", ref, code)

    put("page", "page", "[page 1]")
    for kind, ref, before, parts, notices in reader.blocks(reader.body):
        for k, text in enumerate(parts):
            if (k or before) and (any_text or page > 1):
                page += 1
                put("page", "page", f"[page {page}]")
            if text.strip():
                put(kind, ref, text.rstrip())
                any_text = True
        note_all(ref, notices)
    done = 0
    while done < len(reader.notes):  # a note's text may refer to further notes
        key, node = list(reader.notes.items())[done]
        done += 1
        if node is None:
            put("note", key, f"[^{key}]: （参照先なし）")
            note_all(key, ["MISSING_NOTE"])
            continue
        reader.fields.clear()
        parts, notices = [], []
        for _, _, _, texts, more in reader.blocks(node, note=True):
            parts += [t.rstrip() for t in texts if t.strip()]
            notices += more
        put("note", key, f"[^{key}]: " + "\n\n".join(parts).strip().replace("\n", "\n    "))
        note_all(key, notices)
    return out


def blocks(files: DataFrame) -> DataFrame:
    """The rows of every file (path, content), in the schema BLOCKS; a file that cannot be
    read is one row of kind error with a code."""
    names = [x.split()[0] for x in BLOCKS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for d, c in zip(b["path"], b["content"], strict=True):
                try:
                    rows = read(d, bytes(c or b""))
                except Refused as e:
                    rows = [(d, 0, None, "error", "document", str(e))]
                except (zipfile.BadZipFile, KeyError, ET.ParseError, ValueError):
                    rows = [(d, 0, None, "error", "document", "INVALID_DOCUMENT")]
                yield pd.DataFrame(rows, columns=names).astype(object)

    return files.select("path", "content").mapInPandas(run, BLOCKS)


def markdown(rows: DataFrame) -> DataFrame:
    """One Markdown text for each document, its blocks apart by blank lines. The text of a
    document is one row, as its file was."""
    kept = rows.where("kind NOT IN ('notice', 'error')")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("ord", "markdown"))), lambda x: F.concat(x["markdown"], F.lit("\n\n")))
    return kept.groupBy("doc").agg(F.array_join(parts, "").alias("markdown"))
