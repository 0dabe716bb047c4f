"""Drawings of workbooks: anchors, shapes, connectors, pictures and groups as one relation.

Members of groups carry the group's key and their place in the sheet's units through the
group's transforms; hidden drawings stay, marked, for the visibility rules. Nothing is drawn.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import DataFrame

from .ooxml import A, BOOK, R, S, _accepted, _rels

D = "{http://schemas.openxmlformats.org/drawingml/2006/spreadsheetDrawing}"
COMPAT = "{http://schemas.openxmlformats.org/markup-compatibility/2006}"
DRAWINGS = (
    "doc string, sheet_idx int, ord int, id string, source_id string, group_key string, kind string, preset string, name string, text string, hidden boolean, rotation double, flip_h boolean, flip_v boolean, "
    "anchor string, c1 int, dx1 long, r1 int, dy1 long, c2 int, dx2 long, r2 int, dy2 long, x long, y long, cx long, cy long, start_id string, end_id string, start_arrow string, end_arrow string, media string, crop string"
)
KINDS = {D + "sp": "shape", D + "cxnSp": "connector", D + "pic": "picture", D + "graphicFrame": "frame", D + "grpSp": "group"}
DEPTH = 16

Map = tuple[float, float, float, float]  # scale and shift of each axis


def _whole(node: ET.Element | None, name: str) -> int | None:
    found = None if node is None else node.get(name, node.findtext(D + name))
    return int(found) if found is not None and re.fullmatch(r"-?\d{1,15}", found.strip()) else None


def text_of(shape: ET.Element) -> str:
    """Paragraphs of a shape, without struck runs."""
    lines = []
    for p in shape.iter(A + "p"):
        line = ""
        for r in p:
            props = r.find(A + "rPr")
            if r.tag == A + "br":
                line += "\n"
            elif r.tag in (A + "r", A + "fld") and (props is None or props.get("strike", "noStrike") == "noStrike"):
                line += r.findtext(A + "t") or ""
        lines.append(line)
    return "\n".join(lines).strip("\n")


def _members(node: ET.Element) -> Iterator[ET.Element]:
    for x in node:
        if x.tag in KINDS:
            yield x
        elif x.tag == COMPAT + "AlternateContent":
            choice = x.find(COMPAT + "Choice")
            yield from _members(choice if choice is not None else (x.findall(COMPAT + "Fallback") or [ET.Element("none")])[-1])


class Reader:
    def __init__(self, doc: str, sheet: int, media: dict[str, str]):
        self.doc, self.sheet, self.media = doc, sheet, media
        self.rows: list[tuple] = []
        self.groups = 0

    def read(self, shape: ET.Element, anchor: tuple, place: Map, group: str | None, depth: int, hidden: bool) -> None:
        if depth > DEPTH:
            raise ValueError("GROUP_DEPTH_LIMIT")
        named = next(shape.iter(D + "cNvPr"), None)
        hidden = hidden or named is not None and named.get("hidden") in ("1", "true")
        xfrm = shape.find(f"{D}grpSpPr/{A}xfrm") if shape.tag == D + "grpSp" else shape.find(f"{D}spPr/{A}xfrm")
        if xfrm is None:
            xfrm = shape.find(D + "xfrm")
        off, ext = (None, None) if xfrm is None else (xfrm.find(A + "off"), xfrm.find(A + "ext"))
        if shape.tag == D + "grpSp":
            if group is None:
                self.groups += 1
                group = f"group-{self.sheet}-{self.groups}"
            inner = place
            start, size = (None, None) if xfrm is None else (xfrm.find(A + "chOff"), xfrm.find(A + "chExt"))
            if None not in (off, ext, start, size) and _whole(size, "cx") and _whole(size, "cy"):
                sx, sy = _whole(ext, "cx") / _whole(size, "cx"), _whole(ext, "cy") / _whole(size, "cy")
                ax, bx, ay, by = place
                inner = (ax * sx, bx + ax * (_whole(off, "x") - sx * _whole(start, "x")), ay * sy, by + ay * (_whole(off, "y") - sy * _whole(start, "y")))
            for x in _members(shape):
                self.read(x, anchor, inner, group, depth + 1, hidden)
            return
        box = (None,) * 4
        if off is not None and ext is not None:
            ax, bx, ay, by = place
            box = (round(ax * _whole(off, "x") + bx), round(ay * _whole(off, "y") + by), round(ax * _whole(ext, "cx")), round(ay * _whole(ext, "cy")))
        ends = {k: next(shape.iter(A + k), None) for k in ("stCxn", "endCxn", "headEnd", "tailEnd")}
        get = lambda k, a: None if ends[k] is None else ends[k].get(a)
        blip, cut = next(shape.iter(A + "blip"), None), next(shape.iter(A + "srcRect"), None)
        geometry = next(shape.iter(A + "prstGeom"), None)
        preset = geometry.get("prst") if geometry is not None else "custGeom" if next(shape.iter(A + "custGeom"), None) is not None else None
        turn = 0 if xfrm is None else int(xfrm.get("rot", 0))
        flips = [xfrm is not None and xfrm.get(f) in ("1", "true") for f in ("flipH", "flipV")]
        source = None if named is None else named.get("id")
        media = None if blip is None else self.media.get(blip.get(R + "embed", ""))
        crop = None if cut is None else ",".join(cut.get(k, "0") for k in "ltrb")
        n = len(self.rows)
        self.rows.append((self.doc, self.sheet, n, f"drawing-{self.sheet}-{n + 1}", source, group, KINDS[shape.tag], preset, None if named is None else named.get("name"), text_of(shape), hidden, turn / 60_000, *flips, *anchor, *box, get("stCxn", "id"), get("endCxn", "id"), get("headEnd", "type"), get("tailEnd", "type"), media, crop))

    def drawing(self, root: ET.Element) -> None:
        for a in root:
            kind = a.tag.removeprefix(D)
            if kind not in ("twoCellAnchor", "oneCellAnchor", "absoluteAnchor"):
                continue
            corners = []
            for end in ("from", "to"):
                at = a.find(D + end)
                corners += [_whole(at, k) for k in ("col", "colOff", "row", "rowOff")]
            for x in _members(a):
                self.read(x, (kind.removesuffix("Anchor"), *corners), (1.0, 0.0, 1.0, 0.0), None, 0, False)


def read(doc: str, content: bytes) -> list[tuple]:
    rows: list[tuple] = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        _accepted(z, "/xl/workbook.xml", BOOK)
        book, rels = ET.fromstring(z.read("xl/workbook.xml")), _rels(z, "xl/workbook.xml")
        for k, sheet in enumerate(book.iter(S + "sheet")):
            if sheet.get("state") in ("hidden", "veryHidden"):
                continue
            part = rels[sheet.get(R + "id")]
            held = ET.fromstring(z.read(part)).find(S + "drawing")
            target = None if held is None else _rels(z, part).get(held.get(R + "id"))
            if target is not None:
                reader = Reader(doc, k, _rels(z, target))
                reader.drawing(ET.fromstring(z.read(target)))
                rows += reader.rows
    return rows


def drawings(files: DataFrame) -> DataFrame:
    """The drawings of every workbook (path, content), in the schema DRAWINGS; a file that
    cannot be read has none (its reason is among ooxml.failures)."""
    names = [x.split()[0] for x in DRAWINGS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for d, c in zip(b["path"], b["content"], strict=True):
                try:
                    rows = read(d, bytes(c or b""))
                except (zipfile.BadZipFile, KeyError, ET.ParseError, ValueError, TypeError):
                    rows = []
                yield pd.DataFrame(rows, columns=names).astype(object)

    return files.select("path", "content").mapInPandas(run, DRAWINGS)
