"""List numbers of documents: levels, start values, restarts and formats."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = 9
MOST_ROWS = 4096  # that a worker holds besides a section's own


def roman(n: int) -> str:
    out = ""
    for value, text in ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")):
        out, n = out + text * (n // value), n % value
    return out


def shown(n: int, fmt: str) -> str:
    if fmt in ("bullet", "none"):
        return ""
    if fmt == "decimalZero":
        return f"{n:02d}"
    if fmt in ("upperLetter", "lowerLetter") and n > 0:
        text = chr(65 + (n - 1) % 26) * ((n - 1) // 26 + 1)
        return text if fmt[0] == "u" else text.lower()
    if fmt in ("upperRoman", "lowerRoman") and 0 < n < 4000:
        return roman(n) if fmt[0] == "u" else roman(n).lower()
    return str(n)


def _folded(paragraphs: DataFrame, by: list[str], columns: list[str], labels: Callable[[list[tuple]], list[str]]) -> DataFrame:
    """by, ord and the label of each row: labels() of the rows (ord and columns) of each section, by ord. A
    task reads its sections one after the other; many small ones cost no frame each."""
    kinds, n = dict(paragraphs.dtypes), len(by)
    names = [*by, "ord"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types: list[pa.DataType] = []

        def rows() -> Iterator[tuple]:
            for b in batches:
                types[:] = [b.schema.field(c).type for c in names]
                yield from zip(*[b.column(c).to_pylist() for c in [*names, *columns]], strict=True)

        def made(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True), [*types, pa.string()], strict=True)], [*names, "label"])

        out: list[tuple] = []
        for key, section in groupby(rows(), lambda r: r[:n]):
            held = [r[n:] for r in section]
            out += [(*key, r[0], label) for r, label in zip(held, labels(held), strict=True)]
            if len(out) >= MOST_ROWS:
                yield made(out)
                out = []
        if out:
            yield made(out)

    dealt = paragraphs.select(*names, *columns).repartition(*by).sortWithinPartitions(*by, F.col("ord").asc_nulls_last())
    return dealt.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in names) + ", label string")


def numbered(paragraphs: DataFrame, by: list[str]) -> DataFrame:
    """paragraphs: by, ord, num_id, level, format, pattern (such as "%1.%2"), start,
    restart (the level after which it restarts; -1: never; null: any lower). Adds label.
    The counters are a fold over one document, so a document is a group."""

    def labels(rows: list[tuple]) -> list[str]:
        counters: dict = {}
        formats: dict = {}
        limits: dict = {}
        for _, num_id, level, _, _, _, restart in rows:
            limits.setdefault((num_id, level), restart)
        out = []
        for _, num_id, level, fmt, pattern, start, _ in rows:
            have, known = counters.setdefault(num_id, {}), formats.setdefault(num_id, {})
            known[level] = fmt
            have[level] = have[level] + 1 if level in have else 1 if start is None else start
            for lower in range(level + 1, LEVELS):
                rule = limits.get((num_id, lower))
                if rule is None or 0 <= rule and level <= rule:
                    have.pop(lower, None)
            text = "•" if fmt == "bullet" else pattern or ""
            for k in range(LEVELS):
                if f"%{k + 1}" in text:
                    text = text.replace(f"%{k + 1}", shown(have.get(k, 1), known.get(k, "decimal")))
            out.append(text)
        return out

    return _folded(paragraphs, by, ["num_id", "level", "format", "pattern", "start", "restart"], labels)


#: How a slide's numbers are written: what counts, and what stands around it (fixed values).
SCHEMES = {f"{base}{end}": (fmt, a, z) for base, fmt in (("arabic", "decimal"), ("alphaLc", "lowerLetter"), ("alphaUc", "upperLetter"), ("romanLc", "lowerRoman"), ("romanUc", "upperRoman")) for end, a, z in (("Period", "", "."), ("ParenR", "", ")"), ("ParenBoth", "(", ")"), ("Plain", "", ""))}


def slide_numbered(paragraphs: DataFrame, by: list[str]) -> DataFrame:
    """paragraphs: by, ord, level, scheme (null without number), start (null unless stated) and
    bullet. Adds label. A number goes on while its level keeps the scheme and no higher level
    intervenes; a bullet ends its level's count, plain text ends all. One shape's text is a group."""

    def labels(rows: list[tuple]) -> list[str]:
        counts: dict[int, int] = {}
        known: dict[int, str] = {}
        out = []
        for _, level, scheme, start, bullet in rows:
            level, label = min(max(level, 0), 8), ""
            if scheme is not None:
                first = 1 if start is None else start
                n = counts.get(level, first) if start is None and known.get(level) == scheme else first
                counts = {k: v for k, v in counts.items() if k < level} | {level: n + 1}
                known[level] = scheme
                fmt, before, after = SCHEMES.get(scheme, ("decimal", "", "."))
                label = before + shown(n, fmt) + after
            elif bullet:
                label = "-"
                counts.pop(level, None)
                known.pop(level, None)
            else:
                counts, known = {}, {}
            out.append(label)
        return out

    return _folded(paragraphs, by, ["level", "scheme", "start", "bullet"], labels)
