"""Personal data: fixed patterns, and a linear-chain CRF for what they miss.

The CRF tags words by their shapes and their neighbours' and is trained, on the
driver and within seconds, from a small labelled table made by rule. A word ends at
white space, at = : / & ? , ; quotes and brackets, and where a script without spaces
begins or ends; it is read whole, however long. Only a word with a digit or an @, or one
that follows a name of secrets and = or :, may carry a tag; all others are outside by
constraint, so a text's best path falls apart at them into short runs. The runs of a batch of texts
are decoded together by Viterbi in numpy, which gives the same path as one pass
over each whole text.

A text stays within its task; nothing is shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

KINDS = ["email", "ip", "card", "phone"]
#: Kinds that the CRF adds; "known" is what the patterns find anyway.
ADDED = ["account", "local_phone", "national_id", "secret"]
TAGGED = [*ADDED, "known"]
TAGS = ["O", *[f"{p}-{k}" for k in TAGGED for p in "BI"]]

#: The patterns of the base (fixed values).
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield start, m.end()
            done = m.end()
        # A run before a later @ cannot reach over this one.
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", *s) for s in _emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 8 <= sum(c in "0123456789" for c in m[0]) <= 15:
                    out.append(("phone", *m.span()))
    return out


# --- words and features -------------------------------------------------------

_MARKED = re.compile(r"[0-9@]")
#: Scripts written without spaces, with their punctuation (fixed values).
_WIDE = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3000-\u9fff\uac00-\ud7af\uf900-\ufaff\uff00-\uffef\U00020000-\U0003ffff"
_GAP = r"\x20\x09-\x0D=:/&?,;\"'`()\[\]{}<>"
#: A word; group 1 is one with a digit or an @.
_TOKEN = re.compile(rf"([^{_GAP}{_WIDE}0-9@]*+[0-9@][^{_GAP}{_WIDE}]*+)|[{_WIDE}]++|[^{_GAP}{_WIDE}]++")
_PARTS = re.compile(r"(?<![^_.-])[A-Za-z]{2,12}(?![^_.-])")
_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
QUOTES = "\"'`"
#: Words whose identity counts (fixed values).
CUES = frozenset("token key password passwd pwd secret api = : tel phone fax call mobile ssn iban account konto id version page chapter year".split())
#: Where a name of secrets ends and its value begins.
_NAMED = re.compile(r"(?i)(?<![a-z])(?:token|key|password|passwd|pwd|secret)[\"'`]?\s*[=:]\s*[\"'`]?(?=[^\s=:\"'`])")


def _runs(core: str) -> str:
    out = []
    for c in core:
        s = "9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c
        if not out or out[-1] != s:
            out.append(s)
    return "".join(out)


def _near(word: str | None) -> str:
    if word is None:
        return "edge"
    core = word.strip("\"'.,;()[]!?#*$%&|").lower() or word[:1]
    if core in CUES:
        return core
    if core[-1:] in "=:":
        name = core[:-1].rstrip("\"'`").rsplit("_", 1)[-1].rsplit("-", 1)[-1]
        return name if name in CUES else core[-1]
    return "number" if _MARKED.search(core) else "word"


def features(word: str, lead: str, trail: str, before: str | None, before2: str | None, after: str | None) -> list[str]:
    """lead, trail: the character before and after the word, or nothing."""
    core = word.strip(".!#*$%|")
    digits = sum(c.isdigit() for c in core)
    letters = sum(c.isalpha() for c in core)
    size = len(core)
    return [
        "bias",
        "shape=" + (_runs(core) if size <= 24 else "long"),
        f"digits={min(digits, 12)}",
        f"size={min(size, 40) // 4}",
        f"mixed={digits >= 4 and letters >= 4}",
        f"hex={size >= 16 and bool(_HEX.fullmatch(core))}",
        f"dense={size >= 20 and digits >= 3 and letters >= 3 and core.isalnum()}",
        f"first={core[:1] if not core[:1].isalnum() else lead if lead in '([{<' else ''}",
        f"quoted={lead in QUOTES and lead != ''}",
        f"at={'@' in core}",
        f"lead={lead if lead in ',:;/' else ''}",
        f"trail={trail if trail in ',:;/' else ''}",
        f"parts={min(3, len(_PARTS.findall(core)))}",
        f"letters={digits == 0}",
        f"cased={digits == 0 and core[1:] != core[1:].lower()}",
        "-1=" + _near(before),
        "-2=" + _near(before2),
        "+1=" + _near(after),
    ]


def runs(text: str) -> list[list[tuple[int, int, list[str]]]]:
    """Neighbouring marked words with their features."""
    named = {m.end() for m in _NAMED.finditer(text)} if "=" in text or ":" in text else ()
    if not named and not _MARKED.search(text):
        return []
    words, marked = [], []
    for m in _TOKEN.finditer(text):
        if m.lastindex or m.start() in named:
            marked.append(len(words))
        words.append(m.span())

    def said(k: int) -> str | None:
        """A word with the = or : that follows it."""
        if not 0 <= k < len(words):
            return None
        start, end = words[k]
        gap = text[end : words[k + 1][0] if k + 1 < len(words) else len(text)]
        return text[start:end] + ("=" if "=" in gap else ":" if ":" in gap else "")

    out: list[list] = []
    last = None
    for k in marked:
        start, end = words[k]
        row = (start, end, features(text[start:end], text[start - 1 : start], text[end : end + 1], said(k - 1), said(k - 2), said(k + 1)))
        if last is not None and k == last + 1:
            out[-1].append(row)
        else:
            out.append([row])
        last = k
    return out


# --- the labelled table and training --------------------------------------------

_FILL = "thon rean der ver lichen que eau osco cion the and of with inge stre hena mente para dans".split()


def labelled_table(rows: int = 720, seed: int = 5) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Texts with labelled spans, made by rule: sentences of filler words around
    one thing each, with plain numbers as counterexamples."""
    rng = np.random.default_rng(seed)

    def pick(xs):
        return xs[int(rng.integers(len(xs)))]

    def number(n):
        return "".join(str(x) for x in rng.integers(0, 10, n))

    def text_of(alphabet, n):
        return "".join(pick(alphabet) for _ in range(n))

    hexes, mixed = "0123456789abcdef", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    makers = [
        ("secret", lambda: pick(["token = ", "key = ", "api key: ", "secret: ", "password = ", "token: ", ""]), lambda: pick(['"{}"', "{}", "'{}'"]).format(text_of(pick([hexes, hexes, mixed]), pick([24, 32, 40, 40, 64])))),
        ("secret", lambda: "", lambda: "sk-" + text_of(mixed, 32)),
        ("secret", lambda: pick(["password = ", "password: ", "passwd=", "pwd: ", "password="]), lambda: pick(["{}", '"{}"', "{}!"]).format(pick([text_of(mixed[10:], int(rng.integers(6, 16))), text_of(mixed[10:36], int(rng.integers(6, 14))), pick(_FILL) + "-" + pick(_FILL) + number(2), "-".join(pick(_FILL) for _ in range(int(rng.integers(2, 5))))]))),
        ("secret", lambda: pick(["secret=", "token: ", "api_key="]), lambda: text_of(mixed[10:], int(rng.integers(18, 40)))),
        ("secret", lambda: f"https://{pick(_FILL)}.example.com/{pick(_FILL)}/", lambda: text_of(pick([hexes, mixed]), 40)),
        ("local_phone", lambda: pick(["tel ", "phone: ", "call ", "", ""]), lambda: pick([f"({number(3)}) {number(3)}-{number(4)}", f"{number(3)}-{number(3)}-{number(4)}", f"0{number(3)}/{number(7)}"])),
        ("national_id", lambda: pick(["ssn ", "", "id "]), lambda: f"{number(3)}-{number(2)}-{number(4)}"),
        ("account", lambda: pick(["iban ", "account ", ""]), lambda: pick(["DE", "FR", "ES"]) + number(2) + " " + " ".join(number(4) for _ in range(4)) + pick(["", " " + number(2)])),
        ("known", lambda: "", lambda: f"{pick(_FILL)}.{number(2)}@mail{number(1)}.example.com"),
        ("known", lambda: "", lambda: ".".join(str(x) for x in rng.integers(1, 256, 4))),
        ("known", lambda: "", lambda: pick(["+1 ({}) {}-{}", "+49 {} {} {}"]).format(number(3), number(3), number(4))),
        ("known", lambda: "", lambda: number(16)),
    ]
    plain = [
        lambda: str(rng.integers(1, 3000)), lambda: f"{number(1)}.{number(1)}", lambda: f"version {number(1)}", lambda: f"{rng.integers(1900, 2030)}", lambda: f"{number(2)}:{number(2)}",
        lambda: f"{number(4)}-{number(2)}-{number(2)}", lambda: f"{number(2)}/{number(2)}/{number(4)}", lambda: f"${number(3)},{number(3)}", lambda: f"{number(2)}%", lambda: f"page {number(3)}", lambda: f"{number(1)}th", lambda: number(6),
        lambda: f"BY-SA {number(1)}.0", lambda: f"{number(3)} {number(3)}", lambda: f"x{number(2)}", lambda: f"covid-{number(2)}", lambda: f"{number(1)}-{number(1)}", lambda: f"@{pick(_FILL)}", lambda: f"{number(9)}", lambda: f"{number(2)},{number(3)},{number(3)}",
        lambda: f"https://www.{pick(_FILL)}.org/{rng.integers(1990, 2030)}/{number(2)}/{pick(_FILL)}-{pick(_FILL)}-{number(5)}.html", lambda: f"http://{pick(_FILL)}{number(1)}.net/{pick(_FILL)}?{pick(_FILL)}={number(3)}&page={number(2)}", lambda: f"{pick(_FILL)}/{pick(_FILL)}_{number(2)}/v{number(1)}.{number(1)}",
        lambda: f"key: {pick(_FILL)}", lambda: f"the secret: {pick(_FILL)} {number(1)}", lambda: f"Key: {pick(_FILL).title()}", lambda: f"token: {pick(_FILL)}", lambda: f"https://{pick(_FILL)}.com/{number(8)}", lambda: f"{pick(_FILL)}-{number(4)}-{pick(_FILL)}", lambda: "-".join(pick(_FILL) for _ in range(int(rng.integers(2, 8)))) + f"-{number(5)}.html",
    ]
    ends = ["", "", ".", ",", "###", "!!", "&&&", ";", " | "]
    out = []
    for k in range(rows):
        text, spans = " ".join(pick(_FILL) for _ in range(int(rng.integers(1, 4)))) + " ", []
        if k % 2:
            kind, lead, make = makers[k // 2 % len(makers)]
            cue, thing = lead(), make()
            text += cue
            spans.append((len(text), len(text) + len(thing), kind))
            text += thing
        else:
            text += plain[k // 2 % len(plain)]()
        text += pick(ends)
        out.append((text + " " + " ".join(pick(_FILL) for _ in range(int(rng.integers(1, 4)))), spans))
    return out


class Crf:
    def __init__(self, index: dict[str, int], emit: np.ndarray, move: np.ndarray):
        self.index, self.emit, self.move = index, emit, move

    def scores(self, rows: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(rows), len(TAGS)))
        for k, names in enumerate(rows):
            ids = [i for n in names if (i := self.index.get(n)) is not None]
            out[k] = self.emit[ids].sum(axis=0)
        return out

    def decode(self, found: list[list[list[str]]]) -> list[np.ndarray]:
        """Best tags of each run; a run stands between words that are outside."""
        if not found:
            return []
        lengths = np.array([len(r) for r in found])
        order = np.argsort(-lengths, kind="stable")
        flat = self.scores([w for r in found for w in r])
        first = np.concatenate([[0], np.cumsum(lengths)[:-1]])[order]
        sizes = lengths[order]
        best = self.move[0] + flat[first]
        back: list[np.ndarray] = []
        final = np.zeros(len(sizes), np.int64)
        for t in range(1, int(sizes[0]) + 1):
            n = int((sizes > t - 1).sum())
            more = int((sizes > t).sum())
            if more < n:  # these end here, before an outside word
                final[more:n] = (best[more:n] + self.move[:, 0]).argmax(axis=1)
            if not more:
                break
            step = best[:more, :, None] + self.move[None]
            back.append(step.argmax(axis=1))
            best = step.max(axis=1) + flat[first[:more] + t]
        tags = [np.zeros(s, np.int64) for s in sizes]
        for k in range(len(sizes)):
            tags[k][-1] = final[k]
            for t in range(int(sizes[k]) - 1, 0, -1):
                tags[k][t - 1] = back[t - 1][k, tags[k][t]]
        out: list = [None] * len(found)
        for k, o in enumerate(order):
            out[o] = tags[k]
        return out


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


@cache
def trained(steps: int = 150, rate: float = 0.15, decay: float = 1e-3) -> Crf:
    """Maximum likelihood with a Gaussian prior: exact gradients by forward and
    backward sums, Adam steps; the same model each time."""
    names, tags = [], []
    for text, spans in labelled_table():
        for run in runs(text):
            names.append([w[2] for w in run])
            row = []
            for start, end, _ in run:
                hit = next((s for s in spans if s[0] < end and start < s[1]), None)
                row.append("O" if hit is None else ("B-" if start <= hit[0] or not row or row[-1] == "O" else "I-") + hit[2])
            tags.append([TAGS.index(t) for t in row])
    index: dict[str, int] = {}
    for run in names:
        for w in run:
            for n in w:
                index.setdefault(n, len(index))
    k, (emit, move) = len(TAGS), (np.zeros((len(index), len(TAGS))), np.zeros((len(TAGS), len(TAGS))))
    barred = np.zeros((k, k))
    for j, t in enumerate(TAGS):
        if t[0] == "I":
            for i, s in enumerate(TAGS):
                if s not in (t, "B" + t[1:]):
                    barred[i, j] = -1e4
    moments = [np.zeros_like(x) for x in (emit, emit, move, move)]
    # Runs by falling length, so that those that reach a place are the first ones.
    order = sorted(range(len(names)), key=lambda r: -len(names[r]))
    lengths = np.array([len(names[r]) for r in order])
    first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    words = [[index[n] for n in w] for r in order for w in names[r]]
    sizes = np.array([len(w) for w in words])
    flat, begins = np.concatenate(words), np.concatenate([[0], np.cumsum(sizes)[:-1]])
    gold = np.array([t for r in order for t in tags[r]])
    reach = [int((lengths > t).sum()) for t in range(int(lengths[0]) + 1)]
    for step in range(1, steps + 1):
        full = move + barred
        e = np.add.reduceat(emit[flat], begins)
        a, b = np.empty_like(e), np.empty_like(e)
        a[first] = full[0] + e[first]
        for t, n in enumerate(reach[1:-1], 1):
            a[first[:n] + t] = _logsum(a[first[:n] + t - 1][:, :, None] + full, 1) + e[first[:n] + t]
        b[first + lengths - 1] = full[:, 0]
        for t, n in reversed(list(enumerate(reach[1:-1], 1))):
            b[first[:n] + t - 1] = _logsum(full + (e + b)[first[:n] + t][:, None, :], 2)
        z = _logsum(a[first] + b[first], 1)
        p = -np.exp(a + b - np.repeat(z, lengths)[:, None])
        p[np.arange(len(gold)), gold] += 1
        de, dm = -decay * emit, -decay * move
        np.add.at(de, flat, np.repeat(p, sizes, axis=0))
        for t, n in enumerate(reach[1:-1], 1):
            at = first[:n] + t
            dm -= np.exp(a[at - 1][:, :, None] + full + (e + b)[at][:, None, :] - z[:n, None, None]).sum(axis=0)
            np.add.at(dm, (gold[at - 1], gold[at]), 1)
        dm[0] -= np.exp(a[first] + b[first] - z[:, None]).sum(axis=0)
        np.add.at(dm[0], gold[first], 1)
        ends = first + lengths - 1
        dm[:, 0] -= np.exp(a[ends] + b[ends] - z[:, None]).sum(axis=0)
        np.add.at(dm[:, 0], gold[ends], 1)
        for x, g, m, v in ((emit, de, *moments[:2]), (move, dm, *moments[2:])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Crf(index, emit, move + barred)


# --- spans ------------------------------------------------------------------------


def _trim(text: str, start: int, end: int, kind: str) -> tuple[int, int]:
    if kind == "local_phone" and text[start - 1 : start] == "(":
        start -= 1
    while start < end and not (text[start].isalnum() or text[start] == "(" and kind == "local_phone"):
        start += 1
    while end > start and not text[end - 1].isalnum():
        end -= 1
    return start, end


def _quoted(text: str, start: int, end: int) -> int:
    """Where the value ends that begins in a quote right after a name of secrets: at the
    quote's end, if the line has one; whatever stands between belongs to it."""
    quote = text[start - 1 : start]
    if quote and quote in QUOTES and text[:start - 1].rstrip()[-1:] in ("=", ":"):
        line = text.find("\n", start)
        close = text.find(quote, start, line if line >= 0 else len(text))
        return max(end, close)
    return end


def find(texts: list[str], crf: Crf) -> list[list[tuple[str, int, int]]]:
    """All spans of each text, by kind as listed, then start: the base ones first."""
    found = [runs(t) for t in texts]
    decoded = iter(crf.decode([[w[2] for w in r] for rs in found for r in rs]))
    out = []
    for text, rs in zip(texts, found, strict=True):
        base = base_spans(text)
        added = []
        for r in rs:
            tags, at = next(decoded), 0
            while at < len(r):
                tag = TAGS[tags[at]]
                upto = at + 1
                while upto < len(r) and TAGS[tags[upto]] == "I" + tag[1:] and tag != "O":
                    upto += 1
                if tag[2:] in ADDED:
                    start, end = _trim(text, r[at][0], r[upto - 1][1], tag[2:])
                    if tag[2:] == "secret" and start == r[at][0] and end > start:
                        end = _quoted(text, start, end)
                    if end > start and not any(s < end and start < e for _, s, e in [*base, *added[-1:]]):
                        added.append((tag[2:], start, end))
                at = upto
        rank = {k: i for i, k in enumerate([*KINDS, *ADDED])}
        out.append(sorted(base, key=lambda s: (rank[s[0]], s[1])) + sorted(added, key=lambda s: (rank[s[0]], s[1])))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def detected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, spans: an array of (kind, start, end) in code points, for every row.

    A null or empty text has no spans; a text or word of any length is read whole; repeated
    rows are searched each; an empty table gives an empty result; no other column is read."""
    small_batches(docs.sparkSession)
    crf, kind = trained(), dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            spans = find([t or "" for t in b["text"]], crf)
            yield pd.DataFrame({"id": b["id"], "spans": [[{"kind": k, "start": s, "end": e} for k, s, e in x] for x in spans]})

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, f"id {kind}, spans array<struct<kind:string,start:long,end:long>>").withColumnRenamed("id", id_col)


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or union of overlapping ones, replaced by its kind."""
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def redacted(docs: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """docs with the spans masked; the length column, if there is one, follows. Null, empty
    and very long texts, repeated rows and empty tables: as in detected(); all columns stay."""
    small_batches(docs.sparkSession)
    crf = trained()
    count = chars_col if chars_col in docs.columns else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            spans = find([t or "" for t in b[text_col]], crf)
            yield b.assign(**{text_col: [t if not s else masked(t, s) for t, s in zip(b[text_col], spans, strict=True)]})

    out = docs.mapInPandas(run, docs.schema)
    return out.withColumn(count, F.coalesce(F.length(text_col), F.lit(0)).cast(dict(docs.dtypes)[count])) if count else out
