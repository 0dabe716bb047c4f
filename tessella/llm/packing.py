"""Packing token streams into windows by the sum-of-squares rule.

A document's ids, closed by one end id, are cut into full windows and a remainder.
Remainders are placed online, in the order in which a task reads them: an item of size s
goes to the fill level h that minimises the sum of squared counts of partially filled
windows, where N[h] windows have the fill h. The change is local (level h loses a window,
level h + s gains one), so it is read off the level array.

A packer lives within a task, next to the texts: nothing is shuffled, and it holds the
ids of its open windows only. At a task's end the emptiest open windows are dealt out,
cut where needed, to the fullest ones, so a task pads one window at most.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

WINDOW = 2048
END_ID = 1
TOKENIZER = "word_bpe_49k.json"

CACHED = 500_000  # words and units that a worker remembers, about 170 bytes each
_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_PLAIN = re.compile("[!-~\u00c0-\u024f]+")
#: The vocabulary's own splitting pattern (fixed value).
_UNITS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|[^\s\w]+|_+")


class Words(dict):
    """Ids, as bytes, of the words and units seen: the vocabulary splits at white space, so
    a word's ids do not depend on its neighbours, and a unit's are those of the word that it
    would be. Words of Latin letters go straight to the vocabulary's model, all others
    through the whole tokenizer."""

    def __init__(self, path: str | None):
        assert array("I").itemsize == 4 and sys.byteorder == "little"
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(TOKENIZER)
        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        # Byte-level letters: printable bytes stand for themselves, others follow from 256 on.
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = (b for b in range(256) if b not in set(kept))
        self.letters = {b: chr(b) for b in kept} | {b: chr(256 + n) for n, b in enumerate(rest)}

    def unit(self, u: str) -> bytes:
        mapped = u if u.isascii() else "".join(map(self.letters.__getitem__, u.encode()))
        return array("I", [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def __missing__(self, word: str) -> bytes:
        if len(word) > 64 or not _PLAIN.fullmatch(word) or "_" in word or "<|" in word:
            return self.full(word)
        found = _UNITS.findall(word.lower())
        if len(self) >= CACHED:
            self.clear()
        out = self[word] = self.unit(word) if found == [word] else b"".join(map(self.__getitem__, found))
        return out

    def full(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        if _ODD_SPACE.search(text):
            return self.full(text)
        return b"".join(map(self.__getitem__, text.split()))


_loaded: dict[str | None, Words] = {}


def encoded(texts: list[str], path: str | None) -> Iterator[bytes]:
    """Little-endian 32-bit ids of each text, with the end id. path: a vocabulary
    file that splits at white space, or none for the public one that every
    executor has installed."""
    known = _loaded.get(path) or _loaded.setdefault(path, Words(path))
    end = np.array([END_ID], "<u4").tobytes()
    for t in texts:
        yield known.ids(t) + end


class Packer:
    """Open windows by fill level, and the rule that chooses among them."""

    def __init__(self, window: int = WINDOW):
        self.window, self.made = window, 0
        self.count = np.zeros(window + 1, np.int64)  # open windows at each level; 0 and window stay 0
        self.stacks: list[list[int]] = [[] for _ in range(window + 1)]

    def fresh(self) -> int:
        self.made += 1
        return self.made - 1

    def level(self, s: int) -> int:
        """The level whose choice for an item of size s < window leaves the least sum of
        squares, the fullest of equals; level 0 is a new window."""
        most = self.window - s
        left, reached = self.count[: most + 1], self.count[s:]
        change = 2 * (reached - left) + 2
        change[0] = 2 * reached[0] + 1
        change[most] = 1 - 2 * left[most]  # a full window leaves the sum
        allowed = left > 0
        allowed[0] = True
        found = np.flatnonzero(allowed)
        return int(found[len(found) - 1 - change[found][::-1].argmin()])

    def place(self, s: int) -> tuple[int, int]:
        """Number of the window that takes an item, and the offset there."""
        if s == self.window:
            return self.fresh(), 0
        h = self.level(s)
        if h:
            self.count[h] -= 1
            number = self.stacks[h].pop()
        else:
            number = self.fresh()
        if h + s < self.window:
            self.count[h + s] += 1
            self.stacks[h + s].append(number)
        return number, h


Piece = tuple  # id, start, ids (bytes), tokens of the document


def closed(held: dict[int, list[Piece]], window: int) -> dict[int, list[Piece]]:
    """Open windows after the emptiest have been dealt out, cut where needed, to the
    fullest: all of them but one at most are full."""
    fill = {w: sum(len(p[2]) for p in ps) // 4 for w, ps in held.items()}
    order = sorted(held, key=lambda w: (-fill[w], w))
    out = {w: list(held[w]) for w in order}
    at, last = 0, len(order) - 1
    while at < last:
        into, source = order[at], order[last]
        i, start, ids, tokens = out[source].pop()
        room = window - fill[into]
        take = min(room, len(ids) // 4)
        out[into].append((i, start, ids[: 4 * take], tokens))
        fill[into] += take
        fill[source] -= take
        if 4 * take < len(ids):
            out[source].append((i, start + take, ids[4 * take :], tokens))
        if not out[source]:
            del out[source]
            last -= 1
        if fill[into] == window:
            at += 1
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, tokenizer_path: str | None = None, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece of
    every row, and with with_ids its ids. A sequence's ids lie gapless from 0; sequence ids
    are unique; a task leaves one sequence at most shorter than the window.

    A null or empty text is the end id alone; repeated rows are documents each; a text of
    any length is cut at full windows; a null id is an id like any other. An empty table
    gives an empty result; other columns are not read."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"))
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        base = TaskContext.get().partitionId() << 32
        packer, held, out = Packer(window), {}, []

        def tell(number: int, pieces: list[Piece]) -> None:
            at = 0
            for i, start, ids, tokens in pieces:
                size = len(ids) // 4
                out.append((i, start, size, zlib.crc32(ids), tokens, base + number, at, *([ids] if with_ids else [])))
                at += size

        for b in batches:
            for i, ids in zip(b["id"], encoded([t or "" for t in b["text"]], tokenizer_path), strict=True):
                for at in range(0, len(ids), 4 * window):
                    part = ids[at : at + 4 * window]
                    number, offset = packer.place(len(part) // 4)
                    held.setdefault(number, []).append((i, at // 4, part, len(ids) // 4))
                    if offset + len(part) // 4 == window:
                        tell(number, held.pop(number))
            yield pd.DataFrame(out, columns=names)
            out.clear()
        for number, pieces in closed(held, window).items():
            tell(number, pieces)
        yield pd.DataFrame(out, columns=names)

    out = rows.mapInPandas(run, "id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids)
    return out.withColumn("id", F.col("id").cast(dict(docs.dtypes)[id_col])).withColumnRenamed("id", id_col)
