"""ZIP archives: entry tables, path rules and deterministic output."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import ranges

ENTRY = "doc string, ord int, name string, size long, packed long, encrypted boolean, link boolean, error string"


def entries(archives: DataFrame, doc: str = "path", content: str = "content") -> DataFrame:
    """A row for each entry of each archive, from the directory alone; an archive that
    cannot be read is one row with an error."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for d, c in zip(b["doc"], b["content"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(c)) as z:
                        for i, e in enumerate(z.infolist()):
                            out.append((d, i, e.filename, e.file_size, e.compress_size, bool(e.flag_bits & 1), (e.external_attr >> 16) & 0o170000 == 0o120000, None))
                except (zipfile.BadZipFile, ValueError, OSError, TypeError) as failure:
                    out.append((d, 0, None, 0, 0, False, False, type(failure).__name__))
            yield pd.DataFrame(out, columns=[x.split()[0] for x in ENTRY.split(", ")])

    return archives.select(F.col(doc).alias("doc"), F.col(content).alias("content")).mapInPandas(run, ENTRY)


def unsafe_name(name: Column) -> Column:
    return name.rlike(r"\A/|\\|:|(\A|/)\.\.?(/|\z)|//|[\x00-\x1f\x7f]") | (name == "")


def checked(table: DataFrame, most_files: int = 500, most_bytes: int = 100 << 20) -> DataFrame:
    """doc and the first failed rule (or null): unreadable, unsafe names, links, encryption,
    names that differ by case only, too many files, too many unpacked bytes."""
    n = F.count("*").over(Window.partitionBy("doc", F.lower("name")))
    marked = table.withColumn("_n", n)
    flag = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    g = marked.groupBy("doc").agg(flag(F.col("error").isNotNull()).alias("bad"), flag(unsafe_name(F.col("name"))).alias("path"), flag(F.col("link")).alias("link"), flag(F.col("encrypted")).alias("enc"), flag(F.col("_n") > 1).alias("twice"), F.count("*").alias("files"), F.sum("size").alias("bytes"))
    return g.select("doc", F.when(F.col("bad"), "INVALID_ARCHIVE").when(F.col("path"), "UNSAFE_PATH").when(F.col("link"), "LINK").when(F.col("enc"), "ENCRYPTED").when(F.col("twice"), "DUPLICATE_NAME").when((F.col("files") > most_files) | (F.col("bytes") > most_bytes), "INPUT_LIMIT_EXCEEDED").alias("error"))


def root_document(table: DataFrame) -> DataFrame:
    """doc and its entry: document.md at the root, else the only Markdown file there."""
    md = table.where(F.lower("name").rlike(r"\A[^/]+\.(md|markdown)\z"))
    g = md.groupBy("doc").agg(F.max(F.when(F.col("name") == "document.md", F.col("name"))).alias("named"), F.count("*").alias("n"), F.min("name").alias("only"))
    return g.select("doc", F.coalesce("named", F.when(F.col("n") == 1, F.col("only"))).alias("entry"))


def html_entry(table: DataFrame) -> DataFrame:
    """doc, entry and error: index.html or index.htm at the root, but not both."""
    at = lambda n: F.coalesce(F.bool_or(F.col("name") == n), F.lit(False))
    g = table.groupBy("doc").agg(at("index.html").alias("html"), at("index.htm").alias("htm"))
    error = F.when(F.col("html") & F.col("htm"), "AMBIGUOUS_ENTRYPOINT").when(~F.col("html") & ~F.col("htm"), "HTML_ENTRYPOINT_NOT_FOUND")
    return g.select("doc", F.when(error.isNull(), F.when(F.col("html"), "index.html").otherwise("index.htm")).alias("entry"), error.alias("error"))


def zipped(files: DataFrame, by: str, most_bytes: int = 300 << 20) -> DataFrame:
    """files: by, seq, name, content. One archive for each document: entries in order, all
    with the same time, so equal files give equal bytes. Null beyond the limit: only files
    of documents within it are collected, each document's in one task."""
    kind = dict(files.dtypes)[by]
    totals = files.groupBy(by).agg(F.sum(F.length("content")).alias("_bytes"))
    fits = totals.where(F.coalesce("_bytes", F.lit(0)) <= most_bytes).select(F.col(by).alias("_fit"))
    held = files.join(fits, F.col(by).eqNullSafe(F.col("_fit")), "left_semi")

    def run(key: tuple[Any, ...], b: pd.DataFrame) -> pd.DataFrame:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for name, content in b.sort_values("seq")[["name", "content"]].itertuples(index=False):
                z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), content, zipfile.ZIP_DEFLATED)
        return pd.DataFrame({"k": [key[0]], "archive": [out.getvalue()]})

    done = held.select(by, "seq", "name", "content").groupBy(by).applyInPandas(run, f"k {kind}, archive binary")
    return totals.join(done, F.col(by).eqNullSafe(F.col("k")), "left").select(by, "archive")


def zipped_parts(files: DataFrame, by: str, part_bytes: int = 64 << 20) -> DataFrame:
    """files: by, seq (unique within by), name, content. by, part (from 0) and archive: the files of each group in
    order, a new archive once part_bytes have begun, so a group of any size is packed by as many
    tasks as it needs; a part holds part_bytes and one file at most."""
    slim = files.select(by, "seq", F.length("content").cast("long").alias("_size"))
    starts = ranges.prefix_offsets(slim, [by], "seq", "_size").select(F.col(by).alias("_by"), F.col("seq").alias("_seq"), F.expr(f"start div {part_bytes}").alias("part"))
    keyed = files.join(starts, F.col(by).eqNullSafe(F.col("_by")) & (F.col("seq") == F.col("_seq"))).drop("_by", "_seq")
    keyed = keyed.withColumn("_key", F.to_json(F.struct(F.col("part"), F.col(by).alias("by"))))
    names = keyed.select("_key", by, "part").distinct()
    return names.join(zipped(keyed, "_key"), "_key").select(by, "part", "archive")
