"""Predicates over file bytes and names: nothing is parsed here (Column -> Column)."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OFFICE = ("xlsx", "xls", "docx", "pptx")
#: Leading bytes (fixed values).
OOXML, OLE2 = "504B0304", "D0CF11E0A1B11AE1"


def files(spark: SparkSession, path: str) -> DataFrame:
    """path, length, content of the files below a folder, by Spark's own reader."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^./\\]+)\z", 1))


def is_office(name: Column, content: Column) -> Column:
    magic = F.hex(F.substring(content, 1, 8))
    return extension(name).isin(*OFFICE) & (magic.startswith(OOXML) | (magic == OLE2))


def is_pdf(content: Column) -> Column:
    """%PDF- begins within the first 1024 bytes."""
    head = F.decode(F.substring(content, 1, 1028), "ISO-8859-1")
    return F.locate("%PDF-", head).between(1, 1024)


def markdown_text(content: Column) -> Column:
    """Strict UTF-8 without its mark, null for other bytes or control characters."""
    text = F.try_validate_utf8(content.cast("string"))
    text = F.regexp_replace(text, "\\A\ufeff", "")
    return F.when(~text.rlike(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"), text)


def is_old_slides(content: Column) -> Column:
    """An OLE2 file with the entry of a slide show."""
    entry = "PowerPoint Document".encode("utf-16-le")
    return (F.hex(F.substring(content, 1, 8)) == OLE2) & F.contains(content, F.lit(entry))
