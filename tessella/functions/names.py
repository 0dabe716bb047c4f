"""Names, numbers and references (Column -> Column)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

ROMAN = [(1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]


def roman(n: Column) -> Column:
    """Roman numerals of 1..3999, digits otherwise."""
    parts = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(s).alias("s")) for v, s in ROMAN])

    def step(acc: Column, p: Column) -> Column:
        k = F.floor(acc["left"] / p["v"]).cast("int")
        return F.struct((acc["left"] - k * p["v"]).alias("left"), F.concat(acc["out"], F.repeat(p["s"], k)).alias("out"))

    start = F.struct(n.cast("int").alias("left"), F.lit("").alias("out"))
    return F.when(n.between(1, 3999), F.aggregate(parts, start, step, lambda a: a["out"])).otherwise(n.cast("string"))


def letters(n: Column) -> Column:
    """a..z, aa..zz, and so on: a letter repeated for each turn of the alphabet."""
    return F.repeat(F.char(F.lit(97) + F.pmod(n - 1, F.lit(26))), (F.floor((n - 1) / 26) + 1).cast("int"))


def column_name(index: Column) -> Column:
    """A, B, .. Z, AA for 0-based columns, up to XFD."""
    a = F.lit(65)
    one, two = index, index - 26
    three = index - 702
    return (
        F.when(index < 26, F.char(a + one))
        .when(index < 702, F.concat(F.char(a + F.floor(two / 26)), F.char(a + F.pmod(two, F.lit(26)))))
        .otherwise(F.concat(F.char(a + F.floor(three / 676)), F.char(a + F.pmod(F.floor(three / 26), F.lit(26))), F.char(a + F.pmod(three, F.lit(26)))))
    )


def a1(r1: Column, r2: Column, c1: Column, c2: Column) -> Column:
    """A1 or A1:B2 of a 0-based rectangle."""
    first, last = F.concat(column_name(c1), (r1 + 1).cast("string")), F.concat(column_name(c2), (r2 + 1).cast("string"))
    return F.when((r1 == r2) & (c1 == c2), first).otherwise(F.concat(first, F.lit(":"), last))


def rectangle(ref: Column) -> Column:
    """(r1, r2, c1, c2) of a finite A1 rectangle, null if it is none."""
    m = r"\A\$?([A-Z]{1,3})\$?([1-9][0-9]{0,6})(?::\$?([A-Z]{1,3})\$?([1-9][0-9]{0,6}))?\z"

    def col(name: Column) -> Column:
        return F.aggregate(F.filter(F.split(name, ""), lambda c: c != ""), F.lit(0), lambda acc, c: acc * 26 + F.ascii(c) - 64) - 1

    part = [F.regexp_extract(ref, m, i) for i in (1, 2, 3, 4)]
    c2, r2 = F.when(part[2] == "", part[0]).otherwise(part[2]), F.when(part[3] == "", part[1]).otherwise(part[3])
    rows = [F.try_to_number(x, F.lit("9999999")).cast("int") - 1 for x in (part[1], r2)]
    cols = [col(part[0]), col(c2)]
    out = F.struct(F.least(*rows).alias("r1"), F.greatest(*rows).alias("r2"), F.least(*cols).alias("c1"), F.greatest(*cols).alias("c2"))
    return F.when(ref.rlike(m), out)


def safe_filename(name: Column) -> Column:
    """Path stripped, controls replaced, 255 characters at most."""
    return F.substring(F.regexp_replace(F.regexp_replace(name, r".*[/\\]", ""), r"[\x00-\x1f\x7f]", "_"), 1, 255)


def safe_basename(name: Column) -> Column:
    """Extension stripped, other characters than letters, digits, _ and - replaced."""
    stem = F.regexp_replace(safe_filename(name), r"\.[^.]*\z", "")
    return F.substring(F.regexp_replace(stem, r"[^A-Za-z0-9_-]", "_"), 1, 100)


def page_name(n: Column, fmt: str = "png", style: str = "padded") -> Column:
    """page-0001.png, page-1.png or pages/page-001.png."""
    text = {"padded": "page-%04d.", "number": "page-%d.", "folder": "pages/page-%03d."}[style]
    return F.format_string(text + fmt, n)


def rotation_text(degrees: Column) -> Column:
    """Clockwise rotation, three decimals at most, within a turn; null for none."""
    x = F.round(F.pmod(degrees, F.lit(360.0)), 3).cast("decimal(20,3)")
    text = F.regexp_replace(F.regexp_replace(x.cast("string"), r"0+\z", ""), r"\.\z", "")
    return F.when(x % 360 != 0, F.concat(F.lit("時計回り"), text, F.lit("度")))


def resolved(base: Column, ref: Column) -> Column:
    """A local reference against the folder of its document, or null where it leaves the
    root, is absolute, has a scheme, or holds a backslash or a control."""
    path = F.regexp_replace(ref, r"[?#].*\z", "")
    folder = F.regexp_replace(base, r"[^/]*\z", "")
    parts = F.filter(F.split(F.concat(folder, path), "/"), lambda p: (p != "") & (p != "."))

    def step(acc: Column, p: Column) -> Column:
        up = F.when(F.size(acc["at"]) > 0, F.slice(acc["at"], F.lit(1), F.size(acc["at"]) - 1)).otherwise(acc["at"])
        return F.struct(F.when(p == "..", up).otherwise(F.concat(acc["at"], F.array(p))).alias("at"), (acc["out"] | ((p == "..") & (F.size(acc["at"]) == 0))).alias("out"))

    start = F.struct(F.array().cast("array<string>").alias("at"), F.lit(False).alias("out"))
    end = F.aggregate(parts, start, step)
    bad = path.rlike(r"\A/|\A[a-zA-Z][a-zA-Z0-9+.-]*:|\\|[\x00-\x1f\x7f]") | (path == "")
    return F.when(~bad & ~end["out"], F.array_join(end["at"], "/"))


def hyperlink(formula: Column) -> Column:
    """(address, label) of a literal HYPERLINK formula; a label that is no literal is
    null, and anything after the call makes it none."""
    m = r'(?is)\A\s*HYPERLINK\(\s*"((?:[^"]|"")*)"\s*(?:,\s*(?:"((?:[^"]|"")*)"|([^()"]*(?:\([^()"]*\)[^()"]*)*))\s*)?\)\s*\z'
    part = lambda i: F.replace(F.regexp_extract(formula, m, i), F.lit('""'), F.lit('"'))
    return F.when(formula.rlike(m), F.struct(part(1).alias("address"), F.when(part(2) != "", part(2)).alias("label")))


def json_alt(value: Column) -> Column:
    """JSON text whose Markdown characters are written as \\uXXXX."""
    out = value
    for c in "[]`*_<>|!":
        out = F.replace(out, F.lit(c), F.lit(f"\\u{ord(c):04x}"))
    return out


#: Leading bytes of the image formats that may stand in a data: address (fixed values).
IMAGE_BYTES = {"png": "89504E470D0A1A0A", "jpeg": "FFD8FF", "jpg": "FFD8FF", "gif": "47494638", "bmp": "424D"}


def data_image(uri: Column, most_bytes: int) -> Column:
    """kind, size and error of an image in a data: address: its kind is known, its text is
    base64, its bytes begin as the kind does and are within the limit."""
    kind = F.lower(F.regexp_extract(uri, r"(?i)\Adata:image/(png|jpeg|jpg|gif|bmp);base64,", 1))
    text = F.regexp_replace(F.regexp_extract(uri, r"(?s)\A[^,]*,(.*)\z", 1), r"\s", "")
    raw = F.try_to_binary(text, F.lit("base64"))
    head = F.hex(F.substring(raw, 1, 8))
    known = F.lit(False)
    for name, first in IMAGE_BYTES.items():
        known = known | ((kind == name) & head.startswith(first))
    size = F.length(raw)
    error = F.when(kind == "", "UNSUPPORTED_IMAGE").when(raw.isNull() | (size == 0), "INVALID_BASE64").when(size > most_bytes, "IMAGE_BYTES_LIMIT").when(~known, "CONTENT_MISMATCH")
    return F.struct(F.when(error.isNull(), kind).alias("kind"), F.when(error.isNull(), size).alias("size"), error.alias("error"))
