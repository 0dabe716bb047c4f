"""Queries of drawings, colours, pages, styles, settings and open-topped tables, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import drawing, styles, urls
from ..operators import graph, grid, numbering, pages, settings
from .catalog import CELLS, MERGES, cells, merges, query, t

PRESETS = [*drawing.TYPE_NAMES, "noSuch_Shape", ""]
_VALUES = ", ".join(f"('{k}', '{v}')" for k, v in drawing.TYPE_NAMES.items())


@query(
    f"""WITH names(k, v) AS (VALUES {_VALUES}), p AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN upper(q) WHEN p_partkey % 3 = 1 THEN substr(q, 1, 3) || '_' || substr(q, 4) ELSE q END AS preset
  FROM (SELECT p_partkey, [{", ".join(f"'{x}'" for x in PRESETS)}][p_partkey % {len(PRESETS)} + 1] AS q FROM part))
  SELECT p_partkey, preset, CASE WHEN replace(preset, '_', '') = '' THEN '図形（種類不明）' ELSE coalesce(v, '図形（' || preset || '）') END AS name FROM p LEFT JOIN names ON k = lower(replace(preset, '_', ''))"""
)
def shape_types(spark, sf_dir):
    """Names of preset shapes, whatever the case and separators of the preset."""
    q = F.element_at(F.array(*[F.lit(x) for x in PRESETS]), F.expr(f"cast(p_partkey % {len(PRESETS)} + 1 as int)"))
    preset = F.when(F.expr("p_partkey % 3 = 0"), F.upper(q)).when(F.expr("p_partkey % 3 = 1"), F.concat(F.substring(q, 1, 3), F.lit("_"), F.substr(q, F.lit(4)))).otherwise(q)
    return t(spark, sf_dir, "part").select("p_partkey", preset.alias("preset")).withColumn("name", drawing.type_name(F.col("preset")))


@query(
    """WITH b AS (SELECT l_orderkey, l_linenumber, (l_orderkey % 1000 - 300) / 8.0 AS x, l_linenumber / 4.0 AS y, CASE WHEN l_orderkey % 13 = 0 THEN -1.0 ELSE (l_orderkey % 77) / 16.0 END AS w, CASE WHEN l_orderkey % 17 <> 0 THEN 12.5 END AS h, CASE l_orderkey % 3 WHEN 0 THEN '  ' WHEN 1 THEN 'Sheet  1' END AS ref FROM lineitem),
  s AS (SELECT *, list_transform([x, y, w, h], lambda v: regexp_replace(regexp_replace(CAST(CAST(v AS DECIMAL(24, 3)) AS VARCHAR), '0+$', ''), '\\.$', '') || 'pt') AS p FROM b)
  SELECT l_orderkey, l_linenumber, CASE WHEN coalesce(trim(ref), '') = '' THEN '基準不明' ELSE '基準=Sheet 1' END || CASE WHEN w >= 0 AND h IS NOT NULL THEN '、外接矩形 X=' || p[1] || '、Y=' || p[2] || '、幅=' || p[3] || '、高さ=' || p[4] ELSE '、位置・サイズ不明' END AS geometry FROM s"""
)
def geometry_texts(spark, sf_dir):
    """Reference and bounding box of a drawing in points, or that they are unknown."""
    e = lambda x: F.expr(f"cast({x} as double)")
    ref = F.expr("CASE l_orderkey % 3 WHEN 0 THEN '  ' WHEN 1 THEN 'Sheet  1' END")
    w, h = e("if(l_orderkey % 13 = 0, -1.0D, (l_orderkey % 77) / 16.0D)"), e("if(l_orderkey % 17 <> 0, 12.5D, null)")
    text = drawing.geometry_text(ref, e("(l_orderkey % 1000 - 300) / 8.0D"), e("l_linenumber / 4.0D"), w, h)
    return t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.alias("geometry"))


@query(
    """WITH c AS (SELECT event_id, CAST(event_id * 7 % 1400 - 60 AS DOUBLE) AS x, CAST(event_id * 11 % 800 - 40 AS DOUBLE) AS y, event_id % 7 - 3 AS dx, event_id // 7 % 7 - 3 AS dy FROM events)
  SELECT event_id, CASE WHEN x BETWEEN 0 AND 1280 AND y BETWEEN 0 AND 720 THEN CASE WHEN 3 * x < 1280 THEN 'left' WHEN 3 * x < 2560 THEN 'center' ELSE 'right' END || '-' || CASE WHEN y < 240 THEN 'top' WHEN y < 480 THEN 'middle' ELSE 'bottom' END END AS position,
  CASE WHEN dx = 0 AND dy = 0 THEN NULL WHEN abs(dy) <= abs(dx) * (sqrt(2) - 1) THEN CASE WHEN dx > 0 THEN 'right' ELSE 'left' END WHEN abs(dx) <= abs(dy) * (sqrt(2) - 1) THEN CASE WHEN dy > 0 THEN 'bottom' ELSE 'top' END
    ELSE CASE WHEN dx > 0 THEN 'right' ELSE 'left' END || '-' || CASE WHEN dy > 0 THEN 'bottom' ELSE 'top' END END AS toward FROM c"""
)
def slide_positions(spark, sf_dir):
    """The ninth of a slide that holds a shape's centre, and the eighth that an arrow points to."""
    n = lambda x: F.expr(f"cast({x} as double)")
    place = drawing.slide_position(n("event_id * 7 % 1400 - 60"), n("event_id * 11 % 800 - 40"), F.lit(1280.0), F.lit(720.0))
    return t(spark, sf_dir, "events").select("event_id", place.alias("position"), drawing.points_toward(n("event_id % 7 - 3"), n("event_id div 7 % 7 - 3")).alias("toward"))


_KINDS = [*drawing.MODIFIERS, "unknown"]
_KIND = "[" + ", ".join(f"'{k}'" for k in _KINDS) + "]"


def _colour_step(now: str, last: str, i: int) -> str:
    """SQL of one modifier applied to the table ``last``."""
    lin = lambda c: f"CASE WHEN {c} <= 0.04045 THEN {c} / 12.92 ELSE pow(({c} + 0.055) / 1.055, 2.4) END"
    gam = lambda c: f"CASE WHEN {c} <= 0.0031308 THEN 12.92 * {c} ELSE 1.055 * pow({c}, 1 / 2.4) - 0.055 END"
    rgb = {"r": ("c1", "x1", "0", "0", "x1", "c1"), "g": ("x1", "c1", "c1", "x1", "0", "0"), "b": ("0", "0", "x1", "c1", "c1", "x1")}
    hue = lambda c: "m1 + CASE " + " ".join(f"WHEN h6 < {k + 1} THEN {v}" if k < 5 else f"ELSE {v}" for k, v in enumerate(rgb[c])) + " END"
    out = {c: f"CASE k WHEN 'tint' THEN {gam(f'(1 - (1 - ({lin(c)})) * v)')} WHEN 'shade' THEN {gam(f'(({lin(c)}) * v)')} WHEN '{n}' THEN v WHEN '{n}Mod' THEN {c} * v WHEN '{n}Off' THEN {c} + v ELSE CASE WHEN k[1:3] IN ('lum', 'sat', 'hue') THEN {hue(c)} ELSE {c} END END AS {c}" for c, n in (("r", "red"), ("g", "green"), ("b", "blue"))}
    return f"""{now}k AS (SELECT *, {_KIND}[(p_partkey // {3**i} + {i}) % {len(_KINDS)} + 1] AS k, ((p_partkey * 37 + {i} * 11) % 101) / 100.0::DOUBLE AS v, greatest(r, g, b) AS mx, least(r, g, b) AS mn FROM {last}),
  {now}h AS (SELECT *, CASE WHEN mx = mn THEN 0.0 WHEN mx = r THEN (g - b) / (mx - mn) WHEN mx = g THEN (b - r) / (mx - mn) + 2 ELSE (r - g) / (mx - mn) + 4 END / 6 + 1 AS h0, CASE WHEN mx = mn THEN 0.0 ELSE (mx - mn) / (1 - abs(mx + mn - 1)) END AS s0, (mx + mn) / 2 AS l0 FROM {now}k),
  {now}m AS (SELECT * EXCLUDE (h0, s0, l0), CASE k WHEN 'hueMod' THEN (h0 - floor(h0)) * v WHEN 'hueOff' THEN h0 - floor(h0) + v ELSE h0 - floor(h0) END AS h1, least(1, greatest(0, CASE k WHEN 'satMod' THEN s0 * v WHEN 'satOff' THEN s0 + v ELSE s0 END)) AS s1, least(1, greatest(0, CASE k WHEN 'lumMod' THEN l0 * v WHEN 'lumOff' THEN l0 + v ELSE l0 END)) AS l1 FROM {now}h),
  {now}c AS (SELECT *, (h1 - floor(h1)) * 6 AS h6, (1 - abs(2 * l1 - 1)) * s1 AS c1 FROM {now}m), {now}x AS (SELECT *, c1 * (1 - abs(h6 % 2 - 1)) AS x1, l1 - c1 / 2 AS m1 FROM {now}c),
  {now} AS (SELECT p_partkey, {out['r']}, {out['g']}, {out['b']}, CASE k WHEN 'alpha' THEN v WHEN 'alphaMod' THEN a * v WHEN 'alphaOff' THEN a + v ELSE a END AS a FROM {now}x)"""


@query(
    f"""WITH s0 AS (SELECT p_partkey, n // 65536 / 255.0::DOUBLE AS r, n // 256 % 256 / 255.0::DOUBLE AS g, n % 256 / 255.0::DOUBLE AS b, 1.0::DOUBLE AS a FROM (SELECT p_partkey, p_partkey * 2654435761 % 16777216 AS n FROM part)),
  {_colour_step("s1", "s0", 0)}, {_colour_step("s2", "s1", 1)}, {_colour_step("s3", "s2", 2)}
  SELECT p_partkey, {", ".join(f"CAST(floor(least(1, greatest(0, round({c}, 9))) * 255 + 0.5) AS INT) AS {n}" for c, n in (("r", "red"), ("g", "green"), ("b", "blue"), ("a", "alpha")))} FROM s3"""
)
def colour_pipeline(spark, sf_dir):
    """Colours after three modifiers in their order: alpha, tint, shade, channels, hue,
    saturation and light."""
    kinds = F.array(*[F.lit(k) for k in _KINDS])
    mods = F.array(*[F.struct(F.element_at(kinds, F.expr(f"cast((p_partkey div {3**i} + {i}) % {len(_KINDS)} + 1 as int)")).alias("kind"), F.expr(f"((p_partkey * 37 + {i} * 11) % 101) / 100.0D").alias("amount")) for i in range(3)])
    base = drawing.hex_colour(F.lpad(F.hex(F.expr("p_partkey * 2654435761 % 16777216")), 6, "0"))
    out = t(spark, sf_dir, "part").select("p_partkey", drawing.modified(base, mods).alias("c"))
    return out.select("p_partkey", *[drawing.channel(F.round(F.col(f"c.{c}"), 9)).alias(n) for c, n in (("r", "red"), ("g", "green"), ("b", "blue"), ("a", "alpha"))])


@query(
    """WITH s AS (SELECT event_id, event_id % 4 AS k, event_id // 4 % 3 AS f, event_id // 12 % 5 AS i FROM events)
  SELECT event_id, CASE WHEN k = 1 AND f = 0 THEN '102030' WHEN k = 2 AND i IN (1, 3) THEN 'A0B0C0' ELSE 'FFFFFF' END AS colour, (k = 1 AND f = 2) OR (k = 2 AND i = 2) AS approximated FROM s"""
)
def slide_backgrounds(spark, sf_dir):
    """A slide's background: its solid fill, the theme's, or white; gradients are approximated."""
    kind = F.expr("element_at(array('none', 'properties', 'reference', 'empty'), cast(event_id % 4 + 1 as int))")
    solid = F.expr("CASE event_id div 4 % 3 WHEN 0 THEN '102030' WHEN 1 THEN 'none' END")
    index = F.expr("element_at(array(0, 1, 2, 1001, 1000), cast(event_id div 12 % 5 + 1 as int))")
    themed = F.expr("CASE WHEN event_id div 12 % 5 IN (1, 3) THEN 'A0B0C0' END")
    return t(spark, sf_dir, "events").select("event_id", drawing.background(kind, solid, index, themed).alias("b")).select("event_id", "b.colour", "b.approximated")


@query(
    """WITH a AS (SELECT o_orderkey, o_orderkey % 8 AS k, lower(printf('%x', o_orderkey * 7 % 65536)) AS w FROM orders),
  i AS (SELECT o_orderkey, k, w, CASE k WHEN 0 THEN '2001:db8::' || w WHEN 1 THEN '2600:' || w || '::1' WHEN 2 THEN 'fe80::' || w WHEN 3 THEN '2002:' || w || '::' WHEN 4 THEN '2001:' || w || ':0:0:0:0:0:1' WHEN 5 THEN '::ffff:8.8.8.8' WHEN 6 THEN '3fff:' || w || '::' ELSE '2a00::' || w || '::1' END AS ip FROM a)
  SELECT o_orderkey, ip, CASE k WHEN 1 THEN true WHEN 4 THEN NOT (o_orderkey * 7 % 65536 < 512 OR o_orderkey * 7 % 65536 = 3512) WHEN 6 THEN o_orderkey * 7 % 65536 >= 4096 ELSE false END AS public FROM i"""
)
def public_addresses6(spark, sf_dir):
    """IPv6 addresses that are global unicast, without documentation, tunnel and mapped ones."""
    w = F.lower(F.hex(F.expr("o_orderkey * 7 % 65536")))
    lit = F.lit
    forms = [F.concat(lit("2001:db8::"), w), F.concat(lit("2600:"), w, lit("::1")), F.concat(lit("fe80::"), w), F.concat(lit("2002:"), w, lit("::")), F.concat(lit("2001:"), w, lit(":0:0:0:0:0:1")), lit("::ffff:8.8.8.8"), F.concat(lit("3fff:"), w, lit("::")), F.concat(lit("2a00::"), w, lit("::1"))]
    ip = F.element_at(F.array(*forms), F.expr("cast(o_orderkey % 8 + 1 as int)"))
    return t(spark, sf_dir, "orders").select("o_orderkey", ip.alias("ip")).withColumn("public", urls.is_public(F.col("ip")))


_SIZED = f"""{CELLS}, sized AS (SELECT sheet, row, col, value, 6 + (row * 7 + col) % 9 AS size, row % 11 = 3 OR col = 6 AS hidden FROM cells),
  areas AS (SELECT DISTINCT sheet, row // 16 * 16 AS r1, row // 16 * 16 + 11 AS r2, 1 AS c1, 4 AS c2 FROM cells)"""


@query(
    f"""WITH {_SIZED}, f AS (SELECT a.sheet, a.r1, CAST(min(size) AS INT) AS least_font FROM areas a LEFT JOIN sized s ON s.sheet = a.sheet AND s.row BETWEEN r1 AND r2 AND s.col BETWEEN c1 AND c2 AND NOT hidden AND value <> '' GROUP BY a.sheet, a.r1)
  SELECT sheet, r1, least_font, round(CASE WHEN least_font IS NOT NULL AND least_font * 2 + 1e-6 < 14 THEN 2.0 ELSE least(2.0, greatest(least(2.0, 300 / (100.0 + r1 % 400)), CASE WHEN least_font IS NULL THEN 1.0 ELSE 14.0 / greatest(1, least_font) END)) END, 6) AS scale FROM f"""
)
def readable_scales(spark, sf_dir):
    """The least font of a range's visible texts, and the scale that keeps it readable."""
    c = cells(spark, sf_dir).selectExpr("sheet", "row", "col", "value AS text", "6 + (row * 7 + col) % 9 AS size", "row % 11 = 3 OR col = 6 AS hidden")
    areas = c.selectExpr("sheet", "cast(row div 16 * 16 as int) AS r1", "cast(row div 16 * 16 + 11 as int) AS r2", "1 AS c1", "4 AS c2").distinct()
    out = pages.least_font(c, areas, ["sheet"])
    scale = pages.scale(F.lit(2.0), F.expr("100.0D + r1 % 400"), F.lit(300.0), F.col("least_font"), F.lit(14.0))
    return out.select("sheet", "r1", F.col("least_font").cast("int").alias("least_font"), F.round(scale, 6).alias("scale"))


@query(
    f"""WITH {CELLS}, told AS (SELECT sheet * 1000 + row // 40 AS sheet, row, col, value FROM cells WHERE CAST(value AS BIGINT) % 3 <> 0 AND (row // 40 + col) % 4 <> 0), cs AS (SELECT DISTINCT sheet, col FROM told), rs AS (SELECT DISTINCT sheet, row FROM told)
  SELECT rs.sheet, rs.row, string_agg(coalesce(value, ''), '|' ORDER BY cs.col) AS line FROM rs JOIN cs ON cs.sheet = rs.sheet LEFT JOIN told t ON t.sheet = rs.sheet AND t.row = rs.row AND t.col = cs.col GROUP BY rs.sheet, rs.row"""
)
def dense_rows(spark, sf_dir):
    """Rows without the columns that are empty in all of a sheet, and without empty rows."""
    c = cells(spark, sf_dir).selectExpr("cast(sheet * 1000 + row div 40 as int) AS sheet", "row", "col", "if(cast(value as long) % 3 = 0 or (row div 40 + col) % 4 = 0, ' ', value) AS value")
    return pages.dense(c, ["sheet"]).select("sheet", "row", F.array_join("values", "|").alias("line"))


@query(
    """WITH b AS (SELECT o_custkey AS grp, CAST(o_orderkey % 90 AS BIGINT) AS h, o_orderkey % 60 AS w, (o_orderkey % 50) * 10.0 AS x, (o_orderkey % 70) * 10.0 AS y FROM orders)
  SELECT grp, CAST(sum((h + 1) * (w + 1)) AS BIGINT) AS cells, sum((h + 1) * (w + 1)) <= 10000 AND ceil((max(x + w * 5) - min(x) + 6) * 96 / 72) * ceil((max(y + h * 4) - min(y) + 6) * 96 / 72) <= 900000 AS fits FROM b GROUP BY grp"""
)
def preview_limits(spark, sf_dir):
    """Whether the cells and pixels of a drawing's cell regions are within the limits."""
    b = t(spark, sf_dir, "orders").selectExpr("o_custkey AS grp", "0 AS r1", "o_orderkey % 90 AS r2", "0 AS c1", "o_orderkey % 60 AS c2", "(o_orderkey % 50) * 10.0D AS x", "(o_orderkey % 70) * 10.0D AS y", "o_orderkey % 60 * 5.0D AS width", "o_orderkey % 90 * 4.0D AS height")
    return pages.previews(b, ["grp"], 900_000)


@query("SELECT l_orderkey, l_linenumber, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_partkey % 2 = 0 THEN 0 ELSE 1 END, l_suppkey % 5, l_linenumber, l_partkey) AS INT) AS paint FROM lineitem")
def paint_order(spark, sf_dir):
    """What lies behind the text first, then by z, then as listed: each place once."""
    items = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.struct("l_linenumber", "l_partkey").alias("id"), (F.col("l_partkey") % 2 == 0).alias("behind"), (F.col("l_suppkey") % 5).alias("z"))
    return pages.painted(items, ["l_orderkey"]).select("l_orderkey", "l_linenumber", "paint")


@query(
    """WITH d AS (SELECT conv_id, count(*) - CASE WHEN conv_id % 9 = 0 THEN count(*) ELSE 0 END AS n, CASE WHEN conv_id % 3 > 0 THEN conv_id % 6 END AS page FROM conversations GROUP BY conv_id),
  e AS (SELECT *, CASE WHEN n < 1 THEN 'EMPTY_DOCUMENT' WHEN n > 9 THEN 'PAGE_LIMIT_EXCEEDED' WHEN page > n THEN 'INVALID_PAGE' END AS error FROM d)
  SELECT conv_id, CAST(NULL AS INT) AS page, error FROM e WHERE error IS NOT NULL UNION ALL SELECT conv_id, CAST(page AS INT), NULL FROM e WHERE error IS NULL AND page IS NOT NULL
  UNION ALL SELECT conv_id, CAST(unnest(range(1, n + 1)) AS INT), NULL FROM e WHERE error IS NULL AND page IS NULL"""
)
def page_selection(spark, sf_dir):
    """One page of a document, or all; what cannot be selected says why."""
    d = t(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"))
    n = F.when(F.col("conv_id") % 9 == 0, 0).otherwise(F.col("n")).cast("int")
    wanted = d.select("conv_id", F.when(F.col("conv_id") % 3 > 0, (F.col("conv_id") % 6).cast("int")).alias("page"))
    return pages.selected(d.select("conv_id", n.alias("n")), wanted, ["conv_id"], 9)


_TABLE = "SELECT doc_id, CAST(pos AS BIGINT) AS row, 1 + len(line) // 60 AS lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)"


@query(
    f"""WITH RECURSIVE r AS ({_TABLE}), h AS (SELECT doc_id, lines AS head FROM r WHERE row = 0),
  f(doc_id, row, first, count, page, room) AS (SELECT doc_id, CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(500 AS BIGINT) FROM h
  UNION ALL SELECT doc_id, row, first, least(lines - first, greatest(1, (room - 8) // 10)), page, room - least(lines - first, greatest(1, (room - 8) // 10)) * 10 - 8 FROM (
    SELECT x.*, CASE WHEN fresh OR (left_ - 8) // 10 < 1 THEN page0 + 1 ELSE page0 END AS page, CASE WHEN fresh OR (left_ - 8) // 10 < 1 THEN 500 - CASE WHEN row > 0 AND head <= 8 THEN head * 10 + 8 ELSE 0 END ELSE left_ END AS room FROM (
      SELECT f.doc_id, r.row, r.lines, h.head, f.page AS page0, f.room AS left_, CASE WHEN r.row = f.row THEN f.first + f.count ELSE 0 END AS first, r.row = f.row AS fresh
      FROM f JOIN h ON h.doc_id = f.doc_id JOIN r p ON p.doc_id = f.doc_id AND p.row = greatest(f.row, 0) JOIN r ON r.doc_id = f.doc_id AND r.row = CASE WHEN f.row >= 0 AND f.first + f.count < p.lines THEN f.row ELSE f.row + 1 END) x))
  SELECT doc_id, row, first, count, page FROM f WHERE row >= 0"""
)
def table_chunks(spark, sf_dir):
    """Rows of a table over pages, with the header repeated where it is short."""
    d = t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("row", "line"))
    return pages.chunked(d.select("doc_id", F.col("row").cast("long").alias("row"), F.expr("1 + length(line) div 60").alias("lines")), ["doc_id"], 500, 10, 4)


@query(
    """WITH RECURSIVE w(p_partkey, rest, lines, line, width) AS (SELECT p_partkey, p_name || chr(10) || '改行' || p_name, CAST([] AS VARCHAR[]), '', 0.0::DOUBLE FROM part
  UNION ALL SELECT p_partkey, substr(rest, 2), CASE WHEN c = chr(10) OR full_ THEN list_append(lines, line) ELSE lines END, CASE WHEN c = chr(10) THEN '' WHEN full_ THEN c ELSE line || c END, CASE WHEN c = chr(10) THEN 0.0 WHEN full_ THEN adv ELSE width + adv END
  FROM (SELECT *, line <> '' AND width + adv > 40.001 AS full_ FROM (SELECT *, substr(rest, 1, 1) AS c, CASE WHEN ascii(substr(rest, 1, 1)) < 128 THEN 5.5 ELSE 10.0 END::DOUBLE AS adv FROM w WHERE rest <> '')))
  SELECT p_partkey, array_to_string(list_append(lines, line), '|') AS lines FROM w WHERE rest = ''"""
)
def flow_lines(spark, sf_dir):
    """Lines broken where the next character would pass the width."""
    text = F.concat("p_name", F.lit("\n改行"), "p_name")
    return t(spark, sf_dir, "part").select("p_partkey", F.array_join(pages.broken(text, 40.0, 5.5, 10.0), "|").alias("lines"))


@query("SELECT doc_id, CAST(length_grapheme(text) AS INT) AS graphemes FROM documents")
def grapheme_counts(spark, sf_dir):
    """Characters as a reader counts them."""
    return t(spark, sf_dir, "documents").select("doc_id", styles.graphemes(F.col("text")).cast("int").alias("graphemes"))


@query(
    """WITH g AS (SELECT vec_id, unnest(range(64)) AS i, unnest(list_transform(embedding, lambda v: greatest(0, least(255, CAST(floor(128 + 400 * CAST(v AS DOUBLE)) AS INT))))) AS a FROM embeddings),
  p AS (SELECT x.vec_id, x.i % 8 AS x, x.i // 8 AS y, x.a, z.a AS b FROM g x JOIN g z ON z.vec_id = x.vec_id + 1 AND z.i = x.i),
  e AS (SELECT c.vec_id, 9 * c.a - sum(n.a) > 96 AS ea, 9 * c.b - sum(n.b) > 96 AS eb FROM p c JOIN p n ON n.vec_id = c.vec_id AND n.x BETWEEN c.x - 1 AND c.x + 1 AND n.y BETWEEN c.y - 1 AND c.y + 1 WHERE c.x BETWEEN 1 AND 6 AND c.y BETWEEN 1 AND 6 GROUP BY c.vec_id, c.x, c.y, c.a, c.b),
  k AS (SELECT vec_id, count(*) FILTER (ea) AS source_edges, count(*) FILTER (eb) AS target_edges, count(*) FILTER (ea <> eb) AS edge_mismatch, count(*) FILTER (ea OR eb) AS u FROM e GROUP BY vec_id)
  SELECT vec_id, count(*) AS pixels, count(*) FILTER (abs(a - b) > 16) AS changed, round(avg(abs(a - b)), 6) AS mean_error, round(sqrt(avg((a - b) * (a - b))), 6) AS rms_error, CAST(max(abs(a - b)) AS INT) AS max_error,
  any_value(source_edges) AS source_edges, any_value(target_edges) AS target_edges, any_value(edge_mismatch) AS edge_mismatch, round(any_value(CASE WHEN u > 0 THEN edge_mismatch / u ELSE 0 END), 6) AS edge_mismatch_ratio FROM p JOIN k USING (vec_id) GROUP BY vec_id"""
)
def image_differences(spark, sf_dir):
    """Metrics of pairs of grey pictures (8 x 8, a vector each): changes, errors, edges."""
    grey = F.expr("transform(embedding, v -> cast(greatest(0, least(255, floor(128 + 400 * cast(v as double)))) as int))")
    g = t(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(grey).alias("i", "a"))
    other = g.select((F.col("vec_id") - 1).alias("vec_id"), "i", F.col("a").alias("b"))
    p = g.join(other, ["vec_id", "i"]).select("vec_id", (F.col("i") % 8).alias("x"), F.expr("i div 8").alias("y"), "a", "b")
    out = pages.differences(p, ["vec_id"], 16, 96)
    return out.select("vec_id", "pixels", "changed", F.round("mean_error", 6).alias("mean_error"), F.round("rms_error", 6).alias("rms_error"), "max_error", "source_edges", "target_edges", "edge_mismatch", F.round("edge_mismatch_ratio", 6).alias("edge_mismatch_ratio"))


#: Style sheets and vector pictures with the first reason against each.
SHEETS = {
    "p{color:red}": None, "@media print{p{color:red}}": None, "@import ''x.css'';": "AT_RULE", "@font-face{src:none}": "AT_RULE", "p{background:url(#a)}": None, "p{background:url(http://x/y.png)}": "EXTERNAL_URL",
    "p{background:image-set(#a)}": "FUNCTION", "p{width:expression(1)}": "FUNCTION", "p{behavior:none}": "ACTIVE_PROPERTY", "/* @import x */p{top:0}": None, "p{background:url(data:image/png;base64,AA)}": None, "@KEYFRAMES a{from{top:0}}": None, "p::after{content:''@import url(x)''}": "EXTERNAL_URL",
}
PICTURES = {
    "<svg><rect/></svg>": None, "<svg><script/></svg>": "ELEMENT", "<!DOCTYPE svg><svg/>": "DECLARATION", "<svg><g onload=''x''/></svg>": "EVENT", "<svg><use href=''#a''/></svg>": None, "<svg><use href=''http://x''/></svg>": "EXTERNAL_REFERENCE",
    "<svg><rect fill=''url(#g)''/></svg>": None, "<svg><rect fill=''url(x.svg#g)''/></svg>": "EXTERNAL_PAINT", "<svg><style>@import x</style></svg>": "EXTERNAL_STYLE", "<p/>": "NO_SVG", "<svg><image/></svg>": "ELEMENT",
}
_BLIP = "<blipFill><blip/><stretch><fillRect{}/></stretch></blipFill>"
FRAMES = {
    "<p:pic xmlns:p=''p''><p:spPr><p:prstGeom prst=''rect''/></p:spPr><p:blipFill><p:blip/></p:blipFill></p:pic>": True, f"<pic><spPr><prstGeom prst=''ellipse''/></spPr>{_BLIP.format('')}</pic>": False, f"<pic><spPr><custGeom/><prstGeom prst=''rect''/></spPr>{_BLIP.format('')}</pic>": False,
    f"<pic><spPr><prstGeom prst=''rect''/><effectLst/></spPr>{_BLIP.format('')}</pic>": True, f"<pic><spPr><prstGeom prst=''rect''/><effectLst><glow/></effectLst></spPr>{_BLIP.format('')}</pic>": False, "<pic><spPr><prstGeom prst=''rect''/></spPr><blipFill><blip><alphaModFix/></blip></blipFill></pic>": False,
    "<pic><spPr><prstGeom prst=''rect''/></spPr>" + _BLIP.format(" l=''0'' r=''0%''") + "</pic>": True, "<pic><spPr><prstGeom prst=''rect''/></spPr>" + _BLIP.format(" l=''10%''") + "</pic>": False, "<pic/>": False,
}


def _listed(xs: dict, n: str) -> str:
    """DuckDB SQL of the verdict by a number."""
    lit = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"'{v}'"
    return "CASE " + " ".join(f"WHEN {n} % {len(xs)} = {i} THEN {lit(v)}" for i, v in enumerate(xs.values())) + " END"


def _text(xs: dict, n: str):
    return F.element_at(F.array(*[F.lit(k.replace("''", "'")) for k in xs]), F.expr(f"cast({n} % {len(xs)} + 1 as int)"))


@query(f"SELECT page_id, {_listed(SHEETS, 'page_id')} AS css, {_listed(PICTURES, 'page_id')} AS svg, {_listed(FRAMES, 'page_id')} AS rectangular FROM pages")
def style_rules(spark, sf_dir):
    """First reason against a style sheet and a vector picture; whether a picture is a plain rectangle."""
    p = t(spark, sf_dir, "pages")
    return p.select("page_id", styles.css_problem(_text(SHEETS, "page_id")).alias("css"), styles.svg_problem(_text(PICTURES, "page_id")).alias("svg"), styles.rectangular_picture(_text(FRAMES, "page_id")).alias("rectangular"))


@query(
    """WITH f AS (SELECT c_custkey AS path, 'v' || CAST(c_custkey % 5 AS VARCHAR) AS etag FROM customer WHERE c_custkey % 4 <> 0)
  SELECT o_orderkey, CASE WHEN f.path IS NULL THEN 404 WHEN o_orderkey % 3 > 0 AND 'v' || CAST(o_orderkey % 5 AS VARCHAR) <> etag THEN 409 ELSE 200 END AS status FROM orders LEFT JOIN f ON f.path = o_custkey"""
)
def versioned_reads(spark, sf_dir):
    """Inputs and results that are read only in the version that was asked for."""
    files = t(spark, sf_dir, "customer").where("c_custkey % 4 <> 0").selectExpr("c_custkey AS path", "concat('v', c_custkey % 5) AS version")
    asked = t(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_custkey AS path", "if(o_orderkey % 3 > 0, concat('v', o_orderkey % 5), null) AS version")
    return settings.matched(asked, files).select("o_orderkey", "status")


@query(
    """SELECT event_id, CASE WHEN event_id % 5 = 1 THEN 'MULTIPART' WHEN user_id % 7 = 0 THEN 'EMPTY' WHEN user_id % 7 * 100 > 500 THEN 'INPUT_TOO_LARGE' END AS raw,
  CASE WHEN event_id % 4 = 0 OR event_id % 4 = 3 THEN 'INVALID_MULTIPART' WHEN event_id % 11 * 10 > 80 THEN 'REQUEST_TOO_LARGE' WHEN user_id % 7 * 100 > 500 THEN 'INPUT_TOO_LARGE' WHEN user_id % 7 = 0 THEN 'EMPTY' END AS form,
  CASE WHEN event_id % 3 = 0 THEN 'disabled' WHEN event_id % 6 = 1 OR user_id % 4 = 0 THEN 'invalid' ELSE 'configured' END AS ocr, CASE user_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 60 ELSE 100 + user_id % 4 END AS setting FROM events"""
)
def service_settings(spark, sf_dir):
    """Bodies, forms and settings at a service's boundary."""
    e = t(spark, sf_dir, "events")
    kind = F.expr("if(event_id % 5 = 1, ' Multipart/form-data; boundary=x', 'video/mp4')")
    part = lambda name, size: F.expr(f"named_struct('name', '{name}', 'size', cast({size} as long))")
    file, request = part("file", "user_id % 7 * 100"), part("request", "event_id % 11 * 10")
    parts = F.when(F.expr("event_id % 4 = 0"), F.array(file)).when(F.expr("event_id % 4 = 3"), F.array(file, file)).otherwise(F.array(request, file))
    endpoint = F.expr("CASE WHEN event_id % 6 = 0 THEN ' ' WHEN event_id % 6 = 1 THEN 'http://host.example/' WHEN event_id % 6 = 3 THEN NULL ELSE 'https://host.example:8443/' END")
    timeout = F.expr("CASE user_id % 4 WHEN 0 THEN '181' WHEN 1 THEN '' ELSE '30' END")
    setting = settings.limit_setting(F.expr("CASE user_id % 4 WHEN 0 THEN '-5' WHEN 1 THEN ' ' ELSE concat(' ', 100 + user_id % 4) END"), 60)
    raw = settings.body_error(kind, F.expr("user_id % 7 * 100"), F.lit(500))
    return e.select("event_id", raw.alias("raw"), settings.parts_error(parts, 80, 500).alias("form"), settings.ocr_error(endpoint, F.lit("key-1"), timeout).alias("ocr"), setting.alias("setting"))


@query("SELECT user_id % 20 AS bucket, event_id AS id, CAST((row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) - 1) // 100 AS BIGINT) AS pass FROM events")
def maintenance_passes(spark, sf_dir):
    """The pass of a maintenance cursor, 100 ids at a time, that reaches each job of a bucket."""
    return settings.swept(t(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("bucket"), F.col("event_id").alias("id"))).withColumn("pass", F.col("pass").cast("long"))


# Blocks of four bordered rows; in the top row of each, some columns have no border.
_OPEN = f"""{CELLS}, o AS (SELECT sheet, row, col, value, row % 6 < 4 AND NOT (row % 6 = 0 AND (CASE row // 6 % 4 WHEN 0 THEN col <= 2 WHEN 1 THEN col >= 6 WHEN 2 THEN col = 4 ELSE false END)) AS boxed FROM cells),
  segs AS (SELECT sheet, 'h' AS kind, row, col FROM o WHERE boxed UNION SELECT sheet, 'h', row + 1, col FROM o WHERE boxed UNION SELECT sheet, 'v', row, col FROM o WHERE boxed UNION SELECT sheet, 'v', row, col + 1 FROM o WHERE boxed)"""


@query(
    rf"""WITH RECURSIVE {_OPEN}, pts AS (SELECT sheet, row, col FROM segs UNION SELECT sheet, row - 1, col FROM segs WHERE kind = 'h' AND row > 0 UNION SELECT sheet, row, col - 1 FROM segs WHERE kind = 'v' AND col > 0),
  u AS (SELECT p.* FROM pts p SEMI JOIN segs a ON a.sheet = p.sheet AND a.kind = 'h' AND a.row = p.row AND a.col = p.col SEMI JOIN segs b ON b.sheet = p.sheet AND b.kind = 'h' AND b.row = p.row + 1 AND b.col = p.col
    SEMI JOIN segs c ON c.sheet = p.sheet AND c.kind = 'v' AND c.row = p.row AND c.col = p.col SEMI JOIN segs d ON d.sheet = p.sheet AND d.kind = 'v' AND d.row = p.row AND d.col = p.col + 1),
  l AS (SELECT a.sheet, a.row, a.col, b.row AS r, b.col AS c FROM u a JOIN u b ON b.sheet = a.sheet AND b.row = a.row AND b.col = a.col + 1 UNION ALL SELECT a.sheet, a.row, a.col, b.row, b.col FROM u a JOIN u b ON b.sheet = a.sheet AND b.row = a.row + 1 AND b.col = a.col),
  links AS (SELECT * FROM l UNION ALL SELECT sheet, r, c, row, col FROM l), walk(sheet, row, col, root) AS (SELECT sheet, row, col, row * 1000 + col FROM u UNION SELECT k.sheet, k.r, k.c, w.root FROM walk w JOIN links k ON k.sheet = w.sheet AND k.row = w.row AND k.col = w.col),
  comp AS (SELECT sheet, row, col, min(root) AS root FROM walk GROUP BY 1, 2, 3), box AS (SELECT sheet, root, count(*) AS n, min(row) AS r1, max(row) AS r2, min(col) AS c1, max(col) AS c2 FROM comp GROUP BY 1, 2),
  b AS (SELECT * FROM box WHERE n < (r2 - r1 + 1) * (c2 - c1 + 1) AND r2 > r1 + 1 AND c2 > c1),
  low AS (SELECT b.sheet, b.root FROM b JOIN comp k ON k.sheet = b.sheet AND k.row BETWEEN b.r1 + 1 AND b.r2 AND k.col BETWEEN b.c1 AND b.c2 GROUP BY b.sheet, b.root, r1, r2, c1, c2 HAVING count(*) = (r2 - r1) * (c2 - c1 + 1)),
  gap AS (SELECT b.sheet, b.root, b.r1 AS row, g.col, b.c2 FROM (SELECT *, unnest(range(c1, c2 + 1)) AS col FROM b) g JOIN b ON b.sheet = g.sheet AND b.root = g.root WHERE NOT EXISTS (SELECT 1 FROM comp k WHERE k.sheet = g.sheet AND k.row = g.r1 AND k.col = g.col)),
  bad AS (SELECT DISTINCT g.sheet, g.root FROM gap g WHERE g.col = g.c2 OR EXISTS (SELECT 1 FROM o WHERE o.sheet = g.sheet AND o.row = g.row AND o.col = g.col AND boxed)
    OR (EXISTS (SELECT 1 FROM segs s WHERE s.sheet = g.sheet AND s.kind = 'h' AND s.row = g.row AND s.col = g.col) AND NOT EXISTS (SELECT 1 FROM comp k WHERE k.sheet = g.sheet AND k.row = g.row - 1 AND k.col = g.col AND k.root <> g.root))),
  stand AS (SELECT DISTINCT b.sheet, b.root FROM b JOIN segs s ON s.sheet = b.sheet AND s.kind = 'v' AND s.col BETWEEN b.c1 AND b.c2 + 1 AND (s.row = b.r1 - 1 OR s.row = b.r2 + 1)
    WHERE NOT EXISTS (SELECT 1 FROM comp f WHERE f.sheet = s.sheet AND f.row = s.row AND f.col IN (s.col, s.col - 1) AND f.root <> b.root)),
  ok AS (SELECT b.* FROM b SEMI JOIN low USING (sheet, root) SEMI JOIN gap USING (sheet, root) ANTI JOIN bad USING (sheet, root) ANTI JOIN stand USING (sheet, root)),
  g AS (SELECT gap.sheet, gap.row, gap.col FROM gap SEMI JOIN ok USING (sheet, root))
  SELECT sheet, CAST(r1 AS INT) AS row, CAST(c1 AS INT) AS col, CAST(r2 AS INT) AS r2, CAST(c2 AS INT) AS c2, 'table' AS kind FROM ok UNION ALL SELECT sheet, row, CAST(col AS INT), NULL, NULL, 'open' FROM g
  UNION ALL SELECT sheet, row, col, NULL, NULL, 'candidate' FROM o WHERE value <> '' AND NOT EXISTS (SELECT 1 FROM g WHERE g.sheet = o.sheet AND g.row = o.row AND g.col = o.col)"""
)
def open_top_tables(spark, sf_dir):
    """Tables with gaps in their top row, the gaps, and the values that may belong to tables."""
    gap = "row % 6 = 0 AND (CASE row div 6 % 4 WHEN 0 THEN col <= 2 WHEN 1 THEN col >= 6 WHEN 2 THEN col = 4 ELSE false END)"
    boxed = f"row % 6 < 4 AND NOT ({gap})"
    o = cells(spark, sf_dir).selectExpr("sheet", "row", "col", *[f"{boxed} AS {b}" for b in ("bt", "bb", "bl", "br", "own")], "true AS plain", "value <> '' AS told")
    return grid.open_top_alone(o, ["sheet"])


@query(
    """WITH s AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS g FROM conversations)
  SELECT conv_id, turn, CASE WHEN role = 'user' THEN CAST(g AS VARCHAR) || '.' ELSE CAST(greatest(g, 1) AS VARCHAR) || '.' || lower(chr(CAST(65 + (row_number() OVER (PARTITION BY conv_id, g, role = 'user' ORDER BY turn) - 1) % 26 AS INT))) END AS label FROM s"""
)
def list_numbers(spark, sf_dir):
    """Numbers of a list of two levels: decimals, and letters that restart after each of them."""
    c = t(spark, sf_dir, "conversations").withColumn("level", F.when(F.col("role") == "user", 0).otherwise(1))
    top = F.col("level") == 0
    p = c.select("conv_id", F.col("turn").alias("ord"), F.lit(1).alias("num_id"), "level", F.when(top, "decimal").otherwise("lowerLetter").alias("format"), F.when(top, "%1.").otherwise("%1.%2").alias("pattern"), F.lit(1).alias("start"), F.lit(None).cast("int").alias("restart"))
    return numbering.numbered(p, ["conv_id"]).select("conv_id", F.col("ord").alias("turn"), "label")


@query(
    """WITH RECURSIVE p AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, CAST((conv_id + turn) % 3 AS INT) AS level, CASE WHEN turn % 7 = 5 THEN NULL WHEN turn % 5 = 3 THEN NULL WHEN conv_id % 4 = 0 AND turn % 3 = 0 THEN 'alphaLcParenR' ELSE 'arabicPeriod' END AS scheme, CASE WHEN turn % 11 = 4 THEN 5 END AS start, turn % 7 = 5 AS bullet FROM conversations),
  w(conv_id, turn, i, ns, ks, label) AS (SELECT DISTINCT conv_id, CAST(NULL AS BIGINT), CAST(0 AS BIGINT), CAST([NULL, NULL, NULL] AS INT[]), CAST([NULL, NULL, NULL] AS VARCHAR[]), CAST(NULL AS VARCHAR) FROM p
  UNION ALL SELECT conv_id, turn, i, CASE WHEN scheme IS NOT NULL THEN list_transform([0, 1, 2], lambda k: CASE WHEN k = level THEN n + 1 WHEN k < level THEN ns[k + 1] END) WHEN bullet THEN list_transform([0, 1, 2], lambda k: CASE WHEN k <> level THEN ns[k + 1] END) ELSE CAST([NULL, NULL, NULL] AS INT[]) END,
    CASE WHEN scheme IS NOT NULL THEN list_transform([0, 1, 2], lambda k: CASE WHEN k = level THEN scheme ELSE ks[k + 1] END) WHEN bullet THEN list_transform([0, 1, 2], lambda k: CASE WHEN k <> level THEN ks[k + 1] END) ELSE CAST([NULL, NULL, NULL] AS VARCHAR[]) END,
    CASE WHEN scheme = 'arabicPeriod' THEN CAST(n AS VARCHAR) || '.' WHEN scheme IS NOT NULL THEN chr(CAST(96 + n AS INT)) || ')' WHEN bullet THEN '-' ELSE '' END
    FROM (SELECT p.*, w.ns, w.ks, CASE WHEN p.start IS NOT NULL OR w.ks[p.level + 1] IS DISTINCT FROM p.scheme THEN coalesce(p.start, 1) ELSE coalesce(w.ns[p.level + 1], 1) END AS n FROM w JOIN p ON p.conv_id = w.conv_id AND p.i = w.i + 1))
  SELECT conv_id, turn, label FROM w WHERE turn IS NOT NULL"""
)
def slide_numbers(spark, sf_dir):
    """Numbers of a slide's paragraphs, by level and scheme."""
    p = t(spark, sf_dir, "conversations").selectExpr("conv_id", "turn AS ord", "cast((conv_id + turn) % 3 as int) AS level", "CASE WHEN turn % 7 = 5 THEN null WHEN turn % 5 = 3 THEN null WHEN conv_id % 4 = 0 AND turn % 3 = 0 THEN 'alphaLcParenR' ELSE 'arabicPeriod' END AS scheme", "CASE WHEN turn % 11 = 4 THEN 5 END AS start", "turn % 7 = 5 AS bullet")
    return numbering.slide_numbered(p, ["conv_id"]).select("conv_id", F.col("ord").alias("turn"), "label")


@query(
    f"""WITH {CELLS}, {MERGES}, b AS (SELECT sheet, min(row) AS a1, max(row) AS a2, min(col) AS b1, max(col) AS b2 FROM cells GROUP BY sheet),
  m AS (SELECT b.sheet, least(a1, coalesce(min(r1), a1)) AS r1, greatest(a2, coalesce(max(r2), a2)) AS r2, least(b1, coalesce(min(c1), b1)) AS c1, greatest(b2, coalesce(max(c2), b2)) AS c2 FROM b LEFT JOIN merges m ON m.sheet = b.sheet AND r1 <= a2 AND r2 >= a1 AND c1 <= b2 AND c2 >= b1 GROUP BY b.sheet, a1, a2, b1, b2),
  d AS (SELECT CAST(s_suppkey % 20 AS INT) AS sheet, CAST(s_suppkey AS INT) AS r1, CAST(s_suppkey * 3 AS INT) AS r2, CAST(0 AS INT) AS c1, CAST(s_suppkey % 40 AS INT) AS c2 FROM supplier)
  SELECT sheet, min(r1) AS r1, max(r2) AS r2, min(c1) AS c1, max(c2) AS c2 FROM (SELECT * FROM m UNION ALL SELECT * FROM d) GROUP BY sheet"""
)
def used_range_with_drawings(spark, sf_dir):
    """What a sheet uses: cells, the merges that meet them, and drawings."""
    d = t(spark, sf_dir, "supplier").selectExpr("cast(s_suppkey % 20 as int) AS sheet", "cast(s_suppkey as int) AS r1", "cast(s_suppkey * 3 as int) AS r2", "0 AS c1", "cast(s_suppkey % 40 as int) AS c2")
    return grid.used_range(cells(spark, sf_dir), merges(spark, sf_dir), ["sheet"], d)


@query(
    f"""WITH {CELLS}, v AS (SELECT * FROM cells WHERE row % 11 <> 3 AND col <> 6), b AS (SELECT DISTINCT sheet, row // 6 AS name, row // 6 * 6 AS r1, row // 6 * 6 + 4 AS r2, 1 + row // 6 % 3 AS c1, 3 + row // 6 % 4 AS c2 FROM cells), s AS (SELECT DISTINCT sheet, row // 20 * 20 AS r1, row // 20 * 20 + 7 AS r2, 1 AS c1, row // 20 % 3 + 1 AS c2 FROM cells)
  SELECT b.sheet, name, count(DISTINCT row) AS n_rows, count(DISTINCT col) AS n_cols FROM b JOIN v ON v.sheet = b.sheet AND row BETWEEN r1 AND r2 AND col BETWEEN c1 AND c2 WHERE EXISTS (SELECT 1 FROM s WHERE s.sheet = b.sheet AND s.r1 <= b.r2 AND b.r1 <= s.r2 AND s.c1 <= b.c2 AND b.c1 <= s.c2)
  GROUP BY b.sheet, name HAVING count(DISTINCT row) >= 2 AND count(DISTINCT col) >= 2 AND bool_or(trim(value) <> '')"""
)
def seeded_bands(spark, sf_dir):
    """Named bands that show two rows and columns or more, hold a value and meet a table's seed."""
    c = cells(spark, sf_dir)
    bands = c.selectExpr("sheet", "cast(row div 6 as int) AS name", "cast(row div 6 * 6 as int) AS r1", "cast(row div 6 * 6 + 4 as int) AS r2", "cast(1 + row div 6 % 3 as int) AS c1", "cast(3 + row div 6 % 4 as int) AS c2").distinct()
    seeds = c.selectExpr("sheet", "cast(row div 20 * 20 as int) AS r1", "cast(row div 20 * 20 + 7 as int) AS r2", "1 AS c1", "cast(row div 20 % 3 + 1 as int) AS c2").distinct()
    return grid.eligible_bands(c.withColumn("hidden", F.expr("row % 11 = 3 OR col = 6")), bands, seeds, ["sheet"]).select("sheet", "name", "n_rows", "n_cols")
