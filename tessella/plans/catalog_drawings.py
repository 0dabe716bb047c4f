"""Queries of anchors, visibility, previews, notes, recognition and slide checks, with DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry, names
from ..operators import drawings, graph, pages, ranges, recognition
from .catalog import CELLS, cells, query, t

_TRACKS = """xs AS (SELECT p_partkey - 1 AS line, CAST(p_size AS DOUBLE) AS size, CAST(sum(p_size) OVER (ORDER BY p_partkey) - p_size AS DOUBLE) AS start FROM part),
  ys AS (SELECT c_custkey - 1 AS line, CAST(10 + c_custkey % 13 AS DOUBLE) AS size, CAST(sum(10 + c_custkey % 13) OVER (ORDER BY c_custkey) - (10 + c_custkey % 13) AS DOUBLE) AS start FROM customer)"""


@query(
    f"""WITH {_TRACKS}, d AS (SELECT o_orderkey AS id, o_orderkey % 100 AS c1, (o_orderkey + o_custkey % 9) % 100 AS c2, o_orderkey * 3 % 100 AS r1, (o_orderkey * 3 + o_custkey % 5) % 100 AS r2, o_orderkey * 7 % 1024 AS dx1, o_orderkey * 5 % 1024 AS dx2, o_orderkey % 256 AS dy1, o_orderkey * 11 % 256 AS dy2, o_orderkey % 2 = 0 AS old FROM orders),
  p AS (SELECT id, a.start + CASE WHEN old THEN a.size * dx1 / 1024.0 ELSE dx1 * 100 / 12700.0 END AS x1, b.start + CASE WHEN old THEN b.size * dx2 / 1024.0 ELSE dx2 * 100 / 12700.0 END AS x2, c.start + CASE WHEN old THEN c.size * dy1 / 256.0 ELSE dy1 * 100 / 12700.0 END AS y1, e.start + CASE WHEN old THEN e.size * dy2 / 256.0 ELSE dy2 * 100 / 12700.0 END AS y2
    FROM d JOIN xs a ON a.line = c1 JOIN xs b ON b.line = c2 JOIN ys c ON c.line = r1 JOIN ys e ON e.line = r2)
  SELECT id, round(least(x1, x2), 6) AS x, round(least(y1, y2), 6) AS y, round(abs(x2 - x1), 6) AS width, round(abs(y2 - y1), 6) AS height FROM p"""
)
def drawing_anchors(spark, sf_dir):
    """Boxes of two-cell anchors, with offsets in EMU or in parts of a cell."""
    xs = t(spark, sf_dir, "part").selectExpr("1 AS sheet", "p_partkey - 1 AS line", "cast(p_size as double) AS size")
    ys = t(spark, sf_dir, "customer").selectExpr("1 AS sheet", "c_custkey - 1 AS line", "cast(10 + c_custkey % 13 as double) AS size")
    tracks = [ranges.prefix_offsets(x, ["sheet"], "line", "size") for x in (xs, ys)]
    old = "o_orderkey % 2 = 0"
    offset = lambda n: f"if({old}, {n}, {n} * 100)"
    d = t(spark, sf_dir, "orders").selectExpr("1 AS sheet", "o_orderkey AS id", "o_orderkey % 100 AS c1", f"{offset('o_orderkey * 7 % 1024')} AS dx1", "(o_orderkey + o_custkey % 9) % 100 AS c2", f"{offset('o_orderkey * 5 % 1024')} AS dx2", "o_orderkey * 3 % 100 AS r1", f"{offset('o_orderkey % 256')} AS dy1", "(o_orderkey * 3 + o_custkey % 5) % 100 AS r2", f"{offset('o_orderkey * 11 % 256')} AS dy2", f"{old} AS old")
    out = drawings.anchored(d, *tracks, ["sheet"])
    return out.select("id", *[F.round(c, 6).alias(c) for c in ("x", "y", "width", "height")])


@query(
    """WITH c AS (SELECT p_partkey, (p_size - 5) * 700 / 65536.0::DOUBLE AS a, p_size * 600 / 65536.0::DOUBLE AS b, CASE WHEN p_partkey % 4 > 0 THEN p_partkey % 300 + 1 END AS ow, p_size * 20.0::DOUBLE AS w, CASE WHEN p_partkey % 7 = 0 THEN 0.0 ELSE 300.5 END::DOUBLE AS h, 1 + p_partkey % 3 AS u FROM part),
  s AS (SELECT *, a >= 0 AND a + b < 1 AND ceil(a * 640) < floor((1 - b) * 640) AS fine, CASE WHEN ow IS NULL THEN greatest(1, floor(w * (96.0::DOUBLE / 72.0::DOUBLE * u) + 0.5)) ELSE greatest(1, ow) END AS pw, greatest(1, floor(h * (CASE WHEN ow IS NULL THEN 96.0::DOUBLE / 72.0::DOUBLE * u ELSE ow / w END) + 0.5)) AS ph FROM c)
  SELECT p_partkey, CASE WHEN fine THEN CAST(ceil(a * 640) AS INT) END AS first, CASE WHEN fine THEN CAST(floor((1 - b) * 640) AS INT) END AS "end", CASE WHEN h <= 0 THEN 'INVALID_DOCUMENT' WHEN pw * ph > 1500000 THEN 'PIXEL_LIMIT_EXCEEDED' END AS error,
  CASE WHEN h > 0 AND pw * ph <= 1500000 THEN CAST(pw AS BIGINT) END AS width, CASE WHEN h > 0 AND pw * ph <= 1500000 THEN CAST(ph AS BIGINT) END AS height FROM s"""
)
def old_crops(spark, sf_dir):
    """Crops of old files, in parts of 65536, and the pixels of rendered pages."""
    p = t(spark, sf_dir, "part")
    c = geometry.crop(F.expr("(p_size - 5) * 700"), F.expr("p_size * 600"), F.lit(640), 65536)
    size = geometry.render_size(F.expr("p_size * 20.0D"), F.expr("if(p_partkey % 7 = 0, 0.0D, 300.5D)"), F.expr("if(p_partkey % 4 > 0, p_partkey % 300 + 1, null)"), F.expr("1 + p_partkey % 3"), 1_500_000)
    return p.select("p_partkey", c["first"].alias("first"), c["end"].alias("end"), size["error"].alias("error"), size["width"].alias("width"), size["height"].alias("height"))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey AS part, CASE WHEN l_suppkey % 6 = 0 THEN 'DRAWING_POSITION_UNKNOWN' END AS warning FROM lineitem
  WHERE l_partkey % 5 <> 0 AND (l_suppkey % 6 = 0 OR (l_orderkey % 40 % 7 <> 0 AND l_partkey % 30 % 11 <> 3))"""
)
def visible_drawings(spark, sf_dir):
    """Drawings that are neither hidden nor begin in a hidden row or column."""
    d = t(spark, sf_dir, "lineitem").selectExpr("1 AS sheet", "l_orderkey", "l_linenumber", "l_partkey AS part", "l_partkey % 5 = 0 AS hidden", "if(l_suppkey % 6 = 0, null, l_orderkey % 40) AS row", "if(l_suppkey % 6 = 0, null, l_partkey % 30) AS col")
    lines = lambda n, cond: spark.range(n).where(cond).selectExpr("1 AS sheet", "id AS line")
    out = drawings.visible(d, lines(40, "id % 7 = 0"), lines(30, "id % 11 = 3"), ["sheet"])
    return out.select("l_orderkey", "l_linenumber", "part", "warning")


@query(
    """SELECT conv_id, turn, role, CASE WHEN turn % 4 = 1 OR conv_id % 5 = 0 THEN '' ELSE coalesce(text, '') END AS shown, NOT (conv_id % 3 = 0 AND turn % 2 = 0 AND conv_id % 7 > 0) AS content FROM conversations"""
)
def shown_runs(spark, sf_dir):
    """Text of slides without struck runs, headers and footers; cells that a preview shows."""
    text = drawings.shown_text(F.col("text"), F.expr("turn % 4 = 1"), F.expr("if(conv_id % 5 = 0, element_at(array('hdr', 'ftr', 'dt', 'sldNum'), cast(turn % 4 + 1 as int)), 'body')"))
    content = drawings.has_content(F.expr("if(conv_id % 3 = 0, 'BLANK', 'STRING')"), F.expr("turn % 2 = 1"), F.lit(False), F.expr("conv_id % 7 = 0"), F.lit(None).cast("boolean"))
    return t(spark, sf_dir, "conversations").select("conv_id", "turn", "role", text.alias("shown"), content.alias("content"))


#: Exchanges (status, Retry-After, state, bytes, seconds) and how they end.
_POLL = (200, None, "running", 10, 1.0)
EXCHANGES = [
    ([(202, None, None, 0, 1.0), _POLL, (200, None, "succeeded", 9, 1.0)], "succeeded"), ([(202, "9", None, 0, 1.0), _POLL], "pending"), ([(401, None, None, 0, 1.0)], "OCR_AUTHENTICATION_FAILED"), ([(429, "1", None, 0, 1.0)] * 2 + [(202, None, None, 0, 1.0), (200, None, "failed", 0, 1.0)], "OCR_ANALYSIS_FAILED"),
    ([(429, None, None, 0, 1.0)] * 3, "OCR_RATE_LIMITED"), ([(503, "99", None, 0, 1.0)] * 3, "OCR_SERVICE_UNAVAILABLE"), ([(202, None, None, 0, 1.0), (503, "0", None, 0, 1.0), _POLL, (200, "x", "odd", 0, 1.0)], "OCR_INVALID_RESPONSE"), ([(302, None, None, 0, 1.0)], "OCR_UNSAFE_RESPONSE"),
    ([(202, None, None, 9 << 20, 1.0)], "OCR_RESPONSE_LIMIT"), ([(202, None, None, 0, 61.0)], "OCR_TIMEOUT"), ([(202, "10", None, 0, 30.0), (200, "10", "notStarted", 0, 15.0)], "OCR_TIMEOUT"), ([(202, "1", None, 0, 0.1), *[(200, "1", "running", 0, 0.1)] * 40, (200, "1", "succeeded", 0, 0.1)], "succeeded"),
    ([(202, "1", None, 0, 0.1), *[(200, "1", "running", 0, 0.1)] * 60], "OCR_TIMEOUT"), ([], "pending"),
]
_ENDS = "[" + ", ".join(f"'{e}'" for _, e in EXCHANGES) + "]"


@query(
    f"""SELECT event_id, {_ENDS}[event_id % {len(EXCHANGES)} + 1] AS outcome, CASE WHEN event_id % 3 = 0 THEN ['wait', '503 CONVERSION_BUSY', '503 CONVERSION_BUSY', '429 BUSY'][user_id % 4 + 1] END AS admission, CASE event_id % 5 WHEN 0 THEN 180 WHEN 1 THEN 30 WHEN 4 THEN 210 END AS timeout FROM events"""
)
def recognition_outcomes(spark, sf_dir):
    """How exchanges with a recognition service end, who waits for a busy service, and for how long."""
    kind = "array<struct<status:int,retry:string,state:string,bytes:long,seconds:double>>"
    rows = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(EXCHANGES)], f"k int, answers {kind}")
    e = t(spark, sf_dir, "events").withColumn("k", (F.col("event_id") % len(EXCHANGES)).cast("int")).join(F.broadcast(rows), "k")  # a row for each kind of exchange
    app = F.element_at(F.array(*[F.lit(a) for a in recognition.BUSY]), F.expr("cast(user_id % 4 + 1 as int)"))
    setting = F.expr("element_at(array(' ', '30', '0', '211', '210'), cast(event_id % 5 + 1 as int))")
    return e.select("event_id", recognition.outcome(F.col("answers"), 60.0).alias("outcome"), recognition.admission(app, F.expr("event_id % 3 = 0")).alias("admission"), recognition.timeout(setting).alias("timeout"))


@query(
    """WITH RECURSIVE r AS (SELECT o_custkey % 50 AS doc, CAST(NULL AS BIGINT) AS source, o_orderkey % 31 AS target, o_orderkey AS pos FROM orders WHERE o_orderkey % 5 = 0 UNION ALL SELECT o_custkey % 50, o_orderkey % 31, (o_orderkey % 31) + 1 + o_orderkey % 3, o_orderkey FROM orders WHERE o_orderkey % 5 <> 0),
  w(doc, node, path) AS (SELECT doc, target, [min(pos)] FROM r WHERE source IS NULL GROUP BY 1, 2 UNION SELECT w.doc, r.target, min(list_append(w.path, r.pos)) FROM w JOIN r ON r.doc = w.doc AND r.source = w.node AND len(w.path) < 12 GROUP BY w.doc, r.target, len(w.path)),
  b AS (SELECT doc, node, arg_min(path, (len(path), path)) AS path FROM w GROUP BY 1, 2)
  SELECT doc, node, CAST(row_number() OVER (PARTITION BY doc ORDER BY len(path), path, node) AS BIGINT) AS number FROM b"""
)
def note_order(spark, sf_dir):
    """Notes numbered in the order of their first reference, notes of notes after them."""
    o = t(spark, sf_dir, "orders")
    body = o.where("o_orderkey % 5 = 0").selectExpr("o_custkey % 50 AS doc", "cast(null as long) AS source", "o_orderkey % 31 AS target", "o_orderkey AS pos")
    rest = o.where("o_orderkey % 5 <> 0").selectExpr("o_custkey % 50 AS doc", "o_orderkey % 31 AS source", "o_orderkey % 31 + 1 + o_orderkey % 3 AS target", "o_orderkey AS pos")
    return graph.in_reference_order(body.unionByName(rest), ["doc"]).select("doc", "node", "number")


@query(
    """WITH RECURSIVE i AS (SELECT user_id % 60 AS sheet, event_id AS id, CAST(event_id % 900 AS DOUBLE) AS x, CAST(event_id * 3 % 700 AS DOUBLE) AS y FROM events),
  l AS (SELECT sheet, lag(id) OVER w AS a, id AS b, row_number() OVER w % 4 <> 1 AS joined FROM i WINDOW w AS (PARTITION BY sheet ORDER BY id)), own AS (SELECT sheet, a, b FROM l WHERE joined AND a IS NOT NULL),
  g AS (SELECT sheet, -id - 1 AS id, id AS item, CASE WHEN id % 2 = 0 THEN 40 ELSE 130 END AS side FROM i WHERE id % 10 = 0), tch AS (SELECT sheet, id AS region, item FROM g UNION SELECT g.sheet, g.id, i2.id FROM g JOIN (SELECT sheet, id, lead(id, 4) OVER (PARTITION BY sheet ORDER BY id) AS far FROM i) f ON f.id = g.item JOIN i i2 ON i2.id = f.far),
  e1 AS (SELECT sheet, a, b FROM own UNION SELECT sheet, b, a FROM own UNION SELECT sheet, region, item FROM tch UNION SELECT sheet, item, region FROM tch),
  w1(sheet, node, root) AS (SELECT sheet, id, id FROM i UNION SELECT sheet, id, id FROM g UNION SELECT w.sheet, e.b, w.root FROM w1 w JOIN e1 e ON e.sheet = w.sheet AND e.a = w.node), c1 AS (SELECT sheet, node, min(root) AS root FROM w1 GROUP BY 1, 2),
  boxes AS (SELECT c.sheet, c.root, (side + 1) * (side + 1) AS cells, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y, 50.0::DOUBLE AS w, 50.0::DOUBLE AS h FROM c1 c JOIN g ON g.id = c.node UNION ALL SELECT c.sheet, c.root, NULL, x, y, 20, 10 FROM c1 c JOIN i ON i.id = c.node),
  big AS (SELECT sheet, root FROM boxes GROUP BY 1, 2 HAVING sum(cells) > 10000 OR ceil((max(x + w) - min(x) + 6) * 96 / 72) * ceil((max(y + h) - min(y) + 6) * 96 / 72) > 1000000),
  safe AS (SELECT g.sheet, g.id FROM g JOIN c1 c ON c.node = g.id ANTI JOIN big b ON b.sheet = c.sheet AND b.root = c.root),
  e2 AS (SELECT sheet, a, b FROM own UNION SELECT sheet, b, a FROM own UNION SELECT t.sheet, region, item FROM tch t SEMI JOIN safe s ON s.id = t.region UNION SELECT t.sheet, item, region FROM tch t SEMI JOIN safe s ON s.id = t.region),
  w2(sheet, node, root) AS (SELECT sheet, id, id FROM i UNION SELECT sheet, id, id FROM safe UNION SELECT w.sheet, e.b, w.root FROM w2 w JOIN e2 e ON e.sheet = w.sheet AND e.a = w.node),
  c2 AS (SELECT sheet, node, min(CASE WHEN root >= 0 THEN root END) AS root FROM w2 GROUP BY 1, 2)
  SELECT sheet, node AS id, CASE WHEN node < 0 THEN 'region' ELSE 'item' END AS kind, root FROM c2"""
)
def preview_groups(spark, sf_dir):
    """Drawings of one preview: linked ones and those that touch a cell region, unless its preview is too large."""
    from pyspark.sql import Window

    i = t(spark, sf_dir, "events").selectExpr("user_id % 60 AS sheet", "event_id AS id", "cast(event_id % 900 as double) AS x", "cast(event_id * 3 % 700 as double) AS y", "20.0D AS width", "10.0D AS height")
    w = Window.partitionBy("sheet").orderBy("id")
    near = i.select("sheet", F.lag("id").over(w).alias("a"), F.col("id").alias("b"), (F.row_number().over(w) % 4 != 1).alias("joined"), F.lead("id", 4).over(w).alias("far"))
    near = graph.settled(near)
    g = i.where("id % 10 = 0").selectExpr("sheet", "-id - 1 AS id", "0 AS r1", "if(id % 2 = 0, 40, 130) AS r2", "0 AS c1", "if(id % 2 = 0, 40, 130) AS c2", "0.0D AS x", "0.0D AS y", "50.0D AS width", "50.0D AS height")
    held = near.where("b % 10 = 0")
    touching = held.selectExpr("sheet", "-b - 1 AS region", "b AS item").unionByName(held.where("far is not null").selectExpr("sheet", "-b - 1 AS region", "far AS item"))
    out = drawings.grouped(i, near.where("joined AND a IS NOT NULL").select("sheet", "a", "b"), g, touching, 1_000_000, ["sheet"])
    return out.select("sheet", "id", "kind", F.col("root.id").alias("root"))


@query(
    """WITH e AS (SELECT CASE WHEN event_id % 97 <> 0 THEN user_id % 20 END AS slide, event_id AS ord, event_type AS tag, event_id % 3 > 0 AS vis, event_id % 1300 - 3 AS l, event_id * 7 % 730 - 3 AS t, user_id % 40 AS w, user_id % 30 AS h FROM events),
  f AS (SELECT CASE WHEN slide IS NULL THEN 'CONTENT_OUTSIDE_SLIDES' WHEN l < -2 OR t < -2 OR l + w > 1282 OR t + h > 722 THEN 'SLIDE_OVERFLOW' END AS code, slide, ord, tag FROM e WHERE vis AND w > 0 AND h > 0)
  SELECT * FROM f WHERE code IS NOT NULL ORDER BY slide NULLS FIRST, ord LIMIT 20"""
)
def slide_issues(spark, sf_dir):
    """The first issues of a deck: content outside of slides, elements that leave them."""
    e = t(spark, sf_dir, "events").selectExpr("if(event_id % 97 <> 0, user_id % 20, null) AS slide", "event_id AS ord", "event_type AS tag", "event_id % 3 > 0 AS visible", "event_id % 1300 - 3 AS left", "event_id * 7 % 730 - 3 AS top", "event_id % 1300 - 3 + user_id % 40 AS right", "event_id * 7 % 730 - 3 + user_id % 30 AS bottom")
    slides = spark.range(20).selectExpr("id AS slide", "0 AS left", "0 AS top", "1280 AS right", "720 AS bottom")
    return drawings.slide_issues(e, slides)


@query(
    """SELECT l_orderkey AS tbl, l_linenumber AS row, l_partkey AS col, CAST(greatest(1, floor(l_quantity / 3.0::DOUBLE * 9525 + 0.5)) AS BIGINT) AS height, CAST(floor(l_partkey % 9 / 4.0::DOUBLE * 9525 + 0.5) AS BIGINT) AS top, CAST(0 AS BIGINT) AS "right", CASE WHEN l_suppkey % 4 > 0 AND 100 * (10 + l_partkey % 6) <= 75 * (12 + l_suppkey % 7) + 0.5 THEN CAST(floor(l_suppkey % 4 * 5.5::DOUBLE * 75 + 0.5) AS BIGINT) END AS spacing FROM lineitem"""
)
def table_patches(spark, sf_dir):
    """Heights, margins and line spacing that a slide's tables take from their layout."""
    li = t(spark, sf_dir, "lineitem")
    cells = li.selectExpr("struct(l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS tbl", "l_linenumber AS row", "l_partkey AS col", "array(l_partkey % 9 / 4.0D, -1.0D) AS margins", "l_suppkey % 4 * 5.5D AS line", "12 + l_suppkey % 7 AS font", "100 * (10 + l_partkey % 6) AS most")
    rows = li.selectExpr("struct(l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate) AS tbl", "l_linenumber AS row", "cast(l_quantity as double) / 3.0D AS height").distinct()
    out = drawings.table_patches(rows, cells)
    return out.select(F.col("tbl.l_orderkey").alias("tbl"), "row", "col", "height", F.get("margins", 0).alias("top"), F.get("margins", 1).alias("right"), "spacing")


@query(
    """WITH d AS (SELECT doc_id, 'images/image-' || lpad(CAST(doc_id AS VARCHAR), 6, '0') || CASE doc_id % 3 WHEN 0 THEN '.png' WHEN 1 THEN '.emf' ELSE '.JPG' END AS path, sha256(text) AS sha, strlen(text) AS size, lang <> 'es' AS ok, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN ' ' ELSE source END AS said FROM documents),
  s AS (SELECT *, CASE WHEN NOT ok THEN 'skipped' WHEN said IS NULL THEN 'notRequested' WHEN trim(said) = '' THEN 'noText' ELSE 'succeeded' END AS status FROM d)
  SELECT doc_id, '{"type":"compositeImage","section":"One","path":"' || path || '","sourceImages":[{"sha256":"' || sha || '","sizeBytes":' || size || ',"ocr":{"status":"' || status || '"}}]}' AS block,
  CASE WHEN doc_id % 3 = 1 THEN '' ELSE '!' END || '[図形](' || path || ')' || CASE WHEN status = 'succeeded' THEN chr(10) || chr(10) || '画像内の文字（OCR）:' || chr(10) || chr(10) || said ELSE '' END AS markdown FROM s"""
)
def image_blocks(spark, sf_dir):
    """Blocks of images with their sources and recognised texts."""
    d = t(spark, sf_dir, "documents")
    path = F.concat(F.format_string("images/image-%06d", "doc_id"), F.expr("element_at(array('.png', '.emf', '.JPG'), cast(doc_id % 3 + 1 as int))"))
    said = F.expr("CASE doc_id % 4 WHEN 0 THEN null WHEN 1 THEN ' ' ELSE source END")
    block, md = drawings.image_block(F.lit("compositeImage"), path, F.lit("One"), F.sha2("text", 256), F.octet_length("text"), F.expr("lang <> 'es'"), said)
    return d.select("doc_id", block.alias("block"), md.alias("markdown"))


@query(
    """WITH d AS (SELECT doc_id, text, doc_id % 6 AS k FROM documents)
  SELECT doc_id, CASE k WHEN 0 THEN 'png' WHEN 1 THEN CASE WHEN strlen(text) + 3 <= 4000 THEN 'jpeg' END END AS kind, CAST(CASE k WHEN 0 THEN CASE WHEN strlen(text) + 8 <= 4000 THEN strlen(text) + 8 END WHEN 1 THEN CASE WHEN strlen(text) + 3 <= 4000 THEN strlen(text) + 3 END END AS INT) AS size,
  CASE k WHEN 0 THEN CASE WHEN strlen(text) + 8 > 4000 THEN 'IMAGE_BYTES_LIMIT' END WHEN 1 THEN CASE WHEN strlen(text) + 3 > 4000 THEN 'IMAGE_BYTES_LIMIT' END WHEN 2 THEN 'UNSUPPORTED_IMAGE' WHEN 3 THEN 'INVALID_BASE64' WHEN 4 THEN CASE WHEN strlen(text) > 4000 THEN 'IMAGE_BYTES_LIMIT' WHEN strlen(text) = 0 THEN 'INVALID_BASE64' ELSE 'CONTENT_MISMATCH' END ELSE 'UNSUPPORTED_IMAGE' END AS error
  FROM (SELECT * REPLACE (CASE WHEN k = 0 AND strlen(text) + 8 > 4000 THEN 9 ELSE k END AS k), k AS k0 FROM d) WHERE k <> 9 UNION ALL SELECT doc_id, NULL, NULL, 'IMAGE_BYTES_LIMIT' FROM d WHERE k = 0 AND strlen(text) + 8 > 4000"""
)
def data_images(spark, sf_dir):
    """Images in data: addresses: kind, bytes and what is wrong with them."""
    text = F.col("text").cast("binary")
    coded = lambda lead: F.base64(F.concat(F.unhex(F.lit(lead)), text))
    uri = (
        F.when(F.col("k") == 0, F.concat(F.lit("data:image/png;base64,"), coded("89504E470D0A1A0A"))).when(F.col("k") == 1, F.concat(F.lit("data:image/jpeg;base64,"), coded("FFD8FF")))
        .when(F.col("k") == 2, F.concat(F.lit("data:image/svg+xml;base64,"), F.base64(text))).when(F.col("k") == 3, F.lit("data:image/gif;base64,*?*")).when(F.col("k") == 4, F.concat(F.lit("data:image/gif;base64,"), F.base64(text))).otherwise(F.lit("https://x.example/a.png"))
    )
    d = t(spark, sf_dir, "documents").withColumn("k", F.col("doc_id") % 6)
    return d.select("doc_id", names.data_image(uri, 4000).alias("i")).select("doc_id", "i.kind", F.col("i.size").cast("int").alias("size"), "i.error")


@query(
    f"""WITH {CELLS}, tb AS (SELECT DISTINCT sheet, row // 12 AS ord, row // 12 * 12 AS r1, row // 12 * 12 + 6 AS r2, 1 AS c1, 4 AS c2 FROM cells), d AS (SELECT CAST(p_partkey % 16 AS INT) AS sheet, p_partkey AS id, p_partkey * 3 % 900 AS r1, p_partkey * 3 % 900 + p_size AS r2, p_partkey % 7 AS c1, p_partkey % 7 + 1 AS c2 FROM part)
  SELECT d.sheet, id, CAST(max(ord) AS INT) AS after FROM d LEFT JOIN tb ON tb.sheet = d.sheet AND tb.r1 <= d.r2 AND d.r1 <= tb.r2 AND tb.c1 <= d.c2 AND d.c1 <= tb.c2 GROUP BY d.sheet, id"""
)
def pinned_drawings(spark, sf_dir):
    """The last table that each drawing overlaps: it is placed after it."""
    tables = cells(spark, sf_dir).selectExpr("sheet", "cast(row div 12 as int) AS ord", "cast(row div 12 * 12 as int) AS r1", "cast(row div 12 * 12 + 6 as int) AS r2", "1 AS c1", "4 AS c2").distinct()
    d = t(spark, sf_dir, "part").selectExpr("cast(p_partkey % 16 as int) AS sheet", "p_partkey AS id", "p_partkey * 3 % 900 AS r1", "p_partkey * 3 % 900 + p_size AS r2", "p_partkey % 7 AS c1", "p_partkey % 7 + 1 AS c2")
    return drawings.pinned(d, tables, ["sheet"]).select("sheet", "id", "after")


@query(
    """WITH RECURSIVE s AS (SELECT event_id AS id, user_id % 40 AS page, event_id % 3 AS reference, event_id * 13 % 1900 AS x, event_id * 7 % 1300 AS y, user_id % 50 + 5 AS w, user_id % 30 + 5 AS h, event_id % 4 = 0 AS behind, event_id * 31 % 17 AS z FROM events),
  e AS (SELECT a.id AS u, b.id AS v FROM s a JOIN s b ON a.page = b.page AND a.reference = b.reference AND a.id <> b.id AND a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h),
  walk(n, root) AS (SELECT id, id FROM s UNION SELECT e.v, w.root FROM walk w JOIN e ON e.u = w.n), c AS (SELECT n, min(root) AS root FROM walk GROUP BY n)
  SELECT page, reference, id, root, CAST(row_number() OVER (PARTITION BY root ORDER BY behind DESC, z, id) AS INT) AS paint FROM s JOIN c ON c.n = s.id"""
)
def merged_scopes(spark, sf_dir):
    """Drawings that overlap and agree in page and reference are painted as one."""
    s = t(spark, sf_dir, "events").selectExpr("event_id AS id", "user_id % 40 AS page", "event_id % 3 AS reference", "event_id * 13 % 1900 AS x", "event_id * 7 % 1300 AS y", "user_id % 50 + 5 AS w", "user_id % 30 + 5 AS h", "event_id % 4 = 0 AS behind", "event_id * 31 % 17 AS z")
    return drawings.merged_scopes(s, ["page", "reference"])


def _cut(name: str, axis: str, most: int) -> str:
    """SQL of the pages along an axis of the tables lines and blocks."""
    stop = lambda at: f"(SELECT CASE WHEN n.last <= {at} + {most} THEN n.last ELSE coalesce((SELECT max(b.s) FROM blocks b WHERE b.sheet = n.sheet AND b.axis = '{axis}' AND b.e - b.s <= {most} AND b.s > {at} AND b.s < g.nat AND b.e > g.nat), g.nat) END FROM (SELECT coalesce((SELECT max(l.e) FROM lines l WHERE l.sheet = n.sheet AND l.axis = '{axis}' AND l.e > {at} AND l.e <= {at} + {most}), {at} + {most}) AS nat) g)"
    return f"""{name}e AS (SELECT sheet, max(e) AS last FROM lines WHERE axis = '{axis}' GROUP BY sheet), {name}(sheet, page, s, e) AS (SELECT n.sheet, 0, 0.0::DOUBLE, CAST({stop('0')} AS DOUBLE) FROM {name}e n
  UNION ALL SELECT c.sheet, c.page + 1, c.e, CAST({stop('c.e')} AS DOUBLE) FROM {name} c JOIN {name}e n ON n.sheet = c.sheet WHERE c.e < n.last)"""


@query(
    f"""WITH RECURSIVE {CELLS}, sized AS (SELECT DISTINCT sheet, 'y' AS axis, row AS line, 10 + row % 5 AS size FROM cells UNION SELECT DISTINCT sheet, 'x', col, 30 + col % 3 * 10 FROM cells), lines AS (SELECT sheet, axis, line, CAST(sum(size) OVER w - size AS DOUBLE) AS s, CAST(sum(size) OVER w AS DOUBLE) AS e, lead(line, 2) OVER w AS far FROM sized WINDOW w AS (PARTITION BY sheet, axis ORDER BY line)),
  spans AS (SELECT a.sheet, a.axis, a.s, b.e FROM lines a JOIN lines b ON b.sheet = a.sheet AND b.axis = a.axis AND b.line = a.far WHERE a.line % 7 IN (0, 2) AND b.e - a.s <= CASE a.axis WHEN 'x' THEN 120 ELSE 200 END),
  marked AS (SELECT *, CASE WHEN s >= coalesce(max(e) OVER (PARTITION BY sheet, axis ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s) THEN 1 ELSE 0 END AS new FROM spans), numbered AS (SELECT *, sum(new) OVER (PARTITION BY sheet, axis ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM marked),
  blocks AS (SELECT sheet, axis, min(s) AS s, max(e) AS e FROM numbered GROUP BY sheet, axis, k), {_cut("cx", "x", 120)}, {_cut("cy", "y", 200)}
  SELECT cy.sheet, CAST(row_number() OVER (PARTITION BY cy.sheet ORDER BY cy.page, cx.page) AS INT) AS number, cx.s AS x, cy.s AS y, cx.e - cx.s AS width, cy.e - cy.s AS height FROM cy JOIN cx ON cx.sheet = cy.sheet"""
)
def range_pages(spark, sf_dir):
    """Pages of each sheet in both axes, which merged rows and columns do not cross if they fit."""
    from pyspark.sql import Window

    c = cells(spark, sf_dir)
    rows = c.selectExpr("sheet", "'y' AS axis", "row AS line", "10 + row % 5 AS size").distinct()
    lines = rows.unionByName(c.selectExpr("sheet", "'x' AS axis", "col AS line", "30 + col % 3 * 10 AS size").distinct())
    far = F.lead("line", 2).over(Window.partitionBy("sheet", "axis").orderBy("line"))
    merges = lines.select("sheet", "axis", F.col("line").alias("first"), far.alias("last")).where("last IS NOT NULL AND first % 7 IN (0, 2)")
    return pages.planned(lines, merges, ["sheet"], {"x": 120.0, "y": 200.0})
