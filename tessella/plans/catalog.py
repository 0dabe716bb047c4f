"""Queries of the reference's own operators over whole tables, each with DuckDB SQL.

Cells come from lineitem: sheet = orderkey % 16, row = orderkey div 16, col =
linenumber, value = the summed quantity (the pair of keys is not unique).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import shared
from ..functions import geometry, markdown, names, urls
from ..operators import blocks, effects, graph, grid, jobs, ordered, ranges

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


CELLS = """cells AS (SELECT CAST(l_orderkey % 16 AS INT) AS sheet, CAST(l_orderkey // 16 AS INT) AS row, CAST(l_linenumber AS INT) AS col,
  CAST(CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS VARCHAR) AS value FROM lineitem GROUP BY 1, 2, 3)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = t(spark, sf_dir, "lineitem").selectExpr("cast(l_orderkey % 16 as int) AS sheet", "cast(l_orderkey div 16 as int) AS row", "cast(l_linenumber as int) AS col", "cast(l_quantity as bigint) AS q")
    return keys.groupBy("sheet", "row", "col").agg(F.sum("q").cast("string").alias("value"))


# Merges: on every fifth row, columns 2..3; on every seventh, columns 1..2 over two rows.
MERGES = """merges AS (SELECT DISTINCT sheet, row AS r1, row AS r2, 2 AS c1, 3 AS c2 FROM cells WHERE row % 5 = 0 AND row % 35 NOT IN (0, 1)
  AND row % 7 NOT IN (0, 1) UNION ALL SELECT DISTINCT sheet, row AS r1, row + 1 AS r2, 1 AS c1, 2 AS c2 FROM cells WHERE row % 7 = 0)"""


def merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir)
    wide = c.where("row % 5 = 0 AND row % 7 NOT IN (0, 1)").selectExpr("sheet", "row AS r1", "row AS r2", "2 AS c1", "3 AS c2").distinct()
    return wide.unionByName(c.where("row % 7 = 0").selectExpr("sheet", "row AS r1", "row + 1 AS r2", "1 AS c1", "2 AS c2").distinct())


ESC = r"""regexp_replace(replace(replace(replace(regexp_replace(replace(regexp_replace({x}, '\r\n?', chr(10), 'g'), chr(0), ''),
  '([\\`*_\[\]|#!{{}}~+\-])', '\\\1', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '(?m)^(\d+)\.(\s|$)', '\1\\.\2', 'g')"""


@query(
    rf"""WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
  e AS (SELECT doc_id, pos, {ESC.format(x="line")} AS md FROM lines WHERE trim(line) <> '')
  SELECT doc_id, CAST(pos AS INT) AS pos, CAST(2 * row_number() OVER w - 1 AS BIGINT) AS start_line, CAST(2 * row_number() OVER w - 1 AS BIGINT) AS end_line,
  CAST(strlen(md) AS INT) AS n_bytes, sha256(md) AS sha256 FROM e WINDOW w AS (PARTITION BY doc_id ORDER BY pos)"""
)
def md_escape_lines(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).where(F.trim("line") != "")
    b = d.select("doc_id", "pos", markdown.escape(F.col("line")).alias("markdown"), F.lit("paragraph").alias("kind"), F.col("pos").alias("row"), F.lit(0).alias("col"), F.lit(0).alias("ord"))
    out = blocks.placed(b, ["doc_id"])
    return out.select("doc_id", "pos", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"), F.octet_length("markdown").alias("n_bytes"), F.sha2("markdown", 256).alias("sha256"))


@query(
    rf"""SELECT page_id, label, CASE WHEN regexp_full_match(url, '(?i)https?://[^/?#@\s]+([/?#][^<>"{{}}|^`]*)?') THEN
  '[' || label || '](' || replace(replace(replace(url, ' ', '%20'), '(', '%28'), ')', '%29') || ')' ELSE label END AS link
  FROM (SELECT page_id, url, CASE WHEN e = '' THEN '' WHEN regexp_matches(e, '^[\p{{L}}\p{{Nd}}]') AND regexp_matches(e, '[\p{{L}}\p{{Nd}}]$') THEN '**' || e || '**' ELSE '<strong>' || e || '</strong>' END AS label
  FROM (SELECT page_id, url, {ESC.format(x="split_part(url, '/', 4) || ' ' || split_part(url, '/', 3)")} AS e FROM pages))"""
)
def md_bold_links(spark, sf_dir):
    p = t(spark, sf_dir, "pages")
    part = lambda i: F.split_part(F.col("url"), F.lit("/"), F.lit(i))
    label = markdown.bold(markdown.escape(F.concat(part(4), F.lit(" "), part(3))))
    return p.select("page_id", label.alias("label"), markdown.link(label, F.col("url")).alias("link"))


@query(
    """WITH f AS (SELECT lang AS category, sha256(text) AS sha256, min(doc_id) AS seq, count(*) AS uses, arg_min(lang, doc_id) AS cat FROM documents GROUP BY lang, sha256(text))
  SELECT category, sha256, seq, uses, CAST(row_number() OVER w AS INT) AS number, 'images/' || category || '-' || lpad(CAST(row_number() OVER w AS VARCHAR), CAST(greatest(4, len(CAST(row_number() OVER w AS VARCHAR))) AS INT), '0') || '.bin' AS path
  FROM f WINDOW w AS (PARTITION BY category ORDER BY seq)"""
)
def asset_dedup_number(spark, sf_dir):
    d = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.col("lang").alias("category"), F.col("lang").alias("source_kind"), F.sha2("text", 256).alias("sha256"))
    # Numbers run by category; the source kind is the partition of the content.
    out = blocks.numbered_assets(d.withColumn("section", F.col("category")), ["section"])
    return out.select("category", "sha256", "seq", "uses", F.col("number").cast("int").alias("number"), "path")


@query(
    """SELECT source, to_json({'specVersion': 1, 'source': source, 'sectionCount': count(*), 'markdownBytes': CAST(sum(strlen(text)) AS BIGINT), 'warningCount': CAST(sum(CASE WHEN n_chars > 5000 THEN 1 ELSE 0 END) AS BIGINT)}) AS report,
  CASE WHEN bool_or(n_chars > 5000) THEN 'partial' ELSE 'complete' END AS outcome FROM documents GROUP BY source"""
)
def report_json_per_source(spark, sf_dir):
    d = t(spark, sf_dir, "documents")
    code = F.when(F.col("n_chars") > 5000, "TEXT_LONG").otherwise("RANGE_SCALED")
    r = d.groupBy("source").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b"), F.sum(F.when(F.col("n_chars") > 5000, 1).otherwise(0)).alias("w"), blocks.outcome(code).alias("outcome"))
    report = F.to_json(F.struct(F.lit(1).alias("specVersion"), F.col("source"), F.col("n").alias("sectionCount"), F.col("b").alias("markdownBytes"), F.col("w").alias("warningCount")))
    return r.select("source", report.alias("report"), "outcome")


@query(
    """SELECT doc_id, CAST(sum(strlen(text)) OVER w AS BIGINT) AS total, sum(strlen(text)) OVER w > 200000 AS over FROM documents
  WINDOW w AS (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING)"""
)
def limits_flags(spark, sf_dir):
    return blocks.running_limit(t(spark, sf_dir, "documents"), ["source"], "doc_id", F.octet_length("text"), 200_000).select("doc_id", "total", "over")


@query(
    """WITH s AS (SELECT event_id, user_id % 40 AS section, event_type || ':' || CAST(CAST(floor(value) AS BIGINT) % 50 AS VARCHAR) AS k FROM events),
  f AS (SELECT *, row_number() OVER (PARTITION BY section, k ORDER BY event_id) = 1 AS first FROM s),
  n AS (SELECT *, sum(CASE WHEN first THEN 1 ELSE 0 END) OVER (PARTITION BY section ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS n FROM f)
  SELECT section, CAST(sum(CASE WHEN first AND n <= 30 THEN 1 ELSE 0 END) AS BIGINT) AS kept, CAST(sum(CASE WHEN n > 30 OR (n = 30 AND NOT first) THEN 1 ELSE 0 END) AS BIGINT) AS omitted FROM n GROUP BY section"""
)
def diagnostic_dedup_cap(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 40).alias("section"), "event_type", (F.floor("value") % 50).alias("m"))
    return blocks.capped_diagnostics(e, ["section"], ["event_type", "m"], "event_id", 30)


@query(f"WITH {CELLS} SELECT * FROM cells WHERE row % 11 <> 3 AND col <> 6 AND value <> ''")
def grid_cells(spark, sf_dir):
    return cells(spark, sf_dir).where("row % 11 <> 3 AND col <> 6 AND value <> ''")


@query(
    f"""WITH {CELLS}, {MERGES}, hid AS (SELECT c.sheet, c.row, c.col FROM cells c JOIN merges m ON c.sheet = m.sheet AND c.row BETWEEN r1 AND r2 AND c.col BETWEEN c1 AND c2 AND NOT (c.row = r1 AND c.col = c1))
  SELECT sheet, row, col, value FROM cells c WHERE NOT EXISTS (SELECT 1 FROM hid h WHERE h.sheet = c.sheet AND h.row = c.row AND h.col = c.col)"""
)
def grid_merge_covered(spark, sf_dir):
    c = cells(spark, sf_dir)
    hidden = ranges.covered(c, merges(spark, sf_dir), ["sheet"]).select("sheet", "row", "col")
    return c.join(hidden, ["sheet", "row", "col"], "left_anti")


# Borders: cells are boxed, but for some that lack a side and rows without any.
BORDERED = f"""{CELLS}, bordered AS (SELECT sheet, row, col, value, row % 6 < 4 AS bt, row % 6 < 4 AND (row + col) % 9 <> 0 AS bb, row % 6 < 4 AS bl, row % 6 < 4 AND col % 5 <> 4 AS br FROM cells)"""
SEGS = f"""{BORDERED}, segs AS (SELECT sheet, 'h' AS kind, row, col FROM bordered WHERE bt UNION SELECT sheet, 'h', row + 1, col FROM bordered WHERE bb
  UNION SELECT sheet, 'v', row, col FROM bordered WHERE bl UNION SELECT sheet, 'v', row, col + 1 FROM bordered WHERE br)"""
UNITS = f"""{SEGS}, pts AS (SELECT sheet, row, col FROM segs UNION SELECT sheet, row - 1, col FROM segs WHERE kind = 'h' AND row > 0 UNION SELECT sheet, row, col - 1 FROM segs WHERE kind = 'v' AND col > 0),
  units AS (SELECT p.sheet, p.row, p.col FROM pts p JOIN segs a ON a.sheet = p.sheet AND a.kind = 'h' AND a.row = p.row AND a.col = p.col
  JOIN segs b ON b.sheet = p.sheet AND b.kind = 'h' AND b.row = p.row + 1 AND b.col = p.col JOIN segs c ON c.sheet = p.sheet AND c.kind = 'v' AND c.row = p.row AND c.col = p.col
  JOIN segs d ON d.sheet = p.sheet AND d.kind = 'v' AND d.row = p.row AND d.col = p.col + 1),
  adj AS (SELECT a.sheet, a.row AS ur, a.col AS uc, b.row AS vr, b.col AS vc FROM units a JOIN units b ON a.sheet = b.sheet AND a.row = b.row AND a.col + 1 = b.col
    UNION ALL SELECT a.sheet, a.row, a.col, b.row, b.col FROM units a JOIN units b ON a.sheet = b.sheet AND a.row + 1 = b.row AND a.col = b.col)"""
COMPONENTS = f"""{UNITS}, links AS (SELECT sheet, ur, uc, vr, vc FROM adj UNION ALL SELECT sheet, vr, vc, ur, uc FROM adj),
  walk(sheet, row, col, rr, rc) AS (SELECT sheet, row, col, row, col FROM units UNION SELECT b.sheet, b.vr, b.vc, w.rr, w.rc FROM walk w JOIN links b ON w.sheet = b.sheet AND w.row = b.ur AND w.col = b.uc),
  comp AS (SELECT sheet, row, col, min(rr * 1000 + rc) // 1000 AS root_r, min(rr * 1000 + rc) % 1000 AS root_c FROM walk GROUP BY sheet, row, col)"""
# Accepted tables: closed boxes without vertical borders that stand out above or below.
TABLES = f"""{COMPONENTS}, box0 AS (SELECT sheet, root_r, root_c, count(*) AS n, min(row) AS r1, max(row) AS r2, min(col) AS c1, max(col) AS c2 FROM comp GROUP BY 1, 2, 3),
  box AS (SELECT * FROM box0 WHERE n > 1 AND n = (r2 - r1 + 1) * (c2 - c1 + 1)),
  alone AS (SELECT DISTINCT b.sheet, b.root_r, b.root_c FROM box b JOIN segs s ON s.sheet = b.sheet AND s.kind = 'v' AND s.col BETWEEN b.c1 AND b.c2 + 1 AND (s.row = b.r1 - 1 OR s.row = b.r2 + 1)
    WHERE NOT EXISTS (SELECT 1 FROM comp f WHERE f.sheet = s.sheet AND f.row = s.row AND (f.col = s.col OR f.col + 1 = s.col) AND (f.root_r <> b.root_r OR f.root_c <> b.root_c))),
  tables AS (SELECT b.* FROM box b WHERE NOT EXISTS (SELECT 1 FROM alone a WHERE a.sheet = b.sheet AND a.root_r = b.root_r AND a.root_c = b.root_c))"""


def bordered(spark, sf_dir):
    boxed = "row % 6 < 4"
    return cells(spark, sf_dir).selectExpr("sheet", "row", "col", "value", f"{boxed} AS bt", f"{boxed} AND (row + col) % 9 <> 0 AS bb", f"{boxed} AS bl", f"{boxed} AND col % 5 <> 4 AS br")


def _units(spark, sf_dir, settle=lambda df: df):
    segs = settle(grid.segments(bordered(spark, sf_dir), ["sheet"]))
    none = spark.createDataFrame([], "sheet int, r1 int, r2 int, c1 int, c2 int")
    return segs, grid.units(segs, none, ["sheet"])


@query(f"WITH {SEGS} SELECT * FROM segs")
def border_segments(spark, sf_dir):
    return grid.segments(bordered(spark, sf_dir), ["sheet"])


@query(f"WITH {UNITS} SELECT * FROM adj")
def closed_units_adjacency(spark, sf_dir):
    return grid.adjacent(_units(spark, sf_dir)[1], ["sheet"])


@query(f"WITH RECURSIVE {COMPONENTS} SELECT sheet, row, col, CAST(root_r AS INT) AS root_r, CAST(root_c AS INT) AS root_c FROM comp")
def grid_components(spark, sf_dir):
    return grid.component_of(_units(spark, sf_dir)[1], ["sheet"]).selectExpr("sheet", "r1 AS row", "c1 AS col", "root_r", "root_c")


def _tables(spark, sf_dir):
    segs, units = _units(spark, sf_dir, graph.settled)  # read three times
    return grid.accepted(grid.component_of(units, ["sheet"]), segs, ["sheet"])


@query(f"WITH RECURSIVE {TABLES} SELECT sheet, r1, r2, c1, c2, n FROM tables")
def table_accept(spark, sf_dir):
    return _tables(spark, sf_dir).select("sheet", "r1", "r2", "c1", "c2", "n")


@query(
    f"""WITH RECURSIVE {TABLES}, band AS (SELECT a.sheet, a.r1, a.r2, a.c1, a.c2, coalesce(max(CASE WHEN b.c2 < a.c1 THEN (b.c2 + a.c1) // 2 + 1 END), 0) AS lo, coalesce(min(CASE WHEN b.c1 > a.c2 THEN (a.c2 + b.c1) // 2 END), 16383) AS hi
  FROM tables a JOIN tables b ON a.sheet = b.sheet AND b.r1 <= a.r2 AND a.r1 <= b.r2 GROUP BY 1, 2, 3, 4, 5)
  SELECT c.sheet, c.row, c.col, c.value, r1, r2, c1, c2 FROM cells c JOIN band b ON c.sheet = b.sheet AND c.row BETWEEN r1 AND r2 AND c.col BETWEEN lo AND hi"""
)
def table_expand_band(spark, sf_dir):
    banded = grid.bands(_tables(spark, sf_dir).select("sheet", "r1", "r2", "c1", "c2"), ["sheet"], 16383)
    return grid.owned(cells(spark, sf_dir), banded, ["sheet"])


@query(
    f"""WITH {CELLS}, {MERGES}, n AS (SELECT DISTINCT sheet, 'area_' || CAST(row // 8 AS VARCHAR) AS name, row // 8 * 8 AS r1, row // 8 * 8 + 5 AS r2, 2 AS c1, 5 AS c2 FROM cells),
  ok AS (SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM merges m WHERE m.sheet = n.sheet AND m.r1 <= n.r2 AND n.r1 <= m.r2 AND m.c1 <= n.c2 AND n.c1 <= m.c2 AND NOT (m.r1 >= n.r1 AND m.r2 <= n.r2 AND m.c1 >= n.c1 AND m.c2 <= n.c2)))
  SELECT o.sheet, name, count(*) AS n_cells, CAST(sum(CAST(value AS BIGINT)) AS BIGINT) AS total FROM ok o JOIN cells c ON c.sheet = o.sheet AND c.row BETWEEN r1 AND r2 AND c.col BETWEEN c1 AND c2 GROUP BY 1, 2"""
)
def named_split(spark, sf_dir):
    """Named ranges that cut no merge, with the cells that they hold."""
    c, m = cells(spark, sf_dir), merges(spark, sf_dir)
    n = c.selectExpr("sheet", "concat('area_', row div 8) AS name", "cast(row div 8 * 8 as int) AS r1", "cast(row div 8 * 8 + 5 as int) AS r2", "2 AS c1", "5 AS c2").distinct()
    box = lambda df, s: df.selectExpr("sheet", f"struct(*) AS {s}", "c1 AS x", "r1 AS y", "c2 - c1 + 1 AS w", "r2 - r1 + 1 AS h")
    cut = ranges.overlapping(box(n, "n"), box(m, "m"), ["sheet"], 16).where("NOT (m_r.r1 >= n_l.r1 AND m_r.r2 <= n_l.r2 AND m_r.c1 >= n_l.c1 AND m_r.c2 <= n_l.c2)")
    fine = n.join(cut.selectExpr("sheet", "n_l.name AS name").distinct(), ["sheet", "name"], "left_anti")
    return ranges.cells_in_ranges(c, fine, ["sheet"]).groupBy("sheet", "name").agg(F.count("*").alias("n_cells"), F.sum(F.col("value").cast("long")).alias("total"))


HEAD = f"{CELLS}, head AS (SELECT sheet, row // 3 AS tab, row, col, CAST(CAST(value AS BIGINT) % 3 AS VARCHAR) AS value FROM cells)"


@query(
    f"""WITH {HEAD}, f AS (SELECT *, lag(value) OVER (PARTITION BY sheet, tab, col ORDER BY row) AS was FROM head),
  l AS (SELECT sheet, tab, col, string_agg(value, ' / ' ORDER BY row) AS label FROM f WHERE was IS NULL OR was <> value GROUP BY 1, 2, 3)
  SELECT sheet, CAST(tab AS BIGINT) AS tab, col, CASE WHEN count(*) OVER (PARTITION BY sheet, tab, label) > 1 THEN label || '（' || CAST(col AS VARCHAR) || '）' ELSE label END AS label FROM l"""
)
def header_labels(spark, sf_dir):
    head = cells(spark, sf_dir).selectExpr("sheet", "row div 3 AS tab", "row", "col", "cast(cast(value as bigint) % 3 as string) AS value")
    return grid.header_labels(head, ["sheet", "tab"])


@query(
    f"""WITH {CELLS}, m AS (SELECT sheet, row // 4 AS tab, row AS r1, row AS r2, col AS c1, col + 1 AS c2 FROM cells WHERE (col = 2 OR (col = 5 AND row % 4 < 3))),
  n AS (SELECT sheet, row // 4 AS tab, count(DISTINCT row) AS n_rows FROM cells GROUP BY 1, 2)
  SELECT m.sheet, CAST(m.tab AS BIGINT) AS tab, c1, c2 FROM m JOIN n ON m.sheet = n.sheet AND m.tab = n.tab GROUP BY m.sheet, m.tab, c1, c2, n_rows HAVING count(DISTINCT r1) = n_rows"""
)
def column_collapse(spark, sf_dir):
    c = cells(spark, sf_dir).withColumn("tab", F.expr("row div 4"))
    m = c.where("col = 2 OR (col = 5 AND row % 4 < 3)").selectExpr("sheet", "tab", "row AS r1", "row AS r2", "col AS c1", "col + 1 AS c2")
    return grid.collapsed_columns(m, c.groupBy("sheet", "tab").agg(F.countDistinct("row").alias("n_rows")), ["sheet", "tab"])


@query(
    f"""WITH {CELLS}, r AS (SELECT sheet, row, '| ' || string_agg(coalesce(value, ''), ' | ' ORDER BY k) || ' |' AS md FROM (SELECT s.sheet, s.row, k, value FROM (SELECT DISTINCT sheet, row FROM cells) s
  CROSS JOIN range(1, 8) q(k) LEFT JOIN cells c ON c.sheet = s.sheet AND c.row = s.row AND c.col = k) GROUP BY 1, 2)
  SELECT sheet, string_agg(md, chr(10) ORDER BY row) AS markdown FROM r GROUP BY sheet"""
)
def markdown_table(spark, sf_dir):
    c = cells(spark, sf_dir)
    by_col = c.groupBy("sheet", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("m"))
    row = markdown.table_row(F.transform(F.sequence(F.lit(1), F.lit(7)), lambda k: F.try_element_at(F.col("m"), k)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", row.alias("md")))), lambda x: x["md"]), "\n")
    return by_col.groupBy("sheet").agg(text.alias("markdown"))


BLOCKS = f"""{CELLS}, b AS (SELECT sheet, CASE WHEN cells.row % 3 = 0 THEN 'table' ELSE 'text' END AS kind, CASE WHEN cells.row % 17 = 0 THEN NULL ELSE cells.row END AS row, CASE WHEN cells.row % 17 = 0 THEN NULL ELSE min(cells.col) END AS col, cells.row AS ord,
  CASE WHEN cells.row % 3 = 0 THEN string_agg(value, chr(10) ORDER BY cells.col) ELSE string_agg(value, ' ' ORDER BY cells.col) END AS md FROM cells GROUP BY sheet, cells.row)"""


@query(
    f"""WITH {BLOCKS}, o AS (SELECT *, row_number() OVER w AS position, kind = 'text' AND lag(kind) OVER w = 'text' AND lag(row) OVER w = row - 1 AS joined,
  len(md) - len(replace(md, chr(10), '')) + 1 AS lines FROM b WINDOW w AS (PARTITION BY sheet ORDER BY coalesce(row, 2147483647), coalesce(col, 2147483647), ord)),
  e AS (SELECT *, sum(lines + CASE WHEN position = 1 OR coalesce(joined, false) THEN 0 ELSE 1 END) OVER (PARTITION BY sheet ORDER BY position) AS end_line FROM o)
  SELECT sheet, ord, kind, CAST(position AS INT) AS position, CAST(end_line - lines + 1 AS BIGINT) AS start_line, CAST(end_line AS BIGINT) AS end_line FROM e"""
)
def block_order_lines(spark, sf_dir):
    c = cells(spark, sf_dir)
    values = F.transform(F.array_sort(F.collect_list(F.struct("col", "value"))), lambda x: x["value"])
    b = c.groupBy("sheet", "row").agg(values.alias("vs"), F.min("col").alias("first"))
    known = F.col("row") % 17 != 0
    b = b.select("sheet", F.when(F.col("row") % 3 == 0, "table").otherwise("text").alias("kind"), F.when(known, F.col("row")).alias("row"), F.when(known, F.col("first")).alias("col"), F.col("row").alias("ord"), F.when(F.col("row") % 3 == 0, F.array_join("vs", "\n")).otherwise(F.array_join("vs", " ")).alias("markdown"))
    return blocks.placed(b, ["sheet"]).select("sheet", "ord", "kind", "position", F.col("start_line").cast("long").alias("start_line"), F.col("end_line").cast("long").alias("end_line"))


@query(
    f"""WITH {CELLS}, {MERGES} SELECT c.sheet, c.row, min(c.col) AS col, string_agg(value, '　' ORDER BY c.col) AS text FROM cells c
  WHERE NOT EXISTS (SELECT 1 FROM merges m WHERE m.sheet = c.sheet AND c.row BETWEEN r1 AND r2 AND c.col BETWEEN c1 AND c2) GROUP BY c.sheet, c.row"""
)
def text_rows_except(spark, sf_dir):
    c = cells(spark, sf_dir)
    return grid.text_rows(c, ranges.cells_in_ranges(c, merges(spark, sf_dir), ["sheet"]), ["sheet"])


EDGES = """v AS (SELECT c_nationkey AS section, 'shape-' || CAST(c_custkey AS VARCHAR) AS id, CAST(c_custkey - c_custkey % 2 * (c_custkey % 10 // 7) AS VARCHAR) AS source_id FROM customer),
  k AS (SELECT c_nationkey AS section, o_orderkey AS id, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS start_id, CAST((o_custkey + o_orderkey % 3) AS VARCHAR) AS end_id,
  CASE o_orderkey % 5 WHEN 0 THEN 'triangle' WHEN 1 THEN 'oval' WHEN 2 THEN '' ELSE 'none' END AS start_arrow, CASE o_orderkey % 4 WHEN 0 THEN 'stealth' WHEN 1 THEN 'none' WHEN 2 THEN 'arrow' ELSE 'diamond' END AS end_arrow
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


@query(
    f"""WITH {EDGES}, s AS (SELECT section, source_id, count(*) AS n, min(id) AS vid FROM v GROUP BY 1, 2),
  r AS (SELECT k.*, a.n AS an, a.vid AS av, b.n AS bn, b.vid AS bv, CASE WHEN start_arrow = 'triangle' AND end_arrow IN ('stealth', 'arrow') THEN 'bidirectional' WHEN start_arrow = 'triangle' THEN 'end-to-start' WHEN end_arrow IN ('stealth', 'arrow') THEN 'start-to-end' ELSE 'undirected' END AS direction
  FROM k LEFT JOIN s a ON a.section = k.section AND a.source_id = k.start_id LEFT JOIN s b ON b.section = k.section AND b.source_id = k.end_id),
  w AS (SELECT *, CASE WHEN start_id IS NULL THEN 'MISSING_ENDPOINT' WHEN an IS NULL THEN 'TARGET_UNAVAILABLE' WHEN an > 1 THEN 'AMBIGUOUS_TARGET' WHEN end_id IS NULL THEN 'MISSING_ENDPOINT' WHEN bn IS NULL THEN 'TARGET_UNAVAILABLE' WHEN bn > 1 THEN 'AMBIGUOUS_TARGET' ELSE '' END AS reason FROM r)
  SELECT section, id, CASE WHEN an = 1 THEN av END AS start_vertex, CASE WHEN bn = 1 THEN bv END AS end_vertex, direction, CASE WHEN reason = '' THEN 'resolved' ELSE 'unresolved' END AS status, reason FROM w"""
)
def edge_resolve(spark, sf_dir):
    c, o = t(spark, sf_dir, "customer"), t(spark, sf_dir, "orders")
    v = c.selectExpr("c_nationkey AS section", "concat('shape-', c_custkey) AS id", "cast(c_custkey - c_custkey % 2 * (c_custkey % 10 div 7) as string) AS source_id")
    k = o.join(c, o["o_custkey"] == c["c_custkey"]).selectExpr(
        "c_nationkey AS section", "o_orderkey AS id", "CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE cast(o_custkey as string) END AS start_id", "cast(o_custkey + o_orderkey % 3 as string) AS end_id",
        "CASE o_orderkey % 5 WHEN 0 THEN 'triangle' WHEN 1 THEN 'oval' WHEN 2 THEN '' ELSE 'none' END AS start_arrow", "CASE o_orderkey % 4 WHEN 0 THEN 'stealth' WHEN 1 THEN 'none' WHEN 2 THEN 'arrow' ELSE 'diamond' END AS end_arrow",
    )
    return graph.resolve(v, k, ["section"])


@query(
    """SELECT event_type, CAST(user_id % 7 AS BIGINT) AS k, CASE WHEN user_id % 7 = 6 THEN 'unknown' WHEN event_type IN ('click', 'view') AND user_id % 7 < 3 THEN 'bidirectional' WHEN event_type IN ('click', 'view') THEN 'end-to-start' WHEN user_id % 7 < 3 THEN 'start-to-end' ELSE 'undirected' END AS direction, count(*) AS n FROM events GROUP BY ALL"""
)
def edge_direction(spark, sf_dir):
    e = t(spark, sf_dir, "events").withColumn("k", F.col("user_id") % 7)
    start = F.when(F.col("event_type").isin("click", "view"), "triangle").otherwise("oval")
    end = F.when(F.col("k") < 3, "arrow").when(F.col("k") == 6, "star").otherwise("none")
    return e.groupBy("event_type", "k", graph.direction(start, end).alias("direction")).agg(F.count("*").alias("n"))


BOXES = """boxes AS (SELECT p_partkey AS id, p_partkey % 4 AS sheet, p_partkey * 37 % 400 AS x, p_partkey * 53 % 300 + p_partkey // 500 * 320 AS y, p_size + 5 AS w, p_size % 20 + 8 AS h FROM part)"""


def boxes(spark, sf_dir):
    return t(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_partkey % 4 AS sheet", "p_partkey * 37 % 400 AS x", "p_partkey * 53 % 300 + p_partkey div 500 * 320 AS y", "cast(p_size + 5 as bigint) AS w", "cast(p_size % 20 + 8 as bigint) AS h")


@query(f"WITH {BOXES} SELECT a.id AS a, b.id AS b, a.sheet FROM boxes a JOIN boxes b ON a.sheet = b.sheet AND a.id < b.id AND a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h")
def rect_overlap(spark, sf_dir):
    b = boxes(spark, sf_dir)
    return ranges.overlapping(b, b, ["sheet"], 64).where("id_l < id_r").selectExpr("id_l AS a", "id_r AS b", "sheet")


@query(
    f"""WITH {BOXES}, pts AS (SELECT vec_id, vec_id % 4 AS sheet, CAST(floor((embedding[1] + 1) * 200) AS BIGINT) AS px, CAST(floor((embedding[2] + 1) * 150) AS BIGINT) AS py FROM embeddings),
  hit AS (SELECT vec_id, id FROM pts p JOIN boxes b ON p.sheet = b.sheet AND px BETWEEN x - 1 AND x + w + 1 AND py BETWEEN y - 1 AND y + h + 1 AND NOT (px > x + 1 AND px < x + w - 1 AND py > y + 1 AND py < y + h - 1))
  SELECT vec_id, count(*) AS contacts, CASE WHEN count(*) = 1 THEN min(id) END AS target FROM hit GROUP BY vec_id"""
)
def boundary_contact(spark, sf_dir):
    """Line ends on a box's boundary, within a tolerance; the box counts if it is the only one."""
    p = t(spark, sf_dir, "embeddings").selectExpr("vec_id", "vec_id % 4 AS sheet", "cast(floor((embedding[0] + 1) * 200) as bigint) AS x", "cast(floor((embedding[1] + 1) * 150) as bigint) AS y", "0L AS w", "0L AS h")
    b = boxes(spark, sf_dir).selectExpr("id", "sheet", "x - 1 AS x", "y - 1 AS y", "w + 2 AS w", "h + 2 AS h")
    hit = ranges.overlapping(p, b, ["sheet"], 64, touch=True).where("NOT (x_l > x_r + 2 AND x_l < x_r + w_r - 2 AND y_l > y_r + 2 AND y_l < y_r + h_r - 2)")
    return hit.groupBy(F.col("vec_id_l").alias("vec_id")).agg(F.count("*").alias("contacts"), F.min("id_r").alias("m")).selectExpr("vec_id", "contacts", "CASE WHEN contacts = 1 THEN m END AS target")


@query(
    f"""WITH RECURSIVE {BOXES}, e AS (SELECT a.id AS u, b.id AS v FROM boxes a JOIN boxes b ON a.sheet = b.sheet AND a.id <> b.id AND a.x < b.x + b.w AND b.x < a.x + a.w AND a.y < b.y + b.h AND b.y < a.y + a.h),
  walk(n, root) AS (SELECT id, id FROM boxes UNION SELECT e.v, w.root FROM walk w JOIN e ON e.u = w.n) SELECT n AS id, min(root) AS root FROM walk GROUP BY n"""
)
def drawing_components(spark, sf_dir):
    b = boxes(spark, sf_dir)
    e = ranges.overlapping(b, b, ["sheet"], 64).where("id_l < id_r").selectExpr("id_l AS a", "id_r AS b")
    return graph.components(b.select("id"), e)


@query("SELECT l_orderkey, l_linenumber, l_partkey, CAST(sum(CAST(l_quantity AS BIGINT)) OVER (w ROWS UNBOUNDED PRECEDING) - CAST(l_quantity AS BIGINT) AS BIGINT) AS start FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem) WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber * 1000000 + l_partkey, l_quantity)")
def prefix_offsets(spark, sf_dir):
    rows = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity").distinct()
    rows = rows.withColumn("k", F.struct((F.col("l_linenumber") * F.lit(1000000).cast("long") + F.col("l_partkey")).alias("a"), "l_quantity")).withColumn("q", F.col("l_quantity").cast("long"))
    return ranges.prefix_offsets(rows, ["l_orderkey"], "k", "q").select("l_orderkey", "l_linenumber", "l_partkey", "start")


TRACKS = """tracks AS (SELECT p_size % 4 AS axis, p_partkey AS line, sum(p_size) OVER (PARTITION BY p_size % 4 ORDER BY p_partkey) - p_size AS start FROM part)"""


@query(f"WITH {TRACKS}, pts AS (SELECT event_id, event_id % 4 AS axis, event_id * 7 % 20000 AS at FROM events) SELECT event_id, line FROM pts ASOF LEFT JOIN tracks ON pts.axis = tracks.axis AND pts.at >= tracks.start")
def offset_lookup(spark, sf_dir):
    p = t(spark, sf_dir, "part").selectExpr("cast(p_size % 4 as bigint) AS axis", "p_partkey AS line", "cast(p_size as bigint) AS size")
    tracks = ranges.prefix_offsets(p, ["axis"], "line", "size")
    pts = t(spark, sf_dir, "events").selectExpr("event_id", "event_id % 4 AS axis", "event_id * 7 % 20000 AS at")
    return ranges.locate(pts, tracks, ["axis"], "at", ["line"]).select("event_id", "line")


SPANS = "spans AS (SELECT user_id, epoch_us(ts) // 1000000 AS s, epoch_us(ts) // 1000000 + 1800 + event_id % 5 * 3600 AS e FROM events)"


@query(
    f"""WITH {SPANS}, m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans),
  i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m)
  SELECT user_id, CAST(min(s) AS BIGINT) AS "start", CAST(max(e) AS BIGINT) AS "end" FROM i GROUP BY user_id, k"""
)
def merge_spans(spark, sf_dir):
    e = t(spark, sf_dir, "events").selectExpr("user_id", "unix_micros(cast(ts as timestamp)) div 1000000 AS start", "unix_micros(cast(ts as timestamp)) div 1000000 + 1800 + event_id % 5 * 3600 AS end")
    return ranges.islands(e, ["user_id"])


PAGES = """edges AS (SELECT sheet, 0.0::DOUBLE AS e FROM range(8) r(sheet) UNION ALL SELECT p_partkey % 8, CAST(sum(p_size) OVER (PARTITION BY p_partkey % 8 ORDER BY p_partkey) AS DOUBLE) FROM part),
  ends AS (SELECT sheet, max(e) AS last FROM edges GROUP BY sheet),
  cuts(sheet, page, s, e) AS (SELECT n.sheet, 0, 0.0::DOUBLE, CASE WHEN last <= 200 THEN last ELSE coalesce((SELECT max(x.e) FROM edges x WHERE x.sheet = n.sheet AND x.e > 0 AND x.e <= 200), 200) END FROM ends n
  UNION ALL SELECT c.sheet, c.page + 1, c.e, CASE WHEN last <= c.e + 200 THEN last ELSE coalesce((SELECT max(x.e) FROM edges x WHERE x.sheet = c.sheet AND x.e > c.e AND x.e <= c.e + 200), c.e + 200) END
  FROM cuts c JOIN ends n ON n.sheet = c.sheet WHERE c.e < n.last)"""


def _pages(spark, sf_dir):
    return _sliced(t(spark, sf_dir, "part").selectExpr("p_partkey % 8 AS sheet", "p_partkey AS k", "cast(p_size as double) AS size"))


def _sliced(p: DataFrame) -> DataFrame:
    ends = ranges.prefix_offsets(p, ["sheet"], "k", "size").groupBy("sheet").agg(F.array_sort(F.collect_set("end")).alias("edges"))
    bounds = ends.selectExpr("sheet", "concat(array(0D), edges) AS edges", "cast(array() as array<struct<start:double,end:double>>) AS blocks")
    return ranges.slices(bounds, ["sheet"], 200.0)


@query(f'WITH RECURSIVE {PAGES} SELECT sheet, page, s AS "start", e AS "end" FROM cuts')
def page_slices(spark, sf_dir):
    return _pages(spark, sf_dir)


COLS = PAGES.replace("edges", "wedges").replace("ends", "wends").replace("cuts", "wcuts").replace("range(8) r(sheet)", "range(8) wr(sheet)").replace("p_partkey", "s_suppkey").replace("p_size", "(10 + s_suppkey % 50)").replace("FROM part)", "FROM supplier)")


@query(
    f"""WITH RECURSIVE {PAGES}, {COLS} SELECT a.sheet, CAST(row_number() OVER (PARTITION BY a.sheet ORDER BY a.page, b.page) AS INT) AS number, CAST(ceil((b.e - b.s) * 2) AS BIGINT) AS width, CAST(ceil((a.e - a.s) * 2) AS BIGINT) AS height
  FROM cuts a JOIN wcuts b ON a.sheet = b.sheet"""
)
def page_grid(spark, sf_dir):
    """Pages left to right within each band, with their pixel sizes at the readable scale."""
    rows = _pages(spark, sf_dir).selectExpr("sheet", "page AS i", "end - start AS h")
    cols = shared.table(_sliced(t(spark, sf_dir, "supplier").selectExpr("s_suppkey % 8 AS sheet", "s_suppkey AS k", "cast(10 + s_suppkey % 50 as double) AS size")).selectExpr("sheet", "page AS j", "end - start AS w"))
    scale = geometry.readable_scale(F.lit(2.0), F.lit(1.0), F.lit(5.0), F.lit(12.0))
    # Pages of an axis are numbered from 0 without a gap: a page's number follows from both, without sorting the grid.
    wide = cols.groupBy("sheet").agg(F.count("*").alias("n"))
    number = (F.col("i") * F.col("n") + F.col("j") + 1).cast("int")
    # Each sheet's rows are dealt to 64 keys, and its columns stand under each of them.
    each = cols.join(wide, "sheet").withColumn("key", F.explode(F.sequence(F.lit(0), F.lit(63))))
    return rows.withColumn("key", F.col("i") % 64).join(each.hint("merge"), ["sheet", "key"]).select("sheet", number.alias("number"), F.ceil(F.col("w") * scale).alias("width"), F.ceil(F.col("h") * scale).alias("height"))


@query(
    f"""WITH {CELLS}, {MERGES}, b AS (SELECT sheet, min(row) AS r1, max(row) AS r2, min(col) AS c1, max(col) AS c2 FROM cells GROUP BY sheet),
  w AS (SELECT b.*, m.r1 AS m1, m.r2 AS m2, m.c1 AS n1, m.c2 AS n2 FROM b LEFT JOIN merges m ON m.sheet = b.sheet AND m.r1 <= b.r2 AND m.r2 >= b.r1 AND m.c1 <= b.c2 AND m.c2 >= b.c1)
  SELECT sheet, least(min(r1), min(m1)) AS r1, greatest(max(r2), max(m2)) AS r2, least(min(c1), min(n1)) AS c1, greatest(max(c2), max(n2)) AS c2 FROM w GROUP BY sheet"""
)
def used_range(spark, sf_dir):
    return grid.used_range(cells(spark, sf_dir), merges(spark, sf_dir), ["sheet"])


@query(
    f"""WITH {CELLS}, c AS (SELECT sheet, min(row) AS r1, max(row) AS r2 FROM cells GROUP BY sheet)
  SELECT sheet, CASE WHEN sheet % 4 = 0 THEN 'explicit' WHEN sheet % 4 = 1 THEN 'printArea' ELSE 'occupied' END AS origin, CASE WHEN sheet % 4 = 0 THEN 'B2:D9' WHEN sheet % 4 = 1 THEN 'A1' ELSE 'A' || CAST(r1 + 1 AS VARCHAR) || ':G' || CAST(r2 + 1 AS VARCHAR) END AS area FROM c"""
)
def range_selection(spark, sf_dir):
    """The range to draw: explicit, else the print area, else what is occupied."""
    c = cells(spark, sf_dir).groupBy("sheet").agg(F.min("row").alias("r1"), F.max("row").alias("r2"))
    given = names.rectangle(F.when(F.col("sheet") % 4 == 0, "B2:D9"))
    printed = names.rectangle(F.when(F.col("sheet") % 4 == 1, "$A$1"))
    used = F.struct("r1", "r2", F.lit(0).alias("c1"), F.lit(6).alias("c2"))
    pick = F.coalesce(given, printed, used)
    origin = F.when(given.isNotNull(), "explicit").when(printed.isNotNull(), "printArea").otherwise("occupied")
    return c.select("sheet", origin.alias("origin"), names.a1(pick["r1"], pick["r2"], pick["c1"], pick["c2"]).alias("area"))


@query(
    r"""SELECT page_id, CASE WHEN NOT regexp_matches(url, '^(?i)https://') THEN 'NOT_HTTPS' WHEN regexp_matches(url, '^[a-z]+://[^/?#]*@') THEN 'USER_INFO' WHEN regexp_matches(url, '^[a-z]+://[^/?#]*:\d+') THEN 'PORT' WHEN contains(url, '#') THEN 'FRAGMENT'
  WHEN NOT regexp_matches(url, '^https://([^/?#]*\.)?example\.(com|org)([/?#]|$)') THEN 'HOST_NOT_ALLOWED' ELSE 'ok' END AS policy, lower(regexp_extract(url, '^[a-z]+://([^/?#:@]+)', 1)) AS host FROM pages"""
)
def url_policy(spark, sf_dir):
    return t(spark, sf_dir, "pages").select("page_id", urls.policy(F.col("url"), ["example.com", "example.org"]).alias("policy"), urls.host(F.col("url")).alias("host"))


PRIVATE = " OR ".join(f"n BETWEEN {lo} AND {hi}" for lo, hi in ((lo, lo + (1 << 32 - b) - 1) for lo, b in ((sum(int(p) << 8 * (3 - i) for i, p in enumerate(a.split("."))), b) for a, b in urls.SPECIAL_V4)))


@query(f"SELECT o_orderkey, ip, NOT ({PRIVATE}) AS public FROM (SELECT o_orderkey, n, CAST(n // 16777216 AS VARCHAR) || '.' || CAST(n // 65536 % 256 AS VARCHAR) || '.' || CAST(n // 256 % 256 AS VARCHAR) || '.' || CAST(n % 256 AS VARCHAR) AS ip FROM (SELECT o_orderkey, o_orderkey * 2654435761 % 4294967296 AS n FROM orders))")
def public_addresses(spark, sf_dir):
    n = F.expr("o_orderkey * 2654435761 % 4294967296")
    part = lambda d: F.expr(f"cast(o_orderkey * 2654435761 % 4294967296 div {d} % 256 as string)")
    ip = F.concat_ws(".", part(16777216), part(65536), part(256), (n % 256).cast("string"))
    return t(spark, sf_dir, "orders").select("o_orderkey", ip.alias("ip"), urls.is_public_v4(ip).alias("public"))


@query("SELECT page_id, 1280 AS width, 720 AS height, 'default' AS origin, CAST(1280 * 9525 AS BIGINT) AS width_emu FROM pages WHERE NOT contains(html, 'name=\"slide-width\"')")
def slide_meta(spark, sf_dir):
    """Slide size of every page and its origin."""
    return slide_sizes(t(spark, sf_dir, "pages"), "slide")


def slide_sizes(p, prefix="pptx-slide"):
    """page_id, width, height, origin, width_emu: two meta elements, or the default where
    both are missing. One alone, a repeated one and a size that is no number from 64 to
    4,096 are errors, without a size."""
    tags = F.regexp_extract_all(F.regexp_replace(F.coalesce("html", F.lit("")), r"(?s)<!--.*?-->|(?i:<(script|style|title|textarea)\b.*?</\1\s*>)", ""), F.lit(r"""(?i)<meta(?=[\s/])(?:[^>"']|"[^"]*"|'[^']*')*>"""), 0)
    part = lambda tag, k: F.concat(*[F.regexp_extract(tag, rf"""(?i)[\s/"']{k}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", g) for g in (1, 2, 3)])
    p = p.select("page_id", F.transform(tags, lambda x: F.struct(F.lower(part(x, "name")).alias("name"), part(x, "content").alias("content"))).alias("m"))
    given = lambda k: F.filter("m", lambda x: x["name"] == f"{prefix}-{k}")["content"]
    p = p.select("page_id", given("width").alias("width"), given("height").alias("height"))
    size = lambda k: F.when(F.get(k, 0).rlike(r"\A0*[0-9]{1,4}\z"), F.get(k, 0).cast("int"))
    none = (F.size("width") == 0) & (F.size("height") == 0)
    fine = (F.size("width") == 1) & (F.size("height") == 1) & size("width").between(64, 4096) & size("height").between(64, 4096)
    origin = F.when(none, "default").when(F.coalesce(fine, F.lit(False)), "meta").otherwise("error")
    p = p.select("page_id", size("width").alias("w"), size("height").alias("h"), origin.alias("origin"))
    pick = lambda c, default: F.when(F.col("origin") == "default", default).when(F.col("origin") == "meta", F.col(c))
    p = p.select("page_id", pick("w", 1280).alias("width"), pick("h", 720).alias("height"), "origin")
    return p.withColumn("width_emu", (F.col("width") * geometry.EMU_PIXEL).cast("long"))


@query(
    """WITH s AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS g FROM conversations)
  SELECT conv_id, turn, CAST(g AS BIGINT) AS level0, CAST(row_number() OVER (PARTITION BY conv_id, g ORDER BY turn) AS BIGINT) AS level1 FROM s"""
)
def numbering_restart(spark, sf_dir):
    """List numbers of two levels: the second restarts after each item of the first."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    s = t(spark, sf_dir, "conversations").withColumn("level0", F.sum((F.col("role") == "user").cast("long")).over(w))
    return s.select("conv_id", "turn", "level0", F.row_number().over(Window.partitionBy("conv_id", "level0").orderBy("turn")).cast("long").alias("level1"))


_TENS, _ONES = "['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC']", "['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX']"


@query(f"SELECT p_partkey, {_TENS}[p_size // 10 + 1] || {_ONES}[p_size % 10 + 1] AS roman, repeat(chr(97 + (p_size - 1) % 26), (p_size - 1) // 26 + 1) AS letters FROM part")
def roman_letters(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", names.roman(F.col("p_size")).alias("roman"), names.letters(F.col("p_size")).alias("letters"))


STYLES = """styles AS (SELECT 'r' || CAST(r_regionkey AS VARCHAR) AS id, NULL AS based_on, CAST(r_regionkey AS INT) AS outline, r_name AS font FROM region UNION ALL SELECT 'n' || CAST(n_nationkey AS VARCHAR), 'r' || CAST(n_regionkey AS VARCHAR), NULL, CASE WHEN n_nationkey % 2 = 0 THEN n_name END FROM nation
  UNION ALL SELECT 'c' || CAST(c_custkey AS VARCHAR), 'n' || CAST(c_nationkey AS VARCHAR), CASE WHEN c_custkey % 3 = 0 THEN 9 END, CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment END FROM customer)"""


@query(
    f"""WITH RECURSIVE {STYLES}, up(id, anc, k) AS (SELECT id, id, 0 FROM styles UNION ALL SELECT u.id, s.based_on, k + 1 FROM up u JOIN styles s ON s.id = u.anc WHERE s.based_on IS NOT NULL)
  SELECT u.id, arg_min(outline, k) FILTER (outline IS NOT NULL) AS outline, arg_min(font, k) FILTER (font IS NOT NULL) AS font FROM up u JOIN styles s ON s.id = u.anc GROUP BY u.id"""
)
def style_inheritance(spark, sf_dir):
    r, n, c = (t(spark, sf_dir, x) for x in ("region", "nation", "customer"))
    s = r.selectExpr("concat('r', r_regionkey) AS id", "cast(null as string) AS based_on", "cast(r_regionkey as int) AS outline", "r_name AS font")
    s = s.unionByName(n.selectExpr("concat('n', n_nationkey) AS id", "concat('r', n_regionkey) AS based_on", "cast(null as int) AS outline", "CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS font"))
    s = s.unionByName(c.selectExpr("concat('c', c_custkey) AS id", "concat('n', c_nationkey) AS based_on", "CASE WHEN c_custkey % 3 = 0 THEN 9 END AS outline", "CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment END AS font"))
    return graph.inherited(s, ["outline", "font"])


@query(
    """WITH RECURSIVE e AS (SELECT o_orderkey AS a, o_orderkey * 2 + o_custkey % 3 AS b FROM orders), walk(n, k) AS (SELECT o_orderkey, 0 FROM orders WHERE o_orderpriority LIKE '1%' UNION SELECT e.b, k + 1 FROM walk JOIN e ON e.a = walk.n)
  SELECT n, min(k) AS steps FROM walk GROUP BY n"""
)
def footnote_closure(spark, sf_dir):
    """Notes reached from the body, also through other notes."""
    o = t(spark, sf_dir, "orders")
    e = o.selectExpr("o_orderkey AS a", "o_orderkey * 2 + o_custkey % 3 AS b")
    return graph.closure(e, o.where("o_orderpriority LIKE '1%'").selectExpr("o_orderkey AS n"))


@query(
    """SELECT p_partkey, CASE WHEN p_size % 5 = 4 THEN 'NO_AUDIO_TRACK' WHEN p_size % 3 = 2 THEN 'TRANSCODE' ELSE 'COPY' END AS plan, CASE WHEN p_size % 5 = 4 THEN NULL ELSE CAST(least(512000, 96000 * (p_size % 8 + 1)) AS INT) END AS bitrate FROM part"""
)
def media_probe_plan(spark, sf_dir):
    """The first audio stream of a probe: copied if it is AAC, else encoded at a rate for its channels."""
    audio = "struct(1 as `index`, 'audio' as codec_type, if(p_size % 3 = 2, 'pcm_s16le', 'aac') as codec_name, cast(p_size % 8 + 1 as int) as channels)"
    made = f"to_json(named_struct('streams', filter(array(struct(0 as `index`, 'video' as codec_type, 'h264' as codec_name, cast(null as int) as channels), {audio}), s -> s.codec_type = 'video' or p_size % 5 <> 4)))"
    p = t(spark, sf_dir, "part").select("p_partkey", F.expr(made).alias("probe"))
    p = p.withColumn("s", F.from_json("probe", "streams array<struct<index:int,codec_type:string,codec_name:string,channels:int>>"))
    first = F.get(F.filter("s.streams", lambda x: x["codec_type"] == "audio"), 0)
    plan = F.when(first.isNull(), "NO_AUDIO_TRACK").when(first["codec_name"] == "aac", "COPY").otherwise("TRANSCODE")
    return p.select("p_partkey", plan.alias("plan"), geometry.aac_bitrate(first["channels"]).cast("int").alias("bitrate"))


@query(
    """WITH v AS (SELECT vec_id, list_transform(embedding, lambda e: CAST(e AS DOUBLE)) AS e FROM embeddings)
  SELECT vec_id, CASE WHEN len(e) < 2 OR len(e) > 257 THEN 'invalid_keyframes' WHEN abs(e[len(e)] - 1) >= 1e-5 THEN 'non_final_base'
  WHEN len(list_filter(e, lambda x: abs(x - 1) >= 1e-5)) > 0 AND (abs(e[1]) >= 1e-5 OR list_min(e) < 0 OR list_max(e) > 1 OR len(list_filter(range(2, len(e) + 1), lambda i: e[i] < e[i - 1] - 1e-5)) > 0) THEN 'unsupported_opacity'
  WHEN len(list_filter(e, lambda x: abs(x - 1) > 1e-5)) = 0 THEN 'no_visible_change' END AS reason FROM v"""
)
def animation_reasons(spark, sf_dir):
    """First reason why whole vectors, as opacities of evenly spaced frames, make no native effect."""
    n = F.size("embedding")
    frames = F.transform("embedding", lambda v, i: F.struct((i / (n - 1)).alias("offset"), v.cast("double").alias("opacity"), *[F.lit(None).cast("double").alias(k) for k in list(effects.CHANNELS)[1:]], F.lit(False).alias("other")))
    box = F.struct(*[F.lit(float(v)).alias(k) for k, v in (("x", 0), ("y", 0), ("width", 9), ("height", 9))])
    reason = effects.reason(F.lit("e"), F.lit(1000.0), F.lit(0.0), frames, box, F.lit(None).cast("struct<x:double,y:double>"))
    return t(spark, sf_dir, "embeddings").select("vec_id", reason.alias("reason"))


@query(
    """WITH a AS (SELECT vec_id, unnest(range(len(embedding))) AS pos, unnest(list_transform(embedding, lambda v: ((CAST(v AS DOUBLE) * 720) % 360 + 360) % 360)) AS angle FROM embeddings),
  s AS (SELECT *, lag(angle) OVER (PARTITION BY vec_id ORDER BY pos) AS was FROM a)
  SELECT vec_id, CAST(pos AS INT) AS pos, round(angle + 360 * sum(floor((coalesce(was, angle) - angle) / 360 + 0.5)) OVER (PARTITION BY vec_id ORDER BY pos), 6) AS unwrapped FROM s"""
)
def rotation_unwrap(spark, sf_dir):
    """Angles without jumps of over half a turn: each sample takes the closest turn to the last."""
    a = t(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    a = a.select("vec_id", "pos", F.pmod(F.col("v").cast("double") * 720, F.lit(360.0)).alias("angle"))
    return ordered.unwrapped(a, ["vec_id"], "pos", "angle").select("vec_id", "pos", F.round("unwrapped", 6).alias("unwrapped"))


#: Names of containers and aliases, and whether they may be used.
CONTAINERS = {"abc-def": True, "a-b": True, "a--b": False, "-ab": False, "ab": False, "abc-": False, "A-bc": False, "x" * 63: True, "x" * 64: False, "0-9": True}
ALIASES = {"main": True, "a": True, "_a": False, "A": False, "a_1": True, "a-b": False, "a" * 32: True, "a" * 33: False}
PATHS = {"a/b.xlsx": True, "../up": False, "a/./b": False, "a\\\\..\\\\b": False, "/lead": True, "a//b": True, "a..b/..c": True, " ": False}


def _pick(names: dict[str, bool], n: str, spark: bool) -> tuple[str, str]:
    """Expressions of the name and of its verdict by a number."""
    cases = lambda xs: "CASE " + " ".join(f"WHEN {n} = {i} THEN {x}" for i, x in enumerate(xs)) + " END"
    return cases(["'" + (k if not spark else k.replace("\\", "\\\\")) + "'" for k in names]), cases([str(v).lower() for v in names.values()])


@query(
    f"""WITH e AS (SELECT event_id, {_pick(CONTAINERS, "event_id // 7 % 10", False)[1]} AS c, {_pick(ALIASES, "event_id // 3 % 8", False)[1]} AS a, {_pick(PATHS, "event_id // 5 % 8", False)[1]} AS p FROM events)
  SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'INVALID_JSON' WHEN event_id % 7 = 0 THEN 'UNKNOWN_FIELD' WHEN event_id % 5 = 0 THEN 'INVALID_JOB_ID' WHEN NOT c THEN 'INVALID_CONTAINER' WHEN NOT a THEN 'INVALID_ALIAS' WHEN NOT p THEN 'INVALID_PATH' END AS error FROM e"""
)
def job_contract(spark, sf_dir):
    """Strict requests: trailing text and duplicate keys are no JSON, unknown fields are errors."""
    container, alias, path = (_pick(x, f"event_id div {d} % {len(x)}", True)[0] for x, d in ((CONTAINERS, 7), (ALIASES, 3), (PATHS, 5)))
    made = f"""concat('{{"version":1,"jobId":"', if(event_id % 5 = 0 and event_id % 7 <> 0, 'x', '123e4567-e89b-12d3-a456-426614174000'), '","input":{{"container":"', {container}, '","path":"', {path}, '"}},"output":{{"storage":"', {alias}, '"}}',
      if(event_id % 7 = 0, ',"extra":1', ''), if(event_id % 22 = 0, ',"version":1', ''), '}}', if(event_id % 22 = 11, ' {{}}', ''))"""
    return t(spark, sf_dir, "events").select("event_id", jobs.request_error(F.expr(made)).alias("error"))


JOBS = """ev AS (SELECT user_id AS job, event_id AS seq, CASE WHEN event_id % 6 < 2 THEN 'submitted' WHEN event_id % 6 < 4 THEN 'running' WHEN event_id % 6 = 4 THEN 'succeeded' ELSE 'failed' END AS kind, CAST(event_id % 3 // 2 AS VARCHAR) AS request, epoch_us(ts) // 1000000 AS ts FROM events),
  st AS (SELECT job, coalesce(arg_min(kind, seq) FILTER (kind IN ('succeeded', 'failed')), CASE WHEN count(*) FILTER (kind = 'running') > 0 THEN 'running' END, arg_max(kind, seq)) AS status, coalesce(arg_min(ts, seq) FILTER (kind IN ('succeeded', 'failed')), arg_max(ts, seq)) AS updated,
  count(*) FILTER (kind = 'running') AS attempts, greatest(count(*) FILTER (kind IN ('succeeded', 'failed')) - 1, 0) AS duplicates, count(DISTINCT request) FILTER (kind = 'submitted') > 1 AS conflict FROM ev GROUP BY job)"""


def _states(spark, sf_dir):
    e = t(spark, sf_dir, "events").selectExpr("user_id AS job", "event_id AS seq", "CASE WHEN event_id % 6 < 2 THEN 'submitted' WHEN event_id % 6 < 4 THEN 'running' WHEN event_id % 6 = 4 THEN 'succeeded' ELSE 'failed' END AS kind", "cast(event_id % 3 div 2 as string) AS request", "unix_micros(cast(ts as timestamp)) div 1000000 AS ts")
    return jobs.folded(e, ["job"], "seq")


@query(f"WITH {JOBS} SELECT job, status, updated, attempts, CAST(duplicates AS BIGINT) AS duplicates, conflict FROM st")
def job_state_fold(spark, sf_dir):
    return _states(spark, sf_dir)


@query(f"WITH {JOBS} SELECT job, CAST(job AS VARCHAR) || ':' || status AS event_id, status FROM st WHERE status IN ('succeeded', 'failed') AND NOT (job % 4 = 0 AND status = 'failed')")
def outbox_pending(spark, sf_dir):
    s = _states(spark, sf_dir)
    sent = s.where("job % 4 = 0").selectExpr("concat(job, ':failed') AS event_id")
    return jobs.outbox(s, sent, "job")


@query(f"WITH {JOBS} SELECT job, status, greatest(updated, updated + CASE WHEN job % 2 = 0 THEN 86400 ELSE 0 END) + 7 * 86400 <= (SELECT max(ts) FROM ev) AS expired FROM st")
def retention_expired(spark, sf_dir):
    s = _states(spark, sf_dir)
    now = t(spark, sf_dir, "events").agg(F.max(F.expr("unix_micros(cast(ts as timestamp)) div 1000000")).alias("now"))  # one row
    at, sent = F.timestamp_seconds("updated"), F.when(F.col("job") % 2 == 0, F.timestamp_seconds(F.col("updated") + 86400))
    return s.join(F.broadcast(now)).select("job", "status", jobs.expired(at, sent, 7, F.timestamp_seconds("now")).alias("expired"))


@query("SELECT s_suppkey, coalesce(n_name, 'UNKNOWN_ALIAS') AS alias FROM supplier LEFT JOIN nation ON s_nationkey + 3 = n_nationkey")
def alias_lookup(spark, sf_dir):
    s, n = t(spark, sf_dir, "supplier"), t(spark, sf_dir, "nation")
    return s.join(n, s["s_nationkey"] + 3 == n["n_nationkey"], "left").select("s_suppkey", F.coalesce("n_name", F.lit("UNKNOWN_ALIAS")).alias("alias"))
