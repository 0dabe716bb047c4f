"""Parsers and streams: with SQL where it can follow them, else tested against brute force."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import shared
from ..sources import archive, html, markdown
from ..streaming import jobs
from .catalog import t

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


SQL["note_field_visibility"] = """WITH RECURSIVE e AS (SELECT user_id * 100 + event_id % 100 AS paragraph, event_id, event_id % 5 AS kind, row_number() OVER (PARTITION BY user_id * 100 + event_id % 100 ORDER BY event_id) AS i FROM events),
  w(paragraph, i, open, event_id, shown) AS (SELECT DISTINCT paragraph, CAST(0 AS BIGINT), CAST([] AS BOOLEAN[]), CAST(NULL AS BIGINT), false FROM e UNION ALL SELECT e.paragraph, e.i, CASE kind WHEN 0 THEN list_append(open, false)
    WHEN 1 THEN CASE WHEN len(open) > 0 THEN list_append(open[1:len(open) - 1], true) ELSE open END WHEN 2 THEN open[1:len(open) - 1] ELSE open END, e.event_id, kind > 2 AND NOT list_contains(open, false) FROM w JOIN e ON e.paragraph = w.paragraph AND e.i = w.i + 1)
  SELECT paragraph, event_id FROM w WHERE shown"""

_IN = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
# Tokens of a page, then one step for each: the open elements as two lists, and the node that the token makes.
_PARSED = rf"""tok AS (SELECT page_id, unnest(t) AS x, unnest(range(1, len(t) + 1)) AS i FROM (SELECT page_id, list_filter(flatten(list_transform(regexp_extract_all(coalesce(html, ''), '(?s)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<title[^>]*>.*?</title>|<!--.*?-->|<[^>]*>|[^<]+'),
    lambda v: CASE WHEN regexp_matches(v, '^<(script|style)') THEN [{{'k': 'open', 'v': regexp_extract(v, '^<[^>]*>')}}, {{'k': 'text', 'v': regexp_extract(v, '(?s)^<[^>]*>(.*)</[a-z]+>$', 1)}}, {{'k': 'close', 'v': regexp_extract(v, '</[a-z]+>$')}}]
      WHEN regexp_matches(v, '^<title') THEN [{{'k': 'open', 'v': regexp_extract(v, '^<[^>]*>')}}, {{'k': 'text', 'v': regexp_replace(replace(replace(regexp_extract(v, '(?s)^<[^>]*>(.*)</[a-z]+>$', 1), '&copy;', '©'), '&quot;', '"'), '&amp;?', '&', 'g')}}, {{'k': 'close', 'v': '</title>'}}]
      WHEN regexp_matches(v, '^<[!?]') THEN [] WHEN v[1:2] = '</' THEN [{{'k': 'close', 'v': v}}] WHEN v[1] = '<' THEN [{{'k': 'open', 'v': v}}] ELSE [{{'k': 'text', 'v': regexp_replace(replace(replace(replace(v, '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;?', '&', 'g')}}] END)), lambda z: z.v <> '') AS t FROM pages WHERE page_id IS NOT NULL)),
  named AS (SELECT page_id, i, x.k AS k, x.v AS v, lower(regexp_extract(x.v, '^</?([a-zA-Z][^\s/>]*)', 1)) AS tag FROM tok),
  w(page_id, i, ids, names, next, node_id, parent_id, name, v, depth) AS (SELECT page_id, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS VARCHAR[]), CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(0 AS BIGINT) FROM pages WHERE page_id IS NOT NULL
  UNION ALL SELECT page_id, i, CASE WHEN k = 'open' AND NOT alone THEN list_append(cut_ids, next) WHEN k = 'close' THEN ids[1:upto - 1] ELSE cut_ids END, CASE WHEN k = 'open' AND NOT alone THEN list_append(cut, tag) WHEN k = 'close' THEN names[1:upto - 1] ELSE cut END, CASE WHEN k = 'close' THEN next ELSE next + 1 END,
    CASE WHEN k <> 'close' THEN next END, coalesce(cut_ids[len(cut_ids)], -1), CASE k WHEN 'open' THEN tag WHEN 'text' THEN '#text' END, v, len(cut_ids) FROM (
    SELECT n.page_id, n.i, n.k, n.v, n.tag, w.next, w.ids, w.names, n.tag IN {_IN(html.VOID)} OR n.v LIKE '%/>' AS alone, CASE WHEN n.k = 'close' AND list_contains(w.names, n.tag) THEN len(w.names) + 1 - list_position(list_reverse(w.names), n.tag) ELSE len(w.names) + 1 END AS upto,
      CASE WHEN n.k = 'open' AND n.tag IN ('p', 'li') AND w.names[len(w.names)] = n.tag THEN w.names[1:len(w.names) - 1] ELSE w.names END AS cut, CASE WHEN n.k = 'open' AND n.tag IN ('p', 'li') AND w.names[len(w.names)] = n.tag THEN w.ids[1:len(w.ids) - 1] ELSE w.ids END AS cut_ids
    FROM w JOIN named n ON n.page_id = w.page_id AND n.i = w.i + 1)),
  nodes AS (SELECT * FROM w WHERE node_id IS NOT NULL)"""

SQL["html_text_blocks"] = rf"""WITH RECURSIVE {_PARSED}, own AS (SELECT page_id, parent_id, min(node_id) AS first, trim(regexp_replace(string_agg(v, ' ' ORDER BY node_id), '\s+', ' ', 'g')) AS text FROM nodes WHERE name = '#text' GROUP BY 1, 2)
  SELECT o.page_id, CAST(first AS INT) AS "at", n.name, text FROM own o JOIN nodes n ON n.page_id = o.page_id AND n.node_id = o.parent_id WHERE n.name NOT IN ('script', 'style') AND text <> ''"""

SQL["html_allowlist"] = rf"""WITH RECURSIVE {_PARSED}, c AS (SELECT page_id, CAST(node_id AS INT) AS node_id, CASE WHEN name NOT IN {_IN(html.ALLOWED)} THEN 'UNSUPPORTED_HTML' WHEN name <> '#text' AND regexp_matches(v, '(?i)\s(on[a-z]*|{"|".join(html.ACTIVE)})[\s=/>]') THEN 'ACTIVE_ATTRIBUTE'
    WHEN name <> '#text' AND regexp_matches(v, '(?i)\sdata-') AND NOT regexp_matches(v, '(?i)\sdata-slide[\s=>]') THEN 'CUSTOM_DATA' WHEN name = 'meta' AND contains(lower(v), 'http-equiv') THEN 'META_HTTP_EQUIV' END AS code FROM nodes)
  SELECT * FROM c WHERE code IS NOT NULL UNION ALL SELECT page_id, NULL, 'INPUT_LIMIT_EXCEEDED' FROM nodes GROUP BY page_id HAVING count(*) > 50000 OR max(depth) > 64"""

_RULE = r"(-\s*){3,}|(\*\s*){3,}|(_\s*){3,}"
SQL["markdown_blocks"] = rf"""WITH l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS pos FROM (SELECT doc_id, replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM documents)),
  f AS (SELECT *, regexp_matches(line, '^ {{0,3}}(```|~~~)') AS fence FROM l), o AS (SELECT *, coalesce(sum(CASE WHEN fence THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) % 2 = 1 AS inside FROM f),
  k AS (SELECT *, CASE WHEN inside OR fence THEN 'code' WHEN trim(line) = '' THEN 'blank' WHEN lower(trim(line)) = '<!-- pagebreak -->' THEN 'pagebreak' WHEN regexp_matches(line, '^ {{0,3}}#{{1,6}}(\s|$)') THEN 'heading' WHEN regexp_matches(line, '^ {{0,3}}({_RULE})$') THEN 'rule'
    WHEN regexp_matches(line, '^\s*([-*+]|\d{{1,9}}[.)])\s') THEN 'item' WHEN regexp_matches(line, '^ {{0,3}}>') THEN 'quote' WHEN regexp_matches(line, '^\s*\|.*\|\s*$') THEN 'table' ELSE 'paragraph' END AS kind FROM o),
  n AS (SELECT *, (fence AND NOT inside) OR lag(kind) OVER w IS DISTINCT FROM kind OR kind IN ('heading', 'item', 'rule', 'pagebreak') AS new FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
  r AS (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM n),
  c AS (SELECT doc_id, run, pos, kind, CASE kind WHEN 'heading' THEN len(regexp_extract(line, '#{{1,6}}')) WHEN 'item' THEN len(regexp_extract(line, '^\s*')) // 2 + 1 END AS level, CASE kind WHEN 'heading' THEN regexp_replace(regexp_replace(line, '^ {{0,3}}#{{1,6}}\s*', ''), '\s*#*\s*$', '')
    WHEN 'item' THEN regexp_replace(line, '^\s*([-*+]|\d{{1,9}}[.)])\s+', '') WHEN 'quote' THEN regexp_replace(line, '^ {{0,3}}> ?', '') ELSE line END AS txt FROM r WHERE kind <> 'blank'),
  g AS (SELECT doc_id, run, arg_min(kind, pos) AS kind, arg_min(level, pos) AS level, string_agg(txt, chr(10) ORDER BY pos) AS text FROM c GROUP BY doc_id, run)
  SELECT doc_id, kind, CAST(level AS INT) AS level, text, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY run) AS INT) AS ord FROM g"""


@query
def html_nodes(spark, sf_dir):
    return html.nodes(t(spark, sf_dir, "pages"))


@query
def html_allowlist(spark, sf_dir):
    return html.violations(html.nodes(t(spark, sf_dir, "pages")))


@query
def html_text_blocks(spark, sf_dir):
    return html.text_blocks(html.nodes(t(spark, sf_dir, "pages")))


@query
def markdown_blocks(spark, sf_dir):
    return markdown.blocks(t(spark, sf_dir, "documents"))


@query
def note_field_visibility(spark, sf_dir):
    """Text is visible where every open field has reached its result: a fold over the
    markers of a paragraph, which keeps the stack of open fields."""
    kind = F.expr("CASE event_id % 5 WHEN 0 THEN 'begin' WHEN 1 THEN 'separate' WHEN 2 THEN 'end' ELSE 'text' END")
    e = t(spark, sf_dir, "events").select((F.col("user_id") * 100 + F.col("event_id") % 100).alias("paragraph"), "event_id", kind.alias("kind"))
    p = e.groupBy("paragraph").agg(F.array_sort(F.collect_list(F.struct("event_id", "kind"))).alias("xs"))
    fold = """aggregate(xs, struct(cast(array() as array<boolean>) as open, cast(array() as array<bigint>) as seen), (acc, x) -> struct(
      CASE x.kind WHEN 'begin' THEN concat(acc.open, array(false)) WHEN 'separate' THEN if(size(acc.open) > 0, concat(slice(acc.open, 1, size(acc.open) - 1), array(true)), acc.open)
        WHEN 'end' THEN slice(acc.open, 1, greatest(size(acc.open) - 1, 0)) ELSE acc.open END as open,
      if(x.kind = 'text' and forall(acc.open, o -> o), concat(acc.seen, array(x.event_id)), acc.seen) as seen), acc -> acc.seen)"""
    return p.select("paragraph", F.explode(F.expr(fold)).alias("event_id"))


@query
def archive_bundle(spark, sf_dir):
    """Deterministic archives of each source, a new one for each 64 MiB, with the digest of their bytes."""
    d = t(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("seq"), F.format_string("images/page-%06d.md", "doc_id").alias("name"), F.encode("text", "UTF-8").alias("content"))
    return archive.zipped_parts(d, "source").select("source", "part", F.sha2("archive", 256).alias("sha256"))


@query
def job_stream(spark, sf_dir):
    """The state fold as a stream: events as JSON files, keyed state, notifications."""
    at = f"{shared.folder(spark)}/stream-{uuid.uuid4().hex}"
    kind = F.expr("CASE WHEN event_id % 6 < 2 THEN 'submitted' WHEN event_id % 6 < 4 THEN 'running' WHEN event_id % 6 = 4 THEN 'succeeded' ELSE 'failed' END")
    e = t(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("job"), F.col("event_id").alias("seq"), kind.alias("kind"), (F.col("event_id") % 3).cast("string").alias("request"), F.col("ts").cast("timestamp").alias("ts"))
    e.write.json(f"{at}/in")
    key = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key, None)
    spark.conf.set(key, jobs.PROVIDER)
    try:
        q = jobs.lifecycle(jobs.read_events(spark, f"{at}/in")).writeStream.outputMode("append").option("checkpointLocation", f"{at}/state").foreachBatch(jobs.outbox(f"{at}/out")).trigger(availableNow=True).start()
        q.awaitTermination()
    finally:
        spark.conf.set(key, was) if was else spark.conf.unset(key)
    return spark.read.schema(jobs.OUT).option("recursiveFileLookup", "true").json(f"{at}/out")
