"""HTML as a node table, and the allow-list over it.

Parsing is the only Python here: one pass of the standard parser for each page. The
rules are joins and predicates over nodes.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import spread

NODES = "page_id long, node_id int, parent_id int, ord int, depth int, name string, attrs map<string,string>, text string"
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements and attributes that input may hold (fixed values).
ALLOWED = (
    "html head title meta style link body div section article header footer main aside nav span p h1 h2 h3 h4 h5 h6 a strong b em i u s del small sub sup br hr ul ol li dl dt dd blockquote "
    "pre code figure figcaption img table thead tbody tfoot tr td th colgroup col abbr bdi bdo cite q time address wbr mark kbd samp var svg g defs rect circle ellipse line polyline polygon path text tspan "
    "lineargradient radialgradient stop marker use clippath desc #text"
).split()
ACTIVE = "srcdoc srcset imagesrcset ping background action formaction form manifest codebase archive data poster".split()
#: Nodes that a worker holds besides a page's own, and pages that it is handed at once.
MOST_ROWS, MOST_PAGES = 4096, 512
BLOCKS = "address article aside blockquote dd div dl dt figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th title tr ul".split()


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.stack: list[int] = []
        self.children: dict[int, int] = {}

    def add(self, name: str, attrs: dict, text: str | None) -> int:
        parent = self.stack[-1] if self.stack else -1
        k = self.children.get(parent, 0)
        self.children[parent] = k + 1
        self.rows.append([len(self.rows), parent, k, len(self.stack), name, attrs, text])
        return len(self.rows) - 1

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "li") and self.stack and self.rows[self.stack[-1]][4] == tag:
            self.stack.pop()
        n = self.add(tag, {k: v or "" for k, v in reversed(attrs)}, None)
        if tag not in VOID:
            self.stack.append(n)

    def handle_startendtag(self, tag, attrs):
        self.add(tag, {k: v or "" for k, v in reversed(attrs)}, None)

    def handle_endtag(self, tag):
        for k in range(len(self.stack) - 1, -1, -1):
            if self.rows[self.stack[k]][4] == tag:
                del self.stack[k:]
                break

    def handle_data(self, data):
        self.add("#text", {}, data)


def few_pages(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= MOST_PAGES:
        spark.conf.set(key, str(MOST_PAGES))


def nodes(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """A row for each element and text of each page, in document order. A worker holds MOST_PAGES
    pages and MOST_ROWS nodes, or one page's nodes if they are more."""
    names = [x.split()[0] for x in NODES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, h in zip(b["k"], b["h"], strict=True):
                tree = _Tree()
                tree.feed(h or "")
                tree.close()
                out += [(k, *r) for r in tree.rows]
                if len(out) >= MOST_ROWS:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            yield pd.DataFrame(out, columns=names)

    rows = pages.select(F.col(key).cast("long").alias("k"), F.col(html).alias("h")).where("k is not null")
    few_pages(pages.sparkSession)
    return spread(rows).mapInPandas(run, NODES)


def violations(node_table: DataFrame, most_nodes: int = 50_000, most_depth: int = 64) -> DataFrame:
    """page_id, node_id (null for limits) and the code of what the input rules forbid."""
    keys = F.map_keys("attrs")
    active = F.exists(keys, lambda k: k.startswith("on") | k.isin(ACTIVE))
    custom = F.exists(keys, lambda k: k.startswith("data-") & (k != "data-slide"))
    refresh = (F.col("name") == "meta") & F.array_contains(keys, "http-equiv")
    code = F.when(~F.col("name").isin(ALLOWED), "UNSUPPORTED_HTML").when(active, "ACTIVE_ATTRIBUTE").when(custom, "CUSTOM_DATA").when(refresh, "META_HTTP_EQUIV")
    single = node_table.select("page_id", "node_id", code.alias("code")).where("code is not null")
    limits = node_table.groupBy("page_id").agg(F.count("*").alias("n"), F.max("depth").alias("d")).where((F.col("n") > most_nodes) | (F.col("d") > most_depth))
    return single.unionByName(limits.select("page_id", F.lit(None).cast("int").alias("node_id"), F.lit("INPUT_LIMIT_EXCEEDED").alias("code")))


def text_blocks(node_table: DataFrame) -> DataFrame:
    """Text of each element that holds text itself, white space collapsed, in order."""
    own = node_table.where("name = '#text'").groupBy("page_id", "parent_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node_id", "text"))), lambda x: x["text"]), " ").alias("raw"), F.min("node_id").alias("at"))
    text = F.trim(F.regexp_replace("raw", r"\s+", " "))
    names = node_table.select("page_id", F.col("node_id").alias("parent_id"), "name").where(~F.col("name").isin("script", "style"))
    return own.join(names, ["page_id", "parent_id"]).select("page_id", "at", "name", text.alias("text")).where("text <> ''")
