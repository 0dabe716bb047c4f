"""Graphs: edge resolution, directions, components and closures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import shared
from ..functions import markdown

ARROWS, PLAIN = ("triangle", "stealth", "arrow"), ("none", "oval", "diamond")


def marker(m: Column) -> Column:
    return F.when(m.isNull() | (F.trim(m) == ""), "none").otherwise(m)


def direction(start: Column, end: Column) -> Column:
    """Direction along a line from the arrowheads at its ends."""
    known = start.isin(*ARROWS, *PLAIN) & end.isin(*ARROWS, *PLAIN)
    a, b = start.isin(*ARROWS), end.isin(*ARROWS)
    return F.when(~known, "unknown").when(a & b, "bidirectional").when(a, "end-to-start").when(b, "start-to-end").otherwise("undirected")


def resolve(vertices: DataFrame, connections: DataFrame, by: list[str]) -> DataFrame:
    """vertices: by, id, source_id. connections: by, id, start_id, end_id (saved source
    ids), start_arrow, end_arrow. Adds the vertex ids, the direction, a status and the
    first reason why an edge is not resolved. A source id must name one vertex."""
    named = vertices.where("trim(source_id) <> ''").groupBy(*by, "source_id").agg(F.count("*").alias("n"), F.min("id").alias("vid"))
    out = connections
    for end in ("start", "end"):
        side = named.select(*by, F.col("source_id").alias(f"{end}_id"), F.col("n").alias(f"_{end}_n"), F.col("vid").alias(f"_{end}_v"))
        out = out.join(side, [*by, f"{end}_id"], "left")

    def reason(end: str) -> Column:
        saved, n = F.col(f"{end}_id"), F.col(f"_{end}_n")
        return F.when(saved.isNull() | (F.trim(saved) == ""), "MISSING_ENDPOINT").when(n.isNull(), "TARGET_UNAVAILABLE").when(n > 1, "AMBIGUOUS_TARGET")

    way = direction(marker(F.col("start_arrow")), marker(F.col("end_arrow")))
    why = F.coalesce(reason("start"), reason("end"), F.when(way == "unknown", "UNKNOWN_ARROWHEAD"), F.lit(""))
    vid = [F.when(F.col(f"_{e}_n") == 1, F.col(f"_{e}_v")).alias(f"{e}_vertex") for e in ("start", "end")]
    return out.select(*by, "id", *vid, way.alias("direction"), F.when(why == "", "resolved").otherwise("unresolved").alias("status"), why.alias("reason"))


REASONS = {
    "MISSING_ENDPOINT": "接続先の保存情報がありません",
    "TARGET_UNAVAILABLE": "接続先が出力対象にありません",
    "AMBIGUOUS_TARGET": "接続先IDが重複しています",
    "UNKNOWN_ARROWHEAD": "矢印の向きを確定できません",
}


def diagram(vertices: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    """vertices: by, id, pos, type, text. edges: as of resolve(), listed by id. The
    Markdown of each diagram: its items with a text or an edge, then all its edges."""
    name = lambda c: F.replace(markdown.escape(c.cast("string")), F.lit("\\-"), F.lit("-"))
    blank = ~F.coalesce(F.col("text").rlike(r"\S"), F.lit(False))
    ends = edges.select(*by, F.explode(F.array("start_vertex", "end_vertex")).alias("id")).where("id is not null").distinct().withColumn("_ref", F.lit(True))
    shown = vertices.join(ends, [*by, "id"], "left").where(~blank | F.col("_ref"))
    told = F.replace(F.replace(markdown.escape(F.col("text")), F.lit("  \n"), F.lit("<br>")), F.lit("\n"), F.lit("<br>"))
    item = F.concat(F.lit("- "), name(F.col("id")), F.lit("（"), markdown.escape(F.coalesce("type", F.lit(""))), F.lit("）："), F.when(blank, "文字なし").otherwise(told), F.lit("\n"))

    def listed(rows: DataFrame, pos: str, line: Column, head: str) -> DataFrame:
        lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("pos"), line.alias("md")))), lambda x: x["md"])
        return rows.groupBy(*by).agg(F.concat(F.lit(f"{head}:\n\n"), F.array_join(lines, ""), F.lit("\n")).alias(f"_{pos}"))

    label = F.concat(name(F.col("id")), F.when(blank, "（文字なし）").otherwise(F.concat(F.lit("「"), markdown.escape(markdown.single_line(F.col("text"))), F.lit("」"))))
    lines = edges
    for end in ("start", "end"):
        lines = lines.join(vertices.select(*by, F.col("id").alias(f"{end}_vertex"), label.alias(f"_{end}")), [*by, f"{end}_vertex"], "left")
    a, b, way = F.col("_start"), F.col("_end"), F.col("direction")
    why = F.coalesce(F.create_map(*[F.lit(x) for kv in REASONS.items() for x in kv])[F.col("reason")], F.lit("保存情報を解決できません"))
    relation = (
        F.when(F.col("status") != "resolved", F.concat(F.lit("接続関係不明（"), why, F.lit("）")))
        .when(way == "start-to-end", F.concat(a, F.lit(" → "), b)).when(way == "end-to-start", F.concat(b, F.lit(" → "), a))
        .when(way == "bidirectional", F.concat(a, F.lit(" ↔ "), b)).otherwise(F.concat(a, F.lit(" — "), b, F.lit("（向きなし）")))
    )
    line = F.concat(F.lit("- "), name(F.col("id")), F.lit("："), relation, F.lit("\n"))
    out = listed(shown, "pos", item, "図中の項目").join(listed(lines, "id", line, "接続関係"), by, "full_outer")
    return out.select(*by, F.concat(F.coalesce("_pos", F.lit("")), F.coalesce("_id", F.lit(""))).alias("markdown"))


def _checkpoint_dir(df: DataFrame) -> None:
    shared.folder(df.sparkSession)


def settled(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, for what is read more than once."""
    return shared.table(df)


def components(nodes: DataFrame, edges: DataFrame, node: str = "id", a: str = "a", b: str = "b", inside: bool = False) -> DataFrame:
    """node and root (the least node of its component). Large-star and small-star rounds until
    nothing changes: rounds grow with the logarithm of a component's width, and edges never
    become more. Each round is a table in the shared folder; the driver sees a count and a
    checksum. Edges to what is no node count for nothing; ``inside`` says that there are none."""
    own = nodes.select(F.col(node).alias("u")).distinct()
    ends = [F.col(c).cast(nodes.schema[node].dataType) for c in (a, b)]
    links = edges.select(F.greatest(*ends).alias("u"), F.least(*ends).alias("v")).where("u <> v").distinct()
    if not inside:
        links = links.join(own, "u", "left_semi").join(own.withColumnRenamed("u", "v"), "v", "left_semi").select("u", "v")
    now = shared.table(links)

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    def pairs(u: Column, v: Column) -> Column:
        return F.struct(u.alias("u"), v.alias("v"))

    u, v, m = F.col("u"), F.col("v"), F.col("m")
    seen = mark(now)
    while seen[0]:
        low = shared.table(now.select(F.explode(F.array(pairs(u, v), pairs(v, u))).alias("e")).select("e.*").groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        # An edge goes from its greater end to the least that the lesser one knows.
        large = shared.table(now.join(low.withColumnRenamed("u", "v"), "v").select("u", F.col("m").alias("v")).where("u <> v").distinct())
        least = shared.table(large.groupBy("u").agg(F.min("v").alias("m")))
        met = large.join(least, "u").where("v <> m").select(v.alias("u"), m.alias("v"))
        small = shared.table(least.select("u", F.col("m").alias("v")).unionByName(met).distinct())
        shared.release(now, low, large, least)
        now, was = small, seen
        seen = mark(now)
        if seen == was:
            break
    return own.join(now.select("u", F.col("v").alias("root")), "u", "left").select(F.col("u").alias(node), F.coalesce("root", "u").alias("root"))


def closure(edges: DataFrame, start: DataFrame, depth: int | None = None) -> DataFrame:
    """Nodes reachable from start (column n) over edges (a -> b), with the least number
    of steps (depth at most, if given); a frontier at a time, so cycles end it."""
    _checkpoint_dir(edges)
    seen = start.select("n").distinct().withColumn("steps", F.lit(0)).checkpoint()
    front = seen
    k = 0
    while depth is None or k < depth:
        k += 1
        new = front.join(edges, front["n"] == edges["a"]).select(F.col("b").alias("n")).distinct()
        new = new.join(seen.select("n"), "n", "left_anti").withColumn("steps", F.lit(k)).checkpoint()
        if not new.limit(1).count():
            break
        seen, front = seen.unionByName(new), new
    return seen


def in_reference_order(refs: DataFrame, by: list[str]) -> DataFrame:
    """refs: by, source (null for the body), target, pos. Each target once, numbered in the
    order in which it is first referred to: those of the body, then those of each target in
    turn. A round for each step from the body; cycles end."""
    _checkpoint_dir(refs)
    first = refs.where("source IS NULL").groupBy(*by, F.col("target").alias("node")).agg(F.min("pos").alias("pos"))
    order = Window.partitionBy(*by).orderBy("pos", "node")
    seen = first.select(*by, "node", F.lit(0).alias("step"), F.row_number().over(order).cast("long").alias("number")).checkpoint()
    front, k = seen, 0
    while front.limit(1).count():
        k += 1
        found = front.join(refs, by).where("source = node").groupBy(*by, "target").agg(F.min(F.struct("number", "pos")).alias("_at"))
        found = found.withColumnRenamed("target", "node").join(seen.select(*by, "node"), [*by, "node"], "left_anti")
        base = seen.groupBy(*by).agg(F.max("number").alias("_base"))
        rank = F.row_number().over(Window.partitionBy(*by).orderBy("_at", "node"))
        front = found.join(base, by).select(*by, "node", F.lit(k).alias("step"), (F.col("_base") + rank).alias("number")).checkpoint()
        seen = seen.unionByName(front)
    return seen


def inherited(styles: DataFrame, columns: list[str], key: str = "id", parent: str = "based_on", depth: int = 63) -> DataFrame:
    """styles with every column taken from the nearest ancestor that sets it; a chain is
    64 styles at most, as in the reference, and ends where it comes back to one of its own."""
    _checkpoint_dir(styles)
    out = styles.select(key, *columns, F.col(parent).alias("_up"), F.array(key).alias("_seen"))
    base = styles.select(F.col(key).alias("_k"), *[F.col(c).alias(f"_{c}") for c in columns], F.col(parent).alias("_next"))
    for k in range(depth):
        if not out.where("_up is not null").limit(1).count():
            break
        out = out.withColumn("_up", F.when(~F.array_contains("_seen", F.col("_up")), F.col("_up"))).join(base, F.col("_up") == base["_k"], "left")
        out = out.select(key, *[F.coalesce(c, f"_{c}").alias(c) for c in columns], F.col("_next").alias("_up"), F.concat("_seen", F.array("_k")).alias("_seen"))
        out = out.checkpoint() if k % 4 == 3 else out
    return out.select(key, *columns)
