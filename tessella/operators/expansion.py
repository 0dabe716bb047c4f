"""Expansion of references: every use of a node stands for a copy of all below it.

Sizes come from the leaves upwards, so an expansion that would double at every reference is known
by its size before any copy is made. A document is folded by one worker, many in one task; one
of more than MOST_HELD nodes and uses takes a round of joins for each step of height instead. Only
documents whose expansion is within the bounds are expanded.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import folded, release, table

MOST_NODES, MOST_DEPTH = 20_000, 64
MOST_HELD = 200_000  # nodes and uses of a document that a worker holds


def edges(nodes: DataFrame, refs: DataFrame, by: list[str]) -> DataFrame:
    """nodes: by, node, parent (null for a root). refs: by, node, target (in any order, each
    use a row). by, a, b: what expands below what; a repeated row is a second copy."""
    tree = nodes.where("parent IS NOT NULL").select(*by, F.col("parent").alias("a"), F.col("node").alias("b"))
    held = nodes.select(*by, F.col("node").alias("target"))
    return tree.unionByName(refs.join(held.hint("merge"), [*by, "target"], "left_semi").select(*by, F.col("node").alias("a"), F.col("target").alias("b")))


def _sizes(rows: Iterator[tuple], most: int, roots: bool) -> Iterator[tuple]:
    """node, size and height of a document's nodes. rows: a, b and whether a is b's parent (null for a root)."""
    rows = list(rows)
    held, tops = {b for _, b, own in rows if own}, {b for a, b, own in rows if own and a is None}
    above: dict = {}
    left: dict = {}  # uses below a node whose size is not known yet
    for a, b, _ in rows:
        if a is not None and b in held:
            above.setdefault(b, []).append(a)
            left[a] = left.get(a, 0) + 1
    known, front = {n: (1, 0) for n in held if n not in left}, [n for n in held if n not in left]
    below = {a: (1, 0) for a in left}
    while front:
        n = front.pop()
        size, height = known[n]
        for a in above.get(n, ()):
            total, high = below[a]
            below[a] = total + size, max(high, height + 1)
            left[a] -= 1
            if not left[a]:
                known[a] = min(below[a][0], most + 1), below[a][1]
                front.append(a)
    yield from ((n, *k) for n, k in known.items() if not roots or n in tops)


def _copies(rows: Iterator[tuple], most: int, deep: int) -> Iterator[tuple]:
    """node, depth and copies of a document's expansion, all its roots within the bounds together. rows: as of _sizes()."""
    rows = list(rows)
    held = {b for _, b, own in rows if own}
    below: dict = {}
    for a, b, _ in rows:
        if a is not None and b in held:
            below.setdefault(a, []).append(b)
    front = {n: 1 for n, size, height in _sizes(iter(rows), most, True) if size <= most and height <= deep}
    depth = 0
    while front:
        yield from ((n, depth, k) for n, k in front.items())
        now: dict = {}
        for n, k in front.items():
            for b in below.get(n, ()):
                now[b] = now.get(b, 0) + k
        front, depth = now, depth + 1


def _by_size(nodes: DataFrame, refs: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """The rows (by, a, b, own) of the documents that a worker holds, and the by of those that are larger, if any."""
    own = nodes.select(*by, F.col("parent").alias("a"), F.col("node").alias("b"), F.lit(True).alias("own"))
    rows = table(own.unionByName(refs.select(*by, F.col("node").alias("a"), F.col("target").alias("b"), F.lit(False).alias("own"))))
    large = table(rows.groupBy(*by).agg(F.count("*").alias("n")).where(F.col("n") > MOST_HELD).select(*by))
    return (rows.join(large, by, "left_anti"), large) if large.limit(1).count() else (rows, None)


def sized(nodes: DataFrame, refs: DataFrame, by: list[str], most: int = MOST_NODES, roots: bool = False) -> DataFrame:
    """by, node, size and height of the expansion below each node, itself included (size is
    most + 1 where it is more). Nodes on a cycle, or above one, have no row. With ``roots``, those
    below a parent may have none either."""
    small, large = _by_size(nodes, refs, by)
    out = folded(small, by, [], ["a", "b", "own"], {"node": "b", "size": "long", "height": "int"}, lambda rows: _sizes(rows, most, roots))
    if large is not None:
        out = out.unionByName(_rounds(nodes.join(large, by, "left_semi"), refs.join(large, by, "left_semi"), by, most))
    return out


def _rounds(nodes: DataFrame, refs: DataFrame, by: list[str], most: int) -> DataFrame:
    """sized() by joins, for documents of any size."""
    each = edges(nodes, refs, by).groupBy(*by, "a", "b").agg(F.count("*").alias("uses"))
    inner = each.select(*by, F.col("a").alias("node")).distinct()
    front = table(nodes.select(*by, "node").distinct().join(inner, [*by, "node"], "left_anti").select("*", F.lit(1).cast("long").alias("size"), F.lit(0).alias("height")))
    known, k = front, 0
    open_ = table(each.withColumn("size", F.lit(None).cast("long")).withColumn("height", F.lit(None).cast("int")))
    open_held = open_
    while front.limit(1).count():
        k += 1
        told = front.select(*by, F.col("node").alias("b"), F.col("size").alias("_size"), F.col("height").alias("_high"))
        open_ = open_.join(front.select(*by, F.col("node").alias("a")), [*by, "a"], "left_anti").join(told, [*by, "b"], "left")
        open_ = open_.select(*by, "a", "b", "uses", F.coalesce("size", "_size").alias("size"), F.coalesce("height", "_high").alias("height"))
        if k % 4 == 0:
            held, open_ = open_held, table(open_)
            release(held)
            open_held = open_
        sums = open_.groupBy(*by, F.col("a").alias("node")).agg(F.sum(F.col("uses") * F.col("size")).alias("_size"), F.max("height").alias("_high"), F.count_if(F.col("size").isNull()).alias("_open"))
        front = table(sums.where("_open = 0").select(*by, "node", F.least(F.col("_size") + 1, F.lit(most + 1)).alias("size"), (F.col("_high") + 1).alias("height")))
        known = known.unionByName(front)
    return known


def problem(size: Column, height: Column, nodes: int = MOST_NODES, depth: int = MOST_DEPTH) -> Column:
    return F.when(size.isNull(), "CYCLE").when(size > nodes, "NODES").when(height > depth, "DEPTH")


def checked(nodes: DataFrame, refs: DataFrame, by: list[str], most: int = MOST_NODES, depth: int = MOST_DEPTH) -> DataFrame:
    """A row for each root: by, node, size, height and the reason why it may not be expanded, or
    null. A document has a root for each node without a parent."""
    roots = nodes.where("parent IS NULL").select(*by, "node")
    return roots.join(sized(nodes, refs, by, most, roots=True).hint("merge"), [*by, "node"], "left").withColumn("problem", problem(F.col("size"), F.col("height"), most, depth))


def instances(nodes: DataFrame, refs: DataFrame, by: list[str], verdict: DataFrame) -> DataFrame:
    """verdict: of checked(). The copies of every root without a problem: by, path (the nodes from the
    root to the copy), node, depth and copy, which tells apart the uses of one node by another.
    A document has MOST_NODES rows at most, by its verdict."""
    each = table(edges(nodes, refs, by).groupBy(*by, "a", "b").agg(F.count("*").alias("uses")).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("uses").cast("int")))).drop("uses"))
    fine = verdict.where("problem IS NULL")
    front = table(fine.select(*by, F.array("node").alias("path"), "node", F.lit(0).alias("depth"), F.lit(1).alias("copy")))
    out, k = front, 0
    while front.limit(1).count():
        k += 1
        below = front.select(*by, "path", F.col("node").alias("a")).join(each.hint("merge"), [*by, "a"])  # paths are far larger than their files
        front = table(below.select(*by, F.concat("path", F.array("b")).alias("path"), F.col("b").alias("node"), F.lit(k).alias("depth"), "copy"))
        out = out.unionByName(front)
    return out


def copies(nodes: DataFrame, refs: DataFrame, by: list[str], most: int = MOST_NODES, depth: int = MOST_DEPTH) -> DataFrame:
    """How many copies of each node the expansions of checked() without a problem hold at each depth:
    by, node, depth, copies. The copies are counted, not made; a document of more than MOST_HELD
    nodes and uses takes a round of joins for each step of depth."""
    small, large = _by_size(nodes, refs, by)
    out = folded(small, by, [], ["a", "b", "own"], {"node": "b", "depth": "int", "copies": "long"}, lambda rows: _copies(rows, most, depth))
    if large is None:
        return out
    nodes, refs = nodes.join(large, by, "left_semi"), refs.join(large, by, "left_semi")
    each = table(edges(nodes, refs, by).groupBy(*by, "a", "b").agg(F.count("*").alias("uses")))
    front = table(checked(nodes, refs, by, most, depth).where("problem IS NULL").select(*by, "node", F.lit(0).alias("depth"), F.lit(1).cast("long").alias("copies")))
    k = 0
    while front.limit(1).count():
        out, k = out.unionByName(front), k + 1
        below = front.withColumnRenamed("node", "a").join(each.hint("merge"), [*by, "a"])
        front = table(below.groupBy(*by, F.col("b").alias("node")).agg(F.sum(F.col("copies") * F.col("uses")).alias("copies")).select(*by, "node", F.lit(k).alias("depth"), "copies"))
    return out
