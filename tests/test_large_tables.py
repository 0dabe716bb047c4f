"""What showed on larger tables only."""

import random

from pyspark.sql import functions as F

from tessella.functions import drawing
from tessella.llm import near_dup, simhash
from tessella.operators import drawings, expansion, graph, grid, numbering, ordered, packages, pages, ranges, splits
from tessella.plans import catalog, catalog_deep  # noqa: F401  (the second registers itself in the first)
from tessella.sources import html

DATA = "/root/testdata/sf0.001"


def test_saturation_without_room(spark):
    # 1.5 and 0.5: the light is 1 exactly, and the saturation has no room below it.
    c = F.struct(F.lit(1.5).alias("r"), F.lit(0.5).alias("g"), F.lit(0.5).alias("b"), F.lit(1.0).alias("a"))
    mods = F.array(F.struct(F.lit("lumMod").alias("kind"), F.lit(0.5).alias("amount")))
    got = spark.range(1).select(drawing.modified(c, mods).alias("c")).select("c.*").first()
    assert [round(x, 9) for x in got] == [1.0, 0.0, 0.0, 1.0]


def test_rounds_of_components_keep_their_estimates(spark):
    # The planner's estimate of a checkpoint multiplied with every join of a round: its digits doubled.
    nodes = spark.range(200).selectExpr("struct('s' AS k, id * 7 % 200 AS id) AS id")
    edges = spark.range(199).where("id % 50 <> 49").selectExpr("struct('s' AS k, id) AS a", "struct('s' AS k, id + 1 AS id) AS b")
    out = graph.components(nodes, edges)
    assert {(r.id.id, r.root.id) for r in out.collect()} == {(i, i // 50 * 50) for i in range(200)}
    assert out._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length() < 100


def test_edges_to_no_node(spark):
    nodes = spark.createDataFrame([(1,), (3,), (5,), (6,)], "id int")
    edges = spark.createDataFrame([(1, 2), (2, 3), (6, 5), (5, 5), (5, 6)], "a int, b int")
    assert sorted(map(tuple, graph.components(nodes, edges).collect())) == [(1, 1), (3, 3), (5, 5), (6, 5)]


def test_components_of_merged_units(spark):
    # A tall and a wide unit, a unit under both, one that only touches a corner, and one of another section.
    boxes = spark.createDataFrame([(1, 0, 2, 4, 4), (1, 3, 3, 0, 3), (1, 4, 4, 3, 4), (1, 5, 6, 5, 6), (2, 3, 3, 4, 4), (1, 9, 9, 0, 0), (1, 9, 9, 2, 2)], "sheet int, r1 int, r2 int, c1 int, c2 int")
    got = {(r.sheet, r.r1, r.c1): (r.root_r, r.root_c) for r in grid.component_of(boxes, ["sheet"]).collect()}
    assert got == {(1, 0, 4): (0, 4), (1, 3, 0): (3, 0), (1, 4, 3): (3, 0), (1, 5, 5): (5, 5), (2, 3, 4): (3, 4), (1, 9, 0): (9, 0), (1, 9, 2): (9, 2)}


def test_adjacent_units_once_without_a_distinct(spark):
    # A wide unit over a wide one that begins left of it, and a tall one at the side of both.
    boxes = spark.createDataFrame([(1, 0, 0, 1, 3), (1, 1, 1, 0, 3), (1, 0, 1, 4, 4), (1, 2, 2, 4, 4)], "sheet int, r1 int, r2 int, c1 int, c2 int")
    out = grid.adjacent(boxes, ["sheet"])
    assert sorted(map(tuple, out.drop("sheet").collect())) == [(0, 1, 0, 4), (0, 1, 1, 0), (0, 4, 2, 4), (1, 0, 0, 4)]
    assert "Aggregate" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_segments_are_corners_first(spark):
    cells = spark.createDataFrame([(1, 2, 3, True, True, None, True), (1, 3, 3, True, False, True, False)], "sheet int, row int, col int, bt boolean, bb boolean, bl boolean, br boolean")
    out = grid.segments(cells, ["sheet"])
    assert sorted(map(tuple, out.collect())) == [(1, "h", 2, 3), (1, "h", 3, 3), (1, "v", 2, 4), (1, "v", 3, 3)]
    assert "Aggregate [sheet#" in (plan := out._jdf.queryExecution().optimizedPlan().toString()) and "kind" not in plan.split("Aggregate [")[1].split("]")[0]


def test_glyphs_of_one_number_go_by_place(spark):
    glyphs = spark.createDataFrame([(1, 5, "s", 20.0, 0.0, 8.0, "b"), (1, 5, "s", 10.0, 0.0, 8.0, "c"), (1, 6, "s", 30.0, 0.0, 8.0, "a")], "doc int, seq long, style string, x double, y double, w double, text string")
    assert [(r.x, r.right, r.text) for r in ordered.fragments(glyphs.coalesce(1), ["doc"], 4.0).collect()] == [(10.0, 38.0, "cba")]


def test_glyphs_of_one_number_are_not_parted(spark):
    # Two styles under one number: SQL's running sum gives both the number of the last one.
    glyphs = spark.createDataFrame([(1, 4, "s", 0.0, 0.0, 8.0, "a"), (1, 5, "s", 10.0, 0.0, 8.0, "b"), (1, 5, "t", 20.0, 0.0, 8.0, "c"), (1, 6, "u", 30.0, 0.0, 8.0, "d")], "doc int, seq long, style string, x double, y double, w double, text string")
    assert sorted((r.fragment, r.x, r.right, r.text) for r in ordered.fragments(glyphs, ["doc"], 4.0).collect()) == [(1, 0.0, 8.0, "a"), (2, 10.0, 28.0, "bc"), (3, 30.0, 38.0, "d")]


def _written(monkeypatch, *modules):
    """The plans of the tables that modules write from now on."""
    plans = []
    for m in modules:
        monkeypatch.setattr(m, "table", lambda df, was=m.table: (plans.append(df._jdf.queryExecution().executedPlan().toString()), was(df))[1])
    return plans


def test_nodes_are_not_broadcast(spark, monkeypatch):
    plans = _written(monkeypatch, expansion)
    out = catalog.QUERIES["expanded_nodes"](spark, DATA)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_fingerprints_are_not_broadcast(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"one two three four {i // 2}") for i in range(6)], "doc_id long, text string")
    plans = _written(monkeypatch, simhash, near_dup)
    for out in (simhash.linked(docs, hot=1), near_dup.join(docs), near_dup.one_of_each(docs)):
        plans.append(out._jdf.queryExecution().executedPlan().toString())
        assert out.count() >= 3
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_named_bands_are_not_broadcast(spark, monkeypatch):
    plans = _written(monkeypatch, splits)
    out = catalog.QUERIES["named_bands"](spark, DATA)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert out.count() and not any("Broadcast" in p for p in plans)


def test_much_work_on_a_small_file_is_spread(spark):
    for q in ("path_segments", "picture_clips"):
        assert catalog.QUERIES[q](spark, DATA).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_pages_of_a_grid_are_numbered_without_a_sort(spark):
    out = catalog.QUERIES["page_grid"](spark, DATA)
    assert "row_number" not in (plan := out._jdf.queryExecution().executedPlan().toString()) and "[sheet#" in plan and ", key#" in plan
    assert {r.sheet: (r.n, r.m) for r in out.groupBy("sheet").agg(F.countDistinct("number").alias("n"), F.max("number").alias("m")).collect()} == {r.sheet: (r.n, r.n) for r in out.groupBy("sheet").agg(F.count("*").alias("n")).collect()}


def test_nodes_leave_a_worker_in_parts(spark, monkeypatch):
    pages = spark.createDataFrame([(k, "<p>a</p>" * 8) for k in range(40)], "page_id long, html string").coalesce(1)
    sizes = []
    monkeypatch.setattr(html, "MOST_ROWS", 64)
    monkeypatch.setattr(html, "spread", lambda df: df)
    monkeypatch.setattr(type(pages), "mapInPandas", lambda self, run, schema: sizes.extend(len(x) for x in run(iter([self.toPandas()]))) or self)
    html.nodes(pages)
    assert sum(sizes) == 640 and max(sizes) == 64


def test_sections_of_one_task_are_numbered_without_a_frame_each(spark):
    rows = [(doc, ord_, 1, ord_ % 2, "decimal", "%1." if ord_ % 2 == 0 else "%1.%2", 1, None) for doc in (*range(50), None, (1 << 53) + 1) for ord_ in (3, 1, 0, 2)]
    p = spark.createDataFrame(rows, "doc long, ord int, num_id int, level int, format string, pattern string, start int, restart int").coalesce(1)
    out = numbering.numbered(p, ["doc"])
    assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r.doc, r.ord): r.label for r in out.collect()}
    assert got == {(doc, k): v for doc in (*range(50), None, (1 << 53) + 1) for k, v in enumerate(("1.", "1.1", "2.", "2.1"))}


def test_rounds_of_a_package_read_tables(spark, monkeypatch):
    plans, closure = [], packages.graph.closure
    monkeypatch.setattr(packages.graph, "closure", lambda edges, start: (plans.append(edges._jdf.queryExecution().executedPlan().toString()), closure(edges, start))[1])
    out = catalog.QUERIES["package_parts"](spark, DATA)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert out.count() and "Join" not in plans[0] and not any("lineitem" in p for p in plans)


def test_items_of_a_preview_are_joined_once(spark, monkeypatch):
    items = spark.createDataFrame([(1, k, 0.0 if k < 6 else 5000.0 * k, 0.0, 10.0, 10.0) for k in range(10)], "sheet int, id int, x double, y double, width double, height double")
    links = spark.createDataFrame([(1, 0, 1), (1, 2, 3), (1, 6, 7), (1, 8, 9)], "sheet int, a int, b int")
    regions = spark.createDataFrame([(1, k, 0, 1, 0, 1, 0.0, 0.0, 5.0, 5.0) for k in (70, 71, 72)], "sheet int, id int, r1 int, r2 int, c1 int, c2 int, x double, y double, width double, height double")
    touching = spark.createDataFrame([(1, 70, 1), (1, 70, 3), (1, 71, 7), (1, 71, 9), (1, 71, 99)], "sheet int, region int, item int")
    sizes, components = [], drawings.graph.components
    monkeypatch.setattr(drawings.graph, "components", lambda nodes, edges: (sizes.append(nodes.where("id.kind = 'item'").distinct().count()), components(nodes, edges))[1])
    got = {(r.kind, r.id): (r.root.kind, r.root.id) for r in drawings.grouped(items, links, regions, touching, 1_000_000, ["sheet"]).collect()}
    want = {("item", k): ("item", v) for k, v in enumerate((0, 0, 0, 0, 4, 5, 6, 6, 8, 8))}
    assert got == want | {("region", 70): ("item", 0), ("region", 72): ("region", 72)} and sizes == [10, 4]


def test_turns_are_found_in_the_row_of_an_effect(spark):
    plan = catalog.QUERIES["animation_behaviours"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "Window" not in plan


def test_bands_are_counted_without_a_row_for_each_cell(spark, tmp_path):
    # Orders 0, 16 and 96 * 16: rows 0, 1 and 96; a cell without any quantity is none.
    rows = [(0, 1, 5), (0, 1, 6), (16, 70, 5), (16, 2, None), (32, 1, None), (96 * 16, 1, 5), (96 * 16, 2, 5)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber long, l_quantity long").write.parquet(f"{tmp_path}/lineitem.parquet")
    out = catalog.QUERIES["eligible_bands"](spark, str(tmp_path))
    assert [tuple(r) for r in out.select("sheet", "band", "n_rows", "n_cols").collect()] == [(0, 0, 2, 2)]
    assert "Expand" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_tables_flow_without_a_frame_each(spark):
    rows = [(doc, r, n) for doc in (1, None, (1 << 53) + 1) for r, n in ((2, 3), (0, 2), (1, 4))]
    out = pages.chunked(spark.createDataFrame(rows, "doc long, row long, lines int").coalesce(1), ["doc"], 68, 10, 4)
    assert "FlatMapGroups" not in out._jdf.queryExecution().executedPlan().toString()
    got = {}
    for r in out.collect():
        got.setdefault(r.doc, []).append((r.row, r["first"], r["count"], r.page))
    assert got == {doc: [(0, 0, 2, 0), (1, 0, 3, 0), (1, 3, 1, 1), (2, 0, 1, 1), (2, 1, 2, 2)] for doc in (1, None, (1 << 53) + 1)}


def test_scopes_without_pairs(spark, monkeypatch):
    # Boxes of three densities, some without an extent or a place, on tiles and in parts smaller than they are.
    rng, rows = random.Random(3), []
    for page, (n, far) in enumerate([(60, 900), (90, 300), (80, 40)]):
        rows += [(len(rows) + k, page, rng.choice([None, 1]), rng.randrange(far), rng.randrange(far), rng.choice([0, 5, 40, 90]) if k % 9 == 0 else rng.randint(5, 60), rng.randint(5, 60), k % 4 == 0, k % 5) for k in range(n)]
    rows.append((len(rows), 0, 1, None, 3, 5, 5, True, 1))
    up = list(range(len(rows)))

    def top(k):
        return k if up[k] == k else top(up[k])

    for a in rows:
        for b in rows:
            if a[0] < b[0] and a[1:3] == b[1:3] and None not in (a[3], b[3]) and a[3] < b[3] + b[5] and b[3] < a[3] + a[5] and a[4] < b[4] + b[6] and b[4] < a[4] + a[6]:
                u, v = sorted((top(a[0]), top(b[0])))
                up[v] = u
    want = {r[0]: top(r[0]) for r in rows}
    assert len(set(want.values())) > 20
    df = spark.createDataFrame(rows, "id long, page int, ref int, x int, y int, w int, h int, behind boolean, z int")
    monkeypatch.setattr(ranges, "overlapping", lambda left, *rest, was=ranges.overlapping: was(left.where("w = 0"), *rest))  # pairs for boxes without an extent alone
    for sizes in ((256, 1 << 16), (16, 3)):
        monkeypatch.setattr(drawings, "TILE", sizes[0])
        monkeypatch.setattr(drawings, "MOST_HELD", sizes[1])
        assert {r.id: r.root for r in drawings.merged_scopes(df, ["page", "ref"]).collect()} == want
    paint = {r.id: r.paint for r in drawings.merged_scopes(df, ["page", "ref"]).collect()}
    for root in set(want.values()):
        assert [paint[r[0]] for r in sorted((r for r in rows if want[r[0]] == root), key=lambda r: (not r[7], r[8], r[0]))] == list(range(1, list(want.values()).count(root) + 1))


def test_open_tops_without_joins(spark, monkeypatch):
    # Boxes at random, some next to each other, with holes, gaps in the top and stray borders; slices of all the rows, of few, and of fewer than a box.
    rng, rows = random.Random(11), {}
    for sheet in (0, 1, None):
        for at in range(0, 300, 6):
            first, last, split = rng.randrange(3), rng.randrange(4, 8), rng.randrange(0, 9)
            for r in range(at, at + rng.choice([3, 4, 4, 6])):
                for c in range(first, last):
                    gone = (r == at and c in rng.choice([(), (first,), (first + 1,), (last - 1,)])) or c == split and rng.random() < 0.5 or rng.random() < 0.01
                    rows[sheet, r, c] = [not gone] * 4 if rng.random() > 0.02 else [rng.random() < 0.5 for _ in range(4)]
    cells = [(s, r, c, *b, rng.random() > 0.02, b[0], rng.random() > 0.2) for (s, r, c), b in rows.items()]
    df = spark.createDataFrame(cells, "sheet int, row int, col int, bt boolean, bb boolean, bl boolean, br boolean, plain boolean, own boolean, told boolean").where("sheet IS NOT NULL")
    segs, none = graph.settled(grid.segments(df, ["sheet"])), spark.createDataFrame([], "sheet int, r1 int, r2 int, c1 int, c2 int")
    found, gaps = grid.open_top(grid.component_of(grid.units(segs, none, ["sheet"]), ["sheet"]), segs, none, df.selectExpr("sheet", "row", "col", "'' AS text", "plain", "own"), ["sheet"])
    tables, open_ = {(r.sheet, r.r1, r.c1, r.r2, r.c2) for r in found.collect()}, {tuple(r) for r in gaps.collect()}
    assert len(tables) > 5 and len(open_) > 5
    for n in (4096, 20, 4):
        monkeypatch.setattr(grid, "SLICE", n)
        got = grid.open_top_alone(df, ["sheet"]).collect()
        assert {(r.sheet, r.row, r.col, r.r2, r.c2) for r in got if r.kind == "table"} == tables, n
        assert {(r.sheet, r.row, r.col) for r in got if r.kind == "open"} == open_
        assert sorted((r.sheet, r.row, r.col) for r in got if r.kind == "candidate") == sorted(x[:3] for x in cells if x[0] is not None and x[9] and x[:3] not in open_)
