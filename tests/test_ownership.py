"""Splits by names, owners of objects and overflow of texts, case by case."""

from tessella.operators import overflow, ownership, splits


def test_splits(spark):
    box = "r1 int, r2 int, c1 int, c2 int"
    tables = spark.createDataFrame([(1, t, t * 100, t * 100 + 9, 1, 9) for t in range(10)], f"sheet int, tab int, {box}")
    names = [
        (1, "left", True, 0, 9, 1, 3),  # 0: a band on the left; the rest becomes one of its own
        (1, "whole", True, 100, 109, 1, 9), (1, "part", True, 100, 109, 1, 3),  # 1: the table itself is named
        (1, "a", True, 200, 209, 1, 4), (1, "b", True, 200, 209, 4, 6),  # 2: overlap
        (1, "col", True, 300, 309, 1, 3), (1, "row", True, 300, 303, 1, 9),  # 3: both shapes
        (1, "top", True, 400, 401, 1, 9), (1, "end", True, 408, 409, 1, 9),  # 4: rows, a gap between
        (1, "thin", False, 500, 509, 1, 1),  # 5: not eligible
        (1, "cut", True, 600, 609, 1, 3),  # 6: a merge lies across
        (1, "out", True, 705, 712, 1, 9),  # 7: not contained
        (1, "most", True, 800, 809, 1, 6),  # 8: the rest is hidden, one part is no split
        (2, "other", True, 900, 909, 1, 3),  # 9: of another sheet
    ]
    merges = spark.createDataFrame([(1, 602, 603, 3, 4), (1, 2, 3, 1, 2), (1, 399, 400, 1, 2)], f"sheet int, {box}")
    columns = spark.createDataFrame([(1, t, c) for t in range(10) for c in range(1, 10) if not (t == 8 and c > 6)], "sheet int, tab int, col int")
    got = {}
    for r in splits.by_names(tables, spark.createDataFrame(names, f"sheet int, name string, fit boolean, {box}"), columns, merges, ["sheet"]).orderBy("tab", "part").collect():
        got.setdefault(r.tab, []).append((r.part, (r.r1 - r.tab * 100, r.r2 - r.tab * 100, r.c1, r.c2), r.names, r.outcome))
    yes, no, base = splits.SPLIT, splits.SKIPPED, (0, 9, 1, 9)
    assert got[0] == [(1, (0, 9, 1, 3), ["left"], yes), (2, (0, 9, 4, 9), [], yes)]
    assert got[1] == [(1, base, ["whole"], no)]
    # The merge at 399 reaches into table 4 from outside: it lies in no part.
    assert all(got[t] == [(1, base, [], no)] for t in (2, 3, 4, 6, 8)) and all(got[t] == [(1, base, [], None)] for t in (5, 7, 9))
    free = splits.by_names(tables, spark.createDataFrame(names, f"sheet int, name string, fit boolean, {box}"), columns, merges.where("false"), ["sheet"])
    assert [(r.r1, r.r2, r.names) for r in free.where("tab = 4").orderBy("part").collect()] == [(400, 401, ["top"]), (402, 407, []), (408, 409, ["end"])]


def test_targets(spark):
    shapes = spark.createDataFrame([(1, s, i) for i, s in enumerate("abcdefg")], "slide int, shape string, pos int")
    claims = [(1, "one", "a"), (1, "one", "b"), (1, "gap", "c"), (1, "gap", "e"), (1, "lost", "z"), (1, "none", None), (1, "x", "f"), (1, "y", "f"), (1, "y", "g"), (1, "out", "a")]
    df = spark.createDataFrame([(*c, "bad" if c[1] == "out" else None) for c in claims], "slide int, effect string, shape string, reason string")
    got = {r.effect: (r.first, r.reason) for r in ownership.targets(df, shapes, ["slide"]).collect()}
    # An effect that is out claims nothing.
    assert got == {"one": (0, None), "gap": (None, "interleaved_target"), "lost": (None, "unresolved_target"), "none": (None, "unresolved_target"), "x": (None, "shared_target"), "y": (None, "shared_target"), "out": (None, "bad")}


def test_reconnected(spark):
    objects = ownership.renumbered(spark.createDataFrame([(1, 7, 0), (1, 9, 1), (1, 9, 2), (1, 4, 3)], "slide int, id int, pos int"), ["slide"])
    lines = spark.createDataFrame([(1, "ok", 4, 7), (1, "free", 7, None), (1, "twice", 9, 7), (1, "gone", 4, 5)], "slide int, connector string, start_id int, end_id int")
    got = {r.connector: (r.start_id, r.end_id, r.error) for r in ownership.reconnected(lines, objects, ["slide"]).collect()}
    assert got == {"ok": (4, 1, None), "free": (1, None, None), "twice": (None, 1, "OUTPUT_INVALID"), "gone": (4, None, "OUTPUT_INVALID")}


def test_overflow(spark):
    def cell(row, col, text, width=0.0, kind="STRING", align=None, merged=False, wrap=False):
        return (1, row, col, kind, text, align, wrap, False, 0, merged, width, 0.0)

    rows = [
        cell(1, 1, "long", 45.0), cell(1, 4, "x", 3.0),  # over two blank columns that have no cells, up to the text in the fourth
        cell(2, 1, "long", 100.0), cell(2, 2, ""), cell(2, 3, None, kind="FORMULA"),  # an empty constant is no obstacle, an empty formula is
        cell(3, 2, "far", 500.0),  # to the end
        cell(4, 1, "wrapped", 60.0, wrap=True), cell(5, 1, "7", 60.0, "NUMERIC"),
        cell(6, 1, "sel", 10.0, align="centerContinuous"), cell(6, 2, None, kind="BLANK", align="centerContinuous"), cell(6, 3, None, kind="BLANK", align="centerContinuous"), cell(6, 4, None, kind="BLANK"),
        cell(7, 1, "stop", 100.0), cell(7, 2, None, kind="BLANK", merged=True),
        cell(8, 1, "fits", 36.0),  # wants 40, which is an edge
    ]
    cells = spark.createDataFrame(rows, "sheet int, row int, col int, kind string, text string, align string, wrap boolean, shrink boolean, rotation int, merged boolean, width double, indent double")
    tracks = spark.createDataFrame([(1, c, 20.0 * (c - 1), 20.0) for c in range(1, 6)], "sheet int, line int, start double, size double")
    texts = overflow.boxes(cells, tracks, ["sheet"])
    assert {(r.row, r.col): (r.left, r.right) for r in texts.collect()} == {(1, 1): (0, 60), (1, 4): (60, 80), (2, 1): (0, 40), (3, 2): (20, 100), (4, 1): (0, 20), (5, 1): (0, 20), (6, 1): (0, 60), (7, 1): (0, 20), (8, 1): (0, 40)}
    pages = spark.createDataFrame([(1, 0, 0.0, 40.0), (1, 1, 40.0, 100.0)], "sheet int, page int, start double, end double")
    got = {(r.row, r.col, r.page): (r["from"], r.upto, r.at, r.clipped) for r in overflow.visible(texts, pages, ["sheet"]).collect()}
    assert got[1, 1, 0] == (2, 40, 2, False) and got[1, 1, 1] == (40, 47, 2, False) and got[6, 1, 0] == (25, 35, 25, False)
    assert got[5, 1, 0] == (1, 18, -42, True) and (6, 1, 1) not in got and got[3, 2, 1][3]
