"""Expansion of references against a walk over every copy, and vector pictures."""

import random

from tessella.operators import expansion, vector
from tessella.sources import html


def walked(tree, refs, root, most=20_000, depth=22):
    """Copy by copy: (nodes by depth) or the reason why not."""
    below = {}
    for n, p in tree.items():
        if p is not None:
            below.setdefault(p, []).append(n)
    for a, b in refs:
        if b in tree:
            below.setdefault(a, []).append(b)
    loop, seen, on = [False], set(), set()

    def cyc(n):
        on.add(n)
        for b in below.get(n, []):
            if b in on:
                loop[0] = True
            elif b not in seen:
                cyc(b)
        on.discard(n)
        seen.add(n)

    cyc(root)
    if loop[0]:
        return "CYCLE"
    out, front, k = [], [root], 0
    while front:
        out.append(len(front))
        if sum(out) > most:
            return "NODES"
        front = [b for n in front for b in below.get(n, [])]
        k += 1
    return "DEPTH" if k - 1 > depth else out


def test_against_a_walk(spark):
    rng = random.Random(5)
    nodes, refs, want = [], [], {}
    for d in range(60):
        n = rng.randint(1, 14)
        tree = {0: None} | {k: rng.randrange(k) for k in range(1, n)}
        own = [(rng.randrange(n), rng.randrange(n + 1)) for _ in range(rng.choice([0, 1, 2, 5]))]
        if d % 3:
            own = [(a, b) for a, b in own if a < b]
        want[d] = walked(tree, own, 0)
        nodes += [(d, k, p) for k, p in tree.items()]
        refs += [(d, a, b) for a, b in own]
    # Doubling twenty times; a chain of twenty-five uses; the same use twice.
    for d, (n, uses) in {100: (21, [(k, k + 1) for k in range(20)] * 2), 101: (25, [(k, k + 1) for k in range(24)]), 102: (2, [(0, 1)] * 2)}.items():
        nodes += [(d, k, None if k == 0 else 0 if d == 102 else None) for k in range(n)]
        refs += [(d, a, b) for a, b in uses]
        want[d] = walked({k: None if d != 102 or k == 0 else 0 for k in range(n)}, uses, 0)
    assert want[100] == "NODES" and want[101] == "DEPTH" and want[102] == [1, 3]
    df, uses = spark.createDataFrame(nodes, "doc int, node int, parent int"), spark.createDataFrame(refs, "doc int, node int, target int")
    verdict = expansion.checked(df, uses, ["doc"], depth=22)
    got = {r.doc: r for r in verdict.collect() if r.node == 0}
    for d, w in want.items():
        assert (got[d].problem or [got[d].size, got[d].height]) == (w if isinstance(w, str) else [sum(w), len(w) - 1]), d
    copies = {}
    for r in expansion.instances(df, uses, ["doc"], verdict).where("path[0] = 0").collect():
        assert len(r.path) == r.depth + 1 and r.path[-1] == r.node
        copies.setdefault(r.doc, {}).setdefault(r.depth, []).append(r.node)
    assert {d: [len(v[k]) for k in sorted(v)] for d, v in copies.items()} == {d: w for d, w in want.items() if not isinstance(w, str)}


def test_vector_pictures(spark):
    double = "".join(f'<g id="g{k}"><use href="#g{k - 1}"/><use xlink:href="#g{k - 1}"/></g>' for k in range(1, 10))
    pictures = [
        (1, '<svg><defs><path id="p"/><linearGradient id="l"/></defs><g fill="url(#l)"><use href="#p"/></g></svg>'),
        (2, f'<svg><g id="g0"><path/></g>{double}</svg>'),
        (3, '<svg><g id="a"><use href="#b"/></g><g id="b"><use href="#a"/></g></svg>'),
        (4, '<svg><g id="a"/><g id="a"/></svg>'),
        (5, "<svg>" + "<g>" * 70 + "</g>" * 70 + "</svg>"),
        (6, '<svg><image id="i" href="#i"/><use href="#gone"/></svg>'),
    ]
    nodes = html.nodes(spark.createDataFrame(pictures, "page_id long, html string"))
    got = {r.page_id: (r.n_expanded, r.problem) for r in vector.complexity(nodes, ["page_id"], most=500).collect()}
    assert got == {1: (8, None), 2: (None if got[2][0] is None else got[2][0], "NODES"), 3: (None, "CYCLE"), 4: (3, "DUPLICATE_ID"), 5: (None, "COMPLEXITY"), 6: (3, None)}


def test_documents_without_rounds(spark, monkeypatch):
    # A chain of forty uses, two uses of one node, a loop; the rounds of joins say the same of each node.
    nodes = [(1, k, None if k == 0 else k - 1) for k in range(40)] + [(2, 0, None), (2, 1, None), (3, 0, None), (3, 1, 0), (3, 2, None)]
    refs = [(2, 0, 1), (2, 0, 1), (2, 0, 9), (3, 1, 0), (3, 1, None), (1, 0, 39)]
    df, uses = spark.createDataFrame(nodes, "doc int, node int, parent int"), spark.createDataFrame(refs, "doc int, node int, target int")
    written, table = [], expansion.table
    monkeypatch.setattr(expansion, "table", lambda df: (written.append(1), table(df))[1])
    got = {(r.doc, r.node): (r.size, r.height) for r in expansion.sized(df, uses, ["doc"], most=30).collect()}
    assert len(written) == 2
    assert got == {(1, 0): (31, 39), **{(1, k): (min(40 - k, 31), 39 - k) for k in range(1, 40)}, (2, 0): (3, 1), (2, 1): (1, 0), (3, 2): (1, 0)}
    monkeypatch.setattr(expansion, "MOST_HELD", 4)
    assert {(r.doc, r.node): (r.size, r.height) for r in expansion.sized(df, uses, ["doc"], most=30).collect()} == got
    assert len(written) > 20


def test_copies_are_counted_without_rounds(spark, monkeypatch):
    # Two uses of one node below two uses of another, two roots in one document, a loop, a use of no node; the rounds of joins say the same.
    nodes = [(1, 0, None), (1, 1, 0), (1, 2, 0), (1, 3, 2), (2, 0, None), (2, 1, None), (2, 2, 1), (3, 0, None), (3, 1, 0), (4, 0, None), *[(4, k, k - 1) for k in range(1, 40)]]
    refs = [(1, 1, 2), (1, 1, 2), (1, 3, 9), (2, 0, 2), (3, 1, 0)]
    df, uses = spark.createDataFrame(nodes, "doc int, node int, parent int"), spark.createDataFrame(refs, "doc int, node int, target int")
    want = expansion.instances(df, uses, ["doc"], expansion.checked(df, uses, ["doc"], depth=30)).groupBy("doc", "node", "depth").count().collect()
    assert (1, 3, 3, 2) in set(map(tuple, want)) and {r.doc for r in want} == {1, 2}
    written, table = [], expansion.table
    monkeypatch.setattr(expansion, "table", lambda df: (written.append(1), table(df))[1])
    got = lambda: sorted((r.doc, r.node, r.depth, r.copies) for r in expansion.copies(df, uses, ["doc"], depth=30).groupBy("doc", "node", "depth").sum("copies").toDF("doc", "node", "depth", "copies").collect())
    assert got() == sorted(map(tuple, want)) and len(written) == 2
    monkeypatch.setattr(expansion, "MOST_HELD", 4)
    assert got() == sorted(map(tuple, want)) and len(written) > 8
