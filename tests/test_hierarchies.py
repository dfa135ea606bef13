"""Closures kept up under edits and display forests against plain loops, on random graphs with cycles."""

import random

import pytest

from graphloom.operators import graph


def plain_closure(links):
    out = set(links)
    while True:
        more = {(a, d) for a, b in out for c, d in links if b == c} - out
        if not more:
            return out
        out |= more


@pytest.mark.parametrize("seed", range(3))
def test_maintained(spark, seed):
    rng = random.Random(seed)
    pairs = lambda n: {(rng.randrange(22), rng.randrange(22)) for _ in range(n)}
    links = pairs(24)
    removed, added = set(rng.sample(sorted(links), 7)) | {(99, 98)}, pairs(5) | set(rng.sample(sorted(links), 2))
    frame = lambda rows: spark.createDataFrame([*rows, *rows], "child long, parent long")
    got = graph.maintained(graph.ancestors(frame(links)), frame(links), frame(removed), frame(added)).collect()
    of = lambda *kinds: [(r.node, r.anc) for r in got if r.change in kinds]
    old, new = plain_closure(links), plain_closure((links - removed) | added)
    now = of("kept", "rederived", "added")
    assert set(now) == new and len(now) == len(new)
    assert set(of("gone")) == old - new and set(of("added")) >= new - old
    for a, b in of("kept"):  # what was kept did not need any link that went
        assert (a, b) in old


def test_maintained_nothing(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (None, 1)], "child long, parent long")
    none = links.limit(0)
    assert {tuple(r) for r in graph.maintained(graph.ancestors(links), links, none, none).collect()} == {(1, 2, "kept"), (2, 3, "kept"), (1, 3, "kept")}
    assert graph.maintained(graph.ancestors(none), none, links, none).count() == 0
    assert {r.change for r in graph.maintained(graph.ancestors(none), none, none, links).collect()} == {"added"}


def plain_forest(classes, links):
    label = {}
    for i, x in classes:
        label[i] = min(x, label.get(i, x))
    links = {(a, b) for a, b in links if a in label and b in label and a != b}
    up = plain_closure(links)
    parents = {i: sorted((b for a, b in links if a == i and (b, a) not in up), key=lambda b: (label[b], b)) for i in label}
    parent = {i: p[0] for i, p in parents.items() if p}
    out = {}
    for i in label:
        path = [i]
        while path[0] in parent:
            path.insert(0, parent[path[0]])
        out[i] = [parent.get(i), path[0], len(path) - 1, 0, max(0, len(parents[i]) - 1), "/".join(path)]
    for row in list(out.values()):
        for i in row[5].split("/"):
            out[i][3] += 1
    return {i: (p, r, d, n, e, p is None and n == 1, path) for i, (p, r, d, n, e, path) in out.items()}


@pytest.mark.parametrize("seed", range(3))
def test_display_forest(spark, seed):
    rng = random.Random(seed)
    classes = [(f"c{i}", rng.choice("abc")) for i in range(45)] + [("c1", "a"), ("c2", "zz")]
    links = [(f"c{a}", f"c{b}") for a, b in ((rng.randrange(50), rng.randrange(50)) for _ in range(45))] + [(f"c{i}", f"c{i + 1}") for i in range(20, 38)]
    got = graph.display_forest(spark.createDataFrame(classes, "iri string, label string"), spark.createDataFrame(links, "child string, parent string"), paths=True).collect()
    assert {r.node: (r.parent, r.root, r.depth, r.branch, r.extra, r.standalone, "/".join(r.path)) for r in got} == plain_forest(classes, links) and len(got) == 45


def test_deep_forest(spark):
    """Rounds are the logarithm of the depth."""
    n = 600
    links = spark.range(1, n).selectExpr("id as child", "id - 1 as parent")
    names = spark.range(n).selectExpr("id as iri", "cast(id as string) as label")
    got = {r.node: (r.root, r.depth, r.branch) for r in graph.display_forest(names, links).collect()}
    assert got == {i: (0, i, n - i) for i in range(n)}


@pytest.mark.parametrize("few", [0, 3000])
def test_cycles_of_contracted_graphs(spark, monkeypatch, few):
    """Chains, rings and two-way edges folded and unfolded, and the closure of what is left."""
    monkeypatch.setattr(graph, "FEW_EDGES", few)
    rng = random.Random(few)
    links = {(rng.randrange(30), rng.randrange(30)) for _ in range(38)} | {(i, i + 1) for i in range(40, 60)} | {(60, 40), (45, 3)} | {(i, i + 1) for i in range(70, 80)} | {(80, 70), (5, 5)} | {(90, 91), (91, 90), (91, 92), (92, 93), (93, 90)}
    got = sorted((r.root, r.node) for r in graph.cycles(spark.createDataFrame(sorted(links), "child long, parent long")).collect())
    up = plain_closure(links)
    both = {a: sorted(b for x, b in up if x == a and (b, a) in up) for a, _ in up}
    assert got == sorted((min(b), a) for a, b in both.items() if b)


def test_cycles_along_a_chain(spark, monkeypatch):
    monkeypatch.setattr(graph, "FEW_EDGES", 100)
    e = spark.range(400).selectExpr("explode(array(struct(2*id as child, 2*id+1 as parent), struct(2*id+1 as child, 2*id as parent), struct(2*id+1 as child, 2*id+2 as parent))) x").select("x.*")
    assert sorted((r.root, r.node) for r in graph.cycles(e).collect()) == [(i - i % 2, i) for i in range(800)]
