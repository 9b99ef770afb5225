"""Components and cycles against brute force, at the block size of production and at one that makes several levels; the gram index."""
import itertools
import random

import pytest
from pyspark.sql import functions as F

from codegrid.operators import cycles, deps
from codegrid.plans.materialize import checkpoint


def table(spark, by_repo):
    return spark.createDataFrame([(r, a, b) for r, es in by_repo.items() for a, b in es], "repo string, source string, target string")


def reach(edges):
    out = {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
        out.setdefault(b, set())
    far = {}
    for x in out:
        seen, todo = set(), [x]
        while todo:
            for y in out[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        far[x] = seen
    return out, far


def components(edges):
    _, far = reach(edges)
    groups = {x: {y for y in far[x] if x in far[y]} | {x} for x in far}
    return {(x, min(g)) for x, g in groups.items() if len(g) > 1}


def simple(edges, most):
    out, _ = reach(edges)
    found = set()

    def walk(path):
        for y in out[path[-1]]:
            if y == path[0]:
                found.add(tuple(path))
            elif y > path[0] and y not in path and len(path) < most:
                walk([*path, y])
    for x in out:
        walk([x])
    return found


CHAIN = [e for i in range(500) for e in ((f"a{i:03}", f"b{i:03}"), (f"b{i:03}", f"a{i:03}"), (f"b{i:03}", f"a{i + 1:03}"))]
GRID = ([(f"{r}_{c:04}", f"{r}_{c + 1:04}") for r in range(4) for c in range(999)] + [(f"{r}_{c:04}", f"{r + 1}_{c:04}") for r in range(3) for c in range(1000)])


@pytest.mark.parametrize("edges,block", [(CHAIN, cycles.BLOCK), (CHAIN, 64), (GRID, cycles.BLOCK), (GRID, 500)])
def test_deep_graphs_take_few_rounds(spark, monkeypatch, edges, block):
    monkeypatch.setattr(cycles, "BLOCK", block)
    calls = []
    got = cycles.strongly_connected(table(spark, {"r": edges}), lambda df: calls.append(1) or checkpoint(df)).collect()
    want = {(f"{k}{i:03}", f"a{i:03}") for i in range(500) for k in "ab"} if edges is CHAIN else set()
    assert {(r.file, r.scc) for r in got} == want and len(calls) < 40


@pytest.mark.parametrize("block", [cycles.BLOCK, 7])
def test_components(spark, monkeypatch, block):
    monkeypatch.setattr(cycles, "BLOCK", block)
    rng = random.Random(5)
    graphs = {f"r{k}": [(f"f{rng.randrange(18):02}", f"f{rng.randrange(18):02}") for _ in range(m)] for k, m in enumerate((12, 26))}
    got = cycles.strongly_connected(table(spark, graphs), checkpoint).collect()
    assert {(r.repo, r.file, r.scc) for r in got} == {(r, f, c) for r, es in graphs.items() for f, c in components(es)}


def test_large_component_goes_first(spark, monkeypatch):
    """Edges that follow no blocks: a large component with files before and behind it, and small cycles apart."""
    monkeypatch.setattr(cycles, "BLOCK", 100)
    monkeypatch.setattr(cycles, "SENT", 20)  # paths go on by both kinds of join
    rng = random.Random(11)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(600)] + [(200 + i, rng.randrange(200)) for i in range(20)]
    edges += [(rng.randrange(200), 220 + i) for i in range(20)] + [(a, b) for i in range(240, 300, 2) for a, b in ((i, i + 1), (i + 1, i))]
    order = list(range(300))
    rng.shuffle(order)
    edges = [(f"f{order[a]:03}", f"f{order[b]:03}") for a, b in edges if a != b]
    cores, find = [], cycles._core
    monkeypatch.setattr(cycles, "_core", lambda *a: cores.append(find(*a)) or cores[-1])
    got = {(r.file, r.scc) for r in cycles.strongly_connected(table(spark, {"r": edges}), checkpoint).collect()}
    assert got == components(edges) and [c.count() > 150 for c in cores] == [True]


def test_long_paths_give_the_large_component_up(spark):
    ring = spark.createDataFrame([(i, (i + 1) % 300) for i in range(300)], "src long, dst long")
    assert cycles._core(ring, 300, checkpoint) is None
    assert cycles._core(spark.createDataFrame([(0, 1), (0, 2)], "src long, dst long"), 3, checkpoint) is None
    pair = cycles._core(spark.createDataFrame([(3, 1), (1, 3), (1, 2)], "src long, dst long"), 4, checkpoint)
    assert sorted(tuple(r) for r in pair.collect()) == [(1, 1), (3, 1)]


def test_labels_spread_over_blocks(spark, monkeypatch):
    """The round of colouring by itself, on rings that no block holds."""
    monkeypatch.setattr(cycles, "BLOCK", 3)
    rings = [[0, 5, 10, 2, 7], [1, 8, 4], [3, 11]]
    edges = [(r[i], r[(i + 1) % len(r)]) for r in rings for i in range(len(r))] + [(7, 1), (4, 3), (6, 0), (3, 9)]
    got = cycles._colored(spark.createDataFrame(edges, "src long, dst long"), 12, checkpoint).collect()
    by = {}
    for r in got:
        by.setdefault(r.scc, set()).add(r.id)
    assert sorted(map(sorted, (g for g in by.values() if len(g) > 1))) == sorted(map(sorted, rings))


@pytest.mark.parametrize("most", [1, 2, 4, 6])
def test_simple_cycles(spark, most):
    rng = random.Random(most)
    graphs = {"a": [(f"f{rng.randrange(9)}", f"f{rng.randrange(9)}") for _ in range(30)], "b": [("x", "y"), ("y", "z")], "c": [("x", "x")]}
    rows = cycles.simple_cycles(table(spark, graphs), most, checkpoint).collect()
    got = {}
    for r in rows:
        got.setdefault((r.repo, r.cycle), []).append((r.pos, r.file))
    want = {(repo, " -> ".join(c)): list(enumerate(c)) for repo, es in graphs.items() for c in simple(es, most)}
    assert {k: sorted(v) for k, v in got.items()} == want and len(rows) == sum(map(len, want.values()))


def test_bound_below_one(spark):
    with pytest.raises(ValueError):
        cycles.simple_cycles(table(spark, {"a": [("x", "x")]}), 0, checkpoint)


def test_gram_index(spark, monkeypatch):
    monkeypatch.setattr(deps, "_SALT", 3)  # popular grams are dealt over many salts
    rng = random.Random(8)
    names = ["".join(rng.choice("ab.c") for _ in range(rng.randrange(1, 12))) for _ in range(150)]
    keys = [(r, k, f"{r}{i}") for r in "xy" for i, k in enumerate(names)]
    imports = {("".join(rng.choice("ab.c") for _ in range(rng.randrange(1, 7)))) for _ in range(80)} | {"é", "abc" * 9, ""}
    index = spark.createDataFrame([(r, k, f, int(f[1:])) for r, k, f in keys], "repo string, key string, file string, first_pos long")
    left = spark.createDataFrame([(r, i, p) for r, i in itertools.product("xyz", sorted(imports)) for p in (True, False)], "repo string, imp string, pkg_rule boolean")
    got = {(r.repo, r.imp, r.pkg_rule): r.target for r in deps.gram_match(left, index).collect()}
    want = {}
    for r, i in itertools.product("xyz", imports):
        first = next((f for s, k, f in keys if s == r and i and i in k), None)
        if first:
            want |= {(r, i, p): first for p in (True, False)}
    assert got == want and deps.gram_match(left.where(F.lit(False)), index).count() == 0


def test_sample_with_an_edge_limit(spark):
    edges = {r: [(f"{r}{i}", f"{r}{j}") for i in range(4) for j in range(4)] for r in "ab"}
    got = {(r.source, r.target) for r in deps.sample_graph(table(spark, edges), max_sources=3, max_targets=2, max_edges=5).collect()}
    assert got == {(a, b) for r in "ab" for a, b in [e for e in edges[r] if e[1][1] in "01"][:5]}
    assert deps.sample_graph(table(spark, edges), 3, 2).count() == 12
