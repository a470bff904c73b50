"""Traversals on small graphs with known answers, and against plain Python on random ones."""

import random
from collections import deque

import pytest

from graphloom.operators import traversal as walk

EDGE = "edge_id long, source string, target string, kind string, metadata string, line int, col int, provenance string"


@pytest.fixture
def graph(spark):
    def make(edges, kinds=None, exported=()):
        rows = [(k, *(e if len(e) > 2 else (*e, "calls"))[:3], None, (e[3] if len(e) > 3 else None), None, None) for k, e in enumerate(edges)]
        ids = sorted({x for e in edges for x in e[:2]} | set(kinds or {}))
        nodes = [(i, (kinds or {}).get(i, "function"), i, f"{i}.ts", i in exported) for i in ids]
        return spark.createDataFrame(nodes, "id string, kind string, name string, file_path string, is_exported boolean"), spark.createDataFrame(rows, EDGE)

    return make


def ids(df):
    return {(r["id"], r["depth"]) for r in df.collect()}


def roots(nodes, *names):
    return nodes.filter(nodes.id.isin(*names)).select("id")


def test_parallel_edges_stay(graph):
    nodes, edges = graph([("A", "B", "calls", 1), ("A", "B", "references", 2), ("A", "B", "calls", 7)])
    assert walk.bfs_subgraph(nodes, edges, "A")[1].count() == 3


def test_limits_hold(graph):
    nodes, edges = graph([("A", f"n{i}") for i in range(50)])
    assert walk.bfs_subgraph(nodes, edges, "A", limit=7)[0].count() == 7
    assert walk.dfs_subgraph(nodes, edges, "A", limit=7).count() == 7


def test_each_caller_once(graph):
    nodes, edges = graph([("A", "B", "calls", 1), ("A", "B", "calls", 2), ("A", "B", "references", 3), ("C", "B")])
    assert {(r.id, r.edge_id) for r in walk.neighbours(edges, "B", "incoming").collect()} == {("A", 0), ("C", 3)}
    assert ids(walk.callers(edges, roots(nodes, "B"), 1)) == {("A", 1), ("C", 1)}


def test_impact_keeps_to_callers_of_a_member(graph):
    nodes, edges = graph([("K", "m1", "contains"), ("K", "m2", "contains"), ("x", "m1"), ("y", "x"), ("z", "m2")], {"K": "class"})
    assert ids(walk.impact(nodes, edges, roots(nodes, "m1"), 2)) == {("m1", 0), ("x", 1), ("y", 2)}
    assert ids(walk.impact(nodes, edges, roots(nodes, "K"), 1)) == {("K", 0), ("m1", 0), ("m2", 0), ("x", 1), ("z", 1)}


def test_missing_root(graph):
    nodes, edges = graph([("A", "B")])
    assert walk.bfs_subgraph(nodes, edges, "none")[0].count() == 0
    assert walk.shortest_path(edges, "B", "A").count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_distances_and_paths_on_random_graphs(graph, seed):
    rng = random.Random(seed)
    pairs = [(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(60)]
    nodes, edges = graph(pairs)
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
    distance, todo = {"n1": 0}, deque(["n1"])
    while todo:
        x = todo.popleft()
        for y in near.get(x, ()):
            if y not in distance:
                distance[y] = distance[x] + 1
                todo.append(y)
    assert ids(walk.bfs_subgraph(nodes, edges, "n1")[0]) == set(distance.items())
    goal = max(distance, key=distance.get)
    path = sorted(walk.shortest_path(edges, "n1", goal).collect(), key=lambda r: r.step)
    assert len(path) == distance[goal] + 1 and path[0].id == "n1" and path[-1].id == goal
    assert all(q.id in near[p.id] for p, q in zip(path, path[1:]))


@pytest.mark.parametrize("seed", [3, 4])
def test_cycles_on_random_graphs(spark, seed):
    rng = random.Random(seed)
    pairs = {(f"f{rng.randrange(12)}", f"f{rng.randrange(12)}") for _ in range(16)}
    reach = {a: {b for x, b in pairs if x == a} for a in {p for e in pairs for p in e}}
    for _ in range(12):
        for a in reach:
            reach[a] |= {c for b in list(reach[a]) for c in reach.get(b, ())}
    want = {a: min(b for b in reach if a in reach[b] and b in reach[a]) for a in reach if any(b != a and b in reach[a] and a in reach[b] for b in reach)}
    got = walk.circular_files(spark.createDataFrame(sorted(pairs), "source_file string, target_file string"))
    assert {r.path: r.component for r in got.collect()} == want


def test_random_walk_against_power_iteration(graph):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("c", "d")]
    nodes, edges = graph([(*p, "calls") for p in pairs], {"e": "function"})
    near = {}
    for a, b in pairs:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    score = {x: float(x == "a") for x in "abcde"}
    for _ in range(25):
        came = dict.fromkeys("abcde", 0.0)
        for x, s in score.items():
            for y in near.get(x, ()):
                came[y] += s / len(near[x])
            if x not in near:
                came[x] += s
        score = {x: 0.25 * (x == "a") + 0.75 * came[x] for x in score}
    got = {r.id: r.score for r in walk.random_walk(edges, nodes, roots(nodes, "a")).collect()}
    assert all(abs(got[x] - score[x]) < 1e-9 for x in score)


def test_dead_code_and_hierarchy(graph):
    nodes, edges = graph([("K", "m", "contains"), ("f", "g"), ("S", "B", "extends"), ("B", "T", "implements")], {"K": "class"}, exported=("f",))
    assert {r.id for r in walk.dead_code(nodes, edges).collect()} == {"K", "m", "S"}
    assert {(r.id, r.role) for r in walk.type_hierarchy(edges, roots(nodes, "B")).collect()} == {("B", "focal"), ("T", "ancestor"), ("S", "descendant")}
    assert {r.role for r in walk.type_hierarchy(edges, roots(nodes, "B"), True).collect()} == {"focal", "ancestor"}
