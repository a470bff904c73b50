"""Files that stand out, and the routing manifest, at their limits."""

from graphloom.operators import lookups, traversal


def graph(spark, edges, files, kinds=None):
    nodes = spark.createDataFrame([(i, (kinds or {}).get(i, "function"), f"name {i}", f, k) for k, (i, f) in enumerate(files.items())], "id string, kind string, name string, file_path string, start_line int")
    return nodes, spark.createDataFrame([(k, *e) for k, e in enumerate(edges)], "edge_id long, source string, target string, kind string")


def test_dominant_file(spark):
    files = {"a": "src/a.ts", "b": "src/b.ts", "g": "api/x.pb.go"}
    nodes, edges = graph(spark, [("g", "g", "calls")] * 30 + [("a", "a", "calls")] * 20 + [("b", "b", "calls")] * 7 + [("a", "b", "calls")] * 50, files)
    assert [tuple(r) for r in lookups.dominant_file(nodes, edges).collect()] == [("src/a.ts", 20, 7)]
    assert lookups.dominant_file(nodes, edges.filter("edge_id <> 35")).count() == 0
    assert lookups.dominant_file(nodes, edges, most=1).count() == 0


def test_top_route_file(spark):
    routes = lambda **n: graph(spark, [("x", "x", "calls")], {f"{f}{k}": f"{f}.ts" for f, m in n.items() for k in range(m)}, {f"{f}{k}": "route" for f, m in n.items() for k in range(m)})[0]
    assert [tuple(r) for r in lookups.top_route_file(routes(a=4, b=2)).collect()] == [("a.ts", 4, 6)]
    assert lookups.top_route_file(routes(a=2)).count() == 0
    assert lookups.top_route_file(routes(a=3, b=3, c=3, d=3)).count() == 0
    assert lookups.top_route_file(routes()).count() == 0


def test_routing_manifest(spark):
    files = {"r1": "r.ts", "r2": "r.ts", "r3": "r.ts", "h1": "h.ts", "h2": "h.ts", "t": "h.test.ts", "k": "k.ts"}
    kinds = {"r1": "route", "r2": "route", "r3": "route"}
    nodes, edges = graph(spark, [("r1", "k", "references"), ("r1", "t", "calls"), ("r2", "h1", "calls"), ("r3", "h2", "references"), ("r3", "h1", "extends")], files, kinds)
    got = [(r.url, r.handler, r.in_file, r.top_file) for r in lookups.routing_manifest(nodes, edges).collect()]
    assert sorted(got) == [("name r1", "name k", 1, False), ("name r2", "name h1", 2, True), ("name r3", "name h2", 2, True)]
    assert lookups.routing_manifest(nodes, edges.filter("edge_id <> 0")).count() == 0


def test_reach_by_doubling(spark):
    import random

    rng = random.Random(3)
    chain = [(f"n{i}", f"n{i + 1}", "extends") for i in range(37)]
    extra = [(f"n{rng.randrange(38)}", f"n{rng.randrange(38)}", "implements") for _ in range(6)]
    for rows in (chain, chain + extra):
        edges = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "edge_id long, source string, target string, kind string")
        root = spark.createDataFrame([("n3",)], "id string")
        want = {(r.id, r.depth) for r in traversal.reach(edges, root, "outgoing", ("extends", "implements")).collect()}
        assert {(r.id, r.depth) for r in traversal.reach_by_doubling(edges, root, "outgoing", ("extends", "implements")).collect()} == want
