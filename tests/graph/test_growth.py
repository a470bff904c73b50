"""What operators make of names, symbols and files that very many rows share: right results, and no more rows on the way than the input warrants."""

import random

import pytest

from graphloom.operators import receivers, resolve

REF = "ref_id string, from_node_id string, reference_name string, reference_kind string, line int, file_path string, language string"
NODE = "id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, end_line int, is_exported boolean"


def joined_rows(df):
    """Rows that the largest join of a plan made."""
    df.collect()

    def walk(plan):
        name, most = plan.getClass().getSimpleName(), 0
        if "Join" in name:
            most = plan.metrics().apply("numOutputRows").value()
        inner = [plan.executedPlan()] if name == "AdaptiveSparkPlanExec" else [plan.plan()] if name.endswith("QueryStageExec") else []
        children = plan.children()
        return max([most, *(walk(p) for p in inner), *(walk(children.apply(k)) for k in range(children.size()))])

    return walk(df._jdf.queryExecution().executedPlan())


@pytest.fixture
def crowd(spark):
    """300 references to two names, each of which 300 functions in 40 files have."""
    nodes = [(f"n{k}", "function", "aB"[k % 2], "aB"[k % 2], f"d{k % 5}/e{k % 8}/f.py", "python", k, k + 1, k % 3 == 0) for k in range(600)]
    refs = [(f"r{k}", f"n{k}", "aB"[k % 2], "calls", k, f"d{k % 7}/e{k % 4}/g.py", "python") for k in range(300)]
    return spark.createDataFrame(refs, REF), spark.createDataFrame(nodes, NODE)


def test_exact_names_make_no_pairs(crowd):
    refs, nodes = crowd
    found = resolve.by_exact_name(refs, nodes)
    assert joined_rows(found) <= 6_000 and found.count() == 300
    assert resolve.by_exact_name(refs, nodes, most=200).count() == 0 and resolve.by_exact_name(refs, nodes, most=None).count() == 300


def test_lower_names_make_no_pairs(crowd):
    refs, nodes = crowd
    found = resolve.by_lower_name(refs, nodes.unionByName(nodes.limit(1).selectExpr(*[f"'B2' AS {c}" if c in ("id", "name") else c for c in nodes.columns])))
    assert joined_rows(found) <= 600 and found.count() == 0


def plain(ref, nodes, prefer_same=True, lexical=True):
    """(n, target, confidence) by trying every candidate."""
    _, _, name, kind, line, path, language = ref
    family = lambda x: {"javascript": "web", "typescript": "web", "java": "jvm"}.get(x)
    near = lambda p: 0 if "/" not in path else 15 * min(6, next((k for k, (a, b) in enumerate(zip(path.split("/")[:-1], p.split("/")[:-1])) if a != b), min(path.count("/"), p.count("/"))))

    def seen(n):
        outer = [o for o in nodes if o[1] in ("function", "method") and o[3] == n[3].rpartition(".")[0] and o[4] == n[4] and o[6] <= n[6] <= o[7]] if "." in n[3] and n[1] == "function" else []
        return not lexical or not outer or any(path == n[4] and o[6] <= line <= o[7] for o in outer)

    pool = [n for n in nodes if n[2] == name and n[1] != "import" and (family(n[5]) is None or family(language) is None or family(n[5]) == family(language)) and seen(n)]
    same = [n for n in pool if n[5] == language]
    points = lambda n: min(near(n[4]), 80)
    score = lambda n: (100 if n[4] == path else 0) + points(n) + (50 if n[5] == language else -80) + (25 if kind == "calls" and n[1] in ("function", "method") or kind == "instantiates" and n[1] == "class" else 0) + (10 if n[8] else 0) + (max(0.0, 20 - abs(n[6] - line) / 10) if n[4] == path else 0.0)
    best = min((same if same and prefer_same else pool), key=lambda n: (-score(n), n[0]), default=None)
    if best is None or len(pool) > 1 and prefer_same and score(best) <= -1:
        return None
    return best[0], (0.9 if best[5] == language else 0.5) if len(pool) == 1 else 0.7 if points(best) >= 30 else 0.4


@pytest.mark.parametrize("seed", range(3))
def test_best_candidates_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    path = lambda: "/".join([*rng.choices("ab", k=rng.randrange(8)), rng.choice("xy")])
    paths = [path() for _ in range(12)]
    language = lambda: rng.choice(["python", "go", "javascript", "typescript", "java"])
    nodes = []
    for k in range(150):
        start, name = rng.randrange(400), rng.choice("pqrstuvw")
        nodes.append((f"n{rng.random()}", rng.choice(["function", "method", "class", "import"]), name, rng.choice(["", "p.", "q."]) + name, rng.choice(paths), language(), start, start + rng.randrange(200), rng.random() < 0.5))
    refs = [(f"r{k}", "n", rng.choice("pqrstuvwz"), rng.choice(["calls", "instantiates"]), rng.randrange(500), rng.choice([*paths, path()]), language()) for k in range(200)]
    asked, table = spark.createDataFrame(refs, REF), spark.createDataFrame(nodes, NODE)
    want = {r[0]: plain(r, nodes) for r in refs}
    assert {r.ref_id: (r.target, r.confidence) for r in resolve.by_exact_name(asked, table, None).collect()} == {k: v for k, v in want.items() if v}
    any_language = {r[0]: plain(r, nodes, False, False) for r in refs}
    pool = resolve._candidates(table.filter("kind <> 'import'"))
    assert {r.ref_id: r.best["target"] for r in resolve.best_candidates(asked, pool, prefer_same=False).collect()} == {k: v[0] for k, v in any_language.items() if v}
    pairs = resolve.candidate_pairs(asked, table.filter("kind <> 'import'")).withColumn("score", resolve.candidate_score(resolve.F.col("near"))).collect()
    best = {}
    for r in pairs:
        best[r.ref_id] = min(best.get(r.ref_id, (0, "~")), (-r.score - 1e6, r.target))
    assert {k: v[1] for k, v in best.items()} == {k: v[0] for k, v in any_language.items() if v}


def test_scopes_are_those_of_the_pairs(spark):
    nodes = spark.createDataFrame([("o", "function", "o", "o", "f.py", "python", 1, 9, True), ("i", "function", "i", "o.i", "f.py", "python", 3, 4, True), ("m", "method", "i", "o.i", "f.py", "python", 3, 4, True)], NODE)
    assert {r.target: r.scopes and [tuple(s) for s in r.scopes] for r in receivers.with_scopes(resolve._candidates(nodes), nodes).collect()} == {"o": None, "i": [(1, 9)], "m": None}


def test_parts_grow_with_what_is_read(spark, tmp_path, monkeypatch):
    from graphloom import session

    spark.range(100_000).selectExpr("id", "uuid() AS x").write.parquet(f"{tmp_path}/t")
    rows = spark.read.parquet(f"{tmp_path}/t")
    assert session.pieces(rows) == 4 and session.pieces(spark.createDataFrame([(1,)], "id int")) == 4
    monkeypatch.setattr(session, "PIECE", 200_000)
    assert 10 < session.pieces(rows) < 60 and session.pieces(rows.crossJoin(rows)) <= 2 * session.pieces(rows)
    assert session.spread(rows, "id").rdd.getNumPartitions() == session.pieces(rows)


def test_callers_shuffle_no_pairs(spark):
    from graphloom.operators import changes

    edges = [(k, f"m{k % 40}", f"f{k // 40}", "calls") for k in range(1200)] + [(9000 + k, f"f{k % 30}", f"s{k}", "references") for k in range(300)]
    table = spark.createDataFrame(edges, "edge_id long, source string, target string, kind string")
    found = changes.caller_impact(table, spark.createDataFrame([(f"s{k}",) for k in range(300)], "id string"), 2)
    near = {}
    for _, a, b, _ in edges:
        near.setdefault(b, set()).add(a)
    want = {}
    for s in (f"s{k}" for k in range(300)):
        for a in near.get(s, ()):
            want[s, a] = 1
            for b in near.get(a, ()):
                want.setdefault((s, b), 2)
    assert {(r.symbol, r.caller): r.depth for r in found.collect()} == want
    assert joined_rows(found) <= 1500 < len(want)


def test_blocks_are_found_before_texts_are_read(spark):
    from graphloom.operators import explore

    nodes = spark.createDataFrame([(f"n{k:03}", "function", "n", "n", f"f{k % 2}", "python", k, k, True) for k in range(1, 201)], NODE)
    files = spark.createDataFrame([("f0", "\n".join("" if k % 3 else f"line {k}" for k in range(1, 150))), ("f1", "\n" * 300)], "path string, source string")
    found = nodes.selectExpr("id", "'near' AS role", "1 AS depth")
    blocks = explore.code_blocks(found, nodes, files)
    got = [(r.place, r.id, r.content) for r in blocks.collect()]
    assert got == [(p, f"n{k:03}", f"line {k}") for p, k in enumerate((6, 12, 18, 24, 30), 1)]
    texts = explore.with_text(files, found.join(nodes.select("id", "file_path", "start_line", "end_line"), "id"))
    assert texts.count() == 24 and "source" not in texts.columns


def test_workspace_without_a_budget(spark):
    from graphloom.operators import explore

    nodes = spark.createDataFrame([(f"n{k}", "function", f"ab{k}", f"q{999 - k}", "f.py", "python", k, k, True) for k in range(50)], NODE)
    got = explore.workspace_symbols(nodes, "ab", 3, None).collect()
    assert [(r.id, r.stage, r.exceeded) for r in got] == [("n49", 1, False), ("n48", 1, False), ("n47", 1, False)]
    assert explore.workspace_symbols(nodes, "ab", 3, 10).first().exceeded


@pytest.mark.parametrize("most", [0, 1, 6, 7, 8, None])
def test_hierarchies_to_a_depth(spark, most):
    from graphloom.operators import traversal

    edges = spark.createDataFrame([(k, f"c{k}", f"c{k + 1}", "extends") for k in range(20)], "edge_id long, source string, target string, kind string")
    root = spark.createDataFrame([("c10",)], "id string")
    got = {(r.id, r.depth) for r in (traversal.type_hierarchy(edges, root) if most is None else traversal.type_hierarchy(edges, root, max_depth=most)).collect()}
    assert got == {(f"c{10 + d}", abs(d)) for d in range(-10, 11) if most is None or abs(d) <= most}
