"""Search, stores, catalogs, streams and extraction on small inputs."""

import sqlite3

import pytest

from graphloom.operators import catalogs, changes, resolve, search, store
from graphloom.sources import extract
from graphloom.streaming import sync


def test_parse_query():
    q = search.parse_query('kind:function lang:Go path:"src/my api" name:auth free "two words" other:x kind:')
    assert (q.kinds, q.languages, q.paths, q.names) == (["function"], ["go"], ["src/my api"], ["auth"])
    assert q.text.split() == ["free", "two", "words", "other:x", "kind:"]


def test_bm25_against_a_full_text_engine(spark):
    rows = [("function:1", "getUser", "app.getUser", "Fetch the user by id", "get(id)"), ("class:2", "User_Store", "app.User_Store", "keeps users", None), ("function:3", "save", "app.save", None, "save(user)"), ("function:4", "main", "main", "entry", None), ("class:5", "other", "x.other", "nothing", None)]
    con = sqlite3.connect(":memory:")
    try:
        con.execute("CREATE VIRTUAL TABLE t USING fts5(id, name, qualified_name, docstring, signature)")
    except sqlite3.OperationalError:
        pytest.skip("no full-text engine here")
    con.executemany("INSERT INTO t VALUES (?,?,?,?,?)", rows)
    nodes = spark.createDataFrame(rows, "id string, name string, qualified_name string, docstring string, signature string")
    for text in ("user", "fetch save", "function"):
        match = " OR ".join(f'"{t}"*' for t in text.split())
        want = {r[0]: -r[1] for r in con.execute("SELECT id, bm25(t, 0, 20, 5, 1, 2) FROM t WHERE t MATCH ?", (match,))}
        got = {r.id: r.score for r in search.bm25(nodes, text).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_fusion(spark):
    arm = lambda xs: spark.createDataFrame([(x, k + 1) for k, x in enumerate(xs)], "id string, rank int")
    got = [(r.id, r.match_type) for r in search.reciprocal_rank_fusion(arm("abc"), arm("bd"), 10).collect()]
    assert got == [("b", "both"), ("a", "keyword"), ("d", "semantic"), ("c", "keyword")]
    assert search.resolve_mode("auto", True, 0) == "keyword" and search.resolve_mode("auto", True, 3) == "hybrid"


def test_edges_come_back_and_are_distinct(spark):
    schema = "edge_id long, source string, target string, kind string, metadata string, line int, col int, provenance string"
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    old = spark.createDataFrame([(1, "a", "b", "calls", '{"lsp":{"active":false}}', None, None, None)], schema)
    new = spark.createDataFrame([(2, "a", "b", "calls", "{}", None, None, None), (3, "a", "x", "calls", None, 1, 1, None), (4, "b", "a", "calls", None, None, None, None), (5, "b", "a", "calls", None, None, None, None)], schema)
    assert {(r.edge_id, r.metadata) for r in store.insert_edges(old, new, nodes).collect()} == {(1, "{}"), (4, None)}
    assert store.distinct_edges(new).count() == 3


def test_versions_swap(spark, tmp_path):
    table = store.VersionedTable(spark, f"file://{tmp_path}/t")
    assert table.version() == 0
    assert [table.swap(spark.range(n)) for n in (2, 5)] == [1, 2] and table.read().count() == 5


def test_stream_of_changes(spark, tmp_path):
    schema = "key string, at long, value string, gone boolean"
    source = f"{tmp_path}/in"
    table = store.VersionedTable(spark, f"file://{tmp_path}/t")
    batches = [[("a", 1, "x", False), ("b", 2, "y", False), ("a", 3, "z", False)], [("b", 4, None, True), ("c", 5, "w", False)]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = sync.file_stream(spark, source, spark.read.parquet(source).schema, "*.parquet")
        sync.sync_stream(stream, table, "key", "at", "gone", f"{tmp_path}/check").awaitTermination()
    assert {(r.key, r.value) for r in sync.live(table, "gone").collect()} == {("a", "z"), ("c", "w")}
    late = spark.createDataFrame([("a", 2, "old", False), ("b", 3, "back", False), ("c", 6, "v", False)], schema)
    sync.apply_changes(table, late, "key", "at", "gone")
    assert {(r.key, r.value) for r in sync.live(table, "gone").collect()} == {("a", "z"), ("c", "v")}


def test_progress_and_retries(spark, tmp_path):
    import time

    told = []
    listener = sync.Progress(lambda *x: told.append(x))
    spark.streams.addListener(listener)
    spark.range(5).write.parquet(f"{tmp_path}/in")
    source = lambda: sync.file_stream(spark, f"{tmp_path}/in", "id long", "*.parquet")
    tries = []

    def start():
        tries.append(1)

        def step(batch, _):
            if len(tries) < 3:
                raise ValueError("not yet")
            batch.count()

        return source().writeStream.foreachBatch(step).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()

    assert sync.with_retries(start, first_wait=0.01) and len(tries) == 3
    assert not sync.with_retries(lambda: source().writeStream.foreachBatch(lambda b, _: 1 / 0).option("checkpointLocation", f"{tmp_path}/d").trigger(availableNow=True).start(), tries=2, first_wait=0.01)
    for _ in range(50):
        if any(x[0] == "failed" for x in told) and any(x[0] == "progress" for x in told):
            break
        time.sleep(0.1)
    spark.streams.removeListener(listener)
    assert {"started", "progress", "ended", "failed"} <= {x[0] for x in told}


def test_plug_ins(spark):
    from pyspark.sql import functions as F

    from graphloom import plugins

    provider = plugins.hashed_words(8)
    inputs = spark.createDataFrame([(f"n{k}", f"text {k % 3}", f"h{k}") for k in range(10)], "id string, input string, input_hash string")
    vectors = plugins.embed_nodes(inputs, provider)
    rows = {r.node_id: r for r in vectors.collect()}
    assert len(rows) == 10 and rows["n0"].vector == rows["n3"].vector != rows["n1"].vector and rows["n0"].dims == 8
    known = vectors.filter("node_id <> 'n4'")
    assert [r.node_id for r in plugins.embed_nodes(inputs, provider, known).collect()] == ["n4"]
    state = plugins.vector_state(vectors, provider.model)
    changed = vectors.withColumn("input_hash", F.when(F.col("node_id") == "n1", "new").otherwise(F.col("input_hash")))
    assert state[:3] == (provider.model, 10, 8) and plugins.vector_state(changed, provider.model)[3] != state[3] == plugins.vector_state(vectors.orderBy(F.desc("node_id")), provider.model)[3]
    assert plugins.vector_state(vectors, "other")[1:3] == (0, 0)
    members = spark.createDataFrame([("c", "b/x"), ("c", "a/y"), ("d", "z")], "community string, path string")
    label = lambda paths: paths[0] if len(paths) > 1 else 1 / 0
    assert {tuple(r) for r in plugins.label_clusters(members, label).collect()} == {("c", "a/y"), ("d", None)}
    plugins.REGISTRY.extractors["lua"] = lambda path, source: {"path": path, "nodes": [], "edges": [], "refs": [], "errors": ["own"]}
    plugins.REGISTRY.frameworks["mine"] = lambda files: files.select("path", F.lit("mine").alias("framework"), F.lit("get").alias("method"), F.col("source").alias("route"))
    try:
        files = spark.createDataFrame([("a.lua", "/r")], "path string, source string")
        assert extract.extract(files).first().errors == ["own"]
        assert [tuple(r) for r in extract.routes(files).collect()] == [("a.lua", "mine", "get", "/r")]
    finally:
        plugins.REGISTRY.extractors.clear()
        plugins.REGISTRY.frameworks.clear()


def test_clusters_of_two_cliques(spark):
    files = [f"{c}{i}" for c in "ab" for i in range(4)]
    links = [(f"{c}{i}", f"{c}{j}", 3) for c in "ab" for i in range(4) for j in range(i + 1, 4)] + [("a0", "b0", 1)]
    got = catalogs.louvain(spark.createDataFrame(links, "a string, b string, weight int"), spark.createDataFrame([(f,) for f in [*files, "lone"]], "path string"))
    by = {r.path: r.community for r in got.collect()}
    assert len({by[f] for f in files[:4]}) == 1 and len({by[f] for f in files[4:]}) == 1 and len(set(by.values())) == 3


def test_identity_goes_to_the_largest_overlap(spark):
    make = lambda rows: spark.createDataFrame(rows, "cluster_id string, path string")
    old, new = make([("o", p) for p in "abcd"]), make([("n1", p) for p in "abc"] + [("n2", "d")])
    assert [tuple(r) for r in catalogs.transfer_identity(catalogs.cluster_overlaps(old, new)).collect()] == [("o", "n1")]


def test_flow_caps():
    out = {"r": [("calls", f"n{i}") for i in range(30)], "n0": [("calls", "m")], "m": [("calls", "k")]}
    rows, cut = catalogs.trace_one("r", out, depth=2)
    assert len(rows) == 22 and cut == {"depth": True, "width": True, "steps": False}


def test_interval_join_against_all_pairs(spark):
    hunks = [(k, "f", 7 * k, 7 * k + k % 90) for k in range(60)]
    symbols = [(f"s{k}", "function", "f", 5 * k, 5 * k + (k * 13) % 300) for k in range(80)]
    nodes = spark.createDataFrame(symbols, "id string, kind string, file_path string, start_line int, end_line int")
    got = changes.intersecting_symbols(spark.createDataFrame(hunks, "hunk_id int, path string, start int, end int"), nodes)
    want = sorted((h[0], s[0]) for h in hunks for s in symbols if s[3] <= h[3] and s[4] >= h[2])
    assert sorted((r.hunk_id, r.id) for r in got.collect()) == want


def test_extraction(spark, tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "pkg/a.py").write_text("import os\nclass A(Base):\n    def run(self):\n        return helper(os.path.join('x'))\n\n@app.route('/x')\ndef helper(v):\n    '''Doc.'''\n    return v\n")
    (tmp_path / "pkg/b.ts").write_text("import { x } from './x'\nexport function main() {\n  app.get('/users', list)\n  run()\n}\n")
    (tmp_path / "pkg/bad.py").write_text("def (:\n")
    (tmp_path / "node_modules/c.js").write_text("x")
    files = extract.scan(spark, str(tmp_path))
    assert {r.path for r in files.collect()} == {"pkg/a.py", "pkg/b.ts", "pkg/bad.py"}
    nodes, edges, refs = extract.tables(extract.extract(files))
    assert {(r.kind, r.qualified_name) for r in nodes.filter("kind <> 'file'").collect()} == {("class", "A"), ("method", "A.run"), ("function", "helper"), ("function", "main")}
    assert edges.count() == 4
    names = {(r.reference_name, r.reference_kind) for r in refs.collect()}
    assert {("Base", "extends"), ("helper", "calls"), ("os.path.join", "calls"), ("os", "imports"), ("app.route", "decorates"), ("./x", "imports"), ("run", "calls")} <= names
    assert {(r.framework, r.method, r.route) for r in extract.routes(files).collect()} >= {("flask", "route", "/x"), ("express", "get", "/users")}
    bad = extract.extract(files).filter("path = 'pkg/bad.py'").first()
    assert bad.errors and len(bad.nodes) == 1


def test_the_ceiling_counts_candidates_behind_the_language_gate(spark):
    schema = "id string, name string, kind string, qualified_name string, file_path string, language string, is_exported boolean, start_line int"
    many = [("swift", 2100, "get"), ("java", 1, "get"), ("cpp", 300, "get"), ("java", 500, "put"), ("java", 501, "set"), ("java", 499, "pop"), (None, 1, "pop"), ("cpp", 1, "pop"), ("java", 500, "add"), ("python", 1, "add")]
    nodes = [(f"{name}:{language}:{k:04}", name, "function", name, f"src/{language}{k}", language, True, k) for language, n, name in many for k in range(n)]
    family = {"swift": "apple", "java": "jvm", "kotlin": "jvm", "cpp": "c"}
    passes = lambda a, b: family.get(a) is None or family.get(b) is None or family[a] == family[b]
    refs = [(f"{language}:{name}", name, "calls", "src/main", language, 1) for language in ("swift", "java", "kotlin", "cpp", "python", None) for name in ("get", "put", "set", "pop", "add", "none")]
    got = {r.ref_id: r for r in resolve.by_exact_name(spark.createDataFrame(refs, "ref_id string, reference_name string, reference_kind string, file_path string, language string, line int"), spark.createDataFrame(nodes, schema)).collect()}
    counts = {r[0]: sum(n for language, n, name in many if name == r[1] and passes(r[4], language)) for r in refs}
    assert got["java:get"].target == "get:java:0000" and got["java:get"].confidence == 0.9 and got["kotlin:get"].confidence == 0.5
    assert got["cpp:get"].target.startswith("get:cpp") and "java:put" in got and "java:pop" in got
    assert not [r for r in got if not 0 < counts[r] <= resolve.AMBIGUOUS]
    same = {(language, name) for language, _, name in many}
    assert not [r[0] for r in refs if r[0] not in got and 0 < counts[r[0]] <= resolve.AMBIGUOUS and (r[4], r[1]) in same]
