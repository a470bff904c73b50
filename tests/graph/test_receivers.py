"""Imports, function values, receivers, chains and synthesised edges on small inputs with known answers."""

import pytest

from graphloom.operators import imports, receivers

NODE = "id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, end_line int, is_exported boolean, return_type string"
REF = "ref_id string, from_node_id string, reference_name string, file_path string, language string, line int"


@pytest.fixture
def make(spark):
    def node(id, kind="function", qualified=None, path="a.ts", language="typescript", start=1, end=9, exported=True, returns=None):
        return (id, kind, (qualified or id).replace("::", ".").rsplit(".", 1)[-1], qualified or id, path, language, start, end, exported, returns)

    nodes = lambda *rows: spark.createDataFrame([node(*r[:1], **r[1]) if len(r) == 2 and isinstance(r[1], dict) else node(*r) for r in rows], NODE)
    refs = lambda *rows: spark.createDataFrame([(r[0], r[1], r[2], r[3] if len(r) > 3 else "a.ts", r[4] if len(r) > 4 else "typescript", r[5] if len(r) > 5 else 5) for r in rows], REF)
    return nodes, refs


def said(df):
    return {r.ref_id: (r.target, r.confidence) for r in df.collect()}


def test_paths(spark):
    rows = [("a/b/../c/./d", "a/c/d"), ("./x", "x"), ("a/../../x", None), ("a//b", "a/b"), ("..", None)]
    got = spark.createDataFrame(rows, "p string, want string").select(imports.normalised(imports.F.col("p")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)


def test_module_files(spark):
    files = spark.createDataFrame([(p,) for p in ("src/app/x.ts", "src/app/y/index.ts", "src/lib/u.ts", "packages/ui/button.tsx", "pkg/certs.py", "pkg/sub/__init__.py", "top.py", "gen/g.ts", "src/app/z.d.ts", "src/app/z.js")], "path string")
    asked = [("src/app/m.ts", "typescript", "./x", "src/app/x.ts"), ("src/app/m.ts", "typescript", "./y", "src/app/y/index.ts"), ("src/app/m.ts", "typescript", "../lib/u", "src/lib/u.ts"), ("src/app/m.ts", "typescript", "@/lib/u", "src/lib/u.ts"),
             ("src/app/m.ts", "typescript", "@acme/ui/button", "packages/ui/button.tsx"), ("src/app/m.ts", "typescript", "#g/g", "gen/g.ts"), ("src/app/m.ts", "typescript", "react", None), ("src/app/m.ts", "typescript", "./z", "src/app/z.d.ts"),
             ("pkg/m.py", "python", ".certs", "pkg/certs.py"), ("pkg/sub/m.py", "python", "..certs", "pkg/certs.py"), ("pkg/m.py", "python", ".sub", "pkg/sub/__init__.py"), ("pkg/m.py", "python", "top", "top.py"), ("src/app/m.ts", "typescript", "./x.ts", "src/app/x.ts")]
    table = spark.createDataFrame([a[:3] for a in asked], "file_path string, language string, source string")
    got = {(r.file_path, r.source): r.module_path for r in imports.module_files(table, files, [("#g/*", ["none/*", "gen/*"])], {"@acme/ui": "packages/ui"}).collect()}
    assert got == {(f, s): w for f, _, s, w in asked if w}


def test_names_through_reexports(spark, make):
    nodes, refs = make
    symbols = nodes(("save", {"path": "db/save.ts"}), ("old", {"path": "db/old.ts"}), ("K", {"kind": "class", "path": "db/k.ts"}), ("m", {"kind": "method", "qualified": "K::m", "path": "db/k.ts"}), ("hidden", {"path": "db/save.ts", "exported": False}))
    files = spark.createDataFrame([("db/save.ts",), ("db/old.ts",), ("db/k.ts",), ("db/index.ts",), ("app.ts",), ("loop.ts",)], "path string")
    again = spark.createDataFrame([("db/index.ts", "db/save.ts", "wildcard", None, None), ("db/index.ts", "db/old.ts", "named", "fresh", "old"), ("db/index.ts", "db/k.ts", "wildcard", None, None), ("loop.ts", "db/index.ts", "wildcard", None, None), ("db/save.ts", "loop.ts", "wildcard", None, None)], "path string, module_path string, kind string, name string, original string")
    table = spark.createDataFrame([("app.ts", "typescript", "./db", n, e, s) for n, e, s in (("save", "save", False), ("fresh", "fresh", False), ("db", None, True), ("Kay", "K", False), ("hidden", "hidden", False))], "file_path string, language string, source string, local_name string, exported_name string, is_namespace boolean")
    asked = refs(("1", "x", "save", "app.ts"), ("2", "x", "fresh", "app.ts"), ("3", "x", "db.save", "app.ts"), ("4", "x", "Kay.m", "app.ts"), ("5", "x", "Kay.none", "app.ts"), ("6", "x", "hidden", "app.ts"), ("7", "x", "unknown", "app.ts"))
    got = said(imports.by_import(asked, table, symbols, files, again))
    assert got == {"1": ("save", 0.9), "2": ("old", 0.9), "3": ("save", 0.9), "4": ("m", 0.9), "5": ("K", 0.9)}


def test_function_values(make):
    nodes, refs = make
    symbols = nodes(("f1", {"qualified": "f", "path": "a.ts", "start": 20}), ("f2", {"qualified": "f", "path": "a.ts", "start": 3}), ("g1", {"qualified": "g", "path": "b.ts"}), ("h1", {"qualified": "h", "path": "b.ts"}), ("h2", {"qualified": "h", "path": "c.ts"}),
                    ("k", {"kind": "method", "qualified": "A::k", "path": "b.ts"}), ("p", {"qualified": "p", "path": "b.py", "language": "python"}), ("own", {"qualified": "own"}), ("jm", {"kind": "method", "qualified": "J::jm", "path": "J.java", "language": "java"}))
    got = said(receivers.by_function_ref(refs(("1", "x", "f"), ("2", "x", "g"), ("3", "x", "h"), ("4", "x", "k"), ("5", "x", "A::k"), ("6", "x", "p"), ("7", "own", "own"), ("8", "x", "this.f"), ("9", "x", "jm", "K.java", "java")), symbols))
    assert got == {"1": ("f2", 0.9), "2": ("g1", 0.8), "5": ("k", 0.9), "9": ("jm", 0.8)}


def test_inner_functions_are_reached_from_within_only(make):
    nodes, refs = make
    symbols = nodes(("outer", {"start": 1, "end": 10}), ("inner", {"qualified": "outer::inner", "start": 3, "end": 4}), ("free", {"qualified": "ns::free", "start": 30}))
    rows = refs(("1", "x", "inner", "a.ts", "typescript", 5), ("2", "x", "inner", "a.ts", "typescript", 50), ("3", "x", "inner", "b.ts", "typescript", 5), ("4", "x", "free", "b.ts"))
    joined = rows.join(receivers._candidates(symbols), receivers.F.col("reference_name") == receivers.F.col("target_name"))
    assert {(r.ref_id, r.target) for r in receivers.lexically_reachable(joined, symbols).collect()} == {("1", "inner"), ("4", "free")}


SOURCES = [("a.ts", "typescript", "const svc = new UserService();\nfunction f(log: Logger) {\n  svc.save();\n}"), ("b.go", "go", "func main() {\n\ts := &Store{}\n\ts.Put(1)\n\tvar t *Cache\n}"), ("c.py", "python", "r = Repo(1)\nr.load()"), ("D.java", "java", "class D {\n  private Mailer mailer;\n  Mailer m2 = new Mailer();\n}"), ("e.rs", "rust", "let mut q = Queue::new();")]


def test_receiver_types(spark):
    got = {(r.file_path, r.receiver, r.type, r.line) for r in receivers.receiver_types(spark.createDataFrame(SOURCES, "path string, language string, source string")).collect()}
    assert got >= {("a.ts", "svc", "UserService", 1), ("a.ts", "log", "Logger", 2), ("b.go", "s", "Store", 2), ("b.go", "t", "Cache", 4), ("c.py", "r", "Repo", 1), ("D.java", "mailer", "Mailer", 2), ("D.java", "m2", "Mailer", 3), ("e.rs", "q", "Queue", 1)}
    assert receivers.receiver_types(spark.createDataFrame([("x.ts", "typescript", None), ("y.zz", "unknown", "a = new B()")], "path string, language string, source string")).count() == 0


def test_methods_of_receivers(spark, make):
    nodes, refs = make
    symbols = nodes(("S.save", {"kind": "method", "qualified": "S::save", "path": "s.ts"}), ("B.run", {"kind": "method", "qualified": "B::run", "path": "b.ts"}), ("S", {"kind": "class", "path": "s.ts"}), ("B", {"kind": "class", "path": "b.ts"}),
                    ("L1", {"kind": "method", "qualified": "Log::log", "path": "x.ts"}), ("L2", {"kind": "method", "qualified": "Log::log", "path": "a.ts"}), ("caller", {"start": 4, "end": 20}), ("T.make", {"kind": "method", "qualified": "T::make", "path": "t.ts", "returns": "S"}), ("mk", {"path": "t.ts", "returns": "Promise<B>"}))
    edges = spark.createDataFrame([("S", "B", "extends")], "source string, target string, kind string")
    types = spark.createDataFrame([("a.ts", "s", "S", 5), ("a.ts", "s", "Other", 2), ("a.ts", "l", "Log", 5), ("a.ts", "late", "S", 19), ("a.ts", "before", "S", 1)], "file_path string, receiver string, type string, line int")
    above = receivers.supertypes_of(edges, symbols)
    asked = refs(("1", "caller", "s.save", "a.ts", "typescript", 8), ("2", "caller", "s.run", "a.ts", "typescript", 8), ("3", "caller", "s.none", "a.ts", "typescript", 8), ("4", "caller", "l.log", "a.ts", "typescript", 8), ("5", "caller", "late.save", "a.ts", "typescript", 8), ("6", "caller", "before.save", "a.ts", "typescript", 8), ("7", "caller", "S.save", "a.ts", "typescript", 8))
    assert said(receivers.by_method_call(asked, symbols, types, above)) == {"1": ("S.save", 0.9), "2": ("B.run", 0.9), "4": ("L2", 0.9), "7": ("S.save", 0.9)}
    assert "2" not in said(receivers.by_method_call(asked, symbols, types))
    chains = refs(("1", "caller", "T.make().save"), ("2", "caller", "T::make().run"), ("3", "caller", "mk().run"), ("4", "caller", "mk().none"), ("5", "caller", "zz().run"))
    assert said(receivers.by_call_chain(chains, symbols, above)) == {"1": ("S.save", 0.85), "2": ("B.run", 0.85), "3": ("B.run", 0.85)}


def test_synthesised_edges(spark, make):
    nodes, _ = make
    frame = lambda rows: spark.createDataFrame(rows, "node string, event string")
    got = {(r.source, r.target) for r in receivers.event_edges(frame([("a", "saved"), ("b", "saved"), ("c", "tick")] + [(f"e{i}", "noise") for i in range(50)]), frame([("l", "saved"), ("a", "saved"), ("z", "noise")])).collect()}
    assert got == {("a", "l"), ("b", "l"), ("b", "a")}
    symbols = nodes(("I", {"kind": "interface"}), ("C", {"kind": "class"}), ("I.m", {"kind": "method", "qualified": "I::m"}), ("C.m", {"kind": "method", "qualified": "C::m"}), ("C.n", {"kind": "method", "qualified": "C::n"}))
    edges = spark.createDataFrame([("I", "I.m", "contains"), ("C", "C.m", "contains"), ("C", "C.n", "contains"), ("C", "I", "implements")], "source string, target string, kind string")
    assert [(r.source, r.target, r.provenance) for r in receivers.override_edges(symbols, edges).collect()] == [("I.m", "C.m", "heuristic")]
