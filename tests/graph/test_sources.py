"""Git, markup files, function values, registered entries, settings, code blocks and workspace symbols on small inputs."""

import subprocess

from graphloom.operators import catalogs, changes, explore, store
from graphloom.sources import extract, git


def test_git(spark, tmp_path):
    root = str(tmp_path)
    run = lambda *a: subprocess.run(["git", "-C", root, "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    run("init", "-q")
    for name, text in ((".gitignore", "skip/\n*.log\n"), ("a.py", "one\ntwo\nthree\n"), ("b.py", "x\n" * 20), ("d.py", "gone\n")):
        (tmp_path / name).write_text(text)
    (tmp_path / "skip").mkdir()
    (tmp_path / "skip/x.py").write_text("no")
    run("add", "-A")
    run("commit", "-qm", "first")
    (tmp_path / "a.py").write_text("one\nTWO\nthree\n")
    (tmp_path / "b.py").rename(tmp_path / "c.py")
    (tmp_path / "d.py").unlink()
    (tmp_path / "é.py").write_text("new")
    (tmp_path / "y.log").write_text("no")
    assert [r.path for r in git.visible_files(spark, root).collect()] == [".gitignore", "a.py", "c.py", "é.py"]
    run("add", "c.py", "b.py")
    got = {(r.change_kind, r.old_path, r.new_path) for r in git.changed_files(spark, root, "all").collect()}
    assert got == {("modified", "a.py", "a.py"), ("renamed", "b.py", "c.py"), ("deleted", "d.py", None), ("untracked", None, "é.py")}
    hunks = changes.parse_unified_diff(git.diff_lines(spark, root)).collect()
    assert (2, 1) in {(r.new_start, r.new_lines) for r in hunks}


def test_name_status(spark):
    rows = spark.createDataFrame([(e,) for e in ("M\ta", "A\tb", "D\tc", "R087\tx\ty", "C100\tp\tq", "T\tz")], "entry string")
    assert [(r.status, r.old_path, r.new_path, r.change_kind) for r in git.parse_name_status(rows).collect()] == [("M", "a", "a", "modified"), ("A", None, "b", "added"), ("D", "c", None, "deleted"), ("R087", "x", "y", "renamed"), ("C100", "p", "q", "renamed"), ("T", "z", "z", "unknown")]


def test_markup(spark):
    vue = "<template>\n  <UserCard @click=\"go\"/>\n  <my-list/>\n</template>\n<script lang=\"ts\">\nimport { x } from './x'\nfunction go() {\n  save()\n}\n</script>\n"
    liquid = "<div>\n{% render 'card', a: 1 %}\n</div>"
    razor = "<h1>@Title</h1>\n@code {\n  public class Inner {}\n}\n"
    rows = extract.extract(spark.createDataFrame([("a/Page.vue", vue), ("b.liquid", liquid), ("c.razor", razor), ("d.svelte", None)], "path string, source string"))
    nodes, edges, refs = extract.tables(rows)
    got = {(r.file_path, r.kind, r.name, r.start_line) for r in nodes.filter("kind <> 'file'").collect()}
    assert got == {("a/Page.vue", "component", "Page", 1), ("a/Page.vue", "function", "go", 7), ("b.liquid", "component", "b", 1), ("c.razor", "component", "c", 1), ("c.razor", "class", "Inner", 3), ("d.svelte", "component", "d", 1)}
    said = {(r.reference_name, r.reference_kind, r.line) for r in refs.collect()}
    assert {("UserCard", "references", 2), ("my-list", "references", 3), ("./x", "imports", 6), ("save", "calls", 8), ("card", "imports", 2)} <= said
    ids = {r.id for r in nodes.collect()}
    assert all(r.source in ids and r.target in ids for r in edges.collect()) and all(r.from_node_id in ids for r in refs.collect())


def test_function_values(spark):
    source = "def handler(e):\n    return e\n\ndef wire(bus):\n    bus.on('x', handler)\n    table = [handler, other]\n    handler(1)\n    cb = handler\n"
    _, _, refs = extract.tables(extract.extract(spark.createDataFrame([("a.py", source)], "path string, source string")))
    assert {(r.reference_name, r.line) for r in refs.filter("reference_kind = 'function_ref'").collect()} == {("handler", 5), ("handler", 6), ("handler", 8)}


def test_registered_entries(spark):
    source = "program.command('sync <dir>').description('x').action(runSync)\nprogram.command('other').option('-x')\n// program.command('no').action(dead)\nbus.on('saved', onSaved);\nel.addEventListener(\"click\", clicked, true)\nbus.emit('saved', dead)\nprogram.command('inline').action(() => run())\n"
    nodes = spark.createDataFrame([("1", "function", "runSync", "z.ts", "runSync"), ("2", "function", "runSync", "cli.ts", "runSync"), ("3", "function", "onSaved", "b.ts", "onSaved"), ("4", "function", "onSaved", "a.ts", "onSaved"), ("5", "method", "clicked", "q.ts", "Q::clicked"), ("6", "function", "dead", "cli.ts", "dead"), ("7", "class", "onSaved", "cli.ts", "onSaved")], "id string, kind string, name string, file_path string, qualified_name string")
    got = {tuple(r) for r in catalogs.registered_entries(spark.createDataFrame([("cli.ts", source)], "path string, source string"), nodes).collect()}
    assert got == {("2", "cli"), ("4", "event"), ("5", "event")}


def test_settings_and_vectors(spark, tmp_path):
    meta = store.VersionedTable(spark, f"file://{tmp_path}/meta")
    make = lambda rows: spark.createDataFrame(rows, "node_id string, v int")
    assert store.metadata(meta) == {}
    store.set_metadata(meta, "model", "m")
    rows = store.upsert_vectors(make([("a", 1), ("b", 1)]), make([("b", 2), ("c", 2)]), meta)
    assert {tuple(r) for r in rows.collect()} == {("a", 1), ("b", 2), ("c", 2)}
    store.upsert_vectors(rows, make([]), meta)
    assert store.metadata(meta) == {"model": "m", "vectors_version": "1"} and store.bump(meta, "vectors_version") == 2


def test_blocks_and_workspace(spark):
    nodes = spark.createDataFrame([("e", "class", "E", "E", "a.ts", "typescript", 2, 3), ("f", "function", "fold", "m.fold", "a.ts", "typescript", 4, 4), ("c", "class", "Folder", "Folder", "a.ts", "typescript", 5, 9), ("v", "variable", "unfold", "unfold", "a.ts", "typescript", 1, 1), ("g", "function", "x", "fold.x", "none.ts", "go", 1, 1)], "id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, end_line int")
    files = spark.createDataFrame([("a.ts", "one\ntwo\r\nthree\nfour is long\nfive")], "path string, source string")
    found = spark.createDataFrame([("c", "near", 1), ("f", "near", 1), ("e", "entry", 0), ("v", "near", 1), ("g", "near", 1)], "id string, role string, depth int")
    assert [(r.place, r.id, r.content) for r in explore.code_blocks(found, nodes, files, size=7).collect()] == [(1, "e", "two\nthr" + explore.CUT), (2, "f", "four is" + explore.CUT), (3, "c", "five")]
    look = lambda *a, **k: [(r.id, r.stage, r.exceeded) for r in explore.workspace_symbols(nodes, *a, **k).collect()]
    assert look("FOLD") == [("f", 0, False), ("c", 1, False), ("v", 2, False), ("g", 3, False)]
    assert look("fold", budget=2) == [("f", 0, True), ("c", 1, True), ("v", 2, True)] and look("fold", languages=("go",)) == [("g", 3, False)]


def test_explore(spark):
    names = {"login": "auth/login.ts", "check": "auth/login.ts", "session": "auth/session.ts", "far": "lib/far.ts", "other": "lib/other.ts", "loginTest": "auth/login.test.ts"}
    nodes = spark.createDataFrame([(n, "function", n, n, f, None, None, "typescript", 1) for n, f in names.items()], "id string, kind string, name string, qualified_name string, file_path string, docstring string, signature string, language string, start_line int")
    edges = spark.createDataFrame([(0, "login", "check", "calls"), (1, "login", "session", "calls"), (2, "session", "far", "calls"), (3, "loginTest", "login", "calls")], "edge_id long, source string, target string, kind string")
    got = explore.explore(nodes, edges, "how does login keep a session").collect()
    assert got[0].file_path in ("auth/login.ts", "auth/session.ts") and "lib/other.ts" not in {r.file_path for r in got}
    assert [r.place for r in got] == list(range(1, len(got) + 1)) and [r.tier for r in got] == sorted(r.tier for r in got)
