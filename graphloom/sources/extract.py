"""Source files to nodes, edges and references.

Python is parsed with its own grammar; for other languages declarations,
imports and calls are found by line patterns, which is less than a parser
finds. A file that cannot be parsed gives its file node and an error.
"""

from __future__ import annotations

import ast
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions.columns import base_name
from graphloom.plugins import REGISTRY

# Extensions.
LANGUAGES = {"py": "python", "pyi": "python", "ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "jsx", "mjs": "javascript", "go": "go", "java": "java", "kt": "kotlin", "scala": "scala", "rs": "rust", "rb": "ruby", "php": "php", "cs": "csharp", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "hpp": "cpp", "swift": "swift", "m": "objc", "dart": "dart", "lua": "lua", "vue": "vue", "svelte": "svelte", "astro": "astro", "razor": "razor", "cshtml": "razor", "liquid": "liquid", "tf": "terraform"}
MOST_BYTES = 1 << 20
IGNORED = r"(?:^|/)(?:\.git|node_modules|__pycache__|dist|build|target|vendor|\.venv)(?:/|$)"
DECLARATIONS = (
    ("class", re.compile(r"^\s*(?:export\s+|public\s+|private\s+|abstract\s+|final\s+|default\s+|pub\s+)*(?:class|struct)\s+([A-Za-z_]\w*)")),
    ("interface", re.compile(r"^\s*(?:export\s+|public\s+|pub\s+)*(?:interface|trait|protocol)\s+([A-Za-z_]\w*)")),
    ("enum", re.compile(r"^\s*(?:export\s+|public\s+|pub\s+)*enum\s+([A-Za-z_]\w*)")),
    ("function", re.compile(r"^\s*(?:export\s+|default\s+|async\s+|public\s+|private\s+|static\s+|pub\s+)*(?:function\*?|func|fn|def|fun)\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)")),
)
IMPORT = re.compile(r"""^\s*(?:import\b.*?["']([^"']+)["']|import\s+([\w.]+)|#include\s+[<"]([^>"]+)|use\s+([\w:]+)|require\s*\(?\s*["']([^"']+))""")
CALL = re.compile(r"([A-Za-z_][\w.]*)\s*\(")
KEYWORDS = frozenset("if for while switch return catch function func fn def fun elif match new super print sizeof typeof".split())

NODES = "id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, end_line int, is_exported boolean, docstring string"
EXTRACTED = f"path string, nodes array<struct<{NODES.replace(' ', ':').replace(',:', ',')}>>, edges array<struct<source:string,target:string,kind:string,line:int>>, refs array<struct<from_node_id:string,reference_name:string,reference_kind:string,line:int>>, errors array<string>"


def language_of(path: Column) -> Column:
    """The language of a path by its extension; unknown otherwise."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.coalesce(F.element_at(table, F.lower(F.regexp_extract(base_name(path), r"\.([^.]+)$", 1))), F.lit("unknown"))


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(path, source, size, modified_at, content_hash) of the source files under a folder, without ignored folders and files over 1 MiB."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + re.escape(root.removeprefix("file://").rstrip("/")) + "/", "")
    kept = files.withColumn("path", path).filter(~F.col("path").rlike(IGNORED) & (F.col("length") <= MOST_BYTES) & (language_of(F.col("path")) != "unknown"))
    return kept.select("path", F.decode("content", "UTF-8").alias("source"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modified_at"), F.sha2("content", 256).alias("content_hash"))


def _ident(path: str, kind: str, name: str, line: int) -> str:
    return f"{kind}:{hashlib.sha256(f'{path}:{kind}:{name}:{line}'.encode()).hexdigest()[:32]}"


def _node(path: str, language: str, kind: str, name: str, qualified: str, start: int, end: int, doc: str | None = None) -> dict:
    return {"id": _ident(path, kind, name, start), "kind": kind, "name": name, "qualified_name": qualified, "file_path": path, "language": language, "start_line": start, "end_line": end, "is_exported": not name.startswith("_"), "docstring": doc}


def extract_python(path: str, source: str) -> dict:
    top = _node(path, "python", "file", path.rsplit("/", 1)[-1], path, 1, max(1, source.count("\n") + 1))
    out = {"path": path, "nodes": [top], "edges": [], "refs": [], "errors": []}
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError) as error:
        out["errors"].append(str(error))
        return out

    def name_of(node: ast.expr) -> str:
        return ast.unparse(node) if isinstance(node, (ast.Name, ast.Attribute)) else ""

    def refer(owner: str, name: str, kind: str, line: int) -> None:
        if name:
            out["refs"].append({"from_node_id": owner, "reference_name": name, "reference_kind": kind, "line": line})

    todo = [(tree, top["id"], "", False)]
    while todo:
        parent, owner, prefix, in_class = todo.pop()
        for child in ast.iter_child_nodes(parent):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(child, ast.ClassDef) else "method" if in_class else "function"
                node = _node(path, "python", kind, child.name, prefix + child.name, child.lineno, child.end_lineno or child.lineno, ast.get_docstring(child))
                out["nodes"].append(node)
                out["edges"].append({"source": owner, "target": node["id"], "kind": "contains", "line": child.lineno})
                for decorator in child.decorator_list:
                    refer(node["id"], name_of(decorator.func if isinstance(decorator, ast.Call) else decorator), "decorates", child.lineno)
                for base in getattr(child, "bases", ()):
                    refer(node["id"], name_of(base), "extends", child.lineno)
                todo.append((child, node["id"], f"{prefix}{child.name}.", kind == "class"))
                continue
            if isinstance(child, (ast.Import, ast.ImportFrom)):
                module = getattr(child, "module", None)
                for alias in child.names:
                    refer(owner, f"{module}.{alias.name}" if module else alias.name, "imports", child.lineno)
            elif isinstance(child, ast.Call):
                refer(owner, name_of(child.func), "calls", child.lineno)
            todo.append((child, owner, prefix, in_class))
    return out


def extract_lines(path: str, source: str, language: str) -> dict:
    """Declarations by pattern; a declaration lasts until the next one of its file begins."""
    lines = source.split("\n")
    top = _node(path, language, "file", path.rsplit("/", 1)[-1], path, 1, len(lines))
    out = {"path": path, "nodes": [top], "edges": [], "refs": [], "errors": []}
    owner = top
    for number, line in enumerate(lines, 1):
        found = next(((kind, m[1]) for kind, p in DECLARATIONS if (m := p.match(line))), None)
        if found:
            owner["end_line"] = max(owner["start_line"], number - 1) if owner is not top else owner["end_line"]
            owner = _node(path, language, *found, found[1], number, len(lines))
            out["nodes"].append(owner)
            out["edges"].append({"source": top["id"], "target": owner["id"], "kind": "contains", "line": number})
        elif m := IMPORT.match(line):
            out["refs"].append({"from_node_id": top["id"], "reference_name": next(x for x in m.groups() if x), "reference_kind": "imports", "line": number})
            continue
        for m in CALL.finditer(line):
            if m[1].rsplit(".", 1)[-1] not in KEYWORDS and not (found and m[1] == found[1]):
                out["refs"].append({"from_node_id": owner["id"], "reference_name": m[1], "reference_kind": "calls", "line": number})
    return out


# Files that hold code in blocks, and the language of a block without one of its own.
MARKUP = {"vue": "javascript", "svelte": "javascript", "astro": "typescript", "razor": "csharp", "liquid": "liquid"}
BLOCKS = {
    "vue": re.compile(r"<script\b([^>]*)>(.*?)</script>", re.S | re.I),
    "svelte": re.compile(r"<script\b([^>]*)>(.*?)</script>", re.S | re.I),
    "astro": re.compile(r"\A()\s*---\r?\n(.*?)\r?\n---|<script\b([^>]*)>(.*?)</script>", re.S | re.I),
    "razor": re.compile(r"@(code|functions)\s*\{(.*?)^\}", re.S | re.M),
}
TAG = re.compile(r"<([A-Z][\w.]*|[a-z]+(?:-[a-z0-9]+)+)\b")
INCLUDE = re.compile(r"""\{%-?\s*(?:render|include|section|layout)\s+['"]([^'"]+)""")


def extract_markup(path: str, source: str, language: str) -> dict:
    """Files that mix markup and code: a component, what its code blocks declare and call, at the lines of the file, and the components that its markup uses."""
    lines = source.count("\n") + 1
    top = _node(path, language, "file", path.rsplit("/", 1)[-1], path, 1, lines)
    name = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    component = _node(path, language, "component", name, name, 1, lines)
    out = {"path": path, "nodes": [top, component], "edges": [{"source": top["id"], "target": component["id"], "kind": "contains", "line": 1}], "refs": [], "errors": []}
    rest = source
    for m in BLOCKS[language].finditer(source) if language in BLOCKS else ():
        groups = m.groups()
        attributes, code, at = (groups[0], groups[1], m.start(2)) if groups[1] is not None else (groups[2], groups[3], m.start(4))
        inner = "typescript" if re.search(r"lang\s*=\s*[\"']tsx?", attributes or "") else MARKUP[language]
        skip = source.count("\n", 0, at)
        found = extract_lines(path, code, inner)
        owner = {found["nodes"][0]["id"]: component["id"]}
        for node in found["nodes"][1:]:
            moved = _node(path, inner, node["kind"], node["name"], f"{name}.{node['name']}", node["start_line"] + skip, node["end_line"] + skip)
            owner[node["id"]] = moved["id"]
            out["nodes"].append(moved)
        out["edges"] += [{"source": owner[e["source"]], "target": owner[e["target"]], "kind": e["kind"], "line": e["line"] + skip} for e in found["edges"]]
        out["refs"] += [{**r, "from_node_id": owner[r["from_node_id"]], "line": r["line"] + skip} for r in found["refs"]]
        rest = rest[: m.start()] + re.sub(r"[^\n]", " ", m[0]) + rest[m.end() :]
    for pattern, kind in ((TAG, "references"), (INCLUDE, "imports")):
        if kind == "references" or language == "liquid":
            out["refs"] += [{"from_node_id": component["id"], "reference_name": m[1], "reference_kind": kind, "line": rest.count("\n", 0, m.start()) + 1} for m in pattern.finditer(rest)]
    return out


VALUE = re.compile(r"[(,=:\[]\s*&?([A-Za-z_$][\w$]*(?:::[A-Za-z_]\w*)?)\s*(?=[,)\];}]|$)")


def function_values(out: dict, source: str) -> dict:
    """Adds a reference of kind function_ref wherever a function or method of the file is passed, stored or listed without being called, once for each place."""
    known = {n["name"] for n in out["nodes"] if n["kind"] in ("function", "method")}
    owners = sorted((n for n in out["nodes"] if n["kind"] != "file"), key=lambda n: (n["end_line"] - n["start_line"], n["id"]))
    top = out["nodes"][0]["id"] if out["nodes"] else None
    seen = set()
    for number, line in enumerate(source.splitlines() if known else (), 1):
        if re.match(r"\s*(?:import|export\s*\{|from|def|function|//|#)", line):
            continue
        for m in VALUE.finditer(line):
            name = m[1]
            if name.rsplit("::", 1)[-1] in known and (name, number) not in seen:
                seen.add((name, number))
                owner = next((n["id"] for n in owners if n["start_line"] <= number <= n["end_line"]), top)
                out["refs"].append({"from_node_id": owner, "reference_name": name, "reference_kind": "function_ref", "line": number})
    return out


def extract_file(path: str, source: str, language: str) -> dict:
    if language == "python":
        return function_values(extract_python(path, source), source)
    if language in MARKUP:
        return extract_markup(path, source, language)
    return function_values(extract_lines(path, source, language), source)


def extract(files: DataFrame) -> DataFrame:
    """One row per file (path, source): its nodes, edges, references and errors; by the registered extractor of its language, where there is one."""
    added = dict(REGISTRY.extractors)

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [added[lang](p, s or "") if lang in added else extract_file(p, s or "", lang) for p, s, lang in zip(pdf["path"], pdf["source"], pdf["language"])]
            yield pd.DataFrame(rows, columns=["path", "nodes", "edges", "refs", "errors"])

    return files.select("path", "source", language_of(F.col("path")).alias("language")).mapInPandas(each, EXTRACTED)


def tables(extracted: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, edges and refs of extracted files."""
    flat = lambda name: extracted.select(F.explode(name).alias("x")).select("x.*")
    return flat("nodes"), flat("edges"), flat("refs")


# Route patterns by framework.
ROUTES = {
    "express": r"(?:app|router)\.(get|post|put|patch|delete)\(\s*['\"]([^'\"]+)",
    "flask": r"@\w+\.(route)\(\s*['\"]([^'\"]+)",
    "fastapi": r"@\w+\.(get|post|put|patch|delete)\(\s*['\"]([^'\"]+)",
    "spring": r"@(Get|Post|Put|Patch|Delete|Request)Mapping\(\s*(?:value\s*=\s*)?\"([^\"]+)",
    "go": r"\.(GET|POST|PUT|PATCH|DELETE|HandleFunc)\(\s*\"([^\"]+)",
    "rails": r"^\s*(get|post|put|patch|delete)\s+['\"]([^'\"]+)",
    "laravel": r"Route::(get|post|put|patch|delete)\(\s*['\"]([^'\"]+)",
    "django": r"\b(path|re_path)\(\s*r?['\"]([^'\"]*)",
}


def routes(files: DataFrame) -> DataFrame:
    """(path, framework, method, route) of route declarations in (path, source), and what registered frameworks find."""
    found = None
    for resolver in REGISTRY.frameworks.values():
        own = resolver(files).select("path", "framework", "method", "route")
        found = own if found is None else found.unionByName(own)
    for framework, pattern in ROUTES.items():
        hits = files.filter(F.col("source").rlike("(?m)" + pattern)).select("path", F.lit(framework).alias("framework"), F.explode(F.arrays_zip(F.regexp_extract_all("source", F.lit("(?m)" + pattern), F.lit(1)).alias("method"), F.regexp_extract_all("source", F.lit("(?m)" + pattern), F.lit(2)).alias("route"))).alias("r")).select("path", "framework", F.lower("r.method").alias("method"), "r.route")
        found = hits if found is None else found.unionByName(hits)
    return found


# Forms of dynamic dispatch.
DYNAMIC = {"computed-member": r"\w+\[\s*\w+\s*\]\s*\(", "reflection": r"\b(?:getattr|Reflect\.\w+|Class\.forName|\.invoke)\s*\(", "eval": r"\beval\s*\(", "emit": r"\.(?:emit|dispatch|publish|trigger)\s*\("}


def dynamic_dispatch(files: DataFrame) -> DataFrame:
    """(path, form, hits) of dynamic calls in (path, source)."""
    counts = F.array(*[F.struct(F.lit(k).alias("form"), F.regexp_count("source", F.lit(p)).alias("hits")) for k, p in DYNAMIC.items()])
    return files.select("path", F.explode(counts).alias("d")).select("path", "d.form", "d.hits").filter("hits > 0")
