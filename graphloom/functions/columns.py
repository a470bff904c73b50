"""Scalar rules of the graph as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Kinds, bonuses and path patterns that results depend on.
CALL_KINDS = ("calls", "references", "imports", "instantiates")
HIERARCHY_KINDS = ("extends", "implements")
CONTAINER_KINDS = ("class", "interface", "struct", "trait", "protocol", "module", "enum")
RENAME_KINDS = ("references", "calls", "imports", "extends", "implements", "type_of", "returns", "instantiates", "overrides", "decorates")
EMBEDDABLE_KINDS = ("function", "method", "class", "struct", "interface", "trait", "protocol", "enum", "type_alias", "module", "namespace", "component", "route", "constant", "variable")
REPORTABLE_KINDS = ("class", "struct", "interface", "trait", "protocol", "function", "method", "property", "field", "variable", "constant", "enum", "enum_member", "type_alias", "route", "component")
RANK_KINDS = ("calls", "references", "extends", "implements", "overrides", "instantiates", "returns", "type_of", "imports")
KIND_BONUS = {10: ("function", "method"), 9: ("interface", "trait", "protocol", "route"), 8: ("class", "component"), 6: ("type_alias", "struct"), 5: ("enum",), 4: ("module", "namespace"), 3: ("property", "field", "constant", "enum_member"), 2: ("variable",), 1: ("import", "export")}
TEST_NAME = r"(?i:^test[_.]|[._-](?:tests?|specs?)\.[a-z0-9]+$)|(?:Tests?|TestCase|Tester|Specs?)\.[A-Za-z0-9]+$"
TEST_FOLDER = r"(?i:/(?:tests?|__tests__|specs?|testlib|testing)/|^(?:tests?|specs?)/|(?:^|/)(?:integration|samples?|examples?|fixtures?|benchmarks?|demos?)/)|(?:^|/)[A-Za-z0-9]*(?:Tests?|Spec)/"
LOW_VALUE = r"(?i:(?:^|/)(?:tests?|__tests?__|spec)/|_test\.go$|(?:^|/)test_[^/]+\.py$|_test\.py$|_spec\.rb$|_test\.rb$|\.(?:test|spec)\.[jt]sx?$|(?:test|spec|tests)\.(?:java|kt|scala)$|(?:tests?|spec)\.cs$|tests?\.swift$|_test\.dart$)"
GENERATED = r"\.pb\.go$|\.pulsar\.go$|_mocks?\.go$|^mock_[^/]+\.go$|\.generated\.[jt]sx?$|\.gen\.[jt]sx?$|\.pb\.[jt]s$|_pb\.[jt]s$|\.min\.m?js$|_pb2(?:_grpc)?\.py$|_pb2\.pyi$|\.pb\.(?:cc|h)$|\.g\.cs$|Grpc\.cs$|OuterClass\.java$|Grpc\.java$|\.pb\.swift$|\.(?:g|freezed|pb|pbgrpc|chopper)\.dart$|\.generated\.rs$|_grpc_pb\.[jt]s$"
LANGUAGE_FAMILIES = {"jvm": ("java", "kotlin", "scala"), "apple": ("swift", "objc"), "web": ("typescript", "tsx", "javascript", "jsx", "arkts"), "c": ("c", "cpp"), "dotnet": ("csharp", "razor")}


def active_edge(metadata: str = "metadata") -> Column:
    """Edges that queries see: all but those whose metadata says lsp.active is false or 0."""
    return F.coalesce(~F.get_json_object(metadata, "$.lsp.active").isin("false", "0"), F.lit(True))


def edge_rank(kind: str = "kind") -> Column:
    return F.when(F.col(kind) == "contains", 0).when(F.col(kind) == "calls", 1).otherwise(2)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def folder(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def is_test_file(path: Column) -> Column:
    return base_name(path).rlike(TEST_NAME) | path.rlike(TEST_FOLDER)


def is_generated_file(path: Column) -> Column:
    return path.rlike(GENERATED)


def is_low_value_file(path: Column) -> Column:
    return path.rlike(LOW_VALUE) | is_generated_file(path)


def kind_bonus(kind: Column) -> Column:
    out = F.lit(0)
    for bonus, kinds in KIND_BONUS.items():
        out = F.when(kind.isin(*kinds), bonus).otherwise(out)
    return out


def name_match_bonus(name: Column, query: str) -> Column:
    """How well a name fits the typed query: equal, one of its words, a prefix, all of its parts, or inside."""
    low = F.lower(name)
    joined = re.sub(r"\s+", "", query).lower()
    words = [w for w in query.lower().split() if len(w) >= 2]
    parts = [p for p in re.split(r"[\s_.\-]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", query).lower()) if len(p) >= 2]
    prefix = F.floor(F.lit(10.5) + 30.0 * len(joined) / F.length(low))
    out = F.when(low == joined, 80)
    if len(words) > 1:
        out = out.when(low.isin(*words), 60)
    out = out.when(low.startswith(joined), prefix)
    if len(parts) > 1:
        inside = F.lit(True)
        for p in parts:
            inside = inside & low.contains(p)
        out = out.when(inside, 15)
    return out.when(low.contains(joined), 10).otherwise(0).cast("int")


def path_relevance(path: Column, query: str, project_words: tuple[str, ...] = ()) -> Column:
    """Each query word counts once for the file name and once for the folder or else the path; test files pay unless the query is about tests."""
    low, name, where = F.lower(path), F.lower(base_name(path)), F.lower(folder(path))
    words = [w for w in query.split() if re.sub(r"[^a-z0-9]", "", w.lower()) not in project_words] or query.split()
    score = F.lit(0)
    for word in words:
        terms = search_terms(word)
        if terms:
            has = lambda c, terms=terms: __import__("functools").reduce(lambda a, b: a | b, [c.contains(t) for t in terms])
            score = score + F.when(has(name), 10).otherwise(0) + F.when(has(where), 5).when(has(low), 3).otherwise(0)
    if not re.search("test|spec", query.lower()):
        score = score - F.when(is_test_file(path), 15).otherwise(0)
    return score.cast("int")


def search_terms(text: str) -> list[str]:
    """Lower-case terms of three characters or more: compounds, and their parts at camel and separator boundaries."""
    out: list[str] = []
    for run in re.findall(r"[A-Za-z0-9_.\-]+", text):
        spaced = re.sub(r"([a-z0-9])([A-Z])|([A-Z]+)(?=[A-Z][a-z])", lambda m: f"{m[1]} {m[2]}" if m[1] else f"{m[3]} ", run)
        out += [run, *re.split(r"[\s_.\-]+", spaced)]
    return list(dict.fromkeys(t.lower() for t in out if len(t) >= 3))


def segments(name: Column) -> Column:
    """The distinct parts of an identifier, 2 to 32 characters, at most 12, no numbers; in lower case."""
    spaced = F.regexp_replace(F.regexp_replace(name, r"([\p{Ll}\p{N}])(\p{Lu})", "$1 $2"), r"(\p{Lu}+)(\p{Lu}\p{Ll})", "$1 $2")
    parts = F.split(F.lower(spaced), r"[^\p{L}\p{N}]+")
    good = F.filter(parts, lambda p: F.length(p).between(2, 32) & ~p.rlike(r"^\p{N}+$"))
    return F.slice(F.array_distinct(good), 1, 12)


def is_distinctive(token: Column) -> Column:
    return token.rlike("[_0-9]") | F.substring(token, 2, 1 << 30).rlike("[A-Z]")


def glob_regex(pattern: str, anchored: bool = True) -> str:
    """* and ? of a qualified-name glob as a regular expression."""
    body = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern)
    return f"^{body}$" if anchored else body


def path_glob_regex(pattern: str) -> str:
    """A file glob, not anchored: ** crosses folders, * and ? do not."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            out, i = out + {"*": "[^/]*", "?": "[^/]"}.get(pattern[i], re.escape(pattern[i])), i + 1
    return out


def language_family(language: Column) -> Column:
    out = F.lit(None).cast("string")
    for family, members in LANGUAGE_FAMILIES.items():
        out = F.when(language.isin(*members), family).otherwise(out)
    return out


def shared_folders(a: Column, b: Column) -> Column:
    """Leading folders that two paths have in common."""
    x, y = F.split(folder(a), "/"), F.split(folder(b), "/")
    equal = F.zip_with(x, y, lambda p, q: (p == q) & p.isNotNull() & q.isNotNull())
    first = F.array_position(F.transform(equal, lambda e: F.coalesce(e, F.lit(False))), F.lit(False))
    return F.when(F.length(folder(a)) == 0, 0).when(first == 0, F.least(F.size(x), F.size(y))).otherwise(first - 1).cast("int")


def proximity(a: Column, b: Column) -> Column:
    return F.least(shared_folders(a, b) * 15, F.lit(80))


#: Shared folders from which proximity is at its cap.
NEAREST = 6


def folders(path: Column) -> Column:
    """The folders of a path, one by one; none for a missing path."""
    return F.coalesce(F.split(folder(path), "/"), F.array().cast("array<string>"))


def own_folders(path: Column) -> Column:
    """The same for the side that asks, where a file without a folder has none."""
    return F.when(F.length(folder(path)) == 0, F.array().cast("array<string>")).otherwise(folders(path))


def folder_points(ours: Column, theirs: Column) -> Column:
    """proximity of paths whose folders are known: own_folders of one, folders of the other."""
    points = F.lit(80)
    for depth in reversed(range(NEAREST)):
        points = F.when(F.get(ours, F.lit(depth)) == F.get(theirs, F.lit(depth)), points).otherwise(15 * depth)
    return points


def leading_parts(parts: Column) -> Column:
    """(depth, path) of the leading 0 to NEAREST folders."""
    return F.transform(F.sequence(F.lit(0), F.least(F.size(parts), F.lit(NEAREST))), lambda d: F.struct(d.alias("depth"), F.array_join(F.slice(parts, F.lit(1), d), "/").alias("path")))


def node_id(path: Column, kind: Column, name: Column, line: Column) -> Column:
    """kind and the first 32 hex digits of the SHA-256 of path:kind:name:line."""
    return F.concat(kind, F.lit(":"), F.substring(F.sha2(F.concat_ws(":", path, kind, name, line.cast("string")), 256), 1, 32))
