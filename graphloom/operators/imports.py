"""Import resolution as joins: module specifiers to files, imported names to exported symbols through re-exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.columns import folder
from graphloom.session import materialise

# Endings that are tried on a module path, by language and in order; conventional aliases.
EXTENSIONS = {
    "typescript": (".ts", ".tsx", ".d.ts", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js"),
    "arkts": (".ets", ".ts", ".d.ts", ".js", "/Index.ets", "/index.ets", "/index.ts", "/index.js"),
    "javascript": (".js", ".jsx", ".mjs", ".cjs", "/index.js", "/index.jsx"),
    "tsx": (".tsx", ".ts", ".d.ts", ".js", ".jsx", "/index.tsx", "/index.ts", "/index.js"),
    "jsx": (".jsx", ".js", "/index.jsx", "/index.js"),
    "svelte": (".ts", ".js", ".svelte", ".tsx", ".jsx", "/index.ts", "/index.js", "/index.svelte"),
    "vue": (".ts", ".js", ".vue", ".tsx", ".jsx", "/index.ts", "/index.js", "/index.vue"),
    "astro": (".ts", ".js", ".astro", ".tsx", ".jsx", "/index.ts", "/index.js", "/index.astro"),
    "python": (".py", "/__init__.py"),
    "go": (".go",),
    "rust": (".rs", "/mod.rs"),
    "java": (".java",),
    "c": (".h", ".c"),
    "cpp": (".h", ".hpp", ".hxx", ".cpp", ".cc", ".cxx"),
    "csharp": (".cs",),
    "php": (".php",),
    "ruby": (".rb",),
    "objc": (".h", ".m", ".mm"),
    "ocaml": (".ml", ".mli"),
    "nix": (".nix", "/default.nix"),
}
ALIASES = {"@/": "src/", "~/": "src/", "@src/": "src/", "src/": "src/", "@app/": "app/", "app/": "app/"}
REEXPORT_DEPTH = 8


def normalised(path: Column) -> Column:
    """A path without ., .. and empty parts; null where it leaves the root."""
    none = F.array().cast("array<string>")
    step = lambda kept, part: F.when(part.isin("", "."), kept).when(part == "..", F.when(F.size(kept) > 0, F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(0))))).otherwise(F.concat(kept, F.array(part)))
    return F.array_join(F.aggregate(F.split(path, "/"), none, lambda kept, part: F.when(kept.isNotNull(), step(kept, part))), "/")


def module_bases(imports: DataFrame, aliases: list[tuple[str, list[str]]] = (), workspaces: dict[str, str] | None = None) -> DataFrame:
    """imports (file_path, language, source, ...) with (base, place): the paths that a specifier may stand for, in order.

    Relative ones count from the importing file (leading dots of Python are
    package levels); others go by project aliases (patterns with one * and their
    replacements: the first that fits), workspace packages, conventional
    aliases, and as they are.
    """
    source, here = F.col("source"), folder(F.col("file_path"))
    dots = F.length(F.regexp_extract("source", r"^(\.+)", 1))
    python = F.concat_ws("/", here, F.repeat(F.lit("../"), F.greatest(dots - 1, F.lit(0))), F.replace(F.regexp_replace("source", r"^\.+", ""), F.lit("."), F.lit("/")))
    relative = F.when(F.col("language") == "python", python).otherwise(F.concat_ws("/", here, source))
    options: list[Column] = []
    aliased = F.array().cast("array<string>")
    for pattern, targets in reversed(aliases):
        before, star, after = pattern.partition("*")
        middle = F.substring(source, F.lit(len(before) + 1), F.length(source) - len(before) - len(after))
        fits = source.startswith(before) & source.endswith(after) & (F.length(source) >= len(before) + len(after)) if star else source == pattern
        aliased = F.when(fits, F.array(*[F.concat(F.lit(t.partition("*")[0]), middle, F.lit(t.partition("*")[2])) if star and "*" in t else F.lit(t) for t in targets])).otherwise(aliased)
    options.append(aliased)
    for package, place in sorted((workspaces or {}).items(), key=lambda w: -len(w[0])):
        options.append(F.when((source == package) | source.startswith(package + "/"), F.array(F.concat(F.lit(place), F.substring(source, F.lit(len(package) + 1), F.length(source))))))
    for alias, place in ALIASES.items():
        options.append(F.when(source.startswith(alias), F.array(F.concat(F.lit(place), F.substring(source, F.lit(len(alias) + 1), F.length(source))))))
    options.append(F.array(source))
    none = F.array().cast("array<string>")
    bases = F.when(source.startswith("."), F.array(relative)).otherwise(F.concat(*[F.coalesce(o, none) for o in options]))
    return imports.select("*", F.posexplode(bases).alias("place", "written")).select(*imports.columns, "place", normalised(F.col("written")).alias("base")).filter("base IS NOT NULL")


def module_files(imports: DataFrame, files: DataFrame, aliases: list[tuple[str, list[str]]] = (), workspaces: dict[str, str] | None = None) -> DataFrame:
    """imports with the file (module_path) that each specifier means; those that mean none are dropped. Of the candidates, the first base with an existing ending counts."""
    endings = F.create_map(*[x for k, v in EXTENSIONS.items() for x in (F.lit(k), F.array(*[F.lit(e) for e in (*v, "")]))])
    tried = module_bases(imports, aliases, workspaces).withColumn("ending", F.explode(F.transform(F.coalesce(endings[F.col("language")], F.array(F.lit(""))), lambda e, k: F.struct(k.alias("nth"), e.alias("text")))))
    found = tried.withColumn("path", F.concat("base", "ending.text")).join(files.select("path").distinct(), "path")
    first = Window.partitionBy("file_path", "source", "language").orderBy("place", "ending.nth", "path")
    paths = found.withColumn("nth", F.row_number().over(first)).filter("nth = 1").select("file_path", "source", "language", F.col("path").alias("module_path"))
    return imports.join(paths, ["file_path", "source", "language"])


def exported_symbols(wanted: DataFrame, nodes: DataFrame, reexports: DataFrame, depth: int = REEXPORT_DEPTH) -> DataFrame:
    """(want_id, target) for wanted (want_id, path, name): the exported symbol of a file, or of the files that it re-exports from.

    reexports: (path, module_path, kind named or wildcard, name as exported,
    original name). A file's own symbol comes first, then its named re-exports,
    then wildcards in order of module path; the walk carries its choices, and
    the first in that order wins, as a depth-first search would find it.
    """
    own = nodes.filter("is_exported").groupBy(F.col("file_path").alias("path"), "name").agg(F.min_by("id", F.struct("start_line", "id")).alias("target"))
    order = Window.partitionBy("path").orderBy(F.when(F.col("kind") == "named", 0).otherwise(1), "module_path", "name")
    onward = materialise(reexports.select("path", "module_path", "kind", F.col("name").alias("shown"), "original", F.row_number().over(order).alias("step")), "reexports")
    level = materialise(wanted.select("want_id", "path", "name", F.array().cast("array<int>").alias("way"), F.array("path").alias("seen")), "exports")
    found = None
    for _ in range(depth + 1):
        hit = materialise(level.join(own, ["path", "name"]).select("want_id", "way", "target"), "exports")
        found = hit if found is None else found.unionByName(hit)
        rest = level.join(onward, "path").filter((F.col("kind") == "wildcard") | (F.col("shown") == F.col("name")))
        rest = rest.filter(~F.array_contains("seen", F.col("module_path")))
        name = F.when(F.col("kind") == "wildcard", F.col("name")).otherwise(F.col("original"))
        onward_level = rest.select("want_id", F.col("module_path").alias("path"), name.alias("name"), F.concat("way", F.array("step")).alias("way"), F.concat("seen", F.array("module_path")).alias("seen"))
        # of the ways by which a want reaches a file under one name, the first counts
        level = materialise(onward_level.groupBy("want_id", "path", "name").agg(F.min_by("way", "way").alias("way"), F.min_by("seen", "way").alias("seen")), "exports")
        if not level.limit(1).count():
            break
    return found.groupBy("want_id").agg(F.min_by("target", "way").alias("target"))


def by_import(refs: DataFrame, imports: DataFrame, nodes: DataFrame, files: DataFrame, reexports: DataFrame, aliases: list[tuple[str, list[str]]] = (), workspaces: dict[str, str] | None = None) -> DataFrame:
    """(ref_id, target, confidence .9, resolved_by): references whose name, or its part before the first dot, was imported in their file.

    imports: (file_path, language, source, local_name, exported_name,
    is_namespace); a namespace import looks for the member instead, and a
    static member of an imported class for the method in it, where there is one.
    """
    modules = module_files(imports, files, aliases, workspaces).withColumnRenamed("language", "import_language")
    head = refs.select("ref_id", "file_path", "reference_name", F.substring_index("reference_name", ".", 1).alias("local_name"), F.regexp_extract("reference_name", r"\.(.+)$", 1).alias("member"))
    asked = head.join(modules, ["file_path", "local_name"]).filter("NOT is_namespace OR member <> ''")
    ranked = asked.withColumn("nth", F.row_number().over(Window.partitionBy("ref_id").orderBy("source"))).filter("nth = 1")
    wanted = materialise(ranked.select(F.col("ref_id").alias("want_id"), F.col("module_path").alias("path"), F.when(F.col("is_namespace"), F.col("member")).otherwise(F.col("exported_name")).alias("name"), F.when(~F.col("is_namespace"), F.col("member")).otherwise("").alias("rest")), "wanted")
    symbols = exported_symbols(wanted, nodes, reexports).join(wanted.select("want_id", "rest"), "want_id")
    places = nodes.select(F.col("id").alias("target"), "file_path", "qualified_name")
    members = nodes.filter("kind = 'method'").select(F.col("id").alias("member_id"), "file_path", F.col("qualified_name").alias("member_name"), F.col("name").alias("rest"))
    static = symbols.filter("rest <> ''").join(places, "target").join(members, ["file_path", "rest"]).filter((F.col("member_name") == F.concat("qualified_name", F.lit("::"), "rest")) | (F.col("member_name") == F.concat("qualified_name", F.lit("."), "rest")))
    static = static.groupBy("want_id").agg(F.min("member_id").alias("member_id"))
    out = symbols.join(static, "want_id", "left")
    return out.select(F.col("want_id").alias("ref_id"), F.coalesce("member_id", "target").alias("target"), F.lit(0.9).alias("confidence"), F.lit("import").alias("resolved_by"))

