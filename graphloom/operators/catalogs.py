"""Derived catalogs: execution flows and file clusters."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.columns import base_name, folder

# Flow caps.
DEPTH, WIDTH, STEPS = 12, 20, 200
PRECEDENCE = ("route", "cli", "event", "export")


def file_pair_weights(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(source_file, target_file, weight) over calls and imports between different files."""
    paths = nodes.select("id", "file_path")
    rows = edges.filter(F.col("kind").isin("calls", "imports")).join(paths.toDF("source", "source_file"), "source").join(paths.toDF("target", "target_file"), "target")
    return rows.filter("source_file <> target_file").groupBy("source_file", "target_file").agg(F.count(F.lit(1)).alias("weight"))


def file_graph(pairs: DataFrame) -> DataFrame:
    """(a, b, weight), undirected, a < b."""
    return pairs.filter("source_file <> target_file").groupBy(F.least("source_file", "target_file").alias("a"), F.greatest("source_file", "target_file").alias("b")).agg(F.sum("weight").cast("long").alias("weight"))


def _moved(near: list[dict[int, float]], degree: list[float], total: float, passes: int) -> list[int]:
    """One level: each vertex in order joins the neighbouring community with the greatest gain over staying, the lowest of equal ones, until a pass moves none."""
    home, mass = list(range(len(near))), list(degree)
    for _ in range(passes):
        changed = False
        for v, links in enumerate(near):
            around: dict[int, float] = defaultdict(float)
            for u, w in links.items():
                around[home[u]] += w
            old, pull = home[v], degree[v] / total
            mass[old] -= degree[v]
            stay = mass[old] * pull - around.get(old, 0.0)
            gains = [(stay + around[c] - mass[c] * pull, -c) for c in around]
            gain, place = max(gains, default=(0.0, 0))
            new = -place if gain > 0 else old
            mass[new] += degree[v]
            if new != old:
                home[v], changed = new, True
        if not changed:
            break
    return home


def louvain_communities(links: list[tuple[str, str, float]], files: list[str], total: float | None = None, passes: int = 100) -> dict[str, int]:
    """Deterministic modularity clustering: files in order, moves on a strictly positive gain, levels until none moves. Labels number communities by their first file.

    total: twice the weight of the whole graph, where links are a part of one
    (modularity compares with the whole); by default that of the links.
    """
    names = sorted(files)
    index = {f: i for i, f in enumerate(names)}
    near: list[dict[int, float]] = [defaultdict(float) for _ in names]
    for a, b, w in links:
        if a != b:
            near[index[a]][index[b]] += w
            near[index[b]][index[a]] += w
    inside = [0.0] * len(names)  # twice the weight within a vertex
    total = sum(sum(x.values()) for x in near) if total is None else total
    member = list(range(len(names)))
    while total:
        home = _moved(near, [own + sum(x.values()) for own, x in zip(inside, near)], total, passes)
        number = {c: k for k, c in enumerate(sorted(set(home)))}
        if len(number) == len(near):
            break
        home = [number[c] for c in home]
        member = [home[m] for m in member]
        merged: list[dict[int, float]] = [defaultdict(float) for _ in number]
        within = [0.0] * len(number)
        for v, x in enumerate(near):
            within[home[v]] += inside[v]
            for u, w in x.items():
                if home[u] == home[v]:
                    within[home[v]] += w
                else:
                    merged[home[v]][home[u]] += w
        near, inside = merged, within
    order = {c: k for k, c in enumerate(dict.fromkeys(member))}
    return {f: order[member[i]] for i, f in enumerate(names)}


def louvain(graph: DataFrame, files: DataFrame) -> DataFrame:
    """(path, community). The method is sequential within a connected part of the file graph, and parts touch each other only through the graph's total weight, so each part is one group and the result is that of the whole graph."""
    from graphloom.operators.traversal import materialise

    graph = materialise(graph, "parts")
    total = float(graph.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]) * 2
    labels = materialise(files.select("path").withColumn("part", F.col("path")), "parts")
    both = materialise(graph.select("a", "b").union(graph.select("b", "a")), "parts")
    while True:
        lower = both.join(labels.toDF("a", "part"), "a").groupBy(F.col("b").alias("path")).agg(F.min("part").alias("seen"))
        new = labels.join(lower, "path", "left").select("path", F.least("part", F.coalesce("seen", "part")).alias("part"))
        new = materialise(new.join(new.toDF("part", "next"), "part").select("path", F.col("next").alias("part")), "parts")
        if not new.join(labels.withColumnRenamed("part", "old"), "path").filter("part <> old").limit(1).count():
            break
        labels = new
    rows = graph.join(labels.toDF("a", "part"), "a").select("part", "a", "b", F.col("weight").cast("double").alias("weight"))
    alone = labels.select("part", F.col("path").alias("a"), F.lit(None).cast("string").alias("b"), F.lit(0.0).alias("weight"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        links = pdf[pdf["b"].notna()].sort_values(["a", "b"])
        found = louvain_communities(list(links[["a", "b", "weight"]].itertuples(index=False, name=None)), sorted(set(pdf["a"]) | set(links["b"])), total)
        part = pdf["part"].iloc[0]
        return pd.DataFrame({"path": list(found), "community": [f"{part}#{c}" for c in found.values()]})

    return rows.unionByName(alone).groupBy("part").applyInPandas(solve, "path string, community string")


def cluster_id(members: Column) -> Column:
    return F.concat(F.lit("cluster:"), F.substring(F.sha2(F.array_join(F.array_sort(members), "\n"), 256), 1, 16))


def cluster_labels(members: DataFrame) -> DataFrame:
    """(community, label, member_count): the commonest folder (fewest parts, then by name), and the two commonest words of file names."""
    rows = members.withColumn("dir", folder(F.col("path")))
    dirs = rows.groupBy("community", "dir").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("community").orderBy(F.desc("n"), F.size(F.split("dir", "/")), "dir")
    top = dirs.withColumn("nth", F.row_number().over(order)).filter("nth = 1").select("community", "dir")
    words = rows.select("community", F.explode(F.array_distinct(F.filter(F.split(F.lower(F.regexp_replace(base_name(F.col("path")), r"\.[^.]*$", "")), "[^a-z0-9]+"), lambda w: F.length(w) >= 2))).alias("word"))
    counted = words.groupBy("community", "word").agg(F.count(F.lit(1)).alias("n"))
    best = counted.withColumn("nth", F.row_number().over(Window.partitionBy("community").orderBy(F.desc("n"), "word"))).filter("nth <= 2")
    named = best.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "word"))), lambda s: s["word"]), "+").alias("words"))
    sizes = rows.groupBy("community").agg(F.count(F.lit(1)).alias("member_count"))
    return sizes.join(top, "community").join(named, "community", "left").select("community", F.concat_ws(":", F.when(F.col("dir") == "", ".").otherwise(F.col("dir")), "words").alias("label"), "member_count")


def cluster_overlaps(old: DataFrame, new: DataFrame) -> DataFrame:
    """(old_id, new_id, jaccard) of cluster pairs (cluster_id, path) with a common file."""
    shared = old.select(F.col("cluster_id").alias("old_id"), "path").join(new.select(F.col("cluster_id").alias("new_id"), "path"), "path").groupBy("old_id", "new_id").agg(F.count(F.lit(1)).alias("both"))
    size = lambda df, name: df.groupBy(F.col("cluster_id").alias(f"{name}_id")).agg(F.count(F.lit(1)).alias(f"{name}_n"))
    return shared.join(size(old, "old"), "old_id").join(size(new, "new"), "new_id").select("old_id", "new_id", (F.col("both") / (F.col("old_n") + F.col("new_n") - F.col("both"))).alias("jaccard"))


def transfer_identity(overlaps: DataFrame, least: float = 0.5) -> DataFrame:
    """(old_id, new_id): one to one, the largest overlap first. Pairs of at least one half are a matching already, but for ties at exactly one half, which go to the smaller ids."""
    good = overlaps.filter(F.col("jaccard") >= least)
    mine = F.row_number().over(Window.partitionBy("old_id").orderBy(F.desc("jaccard"), "new_id"))
    theirs = F.row_number().over(Window.partitionBy("new_id").orderBy(F.desc("jaccard"), "old_id"))
    return good.withColumn("a", mine).withColumn("b", theirs).filter("a = 1 AND b = 1").select("old_id", "new_id")


def entry_points(nodes: DataFrame, edges: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """(root, entry_kind): routes, entries found elsewhere (root, entry_kind), and exported functions that nothing calls; each root by its first kind."""
    called = edges.filter(F.col("kind").isin("calls", "references")).select(F.col("target").alias("id"))
    exported = nodes.filter(F.col("kind").isin("function", "method") & F.col("is_exported")).join(called, "id", "left_anti").select(F.col("id").alias("root"), F.lit("export").alias("entry_kind"))
    rows = nodes.filter("kind = 'route'").select(F.col("id").alias("root"), F.lit("route").alias("entry_kind")).unionByName(exported)
    if extra is not None:
        rows = rows.unionByName(extra.select("root", "entry_kind"))
    order = F.array_position(F.array(*[F.lit(p) for p in PRECEDENCE]), F.col("entry_kind"))
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("root").orderBy(order))).filter("nth = 1").drop("nth")


# How JavaScript and TypeScript sources name what they register.
COMMAND = r"\.command\(\s*['\"`]([^'\"`]+)['\"`]"
ACTION = r"(?s)^.*?\.action\(\s*([A-Za-z_$][\w$]*)\s*\)"
LISTENER = r"\.(?:on|once|addListener|addEventListener|subscribe)\(\s*['\"`][^'\"`]+['\"`]\s*,\s*([A-Za-z_$][\w$]*)\s*[,)]"
COMMENTS = r"(?s)/\*.*?\*/|(?m)(?<![:'\"`])//[^\n]*"


def handlers(named: DataFrame, nodes: DataFrame) -> DataFrame:
    """named (file_path, handler, ...) with the root that each name means: of the functions and methods of that name one in the same file, then by file, qualified name and id."""
    pool = nodes.filter(F.col("kind").isin("function", "method")).select(F.col("id").alias("root"), F.col("name").alias("handler"), F.col("file_path").alias("root_file"), "qualified_name")
    keys = named.columns
    order = Window.partitionBy(*keys).orderBy(F.when(F.col("root_file") == F.col("file_path"), 0).otherwise(1), "root_file", "qualified_name", "root")
    return named.join(pool, "handler").withColumn("nth", F.row_number().over(order)).filter("nth = 1").select(*keys, "root")


def registered_entries(files: DataFrame, nodes: DataFrame) -> DataFrame:
    """(root, entry_kind) of command-line actions and event listeners that sources (path, source) register by name; comments do not count, and an action belongs to the command before it."""
    plain = files.select(F.col("path").alias("file_path"), F.regexp_replace("source", COMMENTS, " ").alias("source"))
    parts = F.slice(F.split("source", COMMAND), 2, 1 << 30)
    cli = plain.filter(F.col("source").rlike(COMMAND)).select("file_path", F.explode(parts).alias("part")).select("file_path", F.regexp_extract("part", ACTION, 1).alias("handler"), F.lit("cli").alias("entry_kind"))
    event = plain.select("file_path", F.explode(F.array_distinct(F.regexp_extract_all("source", F.lit(LISTENER), F.lit(1)))).alias("handler"), F.lit("event").alias("entry_kind"))
    return handlers(cli.unionByName(event).filter("handler <> ''").distinct(), nodes).select("root", "entry_kind").distinct()


def flow_id(entry_kind: Column, path: Column, identity: Column) -> Column:
    return F.concat(F.lit("flow:"), F.substring(F.sha2(F.concat_ws("\0", entry_kind, path, identity), 256), 1, 16))


def trace_one(root: str, out: dict[str, list[tuple]], depth: int = DEPTH, width: int = WIDTH, steps: int = STEPS) -> tuple[list[tuple], dict[str, bool]]:
    """Steps (node, depth, parent, edge kind) of a depth-first walk, each node once, and which cap cut it."""
    rows, seen, cut = [], set(), {"depth": False, "width": False, "steps": False}
    stack = [(root, 0, None, None)]
    while stack:
        node, at, parent, kind = stack.pop()
        if node in seen:
            continue
        if len(rows) >= steps:
            cut["steps"] = True
            break
        seen.add(node)
        rows.append((node, at, parent, kind))
        following = [c for c in out.get(node, ()) if c[1] not in seen]
        if following and at >= depth:
            cut["depth"] = True
            continue
        if len(following) > width:
            cut["width"] = True
        stack += [(to, at + 1, node, k) for k, to in reversed(following[:width])]
    return rows, cut


def trace_flows(nodes: DataFrame, edges: DataFrame, roots: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(root, node, depth, parent, edge_kind, truncated) of every root's flow.

    The reachable edges are found by frontier joins that carry the root; each
    root's walk, whose order matters, then runs in a group of its own. A node
    hands on its first WIDTH calls and references, by file, kind and name.
    """
    from graphloom.operators.traversal import materialise

    info = nodes.select(F.col("id").alias("target"), "file_path", "qualified_name")
    rank = F.when(F.col("kind") == "calls", 0).otherwise(1)
    near = edges.filter(F.col("kind").isin("calls", "references")).select("source", "target", "kind").distinct().join(info, "target")
    order = Window.partitionBy("source").orderBy("file_path", rank, "qualified_name", "target")
    steps = materialise(near.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= 2 * WIDTH).select("source", "target", "kind", "nth"), "flow")
    frontier = materialise(roots.select("root", F.col("root").alias("node")), "flow")
    seen, walked = frontier, None
    for _ in range(depth + 1):
        edge = materialise(frontier.join(steps, F.col("node") == F.col("source")).select("root", "source", "target", "kind", "nth"), "flow")
        if not edge.limit(1).count():
            break
        walked = edge if walked is None else walked.unionByName(edge)
        frontier = materialise(edge.select("root", F.col("target").alias("node")).distinct().join(seen, ["root", "node"], "left_anti"), "flow")
        seen = seen.unionByName(frontier)
    start = roots.select("root", F.col("root").alias("source"), F.lit(None).cast("string").alias("target"), F.lit(None).cast("string").alias("kind"), F.lit(0).alias("nth"))
    rows = start if walked is None else start.unionByName(walked)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list] = defaultdict(list)
        for r in pdf[pdf["target"].notna()].sort_values(["source", "nth"]).itertuples():
            out[r.source].append((r.kind, r.target))
        root = pdf["root"].iloc[0]
        found, cut = trace_one(root, out, depth)
        said = ",".join(k for k, v in cut.items() if v)
        return pd.DataFrame([(root, *r, said) for r in found], columns=["root", "node", "depth", "parent", "edge_kind", "truncated"])

    return rows.groupBy("root").applyInPandas(walk, "root string, node string, depth int, parent string, edge_kind string, truncated string")


def catalog_state(meta: DataFrame, graph_version: int) -> DataFrame:
    """(kind, state) from (kind, computed_from_version, first_run_failed, rows): unavailable, stale, empty or available."""
    state = F.when(F.col("computed_from_version").isNull(), "unavailable").when(F.col("computed_from_version") < graph_version, "stale").when(F.col("rows") == 0, "empty").otherwise("available")
    return meta.select("kind", state.alias("state"))


