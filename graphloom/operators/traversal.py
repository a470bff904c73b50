"""Graph traversal by frontier joins.

The edges of one direction are written once, bucketed by the end that a walk
comes from. A level joins the frontier with them (a small frontier is broadcast,
a large one is shuffled alone), drops what has been seen by an anti-join, and is
written to the shared folder, so neither the plan nor the visited set grows on
the driver. Depths are true distances.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.columns import CALL_KINDS, CONTAINER_KINDS, HIERARCHY_KINDS, RANK_KINDS, edge_rank
from graphloom.session import bucketed, materialise, spread

UNBOUNDED = 1 << 20


def adjacency(edges: DataFrame, direction: str, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """(at, to, edge_id, kind) in the direction asked for."""
    if kinds:
        edges = edges.filter(F.col("kind").isin(*kinds))
    out = edges.select(F.col("source").alias("at"), F.col("target").alias("to"), "edge_id", "kind")
    back = edges.select(F.col("target").alias("at"), F.col("source").alias("to"), "edge_id", "kind")
    return {"outgoing": out, "incoming": back, "both": out.unionByName(back)}[direction]


def reach(edges: DataFrame, roots: DataFrame, direction: str = "outgoing", kinds: tuple[str, ...] | None = None, max_depth: int = UNBOUNDED, enter: DataFrame | None = None, stop: DataFrame | None = None) -> DataFrame:
    """(id, depth) of everything within max_depth of roots (id).

    enter: the ids that may be entered; stop: ids that are kept but not expanded.
    """
    steps = bucketed(adjacency(edges, direction, kinds).select("at", "to"), "at", "steps")  # parallel steps are told apart by no level
    enter = materialise(enter.select("id"), "enter") if enter is not None and max_depth > 1 else enter
    seen = materialise(roots.select("id").distinct().withColumn("depth", F.lit(0)), "reach")
    frontier, depth = seen, 0
    while depth < max_depth:
        at = frontier.select(F.col("id").alias("at"))
        if stop is not None:
            at = at.join(stop.select(F.col("id").alias("at")), "at", "left_anti")
        new = steps.join(at, "at").select(F.col("to").alias("id")).distinct()
        if enter is not None:
            new = new.join(enter.select("id"), "id", "left_semi")
        depth += 1
        new = materialise(new.join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(depth)), "reach")
        if not new.limit(1).count():
            break
        seen, frontier = seen.unionByName(new), new
    return seen


def bfs_subgraph(nodes: DataFrame, edges: DataFrame, root: str, direction: str = "outgoing", kinds: tuple[str, ...] | None = None, node_kinds: tuple[str, ...] | None = None, max_depth: int = UNBOUNDED, limit: int | None = None, include_start: bool = True) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, depth) and edges of a bounded breadth-first search.

    An edge is kept if it was walked from an expanded node to a kept one;
    parallel edges stay. limit keeps the first nodes by depth, then id. A
    missing root gives nothing.
    """
    enter = nodes.filter(F.col("kind").isin(*node_kinds)).select("id") if node_kinds else nodes.select("id")
    kept = reach(edges, nodes.filter(F.col("id") == root).select("id"), direction, kinds, max_depth, enter)
    if limit is not None:
        kept = materialise(kept.orderBy("depth", "id").limit(limit), "bfs")
    walked = adjacency(edges, direction, kinds).join(kept.filter(F.col("depth") < max_depth).select(F.col("id").alias("at")), "at", "left_semi")
    ids = walked.join(kept.select(F.col("id").alias("to")), "to", "left_semi").select("edge_id").distinct()
    shown = kept if include_start else kept.filter(F.col("depth") > 0)
    return shown, edges.join(ids, "edge_id", "left_semi")


def dfs_subgraph(nodes: DataFrame, edges: DataFrame, root: str, max_depth: int = UNBOUNDED, limit: int = 1000) -> DataFrame:
    """(id, parent_edge, position) in depth-first preorder over outgoing edges, by (rank, edge_id).

    The order is sequential, so the walk runs in one group over the first
    `limit` nodes that a breadth-first search reaches.
    """
    kept, walked = bfs_subgraph(nodes, edges, root, "outgoing", None, None, max_depth, limit)

    def walk(pdf):
        import pandas as pd

        out: dict[str, list] = {}
        for e in pdf.sort_values(["rank", "edge_id"]).itertuples():
            if e.target:
                out.setdefault(e.source, []).append((e.target, e.edge_id))
        seen, order, stack = set(), [], [(root, None, 0)]
        while stack:
            node, via, depth = stack.pop()
            if node in seen:
                continue
            seen.add(node)
            order.append((node, via, len(order)))
            if depth < max_depth:
                stack += [(t, e, depth + 1) for t, e in reversed(out.get(node, ())) if t not in seen]
        return pd.DataFrame(order, columns=["id", "parent_edge", "position"])

    walked = walked.select("source", "target", "edge_id", edge_rank().alias("rank"))
    start = kept.filter("depth = 0").select(F.col("id").alias("source"), F.lit(None).cast("string").alias("target"), F.lit(-1).cast("long").alias("edge_id"), F.lit(0).alias("rank"))
    return walked.unionByName(start).groupBy(F.lit(1).alias("one")).applyInPandas(walk, "id string, parent_edge long, position int")


def neighbours(edges: DataFrame, node: str, direction: str, kinds: tuple[str, ...] = CALL_KINDS) -> DataFrame:
    """(id, edge_id): each direct neighbour once, by its first edge."""
    return adjacency(edges.filter((F.col("target") if direction == "incoming" else F.col("source")) == node), direction, kinds).groupBy(F.col("to").alias("id")).agg(F.min("edge_id").alias("edge_id"))


def callers(edges: DataFrame, roots: DataFrame, max_depth: int = 1) -> DataFrame:
    """(id, depth) of callers within max_depth, roots left out. A depth-limited walk that marks nodes when first met may miss nodes that a shorter way reaches; these are true distances."""
    return reach(edges, roots, "incoming", CALL_KINDS, max_depth).filter("depth > 0")


def callees(edges: DataFrame, roots: DataFrame, max_depth: int = 1) -> DataFrame:
    return reach(edges, roots, "outgoing", CALL_KINDS, max_depth).filter("depth > 0")


def call_graph(edges: DataFrame, root: DataFrame, depth: int = 2) -> DataFrame:
    """(id, role, depth): the root, its callers and its callees."""
    return root.select("id", F.lit("focal").alias("role"), F.lit(0).alias("depth")).unionByName(callers(edges, root, depth).select("id", F.lit("caller").alias("role"), "depth")).unionByName(callees(edges, root, depth).select("id", F.lit("callee").alias("role"), "depth"))


def reach_by_doubling(edges: DataFrame, roots: DataFrame, direction: str, kinds: tuple[str, ...], max_depth: int = UNBOUNDED) -> DataFrame:
    """(id, depth) of everything that roots (id) reach within max_depth along long, narrow relations, in a number of rounds that grows with the logarithm of the depth: each round takes what has been reached as many steps further as it is deep, and squares the steps."""
    seen = materialise(roots.select("id").distinct().withColumn("depth", F.lit(0)), "double")
    hop, width = bucketed(adjacency(edges, direction, kinds).select("at", "to").distinct(), "at", "hop"), 1
    while width <= max_depth:  # what is less deep than width has been seen
        further = seen.join(hop, F.col("id") == F.col("at")).groupBy(F.col("to").alias("id")).agg((F.min("depth") + width).alias("depth"))
        new = materialise(further.join(seen.select("id"), "id", "left_anti"), "double")
        if not new.limit(1).count():
            break
        seen = materialise(seen.unionByName(new), "double")
        hop = bucketed(hop.join(hop.select(F.col("at").alias("to"), F.col("to").alias("end")), "to").select("at", F.col("end").alias("to")).distinct(), "at", "hop")
        width *= 2
    return seen.filter(F.col("depth") <= max_depth)


def type_hierarchy(edges: DataFrame, root: DataFrame, ancestors_only: bool = False, max_depth: int = UNBOUNDED) -> DataFrame:
    """(id, role, depth) along extends and implements, whole unless max_depth is given. ancestors_only leaves descendants out, as results did where one visited set was shared."""
    up = reach_by_doubling(edges, root, "outgoing", HIERARCHY_KINDS, max_depth).select("id", F.when(F.col("depth") == 0, "focal").otherwise("ancestor").alias("role"), "depth")
    if ancestors_only:
        return up
    return up.unionByName(reach_by_doubling(edges, root, "incoming", HIERARCHY_KINDS, max_depth).filter("depth > 0").select("id", F.lit("descendant").alias("role"), "depth"))


def impact(nodes: DataFrame, edges: DataFrame, roots: DataFrame, max_depth: int = 3) -> DataFrame:
    """(id, depth): what a change reaches. Incoming edges other than contains cost one; children of containers cost nothing, and are taken before each step; nodes at max_depth are not expanded."""
    containers = nodes.filter(F.col("kind").isin(*CONTAINER_KINDS)).select("id")
    down = edges.filter("kind = 'contains'").join(containers.withColumnRenamed("id", "source"), "source", "left_semi").select(F.col("source").alias("at"), F.col("target").alias("to"))
    down = bucketed(down.distinct(), "at", "down")
    up = bucketed(edges.filter("kind <> 'contains'").select(F.col("target").alias("at"), F.col("source").alias("to")).distinct(), "at", "up")
    seen = materialise(roots.select("id").distinct().withColumn("depth", F.lit(0)), "impact")
    frontier = seen
    for depth in range(max_depth):
        inner = frontier
        while True:
            new = down.join(inner.select(F.col("id").alias("at")), "at").select(F.col("to").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
            new = materialise(new.withColumn("depth", F.lit(depth)), "impact")
            if not new.limit(1).count():
                break
            seen, frontier, inner = seen.unionByName(new), frontier.unionByName(new), new
        new = up.join(frontier.select(F.col("id").alias("at")), "at").select(F.col("to").alias("id")).distinct().join(seen.select("id"), "id", "left_anti")
        frontier = materialise(new.withColumn("depth", F.lit(depth + 1)), "impact")
        if not frontier.limit(1).count():
            break
        seen = seen.unionByName(frontier)
    return seen


def shortest_path(edges: DataFrame, start: str, goal: str, kinds: tuple[str, ...] | None = None, max_depth: int = 64) -> DataFrame:
    """(step, id, edge_id) of a shortest outgoing path: each node is reached by the lowest edge id among its shortest ways. No rows if there is none."""
    spark = edges.sparkSession
    steps = bucketed(adjacency(edges, "outgoing", kinds).select("at", "to", "edge_id"), "at", "steps")
    levels = [materialise(spark.createDataFrame([(start, None)], "id string, edge_id long"), "path")]
    seen, found = levels[0].select("id"), start == goal
    while not found and len(levels) <= max_depth:
        new = steps.join(levels[-1].select(F.col("id").alias("at")), "at").groupBy(F.col("to").alias("id")).agg(F.min("edge_id").alias("edge_id"))
        new = materialise(new.join(seen, "id", "left_anti"), "path")
        if not new.limit(1).count():
            break
        levels.append(new)
        seen, found = seen.unionByName(new.select("id")), bool(new.filter(F.col("id") == goal).limit(1).count())
    schema = "step int, id string, edge_id long"
    if not found:
        return spark.createDataFrame([], schema)
    rows, at = [], goal
    for step in range(len(levels) - 1, -1, -1):
        via = levels[step].filter(F.col("id") == at).first()["edge_id"]
        rows.append((step, at, via))
        if via is not None:
            at = steps.filter(F.col("edge_id") == via).first()["at"]
    return spark.createDataFrame(rows, schema)


def ancestors(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, ancestor, distance): containers of each root, nearest first; the first incoming contains edge counts, cycles end."""
    parent = bucketed(edges.filter("kind = 'contains'").groupBy(F.col("target").alias("at")).agg(F.min_by("source", "edge_id").alias("up")), "at", "parent")
    level = materialise(roots.select("id", F.col("id").alias("at")).distinct(), "ancestors")
    out, distance = None, 0
    while True:
        distance += 1
        step = level.join(parent, "at").select("id", F.col("up").alias("ancestor"), F.lit(distance).alias("distance")).filter("ancestor <> id")
        if out is not None:
            step = step.join(out.select("id", "ancestor"), ["id", "ancestor"], "left_anti")
        step = materialise(step, "ancestors")
        if distance > 1 and not step.limit(1).count():
            return out
        out = step if out is None else out.unionByName(step)
        level = step.select("id", F.col("ancestor").alias("at"))


def children(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    ids = edges.filter((F.col("kind") == "contains") & (F.col("source") == node)).select(F.col("target").alias("id")).distinct()
    return nodes.join(ids, "id", "left_semi")


def usages(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """(edge_id, kind, line, source, source_name, source_file) of every incoming edge, contains too."""
    return edges.filter(F.col("target") == node).join(nodes.select(F.col("id").alias("source"), F.col("name").alias("source_name"), F.col("file_path").alias("source_file")), "source").select("edge_id", "kind", "line", "source", "source_name", "source_file")


def node_metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Degrees of every node: out, in, calls made, callers, children."""
    made = edges.groupBy(F.col("source").alias("id")).agg(F.count(F.lit(1)).alias("out_degree"), F.count_if(F.col("kind") == "calls").alias("call_count"), F.count_if(F.col("kind") == "contains").alias("child_count"))
    had = edges.groupBy(F.col("target").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"), F.count_if(F.col("kind") == "calls").alias("caller_count"))
    return nodes.select("id").join(made, "id", "left").join(had, "id", "left").na.fill(0)


def dead_code(nodes: DataFrame, edges: DataFrame, kinds: tuple[str, ...] = ("function", "method", "class")) -> DataFrame:
    """Nodes of the kinds that are not exported and that nothing but a container points to."""
    used = edges.filter("kind <> 'contains'").select(F.col("target").alias("id"))
    return nodes.filter(F.col("kind").isin(*kinds) & ~F.col("is_exported")).join(used, "id", "left_anti")


def file_dependencies(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(source_file, target_file): distinct pairs of different files with an edge other than contains."""
    paths = nodes.select("id", "file_path")
    links = edges.filter("kind <> 'contains'").select("source", "target")
    both = links.join(paths.toDF("source", "source_file"), "source").join(paths.toDF("target", "target_file"), "target")
    return both.filter("source_file <> target_file").select("source_file", "target_file").distinct()


def affected_tests(dependencies: DataFrame, changed: DataFrame, is_test, max_depth: int = 5) -> DataFrame:
    """(path, depth): test files within max_depth dependents of changed files; a test file is not expanded, a changed one counts itself."""
    edges = dependencies.select(F.col("source_file").alias("source"), F.col("target_file").alias("target"), F.lit("file").alias("kind"), F.lit(0).alias("edge_id"))
    paths = dependencies.select(F.col("source_file").alias("id")).union(dependencies.select("target_file")).union(changed.select("id")).distinct()
    tests = materialise(paths.filter(is_test(F.col("id"))), "tests")
    seen = reach(edges, changed, "incoming", None, max_depth, stop=tests)
    return seen.join(tests, "id", "left_semi").select(F.col("id").alias("path"), "depth")


def circular_files(dependencies: DataFrame) -> DataFrame:
    """(path, component): files on a dependency cycle; component is the smallest path of the strongly connected component.

    Files that no cycle can hold are trimmed first (nothing in or nothing
    out, again and again); then the smallest path that reaches a file forwards
    and backwards colours it, and files whose two colours agree are settled.
    """
    links = materialise(dependencies.filter("source_file <> target_file").distinct(), "scc")
    out = None
    while links.limit(1).count():
        while True:
            alive = links.select(F.col("source_file").alias("p")).intersect(links.select("target_file"))
            trimmed = materialise(links.join(alive.toDF("source_file"), "source_file", "left_semi").join(alive.toDF("target_file"), "target_file", "left_semi").select("source_file", "target_file"), "scc")
            done, links = trimmed.count() == links.count(), trimmed
            if done:
                break
        if not links.limit(1).count():
            break
        colour = materialise(links.select(F.col("source_file").alias("path")).distinct().withColumn("colour", F.col("path")), "scc")
        while True:
            lower = links.join(colour.withColumnRenamed("path", "source_file"), "source_file").select(F.col("target_file").alias("path"), "colour")
            new = materialise(colour.unionByName(lower).groupBy("path").agg(F.min("colour").alias("colour")), "scc")
            if not new.join(colour.withColumnRenamed("colour", "old"), "path").filter("colour <> old").limit(1).count():
                break
            colour = new
        owner = materialise(colour.filter("path = colour"), "scc")
        same = links.join(colour.toDF("source_file", "a"), "source_file").join(colour.toDF("target_file", "b"), "target_file").filter("a = b")
        back = same.select(F.col("target_file").alias("source"), F.col("source_file").alias("target"), F.lit("file").alias("kind"), F.lit(0).alias("edge_id"))
        inside = reach(back, owner.select(F.col("path").alias("id")), "outgoing").select(F.col("id").alias("path"))
        settled = materialise(inside.join(colour, "path").select("path", F.col("colour").alias("component")), "scc")
        out = settled if out is None else out.unionByName(settled)
        gone = settled.select("path")
        links = materialise(links.join(gone.toDF("source_file"), "source_file", "left_anti").join(gone.toDF("target_file"), "target_file", "left_anti").select("source_file", "target_file"), "scc")
    if out is None:
        return dependencies.sparkSession.createDataFrame([], "path string, component string")
    sizes = out.groupBy("component").count().filter("count > 1").select("component")
    return out.join(sizes, "component", "left_semi").select("path", "component")


def random_walk(edges: DataFrame, ids: DataFrame, seeds: DataFrame, restart: float = 0.25, rounds: int = 25, cut_every: int = 2) -> DataFrame:
    """(id, score): random walk with restart over the undirected rank edges between ids; parallel edges count each, a node without edges keeps its mass. A round reads the scores twice, so they are written every other round."""
    known = materialise(ids.select("id").distinct(), "walk")
    links = edges.filter(F.col("kind").isin(*RANK_KINDS)).select("source", "target").join(known.toDF("source"), "source", "left_semi").join(known.toDF("target"), "target", "left_semi")
    links = materialise(links.select("source", "target").union(links.select(F.col("target").alias("source"), F.col("source").alias("target"))), "walk")
    degree = links.groupBy("source").agg(F.count(F.lit(1)).alias("degree"))
    chosen = seeds.select("id").distinct().join(known, "id", "left_semi")
    n = chosen.count()
    start = chosen.withColumn("start", F.lit(1.0 / n)) if n else known.withColumn("start", F.lit(1.0 / max(1, known.count())))
    base = materialise(known.join(start, "id", "left").na.fill(0.0).join(degree.withColumnRenamed("source", "id"), "id", "left"), "walk")
    score = base.select("id", F.col("start").alias("score"))
    for k in range(rounds):
        held = base.join(score, "id")
        moved = links.join(held.filter("degree IS NOT NULL").select(F.col("id").alias("source"), (F.col("score") / F.col("degree")).alias("share")), "source").groupBy(F.col("target").alias("id")).agg(F.sum("share").alias("came"))
        score = held.join(moved, "id", "left").select("id", (restart * F.col("start") + (1 - restart) * (F.coalesce("came", F.lit(0.0)) + F.when(F.col("degree").isNull(), F.col("score")).otherwise(0.0))).alias("score"))
        if k % cut_every == cut_every - 1:
            score = materialise(score, "walk")
    return score


def bounded_adjacency(edges: DataFrame, node: str, direction: str, limit: int, kinds: tuple[str, ...] | None = None) -> DataFrame:
    """The first edges at a node: contains, calls, others, then by id; a self-loop once."""
    at: Column = {"outgoing": F.col("source") == node, "incoming": F.col("target") == node, "both": (F.col("source") == node) | (F.col("target") == node)}[direction]
    if kinds:
        at = at & F.col("kind").isin(*kinds)
    return edges.filter(at).orderBy(edge_rank(), "edge_id").limit(limit)


def first_edges(edges: DataFrame, side: str, limit: int) -> DataFrame:
    """Of every node's edges on one side, the first `limit` by id."""
    return spread(edges, side).withColumn("nth", F.row_number().over(Window.partitionBy(side).orderBy("edge_id"))).filter(F.col("nth") <= limit)
