"""Point lookups, filters and pages over nodes, edges, files and references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from graphloom.functions.columns import glob_regex, is_low_value_file


def nodes_by_ids(nodes: DataFrame, ids: list[str]) -> DataFrame:
    return nodes.filter(F.col("id").isin(*ids))


def nodes_in_file(nodes: DataFrame, path: str) -> DataFrame:
    return nodes.filter(F.col("file_path") == path).orderBy("start_line", "id")


def name_substring(nodes: DataFrame, part: str, limit: int = 30, exclude_prefix: bool = False) -> DataFrame:
    """Names that contain the part, whatever the case of ASCII letters; shortest first."""
    low = F.lower("name")
    hit = low.contains(part.lower())
    if exclude_prefix:
        hit = hit & ~low.startswith(part.lower())
    return nodes.filter(hit).orderBy(F.length("name"), "id").limit(limit)


def exact_names(nodes: DataFrame, names: list[str], limit: int = 50, boost: float = 20.0) -> DataFrame:
    """Nodes with one of the names (any case), scored 1, and 20 more in files that hold one of the names found in fewer than ten files. Each name keeps max(8, limit / names) rows."""
    low = F.lower("name")
    hits = nodes.filter(low.isin(*[n.lower() for n in names])).withColumn("low", low)
    files = hits.groupBy("low").agg(F.countDistinct("file_path").alias("n")).filter("n < 10").select("low")
    distinctive = hits.join(files, "low", "left_semi").select("file_path").distinct().withColumn("near", F.lit(boost))
    scored = hits.join(distinctive, "file_path", "left").withColumn("score", 1.0 + F.coalesce("near", F.lit(0.0)))
    keep = max(8, -(-limit // len(names)))
    ranked = scored.withColumn("nth", F.row_number().over(Window.partitionBy("low").orderBy(F.desc("score"), "id"))).filter(F.col("nth") <= keep)
    return ranked.orderBy(F.desc("score"), "id").limit(limit)


def gate(df: DataFrame, paths: list[str] = (), names: list[str] = ()) -> DataFrame:
    """Hard gates: any of the paths and any of the names, as substrings of any case."""
    any_of = lambda c, parts: reduce(lambda a, b: a | b, [F.lower(c).contains(p.lower()) for p in parts])
    if paths:
        df = df.filter(any_of("file_path", paths))
    return df.filter(any_of("name", names)) if names else df


def by_qualified_glob(nodes: DataFrame, pattern: str, kinds: tuple[str, ...] = ("class", "function", "method", "interface", "type_alias", "variable", "constant")) -> DataFrame:
    return nodes.filter(F.col("kind").isin(*kinds) & F.col("qualified_name").rlike(glob_regex(pattern)))


def at_location(nodes: DataFrame, path: str, line: int, column: int | None = None) -> DataFrame:
    """Nodes that cover a place, the narrowest first."""
    inside = (F.col("file_path") == path) & (F.col("start_line") <= line) & (F.col("end_line") >= line)
    if column is not None:
        inside = inside & ((F.col("start_line") < line) | (F.col("start_column") <= column)) & ((F.col("end_line") > line) | (F.col("end_column") >= column))
    return nodes.filter(inside).orderBy(F.col("end_line") - F.col("start_line"), F.col("end_column") - F.col("start_column"), F.desc(F.length("name")), "id")


def edges_between(edges: DataFrame, ids: DataFrame, kinds: tuple[str, ...] | None = None) -> DataFrame:
    if kinds:
        edges = edges.filter(F.col("kind").isin(*kinds))
    return edges.join(ids.select(F.col("id").alias("source")), "source", "left_semi").join(ids.select(F.col("id").alias("target")), "target", "left_semi")


def incoming_page(edges: DataFrame, target: str, after: tuple[str, int] | None, size: int) -> DataFrame:
    """One page of (kind, edge_id) after a cursor, and one row more that says whether there is a next page."""
    page = edges.filter((F.col("target") == target) & (F.col("kind") != "contains") & F.coalesce(F.col("provenance") != "heuristic", F.lit(True)))
    if after:
        page = page.filter((F.col("kind") > after[0]) | ((F.col("kind") == after[0]) & (F.col("edge_id") > after[1])))
    return page.orderBy("kind", "edge_id").limit(size + 1)


def unique_at(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that are alone with their keys."""
    return rows.withColumn("alone", F.count(F.lit(1)).over(Window.partitionBy(*keys))).filter("alone = 1").drop("alone")


def name_tail(name: Column) -> Column:
    """What follows the last dot or colon of a reference."""
    return F.regexp_extract(name, r"[^.:]*$", 0)


def retryable(failed: DataFrame, names: DataFrame, most: int = 500) -> DataFrame:
    """Failed references whose tail is a known name, but for tails with more than `most` failures."""
    rare = failed.groupBy("name_tail").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= most).select("name_tail")
    return failed.join(rare, "name_tail", "left_semi").join(names.select(F.col("name").alias("name_tail")), "name_tail", "left_semi")


def stale_files(stored: DataFrame, seen: DataFrame) -> DataFrame:
    """Paths whose content hash differs between two listings (path, content_hash)."""
    return stored.select("path", F.col("content_hash").alias("was")).join(seen, "path").filter("was <> content_hash").select("path")


def inner_edge_counts(nodes: DataFrame, edges: DataFrame, most: int = 20) -> DataFrame:
    """(file_path, edge_count) of the `most` files with most edges within them, without those of low value among these."""
    places = nodes.select("id", "file_path")
    inside = edges.join(places.toDF("source", "file_path"), "source").join(places.toDF("target", "target_file"), "target").filter("file_path = target_file")
    top = inside.groupBy("file_path").agg(F.count(F.lit(1)).alias("edge_count")).orderBy(F.desc("edge_count"), "file_path").limit(most)
    return top.filter(~is_low_value_file(F.col("file_path")))


def dominant_file(nodes: DataFrame, edges: DataFrame, most: int = 20, least: int = 20) -> DataFrame:
    """(file_path, edge_count, next_edge_count) of the file with most edges within it: of the first `most` files those of low value go, and the first that is left needs `least` edges; no row otherwise."""
    order = Window.orderBy(F.desc("edge_count"), "file_path")  # over `most` rows
    left = inner_edge_counts(nodes, edges, most).select("file_path", "edge_count", F.coalesce(F.lead("edge_count").over(order), F.lit(0)).alias("next_edge_count"), F.row_number().over(order).alias("nth"))
    return left.filter((F.col("nth") == 1) & (F.col("edge_count") >= least)).drop("nth")


def top_route_file(nodes: DataFrame, kind: str = "route", most: int = 20, least: int = 3, share: float = 0.3) -> DataFrame:
    """(file_path, routes, total) of the file with most routes, if it has `least` and that share of those in the first `most` files without the ones of low value."""
    top = nodes.filter(F.col("kind") == kind).groupBy("file_path").agg(F.count(F.lit(1)).alias("routes")).orderBy(F.desc("routes"), "file_path").limit(most)
    left = top.filter(~is_low_value_file(F.col("file_path"))).withColumn("total", F.sum("routes").over(Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))  # over `most` rows
    return left.orderBy(F.desc("routes"), "file_path").limit(1).filter((F.col("total") >= least) & (F.col("routes") >= least) & (F.col("routes") >= share * F.col("total")))


def totals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: how many nodes, files and edges there are, and the largest edge id."""
    one = nodes.agg(F.count(F.lit(1)).alias("nodes"), F.countDistinct("file_path").alias("files"))
    two = edges.agg(F.count(F.lit(1)).alias("edges"), F.max("edge_id").alias("last_edge"))
    return one.select("*", F.lit(None).cast("long").alias("edges"), F.lit(None).cast("long").alias("last_edge")).unionByName(two.select(F.lit(None).cast("long").alias("nodes"), F.lit(None).cast("long").alias("files"), "edges", "last_edge")).agg(*[F.max(c).alias(c) for c in ("nodes", "files", "edges", "last_edge")])


def routing_manifest(nodes: DataFrame, edges: DataFrame, kind: str = "route", limit: int = 40, least: int = 3) -> DataFrame:
    """(url, handler, handler_file, handler_line, handler_kind, in_file, top_file) of the first `limit` routes by file and line and what they refer to or call; handlers in files of low value go. No rows below `least`. in_file: handlers of the list in the file; top_file: whether it has most, and of such files the first."""
    routes = nodes.filter(F.col("kind") == kind).select(F.col("id").alias("source"), F.col("name").alias("url"), F.col("file_path").alias("route_file"), F.col("start_line").alias("route_line"))
    handlers = nodes.filter(F.col("kind").isin("function", "method", "class")).select(F.col("id").alias("target"), F.col("name").alias("handler"), F.col("file_path").alias("handler_file"), F.col("start_line").alias("handler_line"), F.col("kind").alias("handler_kind"))
    place = ("route_file", "route_line", "source", "edge_id")
    first = edges.filter("kind IN ('references', 'calls')").select("source", "target", "edge_id").join(routes, "source").join(handlers, "target").orderBy(*place).limit(limit)
    everything = Window.orderBy(*place)  # over `limit` rows
    whole = everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = first.filter(~is_low_value_file(F.col("handler_file"))).withColumn("in_file", F.count(F.lit(1)).over(Window.partitionBy("handler_file"))).withColumn("total", F.count(F.lit(1)).over(whole))
    ranked = left.withColumn("nth", F.row_number().over(everything))
    top = F.first("handler_file").over(Window.orderBy(F.desc("in_file"), "nth").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return ranked.withColumn("top_file", F.col("handler_file") == top).filter(F.col("total") >= least).select("url", "handler", "handler_file", "handler_line", "handler_kind", "in_file", "top_file")


def definitions(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, definition) of import and export nodes: what their first such edge leads to; nodes without one are dropped."""
    first = edges.filter("kind IN ('imports', 'exports')").groupBy(F.col("source").alias("id")).agg(F.min_by("target", "edge_id").alias("definition"))
    return nodes.select("id").join(first, "id")
